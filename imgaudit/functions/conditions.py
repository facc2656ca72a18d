"""Evaluation conditions: single transforms by family and severity, and chains of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import pick, stable_seed

# The conditions that robustness is measured under.
TRANSFORMS = [
    ("jpeg", "q90", 90.0),
    ("jpeg", "q70", 70.0),
    ("jpeg", "q50", 50.0),
    ("jpeg", "q30", 30.0),
    ("blur", "sigma0.5", 0.5),
    ("blur", "sigma1.0", 1.0),
    ("blur", "sigma2.0", 2.0),
    ("resize", "scale0.5", 0.5),
    ("resize", "scale0.25", 0.25),
    ("noise", "sigma0.02", 0.02),
    ("noise", "sigma0.05", 0.05),
    ("noise", "sigma0.10", 0.10),
    ("jitter", "amount0.20", 0.20),
    ("crop", "ratio0.80", 0.80),
]
REPRESENTATIVE = ["jpeg_q50", "blur_sigma1.0", "resize_scale0.5", "noise_sigma0.05", "jitter_amount0.20", "crop_ratio0.80"]
CHAINS = {
    "chain_moderate_reupload": [("resize", 0.5), ("jitter", 0.20), ("sharpen", 1.4), ("jpeg", 70.0)],
    "chain_heavy_reupload": [("crop", 0.80), ("resize", 0.25), ("blur", 0.5), ("sharpen", 1.6), ("jpeg", 50.0)],
    "chain_noisy_reupload": [("resize", 0.5), ("noise", 0.02), ("sharpen", 1.3), ("jpeg", 70.0)],
}


def condition_table(spark: SparkSession) -> DataFrame:
    """condition, family, severity, kind, steps for clean, all transforms and all chains (18 rows)."""
    steps = "array<struct<family:string,value:double>>"
    rows = [("clean", "clean", "none", "clean", [])]
    rows += [(f"{f}_{s}", f, s, "individual_transform", [(f, v)]) for f, s, v in TRANSFORMS]
    rows += [(k, "chain", k.removeprefix("chain_"), "platform_style_chain", v) for k, v in CHAINS.items()]
    return spark.createDataFrame(rows, f"condition string, family string, severity string, kind string, steps {steps}")


def representative_conditions(spark: SparkSession) -> DataFrame:
    """One severity of each family."""
    return condition_table(spark).where(F.col("condition").isin(REPRESENTATIVE))


def family(condition: Column) -> Column:
    return F.substring_index(condition, "_", 1)


def severity(condition: Column) -> Column:
    return F.when(condition == "clean", "none").otherwise(F.regexp_extract(condition, "^[^_]*_(.*)$", 1))


def kind(condition: Column) -> Column:
    return F.when(condition == "clean", "clean").when(condition.startswith("chain_"), "platform_style_chain").otherwise("individual_transform")


def unknown_conditions(rows: DataFrame) -> DataFrame:
    """Rows whose condition is not in the table."""
    return rows.join(F.broadcast(condition_table(rows.sparkSession).select("condition")), "condition", "left_anti")


def training_condition(seed: int, image_id: Column) -> Column:
    """One transform for each image: a family, then a severity in it, both by stable seeds."""
    families = sorted({f for f, _, _ in TRANSFORMS})
    chosen = pick(families, stable_seed(seed, image_id, F.lit("family")))
    out = F.lit(None).cast("string")
    for name in families:
        keys = [f"{f}_{s}" for f, s, _ in TRANSFORMS if f == name]
        out = F.when(chosen == name, pick(keys, stable_seed(seed, image_id, F.lit(name)))).otherwise(out)
    return out


def expand_conditions(images: DataFrame, seed: int) -> DataFrame:
    """Every image under every condition, with the seed of that view; 18 rows an image."""
    table = condition_table(images.sparkSession).select("condition", "steps")
    return images.crossJoin(F.broadcast(table)).withColumn("seed", stable_seed(seed, F.col("image_id"), F.col("condition")))
