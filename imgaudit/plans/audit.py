"""Whole audits of one long table of scores: (dataset, condition, image_id, label, prob, margin[, source])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, probe, resampling, sampling


def score_audit(scored: DataFrame, threshold: float, keys: list[str] | None = None, replicates: int = 5000, seed: int = 0, per_class: int = 100, seeds: int = 20) -> DataFrame:
    """One row for each group: AUC of probability and margin with intervals, their paired difference,

    saturation, confusion figures at the threshold, ten-bin calibration error, Brier score, and the least, median
    and greatest AUC of the margin over seeded subsamples. Groups with a null key are left out.
    """
    keys = keys or ["dataset"]
    out = metrics.threshold_metrics(scored, keys, threshold, "prob")
    draws = resampling.bootstrap_auc(scored, keys, ["prob", "margin"], replicates, seed)
    for name in ("prob", "margin"):
        auc = metrics.roc_auc(scored, keys, name).withColumnRenamed("auc", f"{name}_auc")
        ci = resampling.interval(draws, keys, f"auc_{name}").withColumnRenamed("low", f"{name}_low").withColumnRenamed("high", f"{name}_high")
        out = out.join(auc, keys).join(ci, keys, "left")
    gap = resampling.interval(draws.withColumn("d", F.col("auc_margin") - F.col("auc_prob")), keys, "d").withColumnRenamed("low", "difference_low").withColumnRenamed("high", "difference_high")
    sub = subsample_sensitivity(scored, per_class, list(range(seeds)), "margin", keys)
    sub = sub.select(*keys, *[F.col(c).alias(f"subsample_{c}") for c in ("min", "median", "max")])
    calibration = metrics.calibration_error(scored, 10, "prob", keys)
    return out.join(gap, keys, "left").join(metrics.saturation(scored, keys), keys).join(calibration, keys).join(sub, keys, "left")


def audit_report(scored: DataFrame, threshold: float, keys: list[str] | None = None, replicates: int = 5000, seed: int = 0, parts: DataFrame | None = None, semantic: int = 0) -> dict[str, DataFrame]:
    """groups, reliability bins, subsample AUCs, and sources and branches where there are such columns.

    ``scored`` may have a source; ``parts`` are the rows of ``branch_contributions`` with the same keys.
    """
    keys = keys or ["dataset"]
    out = {
        "groups": score_audit(scored, threshold, keys, replicates, seed),
        "reliability": metrics.reliability_bins(scored, 10, "prob", keys),
        "subsamples": metrics.roc_auc(sampling.seeded_subsamples(scored, 100, list(range(20)), keys=keys), [*keys, "seed"], "margin"),
    }
    if "source" in scored.columns:
        out["sources"] = metrics.source_scores(scored, threshold, "prob", keys)
    if parts is not None:
        out["branches"] = probe.branch_summary(parts, semantic, keys)
    return out


def stress_audit(scored: DataFrame, threshold: float, replicates: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one row for each dataset and condition, summary by dataset and kind)."""
    rows = score_audit(scored, threshold, ["dataset", "condition"], replicates, seed)
    return rows, metrics.stress_summary(rows.select("dataset", "condition", F.col("prob_auc").alias("auc")))


def robustness_report(scored: DataFrame, threshold: float, k: int = 10) -> dict[str, DataFrame]:
    """matrix, aggregate, families, drops and the top errors of the weakest condition."""
    matrix = metrics.score_matrix(scored, ["condition"], threshold, "prob")
    weakest = matrix.where("condition <> 'clean'").orderBy("auc", "condition").limit(1).select("condition")
    worst = scored.join(F.broadcast(weakest), "condition", "left_semi")  # one row
    return {
        "matrix": matrix,
        "aggregate": metrics.aggregate_robustness(matrix),
        "families": metrics.family_auc(matrix),
        "drops": metrics.condition_drop(matrix.select("condition", "auc")),
        "errors": sampling.top_errors(worst, threshold, k, score="prob"),
    }


def subsample_sensitivity(scored: DataFrame, per_class: int, seeds: list[int], score: str = "prob", keys: list[str] | None = None) -> DataFrame:
    """keys, min, median and max AUC over seeded subsamples; one row without keys."""
    keys = keys or []
    auc = metrics.roc_auc(sampling.seeded_subsamples(scored, per_class, seeds, keys=keys), [*keys, "seed"], score)
    return auc.groupBy(*keys).agg(F.min("auc").alias("min"), F.percentile("auc", 0.5).alias("median"), F.max("auc").alias("max"))
