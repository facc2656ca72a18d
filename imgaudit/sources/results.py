"""Feature tables, predictions, metric tables and models."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog

REQUIRED = ("schema_version", "final_model", "models", "config")


#: Shards of a dataset's condition: the unit whose work is done or pending.
SHARDS = 64


def _units(rows: DataFrame) -> DataFrame:
    """dataset, condition, shard, n and fingerprint of the image ids of each unit of work."""
    return rows.groupBy("dataset", "condition", "shard").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("image_id")).alias("fingerprint"))


def _sharded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("image_id"), F.lit(SHARDS)).cast("int"))


def _committed(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """Rows or units of all commits; what a torn write left has no marker and is never opened."""
    names = CommitLog(spark, path).names()
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/commit={n}" for n in names]) if names else None


def pending_units(rows: DataFrame, path: str) -> DataFrame:
    """dataset, condition and shard of the units of ``rows(dataset, condition, image_id)`` that are not done.

    Told from the markers' unit tables alone: a unit is done if it holds as many ids, with the same fingerprint.
    """
    wanted = _units(_sharded(rows.select("dataset", "condition", "image_id").distinct()))
    units = _committed(rows.sparkSession, path, "units")
    keys = ["dataset", "condition", "shard"]
    if units is None:
        return wanted.select(*keys)
    done = units.groupBy(*keys).agg(F.sum("n").alias("done"), F.bit_xor("fingerprint").alias("seen"))
    return wanted.join(done, keys, "left").where("done is null or done <> n or seen <> fingerprint").select(*keys)


def write_feature_table(rows: DataFrame, path: str, metadata: dict) -> DataFrame:
    """Add the (dataset, condition, image_id) rows that the table lacks, as one commit; other metadata than the table's is an error.

    Ids are compared inside pending units only, so a rerun of work that is done reads unit tables and
    no features. Rows and units are written first and the commit's marker last: a write that breaks
    off leaves nothing that counts. Of rows with the same id one is kept.
    """
    spark = rows.sparkSession
    meta = f"{path}/_metadata_json"
    text = json.dumps(metadata, sort_keys=True)
    try:
        known = spark.read.text(meta).first()[0]
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(meta)
        known = text
    if known != text:
        raise ValueError("the feature table was made with other settings")
    keys = ["dataset", "condition", "shard"]
    pending = F.broadcast(pending_units(rows, path))  # datasets x conditions x SHARDS rows at most
    fresh = _sharded(rows).join(pending, keys, "left_semi").dropDuplicates(["dataset", "condition", "image_id"])
    done = _committed(spark, path, "data")
    if done is not None:
        there = done.select(*keys, "image_id").join(pending, keys, "left_semi").select("dataset", "condition", "image_id")
        fresh = fresh.join(there, ["dataset", "condition", "image_id"], "left_anti")
    name = uuid.uuid4().hex
    data = f"{path}/data/commit={name}"
    fresh.write.partitionBy("dataset", "condition").parquet(data)
    schema = fresh.select("dataset", "condition", *[c for c in fresh.columns if c not in ("dataset", "condition")]).schema
    written = spark.read.schema(schema).parquet(data)
    if not written.isEmpty():
        _units(written).coalesce(1).write.parquet(f"{path}/units/commit={name}")
        CommitLog(spark, path).commit(name, {"metadata": metadata})
    return read_feature_table(spark, path)


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows; an error if nothing was committed."""
    found = _committed(spark, path, "data")
    if found is None:
        raise ValueError(f"{path} holds no committed rows")
    return found.drop("commit", "shard")


def write_predictions(scored: DataFrame, path: str, threshold: float | None = None) -> None:
    """JSON rows of image_path, pred and, with a threshold, label, in path order."""
    rows = scored.select("image_path", F.col("prob").alias("pred"))
    if threshold is not None:
        rows = rows.withColumn("label", F.when(F.col("pred") >= threshold, "FAKE").otherwise("REAL"))
    rows.orderBy("image_path").write.json(path)


def write_metric_table(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.option("header", True).csv(path)


def write_metrics_summary(robustness: DataFrame, families: DataFrame, path: str, final_model: str) -> None:
    """One JSON object of the composites and family AUCs of every model; tables(model, ...) of robustness and family_auc.

    Both hold a row for each model, or model and family, and are collected. A final model without figures is an error.
    """
    models = {r["model"]: {k: v for k, v in r.asDict().items() if k != "model"} | {"family_auc": {}} for r in robustness.collect()}
    if final_model not in models:
        raise ValueError(f"no figures of {final_model}")
    for r in families.collect():
        models[r["model"]]["family_auc"][r["family"]] = r["auc"]
    text = json.dumps({"final_model": final_model, "models": models}, sort_keys=True)
    robustness.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def save_model(spark: SparkSession, bundle: dict, path: str) -> None:
    check_model(bundle)
    spark.createDataFrame([(json.dumps(bundle, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    bundle = json.loads(spark.read.text(path).first()[0])
    check_model(bundle)
    return bundle


def check_model(bundle: dict) -> None:
    """Required keys, version 1, a final model in the bundle, a known feature mode (hybrid if none)."""
    lacking = [k for k in REQUIRED if k not in bundle]
    if lacking or bundle["schema_version"] != 1 or bundle["final_model"] not in bundle["models"]:
        raise ValueError(f"not a model bundle: {lacking or 'version or final model'}")
    if bundle["config"].get("feature_mode", "hybrid") not in ("semantic", "hybrid"):
        raise ValueError("unknown feature mode")
