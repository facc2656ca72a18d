"""Two workloads end to end: a leak-free training set, and fit, threshold and promotion of a probe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exclusion, metrics, probe, sampling


def build_training_set(items: DataFrame, frozen: DataFrame, per_class: int, reserve: int, seed: int, strict: bool = True) -> DataFrame:
    """items(image_id, source, sha256, label) -> chosen rows with role and selection_rank.

    Frozen ids and hashes go first; groups are balanced; repeated hashes leave their first row; the
    roles follow the selection order. Only keys, ranks and hashes are shuffled; join bytes back last.
    """
    fresh = exclusion.exclude_frozen(items, frozen, ["image_id", "sha256"])
    named = fresh.withColumn("group", F.col("source"))
    groups = named.select("label", "group").distinct().withColumn("position", F.col("group"))
    chosen = sampling.group_balanced_select(named, groups, per_class, reserve, seed, "image_id", strict)
    unique = exclusion.dedupe_by_hash(chosen.withColumn("_order", F.col("selection_rank") * 2 + F.col("label")), "_order").drop("_order")
    return sampling.assign_split_roles(unique, per_class - reserve, reserve, "selection_rank", strict=strict).drop("group")


def train_and_promote(training: DataFrame, calibration: DataFrame, gates: DataFrame, minimums: DataFrame, seed: int) -> tuple[dict, DataFrame]:
    """(model bundle, gate rows); promoted in the bundle's config only if every gate holds.

    training(domain, view, image_id, label, features), calibration(image_id, label, features) and
    gates(dataset, image_id, label, features); training and calibration may share no image.
    """
    exclusion.validate_disjoint(training, calibration)
    balanced = sampling.domain_balanced(training, seed).persist()
    model = probe.fit_probe(balanced)
    scored = probe.score(calibration, model)
    threshold = metrics.calibrate_threshold(scored, [], "prob").first()["threshold"]
    rows = metrics.promotion_gates(probe.score(gates, model), minimums, threshold, "prob")
    balanced.unpersist()
    passed = not rows.where("not passed").limit(1).collect()
    config = {"threshold": threshold, "seed": seed, "feature_mode": "semantic", "promoted": passed}
    return {"schema_version": 1, "final_model": "probe", "models": {"probe": model}, "config": config}, rows
