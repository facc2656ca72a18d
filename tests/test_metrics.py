"""Metrics on the small numbers of FIXTURES.md."""

import itertools
import random

import numpy as np
import pytest

from imgaudit.operators import metrics, resampling

SCHEMA = "dataset string, image_id int, label int, score double"


def rows(spark, labels, scores, dataset="d"):
    return spark.createDataFrame([(dataset, i, y, s) for i, (y, s) in enumerate(zip(labels, scores, strict=True))], SCHEMA)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))


def test_auc_matches_pairs(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), i, rng.randint(0, 1), rng.choice([0.1, 0.2, 0.5, rng.random()])) for i in range(400)]
    df = spark.createDataFrame(data, SCHEMA)
    for n in (1, 7):
        got = {r["dataset"]: r["auc"] for r in metrics.roc_auc(df.repartition(n), ["dataset"]).collect()}
        for name in "ab":
            assert got[name] == pytest.approx(brute_auc([(y, s) for d, _, y, s in data if d == name]))


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(rows(spark, [1, 1], [0.1, 0.2]), ["dataset"]).first()["auc"] is None
    assert metrics.roc_auc(rows(spark, [], []), ["dataset"]).count() == 0


def test_confusion_brier_and_ece(spark):
    df = rows(spark, [0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9])
    m = metrics.threshold_metrics(df, [], 0.5).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (2, 0, 0, 2)
    assert m["sensitivity"] == m["specificity"] == 1
    e = metrics.calibration_error(df, bins=2).first()
    assert e["brier"] == pytest.approx(0.085)
    assert e["ece"] == pytest.approx(0.25)


def test_condition_and_family_weighting(spark):
    m = spark.createDataFrame([("clean", 0.9), ("jpeg_q90", 0.8), ("jpeg_q50", 0.6), ("blur_sigma1.0", 0.4)], "condition string, auc double")
    r = metrics.aggregate_robustness(m).first()
    assert [r[c] for c in ("condition_auc", "family_auc", "condition_score", "family_score")] == pytest.approx([0.6, 0.55, 0.75, 0.725])
    assert {x["family"]: x["auc"] for x in metrics.family_auc(m).collect()} == pytest.approx({"blur": 0.4, "jpeg": 0.7})


def test_stress_kinds(spark):
    m = spark.createDataFrame([("d", "clean", 0.9), ("d", "jpeg_q70", 0.8), ("d", "blur_sigma1.0", 0.6), ("d", "chain_moderate_reupload", 0.5)], "dataset string, condition string, auc double")
    r = {x["kind"]: x for x in metrics.stress_summary(m).collect()}
    assert r["individual_transform"]["mean_auc"] == pytest.approx(0.7)
    assert r["individual_transform"]["composite"] == pytest.approx(0.8)
    assert r["platform_style_chain"]["mean_auc"] == pytest.approx(0.5)


def test_gates_reject_constant_scores(spark):
    least = spark.createDataFrame([("d", 0.5)], "dataset string, min_auc double")
    r = metrics.promotion_gates(rows(spark, [0, 0, 1, 1], [0.99] * 4), least, 0.5).first()
    assert not r["passed"]
    assert {"score_std", "predicted_fake_rate"} <= set(r["failures"].split(","))


def test_threshold_is_nearest_to_a_half(spark):
    df = rows(spark, [0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9])
    assert metrics.calibrate_threshold(df, ["dataset"]).first()["threshold"] == pytest.approx(0.6)


def test_bootstrap(spark):
    df = rows(spark, [0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.7, 0.8, 0.9])
    ci = resampling.bootstrap_auc_ci(df, ["dataset"], replicates=60, seed=1)
    assert [tuple(r) for r in ci.collect()] == [("d", 1.0, 1.0)]
    mixed = rows(spark, [0, 1] * 20, [((i * 7) % 11) / 11 for i in range(40)])
    a = resampling.bootstrap_auc(mixed, ["dataset"], ["score"], 60, 5).orderBy("replicate").collect()
    b = resampling.bootstrap_auc(mixed.repartition(7), ["dataset"], ["score"], 60, 5).orderBy("replicate").collect()
    assert a == b and len(a) == 60
    assert resampling.bootstrap_auc_ci(rows(spark, [1, 1], [0.1, 0.2]), ["dataset"], replicates=10).count() == 0


def test_bootstrap_of_many_distinct_scores(spark):
    """Memory grows with the distinct scores, not with their square (28 GB here)."""
    df = spark.range(60_000).selectExpr("'d' as dataset", "int(id % 2) as label", "(id * 7919 % 60000 + id % 2 * 15000) / 75000 as score")
    auc = metrics.roc_auc(df, ["dataset"]).first()["auc"]
    low, high = resampling.bootstrap_auc_ci(df, ["dataset"], replicates=20, seed=1).select("low", "high").first()
    assert auc - 0.02 < low < high < auc + 0.02


def test_robustness_needs_one_clean_and_distinct_conditions(spark):
    schema = "condition string, auc double"
    for bad in ([("jpeg_q90", 0.8)], [("clean", 0.9)], [("clean", 0.9), ("clean", 0.9), ("jpeg_q90", 0.8)], [("clean", 0.9), ("jpeg_q90", 0.8), ("jpeg_q90", 0.7)]):
        with pytest.raises(Exception, match="condition"):
            metrics.aggregate_robustness(spark.createDataFrame(bad, schema)).collect()


def test_quantiles_match_numpy(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([0.5, 1.0, None, rng.random()])) for _ in range(500)] + [("c", None)]
    points = [0.0, 0.05, 0.5, 0.999, 1.0]
    got = metrics.quantiles(spark.createDataFrame(data, "k string, x double"), ["k"], "x", points, list("vwxyz")).collect()
    assert len(got) == 4
    for r in got:
        own = [x for k, x in data if k == r["k"] and x is not None]
        assert list(r)[1:] == (pytest.approx(list(np.quantile(own, points))) if own else [None] * 5)


def test_bootstrap_in_many_cells(spark, monkeypatch):
    """Small cells and ranges give the same spread as one cell, and both scores use the same resample."""
    df = spark.range(4000).selectExpr("int(id % 2) as label", "(id * 7919 % 4000 + id % 2 * 1000) / 5000 as score").selectExpr("*", "score * 3 - 1 as other", "least(score, 0.5) as capped")
    spread = []
    for cell in (1 << 14, 100):
        monkeypatch.setattr(resampling, "CELL", cell)
        got = resampling.bootstrap_auc(df, [], ["score", "other", "capped"], 120, 4).toPandas()
        assert len(got) == 120 and (got["auc_score"] - got["auc_other"]).abs().max() < 1e-12
        assert abs(got["auc_score"].mean() - metrics.roc_auc(df, []).first()["auc"]) < 0.005
        spread.append(got["auc_score"].std())
    assert spread[0] == pytest.approx(spread[1], rel=0.35)
