"""Running sums, quantiles and resamples of skewed scores, Hamming joins on hot keys, pages read in rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgaudit.operators import metrics, near_duplicates, probe, resampling, sampling


def test_cells_hold_equally_many_rows_however_scores_lie(spark):
    # 200,000 distinct scores of which nearly all lie within 1e-6 of 1, and a small group beside
    df = spark.range(200_000).selectExpr("'big' as k", "int(id % 2) as label", "if(id % 100 = 0, id / 200000d, 1 - id * 5e-12) as score")
    df = df.unionByName(spark.createDataFrame([("small", 1, 0.5), ("small", 0, 0.25), (None, 1, 0.5)], "k string, label int, score double"))
    hist = metrics.score_histogram(df, ["k"])
    celled = metrics.with_cells(hist, ["k"], depth=2048)
    sizes = celled.groupBy("k", "_cell").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    big = sorted((r for r in sizes if r["k"] == "big"), key=lambda r: r["_cell"])
    assert len(big) > 60 and max(r["n"] for r in big) < 200_000 / 8
    assert all(a["hi"] < b["lo"] for a, b in zip(big, big[1:], strict=False))
    assert celled.count() == hist.count()
    assert sum(1 for r in sizes if r["k"] == "small") == 1


def test_auc_and_quantiles_of_saturated_scores(spark, monkeypatch):
    monkeypatch.setattr(metrics, "DEPTH", 512)
    monkeypatch.setattr(metrics, "SMALL", 1000)
    rng = np.random.default_rng(1)
    n = 30_000
    label = rng.integers(0, 2, n)
    score = np.where(rng.random(n) < 0.9, 1 - 1e-6 * rng.random(n) * (2 - label), rng.random(n))
    score[:2000] = 1.0
    pdf = [(str(k % 3), int(y), float(s)) for k, (y, s) in enumerate(zip(label, score, strict=True))]
    df = spark.createDataFrame(pdf, "k string, label int, score double")
    got = {r["k"]: r["auc"] for r in metrics.roc_auc(df, ["k"]).collect()}
    points = [0.0, 0.0004, 0.05, 0.5, 0.95, 0.99, 0.999, 1.0]
    found = {r["k"]: list(r)[1:] for r in metrics.quantiles(df, ["k"], "score", points, [f"q{i}" for i in range(len(points))]).collect()}
    for k in "012":
        y, s = (np.array([r[i] for r in pdf if r[0] == k]) for i in (1, 2))
        order = np.sort(s[y == 0])
        below, upto = np.searchsorted(order, s[y == 1]), np.searchsorted(order, s[y == 1], "right")
        assert got[k] == pytest.approx((below + (upto - below) / 2).sum() / ((y == 1).sum() * (y == 0).sum()), abs=1e-12)
        assert found[k] == pytest.approx(list(np.quantile(s, points)), abs=1e-15)


def numpy_interval(label, scores, replicates, seed):
    """Percentile interval of AUC by plain resampling of rows."""
    rng = np.random.default_rng(seed)
    pos, neg = scores[label == 1], scores[label == 0]
    out = []
    for _ in range(replicates):
        a, b = rng.choice(pos, len(pos)), np.sort(rng.choice(neg, len(neg)))
        below, upto = np.searchsorted(b, a), np.searchsorted(b, a, "right")
        out.append((below + upto).sum() / 2 / (len(a) * len(b)))
    return np.quantile(out, [0.025, 0.975])


@pytest.mark.parametrize("cell", [1 << 12, 64])
def test_bootstrap_is_that_of_numpy(spark, monkeypatch, cell):
    monkeypatch.setattr(resampling, "CELL", cell)
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 1500)
    score = np.round(rng.normal(label * 0.5, 1.0), 2)
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(label, score, strict=True)], "label int, score double")
    got = resampling.bootstrap_auc_ci(df, [], replicates=3000, seed=9).first()
    assert [got["low"], got["high"]] == pytest.approx(numpy_interval(label, score, 3000, 2), abs=0.004)


def test_replicates_are_whole_resamples(spark, monkeypatch):
    """Every replicate draws as many rows of a class as there are, and its AUC is that of the rows it drew."""
    monkeypatch.setattr(resampling, "CELL", 8)
    rng = np.random.default_rng(5)
    rows = [(int(y), float(np.round(s, 1)), float(t)) for y, s, t in zip(rng.integers(0, 2, 400), rng.normal(size=400), rng.normal(size=400), strict=True)]
    df = spark.createDataFrame(rows, "label int, score double, other double")
    draws = resampling.bootstrap_auc(df, [], ["score", "other"], 700, 4).toPandas().sort_values("replicate")
    assert draws["replicate"].tolist() == list(range(700))
    # two scores of no common order have the spread that numpy finds for each
    label, score, other = (np.array([r[i] for r in rows]) for i in range(3))
    for name, values in (("score", score), ("other", other)):
        low, high = numpy_interval(label, values, 2000, 3)
        assert draws[f"auc_{name}"].quantile(0.025) == pytest.approx(low, abs=0.012)
        assert draws[f"auc_{name}"].quantile(0.975) == pytest.approx(high, abs=0.012)


def test_leaves_draw_all_rows():
    totals = np.array([5, 0, 7, 1, 12, 3])
    draws = np.full(40, totals.sum())
    found = resampling._of_leaves((1, "g"), totals, np.arange(6), draws)
    assert (sum(found.values()) == draws).all() and (found[1] == 0).all()
    some = resampling._of_leaves((1, "g"), totals, np.array([2, 5]), draws)
    assert all((some[k] == found[k]).all() for k in (2, 5))
    mean = np.mean([resampling._of_leaves((k,), totals, np.arange(6), np.full(500, 28))[4].mean() for k in range(20)])
    assert mean == pytest.approx(12, abs=0.15)


def test_near_pairs_of_hot_keys(spark, monkeypatch):
    """Hashes that share most blocks, in both sides, are dealt to several tasks; each pair is found once."""
    monkeypatch.setattr(near_duplicates, "HOT", 16)
    rng = random.Random(8)
    hashes = [rng.getrandbits(16) << 40 for _ in range(150)] + [rng.getrandbits(64) for _ in range(150)]
    other = [h ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for h in hashes] + hashes[:40]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    make = lambda v: spark.createDataFrame([*((signed(x),) for x in v), (None,)], "h long")
    for bits in (0, 1, 4, 6):
        got = sorted((r["a"], r["b"], r["distance"]) for r in near_duplicates.near_pairs(make(hashes), make(other), bits).collect())
        want = sorted({(signed(a), signed(b), (a ^ b).bit_count()) for a in hashes for b in other if (a ^ b).bit_count() <= bits})
        assert got == want


def test_combinations_make_fewer_candidates_than_bands(spark):
    df = spark.range(6000).select(F.xxhash64("id").alias("h"))
    a, b = df.select(F.col("h").alias("a")), df.select((F.col("h") + 1).alias("b"))
    bands = a.withColumn("x", F.explode(near_duplicates.hash_bands(F.col("a")))).join(b.withColumn("x", F.explode(near_duplicates.hash_bands(F.col("b")))), "x").count()
    combined = near_duplicates.candidates(df, df.select((F.col("h") + 1).alias("h"))).count()
    near = 6000 * 15  # a hash and the next number share most blocks
    assert bands - 6000 * 5 > 10 * max(1, combined - near)


def test_pages_are_read_until_quotas_are_full(spark):
    rng = random.Random(6)
    rows = [(f"p{i // 20:03d}", i, rng.choice([0, 1, 1, 2])) for i in range(2000)]
    table = spark.createDataFrame(rows, "page string, key int, label int")
    excluded = table.where("key % 9 = 0").select("key")
    opened = []

    def read(names):
        opened.extend(names)
        return table.where(F.col("page").isin(names)) if names else table.limit(0)

    whole = sampling.quota_select(table, 25, 7, "page", "key", excluded)
    got, n = sampling.quota_select_pages(table.select("page"), read, 25, 7, "page", "key", excluded)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.columns == whole.columns
    assert n == len(set(opened)) < 30
    short, n = sampling.quota_select_pages(table.select("page"), read, 2000, 7, "page", "key")
    assert n == 100 and sorted(map(tuple, short.collect())) == sorted(map(tuple, sampling.quota_select(table, 2000, 7, "page", "key").collect()))
    assert sampling.quota_select_pages(table.select("page").limit(0), read, 5, 7, "page", "key")[0].count() == 0


def test_models_without_some_sources_are_those_fitted_alone(spark, monkeypatch):
    rng = random.Random(2)
    data = [(i, y, f"g{y * 3 + rng.randrange(3)}", [rng.gauss(y, 1.0), 4.0, rng.gauss(-y, 30.0), 1e4 + rng.gauss(0, 1)]) for i, y in enumerate([0, 1] * 150)]
    data += [(900, 0, None, [0.0, 4.0, 1.0, 1e4])]
    rows = spark.createDataFrame(data, "image_id int, label int, source string, features array<float>")
    held = [("g0", "g3"), ("g1", "g5"), ("g2",), ()]
    for size in (1 << 22, 60):  # all at once, or two at a time
        monkeypatch.setattr(probe, "SECOND", size)
        for sources, model in zip(held, probe.fit_without(rows, held), strict=True):
            own = rows.where(~F.coalesce(F.col("source").isin(*sources), F.lit(False))) if sources else rows
            alone = probe.fit_probe(own)
            assert model["n"] == own.count()
            assert model["weights"] == pytest.approx(alone["weights"], abs=1e-4) and model["bias"] == pytest.approx(alone["bias"], abs=1e-4)
    with pytest.raises(ValueError, match="classes"):
        probe.fit_without(rows.where("label = 1 or source = 'g0'"), [("g0",)])


def test_distinct_scores_by_a_sketch(spark):
    df = spark.range(40_000).selectExpr("id % 3 as k", "(id % 9000) / 9000d as prob", "double(id) as margin")
    exact = {r["k"]: r for r in metrics.saturation(df, ["k"]).collect()}
    for r in metrics.saturation(df, ["k"], approximate=True).collect():
        assert (r["n_zero"], r["n_one"]) == (exact[r["k"]]["n_zero"], 0)
        assert r["distinct_prob"] == pytest.approx(exact[r["k"]]["distinct_prob"], rel=0.08)
        assert r["distinct_margin"] == pytest.approx(exact[r["k"]]["distinct_margin"], rel=0.08)
