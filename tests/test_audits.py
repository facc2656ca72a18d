"""Probes fitted together, held-out pairs, ablations, whole audits, files of metrics and image heads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from imgaudit.functions import arrays, conditions, keys
from imgaudit.operators import images, probe, sampling
from imgaudit.plans import audit
from imgaudit.sources import catalogs, results
from imgaudit.streaming import jobs


def table(spark, n=120, sources=4):
    rng = random.Random(2)
    data = []
    for i in range(n):
        y = i % 2
        data.append((i, y, f"g{y * sources // 2 + rng.randrange(sources // 2)}", [rng.gauss(y, 1.0), rng.gauss(0, 2.0), rng.gauss(-y, 3.0)]))
    return spark.createDataFrame(data, "image_id int, label int, source string, features array<double>")


def test_probes_fitted_together_are_those_fitted_alone(spark):
    rows = table(spark).withColumn("k", F.col("image_id") % 3)
    for k, mean, std, weights, bias in probe.fit_probes(rows, ["k"], 3):
        alone = probe.fit_probe(rows.where(F.col("k") == k))
        assert weights == pytest.approx(alone["weights"], abs=1e-4) and bias == pytest.approx(alone["bias"], abs=1e-4)
        assert mean == pytest.approx(alone["mean"]) and std == pytest.approx(alone["std"])
    with pytest.raises(ValueError):
        probe.fit_probes(rows.where("k > 0 or label = 1"), ["k"], 3)


def test_separable_rows_settle(spark):
    rows = spark.createDataFrame([(0, i, y, [float(100 * y + i % 3)]) for i, y in enumerate([0, 1] * 20)], "k int, image_id int, label int, features array<double>")
    (_, _, _, weights, bias), alone = probe.fit_probes(rows, ["k"], 1)[0], probe.fit_probe(rows)
    assert weights == pytest.approx(alone["weights"], abs=1e-3) and bias == pytest.approx(alone["bias"], abs=1e-3)


def test_metadata_summary(spark):
    rows = table(spark).select("image_id", "label", (F.col("image_id") % 7 + 1).alias("width"), (F.col("image_id") % 5 + 1).alias("height"), (F.col("label") * 1000 + F.col("image_id")).alias("bytes"))
    aucs = probe.metadata_baseline(rows, [1, 2], folds=3)
    assert {r["seed"]: r["auc"] for r in aucs.collect()} == {1: 1.0, 2: 1.0}
    assert tuple(probe.auc_summary(aucs).first()) == (2, 1.0, 1.0, 1.0, 1.0)


def test_held_out_pairs(spark):
    rows = table(spark)
    held = probe.leave_pair_out(rows, ["g0", "g1"], ["g2"], rows)
    found = {r["pair"]: r for r in probe.pair_audit(held, replicates=50).collect()}
    assert set(found) == {"g0|g2", "g1|g2"}
    n = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    for real in ("g0", "g1"):
        r = found[f"{real}|g2"]
        assert (r["n_real"], r["n_fake"], r["n_fit"]) == (n[real], n["g2"], 2 * (120 - n[real] - n["g2"]))
        assert r["low"] <= r["auc"] <= r["high"]


def test_ablations_need_aligned_views(spark):
    view = table(spark).select("image_id", "label", F.slice("features", 1, 2).alias("semantic"), F.slice("features", 3, 1).alias("frequency"))
    models = probe.fit_ablations(view, view)
    assert [len(m["weights"]) for m in models.values()] == [2, 3, 3]
    for bad in (view.where("image_id > 0"), view.withColumn("label", 1 - F.col("label")), view.unionByName(view.limit(1))):
        with pytest.raises(ValueError):
            probe.fit_ablations(view, bad)


def test_forbidden_groups(spark):
    rows = table(spark).withColumnRenamed("source", "group")
    groups = rows.select("label", "group").distinct().withColumn("position", F.col("group"))
    assert sampling.group_balanced_select(rows, groups, 8, 2, 1, "image_id", forbidden=["g9"]).count() == 20
    with pytest.raises(ValueError, match="forbidden"):
        sampling.group_balanced_select(rows, groups, 8, 2, 1, "image_id", forbidden=["G_0"])


def test_audit_report(spark):
    rows = table(spark, 400)
    model = probe.fit_probe(rows)
    scored = probe.score(rows, model).withColumn("dataset", F.when(F.col("image_id") < 250, "a").otherwise("b"))
    parts = probe.branch_contributions(scored, model, 2)
    out = audit.audit_report(scored, 0.5, replicates=20, parts=parts, semantic=2)
    assert out["reliability"].count() == 20 and out["sources"].count() == 8
    total = out["reliability"].groupBy("dataset").agg(F.sum("n").alias("n")).collect()
    assert {r["dataset"]: r["n"] for r in total} == {"a": 250, "b": 150}
    branches = {(r["branch"], r["class"]): r["n"] for r in out["branches"].where("dataset = 'a'").collect()}
    assert branches[("semantic", "all")] == branches[("absolute_frequency", "all")] == 250 and len(branches) == 7
    row = audit.score_audit(scored.where("dataset = 'a'"), 0.5, replicates=20).first()
    assert row["subsample_min"] <= row["subsample_median"] <= row["subsample_max"] and 0 <= row["ece"] <= 1


def test_metrics_files(spark, tmp_path):
    robustness = spark.createDataFrame([("m", 0.9, 0.8)], "model string, clean_auc double, condition_auc double")
    families = spark.createDataFrame([("m", "jpeg", 0.7), ("m", "blur", 0.6)], "model string, family string, auc double")
    results.write_metrics_summary(robustness, families, str(tmp_path / "s"), "m")
    found = json.loads(spark.read.text(str(tmp_path / "s")).first()[0])
    assert found == {"final_model": "m", "models": {"m": {"clean_auc": 0.9, "condition_auc": 0.8, "family_auc": {"jpeg": 0.7, "blur": 0.6}}}}
    with pytest.raises(ValueError):
        results.write_metrics_summary(robustness, families, str(tmp_path / "t"), "x")
    results.write_metric_table(robustness, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["model"] == "m"


def test_image_heads(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (200).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc2\0\x0b\x08" + (64).to_bytes(2, "big") + (48).to_bytes(2, "big") + b"\x01"
    webp = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (319).to_bytes(3, "little") + (239).to_bytes(3, "little")
    files = spark.createDataFrame([("p", png), ("j", jpeg), ("w", webp), ("x", b"text"), ("e", b""), ("n", None)], "path string, content binary")
    found = {r["path"]: (r["format"], r["width"], r["height"]) for r in images.image_properties(files).collect()}
    assert found == {"p": ("PNG", 300, 200), "j": ("JPEG", 48, 64), "w": ("WEBP", 320, 240), "x": ("unknown", None, None), "e": ("unknown", None, None), "n": ("unknown", None, None)}


def test_pages_shards_and_arrays(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps({"rows": [{"row_idx": 4, "row": {"label": 1, "img_id": "q", "image": {"src": "u"}}}]}))
    page = catalogs.read_source_pages(spark, str(tmp_path / "page.json")).first()
    assert (page["row_idx"], page["src"], str(page["img_id"])) == (4, "u", "q")
    table(spark, 6).write.parquet(str(tmp_path / "shards"))
    assert catalogs.read_image_shards(spark, str(tmp_path / "shards"), ["image_id"]).columns == ["image_id"]
    row = spark.range(1).select(arrays.combine_features(F.array(F.lit(3.0)), F.array(F.lit(4.0))).alias("v"), keys.source_id(F.lit("g"), F.lit("a/b.png")).alias("s"))
    got = row.select("s", "v", arrays.l2_normalize(F.col("v")).alias("u")).first()
    assert got["s"] == "g/b.png" and got["v"] == [3.0, 4.0] and got["u"] == pytest.approx([0.6, 0.8])
    named = spark.createDataFrame([("clean",), ("jpeg_q90",), ("other_1",)], "condition string")
    assert [r[0] for r in conditions.unknown_conditions(named).collect()] == ["other_1"]
    assert probe.not_finite(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "margin double")).count() == 2


def test_running_scoreboard(spark, tmp_path):
    spark.sql("select 'm' match_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) ts, id % 2 = 0 human_correct, true ai_correct from range(4)").selectExpr("match_id", "ts", "human_correct", "ai_correct").write.parquet(str(tmp_path / "f"))
    finished = spark.readStream.schema("match_id string, ts timestamp, human_correct boolean, ai_correct boolean").parquet(str(tmp_path / "f"))
    query = jobs.scoreboard_stream(finished).writeStream.format("memory").queryName("board").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r)[1:] for r in spark.table("board").collect()] == [("m", 4, 2, 4)]
