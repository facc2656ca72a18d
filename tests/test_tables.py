"""Sampling, exclusion, near duplicates, probe, images, scoreboard, sources and streaming."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgaudit.functions import conditions, keys
from imgaudit.operators import exclusion, images, near_duplicates, probe, sampling, scoreboard
from imgaudit.sources import catalogs, results
from imgaudit.streaming import jobs


def test_safe_name(spark):
    df = spark.createDataFrame([("folder/image id:1",), ("...",), ("é",)], "n string")
    assert [r[0] for r in df.select(keys.safe_name(F.col("n"))).collect()] == ["folder_image_id_1", "image", "image"]


def test_sample_is_balanced_and_stable(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "image_id int, label int")
    a = {r[0] for r in sampling.balanced_sample(df, 10, 7).select("image_id").collect()}
    b = {r[0] for r in sampling.balanced_sample(df.repartition(9), 10, 7).select("image_id").collect()}
    assert a == b and len(a) == 20
    with pytest.raises(ValueError):
        sampling.balanced_sample(df, 51, 7)


def test_exclusion_ignores_blanks_and_case(spark):
    rows = spark.createDataFrame([("a", "AB"), ("b", ""), ("c", None), ("d", "x")], "id string, sha256 string")
    frozen = spark.createDataFrame([("ab",), ("",), (None,)], "sha256 string")
    assert {r[0] for r in exclusion.exclude_frozen(rows, frozen, ["sha256"]).collect()} == {"b", "c", "d"}


def test_dedupe_keeps_first_and_blank(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "A"), (3, None), (4, None), (5, "b")], "plan_index int, sha256 string")
    assert {r[0] for r in exclusion.dedupe_by_hash(rows, "plan_index").collect()} == {1, 3, 4, 5}


def test_disjoint_message(spark):
    a = spark.createDataFrame([("x",), ("y",)], "image_id string")
    with pytest.raises(ValueError, match="2 ids are in both sets"):
        exclusion.validate_disjoint(a, a)


def test_top_errors(spark):
    df = spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(zip([0, 0, 0, 1, 1, 1], [0.2, 0.8, 0.9, 0.1, 0.3, 0.8], strict=True))], "image_id int, label int, score double")
    out = sampling.top_errors(df, 0.5, 2).orderBy("error_type", "rank").collect()
    assert [r["image_id"] for r in out] == [3, 4, 2, 1]


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63, 0x123456789ABCDEF0]
    other = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base] + [0] * 5
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    make = lambda v: spark.createDataFrame([(signed(x),) for x in v], "h long")
    got = {(r["a"], r["b"], r["distance"]) for r in near_duplicates.near_pairs(make(base), make(other)).collect()}
    want = {(signed(a), signed(b), (a ^ b).bit_count()) for a in base for b in other if (a ^ b).bit_count() <= 4}
    assert got == want


def test_probe_separates(spark):
    data = [(i, y, [x, z]) for i, (y, x, z) in enumerate([(0, -2.0, -1.0), (0, -1.0, -2.0), (1, 1.0, 2.0), (1, 2.0, 1.0)])]
    df = spark.createDataFrame(data, "image_id int, label int, features array<double>")
    model = probe.fit_probe(df)
    scored = probe.score(df, model).orderBy("image_id").collect()
    assert all((r["prob"] > 0.5) == (r["label"] == 1) for r in scored)
    sure = probe.score(df, model | {"bias": 1000.0}).collect()
    assert {r["prob"] for r in sure} == {1.0} and len({r["margin"] for r in sure}) > 1
    with pytest.raises(ValueError):
        probe.fit_probe(df.where("label = 1"))


def test_transforms_keep_shape_and_repeat():
    image = (np.arange(32 * 32 * 3) % 256).astype(np.uint8).reshape(32, 32, 3)
    for name in ["clean", *(f"{f}_{s}" for f, s, _ in conditions.TRANSFORMS), *conditions.CHAINS]:
        a, b = images.apply_condition(image, name, 17), images.apply_condition(image, name, 17)
        assert a.shape == image.shape and a.dtype == np.uint8 and (a == b).all()
    flat = np.full((16, 16, 3), 128, dtype=np.uint8)
    assert np.abs(images.jpeg(flat, 90).astype(int) - 128).max() <= 1
    assert (images.blur(flat, 1.0) == flat).all() and (images.rescale(flat, 0.5) == flat).all()


def test_spectrum_and_hash():
    zero = images.radial_spectrum(np.zeros((32, 32, 3), dtype=np.uint8))
    assert zero.shape == (32,) and np.isfinite(zero).all()
    ramp = np.repeat(np.arange(72, dtype=np.uint8)[None, :, None] * 3, 64, 0).repeat(3, 2)
    assert images.difference_hash(ramp) == -1
    assert images.difference_hash(ramp[:, ::-1]) == 0


def _png(path, value):
    raw = b"".join(b"\0" + bytes([value, 10, 20] * 8) for _ in range(8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_catalogs(spark, tmp_path):
    for k, folder in enumerate(("train/REAL", "train/FAKE", "other")):
        (tmp_path / folder).mkdir(parents=True)
        _png(tmp_path / folder / f"{k}.png", 50 + k)
    (tmp_path / "other/broken.webp").write_bytes(b"no image")
    (tmp_path / "other/notes.txt").write_text("x")
    found = catalogs.catalog_labeled_images(spark, str(tmp_path), "train").orderBy("label").collect()
    assert [r["relative_path"] for r in found] == ["train/REAL/0.png", "train/FAKE/1.png"]
    good, bad = catalogs.catalog_unlabeled_images(spark, str(tmp_path / "other"))
    assert good.count() == 1 and bad.first()["image_path"].endswith("broken.webp")
    pixels = catalogs.decoded_pixels(good).first()
    assert bytes(pixels["pixels"][:3]) == bytes([52, 10, 20])
    labeled = catalogs.catalog_labeled_images(spark, str(tmp_path), "train")
    catalogs.validate_decode_sample(labeled, str(tmp_path), 2, 7)
    catalogs.write_manifest(labeled, str(tmp_path / "manifest"))
    assert catalogs.read_manifest(spark, str(tmp_path / "manifest")).count() == 2
    broken = spark.createDataFrame([("other/broken.webp",)], "relative_path string")
    with pytest.raises(ValueError):
        catalogs.validate_decode_sample(broken, str(tmp_path), 2, 7)
    assert conditions.representative_conditions(spark).count() == 6
    assert catalogs.catalog_challenge_images(spark, [str(tmp_path)]).count() == 2


def test_model_and_predictions(spark, tmp_path):
    bundle = {"schema_version": 1, "final_model": "m", "models": {"m": {"bias": 1.0}}, "config": {"threshold": 0.5}}
    results.save_model(spark, bundle, str(tmp_path / "model"))
    assert results.load_model(spark, str(tmp_path / "model")) == bundle
    with pytest.raises(ValueError):
        results.check_model(bundle | {"final_model": "x"})
    results.write_predictions(spark.createDataFrame([("b.jpg", 0.2), ("a.jpg", 0.75)], "image_path string, prob double"), str(tmp_path / "p"), 0.5)
    lines = [json.loads(x) for f in sorted((tmp_path / "p").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == [{"image_path": "a.jpg", "pred": 0.75, "label": "FAKE"}, {"image_path": "b.jpg", "pred": 0.2, "label": "REAL"}]


def test_feature_table_resumes(spark, tmp_path):
    rows = spark.createDataFrame([("d", "clean", "a"), ("d", "clean", "b")], "dataset string, condition string, image_id string")
    for _ in range(2):
        table = results.write_feature_table(rows, str(tmp_path / "t"), {"seed": 1})
    assert table.count() == 2
    with pytest.raises(ValueError):
        results.write_feature_table(rows, str(tmp_path / "t"), {"seed": 2})


def test_rounds_finish_once(spark):
    rounds = spark.createDataFrame([("r", "m", "REAL", "FAKE", 5.0)], "round_id string, match_id string, ground_truth string, ai_label string, ai_elapsed_ms double")
    guesses = spark.createDataFrame([("r", 2, "FAKE", 1.0), ("r", 1, "REAL", 9.0), ("x", 1, "REAL", 1.0)], "round_id string, ts int, label string, elapsed_ms double")
    done = scoreboard.finish_rounds(rounds, guesses).collect()
    assert len(done) == 1 and done[0]["human_correct"] and not done[0]["ai_correct"]
    assert scoreboard.rejected_guesses(rounds, guesses).count() == 1
    board = scoreboard.scoreboard(scoreboard.finish_rounds(rounds, guesses))
    assert scoreboard.match_winners(board).first()["human_points"] == 1


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    model = {"mean": [0.0], "std": [1.0], "weights": [2.0], "bias": 0.0}
    for ids in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(i, [1.0]) for i in ids], "image_id string, features array<double>").write.mode("append").parquet(source)
        jobs.stream_score_new_images(spark, source, "image_id string, features array<double>", model, out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r[0] for r in jobs.read_scores(spark, out).select("image_id").collect()) == ["a", "b", "c"]
    spark.sql("select 'r' round_id, 'm' match_id, 'REAL' ground_truth, 'FAKE' ai_label, timestamp'2024-01-01 00:00:00' ts").write.parquet(str(tmp_path / "r"))
    spark.sql("select 'r' round_id, 'REAL' label, timestamp'2024-01-01 00:01:00' ts union all select 'q', 'REAL', timestamp'2024-01-01 00:01:00'").write.parquet(str(tmp_path / "g"))
    r = spark.readStream.schema("round_id string, match_id string, ground_truth string, ai_label string, ts timestamp").parquet(str(tmp_path / "r"))
    g = spark.readStream.schema("round_id string, label string, ts timestamp").parquet(str(tmp_path / "g"))
    query = jobs.finished_rounds_stream(r, g).writeStream.format("memory").queryName("finished").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(x["round_id"], x["human_correct"], x["ai_correct"]) for x in spark.table("finished").collect()] == [("r", True, False)]
