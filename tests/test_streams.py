"""Streams with keyed state: rounds bounded by count, scores written once; feature tables by commits."""

import random
import shutil
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from imgaudit.operators import scoreboard
from imgaudit.plans import queries
from imgaudit.sources import results
from imgaudit.sources.commits import CommitLog
from imgaudit.streaming import jobs, rounds

ROUND = "game_id string, round_id string, ts timestamp, ground_truth string, ai_label string, ai_elapsed_ms double"
GUESS = "game_id string, round_id string, ts timestamp, label string, elapsed_ms double"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set(jobs.STORE, jobs.ROCKSDB)
    yield
    spark.conf.unset(jobs.STORE)


def moment(k):
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(k))


class Game:
    """Batches of rounds and guesses as files, run through the stream one batch at a time."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.path, self.options, self.batch = spark, tmp_path, options, 0
        self.known = {"r": [], "g": []}

    def send(self, new_rounds, guesses):
        for name, rows, schema in (("r", new_rounds, ROUND), ("g", guesses, GUESS)):
            self.known[name] += rows
            made = self.spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
            made.coalesce(1).write.mode("append").parquet(str(self.path / name))
        read = lambda name, schema: self.spark.readStream.schema(schema).parquet(str(self.path / name))
        events = rounds.round_events(read("r", ROUND), read("g", GUESS))
        query = rounds.rounds_with_figures(events, **self.options).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()

    def out(self):
        return self.spark.read.parquet(str(self.path / "out"))

    def tables(self):
        make = lambda name, schema: self.spark.createDataFrame(self.known[name], schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
        return make("r", ROUND), make("g", GUESS)


def test_a_thousand_rounds_equal_the_batch_scoreboard(spark, tmp_path):
    game, rng = Game(spark, tmp_path, cache_size=2000, rounds_per_match=60), random.Random(4)
    side = lambda: rng.choice(["REAL", "FAKE"])
    for batch in range(4):
        base = 1_700_000_000 + batch * 1000
        new = [(f"m{k % 9}", f"r{batch}-{k}", base + k, side(), side(), float(rng.randint(1, 900))) for k in range(250)]
        guessed = [(g, r, t + 300, side(), float(rng.randint(1, 9000))) for g, r, t, *_ in new if rng.random() < 0.9]
        again = [(g, r, t + 1, side(), 5.0) for g, r, t, *_ in rng.sample(guessed, 20)]
        wrong = [("m1", f"none{batch}", base + 500, "REAL", 1.0), ("m2", new[2][1], base + 299, "MAYBE", 1.0), ("m3", new[3][1], base + 299, "REAL", 400_000.0)]
        game.send(new, guessed + again + wrong)
    r, g = game.tables()
    finished = scoreboard.finish_rounds(r.withColumnRenamed("game_id", "match_id").drop("ts"), g.drop("game_id"))
    want = scoreboard.scoreboard(finished, 60)
    got = rounds.running_board(game.out())
    columns = ["match_id", "side", "completed", "correct", "mean_ms", "streak", "accuracy"]
    plain = lambda df: sorted((*x[:4], round(x[4], 6), *x[5:]) for x in df.select(*columns).collect())
    assert plain(got) == plain(want) and len(plain(got)) == 18
    states = {x["status"]: x["count"] for x in game.out().groupBy("status").count().collect()}
    assert states["finished"] == 80 and states["unknown"] == 4 and states["invalid"] == 8
    assert states["accepted"] == finished.count()


def test_pushed_out_rounds_reject_guesses(spark, tmp_path):
    game = Game(spark, tmp_path, cache_size=3, rounds_per_match=10)
    t = 1_700_000_000
    game.send([("g", f"r{k}", t + k, "REAL", "REAL", 5.0) for k in range(3)] + [("h", "r0", t, "FAKE", "REAL", 5.0)], [("g", "r0", t + 10, "REAL", 7.0)])
    # two more push out r0 (finished) and r1; r2 is still held, also after the restart of the stream
    game.send([("g", f"r{k}", t + 20 + k, "REAL", "FAKE", 6.0) for k in (3, 4)], [("g", k, t + 30 + i, "REAL", 9.0) for i, k in enumerate(("r0", "r1", "r2", "r3", "r2"))] + [("h", "r0", t + 40, "REAL", 3.0), ("none", "r0", t + 41, "REAL", 3.0)])
    rows = {(r["game_id"], r["round_id"], r["ts"].timestamp()): r for r in game.out().collect()}
    status = [r["status"] for r in sorted((r for r in rows.values() if r["game_id"] == "g"), key=lambda r: r["ts"])]
    assert status == ["accepted", "unknown", "unknown", "accepted", "accepted", "finished"]
    board = {(r["match_id"], r["side"]): r for r in rounds.running_board(game.out()).collect()}
    assert (board["g", "human"]["streak"], board["g", "ai"]["streak"], board["g", "ai"]["correct"]) == (3, 0, 2)
    assert board["g", "human"]["mean_ms"] == pytest.approx((7 + 9 + 9) / 3) and board["g", "ai"]["accuracy"] == 67
    assert board["h", "human"]["correct"] == 0 and board["h", "human"]["streak"] == 0


def as_in_sql(spark, folder, events):
    """The rows of scoreboard_stream over (event_id, ts, user_id, value, k), which must be those of its SQL."""
    made = spark.createDataFrame(events, "event_id long, ts long, user_id long, value double, k int").withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    made = made.select("event_id", "ts", "user_id", F.lit("view").alias("event_type"), "value", F.to_json(F.struct("k")).alias("props"))
    made.coalesce(1).write.parquet(f"{folder}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    found = duck.sql(queries.ORACLES["scoreboard_stream"])
    got = queries.QUERIES["scoreboard_stream"](spark, str(folder)).select(*found.columns).collect()
    want = sorted(found.fetchall())
    assert sorted(tuple(r) for r in got) == want
    return want


def test_rounds_of_one_moment_count_by_number_in_the_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rounds, "PART_EVENTS", 150, raising=False)
    rng = random.Random(5)
    # copies of one stretch of time with shifted ids: ids of one to four digits share their times and games
    base = [(rng.choice([0, 60, 3600, 90_000]), rng.randrange(2), rng.uniform(0, 150), rng.randrange(99)) for _ in range(60)]
    events = [(k + 60 * copy, 1_700_000_000 + t, user + 12 * copy, value, x) for copy in range(30) for k, (t, user, value, x) in enumerate(base)]
    board = as_in_sql(spark, tmp_path, events)
    assert len(board) == 4 and {r[2] for r in board} == {10}


def test_a_silent_game_goes_on_in_the_board(spark, tmp_path):
    rng, day, start = random.Random(6), 86_400, 1_700_000_000
    # game 0 plays eight rounds, is silent for three weeks and goes on; game 1 plays all the time
    quiet = [start + 60 * k for k in range(16)] + [start + 21 * day + 60 * k for k in range(40)]
    times = sorted([(t, 0) for t in quiet] + [(start + k * day // 4, 1) for k in range(120)])
    events = [(k, t, user, rng.uniform(0, 150), rng.randrange(99)) for k, (t, user) in enumerate(times)]
    assert len(as_in_sql(spark, tmp_path, events)) == 4


class Kept(dict):
    """The state of a processor outside of a stream."""

    class List(list):
        exists, get, put = list.__len__, list.__iter__, lambda self, rows: self.__setitem__(slice(None), rows)

    def getListState(self, name, schema):  # noqa: N802
        return self.setdefault(name, self.List())


def test_a_part_holds_no_round_of_a_game_that_has_its_places():
    columns = ["game_id", "round_id", "ts", "kind", "ground_truth", "label", "elapsed_ms"]
    at = lambda k: pd.Timestamp(1_700_000_000 + k, unit="s")
    opened = [(g, f"r{k}", at(0), 0, "REAL", "FAKE", 5.0) for g in ("a", "b") for k in range(500)]
    guessed = [("a", f"r{k}", at(900 - k), 1, None, "REAL", 7.0) for k in range(500)] + [("b", "r7", at(1), 1, None, "REAL", 7.0), ("b", "r7", at(1), 1, None, "FAKE", 9.0), ("b", "r8", at(2), 1, None, "REAL", -1.0), ("b", "none", at(3), 1, None, "REAL", 1.0)]
    part, kept = rounds.FirstRounds(3), Kept()

    def send(events):
        part.init(kept)
        # Spark hands over a part in pieces, in no order of time
        pieces = [pd.DataFrame(events[i : i + 100], columns=columns) for i in range(0, len(events), 100)]
        return [r for out in part.handleInputRows((0,), iter(pieces), None) for r in out.itertuples(index=False) if r.kind == 1]

    assert sorted((r.game_id, r.round_id, r.label) for r in send(guessed + opened)) == [("a", "r497", "REAL"), ("a", "r498", "REAL"), ("a", "r499", "REAL"), ("b", "r7", "FAKE")]
    assert {r[0] for r in kept["held"]} == {"b"} and len(kept["held"]) == 500
    later = [("b", f"r{k}", at(2000 + k), 1, None, "REAL", 7.0) for k in (7, 8, 9, 10)] + [("a", "r9", at(2000), 1, None, "REAL", 7.0)]
    assert [r.round_id for r in send(later)] == ["r8", "r9"]
    assert not kept["held"] and dict(kept["passed"]) == {"a": 3, "b": 3}


# --- scores


FEATURES = "image_id string, features array<double>"
MODEL = {"mean": [0.0], "std": [1.0], "weights": [2.0], "bias": 0.0}


def put(spark, source, rows):
    spark.createDataFrame(rows, FEATURES).coalesce(1).write.mode("append").parquet(source)


def test_a_broken_batch_is_written_again_and_counts_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put(spark, source, [("a", [1.0]), ("b", [2.0]), ("b", [1.5])])
    jobs.stream_score_new_images(spark, source, FEATURES, MODEL, out, check).awaitTermination()
    put(spark, source, [("b", [9.0]), ("c", [3.0])])

    def broken(number):
        raise RuntimeError(f"lost after batch {number} was written")

    with pytest.raises(Exception, match="lost after batch"):
        jobs.stream_score_new_images(spark, source, FEATURES, MODEL, out, check, broken).awaitTermination()
    assert {r["image_id"]: r["margin"] for r in jobs.read_scores(spark, out).collect()} == {"a": 2.0, "b": 3.0}
    jobs.stream_score_new_images(spark, source, FEATURES, MODEL, out, check).awaitTermination()
    for _ in range(2):  # a run with nothing new adds nothing
        got = sorted((r["image_id"], r["margin"]) for r in jobs.read_scores(spark, out).collect())
        assert got == [("a", 2.0), ("b", 3.0), ("c", 6.0)]
        jobs.stream_score_new_images(spark, source, FEATURES, MODEL, out, check).awaitTermination()


def test_a_batch_reads_nothing_of_what_was_scored_before(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(3):
        put(spark, source, [(f"x{k}", [1.0]), ("same", [1.0])])
        jobs.stream_score_new_images(spark, source, FEATURES, MODEL, out, check).awaitTermination()
        # what earlier batches wrote is out of reach and yet no id comes twice
        for batch in Path(out, "data").glob("batch=*"):
            if not (tmp_path / "kept" / batch.name).exists():
                shutil.move(batch, tmp_path / "kept" / batch.name) if (tmp_path / "kept").exists() else shutil.copytree(batch, tmp_path / "kept" / batch.name)
                shutil.rmtree(batch, ignore_errors=True)
    ids = sorted(r["image_id"] for r in spark.read.parquet(*map(str, (tmp_path / "kept").glob("batch=*"))).collect())
    assert ids == ["same", "x0", "x1", "x2"]


def test_no_scores_yet(spark, tmp_path):
    assert jobs.read_scores(spark, str(tmp_path)).count() == 0


# --- feature tables


def features(spark, ids, conditions=("clean", "jpeg_q50")):
    return spark.createDataFrame([("d", c, i, [float(len(i))]) for c in conditions for i in ids], "dataset string, condition string, image_id string, semantic array<double>")


def test_torn_shards_do_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    assert results.write_feature_table(features(spark, ["a", "b"]), path, {"s": 1}).count() == 4
    # a writer that broke off: rows and even its unit table are there, but no marker
    done = CommitLog(spark, path).names()[0]
    for kind in ("data", "units"):
        shutil.copytree(f"{path}/{kind}/commit={done}", f"{path}/{kind}/commit=torn")
    for f in (tmp_path / "t/data/commit=torn").rglob("*.parquet"):
        f.write_bytes(f.read_bytes()[:20])
    assert results.read_feature_table(spark, path).count() == 4
    table = results.write_feature_table(features(spark, ["a", "b", "c", "c"]), path, {"s": 1})
    assert sorted((r["condition"], r["image_id"]) for r in table.collect()) == [(c, i) for c in ("clean", "jpeg_q50") for i in "abc"]


def test_pending_work_comes_from_markers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = features(spark, [f"i{k}" for k in range(200)])
    assert 0 < results.pending_units(rows, path).count() <= 2 * results.SHARDS
    results.write_feature_table(rows, path, {})
    shutil.rmtree(f"{path}/data")  # features are not read to tell what is done
    assert results.pending_units(rows, path).count() == 0
    more = rows.unionByName(features(spark, ["new"], ["clean"]))
    assert results.pending_units(more, path).count() == 1
    commits = CommitLog(spark, path).names()
    assert len(commits) == 1


def test_work_that_is_done_adds_no_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        results.write_feature_table(features(spark, ["a"]), path, {})
    assert len(CommitLog(spark, path).names()) == 1
    with pytest.raises(ValueError, match="committed"):
        results.read_feature_table(spark, str(tmp_path / "none"))
