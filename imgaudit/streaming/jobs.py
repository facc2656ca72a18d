"""The two incremental jobs: scoring of new feature rows and the running scoreboard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import probe
from ..sources.commits import CommitLog


#: Setting of the state store, and the store that keyed state needs.
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state of what was scored; each holds its share of the ids.
BUCKETS = 256


class FirstScores(StatefulProcessor):
    """Lets the rows of an image id pass once, in the first batch that has it; of several in that batch the least score."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "image_id string", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["image_id", "margin", "prob"]).drop_duplicates("image_id")
        new = batch[[not self.seen.containsKey((i,)) for i in batch["image_id"]]]
        for i in new["image_id"]:
            self.seen.updateValue((i,), (True,))
        if len(new):
            yield new[["image_id", "margin", "prob"]]

    def close(self) -> None:
        pass


def stream_score_new_images(spark: SparkSession, features_path: str, schema: str, model: dict, out: str, checkpoint: str, written: Callable[[int], None] | None = None) -> StreamingQuery:
    """Score feature rows as files arrive; an image is written once, also after a restart.

    Which ids were scored is keyed state of the stream, so a batch costs the same however much was
    scored before. A batch is written to a folder of its number, replacing what a broken run of it
    left, and counts from its marker on; ``read_scores`` reads no other. ``written`` is called between both.
    """
    rows = spark.readStream.schema(schema).parquet(features_path)
    scored = probe.score(rows, model).select("image_id", "margin", "prob").withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(BUCKETS)))
    fresh = scored.groupBy("bucket").transformWithStateInPandas(statefulProcessor=FirstScores(), outputStructType="image_id string, margin double, prob double", outputMode="Append", timeMode="None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number:09d}")
        if written:
            written(number)
        CommitLog(spark, out).commit(f"{number:09d}", {"batch": number})

    # a query keeps the state store that its session names when it starts
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    """image_id, margin and prob of all finished batches of ``stream_score_new_images``."""
    names = CommitLog(spark, out).names()
    read = spark.read.schema("image_id string, margin double, prob double")
    return read.parquet(*[f"{out}/data/batch={n}" for n in names]) if names else spark.createDataFrame([], "image_id string, margin double, prob double")


def finished_rounds_stream(rounds: DataFrame, guesses: DataFrame, late: str = "10 minutes", open_for: str = "6 minutes") -> DataFrame:
    """Rounds joined with their first guess; both sides have a ts. State is dropped by event time.

    A guess counts if it comes within ``open_for`` after its round began; what is later finds the
    round gone. With a column elapsed_ms, guesses outside 0 to 360000 are left out.
    """
    if "elapsed_ms" in guesses.columns:
        guesses = guesses.where("elapsed_ms between 0 and 360000")
    r = rounds.withWatermark("ts", late).alias("r")
    g = guesses.where("label in ('REAL', 'FAKE')").withWatermark("ts", late).dropDuplicatesWithinWatermark(["round_id"]).alias("g")
    on = F.expr(f"r.round_id = g.round_id and g.ts >= r.ts and g.ts <= r.ts + interval {open_for}")
    return r.join(g, on).select("r.round_id", "r.match_id", F.col("g.ts").alias("ts"), (F.col("g.label") == F.col("r.ground_truth")).alias("human_correct"), (F.col("r.ai_label") == F.col("r.ground_truth")).alias("ai_correct"))


def scoreboard_stream(finished: DataFrame, window: str = "1 hour") -> DataFrame:
    """Completed and correct rounds of both sides by window and match."""
    return finished.groupBy(F.window("ts", window), "match_id").agg(F.count("*").alias("completed"), F.count_if("human_correct").alias("human_correct"), F.count_if("ai_correct").alias("ai_correct"))
