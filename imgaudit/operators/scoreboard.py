"""Rounds of people against a detector: results and scoreboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finish_rounds(rounds: DataFrame, guesses: DataFrame) -> DataFrame:
    """One row for each round with a guess: the first one counts, guesses on unknown rounds do not.

    rounds(round_id, match_id, ground_truth, ai_label, ai_elapsed_ms), guesses(round_id, ts, label, elapsed_ms).
    """
    first = guesses.where("label in ('REAL', 'FAKE') and elapsed_ms between 0 and 360000").groupBy("round_id").agg(F.min_by(F.struct("label", "elapsed_ms", "ts"), F.struct("ts", "label", "elapsed_ms")).alias("g"))
    out = rounds.join(first, "round_id").withColumn("human_correct", F.col("g.label") == F.col("ground_truth")).withColumn("ai_correct", F.col("ai_label") == F.col("ground_truth"))
    return out.select(*rounds.columns, F.col("g.ts").alias("ts"), F.col("g.label").alias("human_label"), F.col("g.elapsed_ms").alias("human_elapsed_ms"), "human_correct", "ai_correct")


def rejected_guesses(rounds: DataFrame, guesses: DataFrame) -> DataFrame:
    return guesses.join(rounds.select("round_id"), "round_id", "left_anti")


def scoreboard(finished: DataFrame, rounds_per_match: int = 10) -> DataFrame:
    """match_id, side, completed, correct, accuracy %, mean time, current streak; first rounds of a match."""
    kept = finished.withColumn("turn", F.row_number().over(W.partitionBy("match_id").orderBy("ts", "round_id"))).where(F.col("turn") <= rounds_per_match)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_correct").alias("ok"), F.col(f"{s}_elapsed_ms").cast("double").alias("ms")) for s in ("human", "ai")])
    rows = kept.select("match_id", "turn", F.explode(sides).alias("s")).select("match_id", "turn", "s.*")
    out = rows.groupBy("match_id", "side").agg(
        F.count("*").alias("completed"),
        F.count_if("ok").alias("correct"),
        F.avg("ms").alias("mean_ms"),
        (F.max("turn") - F.coalesce(F.max(F.when(~F.col("ok"), F.col("turn"))), F.lit(0))).alias("streak"),
    )
    return out.withColumn("accuracy", F.round(F.col("correct") * 100.0 / F.col("completed")).cast("int"))


def match_winners(board: DataFrame) -> DataFrame:
    """match_id, points of both sides and the winner: one point for accuracy, one for time, ties give none."""
    wide = board.groupBy("match_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("human", "ai") for c in ("accuracy", "mean_ms")])
    point = lambda a, b: F.when(a, 1).otherwise(0) + F.when(b, 1).otherwise(0)
    h = point(F.col("human_accuracy") > F.col("ai_accuracy"), F.col("human_mean_ms") < F.col("ai_mean_ms"))
    a = point(F.col("ai_accuracy") > F.col("human_accuracy"), F.col("ai_mean_ms") < F.col("human_mean_ms"))
    out = wide.withColumn("human_points", h).withColumn("ai_points", a)
    return out.withColumn("winner", F.when(F.col("human_points") > F.col("ai_points"), "human").when(F.col("human_points") < F.col("ai_points"), "ai").otherwise("draw"))
