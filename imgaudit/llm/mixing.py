"""Mixing sources to target weights by entropy balancing, in DataFrame and SQL functions only.

Every document gets a rate, the number of times it is taken on average. Among all rates of at most
MOST_COPIES that give each source its target of words, the ones of least relative entropy to equal
treatment of documents are r = min(MOST_COPIES, exp(v * size / mean size)) with one dual variable v
a source: a source that must grow does so by its long documents first, one that must shrink gives
those up first. The dual is convex; Newton iterations solve it for all sources at once, with
gradient and curvature as sums over the documents. Documents of one source and size have one rate,
so these sums run over counts of sizes, and as integers, so that their order is of no account.
Rates are rounded to whole copies along the sizes of a source, and a few documents of each size
class then settle what rounding has left over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch, free_name, materialize

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this, no source's target is above this share of its size.
MOST_COPIES = 3
#: Documents of one source and size that are ranked together; a larger cell is dealt into parts.
CELL_ROWS = 8192
#: Equal rows of one source beyond this number get parts of their own, dealt by row key.
MANY_EQUAL = 10_000
#: Documents of each size class of a source that may settle the rest of the rounding.
SPARE = 6
#: Rates are whole multiples of 2**-40.
UNIT = 1 << 40
#: The iterations end when every source is as close to its target as this, relatively.
CLOSE = 1e-7
_STEPS = 200


def word_sizes(docs: DataFrame, marks: Sequence[str] = ("doc_id", "source", "text"), row: str | None = None) -> DataFrame:
    """doc_id, source, size (words of the text; 0 if null), mark (hash of the columns ``marks``) and row (its key)."""
    spaced = F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\f\r", "     ")
    # a word starts at a character that is no space and follows a space or the beginning
    starts = F.regexp_count(spaced, F.lit(r"(?<![^ ])[^ ]"))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), starts.cast("long").alias("size"), F.xxhash64(*marks).alias("mark"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))


def source_targets(sources: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0)) -> DataFrame:
    """source, turn, source_size, target of a table ``sources(source, source_size)``, one row a source.

    Sources by code point, null last, take the weights in turn and share the total; a target stops
    at MOST_COPIES times its source's size and the excess goes to the others by weight until none
    is above. The sources are one small row each; they are ranked and shared in one place.
    """
    ranked = sources.withColumn("turn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    # Filling up in order of cap / weight: once a source takes less than its cap, all later ones do.
    ordered = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * MOST_COPIES).cast("double"))
    by_ratio = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "turn")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    shared = ordered.withColumn("total", F.sum("source_size").over(W.partitionBy(F.lit(0))).cast("double"))
    shared = shared.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    level = F.col("rest") / F.col("open")
    # the first source that is not filled sets the level for itself and all after it
    shared = shared.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    shared = shared.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
    return shared.select("source", "turn", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _rate(v: Column, size: Column, mean: Column) -> Column:
    """The tilted rate in multiples of 1 / UNIT; MOST_COPIES where v is null."""
    most = MOST_COPIES * UNIT
    # the exponent stops where the rate has reached its bound
    tilted = F.round(F.exp(F.least(v * size / mean, F.lit(1.2))) * float(UNIT)).cast("long")
    return F.when(v.isNull(), F.lit(most)).otherwise(F.least(tilted, F.lit(most)))


def balance_rates(cells: DataFrame, targets: DataFrame, own: Scratch, few: bool) -> DataFrame:
    """turn, v, mean of every source, by Newton iterations on the dual of all sources at once.

    ``cells(turn, size, n)`` counts the documents of each source and size above 0. The iterations
    compare logarithms of words taken and targets; a step that leaves the interval known to hold the
    solution halves it instead, so they always end. A source whose target is its bound has no
    finite v: null, taken MOST_COPIES times.
    """
    words = F.sum(F.col("n") * F.col("size"))
    means = cells.groupBy("turn").agg((words / F.sum("n")).alias("mean"))
    dual = targets.where("source_size > 0").join(means, "turn")
    full = F.col("target") >= F.col("source_size") * (MOST_COPIES * (1 - 1e-12))
    start = F.when(~full, F.log(F.col("target") / F.col("source_size")))
    dual = own.write(dual.select("turn", "target", "mean", start.alias("v"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("gap")), "dual")
    exact = lambda c: c.cast("decimal(20,0)")
    for _ in range(_STEPS):
        open_ = dual.where(F.col("v").isNotNull() & (F.col("gap") > CLOSE))
        if open_.isEmpty():
            return dual.select("turn", "v", "mean")
        known = open_.select("turn", "v", "mean")
        rated = cells.join(F.broadcast(known) if few else known, "turn").withColumn("rate", _rate(F.col("v"), F.col("size"), F.col("mean")))
        mass = exact(F.col("n") * F.col("size")) * F.col("rate").cast("decimal(13,0)")
        steep = F.when(F.col("rate") < MOST_COPIES * UNIT, mass.cast("decimal(33,0)")).otherwise(F.lit(0).cast("decimal(33,0)"))
        sums = rated.groupBy("turn").agg(F.sum(mass).cast("double").alias("taken"), F.sum((steep * F.col("size").cast("decimal(10,0)")).cast("decimal(38,0)")).cast("double").alias("slope"))
        moved = dual.join(F.broadcast(sums) if few else sums, "turn", "left").withColumn("over", F.log(F.col("taken") / UNIT / F.col("target")))
        moved = moved.withColumn("low", F.when(F.col("over") < 0, F.col("v")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("over") > 0, F.col("v")).otherwise(F.col("high")))
        step = F.col("over") * F.col("taken") * F.col("mean") / F.col("slope")
        newton = F.col("v") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce(step, F.when(F.col("over") < 0, -4.0).otherwise(4.0))))
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        next_ = F.when(F.col("taken").isNull() | (F.abs("over") <= CLOSE), F.col("v")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        dual = own.write(moved.select("turn", "target", "mean", next_.alias("v"), "low", "high", F.coalesce(F.abs("over"), "gap").alias("gap")), "dual")
    raise RuntimeError(f"the mix did not settle in {_STEPS} steps")


def _few(sources: DataFrame, most: int = 100_000) -> bool:
    """Whether the rows may be broadcast; with more, the join shuffles."""
    return sources.limit(most + 1).count() <= most


def _noise(key: Column) -> Column:
    return F.xxhash64(key, F.lit("mix"))


def rounded_copies(sizes: DataFrame, cells: DataFrame, targets: DataFrame, dual: DataFrame, own: Scratch, few: bool) -> DataFrame:
    """row, doc_id, turn, size, source_size, target, class, h, copies of every row of ``sizes``.

    Fractions of rates run up along the sizes of a source, largest first; where the running sum
    passes a whole number, the cell at hand gets an extra copy, and its rows of least hash take
    them. Cells are counts of a source, size and part: a source's running sum goes over as many
    rows as it has sizes, plus one for every CELL_ROWS documents of one size. Rows that are equal in
    all that counts are dealt by row key where there are many, so no task ranks all rows without an
    id. Which of equal rows gets the copy is of no account.
    """
    hot_cells = own.write(cells.where(F.col("n") > CELL_ROWS).select("turn", "size", F.ceil(F.col("n") / CELL_ROWS).alias("parts")), "hot-cells")
    equal = own.write(sizes.groupBy(_noise(F.col("mark")).alias("h")).agg(F.count("*").alias("n")).where(F.col("n") > MANY_EQUAL).select("h", F.ceil(F.col("n") / MANY_EQUAL).alias("deals")), "many-equal")
    small = lambda df: F.broadcast(df) if _few(df) else df
    rows = sizes.withColumn("h", _noise(F.col("mark"))).join(small(hot_cells), ["turn", "size"], "left").join(small(equal), "h", "left")
    hot = F.col("deals").isNotNull()
    rows = rows.withColumn("part", F.when(hot, F.col("h")).otherwise(F.pmod("h", F.coalesce("parts", F.lit(1))))).withColumn("deal", F.when(hot, F.pmod("row", "deals")).otherwise(0)).withColumn("hot", hot)
    keys = ["turn", "size", "hot", "part", "deal"]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    known = targets.select("turn", "source_size", "target").join(dual, "turn", "left")
    rate = F.when((F.col("size") == 0) | (F.col("source_size") == 0), F.lit(0).cast("long")).otherwise(_rate(F.col("v"), F.col("size"), F.col("mean")))
    rated = counted.join(F.broadcast(known) if few else known, "turn").withColumn("rate", rate)
    rated = rated.withColumn("whole", F.expr(f"rate div {UNIT}")).withColumn("parts", (F.col("n").cast("decimal(18,0)") * F.expr(f"rate % {UNIT}").cast("decimal(13,0)")).cast("decimal(31,0)"))
    line = W.partitionBy("turn").orderBy(F.col("size").desc(), "hot", "part", "deal")
    phase = F.pmod(_noise(F.col("turn").cast("string")), F.lit(UNIT)).cast("decimal(13,0)")
    summed = rated.withColumn("to", (F.sum("parts").over(line.rowsBetween(W.unboundedPreceding, 0)) + phase).cast("decimal(38,0)"))
    extra = F.expr(f"(to div cast({UNIT} as decimal(13,0))) - (cast(to - parts as decimal(38,0)) div cast({UNIT} as decimal(13,0)))")
    given = own.write(summed.select(*keys, "source_size", "target", "whole", extra.alias("extra")), "cell-copies")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("h", F.col("doc_id").asc_nulls_last(), "row"))
    placed = rows.drop("parts", "deals").withColumn("rank", rank).join(given, keys)
    copies = F.col("whole") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return placed.select("row", "doc_id", "turn", "size", "source_size", "target", F.length(F.bin("size")).alias("class"), "h", copies.alias("copies"))


def settled(copies: DataFrame, few: bool) -> DataFrame:
    """``copies`` with a few documents of each source changed, so that sums come near targets.

    From every size class of a source, the SPARE documents of least hash that may gain a copy or
    that may lose one are lined up by size, largest first; one pass over this bounded list
    takes each change that is no larger than what is still missing.
    """
    sums = copies.groupBy("turn").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("goal"))
    gaps = sums.select("turn", (F.col("goal") - F.col("taken")).alias("gap"))
    able = copies.where("size > 0").join(F.broadcast(gaps) if few else gaps, "turn")
    change = F.when(F.col("gap") > 0, 1).when(F.col("gap") < 0, -1)
    room = F.when(F.col("gap") > 0, MOST_COPIES - F.col("copies")).otherwise(F.col("copies"))
    able = able.withColumn("change", change).withColumn("room", room.cast("int")).where("change is not null and room > 0 and size <= abs(gap)")
    nth = F.row_number().over(W.partitionBy("turn", "class").orderBy("h", F.col("doc_id").asc_nulls_last(), "copies", "row"))
    picked = able.withColumn("nth", nth).where(F.col("nth") <= SPARE).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("room"))))
    lists = picked.groupBy("turn").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "h", "doc_id", "copies", "row", "change", "step")))).alias("spare"), F.first("gap").alias("gap"))
    # at most SPARE documents of each of some 40 size classes, each once for every copy it may gain or lose
    none = F.array().cast("array<struct<row:bigint,change:int>>")
    chosen = F.aggregate(
        "spare",
        F.struct(F.col("gap").alias("left"), none.alias("done")),
        lambda acc, x: F.when(
            x["size"] <= F.abs(acc["left"]),
            F.struct(
                (acc["left"] - x["size"] * x["change"]).alias("left"),
                F.concat(acc["done"], F.array(F.struct(x["row"].alias("row"), x["change"].cast("int").alias("change")))).alias("done"),
            ),
        ).otherwise(acc),
        lambda acc: acc["done"],
    )
    changes = lists.select(F.explode(chosen).alias("c")).groupBy("c.row").agg(F.sum("c.change").alias("change"))
    joined = copies.join(F.broadcast(changes) if few else changes, "row", "left")
    final = F.col("copies") + F.coalesce("change", F.lit(0))
    return joined.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(MOST_COPIES), final)).cast("long")).drop("change")


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0)) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of ``docs``.

    A null text has size 0 and is not taken; a null source is one source, the last; rows with equal
    or null doc_ids are rounded row by row; other columns are ignored; an empty table gives no
    rows. Nothing is random and all sums are exact: equal tables give equal mixes.
    """
    with Scratch(docs.sparkSession, "mix") as own:
        counted = _counted(word_sizes(docs), weights, own)
        return materialize(counted.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies"), "mix")


def _counted(sized: DataFrame, weights: Sequence[float], own: Scratch) -> DataFrame:
    """The copies of every row of ``sized``, with its row key."""
    sizes = own.write(sized, "word-sizes")
    targets = own.write(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    few = _few(targets)
    names = targets.select(F.col("source").alias("_source"), "turn")
    sizes = sizes.join(F.broadcast(names) if few else names, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    cells = own.write(sizes.where("size > 0").groupBy("turn", "size").agg(F.count("*").alias("n")), "cells")
    dual = balance_rates(cells, targets, own, few)
    return settled(own.write(rounded_copies(sizes, cells, targets, dual, own, few), "copies"), few)


def mixed(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0)) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it.

    Rows are written once with a key of their own; doc_ids may be null or repeated.
    """
    row, key, copies, turn = (free_name(docs, c) for c in ("_row", "_id", "_copies", "_copy"))
    named = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    marks = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    with Scratch(docs.sparkSession, "mix") as own:
        counts = _counted(word_sizes(named, marks, row), weights, own).where("copies > 0").select(F.col("row").alias(key), F.col("copies").alias(copies))
        counts = materialize(counts, "mix")
    taken = named.join(counts.hint("merge"), F.col(row) == F.col(key))  # one row for each taken row: never broadcast
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)
