"""Near duplicates of 64-bit hashes by combinations of blocks.

A hash is cut into BLOCKS blocks. Hashes within ``bits`` bits agree in all blocks but ``bits`` of
them, so they share the signature of some combination of BLOCKS - bits blocks: a key of 21 bits at
four bits, where single bands have 13. A pair is kept under its first common combination only, so
none is found twice and nothing has to be made distinct.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offset and width of each band.
BANDS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Blocks of a hash: two more than the bits that may differ.
EXTRA = 2
#: Hashes of the left side that one task of a key gets; a key with more is dealt to several, with a copy of the right side each.
HOT = 4096


def hash_bands(h: Column) -> Column:
    """One number for each band: its index and its bits."""
    return F.array(*[F.shiftrightunsigned(h, o).bitwiseAND(F.lit((1 << w) - 1)) + F.lit(i << 13) for i, (o, w) in enumerate(BANDS)])


def blocks(n: int) -> list[int]:
    """Masks of n blocks of the 64 bits, as signed numbers; widths differ by one at most."""
    ends = [64 * k // n for k in range(n + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed((1 << b) - (1 << a)) for a, b in zip(ends, ends[1:], strict=False)]


def signatures(h: Column, bits: int) -> Column:
    """(combination, masked hash) for each combination of EXTRA blocks of bits + EXTRA."""
    masks = blocks(bits + EXTRA)
    made = [(i, sum(masks[k] for k in some)) for i, some in enumerate(combinations(range(len(masks)), EXTRA))]
    return F.array(*[F.struct(F.lit(i).alias("combination"), h.bitwiseAND(F.lit(mask)).alias("part")) for i, mask in made])


def _first_common(difference: Column, bits: int) -> Column:
    """The first combination of blocks in which two hashes agree."""
    masks = blocks(bits + EXTRA)
    agree = [difference.bitwiseAND(F.lit(mask)) == 0 for mask in masks]
    out = F.lit(None).cast("int")
    for i, some in reversed(list(enumerate(combinations(range(len(masks)), EXTRA)))):
        both = agree[some[0]]
        for k in some[1:]:
            both = both & agree[k]
        out = F.when(both, F.lit(i)).otherwise(out)
    return out


def candidates(left: DataFrame, right: DataFrame, bits: int = 4) -> DataFrame:
    """a, b and combination of the distinct hashes(h) of both sides that share a signature.

    Keys with many hashes are dealt to several tasks by the left hash.
    """
    sides = []
    for df, name in ((left, "a"), (right, "b")):
        own = df.where("h is not null").select(F.col("h").alias(name)).distinct()
        sides.append(own.withColumn("s", F.explode(signatures(F.col(name), bits))).select(name, "s.*"))
    x, y = sides
    # only keys of many hashes are listed: at most one for HOT rows of the left side
    hot = x.groupBy("combination", "part").agg(F.ceil(F.count("*") / HOT).cast("int").alias("deals")).where("deals > 1")
    key = ["combination", "part"]
    x = x.join(hot, key, "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("a"), F.col("deals")), F.lit(0)).cast("int"))
    y = y.join(hot, key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)))
    return x.drop("deals").join(y.drop("deals"), [*key, "deal"]).select("a", "b", "combination")


def near_pairs(left: DataFrame, right: DataFrame, bits: int = 4) -> DataFrame:
    """a, b, distance of the distinct hashes(h) of both sides within ``bits`` bits; each pair once.

    Equal hashes collapse before the join, so a frequent hash is one row; copies are not expanded. A null hash is near none.
    """
    difference = F.col("a").bitwiseXOR(F.col("b"))
    distance = F.bit_count(difference)
    found = candidates(left, right, bits).where((distance <= bits) & (F.col("combination") == _first_common(difference, bits)))
    return found.select("a", "b", distance.alias("distance"))


def near_duplicate_summary(evaluation: DataFrame, training: DataFrame, bits: int = 4) -> DataFrame:
    """For each dataset of ``evaluation(dataset, image_id, h, label)``: rows, rows near a training row,

    rows near a training row of the other label, and the sources of ``training(h, label, source)``.
    """
    pairs = near_pairs(evaluation, training, bits)
    known = training.groupBy(F.col("h").alias("b")).agg(F.max(F.col("label")).alias("hi"), F.min(F.col("label")).alias("lo"), F.collect_set("source").alias("sources"))
    near = pairs.join(known, "b").groupBy("a").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.array_distinct(F.flatten(F.collect_set("sources"))).alias("sources"))
    rows = evaluation.join(near, evaluation["h"] == near["a"], "left")
    other = F.col("hi").isNotNull() & ((F.col("hi") != F.col("label")) | (F.col("lo") != F.col("label")))
    return rows.groupBy("dataset").agg(
        F.count("*").alias("n_rows"),
        F.count("hi").alias("n_near"),
        F.count_if(other).alias("n_opposite"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("sources", F.array().cast("array<string>")))))), ",").alias("sources"),
    )
