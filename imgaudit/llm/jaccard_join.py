"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Each document is the set of its distinct word shingles, ordered by a corpus-wide estimate of how
many documents hold a shingle, rare ones first. Two sets x and y that link share at least
``least(|x|, |y|)`` shingles, so they share at least l shingles among the first |x| - least + l of x
and |y| - least + l of y, for every l. Each set chooses its own l: a longer prefix costs more
entries to compare, and in return a pair must share l of them before it is verified. By the
estimated frequencies, a prefix of total read(l) has at most read(l) / l candidates, so the l of
least read(l) * (1 + VERIFY * n / l) is taken, 1 where no other document is expected to hold any
prefix shingle and up to the whole set. A pair uses the smaller l of its two sets, for which both
prefixes are long enough. Postings are made of the prefix for l = 1 alone, which must hold a common
shingle in any case: postings of the longer ones would list each pair of a large group many times.

A posting's token is a shingle with a class of set sizes, as wide as the sizes that may link: a set
stands below its own class, with the prefix for partners of at least that class, and below the
class before it, for smaller partners. Sets of too different sizes so share no token, and tokens
of one set alone, most of them, are never joined. Before whole sets are compared, a parity bitmap
of each (a bit flips with every shingle it gets) bounds in how many shingles the two differ.

Large groups of near copies would make all pairs of a group candidates. Instead every set is first
verified against one hub among its candidates (the set with most copies), which already connects
such groups; then only pairs of sets in different components are candidates, so what is left grows
with the documents and not with the square of a group, and no component is missed.

Texts are written once with numbers of their own, so that later steps join numbers, straight from
written tables that Spark can split where they are hot, and only candidates are shingled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest_roots
from .counters import count_all
from .store import Scratch, bitmap, bitmap_bits, free_name, held, in_bitmap, materialize, only_in
from .words import SPACED, batch_words, grams, mix, text_bytes

#: Buckets of the sketch of document frequencies: 2**22 counters of two bytes. With many more
#: shingles it still tells apart what is commoner than an average bucket; any order is right.
SKETCH_BITS = 22
#: Cost of verifying one candidate for each shingle of a set, in postings read.
VERIFY = 0.125
#: Sets whose postings are made at a time.
SLICE = 1024

_SETS = "row long, doc_id long, n_shingles long, high long, low long, matches int, tokens array<long>, parity array<long>"
_CLASS = np.uint64(0xA0761D6478BD642F)


def _shingle_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for first, hashes, _, _, bounds in batch_words(data, offsets, SPACED):
            yield batch, first, [np.unique(grams(hashes[bounds[i] : bounds[i + 1]], size)) for i in range(len(bounds) - 1)]


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits for a set: two sums of its elements, mixed in two ways, with its size."""
    n, out = np.uint64(len(shingles)), []
    with np.errstate(over="ignore"):
        for a, b in ((0x7FB5D329728EA185, 0x81DADEF4BC2DD44D), (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)):
            x = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(a)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(b)
            out.append(int((x ^ (x >> np.uint64(29))).sum(dtype=np.uint64) + n * np.uint64(0x9E3779B97F4A7C15)))
    return out[0], out[1]


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each bit of a power of two of them, 64 and as many as shingles at least: whether an odd number of shingles falls on it.

    Two bitmaps differ in no more bits than their sets differ in shingles, also when the longer one
    is folded to the length of the other.
    """
    bits = 64
    while bits < len(shingles):
        bits *= 2
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def document_frequencies(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """Documents per hash bucket of their shingles; 2**bits numbers, 65,535 at most, over all documents."""

    def fill(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        for _, _, sets in _shingle_sets(batches, size):
            if sets:
                np.add.at(total, (np.concatenate(sets) & np.uint64(len(total) - 1)).astype(np.int64), 1)

    return count_all(docs.select("text"), fill, 1 << bits, np.uint16)


def _base(n: int, t: int) -> int:
    """Length of the prefix for one match with the smallest partner, of t percent of the size."""
    return n - (-(-t * n // 100)) + 1


def matches_of(others: np.ndarray, t: int) -> int:
    """The l that costs a set least; ``others``: how many other documents hold each shingle, in order."""
    base = _base(len(others), t)
    read = np.cumsum(others)[base - 1 :]
    return int(np.argmin(read * (1 + VERIFY * len(others) / np.arange(1, len(read) + 1)))) + 1


def _prefix(shingles: np.ndarray, frequency: np.ndarray, load: float, t: int) -> tuple[np.ndarray, int]:
    """The prefix that costs least, rare shingles first, and the matches it demands."""
    df = frequency[(shingles & np.uint64(len(frequency) - 1)).astype(np.int64)]
    order = np.lexsort((shingles, df))
    # of a counter, ``load`` on average comes from unrelated shingles
    matches = matches_of(np.maximum(df[order] - (1.0 + load), 0.0), t)
    return shingles[order[: _base(len(shingles), t) + matches - 1]], matches


def shingle_table(texts: DataFrame, size: int, t: int, own: Scratch, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per row of ``texts(row, doc_id, text)``: its number, set size, 128-bit key, l, prefix and parity bitmap."""
    frequency = document_frequencies(texts, size, bits)
    load = float(np.median(frequency))
    known = texts.sparkSession.sparkContext.broadcast(frequency)
    del frequency

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = known.value
        for batch, first, sets in _shingle_sets(batches, size):
            parts = [_prefix(s, frequency, load, t) if len(s) else (s, 1) for s in sets]
            keys = np.array([_set_key(s) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").slice(first, len(sets)),
                    batch.column("doc_id").slice(first, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                    pa.array([m for _, m in parts], pa.int32()),
                    _lists([p for p, _ in parts]),
                    _lists([parity(s) for s in sets]),
                ],
                names=["row", "doc_id", "n_shingles", "high", "low", "matches", "tokens", "parity"],
            )

    out = own.write(texts.mapInArrow(run, _SETS), "prefixes")
    known.destroy()
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _whole_sets(texts: DataFrame, size: int, known: Broadcast) -> DataFrame:
    """(row, shingles) of the rows of ``texts`` whose hashed numbers may be in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (batch.filter(pa.array(held(batch.column("key"), known))) for batch in batches)
        for batch, first, sets in _shingle_sets(some, size):
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, len(sets)), _lists(sets)], names=["row", "shingles"])

    return texts.select("row", "text", F.xxhash64("row").alias("key")).mapInArrow(run, "row long, shingles array<long>")


def _least(n: Column, m: Column, t: int) -> Column:
    """Least intersection of linking sets of these sizes."""
    return F.ceil((n + m) * t / (100 + t))


def _bits_apart(x: str, y: str) -> Column:
    """In how many bits two parity bitmaps differ, the longer one folded."""
    fold = lambda s: f"aggregate(sequence(i, size({s}), least(size({x}), size({y}))), 0L, (word, j) -> word ^ element_at({s}, j))"
    return F.expr(f"aggregate(sequence(1, least(size({x}), size({y}))), 0, (bits, i) -> bits + bit_count({fold(x)} ^ {fold(y)}))")


def _joined(pairs: DataFrame, rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``pairs(a, b)`` with structs x and y of the rows that ``key`` numbers."""
    x = rows.select(F.col(key).alias("a"), F.struct(*names).alias("x"))
    y = rows.select(F.col(key).alias("b"), F.struct(*names).alias("y"))
    return pairs.join(x, "a").join(y, "b")


def _verified(pairs: DataFrame, heads: DataFrame, texts: DataFrame, size: int, t: int, own: Scratch) -> DataFrame:
    """The pairs(a, b) whose whole sets link; ``pairs`` is a written table of row numbers.

    First the parity bitmaps and the longer prefixes decide, then the whole sets of what is left.
    Bitmaps of row numbers keep most other rows out of the shuffles.
    """
    known = _numbers(pairs)
    least, shared = F.least("x.matches", "y.matches"), _least(F.col("x.n"), F.col("y.n"), t)
    reach = lambda s: F.slice(f"{s}.tokens", F.lit(1), (F.col(f"{s}.n") - shared + least).cast("int"))
    both = _joined(pairs, only_in(heads, F.xxhash64("set_id"), known), "set_id", ["n", "matches", "tokens", "parity"])
    close = both.where(_bits_apart("x.parity", "y.parity") <= F.col("x.n") + F.col("y.n") - 2 * shared)
    plausible = own.write(close.where(F.size(F.array_intersect(reach("x"), reach("y"))) >= least).select("a", "b"), "plausible")
    known.destroy()
    known = _numbers(plausible)
    both = _joined(plausible, _whole_sets(texts, size, known), "row", ["shingles"])
    common = F.size(F.array_intersect("x.shingles", "y.shingles"))
    links = both.withColumn("i", common).where(100 * F.col("i") >= t * (F.size("x.shingles") + F.size("y.shingles") - F.col("i")))
    own.release()
    out = own.write(links.select("a", "b"), "links")
    known.destroy()
    own.drop("plausible")
    own.release()
    return out


def _numbers(pairs: DataFrame) -> Broadcast:
    """A bitmap of the hashed numbers in pairs(a, b); a sparse one, since the pairs name few of all rows."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    return pairs.sparkSession.sparkContext.broadcast(bitmap(ids, F.xxhash64("id"), bitmap_bits(16 * pairs.count())))


def _heads(table: DataFrame, distinct: DataFrame, own: Scratch) -> DataFrame:
    """(set_id, n, matches, tokens, parity, copies): the prefix of each distinct set, once."""
    prefixes = table.where("n_shingles > 0").select(F.col("row").alias("set_id"), F.col("n_shingles").alias("n"), "matches", "tokens", "parity")
    return own.write(prefixes.join(distinct.select("set_id", "copies"), "set_id"), "heads")


def _entries(batch: pa.RecordBatch, t: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, tokens, whether below the own class, positions in the prefix, indices of the sets) for some of the rows (n, tokens) at a time."""
    wide = max(1.05, 1.001 * 100 / t)  # sizes that may link are less than a class apart, rounding included
    for first in range(0, batch.num_rows, SLICE):
        some = batch.slice(first, SLICE)
        n, shingles = some.column("n").to_numpy(), some.column("tokens")
        size_class = np.floor(np.log(n) / np.log(wide)).astype(np.int64)
        begin = wide**size_class
        smallest = -(-t * n // 100)
        # the smallest partner of the own class or the next; rounded down, as a longer prefix loses nothing
        partner = np.maximum(smallest, np.floor(begin * 0.9999).astype(np.int64))
        own = n + (-(n + partner) * t) // (100 + t) + 1
        below = np.where((size_class > 0) & (smallest < begin * 1.0001), n - smallest + 1, 0)
        lengths = np.concatenate((own, below))
        row = np.repeat(np.tile(np.arange(len(n)), 2), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        classes = np.repeat(np.concatenate((size_class, size_class - 1)).astype(np.uint64), lengths)
        values = shingles.values.to_numpy()[np.asarray(shingles.offsets)[row] + at].view(np.uint64)
        yield some, mix(values ^ (classes + np.uint64(1)) * _CLASS), np.arange(len(row)) < own.sum(), at, row


def _postings(heads: DataFrame, t: int, own: Scratch) -> DataFrame:
    """(token, at, set_id, n, copies) of the tokens that more than one set has, one of them below its own class."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens, low, _, _ in _entries(batch, t):
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(low)], names=["token", "low"])

    held_by = heads.select("n", "tokens").mapInArrow(flat, "token long, low boolean").groupBy("token").agg(F.count("*").alias("sets"), F.max("low").alias("low"))
    shared = own.write(held_by.where("sets > 1 and low").select("token"), "shared-tokens")
    own.release()
    known = heads.sparkSession.sparkContext.broadcast(bitmap(shared, F.col("token"), bitmap_bits(shared.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, tokens, _, at, row in _entries(batch, t):
                keep = in_bitmap(known.value, tokens)
                take = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[keep].view(np.int64)), pa.array(at[keep].astype(np.int32)), *[some.column(c).take(take) for c in ("set_id", "n", "copies")]],
                    names=["token", "at", "set_id", "n", "copies"],
                )

    out = own.write(heads.select("set_id", "n", "copies", "tokens").mapInArrow(run, "token long, at int, set_id long, n long, copies long"), "postings")
    known.destroy()
    own.drop("shared-tokens")
    return out


def _close(t: int) -> Column:
    """The sizes of x and y allow a link, and the common token is in both prefixes for this pair."""
    n, m = F.col("x.n"), F.col("y.n")
    least = _least(n, m, t)
    return (100 * F.least(n, m) >= t * F.greatest(n, m)) & (F.col("x.at") <= n - least) & (F.col("y.at") <= m - least)


def set_components(texts: DataFrame, table: DataFrame, distinct: DataFrame, size: int, t: int, own: Scratch) -> DataFrame:
    """(node, component) of the distinct sets, by number, that link with any other."""
    heads = _heads(table, distinct, own)
    own.drop("prefixes")  # as large as the heads
    own.release()
    postings = _postings(heads, t, own)
    own.release()
    # 1. one hub for each set: among the candidates at hand the one with most copies
    hubs = postings.groupBy("token").agg(F.max(F.struct("copies", "set_id", "n", "at")).alias("y"))
    star = (
        postings.select("token", F.struct("set_id", "n", "at").alias("x"))
        .join(hubs, "token")
        .where((F.col("x.set_id") != F.col("y.set_id")) & _close(t))
        .groupBy(F.col("x.set_id").alias("a"))
        .agg(F.max(F.struct("y.copies", "y.set_id")).alias("hub"))
        .select("a", F.col("hub.set_id").alias("b"))
    )
    # a hub has more copies or, of as many, a larger number than its sets, so these links have no cycles
    label = forest_roots(_verified(own.write(star, "stars"), heads, texts, size, t, own), own)
    # 2. every pair of sets in different components with a common token. Of a token's sets, those in its largest component are never paired with each other.
    tagged = own.write(postings.join(label.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "tagged")
    own.drop("postings")  # as large as what is tagged
    own.release()
    apart = tagged.groupBy("token").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last").select("token")
    rows = own.write(tagged.join(apart, "token").select("token", "component", F.struct("set_id", "n", "at").alias("set")), "open")
    own.drop("tagged")
    own.release()
    per = rows.groupBy("token", "component").agg(F.count("*").alias("k"))
    major = own.write(per.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("major")), "major")
    x = rows.join(major, "token").where("component <> major").select("token", F.col("component").alias("of_x"), "major", F.col("set").alias("x"))
    y = rows.select("token", F.col("component").alias("of_y"), F.col("set").alias("y"))
    pairs = (
        own.write(x, "minor")
        .join(y, "token")
        .where((F.col("of_x") != F.col("of_y")) & ((F.col("of_y") == F.col("major")) | (F.col("of_x") < F.col("of_y"))) & _close(t))
        .select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"))
        .distinct()
    )
    written = own.write(pairs, "pairs")
    own.release()
    known = _verified(written, heads, texts, size, t, own)
    if known.isEmpty():
        return label
    # the late links connect components of the early ones
    for end in ("a", "b"):
        named = label.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        known = known.join(named, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    above = connected_components(known.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), own=own).select(F.col("node").alias("component"), F.col("component").alias("top"))
    every = label.union(known.select("a", "of_a")).union(known.select("b", "of_b")).distinct()
    return every.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of ``docs``.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets; a text
    of fewer words than ``size`` is one shingle, one without words (or null) has none, links with
    nothing and is its own component. Rows that repeat a doc_id are kept, each with its own text's
    set; a null doc_id keeps its row and takes the smallest id of its component, null if there is
    none. Other columns are ignored; an empty table gives no rows. Shingles are 64-bit hashes, sets
    are told apart by 128 bits. The result is written; intermediate tables are removed.
    """
    with Scratch(docs.sparkSession, "jaccard") as own:
        texts = own.write(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text"), "texts")
        table = shingle_table(texts, size, percent, own, sketch_bits)
        keys = own.write(table.select("row", "doc_id", "n_shingles", "high", "low"), "keys")
        full = keys.where("n_shingles > 0")
        sets = full.groupBy("high", "low").agg(F.min("row").alias("set_id"), F.count("*").alias("copies"), F.min("doc_id").alias("first"))
        distinct = own.write(sets, "distinct-sets")
        label = set_components(texts, table, distinct, size, percent, own)
        merged = own.write(distinct.join(label.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "merged")
        heads = merged.groupBy("component").agg(F.min("first").alias("component_id"))
        ids = own.write(merged.join(heads, "component").select("high", "low", "component_id"), "ids")
        named = full.join(ids, ["high", "low"]).select("doc_id", "n_shingles", "component_id")
        return materialize(named.union(keys.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "components")


def one_of_each(docs: DataFrame, size: int = 3, percent: int = 90, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one document stays of each component.

    That is the one of smallest doc_id. Rows with a null doc_id stay; rows that repeat a doc_id go
    only if all of them would. A bitmap lets most documents pass without a shuffle; only those
    that it cannot clear are joined with the list.
    """
    parts = jaccard_components(docs, size, percent, sketch_bits)
    gone = parts.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    dropped = materialize(gone.where("not stays").select("doc_id"), "dropped")
    known = docs.sparkSession.sparkContext.broadcast(bitmap(dropped, F.col("doc_id"), bitmap_bits(dropped.count())))
    key, gone_id = F.col("doc_id").cast("long"), free_name(docs, "_gone")
    suspects = only_in(docs, key, known)
    return only_in(docs, key, known, inside=False).unionByName(suspects.join(dropped.withColumnRenamed("doc_id", gone_id), F.col("doc_id") == F.col(gone_id), "left_anti"))
