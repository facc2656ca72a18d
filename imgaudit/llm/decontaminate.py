"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items. Patterns of one
length share a shift table over blocks of two words: it tells how far the search may move on
without passing an occurrence, so most positions are never looked at. Where the shift is zero, the
block's bucket selects patterns, and their words are compared directly with the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free_name, materialize
from .words import ALNUM, batch_words, text_bytes, words_of

#: Entries of a shift table.
SHIFT_BITS = 18
#: Bytes of benchmark text whose patterns are searched in one pass over the documents; a larger
#: benchmark is searched in as many passes as it needs. Making the tables of a pass of 4 MB takes
#: some 130 MB of the driver's memory.
PASS_BYTES = 4 << 20

_HITS = "n_words long, spans array<struct<s:long,e:long>>, items array<string>"
_ROW = "doc_id long, row long, " + _HITS


class _Length:
    """The patterns of one length: shift table, and their first words sorted by suffix block."""

    def __init__(self, length: int, firsts: np.ndarray, owners: np.ndarray, hashes: np.ndarray) -> None:
        self.length, self.block = length, min(2, length)
        keys = block_keys(hashes, self.block)
        last = length - self.block
        shifts = np.full(1 << SHIFT_BITS, min(last + 1, 255), dtype=np.int64)
        for at in range(last + 1):  # `at`: start of the block in the pattern
            np.minimum.at(shifts, keys[firsts + at], last - at)
        self.shifts = np.minimum(shifts, 255).astype(np.uint8)
        whole = grams_at(hashes, firsts, length)
        order = np.lexsort((whole, keys[firsts + last]))
        self.firsts, self.owners, self.whole = firsts[order], owners[order], whole[order]
        self.bounds = np.searchsorted(keys[firsts + last][order], np.arange((1 << SHIFT_BITS) + 1)).astype(np.int32)


def block_keys(hashes: np.ndarray, block: int) -> np.ndarray:
    """Table index of the block that starts at each word."""
    keys = hashes if block == 1 else hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    return (keys >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


def grams_at(hashes: np.ndarray, firsts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each of the given words on."""
    total = np.full(len(firsts), length, dtype=np.uint64)
    for k in range(length):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[firsts + k]
    return total


class PatternSet:
    """Windows of benchmark items as positions in the items' words, by length, in flat arrays."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        data = [(text or "").encode() for _, text in items]
        found = [words_of(np.frombuffer(x, dtype=np.uint8), ALNUM) for x in data]
        offset = np.cumsum([0, *map(len, data)])
        hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(h for h, _, _ in found)])
        none = np.zeros(0, dtype=np.int64)
        self.starts = np.concatenate([none, *(s + o for (_, s, _), o in zip(found, offset, strict=False))])
        self.ends = np.concatenate([none, *(e + o for (_, _, e), o in zip(found, offset, strict=False))])
        self.data = b"".join(data).lower()
        self.items = [item for item, _ in items]
        counts = np.array([len(h) for h, _, _ in found], dtype=np.int64)
        first = np.cumsum(counts) - counts
        lengths = np.minimum(counts, window)
        self.lengths: list[_Length] = []
        for length in sorted(set(lengths.tolist()) - {0}):
            own = np.flatnonzero(lengths == length)
            n = counts[own] - length + 1
            owners = np.repeat(own, n)
            at = np.arange(len(owners)) - np.repeat(np.cumsum(n) - n, n)
            self.lengths.append(_Length(length, first[owners] + at, owners, hashes))

    def _words(self, data: np.ndarray | bytes, starts: np.ndarray, ends: np.ndarray, first: int, length: int) -> list[bytes]:
        return [bytes(data[s:e]).lower() for s, e in zip(starts[first : first + length].tolist(), ends[first : first + length].tolist(), strict=True)]

    def search(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [s, e) of all occurrences in one document, merged, and the items they come from."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        n = len(hashes)
        for one in self.lengths:
            length = one.length
            if n < length:
                continue
            keys = block_keys(hashes, one.block)
            move = one.shifts[keys].tobytes()
            at, last = length - one.block, n - one.block  # start of the window's last block
            while at <= last:
                step = move[at]
                if step:
                    at += step
                    continue
                key = keys[at]
                low, high = int(one.bounds[key]), int(one.bounds[key + 1])
                if low < high:
                    first = at - (length - one.block)
                    whole = grams_at(hashes, np.array([first]), length)[0]
                    k = low + int(np.searchsorted(one.whole[low:high], whole))
                    words = None
                    while k < high and one.whole[k] == whole:
                        words = words or self._words(data, starts, ends, first, length)
                        if words == self._words(self.data, self.starts, self.ends, int(one.firsts[k]), length):
                            spans.append((first, first + length))
                            items.add(int(one.owners[k]))
                        k += 1
                at += 1
        return _merged(spans), {self.items[i] for i in items} - {None}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _search(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int, columns: list[str], schema: str) -> tuple[DataFrame, Broadcast]:
    patterns = docs.sparkSession.sparkContext.broadcast(PatternSet(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            counts, spans, found = [], [], []
            for _, hashes, starts, ends, bounds in batch_words(data, offsets, ALNUM):
                for i in range(len(bounds) - 1):
                    part = slice(bounds[i], bounds[i + 1])
                    hit, items = patterns.value.search(hashes[part], starts[part], ends[part], data)
                    counts.append(int(bounds[i + 1] - bounds[i]))
                    spans.append([{"s": s, "e": e} for s, e in hit])
                    found.append(sorted(items))
            kept = [batch.column(c) for c in columns]
            made = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*columns, "n_words", "spans", "items"])

    return docs.select(*columns, "text").mapInArrow(run, schema), patterns


def _passes(benchmark: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The benchmark's items with the pass in which they are searched, and the number of passes.

    Items are dealt by hash to as many passes as there are times ``limit`` bytes of text.
    """
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    return rows.withColumn("pass", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def _items(passes: DataFrame, k: int) -> list[tuple[str | None, str]]:
    """The items of one pass; those without an id are windows that no item owns."""
    return sorted({(row.item, row.text) for row in passes.where(F.col("pass") == k).toLocalIterator()}, key=lambda x: (x[0] or "", x[0] is None, x[1]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated (see contamination)."""
    passes, n = _passes(benchmark, pass_bytes)
    if n > 1:
        row = free_name(docs, "_row")
        named = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        marked = contamination(named.select(F.col(row).alias("doc_id"), "text"), benchmark, window, share, pass_bytes)
        return named.join(marked.where("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(docs.columns)
    patterns = docs.sparkSession.sparkContext.broadcast(PatternSet(_items(passes, 0), window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keep = []
            for _, hashes, starts, ends, bounds in batch_words(data, offsets, ALNUM):
                for i in range(len(bounds) - 1):
                    part = slice(bounds[i], bounds[i + 1])
                    hit, _ = patterns.value.search(hashes[part], starts[part], ends[part], data)
                    n_hit = sum(e - s for s, e in hit)
                    keep.append(not (n_hit and share * n_hit >= bounds[i + 1] - bounds[i]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 and contaminated.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. A word inside any
    occurrence of a window is hit; contaminated means n_hit > 0 and share * n_hit >= n_words.
    items_sha256 is of the ids of the items found, sorted as strings and joined by commas (of the
    empty string if none). An item of fewer words than ``window`` is one window, one without words
    or with a null text is none. The windows of an item with a null id hit words, but it counts as no
    item. A null text has no words; repeated and null doc_ids keep their rows; a repeated item_id
    counts once; other columns are ignored, empty tables give no rows or no hits. The benchmark reaches the tasks in passes of bounded size.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    passes, n = _passes(benchmark, pass_bytes)
    if n == 1:
        found = _search(docs, _items(passes, 0), window, ["doc_id"], "doc_id long, " + _HITS)[0]
    else:
        named = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")  # written once, so that the numbers stay
        every = None
        for k in range(n):  # a pass is fetched, searched, written and released before the next
            part, patterns = _search(named, _items(passes, k), window, ["doc_id", "row"], _ROW)
            part = materialize(part, "pass")
            patterns.destroy()
            every = part if every is None else every.union(part)
        found = every.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),  # as many as there are passes
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    ends = F.array_sort("spans")
    # spans merge from left to right: what ends beyond all before adds its own part
    n_hit = F.aggregate(
        ends,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], x["e"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 and {int(share)} * n_hit >= n_words"))
