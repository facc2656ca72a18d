"""Alignment of the tokens of two tokenizers, as Arrow operations on whole batches of documents.

Texts fall apart into segments that no token crosses (the vocabularies prove it), and each segment
of a block is encoded once. The rest is Arrow: the token lists of all segments are flattened with
their parent indices, cumulative sums of token lengths give the place where each token ends, and a
full outer Acero hash join on these document-end keys lines both tokenizers up. Each row of the
sorted join is a stretch of bytes inside one token of A and one of B, hence one link; rows with both
sides are cuts between groups. In how many documents a pair of ids is linked is counted by
Table.group_by in each task and merged by Spark.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .store import Scratch, materialize
from .token_counts import _PLAIN, _SPELLING

#: Characters of text that are aligned at a time; a longer text is aligned in parts of this size.
PIECE = 1 << 19
#: Segments that a worker remembers at most (some 300 bytes each).
REMEMBERED = 300_000
#: Segments longer than this are not remembered.
LONG_SEGMENT = 64
#: Pairs of ids with their counts that are broadcast at most (16 bytes each); rarer pairs are joined.
LOOKUP_PAIRS = 2_000_000
#: Places of a pair of ids in a long: A's id above, B's below.
_SHIFT = 24

#: A segment starts at a space after a character that is no white space, and holds what follows to the next one.
_SEGMENT = re.compile(r"\s*\S+(?:[^\S ]\s*(?:\S+|\Z))*(?:\s*\Z)?|\s+\Z")


class Pair:
    """Both tokenizers, the bytes of their tokens and what segments have been encoded to."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        spelled = {chr(b): b for b in _PLAIN} | {chr(c): b for b, c in _SPELLING.items()}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes_a[k] = bytes(spelled[c] for c in token) if all(c in spelled for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.lengths = tuple(pa.array([len(x) for x in own], pa.int64()) for own in (self.bytes_a, self.bytes_b))
        self.tokens = tuple(pa.array(own, pa.binary()) for own in (self.bytes_a, self.bytes_b))
        self.names = tuple(pa.array([str(k) for k in range(len(own))]) for own in (self.bytes_a, self.bytes_b))
        config = json.loads(self.a.to_str())
        before = config["pre_tokenizer"] or {}
        # A's pre-tokens end where white space follows; B's end where a space follows, as no piece has one behind another character
        self.apart = not config["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def segments(self, text: str) -> list[str]:
        """Parts of space + text whose tokens are those of the whole, in order."""
        return _SEGMENT.findall(" " + text) if self.apart else [" " + text]

    def encode(self, segments: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of A and of B, packed as 32 bits each, and whether both spell the segment."""
        found = [self.known.get(s) for s in segments]
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            texts = [segments[k] for k in new]
            sides = (
                [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)],
                self.b.encode([t[1:] for t in texts], num_threads=1),
            )
            raw = [t.encode() for t in texts]
            packed, spelled = [], np.ones(len(new), dtype=bool)
            for k, ids in enumerate(sides):
                own, right = self._packed(k, ids, raw)
                packed.append(own)
                spelled &= right
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            for k, text, *entry in zip(new, texts, *packed, spelled.tolist(), strict=True):
                found[k] = tuple(entry)
                if len(text) <= LONG_SEGMENT and len(self.known) < REMEMBERED:
                    self.known[text] = found[k]
        return found

    def _packed(self, side: int, ids: list[list[int]], raw: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Packed ids of each segment, and whether their bytes are the segment's."""
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
        data = flat.tobytes()
        cuts = (4 * ends).tolist()
        places = np.concatenate(([0], np.cumsum(self.lengths[side].to_numpy()[flat])))[ends]
        taken = self.tokens[side].take(pa.array(flat)).buffers()[2]
        joined = taken.to_pybytes()[: int(places[-1])] if taken is not None else b""
        right = np.diff(places) == np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        if not right.all() or joined != b"".join(raw):
            own = places.tolist()
            right = np.array([joined[x:y] == r for x, y, r in zip(own, own[1:], raw, strict=False)], dtype=bool)
        return [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], right


@cache
def _pair(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers for each worker process."""
    return Pair(path_a, path_b)


def _lists(packed: list[bytes]) -> pa.ListArray:
    sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))


def _joined(values: pa.Array, offsets: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), by)


class Block:
    """The alignment of some texts, given as lists of segments; all arrays are by text.

    whole: whether both tokenizers spell the text; only these have tokens. pairs: for each link of a
    text, once for equal ones, A's id << 24 | B's id; times: how many links are so; links are cut by
    ``bounds``. groups: the texts of the groups of tokens.
    """

    def __init__(self, pair: Pair, texts: list[list[str]]) -> None:
        number: dict[str, int] = {}
        index = np.fromiter((number.setdefault(s, len(number)) for t in texts for s in t), dtype=np.int64)
        encoded = pair.encode(list(number))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        spelled = np.fromiter((x[2] for x in encoded), dtype=bool, count=len(encoded))
        self.whole = np.bincount(owner[~spelled[index]], minlength=len(texts)) == 0
        keep = self.whole[owner]
        index, owner = pa.array(index[keep]), owner[keep]
        ids, ends, self.n = [], [], []
        for k in (0, 1):
            lists = _lists([x[k] for x in encoded]).take(index)
            own = lists.flatten()
            parents = pc.list_parent_indices(lists)
            ids.append(own)
            self.n.append(np.bincount(owner[parents.to_numpy()], minlength=len(texts)))
            # sums run over all texts of the block, so that an end stands for its text as well
            ends.append(pc.cumulative_sum(pair.lengths[k].take(own)))
        self._align(pair, ids, ends, texts)

    def _align(self, pair: Pair, ids: list[pa.Array], ends: list[pa.Array], texts: list[list[str]]) -> None:
        side = [pa.table({"end": e, x: i, f"{x}_at": pa.array(np.arange(len(i)))}) for x, e, i in zip("ab", ends, ids, strict=True)]
        rows = side[0].join(side[1], "end", join_type="full outer", use_threads=False).combine_chunks().sort_by("end")
        column = lambda name: rows[name].combine_chunks()
        a, b = (pc.fill_null_backward(column(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in "ab")
        own_ends = np.cumsum(self.n[0])  # tokens of A up to each text
        end_a = np.concatenate(([0], ends[0].to_numpy()))
        text_ends = end_a[own_ends]
        text = np.searchsorted(text_ends, column("end").to_numpy(), side="left")
        self.n_links = np.bincount(text, minlength=len(texts))

        key = pa.table({"text": pa.array(text), "pair": pa.array(a << _SHIFT | b)})
        found = key.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("text", "ascending"), ("pair", "ascending")])
        self.pairs, self.times = found["pair"].combine_chunks(), found["count_all"].combine_chunks()
        self.bounds = np.searchsorted(found["text"].to_numpy(), np.arange(len(texts) + 1))

        cut = pc.and_(column("a_at").is_valid(), column("b_at").is_valid())
        cuts = [np.concatenate(([0], column(f"{x}_at").filter(cut).to_numpy() + 1)) for x in "ab"]
        sides = [_joined(pair.names[k].take(ids[k]), cuts[k], ",") for k in (0, 1)]
        groups = pc.binary_join_element_wise(*sides, "|")
        self.n_groups = np.bincount(text[cut.to_numpy(zero_copy_only=False)], minlength=len(texts))
        self.groups = _joined(groups, np.concatenate(([0], np.cumsum(self.n_groups))), ";")


class _Document:
    """Sums of the parts of one long text."""

    def __init__(self) -> None:
        self.whole, self.n, self.text, self.links = True, np.zeros(4, dtype=np.int64), None, []

    def add(self, block: Block, k: int) -> None:
        self.whole = self.whole and bool(block.whole[k])
        if not self.whole:
            return
        self.n += (block.n[0][k], block.n[1][k], block.n_groups[k], block.n_links[k])
        if self.text is None:
            self.text = sha256()
        else:
            self.text.update(b";")
        self.text.update(block.groups[k].as_buffer())
        part = slice(block.bounds[k], block.bounds[k + 1])
        self.links.append((block.pairs[part], block.times[part]))

    def row(self) -> tuple:
        if not self.whole or self.text is None:
            return (0, 0, 0, 0, "", [], [])
        pairs, times = (pa.concat_arrays([x[k] for x in self.links]) for k in (0, 1))
        if len(self.links) > 1:
            merged = pa.table({"pair": pairs, "times": times}).group_by("pair", use_threads=False).aggregate([("times", "sum")]).sort_by("pair")
            pairs, times = merged["pair"].combine_chunks(), merged["times_sum"].combine_chunks()
        return (*map(int, self.n), self.text.hexdigest(), pairs, times)


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _pieces(segments: list[str]) -> Iterator[list[str]]:
    """Parts of a text of some PIECE characters."""
    part, size = [], 0
    for s in segments:
        part.append(s)
        size += len(s)
        if size >= PIECE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _batch(rows: list[tuple], ids: list[tuple[int | None, int | None]]) -> pa.RecordBatch:
    columns = [pa.array([x[k] for x in ids], pa.int64()) for k in (0, 1)]
    columns += [pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k in range(5)]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(r[5]) for r in rows]))).astype(np.int32))
    for k in (5, 6):
        own = [r[k] for r in rows if len(r[k])]
        columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(own).cast(pa.int64()) if own else pa.array([], pa.int64())))
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each row of ``docs(row, doc_id, text)`` with its tokens, groups and links; see Block for pairs and times."""

    def lined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for batch in batches:
            ids = list(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True))
            texts = batch.column("text")
            held: list[_Document] = []
            waiting: list[tuple[int, list[str]]] = []
            size = first = 0

            def close() -> None:
                nonlocal size
                if waiting:
                    block = Block(pair, [part for _, part in waiting])
                    for k, (at, _) in enumerate(waiting):
                        held[at - first].add(block, k)
                    waiting.clear()
                size = 0

            for at in range(len(ids)):
                held.append(_Document())
                text = texts[at].as_py()
                for part in _pieces(pair.segments(text)) if text else ():
                    waiting.append((at, part))
                    size += sum(map(len, part))
                    if size >= PIECE:
                        close()
                if not waiting and (text or len(held) >= 4096):
                    yield _batch([d.row() for d in held], ids[first : at + 1])
                    held, first = [], at + 1
            close()
            if held:
                yield _batch([d.row() for d in held], ids[first:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and looking for them among millions of segments takes a quarter of the time
        try:
            yield from lined_up(batches)
        finally:
            gc.enable()

    return docs.mapInArrow(run, _ROW)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): in how many rows of ``links`` each pair of ids is linked; partial counts of each task, merged by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting = None, []

        def merged() -> pa.Table:
            parts = [pa.table({"pair": pa.concat_arrays(waiting), "n": pa.array(np.ones(sum(map(len, waiting)), dtype=np.int64))})] if waiting else []
            table = pa.concat_tables([*parts, *([total] if total is not None else [])])
            out = table.group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"pair": out["pair"], "n": out["n_sum"]})

        for batch in batches:
            waiting.append(batch.column("pairs").flatten())
            if sum(map(len, waiting)) >= 1 << 21:
                total = merged()
                waiting = []
                if len(total) > 1 << 22:  # more pairs than a task should hold: Spark merges them
                    yield from total.to_batches(1 << 16)
                    total = None
        if waiting or total is not None:
            yield from merged().to_batches(1 << 16)

    return links.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _least_shared(counts: DataFrame, most: int) -> int:
    """The smallest count (1 at least) above which there are no more than ``most`` pairs."""
    least = 1
    while True:
        above, low = counts.where(F.col("n") > least).agg(F.count("*"), F.min("n")).first()
        if above <= most:
            return least
        least = max(low, 2 * least)


def _looked_up(links: DataFrame, known: Broadcast, columns: list[str], schema: str, rare: bool) -> DataFrame:
    """Sums of each row over the pairs that the lookup decides, or (rare) its other pairs as (row, pair, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best, least = known.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, owner = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
            times = batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            if rare:
                rest = pa.array(~found)
                rows = batch.column("row").take(pa.array(owner)).filter(rest)
                yield pa.RecordBatch.from_arrays([rows, pa.array(pairs).filter(rest), pa.array(times).filter(rest)], names=["row", "pair", "times"])
                continue
            count = np.where(found, counts[at], 1) if len(keys) else np.ones(len(pairs), dtype=np.int64)
            decided = found | (least == 1)  # a pair that is not in a whole lookup is in one document
            top = decided & (count == best[pairs >> _SHIFT])
            sums = [np.bincount(owner, weights=w, minlength=batch.num_rows).astype(np.int64) for w in (times * top, times * count * decided)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, sums)], names=[*columns, "n_best", "count_sum"])

    return links.mapInArrow(run, "row long, pair long, times long" if rare else schema)


def token_alignment(docs: DataFrame, path_a: str, path_b: str, lookup: int = LOOKUP_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    ``path_a`` is a byte-level BPE file of tokenizers, ``path_b`` a model of sentencepiece; every
    executor has both. A encodes space + text, B the text, whose first space is its own. Groups are
    the smallest runs of tokens of both that span the same bytes, links the pairs of tokens that
    overlap. The ``lookup`` most widely shared pairs at most are broadcast with their counts, beside
    the highest count of each id of A; links of rarer pairs are joined with theirs.

    Null and empty texts, and those that a tokenizer does not spell (it normalizes them), have no
    tokens: zeros and an empty groups_sha256. Repeated and null doc_ids keep their rows and count as
    documents of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark, "alignment") as scratch:
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        links = scratch.write(aligned(rows, path_a, path_b), "links")
        counts = scratch.write(pair_counts(links), "counts")
        best = np.zeros(len(_pair(path_a, path_b).bytes_a), dtype=np.int64)  # as long as A's vocabulary
        top = counts.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("n").alias("n")).toArrow()
        best[top["a"].to_numpy()] = top["n"].to_numpy()
        least = _least_shared(counts, lookup)
        shared = counts.where(F.col("n") > least).toArrow()
        order = np.argsort(shared["pair"].to_numpy())
        known = spark.sparkContext.broadcast((shared["pair"].to_numpy()[order], shared["n"].to_numpy()[order], best, least))
        columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        sums = _looked_up(links, known, columns, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long", rare=False)
        if least > 1:
            tops = spark.createDataFrame(top.to_pandas().astype("int64"), "a long, top long") if top.num_rows else spark.createDataFrame([], "a long, top long")
            rest = _looked_up(links, known, [], "", rare=True).join(counts.where(F.col("n") <= least), "pair")
            rest = rest.join(F.broadcast(tops), F.shiftright("pair", _SHIFT) == F.col("a"))  # a row for each id of A at most
            extra = rest.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("best_"), F.sum(F.col("times") * F.col("n")).alias("sum_"))
            sums = sums.join(extra, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("best_", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum_", F.lit(0))})
        out = materialize(sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment")
        known.destroy()
        return out
