"""Media columns kept as content-defined chunks.

A text's bytes, padded to whole rows of 64, are the 8-bit samples of a mono PCM sound file. The
samples are cut where a rolling gear hash of the last 32 bytes says so, so equal passages in
different files give equal chunks. A Spark aggregation over chunk digests finds the chunks that
occur more than once; these are stored once in a table of their own, all others stay in the row of
their file, so the bulk of the bytes is never shuffled. A file is its header and its ordered chunk
list; reading back joins the list with the shared chunks, checks the file's digest and computes
the features from the bytes that were stored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bitmap, bitmap_bits, in_bitmap, materialize

#: Shortest and longest chunk; in between, a cut falls after one byte in 2**CUT_BITS.
SHORTEST, LONGEST, CUT_BITS = 256, 8192, 10
#: Samples are padded to whole rows of so many.
ROW = 64
_PIECE = 1 << 21
#: Random numbers of the gear hash, one for each byte value.
GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)

_REFS = "array<struct<digest:long,check:long,size:int,shared:boolean>>"
_STORED = f"doc_id long, n_bytes long, media_id string, head binary, chunks {_REFS}, own binary"
_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of ROW."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW))


def wave_header(samples: int) -> bytes:
    """Header of a mono PCM file of 8-bit samples at 8 kHz."""
    return b"RIFF" + struct.pack("<I", 36 + samples) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", samples)


def wave_samples(media: bytes) -> bytes:
    """Samples of such a file; an error if the header does not fit."""
    (size,) = struct.unpack("<I", media[40:44])
    if media[:4] != b"RIFF" or media[36:40] != b"data" or len(media) != 44 + size:
        raise ValueError("not a sound file of 8-bit samples")
    return media[44:]


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: where the top bits of the gear hash are zero."""
    found = []
    for at in range(0, len(data), _PIECE):
        before = min(at, 31)  # the hash covers 32 bytes
        h = GEAR[data[at - before : at + _PIECE]]
        for step in (1, 2, 4, 8, 16):
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        found.append(np.flatnonzero((h[before:] >> np.uint32(32 - CUT_BITS)) == 0) + at + 1)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def chunk_ends(points: list[int], start: int, stop: int) -> list[int]:
    """Chunk ends within [start, stop), given the possible ends in that range."""
    ends, at = [], start
    for point in points:
        while point - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if point - at >= SHORTEST:
            ends.append(point)
            at = point
    while stop - at > LONGEST:
        at += LONGEST
        ends.append(at)
    if at < stop:
        ends.append(stop)
    return ends


def _files(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(row, payload, chunks) of each row, block by block."""
    texts = batch.column("text")
    row = 0
    while row < len(texts):
        block, sizes = [], []
        while row + len(block) < len(texts) and (not block or sum(sizes) < _PIECE):
            text = texts[row + len(block)].as_py()
            block.append(payload_of(text))
            sizes.append(len(block[-1]))
        joined = b"".join(block)
        points = cut_points(np.frombuffer(joined, dtype=np.uint8))
        stops = np.cumsum(sizes)
        at = 0
        for k, payload in enumerate(block):
            stop = int(stops[k])
            # the window of a cut never reaches into the text before: SHORTEST exceeds 32
            own = points[np.searchsorted(points, at + SHORTEST) : np.searchsorted(points, stop, side="right")].tolist()
            ends = chunk_ends(own, at, stop)
            yield row + k, payload, [joined[s:e] for s, e in zip([at, *ends[:-1]], ends, strict=True)]
            at = stop
        row += len(block)


def _digest(chunk: bytes) -> tuple[int, int]:
    """128 bits of SHA-256 as two longs."""
    return struct.unpack("<qq", hashlib.sha256(chunk).digest()[:16])


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(c) for _, _, chunks in _files(batch) for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["digest", "check"])

    return docs.select("text").mapInArrow(run, "digest long, check long")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, shared chunks) of ``docs(doc_id, text)``, both written.

    files: doc_id, n_bytes, media_id, head, chunks, own (bytes of the chunks that are not shared).
    """
    repeated = materialize(_digests(docs).groupBy("digest", "check").count().where("count > 1").select("digest", "check"), "repeated-chunks")
    bits = bitmap_bits(2 * repeated.count())
    words = docs.sparkSession.sparkContext.broadcast([bitmap(repeated, F.col(half), bits) for half in ("digest", "check")])

    def is_shared(found: list[tuple[int, int]]) -> np.ndarray:
        """A chunk outside either bitmap occurs once; of those inside both, nearly all occur more often."""
        halves = np.array(found, dtype=np.int64).reshape(-1, 2).view(np.uint64)
        return in_bitmap(words.value[0], halves[:, 0]) & in_bitmap(words.value[1], halves[:, 1])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row, payload, chunks in _files(batch):
                found = [_digest(c) for c in chunks]
                shared = is_shared(found)
                head = wave_header(len(payload))
                out[0].append(batch.column("doc_id")[row].as_py())
                out[1].append(batch.column("n_bytes")[row].as_py())
                out[2].append(hashlib.sha256(head + payload).hexdigest())
                out[3].append(head)
                out[4].append([{"digest": a, "check": b, "size": len(c), "shared": bool(s)} for (a, b), c, s in zip(found, chunks, shared, strict=True)])
                out[5].append(b"".join(c for c, s in zip(chunks, shared, strict=True) if not s))
                if sum(map(len, out[5][-64:])) > _PIECE or len(out[0]) >= 512:
                    yield _stored(out)
                    out = [[], [], [], [], [], []]
            yield _stored(out)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            keys, values = [], []
            for _, _, chunks in _files(batch):
                found = [_digest(c) for c in chunks]
                for key, chunk, s in zip(found, chunks, is_shared(found), strict=True):
                    if s and key not in sent:
                        sent.add(key)
                        keys.append(key)
                        values.append(chunk)
                if len(sent) > 500_000:
                    sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array(values, pa.binary())], names=["digest", "check", "bytes"])

    sized = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    packs = materialize(sized.mapInArrow(files, _STORED), "media-files")
    pool = materialize(docs.select("text").mapInArrow(shared, "digest long, check long, bytes binary").groupBy("digest", "check").agg(F.first("bytes").alias("bytes")), "media-chunks")
    words.destroy()
    return packs, pool


def _stored(out: list[list]) -> pa.RecordBatch:
    refs = pa.list_(pa.struct([("digest", pa.int64()), ("check", pa.int64()), ("size", pa.int32()), ("shared", pa.bool_())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), refs, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "media_id", "head", "chunks", "own"])


def feature_of(samples: bytes) -> str:
    """Size, sum, energy about the middle, peak and crossings of the middle, as text."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings}"


def _read(head: bytes, media_id: str, body: bytes) -> tuple[int, str, int, int, str, str]:
    media = head + body
    found = hashlib.sha256(media).hexdigest()
    if found != media_id:
        raise ValueError(f"stored media {media_id} reads back as {found}")
    samples = wave_samples(media)
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(media), found, feature_of(samples)


def _reader(columns: list[str]):  # noqa: ANN202
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_read(h.as_py(), m.as_py(), b"".join(body.as_py()) if pa.types.is_list(body.type) else body.as_py()) for h, m, body in zip(batch.column("head"), batch.column("media_id"), batch.column("body"), strict=True)]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, *(x.split()[0] for x in _READ.split(", "))])

    return run


def read_back(packs: DataFrame, pool: DataFrame) -> DataFrame:
    """One row per stored file: what its bytes are, computed from the bytes read back."""
    some = F.exists("chunks", lambda c: c["shared"])
    alone = packs.where(~some).select("doc_id", "n_bytes", "media_id", "head", F.col("own").alias("body"))
    done = alone.mapInArrow(_reader(["doc_id", "n_bytes"]), f"doc_id long, n_bytes long, {_READ}")
    # files with shared chunks: each distinct file is put together once
    mixed = packs.where(some)
    files = mixed.groupBy("media_id").agg(F.first("head").alias("head"), F.first("chunks").alias("chunks"), F.first("own").alias("own"))
    # offset of each of the file's own chunks within its own bytes
    offsets = F.aggregate(
        "chunks",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, c: F.struct((acc["at"] + F.when(c["shared"], 0).otherwise(c["size"])).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )
    parts = files.withColumn("offsets", offsets).select("media_id", "head", "own", F.posexplode(F.arrays_zip("chunks", "offsets")).alias("pos", "c"))
    parts = parts.select("media_id", F.when(F.col("pos") == 0, F.col("head")).alias("head"), "pos", F.col("c.chunks.*"), F.expr("case when not c.chunks.shared then substring(own, c.offsets + 1, c.chunks.size) end").alias("own"))
    near = parts.where("not shared").select("media_id", "head", "pos", F.col("own").alias("bytes"))
    far = parts.where("shared").join(pool, ["digest", "check"]).select("media_id", "head", "pos", "bytes")
    whole = near.union(far).groupBy("media_id").agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("parts"))
    read = whole.select("media_id", "head", F.col("parts.bytes").alias("body")).mapInArrow(_reader(["media_id"]), f"media_id string, {_READ}")
    return done.unionByName(mixed.select("doc_id", "n_bytes", "media_id").join(read, "media_id").drop("media_id"))


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Every row of ``docs`` is stored and read back; a file that does not read back bit by bit is an
    error. A null text counts as the empty one, whose payload is one row of zeros. Equal texts give
    equal values; repeated and null doc_ids keep their rows; other columns are ignored; an empty
    table gives no rows.
    """
    return read_back(*store(docs))
