"""Tables of counters of a fixed length over a whole table: summed by task, then by range, fetched as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counters that travel together: 2**10.
RANGE_BITS = 10
_ROW = "range int, counts binary"


def _batch(ranges: list[int], packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(packed, pa.binary())], names=["range", "counts"])


def count_all(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], length: int, kind: type = np.int64) -> np.ndarray:
    """``length`` counters (a power of two), each at most the largest number of ``kind``.

    ``fill`` adds the rows of a task to its own int64 counters. Ranges that a task has not touched
    are not sent; those sent are packed as small integers. The driver receives ``length`` counters.
    """
    width = min(length, 1 << RANGE_BITS)
    most = np.iinfo(kind).max

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, dtype=np.int64)
        fill(batches, total)
        parts = [(k, part) for k, part in enumerate(total.reshape(-1, width)) if part.any()]
        for at in range(0, len(parts), 256):
            some = parts[at : at + 256]
            packed = [part.astype(np.uint8 if part.max() < 1 << 8 else np.uint16 if part.max() < 1 << 16 else np.int64).tobytes() for _, part in some]
            yield _batch([k for k, _ in some], packed)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for packed in batch.column("counts"):
                raw = packed.as_py()
                total += np.frombuffer(raw, dtype={width: np.uint8, 2 * width: np.uint16, 8 * width: np.int64}[len(raw)])
        yield _batch([key[0].as_py()], [np.minimum(total, most).astype(kind).tobytes()])

    out = np.zeros(length, dtype=kind).reshape(-1, width)
    for row in df.mapInArrow(count, _ROW).groupBy("range").applyInArrow(add, _ROW).toLocalIterator():
        out[row["range"]] = np.frombuffer(row["counts"], dtype=kind)
    return out.reshape(-1)
