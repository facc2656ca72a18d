"""Shared-folder tables and bounded bitmaps used to cut lineage and to prune scans.

Tables are written below the folder that the cluster names in ``spark.checkpoint.dir``,
which every executor can read, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap whose keys were not counted (2 MB); see bitmap_bits for the others.
BITMAP_BITS = 24


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only in local mode, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, without its lineage."""
    return _write(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator in a folder of their own, which goes when the block ends.

    What the operator returns must not read them lazily; it is materialized outside.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._remove(self.folder)

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        return _write(df, self.paths[name])

    def release(self) -> None:
        """Let go of the shuffle files of finished jobs now: Spark keeps them until the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Remove the table last written by this name before the block ends."""
        self._remove(self.paths.pop(name))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bitmap_bits(rows: int) -> int:
    """Bits for a bitmap of so many keys: eight a key, 2**16 at least and 2**26 (8 MB) at most.

    With more keys the bitmap fills up; it then lets more rows pass, and the joins behind it decide.
    """
    return min(26, max(16, (8 * max(1, rows) - 1).bit_length()))


def bitmap(df: DataFrame, key: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of the low ``bits`` bits of a long key over all rows, as uint64 words.

    The driver receives at most 2**(bits-6) rows. A set bit means "may be among the keys";
    a clear bit proves the opposite, so filtering by it loses nothing.
    """
    low = F.pmod(key, F.lit(1 << bits))
    rows = (
        df.select(low.alias("low"))
        .select(F.shiftright("low", 6).alias("word"), F.expr("shiftleft(1L, cast(low & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 ``keys`` may be in the bitmap."""
    low = keys & np.uint64(len(words) * 64 - 1)
    return (words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def only_in(df: DataFrame, key: Column, known: Broadcast, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose long key may be in a broadcast bitmap, or the others; a null key is not in it.

    One Arrow function for all, so that executors keep no second set of Python workers for it.
    """
    name = free_name(df, "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(batch.column(name), known) == inside)).drop_columns([name])

    return df.withColumn(name, key).mapInArrow(run, df.schema)


def held(keys: pa.Array, known: Broadcast) -> np.ndarray:
    """Which long keys may be in a broadcast bitmap; not null ones."""
    return in_bitmap(known.value, keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & keys.is_valid().to_numpy(zero_copy_only=False)
