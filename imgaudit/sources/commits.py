"""A log of commits below a folder: what has no marker there was never finished and does not count."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class CommitLog:
    """Markers in ``folder``/_commits, one small file each, put there by a rename when all it stands for is written."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/_commits"

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def commit(self, name: str, record: dict) -> None:
        """Put the marker ``name`` in place at once; one that is there already is replaced."""
        target, before = self._path(f"{name}.json"), self._path(f".{name}.tmp")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(before, True)
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.close()
        if files.exists(target):
            files.delete(target, False)
        if not files.rename(before, target):
            raise OSError(f"{target} could not be put in place")

    def names(self) -> list[str]:
        """Names of all commits, in order; one entry a commit."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = [x.getPath().getName() for x in files.listStatus(folder)]
        return sorted(x.removesuffix(".json") for x in found if x.endswith(".json") and not x.startswith("."))
