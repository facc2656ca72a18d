"""Identifiers, seeds and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Empty or white text never identifies anything."""
    return F.nullif(F.trim(c), F.lit(""))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def path_id(path: Column) -> Column:
    """First 16 hex digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 16)


def identity_id(dataset: Column, config: Column, split: Column, row_idx: Column, item_id: Column, img_id: Column) -> Column:
    """24 hex digits over dataset, config (may be missing), split, row and source id."""
    source = F.coalesce(F.nullif(item_id, F.lit("")), F.nullif(img_id, F.lit("")), F.lit(""))
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (dataset, config, split, row_idx)]
    return F.substring(F.sha2(F.concat_ws("|", *parts, source), 256), 1, 24)


def seed_hex(seed: int, *parts: Column) -> Column:
    """SHA-256 of seed and parts joined by colons."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def stable_seed(seed: int, *parts: Column) -> Column:
    """The first 8 bytes of ``seed_hex`` as an unsigned number."""
    return F.conv(F.substring(seed_hex(seed, *parts), 1, 16), 16, 10).cast("decimal(20,0)")


def pick(options: list[str], seed: Column) -> Column:
    """One of the options, by a seed."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(seed, F.lit(len(options))) + 1).cast("int"))


def safe_name(name: Column) -> Column:
    """Letters, digits and ._- only, no ._ at the ends, the last 100 characters, never empty."""
    clean = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(clean == "", "image").otherwise(F.right(clean, F.lit(100)))


def normalize_group(group: Column) -> Column:
    return F.regexp_replace(F.lower(group), "[^a-z0-9]+", "")


def source_id(group: Column, path: Column) -> Column:
    """group/file name."""
    return F.concat_ws("/", group, F.element_at(F.split(path, "/"), -1))


def shard_position(index: Column, rows_per_shard: int = 3000) -> tuple[Column, Column]:
    """(shard, row in shard) of a global row index."""
    return F.floor(index / rows_per_shard).cast("long"), F.pmod(index, F.lit(rows_per_shard)).cast("long")
