"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: an offset and a step,
both hashed from its name. The shards take turns, each claiming its next free slot, until the table
is full. A document's slot is a hash of its id; its shard is what the table holds there. The table
is broadcast, so placing a document costs one lookup and no shuffle; shards own equal shares of the
slots within one, and taking a shard away moves few documents between the others.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the table, a prime of at least 100 slots a shard; 65,537 rows are broadcast.
SLOTS = 65_537
#: Largest table that is broadcast.
MOST_SLOTS = 1 << 21


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """(offset, step) of a shard's order over the slots; a step below a prime visits every slot."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that owns each slot; ``names`` are distinct and take turns in the given order."""
    if not _is_prime(slots) or slots > MOST_SLOTS or not 0 < len(names) <= slots or len(set(names)) < len(names):
        raise ValueError("slots must be a prime up to MOST_SLOTS, with at least one distinct shard and no more than slots")
    table = np.full(slots, -1, dtype=np.int32)
    at, step = (list(x) for x in zip(*(preference(n, slots) for n in names), strict=True))
    left = slots
    while left:
        for k in range(len(names)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def assign_shards(docs: DataFrame, names: list[str], slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """``docs`` with the columns slot (long) and shard (string); columns of these names are replaced.

    The slot is the 64-bit hash of the key modulo ``slots``. A null key is a key like any other and
    always gets the same slot; equal keys get equal slots; an empty table gives no rows.
    """
    owners = fill_table(names, slots)
    table = docs.sparkSession.createDataFrame([(i, names[k]) for i, k in enumerate(owners.tolist())], "slot long, shard string")
    placed = docs.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("long"))
    return placed.join(F.broadcast(table), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")  # MOST_SLOTS rows at most
