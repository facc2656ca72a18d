"""Stratified bootstrap of AUC by trees of multinomial draws.

A group's histogram is cut into cells along each score. A leaf is what lies in one cell of every
score. How many of a class's rows a replicate draws from a leaf comes down a binary tree over the leaves,
whose nodes split their draws by a binomial; inside a leaf the rows are drawn. All generators are
seeded by (seed, group, class, node, block), so every task that needs a leaf draws the same. A cell
therefore gives the final sums of its range of a score for all replicates, and only these are
shuffled, a few numbers for each cell and replicate, however many rows there are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import with_cells

#: Distinct rows of a histogram in one cell, on average.
CELL = 1 << 12
#: Leaves of a group, on average at most: the cells of a score are this number's root by the number of scores.
LEAVES = 1 << 16
#: Replicates of one block, at most, and counts that a task holds at a time; both decide how many there are.
BLOCK, COUNTS = 250, 1 << 22


def _generator(*key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, key)).encode()).digest()[:8], "big"))


def _of_leaves(key: tuple, totals: np.ndarray, needed: np.ndarray, draws: np.ndarray) -> dict[int, np.ndarray]:
    """Draws (one number a replicate) of the ``needed`` leaves, in ascending order, of all draws over ``totals``."""
    before = np.concatenate(([0], np.cumsum(totals)))
    found: dict[int, np.ndarray] = {}
    open_ = [(0, len(totals), draws, needed)]
    while open_:
        low, high, own, some = open_.pop()
        if not len(some):
            continue
        if high - low == 1:
            found[low] = own
            continue
        middle = (low + high) // 2
        both = before[high] - before[low]
        share = (before[middle] - before[low]) / both if both else 0.0
        left = _generator(*key, low, high).binomial(own, share)
        cut = np.searchsorted(some, middle)
        open_ += [(low, middle, left, some[:cut]), (middle, high, own - left, some[cut:])]
    return found


def _inside(rng: np.random.Generator, draws: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Draws by (replicate, row) of rows that count ``n`` times each."""
    total = int(n.sum())
    if total > 4 * len(n):
        return rng.multinomial(draws, n / total)
    row = np.repeat(np.arange(len(n)), n)[rng.integers(0, total, int(draws.sum()))]
    return np.bincount(np.repeat(np.arange(len(draws)), draws) * len(n) + row, minlength=len(draws) * len(n)).reshape(len(draws), len(n))


def _block(leaves: pd.DataFrame) -> int:
    """Replicates of a block: fewer where cells are large."""
    largest = max(leaves.groupby(c)["_k"].sum().max() for c in leaves.columns if c.startswith("_c"))
    return int(max(1, min(BLOCK, COUNTS // max(1, largest))))


def _view_sums(name: str, rows: pd.DataFrame, leaves: pd.DataFrame, value: str, replicates: int, seed: int) -> list[tuple]:
    """(first replicate, positives, negatives, pairs) of a cell and block: how many are drawn, and pairs in order inside the cell."""
    cells = [c for c in leaves.columns if c.startswith("_c")]
    rows = rows.sort_values([value, "label", *sorted(c for c in rows.columns if c.startswith("_s"))])
    at = pd.Series(np.arange(len(leaves)), index=pd.MultiIndex.from_frame(leaves[cells]))
    leaf = at.loc[list(rows[cells].itertuples(index=False, name=None))].to_numpy()
    label, n = rows["label"].to_numpy(), rows["_n"].to_numpy()
    first = np.unique(rows[value].to_numpy(), return_index=True)[1]
    totals = [leaves[f"_n{y}"].to_numpy() for y in (0, 1)]
    size, out = _block(leaves), []
    # rows of a leaf and class in an order that does not depend on which score is asked for
    order = np.lexsort([rows[c].to_numpy() for c in rows.columns if c.startswith("_s")])
    for start in range(0, replicates, size):
        r = min(size, replicates - start)
        drawn = np.zeros((r, len(rows)), dtype=np.int64)
        for y in (0, 1):
            own = order[label[order] == y]
            needed = np.unique(leaf[own])
            counts = _of_leaves((seed, name, y, start), totals[y], needed, np.full(r, totals[y].sum()))
            for k in needed:
                mine = own[leaf[own] == k]
                drawn[:, mine] = _inside(_generator(seed, name, y, start, "leaf", k), counts[k], n[mine])
        pos, neg = (np.add.reduceat(np.where(label == y, drawn, 0), first, axis=1) for y in (1, 0))
        below = np.cumsum(neg, axis=1) - neg
        out.append((start, pos.sum(axis=1), neg.sum(axis=1), (pos * (below + neg / 2)).sum(axis=1)))
    return out


def bootstrap_auc(scored: DataFrame, keys: list[str], scores: list[str], replicates: int, seed: int) -> DataFrame:
    """keys, replicate and one AUC for each score column, all from the same resample.

    Groups of one class give no rows. Memory of a task: the rows of a cell and COUNTS draws.
    """
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    values = [f"_s{i}" for i in range(len(scores))]
    cells = [f"_c{i}" for i in range(len(scores))]
    columns = [F.col(s).cast("double").alias(v) for s, v in zip(scores, values, strict=True)]
    hist = scored.where("label in (0, 1)").groupBy(group.alias("_g"), *keys, *columns, F.col("label").cast("int").alias("label")).agg(F.count("*").alias("_n"))
    celled = hist.select("_g", *values, "label", "_n")
    most = int(min(1024, LEAVES ** (1 / len(scores))))
    for value, cell in zip(values, cells, strict=True):
        celled = with_cells(celled, ["_g"], value, cell, CELL, most)
    sums = [F.sum(F.when(F.col("label") == y, F.col("_n")).otherwise(0)).alias(f"_n{y}") for y in (0, 1)]
    leaves = celled.groupBy("_g", *cells).agg(*sums, F.count("*").alias("_k")).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct(*cells, "_n0", "_n1", "_k"))).alias("_leaves"))
    leaves = leaves.where("exists(_leaves, x -> x._n0 > 0) and exists(_leaves, x -> x._n1 > 0)")
    views = F.explode(F.array(*[F.struct(F.lit(i).alias("_which"), F.col(c).alias("_cell")) for i, c in enumerate(cells)]))
    viewed = celled.withColumn("_view", views).select("_g", "_view._which", "_view._cell", *values, *cells, "label", "_n")
    trees = viewed.select("_g", "_which", "_cell").distinct().join(leaves, "_g").toDF("_of", "_view", "_part", "_leaves")
    schema = "_g string, _which int, _cell int, _start int, _pos binary, _neg binary, _pairs binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def view(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or tree.empty:
            return pd.DataFrame(columns=names)
        at = [rows[c].iloc[0] for c in ("_g", "_which", "_cell")]
        found = _view_sums(at[0], rows, pd.DataFrame(list(tree["_leaves"].iloc[0])), values[at[1]], replicates, seed)
        return pd.DataFrame([(*at, start, *(x.astype(np.float64).tobytes() for x in sums)) for start, *sums in found], columns=names)

    at = ["_g", "_which", "_cell"]
    parts = viewed.groupBy(*at).cogroup(trees.groupBy("_of", "_view", "_part")).applyInPandas(view, schema)
    aucs = [f"auc_{s}" for s in scores]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for which, own in pdf.sort_values("_cell").groupby("_which"):
            pos, neg, pairs = (np.stack([np.frombuffer(x) for x in own[c]]) for c in ("_pos", "_neg", "_pairs"))
            pairs = (pairs + pos * (np.cumsum(neg, axis=0) - neg)).sum(axis=0)
            found[aucs[which]] = pairs / (pos.sum(axis=0) * neg.sum(axis=0))
        out = pd.DataFrame(found)
        start = int(pdf["_start"].iloc[0])
        return out.assign(_g=pdf["_g"].iloc[0], replicate=np.arange(start, start + len(out)))[["_g", "replicate", *aucs]]

    found = parts.groupBy("_g", "_start").applyInPandas(whole, ", ".join(["_g string", "replicate int", *(f"`{a}` double" for a in aucs)]))
    return found.join(hist.select("_g", *keys).distinct(), "_g").drop("_g").select(*keys, "replicate", *aucs)


def interval(replicates: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """keys, low, high: percentile interval of a column of replicates."""
    tail = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return replicates.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_auc_ci(scored: DataFrame, keys: list[str], score: str = "score", replicates: int = 5000, seed: int = 0) -> DataFrame:
    return interval(bootstrap_auc(scored, keys, [score], replicates, seed), keys, f"auc_{score}")


def paired_difference_ci(scored: DataFrame, keys: list[str], first: str, second: str, replicates: int = 5000, seed: int = 0) -> DataFrame:
    """Interval of the difference first - second on the same resamples."""
    both = bootstrap_auc(scored, keys, [first, second], replicates, seed)
    return interval(both.withColumn("difference", F.col(f"auc_{first}") - F.col(f"auc_{second}")), keys, "difference")
