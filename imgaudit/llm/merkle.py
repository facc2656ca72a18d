"""Merkle manifest of a table with incremental witnesses.

Leaves of a tree are appended in order. Open subtrees are kept by level; a node that is appended
waits in the open run of its level. When a run of FAN nodes is complete, each of its nodes gets its
witness of that level (the texts of the siblings before and after it), and the run's hash is appended one
level up, where later siblings complete it in turn. A leaf's witness is what its own node got and
what the nodes above it got.

Appends are distributed by aligned blocks of FAN**LEVELS leaves: every block is streamed by itself,
its root is a leaf of the next round, and so on until one node remains. Witnesses then come down the
rounds: the path of a block's root is given to the stream of the block, which extends it to its nodes.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, materialize

#: Nodes of a run, and levels that a block closes by itself: 256 leaves a block.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS

#: A node of a round: tree, place in it and nodes of the tree; name is the source that a node stands for.
_NODE = "tree string, name string, pos long, n long, digest string, doc_id long, tampered string"
_ROOT = "tree string, name string, pos long, n long, digest string, doc_id long, tampered string"
_PATH = "tree string, name string, pos long, path array<string>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Node:
    """A digest, the texts of its siblings before and after it once its run is complete, and the node above."""

    __slots__ = ("above", "digest", "left", "right")

    def __init__(self, digest: str) -> None:
        self.digest = digest
        self.left = self.right = ""
        self.above: Node | None = None

    def path(self) -> list[str]:
        """Texts before and after this node and the nodes above it, level by level."""
        found: list[str] = []
        node: Node | None = self
        while node is not None and node.above is not None:
            found += (node.left, node.right)
            node = node.above
        return found


class Appender:
    """An open tree: runs that wait for siblings, by level."""

    def __init__(self) -> None:
        self.open: list[list[Node]] = [[]]

    def append(self, node: Node, level: int = 0) -> None:
        """Add a node; each run that it completes extends the witnesses of its nodes and goes up a level."""
        while True:
            if level == len(self.open):
                self.open.append([])
            run = self.open[level]
            run.append(node)
            if len(run) < FAN:
                return
            node = self._complete(level)
            level += 1

    def _complete(self, level: int) -> Node:
        run = self.open[level]
        self.open[level] = []
        text = "".join(x.digest for x in run)
        above = Node(digest(text))
        for k, x in enumerate(run):
            x.left, x.right, x.above = text[: 64 * k], text[64 * k + 64 :], above
        return above

    def close(self, levels: int | None) -> Node:
        """The root: after exactly ``levels`` levels, or (None) as soon as one node remains."""
        level = 0
        while level < levels if levels is not None else len(self.open) > level + 1 or len(self.open[level]) > 1:
            if level + 1 == len(self.open):
                self.open.append([])
            if self.open[level]:
                self.open[level + 1].append(self._complete(level))
            level += 1
        return self.open[level][0]


def fold(leaf: str, path: list[str]) -> str:
    """Root of a leaf and the siblings' texts of each level."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = digest(left + leaf + right)
    return leaf


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _closed(rows: list[tuple]) -> tuple[Node, list[Node]]:
    """Root and nodes of a block (tree, name, pos, n, digest, ...)."""
    tree, nodes = Appender(), [Node(r[4]) for r in rows]
    for node in nodes:
        tree.append(node)
    return tree.close(LEVELS if rows[0][3] > BLOCK else None), nodes


def _streamed(df: DataFrame, run: Callable[[list[tuple]], Iterator[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """``run`` on each block of a frame of nodes, which are dealt by (tree, block) and sorted by place.

    A task holds one block (and its path) at a time.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in itertools.groupby(_nodes(batches), key=lambda r: (r[0], r[-1])):
            out += run([r[:-1] for r in rows])
            if len(out) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(blocks, schema)


def _block(pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / BLOCK).cast("long")


_STRING, _LONG = pa.string(), pa.int64()


def _roots(nodes: DataFrame) -> DataFrame:
    """The roots of all blocks as nodes of the next round."""

    def run(rows: list[tuple]) -> Iterator[tuple]:
        root, _ = _closed(rows)
        tree, name, pos, n = rows[0][:4]
        yield tree, name, pos // BLOCK, -(-n // BLOCK), root.digest, None, None

    return _streamed(nodes.withColumn("block", _block()), run, _ROOT, [_STRING, _STRING, _LONG, _LONG, _STRING, _LONG, _STRING])


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes, each block after a row (place -1) with the path of its root."""
    above = paths.select("tree", F.lit(None).cast("string").alias("name"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered"), "path", F.col("pos").alias("block"))
    return nodes.select("*", F.lit(None).cast("array<string>").alias("path"), _block().alias("block")).unionByName(above)


def _paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of the nodes of a round from the paths of its blocks' roots."""

    def run(rows: list[tuple]) -> Iterator[tuple]:
        above, own = rows[0][7], rows[1:]
        _, nodes = _closed(own)
        for r, node in zip(own, nodes, strict=True):
            yield r[0], r[1], r[2], node.path() + above

    return _streamed(_with_paths(nodes, paths), run, _PATH, [_STRING, _STRING, _LONG, pa.list_(_STRING)])


def _manifest(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The result rows of the leaves; a block's path ends with the source's levels, then those above, then subroot and root."""

    def run(rows: list[tuple]) -> Iterator[tuple]:
        (*above, subroot, root), own = rows[0][7], rows[1:]
        _, nodes = _closed(own)
        for r, node in zip(own, nodes, strict=True):
            path = node.path() + above
            folded = fold(r[6] or r[4], path)
            yield r[5], r[4], subroot, root, digest("".join(path)), folded, folded == root

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _streamed(_with_paths(nodes, paths), run, schema, [_LONG, _STRING, _STRING, _STRING, _STRING, _STRING, pa.bool_()])


def placed(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with pos and n: the place of each row in its tree by ``order``, from 0, and the tree's rows.

    Rows are dealt by ranges of (tree, order), counted there, and counts are summed over the parts
    that hold a tree: no task sorts or counts a whole tree.
    """
    schema = df.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    at = df.columns.index("tree")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth = object(), 0
        for batch in batches:
            places = []
            for tree in batch.column(at).to_pylist():
                nth = nth + 1 if tree == last else 0
                last = tree
                places.append(nth)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, _LONG)], names=[*batch.schema.names, "nth"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    numbered = scratch.write(sorted_.mapInArrow(number, f"{schema}, nth long").withColumn("part", F.spark_partition_id()), name)
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    offsets = counts.selectExpr("tree as tree_", "part as part_", "sum(rows) over (partition by tree order by part) - rows as before", "sum(rows) over (partition by tree) as n")
    return numbered.join(offsets, F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("part") == F.col("part_"))).withColumn("pos", F.col("nth") + F.col("before")).drop("tree_", "part_", "part", "nth", "before")


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, digest and (where 5 divides the id's checksum) tampered: the leaf of the text with A-Z lower-cased."""

    def coded(c: Column) -> Column:
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(coded(F.col("doc_id").cast("string")), coded(F.col("source")), coded(F.col("lang")), coded(F.col("n_chars").cast("string")), coded(text)), 256)

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(F.col("source").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), F.when(chosen, leaf(lower)).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    A null value has the code "-", so that null and empty texts are different leaves. Rows of one
    source ascend by doc_id, null first; equal ids by their leaf. Repeated rows are leaves of their
    own. A null source is a source and comes first. A null doc_id is never tampered with. Other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark, "merkle") as scratch:
        first = scratch.write(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
        rows = placed(first, ["doc_id", "digest", "row"], scratch, "placed").select("tree", F.col("tree").alias("name"), "pos", "n", "digest", "doc_id", "tampered")
        base = scratch.write(rows, "nodes")
        scratch.drop("leaves")
        rounds, roots = _climb(base, scratch)
        sources = placed(roots.select(F.lit("").alias("tree"), "name", "digest"), ["name"], scratch, "sources")
        sources = scratch.write(sources.select("tree", "name", "pos", "n", "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered")), "sources")
        upper, top = _climb(sources, scratch)
        paths = top.select("tree", "name", "pos", F.array("digest").alias("path"))
        paths = _descend(upper, paths, scratch)
        paths = _of_sources(roots, paths, scratch)
        return materialize(_manifest(base, _descend(rounds[1:], paths, scratch)), "manifest")


def _climb(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of nodes from ``nodes`` up, and the roots of all trees."""
    rounds = [nodes]
    while True:
        above = scratch.write(_roots(rounds[-1]), "roots")
        if (above.agg(F.max("n")).first()[0] or 1) <= 1:
            return rounds, above
        rounds.append(above)


def _descend(rounds: list[DataFrame], paths: DataFrame, scratch: Scratch) -> DataFrame:
    """From the paths of the roots to those of the first round's nodes."""
    for nodes in reversed(rounds):
        paths = scratch.write(_paths(nodes, paths), "paths")
    return paths


def _of_sources(roots: DataFrame, paths: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, pos 0, path) of each source's root: its path above, then subroot and root."""
    found = paths.select(F.col("name").alias("name_"), "path")
    joined = roots.join(found, F.col("name").eqNullSafe(F.col("name_")))
    last = F.element_at("path", -1)
    path = F.concat(F.slice("path", 1, F.size("path") - 1), F.array("digest", last))
    return scratch.write(joined.select("tree", "name", "pos", path.alias("path")), "paths")
