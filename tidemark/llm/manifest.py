"""Merkle manifest of a dataset: a hash tree a source, a tree over the sources, and the authentication path of every row.

Leaves are ranked by a range shuffle of (source, doc_id, digest) and the counts of its partitions, so no task sees a whole source.
Sixteen consecutive nodes have one parent.  An aligned block of 4,096 leaves is three whole levels of the tree and one group of a shuffle;
the block's root is one row of the next tree, and so on until a source has one node.  Blocks of every height go through the same
code, and so does the tree over sources.

Within a block paths come from a fractal traversal.  Each level keeps its existing subtree, the run of siblings around the current leaf,
and a desired one, the next run, which a cursor of that level builds one leaf a step on a stack of open runs; when the leaf
leaves the existing run the desired one takes its place.  So each path is at hand when its leaf is, with two runs and a
stack a level in memory, and every node is hashed once a level.  What lies above the block comes from its parents' own paths and
is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, work_dir

ARITY = 16
HEIGHT = 3
BLOCK = ARITY**HEIGHT
STEPS = "array<struct<before:string, after:string>>"
STEP_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def joined(digests) -> str:
    """H of digests as hexadecimal text, one after the other."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Stack:
    """Open runs of a tree, one a level, that takes nodes in order; ``top`` gets the finished nodes of level ``levels``."""

    def __init__(self, levels: int):
        self.open: list[list[str]] = [[] for _ in range(levels)]
        self.top: list[str] = []

    def push(self, node: str, level: int = 0) -> None:
        if level == len(self.open):
            self.top.append(node)
            return
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self.close(level)

    def close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.push(joined(run), level + 1)

    def finish(self) -> list[str]:
        """No more nodes come: the last run of each level, short or not, is closed."""
        for level, run in enumerate(self.open):
            if run:
                self.close(level)
        return self.top


def root_of(leaves: list[str], levels: int) -> str:
    stack = Stack(levels)
    for leaf in leaves:
        stack.push(leaf)
    return stack.finish()[0]


class Desired:
    """The next run of siblings of a level, built from the leaves under it as its cursor passes them."""

    def __init__(self, leaves: list[str], level: int, start: int):
        self.leaves, self.at, self.end = leaves, start, min(start + ARITY ** (level + 1), len(leaves))
        self.stack = Stack(level)

    def step(self) -> None:
        if self.at < self.end:
            self.stack.push(self.leaves[self.at])
            self.at += 1

    def run(self) -> list[str]:
        while self.at < self.end:
            self.step()
        return self.stack.finish()


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in turn, as the digests (before, after) it at each of ``levels`` levels."""
    existing = [Desired(leaves, i, 0).run() for i in range(levels)]
    desired = [Desired(leaves, i, ARITY ** (i + 1)) for i in range(levels)]
    for at in range(len(leaves)):
        for i in range(levels):
            span = ARITY ** (i + 1)
            if at and at % span == 0:
                existing[i], desired[i] = desired[i].run(), Desired(leaves, i, at + span)
        path = []
        for i in range(levels):
            place = at // ARITY**i % ARITY
            path.append(("".join(existing[i][:place]), "".join(existing[i][place + 1 :])))
            desired[i].step()
        yield path


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    for before, after in path:
        leaf = joined((before, leaf, after))
    return leaf


def ranked(nodes: DataFrame, order: list[str], path: str) -> DataFrame:
    """``nodes`` (tree, ...) with ``at``, the place in its tree by ``order``, and ``n``, the nodes of its tree.

    A range shuffle sorts them; each of its partitions learns from the others' counts where it begins.
    """
    by = [F.col(c) for c in ("tree", *order)]
    rows = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stored(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_nth")), f"{path}-sorted")
    parts = rows.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    within = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = stored(parts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(within).alias("n")), f"{path}-parts")
    return rows.join(parts, ["tree", "_part"]).withColumn("at", F.col("_nth") + F.col("_shift")).drop("_part", "_nth", "_shift")


def _levels(n: int) -> int:
    return min(height_of(n), HEIGHT)


def _roots(nodes: DataFrame) -> DataFrame:
    """The root of each block of ``nodes`` (tree, block, at, n, digest) as a node (tree, at, n, digest) of the tree above."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        n = group["n"][0].as_py()
        root = root_of(group["digest"].to_pylist(), _levels(n))
        return pa.table({"tree": group["tree"][:1], "at": group["block"][:1], "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": [root]})

    return nodes.select("tree", "block", "at", "n", "digest").groupBy("tree", "block").applyInArrow(run, "tree string, at long, n long, digest string")


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))


def _paths(nodes: DataFrame, path: str) -> DataFrame:
    """(tree, at, steps, root) of ``nodes`` (tree, at, n, digest): the whole path of each within its tree, and the tree's root."""
    nodes = stored(_with_block(nodes), path)
    roots = stored(_roots(nodes), f"{path}-roots")
    if roots.where("n > 1").isEmpty():
        above = roots.select("tree", F.col("at").alias("block"), F.from_json(F.lit("[]"), STEPS).alias("above"), F.col("digest").alias("root"))
    else:
        above = _paths(roots, f"{path}-up").select("tree", F.col("at").alias("block"), F.col("steps").alias("above"), "root")
    above = stored(above, f"{path}-above")

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        rest = [(s["before"], s["after"]) for s in above["above"][0].as_py()]
        found = traverse(group["digest"].to_pylist(), _levels(group["n"][0].as_py()))
        steps = [[{"before": b, "after": a} for b, a in p + rest] for p in found]
        return pa.table({"tree": group["tree"], "at": group["at"], "steps": pa.array(steps, STEP_TYPE), "root": pa.array([above["root"][0].as_py()] * len(steps))})

    left, right = (x.groupBy("tree", "block") for x in (nodes.select("tree", "block", "at", "n", "digest"), above))
    return left.cogroup(right).applyInArrow(run, f"tree string, at long, steps {STEPS}, root string")


def leaf_of(*columns) -> F.col:
    """H of the columns, each ``-`` if null, else its length in UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts)).cast("binary"), 256)


def manifest(leaves: DataFrame) -> DataFrame:
    """The proof of every row of ``leaves`` (doc_id, source, leaf, seen): (doc_id, leaf, subroot, root, proof_sha256, n_steps, folded_root, verified).

    ``leaf`` is the digest in the manifest, ``seen`` that of the row as it is now (null: as in the manifest), from which the root is folded.
    Trees are ordered by source, null first, then by bytes; leaves by doc_id, null first, then by digest, so rows that repeat
    take neighbouring places.  An empty table gives no rows.
    """
    path = work_dir(leaves.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null before the empty source
    leaves = stored(leaves.select(tree.alias("tree"), F.col("doc_id").cast("long"), F.col("leaf").alias("digest"), "seen"), f"{path}/leaves")
    blocks = stored(_with_block(ranked(leaves, ["doc_id", "digest"], f"{path}/rank")), f"{path}/blocks")
    roots = stored(_roots(blocks), f"{path}/roots")
    within = stored(_paths(roots, f"{path}/within"), f"{path}/within-paths")  # of each block in its source
    subroots = within.groupBy("tree").agg(F.first("root").alias("digest"))
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = stored(ranked(sources, ["source"], f"{path}/sources-rank"), f"{path}/sources")
    over = _paths(sources.select("tree", "at", "n", "digest"), f"{path}/over")  # of each source in the dataset
    over = over.join(sources.select("source", "at"), "at").select(F.col("source").alias("tree"), F.col("steps").alias("over"), F.col("root").alias("whole"))
    above = within.join(stored(over, f"{path}/over-paths"), "tree")
    above = stored(above.select("tree", F.col("at").alias("block"), F.concat("steps", "over").alias("above"), F.col("root").alias("subroot"), F.col("whole").alias("root")), f"{path}/above")

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group, m = group.sort_by("at"), group.num_rows
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        rest = [(s["before"], s["after"]) for s in above["above"][0].as_py()]
        tail = "".join(b + a for b, a in rest).encode()
        digests, seen = group["digest"].to_pylist(), group["seen"].to_pylist()
        proofs, n, roots = [], [], []
        for leaf, now, path in zip(digests, seen, traverse(digests, _levels(group["n"][0].as_py())), strict=True):
            proofs.append(hashlib.sha256("".join(b + a for b, a in path).encode() + tail).hexdigest())
            n.append(len(path) + len(rest))
            roots.append(folded(leaf if now is None else now, path + rest))
        out = {"doc_id": group["doc_id"], "leaf": group["digest"], "subroot": [subroot] * m, "root": [root] * m, "proof_sha256": proofs, "n_steps": pa.array(n, pa.int32())}
        return pa.table({**out, "folded_root": roots, "verified": [r == root for r in roots]})

    left, right = (x.groupBy("tree", "block") for x in (blocks, above))
    return left.cogroup(right).applyInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, n_steps int, folded_root string, verified boolean"
    )


def document_leaves(docs: DataFrame, tampered=None) -> DataFrame:
    """(doc_id, source, leaf, seen) of documents; ``seen`` is the leaf with the text ``tampered``, null where that is null."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    seen = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_of(*columns, tampered))
    return docs.select("doc_id", "source", leaf_of(*columns, F.col("text")).alias("leaf"), seen.alias("seen"))
