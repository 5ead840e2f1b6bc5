"""Helpers shared by the training-data operators: scratch tables, batch mapping, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """The one large table that a worker keeps between batches and tasks; asking for another drops the last.

    Workers live on after a task, and the tables of several operators would add up.
    """
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def work_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under ``spark.checkpoint.dir``.

    Where that setting is missing a local master (tests) uses a folder of this process, which goes at exit; any other raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "base" not in _own:
            _own["base"] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _own["base"], ignore_errors=True)
        base = _own["base"]
    return f"{base}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet at ``path`` and read again: lineage ends at files that all executors see."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on slices of bounded bytes of each Arrow batch of ``df``; ``None`` gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_where(df: DataFrame, column: str, judge: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``df`` whose ``column`` the judge accepts; only that column goes to Python and only verdicts come back."""

    @F.arrow_udf("boolean")
    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            found = [pa.array(judge(part.column(0).to_pylist()), pa.bool_()) for part in slices(pa.record_batch([whole], ["text"]))]
            yield pa.concat_arrays(found) if found else pa.array([], pa.bool_())

    return df.where(accepted(F.col(f"`{column}`")))


def row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of the strings and binaries of each row, those inside lists and structs too."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_struct(column.type):
        return sum((row_bytes(c) for c in column.flatten()), np.zeros(len(column), np.int64))
    if pa.types.is_list(column.type) and not pa.types.is_primitive(column.type.value_type):
        ends = np.concatenate([[0], np.cumsum(row_bytes(column.flatten()))])
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
        return ends[at[1:]] - ends[at[:-1]]
    return np.zeros(len(column), np.int64)


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``most_bytes`` in its strings and binaries at most; one row at least."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        sizes += row_bytes(c)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


HUBS = 64


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``rows`` (a, ...) with the least of their ``a`` from ``least`` (a, m, n).

    Nodes with over an ``edges`` / HUBS share of the rows, of which there are fewer than 2 * HUBS by that count, are broadcast, so that
    no task gets all rows of a hub; the others are joined by shuffle.
    """
    hub = F.col("n") > max(edges // HUBS, 1)
    hubs = F.broadcast(least.where(hub).drop("n"))
    return rows.join(hubs, "a").unionByName(rows.join(hubs.select("a"), "a", "left_anti").join(least.where(~hub).drop("n"), "a"))


def components(edges: DataFrame, path: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (node, component), component the smallest node.

    Alternates the large-star and small-star rewrites; each round is an aggregation and a join on node
    ids, stored in the shared folder, until a round changes nothing.  Nodes without an edge and edges with a null do not
    appear; repeated edges count once.  Hubs are joined by :func:`_with_least`, and minima are combined before the shuffle.
    """
    marks = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    current = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{path}/e0"
    )
    mark = current.agg(*marks).first()
    # a: node, b: a smaller node of its component.
    for i in range(1, most_rounds):
        if not mark[0]:
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("b > a"), least, 2 * mark[0])
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # larger neighbours to the minimum
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, mark[0]).select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
        ).select("x.a", "x.b").where("a != b").distinct()
        current, before = stored(small, f"{path}/e{i}"), mark
        mark = current.agg(*marks).first()
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
