"""Approximate vector search: a stored inverted-file index with product-quantised residuals, probed per query, the best rechecked exactly.

The index is a table.  Each vector, scaled to length one, lies in the list of its nearest centroid, and what is left of it is written as one
byte a sub-space.  Centroids and code books are trained on a bounded sample (``FIT`` vectors by a hash of their key); every
vector is indexed.  Lists are stored in blocks of ``BLOCK`` vectors, sorted by list, so that a query's probes read row groups of
its lists, a few bytes a vector; only the ids that its estimates put first are fetched from the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scratch import kept
from tidemark.operators.search import cosine
from tidemark.operators.series import first_of_each

#: Vectors that train the index, and centroids at most.
FIT, MOST_LISTS = 20_000, 4096
#: Bytes of a code, vectors of a block, queries of a block.
CODE, BLOCK, ASKED = 16, 4096, 256
#: Vectors that meet a block of queries at once at most, and chunks of a smaller index.
CHUNK, SPREAD = 32_768, 24
ROUNDS, SEED = 12, 5


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids of the rows of ``x`` by Lloyd's rounds from random rows; an empty centroid takes the row farthest from its own."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own, off = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        for i, j in zip(np.flatnonzero(n == 0), np.argsort(-off), strict=False):
            c[i] = x[j]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest row of ``c``, squared distance) of each row of ``x``."""
    size, own, off = (c * c).sum(1), np.empty(len(x), np.int64), np.empty(len(x))
    for s in range(0, len(x), 4096):
        d = size[None, :] - 2 * (x[s : s + 4096] @ c.T)
        own[s : s + 4096] = d.argmin(1)
        off[s : s + 4096] = d.min(1) + (x[s : s + 4096] ** 2).sum(1)
    return own, off


@dataclass
class Book:
    """What the index is written with: (lists, dim) centroids and (CODE, 256, width) sub-space words; ``dim`` is padded to a multiple of CODE."""

    dim: int
    centroids: np.ndarray
    words: np.ndarray

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centroids.shape[1] - x.shape[1])))

    def write(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of unit vectors."""
        x = self.padded(unit)
        own, _ = _nearest(x, self.centroids)
        rest = (x - self.centroids[own]).reshape(len(x), len(self.words), -1)
        return own, np.stack([_nearest(rest[:, j], w)[0].astype(np.uint8) for j, w in enumerate(self.words)], 1)

    def read(self, own: int, codes: np.ndarray) -> np.ndarray:
        """The vectors of one list as their codes have them; their inner products with a query are its estimates."""
        return self.centroids[own] + self.words[np.arange(len(self.words)), codes].reshape(len(codes), -1)


def train(unit: np.ndarray, lists: int) -> Book:
    rng, dim = np.random.default_rng(SEED), unit.shape[1]
    x = np.pad(unit, ((0, 0), (0, -dim % CODE)))
    centroids = _spread(x, lists, rng)
    rest = (x - centroids[_nearest(x, centroids)[0]]).reshape(len(x), CODE, -1)
    words = [_spread(rest[:, j], 256, rng) for j in range(CODE)]
    return Book(dim, centroids, np.stack([np.pad(w, ((0, 256 - len(w)), (0, 0)), constant_values=1e6) for w in words]))


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the column that can be compared, their unit vectors): not null, of ``dim`` finite numbers, not zero."""
    rows, out = [], []
    for i, v in enumerate(column):
        a = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and len(v.values) == dim and not v.values.null_count else None
        if a is not None and np.isfinite(a).all() and a.any():
            rows.append(i)
            out.append(a / np.abs(a).max())
    x = np.array(out).reshape(-1, dim)
    return np.array(rows, np.int64), x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Index:
    """A stored index: ``blocks`` (list, keys, codes), its book, and the vectors it is of."""

    blocks: DataFrame
    book: Book | None
    vectors: DataFrame
    rows: int


def build(vectors: DataFrame, key: str, vector: str, lists: int | None = None) -> Index:
    """The index of all rows of ``vectors``; ``lists`` by default twice the root of their number, MOST_LISTS at most.

    Rows without key and vectors that are null, zero, of another length than most of the sample or with a null or non-finite component are not in it.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    share = F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(1 << 30)) < int(min(1.0, FIT / max(n, 1)) * (1 << 30))
    sample = rows.where(share).orderBy("key").limit(2 * FIT).toArrow()
    sizes = [len(v.values) for v in sample["v"].combine_chunks()] if sample.num_rows else []
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    unit = _units(sample["v"].combine_chunks(), dim)[1] if dim else np.empty((0, 1))
    if not len(unit):
        return Index(spark.createDataFrame([], "list int, keys binary, codes binary"), None, rows, 0)
    book = train(unit, lists or int(min(MOST_LISTS, max(1, 2 * np.sqrt(n)))))
    shared = spark.sparkContext.broadcast(book)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _units(batch["v"], dim)
            if len(at):
                own, codes = shared.value.write(x)
                blobs = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.record_batch([pa.array(own, pa.int32()), batch["key"].take(pa.array(at)), blobs], ["list", "key", "code"])

    # A list of any size is cut into parts by a hash, so that no task gets more of it than a few blocks.
    coded = kept(rows.mapInArrow(write, "list int, key long, code binary"))
    parts = kept(coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
    dealt = coded.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("key"), "parts"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        starts = range(0, group.num_rows, BLOCK)
        keys, codes = group["key"].to_numpy().astype("<i8"), group["code"].to_pylist()
        return pa.table({
            "list": pa.array([group["list"][0].as_py()] * len(starts), pa.int32()),
            "keys": pa.array([keys[s : s + BLOCK].tobytes() for s in starts], pa.binary()),
            "codes": pa.array([b"".join(codes[s : s + BLOCK]) for s in starts], pa.binary()),
        })

    blocks = dealt.groupBy("list", "part").applyInArrow(pack, "list int, keys binary, codes binary")
    return Index(kept(blocks.repartitionByRange("list").sortWithinPartitions("list")), book, rows, n)


def search(index: Index, queries: DataFrame, k: int = 10, probes: float = 0.8, recheck: int = 20) -> DataFrame:
    """(query_id, key, score, rn): about the ``k`` nearest of each of ``queries`` (query_id, q) by cosine, the query's own key left out.

    The share ``probes`` of all lists that is nearest to a query is estimated from codes (vectors without clusters need most of them,
    clustered ones few); its ``recheck * k`` best are fetched and their cosine is exact, so a score
    is never an estimate.  Ties go to the smaller key.  A query that cannot be compared has no hit.
    """
    empty = "query_id long, key long, score double, rn int"
    if index.book is None:
        return queries.sparkSession.createDataFrame([], empty)
    shared, first = queries.sparkSession.sparkContext.broadcast(index.book), recheck * k
    lists = max(1, int(np.ceil(probes * len(index.book.centroids))))
    chunk = int(min(CHUNK, max(BLOCK, index.rows / SPREAD)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(asked, matrix, probed): ASKED queries at a time, and a bit for each list that each of them probes."""
        book = shared.value
        for batch in batches:
            at, x = _units(batch["q"], book.dim)
            ids = batch["query_id"].to_numpy()[at].astype("<i8")
            for s in range(0, len(at), ASKED):
                q = x[s : s + ASKED]
                near = np.argsort(-(2 * (book.padded(q) @ book.centroids.T) - (book.centroids**2).sum(1)), axis=1, kind="stable")[:, :lists]
                probed = np.zeros((len(q), len(book.centroids)), bool)
                np.put_along_axis(probed, near, True, 1)
                yield pa.record_batch([pa.array([x.tobytes()]) for x in (ids[s : s + ASKED], q, np.packbits(probed, axis=1))], ["asked", "matrix", "probed"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lists, keys, codes): blocks one behind the other, about ``chunk`` vectors at a time, each vector with its list."""
        held: list[tuple[np.ndarray, bytes, bytes]] = []

        def whole() -> pa.RecordBatch:
            cols = [np.concatenate([own for own, _, _ in held]).tobytes(), b"".join(k for _, k, _ in held), b"".join(c for _, _, c in held)]
            held.clear()
            return pa.record_batch([pa.array([c]) for c in cols], ["lists", "keys", "codes"])

        for batch in batches:
            for c, keys, codes in zip(*(batch[x] for x in ("list", "keys", "codes")), strict=True):
                keys = keys.as_py()
                held.append((np.full(len(keys) // 8, c.as_py(), "<i4"), keys, codes.as_py()))
                if sum(len(own) for own, _, _ in held) >= chunk:
                    yield whole()
        if held:
            yield whole()

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                owns, keys, codes, asked, q, probed = (batch[x][at].as_buffer() for x in ("lists", "keys", "codes", "asked", "matrix", "probed"))
                owns, keys, asked = np.frombuffer(owns, "<i4"), np.frombuffer(keys, "<i8"), np.frombuffer(asked, "<i8")
                codes, q = np.frombuffer(codes, np.uint8).reshape(len(keys), -1), book.padded(np.frombuffer(q).reshape(len(asked), -1))
                probed = np.unpackbits(np.frombuffer(probed, np.uint8).reshape(len(asked), -1), axis=1, count=len(book.centroids)).astype(bool)
                score = np.full((len(asked), len(keys)), -np.inf)
                for s, e in zip(starts := [0, *(np.flatnonzero(np.diff(owns)) + 1).tolist()], [*starts[1:], len(owns)], strict=True):
                    who = np.flatnonzero(probed[:, owns[s]])
                    if len(who):
                        score[who, s:e] = q[who] @ book.read(owns[s], codes[s:e]).T
                score[asked[:, None] == keys[None, :]] = -np.inf
                for own, row in zip(asked.tolist(), score, strict=True):
                    best = np.argpartition(-row, first)[:first] if len(row) > first else np.arange(len(row))
                    best = best[np.isfinite(row[best])]
                    yield pa.record_batch([pa.array([own] * len(best), pa.int64()), pa.array(keys[best]), pa.array(row[best])], ["query_id", "key", "estimate"])

    asked = kept(queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>").alias("q")))
    probed = kept(asked.mapInArrow(ask, "asked binary, matrix binary, probed binary"))
    # Every chunk of the index meets every block of queries once, and only the best of a query leave a meeting; chunks are dealt to tasks.
    chunks = index.blocks.mapInArrow(gather, "lists binary, keys binary, codes binary").repartition(max(1, -(-index.rows // chunk)))
    hits = kept(chunks).crossJoin(probed).mapInArrow(estimate, "query_id long, key long, estimate double")
    near = kept(first_of_each(hits, ["query_id"], [F.desc("estimate"), F.asc("key")], first).select("query_id", "key"))
    exact = index.vectors.join(near, "key").join(asked, "query_id").select("query_id", "key", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score"))
    return first_of_each(exact, ["query_id"], [F.desc("score"), F.asc("key")], k)
