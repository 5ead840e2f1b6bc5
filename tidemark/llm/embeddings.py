"""Embedding near-dedup: randomised-rotation binary codes with stored correction factors.

A unit vector is rotated at random and keeps the signs of its coordinates: the code, stored with one factor a rotation, the
inner product of the vector with the corner its code names.  Dividing by the factor makes the code's inner product with
any vector an unbiased estimate of the cosine, with an error that shrinks with the dimension.

Equal vectors are one class with a count.  Vectors that agree on a band of sign bits meet in a bucket (each bit of a band is
a direction of its own, shared with no other bit or band).  The bands carry ids and codes only, so what is shuffled grows with the
number of bands: the bits in which two codes differ estimate the angle, and a pair out of its confidence bound is dropped.
Vectors with a pair left get the bits of the earlier bands, which say where a pair meets first; those with a pair that is
new there are fetched, and the unbiased estimate with its bound says which pairs are computed exactly, in double precision.

Buckets are compared in tiles of at most ``TILE`` vectors a side, one tile pair a group, so a bucket of any size is
spread over tasks.  A pair that meets in several bands counts in the first.  Pairs are never listed: a tile
returns, for each vector, how many links it found and the smallest vector of its local component.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, map_batches, stored, work_dir

LEAST = 0.9
ROTATIONS = 4
TILE = 1024
#: Unrelated vectors that a bucket holds at every corpus size, and the chance that a pair at the threshold meets in no band.
BUCKET = 1024
MISS = 1e-6
SEED = 20
#: Standard errors between an estimate and the cosine it may still reach.
CONFIDENCE = 5.0
AT_ONCE = 1 << 16
GROUP = ["dim", "band", "key", "i", "j"]


@lru_cache(maxsize=4)
def rotations(dim: int) -> np.ndarray:
    """ROTATIONS random orthogonal matrices, side by side: (dim, ROTATIONS * dim)."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(ROTATIONS):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, 1)


def units(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as booleans, factor by rotation) of unit vectors."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim)
    factor = np.abs(turned).reshape(len(unit), ROTATIONS, dim).sum(2) / np.sqrt(dim)
    return turned > 0, factor


def bands_of(n: int) -> tuple[int, int]:
    """(bits of a band, bands) for ``n`` vectors: longer bands as the corpus grows, and as many as MISS asks for.

    Bits and bands are independent, so a pair at the threshold misses all bands with (1 - agree) ** bands exactly.
    """
    bits = int(np.clip(np.ceil(np.log2(max(n, 2) / BUCKET)), 4, 30))
    agree = (1 - np.arccos(LEAST) / np.pi) ** bits
    return bits, int(np.ceil(np.log(MISS) / np.log1p(-agree)))


@lru_cache(maxsize=4)
def directions(dim: int, n: int) -> np.ndarray:
    """(dim, n): one column of each of ``n`` independent random rotations, which is a uniform direction; lengths do not matter."""
    return np.random.default_rng(SEED + 1).standard_normal((n, dim)).T


def band_sides(unit: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): on which side of ``n`` directions unit vectors lie; a band reads ``bits`` of them that no other band reads."""
    ways = directions(unit.shape[1], n)
    return np.concatenate([unit[s : s + 2048] @ ways > 0 for s in range(0, len(unit), 2048)])


def band_keys(sides: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bands) keys of the bands' sides."""
    return (sides.reshape(len(sides), -1, bits) @ np.left_shift(1, np.arange(bits))).astype(np.int32)


def differing_bits(dim: int) -> int:
    """The most bits in which the codes of a pair at the threshold differ, CONFIDENCE standard errors above the mean."""
    bits, share = ROTATIONS * dim, np.arccos(LEAST) / np.pi
    return int(bits * share + CONFIDENCE * np.sqrt(bits * share * (1 - share)))


def upper_bounds(unit: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The largest cosine each pair may have: the unbiased estimate of column vectors' codes with row vectors, plus the bound.

    ``unit`` are the row vectors, ``signs`` and ``factor`` the column vectors' stored codes.
    """
    dim = unit.shape[1]
    turned = (unit @ rotations(dim)).astype(np.float32)
    corners = (np.where(signs, 1, -1) / np.sqrt(dim)).reshape(len(signs), ROTATIONS, dim)
    corners = (corners / factor[:, :, None] / ROTATIONS).reshape(len(signs), -1).astype(np.float32)
    error = np.sqrt(np.maximum((1 - factor**2) / factor**2, 0).sum(1)) / ROTATIONS / np.sqrt(max(dim - 1, 1))
    return turned @ corners.T + CONFIDENCE * error[None, :] + 1e-5


def _plain(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, dim, vector): every row, its vector packed; null where it links with nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, packed = [], []
        for v in batch["embedding"]:
            a = None if not v.is_valid or v.values.null_count or not len(v.values) else v.values.to_numpy().astype(np.float64)
            good = a is not None and np.isfinite(a).all() and a.any()
            dims.append(len(a) if good else None)
            packed.append((a + 0.0).astype(kind).tobytes() if good else None)
        return pa.record_batch([batch["vec_id"], pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "dim", "vector"])

    return map_batches(vectors, run, "vec_id long, dim int, vector binary")


def _coded(classes: DataFrame, bits: int, bands: int, kind: str) -> DataFrame:
    """``classes`` (uid, first, n, dim, vector) with code, factors, the bits of all bands packed, and the key of each band."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, vectors, parts = batch["dim"].to_numpy(), batch["vector"].to_pylist(), []
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            unit = units(list(np.frombuffer(b"".join(vectors[i] for i in rows.tolist()), kind).reshape(-1, dim)))
            signs, factor = encode(unit)
            side = band_sides(unit, bits * bands)
            cols = [
                pa.array([x.tobytes() for x in words64(signs)], pa.binary()),
                pa.array([x.tobytes() for x in factor.astype("<f8")], pa.binary()),
                pa.array([x.tobytes() for x in np.packbits(side, 1)], pa.binary()),
                pa.array(list(band_keys(side, bits)), pa.list_(pa.int32())),
            ]
            same = batch.take(pa.array(rows))
            parts.append(pa.record_batch([*(same[c] for c in ("uid", "first", "n", "dim", "vector")), *cols], ["uid", "first", "n", "dim", "vector", "code", "factors", "sides", "keys"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    schema = "uid long, first long, n long, dim int, vector binary, code binary, factors binary, sides binary, keys array<int>"
    return map_batches(classes.select("uid", "first", "n", "dim", "vector"), run, schema)


def words64(signs: np.ndarray) -> np.ndarray:
    """Signs packed into rows of 64-bit words."""
    packed = np.packbits(signs, 1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def _close_codes(tile: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``tile`` of the pairs whose codes are close enough and, where it has ``sides``, that meet in this band first."""
    band, side, own = tile["band"][0].as_py(), tile["side"].to_numpy(), tile["i"][0] == tile["j"][0]
    code, limit = _matrix(tile["code"], np.uint64), differing_bits(tile["dim"][0].as_py())
    a, b = (np.arange(len(side)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    off = np.zeros((len(a), len(b)), np.uint16)
    for w in range(code.shape[1]):
        off += np.bitwise_count(code[a, w][:, None] ^ code[b, w][None, :])
    i, j = np.nonzero(off <= limit)
    i, j = a[i], b[j]
    if own:
        i, j = i[i < j], j[i < j]
    if "sides" not in tile.column_names or not band:
        return i, j
    fresh, sides = np.ones(len(i), bool), _matrix(tile["sides"], np.uint8)
    for s in range(0, len(i), AT_ONCE):  # a pair counts in the first band where it meets
        x = np.unpackbits(sides[i[s : s + AT_ONCE]] ^ sides[j[s : s + AT_ONCE]], axis=1, count=band * bits)
        fresh[s : s + AT_ONCE] = x.reshape(-1, band, bits).any(2).all(1)
    return i[fresh], j[fresh]


def _hopeful(tile: pa.Table, bits: int) -> pa.Table:
    """The vectors of a tile pair that may have a link there."""
    i, j = _close_codes(tile, bits)
    return tile.select([*GROUP, "side", "uid"]).take(pa.array(np.unique(np.concatenate([i, j]))))


def _tile_links(tile: pa.Table, kind: str, bits: int) -> pa.Table:
    """Links inside one tile pair: (uid, node, n, least) of every vector with a link, nodes being smallest vec_ids of classes."""
    i, j = _close_codes(tile, bits)
    dim, uid, first, times = tile["dim"][0].as_py(), tile["uid"].to_numpy(), tile["first"].to_numpy(), tile["n"].to_numpy()
    unit = units(list(_matrix(tile["vector"], kind)))
    signs = np.unpackbits(_matrix(tile["code"], np.uint8), axis=1, count=ROTATIONS * dim).astype(bool)
    if len(i):
        a, b = np.unique(i), np.unique(j)
        bound = upper_bounds(unit[a], signs[b], _matrix(tile["factors"], "<f8")[b])
        open_ = bound[np.searchsorted(a, i), np.searchsorted(b, j)] >= LEAST
        i, j = i[open_], j[open_]
    exact = [np.einsum("ij,ij->i", unit[i[s : s + AT_ONCE]], unit[j[s : s + AT_ONCE]]) for s in range(0, len(i), AT_ONCE)]
    close = np.concatenate(exact or [np.empty(0)]) >= LEAST
    i, j = i[close], j[close]
    linked = np.unique(np.concatenate([i, j]))
    x, y = np.searchsorted(linked, i), np.searchsorted(linked, j)
    n = np.bincount(x, times[j], len(linked)) + np.bincount(y, times[i], len(linked))
    root, low = None, first[linked]
    while root is None or (low != root).any():  # smallest node reachable inside the tile
        root = low
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
    cols = [pa.array(uid[linked], pa.int64()), pa.array(first[linked], pa.int64()), pa.array(n.astype(np.int64)), pa.array(root, pa.int64())]
    return pa.table(cols, ["uid", "node", "n", "least"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so does a row without
    vec_id.  Vectors of different lengths are not compared.  A worker holds four rotations, so memory and time grow with the
    square of the length, which is meant to be a few thousand at most.  Equal vectors are linked.  Rows that repeat
    a vec_id count as separate vectors in each other's ``n_links`` but form one component.  An empty table gives no rows.
    Other columns are not read.
    """
    path = work_dir(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    plain = stored(_plain(rows, kind).select("vec_id", "dim", "vector", F.md5("vector").alias("same")), f"{path}/plain")
    classes = plain.where("vector is not null and vec_id is not null").groupBy("same").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("dim").alias("dim"), F.first("vector").alias("vector")
    )
    classes = stored(classes.withColumn("uid", F.monotonically_increasing_id()), f"{path}/classes")
    bits, bands = bands_of(classes.count())
    coded = stored(_coded(classes, bits, bands, kind), f"{path}/coded")
    met = coded.select("dim", F.posexplode("keys").alias("band", "key"))
    sizes = stored(met.groupBy("dim", "band", "key").agg(F.count("*").alias("size")).where("size > 1"), f"{path}/sizes")
    # A bucket is cut into tiles by a hash of the vector; tile pair (i, j), i <= j, is a group, and a vector goes to each pair of its tile.
    wide = coded.select("uid", "dim", "code", F.posexplode("keys").alias("band", "key")).join(sizes, ["dim", "band", "key"])
    wide = wide.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    wide = wide.withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles").cast("long")).cast("int"))
    pairs = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select(
        "dim", "band", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
        (F.col("tile") > F.col("other")).cast("int").alias("side"), "uid", "code",
    )

    def hopeful(tile: pa.Table) -> pa.Table:
        return _hopeful(tile, bits)

    def links_of(tile: pa.Table) -> pa.Table:
        return _tile_links(tile, kind, bits)

    found = "dim int, band int, key int, i int, j int, side int, uid long"
    near = stored(pairs.groupBy(*GROUP).applyInArrow(hopeful, found), f"{path}/near")
    earlier = F.expr(f"substring(sides, 1, int(ceil(band * {bits} / 8)))")  # the bits of the bands before
    near = near.join(coded.select("uid", "code", "sides"), "uid").select(*GROUP, "side", "uid", "code", earlier.alias("sides"))
    left = stored(near.groupBy(*GROUP).applyInArrow(hopeful, found), f"{path}/left").join(coded.drop("dim", "keys"), "uid")
    found = stored(left.groupBy(*GROUP).applyInArrow(links_of, "uid long, node long, n long, least long"), f"{path}/found")
    links = found.groupBy("uid").agg(F.sum("n").alias("more"))
    whole = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), path)
    each = classes.select("same", "uid", "n", "first").join(links, "uid", "left").join(whole, F.col("first") == F.col("node"), "left")
    each = each.select(
        "same", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "first").alias("component_id")
    )
    known = plain.where("vec_id is not null").select("vec_id", "same").join(each, "same", "left")
    out = known.unionByName(plain.where("vec_id is null").select("vec_id", "same"), allowMissingColumns=True)
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
