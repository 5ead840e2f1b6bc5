"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle is five lower-cased words; its weight is how often it occurs times its inverse document frequency.  Documents are counted
by class, so that a thousand near copies make their common shingles no more frequent than one text does: plain min-hashes of
the shingles, three to a label, put copies under a common label, and a document counts as one over the documents of its
largest label.  Frequencies are summed in a sketch of two rows of ``WIDTH`` places, so what the driver holds and the tasks receive has one
size for every corpus.  What stands out of the sketch's own noise is a frequency; any other shingle is rare and weighs as if one
class held it.

Texts of equal words form a class first and only its smallest doc_id goes on.  Documents that agree in all samples of a band
meet in a bucket.  Every member is first compared with its bucket's smallest document, which costs one comparison a
member; what these links join is settled.  Only members of a bucket that are still in different classes are then compared with
each other, in tiles of about ``TILE`` documents a side, one tile pair a group.  So copies by the thousand cost one comparison
each, and every pair that meets is either in one class already or compared.  Links are pairs whose weighted Jaccard
similarity is ``LEAST`` or more; classes are their connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, free_name, map_batches, slices, stored, work_dir
from tidemark.llm.substrings import hashes as word_hashes
from tidemark.llm.substrings import spans

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 11, 3
WIDTH = 1 << 17
#: Labels of a document when classes are counted, and plain min-hashes of a label.
LABELS, LABEL_ROWS = 3, 3
#: Standard deviations of the sketch's places from which a frequency is told from noise.
CLEAR = 4.0
TILE = 128
COLUMNS = 8192
AT_ONCE = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def labels_of(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(documents, LABELS) of documents whose shingles lie end to end, none empty: texts with a Jaccard similarity of s share one with s ** LABEL_ROWS."""
    rng, first = np.random.default_rng(11), np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), LABELS), np.uint64)
    for k in range(LABELS * LABEL_ROWS):
        mix = rng.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)
        x = shingles * mix
        x ^= x >> np.uint64(31)
        x *= mix
        least = np.minimum.reduceat(x ^ (x >> np.uint64(29)), first)
        band = k // LABEL_ROWS
        out[:, band] = (out[:, band] ^ (out[:, band] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + least
    return out.view(np.int64)


def _profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, digest, labels) of every row; no digest where there is no word, no label where there is no shingle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digests, labels = [], [], [None] * batch.num_rows
        places, parts = [], []

        def label() -> None:
            for i, found in zip(places, labels_of(np.concatenate(parts), np.array([len(x) for x in parts])), strict=True):
                labels[i] = found
            places.clear()
            parts.clear()

        for i, text in enumerate(batch["text"].to_pylist()):
            words = words_of(text)
            n.append(len(words))
            digests.append(hashlib.md5(b" ".join(words)).hexdigest() if words else None)
            if len(words) >= SHINGLE:
                places.append(i)
                parts.append(spans(word_hashes(words), SHINGLE))
                if sum(map(len, parts)) >= AT_ONCE:
                    label()
        if parts:
            label()
        cols = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(labels, pa.list_(pa.int64()))]
        return pa.record_batch(cols, ["doc_id", "n_words", "digest", "labels"])

    return map_batches(docs, run, "doc_id long, n_words long, digest string, labels array<long>")


def _shares(firsts: DataFrame, path: str) -> DataFrame:
    """(doc_id, share) of ``firsts`` (first, labels): one over the documents of the largest label that a document has."""
    each = stored(firsts.select(F.col("first").alias("doc_id"), F.posexplode("labels").alias("band", "label")), f"{path}/labels")
    sizes = stored(each.groupBy("band", "label").agg(F.count("*").alias("n")).where("n > 1"), f"{path}/label-sizes")
    most = each.join(sizes, ["band", "label"]).groupBy("doc_id").agg(F.max("n").alias("n"))
    return firsts.select(F.col("first").alias("doc_id")).join(most, "doc_id", "left").select("doc_id", (1 / F.coalesce("n", F.lit(1))).alias("share"))


def counted(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, occurrences) of the distinct shingles."""
    h = word_hashes(words)
    if len(h) < SHINGLE:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    found, times = np.unique(spans(h, SHINGLE), return_counts=True)
    return found, times.astype(np.int32)


def places(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sketch counts each shingle: a place of each row."""
    shift = np.uint64(64 - WIDTH.bit_length() + 1)
    rows = (shingles * np.uint64(m) for m in (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25))
    return tuple((r >> shift).astype(np.int64) + i * WIDTH for i, r in enumerate(rows))


def _sketch(docs: DataFrame) -> DataFrame:
    """(place, n): the counts of each task by place of the sketch, a document counting as its share; place -1 has the documents' own sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, classes = np.zeros(2 * WIDTH), 0.0
        for batch in batches:
            for part in slices(batch):
                found = [counted(words_of(t))[0] for t in part["text"].to_pylist()]
                share = part["share"].to_numpy()
                classes += share.sum()
                each = np.repeat(share, list(map(len, found)))
                for row in places(np.concatenate(found)):
                    total += np.bincount(row, each, minlength=2 * WIDTH)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], classes))], ["place", "n"])

    return docs.select("text", "share").mapInArrow(run, "place int, n double")


def idf_of(count: np.ndarray, classes: float) -> np.ndarray:
    """Inverse frequency by place of the sketch: 1 + ln(classes / frequency), where a place within its row's noise has frequency one.

    What rare shingles add to a place on average, the row's median, is taken off; the noise is measured by the median deviation.
    """
    out = np.empty(2 * WIDTH, np.float32)
    for row in (slice(0, WIDTH), slice(WIDTH, 2 * WIDTH)):
        usual = np.median(count[row])
        noise = 1.4826 * np.median(np.abs(count[row] - usual))
        above = count[row] - usual
        frequency = np.clip(np.where(above > CLEAR * noise, above, 1.0), 1.0, max(classes, 1.0))
        out[row] = 1 + np.log(max(classes, 1.0) / frequency)
    return out


def sketch_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by place of the sketch, over all texts of ``docs`` (text, share); 2 * WIDTH floats whatever the corpus size.

    A shingle's weight is the larger of its two places', as only what meets it in both can hide it.
    """
    rows = _sketch(docs).groupBy("place").agg(F.sum(F.round("n", 9).cast("decimal(28,9)")).cast("double").alias("n")).toArrow()
    place, n = rows["place"].to_numpy(), rows["n"].to_numpy()
    count = np.zeros(2 * WIDTH)
    count[place[place >= 0]] = n[place >= 0]
    return idf_of(count, float(n[place < 0].sum()))


def weights_of(shingles: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Inverse document frequency of each shingle."""
    first, second = places(shingles)
    return np.maximum(idf[first], idf[second])


def weighed(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes ascending, weight of one, occurrences) of a text's shingles."""
    found, times = counted(words_of(text))
    return found, weights_of(found, idf), times


class Sampler:
    """Consistent weighted samples: r and c from Gamma(2, 1) and b uniform, by shingle hash and sample number.

    Each sample hashes a shingle anew, and separate bits of that hash draw r, b (12 bits each) and c (16 bits, since the least c decides most)
    by quantile; so all shingles of a document have draws of their own, however long it is.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.r = self.gamma(12)
        self.log_c = np.log(self.gamma(16)).astype(np.float32)
        self.b = ((np.arange(1 << 12) + 0.5) / (1 << 12)).astype(np.float32)
        self.mix = rng.integers(1, 1 << 63, samples, np.uint64) | np.uint64(1)
        self.salt = rng.integers(1, 1 << 63, samples, np.uint64) | np.uint64(1)

    @staticmethod
    def gamma(bits: int) -> np.ndarray:
        """Quantiles of Gamma(2, 1) at the middles of 2 ** bits equal shares: the roots of 1 - (1 + x) exp(-x) = u."""
        u = (np.arange(1 << bits) + 0.5) / (1 << bits)
        low, high = np.zeros_like(u), np.full_like(u, 60.0)
        for _ in range(60):
            x = (low + high) / 2
            under = 1 - (1 + x) * np.exp(-x) < u
            low, high = np.where(under, x, low), np.where(under, high, x)
        return ((low + high) / 2).astype(np.float32)

    def samples(self, shingles: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the least draw, its level) by document, one sample after the other; documents lie end to end, none empty."""
        log_w = np.log(weights).astype(np.float32)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(shingles))
        for mix in self.mix:
            x = shingles * mix
            x ^= x >> np.uint64(31)
            x *= mix
            c = self.log_c[(x >> np.uint64(48)).astype(np.int64)]
            r = self.r[((x >> np.uint64(36)) & np.uint64(0xFFF)).astype(np.int64)]
            b = self.b[((x >> np.uint64(24)) & np.uint64(0xFFF)).astype(np.int64)]
            t = np.floor(log_w / r + b)
            value = c - r * (t - b + 1)
            order = value.view(np.int32)
            order = order ^ ((order >> 31) & np.int32(0x7FFFFFFF))  # integers in the order of the values
            least = np.minimum.reduceat((order.astype(np.int64) << 32) | place, first) & 0xFFFFFFFF  # of equal values the first
            yield least, t[least].astype(np.int64)

    def keys(self, shingles: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(documents, BANDS): equal keys mean equal (shingle, level) samples in all rows of a band."""
        out = np.empty((len(sizes), BANDS), np.uint64)
        for k, (at, level) in enumerate(self.samples(shingles, weights, sizes)):
            said = (shingles[at] + (level & 0xFFFF).astype(np.uint64)) * self.salt[k]
            said ^= said >> np.uint64(32)
            band = k // ROWS
            out[:, band] = (out[:, band] ^ (out[:, band] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + said if k % ROWS else said
        return out.view(np.int64)


def _samples(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, band, key): a row a band of each document with a shingle; documents are sampled together, about AT_ONCE shingles at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weights = Sampler(), idf.value

        def drawn(ids: list[int], found: list) -> pa.RecordBatch:
            h, w = np.concatenate([x[0] for x in found]), np.concatenate([x[1] * x[2] for x in found])
            keys = sampler.keys(h, w, np.array([len(x[0]) for x in found]))
            cols = [np.repeat(np.array(ids, np.int64), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(ids)), keys.ravel()]
            return pa.record_batch([pa.array(c) for c in cols], ["doc_id", "band", "key"])

        for batch in batches:
            for part in slices(batch):
                ids, found, held = [], [], 0
                for key, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    x = weighed(text, weights)
                    if len(x[0]):
                        ids.append(key)
                        found.append(x)
                        held += len(x[0])
                    if held >= AT_ONCE:
                        yield drawn(ids, found)
                        ids, found, held = [], [], 0
                if ids:
                    yield drawn(ids, found)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, band int, key long")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets (hashes, weights)."""
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    return float(common / (total - common))


def _common(a: list, b: list) -> np.ndarray:
    """Common weight of each pair of shingle sets; a shingle that occurs n times counts as n elements of its weight."""

    def elements(sets: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(h) for h, _, _ in sets])
        h, w, n = (np.concatenate([x[i] for x in sets]) for i in range(3))
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(owner, n), np.repeat(h, n) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.repeat(w, n)

    (row_a, el_a, w_a), (row_b, el_b, _) = elements(a), elements(b)
    shared = np.intersect1d(el_a, el_b)  # what one side alone has adds nothing
    out = np.zeros((len(a), len(b)))
    for s in range(0, len(shared), COLUMNS):
        part = shared[s : s + COLUMNS]
        both = []
        for row, el, w, n in ((row_a, el_a, w_a, len(a)), (row_b, el_b, None, len(b))):
            at = np.minimum(np.searchsorted(part, el), len(part) - 1)
            hit = part[at] == el
            m = np.zeros((n, len(part)), np.float32)
            m[row[hit], at[hit]] = 1 if w is None else w[hit]
            both.append(m)
        out += both[0] @ both[1].T
    return out


def alike(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a``, in ``b``) of the pairs of shingle sets with a similarity of LEAST or more."""
    if not a or not b:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total_a, total_b = (np.array([w.astype(np.float64) @ n for _, w, n in side]) for side in (a, b))
    common = _common(a, b)
    found = common / (total_a[:, None] + total_b[None, :] - common)
    for i, j in zip(*np.nonzero(np.abs(found - LEAST) < 1e-4), strict=True):  # sums in single precision do not decide
        found[i, j] = similarity(*((h, w * n) for h, w, n in (a[i], b[j])))
    return np.nonzero(found >= LEAST)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    apart = a != b
    return pa.table({"a": pa.array(a[apart], pa.int64()), "b": pa.array(b[apart], pa.int64())})


def _star_links(group: pa.Table, idf: np.ndarray) -> pa.Table:
    """(a, b): the members of a group that are like its head, and the head."""
    ids, head = group["doc_id"].to_numpy(), group["rep"].to_numpy()
    sets = [weighed(t, idf) for t in group["text"].to_pylist()]
    heads, others = np.flatnonzero(ids == head), np.flatnonzero(ids != head)
    x, y = alike([sets[i] for i in others], [sets[i] for i in heads])
    return _pairs(ids[others[x]], ids[heads[y]])


def _cross_links(tile: pa.Table, idf: np.ndarray) -> pa.Table:
    """(a, b): the labels of the pairs of a tile that are alike and have different labels; each pair of labels once."""
    side, label = tile["side"].to_numpy(), tile["label"].to_numpy()
    sets = [weighed(t, idf) for t in tile["text"].to_pylist()]
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    x, y = alike([sets[i] for i in a], [sets[i] for i in b])
    found = np.unique(np.stack([label[a[x]], label[b[y]]], 1), axis=0)
    return _pairs(found[:, 0], found[:, 1])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) for every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id of the class; ``kept`` tells that document.  Texts of one to four words are
    alike only when their words are equal.  A null, empty or blank text is a class of its own, and so is a row
    without doc_id, whose class_id is null.  Rows that repeat a doc_id count as one document, with all its texts.  Texts
    of any length are read whole.  An empty table gives no rows.  Other columns are not read.
    """
    spark, path = docs.sparkSession, work_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    profiles = stored(_profiles(docs), f"{path}/profiles")
    least = profiles.where("doc_id is not null and digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("n_words").alias("n_words"), F.first("labels").alias("labels")
    )
    firsts = stored(least, f"{path}/firsts")
    long = stored(_shares(firsts.where(F.col("n_words") >= SHINGLE), path).groupBy("doc_id").agg(F.max("share").alias("share")), f"{path}/long")
    once = stored(docs.join(long.hint("merge"), "doc_id"), f"{path}/once")  # texts are dealt out alike at every size
    idf = spark.sparkContext.broadcast(sketch_weights(once))
    samples = stored(_samples(once, idf), f"{path}/samples")
    # Buckets of the same documents count once.
    buckets = samples.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("top"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("mark")
    )
    buckets = buckets.where("low < top").groupBy("n", "low", "top", "mark").agg(F.min(F.struct("band", "key")).alias("at"))
    buckets = buckets.select("at.band", "at.key", "low", "n")
    salts = buckets.groupBy("low").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("salts"))
    buckets = stored(buckets.join(salts, "low"), f"{path}/buckets")
    members = stored(samples.join(buckets.select("band", "key", "low", "salts"), ["band", "key"]), f"{path}/members")
    involved = stored(members.select("doc_id").distinct(), f"{path}/involved")
    texts = stored(once.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), f"{path}/texts")

    def star_links(group: pa.Table) -> pa.Table:
        return _star_links(group, idf.value)

    salt = F.pmod(F.xxhash64("doc_id"), F.col("salts").cast("long")).cast("int").alias("salt")
    to_low = members.where("doc_id != low").select(F.col("low").alias("rep"), salt, "doc_id").distinct()
    heads = buckets.select(F.col("low").alias("rep"), "salts").distinct().select("rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    stars = to_low.unionByName(heads.withColumn("doc_id", F.col("rep"))).join(texts, "doc_id")
    links = stored(stars.groupBy("rep", "salt").applyInArrow(star_links, "a long, b long").distinct(), f"{path}/links")
    settled = stored(components(links, f"{path}/parts"), f"{path}/settled").select(F.col("node").alias("doc_id"), F.col("component").alias("label"))

    labelled = members.select("band", "key", "doc_id").join(settled, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    labelled = stored(labelled, f"{path}/labelled")
    each = labelled.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    mixed = each.groupBy("band", "key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    mixed = stored(mixed.select("band", "key", F.col("main.label").alias("main"), tiles(F.col("all") - F.col("main.n")).alias("rows"), tiles(F.col("all")).alias("cols")), f"{path}/mixed")
    apart = labelled.join(mixed, ["band", "key"])
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = apart.where("label != main").select("band", "key", "doc_id", "label", F.lit(0).alias("side"), dealt("rows", 1).alias("i"), every("cols").alias("j"))
    right = apart.select("band", "key", "doc_id", "label", F.lit(1).alias("side"), dealt("cols", 2).alias("j"), every("rows").alias("i"))

    def cross_links(tile: pa.Table) -> pa.Table:
        return _cross_links(tile, idf.value)

    crossed = left.unionByName(right).join(texts, "doc_id").groupBy("band", "key", "i", "j").applyInArrow(cross_links, "a long, b long")
    bridges = stored(crossed.distinct(), f"{path}/bridges")
    joined = stored(components(bridges, f"{path}/wholes"), f"{path}/whole")
    classes = firsts.join(settled, F.col("first") == F.col("doc_id"), "left").select("digest", F.coalesce("label", "first").alias("label"))
    classes = classes.join(joined, F.col("label") == F.col("node"), "left").select("digest", F.coalesce("component", "label").alias("class_id"))
    return profiles.join(classes, "digest", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("class_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the kept document of their class, with all their columns.

    Rows that repeat a kept doc_id all stay, as do rows without text or doc_id; an empty table gives no rows.
    """
    own = free_name(docs, "kept_id")
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[own]), "left_semi")
