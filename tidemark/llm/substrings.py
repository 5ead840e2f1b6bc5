"""Substring dedup: relative Lempel-Ziv factors of documents against blocks of reference text.

A window is 50 consecutive words.  The reference is the text where a repeated window first occurs (in the smallest document
that holds it), cut into blocks of ``BLOCK`` windows; a hot passage so stands in the reference once, however many documents
hold it.  An index over windows says which blocks hold one of a document's windows; no other block can give it a
factor.  The document is then factored greedily against all its blocks: from the first word whose window a block holds, the
longest match with any block, compared word by word, is a factor.  The next one is sought from the first window that
straddles the factor's end, so that boundaries are checked too.  A factor is never shorter than a window, and its words go.

Only windows that can repeat are indexed.  Each window has an anchor, the least hash of its 16-word grams; equal
windows have equal anchors, so an anchor found in one document alone rules its windows out.  One of about 18 words is
an anchor, which is all that is shuffled for text that repeats nowhere.  A text whose words equal an earlier
document's is one factor, told by its digest.

A row is known by doc_id and the digest of its words, so that rows that share a doc_id but not their text stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, held, map_batches, slices, stored, work_dir

WINDOW = 50
GRAM = 16
REACH = WINDOW - GRAM + 1  # grams of a window
MOST_WORDS = 300_000
BLOCK = 256
ROW = ["doc_id", "mark"]


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it grows past MOST_WORDS."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashes(words: list[bytes]) -> np.ndarray:
    """Hash of each word, by the worker's table."""
    return held("word hashes", WordHashes).of(words)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _joined(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """Hash of two neighbouring spans of words from the hashes of each."""
    x = (left ^ (left >> np.uint64(31))) * np.uint64(salt) + right
    return x ^ (x >> np.uint64(29))


def spans(h: np.ndarray, size: int, salt: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each span of ``size`` neighbours, by doubling."""
    out, done, power, width = None, 0, h, 1
    while True:
        if size & width:
            n = len(h) - size + 1
            part = power[done : done + n]
            out = part if out is None else _joined(out, part, salt)
            done += width
        if done == size:
            return out
        power = _joined(power[:-width], power[width:], salt)
        width *= 2


def least(h: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of ``size`` neighbours."""
    power, width = h, 1
    while width * 2 <= size:
        power = np.minimum(power[:-width], power[width:])
        width *= 2
    n = len(h) - size + 1
    return np.minimum(power[:n], power[size - width : size - width + n])


def anchors_of(h: np.ndarray) -> np.ndarray:
    """The anchor of each window of a document's word hashes, as signed 64-bit integers."""
    return least(spans(h, GRAM), REACH).view(np.int64)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_words, digest, anchors) of every row of ``docs``; ``mark`` is the digest's first eight bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, kept, anchors = [], [], []
        for text in batch["text"].to_pylist():
            words = words_of(text)
            n.append(len(words))
            kept.append(digest(words))
            if len(words) < WINDOW:
                anchors.append([])
                continue
            a = anchors_of(hashes(words))
            anchors.append(a[np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))])
        mark = np.array([int(d[:16], 16) for d in kept], np.uint64).view(np.int64)
        cols = [batch["doc_id"], pa.array(mark), pa.array(n, pa.int64()), pa.array(kept), pa.array(anchors, pa.list_(pa.int64()))]
        return pa.record_batch(cols, ["doc_id", "mark", "n_words", "digest", "anchors"])

    return map_batches(docs, run, "doc_id long, mark long, n_words long, digest string, anchors array<long>")


def _windows(candidates: DataFrame) -> DataFrame:
    """(doc_id, mark, start, h, check) of the windows whose anchor is shared."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for key, mark, text, shared in zip(*(batch[c].to_pylist() for c in ("doc_id", "mark", "text")), batch["shared"], strict=True):
            h = hashes(words_of(text))
            if len(h) < WINDOW:
                continue
            at = np.flatnonzero(np.isin(anchors_of(h), shared.values.to_numpy()))
            check = (spans(h, WINDOW, 0xC2B2AE3D27D4EB4F)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            parts.append((np.full(len(at), key), np.full(len(at), mark), at.astype(np.int32), spans(h, WINDOW)[at].view(np.int64), check))
        if not parts:
            return None
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], [*ROW, "start", "h", "check"])

    return map_batches(candidates, run, "doc_id long, mark long, start int, h long, check int")


def _blocks(sources: DataFrame) -> DataFrame:
    """(source, source_mark, block, words) of ``sources`` (doc_id, mark, text, blocks): the words of each block that is asked for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, mark, text, wanted in zip(*(batch[c].to_pylist() for c in ("doc_id", "mark", "text", "blocks")), strict=True):
            words = words_of(text)
            rows += [(key, mark, k, b" ".join(words[k * BLOCK : (k + 1) * BLOCK + WINDOW - 1])) for k in wanted]
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["source", "source_mark", "block", "words"])

    return map_batches(sources, run, "source long, source_mark long, block int, words binary")


class Parsed:
    """The stages of one parse of ``docs`` (doc_id, text), each a table in the shared folder.

    ``profiles``: every row with n_words and digest.  ``firsts``: the smallest doc_id of each digest.  ``candidates``: rows
    with a shared anchor, and their text.  ``blocks``: the reference.  ``factors``: what each row owes to smaller documents.
    """

    def __init__(self, docs: DataFrame):
        path = work_dir(docs.sparkSession)
        docs = docs.select(F.col("doc_id").cast("long"), "text")
        self.profiles = stored(profile(docs), f"{path}/profiles")
        least_of = self.profiles.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("mark").alias("mark"))
        self.firsts = stored(least_of, f"{path}/firsts")
        long = self.profiles.where(F.size("anchors") > 0).select(*ROW, "anchors")
        own = self.firsts.select(F.col("first").alias("doc_id"), "mark")
        anchors = long.join(own, ROW, "left_semi").select(*ROW, F.explode("anchors").alias("anchor"))
        anchors = stored(anchors, f"{path}/anchors")
        both = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
        shared = stored(both.select("anchor"), f"{path}/shared")
        marked = stored(anchors.join(shared, "anchor").groupBy(*ROW).agg(F.collect_set("anchor").alias("shared")), f"{path}/marked")
        texts = docs.join(marked.withColumnRenamed("mark", "own_mark"), "doc_id")
        self.candidates = stored(self._of_mark(texts), f"{path}/candidates")
        windows = stored(_windows(self.candidates), f"{path}/windows")
        index = windows.groupBy("h", "check").agg(F.min(F.struct("doc_id", "mark", "start")).alias("at"), F.max("doc_id").alias("top"))
        index = index.where("at.doc_id < top").select(
            "h", "check", F.col("at.doc_id").alias("source"), F.col("at.mark").alias("source_mark"), F.floor(F.col("at.start") / BLOCK).cast("int").alias("block")
        )
        index = stored(index, f"{path}/index")
        place = ["source", "source_mark", "block"]
        needs = stored(windows.join(index, ["h", "check"]).where("source < doc_id").select(*ROW, *place).distinct(), f"{path}/needs")
        asked = needs.select(*place).distinct().groupBy("source", "source_mark").agg(F.collect_set("block").alias("blocks"))
        asked = asked.select(F.col("source").alias("doc_id"), F.col("source_mark").alias("mark"), "blocks")
        self.blocks = stored(_blocks(self.candidates.select(*ROW, "text").join(asked, ROW)).dropDuplicates(place), f"{path}/blocks")
        given = needs.join(self.blocks, place).groupBy(*ROW).agg(F.collect_list(F.struct("source", "words")).alias("reference"))
        self.parsed = stored(_parse(self.candidates.select(*ROW, "text").join(given, ROW)), f"{path}/parsed")

    @staticmethod
    def _of_mark(texts: DataFrame) -> DataFrame:
        """(doc_id, mark, text, shared) of the rows whose words have the digest that ``own_mark`` says; a doc_id may have several."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            mark = np.array([int(digest(words_of(t))[:16], 16) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            same = pa.array(mark == batch["own_mark"].to_numpy(zero_copy_only=False))
            return pa.record_batch([batch["doc_id"], pa.array(mark), batch["text"], batch["shared"]], [*ROW, "text", "shared"]).filter(same)

        return map_batches(texts.select("doc_id", "own_mark", "text", "shared"), run, "doc_id long, mark long, text string, shared array<long>")


def _match(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements agree."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        off = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(off):
            return at + int(off[0])
        at, step = at + step, 2 * step
    return n


def factors_of(words: list[bytes], blocks: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, words, number of the block) of at least WINDOW words; words decide, hashes only hint."""
    known: dict[bytes, int] = {}
    own = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    parts, first, at = [], [], 0
    for b in blocks:
        parts += [np.array([known.get(w, -1) for w in b], np.int64), np.array([-2])]
        first.append(at)
        at += len(b) + 1
    whole = np.concatenate(parts)
    if len(own) < WINDOW or len(whole) < WINDOW:
        return []
    mix = lambda x: spans((x + 3).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), WINDOW)
    theirs, mine = mix(whole), mix(own)
    order = np.argsort(theirs, kind="stable")
    keys = theirs[order]
    low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
    starts, out, i = np.flatnonzero(high > low), [], 0
    while i < len(starts):
        p = int(starts[i])
        n, r = max((_match(own[p:], whole[r:]), -r) for r in order[low[p] : high[p]].tolist())
        if n < WINDOW:
            i += 1
            continue
        out.append((p, n, int(np.searchsorted(first, -r, "right")) - 1))
        i = int(np.searchsorted(starts, p + n - WINDOW + 1))  # the first window that straddles this factor's end
    return out


def _parse(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, n_removed, kept, starts, lengths, sources) of ``rows`` (doc_id, mark, text, reference)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, kept, found = [], [], ([], [], [])
        for text, reference in zip(batch["text"].to_pylist(), batch["reference"].to_pylist(), strict=True):
            words, edge = words_of(text), None
            cuts = factors_of(words, [x["words"].split(b" ") for x in reference])
            edge = np.zeros(len(words) + 1, np.int32)
            for start, n, _ in cuts:
                edge[start] += 1
                edge[start + n] -= 1
            stay = np.cumsum(edge)[:-1] == 0
            removed.append(len(words) - int(stay.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]).decode("utf-8", "surrogatepass"))
            for column, values in zip(found, ([c[0] for c in cuts], [c[1] for c in cuts], [reference[c[2]]["source"] for c in cuts]), strict=True):
                column.append(values)
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        cols = [batch["doc_id"], batch["mark"], pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))]
        return pa.record_batch(cols, [*ROW, "n_removed", "kept", "starts", "lengths", "sources"])

    return map_batches(rows, run, "doc_id long, mark long, n_removed long, kept string, starts array<int>, lengths array<int>, sources array<long>")


def factors(parsed: Parsed) -> DataFrame:
    """(doc_id, start, n_words, source): the duplicate spans of documents that are not whole copies, in words."""
    each = parsed.parsed.select("doc_id", F.explode(F.arrays_zip("starts", "lengths", "sources")).alias("f"))
    return each.select("doc_id", F.col("f.starts").alias("start"), F.col("f.lengths").alias("n_words"), F.col("f.sources").alias("source"))


def _cut(parsed: Parsed) -> DataFrame:
    """Every row's (doc_id, mark, n_words, digest, n_removed, kept); ``kept`` is null where nothing is removed."""
    rows = parsed.profiles.select(*ROW, "n_words", "digest").join(parsed.firsts.select("digest", "first"), "digest", "left")
    less = parsed.parsed.where("n_removed > 0").dropDuplicates(ROW)
    rows = rows.join(less.select(*ROW, F.col("n_removed").alias("less"), F.col("kept").alias("rest")), ROW, "left")
    copy = (F.col("n_words") >= WINDOW) & (F.col("first") < F.col("doc_id"))
    return rows.select(
        *ROW, "n_words", "digest",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("less", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("rest")).alias("kept"),
    )


def repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``.

    Null, empty and shorter texts lose nothing.  Rows of one doc_id do not remove each other's words, whether their texts are
    equal or not, and each loses what smaller doc_ids hold.  A row without doc_id is neither a source nor shortened.  An
    empty table gives no rows.  Texts of any length are read whole.  Other columns are not read.
    """
    found = _cut(Parsed(docs))
    return found.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2(F.encode("kept", "UTF-8"), 256), "digest").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated words removed from ``text``; other columns stay, all rows stay.

    A text that loses words becomes its kept words joined by one space; any other text, null ones included, is unchanged.
    Repeated rows, null doc_ids and empty tables are treated as by :func:`repeated_words`.
    """
    own, kept = free_name(docs, "changed_id"), free_name(docs, "kept_by_digest")
    changes = _cut(Parsed(docs)).where("n_removed > 0").select("doc_id", "digest", "kept").distinct()
    changes = changes.groupBy(F.col("doc_id").alias(own)).agg(F.map_from_entries(F.collect_list(F.struct("digest", "kept"))).alias(kept))
    words = F.array_join(F.regexp_extract_all(docs["text"], F.lit("[^ \\t\\n\\x0B\\f\\r]+"), F.lit(0)), " ")
    text = F.when(changes[kept].isNotNull(), F.element_at(changes[kept], F.sha2(F.encode(words, "UTF-8"), 256)))
    return docs.join(changes, docs["doc_id"] == changes[own], "left").select(
        *(F.coalesce(text, docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns)
    )
