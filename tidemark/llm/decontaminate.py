"""Benchmark decontamination by winnowing: which words of a document stand in a window of ten words that a benchmark item holds.

A gram is five consecutive words and a window of ten words holds six of them; the fingerprint of a window is its least gram hash.
Equal windows have equal fingerprints, so a passage of ten shared words or more can never be missed.  Training and test
fingerprints meet twice: first in a bitmap of the benchmark's fingerprints, ``PLACES`` bits whatever the benchmark holds, which
every task of the one pass over the texts gets; what that lets through is then joined.  A hit is extended to the windows
around its gram: fingerprint, length and the words themselves are the key of the join, so words decide and a document
window meets one row of the index at most, however many items share it.  Items of fewer than ten words are one window of
their own length, where gram and window are all their words.

The items of a window are named by a set, stored once; a passage of many windows and items costs a document one row a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, stored, work_dir
from tidemark.llm.substrings import hashes, least, spans

WINDOW, GRAM = 10, 5
REACH = WINDOW - GRAM + 1
PLACES = 1 << 25
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FOUND = "array<struct<n:int, h:bigint, words:binary, starts:array<int>>>"


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def fingerprints(h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each window of ``n`` words, from the hashes of the words; windows of different length never share one."""
    least_gram = least(spans(h, GRAM), REACH) if n == WINDOW else spans(h, n)
    return (least_gram ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)


def held_by(prints: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which of the fingerprints have their place, given by their first bits, set in the bitmap."""
    place = prints >> np.uint64(64 - PLACES.bit_length() + 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _windows(words: list[bytes], n: int, wanted: np.ndarray | None) -> list[dict]:
    """Each different window of ``n`` words whose fingerprint the bitmap ``wanted`` holds (all without one), and where it starts."""
    if len(words) < n:
        return []
    prints = fingerprints(hashes(words), n)
    at = np.arange(len(prints)) if wanted is None else np.flatnonzero(held_by(prints, wanted))
    starts: dict[bytes, list[int]] = {}
    for i in at.tolist():
        starts.setdefault(b" ".join(words[i : i + n]), []).append(i)
    signed = prints.view(np.int64)
    return [{"n": n, "h": int(signed[s[0]]), "words": w, "starts": s} for w, s in starts.items()]


def _index(items: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(n, h, words, items_key) of the benchmark's windows and (items_key, items), the sets of item ids that they name."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for key, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = words_of(text)
            rows += [(key, w["n"], w["h"], w["words"]) for w in _windows(words, min(len(words), WINDOW), None)] if words else []
        if not rows:
            return None
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["item_id", "n", "h", "words"])

    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = map_batches(items, run, "item_id string, n int, h long, words binary")
    windows = windows.groupBy("n", "h", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    windows = stored(windows.withColumn("items_key", F.sha2(F.concat_ws(",", "items").cast("binary"), 256)), f"{path}/windows")
    sets = stored(windows.groupBy("items_key").agg(F.first("items").alias("items")), f"{path}/sets")
    return windows.drop("items"), sets


def _bitmap(windows: DataFrame) -> np.ndarray:
    """A bit a place: whether a fingerprint has it; that comes to the driver as at most PLACES / 64 numbers."""
    place = F.shiftrightunsigned("h", 64 - PLACES.bit_length() + 1)
    places = windows.select(F.shiftright(place, 6).alias("at"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = places.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bits = np.zeros(PLACES // 64, np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64)


def _found(docs: DataFrame, wanted, lengths: list[int]) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_words, found): the windows of each row whose fingerprint the bitmap holds."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, found = [], []
        for text in batch["text"].to_pylist():
            words = words_of(text)
            n.append(len(words))
            found.append([w for k in lengths for w in _windows(words, k, wanted.value)])
        kind = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("words", pa.binary()), ("starts", pa.list_(pa.int32()))]))
        return pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "found"])

    return map_batches(docs, run, f"doc_id long, n_words long, found {FOUND}")


def _covered(rows: DataFrame) -> DataFrame:
    """(row, spans, n_hit) of ``rows`` (row, hits): the runs of words [first, end) that windows cover, and how many words that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total = [], []
            for hits in batch["hits"].to_pylist():
                runs: list[list[int]] = []
                for start, end in sorted((s, s + x["n"]) for x in hits for s in x["starts"]):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                out.append([{"first": a, "end": b} for a, b in runs])
                total.append(sum(b - a for a, b in runs))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch["row"], pa.array(out, kind), pa.array(total, pa.int64())], ["row", "spans", "n_hit"])

    return rows.mapInArrow(run, "row long, spans array<struct<first:int, end:int>>, n_hit long")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, n_hit, items) for every row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    ``spans`` are the runs of hit words, ``items`` the ids of the items that have a window there, as strings in order.  Null and
    empty texts have no words, on either side.  Words of an item without id are hit but name no item; items that share an id are
    one.  Rows that repeat, share a doc_id or have none are judged each by its own text.  Texts of any length are read whole; empty
    tables give no rows or no hits; other columns are not read.
    """
    spark, path = docs.sparkSession, work_dir(docs.sparkSession)
    windows, sets = _index(benchmark, path)
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # ten at most
    wanted = spark.sparkContext.broadcast(_bitmap(windows))
    rows = _found(docs.select(F.col("doc_id").cast("long"), "text"), wanted, lengths)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), f"{path}/rows")
    hits = rows.select("row", F.inline("found")).join(windows, ["n", "h", "words"]).select("row", "n", "starts", "items_key")
    hits = stored(hits, f"{path}/hits")
    cover = _covered(hits.groupBy("row").agg(F.collect_list(F.struct("n", "starts")).alias("hits")))
    named = hits.select("row", "items_key").distinct().join(sets, "items_key")
    named = named.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = rows.select("row", "doc_id", "n_words").join(cover, "row", "left").join(named, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<first:int, end:int>>")).alias("spans"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
