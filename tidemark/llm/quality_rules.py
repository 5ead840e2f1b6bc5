"""Quality rules: word counts of whole texts and bands of zstandard compression ratios.

``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` describe the whole text.
A text that fails the base rules is rejected; any other is compressed, as a whole and in fixed chunks,
and must lie inside the band of its length: repetitive text compresses too well, random text too badly.

Two levels tell what one cannot.  The first codes letters by their frequency, so digits or hexadecimal noise, of few different
characters, come out like prose; the second (a fast level) writes letters as they are and gains by repeated strings alone, of which
noise of any alphabet has none.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches, texts_where

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Accepted ratios raw bytes / compressed bytes.

    ``whole``: (bytes up to, least, most); short texts cannot shrink far, long ones shrink more, so the
    limits follow the length.  Each lower limit lies between the measured ratios of random letters and digits and
    those of clean text of that length; from 1,536 bytes on also above random lower-case letters.  A text is cut into chunks of
    ``chunk_bytes``; full ones are bounded by ``chunk``, the last by the limits of its own length, and a text is rejected when
    chunks with more than ``chunk_share`` of its bytes lie outside.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (64, 0.89, 3.0),
        (96, 0.98, 3.0),
        (128, 1.02, 3.0),
        (192, 1.09, 3.0),
        (256, 1.16, 3.0),
        (320, 1.18, 3.0),
        (384, 1.22, 3.0),
        (512, 1.30, 3.0),
        (768, 1.40, 3.0),
        (1024, 1.50, 3.0),
        (1536, 1.58, 3.6),
        (2048, 1.70, 3.6),
        (4096, 1.75, 3.6),
        (16384, 1.85, 4.5),
        (float("inf"), 1.95, 6.0),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.72, 3.6)
    chunk_share: float = 0.34
    level: int = 3
    #: (bytes up to, least) of ratios at ``matched_level``: above noise of any alphabet, below the least of clean text and of English prose.
    matched: tuple[tuple[float, float], ...] = ((600, 0.0), (1000, 1.005), (1500, 1.03), (2048, 1.06), (4096, 1.1), (8192, 1.2), (float("inf"), 1.3))
    matched_chunk: float = 1.1
    matched_level: int = -1

    def of(self, size: int) -> tuple[float, float]:
        """(least, most) for a text of ``size`` bytes."""
        return next(x[1:] for x in self.whole if size < x[0])

    def least_matched(self, size: int) -> float:
        return next(least for most, least in self.matched if size < most)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside some ``width``-word window whose words occur at two or more places of ``words``."""
    n = len(words)
    if n <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    for step in (1, 2, 4):
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ (h[step:] >> np.uint64(29)))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(len(h), bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    keys = [tuple(words[i : i + width]) for i in at]  # equal hashes are only a hint; words decide
    seen = Counter(keys)
    edge = np.zeros(n + 1, np.int32)
    for i, key in zip(at, keys, strict=True):
        if seen[key] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def in_band(text: str, bands: Bands, packer: zstandard.ZstdCompressor, matcher: zstandard.ZstdCompressor) -> tuple[bool, float, float]:
    """(accepted, ratio of the whole text, share of its bytes in chunks outside their limits)."""
    raw, size, off = text.encode("utf-8", "surrogatepass"), bands.chunk_bytes, 0
    of = lambda data, by: len(data) / len(by.compress(data))
    ratio = of(raw, packer)
    for start in range(0, len(raw), size):
        chunk = raw[start : start + size]
        full = len(chunk) == size
        least, most = bands.chunk if full else bands.of(len(chunk))
        matched = bands.matched_chunk if full else bands.least_matched(len(chunk))
        off += 0 if least <= of(chunk, packer) <= most and of(chunk, matcher) >= matched else len(chunk)
    least, most = bands.of(len(raw))
    inside = least <= ratio <= most and of(raw, matcher) >= bands.least_matched(len(raw))
    return inside and off <= bands.chunk_share * len(raw), ratio, off / len(raw)


def _judge(texts: list[str | None], bands: Bands) -> list[tuple]:
    packer, matcher = (zstandard.ZstdCompressor(level=x) for x in (bands.level, bands.matched_level))
    out = []
    for text in texts:
        counts = measure(text)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        kept, ratio, share = (False, 0.0, 0.0) if failed else in_band(text, bands, packer, matcher)
        out.append((*counts, failed, kept, ratio, share))
    return out


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ``base_failed``, ``kept``, ratio and chunk share.

    Null and empty texts have zero words, so they fail the base rules; ratios are 0 for texts that
    fail.  A text of any length is measured and compressed whole.  A ratio at a limit is inside.  Repeated rows are judged each; a null doc_id is
    carried; an empty table gives no rows.  Other columns are not read.
    """

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(zip(*_judge(batch["text"].to_pylist(), bands), strict=True))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_share"]
        return pa.record_batch([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return map_batches(
        docs.select("doc_id", "text"),
        judge,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, ratio double, chunk_share double",
    )


def keep_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns unchanged.

    Null and empty texts go; repeated rows and rows without doc_id are judged by their text like any other; an empty table gives no rows.
    """

    return texts_where(docs, "text", lambda texts: [x[6] for x in _judge(texts, bands)])
