"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays, one a language.

A model scores words, each between start and end marks, by 5-grams of its letters in lower case; contexts do not cross
words, so each distinct word is scored once in a batch.  For each order the hashes of the n-grams seen lie sorted in
one array, beside their interpolated log probabilities and, for contexts, the back-off weights.  A text goes to
the language of least cross-entropy a character.  Labelled documents that were not counted calibrate the rejection: their deviations
from their language's mean give a variance within a text, which falls with its length, and one between texts, which does not; a
text is rejected beyond the limit that the tail of their deviations sets for ``FALSE_REJECTS``.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, map_batches, slices, texts_where

ORDER = 5
START, END = "\x02", "\x03"
WORDS = re.compile(r"[^\W\d_]+")
UNIFORM = 1 / 4096
UNKNOWN = "und"
#: Share of texts of a known language that may be rejected, by an exponential tail beyond the farthest tenth of the calibration documents.
FALSE_REJECTS = 1e-6
MOST_WORDS = 300_000
FIT_DOCS = 3000
CALIBRATION_DOCS = 500
BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: str | None) -> list[str]:
    """The runs of letters (Unicode's classes L) of a text in lower case; fractions, numerals and other numbers that words may hold are none."""
    runs = WORDS.findall((text or "").lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [part for run in runs for part in "".join(c if c.isalpha() else " " for c in run).split()]


def hashes(chars: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.full(len(chars), np.uint64(chars.shape[1]))
    for i in range(chars.shape[1]):
        h = (h ^ (h >> np.uint64(31))) * BASE + chars[:, i].astype(np.uint64)
    return h


@dataclass
class Model:
    """By order 1..ORDER: sorted hashes with log probabilities, and sorted context hashes with log back-off weights."""

    seen: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    log_backoff: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, grams: list[str], counts: np.ndarray) -> Model:
        """From the counts of all padded ORDER-grams."""
        chars = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
        raw, levels = np.array(counts, np.float64), []
        for k in range(ORDER, 0, -1):  # adjusted counts of each order, from the order above
            if k == ORDER:
                levels.append((chars, raw))
                continue
            above, total = levels[-1][0], None
            part, at = np.unique(above[:, 1:], axis=0, return_inverse=True)
            follow = np.bincount(at.ravel(), minlength=len(part)).astype(np.float64)
            whole, where = np.unique(chars[:, ORDER - k :], axis=0, return_inverse=True)
            total = np.bincount(where.ravel(), raw, len(whole))  # the same rows in the same order as ``part``
            levels.append((part, np.where(part[:, 0] == ord(START), total, follow)))
        m, lower = cls(), {}
        for k, (part, n) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
            one, two = float((n == 1).sum()), float((n == 2).sum())
            d = one / (one + 2 * two) if one and two else 0.5
            context, at = np.unique(part[:, :-1], axis=0, return_inverse=True)
            at = at.ravel()
            total = np.bincount(at, n, len(context))
            back = d * np.bincount(at, minlength=len(context)) / total
            if k == 1:
                below = np.full(len(part), UNIFORM)
            else:
                below = np.exp(m._find(m.seen[k - 2], m.log_p[k - 2], hashes(part[:, 1:]))[0])
            p = np.maximum(n - d, 0) / total[at] + back[at] * below
            for keys, values, key_list, value_list in (
                (hashes(part), np.log(p), m.seen, m.log_p),
                (hashes(context), np.log(back), m.contexts, m.log_backoff),
            ):
                by = np.argsort(keys)
                key_list.append(keys[by])
                value_list.append(values[by])
        return m

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of ``wanted``, found); 0 where not found."""
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = keys[at] == wanted
        return np.where(found, values[at], 0.0), found

    def log_prob(self, windows: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each row of ORDER code points, given the others."""
        out = np.zeros(len(windows))
        left = np.arange(len(windows))
        for k in range(ORDER, 0, -1):
            rows = windows[left, ORDER - k :]
            p, found = self._find(self.seen[k - 1], self.log_p[k - 1], hashes(rows))
            out[left[found]] += p[found]
            left, rows = left[~found], rows[~found]
            if not len(left):
                return out
            out[left] += self._find(self.contexts[k - 1], self.log_backoff[k - 1], hashes(rows[:, :-1]))[0]
        out[left] += np.log(UNIFORM)
        return out


@dataclass
class Languages:
    """The models of all learned languages, the mean cross-entropy of each, and the calibrated rejection."""

    names: list[str]
    models: list[Model]
    mean: np.ndarray
    within: float = 2.0
    between: float = 0.01
    limit: float = 20.0

    def far(self, entropy: np.ndarray, n: np.ndarray, language: np.ndarray) -> np.ndarray:
        """How many standard deviations the cross-entropy of texts of ``n`` characters lies above their language's mean."""
        return (entropy - self.mean[language]) / np.sqrt(self.within / np.maximum(n, 1) + self.between)

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, language: np.ndarray) -> None:
        """Set means, variances and limit from labelled texts that were not counted; without any the defaults stay."""
        for i in range(len(self.names)):
            if (language == i).any():
                self.mean[i] = np.average(entropy[language == i], weights=n[language == i])
        if len(n) < 2:
            return
        off = (entropy - self.mean[language]) ** 2 * n  # within + between * n on average, with an error that grows likewise
        for _ in range(8):
            odd = off / (self.within + self.between * n)
            usual = odd <= np.quantile(odd, 0.99)  # texts in two languages do not widen what is usual
            a, b = np.stack([np.ones(len(n)), n], 1)[usual], (1 / (self.within + self.between * n) ** 2)[usual, None]
            found = np.linalg.lstsq((a * b).T @ a, (a * b).T @ off[usual], rcond=None)[0]
            self.within, self.between = np.maximum(found, [1e-3, 1e-6]).tolist()
        far = np.sort(self.far(entropy, n, language))
        edge = float(np.quantile(far, 0.9))
        excess = float(np.mean(np.append(far[far > edge] - edge, 0.0)[: max((far > edge).sum(), 1)]))
        self.limit = edge + excess * float(np.log(0.1 / FALSE_REJECTS))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Rows (characters with the end mark, log probability under each language)."""
        padded = [START * (ORDER - 1) + w + END for w in words]
        sizes = np.array([len(w) + 1 for w in words])
        text = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
        first = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]
        windows = np.stack([text[at + i] for i in range(ORDER)], 1)
        return np.stack([sizes, *(np.bincount(owner, m.log_prob(windows), len(words)) for m in self.models)], 1)


class Scorer:
    """A worker's table of scored words."""

    def __init__(self, languages: Languages):
        self.languages, self.row = languages, {}
        self.table = np.zeros((1024, 1 + len(languages.names)))

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """For each text the sums over its words; a zero row where there is no letter."""
        split = list(map(letter_runs, texts))
        new = set().union(*split) - self.row.keys()
        if len(self.row) + len(new) > MOST_WORDS:
            self.row.clear()
            new = set().union(*split)
        if new:
            start, new = len(self.row), list(new)
            if start + len(new) > len(self.table):
                self.table = np.resize(self.table, (max(2 * len(self.table), start + len(new)), self.table.shape[1]))
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.table[start + i : start + i + len(part)] = self.languages.word_scores(part)
            self.row.update(zip(new, range(start, start + len(new)), strict=True))
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(split):
            if words:
                out[i] = self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(0)
        return out


def judge(languages: Languages, sums: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, cross-entropy, rejected) of each row of sums."""
    n = sums[:, 0]
    if not languages.names:
        return [UNKNOWN] * len(n), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
    best = sums[:, 1:].argmax(1)
    total = sums[np.arange(len(n)), best + 1]
    score = np.where(n > 0, 1 / np.exp(np.minimum(sums[:, 1:] - total[:, None], 0)).sum(1), 0.0)
    entropy = -total / np.maximum(n, 1)
    rejected = (n == 0) | (languages.far(entropy, n, best) > languages.limit)
    return [languages.names[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], score, entropy, rejected


def _gram_counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = defaultdict(Counter)
        for batch in batches:
            for part in slices(batch):
                for text, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist(), strict=True):
                    words[lang].update(letter_runs(text))
        for lang, counts in words.items():
            grams: Counter[str] = Counter()
            for w, n in counts.items():
                s = START * (ORDER - 1) + w + END
                for i in range(len(w) + 1):
                    grams[s[i : i + ORDER]] += n
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    return sample.select("text", "lang").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Shared:
    """A broadcast with an identity that workers can compare."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def scorer(shared: Shared) -> Scorer:
    """The worker's scorer of these models."""
    return held(f"scorer {shared.id}", lambda: Scorer(shared.value))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Languages:
    """Models of every language of ``docs`` (doc_id, text, lang) outside the held-out fifth.

    About ``fit_docs`` labelled documents of each language are counted and ``calibration_docs`` others calibrate,
    chosen by a hash of doc_id; these bounds are what keeps the models of one size at any corpus size.
    """
    usable = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null").where("crc32(cast(doc_id as string)) % 5 != 0")
    per = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return Languages([], [], np.zeros(0))
    rank = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit((fit_docs + calibration_docs) / n)) for k, n in per.items()))
    picked = usable.withColumn("at", rank / F.least(share, F.lit(1.0))).where("at < 1")
    edge = fit_docs / (fit_docs + calibration_docs)
    rows = _gram_counts(picked.where(F.col("at") < edge)).toArrow().combine_chunks()
    names = sorted(k for k in per if k in set(rows["lang"].unique().to_pylist()))
    models = []
    for k in names:  # one language's table at a time
        own = rows.filter(pc.equal(rows["lang"], k)).sort_by("gram")
        models.append(Model.fit(own["gram"].to_pylist(), own["n"].to_numpy()))
    del rows
    languages = Languages(names, models, np.ones(len(names)))
    if not names:
        return languages
    shared = Shared(docs.sparkSession.sparkContext.broadcast(languages))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = scorer(shared).sums(batch["text"].to_pylist())
        own = np.array([languages_index.get(x, -1) for x in batch["lang"].to_pylist()])
        total = sums[np.arange(len(own)), own + 1]
        return pa.record_batch([pa.array(own), pa.array(sums[:, 0]), pa.array(-total / np.maximum(sums[:, 0], 1))], ["own", "n", "entropy"])

    languages_index = {k: i for i, k in enumerate(names)}
    found = map_batches(picked.where(F.col("at") >= edge).select("text", "lang"), measure, "own long, n double, entropy double").toPandas()
    found = found[(found["own"] >= 0) & (found["n"] > 0)]
    found = found.sort_values(["own", "n", "entropy"])  # any order of tasks gives one limit
    languages.calibrate(found["entropy"].to_numpy(), found["n"].to_numpy(), found["own"].to_numpy())
    return languages


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every row of ``docs`` (doc_id, text).

    A null text or one without a letter is ``und`` with score 0 and rejected; so is every text where no language
    was learned.  Ties go to the language first by name.  Texts of any length are read whole.  Repeated rows are judged each; a null
    doc_id is carried; an empty table gives no rows.
    """
    shared = Shared(docs.sparkSession.sparkContext.broadcast(languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score, entropy, rejected = judge(shared.value, scorer(shared).sums(part["text"].to_pylist()))
                cols = [part["doc_id"], pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)]
                yield pa.record_batch(cols, ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_known(docs: DataFrame, languages: Languages) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns unchanged.

    Null texts and texts without a letter go; repeated rows and rows without doc_id are judged by their text like any other; an empty table
    gives no rows.
    """
    shared = Shared(docs.sparkSession.sparkContext.broadcast(languages))

    def known(texts: list[str | None]) -> list[bool]:
        return (~judge(shared.value, scorer(shared).sums(texts))[3]).tolist()

    return texts_where(docs, "text", known)
