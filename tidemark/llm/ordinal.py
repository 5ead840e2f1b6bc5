"""Quality classifier: ordinal cumulative-link regression on hashed text.

A rating of 0 .. K has K ascending thresholds and one weight vector for all of them: P(rating >= k) is the logistic
function of the text's score less the k-th threshold.  Features are the square roots of relative token frequencies, hashed into ``DIM``
places, so every text has length one whatever its size; a token that repeats the one before it also counts as such.
The expected rating and the tail probability P(rating >= K) select texts.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, slices

DIM = 1 << 18
TOKENS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
REPEAT = DIM - 1
#: At most about so many labelled rows are fitted, chosen by a hash of doc_id.
FIT_ROWS = 12_000
#: Of those, as many as hold about so many characters.
FIT_CHARS = 100_000_000
#: Tokens in fewer fitted texts get no weight.
LEAST_TEXTS = 5
STEPS = 150
RATE = 0.5
RIDGE = 1e-4
MOST_TOKENS = 300_000


class Places(dict):
    """Hashed place of a token, remembered; emptied when it grows past MOST_TOKENS."""

    def __missing__(self, token: str) -> int:
        place = self[token] = xxhash.xxh3_64_intdigest(token) % (DIM - 1)
        return place


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places ascending, values) of a text; both empty where it has no token."""
    tokens = TOKENS.findall((text or "").lower())
    places = held("places", Places)
    if len(places) > MOST_TOKENS:
        places.clear()
    at, times = np.unique(np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens)), return_counts=True)
    again = sum(map(operator.eq, tokens[1:], tokens))
    if again:
        at, times = np.append(at, REPEAT), np.append(times, again)
    return at, np.sqrt(times / max(len(tokens), 1))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(rows, K): P(rating >= 1), ..., P(rating >= K)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def score(self, text: str | None) -> float:
        at, value = features(text)
        return float(self.weights[at] @ value)


def learn(rows: list[np.ndarray], values: list[np.ndarray], ratings: np.ndarray, top: int) -> Ordinal:
    """Maximum of the ridge-penalised likelihood by Adam on all rows at once.

    Features count by their inverse document frequency among the rows; ratings count by the root of their rarity.
    """
    if not len(ratings):
        return Ordinal(np.zeros(DIM, np.float32), np.zeros(top) + np.linspace(-1, 1, top))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place, value = np.concatenate(rows), np.concatenate(values)
    texts = np.bincount(place, minlength=DIM)
    common = texts[place] >= LEAST_TEXTS
    owner, place, value = owner[common], place[common], value[common]
    rarity = np.log((1 + len(rows)) / (1 + texts))
    value = value * rarity[place]
    used, place = np.unique(place, return_inverse=True)
    count = np.bincount(ratings, minlength=top + 1)
    cost = np.sqrt(len(ratings) / np.maximum(count, 1) / (count > 0).sum())[ratings]
    n, m = len(ratings), len(used)
    # The first threshold is free and the gaps after it are exponentials, so thresholds stay in order.
    p = np.concatenate([np.zeros(m), [-1.0], np.zeros(top - 1)])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        cuts = np.cumsum(np.concatenate([p[m : m + 1], np.exp(p[m + 1 :])]))
        score = np.bincount(owner, p[place] * value, n)
        tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))
        tail = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
        i = np.arange(n)
        upper, lower = tail[i, ratings], tail[i, ratings + 1]
        likely = np.maximum(upper - lower, 1e-9)
        slope_up, slope_low = upper * (1 - upper), lower * (1 - lower)
        d_score = -cost * (slope_up - slope_low) / likely / n
        d_cuts = np.zeros(top)
        for k in range(top):
            d_cuts[k] = (cost * slope_up / likely)[ratings == k + 1].sum() / n - (cost * slope_low / likely)[ratings == k].sum() / n
        after = np.cumsum(d_cuts[::-1])[::-1]
        g = np.concatenate([np.bincount(place, d_score[owner] * value, m) + RIDGE * p[:m], after[:1], after[1:] * np.exp(p[m + 1 :])])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p = p - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIM, np.float32)
    weights[used] = p[:m] * rarity[used]
    return Ordinal(weights, np.cumsum(np.concatenate([p[m : m + 1], np.exp(p[m + 1 :])])))


def fit(docs: DataFrame, ratings: DataFrame, top: int, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Ordinal:
    """The model of ``ratings`` (doc_id, rating 0 .. top) on the texts of ``docs``.

    ``fit_rows`` bounds the rated rows that are fitted and ``fit_chars`` their text, which is what the driver gathers; both are chosen by a hash of
    doc_id.  Null texts and ratings are left out; a doc_id rated twice is fitted with each rating, and so is each of its texts.  Without a
    rated row all weights are zero.
    """
    rated = ratings.where("rating is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("rating").cast("int"))
    share = fit_rows / max(rated.count(), 1)
    picked = rated.where(F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    # ``picked`` holds about ``fit_rows`` short rows at most, whatever the corpus size: that bound makes it safe to broadcast.
    chosen = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("__id", "text", "rating")

    chars = chosen.agg(F.sum(F.length("text"))).first()[0] or 1
    chosen = chosen.where(F.pmod(F.xxhash64(F.lit(4), "__id"), F.lit(1 << 40)) < int(min(1.0, fit_chars / chars) * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [features(t) for t in batch["text"].to_pylist()]
            places = pa.array([a for a, _ in both], pa.list_(pa.int64()))
            yield pa.record_batch([batch["rating"], places, pa.array([v for _, v in both], pa.list_(pa.float64()))], ["rating", "place", "value"])

    table = chosen.select("rating", "text").mapInArrow(run, "rating int, place array<long>, value array<double>").toArrow()
    lists = [[x.values.to_numpy() for x in table[c]] for c in ("place", "value")]
    rows = table["rating"].to_numpy()
    by = sorted(range(len(rows)), key=lambda i: (rows[i], lists[0][i].tobytes(), lists[1][i].tobytes()))  # any order of tasks gives one model
    return learn([lists[0][i] for i in by], [lists[1][i] for i in by], rows[by].astype(np.int64), top)


def rate(docs: DataFrame, model: Ordinal, least_tail: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every row of ``docs`` (doc_id, text).

    ``kept`` where the tail probability is ``least_tail`` or more, so a tie with the limit is kept.  A null or empty text scores 0; texts of any
    length are read whole.  Repeated rows are
    rated each; a null doc_id is carried; an empty table gives no rows.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                tails = m.tails(np.array([m.score(t) for t in part["text"].to_pylist()]))
                cols = [part["doc_id"], pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least_tail)]
                yield pa.record_batch(cols, ["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, rating) of ``labels`` (doc_id, quality, toxic): 0 toxic, 1 poor, 2 good; null where neither is known."""
    rating = F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNotNull(), F.when(F.col("quality") > 0, 2).otherwise(1))
    return labels.groupBy("doc_id").agg(F.min(rating).alias("rating"))
