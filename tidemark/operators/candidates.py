"""Candidates of a question from several ranked sources: one wide row of features each, ranked by weights learned from choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scratch import kept
from tidemark.operators.series import first_of_each

#: Pairs a choice makes at most with what was not chosen, and the learning's rate, pull towards one, rounds and bounds.
NEGATIVES, RATE, PULL, ROUNDS, MOST = 8, 0.05, 0.02, 4, 3.0
KEY = ["query_id", "candidate"]


def by_rank(hits: DataFrame) -> DataFrame:
    """(query_id, candidate, value): one over a hit's rank (``rn``)."""
    return hits.select(*KEY, (1.0 / F.col("rn")).alias("value"))


def by_score(hits: DataFrame) -> DataFrame:
    """(query_id, candidate, value): a hit's ``score`` as a share of its question's best."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return hits.join(best, "query_id").select(*KEY, F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0).alias("value"))


def features(sources: dict[str, DataFrame]) -> DataFrame:
    """(query_id, candidate, a column a source): the largest value that each source (query_id, candidate, value) gives a candidate, 0 without one.

    One aggregation serves all sources; their names are given, so no pass looks for them.
    """
    long = reduce(DataFrame.unionByName, [df.select(*KEY, F.lit(name).alias("feature"), F.col("value").cast("double").alias("value")) for name, df in sources.items()])
    largest = [F.coalesce(F.max(F.when(F.col("feature") == name, F.col("value"))), F.lit(0.0)).alias(name) for name in sources]
    return long.groupBy(*KEY).agg(*largest)


def scored(wide: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``wide`` with ``score``, the weighted sum of its features, and ``rn``, the place among the candidates of its question."""
    total = reduce(lambda a, b: a + b, (F.col(f) * w for f, w in weights.items()))
    return first_of_each(wide.withColumn("score", F.round(total, 9)), ["query_id"], [F.desc("score"), F.asc("candidate")], 1 << 30)


def choices(wide: DataFrame, chosen: DataFrame, names: list[str], negatives: int = NEGATIVES) -> DataFrame:
    """(a column a feature) the differences of a chosen candidate (``chosen``: query_id, candidate) and of ones not chosen, ``negatives`` a choice by a hash."""
    marked = kept(wide.join(chosen.select(*KEY).distinct().withColumn("chosen", F.lit(True)), KEY, "left"))
    good = marked.where("chosen").select("query_id", F.col("candidate").alias("good"), *(F.col(f).alias(f"good_{f}") for f in names))
    poor = first_of_each(marked.where("chosen is null"), ["query_id"], [F.xxhash64(*KEY).asc(), F.asc("candidate")], negatives)
    return good.join(poor, "query_id").select(*((F.col(f"good_{f}") - F.col(f)).alias(f) for f in names))


def learned(pairs: DataFrame, names: list[str], rounds: int = ROUNDS, rate: float = RATE, pull: float = PULL) -> dict[str, float]:
    """Weights by which chosen candidates come before others: logistic steps over all ``pairs``, pulled towards one and kept within 0 and MOST.

    A round is one aggregation; the driver gets a number a feature.
    """
    pairs, weights = kept(pairs), dict.fromkeys(names, 1.0)
    for _ in range(rounds):
        lead = reduce(lambda a, b: a + b, (F.col(f) * w for f, w in weights.items()))
        step = pairs.agg(*(F.avg(F.col(f) / (1 + F.exp(lead))).alias(f) for f in names)).first()
        weights = {f: min(MOST, max(0.0, w + rate * (step[f] or 0.0) - pull * (w - 1))) for f, w in weights.items()}
    return weights


def mean_reciprocal_rank(ranked: DataFrame, chosen: DataFrame) -> float:
    """Over the questions of ``chosen``: one over the place of the first chosen candidate, 0 where none is ranked."""
    best = ranked.join(chosen.select(*KEY).distinct(), KEY, "left_semi").groupBy("query_id").agg(F.min("rn").alias("rn"))
    asked = chosen.select("query_id").distinct().join(best, "query_id", "left")
    return float(asked.agg(F.avg(F.coalesce(1.0 / F.col("rn"), F.lit(0.0)))).first()[0] or 0.0)
