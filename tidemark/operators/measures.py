"""Statistics of use: shapes of queries, usage by several groupings, usefulness, retrieval quality, busiest hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import sql_shape
from tidemark.operators.series import first_of_each


def query_shapes(df: DataFrame, sql: str, seconds: str, failed: str) -> DataFrame:
    """Calls, errors, total and longest seconds by the shape of a query."""
    shaped = df.withColumn("shape", sql_shape(F.col(sql)))
    return shaped.groupBy(F.sha2("shape", 256).alias("shape_hash"), "shape").agg(
        F.count("*").alias("calls"), F.count_if(F.col(failed)).alias("errors"), F.sum(seconds).alias("total"), F.max(seconds).alias("longest")
    )


def usage(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Calls, total and nearest-rank p95 of ``value`` for several groupings in one pass over the data."""
    columns = sorted({c for s in sets for c in s})
    parts = [F.struct(F.lit(i).alias("grouping"), *((F.col(c).cast("string") if c in s else F.lit(None).cast("string")).alias(c) for c in columns)) for i, s in enumerate(sets)]
    long = df.select(F.col(value).alias("v"), F.explode(F.array(*parts)).alias("g"))
    return long.groupBy("g.grouping", *(f"g.{c}" for c in columns)).agg(
        F.count("*").alias("calls"), F.sum("v").alias("total"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95")
    )


def usefulness(given: DataFrame, ref: str, message: str, helpful: str, full: int = 5) -> DataFrame:
    """Per ref: distinct messages, helpful ones, the Laplace score (h + 1) / (n + 2) and its weight min(1, n / full)."""
    per = given.groupBy(ref, message).agg(F.max(F.col(helpful).cast("int")).alias("h"))
    n, h = F.count("*"), F.sum(F.coalesce("h", F.lit(0)))
    return per.groupBy(ref).agg(n.alias("n"), h.alias("n_helpful"), F.round((h + 1) / (n + 2), 6).alias("score"), F.least(F.lit(1.0), n / full).alias("weight"))


def retrieval_quality(ranks: DataFrame, rank: str) -> DataFrame:
    """hit@1, hit@3 and mean reciprocal rank; a null rank is a miss."""
    r = F.col(rank)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return ranks.agg(F.count("*").alias("n"), share(r <= 1).alias("hit_1"), share(r <= 3).alias("hit_3"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"))


def busiest_hours(df: DataFrame, service: str, time: str, k: int) -> DataFrame:
    """The ``k`` hours of the day with the highest median count of each service, beside its median daily count."""
    per_hour = df.groupBy(service, F.hour(time).alias("hour"), F.to_date(time).alias("day")).agg(F.count("*").cast("double").alias("n"))
    days = per_hour.groupBy(service, "day").agg(F.sum("n").alias("n")).groupBy(service).agg(F.median("n").alias("usual_day"))
    hours = per_hour.groupBy(service, "hour").agg(F.median("n").alias("usual_hour"))
    best = first_of_each(hours, [service], [F.desc("usual_hour"), F.asc("hour")], k)
    return best.join(days, service).select(service, "hour", "usual_hour", "usual_day", F.col("rn").cast("long").alias("rn"))


def priors(df: DataFrame, word: str, subject: str) -> DataFrame:
    """Association of words and subjects: n / (1 + all of the word)."""
    per = df.groupBy(word, subject).agg(F.count("*").alias("n"))
    total = per.groupBy(word).agg(F.sum("n").alias("total"))
    return per.join(total, word).select(word, subject, "n", F.round(F.col("n") / (1 + F.col("total")), 6).alias("prior"))
