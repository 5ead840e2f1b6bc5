"""Learning what tables hold: column profiles, changes between two of them, join keys by shared values, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Join keys and changes.
MOST_COLUMNS = 50
LEAST_COVERAGE = 0.6
CHANGE_RATIO, CHANGE_DIFFERENCE = 2.0, 10


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_filled, n_distinct, least, most): one scan for all columns; least and most by text order."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.column", "p.v")
    per = long.groupBy("column", "v").agg(F.count("*").alias("n"))  # distinct values before the column totals: no column in one task
    return per.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_filled"), F.count("v").alias("n_distinct"),
        F.min("v").alias("least"), F.max("v").alias("most"),
    )


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent values of each column (ties by value), with their counts."""
    from tidemark.operators.series import first_of_each

    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    per = df.select(F.explode(F.array(*parts)).alias("p")).select("p.column", "p.v").where("v is not null").groupBy("column", "v").count()
    return first_of_each(per, ["column"], [F.desc("count"), F.asc("v")], k)


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric digest of a result: (column, least, most, mean, total, n_blank)."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.sum(v).alias("total"), F.count_if(F.col(c).isNull()).alias("n_blank")))
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each column between two profiles: new, gone, cardinality or same."""
    a, b = before.select("column", F.col("n_distinct").alias("old")), after.select("column", F.col("n_distinct").alias("now"))
    far = (F.greatest("old", "now") >= CHANGE_RATIO * F.least("old", "now")) & (F.abs(F.col("old") - F.col("now")) >= CHANGE_DIFFERENCE)
    what = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "gone").when(far, "cardinality").otherwise("same")
    return a.join(b, "column", "full_outer").select("column", "old", "now", what.alias("change"))


def object_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, change, was, is_now): what became of objects (key, type, unit, cardinality, gone) between two learnings, a row a change.

    ``new`` and ``gone``; ``back`` for one that was marked gone; ``type`` and ``unit`` where both say one and they differ; ``cardinality``
    CHANGE_RATIO-fold and by CHANGE_DIFFERENCE, or to or from none by as many.  An object may change in several ways.
    """
    facts = ("type", "unit", "cardinality", "gone")
    a, b = (df.select(*key, *(F.col(c).alias(f"{side}_{c}") for c in facts), F.lit(True).alias(f"{side}_there")) for side, df in (("a", before), ("b", after)))
    both = a.join(b, key, "full")
    there = lambda side: F.coalesce(F.col(f"{side}_there"), F.lit(False)) & ~F.coalesce(F.col(f"{side}_gone"), F.lit(False))
    old, now = F.col("a_cardinality").cast("double"), F.col("b_cardinality").cast("double")
    low, high = F.least(old, now), F.greatest(old, now)
    far = F.when(low <= 0, (old != now) & (high >= CHANGE_DIFFERENCE)).otherwise((high >= CHANGE_RATIO * low) & (high - low >= CHANGE_DIFFERENCE))
    same = there("a") & there("b")
    text = lambda c: F.col(c).cast("string")
    row = lambda what, when, was, now: F.when(when, F.struct(F.lit(what).alias("change"), was.alias("was"), now.alias("is_now")))
    none = F.lit(None).cast("string")
    rows = F.array(
        row("new", F.col("a_there").isNull() & there("b"), none, text("b_type")), row("gone", there("a") & ~there("b"), text("a_type"), none),
        row("back", F.coalesce(F.col("a_gone"), F.lit(False)) & there("b"), none, text("b_type")), row("type", same & (F.col("a_type") != F.col("b_type")), text("a_type"), text("b_type")),
        row("unit", same & (F.col("a_unit") != F.col("b_unit")), text("a_unit"), text("b_unit")), row("cardinality", same & far, text("a_cardinality"), text("b_cardinality")),
    )
    return both.select(*key, F.inline(F.filter(rows, lambda x: x.isNotNull())))


def value_overlap(columns: dict[str, DataFrame]) -> DataFrame:
    """Pairs of columns (each a one-column frame) that share values: likely join keys.

    Values in more than MOST_COLUMNS columns say nothing; a pair needs 2 common values, 3 if the smaller side has over
    3, and LEAST_COVERAGE of the smaller side.  The inverted index holds distinct values only.
    """
    long = None
    for name, df in columns.items():
        part = df.select(F.lit(name).alias("column"), F.col(df.columns[0]).cast("string").alias("v")).where("v is not null").distinct()
        long = part if long is None else long.unionByName(part)
    sizes = long.groupBy("column").agg(F.count("*").alias("n"))
    few = long.groupBy("v").agg(F.sort_array(F.collect_list("column")).alias("cols")).where((F.size("cols") > 1) & (F.size("cols") <= MOST_COLUMNS))
    pairs = few.select(F.explode(F.expr("flatten(transform(cols, (x, i) -> transform(slice(cols, i + 2, size(cols)), y -> struct(x as a, y as b))))")).alias("p"))
    common = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("common"))
    a, b = (F.broadcast(sizes.select(F.col("column").alias(c), F.col("n").alias(f"n_{c}"))) for c in "ab")  # a row a column
    smaller = F.least("n_a", "n_b")
    enough = F.col("common") >= F.when(smaller > 3, 3).otherwise(2)
    found = common.join(a, "a").join(b, "b").where(enough & (F.col("common") / smaller >= LEAST_COVERAGE))
    return found.select("a", "b", "common", (F.col("common") / smaller).alias("coverage"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Whether joining on ``key`` multiplies rows: rows, distinct keys, and how many rows the worst key has."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.max("n").alias("most"), F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("repeats"))


def gone(stored: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return stored.join(seen.select(key).distinct(), key, "left_anti")


def seen_together(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def delta(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, change): added, removed, changed or same by a hash of the content."""
    mark = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content)), 256)
    a, b = old.select(key, mark.alias("x")), new.select(key, mark.alias("y"))
    what = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, what.alias("change"))


def kind_of(columns: list[str]) -> str:
    """What a table is by its column names: spans, alerts, logs, events or inventory."""
    low = {c.lower() for c in columns}
    has = lambda *names: any(n in c for c in low for n in names)
    if has("spanid", "span_id") or (has("traceid", "trace_id") and has("duration")):
        return "spans"
    if has("alert", "severity") and has("status", "state"):
        return "alerts"
    if has("message", "msg") and has("level", "logger", "ts", "time"):
        return "logs"
    if has("ts", "time", "date"):
        return "events"
    return "inventory"
