"""Records and their fields: which tables tell of a value, what two sides differ in, frames of a window, what retired, holders of holders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scratch import kept
from tidemark.operators.series import first_of_each, join_same


def records_about(fields: list[tuple[str, DataFrame, str, str]], wanted: DataFrame) -> DataFrame:
    """(source, field, record): the records of every (source, table, field, key) of which the field holds a value of ``wanted`` (value); fields may differ in type."""
    values = kept(wanted.select(F.col("value").cast("string").alias("_value")).distinct())
    parts = [
        df.select(F.lit(source).alias("source"), F.lit(field).alias("field"), F.col(key).cast("string").alias("record"), F.col(field).cast("string").alias("_value")).join(values, "_value", "left_semi").drop("_value")
        for source, df, field, key in fields
    ]
    return reduce(DataFrame.unionByName, parts)


def sides(rows: DataFrame, side: str, value: str, a: str, b: str) -> DataFrame:
    """(side, value): ``adds`` what side ``a`` has and ``b`` has not, ``leaves out`` the reverse; one aggregation of both sides."""
    both = rows.where(F.col(side).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.max(F.col(side) == a).alias("in_a"), F.max(F.col(side) == b).alias("in_b"))
    return both.where("in_a != in_b").select(F.when(F.col("in_a"), "adds").otherwise("leaves out").alias("side"), value)


def frames(df: DataFrame, by: list[str], time: str, first: str, days: int, n: int, tie: str) -> DataFrame:
    """``df`` cut into frames of ``days`` from the day ``first`` on (``frame``), the latest ``n`` rows of each frame and group, by place (``rn``)."""
    frame = F.floor(F.datediff(F.to_date(time), F.lit(first).cast("date")) / days)
    return first_of_each(df.withColumn("frame", frame), [*by, "frame"], [F.desc(time), F.asc(tie)], n)


def same_weekdays(df: DataFrame, by: list[str], time: str, day: str, weeks: int) -> DataFrame:
    """(weeks_back, by, n): rows of a day and of the same weekday of ``weeks`` weeks before, in one scan."""
    back = F.datediff(F.lit(day).cast("date"), F.to_date(time))
    rows = df.withColumn("_back", back).where((F.col("_back") % 7 == 0) & F.col("_back").between(0, 7 * weeks))
    return rows.groupBy(F.floor(F.col("_back") / 7).alias("weeks_back"), *by).agg(F.count("*").alias("n"))


def localizing_fields(df: DataFrame, fields: list[str], filled: float = 0.5, own: float = 0.5) -> DataFrame:
    """(field, filled, n_values, localizes): which fields can say where a change lies: filled in enough rows, several values, not nearly one a row.

    Values are counted by field in two aggregations, so no field's distinct values meet in one task.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in fields))).alias("p")).select("p.*")
    per = long.groupBy("field", "v").agg(F.count("*").alias("n"))
    each = per.groupBy("field").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.count("v").alias("n_values"))
    good = (F.col("n") >= filled * F.col("rows")) & (F.col("n_values") > 1) & (F.col("n_values") < own * F.col("n"))
    return each.select("field", F.round(F.col("n") / F.col("rows"), 6).alias("filled"), "n_values", good.alias("localizes"))


def usual_counts(df: DataFrame, by: list[str], time: str, first: str, until: str, least_days: int) -> DataFrame:
    """(by, n_days, usual): groups with rows on ``least_days`` days of [first, until), and the median of their rows a day."""
    rows = df.where((F.col(time) >= F.lit(first).cast("timestamp_ntz")) & (F.col(time) < F.lit(until).cast("timestamp_ntz")))
    days = rows.groupBy(*by, F.to_date(time).alias("_day")).agg(F.count("*").alias("n"))
    return days.groupBy(*by).agg(F.count("*").alias("n_days"), F.median("n").alias("usual")).where(F.col("n_days") >= least_days)


def lift_of(df: DataFrame, fields: list[str], focus: Column) -> DataFrame:
    """(field, value, n_all, n_focus, lift): how much more often each value of the fields, own or joined, is in the focus than overall."""
    long = df.select(focus.alias("f"), F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields))).alias("p"))
    per = long.groupBy("p.field", "p.value").agg(F.count("*").alias("n_all"), F.count_if("f").alias("n_focus"))
    total = per.groupBy("field").agg(F.sum("n_all").alias("_n"), F.sum("n_focus").alias("_f"))
    return per.join(total, "field").select("field", "value", "n_all", "n_focus", F.round((F.col("n_focus") / F.col("_f")) / (F.col("n_all") / F.col("_n")), 6).alias("lift"))


def associations(rows: DataFrame, subject: str, words: Column, least: int) -> DataFrame:
    """(subject, term, n): the terms that ``least`` rows of a subject hold, each row once."""
    terms = rows.select(subject, F.explode(F.array_distinct(words)).alias("term"))
    return terms.groupBy(subject, "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)


#: How a text says that a part is no more, in English and French.
RETIRED = r"(?i)(\b(retired|decommissioned|shut down|switched off|no longer (used|exists)|replaced by)\b|\b(d[ée]commissionn|arr[êe]t|n'est plus utilis)[ée]e?s?(?=[\s.,;:!?]|$))"


def retired(seen: DataFrame, part: str, time: str, days: int, said: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(part, last_seen, why): parts without a row in the ``days`` before the newest row (silent), or of which a text of ``said`` (part, text) says so.

    Both come as ``silent and said``; a part that only texts know has no last_seen.
    """
    newest = seen.agg(F.max(time).alias("_newest"))
    last = seen.groupBy(part).agg(F.max(time).alias("last_seen")).join(F.broadcast(newest), how="cross")  # one row
    last = last.withColumn("_silent", F.col("last_seen") < F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")
    if said is None:
        return last.where("_silent").select(part, "last_seen", F.lit("silent").alias("why"))
    told = said.where(F.col(text).rlike(RETIRED)).select(part).distinct().withColumn("_told", F.lit(True))
    both = last.join(told, part, "full").where("_silent or _told")
    why = F.when(F.col("_silent") & F.col("_told"), "silent and said").when(F.col("_told"), "said").otherwise("silent")
    return both.select(part, "last_seen", why.alias("why"))


def lineage(start: DataFrame, holders: DataFrame, most: int = 50) -> DataFrame:
    """(node, lineage, depth): the holders of each of ``start`` (node), outermost first, through ``holders`` (node, holder) of any depth.

    A node has one holder, the first by name of several; a round goes one holder up for all that have one, and a holder that is in the
    chain already ends it.
    """
    up = kept(holders.where("holder is not null").groupBy("node").agg(F.min("holder").alias("holder")))
    live = kept(start.select("node", F.col("node").alias("top"), F.array("node").alias("chain")).distinct())
    done = []
    for _ in range(most):
        grown = kept(join_same(live, up.toDF("top", "holder"), ["top"]).withColumn("goes_on", F.coalesce(~F.array_contains("chain", F.col("holder")), F.lit(False))))
        done.append(grown.where("not goes_on").select("node", F.col("chain").alias("lineage"), (F.size("chain") - 1).alias("depth")))
        live = grown.where("goes_on").select("node", F.col("holder").alias("top"), F.concat(F.array("holder"), "chain").alias("chain"))
        if live.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError("holders did not end")
