"""Answers held against results: numbers they state, values that follow from a result, generic questions, agreement of two computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.plan import UNITS

#: Typographic characters and what stands for them.
MARKS, PLAIN = "‘’‚“”„‐‑‒–—  ", "'''\"\"\"-----  "
#: A number and a unit that may follow it.
NUMBER = r"([0-9]+(?:\.[0-9]+)?)(?: ?(%|us|ms|min|kb|mb|gb|tb)\b)?"
TOLERANCE = 0.005
#: What a question is about, with a placeholder.
CASES = ((r"'[^']*'", "<value>"), (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "<day>"), (r"[0-9]+(\.[0-9]+)?", "<number>"), (r"\s+", " "))


def plain_signs(c: Column) -> Column:
    """Curly quotes, dashes and hard blanks as plain ones."""
    return F.translate(c, MARKS, PLAIN)


def number_text(c: Column, places: int = 2) -> Column:
    """A number with separated thousands, "-" where there is none."""
    return F.coalesce(F.format_number(c, places), F.lit("-"))


def numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, value, unit, base): every number of a text; ``base`` is in seconds, bytes or the number itself."""
    low = F.lower(F.col(text))
    values, units = F.regexp_extract_all(low, F.lit(NUMBER), 1), F.regexp_extract_all(low, F.lit(NUMBER), 2)
    found = df.select(key, F.posexplode(F.arrays_zip(values.alias("x"), units.alias("u"))).alias("place", "n"))
    factors = F.create_map(*(F.lit(x) for family in UNITS.values() for pair in family.items() for x in pair))
    value = F.col("n.x").cast("double")
    return found.select(key, "place", value.alias("value"), F.col("n.u").alias("unit"), (value * F.coalesce(F.element_at(factors, F.col("n.u")), F.lit(1.0))).alias("base"))


def derived(result: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """A result with what an answer may rightly say of it: running sums, shares of the group, differences and ratios to the row before."""
    group = Window.partitionBy(*by)
    w = group.orderBy(order)
    before = F.lag(value).over(w)
    return result.select(
        *by, order, value,
        F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), (F.col(value) / F.sum(value).over(group)).alias("share"),
        (F.col(value) - before).alias("difference"), F.when(before != 0, F.col(value) / before).alias("ratio"),
    )


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, a, b, verdict): whether two computations of ``value`` agree within TOLERANCE, key by key."""
    both = a.select(*keys, F.col(value).cast("double").alias("a")).join(b.select(*keys, F.col(value).cast("double").alias("b")), keys, "full")
    near = F.abs(F.col("a") - F.col("b")) <= TOLERANCE * F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-9))
    return both.withColumn("verdict", F.when(F.col("a").isNull(), "only b").when(F.col("b").isNull(), "only a").when(near, "agree").otherwise("differ"))


def generic(question: Column) -> Column:
    """A question without its quoted values, days and numbers."""
    for pattern, by in CASES:
        question = F.regexp_replace(question, pattern, by)
    return F.trim(F.lower(question))


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, which JSON can say."""
    real = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c in real})
