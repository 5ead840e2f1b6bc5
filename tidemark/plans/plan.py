"""Typed query plans and their translation to DataFrames.

A plan is a list of steps; each filters one table, groups it by columns and a time bucket, computes measures with filters
of their own, orders and limits.  A condition may take its values from a column of an earlier step: that is a
semi-join, or an anti-join where the values are excluded, and nothing is collected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.series import histogram_quantile, increase_within, join_same

# The grammar.
COMPARISONS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in", "like", "not like", "is null", "is not null")
FUNCTIONS = ("count", "count_distinct", "sum", "avg", "min", "max", "share", "formula", "increase", "rate", "quantile", "ratio")
#: Functions that a measure's text may name, and the names they also go by.
SAID = {"count": "count", "avg": "avg", "average": "avg", "mean": "avg", "sum": "sum", "max": "max", "min": "min", "ratio": "ratio"}
#: Functions of the samples of counters.
OF_COUNTERS = ("increase", "rate", "quantile")
BUCKETS = ("minute", "5 minutes", "15 minutes", "hour", "day", "week", "month")
#: Seconds or bytes in a unit.
UNITS = {
    "time": {"us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0},
    "size": {"b": 1.0, "kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3, "tb": 1024.0**4},
}
#: What the last part of a column's name says of its unit.
SUFFIXES = {"us": "us", "ms": "ms", "s": "s", "sec": "s", "seconds": "s", "min": "min", "minutes": "min", "hours": "h", "days": "d", "bytes": "b", "kb": "kb", "mb": "mb", "gb": "gb"}
#: Measures by formula over the samples of a counter, and the label that ``field`` names where it is not given.
FORMULAS = {
    "cpu_busy_pct": ("mode", lambda label, kept: F.lit(100.0) * F.sum(F.when(kept & (F.col(label) != "idle"), F.col("rate"))) / F.sum(F.when(kept, F.col("rate")))),
    "availability_pct": (
        "code",
        lambda label, kept: F.lit(100.0)
        - F.lit(100.0) * F.coalesce(F.sum(F.when(kept & F.col(label).like("5%"), F.col("increase"))), F.lit(0.0)) / F.sum(F.when(kept, F.col("increase"))),
    ),
}


@dataclass(frozen=True)
class StepColumn:
    """The values of a column of an earlier step."""

    step: str
    column: str


@dataclass(frozen=True)
class Cond:
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Measure:
    label: str
    function: str
    field: str | None = None
    where: tuple[Cond, ...] = ()
    unit: tuple[str, str] | None = None
    formula: str | None = None
    q: float | None = None
    under: str | None = None


@dataclass(frozen=True)
class Counter:
    """What makes a table one of counter samples: the labels that name a series, the column that counts, and the label of a histogram's bounds."""

    labels: tuple[str, ...]
    value: str = "value"
    le: str = "le"


@dataclass(frozen=True)
class Step:
    name: str
    table: str
    measures: tuple[Measure, ...]
    by: tuple[str, ...] = ()
    where: tuple[Cond, ...] = ()
    time_field: str | None = None
    period: tuple[str, str] | None = None
    bucket: str | None = None
    order: str | None = None
    ascending: bool = False
    limit: int | None = None
    counter: Counter | None = None


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...] = field(default=())


def factor(source: str, target: str) -> float:
    """What a value in ``source`` units is multiplied by to be in ``target`` units of the same family."""
    for family in UNITS.values():
        if source in family and target in family:
            return family[source] / family[target]
    raise ValueError(f"no conversion from {source} to {target}")


def unit_of(column: str, known: dict[str, str] | None = None) -> str | None:
    """The unit of a column: as stated in ``known``, else by the last part of its name, else none."""
    return (known or {}).get(column) or SUFFIXES.get(column.lower().rsplit("_", 1)[-1])


def day_periods(conds: tuple[Cond, ...], schema: StructType) -> tuple[Cond, ...]:
    """Equality of a time column with a day, as the period from that day's begin to the next day's."""
    out: list[Cond] = []
    for c in conds:
        timed = c.field in schema.names and schema[c.field].dataType.typeName().startswith("timestamp")
        if timed and c.op == "=" and isinstance(c.value, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", c.value):
            out += [Cond(c.field, ">=", c.value), Cond(c.field, "<", (date.fromisoformat(c.value) + timedelta(days=1)).isoformat())]
        else:
            out.append(c)
    return tuple(out)


def typed(conds: tuple[Cond, ...], schema: StructType) -> tuple[Cond, ...]:
    """Conditions whose literals have their column's type, so that "37" meets a number as 37; patterns stay text."""

    def cast(c: Cond, v):
        return F.lit(v).cast(schema[c.field].dataType) if isinstance(v, str) and c.field in schema.names and schema[c.field].dataType.typeName() != "string" else v

    done = []
    for c in conds:
        if c.op in ("like", "not like", "is null", "is not null") or isinstance(c.value, StepColumn):
            done.append(c)
        else:
            done.append(replace(c, value=[cast(c, v) for v in c.value] if isinstance(c.value, (list, tuple)) else cast(c, c.value)))
    return tuple(done)


def validate(plan: Plan, columns: dict[str, list[str]]) -> list[str]:
    """What is wrong with a plan, in words; empty if it can run."""
    errors, seen = [], []
    for s in plan.steps:
        have = columns.get(s.table)
        if have is None:
            errors.append(f"{s.name}: no table {s.table}")
            continue
        if not s.measures:
            errors.append(f"{s.name}: no measure")
        if s.bucket and s.bucket not in BUCKETS:
            errors.append(f"{s.name}: no bucket {s.bucket}")
        if (s.bucket or s.period) and s.time_field not in have:
            errors.append(f"{s.name}: a bucket or a period needs a time field")
        if s.period and s.period[0] >= s.period[1]:
            errors.append(f"{s.name}: the period is empty")
        for c in (*s.where, *(c for m in s.measures for c in m.where)):
            if c.op not in COMPARISONS:
                errors.append(f"{s.name}: no comparison {c.op}")
            if isinstance(c.value, StepColumn) and c.value.step not in seen:
                errors.append(f"{s.name}: {c.value.step} does not come before")
        for f in (*s.by, *(c.field for c in s.where), *(f for m in s.measures for f in (m.field, m.under) if f)):
            if f not in have:
                errors.append(f"{s.name}: no column {f}")
        for m in s.measures:
            if m.function not in FUNCTIONS:
                errors.append(f"{s.name}: no function {m.function}")
            elif m.function not in ("count", "share", "formula", *OF_COUNTERS) and not m.field:
                errors.append(f"{s.name}: {m.function} needs a column")
            elif m.function == "share" and not m.where:
                errors.append(f"{s.name}: a share needs a condition")
            if m.function == "formula" and m.formula not in FORMULAS:
                errors.append(f"{s.name}: no formula {m.formula}")
            elif m.function in (*OF_COUNTERS, "formula") and not s.counter:
                errors.append(f"{s.name}: {m.function} needs a counter")
            elif m.function == "formula" and (m.field or FORMULAS[m.formula][0]) not in have:
                errors.append(f"{s.name}: {m.formula} needs a label {m.field or FORMULAS[m.formula][0]}")
            if m.function == "ratio" and not m.under:
                errors.append(f"{s.name}: a ratio needs two columns")
            if m.function == "quantile" and not (m.q and 0 < m.q < 1):
                errors.append(f"{s.name}: a quantile needs q between 0 and 1")
            elif m.function == "quantile" and s.counter and s.counter.le not in have:
                errors.append(f"{s.name}: a quantile needs a label {s.counter.le}")
        if s.counter:
            errors += [f"{s.name}: no column {f}" for f in (*s.counter.labels, s.counter.value) if f not in have]
            if s.time_field not in have:
                errors.append(f"{s.name}: a counter needs a time field")
        if s.order and s.order not in {m.label for m in s.measures} | set(s.by) | {"bucket"}:
            errors.append(f"{s.name}: no order {s.order}")
        seen.append(s.name)
    return errors


def condition(c: Cond) -> Column:
    """A comparison as a column: a list with = or != is membership; an empty list matches nothing, its negation everything."""
    col, value, op = F.col(c.field), c.value, c.op
    if isinstance(value, (list, tuple)) and op in ("=", "!="):
        op = "in" if op == "=" else "not in"
    if op == "is null":
        return col.isNull()
    if op == "is not null":
        return col.isNotNull()
    if op in ("in", "not in"):
        values = list(value) if isinstance(value, (list, tuple)) else [value]
        if not values:
            return F.lit(op == "not in")
        return col.isin(values) if op == "in" else ~col.isin(values)
    if op in ("like", "not like"):
        return col.like(value) if op == "like" else ~col.like(value)
    return {"=": col == value, "!=": col != value, ">": col > value, ">=": col >= value, "<": col < value, "<=": col <= value}[op]


def all_of(conds: tuple[Cond, ...]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & condition(c)
    return out


def bucket_of(time: str, bucket: str) -> Column:
    """The start of the bucket a time is in; days and longer by the calendar, weeks from Monday."""
    if bucket.endswith("minutes"):
        return F.window(time, bucket)["start"]
    return F.date_trunc(bucket, time).cast("timestamp_ntz")


def measure(m: Measure, counter: Counter | None = None) -> Column:
    kept = all_of(m.where)
    filtered = lambda name: F.when(kept, F.col(name)) if m.where else F.col(name)
    if m.function == "formula":
        label, formula = FORMULAS[m.formula]
        out = formula(m.field or label, kept)
    elif m.function == "share" and counter:
        out = F.lit(100.0) * F.sum(filtered("increase")) / F.sum("increase")
    elif m.function == "share" and m.field:
        out = F.lit(100.0) * F.avg(filtered(m.field)) / F.avg(m.field)
    elif m.function == "share":
        out = F.lit(100.0) * F.count_if(kept).cast("double") / F.count("*")
    elif m.function in ("increase", "rate"):
        out = F.sum(filtered(m.function))
    elif m.function == "ratio":  # over the rows that have both
        both = kept & F.col(m.field).isNotNull() & F.col(m.under).isNotNull()
        below = F.sum(F.when(both, F.col(m.under)))
        out = F.when(below != 0, F.sum(F.when(both, F.col(m.field))) / below)
    elif m.function == "count":
        out = F.count_if(kept) if m.where else F.count("*")
    else:
        out = {"count_distinct": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[m.function](filtered(m.field))
    return _in_unit(m, out).alias(m.label)


def measure_of(text: str, label: str | None = None) -> Measure:
    """The measure that a text names: ``count``, ``avg(F)``, ``sum(F)``, ``min(F)``, ``max(F)`` or ``ratio(A, B)``; any other, a median among them, is an error."""
    m = re.fullmatch(r"\s*([a-zA-Z]+)\s*(?:\(\s*([\w@.-]+)?\s*(?:,\s*([\w@.-]+)\s*)?\))?\s*", text)
    function = SAID.get(m[1].lower()) if m else None
    fields = [f for f in m.groups()[1:] if f] if m else []
    if function is None or len(fields) != {"count": 0, "ratio": 2}.get(function, 1):
        raise ValueError(f"no measure {text.strip()!r}: count, avg(F), sum(F), min(F), max(F) or ratio(A, B)")
    return Measure(label or "_".join([function, *fields]), function, fields[0] if fields else None, under=fields[1] if len(fields) > 1 else None)


def _in_unit(m: Measure, out: Column) -> Column:
    return out * factor(*m.unit) if m.unit else out


def _quantile(m: Measure, df: DataFrame, keys: list[str], counter: Counter) -> DataFrame:
    """A quantile measure by ``keys``: rates summed by bound, then the quantile inside the bucket."""
    rates = df.where(all_of(m.where)) if m.where else df
    rates = rates.groupBy(*keys, F.col(counter.le).cast("double").alias("__le")).agg(F.sum("rate").alias("__n"))
    found = histogram_quantile(rates.where("__le is not null and __n is not null"), keys, "__le", "__n", m.q)
    return found.select(*keys, _in_unit(m, F.col("quantile")).alias(m.label))


def _filtered(conds: tuple[Cond, ...], df: DataFrame, done: dict[str, DataFrame]) -> DataFrame:
    """``df`` where all conditions hold; those that take their values from a step are semi-joins and anti-joins."""
    plain = []
    for c in conds:
        if isinstance(c.value, StepColumn):
            values = done[c.value.step].select(F.col(c.value.column).alias("__value")).where("__value is not null")
            how = "left_anti" if c.op in ("!=", "not in") else "left_semi"
            df = df.join(values, F.col(c.field) == F.col("__value"), how)
        else:
            plain.append(c)
    return df.where(all_of(typed(day_periods(tuple(plain), df.schema), df.schema)))


def compile_step(step: Step, df: DataFrame, done: dict[str, DataFrame] | None = None) -> DataFrame:
    """The DataFrame of one step over its table; ``done`` are the earlier steps by name.

    Over a counter it has two levels: conditions on labels choose series, the increase and rate of each sample are found in its
    series, over restarts and from the sample before the period on, and then other conditions and measures see them as columns.
    """
    rest, counter = step.where, step.counter
    if counter:
        of_series = tuple(c for c in step.where if c.field in counter.labels)
        rest = tuple(c for c in step.where if c.field not in counter.labels)
        df = increase_within(_filtered(of_series, df, done or {}), list(counter.labels), step.time_field, counter.value, step.period)
    df = _filtered(rest, df, done or {})
    schema = df.schema
    if step.period and not counter:
        start, end = (F.lit(x).cast("timestamp_ntz") for x in step.period)
        df = df.where((F.col(step.time_field) >= start) & (F.col(step.time_field) < end))
    keys = list(step.by)
    if step.bucket:
        df, keys = df.withColumn("bucket", bucket_of(step.time_field, step.bucket)), ["bucket", *keys]
    measures = [replace(m, where=typed(day_periods(m.where, schema), schema)) for m in step.measures]
    plain = [measure(m, counter) for m in measures if m.function != "quantile"]
    out = df.groupBy(*keys).agg(*(plain or [F.count("*").alias("__n")]))
    for m in measures:
        if m.function == "quantile":
            out = join_same(out, _quantile(m, df, keys, counter), keys)
    out = out.select(*keys, *(m.label for m in measures))
    if step.order:
        first = F.col(step.order).asc() if step.ascending else F.col(step.order).desc()
        out = out.orderBy(first, *keys)
    elif step.bucket:
        out = out.orderBy(*keys)
    return out.limit(step.limit) if step.limit else out


def run_plan(plan: Plan, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All steps of a plan, lazily; later steps read earlier ones."""
    errors = validate(plan, {k: v.columns for k, v in tables.items()})
    if errors:
        raise ValueError("; ".join(errors))
    done: dict[str, DataFrame] = {}
    for step in plan.steps:
        done[step.name] = compile_step(step, tables[step.table], done)
    return done


def ruled(step: Step, rules: dict[str, dict[str, Cond]], lifted: tuple[str, ...] = ()) -> Step:
    """A step with the conditions that hold for its table by rule (table -> name -> condition), but for those the question lifts by name."""
    more = tuple(c for name, c in rules.get(step.table, {}).items() if name not in lifted)
    return replace(step, where=(*step.where, *more))
