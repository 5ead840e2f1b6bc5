"""Time series: counters, quantiles from histograms, excursions beyond a threshold, usual values of earlier windows.

A series is the rows of one combination of label columns; nothing gathers a series into an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# When a value differs from its usual.
WEEKS_NEEDED = 3
DEVIATIONS = 3.5
CHANGE = 0.20
LEAST_SCALE = 0.05
BAND = (0.77, 1.3)
RECURS = 0.6


def _over(labels: list[str], time: str) -> Window:
    return Window.partitionBy(*labels).orderBy(time)


def _micros(time: str, df: DataFrame) -> Column:
    """A time column as microseconds; a number counts as such."""
    kind = df.schema[time].dataType.typeName()
    return F.unix_micros(F.col(time).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date", "string") else F.col(time).cast("long")


def join_same(left: DataFrame, right: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with the other columns of ``right`` on ``columns``, null with null."""
    names = {c: f"__of_{c}" for c in columns}
    right = right.select(*(F.col(c).alias(names.get(c, c)) for c in right.columns))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()), F.lit(True))
    return left.join(right, same, how).drop(*names.values())


def with_before(df: DataFrame, labels: list[str], time: str, value: str, chunk: int = 86_400) -> DataFrame:
    """``df`` with ``__before`` and ``__before_at``: value and time (microseconds) of the sample before, in order of time, then value.

    Samples are looked at inside chunks of ``chunk`` seconds, so that a series of any length is spread over tasks; what stands before the
    first sample of a chunk is the last one of the series' chunk before, found among one row a series and chunk.
    """
    rows = df.withColumn("__at", _micros(time, df)).withColumn("__chunk", F.floor(F.col("__at") / (chunk * 1_000_000)))
    sample = F.struct(F.col("__at").alias("at"), F.col(value).alias("v"))
    ends = rows.groupBy(*labels, "__chunk").agg(F.max(sample).alias("last"))
    ends = ends.select(*labels, "__chunk", F.lag("last").over(_over(labels, "__chunk")).alias("__edge"))
    keys = [*labels, "__chunk"]
    edged = join_same(rows, ends, keys)
    w = Window.partitionBy(*keys).orderBy("__at", value)
    found = edged.withColumn("__prior", F.coalesce(F.lag(sample).over(w), F.col("__edge")))
    return found.select(*df.columns, "__at", F.col("__prior.v").alias("__before"), F.col("__prior.at").alias("__before_at"))


def increase(df: DataFrame, labels: list[str], time: str, value: str, chunk: int = 86_400) -> DataFrame:
    """``increase`` and ``rate`` (a second) since the sample before; a smaller value means the counter began anew."""
    found, before = with_before(df, labels, time, value, chunk), F.col("__before")
    grown = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    seconds = (F.col("__at") - F.col("__before_at")) / 1e6
    return found.select(*df.columns, grown.alias("increase"), F.when(seconds > 0, grown / seconds).alias("rate"))


def increase_within(df: DataFrame, labels: list[str], time: str, value: str, period: tuple[str, str] | None, chunk: int = 86_400) -> DataFrame:
    """:func:`increase` of the samples of ``period``, the first of each series measured from its last sample before it.

    Of what lies before the period only one row a series is kept, by an aggregation that combines before it shuffles.
    """
    if period is None:
        return increase(df, labels, time, value, chunk)
    start, end = (F.lit(x).cast("timestamp_ntz") for x in period)
    inside = df.where((F.col(time) >= start) & (F.col(time) < end))
    earlier = df.where(F.col(time) < start).groupBy(*labels).agg(F.max_by(F.struct(*df.columns), F.struct(time, value)).alias("__row"))
    return increase(inside.unionByName(earlier.select("__row.*")), labels, time, value, chunk).where(F.col(time) >= start)


def changes(df: DataFrame, labels: list[str], time: str, value: str, chunk: int = 86_400) -> DataFrame:
    """How often each series changed and fell."""
    marked = with_before(df, labels, time, value, chunk)
    marked = marked.select(*labels, (F.col(value) != F.col("__before")).alias("c"), (F.col(value) < F.col("__before")).alias("r"))
    return marked.groupBy(*labels).agg(F.count_if("c").alias("n_changes"), F.count_if("r").alias("n_resets"), F.count("*").alias("n_samples"))


def _behind(df: DataFrame, labels: list[str], time: str, seconds: int, columns: dict) -> DataFrame:
    """``df`` with ``columns`` (name: function of a window) over the ``seconds`` up to each row.

    Time is cut into chunks of a day or of ``seconds``, and every row also goes to the next chunk as what lies behind it: a series of any
    length is spread over tasks.
    """
    size = max(86_400, seconds) * 1_000_000
    at = df.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("__own", F.floor(F.col("__at") / size))
    both = at.withColumn("__chunk", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    w = Window.partitionBy(*labels, "__chunk").orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    found = both.select("*", *(f(w).alias(name) for name, f in columns.items()))
    return found.where(F.col("__chunk").eqNullSafe(F.col("__own"))).drop("__at", "__own", "__chunk")


def over_time(df: DataFrame, labels: list[str], time: str, value: str, seconds: int) -> DataFrame:
    """Average, least and largest value of the ``seconds`` up to each sample.

    Time is cut into chunks of ``seconds``: behind a sample lie the beginning of its own chunk and the end of the chunk before, whose samples
    also stand in the next chunk at the last moment that still sees them.  Both are running aggregates, so a sample costs the same
    however many lie in its window.
    """
    size = seconds * 1_000_000
    own = df.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
    own = own.withColumn("__chunk", F.floor((F.col("__at") - F.pmod("__at", F.lit(size))) / size)).withColumn("__v", F.col(value)).withColumn("__past", F.lit(False))
    past = own.where("__at is not null").select(*labels, (F.col("__at") + size).alias("__at"), (F.col("__chunk") + 1).alias("__chunk"), "__v", F.lit(True).alias("__past"))
    both = own.unionByName(past, allowMissingColumns=True)
    w = Window.partitionBy(*labels, "__chunk").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sides = ((F.when(~F.col("__past"), F.col("__v")), w.orderBy("__at")), (F.when(F.col("__past"), F.col("__v")), w.orderBy(F.desc("__at"))))
    run = {f"__{name}_{i}": f(v).over(o) for i, (v, o) in enumerate(sides) for name, f in (("sum", lambda v: F.sum(v.cast("double"))), ("n", F.count), ("min", F.min), ("max", F.max))}
    two = lambda name: (F.col(f"__{name}_0"), F.col(f"__{name}_1"))
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in two("sum")))
    n = reduce(lambda a, b: a + b, two("n"))
    found = both.select("*", *(c.alias(name) for name, c in run.items())).where("not __past")
    return found.select(*df.columns, F.when(n > 0, total / n).alias("avg_over"), F.least(*two("min")).alias("min_over"), F.greatest(*two("max")).alias("max_over"))


def histogram_quantile(df: DataFrame, by: list[str], le: str, count: str, q: float) -> DataFrame:
    """The q-quantile of cumulative buckets (``le`` upper bound, ``count`` up to it), linear inside the bucket; the last bound in the open one."""
    w = Window.partitionBy(*by).orderBy(le)
    total = F.max(count).over(Window.partitionBy(*by))
    marked = df.select(
        *by, F.col(le).alias("le"), F.col(count).cast("double").alias("n"), total.cast("double").alias("total"),
        F.coalesce(F.lag(le).over(w), F.lit(0.0)).alias("low"), F.coalesce(F.lag(count).over(w), F.lit(0)).cast("double").alias("below"),
    )
    reached = marked.where((F.col("n") >= q * F.col("total")) & (F.col("total") > 0))
    first = reached.groupBy(*by).agg(F.min_by(F.struct("low", "le", "below", "n", "total"), "le").alias("b"))
    inside = (F.lit(q) * F.col("b.total") - F.col("b.below")) / (F.col("b.n") - F.col("b.below"))
    between = F.when(F.col("b.n") == F.col("b.below"), F.col("b.le")).otherwise(F.col("b.low") + (F.col("b.le") - F.col("b.low")) * inside)
    return first.select(*by, F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(between).alias("quantile"))


def breaches(df: DataFrame, labels: list[str], time: str, value: str, threshold: float, step: int, least: int, above: bool = True) -> DataFrame:
    """Runs of samples beyond ``threshold``, at most ``step`` seconds apart, that last ``least`` seconds; one row a run.

    Runs are found inside chunks of time, so a series of any length is spread over tasks; then those that touch a chunk's edge are joined
    with the next chunk's first, which handles runs only.
    """
    bad = F.col(value) > threshold if above else F.col(value) < threshold
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*labels, F.col(time).alias("at_time"), F.col(value).alias("v"), at.alias("at"), bad.alias("bad"))
    rows = rows.withColumn("chunk", F.floor(F.col("at") / (max(86_400, 2 * step) * 1_000_000)))
    w = Window.partitionBy(*labels, "chunk").orderBy("at")
    far = lambda before: F.col("at") - before > step * 1_000_000
    opens = F.col("bad") & (~F.coalesce(F.lag("bad").over(w), F.lit(False)) | far(F.lag("at").over(w)))
    runs = rows.select("*", opens.alias("opens"), F.lag("at").over(w).isNull().alias("first"), F.lead("at").over(w).isNull().alias("last"))
    runs = runs.withColumn("run", F.sum(F.col("opens").cast("int")).over(w)).where("bad")
    worst = F.max if above else F.min
    parts = runs.groupBy(*labels, "chunk", "run").agg(
        F.min("at").alias("begin"), F.max("at").alias("end"), F.min("at_time").alias("from_time"), F.max("at_time").alias("to_time"),
        F.count("*").alias("n_samples"), worst("v").alias("worst"), F.max("first").alias("first"), F.max("last").alias("last"),
    )
    order = Window.partitionBy(*labels).orderBy("begin")
    goes_on = F.col("first") & F.coalesce(F.lag("last").over(order), F.lit(False)) & (F.col("begin") - F.lag("end").over(order) <= step * 1_000_000)
    whole = parts.withColumn("begins", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("begins").over(order))
    found = whole.groupBy(*labels, "run").agg(
        F.min("from_time").alias("from_time"), F.max("to_time").alias("to_time"), F.sum("n_samples").alias("n_samples"), worst("worst").alias("worst"),
        ((F.max("end") - F.min("begin")) / 1e6 + step).cast("long").alias("seconds"),
    )
    return found.where(F.col("seconds") >= least).drop("run")


def excursions(df: DataFrame, labels: list[str], time: str, value: str, threshold: float, step: int) -> DataFrame:
    """Per series the worst value above ``threshold``, when it was, and the minutes above."""
    bad = df.where(F.col(value) > threshold)
    return bad.groupBy(*labels).agg(F.max(value).alias("worst"), F.min_by(time, F.struct(-F.col(value), F.col(time))).alias("worst_at"), (F.count("*") * step / 60.0).alias("minutes"))


def windows_back(df: DataFrame, time: str, start: str, end: str, unit: str, count: int) -> DataFrame:
    """Rows of [start, end) and of the same clock window ``count`` units (days, weeks) before, tagged with ``k``: one scan."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    size = {"day": 86_400, "week": 604_800}[unit]
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    k = F.ceil((micros(b) - micros(F.col(time))) / (size * 1e6)) - 1
    inside = (micros(F.col(time)) + k * size * 1_000_000 >= micros(a)) & (micros(F.col(time)) + k * size * 1_000_000 < micros(b))
    return df.withColumn("k", k.cast("int")).where((F.col("k") >= 0) & (F.col("k") <= count) & inside)


def weeks_verdict(per_window: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Now (k = 0) against earlier windows by median and median absolute deviation: high, low, normal or unknown."""
    now = per_window.where("k = 0").select(*labels, F.col(value).alias("now"))
    earlier = per_window.where("k > 0").select(*labels, F.col(value).alias("v"))
    middle = earlier.groupBy(*labels).agg(F.median("v").alias("usual"), F.count("v").alias("windows"))
    spread = earlier.join(middle, labels).groupBy(*labels).agg(F.median(F.abs(F.col("v") - F.col("usual"))).alias("mad"))
    both = now.join(middle.join(spread, labels), labels, "left")
    scale = F.greatest("mad", F.abs("usual") * LEAST_SCALE, F.lit(1e-9))
    far = (F.abs(F.col("now") - F.col("usual")) / scale >= DEVIATIONS) & (F.abs(F.col("now") - F.col("usual")) >= CHANGE * F.abs("usual"))
    verdict = (
        F.when(F.coalesce("windows", F.lit(0)) < WEEKS_NEEDED, "unknown").when(far & (F.col("now") > F.col("usual")), "high").when(far, "low").otherwise("normal")
    )
    return both.select(*labels, "now", "usual", "mad", F.coalesce("windows", F.lit(0)).alias("windows"), verdict.alias("verdict"))


def days_ratio(per_window: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Now against the median of earlier days, and whether the ratio leaves the usual band."""
    found = per_window.groupBy(*labels).agg(
        F.max(F.when(F.col("k") == 0, F.col(value))).alias("now"), F.median(F.when(F.col("k") > 0, F.col(value))).alias("usual")
    )
    ratio = F.when(F.col("usual") != 0, F.col("now") / F.col("usual"))
    return found.select("*", ratio.alias("ratio"), F.coalesce((ratio < BAND[0]) | (ratio > BAND[1]), F.lit(False)).alias("unusual"))


def downsample(df: DataFrame, labels: list[str], time: str, points: int, chunks: int = 256) -> DataFrame:
    """At most about ``points`` samples of each series, evenly by rank (``rn``), and always its last.

    Ranks are counted in ``chunks`` equal parts of a series' span, which are spread over tasks, behind the sizes of the parts before.
    """
    at = F.col(time).cast("double") if df.schema[time].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    spans = df.groupBy(*labels).agg(F.min(at).alias("__low"), F.max(at).alias("__high"))
    part = F.floor((at - F.col("__low")) / F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-9)) * (chunks - 1))
    placed = df.join(spans, labels).withColumn("__part", part).drop("__low", "__high")
    sizes = placed.groupBy(*labels, "__part").agg(F.count("*").alias("__size"))
    w = Window.partitionBy(*labels)
    before = sizes.select(*labels, "__part", (F.sum("__size").over(w.orderBy("__part")) - F.col("__size")).alias("__before"), F.sum("__size").over(w).alias("__n"))
    ranked = placed.join(before, [*labels, "__part"]).withColumn("rn", F.row_number().over(Window.partitionBy(*labels, "__part").orderBy(time)) + F.col("__before"))
    every = F.ceil(F.col("__n") / points)
    return ranked.where(((F.col("rn") - 1) % every == 0) | (F.col("rn") == F.col("__n"))).drop("__part", "__before", "__n")


def first_of_each(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)


def pivoted(df: DataFrame, row: str, series: str, value: str, names: list[str]) -> DataFrame:
    """Long (row, series, value) to one column a series of ``names``."""
    return df.groupBy(row).pivot(series, names).agg(F.max(value))


def day_ends(df: DataFrame, labels: list[str], time: str, value: str) -> DataFrame:
    """The last value of each day of each series."""
    return df.groupBy(*labels, F.to_date(time).alias("day")).agg(F.max_by(value, time).alias("day_end"))


def active_between(df: DataFrame, start_col: str, end_col: str, start: str, end: str) -> DataFrame:
    """Records with a start and an open or later end that overlap [start, end)."""
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return df.where((F.col(start_col) < b) & (F.col(end_col).isNull() | (F.col(end_col) >= a)))


def recurrence(found: DataFrame, labels: list[str], time: str, days: int) -> DataFrame:
    """Whether each series' runs of ``found`` are usual: the days they were on, usual from RECURS of at least 3 days."""
    per = found.groupBy(*labels).agg(F.countDistinct(F.to_date(time)).alias("days_on"))
    return per.withColumn("usual", F.lit(days >= 3) & (F.col("days_on") >= RECURS * days))


def recurring_runs(df: DataFrame, labels: list[str], time: str, value: str, threshold: float, step: int, least: int, start: str, end: str, days: int = 7) -> DataFrame:
    """(labels, n_runs, worst, seconds, days_on, days_seen, verdict) of the series with runs beyond ``threshold`` in [start, end).

    The same clock window of each of ``days`` earlier days is moved onto the first and cut into runs in the same scan.  Days on which a series
    has no sample do not count; with 3 that do, runs on RECURS of them are usual, on fewer they are not.
    """
    tagged = windows_back(df, time, start, end, "day", days)
    moved = tagged.withColumn(time, (F.col(time) + F.make_dt_interval(F.col("k"))).cast(df.schema[time].dataType))
    runs = breaches(moved, [*labels, "k"], time, value, threshold, step, least)
    now = runs.where("k = 0").groupBy(*labels).agg(F.count("*").alias("n_runs"), F.max("worst").alias("worst"), F.sum("seconds").alias("seconds"))
    on = runs.where("k > 0").groupBy(*labels).agg(F.countDistinct("k").alias("days_on"))
    seen = tagged.where((F.col("k") > 0) & F.col(value).isNotNull()).groupBy(*labels).agg(F.countDistinct("k").alias("days_seen"))
    both = join_same(join_same(now, on, labels), seen, labels).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("days_on", "days_seen")})
    usual = F.when(F.col("days_seen") < 3, "unknown").when(F.col("days_on") >= RECURS * F.col("days_seen"), "usual").otherwise("not usual")
    return both.withColumn("verdict", usual)


def day_scan(df: DataFrame, labels: list[str], time: str, last_day: str, weeks: int = 4) -> DataFrame:
    """Rows on ``last_day`` of each series against the same weekday of earlier weeks, a series without rows counting 0.

    Noise guard: a difference counts from max(3, 2 * sqrt(usual)) on.
    """
    back = F.datediff(F.lit(last_day).cast("date"), F.to_date(time))
    near = df.withColumn("k", (back / 7).cast("int")).where((back >= 0) & (back % 7 == 0) & (back <= 7 * weeks))
    per = near.groupBy(*labels).agg(*(F.count_if(F.col("k") == i).alias(f"w{i}") for i in range(weeks + 1)))
    earlier = F.array_sort(F.array(*(F.col(f"w{i}") for i in range(1, weeks + 1))))
    usual = (F.element_at(earlier, (weeks + 1) // 2) + F.element_at(earlier, weeks // 2 + 1)) / 2.0
    off = F.abs(F.col("w0") - usual) >= F.greatest(F.lit(3.0), 2 * F.sqrt(usual))
    what = F.when((F.col("w0") == 0) & (usual > 0) & off, "gone").when(off & (F.col("w0") > usual), "above").when(off, "below").otherwise("usual")
    return per.select(*labels, F.col("w0").alias("now"), usual.alias("usual"), what.alias("reading"))


def findings(df: DataFrame, labels: list[str], time: str, last_day: str, weeks: int = 4, most: int = 20) -> DataFrame:
    """(labels, finding, now, usual, weight, place): what to tell of a chart's day, at most ``most``, the weightiest first.

    ``stale`` series whose rows stopped before the day, by their usual rows; ``gone``, ``above`` and ``below`` by how far they are from usual.
    """
    read = day_scan(df, labels, time, last_day, weeks)
    last = df.groupBy(*labels).agg(F.max(F.to_date(time)).alias("_last"))
    both = join_same(read, last, labels)
    stopped = (F.col("_last") < F.lit(last_day).cast("date")) & (F.col("usual") > 0)
    told = both.withColumn("finding", F.when(stopped, "stale").otherwise(F.col("reading"))).where("finding != 'usual'")
    told = told.withColumn("weight", F.when(F.col("finding") == "stale", F.col("usual")).otherwise(F.abs(F.col("now") - F.col("usual"))))
    first = told.orderBy(F.desc("weight"), *labels).limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("weight"), *labels))  # ``most`` rows
    return first.select(*labels, "finding", "now", "usual", "weight", place.alias("place"))


def health(tagged: DataFrame, labels: list[str], value: str, threshold: float, band: float = 0.05) -> DataFrame:
    """(labels, now, usual, verdict): the share of samples within ``threshold`` now and as the median of the same windows before."""
    per = tagged.groupBy(*labels, "k").agg((F.count_if(F.col(value) <= threshold) / F.count("*")).alias("level"))
    both = per.groupBy(*labels).agg(F.max(F.when(F.col("k") == 0, F.col("level"))).alias("now"), F.median(F.when(F.col("k") > 0, F.col("level"))).alias("usual"))
    what = F.when(F.col("now").isNull(), "silent").when(F.col("usual").isNull(), "unknown").when(F.col("now") < F.col("usual") - band, "worse").when(F.col("now") > F.col("usual") + band, "better").otherwise("usual")
    return both.withColumn("verdict", what)


def quantile_over_time(df: DataFrame, labels: list[str], time: str, value: str, seconds: int, q: float) -> DataFrame:
    """Mean and q-quantile of the ``seconds`` up to each sample."""
    return _behind(df, labels, time, seconds, {"avg_over": lambda w: F.avg(value).over(w), "quantile_over": lambda w: F.percentile(value, F.lit(q)).over(w)})


def stale(df: DataFrame, labels: list[str], time: str, last_day: str, most: int = 20) -> DataFrame:
    """(labels, n, last_seen, stale, place): the ``most`` series with most rows, and whether their data stopped before ``last_day``."""
    per = df.groupBy(*labels).agg(F.count("*").alias("n"), F.max(F.to_date(time)).alias("last_seen"))
    top = per.orderBy(F.desc("n"), *labels).limit(most)
    return top.withColumn("stale", F.col("last_seen") < F.lit(last_day).cast("date")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), *labels)))


def top_series(df: DataFrame, metric: str, series: str, value: str, n: int) -> DataFrame:
    """(metric, series, total, place): the ``n`` series of each metric with the largest total magnitude."""
    per = df.groupBy(metric, series).agg(F.round(F.sum(F.abs(F.col(value))), 4).alias("total"))
    return first_of_each(per, [metric], [F.desc("total"), F.asc(series)], n).withColumnRenamed("rn", "place")


def metric_profile(df: DataFrame, labels: list[str], time: str, value: str) -> DataFrame:
    """(labels, n, least, most, mean, total, seconds, rate): what a counter did: its values, its growth over restarts, and that a second."""
    grown = increase(df, labels, time, value)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    per = grown.groupBy(*labels).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.sum("increase").alias("total"),
        ((F.max(at) - F.min(at)) / 1e6).alias("seconds"),
    )
    return per.withColumn("rate", F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds")))


def latencies(df: DataFrame, by: list[str], value: str, failed) -> DataFrame:
    """(by, n, p95, failed_share): exact 95th percentile and share of failures of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.95)).alias("p95"), (F.count_if(failed) / F.count("*")).alias("failed_share"))
