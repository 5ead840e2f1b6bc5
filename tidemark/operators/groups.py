"""Where a change comes from: each value of many fields, now against the same window of earlier days, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# When a value stands out.
HIGH, LOW = BAND = (1.3, 0.77)
LEAST_COUNT = 5
COUNT_NOISE = 3.0
NOISE = 3.0
FLOOR, FLOOR_SHARE = 3.0, 0.02
STEADY_DAYS, STEADY_SHARE = 5, 0.1
LEAST_MEAN = 3
NONE = "(none)"


def cube(tagged: DataFrame, fields: list[str], measure: str | None = None) -> DataFrame:
    """(k, field, value, n, m): rows and mean of ``measure`` of each value of each field in each window; field '' is the total."""
    parts = [F.struct(F.lit("").alias("field"), F.lit("").alias("value"))]
    parts += [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit(NONE)).alias("value")) for f in fields]
    m = F.col(measure).cast("double") if measure else F.lit(None).cast("double")
    long = tagged.select("k", m.alias("m"), F.explode(F.array(*parts)).alias("p"))
    return long.groupBy("k", F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"), F.avg("m").alias("m"))


def compare(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Counts now against their usual, the median of the earlier windows in ``windows`` (k), a missing value counting 0.

    A count stands out beyond HIGH or LOW times its usual, LEAST_COUNT and what counts differ by from day to day.
    """
    values = cells.select("field", "value").distinct()
    grid = values.join(F.broadcast(windows.select("k")), how="cross")  # windows: a few rows by construction
    full = grid.join(cells.select("k", "field", "value", "n"), ["k", "field", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    middle = full.groupBy("field", "value").agg(
        F.max(F.when(F.col("k") == 0, F.col("n"))).alias("now"), F.median(F.when(F.col("k") > 0, F.col("n"))).alias("usual"), F.count_if(F.col("k") > 0).alias("windows")
    )
    spread = full.where("k > 0").join(middle, ["field", "value"]).groupBy("field", "value").agg(F.median(F.abs(F.col("n") - F.col("usual"))).alias("mad"))
    both = middle.join(spread, ["field", "value"], "left").withColumn("now", F.coalesce("now", F.lit(0.0)))
    ratio = F.when(F.col("usual") > 0, F.col("now") / F.col("usual"))
    off = F.abs(F.col("now") - F.col("usual"))
    noise = F.when(F.col("windows") >= 3, F.coalesce("mad", F.lit(0.0))).otherwise(0.0)
    unusual = (
        ((ratio >= HIGH) | (ratio <= LOW))
        & (off >= LEAST_COUNT)
        & (off > COUNT_NOISE * F.sqrt(F.greatest("usual", F.lit(1.0))))
        & (off > NOISE * noise)
    )
    return both.select("field", "value", "now", "usual", ratio.alias("ratio"), F.coalesce(unusual, F.lit(False)).alias("unusual"), ((F.col("usual") == 0) & (F.col("now") > 0)).alias("appeared"))


def localize(found: DataFrame) -> DataFrame:
    """Per field: values that stand out, the share of the total change they hold, and the share of their rows in all rows."""
    total = found.where("field = ''").select((F.col("now") - F.col("usual")).alias("change"), F.col("now").alias("rows"))
    per = found.where("field != ''").groupBy("field").agg(
        F.count("*").alias("n_values"), F.count_if("unusual").alias("n_unusual"),
        F.sum(F.when(F.col("unusual"), F.col("now") - F.col("usual"))).alias("held"), F.sum(F.when(F.col("unusual"), F.col("now"))).alias("held_rows"),
    )
    return per.join(F.broadcast(total), how="cross").select(  # one row
        "field", "n_values", "n_unusual",
        F.when(F.col("change") != 0, F.col("held") / F.col("change")).alias("coverage"), F.when(F.col("rows") > 0, F.col("held_rows") / F.col("rows")).alias("row_share"),
    )


def stages(df: DataFrame, by: list[str], first: str, second: str, until: str) -> DataFrame:
    """Per group: rows that reached each time before ``until``, mean lapse between both, rows still waiting and their mean age in days."""
    end = F.lit(until).cast("timestamp_ntz")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    a, b = F.col(first) < end, F.col(second) < end
    waiting = a & (F.col(second).isNull() | ~b)
    return df.groupBy(*by).agg(
        F.count_if(a).alias("reached_first"), F.count_if(b).alias("reached_second"),
        F.avg(F.when(a & b, (seconds(F.col(second)) - seconds(F.col(first))) / 86400)).alias("lapse_days"),
        F.count_if(waiting).alias("waiting"), F.avg(F.when(waiting, (seconds(end) - seconds(F.col(first))) / 86400)).alias("age_days"),
    )


def journey(df: DataFrame, by: list[str], times: list[str], until: str) -> DataFrame:
    """(by, step, reached, lapse_days, waiting, age_days, share): each stage of a way through ``times``, from one time to the next.

    ``reached`` rows have both times before ``until``; ``waiting`` ones the first only, for ``age_days`` on average; ``share`` is the step's part of
    the whole way's mean time.  All steps come from one scan.
    """
    end = F.lit(until).cast("timestamp_ntz")
    days = lambda c: F.unix_micros(c.cast("timestamp")) / 86_400_000_000
    steps = [F.struct(F.lit(f"{a} > {b}").alias("step"), F.col(a).cast("timestamp_ntz").alias("a"), F.col(b).cast("timestamp_ntz").alias("b")) for a, b in zip(times, times[1:], strict=False)]
    long = df.select(*by, F.inline(F.array(*steps)))
    began, ended = F.coalesce(F.col("a") < end, F.lit(False)), F.coalesce(F.col("b") < end, F.lit(False))
    per = long.groupBy(*by, "step").agg(
        F.count_if(began & ended).alias("reached"), F.avg(F.when(began & ended, days(F.col("b")) - days(F.col("a")))).alias("lapse_days"),
        F.count_if(began & ~ended).alias("waiting"), F.avg(F.when(began & ~ended, days(end) - days(F.col("a")))).alias("age_days"),
    )
    whole = F.sum("lapse_days").over(Window.partitionBy(*by)) if by else F.sum("lapse_days").over(Window.partitionBy(F.lit(0)))
    return per.withColumn("share", F.when(whole != 0, F.col("lapse_days") / whole))


def ratio(df: DataFrame, by: list[str], over: str, under: str) -> DataFrame:
    """sum(over) / sum(under) on the rows that have both, with their number."""
    both = F.col(over).isNotNull() & F.col(under).isNotNull()
    below = F.sum(F.when(both, F.col(under)))
    return df.groupBy(*by).agg(F.count_if(both).alias("n_both"), F.when(below != 0, F.sum(F.when(both, F.col(over))) / below).alias("ratio"))


def lift(df: DataFrame, fields: list[str], focus) -> DataFrame:
    """Values of ``fields`` among the focus rows against all rows: share, lift and share * ln(lift)."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    long = df.select(focus.cast("int").alias("hit"), F.explode(F.array(*parts)).alias("p")).where("p.value is not null")
    per = long.groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"), F.sum("hit").alias("n_focus"))
    totals = per.groupBy("field").agg(F.sum("n").alias("all_n"), F.sum("n_focus").alias("all_focus"))
    share, base = F.col("n_focus") / F.col("all_focus"), F.col("n") / F.col("all_n")
    return per.join(F.broadcast(totals), "field").where("n_focus > 0").select(  # totals: a row a field
        "field", "value", "n", "n_focus", share.alias("share"), (share / base).alias("lift"), (share * F.log(share / base)).alias("score")
    )


def replaced(now: DataFrame, before: DataFrame, value: str, close: float = 0.25) -> DataFrame:
    """(new, old): values only there now, each beside the value only there before whose count is nearest, within ``close``."""
    a = now.groupBy(value).agg(F.count("*").alias("n"))
    b = before.groupBy(value).agg(F.count("*").alias("n"))
    came = a.join(b.select(value), value, "left_anti").select(F.col(value).alias("new"), F.col("n").alias("n_new"))
    went = b.join(a.select(value), value, "left_anti").select(F.col(value).alias("old"), F.col("n").alias("n_old"))
    # Counts meet, not values: distinct counts of n rows are fewer than sqrt(2 n), so their pairs are no more than the rows.
    # Counts in logarithmic steps: near counts are in the same or a neighbouring step, so this is an equi-join.
    step = lambda c: F.floor(F.log(F.col(c)) / F.log(F.lit(1 + close))).cast("long")
    first = went.groupBy("n_old").agg(F.min("old").alias("old"))
    counts = came.select("n_new").distinct()
    near = counts.withColumn("s", F.explode(F.array(*(step("n_new") + i for i in (-2, -1, 0, 1, 2))))).join(first.withColumn("s", step("n_old")), "s")
    off = F.abs(F.col("n_new") - F.col("n_old"))
    fit = near.where(off <= close * F.greatest("n_new", "n_old"))
    best = fit.groupBy("n_new").agg(F.min_by("old", F.struct(off, "old")).alias("old"))
    return came.join(best, "n_new").select("new", "n_new", "old")


def filled_windows(tagged: DataFrame, wanted: int) -> DataFrame:
    """(k, n, place): the nearest ``wanted`` earlier windows that hold rows, empty ones passed over; place 1 is the nearest."""
    per = tagged.where("k > 0").groupBy("k").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.row_number().over(Window.orderBy("k"))).where(F.col("place") <= wanted)  # a row a window


def summarize(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """What became of each value of each field: appeared, gone, off, moved or usual.

    Counts: ``usual`` is the median of the earlier windows in ``windows`` (k), a missing value counting 0.  A change of fewer than FLOOR rows
    or FLOOR_SHARE of all rows is none.  A value is off beyond BAND if it also leaves NOISE times its spread and, unless its counts
    are steady, what counts differ by from day to day.  Means: moved beyond BAND, where now and three earlier windows have LEAST_MEAN rows.
    """
    found = _against_usual(cells, windows)
    total = found.where("field = ''").select(F.greatest("now", "usual").alias("all"))
    x = found.join(F.broadcast(total), how="cross")  # one row
    off = F.abs(F.col("now") - F.col("usual"))
    floor = F.greatest(F.lit(FLOOR), FLOOR_SHARE * F.col("all"))
    steady = (F.col("windows") >= STEADY_DAYS) & (F.col("mad") <= STEADY_SHARE * F.col("usual"))
    beyond = lambda r: (r >= BAND[0]) | (r <= BAND[1])
    counts = beyond(F.col("now") / F.col("usual")) & (off >= floor) & (off > NOISE * F.col("mad")) & (steady | (off > COUNT_NOISE * F.sqrt(F.greatest("usual", F.lit(1.0)))))
    means = (F.col("now") >= LEAST_MEAN) & (F.col("m_windows") >= 3) & beyond(F.col("m_now") / F.col("m_usual"))
    what = (
        F.when((F.col("usual") == 0) & (F.col("now") >= LEAST_COUNT), "appeared").when((F.col("now") == 0) & (F.col("usual") >= floor), "gone")
        .when((F.col("usual") > 0) & counts, "off").when(F.coalesce(means, F.lit(False)), "moved").otherwise("usual")
    )
    return x.select("field", "value", "now", "usual", "m_now", "m_usual", F.coalesce(steady, F.lit(False)).alias("steady"), what.alias("what"))


def _against_usual(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Counts and means of each value now, the medians of their earlier windows, and the median deviation of counts."""
    values = cells.select("field", "value").distinct()
    grid = values.join(F.broadcast(windows.select("k")), how="cross")  # windows: a few rows by construction
    full = grid.join(cells.select("k", "field", "value", "n", "m"), ["k", "field", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    earlier = F.col("k") > 0
    middle = full.groupBy("field", "value").agg(
        F.coalesce(F.max(F.when(~earlier, F.col("n"))), F.lit(0.0)).alias("now"), F.median(F.when(earlier, F.col("n"))).alias("usual"), F.count_if(earlier).alias("windows"),
        F.max(F.when(~earlier, F.col("m"))).alias("m_now"), F.median(F.when(earlier & (F.col("n") >= LEAST_MEAN), F.col("m"))).alias("m_usual"),
        F.count_if(earlier & (F.col("n") >= LEAST_MEAN)).alias("m_windows"),
    )
    spread = full.where(earlier).join(middle.select("field", "value", "usual"), ["field", "value"]).groupBy("field", "value").agg(F.median(F.abs(F.col("n") - F.col("usual"))).alias("mad"))
    return middle.join(spread, ["field", "value"], "left")


def rank_fields(found: DataFrame) -> DataFrame:
    """Fields by how well their unusual values explain the change: coverage, then purity, then the fewest values.

    ``purity`` is the share of a field's absolute changes that its unusual values hold.
    """
    held = F.when(F.col("unusual"), F.abs(F.col("now") - F.col("usual")))
    purity = found.where("field != ''").groupBy("field").agg((F.sum(held) / F.sum(F.abs(F.col("now") - F.col("usual")))).alias("purity"))
    per = localize(found).join(purity, "field").where("n_unusual > 0")
    order = Window.orderBy(F.desc("coverage"), F.desc("purity"), "n_unusual", "field")  # a row a field
    return per.select("field", "n_unusual", "coverage", "purity", F.row_number().over(order).alias("place"))


def others(tagged: DataFrame, scope, value: str) -> DataFrame:
    """Values found in the scope now, with the rows outside it that share them: now and the median of earlier windows."""
    inside = tagged.where((F.col("k") == 0) & scope).select(value).distinct()
    per = tagged.where(~scope).join(inside, value, "left_semi").groupBy(value, "k").agg(F.count("*").cast("double").alias("n"))
    windows = tagged.select("k").distinct()
    full = inside.join(F.broadcast(windows), how="cross").join(per, [value, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))  # a few windows
    return full.groupBy(value).agg(F.max(F.when(F.col("k") == 0, F.col("n"))).alias("now"), F.median(F.when(F.col("k") > 0, F.col("n"))).alias("usual"))


def survey(tagged: DataFrame, fields: list[str], measures: dict) -> DataFrame:
    """(measure, field, value, now, usual, ratio, off, place): every measure of every value now and usually, the farthest first.

    ``measures`` are aggregates by name; ``usual`` is the median of the earlier windows that have the value.  A measure is off beyond BAND.
    """
    parts = [F.struct(F.lit("").alias("field"), F.lit("").alias("value"))]
    parts += [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit(NONE)).alias("value")) for f in fields]
    cells = tagged.withColumn("p", F.explode(F.array(*parts))).groupBy("k", F.col("p.field").alias("field"), F.col("p.value").alias("value"))
    wide = cells.agg(*(m.cast("double").alias(name) for name, m in measures.items()))
    long = wide.unpivot(["k", "field", "value"], list(measures), "measure", "v")
    per = long.groupBy("measure", "field", "value").agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("now"), F.median(F.when(F.col("k") > 0, F.col("v"))).alias("usual"))
    ratio = F.round(F.when(F.col("usual") != 0, F.col("now") / F.col("usual")), 6)
    per = per.withColumn("ratio", ratio).withColumn("off", F.coalesce((F.col("ratio") >= BAND[0]) | (F.col("ratio") <= BAND[1]), F.lit(False)))
    far = F.desc(F.when(F.col("ratio") == 0, F.lit(float("inf"))).otherwise(F.round(F.abs(F.log("ratio")), 6)))  # log(0) is null, and nothing is farther
    return per.where("off").withColumn("place", F.row_number().over(Window.partitionBy("measure").orderBy(far, "field", "value")))


def moved(column: str, limit: str, days_back) -> Column:
    """``column`` before the day ``limit``, moved back with the window a row is in."""
    return F.col(column) < F.lit(limit).cast("timestamp_ntz") - F.make_dt_interval(days_back)
