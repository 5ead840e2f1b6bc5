"""All queries of the analytics part, with the SQL each is held against on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import entities, groups, measures, profiles, series
from tidemark.plans.plan import Cond, Measure, Plan, Step, StepColumn, run_plan
from tidemark.registry import QUERIES, SQL, query
from tidemark.sources import tables
from tidemark.sources.tables import table

def _plan(spark: SparkSession, sf_dir: str, *steps: Step) -> DataFrame:
    return run_plan(Plan(steps), {s.table: table(spark, sf_dir, s.table) for s in steps})[steps[-1].name]


def _cents(c):
    """Sums of prices as whole cents: the same whatever the order of addition."""
    return F.round(F.col(c) * 100).cast("long")


# Plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_group_bucket(spark, sf_dir)


@query(
    """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, o_orderpriority, count(*) AS n_orders, round(max(o_totalprice), 2) AS highest
       FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
       GROUP BY 1, 2 ORDER BY n_orders DESC, 1, 2 LIMIT 20"""
)
def plan_group_bucket(spark, sf_dir):
    step = Step(
        "q1", "orders", (Measure("n_orders", "count"), Measure("highest", "max", "o_totalprice")), ("o_orderpriority",),
        time_field="o_orderdate", period=("1997-01-01", "1998-01-01"), bucket="month", order="n_orders", limit=20,
    )
    return _plan(spark, sf_dir, step).withColumn("highest", F.round("highest", 2))


@query(
    """SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem
       WHERE l_quantity >= 10 AND l_linestatus IN ('O', 'F') AND l_returnflag NOT IN ('X') AND l_discount <> 0.05 AND l_returnflag LIKE '%'
         AND l_shipdate IS NOT NULL GROUP BY 1"""
)
def plan_filter_ops(spark, sf_dir):
    where = (
        Cond("l_quantity", ">=", 10), Cond("l_linestatus", "=", ["O", "F"]), Cond("l_returnflag", "!=", ["X"]), Cond("l_discount", "!=", 0.05),
        Cond("l_returnflag", "like", "%"), Cond("l_shipdate", "is not null"),
    )
    return _plan(spark, sf_dir, Step("q1", "lineitem", (Measure("n", "count"), Measure("suppliers", "count_distinct", "l_suppkey")), ("l_returnflag",), where))


@query("SELECT count(*) FILTER (WHERE FALSE) AS n_none, count(*) FILTER (WHERE TRUE) AS n_all FROM orders")
def plan_empty_in(spark, sf_dir):
    ms = (Measure("n_none", "count", None, (Cond("o_orderstatus", "in", []),)), Measure("n_all", "count", None, (Cond("o_orderstatus", "not in", []),)))
    return _plan(spark, sf_dir, Step("q1", "orders", ms))


@query(
    """SELECT event_type, count(*) FILTER (WHERE value > 50) AS n_high, round(max(value) FILTER (WHERE user_id <> 3), 6) AS top,
              round(min(value), 6) AS low, count(DISTINCT user_id) FILTER (WHERE value > 20) AS users,
              round(100.0::DOUBLE * count(*) FILTER (WHERE value > 50) / count(*), 6) AS share_high FROM events GROUP BY 1"""
)
def plan_measures_filter(spark, sf_dir):
    high = (Cond("value", ">", 50),)
    ms = (
        Measure("n_high", "count", None, high), Measure("top", "max", "value", (Cond("user_id", "!=", 3),)), Measure("low", "min", "value"),
        Measure("users", "count_distinct", "user_id", (Cond("value", ">", 20),)), Measure("share_high", "share", None, high),
    )
    df = _plan(spark, sf_dir, Step("q1", "events", ms, ("event_type",)))
    return df.select("event_type", "n_high", F.round("top", 6).alias("top"), F.round("low", 6).alias("low"), "users", F.round("share_high", 6).alias("share_high"))


def _bucketed(spark, sf_dir, bucket):
    step = Step("q1", "events", (Measure("n", "count"),), ("event_type",), time_field="ts", period=("2024-01-02", "2024-01-20"), bucket=bucket, limit=1_000_000)
    return _plan(spark, sf_dir, step)


_BUCKET_SQL = "SELECT {} AS bucket, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2"


@query(_BUCKET_SQL.format("date_trunc('day', ts)::TIMESTAMP"))
def plan_bucket_day(spark, sf_dir):
    return _bucketed(spark, sf_dir, "day")


@query(_BUCKET_SQL.format("date_trunc('week', ts)::TIMESTAMP"))
def plan_bucket_week(spark, sf_dir):
    return _bucketed(spark, sf_dir, "week")


@query(_BUCKET_SQL.format("time_bucket(INTERVAL '15 minutes', ts)"))
def plan_bucket_15min(spark, sf_dir):
    return _bucketed(spark, sf_dir, "15 minutes")


@query(
    """WITH q1 AS (SELECT c_custkey, count(*) AS n FROM customer WHERE c_nationkey IN (1, 2, 3) GROUP BY 1)
       SELECT o_orderstatus, count(*) AS n_orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM q1) GROUP BY 1"""
)
def plan_step_feed(spark, sf_dir):
    first = Step("q1", "customer", (Measure("n", "count"),), ("c_custkey",), (Cond("c_nationkey", "in", [1, 2, 3]),))
    return _plan(spark, sf_dir, first, Step("q2", "orders", (Measure("n_orders", "count"),), ("o_orderstatus",), (Cond("o_custkey", "in", StepColumn("q1", "c_custkey")),)))


@query(
    """SELECT o_orderstatus, count(*) AS n_orders FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_nationkey IN (1, 2, 3)) GROUP BY 1"""
)
def plan_step_exclude(spark, sf_dir):
    first = Step("q1", "customer", (Measure("n", "count"),), ("c_custkey",), (Cond("c_nationkey", "in", [1, 2, 3]),))
    return _plan(spark, sf_dir, first, Step("q2", "orders", (Measure("n_orders", "count"),), ("o_orderstatus",), (Cond("o_custkey", "not in", StepColumn("q1", "c_custkey")),)))


@query("SELECT round(max(l_quantity) * 60, 6) AS longest_s, round(min(l_quantity) / 1024, 9) AS smallest_mb FROM lineitem")
def unit_convert(spark, sf_dir):
    ms = (Measure("longest_s", "max", "l_quantity", unit=("min", "s")), Measure("smallest_mb", "min", "l_quantity", unit=("kb", "mb")))
    return _plan(spark, sf_dir, Step("q1", "lineitem", ms)).select(F.round("longest_s", 6).alias("longest_s"), F.round("smallest_mb", 9).alias("smallest_mb"))


# Windows of earlier days and weeks

_BACK = """tagged AS (SELECT *, CAST(ceil((epoch_us(TIMESTAMP '{end}') - epoch_us(ts)) / ({size} * 1e6)) - 1 AS INT) AS k FROM events),
 cells AS (SELECT * FROM tagged WHERE k BETWEEN 0 AND {n} AND epoch_us(ts) + k::BIGINT * {size} * 1000000 >= epoch_us(TIMESTAMP '{start}') AND epoch_us(ts) + k::BIGINT * {size} * 1000000 < epoch_us(TIMESTAMP '{end}'))"""


def _back(spark, sf_dir, start, end, unit, n):
    return series.windows_back(table(spark, sf_dir, "events"), "ts", start, end, unit, n)


@query(
    "WITH " + _BACK.format(start="2024-01-27", end="2024-01-28", size=604800, n=3) + """, per AS (SELECT event_type, k, count(*)::DOUBLE AS n FROM cells GROUP BY 1, 2),
       med AS (SELECT event_type, median(n) AS usual, count(*) AS windows FROM per WHERE k > 0 GROUP BY 1),
       m AS (SELECT p.event_type, median(abs(n - usual)) AS mad FROM per p JOIN med USING (event_type) WHERE k > 0 GROUP BY 1)
       SELECT event_type, n AS now, usual, mad, coalesce(windows, 0)::BIGINT AS windows,
         CASE WHEN coalesce(windows, 0) < 3 THEN 'unknown'
              WHEN abs(n - usual) / greatest(mad, abs(usual) * 0.05, 1e-9) >= 3.5 AND abs(n - usual) >= 0.2 * abs(usual) THEN CASE WHEN n > usual THEN 'high' ELSE 'low' END
              ELSE 'normal' END AS verdict
       FROM per LEFT JOIN med USING (event_type) LEFT JOIN m USING (event_type) WHERE k = 0"""
)
def usual_weeks_verdict(spark, sf_dir):
    per = _back(spark, sf_dir, "2024-01-27", "2024-01-28", "week", 3).groupBy("event_type", "k").agg(F.count("*").cast("double").alias("n"))
    return series.weeks_verdict(per, ["event_type"], "n")


@query(
    "WITH " + _BACK.format(start="2024-01-20 06:00:00", end="2024-01-20 18:00:00", size=86400, n=7) + """, per AS (SELECT event_type, k, count(*)::DOUBLE AS n FROM cells GROUP BY 1, 2),
       a AS (SELECT event_type, max(n) FILTER (WHERE k = 0) AS now, median(n) FILTER (WHERE k > 0) AS usual FROM per GROUP BY 1)
       SELECT *, CASE WHEN usual <> 0 THEN now / usual END AS ratio, coalesce(now / usual < 0.77 OR now / usual > 1.3, FALSE) AS unusual FROM a"""
)
def usual_days_ratio(spark, sf_dir):
    per = _back(spark, sf_dir, "2024-01-20 06:00:00", "2024-01-20 18:00:00", "day", 7).groupBy("event_type", "k").agg(F.count("*").cast("double").alias("n"))
    return series.days_ratio(per, ["event_type"], "n")


_CUBE = "WITH " + _BACK.format(start="2024-01-20", end="2024-01-21", size=86400, n=8) + """,
 long AS (SELECT k, '' AS field, '' AS value FROM cells UNION ALL SELECT k, 'event_type', event_type FROM cells UNION ALL SELECT k, 'user_id', user_id::VARCHAR FROM cells),
 per AS (SELECT k, field, value, count(*)::DOUBLE AS n FROM long GROUP BY ALL),
 grid AS (SELECT field, value, k FROM (SELECT DISTINCT field, value FROM per), (SELECT DISTINCT k FROM cells)),
 full_ AS (SELECT g.field, g.value, g.k, coalesce(n, 0) AS n FROM grid g LEFT JOIN per USING (k, field, value)),
 mid AS (SELECT field, value, coalesce(max(n) FILTER (WHERE k = 0), 0) AS now, median(n) FILTER (WHERE k > 0) AS usual, count(*) FILTER (WHERE k > 0) AS windows FROM full_ GROUP BY 1, 2),
 spread AS (SELECT f.field, f.value, median(abs(n - usual)) AS mad FROM full_ f JOIN mid USING (field, value) WHERE k > 0 GROUP BY 1, 2),
 found AS (SELECT field, value, now, usual, CASE WHEN usual > 0 THEN now / usual END AS ratio,
   coalesce((now / nullif(usual, 0) >= 1.3 OR now / nullif(usual, 0) <= 0.77) AND abs(now - usual) >= 5 AND abs(now - usual) > 3 * sqrt(greatest(usual, 1))
     AND abs(now - usual) > 3 * CASE WHEN windows >= 3 THEN coalesce(mad, 0) ELSE 0 END, FALSE) AS unusual, usual = 0 AND now > 0 AS appeared
   FROM mid LEFT JOIN spread USING (field, value))"""


def _compared(spark, sf_dir):
    tagged = _back(spark, sf_dir, "2024-01-20", "2024-01-21", "day", 8)
    cells = groups.cube(tagged, ["event_type", "user_id"])
    return groups.compare(cells, tagged.select("k").distinct())


@query(_CUBE + " SELECT * FROM found")
def compare_groups_cube(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(
    _CUBE + """ SELECT field, count(*) AS n_values, count(*) FILTER (WHERE unusual) AS n_unusual,
     CASE WHEN (SELECT now - usual FROM found WHERE field = '') <> 0 THEN sum(now - usual) FILTER (WHERE unusual) / (SELECT now - usual FROM found WHERE field = '') END AS coverage,
     sum(now) FILTER (WHERE unusual) / nullif((SELECT now FROM found WHERE field = ''), 0) AS row_share FROM found WHERE field <> '' GROUP BY 1"""
)
def localize_change(spark, sf_dir):
    return groups.localize(_compared(spark, sf_dir))


_RUNS = """rows_ AS (SELECT event_type, ts, value AS v, epoch_us(ts) AS us, value > {t} AS bad FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
 o AS (SELECT *, bad AND (NOT coalesce(lag(bad) OVER w, FALSE) OR us - lag(us) OVER w > {step}::BIGINT * 1000000) AS opens FROM rows_ WINDOW w AS (PARTITION BY event_type ORDER BY us)),
 r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY event_type ORDER BY us) AS run FROM o)"""


@query(
    "WITH " + _RUNS.format(t=60, step=7200) + """ SELECT event_type, min(ts) AS from_time, max(ts) AS to_time, count(*) AS n_samples, max(v) AS worst, CAST(floor((max(us) - min(us)) / 1e6 + 7200) AS BIGINT) AS seconds
       FROM r WHERE bad GROUP BY event_type, run HAVING floor((max(us) - min(us)) / 1e6 + 7200) >= 10800"""
)
def breach_islands(spark, sf_dir):
    return series.breaches(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", 60.0, 7200, 10800)


@query(
    """SELECT event_type, max(value) AS worst, arg_min(ts, (-value, ts)) AS worst_at, count(*) * 300 / 60.0::DOUBLE AS minutes FROM events WHERE value > 90 GROUP BY 1"""
)
def excursions(spark, sf_dir):
    return series.excursions(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", 90.0, 300)


@query(
    """WITH c AS (SELECT user_id, event_id, ts, (event_id * 7919) % 1000 / 1.0::DOUBLE AS v FROM events),
       g AS (SELECT user_id, event_id, v, CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS increase FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
       SELECT user_id, sum(increase) AS total, count(*) AS n FROM g GROUP BY 1"""
)
def counter_increase(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", F.timestamp_micros("event_id").alias("at"), ((F.col("event_id") * 7919) % 1000).cast("double").alias("v"))
    return series.increase(df, ["user_id"], "at", "v").groupBy("user_id").agg(F.sum("increase").alias("total"), F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT user_id, (event_id * 7919) % 1000 AS v, lag((event_id * 7919) % 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
       SELECT user_id, count(*) FILTER (WHERE v <> b) AS n_changes, count(*) FILTER (WHERE v < b) AS n_resets, count(*) AS n_samples FROM c GROUP BY 1"""
)
def counter_changes(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 7919) % 1000).alias("v"))
    return series.changes(df, ["user_id"], "event_id", "v")


@query(
    """SELECT event_id, min(value) OVER w AS min_over, max(value) OVER w AS max_over FROM events
       WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)"""
)
def value_over_time(spark, sf_dir):
    return series.over_time(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", 6 * 3600).select("event_id", "min_over", "max_over")


@query(
    """WITH le AS (SELECT unnest([10.0, 25.0, 50.0, 75.0, 100.0, 1000000.0])::DOUBLE AS le), h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le)::DOUBLE AS n FROM events, le GROUP BY 1, 2),
       w AS (SELECT *, coalesce(lag(le) OVER p, 0) AS low, coalesce(lag(n) OVER p, 0) AS below, max(n) OVER (PARTITION BY event_type) AS total FROM h WINDOW p AS (PARTITION BY event_type ORDER BY le)),
       f AS (SELECT event_type, arg_min({'low': low, 'le': le, 'below': below, 'n': n, 'total': total}, le) AS b FROM w WHERE n >= 0.95 * total AND total > 0 GROUP BY 1)
       SELECT event_type, round(CASE WHEN b.n = b.below THEN b.le ELSE b.low + (b.le - b.low) * ((0.95 * b.total - b.below) / (b.n - b.below)) END, 6) AS quantile FROM f"""
)
def hist_quantile(spark, sf_dir):
    bounds = F.explode(F.array(*(F.lit(x) for x in (10.0, 25.0, 50.0, 75.0, 100.0, 1e6))))
    hist = table(spark, sf_dir, "events").select("event_type", "value", bounds.alias("le")).groupBy("event_type", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("n"))
    return series.histogram_quantile(hist, ["event_type"], "le", "n", 0.95).select("event_type", F.round("quantile", 6).alias("quantile"))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS middle, quantile_disc(value, 0.9) AS p90_nearest FROM events GROUP BY 1")
def quantiles_exact(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.median("value"), 6).alias("middle"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90_nearest")
    )


@query(
    """WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
       SELECT event_type, event_id, value, rn FROM r WHERE (rn - 1) % ceil(n / 60.0) = 0 OR rn = n"""
)
def downsample(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return series.downsample(df, ["event_type"], "event_id", 60).withColumn("rn", F.col("rn").cast("long"))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def first_n_per_group(spark, sf_dir):
    found = series.first_of_each(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 5)
    return found.select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query(
    """SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS "view" FROM events GROUP BY 1"""
)
def pivot_series(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").count()
    return series.pivoted(per, "day", "event_type", "count", ["click", "error", "view"]).na.fill(0)


@query("SELECT event_type, ts::DATE AS day, arg_max(event_id, ts) AS day_end FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id DESC) AS x FROM events) WHERE x = 1 GROUP BY 1, 2")
def day_end_values(spark, sf_dir):
    one = table(spark, sf_dir, "events").groupBy("event_type", "ts").agg(F.max("event_id").alias("event_id"))
    return series.day_ends(one, ["event_type"], "ts", "event_id")


@query(
    """WITH d AS (SELECT event_type, ts::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), h AS (SELECT event_type, hour(ts) AS hour, ts::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2, 3),
       m AS (SELECT event_type, hour, median(n) AS n FROM h GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, hour) AS rn FROM m)
       SELECT b.event_type, hour::INT AS hour, b.n AS usual_hour, x.n AS usual_day, rn FROM b JOIN (SELECT event_type, median(n) AS n FROM d GROUP BY 1) x USING (event_type) WHERE rn <= 3"""
)
def behaviour_median_hours(spark, sf_dir):
    return measures.busiest_hours(table(spark, sf_dir, "events"), "event_type", "ts", 3)


@query(
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1997-06-01') AS reached_first, count(*) FILTER (WHERE s < TIMESTAMP '1997-06-01') AS reached_second,
         round(avg((epoch_us(s) - epoch_us(o_orderdate)) / 1e6 / 86400) FILTER (WHERE o_orderdate < TIMESTAMP '1997-06-01' AND s < TIMESTAMP '1997-06-01'), 4) AS lapse_days,
         count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1997-06-01' AND (s IS NULL OR s >= TIMESTAMP '1997-06-01')) AS waiting
       FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1"""
)
def stage_lapse(spark, sf_dir):
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    df = table(spark, sf_dir, "orders").join(ship, "o_orderkey", "left")
    return groups.stages(df, ["o_orderpriority"], "o_orderdate", "shipped", "1997-06-01").drop("age_days").withColumn("lapse_days", F.round("lapse_days", 4))


@query("SELECT l_returnflag, count(*) AS n_both, round(sum(l_quantity) / sum(l_linenumber), 6) AS ratio FROM lineitem GROUP BY 1")
def ratio_measure(spark, sf_dir):
    return groups.ratio(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber").withColumn("ratio", F.round("ratio", 6))


@query(
    """WITH long AS (SELECT 'l_linestatus' AS field, l_linestatus AS value, l_returnflag = 'R' AS hit FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, l_returnflag = 'R' FROM lineitem),
       p AS (SELECT field, value, count(*) AS n, count(*) FILTER (WHERE hit) AS n_focus FROM long GROUP BY 1, 2), t AS (SELECT field, sum(n)::BIGINT AS a, sum(n_focus)::BIGINT AS f FROM p GROUP BY 1)
       SELECT field, value, n, n_focus, round(n_focus / f, 6) AS share, round((n_focus / f) / (n / a), 6) AS lift, round(n_focus / f * ln((n_focus / f) / (n / a)), 6) AS score FROM p JOIN t USING (field) WHERE n_focus > 0"""
)
def lift_focus(spark, sf_dir):
    found = groups.lift(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber"], F.col("l_returnflag") == "R")
    return found.select("field", "value", "n", "n_focus", *(F.round(c, 6).alias(c) for c in ("share", "lift", "score")))


# Profiles and keys


@query(
    """WITH long AS (SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
       SELECT c AS "column", count(*) AS n_rows, count(v) AS n_filled, count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS most FROM long GROUP BY 1"""
)
def profile_columns(spark, sf_dir):
    return profiles.profile(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey", "o_orderpriority"])


@query(
    """WITH p AS (SELECT 'l_quantity' AS c, l_quantity::INT::VARCHAR AS v FROM lineitem UNION ALL SELECT 'l_suppkey', l_suppkey::VARCHAR FROM lineitem), g AS (SELECT c, v, count(*) AS n FROM p GROUP BY 1, 2)
       SELECT c AS "column", v, n AS "count", rn FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS rn FROM g) WHERE rn <= 12"""
)
def top_values(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("l_quantity"), "l_suppkey")
    return profiles.top_values(df, ["l_quantity", "l_suppkey"], 12).withColumn("rn", F.col("rn").cast("long"))


@query(
    """SELECT 'c_acctbal' AS "column", min(c_acctbal) AS least, max(c_acctbal) AS most, round(avg(c_acctbal), 4) AS mean, round(sum(c_acctbal), 2) AS total, count(*) FILTER (WHERE c_acctbal IS NULL) AS n_blank FROM customer
       UNION ALL SELECT 'c_nationkey', min(c_nationkey)::DOUBLE, max(c_nationkey)::DOUBLE, round(avg(c_nationkey), 4), round(sum(c_nationkey)::DOUBLE, 2), count(*) FILTER (WHERE c_nationkey IS NULL) FROM customer"""
)
def result_digest(spark, sf_dir):
    return profiles.digest(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"]).withColumns({"mean": F.round("mean", 4), "total": F.round("total", 2)})


@query(
    """WITH a AS (SELECT 'o_custkey' AS "column", count(DISTINCT o_custkey) AS old FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01' UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01'),
       b AS (SELECT 'o_custkey' AS "column", count(DISTINCT o_custkey) AS now FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders)
       SELECT "column", old, now, CASE WHEN old IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN greatest(old, now) >= 2 * least(old, now) AND abs(old - now) >= 10 THEN 'cardinality' ELSE 'same' END AS change FROM a FULL JOIN b USING ("column")"""
)
def change_detection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    early = orders.where(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp_ntz"))
    return profiles.changed(profiles.profile(early, ["o_custkey", "o_orderstatus"]), profiles.profile(orders, ["o_custkey", "o_orderpriority"]))


_KEYS = {"customer.c_nationkey": ("customer", "c_nationkey"), "nation.n_nationkey": ("nation", "n_nationkey"), "nation.n_regionkey": ("nation", "n_regionkey"), "region.r_regionkey": ("region", "r_regionkey"), "orders.o_custkey": ("orders", "o_custkey"), "customer.c_custkey": ("customer", "c_custkey")}


@query(
    "WITH long AS (" + " UNION ".join(f"SELECT DISTINCT '{n}' AS c, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for n, (t, c) in _KEYS.items()) + """), s AS (SELECT c, count(*) AS n FROM long GROUP BY 1),
       p AS (SELECT x.c AS a, y.c AS b, count(*) AS common FROM long x JOIN long y ON x.v = y.v AND x.c < y.c GROUP BY 1, 2)
       SELECT a, b, common, common / least(sa.n, sb.n) AS coverage FROM p JOIN s sa ON sa.c = a JOIN s sb ON sb.c = b WHERE common >= CASE WHEN least(sa.n, sb.n) > 3 THEN 3 ELSE 2 END AND common / least(sa.n, sb.n) >= 0.6"""
)
def value_overlap_joins(spark, sf_dir):
    return profiles.value_overlap({n: table(spark, sf_dir, t).select(c) for n, (t, c) in _KEYS.items()})


@query("SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, max(n) AS most, bool_or(n > 1) AS repeats FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def fanout_probe(spark, sf_dir):
    return profiles.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01')")
def anti_gone(spark, sf_dir):
    """Customers without an urgent order since 1997."""
    seen = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate >= timestamp_ntz'1997-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return profiles.gone(table(spark, sf_dir, "customer").select("c_custkey"), seen, "c_custkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def pair_counts(spark, sf_dir):
    return profiles.seen_together(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    """WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)
       SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.text <> n.text THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n USING (doc_id)"""
)
def sync_delta(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = docs.where("doc_id % 11 != 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return profiles.delta(docs.where("doc_id % 10 != 0"), new, "doc_id", ["text"])


@query("SELECT count(*) AS n_rows, min(ts) AS first_at, max(ts) AS last_at FROM events")
def family_span(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return tables.span(tables.read_family([events.where("user_id % 2 = 0"), events.where("user_id % 2 = 1")]), "ts")


# Joins


@query(
    """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 120000000 WHERE a.event_type = 'click' AND b.event_type = 'view'"""
)
def same_events_tolerance(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    a = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("a"))
    b = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("b"))
    return entities.same_moment(a, b, ["user_id"], "ts", 120_000_000).select("a", "b")


@query(
    """SELECT p.role AS caller, s.role AS callee, count(*) AS calls, round(avg(length(s.text)), 6) AS mean_duration FROM conversations s JOIN conversations p ON p.conv_id = s.conv_id AND p.turn = s.turn - 1 WHERE p.role <> s.role GROUP BY 1, 2"""
)
def span_call_graph(spark, sf_dir):
    spans = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), (F.col("turn") - 1).alias("parent_id"), F.col("role").alias("service"), F.length("text").alias("duration")
    )
    return entities.span_calls(spans).withColumn("mean_duration", F.round("mean_duration", 6))


@query(
    """SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders
       WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) WHERE rn <= 3"""
)
def related_latest(spark, sf_dir):
    focus = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).join(focus, "o_custkey", "left_semi")
    found = series.first_of_each(rows, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)
    return found.select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query(
    """WITH v AS (SELECT DISTINCT lower(split_part(text, ' ', 3)) AS v FROM benchmark), w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS v FROM documents)
       SELECT doc_id, v AS mention FROM w JOIN v USING (v) WHERE v <> ''"""
)
def text_mention(spark, sf_dir):
    values = table(spark, sf_dir, "benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(3))).alias("mention")).distinct().where("mention != ''")
    said = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("mention"))
    return said.join(values, "mention").select("doc_id", "mention")


@query(
    """WITH m AS (SELECT DISTINCT l_linenumber AS n, l_partkey AS m FROM lineitem), s AS (SELECT n, count(*) AS s FROM m GROUP BY 1),
       p AS (SELECT x.n AS a, y.n AS b, count(*) AS common FROM m x JOIN m y ON x.m = y.m AND x.n < y.n GROUP BY 1, 2)
       SELECT a, b, common, round(common / (sa.s + sb.s - common), 6) AS jaccard FROM p JOIN s sa ON sa.n = a JOIN s sb ON sb.n = b WHERE round(common / (sa.s + sb.s - common), 6) >= 0.3"""
)
def shared_members(spark, sf_dir):
    return entities.set_likeness(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_partkey", 0.3)


@query("SELECT o_orderpriority, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_aggregate(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n_lines"), F.countDistinct("o_orderkey").alias("n_orders"), F.sum(_cents("l_extendedprice")).alias("cents"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01' AND (o_orderdate + INTERVAL 30 DAY IS NULL OR o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1996-06-01')")
def active_in_window(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("ended", F.expr("o_orderdate + INTERVAL 30 DAYS"))
    return series.active_between(df, "o_orderdate", "ended", "1996-06-01", "1996-07-01").select("o_orderkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import tidemark.catalog_text  # noqa: F401  these register the rest
    import tidemark.catalog_analysis  # noqa: F401
    import tidemark.catalog_knowledge  # noqa: F401
    import tidemark.catalog_more  # noqa: F401
    import tidemark.catalog_records  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
