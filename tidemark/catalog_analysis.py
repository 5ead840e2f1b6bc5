"""Further queries: typed literals and day periods of plans, what became of groups, log surveys, excerpts and glossaries, chains and inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import _BACK, _CUBE, _back, _plan
from tidemark.catalog_text import _BM25, _INDEX, _Q, _SHAPE, _TRI, _TWO, _asked, _depends, _index, _lines, _lists, _terms_sql
from tidemark.functions import text as T
from tidemark.operators import answers, entities, graphs, groups, logs, search, series
from tidemark.operators.scratch import kept
from tidemark.plans.plan import Cond, Counter, Measure, Plan, Step, run_plan, unit_of
from tidemark.registry import query
from tidemark.sources.tables import table

# Plans


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (37, 40, 43) OR FALSE GROUP BY 1")
def plan_typed_literals(spark, sf_dir):
    """Literals given as text meet a number as numbers."""
    return _plan(spark, sf_dir, Step("q1", "orders", (Measure("n", "count"),), ("o_orderstatus",), (Cond("o_custkey", "in", ["37", "040", "43"]),)))


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 1000) AS large FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-05' AND o_orderdate < TIMESTAMP '1997-03-06' GROUP BY 1")
def plan_day_equality(spark, sf_dir):
    """A time column that equals a day."""
    ms = (Measure("n", "count"), Measure("large", "count", None, (Cond("o_totalprice", ">", "1000"),)))
    return _plan(spark, sf_dir, Step("q1", "orders", ms, ("o_orderpriority",), (Cond("o_orderdate", "=", "1997-03-05"),)))


#: A counter a user and event type that grows by event and begins anew now and then, with the labels of a CPU and of a web server.
_COUNTER = """c AS (SELECT user_id, event_type, event_id, ts, CASE event_type WHEN 'view' THEN 'idle' ELSE event_type END AS mode, ((user_id % 4 + 2) * 100)::INT::VARCHAR AS code,
  ((event_id * 7919) % 1000)::DOUBLE AS value FROM events),
l AS (SELECT *, lag(value) OVER w AS before, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM c WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, value)),
s AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS increase FROM l),
g AS (SELECT *, CASE WHEN gap > 0 THEN increase / (gap / 1e6) END AS rate FROM s)"""
_OF_EVENTS = Counter(("user_id", "event_type"))


def _counter(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_type") == "view", "idle").otherwise(F.col("event_type"))
    code = ((F.col("user_id") % 4 + 2) * 100).cast("int").cast("string")
    return df.select("user_id", "event_type", "ts", mode.alias("mode"), code.alias("code"), ((F.col("event_id") * 7919) % 1000).cast("double").alias("value"))


@query("WITH " + _COUNTER + """ SELECT user_id % 10 AS team, round(100 * sum(rate) FILTER (mode <> 'idle') / sum(rate), 6) AS busy,
       round(100 - 100 * coalesce(sum(increase) FILTER (code LIKE '5%'), 0) / sum(increase), 6) AS available FROM g GROUP BY 1""")
def plan_formulas(spark, sf_dir):
    """Both surveyed formulas over the rates and increases of a counter."""
    df = _counter(spark, sf_dir).withColumn("team", F.col("user_id") % 10)
    ms = (Measure("busy", "formula", formula="cpu_busy_pct"), Measure("available", "formula", formula="availability_pct"))
    found = run_plan(Plan((Step("q1", "t", ms, ("team",), time_field="ts", counter=_OF_EVENTS),)), {"t": df})["q1"]
    return found.select("team", F.round("busy", 6).alias("busy"), F.round("available", 6).alias("available"))


@query("WITH " + _COUNTER + """ SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, mode, sum(increase) AS grown, round(sum(rate), 6) AS rate, round(100 * sum(increase) FILTER (code = '500') / sum(increase), 6) AS failing,
       max(value) FILTER (value < 900) AS top FROM g WHERE code IN ('300', '400', '500') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND value <> 13 GROUP BY 1, 2""")
def plan_counter_measures(spark, sf_dir):
    """Increase, rate and a share over increases, by day of a period: a label's condition chooses series, a value's chooses samples."""
    ms = (
        Measure("grown", "increase"), Measure("rate", "rate"), Measure("failing", "share", where=(Cond("code", "=", "500"),)),
        Measure("top", "max", "value", where=(Cond("value", "<", 900),)),
    )
    counter = Counter(("user_id", "event_type", "code"))
    where = (Cond("code", "in", ["300", "400", "500"]), Cond("value", "!=", 13))
    step = Step("q1", "t", ms, ("mode",), where, time_field="ts", period=("2024-01-10", "2024-01-20"), bucket="day", counter=counter)
    found = run_plan(Plan((step,)), {"t": _counter(spark, sf_dir)})["q1"]
    return found.withColumns({c: F.round(c, 6) for c in ("rate", "failing")})


@query(
    """WITH le AS (SELECT unnest(['10', '25', '50', '75', '100', '+Inf']) AS le, unnest([10, 25, 50, 75, 100, 1e300]) AS top),
       d AS (SELECT event_type, le, date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (value <= top) AS n FROM events, le GROUP BY ALL),
       c AS (SELECT event_type, le, day, sum(n) OVER (PARTITION BY event_type, le ORDER BY day)::DOUBLE AS value FROM d),
       r AS (SELECT event_type, le, day, (value - lag(value) OVER w) / (epoch(day) - epoch(lag(day) OVER w)) AS rate FROM c WINDOW w AS (PARTITION BY event_type, le ORDER BY day)),
       h AS (SELECT event_type, CASE le WHEN '+Inf' THEN 'Infinity' ELSE le END::DOUBLE AS le, sum(rate) AS n FROM r WHERE day >= TIMESTAMP '2024-01-05' AND day < TIMESTAMP '2024-01-25' GROUP BY 1, 2),
       w AS (SELECT *, coalesce(lag(le) OVER p, 0) AS low, coalesce(lag(n) OVER p, 0) AS below, max(n) OVER (PARTITION BY event_type) AS total FROM h WINDOW p AS (PARTITION BY event_type ORDER BY le)),
       f AS (SELECT q, event_type, arg_min({'low': low, 'le': le, 'below': below, 'n': n, 'total': total}, le) AS b FROM w, (SELECT unnest([0.5, 0.9]) AS q) WHERE n >= q * total GROUP BY 1, 2),
       v AS (SELECT q, event_type, round(CASE WHEN b.le = 'Infinity' THEN b.low ELSE b.low + (b.le - b.low) * ((q * b.total - b.below) / (b.n - b.below)) END, 6) AS v FROM f)
       SELECT event_type, max(v) FILTER (q = 0.5) AS middle, max(v) FILTER (q = 0.9) * 1000 AS high FROM v GROUP BY 1"""
)
def plan_counter_quantile(spark, sf_dir):
    """Quantiles of a histogram kept as counters, one a bound: rates summed by bound, one quantile in another unit."""
    bounds = F.inline(F.array(*(F.struct(F.lit(x).alias("le"), F.lit(float(x.replace("+Inf", "inf"))).alias("top")) for x in ("10", "25", "50", "75", "100", "+Inf"))))
    days = table(spark, sf_dir, "events").select("event_type", "value", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at"), bounds)
    days = days.groupBy("event_type", "le", "at").agg(F.count_if(F.col("value") <= F.col("top")).alias("n"))
    df = days.select("event_type", "le", "at", F.sum("n").over(Window.partitionBy("event_type", "le").orderBy("at")).cast("double").alias("value"))
    ms = (Measure("middle", "quantile", q=0.5), Measure("high", "quantile", q=0.9, unit=("s", "ms")))
    step = Step("q1", "t", ms, ("event_type",), time_field="at", period=("2024-01-05", "2024-01-25"), counter=Counter(("event_type", "le")))
    return run_plan(Plan((step,)), {"t": df})["q1"].select("event_type", F.round("middle", 6).alias("middle"), (F.round(F.col("high") / 1000, 6) * 1000).alias("high"))


@query("SELECT event_type, round(max(value) / 1000, 9) AS longest_s FROM events GROUP BY 1")
def plan_unit_by_name(spark, sf_dir):
    """A unit read off the column's name."""
    df = table(spark, sf_dir, "events").withColumnRenamed("value", "took_ms")
    from tidemark.plans.plan import compile_step

    step = Step("q1", "events", (Measure("longest_s", "max", "took_ms", unit=(unit_of("took_ms"), "s")),), ("event_type",))
    return compile_step(step, df).withColumn("longest_s", F.round("longest_s", 9))


# Groups


def _days(spark, sf_dir, n=8):
    return _back(spark, sf_dir, "2024-01-20", "2024-01-21", "day", n)


_DAYS = _BACK.format(start="2024-01-20", end="2024-01-21", size=86400, n=8)


@query("WITH " + _DAYS + ", p AS (SELECT k, count(*) AS n FROM cells WHERE k > 0 AND user_id % 5 = 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY k) AS place FROM p) SELECT k, n, place FROM r WHERE place <= 5")
def earlier_windows(spark, sf_dir):
    """The five nearest earlier days with rows of some users."""
    return groups.filled_windows(_days(spark, sf_dir).where("user_id % 5 = 0"), 5)


_SUMMARY = "WITH " + _DAYS + """,
 long AS (SELECT k, '' AS field, '' AS value, value AS m FROM cells UNION ALL SELECT k, 'event_type', event_type, value FROM cells UNION ALL SELECT k, 'user_id', user_id::VARCHAR, value FROM cells),
 per AS (SELECT k, field, value, count(*)::DOUBLE AS n, avg(m) AS m FROM long GROUP BY ALL),
 grid AS (SELECT field, value, k FROM (SELECT DISTINCT field, value FROM per), (SELECT DISTINCT k FROM cells)),
 f AS (SELECT g.field, g.value, g.k, coalesce(n, 0) AS n, m FROM grid g LEFT JOIN per USING (k, field, value)),
 mid AS (SELECT field, value, coalesce(max(n) FILTER (WHERE k = 0), 0) AS now, median(n) FILTER (WHERE k > 0) AS usual, count(*) FILTER (WHERE k > 0) AS windows, max(m) FILTER (WHERE k = 0) AS m_now,
   median(m) FILTER (WHERE k > 0 AND n >= 3) AS m_usual, count(*) FILTER (WHERE k > 0 AND n >= 3) AS m_windows FROM f GROUP BY 1, 2),
 sp AS (SELECT f.field, f.value, median(abs(n - usual)) AS mad FROM f JOIN mid USING (field, value) WHERE k > 0 GROUP BY 1, 2),
 x AS (SELECT *, abs(now - usual) AS off, greatest(3, 0.02 * (SELECT greatest(now, usual) FROM mid WHERE field = '')) AS floor_, coalesce(windows >= 5 AND mad <= 0.1 * usual, FALSE) AS steady FROM mid LEFT JOIN sp USING (field, value))
 SELECT field, value, now, usual, round(m_now, 6) AS m_now, round(m_usual, 6) AS m_usual, steady, CASE WHEN usual = 0 AND now >= 5 THEN 'appeared' WHEN now = 0 AND usual >= floor_ THEN 'gone'
   WHEN usual > 0 AND (now / usual >= 1.3 OR now / usual <= 0.77) AND off >= floor_ AND off > 3 * mad AND (steady OR off > 3 * sqrt(greatest(usual, 1))) THEN 'off'
   WHEN now >= 3 AND m_windows >= 3 AND (m_now / m_usual >= 1.3 OR m_now / m_usual <= 0.77) THEN 'moved' ELSE 'usual' END AS what FROM x"""


@query(_SUMMARY)
def group_summary(spark, sf_dir):
    """Counts and mean values of every event type and user against eight earlier days."""
    tagged = _days(spark, sf_dir)
    found = groups.summarize(groups.cube(tagged, ["event_type", "user_id"], "value"), tagged.select("k").distinct())
    return found.withColumns({"m_now": F.round("m_now", 6), "m_usual": F.round("m_usual", 6)})


#: The errors of the day five times over, so that something stands out at every size.
_EV = "ev AS (SELECT * FROM events UNION ALL SELECT e.* FROM events e, (SELECT unnest(range(4))) WHERE event_type = 'error' AND ts::DATE = DATE '2024-01-20')"


def _with_errors(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    again = events.where((F.col("event_type") == "error") & (F.to_date("ts") == F.lit("2024-01-20").cast("date")))
    return events.unionByName(again.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i")).drop("i"))


@query(
    _CUBE.replace("FROM events)", "FROM ev)").replace("WITH ", f"WITH {_EV}, ", 1)
    + """, l AS (SELECT field, count(*) FILTER (WHERE unusual) AS n_unusual, sum(now - usual) FILTER (WHERE unusual) / (SELECT nullif(now - usual, 0) FROM found WHERE field = '') AS coverage,
       sum(abs(now - usual)) FILTER (WHERE unusual) / sum(abs(now - usual)) AS purity FROM found WHERE field <> '' GROUP BY 1)
     SELECT *, row_number() OVER (ORDER BY coverage DESC, purity DESC, n_unusual, field) AS place FROM l WHERE n_unusual > 0"""
)
def rank_localizing(spark, sf_dir):
    """Fields by how well their values hold a planted rise of errors."""
    tagged = series.windows_back(_with_errors(spark, sf_dir), "ts", "2024-01-20", "2024-01-21", "day", 8)
    return groups.rank_fields(groups.compare(groups.cube(tagged, ["event_type", "user_id"]), tagged.select("k").distinct()))


@query(
    "WITH " + _DAYS + """, i AS (SELECT DISTINCT user_id FROM cells WHERE k = 0 AND event_type = 'error'), g AS (SELECT user_id, k FROM i, (SELECT DISTINCT k FROM cells)),
     p AS (SELECT user_id, k, count(*)::DOUBLE AS n FROM cells WHERE event_type <> 'error' GROUP BY 1, 2), f AS (SELECT user_id, k, coalesce(n, 0) AS n FROM g LEFT JOIN p USING (user_id, k))
     SELECT user_id, max(n) FILTER (WHERE k = 0) AS now, median(n) FILTER (WHERE k > 0) AS usual FROM f GROUP BY 1"""
)
def others_usual(spark, sf_dir):
    """Users with errors today: their other events, now and usually."""
    return groups.others(_days(spark, sf_dir), F.col("event_type") == "error", "user_id")


@query(
    "WITH " + _DAYS + """, long AS (SELECT k, '' AS field, '' AS v, value FROM cells UNION ALL SELECT k, 'event_type', event_type, value FROM cells UNION ALL SELECT k, 'user_id', user_id::VARCHAR, value FROM cells),
     a AS (SELECT k, field, v, count(*)::DOUBLE AS rows_, max(value) AS highest FROM long GROUP BY ALL), m AS (SELECT 'rows' AS measure, field, v, k, rows_ AS x FROM a UNION ALL SELECT 'highest', field, v, k, highest FROM a),
     p AS (SELECT measure, field, v AS value, max(x) FILTER (WHERE k = 0) AS now, median(x) FILTER (WHERE k > 0) AS usual FROM m GROUP BY 1, 2, 3), r AS (SELECT *, round(now / nullif(usual, 0), 6) AS ratio FROM p)
     SELECT *, TRUE AS off, row_number() OVER (PARTITION BY measure ORDER BY round(abs(ln(ratio)), 6) DESC, field, value) AS place FROM r WHERE ratio >= 1.3 OR ratio <= 0.77"""
)
def measure_survey(spark, sf_dir):
    """Which measures of which event types and users are off."""
    return groups.survey(_days(spark, sf_dir), ["event_type", "user_id"], {"rows": F.count("*"), "highest": F.max("value")})


@query(
    """WITH s AS (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1), t AS (SELECT *, CAST(ceil((epoch_us(TIMESTAMP '1997-06-08') - epoch_us(o_orderdate)) / (604800 * 1e6)) - 1 AS INT) AS k FROM orders JOIN s ON l_orderkey = o_orderkey)
       SELECT k, count(*) AS n, count(*) FILTER (WHERE shipped < TIMESTAMP '1997-06-20' - to_days(7 * k)) AS shipped_by FROM t WHERE k BETWEEN 0 AND 4 GROUP BY 1"""
)
def scope_moves(spark, sf_dir):
    """Orders of a week and of the weeks before, shipped by a day that moves back with the week."""
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    tagged = series.windows_back(table(spark, sf_dir, "orders").join(ship, "o_orderkey"), "o_orderdate", "1997-06-01", "1997-06-08", "week", 4)
    return tagged.groupBy("k").agg(F.count("*").alias("n"), F.count_if(groups.moved("shipped", "1997-06-20", 7 * F.col("k"))).alias("shipped_by"))


# Series


@query(
    "WITH " + _DAYS + """, p AS (SELECT event_type, k, count(*) FILTER (WHERE value <= 60) / count(*) AS level FROM cells GROUP BY 1, 2), b AS (SELECT event_type, max(level) FILTER (WHERE k = 0) AS now, median(level) FILTER (WHERE k > 0) AS usual FROM p GROUP BY 1)
     SELECT event_type, round(now, 9) AS now, round(usual, 9) AS usual, CASE WHEN now IS NULL THEN 'silent' WHEN usual IS NULL THEN 'unknown' WHEN now < usual - 0.05 THEN 'worse' WHEN now > usual + 0.05 THEN 'better' ELSE 'usual' END AS verdict FROM b"""
)
def usual_health(spark, sf_dir):
    found = series.health(_days(spark, sf_dir), ["event_type"], "value", 60.0)
    return found.withColumns({"now": F.round("now", 9), "usual": F.round("usual", 9)})


@query(
    """SELECT event_id, round(avg(value) OVER w, 6) AS avg_over, round(quantile_cont(value, 0.9) OVER w, 6) AS quantile_over FROM events
       WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW)"""
)
def quantile_over_time(spark, sf_dir):
    found = series.quantile_over_time(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "value", 12 * 3600, 0.9)
    return found.select("event_id", F.round("avg_over", 6).alias("avg_over"), F.round("quantile_over", 6).alias("quantile_over"))


@query(
    """WITH p AS (SELECT event_type, user_id, count(*) AS n, max(ts)::DATE AS last_seen FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, user_id LIMIT 20)
       SELECT *, last_seen < DATE '2024-01-29' AS stale, row_number() OVER (ORDER BY n DESC, event_type, user_id) AS place FROM p"""
)
def stale_series(spark, sf_dir):
    return series.stale(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "2024-01-29")


@query("WITH p AS (SELECT event_type, user_id, round(sum(abs(value)), 4) AS total FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, user_id) AS place FROM p) SELECT * FROM r WHERE place <= 3")
def top_series(spark, sf_dir):
    return series.top_series(table(spark, sf_dir, "events"), "event_type", "user_id", "value", 3)


# Logs

_JOB = "'job ''' || event_type || ''' step ''' || CASE WHEN event_id % 10 = 0 THEN 'other' ELSE 'load' END || ''' took ' || event_id || ' ms'"


def _job_lines(spark, sf_dir):
    step = F.when(F.col("event_id") % 10 == 0, "other").otherwise("load")
    message = F.concat(F.lit("job '"), "event_type", F.lit("' step '"), step, F.lit("' took "), F.col("event_id").cast("string"), F.lit(" ms"))
    return table(spark, sf_dir, "events").select("ts", "event_type", "user_id", message.alias("message")).withColumn("template", logs.template(F.col("message")))


@query(
    f"""WITH l AS (SELECT {_SHAPE} AS template, m FROM (SELECT {_JOB} AS m FROM events)), t AS (SELECT template, count(*) AS lines FROM l GROUP BY 1),
        n AS (SELECT template, unnest(regexp_extract_all(m, '''([^'']*)''', 1)) AS name, unnest(range(0, len(regexp_extract_all(m, '''([^'']*)''', 1)))) AS place FROM l), p AS (SELECT template, place, name, count(*) AS n FROM n GROUP BY 1, 2, 3)
        SELECT template, place::INT AS place, name, round(n / lines, 6) AS share FROM p JOIN t USING (template) WHERE n >= 0.8 * lines"""
)
def names_written_back(spark, sf_dir):
    return logs.written_back(_job_lines(spark, sf_dir))


@query(
    f"""WITH l AS (SELECT DISTINCT {_SHAPE} AS template FROM (SELECT {_JOB} AS m FROM events)), p AS (SELECT template, trim(unnest(string_split_regex(template, '#|''<value>''|<name>'))) AS t FROM l),
        b AS (SELECT template, arg_min(t, (-length(t), t)) AS t FROM p GROUP BY 1) SELECT template, CASE WHEN length(t) >= 12 THEN t END AS fragment FROM b"""
)
def log_fragments(spark, sf_dir):
    """The longest literal piece of each template."""
    return _job_lines(spark, sf_dir).select("template").distinct().select("template", logs.longest_piece(F.col("template")).alias("fragment"))


@query(
    f"""WITH l AS (SELECT event_type, user_id, {_SHAPE} AS template FROM (SELECT *, {_JOB} AS m FROM events)), x AS (SELECT template, 'event_type' AS field, event_type AS v FROM l UNION ALL SELECT template, 'user_id', user_id::VARCHAR FROM l),
        p AS (SELECT template, field, v, count(*) AS n FROM x GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY template, field ORDER BY n DESC, v) AS rank FROM p)
        SELECT template, field, count(*) AS n_values, string_agg(v, ', ' ORDER BY rank) FILTER (WHERE rank <= 4) AS top, round(sum(n) FILTER (WHERE rank <= 4) / sum(n), 6)::DOUBLE AS coverage FROM r GROUP BY 1, 2"""
)
def log_origins(spark, sf_dir):
    return logs.origins(_job_lines(spark, sf_dir), ["event_type", "user_id"])


def _log_survey_sql() -> str:
    from tidemark.registry import SQL

    judged = SQL["log_verdicts"].replace("FROM events)", "FROM ev)")
    return f"""WITH {_EV}, v AS ({judged}), r AS (SELECT *, row_number() OVER (ORDER BY CASE level WHEN 'error' THEN 4 ELSE 2 END DESC, now DESC, template) AS place FROM v WHERE verdict <> 'as usual')
       SELECT place, template, level, now, usual, verdict FROM r WHERE place <= 12"""


@query(_log_survey_sql())
def log_survey(spark, sf_dir):
    """What to tell of the lines of a day with a planted rise of errors."""
    k = F.datediff(F.lit("2024-01-20").cast("date"), F.to_date("ts"))
    lines = _lines(spark, sf_dir, _with_errors(spark, sf_dir)).withColumn("k", k).where("k between 0 and 7")
    counts = lines.groupBy(logs.template(F.col("message")).alias("template"), logs.level(F.col("message")).alias("level"), "k").agg(F.count("*").alias("n"))
    return logs.survey(logs.judge(counts, 7))


@query(
    """WITH l AS (SELECT 'svc-' || event_type AS src, CASE user_id % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'waits for' ELSE 'reads from' END AS said, CASE WHEN user_id % 4 = 0 THEN 'nowhere' ELSE 'svc-' || CASE event_type WHEN 'click' THEN 'view' ELSE 'click' END END AS dst FROM events),
       k AS (SELECT DISTINCT 'svc-' || event_type AS name FROM events)
       SELECT src, CASE said WHEN 'calls' THEN 'calls' WHEN 'waits for' THEN 'waits' ELSE 'reads' END AS kind, dst, count(*) AS n FROM l WHERE src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k) GROUP BY 1, 2, 3"""
)
def stated_interactions(spark, sf_dir):
    """What lines say that one service does with another; names that are no service go."""
    u, service = F.col("user_id"), F.concat(F.lit("svc-"), "event_type")
    verb = F.when(u % 3 == 0, "calls").when(u % 3 == 1, "waits for").otherwise("reads from")
    other = F.when(u % 4 == 0, "nowhere").otherwise(F.concat(F.lit("svc-"), F.when(F.col("event_type") == "click", "view").otherwise("click")))
    events = table(spark, sf_dir, "events")
    return logs.stated_links(events.select(F.concat(F.lit("at 10:00 "), service, F.lit(" "), verb, F.lit(" "), other).alias("message")), events.select(service.alias("name")))


# Search


@query(
    f"""WITH {_Q}, w AS (SELECT doc_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS start FROM (SELECT doc_id, {_terms_sql('text')} AS ts FROM documents)), h AS (SELECT query_id, doc_id, start FROM w JOIN q USING (term)),
        c AS (SELECT query_id, doc_id, start, count(*) OVER (PARTITION BY query_id, doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING) AS hits FROM h)
        SELECT query_id, doc_id, arg_min(start, (-hits, start))::INT AS start, max(hits) AS hits FROM c GROUP BY 1, 2"""
)
def best_excerpts(spark, sf_dir):
    return search.excerpts(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _asked(spark, sf_dir))


@query(
    f"""WITH {_TWO}, x AS (SELECT a.query_id, a.doc_id, a.rn, row_number() OVER (PARTITION BY a.query_id ORDER BY n_chars DESC, doc_id) AS again FROM a JOIN documents USING (doc_id))
        SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rn) + 1.0::DOUBLE / (60 + again), 9) AS score FROM x"""
)
def rerank_fused(spark, sf_dir):
    """The best twenty by words, fused with the order a second scorer gives them."""
    best, _ = _lists(spark, sf_dir)
    return search.reranked(best.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"), "doc_id", "n_chars")


_BOTH_Q = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({_terms_sql('text')}) AS term FROM benchmark WHERE item_id % 50 = 0 UNION SELECT -1 - item_id, unnest({_terms_sql('text')}[:2]) FROM benchmark WHERE item_id % 50 = 0)"""


@query(
    f"""WITH {_TWO.replace(_Q, _BOTH_Q)}, kind AS (SELECT query_id, count(*) >= 5 AS long FROM q GROUP BY 1), s AS (SELECT query_id, doc_id, 0.7 * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM a WINDOW w AS (PARTITION BY query_id)
        UNION ALL SELECT query_id, doc_id, 0.3 * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END FROM bb WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, doc_id, round(sum(s), 6) AS score, 'score' AS how FROM s JOIN kind USING (query_id) WHERE NOT long GROUP BY 1, 2
        UNION ALL SELECT query_id, doc_id, round(sum(s), 9), 'rank' FROM (SELECT query_id, doc_id, 0.7::DOUBLE / (60 + rn) AS s FROM a UNION ALL SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rn) FROM bb) JOIN kind USING (query_id) WHERE long GROUP BY 1, 2"""
)
def mixed_fusion(spark, sf_dir):
    """Sentences fused by rank, their first two words as keywords by score."""
    b = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", T.terms(F.col("text")).alias("ts"))
    asked = b.select(F.col("item_id").alias("query_id"), F.explode("ts").alias("term")).unionByName(b.select((-1 - F.col("item_id")).alias("query_id"), F.explode(F.slice("ts", 1, 2)).alias("term"))).distinct()
    index = kept(_index(spark, sf_dir))
    count = index.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum("tf").cast("double").alias("score"))
    lists = [(search.bm25(index, "doc_id", asked, 20), 0.7), (series.first_of_each(count, ["query_id"], [F.desc("score"), F.asc("doc_id")], 20), 0.3)]
    return search.mixed(lists, "doc_id", asked)


@query(
    f"""WITH {_BM25}, v AS (SELECT DISTINCT term, 1 AS known FROM idx), p AS (SELECT query_id, count(*) AS n_terms, count(*) FILTER (WHERE known IS NULL) AS n_unknown FROM q LEFT JOIN v USING (term) GROUP BY 1), b AS (SELECT query_id, max(score) AS best FROM top WHERE rn <= 10 GROUP BY 1)
        SELECT query_id, n_terms, n_unknown, best, 2 * n_unknown >= n_terms OR coalesce(best, 0) < 5 AS weak FROM p LEFT JOIN b USING (query_id)"""
)
def weak_searches(spark, sf_dir):
    index, asked = kept(_index(spark, sf_dir)), _asked(spark, sf_dir)
    return search.weak(asked, search.vocabulary(index), search.bm25(index, "doc_id", asked, 10), 5.0)


_ASKED_VALUES = """q AS (SELECT c_custkey, list_filter(string_split(regexp_replace(lower('show ' || c_mktsegment || ' orders of ' || n_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM customer JOIN nation ON n_nationkey = c_nationkey),
 v AS (SELECT DISTINCT 'n_name' AS field, n_name AS value, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS run FROM nation UNION SELECT DISTINCT 'c_mktsegment', c_mktsegment, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')) FROM customer),
 r AS (SELECT c_custkey, i AS place, n AS n_words, array_to_string(ws[i : i + n - 1], ' ') AS run FROM q, (SELECT unnest(range(1, 12)) AS i), (SELECT unnest(range(1, 6)) AS n) WHERE i + n - 1 <= len(ws)),
 f AS (SELECT c_custkey, place, n_words, value, field FROM r JOIN v USING (run)),
 t AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.c_custkey = a.c_custkey AND b.n_words > a.n_words AND b.place <= a.place AND b.place + b.n_words >= a.place + a.n_words))"""


def _named(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    values = nation.select(F.lit("n_name").alias("field"), F.col("n_name").alias("value")).unionByName(customer.select(F.lit("c_mktsegment").alias("field"), F.col("c_mktsegment").alias("value")))
    asked = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return asked, search.value_places(asked, "c_custkey", F.concat(F.lit("show "), "c_mktsegment", F.lit(" orders of "), "n_name"), values)


@query(f"WITH {_ASKED_VALUES} SELECT c_custkey, place::INT AS place, n_words::INT AS n_words, value, field FROM t")
def value_places(spark, sf_dir):
    """Values that questions name, longest runs of words first."""
    return _named(spark, sf_dir)[1]


@query(f"WITH {_ASKED_VALUES} SELECT c_custkey, field, value FROM t JOIN customer USING (c_custkey) WHERE NOT (field = 'c_mktsegment' AND value = c_mktsegment)")
def values_left_out(spark, sf_dir):
    """Values that a question names and that its query, which filters by segment only, does not use."""
    asked, found = _named(spark, sf_dir)
    used = asked.select("c_custkey", F.lit("c_mktsegment").alias("field"), F.col("c_mktsegment").alias("value"))
    return found.select("c_custkey", "field", "value").join(used, ["c_custkey", "field", "value"], "left_anti")


@query(
    f"""WITH n AS (SELECT DISTINCT p_name AS name, {_TRI.format('p_name')} AS a FROM part), t AS (SELECT DISTINCT unnest(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM part), k AS (SELECT token, {_TRI.format('token')} AS b FROM t WHERE token <> ''),
        s AS (SELECT token, name, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS score FROM n, k), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, name) AS rn FROM s WHERE score >= 0.3) SELECT token, name, score, rn FROM r WHERE rn <= 3"""
)
def names_per_token(spark, sf_dir):
    """The three names most like each word of any name."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    tokens = names.select(F.explode(T.words(F.col("name"))).alias("token")).distinct()
    return search.similar_per_token(tokens, names, 3)


@query(
    f"""WITH s AS (SELECT s_suppkey, s_name, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g'), '(^|[a-z])0+([0-9])', '\\1\\2', 'g') AS key, {_TRI.format('s_name')} AS a FROM supplier),
        q AS (SELECT DISTINCT 'supplier-' || s_nationkey AS asked, regexp_replace('supplier' || s_nationkey, '(^|[a-z])0+([0-9])', '\\1\\2', 'g') AS key, {_TRI.format("('supplier-' || s_nationkey)")} AS b FROM supplier)
        SELECT asked, s_name AS name, 'identifier' AS how FROM q JOIN s USING (key)
        UNION ALL SELECT asked, s_name, 'name' FROM q, s WHERE round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) >= 0.5"""
)
def near_matches(spark, sf_dir):
    """Near matches of what was asked by identifier and by name, one list after the other."""
    supplier = table(spark, sf_dir, "supplier")
    asked = supplier.select(F.concat(F.lit("supplier-"), "s_nationkey").alias("token")).distinct()
    by_key = asked.withColumn("key", T.loose_key(F.col("token"))).join(supplier.withColumn("key", T.loose_key(F.col("s_name"))), "key")
    by_name = search.similar_per_token(asked, supplier.select(F.col("s_name").alias("name")).distinct(), 1 << 30, 0.5)
    first = by_key.select(F.col("token").alias("asked"), F.col("s_name").alias("name"), F.lit("identifier").alias("how"))
    return first.unionByName(by_name.select(F.col("token").alias("asked"), "name", F.lit("name").alias("how")))


_NORM = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))"


@query(f"WITH g AS (SELECT DISTINCT p_type AS term, {_NORM.format('p_type')} AS ws FROM part), q AS (SELECT DISTINCT p_type || ' and ' || p_name AS question, {_NORM.format('(p_type || chr(32) || p_name)')} AS qs FROM part) SELECT question, term FROM q, g WHERE list_has_all(qs || ['and'], ws)")
def glossary_terms(spark, sf_dir):
    """Glossary terms whose words a question holds."""
    part = table(spark, sf_dir, "part")
    asked = part.select(F.concat("p_type", F.lit(" and "), "p_name").alias("question")).distinct()
    return search.glossary_terms(asked, "question", F.col("question"), part.select(F.col("p_type").alias("term")).distinct())


@query(f"WITH t AS (SELECT DISTINCT p_type || ' ' || p_brand AS title FROM part), w AS (SELECT title, {_NORM.format('title')} AS ws FROM t) SELECT a.title AS a, b.title AS b, len(list_intersect(a.ws, b.ws))::BIGINT AS shared FROM w a JOIN w b ON a.title < b.title WHERE len(list_intersect(a.ws, b.ws)) >= 2")
def similar_panels(spark, sf_dir):
    """Titles that share two words or more."""
    return search.titles_alike(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("title")).distinct())


@query("WITH n AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id WHERE v.label IN (0, 2, 4)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM n) SELECT query_id, vec_id, score, rn FROM r WHERE rn <= 5")
def masked_nearest(spark, sf_dir):
    """The nearest vectors that the asker may see."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.nearest(v.where(F.col("label").isin(0, 2, 4)), "vec_id", "embedding", asked, 5).withColumn("rn", F.col("rn").cast("long"))


@query("SELECT c_nationkey AS key, 'customer' AS who FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier UNION SELECT n_nationkey, 'nation' FROM nation")
def union_statement(spark, sf_dir):
    parts = (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))
    first, *rest = (table(spark, sf_dir, t).select(F.col(c).alias("key"), F.lit(t).alias("who")) for t, c in parts)
    for df in rest:
        first = first.unionByName(df)
    return first.distinct()


# Names and graphs


@query("""WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
       h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 'n1'), h2 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (SELECT node FROM h1) AND dst <> 'n1' AND dst NOT IN (SELECT node FROM h1))
       SELECT 'n1' AS origin, 'n1' AS node, 0 AS hops UNION ALL SELECT 'n1', node, 1 FROM h1 UNION ALL SELECT 'n1', node, 2 FROM h2""")
def within_hops(spark, sf_dir):
    """What lies within two hops of a part, in either direction."""
    return entities.within_hops(_depends(spark, sf_dir), spark.createDataFrame([("n1",)], "node string"), 2)


@query("""WITH n AS (SELECT 'n' || n_nationkey AS n, 'r' || n_regionkey AS r FROM nation), c AS (SELECT 'c' || c_custkey AS c, 'n' || c_nationkey AS n FROM customer)
       SELECT 'back' AS direction, 'r2>' || n AS path FROM n WHERE r = 'r2' UNION ALL SELECT 'back', 'r2>' || n.n || '>' || c FROM n JOIN c ON c.n = n.n WHERE r = 'r2'
       UNION ALL SELECT 'forward', 'c7>' || n FROM c WHERE c = 'c7' UNION ALL SELECT 'forward', 'c7>' || c.n || '>' || r FROM c JOIN n ON c.n = n.n WHERE c = 'c7'""")
def dependency_chains(spark, sf_dir):
    found = entities.chains(_depends(spark, sf_dir), spark.createDataFrame([("r2",), ("c7",)], "node string"), 2)
    return found.select("direction", F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_name AS a, p_brand AS b FROM part UNION SELECT DISTINCT p_name, 'size ' || p_size FROM part WHERE p_size > 45), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
       r(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n) SELECT n AS name, min(m) AS "group" FROM r GROUP BY 1""")
def alias_groups(spark, sf_dir):
    """Names that inventory rows hold together, by any of their aliases."""
    part = table(spark, sf_dir, "part").withColumn("large", F.when(F.col("p_size") > 45, F.concat(F.lit("size "), "p_size")))
    return entities.alias_groups(part, "p_name", ["p_brand", "large"])


_CORE = "replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), '(^| )(prod|production|preprod|dev|test|uat|qa|staging|int)( |$)', ' ', 'g')), '( v?[0-9]+)+$', '')), ' ', '')"


@query(
    f"""WITH p AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN p_name || ' test' WHEN p_partkey % 4 = 2 THEN p_name || ' v2' ELSE p_name END AS name FROM part), n AS (SELECT name, count(*) AS n FROM p GROUP BY 1),
        k AS (SELECT *, concat_ws('#', {_CORE}, array_to_string(regexp_extract_all(name, '([0-9]+)', 1), '.')) AS "group" FROM n), c AS (SELECT "group", arg_min(name, (-n, length(name), name)) AS canonical FROM k GROUP BY 1) SELECT name, "group", canonical FROM k JOIN c USING ("group")"""
)
def canonical_names(spark, sf_dir):
    """Spellings of one name; a version keeps names apart, an environment does not."""
    name, key = F.col("p_name"), F.col("p_partkey") % 4
    spelt = F.when(key == 0, F.upper(name)).when(key == 1, F.concat(name, F.lit(" test"))).when(key == 2, F.concat(name, F.lit(" v2"))).otherwise(name)
    return entities.name_groups(table(spark, sf_dir, "part").select(spelt.alias("name")), "name")


_RELATED = {"customer.c_nationkey": ("customer", "c_nationkey"), "supplier.s_nationkey": ("supplier", "s_nationkey"), "orders.o_custkey": ("orders", "o_custkey"), "lineitem.l_partkey": ("lineitem", "l_partkey"), "lineitem.l_linenumber": ("lineitem", "l_linenumber"), "nation.n_regionkey": ("nation", "n_regionkey")}
_TARGETS = {"nation": ("nation", "n_nationkey"), "customer": ("customer", "c_custkey"), "part": ("part", "p_partkey"), "region": ("region", "r_regionkey")}


def _columns(spark, sf_dir, which):
    return {name: table(spark, sf_dir, t).select(c) for name, (t, c) in which.items()}


def _stacked_sql(which: dict, label: str) -> str:
    return " UNION ".join(f"SELECT '{n}' AS {label}, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for n, (t, c) in which.items())


@query(f"WITH f AS ({_stacked_sql(_RELATED, 'field')}), t AS ({_stacked_sql(_TARGETS, 'target')}), s AS (SELECT field, count(*) AS size FROM f GROUP BY 1), h AS (SELECT field, target, count(*) AS held FROM f JOIN t USING (v) GROUP BY 1, 2) SELECT field, target, round(held / size, 6) AS share FROM h JOIN s USING (field) WHERE round(held / size, 6) >= 0.5")
def inventory_relations(spark, sf_dir):
    """Fields that name rows of another table."""
    return entities.relations(_columns(spark, sf_dir, _RELATED), _columns(spark, sf_dir, _TARGETS))


@query(f"WITH f AS ({_stacked_sql(_RELATED, 'field')}), c AS (SELECT DISTINCT n_nationkey::VARCHAR AS v, 1 AS hit FROM nation), p AS (SELECT field, count(hit) AS held, count(*) AS own FROM f LEFT JOIN c USING (v) GROUP BY 1), r AS (SELECT field, held, round(held / (SELECT count(*) FROM c), 6) AS of_category, round(held / own, 6) AS of_field FROM p) SELECT * FROM r WHERE held >= 3 AND of_category >= 0.5 AND of_field >= 0.6")
def category_fields(spark, sf_dir):
    """Fields proposed for the category of nations."""
    return entities.category_fields(_columns(spark, sf_dir, _RELATED), table(spark, sf_dir, "nation").select("n_nationkey"))


# Answers


@query(
    rf"""WITH n AS (SELECT doc_id, regexp_extract_all(lower(text), '{answers.NUMBER}', 1) AS x, regexp_extract_all(lower(text), '{answers.NUMBER}', 2) AS u FROM documents), l AS (SELECT doc_id, unnest(range(0, len(x)))::INT AS place, unnest(x)::DOUBLE AS value, coalesce(unnest(u), '') AS unit FROM n)
         SELECT *, value * CASE unit WHEN 'us' THEN 1e-6 WHEN 'ms' THEN 1e-3 WHEN 'min' THEN 60 WHEN 'kb' THEN 1024 WHEN 'mb' THEN 1048576 WHEN 'gb' THEN 1073741824 WHEN 'tb' THEN 1099511627776 ELSE 1 END::DOUBLE AS base FROM l"""
)
def answer_numbers(spark, sf_dir):
    """Every number of every document, with its unit."""
    return answers.numbers(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT event_type, day, n, sum(n) OVER w::BIGINT AS running, round(n / sum(n) OVER (PARTITION BY event_type), 9)::DOUBLE AS share, n - lag(n) OVER w AS difference, round(n / lag(n) OVER w, 9) AS ratio FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)"""
)
def derived_values(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return answers.derived(per, ["event_type"], "day", "n").withColumns({"share": F.round("share", 9), "ratio": F.round("ratio", 9)})


@query(
    """WITH a AS (SELECT o_custkey AS k, count(*)::DOUBLE AS a FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, (count(o_orderkey) + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END)::DOUBLE AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 GROUP BY 1)
       SELECT k AS o_custkey, a, b, CASE WHEN a IS NULL THEN 'only b' WHEN b IS NULL THEN 'only a' WHEN abs(a - b) <= 0.005 * greatest(abs(a), abs(b), 1e-9) THEN 'agree' ELSE 'differ' END AS verdict FROM a FULL JOIN b USING (k)"""
)
def computations_agree(spark, sf_dir):
    """Orders a customer counted in two ways, the second with planted slips and gaps."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 7 != 0")
    one = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    other = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("o_custkey")).agg(F.count("o_orderkey").alias("n"))
    return answers.agreement(one, other.withColumn("n", F.col("n") + F.when(F.col("o_custkey") % 10 == 0, 1).otherwise(0)), ["o_custkey"], "n")


@query("WITH g AS (SELECT trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Errors of ''' || event_type || ''' on ' || ts::DATE || ' above ' || user_id, '''[^'']*''', '<value>', 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}', '<day>', 'g'), '[0-9]+(\\.[0-9]+)?', '<number>', 'g'), '\\s+', ' ', 'g'))) AS question FROM events) SELECT question, count(*) AS n FROM g GROUP BY 1")
def generic_questions(spark, sf_dir):
    asked = F.concat(F.lit("Errors of '"), "event_type", F.lit("' on "), F.to_date("ts").cast("string"), F.lit(" above "), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").groupBy(answers.generic(asked).alias("question")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE value END AS value FROM events")
def json_safe_rows(spark, sf_dir):
    """Rows with planted NaN and infinite values, as JSON can hold them."""
    spoilt = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("inf")).otherwise(F.col("value"))
    return answers.json_safe(table(spark, sf_dir, "events").select("event_id", spoilt.alias("value")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '-' ELSE format('{:,.2f}', c_acctbal) END AS balance FROM customer")
def number_texts(spark, sf_dir):
    some = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", answers.number_text(some).alias("balance"))


@query(f"SELECT doc_id, translate(text, '{answers.MARKS}', '{answers.PLAIN.replace(chr(39), chr(39) * 2)}') AS plain FROM documents")
def plain_signs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", answers.plain_signs(F.col("text")).alias("plain"))


# Structure


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey), n AS (SELECT a AS node FROM e UNION SELECT b FROM e), r(a, b) AS (SELECT node, node FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
       SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1"""
)
def strong_components(spark, sf_dir):
    """Nodes that reach each other along all lines, taken as edges from the supplier's key to the part's."""
    return graphs.strong_components(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query(
    """WITH m AS (SELECT DISTINCT lower(split_part(text, ' ', 3)) AS name FROM benchmark), w AS (SELECT doc_id, source, n_chars, unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS name FROM documents),
       p AS (SELECT name, source, count(*) AS n, max(n_chars) AS last FROM w JOIN m USING (name) WHERE name <> '' GROUP BY 1, 2)
       SELECT name, arg_min(source, (-n, source)) AS own_space, sum(n)::BIGINT AS n_pages, count(*) AS n_spaces, max(last) AS last_change FROM p GROUP BY 1"""
)
def parts_index(spark, sf_dir):
    """Which source writes most about a word, who else does, and the largest text (in place of the latest change)."""
    docs = table(spark, sf_dir, "documents")
    names = table(spark, sf_dir, "benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(3))).alias("name")).distinct().where("name != ''")
    said = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("name")).join(names, "name")
    return entities.parts_index(said, docs, "doc_id", "source", "n_chars")


def _column_names(spark, sf_dir):
    return [(f"{t}.{c}",) for t in ("orders", "lineitem", "customer", "part", "supplier") for c in table(spark, sf_dir, t).columns]


_WANTED = ("orderkey", "cust_key", "l_ship_date", "O_ORDERSTATUS", "retail price", "suppkey")


_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@query(
    f"""WITH c AS (SELECT DISTINCT table_name || '.' || column_name AS "column" FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'customer', 'part', 'supplier')),
        p AS (SELECT asked, "column", {_PLAIN.format('asked')} AS x, {_PLAIN.format('"column"')} AS y FROM (VALUES {', '.join(f"('{w}')" for w in _WANTED)}) w(asked), c), t AS (SELECT *, {_TRI.format('x')} AS a, {_TRI.format('y')} AS b FROM p),
        s AS (SELECT asked, "column", CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.9 ELSE round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) END::DOUBLE AS score FROM t WHERE len(list_intersect(a, b)) > 0) SELECT * FROM s WHERE score >= 0.3"""
)
def closest_columns(spark, sf_dir):
    """Columns of the tables for names as somebody wrote them."""
    asked = spark.createDataFrame([(w,) for w in _WANTED], "asked string")
    return search.closest_columns(asked, spark.createDataFrame(_column_names(spark, sf_dir), "column string"), 0.3)


@query(
    f"""WITH t AS (SELECT conv_id, turn, list_distinct({_terms_sql('text')}) AS ts FROM conversations), l AS (SELECT conv_id, turn, len(list_intersect(ts, lag(ts) OVER w)) AS overlap FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        o AS (SELECT conv_id, turn, coalesce(overlap, 0)::INT AS overlap, coalesce(overlap < 2, TRUE) AS opens FROM l) SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS subject FROM o"""
)
def message_subjects(spark, sf_dir):
    """Where a conversation turns to another subject."""
    return search.subjects(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, list_distinct({_terms_sql('text')}) AS ts FROM conversations), w AS (SELECT conv_id, turn, unnest(ts) AS term FROM t)
        SELECT a.conv_id, a.turn, b.turn AS other, count(*) AS hits FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn <> b.turn GROUP BY 1, 2, 3"""
)
def own_chat_hits(spark, sf_dir):
    """What else was said in the same conversation about a turn's words; other conversations are never looked at."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    pairs = w.join(w.withColumnRenamed("turn", "other"), ["conv_id", "term"]).where("turn != other")
    return pairs.groupBy("conv_id", "turn", "other").agg(F.count("*").alias("hits"))


def _learned_sql(rounds: int) -> str:
    sql = """WITH l AS (SELECT doc_id, n_chars / 10000.0::DOUBLE AS size, len(string_split(text, chr(10))) / 10.0::DOUBLE AS lines, quality, source FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
     r AS (SELECT *, row_number() OVER (PARTITION BY source, quality ORDER BY doc_id) AS rn FROM l), p AS (SELECT g.size - b.size AS size, g.lines - b.lines AS lines FROM r g JOIN r b ON g.source = b.source AND g.rn = b.rn WHERE g.quality = 1 AND b.quality = 0), w0 AS (SELECT 1.0::DOUBLE AS size, 1.0::DOUBLE AS lines)"""
    for i in range(rounds):
        step = ", ".join(f"least(3.0, greatest(0.0, any_value(w.{f}) + 0.05 * coalesce(avg(p.{f} / (1 + exp(p.size * w.size + p.lines * w.lines))), 0) - 0.02 * (any_value(w.{f}) - 1)))::DOUBLE AS {f}" for f in ("size", "lines"))
        sql += f", w{i + 1} AS (SELECT {step} FROM p, w{i} w)"
    return sql + f" SELECT 'size' AS feature, round(size, 6) AS weight FROM w{rounds} UNION ALL SELECT 'lines', round(lines, 6) FROM w{rounds}"


@query(_learned_sql(4))
def preference_weights(spark, sf_dir):
    """Weights of two features learned from pairs of a good and a poor document of one source."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id").select(
        "doc_id", "source", "quality", (F.col("n_chars") / 10000.0).alias("size"), (F.size(F.split("text", "\n")) / 10.0).alias("lines")
    )
    ranked = search.ranked(kept(docs), ["source", "quality"], "doc_id")
    good, poor = ranked.where("quality = 1"), ranked.where("quality = 0").select("source", "rn", F.col("size").alias("s"), F.col("lines").alias("l"))
    pairs = good.join(poor, ["source", "rn"]).select((F.col("size") - F.col("s")).alias("size"), (F.col("lines") - F.col("l")).alias("lines"))
    found = search.learn_preferences(kept(pairs), ["size", "lines"])
    return spark.createDataFrame([(f, round(w, 6)) for f, w in found.items()], "feature string, weight double")


# More of the plans, series and texts

RULES = {"orders": {"no pending": Cond("o_orderstatus", "!=", "P"), "large": Cond("o_totalprice", ">", 1000)}}


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus <> 'P' GROUP BY 1")
def plan_rules(spark, sf_dir):
    """Conditions that hold by rule, one of them lifted by the question."""
    from tidemark.plans.plan import ruled

    step = Step("q1", "orders", (Measure("n", "count"),), ("o_orderpriority",), (Cond("o_orderdate", ">=", "1996-01-01"),))
    return _plan(spark, sf_dir, ruled(step, RULES, ("large",)))


@query(
    """WITH a AS (SELECT DISTINCT 'c_mktsegment' AS field, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) || 'x' ELSE lower(c_mktsegment) END AS value FROM customer), k AS (SELECT lower(c_mktsegment) AS key, min(c_mktsegment) AS listed FROM customer GROUP BY 1)
       SELECT field, value, listed FROM a LEFT JOIN k ON key = value"""
)
def listed_values(spark, sf_dir):
    """Values in another case as their field lists them; unknown ones stay without."""
    customer = table(spark, sf_dir, "customer")
    low = F.lower("c_mktsegment")
    asked = F.when(F.col("c_custkey") % 5 == 0, F.concat(low, F.lit("x"))).otherwise(low)
    return search.listed_case(customer.select(F.lit("c_mktsegment").alias("field"), asked.alias("value")), customer.select(F.lit("c_mktsegment").alias("field"), F.col("c_mktsegment").alias("value")))


@query(
    f"WITH {_INDEX}, r AS (SELECT term FROM idx GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5), t AS (SELECT term, doc_id FROM idx JOIN r USING (term)) SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2"
)
def related_pages(spark, sf_dir):
    """Documents that share two rare terms."""
    return search.related(search.told_terms(table(spark, sf_dir, "documents"), "doc_id", F.col("text")), "doc_id")


@query(
    """WITH m AS (SELECT DISTINCT x.event_type AS a, y.event_type AS b, x.event_id FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_type <> y.event_type AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 600000000), t AS (SELECT event_type AS a, count(*) AS n FROM events GROUP BY 1)
       SELECT a, b, round(count(*) / any_value(n), 6) AS share, round(count(*) / any_value(n), 6) >= 0.8 AS same FROM m JOIN t USING (a) GROUP BY 1, 2"""
)
def same_event_kinds(spark, sf_dir):
    """Kinds of events that happen together."""
    return entities.same_event_kinds(table(spark, sf_dir, "events"), "event_type", ["user_id"], "ts", "event_id", 600_000_000)


@query(
    """WITH c AS (SELECT user_id, event_id, (event_id * 7919) % 1000 / 1.0::DOUBLE AS v FROM events), g AS (SELECT user_id, event_id, v, CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS increase FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       p AS (SELECT user_id, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, sum(increase) AS total, (max(event_id) - min(event_id)) / 1.0::DOUBLE AS seconds FROM g GROUP BY 1)
       SELECT *, CASE WHEN seconds > 0 THEN round(total / seconds, 6) END AS rate FROM p"""
)
def metric_profiles(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", F.timestamp_seconds("event_id").alias("at"), ((F.col("event_id") * 7919) % 1000).cast("double").alias("v"))
    return series.metric_profile(df, ["user_id"], "at", "v").withColumns({"mean": F.round("mean", 6), "rate": F.round("rate", 6)})


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) FILTER (WHERE value > 90) / count(*), 6) AS failed_share FROM events GROUP BY 1, 2")
def latency_by_day(spark, sf_dir):
    found = series.latencies(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["day", "event_type"], "value", F.col("value") > 90)
    return found.withColumns({"p95": F.round("p95", 6), "failed_share": F.round("failed_share", 6)})


@query(
    "WITH " + _BACK.format(start="2024-01-20 06:00:00", end="2024-01-20 18:00:00", size=86400, n=7) + """, p AS (SELECT event_type, k, max(value) AS n FROM cells GROUP BY 1, 2), a AS (SELECT event_type, max(n) FILTER (WHERE k = 0) AS now, median(n) FILTER (WHERE k > 0) AS usual FROM p GROUP BY 1)
     SELECT *, CASE WHEN usual <> 0 THEN now / usual END AS ratio, coalesce(now / usual < 0.77 OR now / usual > 1.3, FALSE) AS unusual FROM a"""
)
def usual_days_highest(spark, sf_dir):
    """The highest value now and the median of the highest of the same hours of seven earlier days."""
    per = _back(spark, sf_dir, "2024-01-20 06:00:00", "2024-01-20 18:00:00", "day", 7).groupBy("event_type", "k").agg(F.max("value").alias("n"))
    return series.days_ratio(per, ["event_type"], "n")


@query("SELECT user_id, count(*) AS calls, round(count(*) FILTER (WHERE value < 20) / count(*), 6) AS cached, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1 ORDER BY calls DESC, user_id LIMIT 10")
def usage_top(spark, sf_dir):
    """The ten users with most calls: how many were answered from what was there, and their nearest-rank p95."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("calls"), F.round(F.count_if(F.col("value") < 20) / F.count("*"), 6).alias("cached"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95")
    )
    return per.orderBy(F.desc("calls"), "user_id").limit(10)


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY source, md5(coalesce(text, '')) ORDER BY doc_id) AS copy FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM o WHERE copy = 1)
       SELECT doc_id, source, n_chars FROM r WHERE rn <= 2 ORDER BY n_chars DESC, doc_id LIMIT 15"""
)
def cap_per_page_once(spark, sf_dir):
    """At most two texts a source among the fifteen largest, copies counted once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_id"))
    once = docs.groupBy("source", "text_id").agg(F.min_by(F.struct("doc_id", "n_chars"), "doc_id").alias("d")).select("source", "d.doc_id", "d.n_chars")
    return search.per_page(once.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 2, 15)
