"""Queries of records and rules: runs that recur, tables that tell the same, what lines state, table families, periods that texts name."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tidemark.catalog import _BACK
from tidemark.catalog_text import _TWO, _asked, _index, _terms_sql
from tidemark.functions import text as T
from tidemark.operators import entities, groups, logs, profiles, search, series
from tidemark.operators.scratch import folder_of, kept
from tidemark.plans.plan import Plan, Step, measure_of, run_plan
from tidemark.registry import query
from tidemark.sources import tables
from tidemark.sources.tables import table


@query(
    "WITH " + _BACK.format(start="2024-01-20", end="2024-01-21", size=86400, n=7) + """, m AS (SELECT event_type, k, value, epoch_us(ts) + k::BIGINT * 86400000000 AS us FROM cells WHERE value IS NOT NULL AND NOT isnan(value)),
       b AS (SELECT *, value > 60 AS bad FROM m), o AS (SELECT *, bad AND (NOT coalesce(lag(bad) OVER w, FALSE) OR us - lag(us) OVER w > 7200000000) AS opens FROM b WINDOW w AS (PARTITION BY event_type, k ORDER BY us)),
       r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY event_type, k ORDER BY us) AS run FROM o),
       runs AS (SELECT event_type, k, max(value) AS worst, floor((max(us) - min(us)) / 1e6 + 7200)::BIGINT AS seconds FROM r WHERE bad GROUP BY event_type, k, run HAVING floor((max(us) - min(us)) / 1e6 + 7200) >= 14400),
       now AS (SELECT event_type, count(*) AS n_runs, max(worst) AS worst, sum(seconds)::BIGINT AS seconds FROM runs WHERE k = 0 GROUP BY 1), d AS (SELECT event_type, count(DISTINCT k) AS days_on FROM runs WHERE k > 0 GROUP BY 1),
       s AS (SELECT event_type, count(DISTINCT k) AS days_seen FROM cells WHERE k > 0 GROUP BY 1)
       SELECT event_type, n_runs, worst, seconds, coalesce(days_on, 0) AS days_on, coalesce(days_seen, 0) AS days_seen,
         CASE WHEN coalesce(days_seen, 0) < 3 THEN 'unknown' WHEN coalesce(days_on, 0) >= 0.6 * days_seen THEN 'usual' ELSE 'not usual' END AS verdict FROM now LEFT JOIN d USING (event_type) LEFT JOIN s USING (event_type)"""
)
def recurring_runs(spark, sf_dir):
    """Runs of a day beside those of the same window on seven earlier days."""
    return series.recurring_runs(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", 60.0, 7200, 14400, "2024-01-20", "2024-01-21")


@query(
    """WITH a AS (SELECT event_id, event_type, epoch_us(ts) AS us, CASE WHEN event_id % 9 = 0 THEN 'ok 1' WHEN event_id % 2 = 0 THEN 'request took too long at the gate 7' ELSE 'connection closed by the other side' END AS m FROM events),
       p AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'request took too long at the gate' ELSE m END AS piece FROM a),
       b AS (SELECT event_type, us + 1500000 AS us, 'gw: ' || m || ' (seen)' AS other FROM a WHERE event_type <> 'click' OR event_id % 5 = 0),
       f AS (SELECT event_type, count(DISTINCT event_id) AS found FROM p JOIN b USING (event_type) WHERE piece IS NOT NULL AND abs(p.us - b.us) <= 2000000 AND contains(other, piece) GROUP BY 1),
       n AS (SELECT event_type, count(*) AS n_lines FROM p WHERE piece IS NOT NULL GROUP BY 1)
       SELECT event_type, n_lines, coalesce(found, 0) AS found, round(coalesce(found, 0) / n_lines, 6) AS share, round(coalesce(found, 0) / n_lines, 6) >= 0.8 AS same FROM n LEFT JOIN f USING (event_type)"""
)
def same_lines(spark, sf_dir):
    """Which event types' lines a second table tells too, by moment and longest piece of text; the second lacks most clicks."""
    message = F.when(F.col("event_id") % 9 == 0, "ok 1").when(F.col("event_id") % 2 == 0, "request took too long at the gate 7").otherwise("connection closed by the other side")
    a = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", message.alias("message"))
    b = a.where((F.col("event_type") != "click") | (F.col("event_id") % 5 == 0)).select("event_type", (F.col("ts") + F.expr("interval 1500 milliseconds")).alias("ts"), F.concat(F.lit("gw: "), "message", F.lit(" (seen)")).alias("message"))
    return logs.same_lines(a, b, ["event_type"], "ts", "event_id")


@query(
    """WITH l AS (SELECT event_id, ts::DATE AS day, 'svc-' || event_type AS src, CASE user_id % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'waits' WHEN 2 THEN 'reads' ELSE NULL END AS kind, 'db-' || user_id % 3 AS dst, user_id % 5 = 0 AS twice FROM events),
       s AS (SELECT event_id, day, src, kind, dst FROM l WHERE kind IS NOT NULL UNION ALL SELECT event_id, day, dst, 'writes', 'disk-1' FROM l WHERE twice)
       SELECT src, kind, dst, count(*) AS n_lines, count(DISTINCT day) AS n_days FROM s GROUP BY 1, 2, 3"""
)
def stated_by_lines(spark, sf_dir):
    """What lines say that parts do with each other, two statements in some lines, none in others."""
    src, dst = F.concat(F.lit("svc-"), "event_type"), F.concat(F.lit("db-"), (F.col("user_id") % 3).cast("string"))
    verb = F.element_at(F.array(*map(F.lit, (" Invokes the ", " is waiting for ", " queries ", " beside "))), (F.col("user_id") % 4 + 1).cast("int"))
    more = F.when(F.col("user_id") % 5 == 0, ", which saves to disk-1").otherwise(", disk-1 is far from here by now")
    lines = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), F.concat(F.lit("12:00 "), src, verb, dst, more).alias("message"))
    known = lines.select(F.explode(F.regexp_extract_all("message", F.lit("((svc|db|disk)-[a-z0-9_]+)"), 1)).alias("name")).distinct()
    return logs.stated(lines, "event_id", "day", "message", known)


@query("""SELECT CASE WHEN count(DISTINCT name) > 1 THEN family ELSE min(name) END AS family, count(DISTINCT name) AS n_members, sum(n)::BIGINT AS n FROM
       (SELECT name, regexp_replace(name, '([-_.]?[0-9]{4}[-_.][0-9]{2}([-_.][0-9]{2})?|[-_.][0-9]+)$', '-*') AS family, n FROM
         (SELECT CASE event_type WHEN 'error' THEN 'errors-' || strftime(ts, '%Y.%m.%d') WHEN 'view' THEN 'views_' || user_id % 7 ELSE event_type END AS name, count(*) AS n FROM events GROUP BY 1)) GROUP BY family""")
def table_families(spark, sf_dir):
    """Rows of dated and numbered tables by family."""
    name = F.when(F.col("event_type") == "error", F.concat(F.lit("errors-"), F.date_format("ts", "yyyy.MM.dd"))).when(F.col("event_type") == "view", F.concat(F.lit("views_"), (F.col("user_id") % 7).cast("string"))).otherwise(F.col("event_type"))
    return tables.family_members(table(spark, sf_dir, "events").groupBy(name.alias("name")).agg(F.count("*").alias("n")), "name", "n")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') > 25 AS truncated FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def rows_capped(spark, sf_dir):
    """The first rows of a user's part of a table, and whether there are more."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return tables.capped(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query("SELECT 'region' AS name, count(*) AS n, sum(length(r_name))::BIGINT AS letters FROM region UNION ALL SELECT 'nation', count(*), sum(length(n_name))::BIGINT FROM nation UNION ALL SELECT 'supplier', count(*), sum(length(s_name))::BIGINT FROM supplier")
def backup_and_restore(spark, sf_dir):
    """Three tables through a backup and back, with their types."""
    path = f"{folder_of(spark)}/tidemark-{uuid.uuid4().hex}"
    tables.backup({n: table(spark, sf_dir, n) for n in ("region", "nation", "supplier")}, path)
    found = tables.restore(spark, path)
    parts = [found[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(F.length(f"{n[0]}_name")).alias("letters")) for n in ("region", "nation", "supplier")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT vec_id, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def vectors_kept(spark, sf_dir):
    """Vectors through the vector table and back."""
    path = f"{folder_of(spark)}/tidemark-{uuid.uuid4().hex}"
    tables.write_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


_WRITTEN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_ENV = f"trim(regexp_replace({_WRITTEN}, '(^| )({entities.ENVIRONMENTS})( |$)', ' ', 'g'))"
_CORE = f"trim(regexp_replace({_ENV}, '( v?[0-9]+)+$', '', 'g'))"


def _compact(form: str, name: str) -> str:
    return f"replace({form.format(name)}, ' ', '')"


@query(
    f"""WITH p AS (SELECT p_partkey, p_name AS a, unnest([upper(replace(p_name, ' ', '-')), p_name || ' prod', substr(p_name, 1, 3) || substr(p_name, 5), p_name || ' v2', substr(p_name, 1, 2)]) AS b, unnest(range(5)) AS i FROM part),
       k AS (SELECT p_partkey, i, {_compact(_WRITTEN, 'a')} AS ca, {_compact(_WRITTEN, 'b')} AS cb, {_compact(_ENV, 'a')} AS ea, {_compact(_ENV, 'b')} AS eb, {_compact(_CORE, 'a')} AS ra, {_compact(_CORE, 'b')} AS rb FROM p)
       SELECT p_partkey, i::INT AS i, CASE WHEN ca = cb THEN 'strong' WHEN ea = eb AND ea <> '' THEN 'noenv'
         WHEN levenshtein(ca, cb) = 1 AND least(length(ca), length(cb)) >= 7 AND regexp_replace(ca, '[^0-9]', '', 'g') = regexp_replace(cb, '[^0-9]', '', 'g') THEN 'typo' WHEN ra = rb AND ra <> '' THEN 'doubt' ELSE 'none' END AS verdict FROM k"""
)
def name_verdicts(spark, sf_dir):
    """What every part's name is to five spellings of it; a name is judged once, however many parts have it."""
    name, part = F.col("p_name"), table(spark, sf_dir, "part")
    spelled = F.array(F.upper(F.regexp_replace(name, " ", "-")), F.concat(name, F.lit(" prod")), F.concat(F.substring(name, 1, 3), F.expr("substring(p_name, 5)")), F.concat(name, F.lit(" v2")), F.substring(name, 1, 2))
    pairs = part.select(name).distinct().select(name, F.posexplode(spelled).alias("i", "b"))
    keyed = pairs.select(name, "i", entities.name_keys(name).alias("x"), entities.name_keys(F.col("b")).alias("y"))
    judged = keyed.select(name, "i", entities.verdict_of(F.col("x"), F.col("y")).alias("verdict"))
    return series.join_same(part.select("p_partkey", name), judged, ["p_name"], "inner").select("p_partkey", "i", "verdict")


@query(
    """WITH le AS (SELECT unnest([10.0, 25.0, 50.0, 75.0, 100.0, 1000000.0])::DOUBLE AS le), h AS (SELECT event_type, ts::DATE AS day, le, count(*) FILTER (WHERE value <= le)::DOUBLE AS n FROM events, le GROUP BY 1, 2, 3),
       w AS (SELECT *, coalesce(lag(le) OVER p, 0) AS low, coalesce(lag(n) OVER p, 0) AS below, max(n) OVER (PARTITION BY event_type, day) AS total FROM h WINDOW p AS (PARTITION BY event_type, day ORDER BY le)),
       f AS (SELECT event_type, day, arg_min({'low': low, 'le': le, 'below': below, 'n': n, 'total': total}, le) AS b FROM w WHERE n >= 0.95 * total AND total > 0 GROUP BY 1, 2)
       SELECT event_type, count(*) AS days, round(median(b.low + (b.le - b.low) * ((0.95 * b.total - b.below) / (b.n - b.below))), 6) AS usual FROM f GROUP BY 1"""
)
def hist_quantile_of_days(spark, sf_dir):
    """The median over days of each day's 95 % quantile from histogram buckets."""
    bounds = F.explode(F.array(*(F.lit(x) for x in (10.0, 25.0, 50.0, 75.0, 100.0, 1e6))))
    hist = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value", bounds.alias("le"))
    hist = hist.groupBy("event_type", "day", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("n"))
    return series.histogram_quantile(hist, ["event_type", "day"], "le", "n", 0.95).groupBy("event_type").agg(F.count("*").alias("days"), F.round(F.median("quantile"), 6).alias("usual"))


_SAID = (
    "errors of today", "what happened yesterday?", "calls LAST WEEK", "cette semaine", "le mois dernier", "this month so far", "the weekend", "les 10 derniers jours", "the last 3 days",
    "on 2023-12-31 or today", "nothing said", "semaine dernière", "hier",
)
_REF = "(DATE '2024-01-01' + (conv_id % 60)::INT)"


@query(
    f"""WITH t AS (SELECT conv_id, turn, {list(_SAID)}[turn % 13 + 1] AS s, {_REF} AS r, date_trunc('week', {_REF})::DATE AS w, date_trunc('month', {_REF})::DATE AS m, {_REF} - ((isodow({_REF}) - 6 + 7) % 7)::INT AS sat FROM conversations),
       p AS (SELECT *, CASE turn % 13 WHEN 0 THEN r WHEN 1 THEN r - 1 WHEN 2 THEN w - 7 WHEN 3 THEN w WHEN 4 THEN (m - INTERVAL 1 MONTH)::DATE WHEN 5 THEN m WHEN 6 THEN sat WHEN 7 THEN r - 9 WHEN 8 THEN r - 2 WHEN 9 THEN DATE '2023-12-31' WHEN 10 THEN NULL WHEN 11 THEN w - 7 ELSE r - 1 END AS first,
         CASE turn % 13 WHEN 0 THEN r + 1 WHEN 1 THEN r WHEN 2 THEN w WHEN 3 THEN w + 7 WHEN 4 THEN m WHEN 5 THEN (m + INTERVAL 1 MONTH)::DATE WHEN 6 THEN sat + 2 WHEN 7 THEN r + 1 WHEN 8 THEN r + 1 WHEN 9 THEN DATE '2024-01-01' WHEN 10 THEN NULL WHEN 11 THEN w ELSE r END AS until FROM t)
       SELECT conv_id, turn, first, until FROM p"""
)
def named_periods(spark, sf_dir):
    """The days that texts name in English and French, seen from a day of each conversation."""
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("turn") % 13 + 1).cast("int"))
    ref = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 60).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.named_period(said, ref).alias("p")).select("conv_id", "turn", F.col("p.first").alias("first"), F.col("p.until").alias("until"))


@query(
    f"""WITH d AS (SELECT doc_id, {_terms_sql('text')} AS ws, {_terms_sql("array_to_string(string_split(text, ' ')[1:3], ' ')")} AS hs FROM documents), t AS (SELECT doc_id, ws || hs || hs AS ts FROM d)
       SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS tf, max(length)::INT AS longest FROM (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, unnest(ts) AS term, len(ts) AS length FROM t) GROUP BY 1, 2) GROUP BY 1"""
)
def titled_postings(spark, sf_dir):
    """Terms of an index in which the first three words of a text, as its title, count twice more."""
    head = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    index = search.postings(table(spark, sf_dir, "documents").withColumn("head", head), "doc_id", F.col("text"), F.col("head"))
    return index.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("tf"), F.max("length").alias("longest"))


@query(
    """WITH g AS (SELECT DISTINCT p_type AS term, 0 AS k FROM part UNION SELECT DISTINCT 'house ' || p_brand, 1 FROM part), w AS (SELECT term, trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) AS run FROM g), t AS (SELECT term, run, list_distinct(string_split(run, ' ')) AS ws FROM w),
       n AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM t) GROUP BY 1), rare AS (SELECT term, list(w) AS rs FROM (SELECT term, unnest(ws) AS w FROM t) JOIN n USING (w) WHERE length(w) >= 4 AND n <= 2 GROUP BY 1),
       q AS (SELECT DISTINCT p_brand || ' in ' || p_type || ' for ' || split_part(p_name, ' ', 1) AS question FROM part), a AS (SELECT question, ' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' ' AS said FROM q), b AS (SELECT question, said, string_split(trim(said), ' ') AS qs FROM a),
       s AS (SELECT question, term, CASE WHEN list_has_all(qs, ws) AND contains(said, ' ' || run || ' ') THEN 6.0 + len(ws) WHEN list_has_all(qs, ws) THEN 4.0 + len(ws) WHEN rs IS NOT NULL AND list_has_any(qs, rs) THEN 2.0 END::DOUBLE AS certainty FROM b, t LEFT JOIN rare USING (term)),
       r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY certainty DESC, term) AS rn FROM s WHERE certainty IS NOT NULL) SELECT question, term, certainty, rn FROM r WHERE rn <= 10"""
)
def glossary_ranked(spark, sf_dir):
    """The glossary's terms that questions hold: as written, by all their words, or by a rare one (a brand's)."""
    part = table(spark, sf_dir, "part")
    glossary = part.select(F.col("p_type").alias("term")).unionByName(part.select(F.concat(F.lit("house "), "p_brand").alias("term")))
    asked = part.select(F.concat("p_brand", F.lit(" in "), "p_type", F.lit(" for "), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("question")).distinct()
    return search.glossary_ranked(asked, "question", F.col("question"), glossary).withColumn("rn", F.col("rn").cast("long"))


@query(
    f"""WITH {_TWO}, v AS (SELECT DISTINCT term, 1 AS known FROM idx), p AS (SELECT query_id, count(*) AS n_terms, count(*) FILTER (WHERE known IS NULL) AS n_unknown FROM q LEFT JOIN v USING (term) GROUP BY 1), t AS (SELECT query_id, max(score) AS best FROM top WHERE rn <= 10 GROUP BY 1),
       j AS (SELECT query_id, 2 * n_unknown >= n_terms OR coalesce(best, 0) < 40 AS weak FROM p LEFT JOIN t USING (query_id)),
       l AS (SELECT query_id, doc_id, 1 / (60::DOUBLE + rn - 1) AS s FROM a UNION ALL SELECT query_id, doc_id, 1 / (60::DOUBLE + rn - 1) FROM bb JOIN j USING (query_id) WHERE weak),
       f AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM f) SELECT query_id, doc_id, score, rn FROM r WHERE rn <= 10"""
)
def second_look(spark, sf_dir):
    """Searches that are doubted with a second list (documents by plain term counts) fused in by rank."""
    asked, index = _asked(spark, sf_dir), kept(_index(spark, sf_dir))
    first = kept(search.bm25(index, "doc_id", asked, 20))
    count = index.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum("tf").cast("double").alias("score"))
    second = series.first_of_each(count, ["query_id"], [F.desc("score"), F.asc("doc_id")], 20)
    judged = search.weak(asked, search.vocabulary(index), first.where("rn <= 10"), 40.0)
    return search.second_look(first, second, judged, "doc_id", 10).withColumn("rn", F.col("rn").cast("long"))


_QUESTIONS = ("what does the gate depend on", "which parts are affected in order", "how many parts are affected", "top rates behind the gate", "what runs on rack 3", "say something")


@query(
    f"""WITH h AS (SELECT vec_id // 20 AS query_id, vec_id % 20 + 1 AS rn, vec_id, ['page', 'metric', 'chart', 'system'][label % 4 + 1] AS kind, {list(_QUESTIONS)}[(vec_id // 20) % 6 + 1] AS question FROM embeddings),
       o AS (SELECT *, (query_id % 6 IN (0, 1, 4)) AND kind IN ('metric', 'chart') AS after FROM h) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY after::INT, rn)::INT AS rn FROM o"""
)
def built_first(spark, sf_dir):
    """Hits of questions on structure with the objects of the data behind the others, those of other questions as they were."""
    v = table(spark, sf_dir, "embeddings")
    hits = v.select(
        F.floor(F.col("vec_id") / 20).alias("query_id"), (F.col("vec_id") % 20 + 1).alias("rn"), "vec_id",
        F.element_at(F.array(*map(F.lit, ("page", "metric", "chart", "system"))), (F.col("label") % 4 + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.floor(F.col("vec_id") / 20) % 6 + 1).cast("int")).alias("question"),
    )
    return search.built_first(hits, F.col("question"), "kind").select("query_id", "vec_id", "rn")


@query(
    """SELECT l_returnflag, count(*) AS count, round(avg(l_quantity), 6) AS avg_l_quantity, max(l_discount) AS max_l_discount, round(sum(l_extendedprice) / sum(l_quantity), 6) AS ratio_l_extendedprice_l_quantity FROM lineitem GROUP BY 1"""
)
def measures_by_name(spark, sf_dir):
    """Measures as texts name them, in one step of a plan."""
    ms = tuple(measure_of(t) for t in ("count", "mean(l_quantity)", "MAX( l_discount )", "ratio(l_extendedprice, l_quantity)"))
    found = run_plan(Plan((Step("q1", "lineitem", ms, ("l_returnflag",)),)), {"lineitem": table(spark, sf_dir, "lineitem")})["q1"]
    return found.withColumns({c: F.round(c, 6) for c in ("avg_l_quantity", "ratio_l_extendedprice_l_quantity")})


@query(
    """WITH s AS (SELECT event_id, event_id // 4 AS trace, event_id % 4 AS span, event_type AS service, value, epoch_us(ts) AS us FROM events)
       SELECT p.service AS caller, c.service AS callee, count(*) AS calls, round(avg(c.value), 6) AS mean_duration FROM s c JOIN s p ON p.trace = c.trace AND p.span = c.span - 1
       WHERE p.service <> c.service AND abs(c.us - p.us) <= 172800000000 GROUP BY 1, 2"""
)
def span_calls_in_time(spark, sf_dir):
    """Calls between services whose spans lie within two days of their parents."""
    spans = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 4).alias("trace_id"), (F.col("event_id") % 4).alias("span_id"), (F.col("event_id") % 4 - 1).alias("parent_id"), F.col("event_type").alias("service"), F.col("value").alias("duration"), "ts"
    )
    return entities.span_calls(spans, "ts", 172_800).withColumn("mean_duration", F.round("mean_duration", 6))


@query(
    """WITH RECURSIVE m AS (SELECT DISTINCT l_linenumber AS n, l_partkey AS m FROM lineitem), s AS (SELECT n, count(*) AS s FROM m GROUP BY 1), p AS (SELECT x.n AS a, y.n AS b, count(*) AS common FROM m x JOIN m y ON x.m = y.m AND x.n < y.n GROUP BY 1, 2),
       e AS (SELECT a, b FROM p JOIN s sa ON sa.n = a JOIN s sb ON sb.n = b WHERE round(common / (sa.s + sb.s - common), 6) >= 0.5), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, g) AS (SELECT n, n FROM s UNION SELECT r.n, u.b FROM r JOIN u ON u.a = r.g)
       SELECT n::VARCHAR AS name, min(g)::VARCHAR AS "group" FROM r GROUP BY 1"""
)
def shared_member_groups(spark, sf_dir):
    """Line numbers that share half of their parts, as groups."""
    return entities.shared_member_groups(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_partkey", 0.5)


@query(
    """WITH p AS (SELECT user_id, date_diff('day', ts::DATE, DATE '2024-01-29') AS b FROM events), w AS (SELECT user_id, count(*) FILTER (WHERE b = 0) AS w0, list_sort([count(*) FILTER (WHERE b = 7), count(*) FILTER (WHERE b = 14), count(*) FILTER (WHERE b = 21), count(*) FILTER (WHERE b = 28)]) AS l FROM p WHERE b % 7 = 0 AND b BETWEEN 0 AND 28 GROUP BY 1),
       u AS (SELECT user_id, w0 AS now, (l[2] + l[3]) / 2.0::DOUBLE AS usual FROM w), d AS (SELECT user_id, max(ts)::DATE AS last FROM events GROUP BY 1),
       r AS (SELECT user_id, now, usual, CASE WHEN last < DATE '2024-01-29' AND usual > 0 THEN 'stale' WHEN abs(now - usual) < greatest(3, 2 * sqrt(usual)) THEN 'usual' WHEN now = 0 AND usual > 0 THEN 'gone' WHEN now > usual THEN 'above' ELSE 'below' END AS finding FROM u JOIN d USING (user_id)),
       t AS (SELECT *, CASE finding WHEN 'stale' THEN usual ELSE abs(now - usual) END AS weight FROM r WHERE finding <> 'usual'), o AS (SELECT *, row_number() OVER (ORDER BY weight DESC, user_id) AS place FROM t)
       SELECT user_id, finding, now, usual, weight, place FROM o WHERE place <= 20"""
)
def day_findings(spark, sf_dir):
    """What to tell of a day: users whose rows stopped or left their usual."""
    return series.findings(table(spark, sf_dir, "events"), ["user_id"], "ts", "2024-01-29").withColumn("place", F.col("place").cast("long"))


@query(
    """WITH s AS (SELECT l_orderkey AS o_orderkey, min(l_shipdate) AS shipped, max(l_shipdate) AS complete FROM lineitem GROUP BY 1), j AS (SELECT o_orderpriority, o_orderdate::TIMESTAMP AS o, shipped::TIMESTAMP AS s, complete::TIMESTAMP AS c FROM orders LEFT JOIN s USING (o_orderkey)),
       l AS (SELECT o_orderpriority, 'o_orderdate > shipped' AS step, o AS a, s AS b FROM j UNION ALL SELECT o_orderpriority, 'shipped > complete', s, c FROM j),
       f AS (SELECT *, coalesce(a < TIMESTAMP '1997-06-01', FALSE) AS x, coalesce(b < TIMESTAMP '1997-06-01', FALSE) AS y FROM l),
       p AS (SELECT o_orderpriority, step, count(*) FILTER (WHERE x AND y) AS reached, avg((epoch_us(b) - epoch_us(a)) / 86400000000) FILTER (WHERE x AND y) AS lapse, count(*) FILTER (WHERE x AND NOT y) AS waiting, avg((epoch_us(TIMESTAMP '1997-06-01') - epoch_us(a)) / 86400000000) FILTER (WHERE x AND NOT y) AS age FROM f GROUP BY 1, 2)
       SELECT o_orderpriority, step, reached, round(lapse, 4) AS lapse_days, waiting, round(age, 4) AS age_days, round(lapse / sum(lapse) OVER (PARTITION BY o_orderpriority), 4) AS share FROM p"""
)
def journey(spark, sf_dir):
    """The way of orders through two stages: how many passed, how long it took, how many wait and how long."""
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"), F.max("l_shipdate").alias("complete"))
    df = table(spark, sf_dir, "orders").join(ship, "o_orderkey", "left")
    return groups.journey(df, ["o_orderpriority"], ["o_orderdate", "shipped", "complete"], "1997-06-01").withColumns({c: F.round(c, 4) for c in ("lapse_days", "age_days", "share")})


@query(
    """WITH a AS (SELECT p_partkey, p_brand AS type, CASE WHEN p_size % 2 = 0 THEN 'kg' END AS unit, p_size AS cardinality, p_partkey % 11 = 0 AS gone FROM part WHERE p_partkey % 7 <> 0),
       b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE p_brand END AS type, CASE WHEN p_size % 3 = 0 THEN 'g' WHEN p_size % 2 = 0 THEN 'kg' END AS unit, CASE WHEN p_partkey % 3 = 0 THEN p_size * 3 ELSE p_size + 1 END AS cardinality, p_partkey % 13 = 0 AS gone FROM part WHERE p_partkey % 17 <> 0),
       j AS (SELECT p_partkey, a.p_partkey IS NOT NULL AS ha, b.p_partkey IS NOT NULL AS hb, coalesce(a.gone, FALSE) AS ga, coalesce(b.gone, FALSE) AS gb, a.type AS ta, b.type AS tb, a.unit AS ua, b.unit AS ub, a.cardinality AS ca, b.cardinality AS cb FROM a FULL JOIN b USING (p_partkey)),
       k AS (SELECT *, ha AND NOT ga AS la, hb AND NOT gb AS lb FROM j)
       SELECT p_partkey, 'new' AS change, NULL AS was, tb AS is_now FROM k WHERE NOT ha AND lb UNION ALL SELECT p_partkey, 'gone', ta, NULL FROM k WHERE la AND NOT lb UNION ALL SELECT p_partkey, 'back', NULL, tb FROM k WHERE ga AND lb
       UNION ALL SELECT p_partkey, 'type', ta, tb FROM k WHERE la AND lb AND ta <> tb UNION ALL SELECT p_partkey, 'unit', ua, ub FROM k WHERE la AND lb AND ua <> ub
       UNION ALL SELECT p_partkey, 'cardinality', ca::VARCHAR, cb::VARCHAR FROM k WHERE la AND lb AND CASE WHEN least(ca, cb) <= 0 THEN ca <> cb AND greatest(ca, cb) >= 10 ELSE greatest(ca, cb) >= 2 * least(ca, cb) AND abs(ca - cb) >= 10 END"""
)
def object_changes(spark, sf_dir):
    """What became of objects between two learnings, on all parts with planted changes."""
    part, k, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    kg = F.when(size % 2 == 0, "kg")
    before = part.where(k % 7 != 0).select(k, F.col("p_brand").alias("type"), kg.alias("unit"), size.alias("cardinality"), (k % 11 == 0).alias("gone"))
    after = part.where(k % 17 != 0).select(
        k, F.when(k % 5 == 0, "other").otherwise(F.col("p_brand")).alias("type"), F.when(size % 3 == 0, "g").otherwise(kg).alias("unit"),
        F.when(k % 3 == 0, size * 3).otherwise(size + 1).alias("cardinality"), (k % 13 == 0).alias("gone"),
    )
    return profiles.object_changes(before, after, ["p_partkey"])


_PLACED = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'service' ELSE 'host' END AS category, CASE p_partkey % 5 WHEN 0 THEN upper(replace(p_name, ' ', '_')) WHEN 1 THEN p_name || 's' ELSE p_name END AS name FROM part)"
_KEYED = f"k AS (SELECT id, category, replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ', '') AS key FROM {_PLACED})"


def _placed(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    spelled = F.when(k % 5 == 0, F.upper(F.regexp_replace(name, " ", "_"))).when(k % 5 == 1, F.concat(name, F.lit("s"))).otherwise(name)
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, "service").otherwise("host").alias("category"), spelled.alias("name"))


@query(f"WITH {_KEYED} SELECT key, count(*) AS n_values, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT category) > 1")
def named_twice(spark, sf_dir):
    """Names that are values of both categories."""
    return entities.named_twice(_placed(spark, sf_dir))


@query(
    f"""WITH {_KEYED}, f AS (SELECT category, key, min(id) AS a FROM k WHERE key <> '' GROUP BY 1, 2), s AS (SELECT a, id AS b, 'same letters' AS how FROM k JOIN f USING (category, key) WHERE id <> a),
       u AS (SELECT category, a, unnest([key || 's', key || 'es', CASE WHEN key LIKE '%y' THEN key[:-2] || 'ies' END]) AS key FROM f WHERE length(key) >= 4 AND NOT regexp_matches(key, '[0-9]$')),
       l AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part UNION SELECT p_partkey + 1, p_partkey FROM part) SELECT DISTINCT * FROM (SELECT * FROM s UNION ALL SELECT a, id, 'plural' FROM u JOIN k USING (category, key)) x ANTI JOIN l USING (a, b)"""
)
def written_two_ways(spark, sf_dir):
    """Values of a category that may be one thing written twice, but for neighbours, which links keep apart."""
    links = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return entities.written_two_ways(_placed(spark, sf_dir), links)


@query(
    """WITH h AS (SELECT s_suppkey, 'WEB' || s_suppkey || '.corp.example:' || (9000 + s_nationkey) AS asked, CASE s_suppkey % 4 WHEN 0 THEN 'web' || s_suppkey WHEN 1 THEN 'web' || s_suppkey || '.corp.example' WHEN 2 THEN 'web' || s_suppkey || '.other.example' ELSE '10.0.0.' || s_suppkey % 250 END AS known FROM supplier)
       SELECT s_suppkey, lower(asked) || ',web' || s_suppkey || '.corp.example,web' || s_suppkey AS forms, s_suppkey % 4 < 2 AS same FROM h"""
)
def host_forms(spark, sf_dir):
    """The names that hosts go by, and whether another spelling is the same host."""
    key = F.col("s_suppkey").cast("string")
    asked = F.concat(F.lit("WEB"), key, F.lit(".corp.example:"), (F.col("s_nationkey") + 9000).cast("string"))
    web, turn = F.concat(F.lit("web"), key), F.col("s_suppkey") % 4
    known = F.when(turn == 0, web).when(turn == 1, F.concat(web, F.lit(".corp.example"))).when(turn == 2, F.concat(web, F.lit(".other.example"))).otherwise(F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 250).cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(T.host_forms(asked), ",").alias("forms"), T.same_host(asked, known).alias("same"))


@query()
def section_pieces(spark, sf_dir):
    """Pieces of every conversation written as a page, a heading a turn and role, cut at its sections (cut rules have no SQL form; tests hold them)."""
    said = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(F.when(F.col("role") == "user", "# ").otherwise("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text")).alias("s")).alias("x"))
    pages = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("text"))
    return search.section_chunks(pages, "conv_id", "text")


@query(
    """WITH c AS (SELECT 'region-' || n_regionkey AS name, 'pattern' AS kind, n_name AS member FROM nation UNION ALL SELECT 'r' || n_regionkey, 'alias', n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'part-of-' || n_regionkey, 'alias', n_name FROM nation WHERE n_nationkey % 2 = 0
         UNION ALL SELECT 'stream-1', 'data_stream', n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, 'index', n_name FROM nation),
       s AS (SELECT name, kind, list_sort(list_distinct(list(member))) AS ms FROM c GROUP BY 1, 2), k AS (SELECT name, CASE WHEN name IN ('region-3', 'FRANCE') THEN 0 ELSE 1 END AS known, CASE kind WHEN 'data_stream' THEN 0 WHEN 'alias' THEN 1 WHEN 'pattern' THEN 2 ELSE 3 END AS r, kind, ms FROM s),
       b AS (SELECT ms, arg_min(name, (known, r, name)) AS best, count(*) - 1 AS others FROM k GROUP BY 1)
       SELECT name, kind, len(ms) AS n_members, CASE WHEN name = best THEN others ELSE 0 END AS stands_for, best AS same_as FROM k JOIN b USING (ms)"""
)
def one_table_each(spark, sf_dir):
    """Names of the same tables, and the one that is read for them: patterns, aliases of all or a part of them, a stream, plain tables."""
    n = table(spark, sf_dir, "nation")
    key, member = F.col("n_regionkey").cast("string"), F.col("n_name").alias("member")
    one = lambda df, name, kind: df.select(name.alias("name"), F.lit(kind).alias("kind"), member)
    parts = (
        one(n, F.concat(F.lit("region-"), key), "pattern"), one(n.where("n_regionkey <> 2"), F.concat(F.lit("r"), key), "alias"), one(n.where("n_nationkey % 2 = 0"), F.concat(F.lit("part-of-"), key), "alias"),
        one(n.where("n_regionkey = 1"), F.lit("stream-1"), "data_stream"), one(n, F.col("n_name"), "index"),
    )
    known = spark.createDataFrame([("region-3",), ("FRANCE",)], "name string")
    return tables.one_table_each(reduce(lambda a, b: a.unionByName(b), parts), known)


_SYNONYMS = (("economy", "hot"), ("small", "red"), ("large", "bolt"), ("brand", "widgets"), ("promo", "gear"), ("part", "rings"), ("standard", "standards"))
_LOW = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


@query(
    f"""WITH o AS (SELECT p_partkey AS object, list_distinct({_LOW.format('p_name')}) AS ts, {_LOW.format('p_type')} AS ws, {_LOW.format('p_brand')} AS ls FROM part),
       q AS (SELECT DISTINCT p_type AS query_id, unnest({_LOW.format("p_type || ' ' || p_brand || ' of part'")}) AS term FROM part), y AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _SYNONYMS)}) v(term, other)),
       a AS (SELECT query_id, q.term, list(other) FILTER (WHERE other IS NOT NULL) AS alts FROM (SELECT DISTINCT * FROM q) q LEFT JOIN y ON q.term = y.term GROUP BY 1, 2), p AS (SELECT object, query_id, term, coalesce(alts, []) AS alts, ts, ws, ls FROM a, o),
       k AS (SELECT object, query_id, len(ts) AS n, CASE WHEN list_contains(ts, term) THEN 1 WHEN list_has_any(alts, ts) THEN 2
           WHEN len(list_filter(ts, lambda t: length(t) >= 4 AND len(list_filter(alts || [term], lambda x: length(x) >= 4 AND (starts_with(t, x) OR starts_with(x, t)))) > 0)) > 0 THEN 3 WHEN list_has_any(alts || [term], ws) THEN 4 ELSE 5 END AS kind, list_contains(ls, term) AS listed FROM p),
       s AS (SELECT query_id, object, any_value(n) AS n, sum(CASE kind WHEN 1 THEN 3.0 WHEN 2 THEN 2.0 WHEN 3 THEN 1.5 WHEN 4 THEN 1.0 ELSE 0.0 END + CASE WHEN listed THEN 1.0 ELSE 0.0 END) AS total, count(*) FILTER (WHERE kind <= 3) AS matched, count(*) FILTER (WHERE kind < 5 OR listed) AS told FROM k GROUP BY 1, 2)
       SELECT query_id, object, round((total + CASE WHEN matched >= 2 THEN 1 ELSE 0 END - 0.1 * greatest(0, n - matched))::DOUBLE, 6) AS score FROM s WHERE told > 0"""
)
def resolved_objects(spark, sf_dir):
    """All parts that tell of what is asked, by words, synonyms and starts of their names, descriptions and labels."""
    part = table(spark, sf_dir, "part")
    low = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    objects = part.select(F.col("p_partkey").alias("object"), low(F.col("p_name")).alias("tokens"), low(F.col("p_type")).alias("words"), low(F.col("p_brand")).alias("labels"))
    asked = part.select(F.col("p_type").alias("query_id"), F.explode(low(F.concat_ws(" ", "p_type", "p_brand", F.lit("of part")))).alias("term"))
    return search.resolved(objects, asked, spark.createDataFrame(list(_SYNONYMS), "term string, other string"))
