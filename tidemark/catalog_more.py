"""Further queries: spellings, records about values, frames, links by co-occurrence, routing, term statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog_text import _INDEX, _Q, _asked, _index, _terms_sql
from tidemark.functions import text as T
from tidemark.operators import logs, records, search
from tidemark.operators.routing import Route, receivers
from tidemark.registry import query
from tidemark.sources.tables import table


@query(
    r"""WITH k AS (SELECT s_suppkey, s_name, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g'), '(^|[a-z])0+([0-9])', '\1\2', 'g') AS key FROM supplier),
        a AS (SELECT 'supplier ' || s_suppkey AS asked FROM supplier), b AS (SELECT asked, regexp_replace(regexp_replace(lower(asked), '[^a-z0-9]+', '', 'g'), '(^|[a-z])0+([0-9])', '\1\2', 'g') AS key FROM a)
        SELECT asked, s_suppkey, s_name FROM b JOIN k USING (key)"""
)
def respelled_values(spark, sf_dir):
    """Values as somebody wrote them, with the stored value that differs in case, separators or leading zeros only."""
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", T.loose_key(F.col("s_name")).alias("key"))
    asked = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("asked"))
    return asked.withColumn("key", T.loose_key(F.col("asked"))).join(names, "key").select("asked", "s_suppkey", "s_name")


@query(
    """WITH w AS (SELECT n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 3)
       SELECT 'customer' AS source, c_custkey AS record FROM customer WHERE c_nationkey IN (SELECT k FROM w) UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey IN (SELECT k FROM w)"""
)
def records_about(spark, sf_dir):
    """Records of every table with a field that names one of the wanted parts."""
    wanted = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_regionkey = 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    fields = [("customer", table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey"), ("supplier", table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")]
    return records.records_about(fields, wanted.select(F.col("n_nationkey").alias("value"))).select("source", F.col("record").cast("long").alias("record"))


@query(
    r"""WITH s AS (SELECT l_partkey, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1), n AS (SELECT max(l_shipdate) AS newest FROM lineitem), q AS (SELECT *, last_seen < newest - INTERVAL 60 DAY AS silent FROM s, n),
        t AS (SELECT p_partkey AS l_partkey, p_partkey % 7 = 0 AS told FROM part UNION ALL SELECT -1, TRUE)
        SELECT l_partkey, last_seen, CASE WHEN silent AND told THEN 'silent and said' WHEN told THEN 'said' ELSE 'silent' END AS why FROM q FULL JOIN (SELECT * FROM t WHERE told) USING (l_partkey) WHERE coalesce(silent, FALSE) OR coalesce(told, FALSE)"""
)
def retired_or_said(spark, sf_dir):
    """Parts that are silent, that a text says are no more, or both; one is known from its text alone."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 7 == 0, "It was REPLACED BY another.").otherwise("It replaced another; retiredness unknown.").alias("text"))
    said = part.unionByName(spark.createDataFrame([(-1, "Arrêté, n'est plus utilisé.")], part.schema))
    return records.retired(table(spark, sf_dir, "lineitem"), "l_partkey", "l_shipdate", 60, said)


@query(
    """SELECT role, count(*) AS n, median(length(text))::DOUBLE AS middle, round(quantile_cont(length(text), 0.9), 6)::DOUBLE AS p90, round(100.0::DOUBLE * count(*) FILTER (WHERE length(text) > 400) / count(*), 6) AS long_share FROM conversations GROUP BY 1"""
)
def answer_stats(spark, sf_dir):
    n = F.length("text")
    return (
        table(spark, sf_dir, "conversations").groupBy("role")
        .agg(F.count("*").alias("n"), F.median(n).alias("middle"), F.round(F.percentile(n, F.lit(0.9)), 6).alias("p90"), F.round(F.lit(100.0) * F.count_if(n > 400) / F.count("*"), 6).alias("long_share"))
    )


@query(
    """WITH r AS (SELECT event_id, user_id, ts, date_diff('day', DATE '2024-01-01', ts::DATE) // 10 AS third FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, third ORDER BY ts DESC, event_id) AS rn FROM r)
       SELECT event_id, user_id, third, rn FROM f WHERE rn <= 3"""
)
def rank_frames(spark, sf_dir):
    """The latest rows of each third of a window."""
    found = records.frames(table(spark, sf_dir, "events"), ["user_id"], "ts", "2024-01-01", 10, 3, "event_id")
    return found.select("event_id", "user_id", F.col("frame").alias("third"), "rn")


@query(
    """WITH l AS (SELECT DISTINCT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE source IN ('src1', 'src2'))
       (SELECT 'adds' AS side, line FROM l WHERE source = 'src1' AND line <> '' AND line NOT IN (SELECT line FROM l WHERE source = 'src2'))
       UNION ALL (SELECT 'leaves out', line FROM l WHERE source = 'src2' AND line <> '' AND line NOT IN (SELECT line FROM l WHERE source = 'src1'))"""
)
def statement_diff(spark, sf_dir):
    """Lines that one of two sources has and the other has not."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).select("source", F.trim("line").alias("line")).where("line != ''")
    return records.sides(lines, "source", "line", "src1", "src2")


_FIELDS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, round(count({c}) / count(*), 6) AS filled, count(DISTINCT {c}) AS n_values, count({c}) >= 0.5 * count(*) AND count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) < 0.5 * count({c}) AS localizes FROM orders"
        for c in _FIELDS
    )
)
def unfilled_fields(spark, sf_dir):
    """Which fields can say where a change lies: filled in half the rows, more than one value, not a value a row."""
    return records.localizing_fields(table(spark, sf_dir, "orders"), list(_FIELDS))


@query(
    """WITH m AS (SELECT event_type || ' by user ' || user_id AS message FROM events)
       SELECT CASE WHEN regexp_matches(message, '(?i)\\b(error|fail(ed|ure)?|exception)\\b') THEN 'error' WHEN regexp_matches(message, '(?i)\\b(warn(ing)?|purchase)\\b') THEN 'warning' ELSE 'info' END AS level, count(*) AS n FROM m GROUP BY 1"""
)
def level_from_text(spark, sf_dir):
    message = F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string"), F.when(F.col("event_type") == "purchase", " warning").otherwise(""))
    level = logs.level(message)
    return table(spark, sf_dir, "events").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT event_type, user_id, ts::DATE AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2, 3)
       SELECT event_type, user_id, count(*) AS n_days, median(n)::DOUBLE AS usual FROM d GROUP BY 1, 2 HAVING count(*) >= 4"""
)
def usual_patterns(spark, sf_dir):
    """Patterns present on most earlier days, with their median lines a day."""
    return records.usual_counts(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "2024-01-08", "2024-01-15", 4)


@query(
    f"WITH {_INDEX}, {_Q}, h AS (SELECT query_id, doc_id, count(*) AS hits FROM idx JOIN q USING (term) GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rn FROM h) SELECT query_id, doc_id, hits, rn FROM t WHERE rn <= 5"
)
def term_hits(spark, sf_dir):
    """The documents that hold most of a query's terms."""
    hits = _index(spark, sf_dir).join(_asked(spark, sf_dir), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")
    return hits.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("query_id", "doc_id", "hits", "rn")


@query(f"WITH t AS (SELECT {_terms_sql('text')} AS ts FROM documents), p AS (SELECT unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS pair FROM t) SELECT pair, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 3")
def adjacent_words(spark, sf_dir):
    """Pairs of terms found side by side at least three times."""
    ts = table(spark, sf_dir, "documents").select(T.terms(F.col("text")).alias("ts")).where(F.size("ts") > 1)
    pairs = ts.select(F.explode(F.zip_with(F.expr("slice(ts, 1, size(ts) - 1)"), F.expr("slice(ts, 2, size(ts) - 1)"), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).where("n >= 3")


@query("WITH i AS (SELECT page_id, unnest(regexp_extract_all(url, '[A-Za-z]+_[A-Za-z_]+')) AS name FROM pages) SELECT name, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM i GROUP BY 1")
def identifiers_in_text(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit("[A-Za-z]+_[A-Za-z_]+"), F.lit(0))).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query(
    """WITH l AS (SELECT event_type, user_id, count(DISTINCT ts::DATE) AS n_days, max(ts)::DATE AS last_day FROM events GROUP BY 1, 2 HAVING count(DISTINCT ts::DATE) >= 5)
       SELECT *, last_day < (SELECT max(ts)::DATE FROM events) - 7 AS stale FROM l"""
)
def cooccurrence_links(spark, sf_dir):
    """Values seen together on at least five days, and whether the link has not been seen for a week."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    last = events.agg(F.max("day").alias("newest"))
    links = events.groupBy("event_type", "user_id").agg(F.countDistinct("day").alias("n_days"), F.max("day").alias("last_day")).where("n_days >= 5")
    return links.join(F.broadcast(last)).withColumn("stale", F.col("last_day") < F.date_sub("newest", 7)).drop("newest")  # one row


@query("SELECT l_partkey, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1 HAVING max(l_shipdate) < (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 60 DAY")
def retired_parts(spark, sf_dir):
    """Parts silent for sixty days before the newest row."""
    return records.retired(table(spark, sf_dir, "lineitem"), "l_partkey", "l_shipdate", 60).drop("why")


@query("SELECT c_custkey, r_name || ' > ' || n_name || ' > ' || c_name AS lineage FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lineage_up(spark, sf_dir):
    """The chain of holders of each customer, outermost first."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    held = lambda df, node, holder: df.select(F.col(node).alias("node"), F.col(holder).alias("holder"))
    up = held(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "n_name").unionByName(held(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name"))
    found = records.lineage(c.select(F.col("c_name").alias("node")), up)
    return c.select("c_custkey", F.col("c_name").alias("node")).join(found, "node").select("c_custkey", F.array_join("lineage", " > ").alias("lineage"))


ROUTES = Route(
    "desk",
    children=(
        Route("audit", (("event_type", "=~", "purch.*"),), go_on=True),
        Route("web", (("event_type", "=", "error"),), children=(Route("first users", (("user_id", "=~", "[0-4]"),)), Route(None, (("user_id", "!=", "9"), ("user_id", "!~", "1.*"))))),
        Route("sales", (("event_type", "=", "purchase"), ("user_id", "!=", "3"))),
    ),
)


@query(
    """WITH r AS (SELECT unnest(CASE WHEN event_type = 'error' AND user_id BETWEEN 0 AND 4 THEN ['first users'] WHEN event_type = 'error' THEN ['web']
       WHEN event_type = 'purchase' AND user_id = 3 THEN ['audit'] WHEN event_type = 'purchase' THEN ['audit', 'sales'] ELSE ['desk'] END) AS receiver FROM events) SELECT receiver, count(*) AS n FROM r GROUP BY 1"""
)
def alert_routes(spark, sf_dir):
    """Events by the receivers that a policy tree sends them to."""
    return table(spark, sf_dir, "events").select(F.explode(receivers(ROUTES)).alias("receiver")).groupBy("receiver").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type IN ('error', '7') OR user_id::VARCHAR IN ('error', '7')")
def names_hit(spark, sf_dir):
    """Rows of which any label has any of the wanted names."""
    labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").where(F.exists(F.map_values(labels), lambda v: v.isin("error", "7"))).select("event_id")


@query(
    """WITH j AS (SELECT n_regionkey AS region, o_orderpriority = '1-URGENT' AS focus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE focus) AS f FROM j),
       g AS (SELECT region, count(*) AS n_all, count(*) FILTER (WHERE focus) AS n_focus FROM j GROUP BY 1) SELECT region, n_all, n_focus, round((n_focus / f) / (n_all / n), 6) AS lift FROM g, t"""
)
def derived_lift(spark, sf_dir):
    """Lift of a joined attribute among focus rows."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    found = records.lift_of(rows, ["n_regionkey"], F.col("o_orderpriority") == "1-URGENT")
    return found.select(F.col("value").cast(n.schema["n_regionkey"].dataType).alias("region"), "n_all", "n_focus", "lift")


@query(f"WITH t AS (SELECT role, unnest(list_distinct({_terms_sql('text')})) AS term FROM conversations) SELECT role, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 3")
def word_associations(spark, sf_dir):
    """Words and the roles whose turns hold them, three turns at least."""
    return records.associations(table(spark, sf_dir, "conversations"), "role", T.terms(F.col("text")), 3)


@query(f"WITH {_INDEX}, v AS (SELECT term, count(*) AS n_docs FROM idx GROUP BY 1) SELECT term, round(0.7::DOUBLE + 0.3::DOUBLE * ln((SELECT count(*) FROM documents) / n_docs) / ln((SELECT count(*) FROM documents)), 6) AS weight FROM v")
def rarity_weights(spark, sf_dir):
    """Weight of each term: 0.7 in all documents, 1 in a single one."""
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("total"))
    weight = F.lit(0.7) + F.lit(0.3) * F.log(F.col("total") / F.col("n_docs")) / F.log(F.col("total"))
    return search.vocabulary(_index(spark, sf_dir)).join(F.broadcast(total)).select("term", F.round(weight, 6).alias("weight"))  # one row


@query("SELECT date_diff('day', ts::DATE, DATE '2024-01-29') // 7 AS weeks_back, event_type, count(*) AS n FROM events WHERE date_diff('day', ts::DATE, DATE '2024-01-29') IN (0, 7, 14, 21) GROUP BY 1, 2")
def reference_days(spark, sf_dir):
    """One day beside the same weekday one to three weeks before, in one scan."""
    return records.same_weekdays(table(spark, sf_dir, "events"), ["event_type"], "ts", "2024-01-29", 3)


@query(
    """WITH s AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) SELECT l_suppkey, count(*) AS n_others FROM lineitem
       WHERE l_suppkey IN (SELECT l_suppkey FROM s) AND NOT (l_returnflag = 'R' AND l_quantity > 49) GROUP BY 1"""
)
def others_sharing(spark, sf_dir):
    """Rows outside the scope that share a value found inside it."""
    lines, scope = table(spark, sf_dir, "lineitem"), (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)
    return lines.groupBy("l_suppkey").agg(F.count_if(~scope).alias("n_others"), F.max(scope).alias("inside")).where("inside and n_others > 0").drop("inside")


@query("SELECT n_nationkey, sha256(concat_ws('|', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR)) AS fingerprint FROM nation")
def row_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"), 256).alias("fingerprint"))


_WORDS = f"list_filter(string_split(regexp_replace(translate(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '{T.MARKED}', '{T.FOLDED}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x IN ({{}}))"


def _common_sql(lang: str) -> str:
    return f"len({_WORDS.format(', '.join(repr(w) for w in T.COMMON[lang]))})"


@query(f"SELECT doc_id, CASE WHEN greatest({_common_sql('fr')}, {_common_sql('en')}) < 2 THEN 'unclear' WHEN {_common_sql('fr')} > {_common_sql('en')} THEN 'fr' ELSE 'en' END AS language FROM documents WHERE text IS NOT NULL")
def language_by_words(spark, sf_dir):
    """en or fr, by whose common words a text has more of; unclear below two."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.language(F.col("text")).alias("language"))
