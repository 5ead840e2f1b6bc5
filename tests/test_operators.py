"""Operators on small hand-made inputs: edge cases that the tables do not hold."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions import text as T
from tidemark.operators import entities, groups, guards, logs, search, series
from tidemark.plans.plan import Cond, Counter, Measure, Plan, Step, StepColumn, all_of, condition, factor, run_plan, validate
from tidemark.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_conditions(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    pick = lambda c: [r.n for r in df.where(condition(c)).orderBy("n").collect()]
    assert pick(Cond("n", "in", [])) == [] and pick(Cond("n", "not in", [])) == [1, 2, 3]
    assert pick(Cond("n", "=", [1, 3])) == [1, 3] and pick(Cond("n", "!=", [1])) == [2, 3]
    assert pick(Cond("s", "is null")) == [2] and pick(Cond("s", "like", "a%")) == [1]


def test_plan_is_checked(spark):
    df = spark.createDataFrame([(1,)], "n int")
    step = Step("q1", "t", (Measure("m", "median", "n"),), ("x",), (Cond("n", "~", 1), Cond("n", "in", StepColumn("q9", "n"))))
    errors = " ".join(validate(Plan((step,)), {"t": ["n"]}))
    assert all(w in errors for w in ("no function median", "no column x", "no comparison ~", "q9"))
    with pytest.raises(ValueError):
        run_plan(Plan((step,)), {"t": df})


def test_step_values_with_null_do_not_empty_the_exclusion(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    steps = (Step("q1", "a", (Measure("n", "count"),), ("k",)), Step("q2", "b", (Measure("n", "count"),), ("k",), (Cond("k", "not in", StepColumn("q1", "k")),)))
    assert rows(run_plan(Plan(steps), {"a": a, "b": b})["q2"]) == [(2, 1)]


def test_units():
    assert factor("h", "s") == 3600 and factor("mb", "kb") == 1024
    with pytest.raises(ValueError):
        factor("h", "kb")


def test_filters_reach_the_scan(spark):
    from tests.conftest import SF

    step = Step("q1", "orders", (Measure("n", "count"),), ("o_orderstatus",), (Cond("o_totalprice", ">", 1000.0),))
    plan = run_plan(Plan((step,)), {"orders": tables.table(spark, SF, "orders")})["q1"]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_custkey" not in plan


def test_breaches(spark):
    df = spark.sql("select 'x' s, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,60 * id) ts, cast(if(id in (2,3,4,9), 5, 1) as double) v from range(12)")
    found = series.breaches(df, ["s"], "ts", "v", 3.0, 60, 120).collect()
    assert [(r.n_samples, r.seconds) for r in found] == [(3, 180)]


def test_counter_restarts(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 2.0)], "t long, v double").select(F.lit("s").alias("s"), F.timestamp_seconds("t").alias("t"), "v")
    assert [r.increase for r in series.increase(df, ["s"], "t", "v").orderBy("t").collect()] == [0.0, 4.0, 2.0]


def test_counters_are_stitched_at_the_edges_of_chunks(spark):
    """Restarts, gaps of many chunks and null labels, against the samples in order; chunks of 10 s."""
    rng, rows_ = random.Random(3), []
    for label in ("a", "b", None):
        t = 0
        for _ in range(80):
            t += rng.choice([1, 1, 9, 10, 11, 45])
            rows_.append((label, t, float(rng.choice([0, 1, 5, 5, 30]) if t % 10 else 0)))  # the counter begins anew where a chunk does
    df = spark.createDataFrame(rows_, "s string, t long, v double").select("s", F.timestamp_seconds("t").alias("at"), "t", "v")
    want, last = {}, {}
    for s, t, v in rows_:
        before = last.get(s)
        want[s, t] = (0.0, None) if before is None else (v if v < before[1] else v - before[1], (v if v < before[1] else v - before[1]) / (t - before[0]))
        last[s] = (t, v)
    got = {(r.s, r.t): (r.increase, r.rate) for r in series.increase(df, ["s"], "at", "v", chunk=10).collect()}
    assert got == want
    period = ("1970-01-01 00:03:00", "1970-01-01 00:05:00")
    inside = {(r.s, r.t): (r.increase, r.rate) for r in series.increase_within(df.withColumn("at", F.col("at").cast("timestamp_ntz")), ["s"], "at", "v", period, chunk=10).collect()}
    assert inside == {k: x for k, x in want.items() if 180 <= k[1] < 300} and len(inside) > 20
    changes = {r.s: (r.n_changes, r.n_resets) for r in series.changes(df, ["s"], "at", "v", chunk=10).collect()}
    for s in ("a", "b", None):
        v = [x[2] for x in rows_ if x[0] == s]
        assert changes[s] == (sum(x != y for x, y in zip(v, v[1:], strict=False)), sum(y < x for x, y in zip(v, v[1:], strict=False)))


def test_counter_measures_of_plans(spark):
    """A label's condition leaves whole series, so increases do not change; a value's condition drops samples after they are measured."""
    rows_ = [("get", "200", t, float(10 * t)) for t in range(1, 7)] + [("get", "500", t, float(t if t < 4 else t - 3)) for t in range(1, 7)]
    df = spark.createDataFrame(rows_, "verb string, code string, t long, value double").select("verb", "code", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "value")
    counter = Counter(("verb", "code"))
    ms = (Measure("grown", "increase"), Measure("failed", "share", where=(Cond("code", "=", "500"),)), Measure("up", "formula", formula="availability_pct"))
    run = lambda step: run_plan(Plan((step,)), {"t": df})["q1"].collect()
    (row,) = run(Step("q1", "t", ms, ("verb",), time_field="ts", counter=counter))
    assert (row.grown, round(row.failed, 6), round(row.up, 6)) == (55.0, round(500 / 55, 6), round(100 - 500 / 55, 6))
    (row,) = run(Step("q1", "t", ms[:1], (), (Cond("code", "=", "500"), Cond("value", ">", 1.5)), time_field="ts", counter=counter))
    assert row.grown == 4.0  # 1, 2 and 3 grow by 1; after the restart 2 and 3 do
    (row,) = run(Step("q1", "t", ms[:1], (), (Cond("code", "=", "200"),), time_field="ts", period=("1970-01-01 00:00:03", "1970-01-01 00:00:05"), counter=counter))
    assert row.grown == 20.0  # the first sample of the period is measured from the one before it
    errors = " ".join(validate(Plan((Step("q1", "t", (Measure("x", "rate"), Measure("y", "quantile", q=1.5))),)), {"t": ["a"]}))
    assert "rate needs a counter" in errors and "q between 0 and 1" in errors


def test_verdict_needs_three_windows(spark):
    df = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 5.0), ("b", 0, 30.0), ("b", 1, 10.0), ("b", 2, 11.0), ("b", 3, 9.0)], "s string, k int, v double")
    assert {r.s: r.verdict for r in series.weeks_verdict(df, ["s"], "v").collect()} == {"a": "unknown", "b": "high"}


def test_groups_find_the_value_that_carries_the_change(spark):
    now = [(0, "n1")] * 60 + [(0, "n2")] * 20
    df = spark.createDataFrame(now + [(k, n) for k in range(1, 5) for n in ["n1"] * 20 + ["n2"] * 20], "k int, node string")
    found = groups.compare(groups.cube(df, ["node"]), df.select("k").distinct())
    assert [r.value for r in found.where("unusual and field = 'node'").collect()] == ["n1"]
    assert groups.localize(found).first().coverage == 1.0


def test_log_shapes(spark):
    lines = ["took 12.5 ms at 2024-01-02 03:04:05.", "took 7 ms at 2024-02-02 13:04:05", "user 'bob' 0xff failed"]
    df = spark.createDataFrame([(x,) for x in lines], "m string").select(logs.template(F.col("m")).alias("t"), logs.level(F.col("m")).alias("l"))
    assert [tuple(r) for r in df.collect()] == [("took # ms at #", "info"), ("took # ms at #", "info"), ("user '<value>' # failed", "error")]


def test_text_functions(spark):
    df = spark.range(1).select(
        T.words(F.lit("Café isOpen_now 42")).alias("w"), T.host(F.lit("https://u@Ex.Org:80/a?b")).alias("h"), T.page_key(F.lit("HTTP://www.Ex.org/A/?q=1#x")).alias("k"),
        T.mask_secrets(F.lit("password = hunter2, ok")).alias("m"), T.language(F.lit("le chat et la souris")).alias("l"), T.business_label(F.to_date(F.lit("2024-01-05")), F.to_date(F.lit("2024-01-08"))).alias("d"),
    )
    assert tuple(df.first()) == (["cafe", "is", "open", "now", "42"], "ex.org", "ex.org/a", "password = ***, ok", "fr", "D-1")


def test_one_slip(spark):
    pairs = [("ab", "ba"), ("form", "from"), ("kitten", "kittens"), ("kitten", "mitten"), ("a", "a"), ("kitten", "sitting"), ("abcd", "badc"), ("", "abc")]
    df = spark.createDataFrame(pairs, "a string, b string").select(search.one_slip(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in df.collect()] == [1, 1, 1, 1, 0, None, None, None]


def test_pieces_cover_the_text():
    text = " ".join(f"word{i}" for i in range(600))
    found = search.pieces(text, 500, 50)
    assert max(map(len, found)) <= 500 and all(w in " ".join(found) for w in text.split())
    assert search.pieces(None) == [] and search.sections("# A\nx\n```\n# no\n```\n## B\ny") == [(("A",), "# A\nx\n```\n# no\n```"), (("A", "B"), "## B\ny")]


def test_sections_are_packed():
    assert search.section_pieces(None) == [] and search.section_pieces("just text") == [("", "just text")]
    page = "intro\n# A #\n" + "a " * 300 + "\n## B\nbb\n~~~\n## not\n~~~\n# C\n" + "c " * 500 + "\n# D\n" + "d. " * 1200 + "\n### E\ne"
    found = search.section_pieces(page)
    assert "intro" in found[0][1] and found[0][0] == ""
    assert all(len(p) <= search.SECTION for _, p in found)
    assert [h for h, _ in found][-1] == "D > E" and sum(h == "D" for h, _ in found) == 2
    text = "\n".join(p for _, p in found)
    assert all(x in text for x in ("intro", "## B", "## not", "# C", "### E"))


def test_components_and_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y")], "a string, b string")
    assert rows(entities.connected(edges)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    g = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "src string, dst string")
    assert [r.path for r in entities.paths(g, "a", "c", 3).collect()] == [["a", "c"], ["a", "b", "c"]]


def test_name_verdicts(spark):
    df = spark.createDataFrame([("Order-Service", "order_service"), ("billing-prod", "billing-dev"), ("inventory", "inventoory"), ("api v1", "api v2"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(entities.verdict(F.col("a"), F.col("b"))).collect()] == ["strong", "noenv", "typo", "doubt", "none"]


def test_guards():
    assert guards.check("SELECT a FROM t WHERE x = 'or' AND y = 2") == [] and "not_one_select" in guards.check("SELECT 1; DROP TABLE t")
    assert guards.check("SELECT a FROM t LEFT JOIN u ON t.i = u.i WHERE u.i IS NULL") == [] and "not_one_select" in guards.check(None)


def test_families_and_backup(spark, tmp_path):
    assert tables.families(["logs-2026.09.27", "logs-2026.09.28", "app-1", "users"]) == {"logs-*": ["logs-2026.09.27", "logs-2026.09.28"], "app-1": ["app-1"], "users": ["users"]}
    df = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    tables.backup({"t": df}, str(tmp_path / "b"))
    assert rows(tables.restore(spark, str(tmp_path / "b"))["t"]) == rows(df)
    assert tables.with_truncation(df, 1)[1] and not tables.with_truncation(df, 2)[1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "ts timestamp_ntz, s string, v double")
    assert series.breaches(empty, ["s"], "ts", "v", 1.0, 60, 60).count() == 0
    assert entities.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def _labels_around(edges, rounds):
    """Label propagation by hand over (a, b, w)."""
    label = {n: n for e in edges for n in e[:2]}
    for _ in range(rounds):
        around = {n: {} for n in label}
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                around[x][label[y]] = around[x].get(label[y], 0) + w
        label = {n: min(v, key=lambda k: (-v[k], k)) for n, v in around.items()}
    return label


def test_graph_queries_see_all_lines(spark):
    from tidemark import catalog

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    edges = collections.Counter((f"o{r.l_orderkey}", f"p{r.l_partkey}") for r in lines)
    up = {n: n for e in edges for n in e}

    def root(n):
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert {r.node: r.component for r in catalog.queries()["connected_components_all"](spark, SF).collect()} == {n: root(n) for n in up}
    want = _labels_around([(*e, w) for e, w in edges.items()], 4)
    assert {r.node: r.label for r in catalog.queries()["communities"](spark, SF).collect()} == want


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(100)], "a string, b string")
    with pytest.raises(RuntimeError):
        entities.connected(chain, most_rounds=2)
    assert {r.component for r in entities.connected(chain).collect()} == {"n000"}


def test_candidate_pairs_of_large_blocks(spark, monkeypatch):
    """Blocks of over 200 names, compared in several tiles, and pairs of representatives that stand for all rows."""
    from tidemark.operators import entities

    monkeypatch.setattr(entities, "TILE", 100)
    names = [(i, f"{('red', 'blue')[i % 2]} {('ring', 'bolt', 'plate')[i % 3]}" if i % 50 else ("-", None, "lone")[i // 50 % 3]) for i in range(600)]
    blocks = [{*(n or "").split(), (n or "").replace(" ", "")} - {"", "-"} for _, n in names]
    want = {(a, b) for a in range(600) for b in range(a + 1, 600) if blocks[a] & blocks[b]}
    df = spark.createDataFrame(names, "id long, name string")
    assert {tuple(r) for r in entities.candidate_pairs(df, "id", "name").collect()} == want
    members = entities.name_members(df, "id", "name")
    stands = {r.id: r.representative for r in members.collect()}
    assert len(stands) == 600
    few = df.join(members.where("id = representative").select("id"), "id", "left_semi")
    pairs = {tuple(r) for r in entities.candidate_pairs(few, "id", "name").collect()}
    assert len(pairs) < 30
    same = lambda a, b: stands[a] == stands[b] or (min(stands[a], stands[b]), max(stands[a], stands[b])) in pairs
    assert {(a, b) for a in range(600) for b in range(a + 1, 600) if same(a, b)} == want


def test_stream_equals_batch(spark, tmp_path):
    from tests.conftest import SF
    from tidemark.streaming import windows

    events = tables.table(spark, SF, "events")
    stream = windows.tumbling(windows.source(spark, f"{SF}/events.parquet", events), "ts", "1 hour", ["event_type"])
    q = stream.writeStream.format("memory").queryName("t").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    batch = windows.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"])
    assert rows(spark.table("t").drop("total")) == rows(batch.drop("total"))


def test_alike_misses_no_pair(spark):
    names = "amber birch cedar delta ember fjord grove haven inlet jetty".split()
    texts = [(i, " ".join(names[(i * k) % 10] for k in range(1, 3 + i % 6))) for i in range(40)] + [(90, ""), (91, None), (92, "amber")]
    df = spark.createDataFrame(texts, "id long, text string")
    sets = {r.id: set(r.ts or ()) for r in df.select("id", T.terms(F.col("text")).alias("ts")).collect()}
    for least in (0.3, 0.6, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(r.a, r.b) for r in search.alike(df, "id", F.col("text"), least).collect()} == want and want


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)], "src long, dst long")
    assert {r.node: r.component for r in entities.strong_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_runs_cross_midnight(spark):
    df = spark.sql("select 'x' s, timestamp_ntz'2024-01-01 22:30:00' + make_interval(0,0,0,0,0,0,1800 * id) ts, cast(if(id in (1,2,3,4,5,9), 5, 1) as double) v from range(100)")
    found = series.breaches(df, ["s"], "ts", "v", 3.0, 1800, 3600).orderBy("from_time").collect()
    assert [(r.n_samples, r.seconds) for r in found] == [(5, 9000)]


def test_closest_columns(spark):
    asked, columns = spark.createDataFrame([("order key",)], "asked string"), spark.createDataFrame([("o_orderkey",), ("orderkey",), ("custkey",)], "column string")
    assert rows(search.closest_columns(asked, columns)) == [("order key", "o_orderkey", 0.9), ("order key", "orderkey", 1.0)]


def test_pieces_fit_and_cover():
    text = "".join(f"Sentence {i}. " for i in range(50)) + "\n\n" + "".join(f"word{i} " for i in range(400)) + "".join(map(str, range(800)))
    for size, overlap in ((100, 20), (1200, 150)):
        cut = search.pieces(text, size, overlap)
        assert all(0 < len(p) <= size for p in cut) and all(p in text for p in cut)
        at = 0
        for p in cut:  # nothing but blanks between a piece and what came before it
            start = text.find(p, max(0, at - overlap - 1))
            assert start <= at or not text[at:start].strip()
            at = max(at, start + len(p))
        assert not text[at:].strip()


def test_day_periods_and_typed_literals(spark):
    from tidemark.plans.plan import day_periods, ruled, typed, unit_of

    df = spark.sql("select * from values (1, timestamp_ntz'2024-03-05 00:00:00', '07'), (2, timestamp_ntz'2024-03-05 23:59:59', '7'), (3, timestamp_ntz'2024-03-06 00:00:00', '7') t(n, at, s)")
    pick = lambda *c: [r.n for r in df.where(all_of(typed(day_periods(c, df.schema), df.schema))).orderBy("n").collect()]
    assert pick(Cond("at", "=", "2024-03-05")) == [1, 2] and pick(Cond("n", "in", ["01", "3"])) == [1, 3] and pick(Cond("s", "=", "7")) == [2, 3]
    assert (unit_of("took_ms"), unit_of("size", {"size": "mb"}), unit_of("count")) == ("ms", "mb", None)
    step = ruled(Step("q", "t", (Measure("n", "count"),)), {"t": {"x": Cond("n", ">", 1), "y": Cond("n", "<", 9)}}, ("y",))
    assert [c.op for c in step.where] == [">"]


def test_plans_cut_only_at_their_limit(spark):
    df = spark.range(3000).selectExpr("id k")
    step = Step("q1", "t", (Measure("n", "count"),), ("k",), order="n")
    assert run_plan(Plan((step,)), {"t": df})["q1"].count() == 3000


def test_severity_beats_the_alphabet(spark):
    counts = spark.createDataFrame([("x", "warning", 0, 9), ("x", "fatal", 0, 1), ("x", "info", 1, 1)], "template string, level string, k int, n long")
    assert logs.judge(counts, 3).first().level == "fatal"


def test_values_in_longer_values_are_covered(spark):
    values = spark.createDataFrame([("c", "York"), ("c", "New York"), ("s", "Open")], "field string, value string")
    asked = spark.createDataFrame([(1, "open orders of New York"), (2, "york only")], "id int, q string")
    assert rows(search.value_places(asked, "id", F.col("q"), values).select("id", "value")) == [(1, "New York"), (1, "Open"), (2, "York")]


def test_measures_that_texts_name():
    from tidemark.plans.plan import measure_of

    assert measure_of(" Ratio( a , b ) ") == Measure("ratio_a_b", "ratio", "a", under="b")
    assert measure_of("average(x.y)", "m") == Measure("m", "avg", "x.y") and measure_of("count").function == "count"
    for text in ("median(x)", "avg", "ratio(a)", "count(x)", "avg(a, b)", "avg(a) + 1", ""):
        with pytest.raises(ValueError):
            measure_of(text)


def test_runs_recur_over_days_with_data(spark):
    rows = [("a", f"2024-01-{d:02d} 10:{m:02d}:00", 9.0) for d in (8, 9, 10) for m in (0, 1, 2)] + [("a", f"2024-01-{d:02d} 12:00:00", 1.0) for d in range(4, 11)]
    rows += [("b", f"2024-01-10 10:{m:02d}:00", 9.0) for m in (0, 1, 2)] + [("b", f"2024-01-0{d} 10:00:00", 1.0) for d in (7, 8)]
    rows += [("c", f"2024-01-{d:02d} 10:{m:02d}:00", 9.0) for d in (7, 8, 9, 10) for m in (0, 1, 2)]
    df = spark.createDataFrame(rows, "s string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = series.recurring_runs(df, ["s"], "ts", "v", 5.0, 60, 120, "2024-01-10", "2024-01-11")
    assert {r.s: (r.n_runs, r.days_on, r.days_seen, r.verdict) for r in found.collect()} == {"a": (1, 2, 6, "not usual"), "b": (1, 0, 2, "unknown"), "c": (1, 3, 3, "usual")}


def test_questions_on_structure():
    assert "depends?" in search.STRUCTURE and "metrics?" in search.FIGURES
