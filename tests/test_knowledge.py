"""Names in texts, subjects of messages, candidates and sketches against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions.text import STOP
from tidemark.operators import candidates, names, sketches, subjects

ATOM = re.compile(names.ATOM)


def plain_names(text, dictionary):
    atoms = [re.sub(r"[.:/-]+$", "", a) for a in ATOM.findall(text or "")]
    known, free, spelled = {}, set(), {}
    for name in sorted(dictionary):
        raw = [re.sub(r"[.:/-]+$", "", a) for a in ATOM.findall(name)]
        if 1 <= len(raw) <= names.LONGEST:
            key = " ".join(raw).lower()
            known.setdefault(key, name)
            if len(raw) == 1 and (len(raw[0]) < names.SHORT or raw[0].lower() in STOP):
                spelled.setdefault(key, set()).add(raw[0])
            else:
                free.add(key)
    out, i = [], 0
    while i < len(atoms):
        for n in range(min(names.LONGEST, len(atoms) - i), 0, -1):
            key = " ".join(atoms[i : i + n]).lower()
            if key in known and (key in free or atoms[i] in spelled[key]):
                out.append((i, n, known[key]))
                i += n
                break
        else:
            i += 1
    return out


def test_names_in_texts(spark):
    rng = random.Random(5)
    words = ["risk", "engine", "order", "desk", "The", "of", "db-01", "web01.corp", "POOL_A", "x", "NOVA", "über"]
    dictionary = {" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(60)} | {"risk engine", "risk", "THE", "OF", "X", "a b c d e", "a b c d e f", "!!", ""}
    texts = [(i, ", ".join(" ".join(rng.choices([*words, "RISK", "Engine", "the", "zzz"], k=rng.randrange(1, 30))) for _ in range(rng.randrange(4)))) for i in range(80)]
    texts += [(100, None), (101, ""), (102, "a b c d e f. Risk engine."), (103, "the THE of OF x X"), (104, "risk " * 300)]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("name", F.lit("q")).withColumn("place", F.lit(1))
    found = names.names_in(df, "id", F.col("text"), spark.createDataFrame([(n,) for n in dictionary] + [(None,)], "name string"))
    got = sorted((r.id, r.place, r.n_words, r.name) for r in found.collect())
    assert got == sorted((i, *x) for i, t in texts for x in plain_names(t, dictionary)) and len(got) > 500


def test_names_of_a_table_in_all_documents(spark):
    """A dictionary of every three words that follow each other in a document, against whole documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    some = {" ".join(ATOM.findall(t)[k : k + 3]) for t in texts.values() for k in range(0, 60, 7)} - {""}
    found = names.names_in(docs, "doc_id", F.col("text"), spark.createDataFrame([(n,) for n in some], "name string"))
    got = sorted((r.doc_id, r.place, r.n_words, r.name) for r in found.collect())
    assert got == sorted((i, *x) for i, t in texts.items() for x in plain_names(t, some)) and len(got) > 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan


def test_subjects(spark):
    rows = [
        (1, 1, ["failure", "rate"], ["jobs"], ["BILLING"]), (1, 2, ["latency"], ["requests"], ["CARE"]), (1, 3, ["hour"], [], []), (1, 4, ["rate"], ["jobs"], ["BILLING"]),
        (1, 5, ["latency"], [], ["CARE", "BILLING"]), (1, 6, [], [], ["NEW"]), (1, 7, ["failure", "x", "y"], [], []), (1, 8, ["p", "q", "r"], [], []), (1, 9, None, None, None),
        (2, 2, ["a", "b"], [], []), (2, 1, [], ["t"], []), (None, 1, ["a"], [], []),
    ]
    df = spark.createDataFrame(rows, "conv long, turn int, words array<string>, tables array<string>, values array<string>").repartition(3)
    got = {(r.conv, r.turn): (r.subject, r.why) for r in subjects.subjects(df, "conv", "turn").collect()}
    assert [got[1, t] for t in range(1, 10)] == [
        (1, "first"), (2, "new"), (2, "no subject of its own"), (1, "back"), (1, "same"), (3, "new"), (3, "unsure"), (4, "new"), (4, "no subject of its own"),
    ]
    assert got[2, 1] == (1, "first") and got[2, 2][0] == 1 and got[None, 1] == (1, "first")
    assert subjects.subjects(df.where("false"), "conv", "turn").collect() == []


def test_subjects_of_random_conversations(spark):
    rng = random.Random(11)
    pick = lambda k, n: [rng.choice("abcdefgh") + k for _ in range(rng.randrange(n))]
    rows = [(c, t, pick("w", 5), pick("t", 2), pick("v", 2)) for c in range(20) for t in range(40)]
    rng.shuffle(rows)
    got = {(r.c, r.t): (r.subject, r.score) for r in subjects.subjects(spark.createDataFrame(rows, "c long, t long, words array<string>, tables array<string>, values array<string>"), "c", "t").collect()}
    for c in range(20):
        held, last, when = [], None, []
        for k, (_, t, w, ta, v) in enumerate(sorted(r for r in rows if r[0] == c)):
            score = [3 * len(set(v) & h[2]) + 2 * len(set(ta) & h[1]) + len(set(w) & h[0]) for h in held]
            top = max(range(len(held)), key=lambda i: (score[i], when[i]), default=None)
            if top is None:
                to = None
            elif score[top] >= 2:
                to = top if top == last or score[top] >= score[last] + 2 or score[last] < 2 else last
            elif (not ta and not v and len(set(w)) < 3) or score[top] > 0:
                to = last
            else:
                to = None
            if to is None:
                held.append((set(), set(), set()))
                when.append(0)
                to = len(held) - 1
            for mine, new in zip(held[to], (w, ta, v), strict=True):
                mine |= set(new)
            when[to], last = k + 1, to
            assert got[c, t] == (to + 1, max(score, default=0))


def some_sources(rng, questions):
    """Fifteen sources, three of which tell the chosen candidate and one misleads."""
    chosen, rows = [], {f"f{k}": [] for k in range(15)}
    for q in questions:
        good = rng.randrange(12)
        chosen.append((q, f"c{good}"))
        for c in range(12):
            for k in range(15):
                value = rng.random()
                if k < 3:
                    value = 0.55 * value + 0.45 * (c == good)
                if k == 3:
                    value = 0.7 * value + 0.3 * (c != good)
                if rng.random() < 0.7:
                    rows[f"f{k}"].append((q, f"c{c}", value))
    return chosen, rows


def test_candidates_are_ranked_better_by_learned_weights(spark):
    rng = random.Random(9)
    frame = lambda rows: spark.createDataFrame(rows, "query_id long, candidate string, value double")
    (seen, seen_rows), (held, held_rows) = some_sources(rng, range(150)), some_sources(rng, range(1000, 1100))
    names_ = list(seen_rows)
    wide = candidates.features({k: frame(v) for k, v in seen_rows.items()})
    plain = {}
    for k, v in seen_rows.items():
        for q, c, x in v:
            row = plain.setdefault((q, c), dict.fromkeys(names_, 0.0))
            row[k] = max(row[k], x)
    assert {(r.query_id, r.candidate): {k: r[k] for k in names_} for r in wide.collect()} == plain
    chosen = lambda rows: spark.createDataFrame(rows, "query_id long, candidate string")
    pairs = candidates.choices(wide, chosen(seen), names_)
    assert 1000 < pairs.count() <= 8 * 150
    weights = candidates.learned(pairs, names_, rounds=60, rate=0.5, pull=0.0)
    x, w = np.array([[r[k] for k in names_] for r in pairs.collect()]), np.ones(15)
    for _ in range(60):
        w = np.clip(w + 0.5 * (x / (1 + np.exp(x @ w))[:, None]).mean(0), 0, 3)
    assert np.allclose([weights[k] for k in names_], w, atol=1e-6)
    other = candidates.features({k: frame(v) for k, v in held_rows.items()})
    before, after = (candidates.mean_reciprocal_rank(candidates.scored(other, ws), chosen(held)) for ws in (dict.fromkeys(names_, 1.0), weights))
    assert after > before + 0.1 and weights["f0"] > 1.2 > 0.8 > weights["f3"]


def test_sources_by_rank_and_score(spark):
    hits = spark.createDataFrame([(1, "a", 1, 4.0), (1, "b", 2, 1.0), (2, "a", 1, 0.0)], "query_id long, candidate string, rn int, score double")
    assert sorted(map(tuple, candidates.by_rank(hits).collect())) == [(1, "a", 1.0), (1, "b", 0.5), (2, "a", 1.0)]
    assert sorted(map(tuple, candidates.by_score(hits).collect())) == [(1, "a", 1.0), (1, "b", 0.25), (2, "a", 0.0)]
    lists = {"rank": candidates.by_rank(hits), "score": candidates.by_score(hits.where("candidate = 'a'"))}
    assert {(r.query_id, r.candidate): (r["rank"], r.score) for r in candidates.features(lists).collect()} == {(1, "a"): (1.0, 1.0), (1, "b"): (0.5, 0.0), (2, "a"): (1.0, 0.0)}


def test_sketches_of_windows(spark):
    """Any window from stored days within the sketches' bounds; only new days are read; exact where a day is small."""
    rng = np.random.default_rng(2)
    rows = [(f"2024-01-{d + 1:02d} 00:00:00", s, float(x), f"m{int(i)}") for d in range(6) for s in ("a", "b") for x, i in zip(rng.gamma(2, 50, 2500), rng.integers(0, 4000, 2500), strict=True)]
    rows += [("2024-01-02 00:00:00", "a", float("nan"), None), ("2024-01-02 00:00:00", "a", None, None)]
    df = spark.createDataFrame(rows, "ts string, s string, v double, m string").withColumn("ts", F.to_timestamp("ts"))
    first = sketches.daily(df.where("ts < '2024-01-04'"), ["s"], "ts", "v", "m").cache()
    more = sketches.extended(first, df, ["s"], "ts", "v", "m").cache()
    assert sorted({str(r.day) for r in more.select("day").collect()}) == ["2024-01-04", "2024-01-05", "2024-01-06"]
    store = first.unionByName(more)
    got = {r.s: r for r in sketches.window(store, ["s"], "2024-01-02", "2024-01-05").select("*", *(sketches.quantile("quantiles", q).alias(f"q{int(q * 100)}") for q in (0.5, 0.95)), sketches.distinct("members").alias("k")).collect()}
    for s in ("a", "b"):
        v = np.sort([x[2] for x in rows if x[1] == s and "2024-01-02" <= x[0][:10] <= "2024-01-05" and x[2] is not None and x[2] == x[2]])
        members = {x[3] for x in rows if x[1] == s and "2024-01-02" <= x[0][:10] <= "2024-01-05" and x[3]}
        for q, name in ((0.5, "q50"), (0.95, "q95")):
            assert abs(np.searchsorted(v, got[s][name], "right") / len(v) - q) < 0.03
        assert abs(got[s].k / len(members) - 1) < 0.05
        assert (got[s].filled, got[s].least, got[s].most) == (len(v), v[0], v[-1]) and abs(got[s]["mean"] - v.mean()) < 1e-9
        assert got[s].n == len(v) + 2 * (s == "a")
    usual = {r.s: (r.days, r.usual) for r in sketches.median_of_days(store, ["s"], "2024-01-01", "2024-01-06", 0.95).collect()}
    for s in ("a", "b"):
        days = [np.quantile([x[2] for x in rows if x[1] == s and x[0][8:10] == f"{d + 1:02d}" and x[2] is not None and x[2] == x[2]], 0.95) for d in range(6)]
        assert usual[s][0] == 6 and abs(usual[s][1] / np.median(days) - 1) < 0.06


def test_changes_between_windows(spark):
    day = lambda d, s, n: [(f"2024-01-{d:02d}", s, float(i)) for i in range(n)]
    rows = day(1, "same", 50) + day(2, "same", 52) + day(1, "more", 20) + day(2, "more", 45) + day(1, "few", 2) + day(2, "few", 5) + day(1, "gone", 3) + day(2, "new", 3)
    df = spark.createDataFrame(rows, "ts string, s string, v double").withColumn("ts", F.to_timestamp("ts"))
    store = sketches.daily(df, ["s"], "ts", "v").cache()
    one, two = (sketches.window(store, ["s"], d, d) for d in ("2024-01-01", "2024-01-02"))
    assert sorted((r.s, r.before, r.after, r.what) for r in sketches.changed(one, two, ["s"]).collect()) == [("gone", 3, None, "gone"), ("more", 20, 45, "cardinality"), ("new", None, 3, "new")]


def test_holders_of_holders(spark):
    from tidemark.operators import records

    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("n", "m"), ("n", "k"), ("z", None)], "node string, holder string")
    start = spark.createDataFrame([(n,) for n in ("a", "c", "d", "x", "n", "z", "q", "a")], "node string")
    got = {r.node: (r.lineage, r.depth) for r in records.lineage(start, up).collect()}
    assert got == {"a": (["d", "c", "b", "a"], 3), "c": (["d", "c"], 1), "d": (["d"], 0), "x": (["y", "x"], 1), "n": (["k", "n"], 1), "z": (["z"], 0), "q": (["q"], 0)}


def test_retired_by_silence_or_by_text(spark):
    from tidemark.operators import records

    seen = spark.sql("select * from values ('a', date'2024-03-01'), ('b', date'2024-01-01'), ('c', date'2024-01-02'), ('d', date'2024-02-28') t(part, day)")
    said = spark.createDataFrame([("c", "It was decommissioned in May."), ("d", "Est arrêtée."), ("e", "no longer used"), ("a", "not retiredish"), ("b", None)], "part string, text string")
    assert sorted((r.part, r.why) for r in records.retired(seen, "part", "day", 30, said).collect()) == [("b", "silent"), ("c", "silent and said"), ("d", "said"), ("e", "said")]
    assert sorted((r.part, r.why) for r in records.retired(seen, "part", "day", 30).collect()) == [("b", "silent"), ("c", "silent")]


def test_names_alike_by_their_rarest_trigrams(spark):
    """The rarest trigrams lose no pair: against all pairs, with parts that every name has."""
    from tidemark.functions.text import trigram_similarity
    from tidemark.operators import search

    rng = random.Random(3)
    known = sorted({"svc-" + "".join(rng.choices("abc", k=rng.randrange(2, 8))) for _ in range(80)})
    asked = sorted({"svc " + "".join(rng.choices("abc", k=rng.randrange(2, 8))) for _ in range(30)})
    a, b = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((asked, "token"), (known, "name")))
    score = F.round(trigram_similarity(F.col("token"), F.col("name")), 6)
    want = {tuple(r) for r in a.crossJoin(b).select("token", "name", score.alias("s")).where("s >= 0.5").collect()}
    assert {(r.token, r.name, r.score) for r in search.similar_per_token(a, b, 1 << 20, 0.5).collect()} == want and len(want) > 100


def test_resolver_weighs_rare_words(spark):
    from tidemark.operators import search

    objects = spark.createDataFrame(
        [(1, ["http", "requests", "total"], ["count", "of", "calls"], ["code"]), (2, ["cpu", "seconds"], ["busy", "requests"], []), (3, ["requesting"], [], ["requests"]), (4, ["zz"], [], [])],
        "object long, tokens array<string>, words array<string>, labels array<string>",
    )
    asked = spark.createDataFrame([(7, "requests"), (7, "http"), (7, "code"), (7, "load")], "query_id long, term string")
    synonyms = spark.createDataFrame([("load", "cpu"), ("load", "load")], "term string, other string")
    got = {r.object: r.score for r in search.resolved(objects, asked, synonyms).collect()}
    assert got == {1: 3 + 3 + 1 + 1 - 0.1, 2: 1 + 2 - 0.1, 3: 0.9}  # "requesting" begins like "requests" but neither starts the other
    weights = spark.createDataFrame([("requests", 0.5), ("cpu", 0.8)], "term string, weight double")
    got = {r.object: r.score for r in search.resolved(objects, asked, synonyms, weights).collect()}
    assert got == {1: 1.5 + 3 + 1 + 1 - 0.1, 2: 1 + 1.6 - 0.1, 3: 0.9}


def test_kinds_of_tables():
    from tidemark.operators.profiles import kind_of

    kinds = {"spans": ["trace_id", "span_id", "duration"], "alerts": ["alertname", "status"], "logs": ["message", "level", "ts"], "events": ["o_orderdate", "o_custkey"], "inventory": ["name", "owner"]}
    assert {k: kind_of(v) for k, v in kinds.items()} == {k: k for k in kinds}


def test_classes_of_alike_texts(spark):
    from tidemark.operators import search

    rows = [(3, "orders failed yesterday badly"), (1, "Failed orders, badly yesterday"), (2, "orders failed yesterday"), (5, "nothing alike here"), (6, ""), (7, None), (8, "orders failed yesterday")]
    df = spark.createDataFrame(rows, "id long, text string")
    members = {r.id: r.standing for r in search.alike_members(df, "id", F.col("text")).collect()}
    assert members == {1: 1, 3: 1, 2: 2, 8: 2, 5: 5}
    assert [tuple(r) for r in search.alike_classes(df, "id", F.col("text"), 0.7).collect()] == [(1, 2, 0.75, 2, 2)]


def test_sliding_windows(spark):
    from tidemark.streaming import windows

    df = spark.createDataFrame([("a", 0), ("a", 70), ("b", 100)], "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r.start.minute * 60 + r.start.second if r.start.year == 1970 else -60, r.k, r.n) for r in windows.sliding(df, "ts", "2 minutes", "1 minute", ["k"]).collect())
    assert got == [(-60, "a", 1), (0, "a", 2), (0, "b", 1), (60, "a", 1), (60, "b", 1)]
