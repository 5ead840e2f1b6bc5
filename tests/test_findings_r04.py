"""Findings of round 4, each with what failed before."""

from __future__ import annotations

import random

import duckdb
import numpy as np

from tidemark import catalog
from tidemark.catalog_text import _terms_sql
from tidemark.operators import search


def test_retrieval_quality_is_of_all_vectors(spark, tmp_path):
    """every vector asks, not only those whose key 50 divides."""
    rng = random.Random(1)
    near = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(1 + i + i // 49, [x + rng.gauss(0, 0.8) for x in near[i % 4]], i % 4 if i % 7 else None) for i in range(147)]
    assert all(r[0] % 50 for r in rows)
    rows += [(1000, rows[3][1], 3), (1001, rows[3][1], 0)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    got = catalog.queries()["mrr_hit_at_k"](spark, str(tmp_path)).select("n", "hit_1", "hit_3", "mrr").collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(catalog.oracle_sql()["mrr_hit_at_k"]).fetchall() and got[0].n == 149
    assert "%" not in catalog.oracle_sql()["mrr_hit_at_k"]


def test_the_best_of_many_blocks_are_those_of_all_rows(spark, monkeypatch):
    """where all rows ask, blocks, parts and copies of one vector change nothing: the best by rounded cosine, then by key."""
    for name, n in {"ROWS": 70, "ASKED": 30, "AT_ONCE": 16, "ROWS_PART": 150, "ASKED_PART": 90}.items():
        monkeypatch.setattr(search, name, n)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 5))
    x[100:180], x[180:200] = x[7], -x[7] + 1e-9
    keys = rng.permutation(400) * 3
    rows = [(int(k), v.tolist()) for k, v in zip(keys, x, strict=True)]
    df = spark.createDataFrame([*rows, (9001, None), (9002, [0.0] * 5), (None, [1.0] * 5), (9003, [float("inf")] * 5), (9004, [float("nan")] * 5)], "id long, v array<double>")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    score = np.round(unit @ unit.T, 6) + 0.0
    for k in (1, 9, 500):
        got = {(r.query_id, r.rn): (r.id, r.score) for r in search.nearest(df, "id", "v", df.selectExpr("id as query_id", "v as q"), k).collect()}
        want = {}
        for i, own in enumerate(keys):
            best = [j for j in np.lexsort((keys, -score[i])) if j != i][:k]
            want |= {(own, n + 1): (keys[j], score[i, j]) for n, j in enumerate(best)}
        assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-9 for p in want)
        own = search._Best(keys, unit, k)
        for at in range(0, 400, 70):
            own.meet(keys[at : at + 70], unit[at : at + 70])
        told = {(q, n + 1): (i, s) for q, ids, scores in zip(keys, own.ids, own.score, strict=True) for n, (i, s) in enumerate(zip(ids, scores, strict=True)) if np.isfinite(s)}
        assert told.keys() == want.keys() and all(told[p][0] == want[p][0] for p in want)


def test_no_link_of_different_texts_is_lost(spark, tmp_path):
    """texts of the same terms are paired with each other and with all that are alike to them; copies stand beside their first."""
    rng = random.Random(3)
    words = ["orders", "failed", "yesterday", "late", "again", "monday"]
    said = ["orders failed yesterday", "Failed orders, yesterday", "yesterday: orders failed!", "orders failed yesterday late", "Late! Orders failed yesterday", "???", None, "", "é", "nothing alike here"]
    said += [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(40)]
    rows = [(1 + i // 4, i % 4, "user", rng.choice(said)) for i in range(160)] + [(90 + i, 0, "user", t) for i, t in enumerate(said)]
    rows += [(300, 0, "user", said[0]), (301, 0, "user", said[1]), (None, 0, "user", said[2]), (302, 0, "tool", said[0])]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    got = [tuple(r) for r in catalog.queries()["alike_questions"](spark, str(tmp_path)).select("a", "b", "jaccard", "n_a", "n_b").collect()]
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/*.parquet'")
    assert sorted(got) == sorted(con.execute(catalog.oracle_sql()["alike_questions"]).fetchall())
    # With copies told by their first turn, the pairs are those of the query's first SQL, which compared every turn with every other.
    con.execute("create view a as select conv_id * 1000 + turn as id, text from conversations where role = 'user' and conv_id is not null and text is not null")
    con.execute(f"create table s as select id, text, list_distinct({_terms_sql('text')}) as ts, min(id) over (partition by text) as lead from (select * from a union all select -1 - id, text || ' quickly' from a)")
    alike = "len(list_intersect(x.ts, y.ts)) > 0 and round(len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts))), 6) >= 0.6"
    every = con.execute(f"select x.id, y.id, x.lead, y.lead from s x join s y on x.id < y.id and {alike}").fetchall()
    lead = dict(con.execute("select id, lead from s").fetchall())
    told = {(a, b) for a, b, *_ in got}
    assert len(told) == len(got) and {(a, b) for a, b in told if lead[a] != lead[b]} == {(min(x, y), max(x, y)) for _, _, x, y in every if x != y}
    assert {(a, b) for a, b in told if lead[a] == lead[b]} == {(x, b) for _, b, x, y in every if x == y}
