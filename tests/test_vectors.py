"""The vector index against exact search."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.conftest import SF
from tidemark import catalog
from tidemark.operators import search, vectors


def hits(df, key):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r[key]] = r.score
    return out


def test_recall_of_the_query(spark):
    got, want = (hits(catalog.queries()[q](spark, SF), "vec_id") for q in ("vector_index_topk", "cosine_topk"))
    assert got.keys() == want.keys() and all(len(h) == 10 for h in got.values())
    assert sum(len(got[q].keys() & want[q].keys()) for q in want) >= 0.95 * 10 * len(want)
    assert all(abs(got[q][k] - want[q][k]) < 1e-6 for q in want for k in got[q].keys() & want[q].keys())  # a score is exact


def test_clusters_need_few_probes_and_few_bytes(spark):
    """3,000 vectors in 60 clusters: a tenth of the lists gives 0.95; what is read is a few bytes a vector instead of 8 a component."""
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((60, 40))
    x = middle[rng.integers(0, 60, 3000)] + 0.35 * rng.standard_normal((3000, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked = df.where("id % 50 = 0").selectExpr("id as query_id", "v as q")
    index = vectors.build(df, "id", "v", lists=60)
    got, want = hits(vectors.search(index, asked, 10, probes=0.1), "key"), hits(search.nearest(df, "id", "v", asked, 10), "id")
    assert sum(len(got[q].keys() & want[q].keys()) for q in want) >= 0.95 * 10 * len(want)
    stored = index.blocks.selectExpr("sum(octet_length(keys) + octet_length(codes)) as n", "sum(octet_length(keys) / 8) as rows").first()
    assert stored.rows == 3000 and stored.n <= 3000 * (8 + vectors.CODE)


def test_vectors_that_cannot_be_compared(spark):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9), 0.1]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 0.0]), (104, [1.0, float("nan"), 0.0]), (105, [1.0]), (None, [1.0, 0.0, 0.0]), (41, rows[3][1]), (42, [1e300, 0.0, 1e299])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vectors.build(df, "id", "v")
    found = vectors.search(index, df.selectExpr("id as query_id", "v as q").where("id is not null"), 5, probes=1.0)
    got = hits(found, "key")
    assert set(got) == {*range(40), 41, 42} and {k for h in got.values() for k in h} <= {*range(40), 41, 42}
    assert got[3][41] == pytest.approx(1.0) and 3 not in got[3]
    none = vectors.build(df.where("false"), "id", "v")
    assert vectors.search(none, df.selectExpr("id as query_id", "v as q"), 5).collect() == []
