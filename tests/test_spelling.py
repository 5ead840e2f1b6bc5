"""Distances, typing slips and readings against plain Python."""

from __future__ import annotations

import random
from string import ascii_lowercase

from pyspark.sql import functions as F

from tidemark.operators import spelling

NEAR = spelling.beside()


def osa(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def typed(w):
    """Every word that ``w`` may be a typing slip of."""
    out = {w[:i] + c + w[i:] for i in range(1, len(w) + 1) for c in ascii_lowercase}
    for i in range(1, len(w)):
        beside = [w[i - 1], *w[i + 1 : i + 2]]
        if any(w[i] == x or w[i] in NEAR[x] for x in beside):
            out.add(w[:i] + w[i + 1 :])
        if i < len(w) - 1:
            out.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
        out |= {w[:i] + c + w[i + 1 :] for c in ascii_lowercase if c in NEAR[w[i]] or (c in spelling.VOWELS and w[i] in spelling.VOWELS)}
    return out - {w}


def some_pairs():
    rng = random.Random(7)
    pairs = [("kitten", "sitting"), ("ab", "ba"), ("abcdef", "abdcfe"), ("ca", "abc"), ("paymnet", "payment"), ("a", "a"), ("a", "ab"), ("", "a"), ("refunnd", "refund"), ("comunitty", "community")]
    for _ in range(400):
        w = "".join(rng.choices("abcdeqwsaz", k=rng.randrange(1, 9)))
        v = list(w)
        for _ in range(rng.randrange(0, 4)):
            i, what = rng.randrange(len(v) + 1), rng.randrange(4)
            if what == 0:
                v.insert(i, rng.choice("abcdeqwsz"))
            elif i < len(v) and what == 1 and len(v) > 1:
                del v[i]
            elif i < len(v) and what == 2:
                v[i] = rng.choice("abcdeqwsz")
            elif i + 1 < len(v):
                v[i], v[i + 1] = v[i + 1], v[i]
        pairs.append((w, "".join(v)))
    return pairs


def test_keys_beside():
    assert set("qsz") <= set(NEAR["a"]) and "e" in NEAR["w"] and "p" not in NEAR["a"] and "a" not in NEAR["a"]


def test_slips_and_typing_slips(spark):
    pairs = some_pairs()
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", spelling.slips(F.col("a"), F.col("b")).alias("d"), spelling.typing_slip(F.col("a"), F.col("b")).alias("t"))
    for r in df.collect():
        want = osa(r.a, r.b) if r.a and r.b else None
        assert r.d == (want if want is not None and want <= 2 else None), (r.a, r.b)
        if r.a:
            assert r.t == (r.b in typed(r.a)), (r.a, r.b)


def test_near_words_finds_every_pair(spark):
    rng = random.Random(3)
    vocab = sorted({"".join(rng.choices("abc", k=rng.randrange(3, 9))) for _ in range(250)})
    asked = sorted({"".join(rng.choices("abc", k=rng.randrange(5, 9))) for _ in range(60)} - set(vocab))
    got = spelling.near_words(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w, 1) for w in vocab], "term string, n_docs long"))
    want = {(w, v, osa(w, v)) for w in asked for v in vocab if w[0] == v[0] and w != v and osa(w, v) <= (2 if len(w) >= 7 else 1)}
    assert {(r.word, r.term, r.slips) for r in got.collect()} == want and len(want) > 100


VOCAB = {
    "payment": 9, "payments": 3, "refund": 8, "working": 5, "community": 7, "restore": 4, "order": 9, "orders": 2, "set": 9, "up": 9, "setup": 4, "index": 6, "query": 5,
    "latency": 5, "network": 3, "work": 6, "filter": 2, "falter": 9, "replica": 6, "data": 9, "base": 5, "database": 8, "monitoring": 6,
}
SIDE = [("payment", "refund"), ("set", "up"), ("data", "base"), ("order", "index")]
STOP = ("with", "the", "from")


def read(spark, *queries):
    asked = [(i, k, w) for i, q in enumerate(queries) for k, w in enumerate(q.split())]
    found = spelling.readings(
        spark.createDataFrame(asked, "query_id long, place int, word string"), spark.createDataFrame(list(VOCAB.items()), "term string, n_docs long"),
        spark.createDataFrame(SIDE, "a string, b string"), STOP,
    )
    out = [[] for _ in queries]
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.place)):
        out[r.query_id].append((r.place, r.n_words, r.typed, r.read, r.how))
    return out


def test_each_kind_of_reading(spark):
    got = read(
        spark, "refunnd of payment", "wo rking latency", "paymentrefund", "workingwith data", "comunitty", "set up index", "data base", "ML order", "filtre", "ordr quary", "zzzzzz",
        "monitorring netwrok", "mnoitorign", "query", "latancy latancy", "or der in dex",
    )
    assert got[0] == [(0, 1, "refunnd", "refund", "slip")]
    assert got[1] == [(0, 2, "wo rking", "working", "joined")]
    assert got[2] == [(0, 1, "paymentrefund", "payment refund", "split")]
    assert got[3] == [(0, 1, "workingwith", "working with", "split")]
    assert got[4] == [(0, 1, "comunitty", "community", "near")]  # a letter missing and one too many
    assert got[5] == [] and got[6] == []  # known words that some piece has side by side
    assert got[8] == [(0, 1, "filtre", "filter", "slip")]
    assert got[9] == [(1, 1, "quary", "query", "slip")]  # four letters are too few to be read otherwise
    assert got[10] == [] and got[13] == []
    assert got[11] == [(0, 1, "monitorring", "monitoring", "slip"), (1, 1, "netwrok", "network", "slip")]
    assert got[12] == [(0, 1, "mnoitorign", "monitoring", "near")]
    assert got[14] == [(0, 1, "latancy", "latency", "slip"), (1, 1, "latancy", "latency", "slip")]
    assert got[15] == [(0, 2, "or der", "order", "joined"), (2, 2, "in dex", "index", "joined")]


def test_nothing_is_read_from_nothing(spark):
    empty = spark.createDataFrame([], "query_id long, place int, word string")
    vocab, pairs = spark.createDataFrame([("word", 1)], "term string, n_docs long"), spark.createDataFrame([], "a string, b string")
    assert spelling.readings(empty, vocab, pairs).collect() == []
