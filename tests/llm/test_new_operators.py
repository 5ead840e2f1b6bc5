"""Filter audit, winnowing and manifest against plain Python, on planted and nasty rows, and their queries against SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import decontaminate, filter_audit, manifest, oracle, queries
from tidemark.llm.common import stored, work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 5000}x{i // 5000}" for i in range(20_000))


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_winnowing", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = getattr(queries, name)(spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


# filter audit


def fails(text: str) -> str:
    w = WORD.findall(text)
    marks = len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text)
    return "".join(f for f, m in zip("ABCD", marks, strict=True) if m)


def plain_audit(rows, labels):
    """{(part, order, step): counts} by applying the filters one after the other."""
    out = {}
    marks = []
    for i, source, text in rows:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, _, t in rows)
        marks.append((source or "", fails(text or "") + ("E" if copy else ""), labels.get(i, (0, 0))))
    for order in map("".join, permutations("ABCDE")):
        alive = [True] * len(marks)
        for step, f in enumerate(order, 1):
            for part in {p for p, _, _ in marks}:
                own = [k for k, m in enumerate(marks) if m[0] == part]
                hit = [k for k in own if f in marks[k][1]]
                gone = [k for k in hit if alive[k]]
                out[part, order, step] = [
                    sum(alive[k] for k in own) - len(gone), len(gone), len(hit) - len(gone), sum(marks[k][1] == f for k in own),
                    sum(marks[k][2][0] for k in gone), sum(marks[k][2][1] for k in gone),
                ]
            for k, m in enumerate(marks):
                alive[k] &= f not in m[1]
    for part in {p for p, _, _ in marks}:
        for f in "ABCDE":
            at = [(o, o.index(f) + 1) for o in map("".join, permutations("ABCDE"))]
            total = sum(out[part, o, s][1] for o, s in at)
            for o, s in at:
                out[part, o, s].append(total)
    return out


def test_audit_equals_plain(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["CAPS", "$5", "é"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 49, 50, 51, 80, 900]))) for _ in range(12)]
    texts += [LONG, LONG[:-1] + "!", LONG, None, "", " \n\t", "A" * 5 + "b" * 95, "A" * 6 + "b" * 94]
    rows = [(i if i % 17 else None, rng.choice(["a", "b", "", None]), rng.choice(texts)) for i in range(120)]
    rows += [(3, "a", texts[2]), (3, "a", texts[2]), (3, "b", texts[3])]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    good = {}
    for i, q, t in labels:
        a, b = good.get(i, (0, 0))
        good[i] = (max(a, int(q)), max(b, int(t)))
    good.pop(None)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mask", F.lit("x")).withColumn("part", F.lit(1)).withColumn("key", F.lit(None))
    said = spark.createDataFrame([(i, int(q), int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.interactions(docs, said).collect()}
    assert got == plain_audit(rows, good)
    assert filter_audit.interactions(docs.where("false"), said).collect() == []


def test_colliding_hashes_do_not_decide(spark):
    """Rows of one class whose texts differ are told apart by their text, and the others of the class form classes of their own."""
    rows = [(1, "x"), (2, "y"), (3, "x"), (4, "y"), (5, "z"), (6, "y"), (7, "x"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.xxhash64("text"))
    same = docs.select("doc_id", "mark", F.lit(1).cast("long").alias("points"), F.array(F.lit(7).cast("long")).alias("blocks"))
    found = filter_audit.later_copies(docs, same, work_dir(spark))
    assert sorted({r.doc_id for r in found.collect()}) == [3, 4, 6, 7]


def test_refinement_drops_singletons_by_length_then_by_block(spark):
    long = "a" * 1024 + "b" * 4096 + "c" * 100
    texts = [long, long, long[:-1] + "d", "z" + long[1:], long + "e", "short", "shore"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("mark"), F.lit("").alias("part"), "text")
    rows = stored(filter_audit.profile(docs), f"{work_dir(spark)}/rows")
    assert {r.doc_id: len(r.blocks) for r in rows.collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 5: 1, 6: 1}
    assert sorted(r.doc_id for r in filter_audit.refined(rows, work_dir(spark)).collect()) == [0, 1]


# winnowing


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_hits(text, items):
    w = plain_words(text)
    hit, found = set(), set()
    for key, item in items:
        iw = plain_words(item)
        n = min(len(iw), 10)
        held = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
        for s in range(len(w) - n + 1):
            if n and tuple(w[s : s + n]) in held:
                hit |= set(range(s, s + n))
                if key is not None:
                    found.add(str(key))
    return len(w), len(hit), sorted(found)


def test_winnowing_equals_plain(spark):
    rng = random.Random(9)
    say = lambda n, k=30: " ".join(f"{rng.choice('abé日9')}{rng.randrange(k)}" for _ in range(n))
    items = [(i, say(rng.choice([10, 11, 25, 60]))) for i in range(30)]
    items += [(100, items[3][1]), (101, "Alone"), (102, "two words"), (103, say(9)), (104, ""), (105, None), (None, say(12)), (9, say(14)), (106, items[2][1][5:60])]
    rows = []
    for i in range(60):
        parts = [say(rng.randrange(40), 4000)]
        for _ in range(rng.randrange(3)):
            w = plain_words(rng.choice(items)[1])
            cut = rng.randrange(max(len(w) - 8, 1))
            parts += ["-- ".join(w[cut : cut + rng.choice([9, 10, 12, 80])]).replace("a", "A").replace("b", "B"), say(3, 4000)]
        rows.append((i, " ".join(parts)))
    rows += [(60, None), (61, ""), (62, "... !"), (None, items[0][1]), (5, items[1][1]), (5, items[1][1]), (63, LONG + " " + items[4][1] + " " + LONG), (64, "ALONE two, words"), (65, items[6][1] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("found", F.lit("x")).withColumn("n", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit(1))
    got = sorted((repr(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == sorted((repr(i), *plain_hits(t, items)) for i, t in rows)
    assert sum(1 for g in got if g[2]) > 25
    assert decontaminate.contaminated(docs.where("false"), bench).collect() == []
    clean = decontaminate.contaminated(docs, bench.where("false")).collect()
    assert len(clean) == len(rows) and not any(r.n_hit or r["items"] or r.spans for r in clean)


def test_spans_are_the_hit_words(spark):
    item = " ".join(f"i{k}" for k in range(14))
    docs = spark.createDataFrame([(1, f"x y {item} z {item[:-4]}")], "doc_id long, text string")
    (row,) = decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(s.first, s.end) for s in row.spans] == [(2, 16), (17, 30)] and row.n_hit == 27 and row["items"] == ["7"]


# manifest


def plain_tree(nodes):
    """(root, [path]) of a list of digests, level by level; a path is a list of (before, after)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, place, strict=True):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            p.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes = [hashlib.sha256("".join(nodes[i : i + 16]).encode()).hexdigest() for i in range(0, len(nodes), 16)]
        place = [k // 16 for k in place]
    return nodes[0], paths


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_traversal_gives_every_path_of_a_block(n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    root, paths = plain_tree(leaves)
    levels = manifest.height_of(n)
    assert list(manifest.traverse(leaves, levels)) == paths and manifest.root_of(leaves, levels) == root
    assert all(manifest.folded(leaf, p) == root for leaf, p in zip(leaves, paths, strict=True))


def plain_leaf(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def plain_manifest(rows):
    """{doc_id: (leaf, subroot, root, proof, folded)} of rows (doc_id, source, lang, n_chars, text)."""
    order = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[s] = (own, *plain_tree([plain_leaf(*r) for r in own]))
    root, tops = plain_tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            seen = plain_leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                seen = plain_leaf(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for before, after in path + top:
                seen = hashlib.sha256((before + seen + after).encode()).hexdigest()
            proof = hashlib.sha256("".join(b + a for b, a in path + top).encode()).hexdigest()
            out.append((repr(r[0]), plain_leaf(*r), subroot, root, proof, seen, seen == root))
    return sorted(out)


COLUMNS = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def through_query(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("at", F.lit(2)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((repr(r.doc_id), *(r[c] for c in COLUMNS)) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect())


def test_manifest_of_several_blocks(spark, tmp_path):
    """A source of more than one block of 4,096, more than sixteen sources, null and empty sources, values, ties and repeated rows."""
    rows = [(i * 3, "big", "en", i, f"Text {i} É") for i in range(4_500)]
    rows += [(100_000 + i, f"s{i % 40}", None if i % 3 else "de", None, f"T{i}") for i in range(200)]
    rows += [(7, None, "en", 1, "N"), (8, "", "en", 1, "E"), (9, "ÿ", "en", 0, ""), (10, "big", None, None, None), (None, "big", "en", 1, "A"), (11, "x", "en", 3, LONG)]
    rows += [(12, "x", "en", 1, "Same"), (12, "x", "en", 1, "Same"), (12, "x", "en", 1, "Other")]
    got = through_query(spark, rows, tmp_path)
    assert got == plain_manifest(rows)
    assert {g[-1] for g in got} == {True, False}


def test_manifest_of_one_row_and_none(spark, tmp_path):
    row = (1, "only", "en", 1, "Text")
    (got,) = through_query(spark, [row], tmp_path / "one")
    assert got[1] == got[2] == got[3] == plain_leaf(*row) and got[4] == hashlib.sha256(b"").hexdigest()
    assert through_query(spark, [], tmp_path / "none") == []


def test_sql_of_the_tree_has_enough_levels():
    assert manifest.ARITY == 16 and "l5" in oracle.OP13 and "t5" in oracle.OP13
