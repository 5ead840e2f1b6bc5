"""Walks, strong components, communities and constrained groups against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import entities, graphs


def frame(spark, pairs, names="src string, dst string"):
    return spark.createDataFrame(pairs, names)


def starts(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def plain_reach(edges, free, origin, depth):
    best, layer = {}, {origin}
    for hops in range(depth + 1):
        todo = list(layer)
        while todo:
            n = todo.pop()
            if n not in best:
                best[n] = hops
                todo += [b for a, b in free if a == n]
        layer = {b for a, b in edges if a in best and best[a] == hops and b not in best}
    return {(origin, n, h) for n, h in best.items()}


def test_reach_with_free_hops(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    free = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(25)]
    for loose in ([], free):
        got = {tuple(r) for r in graphs.reach(frame(spark, edges), starts(spark, "n1", "n2"), 4, frame(spark, loose)).collect()}
        assert got == plain_reach(edges, loose, "n1", 4) | plain_reach(edges, loose, "n2", 4)


def test_deep_walks_have_small_plans(spark):
    line = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(40)])
    found = graphs.reach(line, starts(spark, "n0"), 20)
    assert found.count() == 21 and len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 21 * 4
    assert graphs.reach(line, starts(spark, "n38"), 20).count() == 3  # ends where nothing is new


def plain_chains(edges, free, origin, depth):
    out, todo = set(), [([origin], 0)]
    steps = [(a, b, 1) for a, b in set(edges)] + [(a, b, 0) for a, b in set(free)]
    while todo:
        path, hops = todo.pop()
        on = [(b, c) for a, b, c in steps if a == path[-1] and b not in path]
        if not on and len(path) > 1:
            out.add((tuple(path), hops))
        for b, cost in on:
            if hops + cost >= depth and cost:
                out.add((tuple([*path, b]), hops + 1))
            else:
                todo.append(([*path, b], hops + cost))
    return out


def test_chains_with_free_hops(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(24)]
    free = [(f"n{rng.randrange(14)}", f"w{rng.randrange(3)}") for _ in range(8)] + [("n9", "w0"), ("w0", "w1"), ("w1", "n3")]
    edges += [("n4", "n9"), ("w0", "n5"), ("w2", "n6")]
    got = {(tuple(r.path), r.hops) for r in graphs.chains(frame(spark, edges), starts(spark, "n1", "n4"), 3, frame(spark, free)).collect()}
    want = plain_chains(edges, free, "n1", 3) | plain_chains(edges, free, "n4", 3)
    assert got == want and any(len(p) > 4 for p, _ in got)


def plain_strong(edges):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    nodes = {n for e in edges for n in e}

    def reached(n):
        seen, todo = {n}, [n]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    far = {n: reached(n) for n in nodes}
    return {n: min(m for m in far[n] if n in far[m]) for n in nodes}


def test_strong_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    edges += [(100 + i, 101 + i) for i in range(60)]  # an ascending chain longer than any limit on rounds was
    edges += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(208, 100), (5, 200), (300, 300)]
    got = {r.node: r.component for r in graphs.strong_components(frame(spark, edges, "src long, dst long")).collect()}
    assert got == plain_strong(edges)
    with pytest.raises(RuntimeError):
        graphs.strong_components(frame(spark, edges, "src long, dst long"), most_rounds=3)


def plain_modularity(edges, label):
    m2 = 2 * sum(w for _, _, w in edges)
    tot, inner = Counter(), 0
    for a, b, w in edges:
        tot[label[a]] += w
        tot[label[b]] += w
        inner += 2 * w * (label[a] == label[b])
    return inner / m2 - sum(t * t for t in tot.values()) / m2**2


def plain_louvain(edges):
    """Modularity that sequential moves with coarsening reach."""
    graph, whole = Counter(), {n: n for e in edges for n in e[:2]}
    for a, b, w in edges:
        graph[min(a, b), max(a, b)] += w
    while True:
        deg, near = Counter(), defaultdict(Counter)
        for (a, b), w in graph.items():
            deg[a] += w
            deg[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        m2, com, tot, any_moved = sum(deg.values()), {n: n for n in deg}, Counter(deg), False
        moved = True
        while moved:
            moved = False
            for n in sorted(deg):
                tot[com[n]] -= deg[n]
                links = Counter({com[n]: 0})
                for x, w in near[n].items():
                    links[com[x]] += w
                gain = {c: w - tot[c] * deg[n] / m2 for c, w in links.items()}
                best = max(gain, key=lambda c: (gain[c], c == com[n]))
                if gain[best] > gain[com[n]] + 1e-9:
                    com[n], moved, any_moved = best, True, True
                tot[com[n]] += deg[n]
        if not any_moved:
            return plain_modularity(edges, whole)
        whole = {n: com[c] for n, c in whole.items()}
        up = Counter()
        for (a, b), w in graph.items():
            up[min(com[a], com[b]), max(com[a], com[b])] += w
        graph = up


def test_louvain_finds_two_groups(spark):
    edges = [(a, b, 1) for a, b in ((1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4))]
    got = {r.node: r.community for r in graphs.louvain(frame(spark, edges, "a long, b long, w long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_louvain_never_lowers_modularity(spark):
    """Planted groups, a hub and loose ends: modularity rises with every round, no single move is left, and it is what sequential moves reach."""
    rng = random.Random(2)
    edges = [(g * 10 + rng.randrange(10), g * 10 + rng.randrange(10), rng.choice([1, 1, 2])) for g in range(6) for _ in range(30)]
    edges += [(rng.randrange(60), rng.randrange(60), 1) for _ in range(25)] + [(99, 100 + i, 1) for i in range(12)]
    edges = [(a, b, w) for a, b, w in edges if a != b]
    df, seen = frame(spark, edges, "a long, b long, w long"), []
    got = graphs.louvain(df, on_round=lambda labels: seen.append(plain_modularity(edges, {r.node: r.community for r in labels.collect()})))
    label = {r.node: r.community for r in got.collect()}
    q = plain_modularity(edges, label)
    assert all(y > x - 1e-12 for x, y in zip(seen, seen[1:], strict=False)) and abs(seen[-1] - q) < 1e-12
    assert abs(graphs.modularity(df, got) - q) < 1e-12
    assert q > plain_louvain(edges) - 0.03
    assert len({label[100 + i] for i in range(12)} | {label[99]}) == 1 and all(c == min(n for n in label if label[n] == c) for c in set(label.values()))
    assert graphs.louvain(df.where("false")).collect() == []


def plain_groups(nodes, pairs, apart, value):
    group = {n: {n} for n in nodes}
    apart = {frozenset(p) for p in apart}
    for _, a, b in sorted((r, min(a, b), max(a, b)) for a, b, r in pairs):
        x, y = group[a], group[b]
        values = {value[n] for n in x | y if value[n] is not None}
        if x is not y and len(values) < 2 and not any(frozenset((i, j)) in apart for i in x for j in y):
            for n in y:
                x.add(n)
                group[n] = x
    return {n: min(g) for n, g in group.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_apart_equals_merging_in_order(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(50))
    pairs = [(rng.randrange(50), rng.randrange(50), rng.choice([1, 2, 3])) for _ in range(70)]
    apart = [(rng.randrange(50), rng.randrange(50)) for _ in range(25)]
    pairs, apart = ([p for p in x if p[0] != p[1]] for x in (pairs, apart))
    value = {n: rng.choice([None, None, None, "x", "y"]) for n in nodes}
    frames = spark.createDataFrame([(n, value[n]) for n in nodes], "node long, whole string"), frame(spark, pairs, "a long, b long, rank int"), frame(spark, apart, "a long, b long")
    got = {r.node: r.group for r in graphs.groups_apart(*frames, ("whole",), entities.connected).collect()}
    assert got == plain_groups(nodes, pairs, apart, value) and len(set(got.values())) < 40


def test_entity_groups(spark):
    """Strong, environment and typo pairs join; a part and its whole, parts of two wholes and extended names stay apart."""
    names = [
        (1, "Order Service", None), (2, "order_service", None), (3, "order-service-prod", None), (4, "Ordr Service", None), (5, "order service", None),
        (10, "Billing Hub", None), (11, "billing-hub-adapter", None), (12, "billing-hub-ui", None), (13, "BillingHub", None),
        (20, "inventory", None), (21, "Inventory", 20), (22, "inventory-dev", 20), (30, "ledger-prod", 10), (31, "ledger-dev", 20), (32, "Ledger", None),
        (40, "api v1", None), (41, "api v2", None), (50, "--", None), (51, None, None), (52, "++", None),
    ]
    got = {r.id: r.group for r in entities.entity_groups(spark.createDataFrame(names, "id long, name string, whole long")).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [1] * 5
    assert [got[i] for i in (10, 11, 12, 13)] == [10, 11, 12, 10]
    assert got[20] != got[21] == got[22] == 21
    assert got[30] != got[31] and (got[32] in (got[30], got[31]))
    assert got[40] != got[41] and [got[i] for i in (50, 51, 52)] == [50, 51, 52]


def test_extensions(spark):
    df = spark.createDataFrame([(1, "Order Desk"), (2, "order-desk-adapter"), (3, "order-desk-ui"), (4, "order-desk-prod"), (5, "solo part"), (6, "solo part x")], "id long, name string")
    assert sorted(map(tuple, entities.extensions(df).collect())) == [(1, 2), (1, 3)]


def test_a_large_graph_settles(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") * 7 % 130).alias("b"), F.lit(1).alias("w")).where("a != b")
    found = graphs.louvain(edges)
    assert found.count() == 400 and graphs.modularity(edges, found) > 0.5
