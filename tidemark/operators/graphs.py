"""Walks, strong components and communities of graphs, and groups that constraints keep apart.

Every loop stores what a round found (:func:`kept`), so plans do not grow with the rounds, a lost executor costs a retry, and a join on a node
of many edges has a table on either side, which lets AQE split it.  A loop that has not settled after ``most_rounds`` raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scratch import kept


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _grown(front: DataFrame, steps: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """(origin, node) one step on from ``front`` that no table of ``seen`` has, stored."""
    on = front.select("origin", F.col("node").alias("src")).join(steps, "src").select("origin", F.col("dst").alias("node")).distinct()
    return kept(on.join(_union(seen).select("origin", "node"), ["origin", "node"], "left_anti"))


def reach(edges: DataFrame, start: DataFrame, depth: int, free: DataFrame | None = None) -> DataFrame:
    """(origin, node, hops): nodes reachable from each origin along src -> dst in at most ``depth`` hops, by the shortest way.

    Edges of ``free`` cost no hop: each layer is closed under them before the next hop (a 0-1 breadth-first search).  Only the last
    layer is joined with the edges (semi-naive), and the walk ends where a layer is empty.
    """
    steps = kept(edges.select("src", "dst").distinct())
    loose = None if free is None else kept(free.select("src", "dst").distinct())
    front = kept(start.select(F.col("node").alias("origin"), "node").distinct())
    layers, seen = [], []
    for hops in range(depth + 1):
        layer = [front]
        while loose is not None and not front.isEmpty():
            front = _grown(front, loose, [*seen, *layer])
            layer.append(front)
        seen += layer
        layers.append(_union(layer).withColumn("hops", F.lit(hops)))
        if hops == depth:
            break
        front = _grown(_union(layer), steps, seen)
        if front.isEmpty():
            break
    return _union(layers)


def chains(edges: DataFrame, start: DataFrame, depth: int, free: DataFrame | None = None, most_rounds: int = 200) -> DataFrame:
    """(path, hops): the chains from each start node along src -> dst that cannot or may not go on.

    A chain takes at most ``depth`` hops; edges of ``free`` cost none, but a chain whose last hop was the ``depth``-th ends there.  A node that is
    in a chain already ends it.  Each round's open chains are stored, so none is computed twice.
    """
    steps = edges.select("src", "dst").distinct().withColumn("cost", F.lit(1))
    if free is not None:
        steps = steps.unionByName(free.select("src", "dst").distinct().withColumn("cost", F.lit(0)))
    steps = kept(steps)
    live = kept(start.select(F.array("node").alias("path"), F.col("node").alias("src"), F.lit(0).alias("hops")).distinct())
    done: list[DataFrame] = []
    for _ in range(most_rounds):
        if live.isEmpty():
            return _union(done).select("path", "hops")
        grown = live.join(steps, "src").where(~F.array_contains("path", F.col("dst")))
        grown = kept(grown.select(F.col("path").alias("before"), F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"), (F.col("hops") + F.col("cost")).alias("hops"), "cost"))
        stuck = live.where(F.size("path") > 1).join(grown.select(F.col("before").alias("path")).distinct(), "path", "left_anti")
        full = (F.col("hops") >= depth) & (F.col("cost") == 1)
        done += [kept(stuck.select("path", "hops")), grown.where(full).select("path", "hops")]
        live = grown.where(~full).select("path", "src", "hops").distinct()
    raise RuntimeError("chains did not end")


def strong_components(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, component): nodes that reach each other along src -> dst, the component named by its smallest node.

    Nodes without an edge in or out among those left are components of their own and go first, again and again.  Then the smallest
    node that reaches a node is its colour, and a colour's name, walked backwards inside the colour, reaches one whole component,
    which leaves the graph; then ends are trimmed again.
    """
    nodes = kept(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    live, left = kept(edges.select("src", "dst").where("src != dst").distinct()), nodes
    done: list[DataFrame] = []
    for _ in range(most_rounds):
        inner = kept(live.select(F.col("src").alias("node")).distinct().intersect(live.select(F.col("dst").alias("node")).distinct()))
        ends = left.join(inner, "node", "left_anti")
        if not ends.isEmpty():
            done.append(kept(ends.select("node", F.col("node").alias("component"))))
            left, live = inner, _within(live, inner)
            continue
        if left.isEmpty():
            return _union(done) if done else nodes.withColumn("component", F.col("node"))
        colour = _spread(left.select("node", F.col("node").alias("colour")), live, most_rounds)
        inside = live.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd")
        inside = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = colour").select("node")
        found = kept(reach(inside, roots, most_rounds).select(F.col("origin").alias("component"), "node"))
        done.append(found.select("node", "component"))
        left = kept(left.join(found, "node", "left_anti"))
        live = _within(live, left)
    raise RuntimeError("components did not settle")


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between ``nodes``, stored."""
    return kept(edges.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi"))


def _spread(colours: DataFrame, edges: DataFrame, most_rounds: int) -> DataFrame:
    """(node, colour): the smallest colour that reaches each node along the edges; only colours that changed are sent on."""
    colours = moved = kept(colours)
    for _ in range(most_rounds):
        came = edges.join(moved.select(F.col("node").alias("src"), F.col("colour").alias("came")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("came").alias("came"))
        following = colours.join(came, "node", "left").select("node", F.least("colour", F.coalesce("came", "colour")).alias("colour"), F.coalesce(F.col("came") < F.col("colour"), F.lit(False)).alias("moved"))
        following = kept(following)
        colours, moved = following.select("node", "colour"), following.where("moved")
        if moved.isEmpty():
            return colours
    raise RuntimeError("colours did not settle")


# Communities

#: Levels of gain a degree, each 1.4 times the next, and slices of a level.
LEVELS, SLICES = 64, 64


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Newman's modularity of ``labels`` (node, community) over undirected weighted ``edges`` (a, b, w)."""
    on = edges.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
    ends = on.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("tot"))
    m2, square = ends.agg(F.sum("tot"), F.sum(F.col("tot").cast("double") * F.col("tot"))).first()
    inner = on.where("ca = cb").agg(F.sum("w")).first()[0] or 0
    return 2.0 * inner / m2 - square / (float(m2) * m2)


def _gains(links: DataFrame, nodes: DataFrame, labels: DataFrame, m2: float) -> DataFrame:
    """(node, own, to, deg, gain) of every move of a node to a community that it has a link to, with what modularity gains, times m2 / 2."""
    around = links.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
    sized = nodes.join(labels, "node")
    tot = sized.groupBy(F.col("community").alias("c")).agg(F.sum("deg").alias("tot"))
    around = kept(around.join(tot, "c"))
    home = sized.join(tot.toDF("community", "tot"), "community").join(around.select("node", F.col("c").alias("community"), "w"), ["node", "community"], "left")
    home = home.select("node", F.col("community").alias("own"), "deg", (F.coalesce("w", F.lit(0)) - (F.col("tot") - F.col("deg")) * F.col("deg") / m2).alias("stay"))
    moves = around.join(home, "node").where("c != own")
    return moves.select("node", "own", F.col("c").alias("to"), "deg", (F.col("w") - F.col("tot") * F.col("deg") / m2 - F.col("stay")).alias("gain")).where("gain > 1e-9")


def _best(moves: DataFrame, turn: int) -> DataFrame:
    """(node, own, deg, to, gain, slice): each node's best move that is open in this turn, stored.

    In a turn a community either gives or takes nodes, by a hash, and in the next one the other way round.  Moves have an order: most gain a degree
    first, by LEVELS, and in a level by a hash, by SLICES.
    """
    takes = lambda c: F.pmod(F.xxhash64(F.lit(turn // 2), c) + turn, F.lit(2)) == 1
    open_ = moves.where(takes(F.col("to")) & ~takes(F.col("own")))
    best = open_.groupBy("node", "own", "deg").agg(F.min_by(F.struct("to", "gain"), F.struct(-F.col("gain"), F.col("to"))).alias("x"))
    level = F.least(F.greatest(F.floor(-2 * F.log2(F.col("x.gain") / F.col("deg"))), F.lit(0)), F.lit(LEVELS - 1))
    slice_ = level * SLICES + F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(SLICES))
    return kept(best.select("node", "own", "deg", "x.to", "x.gain", slice_.cast("int").alias("slice")))


def _chosen(best: DataFrame, m2: float) -> DataFrame:
    """(node, to): the moves of :func:`_best` that raise modularity one after the other when they are made in their order.

    A node that leaves or enters a community costs a later one deg * deg / m2 at most of its gain; so a move goes through if its gain is more than
    that for all candidates of both its communities in earlier slices and in its own.  The first of a slice of both its communities has none of its
    own slice before it, so the very first move goes.  What is summed up in order is a row a community and slice, however many nodes it has.
    """

    def of(c: str) -> DataFrame:
        per = best.groupBy(c, "slice").agg(F.sum("deg").alias(f"with_{c}"), F.min_by("node", F.struct(-F.col("gain"), F.col("node"))).alias(f"first_{c}"))
        before = Window.partitionBy(c).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        return per.withColumn(f"before_{c}", F.coalesce(F.sum(f"with_{c}").over(before), F.lit(0)))

    both = best.join(of("to"), ["to", "slice"]).join(of("own"), ["own", "slice"])
    first = (F.col("node") == F.col("first_to")) & (F.col("node") == F.col("first_own"))
    beside = F.when(first, F.lit(0)).otherwise(F.col("with_to") + F.col("with_own") - 2 * F.col("deg"))
    return both.where(F.col("gain") > F.col("deg") * (F.col("before_to") + F.col("before_own") + beside) / m2).select("node", "to")


def louvain(edges: DataFrame, most_rounds: int = 1000, on_round=None) -> DataFrame:
    """(node, community) of undirected ``edges`` (a, b, w): communities by modularity, each named by its smallest node.

    Rounds move nodes to the community of most gain until no move gains; then communities become the nodes of a smaller graph and it
    starts again, until nothing moves there either.  What moves in a round never lowers modularity (see :func:`_chosen`), and hashes
    make the result one and the same for a graph.  Edges that repeat add up.  ``on_round`` is called with the labels of each round.
    """
    plain = edges.where("a is not null and b is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
    graph = kept(plain)
    whole = kept(graph.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node")))
    m2 = 2.0 * (graph.agg(F.sum("w")).first()[0] or 0)
    turn = 0
    while m2:
        nodes = kept(graph.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("deg")))
        links = graph.where("a != b")
        links = kept(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
        labels, moved = nodes.select("node", F.col("node").alias("community")), False
        for _ in range(most_rounds):
            moves = _gains(links, nodes, labels, m2)
            turn += 1
            best = _best(moves, turn)
            if best.isEmpty():
                if moves.isEmpty():
                    break
                continue
            chosen = _chosen(best, m2)
            labels = kept(labels.join(chosen, "node", "left").select("node", F.coalesce("to", "community").alias("community")))
            moved = True
            if on_round:
                on_round(_through(whole, labels))
        else:
            raise RuntimeError("communities did not settle")
        if not moved:
            break
        names = labels.groupBy("community").agg(F.min("node").alias("name"))
        labels = kept(labels.join(names, "community").select("node", F.col("name").alias("community")))
        whole = kept(_through(whole, labels))
        up = graph.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
        graph = kept(up.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
    names = whole.groupBy("community").agg(F.min("node").alias("name"))
    return whole.join(names, "community").select("node", F.col("name").alias("community"))


def _through(whole: DataFrame, labels: DataFrame) -> DataFrame:
    return whole.join(labels.toDF("community", "now"), "community").select("node", F.col("now").alias("community"))


# Groups under constraints


def groups_apart(nodes: DataFrame, pairs: DataFrame, apart: DataFrame, one_of: tuple[str, ...], connect, most_rounds: int = 10_000) -> DataFrame:
    """(node, group): what merging ``pairs`` (a, b, rank) in order of (rank, a, b) gives, where no merge may break a constraint.

    Two nodes of ``apart`` (a, b) are never in one group, and a group has one value at most of each column ``one_of`` of ``nodes``
    (node, ...), nulls not counting.  A group is named by its smallest node.  ``connect`` gives (node, component) of (a, b).

    Components in which all constraints hold merge whole, whatever the order.  In the others, round by round, merges that a
    constraint forbids by now go for good, since groups only grow, and the first pair of both its groups is merged: no earlier pair
    touches either, so that is what merging one after the other does.
    """
    pairs = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rank").where("a != b").distinct())
    apart = kept(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    loose = connect(pairs.select("a", "b"))
    whole = kept(nodes.select("node", *one_of).join(loose, "node", "left").withColumn("component", F.coalesce("component", "node")))
    broken = whole.groupBy("component").agg(F.lit(False).alias("_"), *(F.countDistinct(c).alias(c) for c in one_of))
    broken = broken.where(reduce(lambda x, y: x | y, (F.col(c) > 1 for c in one_of), F.col("_"))).select("component")
    inside = apart.join(whole.select(F.col("node").alias("a"), "component"), "a").join(whole.select(F.col("node").alias("b"), F.col("component").alias("other")), "b")
    contested = kept(broken.unionByName(inside.where("component = other").select("component")).distinct())
    settled = whole.join(contested, "component", "left_anti").select("node", F.col("component").alias("group"))
    labels = kept(whole.join(contested, "component", "left_semi").select("node", *one_of, F.col("node").alias("group")))
    open_ = kept(pairs.join(labels.select(F.col("node").alias("a")), "a", "left_semi"))
    for _ in range(most_rounds):
        if open_.isEmpty():
            return kept(settled.unionByName(labels.select("node", "group")))
        state = kept(labels.groupBy("group").agg(F.count("*").alias("_"), *(F.first(c, ignorenulls=True).alias(c) for c in one_of)).drop("_"))
        of = lambda side: state.select(F.col("group").alias(f"g{side}"), *(F.col(c).alias(f"{c}_{side}") for c in one_of))
        now = lambda df: df.join(labels.select(F.col("node").alias("a"), F.col("group").alias("ga")), "a").join(labels.select(F.col("node").alias("b"), F.col("group").alias("gb")), "b")
        places = now(open_).select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"), "a", "b", "rank").where("ga != gb")
        forbidden = now(apart).select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).distinct()
        clash = reduce(lambda x, y: x | y, (F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False)) for c in one_of), F.lit(False))
        may = places.join(forbidden, ["ga", "gb"], "left_anti").join(of("a"), "ga").join(of("b"), "gb").where(~clash)
        may = kept(may.select("ga", "gb", F.struct("rank", "a", "b").alias("at")))
        first = kept(may.select(F.explode(F.array("ga", "gb")).alias("g"), "at").groupBy("g").agg(F.min("at").alias("least")))
        agreed = may.join(first.toDF("ga", "la"), "ga").join(first.toDF("gb", "lb"), "gb").where("at = la and at = lb").select("ga", "gb")
        labels = kept(labels.join(agreed.select(F.col("gb").alias("group"), F.col("ga").alias("into")), "group", "left").select("node", *one_of, F.coalesce("into", "group").alias("group")))
        open_ = kept(may.select("at.*"))
        open_ = kept(now(open_).where("ga != gb").select("a", "b", "rank"))
    raise RuntimeError("groups did not settle")
