"""Names that mean one thing, and graphs of what depends on what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import fold
from tidemark.operators.graphs import groups_apart, reach, strong_components  # noqa: F401  strong components are called by this name too
from tidemark.operators.scratch import kept as stored
from tidemark.operators.series import join_same

#: Words of a name that tell an environment or a version.
ENVIRONMENTS = "prod|production|preprod|dev|test|uat|qa|staging|int"
#: Letters from which one slip is a typo, and how sure a verdict is; "doubt" joins nothing.
TYPO_LETTERS = 7
STRENGTH = {"strong": 1, "noenv": 2, "typo": 3}
#: Names in a tile of a block.
TILE = 1000
#: Times that hooks are followed in a round of components.
JUMPS = 3


def name_keys(c: Column) -> Column:
    """A name as written in one way, without separators, without environment, without version, and without both."""
    written = F.trim(F.regexp_replace(fold(c), r"[^a-z0-9]+", " "))
    no_env = F.trim(F.regexp_replace(written, rf"(^| )({ENVIRONMENTS})( |$)", " "))
    no_ver = F.trim(F.regexp_replace(written, r"( v?[0-9]+)+$", ""))
    core = F.trim(F.regexp_replace(no_env, r"( v?[0-9]+)+$", ""))
    compact = lambda x: F.regexp_replace(x, " ", "")
    return F.struct(written.alias("written"), compact(written).alias("compact"), compact(no_env).alias("noenv"), compact(no_ver).alias("nover"), compact(core).alias("core"))


def _block_keys(name: str) -> Column:
    k = name_keys(F.col(name))
    keys = F.array_distinct(F.concat(F.array(k["compact"], k["noenv"], k["nover"], k["core"]), F.split(k["written"], " ")))
    return F.filter(keys, lambda x: F.length(x) > 1)


def _standing(rows: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (id, name, ...) and ``standing``: the least id of those whose names have the same keys and that agree in ``beside``, null without keys.

    Rows of one name meet first, so keys are made once a name, however many rows have it, and what was found is joined to the rows.
    """
    columns, keys = ["name", *beside], F.array_sort(_block_keys("name"))
    forms = rows.groupBy(*columns).agg(F.min("id").alias("first"))
    forms = stored(forms.select(*columns, "first", F.when(F.size(keys) > 0, F.to_json(F.struct(keys.alias("k"), *beside))).alias("same")))
    least = stored(forms.where("same is not null").groupBy("same").agg(F.min("first").alias("standing")))
    return join_same(rows, stored(forms.join(least, "same").select(*columns, "standing")), columns)


def name_members(names: DataFrame, key: str, name: str) -> DataFrame:
    """(id, representative): rows with the same keys and words have one representative, the least id; a row without any is its own.

    Rows of one representative are candidates of each other, and what holds for a pair of representatives holds for all their rows.
    """
    standing = _standing(names.select(F.col(key).alias("id"), F.col(name).alias("name")))
    return standing.select("id", F.coalesce("standing", "id").alias("representative"))


def candidate_pairs(names: DataFrame, key: str, name: str) -> DataFrame:
    """Pairs (a < b) that share a key or a word; blocks of any size are compared, in pairs of tiles spread over tasks.

    Their number grows with the square of a block: over tables that repeat names, pair the representatives of :func:`name_members`.
    """
    blocks = names.select(F.col(key).alias("id"), F.explode(_block_keys(name)).alias("block"))
    tiles = blocks.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block", F.ceil(F.col("n") / TILE).alias("tiles"))
    kept = blocks.join(tiles, "block").select("block", "id", F.pmod(F.xxhash64("id"), "tiles").alias("tile"), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1).alias("others"))
    left = kept.select("block", F.col("id").alias("a"), F.col("tile").alias("i"), F.explode("others").alias("j"))
    right = kept.select("block", F.col("id").alias("b"), F.explode("others").alias("i"), F.col("tile").alias("j"))
    return left.join(right, ["block", "i", "j"]).where("a < b").select("a", "b").distinct()


def verdict(a: Column, b: Column) -> Column:
    """What two names are to each other: strong, noenv, typo, doubt or none."""
    return verdict_of(name_keys(a), name_keys(b))


def verdict_of(x: Column, y: Column) -> Column:
    """:func:`verdict` from the keys of both names, where they are at hand."""
    close = (F.levenshtein(x["compact"], y["compact"]) == 1) & (F.least(F.length(x["compact"]), F.length(y["compact"])) >= TYPO_LETTERS)
    digits = F.regexp_replace(x["compact"], "[^0-9]", "") == F.regexp_replace(y["compact"], "[^0-9]", "")
    return (
        F.when(x["compact"] == y["compact"], "strong")
        .when((x["noenv"] == y["noenv"]) & (x["noenv"] != ""), "noenv")
        .when(close & digits, "typo")
        .when((x["core"] == y["core"]) & (x["core"] != ""), "doubt")
        .otherwise("none")
    )


def connected(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b): the smallest node reachable.

    Each round hooks every node to its smallest neighbour, if that is smaller, follows hooks JUMPS times and draws the edges between where they
    lead; edges inside one place are gone, so rounds get smaller.  No hook leads to a larger node, so the smallest of a component
    stays and names it.  Each round is a table in the shared folder.  Edges left after ``most_rounds`` are an error.
    """
    ends = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    first = live = stored(ends)
    live = live.where("lo != hi")
    hooks: list[DataFrame] = []
    for _ in range(most_rounds):
        hook = stored(live.groupBy("hi").agg(F.min("lo").alias("to")))
        if hook.isEmpty():
            break
        for _ in range(JUMPS):
            on = hook.select(F.col("hi").alias("to"), F.col("to").alias("on"))
            hook = stored(hook.join(on, "to", "left").select("hi", F.coalesce("on", "to").alias("to")))
        hooks.append(hook)
        led = live.join(hook, "hi").select("lo", F.col("to").alias("b")).join(hook.toDF("lo", "on"), "lo", "left").select(F.coalesce("on", "lo").alias("a"), "b")
        live = stored(led.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
    else:
        raise RuntimeError("components did not settle")
    smallest = first.select(F.col("lo").alias("node")).distinct()
    if not hooks:
        return smallest.withColumn("component", F.col("node"))
    found = hooks[-1]
    for hook in reversed(hooks[:-1]):
        later = found.join(hook, "hi", "left_anti")  # hooked in a later round only
        found = stored(hook.join(found.toDF("to", "on"), "to", "left").select("hi", F.coalesce("on", "to").alias("to")).unionByName(later))
    found = found.toDF("node", "component")
    alone = smallest.join(found, "node", "left_anti").withColumn("component", F.col("node"))
    return stored(found.unionByName(alone))


def connected_sides(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of ``edges`` (a, b) whose a's are never b's: (a, component) and (b, component), each named by its smallest b.

    The b's of an a are joined to the smallest of them, so the a's leave the graph before it is walked.
    """
    edges = edges.where("a is not null and b is not null")
    least = stored(edges.groupBy("a").agg(F.min("b").alias("b")))
    drawn = edges.join(least.toDF("a", "least"), "a").select(F.col("least").alias("a"), "b")
    of_b = connected(drawn).toDF("b", "component")
    return least.join(of_b, "b").select("a", "component"), of_b


def paths(edges: DataFrame, src, dst, depth: int) -> DataFrame:
    """Simple paths from ``src`` to ``dst`` of at most ``depth`` hops: (path, hops), shortest first."""
    edges = stored(edges.select("src", "dst"))
    live = edges.where(F.col("src") == src).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    done = live.where(F.col("at") == dst)
    for _ in range(depth - 1):
        grown = live.where(F.col("at") != dst).join(edges, F.col("at") == F.col("src"))
        live = stored(grown.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        done = done.unionByName(live.where(F.col("at") == dst))
    return done.select("path", (F.size("path") - 1).alias("hops")).orderBy("hops", "path")


def common_reach(reached: DataFrame, n: int) -> DataFrame:
    """Nodes that all ``n`` origins reach."""
    return reached.groupBy("node").agg(F.countDistinct("origin").alias("origins"), F.max("hops").alias("farthest")).where(F.col("origins") == n)


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs (src < dst) of ``edges`` (src, dst) that point at each other.

    Only nodes that are a src and a dst can be in one, so other edges leave first; the rest is one aggregation that sees each pair from both sides.
    """
    edges = edges.where("src is not null and dst is not null and src != dst")
    nodes = stored(edges.select(F.col("src").alias("node")).distinct())
    inner = edges.join(nodes.toDF("dst"), "dst", "left_semi")
    pairs = inner.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    seen = pairs.agg(F.max(F.when(F.col("src") < F.col("dst"), 1).otherwise(0)).alias("up"), F.max(F.when(F.col("src") > F.col("dst"), 1).otherwise(0)).alias("down"))
    return seen.where("up = 1 and down = 1").select(F.col("lo").alias("src"), F.col("hi").alias("dst"))


def majority_parent(votes: DataFrame, child: str, parent: str) -> DataFrame:
    """The parent most of a child's rows name; ties by name."""
    per = votes.groupBy(child, parent).agg(F.count("*").alias("n"))
    return per.groupBy(child).agg(F.min_by(F.struct(parent, "n"), F.struct(-F.col("n"), F.col(parent))).alias("x")).select(child, f"x.{parent}", F.col("x.n").alias("votes"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation on weighted undirected ``edges`` (a, b, w): every node takes the label of most weight around it, ties to the least."""
    both = stored(edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    labels = both.select("a").distinct().withColumn("label", F.col("a"))
    for _ in range(rounds):
        around = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
        labels = stored(around.groupBy("a").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label")))
    return labels.select(F.col("a").alias("node"), "label")


def communities_of_sides(edges: DataFrame, rounds: int, name_a, name_b) -> tuple[DataFrame, DataFrame]:
    """:func:`communities` of ``edges`` (a, b, w) whose a's are never b's: (a, label, of) and (b, label, of), ``of`` telling whose key a label is.

    A round gives the labels of one side to the other, so all labels of a side are keys of one side: keys alone are shuffled, and ``name_a`` and
    ``name_b`` write a key as the name that decides between equals.  Edges are sent to the node that reads them once, for both sums.
    """
    edges = stored(edges.select("a", "b", "w"))
    names = {"a": name_a, "b": name_b}

    def heard(to: str, of: str, labels: DataFrame | None, kind: str) -> DataFrame:
        told = edges.select(to, F.col(of).alias("label"), "w") if labels is None else edges.join(labels, of).select(to, "label", "w")
        around = told.repartition(to).groupBy(to, "label").agg(F.sum("w").alias("w"))
        return stored(around.groupBy(to).agg(F.min_by("label", F.struct(-F.col("w"), names[kind](F.col("label")))).alias("label")))

    of_a, of_b, kind_a, kind_b = None, None, "a", "b"
    for _ in range(rounds):
        of_a, of_b = heard("a", "b", of_b, kind_b), heard("b", "a", of_a, kind_a)
        kind_a, kind_b = kind_b, kind_a
    return of_a.withColumn("of", F.lit(kind_a)), of_b.withColumn("of", F.lit(kind_b))


def span_calls(spans: DataFrame, time: str | None = None, within: int = 3600) -> DataFrame:
    """(caller, callee, calls, mean_duration) from spans (trace_id, span_id, parent_id, service, duration); calls inside a service do not count.

    With ``time`` a span and its parent lie at most ``within`` seconds apart: ids that come again later are other spans.
    """
    at = lambda name: [] if time is None else [F.unix_micros(F.col(time).cast("timestamp")).alias(name)]
    parent = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("caller"), *at("_parent_at"))
    calls = spans.select("*", *at("_at")).join(parent, ["trace_id", "parent_id"]).where("caller != service")
    if time is not None:
        calls = calls.where(F.abs(F.col("_at") - F.col("_parent_at")) <= within * 1_000_000)
    return calls.groupBy("caller", F.col("service").alias("callee")).agg(F.count("*").alias("calls"), F.avg("duration").alias("mean_duration"))


def same_moment(a: DataFrame, b: DataFrame, keys: list[str], time: str, micros: int) -> DataFrame:
    """Rows of ``a`` and ``b`` with equal ``keys`` at most ``micros`` apart.

    Time is cut into buckets of that size and each row of ``a`` asks its own and both neighbours: an equi-join.
    """
    at = lambda p: F.unix_micros(F.col(p).cast("timestamp"))
    left = a.withColumn("at_a", at(time)).withColumn("slot", F.explode(F.array(*(F.floor(F.col("at_a") / micros) + i for i in (-1, 0, 1)))))
    right = b.withColumn("at_b", at(time)).withColumn("slot", F.floor(F.col("at_b") / micros)).drop(time)
    return left.join(right, [*keys, "slot"]).where(F.abs(F.col("at_a") - F.col("at_b")) <= micros).drop("slot")


def set_likeness(pods: DataFrame, name: str, member: str, least: float) -> DataFrame:
    """Pairs of names (a < b) whose member sets have a Jaccard similarity of ``least`` or more."""
    m = pods.select(F.col(name).alias("n"), F.col(member).alias("m")).distinct()
    sizes = m.groupBy("n").agg(F.count("*").alias("s"))
    both = m.select("m", F.col("n").alias("a")).join(m.select("m", F.col("n").alias("b")), "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    x, y = sizes.select(F.col("n").alias("a"), F.col("s").alias("sa")), sizes.select(F.col("n").alias("b"), F.col("s").alias("sb"))
    score = F.col("common") / (F.col("sa") + F.col("sb") - F.col("common"))
    return both.join(x, "a").join(y, "b").select("a", "b", "common", F.round(score, 6).alias("jaccard")).where(F.col("jaccard") >= least)


def shared_member_groups(pods: DataFrame, name: str, member: str, least: float) -> DataFrame:
    """(name, group): names whose member sets are alike (:func:`set_likeness`), directly or through others; a group is named by its first."""
    alike = set_likeness(pods, name, member, least).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    joined = connected(alike)
    every = pods.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("name")).distinct()
    return every.join(joined.toDF("name", "component"), "name", "left").select("name", F.coalesce("component", "name").alias("group"))


def named_twice(values: DataFrame) -> DataFrame:
    """(key, n_values, categories): names (id, category, name) that are values of two categories or more, by their letters and digits."""
    key = name_keys(F.col("name"))["compact"].alias("key")
    per = values.select(key, "category").where("key != ''").groupBy("key").agg(F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"), F.count_distinct("category").alias("_n"))
    return per.where("_n > 1").drop("_n")


def written_two_ways(values: DataFrame, links: DataFrame, least: int = 4) -> DataFrame:
    """(a, b, how): values (id, category, name) of a category that may be one thing written twice: the same letters and digits, or a name and its plural.

    Each of equal names pairs with the first of them.  Values that a link (a, b) joins are two things.  A plural is of a name of ``least``
    letters that does not end in a digit.
    """
    keyed = stored(values.select("id", "category", name_keys(F.col("name"))["compact"].alias("key")).where("key != ''"))
    first = stored(keyed.groupBy("category", "key").agg(F.min("id").alias("a")))
    same = keyed.join(first, ["category", "key"]).where("id != a").select("a", F.col("id").alias("b"), F.lit("same letters").alias("how"))
    k = F.col("key")
    plurals = F.array(F.concat(k, F.lit("s")), F.concat(k, F.lit("es")), F.when(k.endswith("y"), F.concat(F.expr("left(key, length(key) - 1)"), F.lit("ies"))))
    single = first.where((F.length("key") >= least) & ~k.rlike("[0-9]$")).select("category", "a", F.explode(plurals).alias("key"))
    plural = single.join(keyed, ["category", "key"]).select("a", F.col("id").alias("b"), F.lit("plural").alias("how"))
    joined = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return same.unionByName(plural).join(joined, ["a", "b"], "left_anti").distinct()


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(origin, node, hops): nodes near each origin along edges in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return reach(both, start, hops)


def chains(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(direction, path): simple paths of at most ``depth`` edges from each start node, forward and back."""
    out = None
    for direction, src, dst in (("forward", "src", "dst"), ("back", "dst", "src")):
        steps = stored(edges.select(F.col(src).alias("at"), F.col(dst).alias("to")).distinct())
        live = start.select(F.array("node").alias("path"), F.col("node").alias("at"))
        for _ in range(depth):
            live = stored(live.join(steps, "at").where(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at")))
            part = live.select(F.lit(direction).alias("direction"), "path")
            out = part if out is None else out.unionByName(part)
    return out


def alias_groups(names: DataFrame, name: str, aliases: list[str]) -> DataFrame:
    """(name, group): names and their aliases that one inventory row or a chain of rows holds together; the group is its first name."""
    edges = [names.select(F.col(name).alias("a"), F.col(a).alias("b")).where("a is not null and b is not null") for a in aliases]
    whole = edges[0]
    for e in edges[1:]:
        whole = whole.unionByName(e)
    return connected(whole.distinct()).select(F.col("node").alias("name"), F.col("component").alias("group"))


def name_groups(names: DataFrame, name: str) -> DataFrame:
    """(name, group, canonical): names of one core whose numbers agree; names with different numbers are never one thing.

    ``canonical`` is the name most rows have, the shortest of equals, the first by text of those.
    """
    keyed = names.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).withColumn("core", name_keys(F.col("name"))["core"])
    keyed = keyed.withColumn("group", F.concat_ws("#", "core", F.array_join(F.regexp_extract_all("name", F.lit("([0-9]+)"), 1), ".")))
    best = keyed.groupBy("group").agg(F.min_by("name", F.struct(-F.col("n"), F.length("name"), "name")).alias("canonical"))
    return keyed.join(best, "group").select("name", "group", "canonical")


def extensions(names: DataFrame) -> DataFrame:
    """(a, b) of ``names`` (id, name): b's name is a's and one word more, where two names or more extend a's so: a whole and a part of it."""
    written = names.select("id", name_keys(F.col("name"))["written"].alias("w")).where("w != ''")
    longer = written.where("instr(w, ' ') > 0").select(F.col("id").alias("b"), F.expr("substring_index(w, ' ', size(split(w, ' ')) - 1)").alias("w"), F.expr("substring_index(w, ' ', -1)").alias("last"))
    longer = longer.where(~F.col("last").rlike(rf"^({ENVIRONMENTS}|v?[0-9]+)$"))
    stems = longer.groupBy("w").agg(F.countDistinct("last").alias("n")).where("n > 1").select("w")
    return written.select(F.col("id").alias("a"), "w").join(longer.join(stems, "w", "left_semi"), "w").select("a", "b")


def entity_groups(names: DataFrame) -> DataFrame:
    """(id, group) of ``names`` (id, name, whole): rows that are one thing.

    Names of equal keys are one row first (:func:`name_members`) where their wholes agree.  Pairs of a block that a verdict joins merge,
    the surest first; never a part and its whole, parts of different wholes, or a name and one that extends it among others.
    """
    keyed = stored(_standing(names.select("id", "name", "whole"), ("whole",)))
    few = stored(keyed.where("id = standing").select("id", "name", "whole"))
    wholes = few.where("whole is not null").select(F.col("id").alias("a"), F.col("whole").alias("id"))
    parts = wholes.join(keyed.where("standing is not null").select("id", F.col("standing").alias("b")), "id").select("a", "b")
    apart = parts.unionByName(extensions(few.select("id", "name"))).where("a != b")
    groups = groups_apart(few.select(F.col("id").alias("node"), "whole"), _linked(few), apart, ("whole",), connected)
    return keyed.select("id", "standing").join(groups.toDF("standing", "group"), "standing", "left").select("id", F.coalesce("group", "id").alias("group"))


def _linked(names: DataFrame) -> DataFrame:
    """(a, b, rank) of ``names`` (id, name, whole): pairs of a block that a verdict joins, without parts of different wholes, which never merge.

    A way of writing is judged once, whatever wholes it has.  One without a whole meets every one that it is linked with, others those of their whole.
    """
    spelled = names.select("id", "name", "whole", name_keys(F.col("name")).alias("k"))
    forms = stored(spelled.groupBy("k").agg(F.min("id").alias("form"), F.min("name").alias("name")))
    members = stored(spelled.join(forms.select("k", "form"), "k").select("form", "id", "whole"))
    met = stored(candidate_pairs(forms, "form", "name"))
    met = met.join(forms.select(F.col("form").alias("a"), F.col("k").alias("ka")), "a").join(forms.select(F.col("form").alias("b"), F.col("k").alias("kb")), "b")
    what = verdict_of(F.col("ka"), F.col("kb"))
    rank = F.element_at(F.create_map(*(F.lit(v) for pair in STRENGTH.items() for v in pair)), F.col("what"))
    met = met.select(F.col("a").alias("fa"), F.col("b").alias("fb"), what.alias("what")).select("fa", "fb", rank.alias("rank")).where("rank is not null")
    links = stored(met.unionByName(forms.select(F.col("form").alias("fa"), F.col("form").alias("fb"), F.lit(STRENGTH["strong"]).alias("rank"))))
    free, held = members.where("whole is null"), members.where("whole is not null")
    a = lambda df: df.select(F.col("form").alias("fa"), F.col("id").alias("a"), "whole")
    b = lambda df: df.select(F.col("form").alias("fb"), F.col("id").alias("b"), "whole")
    found = [
        links.join(a(free).drop("whole"), "fa").join(b(members).drop("whole"), "fb"),
        links.join(b(free).drop("whole"), "fb").join(a(held).drop("whole"), "fa"),
        links.join(a(held), "fa").join(b(held), ["fb", "whole"]),
    ]
    return reduce(DataFrame.unionByName, (df.select("a", "b", "rank") for df in found)).where("a != b")


def relations(fields: dict[str, DataFrame], names: dict[str, DataFrame], least: float = 0.5) -> DataFrame:
    """(field, target, share): fields of which ``least`` of the distinct values name a row of a target, by columns of one value each."""
    long = lambda frames, label: _stacked(frames, label).where("v is not null").distinct()
    f, t = long(fields, "field"), long(names, "target")
    sizes = f.groupBy("field").agg(F.count("*").alias("size"))
    held = f.join(t, "v").groupBy("field", "target").agg(F.count("*").alias("held"))
    share = F.round(F.col("held") / F.col("size"), 6)
    return held.join(F.broadcast(sizes), "field").select("field", "target", share.alias("share")).where(F.col("share") >= least)  # sizes: a row a field


def _stacked(frames: dict[str, DataFrame], label: str) -> DataFrame:
    out = None
    for name, df in frames.items():
        part = df.select(F.lit(name).alias(label), F.col(df.columns[0]).cast("string").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


def category_fields(fields: dict[str, DataFrame], category: DataFrame, least: int = 3, of_category: float = 0.5, of_field: float = 0.6) -> DataFrame:
    """(field, held, of_category, of_field): fields that hold enough of a category's values, which are enough of their own."""
    f = _stacked(fields, "field").where("v is not null").distinct()
    c = category.select(F.col(category.columns[0]).cast("string").alias("v")).distinct()
    size = c.agg(F.count("*").alias("values"))
    per = f.join(c.withColumn("in", F.lit(1)), "v", "left").groupBy("field").agg(F.count("in").alias("held"), F.count("*").alias("own"))
    per = per.join(F.broadcast(size), how="cross")  # one row
    return per.select(
        "field", "held", F.round(F.col("held") / F.col("values"), 6).alias("of_category"), F.round(F.col("held") / F.col("own"), 6).alias("of_field")
    ).where((F.col("held") >= least) & (F.col("of_category") >= of_category) & (F.col("of_field") >= of_field))


def parts_index(mentions: DataFrame, pages: DataFrame, page: str, space: str, changed: str) -> DataFrame:
    """(name, own_space, n_pages, n_spaces, last_change) of every name with a mention (name, page).

    ``own_space`` is the space with most pages about it, the first by name of equals; pages are (page, space, changed).
    """
    on = mentions.select("name", page).distinct().join(pages.select(page, space, changed), page)
    per = on.groupBy("name", space).agg(F.count("*").alias("n"), F.max(changed).alias("last"))
    return per.groupBy("name").agg(
        F.min_by(space, F.struct(-F.col("n"), F.col(space))).alias("own_space"), F.sum("n").alias("n_pages"), F.count("*").alias("n_spaces"), F.max("last").alias("last_change")
    )


def same_event_kinds(events: DataFrame, kind: str, keys: list[str], time: str, row: str, micros: int, least: float = 0.8) -> DataFrame:
    """(a, b, share, same): for kinds of events (a != b) the share of a's rows with a row of b at the same keys and moment; same from ``least`` on."""
    one = lambda side: events.select(*keys, time, F.col(kind).alias(side), F.col(row).alias(f"row_{side}"))
    met = same_moment(one("a"), one("b"), keys, time, micros).where("a != b").select("a", "b", "row_a").distinct()
    total = events.groupBy(F.col(kind).alias("a")).agg(F.count("*").alias("rows"))
    per = met.groupBy("a", "b").agg(F.count("*").alias("n")).join(F.broadcast(total), "a")  # a row a kind
    share = F.round(F.col("n") / F.col("rows"), 6)
    return per.select("a", "b", share.alias("share"), (share >= least).alias("same"))
