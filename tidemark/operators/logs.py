"""Log mining: message templates, their counts a window, and what is new, gone, rare or above its usual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.entities import same_moment
from tidemark.operators.names import atoms, names_in

# When a template's count is told.
NEW_LINES, NEW_ERRORS = 5, 2
HIGH = 2.0
NOISE = 3.0
GONE_SHARE = 0.75
VALUE_HIGH, VALUE_FEW = 2.0, 2.5
HELD = 0.8
#: Words of a line that state what one part does with another.
KINDS = {"waits for": "waits", "calls": "calls", "reads from": "reads", "writes to": "writes", "depends on": "depends"}
#: Words between two parts, and what they say the first does with the second.
VERBS = {
    **dict.fromkeys(("waits", "waiting", "awaits", "blocked"), "waits"), **dict.fromkeys(("calls", "calling", "called", "invokes", "requests"), "calls"),
    **dict.fromkeys(("reads", "reading", "loads", "fetches", "queries"), "reads"), **dict.fromkeys(("writes", "writing", "stores", "saves"), "writes"),
    **dict.fromkeys(("sends", "sending", "publishes", "forwards"), "sends"), **dict.fromkeys(("depends", "needs", "requires"), "depends"), **dict.fromkeys(("starts", "triggers", "launches"), "triggers"),
}
SEVERITY = {"trace": 0, "debug": 1, "info": 2, "warning": 3, "error": 4, "fatal": 5}
#: Patterns of the parts of a message that vary, masked in this order.
MASKS = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?", "#"),
    (r"\b0x[0-9a-fA-F]+\b", "#"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "#"),
    (r"'[^']*'", "'<value>'"),
    (r'"[^"]*"', "'<value>'"),
    (r"[0-9]+(\.[0-9]+)?", "#"),
    (r"\s+", " "),
)
#: A list of names in a masked message.
LISTED = r"<name>((\s*[,;/&+]\s*|\s+(and|or)\s+)<name>)+"


def template(message: Column) -> Column:
    """A message with what varies masked: times, hexadecimal, quoted values and numbers."""
    for pattern, by in MASKS:
        message = F.regexp_replace(message, pattern, by)
    return F.rtrim(F.trim(message), F.lit(" .,;:"))


def is_name(token: Column) -> Column:
    """Whether a token is written as an identifier: letters with digits or underscores, or with dots or dashes inside; no number with its unit, no joined words."""
    core = F.regexp_extract(token, r"^[.-]*(.*?)[.-]*$", 1)
    return core.rlike("[A-Za-z]") & ~core.rlike(r"^[+-]?[0-9]+([.,][0-9]+)?[A-Za-z%]{1,5}$") & ~core.rlike("^[a-z]+(-[a-z]+)+$") & core.rlike("[0-9_#]|[A-Za-z0-9][.-][A-Za-z0-9]")


def shape(message: Column) -> Column:
    """(pattern, names) of a message: identifiers masked as <name>, a list of them as one, beside what :func:`template` masks.

    A message that says nothing but names keeps them: they are what it says.
    """
    for mask, by in MASKS[:-2]:
        message = F.regexp_replace(message, mask, by)
    tokens = F.regexp_extract_all(message, F.lit(r"([A-Za-z0-9_.#-]+|[^A-Za-z0-9_.#-]+)"), 1)
    ends = lambda x: (F.regexp_extract(x, r"^([.-]*)", 1), F.regexp_extract(x, r"([.-]*)$", 1))
    plain = lambda x: F.regexp_replace(x, *MASKS[-2])
    masked = F.array_join(F.transform(tokens, lambda x: F.when(is_name(x), F.concat(ends(x)[0], F.lit("<name>"), ends(x)[1])).otherwise(plain(x))), "")
    masked = F.regexp_replace(masked, LISTED, "<name>")
    tidy = lambda c: F.rtrim(F.trim(F.regexp_replace(c, *MASKS[-1])), F.lit(" .,;:"))
    says = F.regexp_replace(masked, "<name>|'<value>'", " ").rlike("[A-Za-z]{3,}")
    names = F.transform(F.filter(tokens, is_name), lambda x: F.regexp_extract(x, r"^[.-]*(.*?)[.-]*$", 1))
    as_written = F.array_join(F.transform(tokens, lambda x: F.when(is_name(x), x).otherwise(plain(x))), "")
    return F.struct(F.when(says, tidy(masked)).otherwise(tidy(as_written)).alias("pattern"), F.when(says, names).otherwise(F.array().cast("array<string>")).alias("names"))


def numbers(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)


def level(message: Column) -> Column:
    """The level a line states, where there is no level column."""
    low = F.lower(message)
    return (
        F.when(low.rlike(r"\b(fatal|critical|panic)\b"), "fatal")
        .when(low.rlike(r"\b(error|exception|failed|failure)\b"), "error")
        .when(low.rlike(r"\b(warn|warning)\b"), "warning")
        .when(low.rlike(r"\b(debug|trace)\b"), "debug")
        .otherwise("info")
    )


def severity(level_col: Column) -> Column:
    """The rank of a level: fatal highest, what is not known as info."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair)), F.lower(level_col)), F.lit(SEVERITY["info"]))


def longest_piece(template_col: Column) -> Column:
    """The longest literal piece of a template, if it has 12 characters."""
    pieces = F.split(template_col, r"#|'<value>'|<name>")
    best = F.element_at(F.array_sort(F.transform(pieces, lambda x: F.struct(-F.length(F.trim(x)), F.trim(x).alias("t")))), 1)["t"]
    return F.when(F.length(best) >= 12, best)


def judge(counts: DataFrame, windows: int) -> DataFrame:
    """(template, level, k, n) -> a verdict a template; windows 1 .. ``windows`` are the earlier ones, without rows they count 0."""
    per = counts.groupBy("template").agg(
        F.max_by("level", severity(F.col("level"))).alias("level"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("now"),
        F.collect_list(F.when(F.col("k") > 0, F.col("n"))).alias("seen"),
    )
    # At most ``windows`` counts a template: padded with zeros, the middle of the sorted list is the median.
    padded = F.array_sort(F.concat("seen", F.array_repeat(F.lit(0).cast("bigint"), F.lit(windows) - F.size("seen"))))
    middle = (F.element_at(padded, windows // 2 + 1) + F.element_at(padded, (windows + 1) // 2)) / 2.0
    x = per.select("template", "level", "now", F.size("seen").alias("seen_on"), middle.alias("usual"))
    now, usual, seen = F.col("now"), F.col("usual"), F.col("seen_on")
    least = F.when(F.col("level").isin("error", "fatal"), NEW_ERRORS).otherwise(NEW_LINES)
    verdict = (
        F.when((seen == 0) & (now >= least), "new")
        .when((usual > 0) & (now >= HIGH * usual) & (now - usual > NOISE * F.sqrt(usual)) & (now - usual >= least), "above usual")
        .when((usual == 0) & (seen > 0) & (now >= least), "rare")
        .when((usual >= NEW_LINES) & (now == 0) & (seen >= GONE_SHARE * windows), "gone")
        .when((usual > 0) & (now <= usual / HIGH) & (usual - now > NOISE * F.sqrt(usual)), "below usual")
        .otherwise("as usual")
    )
    return x.withColumn("verdict", verdict)


def numbers_moved(lines: DataFrame) -> DataFrame:
    """(template, k, message): numbers, by their place, whose median now is far from the median of their daily medians."""
    long = lines.select("template", "k", F.posexplode(numbers(F.col("message"))).alias("place", "x")).withColumn("x", F.col("x").cast("double"))
    daily = long.groupBy("template", "place", "k").agg(F.median("x").alias("m"), F.count("*").alias("n"))
    both = daily.groupBy("template", "place").agg(
        F.max(F.when((F.col("k") == 0) & (F.col("n") >= 5), F.col("m"))).alias("now"),
        F.median(F.when((F.col("k") > 0) & (F.col("n") >= 3), F.col("m"))).alias("usual"),
        F.count_if((F.col("k") > 0) & (F.col("n") >= 3)).alias("days"), F.max("k").alias("last"),
    )
    bar = F.when(F.col("days") >= F.greatest(F.lit(2), F.floor(F.col("last") / 2)), VALUE_HIGH).otherwise(VALUE_FEW)
    r = F.col("now") / F.col("usual")
    return both.where("now > 0 and usual > 0").where((r >= bar) | (r <= 1 / bar)).select("template", "place", "now", "usual", r.alias("ratio"), "days")


def written_back(lines: DataFrame) -> DataFrame:
    """(template, place, name, share): quoted names that HELD of a template's lines have in the same place, and that it may be told with."""
    total = lines.groupBy("template").agg(F.count("*").alias("lines"))
    names = lines.select("template", F.posexplode(F.regexp_extract_all("message", F.lit("'([^']*)'"), 1)).alias("place", "name"))
    per = names.groupBy("template", "place", "name").agg(F.count("*").alias("n")).join(total, "template")
    return per.where(F.col("n") >= HELD * F.col("lines")).select("template", "place", "name", F.round(F.col("n") / F.col("lines"), 6).alias("share"))


def origins(lines: DataFrame, fields: list[str], most: int = 4) -> DataFrame:
    """(template, field, n_values, top, coverage): where a template's lines come from, by the ``most`` values of each field."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    long = lines.select("template", F.explode(F.array(*parts)).alias("p")).where("p.value is not null")
    per = long.groupBy("template", F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("template", "field").orderBy(F.desc("n"), "value"))
    per = per.withColumn("rank", rank)
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "value"))))  # ``most`` values a field
    return per.groupBy("template", "field").agg(
        F.count("*").alias("n_values"), F.array_join(F.transform(top, lambda x: x["value"]), ", ").alias("top"),
        F.round(F.sum(F.when(F.col("rank") <= most, F.col("n"))) / F.sum("n"), 6).alias("coverage"),
    )


def survey(judged: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` findings to tell first: what is not as usual, by severity, then lines; the same wording counts once, at its highest level."""
    told = judged.where("verdict != 'as usual'").withColumn("severity", severity(F.col("level")))
    order = Window.orderBy(F.desc("severity"), F.desc("now"), "template")
    return told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("place", "template", "level", "now", "usual", "verdict")


def same_lines(a: DataFrame, b: DataFrame, keys: list[str], time: str, row: str, micros: int = 2_000_000, least: float = HELD) -> DataFrame:
    """(keys, n_lines, found, share, same): the lines of ``a`` (keys, time, row, message) whose longest clean piece a line of ``b`` has, at the same keys and
    at most ``micros`` apart; from ``least`` of them on both tables tell the same events.  Lines without a piece of 12 characters do not count."""
    pieces = a.select(*keys, time, row, longest_piece(template(F.col("message"))).alias("piece")).where("piece is not null")
    met = same_moment(pieces, b.select(*keys, time, F.col("message").alias("other")), keys, time, micros)
    found = met.where(F.contains(template(F.col("other")), F.col("piece"))).select(*keys, row).distinct().groupBy(*keys).agg(F.count("*").alias("found"))
    both = pieces.groupBy(*keys).agg(F.count("*").alias("n_lines")).join(found, keys, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.withColumn("share", F.round(F.col("found") / F.col("n_lines"), 6)).withColumn("same", F.col("share") >= least)


def stated(lines: DataFrame, line: str, day: str, message: str, names: DataFrame, most: int = 4) -> DataFrame:
    """(src, kind, dst, n_lines, n_days): what lines say that one known part does with the next, every statement of a line.

    Parts are the names (name) that a line holds (:func:`tidemark.operators.names.names_in`); the kind is read from the at most ``most`` words between
    two of them: the first that VERBS know.  A statement that a line makes twice counts once.
    """
    words = lines.select(F.col(line).alias("line"), F.col(day).alias("day"), atoms(F.col(message)).alias("ws"))
    held = names_in(lines.select(F.col(line).alias("line"), F.col(message).alias("m")), "line", F.col("m"), names)
    w = Window.partitionBy("line").orderBy("place")
    pairs = held.select("line", F.col("name").alias("src"), (F.col("place") + F.col("n_words")).alias("at"), F.lead("place").over(w).alias("to"), F.lead("name").over(w).alias("dst"))
    pairs = pairs.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")) & F.col("to").isNotNull() & (F.col("to") > F.col("at")) & (F.col("to") - F.col("at") <= most))
    verbs = F.create_map(*(F.lit(x) for pair in VERBS.items() for x in pair))
    between = F.transform(F.slice("ws", F.col("at") + 1, F.col("to") - F.col("at")), F.lower)
    kinds = F.filter(F.transform(between, lambda x: F.element_at(verbs, x)), lambda k: k.isNotNull())
    said = pairs.join(words, "line").select("line", "day", "src", "dst", F.get(kinds, F.lit(0)).alias("kind")).where("kind is not null").distinct()
    return said.groupBy("src", "kind", "dst").agg(F.count("*").alias("n_lines"), F.countDistinct("day").alias("n_days"))


def stated_links(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(src, kind, dst, n): what lines say that one part does with another, for parts in ``names`` (name); words decide the kind."""
    pattern = r"(?i)([a-z0-9_-]+) (" + "|".join(KINDS) + r") ([a-z0-9_-]+)"
    part = lambda i: F.regexp_extract("message", pattern, i)
    said = lines.select(*(F.lower(part(i)).alias(c) for i, c in ((1, "src"), (2, "said"), (3, "dst")))).where("src != ''")
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    known = names.select(F.lower("name").alias("name")).distinct()
    both = said.join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return both.groupBy("src", F.element_at(kinds, F.col("said")).alias("kind"), "dst").agg(F.count("*").alias("n"))
