"""Names that texts hold: a dictionary of any size as a trie whose steps are a table, walked by joins.

A node of the trie is the words that lead to it.  A word of a text that may open a name (a bitmap of fixed size says so in the same
pass that splits the text, and a join makes sure) becomes a row with the few words behind it; round by round such a row
takes the one step that its next word allows or is done, so a row meets one row of the dictionary a round however many names begin
alike, and nothing of the dictionary is broadcast but the bitmap.  The longest name that begins at a word wins, and
names do not overlap: of two that do, the one that begins first stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import STOP
from tidemark.operators.scratch import kept

#: Words of a name at most, and letters from which a single word is a name however it is written.
LONGEST, SHORT = 5, 3
#: A run of the characters that names are written with, without punctuation at its end.
ATOM = r"[A-Za-z0-9_][A-Za-z0-9_.:/#@-]*"
PLACES = 1 << 22


def atoms(text: Column) -> Column:
    """The words of a text as they are written."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ATOM})"), 1)
    return F.transform(found, lambda w: F.regexp_replace(w, r"[.:/-]+$", ""))


def _lowered(words: Column) -> Column:
    return F.transform(words, F.lower)


def trie(names: DataFrame) -> DataFrame:
    """(node, word, child, name, exact) from ``names`` (name): the step from a node by a word; ``name`` where a name ends at the child.

    ``exact`` holds the spellings of which one must stand in the text, where the name is one common or short word.
    """
    ws = names.where("name is not null").select("name", atoms(F.col("name")).alias("raw")).where(F.size("raw").between(1, LONGEST))
    ws = ws.withColumn("words", _lowered(F.col("raw")))
    joined = lambda n: F.array_join(F.slice("words", F.lit(1), n), " ")
    steps = ws.select("*", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("n"))
    common = (F.size("words") == 1) & ((F.length(F.col("words")[0]) < SHORT) | F.col("words")[0].isin(*STOP))
    ends = F.col("n") == F.size("words")
    steps = steps.select(
        joined(F.col("n") - 1).alias("node"), F.element_at("words", F.col("n")).alias("word"), joined(F.col("n")).alias("child"),
        F.when(ends, F.col("name")).alias("name"), F.when(ends & common, F.col("raw")[0]).alias("spelling"), (ends & ~common).alias("free"),
    )
    found = steps.groupBy("node", "word", "child").agg(F.min("name").alias("name"), F.collect_set("spelling").alias("spellings"), F.max("free").alias("free"))
    return found.select("node", "word", "child", "name", F.when(~F.col("free"), F.col("spellings")).alias("exact"))


def _place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(PLACES).cast("long"))


def _may_open(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The ``rows`` whose ``word`` has the place of one of ``first`` (word) in a bitmap, which is broadcast at its one size."""
    slots = first.select(F.shiftright(_place(F.col("word")), 6).alias("_slot"), _place(F.col("word")).bitwiseAND(F.lit(63)).cast("int").alias("_bit"))
    bits = slots.groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    held = F.expr(f"shiftright(_bits, cast(pmod(xxhash64(word), {PLACES}L) & 63 as int)) & 1") == 1
    return rows.join(F.broadcast(bits), (F.shiftright(_place(F.col("word")), 6) == F.col("_slot")) & held, "left_semi")


def names_in(texts: DataFrame, key: str, text: Column, names: DataFrame) -> DataFrame:
    """(key, place, n_words, name) of the names (name) that each row's text holds, in words of their own.

    Names are found however they are spaced or written in capitals, but a name that is one common or short word only as it is
    spelled.  Names that are equal but for that count as the first of them.  A null text holds none.
    """
    steps = kept(trie(names))
    first = steps.where("node = ''")
    words = texts.select(F.col(key).alias("key"), atoms(text).alias("raw"))
    each = words.select("key", F.posexplode("raw").alias("place", "spelled"), "raw")
    each = each.select("key", "place", F.lower("spelled").alias("word"), "spelled", F.slice("raw", F.col("place") + 2, LONGEST - 1).alias("rest"))
    live = _may_open(each.where("word != ''"), first).withColumn("node", F.lit("")).withColumn("n", F.lit(1))
    done = []
    for n in range(1, LONGEST + 1):
        gone = live.join(steps, ["node", "word"]).select("key", "place", "spelled", "rest", F.col("child").alias("node"), "name", "exact", F.lit(n).alias("n"))
        gone = kept(gone)
        good = F.col("exact").isNull() | F.array_contains("exact", F.col("spelled"))
        done.append(gone.where(F.col("name").isNotNull() & good).select("key", "place", F.col("n").alias("n_words"), "name"))
        if n < LONGEST:
            live = gone.where(F.size("rest") >= n).drop("name", "exact").withColumn("word", F.lower(F.element_at("rest", n)))
    longest = reduce(DataFrame.unionByName, done).groupBy("key", "place").agg(F.max(F.struct("n_words", "name")).alias("x")).select("key", "place", "x.*")
    # From the left, a name that begins inside the one before it goes.
    held = longest.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "n_words", "name"))).alias("all"))
    start = F.struct(F.lit(0).alias("end"), F.filter("all", lambda x: F.lit(False)).alias("kept"))
    after = lambda s, x: F.when(
        x["place"] >= s["end"], F.struct((x["place"] + x["n_words"]).alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))
    ).otherwise(s)
    apart = held.select("key", F.inline(F.aggregate("all", start, after, lambda s: s["kept"])))
    return apart.select(F.col("key").alias(key), "place", "n_words", "name")
