"""Words read as the knowledge spells them: slips of one and two letters, words run together and words cut in two.

Known words lie under every form that they have with one or two letters left out (a word's first letter is never mistyped), so words
two slips apart share a form and meet in an equi-join.  The distance of a pair that meets is the optimal string alignment, a bounded
dynamic programme in column expressions.  What a word is read as: the known word it makes with its neighbour; else the known
word one typing slip away that most pieces hold; else the two known words it runs together, if some piece has them side by
side; else the known word fewest slips away.  A word that is known is read as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scratch import kept
from tidemark.operators.series import first_of_each

#: Letters of a word that is read otherwise at all, of one that is read two slips away, and of a half of a word.
LEAST_LETTERS, TWO_SLIPS, HALF = 5, 7, 3
FRAGMENT = 3
VOWELS = "aeiouy"
#: The rows of letters of two keyboards, how far each row stands in, and how far keys that touch are apart.
KEYBOARDS = ((("qwertyuiop", 0.0), ("asdfghjkl", 0.25), ("zxcvbnm", 0.75)), (("azertyuiop", 0.0), ("qsdfghjklm", 0.25), ("wxcvbn", 0.75)))
TOUCH = 1.3


def beside() -> dict[str, str]:
    """The letters whose keys touch each letter's on either keyboard."""
    near: dict[str, set[str]] = {}
    for rows in KEYBOARDS:
        keys = [(letter, i + indent, y) for y, (row, indent) in enumerate(rows) for i, letter in enumerate(row)]
        for a, xa, ya in keys:
            near.setdefault(a, set()).update(b for b, xb, yb in keys if a != b and (xa - xb) ** 2 + (ya - yb) ** 2 <= TOUCH**2)
    return {a: "".join(sorted(bs)) for a, bs in near.items()}


def _letters(c: Column) -> Column:
    return F.split(c, "")


def slips(a: Column, b: Column, most: int = 2) -> Column:
    """The optimal string alignment distance of two words (a letter missing, one too many, one replaced, two neighbours swapped); null beyond ``most``."""
    x, y = _letters(a), _letters(b)
    at = lambda row, i: F.get(row, i)

    def line(state: Column, i: Column) -> Column:
        """The next row of the table, from (row before the last, last row)."""

        def cell(row: Column, j: Column) -> Column:
            same = at(x, i - 1) == at(y, j - 1)
            step = F.least(at(state["last"], j) + 1, at(row, j - 1) + 1, at(state["last"], j - 1) + F.when(same, 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (at(x, i - 1) == at(y, j - 2)) & (at(x, i - 2) == at(y, j - 1))
            return F.concat(row, F.array(F.when(swap, F.least(step, at(state["older"], j - 2) + 1)).otherwise(step)))

        row = F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell)
        return F.struct(state["last"].alias("older"), row.alias("last"))

    first = F.sequence(F.lit(0), F.length(b))
    table = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.struct(first.alias("older"), first.alias("last")), line, lambda s: s["last"])
    found = F.element_at(table, -1)
    plain = (F.length(a) > 0) & (F.length(b) > 0) & (F.abs(F.length(a) - F.length(b)) <= most)
    return F.when(plain & (found <= most), found)


def typing_slip(a: Column, b: Column) -> Column:
    """Whether typing ``a`` for ``b`` is one slip of the fingers: a letter left out, one too many that is its neighbour's or touches it, two
    swapped, or a key beside the right one or a vowel for a vowel; never at the first letter."""
    near = F.create_map(*(F.lit(v) for pair in beside().items() for v in pair))
    sure = lambda c: F.coalesce(c, F.lit(False))  # noqa: E731  beyond a word's ends there is no letter
    touches = lambda p, q: sure(F.contains(F.element_at(near, p), q))
    x, y, n, m = _letters(a), _letters(b), F.length(a), F.length(b)
    get, other = (lambda i: F.get(x, i)), (lambda i: F.get(y, i))
    cut = lambda w, i: F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w)))
    inner = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    missing = (m == n + 1) & F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: cut(b, i) == a)
    around = lambda i: sure(get(i) == get(i - 1)) | sure(get(i) == get(i + 1)) | touches(get(i - 1), get(i)) | touches(get(i + 1), get(i))
    many = (m == n - 1) & F.exists(inner, lambda i: (cut(a, i) == b) & around(i))
    swapped = (m == n) & (n > 2) & F.exists(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i), F.substring(a, i + 2, F.lit(1)), F.substring(a, i + 1, F.lit(1)), F.substring(a, i + 3, n)) == b,
    )
    vowel = lambda c: F.contains(F.lit(VOWELS), c)
    replaced = (m == n) & F.exists(
        inner,
        lambda i: (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)) & (F.substring(a, i + 2, n) == F.substring(b, i + 2, n))
        & (get(i) != other(i)) & (touches(get(i), other(i)) | (vowel(get(i)) & vowel(other(i)))),
    )
    return F.coalesce((a != b) & (missing | many | swapped | replaced), F.lit(False))


def shortened(c: Column, letters: int) -> Column:
    """The forms of a word with up to ``letters`` of its letters left out, but for the first."""
    forms = F.array(c)
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w))))
    for _ in range(letters):
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, cut))))
    return forms


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` spread over all tasks: a few bytes of words are much work, and Spark would give them to one task by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def near_words(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, term, n_docs, slips, typing) of each of ``asked`` (word) and the words of ``vocab`` (term, n_docs) at most two slips away, with its first letter.

    Words of fewer than TWO_SLIPS letters meet at one slip only.
    """
    forms = F.when(F.length("word") >= TWO_SLIPS, shortened(F.col("word"), 2)).otherwise(shortened(F.col("word"), 1))
    left = asked.select("word", F.explode(forms).alias("form"))
    # Only words that begin as an asked one does and are at most two letters longer or shorter are cut: a long run of letters has forms by the square.
    beside = F.explode(F.sequence(F.length("word") - 2, F.length("word") + 2)).alias("letters")
    spans = kept(asked.select(F.left("word", F.lit(1)).alias("first"), beside).distinct())
    some = vocab.where(F.length("term") > 1).withColumns({"first": F.left("term", F.lit(1)), "letters": F.length("term")}).join(spans, ["first", "letters"], "left_semi")
    right = _dealt(some, "term").select("term", "n_docs", F.explode(shortened(F.col("term"), 2)).alias("form"))
    met = left.join(right, "form").where("word != term and left(word, 1) = left(term, 1)").select("word", "term", "n_docs").distinct()
    # Two slips are four edits at most, and four only as two swaps, which leave the letters as they are: told before the table of a pair is filled.
    edits, letters = F.levenshtein(F.col("word"), F.col("term")), lambda c: F.array_sort(_letters(F.col(c)))
    met = met.where((edits <= 3) | ((edits == 4) & (letters("word") == letters("term"))))
    found = kept(_dealt(met, "word", "term").withColumn("slips", slips(F.col("word"), F.col("term"))))  # stored: a filter would work it out again
    found = found.where((F.col("slips") == 1) | ((F.col("slips") == 2) & (F.length("word") >= TWO_SLIPS)))
    return found.withColumn("typing", typing_slip(F.col("word"), F.col("term")))


def _two_typed(pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (word, term) two slips apart between which a word lies that is a typing slip from either.

    What lies between shares the letters of both: the word with one letter of the term put in, left out, replaced by one, or two swapped.
    """
    a, b = F.col("word"), F.col("term")
    spots = F.sequence(F.lit(1), F.length(a))
    letters = F.array_distinct(_letters(b))
    put = F.flatten(F.transform(spots, lambda i: F.transform(letters, lambda c: F.concat(F.substring(a, F.lit(1), i), c, F.substring(a, i + 1, F.length(a))))))
    changed = F.flatten(F.transform(spots, lambda i: F.transform(letters, lambda c: F.concat(F.substring(a, F.lit(1), i), c, F.substring(a, i + 2, F.length(a))))))
    left = F.transform(spots, lambda i: F.concat(F.substring(a, F.lit(1), i), F.substring(a, i + 2, F.length(a))))
    swap = F.transform(spots, lambda i: F.concat(F.substring(a, F.lit(1), i), F.substring(a, i + 2, F.lit(1)), F.substring(a, i + 1, F.lit(1)), F.substring(a, i + 3, F.length(a))))
    between = F.array_distinct(F.concat(put, changed, left, swap))
    each = _dealt(pairs, "word", "term").select("word", "term", F.explode(between).alias("mid")).where("length(mid) > 0 and mid != word and mid != term")
    # One slip from the term is one letter missing, too many or another, or the same letters in another order: told before keys are looked at.
    mid = F.col("mid")
    same = (F.length(mid) == F.length(b)) & (F.array_sort(_letters(mid)) == F.array_sort(_letters(b)))
    each = each.where((F.levenshtein(mid, b) == 1) | same)
    good = each.where(typing_slip(F.col("word"), F.col("mid")) & typing_slip(F.col("mid"), F.col("term")))
    return good.select("word", "term").distinct()


def readings(asked: DataFrame, vocab: DataFrame, pairs: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, place, n_words, typed, read, how) of the words of ``asked`` (query_id, place, word) that are read otherwise.

    ``vocab`` (term, n_docs) are the known words, ``pairs`` (a, b) those some piece has side by side.  ``how`` is joined, slip, split or near;
    a joined reading takes two places.  Function words (``stop``) are known and never part of a reading but a split's.
    """
    vocab = kept(vocab.where("n_docs > 0").groupBy("term").agg(F.max("n_docs").alias("n_docs")))
    functional = F.col("word").isin(*stop) if stop else F.lit(False)
    words = asked.where(F.col("word").rlike("^[a-z]+$"))
    is_known = vocab.select(F.col("term").alias("word"), F.lit(True).alias("known"))
    words = words.join(is_known, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)) | functional).withColumn("functional", functional)
    words = kept(words.select("query_id", "place", "word", "known", "functional"))
    wrong = kept(words.where(~F.col("known") & (F.length("word") >= LEAST_LETTERS)).select("word").distinct())

    near = kept(near_words(wrong, vocab))
    slip = first_of_each(near.where("typing"), ["word"], [F.desc("n_docs"), F.asc("term")], 1).select("word", F.col("term").alias("read"), F.lit("slip").alias("how"))
    left = wrong.join(slip, "word", "left_anti")

    halves = left.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    halves = halves.select("word", F.expr("left(word, at)").alias("a"), F.expr("substring(word, at + 1)").alias("b"))
    of = lambda side: vocab.select(F.col("term").alias(side), F.col("n_docs").alias(f"n_{side}"))
    is_stop = lambda c: F.col(c).isin(*stop) if stop else F.lit(False)
    plain = halves.where((F.length("a") >= HALF) & (F.length("b") >= HALF) & ~is_stop("a") & ~is_stop("b"))
    plain = kept(plain.join(of("a"), "a").join(of("b"), "b"))

    # Two neighbours that make one known word: one of them unknown or a fragment; two known ones only if no piece has them side by side.
    w = Window.partitionBy("query_id").orderBy("place")
    follow = lambda c: F.lead(c).over(w)
    both = words.select("*", *(follow(c).alias(f"{c}_b") for c in ("place", "word", "known", "functional"))).where(F.col("place_b") == F.col("place") + 1)
    odd = lambda s="": ~F.col(f"known{s}") | ((F.length(f"word{s}") <= FRAGMENT) & ~F.col(f"functional{s}"))
    both = both.withColumn("read", F.concat("word", "word_b")).where((odd() | odd("_b")) & (F.length("read") >= LEAST_LETTERS))
    both = both.join(vocab.select(F.col("term").alias("read")), "read", "left_semi")
    both = kept(both)
    apart = both.where("known and known_b and not functional and not functional_b")
    # Of the pairs side by side only those asked for are kept, so the pairs of all texts are not shuffled.
    wanted = kept(apart.select(F.col("word").alias("a"), F.col("word_b").alias("b")).unionByName(plain.select("a", "b")).distinct())
    seen = kept(pairs.select("a", "b").join(wanted, ["a", "b"], "left_semi").distinct())
    apart = apart.join(seen.toDF("word", "word_b"), ["word", "word_b"], "left_anti")
    plain = plain.join(seen, ["a", "b"], "left_semi").withColumn("n", F.least("n_a", "n_b"))
    joins = both.where("not (known and known_b)").unionByName(apart)
    joins = joins.select("query_id", "place", "read", F.concat_ws(" ", "word", "word_b").alias("typed"))
    # Of joins that overlap, the first of a run goes, and every other one after it.
    run = F.sum((F.coalesce(F.lag("place").over(w), F.lit(-2)) != F.col("place") - 1).cast("int")).over(w)
    joins = joins.withColumn("run", run)
    nth = F.row_number().over(Window.partitionBy("query_id", "run").orderBy("place"))
    joins = kept(joins.withColumn("nth", nth).where("nth % 2 = 1").select("query_id", "place", "typed", "read"))

    cuts = [plain.select("word", "a", "b", "n")]
    for func, other in (("a", "b"), ("b", "a")):
        some = halves.where(is_stop(func) & ~is_stop(other) & (F.length(func) >= HALF) & (F.length(other) > HALF)).join(of(other), other)
        cuts.append(some.select("word", "a", "b", F.col(f"n_{other}").alias("n")))
    split = first_of_each(reduce(DataFrame.unionByName, cuts), ["word"], [F.desc("n"), F.desc("a"), F.desc("b")], 1)
    split = split.select("word", F.concat_ws(" ", "a", "b").alias("read"), F.lit("split").alias("how"))

    rest = near.join(left.join(split, "word", "left_anti"), "word", "left_semi")
    # The fewest slips decide, then the pieces; two slips count only if each is one of typing.
    fewest = kept(first_of_each(rest, ["word"], [F.asc("slips"), F.desc("n_docs"), F.asc("term")], 1 << 20).withColumnRenamed("rn", "rank"))
    fewest = fewest.withColumn("best", F.min("slips").over(Window.partitionBy("word")))
    close = fewest.where("best < 2 and slips = best")
    far = fewest.where("best = 2")
    far = far.join(_two_typed(far.select("word", "term")), ["word", "term"], "left_semi")
    nearest = first_of_each(close.unionByName(far), ["word"], [F.asc("slips"), F.desc("n_docs"), F.asc("term")], 1)
    nearest = nearest.select("word", F.col("term").alias("read"), F.lit("near").alias("how"))

    taken = joins.select("query_id", F.explode(F.array("place", F.col("place") + 1)).alias("place"))
    single = words.where(~F.col("known")).join(reduce(DataFrame.unionByName, [slip, split, nearest]), "word").join(taken, ["query_id", "place"], "left_anti")
    single = single.select("query_id", "place", F.lit(1).alias("n_words"), F.col("word").alias("typed"), "read", "how")
    return joins.select("query_id", "place", F.lit(2).alias("n_words"), "typed", "read", F.lit("joined").alias("how")).unionByName(single)
