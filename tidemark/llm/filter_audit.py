"""Filter interaction audit: five filters over whole texts, every order in which they can be applied, by part of the corpus.

Duplicates are found by partition refinement.  Texts are split by their number of code points, then each class by the hash of
one block of the text after the other; a class of one goes at once, so later blocks are only looked at where copies are still
possible.  Blocks grow by four (1 KB, 4 KB, 16 KB, ...), which bounds the rounds by the logarithm of the longest text.  What survives
is compared as full text with the smallest doc_id of its class, in salted groups (a bitmap of fixed size keeps other texts out of that shuffle), and members that differ from it (hashes that
collide) form a class again; so hashes never decide.  All ids but the smallest of equal texts are marked.

The five marks of a document are one mask.  Documents are counted by part, mask and label, and all orders and steps are read off
those counts, of which there are at most 32 * 4 a part whatever the corpus holds.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, stored, work_dir

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FIRST_BLOCK, GROWTH = 1024, 4
GROUP = 64
PLACES = 1 << 24
ROW = ["doc_id", "mark"]


def failures(data: bytes, points: int) -> int:
    """Bits 0 to 3: which of the filters A to D a text of ``points`` code points fails."""
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    marks = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * points,
        len(data.translate(None, SIGNS)) < len(data),
    )
    return sum(1 << i for i, failed in enumerate(marks) if failed)


def block_hashes(data: bytes) -> list[int]:
    """Signed 64-bit hash of each block."""
    out, at, size = [], 0, FIRST_BLOCK
    while at < len(data):
        h = xxhash.xxh3_64_intdigest(data[at : at + size])
        out.append(h - (1 << 64) if h >> 63 else h)
        at, size = at + size, size * GROWTH
    return out


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, part, mask, points, blocks) of every row; ``mark`` tells apart rows that share a doc_id but not their text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        mask = [failures(d, len(t)) for d, t in zip(data, texts, strict=True)]
        cols = [pa.array(mask, pa.int32()), pa.array([len(t) for t in texts], pa.int64()), pa.array([block_hashes(d) for d in data], pa.list_(pa.int64()))]
        return pa.record_batch([batch["doc_id"], batch["mark"], batch["part"], *cols], [*ROW, "part", "mask", "points", "blocks"])

    return map_batches(docs.select(*ROW, "part", "text"), run, "doc_id long, mark long, part string, mask int, points long, blocks array<long>")


def _shared(rows: DataFrame, path: str) -> DataFrame:
    """The rows whose ``key`` two or more have; both sides of the join are tables, so that a key of many rows can be split."""
    keys = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), f"{path}-keys")
    return stored(rows.join(keys, "key"), f"{path}-rows")


def refined(rows: DataFrame, path: str) -> DataFrame:
    """(key, doc_id, mark) of the ``rows`` (doc_id, mark, points, blocks) that agree with another in length and in all blocks."""
    current = stored(rows.select(F.xxhash64("points").alias("key"), *ROW, "blocks"), f"{path}/length")
    current, k = _shared(current, f"{path}/round0"), 0
    while k < (current.agg(F.max(F.size("blocks"))).first()[0] or 0):
        key = F.when(F.size("blocks") > k, F.xxhash64("key", F.get("blocks", F.lit(k)))).otherwise(F.col("key"))
        current, k = _shared(stored(current.withColumn("key", key), f"{path}/split{k}"), f"{path}/round{k + 1}"), k + 1
    return current.select("key", *ROW)


def _possible(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``mark`` has the place of a member's in a bitmap of ``PLACES`` bits, which is what is broadcast at any size."""
    place = F.pmod("mark", F.lit(PLACES).cast("long"))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    bits = members.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    held = F.expr(f"shiftright(_bits, cast(pmod(mark, {PLACES}L) & 63 as int)) & 1") == 1
    return docs.join(F.broadcast(bits), (word == F.col("_word")) & held, "left_semi")


def later_copies(docs: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, mark) of the rows whose text a smaller doc_id has; ``docs`` (doc_id, mark, text) are the texts of ``rows``."""
    alike = stored(refined(rows, path).distinct(), f"{path}/alike0")
    copies, again = [], 0
    while True:
        classes = alike.groupBy("key").agg(F.min(F.struct(*ROW)).alias("low"), F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
        classes = stored(classes, f"{path}/classes{again}")
        salt = F.pmod(F.xxhash64(*ROW), F.col("salts").cast("long")).cast("int").alias("salt")
        members = stored(alike.join(classes, "key").select("key", *ROW, salt, "low"), f"{path}/members{again}")
        # Texts that cannot be copies stay where they are; the others are dealt out in the same way at every size.
        texts = stored(_possible(docs, members).join(members.hint("merge"), ROW), f"{path}/texts{again}")
        low = texts.where("low.doc_id = doc_id and low.mark = mark").dropDuplicates(["key"]).select("key", F.col("text").alias("first"))
        low = low.join(classes, "key").select("key", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        met = texts.join(stored(low, f"{path}/low{again}"), ["key", "salt"])
        met = stored(met.select("key", *ROW, F.col("low.doc_id").alias("low_id"), (F.col("text") == F.col("first")).alias("same")), f"{path}/met{again}")
        copies.append(met.where("same and doc_id > low_id").select(*ROW))
        rest = met.where("not same").select("key", *ROW)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, copies)
        again += 1
        alike = stored(rest.distinct(), f"{path}/alike{again}")


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs`` (doc_id, source, text); bit i of ``mask``: it fails filter i of A to E.

    A null text counts as empty and a null source as the empty one.  A row without doc_id is no copy and makes none.  Rows of one
    doc_id are no copies of each other.
    """
    path = work_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    rows = stored(profile(docs), f"{path}/profile")
    copies = stored(later_copies(docs.select(*ROW, "text"), rows.where("doc_id is not null").select(*ROW, "points", "blocks"), path).distinct(), f"{path}/copies")
    rows = rows.select(*ROW, "part", "mask").join(copies.withColumn("copy", F.lit(1 << 4)), ROW, "left")
    return rows.select("doc_id", "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"))


def audit(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by part, order and step from ``marked`` (doc_id, part, mask) and ``labels`` (doc_id, quality, toxic).

    A document with several labels is good if one says quality 1 and toxic if one says toxic 1.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    counts = marked.join(said, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    steps = [
        (order, i + 1, sum(1 << FILTERS.index(f) for f in order[:i]), 1 << FILTERS.index(order[i]))
        for order in map("".join, permutations(FILTERS))
        for i in range(len(FILTERS))
    ]
    names = ("filter_order", "step", "before", "own")
    each = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, s, strict=True))) for s in steps))
    rows = counts.select("*", F.inline(each))
    fails, alive = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(F.lit(0)))
    out = rows.groupBy("part", "filter_order", "step", "own").agg(
        total(alive & ~fails).alias("kept"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(alive & fails, "good").alias("good_lost"),
        total(alive & fails, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, source, text): one row per part, order of the five filters and step, zeros included.

    Texts of any length are read whole; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    return audit(masks(docs), labels)
