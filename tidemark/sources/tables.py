"""Reading and writing tables: families of dated tables, visibility, bounded pages, backups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.scratch import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def family_of(name: str) -> str:
    """The pattern a dated or numbered table name belongs to: ``logs-2026.09.27`` -> ``logs-*``."""
    return re.sub(r"[-_.]?\d{4}[-_.]\d{2}(?:[-_.]\d{2})?$|[-_.]\d+$", "-*", name)


def family_key(name: Column) -> Column:
    """:func:`family_of` of a column of names."""
    return F.regexp_replace(name, r"([-_.]?[0-9]{4}[-_.][0-9]{2}([-_.][0-9]{2})?|[-_.][0-9]+)$", "-*")


def family_members(names: DataFrame, name: str, *sums: str) -> DataFrame:
    """(family, n_members, sums) of tables by ``name``: dated or numbered ones together, one without others of its kind by its own name."""
    per = names.withColumn("family", family_key(F.col(name))).groupBy("family").agg(F.countDistinct(name).alias("n_members"), F.min(name).alias("only"), *(F.sum(c).alias(c) for c in sums))
    return per.select(F.when(F.col("n_members") > 1, F.col("family")).otherwise(F.col("only")).alias("family"), "n_members", *sums)


#: Which of several names of the same tables stands for them.
PREFERRED = ("data_stream", "alias", "pattern", "index")


def one_table_each(containers: DataFrame, known: DataFrame) -> DataFrame:
    """(name, kind, n_members, stands_for, same_as): every container of ``containers`` (name, kind, member) and the one of the same members that is read in its place.

    Of names with equal members one is kept: a name of ``known`` (name) before others, then by PREFERRED, then by name; ``stands_for`` counts the
    names that it replaces, and ``same_as`` is the kept name.  Member sets are compared by their sorted digests, combined before the shuffle.
    """
    sets = containers.select("name", "kind", "member").distinct().groupBy("name", "kind").agg(
        F.count("*").alias("n_members"), F.sum(F.xxhash64("member").cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64(F.lit(7), "member")).alias("_mix"), F.min("member").alias("_low"), F.max("member").alias("_top")
    )
    listed = known.select("name").distinct().withColumn("_known", F.lit(0))
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(PREFERRED)), F.lit(len(PREFERRED)))
    same = ["n_members", "_sum", "_mix", "_low", "_top"]
    ranked = sets.join(listed, "name", "left").withColumn("_rank", F.struct(F.coalesce("_known", F.lit(1)).alias("k"), rank.alias("r"), "name"))
    kept_of = ranked.groupBy(*same).agg(F.min("_rank").alias("_best"), (F.count("*") - 1).alias("others"))
    found = ranked.join(kept_of, same)
    return found.select("name", "kind", "n_members", F.when(F.col("name") == F.col("_best.name"), F.col("others")).otherwise(0).alias("stands_for"), F.col("_best.name").alias("same_as"))


def capped(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` rows in ``order``, each told whether there are more (``truncated``); one job, which reads ``most`` + 1 rows a task."""
    first = df.orderBy(*order).limit(most + 1)
    whole = Window.partitionBy(F.lit(0))  # at most ``most`` + 1 rows
    return first.select("*", F.row_number().over(whole.orderBy(*order)).alias("_rn"), (F.count("*").over(whole) > most).alias("truncated")).where(F.col("_rn") <= most).drop("_rn")


def families(names: list[str]) -> dict[str, list[str]]:
    """Table names by family; a family of one member keeps the member's own name."""
    found: dict[str, list[str]] = {}
    for name in sorted(set(names)):
        found.setdefault(family_of(name), []).append(name)
    return {(k if len(v) > 1 else v[0]): v for k, v in found.items()}


def read_family(frames: list[DataFrame]) -> DataFrame:
    """One table of all members; columns that a member lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def span(df: DataFrame, time: str) -> DataFrame:
    """Rows and time range of a table or family, in one pass."""
    return df.agg(F.count("*").alias("n_rows"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))


def visible(df: DataFrame, sources: list[str] | None = None, scope: str = "scope", user: str | None = None) -> DataFrame:
    """Rows a user may see: of an allowed source, and shared by the team or their own."""
    if sources is not None:
        df = df.where(F.col("source").isin(sources) if sources else F.lit(False))
    if user is not None:
        df = df.where((F.col(scope) == "team") | (F.col("user_id") == user))
    return df


def with_truncation(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` rows and whether there are more."""
    more = df.limit(most + 1).count() > most
    return df.limit(most), more


def page_rows(df: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The first rows in ``order`` whose JSON texts fit ``budget`` bytes, by buckets of order so that no task sorts all rows.

    The running size is exact: totals of earlier ranges are added to the running sum inside each range.
    """
    sized = df.withColumn("row_bytes", F.octet_length(F.to_json(F.struct(*df.columns))))
    ranged = kept(sized.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id()))  # once: another run may cut the ranges elsewhere
    inside = ranged.withColumn("run", F.sum("row_bytes").over(Window.partitionBy("range_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("range_id").agg(F.sum("row_bytes").alias("range_bytes"))
    before = totals.select("range_id", (F.sum("range_bytes").over(Window.orderBy("range_id")) - F.col("range_bytes")).alias("before"))
    return inside.join(before, "range_id").where(F.col("run") + F.col("before") <= budget).select(*df.columns)


def backup(frames: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines under ``path``, and a manifest of their names and columns."""
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(frames.values())).sparkSession
    rows = [(name, df.schema.json()) for name, df in frames.items()]
    spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def restore(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a backup, or those of ``names``, with their columns and types."""
    from pyspark.sql.types import StructType
    import json

    rows = spark.read.schema("name string, schema string").json(f"{path}/manifest").collect()  # one row a table
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).json(f"{path}/{r['name']}") for r in rows if not names or r["name"] in names}


def write_vectors(vectors: DataFrame, key: str, vector: str, path: str) -> None:
    """Vectors as Parquet of single-precision arrays, one row a key; of several vectors of a key the greatest is kept."""
    one = vectors.where(F.col(vector).isNotNull()).groupBy(key).agg(F.max(F.col(vector).cast("array<float>")).alias(vector))
    one.write.mode("overwrite").parquet(path)
