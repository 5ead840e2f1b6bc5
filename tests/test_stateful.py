"""Streams with state of their own against the same work in one batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.streaming import stateful


def run(query):
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive


@pytest.mark.parametrize("above", [True, False])
def test_runs_stay_open_over_batches(spark, tmp_path, above):
    """Late and repeated rows in six files, runs over several of them, null labels: the stream closes what a batch finds."""
    rng, rows = random.Random(1), []
    for label in ("a", "b", None):
        t = 1_700_000_000
        for _ in range(150):
            t += rng.choice([60, 60, 60, 120, 400])
            rows.append((label, t, float(rng.choice([1, 9, 9, 9]) if above else rng.choice([9, 1, 1, 1]))))
    rows += [(x, 1_700_200_000, 5.0) for x in ("a", "b", None)]  # the watermark passes all runs
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.randrange(0, 900))  # late by 15 minutes at most
    shuffled = [rows[i] for i in order]
    shuffled += rng.sample(shuffled[-60:], 20)
    schema = "s string, at long, v double"
    size = len(shuffled) // 6 + 1
    for k in range(6):
        part = spark.createDataFrame(shuffled[k * size : (k + 1) * size], schema).withColumn("ts", F.timestamp_seconds("at"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        like = spark.read.parquet(str(tmp_path / "in"))
    want = series.breaches(like.dropDuplicates(["s", "at"]), ["s"], "ts", "v", 5.0, 180, 200, above)
    source = stateful.prepared(spark).readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = stateful.open_runs(source, ["s"], "ts", "v", 5.0, 180, 200, "30 minutes", above)
    run(found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")))
    pick = lambda df: sorted(map(repr, df.select("s", "from_time", "to_time", "n_samples", "worst", "seconds").collect()))
    got = pick(spark.read.parquet(str(tmp_path / "out")))
    assert got == pick(want) and len(got) > 30


def test_an_index_takes_changes_only(spark, tmp_path):
    batches = [
        [("p1", 1, "one", None), ("p2", 1, "two", None), ("p3", 1, None, None), ("p1", 1, "one", None)],
        [("p1", 2, "one", None), ("p2", 2, "two!", None), ("p4", 1, "four", None), ("p9", 1, "x", True)],
        [("p2", 1, "late", None), ("p3", 2, None, True), ("p4", 2, "four", None), ("p4", 3, "4", None)],
        [("p3", 3, "again", None), ("p1", 3, "one", None)],
    ]
    like = spark.createDataFrame([], "ref string, version int, text string, gone boolean")
    for k, b in enumerate(batches):
        spark.createDataFrame(b, like.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    index = stateful.PieceIndex(spark, str(tmp_path / "index"), ["text"], "version")
    for k in range(4):  # a file a batch, in order
        index.take(spark.read.parquet(str(tmp_path / f"in/{k}")), k)
    index.take(spark.read.parquet(str(tmp_path / "in/3")), 3)  # a batch that is repeated counts once
    assert sorted(map(tuple, index.current().collect())) == [("p1", 1, "one"), ("p2", 2, "two!"), ("p3", 3, "again"), ("p4", 3, "4")]
    assert sorted(map(tuple, index.written().collect())) == [
        (0, "p1", False), (0, "p2", False), (0, "p3", False), (1, "p2", False), (1, "p4", False), (2, "p3", True), (2, "p4", False), (3, "p3", False),
    ]


def test_an_index_behind_a_stream(spark, tmp_path):
    rows = [(f"p{i % 40}", i, f"text {i % 7 // 3}", None) for i in range(400)]
    df = spark.createDataFrame(rows, "ref string, version int, text string, gone boolean")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    index = stateful.PieceIndex(spark, str(tmp_path / "index"), ["text"], "version")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(stream.writeStream.foreachBatch(index.take).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    newest = {r: (v, t) for r, v, t, _ in rows}
    got = {r.ref: (r.version, r.text) for r in index.current().collect()}
    assert {r: t for r, (_, t) in got.items()} == {r: t for r, (_, t) in newest.items()}
    assert index.written().count() < 200
