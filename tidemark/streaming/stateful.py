"""State that outlives a micro-batch: runs beyond a threshold that stay open, and an index of pieces that takes changes only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that arbitrary state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that :func:`open_runs` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Runs(StatefulProcessor):
    """The open run of one series, and its samples that the watermark has not passed.

    Samples wait until the watermark passes them, so late ones take their place in time, and a time counts once.  A run closes with a sample
    inside the threshold, or by a timer when the watermark is a step past its last sample.

    All of a series' state is one value, read and written once a call, and one timer, for what is due next: calls to the state store go by
    series and micro-batches, not by samples.
    """

    #: Before the first sample: begin, last, n, worst, seen, and times and values that wait.
    NEW = (0, 0, 0, 0.0, -(1 << 62), [], [])

    def __init__(self, labels: list[str], time: str, value: str, threshold: float, step: int, least: int, above: bool):
        self.labels, self.time, self.value = labels, time, value
        self.threshold, self.step, self.least, self.above = threshold, step * 1_000_000, least, above

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", "begin long, last long, n long, worst double, seen long, at array<long>, v array<double>")

    def _worse(self, a: float, b: float) -> float:
        return max(a, b) if self.above else min(a, b)

    def _told(self, key: tuple, run: list) -> list[tuple]:
        seconds = (run[1] - run[0]) // 1_000_000 + self.step // 1_000_000
        return [(*key, pd.Timestamp(run[0], unit="us"), pd.Timestamp(run[1], unit="us"), run[2], run[3], seconds)] if run[2] and seconds >= self.least else []

    def _upto(self, key: tuple, mark: int, run: list, waiting: dict[int, float]) -> list[tuple]:
        """Takes the ``waiting`` samples up to ``mark`` in order, keeps the rest; the runs that they close."""
        out, rest = [], {}
        for at, v in sorted(waiting.items()):
            if at > mark:
                rest[at] = v
                continue
            bad = v > self.threshold if self.above else v < self.threshold
            if run[2] and (not bad or at - run[1] > self.step):
                out += self._told(key, run)
                run[2] = 0
            if bad:
                run[:4] = [run[0], at, run[2] + 1, self._worse(run[3], v)] if run[2] else [at, at, 1, v]
            run[4] = at
        if run[2] and mark > run[1] + self.step:
            out += self._told(key, run)
            run[2] = 0
        self.state.update((*run, list(rest), list(rest.values())))
        due = [*([next(iter(rest))] if rest else []), *([run[1] + self.step] if run[2] else [])]
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        return out

    def _known(self) -> tuple[list, dict[int, float]]:
        """The open run and the samples that wait."""
        *run, ats, values = self.state.get() or self.NEW
        return run, dict(zip(ats, values, strict=True))

    def _frames(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[*self.labels, "from_time", "to_time", "n_samples", "worst", "seconds"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        run, waiting = self._known()
        for frame in rows:
            times = frame[self.time].astype("datetime64[us]").astype("int64")
            for at, v in zip(times.tolist(), frame[self.value].tolist(), strict=True):
                if v == v and at > run[4]:
                    waiting.setdefault(at, v)
        yield from self._frames(self._upto(key, mark, run, waiting))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frames(self._upto(key, max(timerValues.getCurrentWatermarkInMs(), 0) * 1000, *self._known()))

    def close(self) -> None:
        pass


def open_runs(df: DataFrame, labels: list[str], time: str, value: str, threshold: float, step: int, least: int, late: str, above: bool = True) -> DataFrame:
    """The runs of :func:`tidemark.operators.series.breaches` as they close, for a stream: a run may stay open over any number of micro-batches.

    Rows later than ``late`` behind the newest are dropped; a time of a series counts once, with the value that came first.  Null and
    non-number values are not samples.
    """
    kept = df.select(*labels, time, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()).withWatermark(time, late)
    schema = StructType([kept.schema[c] for c in labels]).add("from_time", "timestamp").add("to_time", "timestamp").add("n_samples", "long").add("worst", "double").add("seconds", "long")
    processor = Runs(labels, time, value, threshold, step, least, above)
    return kept.groupBy(*labels).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


class PieceIndex:
    """A stored index of pieces by ``ref`` that micro-batches upsert: what did not change is not written again.

    A batch's changes are files of their own under ``batch=<id>``, written over when a batch is repeated after a failure, so that each
    counts once.  A piece that comes again as it is leaves its new version only, without its columns, so that what is late is known
    to be late.  The index is the newest changed row of each ref; :meth:`compacted` writes it anew.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], version: str):
        self.spark, self.path, self.columns, self.version = spark, path, columns, version
        self.schema: StructType | None = None

    def _stored(self) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        reader = self.spark.read if self.schema is None else self.spark.read.schema(StructType([*self.schema.fields]).add("batch", "long"))
        return reader.parquet(self.path)

    def _newest(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy("ref").agg(F.max_by(F.struct(*rows.columns), F.struct(*by)).alias("x")).select("x.*")

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Writes what ``batch`` (ref, version, columns, gone) changes; for ``foreachBatch``."""
        digest = F.sha2(F.to_json(F.struct(*self.columns), {"ignoreNullFields": "false"}), 256)
        rows = batch.select("ref", self.version, *self.columns, F.coalesce("gone", F.lit(False)).alias("gone")).withColumn("digest", digest)
        rows = self._newest(rows, [self.version, "digest"]).withColumn("same", F.lit(False))
        self.schema, known = rows.schema, self._stored()
        if known is None:
            rows = rows.where("not gone")
        else:
            before = self._newest(known.where(F.col("batch") < batch_id), [self.version, "batch"])
            before = before.select("ref", F.col("digest").alias("had"), F.col("gone").alias("was"), F.col(self.version).alias("since"))
            both = rows.join(before, "ref", "left")
            same = (F.col("gone") == F.col("was")) & (F.col("gone") | (F.col("digest") == F.col("had")))
            both = both.withColumn("same", F.coalesce(same, F.lit(False)))
            late = F.col(self.version) < F.col("since")
            idle = (F.col("same") & (F.col(self.version) == F.col("since"))) | (F.col("gone") & F.col("had").isNull())
            both = both.where(~F.coalesce(late, F.lit(False)) & ~F.coalesce(idle, F.lit(False)))
            rows = both.select("ref", self.version, *(F.when(~F.col("same"), F.col(c)).alias(c) for c in self.columns), "gone", "digest", "same")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def current(self) -> DataFrame:
        """(ref, version, columns) of the pieces there are now, with the version that they have had since."""
        return self._newest(self._stored().where("not same"), [self.version, "batch"]).where("not gone").select("ref", self.version, *self.columns)

    def written(self) -> DataFrame:
        """(batch, ref, gone): every change that was written."""
        return self._stored().where("not same").select("batch", "ref", "gone")

    def compacted(self, path: str) -> None:
        self.current().write.mode("overwrite").parquet(path)
