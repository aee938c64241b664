"""Structured Streaming over the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, lateness
from ..plans.pipeline import run_pipeline


class HourSink:
    """foreachBatch target that keeps the trees of :mod:`..operators.lateness` between batches, and with them the hours as they stand: late messages correct the
    partials of their hours, hours past the cut-off are closed, and what comes for them is refused. The state has one version a batch under `state`, so that a
    batch that runs again starts from the same trees; versions older than the one before are deleted."""

    def __init__(self, spark: SparkSession, state: str, by: tuple[str, ...] = lateness.KEYS, grace: int = lateness.GRACE_H, cutoff: int = lateness.CUTOFF_H):
        self.spark, self.state, self.by, self.grace, self.cutoff = spark, state, by, grace, cutoff

    def table(self, batch_id: int) -> DataFrame:
        """The hours after a batch."""
        return self.spark.read.parquet(f"{self.state}/v{batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self.table(batch_id - 1) if batch_id else None
        parts = lateness.partials(batch.where("kind = 'status' and event_ts is not null"), self.by)
        lateness.advance(before, parts, self.by, self.grace, self.cutoff).write.mode("overwrite").parquet(f"{self.state}/v{batch_id}")
        _drop(self.spark, f"{self.state}/v{batch_id - 2}")


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hourly_stream(events: DataFrame, sink: HourSink, checkpoint: str):
    """Starts a stream of messages into `sink` until nothing is left."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_landing(spark: SparkSession, root: str, parser_version: int = 1, checkpoint: str | None = None):
    """Ingests what lands in `root`/landing until nothing is left. The stream only says that something came; the manifest decides what is new, changed or known."""

    def batch(_: DataFrame, __: int) -> None:
        run_pipeline(spark, root, parser_version)

    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.{txt,jsonl}").option("recursiveFileLookup", "true").load(f"{root}/landing")
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{root}/state/stream").trigger(availableNow=True).start()


class SequenceSink:
    """foreachBatch target that accepts every message of a producer once: sequence numbers by the ranges seen, all other identifiers and null by exact
    lookup. The ranges lie in `state`, one version a batch, the ids in `state`/ids, what is new in each batch, so that a batch that runs again starts
    from the same state. `rest` identifies a message without a key, by default as in :mod:`..operators.delivery`; where a batch has other columns than
    those, a row without a key is a copy only of a row that equals it in all columns but the key."""

    def __init__(self, spark: SparkSession, state: str, out: str, key: str, producer: str, order: tuple[str, ...], rest: tuple[str, ...] | None = None):
        self.spark, self.state, self.out, self.key, self.producer, self.order, self.rest = spark, state, out, key, producer, order, rest

    def _seen(self, batch_id: int) -> DataFrame:
        schema = delivery.RANGES
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.state}/v{batch_id - 1}")

    def _known(self, batch_id: int) -> DataFrame:
        schema = "_key binary, _nid binary, batch bigint"
        if batch_id == 0:
            return self.spark.createDataFrame([], schema).drop("batch")
        return self.spark.read.schema(schema).parquet(f"{self.state}/ids").where(F.col("batch") < batch_id).drop("batch")

    def _rest(self, batch: DataFrame) -> tuple[str, ...]:
        if self.rest is not None:
            return self.rest
        return delivery.REST if set(delivery.REST) <= set(batch.columns) else tuple(c for c in batch.columns if c not in (self.key, self.producer))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        fresh, ranges, ids = delivery.accept_batch(batch, self._seen(batch_id), self._known(batch_id), self.key, self.producer, self.order, self._rest(batch))
        fresh.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
        ranges.write.mode("overwrite").parquet(f"{self.state}/v{batch_id}")
        ids.write.mode("overwrite").parquet(f"{self.state}/ids/batch={batch_id}")
        _drop(self.spark, f"{self.state}/v{batch_id - 2}")
