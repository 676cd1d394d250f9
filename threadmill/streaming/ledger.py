"""Incremental note collection: deduplicated ingest, progress counts and stale stops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadmill.session import cut


def new_notes(stream: DataFrame, key: str = "note_id", event_time: str | None = None, late: str = "30 days") -> DataFrame:
    """Each key's first arrival. Without ``event_time`` keys are remembered for ever; with it
    state older than ``late`` is dropped and a later repeat counts as new."""
    rows = stream.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key]) if event_time else rows.dropDuplicates([key])


def progress(stream: DataFrame, by: str = "keyword", key: str = "note_id") -> DataFrame:
    """Running number of distinct keys per keyword, for update mode.

    Keys are counted where they came first, so a key met under two keywords counts once.
    """
    return new_notes(stream, key).groupBy(by).agg(F.count("*").alias("n"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet folder, None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


#: Folders a store is divided into by a hash of the key.
BUCKETS = 256


def append_new(target: str, key: str = "note_id", buckets: int = BUCKETS):
    """A foreachBatch sink: appends to a parquet store the keys it doesn't hold yet.

    The store is partitioned by a hash of the key, and a batch reads the keys of the
    partitions it touches only. Null and '' keys are left out, as in new_notes. A batch
    that is replayed after a failure finds its own rows there and adds nothing.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = cut(batch.where(F.col(key).isNotNull() & (F.col(key) != "")).dropDuplicates([key]).withColumn("bucket", bucket))
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        store = _read(spark, target)
        if store is not None:
            fresh = fresh.join(store.where(F.col("bucket").isin(touched)).select(key), key, "left_anti").select(fresh.columns)
        fresh.write.mode("append").partitionBy("bucket").parquet(target)

    return write


def stale_sources(stream: DataFrame, source: str, key: str, limit: int) -> DataFrame:
    """(source, batches, stale, stopped) after every batch: how many batches in a row brought
    a source nothing new, and whether that reached ``limit``.

    The state remembers eight bytes for each key of a source, so it suits sources of some
    millions of keys; beyond that use track_stale, which keeps keys in a store.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blob, batches, stale = state.get if state.exists else (b"", 0, 0)
        known = np.frombuffer(blob, np.uint64)
        arrived = [k for f in frames for k in f[key] if k is not None]
        hashes = np.unique(np.fromiter((xxhash.xxh64_intdigest(str(k)) for k in arrived), np.uint64, len(arrived)))
        fresh = np.setdiff1d(hashes, known, assume_unique=True)
        stale = 0 if len(fresh) else stale + 1
        state.update((np.union1d(known, fresh).tobytes(), batches + 1, stale))
        yield pd.DataFrame({source: [name[0]], "batches": [batches + 1], "stale": [stale], "stopped": [stale >= limit]})

    return stream.groupBy(source).applyInPandasWithState(step, f"{source} string, batches long, stale long, stopped boolean", "seen binary, batches long, stale long", "update", GroupStateTimeout.NoTimeout)


def track_stale(target: str, counters: str, source: str, limit: int, key: str = "note_id"):
    """A foreachBatch sink: append_new, and per batch the counters of stale_sources.

    What is new is decided by the store, one row a source is written to
    ``counters``/batch=N, made from the batch before. A replayed batch, whose rows are in
    the store already, keeps the counters it wrote.
    """
    append = append_new(target, key)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.where(F.col(source).isNotNull()))
        held = _read(spark, target)
        known = rows.select(source, key).where(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
        fresh = known.join(held.select(key), key, "left_anti") if held is not None else known
        now = rows.select(source).distinct().join(fresh.select(source).distinct().withColumn("__new", F.lit(True)), source, "left")
        every = _read(spark, counters)
        if every is None or not every.where(F.col("batch") == batch_id).limit(1).count():
            zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
            before = every.where(F.col("batch") == every.where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]) if every is not None else spark.createDataFrame([], f"{source} string, batches bigint, stale bigint")
            both = now.withColumn("__here", F.lit(True)).join(before.select(source, "batches", "stale"), source, "full")
            here, new = F.coalesce("__here", F.lit(False)), F.coalesce("__new", F.lit(False))
            stale = F.when(~here, zero("stale")).when(new, F.lit(0)).otherwise(zero("stale") + 1)
            cut(both.select(source, (zero("batches") + here.cast("bigint")).alias("batches"), stale.cast("bigint").alias("stale"), (stale >= limit).alias("stopped"))).write.mode("overwrite").parquet(f"{counters}/batch={batch_id}")
        append(rows, batch_id)

    return write
