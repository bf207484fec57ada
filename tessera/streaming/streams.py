"""Structured Streaming over arriving rollout, metric and event files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import seeded


def arriving(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """Files as they arrive; the number per trigger is the back-pressure."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def windowed(events: DataFrame, time: str, key: str, value: str, *, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and key; rows later than ``late`` are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def distinct_keys(events: DataFrame, time: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def hash_validation(rows: DataFrame, share: float, *key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(validation, train) of a stream by a hash of the key: a counter would need state for nothing."""
    h = F.pmod(seeded(seed, *key), F.lit(1_000_000))
    return rows.where(h < int(share * 1_000_000)), rows.where(h >= int(share * 1_000_000))


def check_settings(*, val_size: float = 0, max_samples: int | None = None, num_samples: int | None = None) -> None:
    """A stream has no length: no validation count, no sample numbers."""
    if val_size > 1 or max_samples is not None or num_samples is not None:
        raise ValueError("a stream takes a validation share under 1, and neither max_samples nor num_samples")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _manifest(spark: SparkSession, path: str, epoch: int | None = None) -> tuple[int, dict[int, int]]:
    """(version, bucket -> version that holds it) of the newest whole manifest, or of the newest before ``epoch``."""
    from ..sources.files import exists

    if not exists(spark, f"{path}/manifest"):
        return -1, {}
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    found = [int(f.getPath().getName()[2:]) for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    whole = [v for v in found if (epoch is None or v < epoch) and exists(spark, f"{path}/manifest/v={v}/_SUCCESS")]
    if not whole:
        return -1, {}
    return max(whole), {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest/v={max(whole)}").collect()}


def _buckets(spark: SparkSession, path: str, held: dict[int, int], schema: T.StructType) -> DataFrame:
    places = [f"{path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def upserted(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The table that :func:`upsert_sink` keeps at ``path``, as of its newest whole version."""
    version, held = _manifest(spark, path)
    if version < 0 and schema is None:
        raise FileNotFoundError(f"nothing was upserted into {path} yet")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _buckets(spark, path, held, kind or spark.read.parquet(*(f"{path}/data/v={v}/bucket={b}" for b, v in list(held.items())[:1])).schema)


def upsert_sink(path: str, *keys: str, order: Column, buckets: int = 64, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps one row per key in a table of ``buckets`` hash buckets: of a batch the row of highest
    ``order``, which takes the place of the one from earlier batches.

    A micro-batch rewrites the buckets that its keys touch, as folders of its own version, and then writes a manifest
    (one row a bucket) that names for each bucket the version that holds it: the batch counts from that file on. A
    batch that is run again starts from the manifest before it and writes the same again. Versions that none of the last
    ``keep`` manifests names are deleted. Read the table with :func:`upserted`.
    """
    from ..operators.trajectory import upsert

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _, held = _manifest(spark, path, epoch)
        own = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = [r.b for r in batch.select(own.alias("b")).distinct().collect()]  # at most ``buckets``
            before = _buckets(spark, path, {b: v for b, v in held.items() if b in touched}, batch.schema)
            merged = upsert(before, upsert(batch.limit(0), batch, *keys, order=order), *keys, order=order)
            merged.withColumn("bucket", own).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={epoch}")
        finally:
            batch.unpersist()
        now = {**held, **dict.fromkeys(touched, epoch)}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={epoch}")
        _forget(spark, path, epoch, keep)

    return run


def _forget(spark: SparkSession, path: str, epoch: int, keep: int) -> None:
    """Deletes manifests before the last ``keep``, and bucket folders that only they named."""
    at, named = epoch + 1, set()
    for _ in range(keep):
        at, held = _manifest(spark, path, at)
        named |= set(held.items())
        if at < 0:
            return
    old, held = _manifest(spark, path, at)
    while old >= 0:
        for b, v in held.items():
            if (b, v) not in named:
                _delete(spark, f"{path}/data/v={v}/bucket={b}")
        _delete(spark, f"{path}/manifest/v={old}")
        old, held = _manifest(spark, path, old)


def shuffled_batches(seed: int, sink: Callable[[DataFrame, int], None], *key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that hands each micro-batch on in seeded order (the buffer of a streaming shuffle)."""
    return lambda batch, epoch: sink(batch.orderBy(seeded(seed + epoch, *key)), epoch)


def joined_streams(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, *, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Pairs of two streams with equal keys whose right time lies within ``within`` after the left one; both sides'
    state is bounded by their watermarks."""
    a = left.withWatermark(left_time, late).alias("a")
    b = right.withWatermark(right_time, late).alias("b")
    near = F.expr(f"b.{right_time} >= a.{left_time} AND b.{right_time} <= a.{left_time} + INTERVAL {within}")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)


def micro_batched(rows: DataFrame, size: int, run, schema: str | T.StructType) -> DataFrame:
    """Hands the rows of each task to ``run`` (a function of a pandas frame) in batches of ``size``, the task's last one
    smaller: requests are drained in groups whatever the size of Arrow batches."""
    import pandas as pd

    def drain(it):
        wait: list[pd.DataFrame] = []
        for frame in it:
            wait.append(frame)
            if sum(map(len, wait)) >= size:
                whole = pd.concat(wait, ignore_index=True)
                full = len(whole) // size * size
                for at in range(0, full, size):
                    yield run(whole.iloc[at : at + size].reset_index(drop=True))
                wait = [whole.iloc[full:]] if full < len(whole) else []
        if wait:
            yield run(pd.concat(wait, ignore_index=True))

    return rows.mapInPandas(drain, schema)


def start(rows: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None], mode: str = "append"):
    """Runs a stream into a foreachBatch function until what has arrived is done; the checkpoint holds offsets."""
    return rows.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
