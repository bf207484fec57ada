"""Metrics observed while jobs run, against aggregating the rows on their own."""

from pyspark.sql import functions as F
from tessera.operators import metrics
from tessera.sources.metric_log import MetricLog, reducing
from tessera.streaming import streams

NAMES = ["loss", "reward_max", "length_min"]


def wanted(spark, rows, step):
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in NAMES))).alias("x")).select("x.*")
    return {(step, r["name"], round(r.value, 9)) for r in metrics.reduce_by_name(long).collect()}


def steps(spark, k):
    return spark.range(k * 100, k * 100 + 37).select((F.col("id") * 0.25).alias("loss"), (F.col("id") % 9).alias("reward_max"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("length_min"))


def aggregates():
    return {n: reducing(F.col(n).cast("double"), n) for n in NAMES}


def test_batch_steps_are_observed(spark, tmp_path):
    """One file for several steps; the job that writes the rows is the only one that reads them."""
    path, want = f"{tmp_path}/metrics", set()
    with MetricLog(spark, path, flush_rows=7) as log:
        for k in range(5):
            log.watch(steps(spark, k), k, **aggregates()).write.parquet(f"{tmp_path}/rows/{k}")
            want |= wanted(spark, spark.read.parquet(f"{tmp_path}/rows/{k}"), k)
        log.watch(steps(spark, 9), 9, **aggregates())  # no one reads it
    got = [(r.step, r["name"], round(r.value, 9)) for r in spark.read.parquet(path).collect()]
    assert set(got) == want and len(got) == 15
    assert len(list((tmp_path / "metrics").glob("*.parquet"))) < 5


def test_a_stream_is_observed(spark, tmp_path):
    src, want = f"{tmp_path}/in", set()
    schema = steps(spark, 0).schema
    with MetricLog(spark, f"{tmp_path}/metrics") as log:
        for k in range(3):
            steps(spark, k).coalesce(1).write.mode("append").parquet(src)
            s = log.follow(streams.arriving(spark, src, schema, files_per_trigger=1), "train_metrics", **aggregates())
            streams.start(s, f"{tmp_path}/cp", lambda d, e: d.count()).awaitTermination()
            log.settle("train_metrics", 1)
            log.flush()
            want |= wanted(spark, steps(spark, k), k)
    got = [(r.step, r["name"], round(r.value, 9)) for r in spark.read.parquet(f"{tmp_path}/metrics").collect()]
    assert set(got) == want and len(got) == 9
