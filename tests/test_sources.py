"""Files, sinks, streams and managers that no query reaches."""

import json

import pytest
from pyspark.sql import functions as F
from tessera.functions import registry as scorers
from tessera.operators.batch import Batch
from tessera.sources import files, registry
from tessera.streaming import streams


def test_parquet_unions(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "a int, b double").write.parquet(f"{tmp_path}/x")
    spark.createDataFrame([(3, float("nan"), "c")], "a int, b double, c string").write.parquet(f"{tmp_path}/y")
    spark.createDataFrame([(5, 6.0)], "a int, b double").write.parquet(f"{tmp_path}/z")
    assert sorted(r.a for r in files.read_parquet_union(spark, [f"{tmp_path}/x", f"{tmp_path}/z"]).collect()) == [1, 5]
    got = {r.a: (r.b, r.c) for r in files.read_parquet_union(spark, [f"{tmp_path}/x", f"{tmp_path}/y"], heterogeneous=True).collect()}
    assert got == {1: (2.0, None), 3: (None, "c")}
    with pytest.raises(Exception):
        files.read_parquet_union(spark, [f"{tmp_path}/x", f"{tmp_path}/y"]).collect()


def test_documents_and_logs(spark, tmp_path):
    for s, t, v in (("s2", "t1", 1), ("s1", "t9", 2), ("s1", "t2", 3)):
        d = tmp_path / "runs" / s / "trajectories" / t
        d.mkdir(parents=True)
        (d / "trajectory.json").write_text(json.dumps({"v": v}))
    glob = f"{tmp_path}/runs/*/trajectories/*/trajectory.json"
    rows = files.read_documents(spark, glob, "v int").collect()
    assert [r.v for r in rows] == [3, 2, 1] and [r.path for r in rows] == sorted(r.path for r in rows)
    assert [r.v for r in files.read_documents(spark, glob, "v int", sample="s2").collect()] == [1]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"current_steps": k, "loss": k / 2}) for k in (1, 10, 9)))
    assert files.last_progress(spark, f"{tmp_path}/log.jsonl").first().loss == 5.0


def test_steps_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "step int, v string")
    files.write_steps(df, f"{tmp_path}/steps")
    files.write_steps(spark.createDataFrame([(2, "c")], "step int, v string"), f"{tmp_path}/steps")
    assert sorted((r.step, r.v) for r in spark.read.json(f"{tmp_path}/steps").collect()) == [(1, "a"), (2, "c")]
    for k in (1, 2):
        files.append_metrics(spark.createDataFrame([(k, "loss", k / 4)], "step int, name string, value double"), f"{tmp_path}/m")
    assert sorted((r.step, r.value) for r in spark.read.parquet(f"{tmp_path}/m").collect()) == [(1, 0.25), (2, 0.5)]


def test_registered_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n')
    (tmp_path / "load.py").write_text("def load(spark):\n    return spark.range(4)\n")
    text = json.dumps({"a": {"file_name": "a.jsonl"}, "s": {"script_url": "load.py"}, "c": {"cloud_file_name": f"file://{tmp_path}/a.jsonl"}, "h": {"hf_hub_url": "x/y"}})
    r = registry.load_registry(text)
    assert registry.read(spark, r["a"], str(tmp_path)).first().k == 1 and registry.read(spark, r["s"], str(tmp_path)).count() == 4 and registry.read(spark, r["c"], "").first().k == 1
    with pytest.raises(NotImplementedError):
        registry.read(spark, r["h"], "")


def test_shuffled_stream(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = []
    streams.start(streams.arriving(spark, f"{tmp_path}/in", "id long"), f"{tmp_path}/cp", streams.shuffled_batches(3, lambda d, e: out.extend(r.id for r in d.collect()), "id")).awaitTermination()
    assert sorted(out) == list(range(50)) and out != sorted(out)


def test_upserted_versions(spark, tmp_path):
    sink = streams.upsert_sink(f"{tmp_path}/t", "k", order=F.col("o"), buckets=8)
    with pytest.raises(FileNotFoundError):
        streams.upserted(spark, f"{tmp_path}/t")
    for e, rows in enumerate(([(1, 1, "a"), (1, 2, "b")], [(2, 1, "c")], [(1, 3, "d"), (2, 0, "e")])):
        sink(spark.createDataFrame(rows, "k int, o int, v string"), e)
    assert sorted((r.k, r.v) for r in streams.upserted(spark, f"{tmp_path}/t").collect()) == [(1, "d"), (2, "e")]
    assert not (tmp_path / "t/manifest/v=0").exists() and (tmp_path / "t/manifest/v=1").exists()


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    """A batch of one key writes one bucket; a batch that is run again gives the same."""
    sink, path = streams.upsert_sink(f"{tmp_path}/t", "k", order=F.col("o"), buckets=16), tmp_path / "t"
    sink(spark.range(300).select(F.col("id").alias("k"), F.lit(0).alias("o")), 0)
    one = spark.createDataFrame([(7, 5)], "k long, o int")
    sink(one, 1)
    assert len(list((path / "data/v=0").glob("bucket=*"))) == 16 and len(list((path / "data/v=1").glob("bucket=*"))) == 1
    for again in (1, 1, 2, 2):
        sink(one if again == 1 else spark.createDataFrame([(7, 4), (9, 9), (1000, 1)], "k long, o int"), again)
    got = {r.k: r.o for r in streams.upserted(spark, str(path)).collect()}
    assert got == {**{k: 0 for k in range(300)}, 7: 4, 9: 9, 1000: 1}
    sink(one.limit(0), 3)
    assert streams.upserted(spark, str(path)).count() == 301


def test_managers(spark):
    df = spark.createDataFrame([("openai/gsm8k", "#### 4", "4", 12), ("openai/gsm8k", "#### 5", "4", 30)], "data_source string, solution string, ground_truth string, length int")
    assert [r.rm_scores for r in scorers.MANAGERS["naive"](df).collect()] == [1.0, 0.0]
    assert [r.rm_scores for r in scorers.MANAGERS["dapo"](df, most=20, buffer=10).collect()] == pytest.approx([0.8, -2.0])
    assert [r.rm_scores for r in scorers.MANAGERS["batch"](df, lambda s, x, g: [len(a) for a in x]).collect()] == [6.0, 6.0]
    assert [r.rm_scores for r in scorers.MANAGERS["uvtr"](df, weight=0.5).collect()] == [1.0, 0.0]
    again = df.withColumn("rm_scores", F.lit(7.0))
    assert {r.rm_scores for r in scorers.MANAGERS["naive"](again).collect()} == {7.0}


def test_batch_columns(spark):
    b = Batch.of(spark.createDataFrame([(k, k * 2, "x") for k in range(5)], "k int, v int, s string"), "k", meta={"a": 1, "b": 2})
    popped, left = b.pop(["v"], ["a"])
    assert popped.columns == ["v"] and popped.meta == {"a": 1} and left.columns == ["k", "s"] and left.meta == {"b": 2}
    assert b.rename(["k"], ["id"]).columns == ["id", "v", "s"]
    with pytest.raises(ValueError):
        b.rename(["k"], ["a", "b"])
    with pytest.raises(KeyError):
        b.pop(["none"])
