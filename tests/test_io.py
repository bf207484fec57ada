import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.operators.batch import Batch
from tessera.operators.rows import dense_index
from tessera.sources import files, registry
from tessera.streaming import streams

SF = "/root/testdata/sf0.001"


def test_files(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "a.csv").write_text("x,y\n1,p\n")
    (d / "b.csv").write_text("x,y\n2,q\n")
    assert sorted(r.x for r in files.read_files(spark, str(d)).collect()) == [1, 2]
    (d / "c.txt").write_text("z")
    with pytest.raises(ValueError, match="differ"):
        files.read_files(spark, str(d))
    t = pa.table({"k": [1, 2, 3], "v": ["a", None, "c"]})
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), t.schema) as w:
        w.write_table(t)
    assert [tuple(r) for r in files.read_files(spark, str(tmp_path / "t.arrow")).orderBy("k").collect()] == [(1, "a"), (2, None), (3, "c")]
    (tmp_path / "r").mkdir()
    for n in (10, 9):
        (tmp_path / f"r/{n}.jsonl").write_text(json.dumps({"input": "i", "output": f"secret{n}", "score": n, "request_id": "a-b"}) + "\n")
    rows = files.read_rollouts(spark, f"{tmp_path}/r", mask="secret").orderBy("step").collect()
    assert [(r.step, r.idx, r.output) for r in rows] == [(9, 0, "*9"), (10, 0, "*10")]
    assert files.by_request(files.read_rollouts(spark, f"{tmp_path}/r"), "ab").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "bad")], "k int, v string, error string")
    assert files.write_with_errors(df, f"{tmp_path}/g", f"{tmp_path}/b") == {"rows": 2, "written": 1, "errors": 1}
    assert spark.read.json(f"{tmp_path}/b").first().k == 2
    files.write_checked(df, f"{tmp_path}/ok", f"{tmp_path}/no", small=F.col("k") < 2)
    assert spark.read.json(f"{tmp_path}/no").first().broken == ["small"]
    b = Batch.of(df, "k", meta={"m": [1]})
    files.save_batch(b, f"{tmp_path}/batch")
    again = files.load_batch(spark, f"{tmp_path}/batch")
    assert again.meta == {"m": [1]} and len(again) == 2
    calls = []
    for _ in range(2):
        assert files.cached(spark, f"{tmp_path}/cache", lambda: calls.append(1) or df).count() == 2
    assert calls == [1]


def test_registry():
    text = json.dumps({"a": {"file_name": "a.json", "hf_hub_url": "x/y"}, "b": {"file_name": "b.json", "formatting": "sharegpt", "ranking": True, "size": 5, "tags": {"user_tag": "user"}}})
    r = registry.load_registry(text)
    assert r["a"].kind == "hf_hub_url" and r["b"].kind == "file_name" and r["b"].num_samples == 5
    assert registry.tag_map(r["b"])["user"] == "user" and registry.tag_map(r["b"])["gpt"] == "assistant"
    with pytest.raises(KeyError):
        registry.load_registry(text, ["zzz"])
    with pytest.raises(ValueError):
        registry.check_stage(r["b"], "sft")


def test_dense_index(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.hash("id"), F.lit(50)))
    for per in (10_000, 90):
        got = [r.id for r in dense_index(df, "x", "id", rows_per_bucket=per).orderBy("row").collect()]
        assert got == [r.id for r in df.orderBy("x", "id").collect()]


def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    s = streams.arriving(spark, f"{tmp_path}/in", e.schema, files_per_trigger=1)
    seen = []
    q = streams.start(streams.windowed(s, "ts", "event_type", "value", late="400 days"), f"{tmp_path}/cp", lambda b, k: seen.append(b.count()), mode="update")
    q.awaitTermination()
    assert len(seen) >= 3
    q = streams.start(s.select("event_id", "user_id", "value"), f"{tmp_path}/cp2", streams.upsert_sink(f"{tmp_path}/t", "user_id", order=F.col("event_id")))
    q.awaitTermination()
    assert streams.upserted(spark, f"{tmp_path}/t").count() == e.select("user_id").distinct().count()
    val, train = streams.hash_validation(e, 0.2, "event_id")
    assert val.count() + train.count() == e.count() and 0.1 < val.count() / e.count() < 0.3
    with pytest.raises(ValueError):
        streams.check_settings(val_size=100)
