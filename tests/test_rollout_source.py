"""Rollout steps: round trip, order, pruned files, broken lines, failures that leave nothing, and arriving steps."""

import json
import time

import pytest
from pyspark.sql import functions as F
from tessera.sources.rollouts import RolloutReader, RolloutSource, steps


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    spark.dataSource.register(RolloutSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rollouts(spark, n, first=0):
    return spark.range(n).select((F.col("id") % 12 + first).alias("step"), F.concat(F.lit("in ü"), "id").alias("input"), F.lit("o\nut").alias("output"), F.when(F.col("id") % 2 == 0, F.lit("g")).alias("gts"), (F.col("id") / 4).alias("score"))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = rollouts(spark, 200)
    rows.repartition(5).write.format("rollouts").mode("append").option("path", path).save()
    back = spark.read.format("rollouts").option("path", f"file://{path}").load()
    names = ["step", "input", "output", "gts", "score"]
    assert sorted(map(tuple, back.select(*names).collect()), key=str) == sorted(map(tuple, rows.select(*names).collect()), key=str)
    assert steps(path) == list(range(12)) and back.rdd.getNumPartitions() == 12
    assert [r.step for r in back.select("step").collect()] == sorted(r.step for r in rows.collect())  # in the order of numbers
    assert sorted((r.step, r.idx) for r in back.collect()) == sorted((s, k) for s in range(12) for k in range(17 if s < 8 else 16))
    manifest = json.loads((tmp_path / "r/_manifest.json").read_text())
    assert sum(s["rows"] for s in manifest["steps"].values()) == 200 and not (tmp_path / "r/_jobs").exists() or not list((tmp_path / "r/_jobs").iterdir())
    # appending replaces steps that it writes and keeps the others
    rollouts(spark, 3, 11).write.format("rollouts").mode("append").option("path", path).save()
    assert {r.step: r["count"] for r in spark.read.format("rollouts").option("path", path).load().groupBy("step").count().collect()} == {**{s: 17 if s < 8 else 16 for s in range(11)}, 11: 1, 12: 1, 13: 1}
    rollouts(spark, 1, 5).write.format("rollouts").mode("overwrite").option("path", path).save()
    assert steps(path) == [5]


def test_a_filter_opens_only_its_files(spark, tmp_path):
    path = str(tmp_path / "r")
    rollouts(spark, 60).write.format("rollouts").mode("append").option("path", path).save()
    reader = RolloutReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    rest = list(reader.pushFilters([GreaterThanOrEqual(("step",), 3), LessThan(("step",), 9), In(("step",), (2, 4, 8, 11)), EqualTo(("score",), 1.0)]))
    assert [p.step for p in reader.partitions()] == [4, 8] and len(rest) == 1
    for name in [p.name for p in (tmp_path / "r").iterdir() if p.name.endswith(".jsonl") and not p.name.startswith("7.")]:
        (tmp_path / "r" / name).write_text("{not json\n")
    got = spark.read.format("rollouts").option("path", path).option("mode", "strict").load().where("step = 7 AND score >= 0")
    assert got.count() == 5
    with pytest.raises(Exception, match="line 1"):
        spark.read.format("rollouts").option("path", path).option("mode", "strict").load().where("step = 6").collect()
    assert [r.broken for r in spark.read.format("rollouts").option("path", path).load().where("step = 6").collect()] == ["{not json"]


def test_plain_files_and_odd_lines(spark, tmp_path):
    """Files without a manifest, in order of their numbers; other files, blank and broken lines."""
    (tmp_path / "10.jsonl").write_text('{"input": "a", "score": 1}\n\n[1]\n{"input": {"x": [1]}, "score": "nan?"}\n')
    (tmp_path / "9.jsonl").write_text('{"input": {"x": [1]}, "gts": 4, "score": null, "more": 1}\r\n')
    (tmp_path / "x1.jsonl").write_text("no")
    got = [tuple(r) for r in spark.read.format("rollouts").option("path", str(tmp_path)).load().collect()]
    assert got == [(9, 0, '{"x": [1]}', None, "4", None, None), (10, 0, "a", None, None, 1.0, None), (10, 2, None, None, None, None, "[1]"), (10, 3, None, None, None, None, '{"input": {"x": [1]}, "score": "nan?"}')]
    (tmp_path / "none").mkdir()
    assert spark.read.format("rollouts").option("path", str(tmp_path / "none")).load().count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    rollouts(spark, 24).write.format("rollouts").mode("append").option("path", path).save()
    before = sorted(p.name for p in (tmp_path / "r").iterdir() if p.name != "_jobs")
    bad = rollouts(spark, 400).repartition(4).withColumn("step", F.when(F.col("score") == 99.0, F.lit(None)).otherwise(F.col("step")))
    with pytest.raises(Exception, match="needs a step"):
        bad.write.format("rollouts").mode("append").option("path", path).save()
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.name != "_jobs") == before and spark.read.format("rollouts").option("path", path).load().count() == 24
    end = time.time() + 20  # tasks that run on when their job fails
    while time.time() < end and [p for p in (tmp_path / "r/_jobs").rglob("*.jsonl")]:
        time.sleep(0.2)
    assert not [p for p in (tmp_path / "r/_jobs").rglob("*.jsonl")]


def test_dead_letters(spark, tmp_path):
    rows = rollouts(spark, 30).withColumn("error", F.when(F.col("score") < 1, F.lit("too low")))
    rows.write.format("rollouts").mode("append").option("path", str(tmp_path / "r")).save()
    manifest = json.loads((tmp_path / "r/_manifest.json").read_text())
    assert [e["rows"] for e in manifest["errors"]] == [4] and sum(s["rows"] for s in manifest["steps"].values()) == 26
    dead = [json.loads(x) for x in (tmp_path / "r" / manifest["errors"][0]["file"]).read_text().splitlines()]
    assert sorted(d["step"] for d in dead) == [0, 1, 2, 3] and {d["error"] for d in dead} == {"too low"}
    assert spark.read.format("rollouts").option("path", str(tmp_path / "r")).load().count() == 26


def test_arriving_steps(spark, tmp_path):
    """Each step once, over restarts."""
    path, seen = str(tmp_path / "r"), []

    def drain():
        s = spark.readStream.format("rollouts").option("path", path).load()
        s.writeStream.foreachBatch(lambda d, e: seen.append(sorted(r.step for r in d.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    rollouts(spark, 6).write.format("rollouts").mode("append").option("path", path).save()
    drain()
    rollouts(spark, 4, 6).write.format("rollouts").mode("append").option("path", path).save()
    drain()
    drain()
    assert [x for b in seen for x in b] == list(range(10))
