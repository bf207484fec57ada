"""A streaming shuffle and groups that complete, over several micro-batches and restarts."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tessera.operators import advantages
from tessera.streaming import stateful, streams

SF = "/root/testdata/sf0.001"


def arrive(spark, path, rows, schema, n=0):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drained(df, checkpoint, mode="append"):
    """Rows by micro-batch."""
    out = {}

    def keep(batch, epoch):
        out[epoch] = batch.collect()

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_shuffle_buffer(spark, tmp_path):
    """Three arrivals and an end: every row leaves once and not before it arrives, what stays is bounded, and a second
    run over the same arrivals leaves the same rows in the same batches."""
    schema = "id long, name string, v array<int>, last boolean"
    runs = []
    for run in range(2):
        src, left, waiting = f"{tmp_path}/in{run}", [], set()
        runs.append([])
        for k in range(4):
            rows = [(k * 100 + i, f"n{i}", [i, k], False) for i in range(100)] if k < 3 else [(-1, None, None, True)]
            arrive(spark, src, rows, schema)
            waiting |= {r[0] for r in rows if not r[3]}
            s = stateful.shuffle_buffer(streams.arriving(spark, src, schema), 40, "id", seed=5, buffers=4, end=F.col("last"))
            batches = drained(s, f"{tmp_path}/cp{run}")
            out = [r for e in sorted(batches) for r in batches[e]]
            assert {r.id for r in out} <= waiting and len({r.id for r in out}) == len(out)
            waiting -= {r.id for r in out}
            assert len(waiting) <= 40 and (k < 3 or not waiting)
            assert all(r.name == f"n{r.id % 100}" and r.v == [r.id % 100, r.id // 100] for r in out)
            runs[-1].append(sorted(r.id for r in out))
            left += [r.id for r in out]
        assert sorted(left) == list(range(300)) and left != sorted(left)
        assert any(x // 100 < k for k, part in enumerate(runs[-1]) for x in part)  # rows of an earlier batch leave later
    assert runs[0] == runs[1]


@pytest.mark.parametrize("by_std", [True, False])
def test_streamed_advantages_are_the_batch_ones(spark, tmp_path, by_std):
    """``events`` cut into files: a user's events leave when the last one arrives."""
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "value")
    sized = e.join(e.groupBy("user_id").agg(F.count("*").alias("expected")), "user_id")
    sized.withColumn("f", F.pmod(F.xxhash64("event_id"), F.lit(3))).repartition(3, "f").drop("f").write.parquet(f"{tmp_path}/in")
    s = streams.arriving(spark, f"{tmp_path}/in", sized.schema, files_per_trigger=1)
    batches = drained(stateful.completed_groups(s, "user_id", "event_id", "value", "expected", by_std=by_std), f"{tmp_path}/cp")
    assert len(batches) >= 3
    got = {r.event_id: r.advantage for b in batches.values() for r in b}
    want = {r.event_id: r.advantage for r in advantages.grpo(e, "user_id", "value", by_std).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    assert all(r.complete and r.late == 0 for b in batches.values() for r in b)


def test_late_and_null_responses(spark, tmp_path):
    schema, src = "uid string, id long, score double, n int", f"{tmp_path}/in"
    arrive(spark, src, [("a", 1, 1.0, 2), ("b", 1, 5.0, 3), ("solo", 1, 4.0, 1)], schema)
    df = stateful.completed_groups(streams.arriving(spark, src, schema), "uid", "id", "score", "n")
    first = [r for b in drained(df, f"{tmp_path}/cp").values() for r in b]
    assert [(r.uid, r.complete, round(r.advantage, 3)) for r in first] == [("solo", True, 4.0)]
    arrive(spark, src, [("a", 2, 3.0, 2), ("a", 3, 9.0, 2), ("b", 2, None, 3), ("b", 3, 7.0, 3)], schema)
    df = stateful.completed_groups(streams.arriving(spark, src, schema), "uid", "id", "score", "n")
    second = sorted((r for b in drained(df, f"{tmp_path}/cp").values() for r in b), key=lambda r: (r.uid, r.id))
    assert Counter(r.uid for r in second) == {"a": 3, "b": 3} and second[4].advantage is None and second[3].advantage < 0 < second[5].advantage
    arrive(spark, src, [("a", 4, 1.0, 2), ("a", 5, 2.0, 2)], schema)
    df = stateful.completed_groups(streams.arriving(spark, src, schema), "uid", "id", "score", "n")
    third = sorted((r for b in drained(df, f"{tmp_path}/cp").values() for r in b), key=lambda r: r.id)
    assert [(r.id, r.advantage, r.complete, r.late) for r in third] == [(4, None, False, 1), (5, None, False, 2)]


def test_moments_merge():
    x, y = [1.0, 4.0, 4.5], [2.0, -3.0]
    m = lambda v: (len(v), sum(v) / len(v), sum((a - sum(v) / len(v)) ** 2 for a in v))
    assert stateful.merged_moments(m(x), m(y)) == pytest.approx(m(x + y)) and stateful.merged_moments((0, 0.0, 0.0), m(x)) == m(x)
