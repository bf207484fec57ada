"""Draws, splits, growing sets and sequence recursions against plain restatements."""

import json
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessera.operators import advantages, convert, encode, packing, sampling
from tessera.operators.batch import Batch
from tessera.sources import files
from tessera.streaming import streams


def test_few_shot_draws(spark):
    pool = spark.createDataFrame([(f"s{k % 3}", k) for k in range(300)] + [("rare", 1000), ("rare", 1001)], "subject string, id long")
    tests = spark.createDataFrame([(f"s{k % 3}", 5000 + k) for k in range(60)] + [("rare", 6000), ("none", 6001)], "subject string, id long")
    rows = sampling.few_shot(tests, pool, "subject", "id", 4, 7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sampling.few_shot(tests.repartition(5), pool.repartition(3), "subject", "id", 4, 7).collect()))
    per = {}
    for r in rows:
        per.setdefault((r.subject, r.id), []).append(r.shot_id)
        assert (r.subject == "rare") == (r.shot_id >= 1000) and (r.subject == "rare" or r.shot_id % 3 == int(r.subject[1]))
    assert len(per) == 61 and all(len(set(v)) == len(v) == (2 if k[0] == "rare" else 4) for k, v in per.items())
    assert len(Counter(s for v in per.values() for s in v)) > 100


def test_group_index(spark):
    df = spark.createDataFrame([("hot", k) for k in range(500)] + [("b", 1), (None, 2), (None, 3)], "g string, k long")
    got = {}
    for r in sampling.group_index(df, ["g"], ["k"], "at", parts=16).collect():
        got.setdefault(r.g, []).append(r["at"])
    assert {g: sorted(v) for g, v in got.items()} == {"hot": list(range(500)), "b": [0], None: [0, 1]}


def test_weighted_resample(spark):
    df = spark.createDataFrame([(k, float(k % 4)) for k in range(40)], "k long, w double")
    rows = sampling.weighted_resample(df, "w", 20_000, 3, "k", rows_per_part=7).collect()
    assert sorted(r.draw for r in rows) == list(range(20_000))
    seen = Counter(r.k % 4 for r in rows)
    assert seen[0] == 0 and all(abs(seen[c] / 20_000 - c / 6) < 0.02 for c in (1, 2, 3))


def test_mini_batches(spark):
    b = Batch.of(spark.range(120).withColumnRenamed("id", "k"), "k")
    rows = b.mini_batches(24, epochs=2, seed=5).collect()
    sizes = Counter((r.epoch, r.batch) for r in rows)
    assert sizes == {(e, k): 24 for e in range(2) for k in range(5)}
    order = [[r.k for r in rows if (r.epoch, r.batch) == (e, 0)] for e in range(2)]
    assert sorted(order[0]) != sorted(order[1]) and sorted(order[0]) != list(range(24))


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, t string"), spark.createDataFrame([(2,)], "k int")
    assert sorted(map(tuple, sampling.eval_sets({"math": a, "code": b}).select("k", "t", "split").collect())) == [(1, "x", "validation_math"), (2, None, "validation_code")]
    new = spark.createDataFrame([(1, "old key"), (3, "b"), (3, "a"), (4, "")], "k int, t string")
    assert sorted(map(tuple, sampling.appended(a, new, F.length("t") > 0, "k").collect())) == [(1, "x"), (3, "a")]
    n = spark.range(8).withColumnRenamed("id", "row")
    assert sampling.first_rows(n, "row", 3).count() == 3 and sampling.first_rows(n, "row", None).count() == 8
    assert Counter(r.part for r in convert.head_and_tail(n, "row").collect()) == {"head": 6, "tail": 2}
    images = spark.createDataFrame([([("a.png",)],), ([],)], "i array<struct<path:string>>").select(convert.pixel_bounds(F.col("i"), 900, 4).alias("x")).collect()
    assert images[0].x[0].asDict() == {"path": "a.png", "max_pixels": 900, "min_pixels": 4} and images[1].x is None


def test_recursions(spark):
    rows = [([0.1, 0.2, 0.3, 1.0], [0.5, 0.4, 0.3, 0.2], [1, 1, 0, 1]), ([1.0], [0.0], [1]), ([], [], []), ([0.0] * 3000 + [1.0], [0.1] * 3001, [1] * 3001)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, r array<double>, v array<double>, m array<int>")
    got = {x.k: x for x in df.select("k", advantages.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("g"), advantages.discounted_returns(F.col("r"), F.col("m"), 0.9).alias("d")).collect()}
    for k, (r, v, m) in enumerate(rows):
        following = last = carry = 0.0
        g, d = [], []
        for x, y, z in zip(reversed(r), reversed(v), reversed(m), strict=True):
            d.insert(0, x + 0.9 * carry)
            carry = d[0] * z
            if z:
                last, following = x + 0.9 * following - y + 0.72 * last, y
            g.insert(0, last)
        assert list(got[k].g) == pytest.approx(g) and list(got[k].d) == pytest.approx(d)


def test_pretrain_blocks(spark):
    rows = [(k, list(range(10 * k, 10 * k + k % 23))) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, ids array<long>")
    got = {(r.batch_no, r.block_no): list(r.ids) for r in packing.pretrain_blocks(df, "k", "ids", 8, batch=15).collect()}
    want = {}
    for b in range(3):
        flat = [x for k, ids in rows if k // 15 == b for x in ids]
        want |= {(b, i): flat[8 * i : 8 * i + 8] for i in range(len(flat) // 8)}
    assert got == want


def test_packed_examples(spark):
    rows = [(k, list(range(100 * k, 100 * k + 1 + k * 7 % 19)), [k] * (1 + k * 7 % 19)) for k in range(60)] + [(60, [1] * 40, [1] * 40)]
    df = spark.createDataFrame(rows, "k long, ids array<int>, labels array<int>")
    by = {k: (i, lab) for k, i, lab in rows}
    seen = Counter()
    for neat in (True, False):
        for r in encode.packed_examples(df, "k", "ids", "labels", 20, 0, batch=25, neat=neat).collect():
            sacks = packing.greedy_knapsack([len(by[k][0]) for k in range(25 * r.batch_no, min(25 * r.batch_no + 25, 61))], 20)
            members = [25 * r.batch_no + i for i in sacks[r.knapsack]]
            seen.update(members)
            flat = [x for k in members for x in by[k][0]]
            pad = 21 - len(flat)
            assert list(r.input_ids) == flat + [0] * pad and list(r.labels) == [x for k in members for x in by[k][1]] + [-100] * pad
            assert list(r.position_ids) == [p for k in members for p in range(len(by[k][0]))] + [0] * pad
            assert list(r.attention_mask) == ([s + 1 for s, k in enumerate(members) for _ in by[k][0]] + [0] * pad if neat else [1] * 21)
    assert seen == {k: 2 for k in range(60)}


def test_feedback_collation(spark):
    df = spark.createDataFrame([(0, [1], [1], [1, 2, 3], [-100, 2, 3]), (0, [1, 2], [-100, 2], [4], [4])], "b int, input_ids array<int>, labels array<int>, kl_input_ids array<int>, kl_labels array<int>")
    got = {tuple(r.input_ids): r for r in encode.collate_feedback(df, "b", 9).collect()}
    assert list(got[1, 9].labels) == [1, -100] and list(got[1, 9].attention_mask) == [1, 0] and list(got[1, 2].kl_input_ids) == [4, 9, 9] and list(got[1, 2].kl_attention_mask) == [1, 0, 0] and list(got[1, 9].kl_labels) == [-100, 2, 3]


def test_micro_batches(spark):
    sizes = streams.micro_batched(spark.range(0, 50, 1, 2), 8, lambda p: pd.DataFrame({"n": [len(p)]}), "n int")
    assert Counter(r.n for r in sizes.collect()) == {8: 6, 1: 2}


def test_staging_and_tools(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("one")
    at = files.staged(spark, f"file://{tmp_path}/src", f"file://{tmp_path}/cache")
    (first,) = (tmp_path / "cache").glob("*/src/a.txt")
    assert first.read_text() == "one" and at.endswith("/src")
    (tmp_path / "src" / "a.txt").write_text("another")
    files.staged(spark, f"file://{tmp_path}/src", f"file://{tmp_path}/cache")
    assert first.read_text() == "another"
    (tmp_path / "tools.json").write_text(json.dumps([{"name": "crop", "description": "cuts"}, {"name": "zoom", "description": "grows", "usage_notes": "n"}]))
    assert sorted(r.name for r in files.tool_capabilities(spark, f"{tmp_path}/tools.json").collect()) == ["crop", "zoom"]
    (tmp_path / "bad.json").write_text(json.dumps([{"name": "crop"}]))
    with pytest.raises(Exception, match="a name and a description"):
        files.tool_capabilities(spark, f"{tmp_path}/bad.json").collect()
    row = spark.createDataFrame([("q", "a", None)], "p string, x string, y string")
    assert json.loads(files.predictions(row, "p", "x", "y").first().value) == {"prompt": "q", "predict": "a"}


def test_a_broken_cache_is_rebuilt_and_others_are_not(spark, tmp_path):
    (tmp_path / "c").mkdir()
    build = lambda: spark.range(3)
    assert files.cached(spark, f"{tmp_path}/c", build).count() == 3
    assert files.cached(spark, f"{tmp_path}/c", lambda: spark.range(9)).count() == 3


def test_prepared_rows(spark):
    df = spark.createDataFrame([(1, "What is 1/2 + 0?", "so \\boxed{\\frac{1}{2}}", "a", ["i.png"], ["X", "Y"])], "i int, p string, s string, a string, im array<string>, g array<string>")
    r = convert.math_rows(df, "p", "s", "i").first()
    assert r.reward_model.ground_truth == "\\frac{1}{2}" and r.prompt[0].content.startswith("What is 1/2 + 0?") and r.prompt[0].content.endswith("\\boxed{}.") and r.extra_info["index"] == 1
    r = convert.geo3k_rows(df, "p", "a", "im", "i").first()
    assert r.images == ["i.png"] and r.reward_model.ground_truth == "a" and r.data_source == "hiyouga/geometry3k"
    r = convert.search_rows(df.withColumn("p", F.lit("who is it ")).withColumn("src", F.lit("nq")), "p", "g", "src", "i").first()
    assert r.data_source == "searchR1_nq" and r.prompt[0].content == "who is it?" and r.reward_model.ground_truth.target == ["X", "Y"]
    one = convert.choice_prompt(F.lit("Q"), [F.lit("a"), F.lit("b")], F.lit("B"))
    p = df.select(convert.few_shot_prompt(F.lit("high_school"), F.array(one), convert.choice_prompt(F.lit("R"), [F.lit("c"), F.lit("d")])).alias("p"), convert.limited_images(F.array(F.lit(1), F.lit(2)), 1).alias("i")).first()
    assert p.p == "The following are multiple choice questions (with answers) about high school.\n\nQ\nA. a\nB. b\nAnswer: B\n\nR\nA. c\nB. d\nAnswer:" and p.i == [1]


def test_small_statistics(spark):
    from tessera.functions import geometry
    from tessera.operators import metrics

    t = spark.createDataFrame([("gen", 0, 1.0), ("gen", 0, 2.0), ("gen", 1, 5.0)], "name string, rank int, seconds double")
    assert tuple(metrics.cross_rank_timing(t).first()) == ("gen", 4.0, 3.0, 5.0)
    a, b = spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "name string, values array<double>"), spark.createDataFrame([("x", [3.0]), ("z", [4.0])], "name string, values array<double>")
    assert sorted((r.name, list(r["values"])) for r in metrics.appended_series(a, b).collect()) == [("x", [1.0, 3.0]), ("y", [2.0]), ("z", [4.0])]
    k = spark.createDataFrame([(True,)] * 19 + [(False,)], "kto_tags boolean")
    assert tuple(metrics.balanced_preferences(k, "kto_tags").first()) == (19, 1, False, True)
    r = spark.range(1).select(geometry.best_mask(F.array(F.lit(0.2), F.lit(0.9), F.lit(0.9)), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("m"), geometry.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s")).first()
    assert r.m == "b" and list(r.s) == pytest.approx([0.5, 0.5])
    rows = spark.createDataFrame([(0, i, 10 * (i + 1)) for i in range(9)], "g int, k long, n long")
    got = packing.micro_batched(rows, "g", "k", "n", 150).collect()
    parts = packing.micro_batches([10 * (i + 1) for i in range(9)], 150)
    assert {r.k: r.micro for r in got} == {k: j for j, p in enumerate(parts) for k in p}


def test_shards_and_caches(spark, tmp_path):
    df = spark.createDataFrame([(k, f"v{k}", "bad" if k == 3 else None) for k in range(7)], "row long, v string, error string")
    m = files.write_shards(df, f"{tmp_path}/s", 3)
    assert m["workers"] == [{"worker": 0, "written": 2, "errors": 1}, {"worker": 1, "written": 2, "errors": 0}, {"worker": 2, "written": 2, "errors": 0}]
    assert [r.row for r in files.read_shards(spark, f"{tmp_path}/s").collect()] == [0, 6, 1, 4, 2, 5] and json.loads(spark.read.text(f"{tmp_path}/s/manifest").first().value) == m
    assert files.write_extras(df, f"{tmp_path}/x", ["v"], {"fits": [str(k) for k in range(7)], "short": ["a"]}) == ["fits"]
    assert {r.v: r.fits for r in spark.read.json(f"{tmp_path}/x").collect()} == {f"v{k}": str(k) for k in range(7)}
    assert files.load_rollout_cache(spark, f"{tmp_path}/c", "p", "e", 7, 1) is None
    files.save_batch(Batch.of(df, "row", meta={"model": "m"}), files.rollout_cache_path(f"{tmp_path}/c", "p", "e", 7, 1))
    assert len(files.load_rollout_cache(spark, f"{tmp_path}/c", "p", "e", 7, 1, {"model": "m"})) == 7
    assert files.load_rollout_cache(spark, f"{tmp_path}/c", "p", "e", 7, 1, {"model": "other"}) is None


def test_stream_join(spark, tmp_path):
    for name, rows in (("a", [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")]), ("b", [(1, "2024-01-01 00:05:00"), (2, "2024-01-01 02:00:00")])):
        spark.createDataFrame(rows, "k int, s string").select("k", F.to_timestamp("s").alias(f"t{name}")).write.parquet(f"{tmp_path}/{name}")
    left, right = (streams.arriving(spark, f"{tmp_path}/{n}", f"k int, t{n} timestamp") for n in "ab")
    out = []
    q = streams.joined_streams(left, right, "k", "ta", "tb").select(F.col("a.k").alias("k")).writeStream.foreachBatch(lambda d, e: out.extend(r.k for r in d.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert out == [1]
