import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import advantages, losses, metrics, sampling


def test_reduce(spark):
    rows = [("loss", x) for x in (1.0, 2.0, 3.0)] + [("accuracy", x) for x in (0.8, 0.9, 0.7)] + [("max_reward", x) for x in (5.0, 8.0, 6.0)] + [("min_error", x) for x in (0.1, 0.05, 0.2)] + [("min_max", x) for x in (1.0, 4.0)]
    got = {r.name: round(r.value, 9) for r in metrics.reduce_by_name(spark.createDataFrame(rows, "name string, value double")).collect()}
    assert got == {"loss": 2.0, "accuracy": 0.8, "max_reward": 8.0, "min_error": 0.05, "min_max": 4.0}


def test_majority(spark):
    df = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "A", 0.7), (2, 0, "B", 0.1), (2, 1, "A", 0.2)], "g int, o int, v string, s double")
    got = {r.g: (r.vote, r.votes, r.vote_value) for r in metrics.majority(df, ["g"], "o", "v", "s").collect()}
    assert got == {1: ("A", 2, 0.9), 2: ("B", 1, 0.1)}


def test_bootstrap(spark):
    x = [0.1, 0.9, 0.4, 0.7, 0.2]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(x)] + [("one", 0, 1.0)], "g string, o int, s double")
    rows = {(r.g, r.k): r for r in metrics.bootstrap_best(df, ["g"], "o", "s").collect()}
    assert sorted(rows) == [("g", 2), ("g", 4), ("g", 5)]
    rng = np.random.RandomState(42)
    draws = np.array([np.array(x)[rng.choice(5, 2, replace=True)] for _ in range(1000)])
    assert math.isclose(rows["g", 2].best_mean, draws.max(1).mean()) and math.isclose(rows["g", 2].worst_std, draws.min(1).std())


def test_advantages(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 2), ("a", 1, 3.0, 4), ("a", 2, 3.0, 1), ("b", 3, 5.0, 3)], "uid string, row int, score double, length int")
    got = {k: {r.row: r.advantage for r in advantages.estimate(k, df).collect()} for k in ("grpo", "rloo", "opo", "gpg")}
    a, sd = np.array([1.0, 3.0, 3.0]), np.std([1.0, 3.0, 3.0], ddof=1)
    assert np.allclose([got["grpo"][i] for i in range(3)], (a - a.mean()) / (sd + 1e-6)) and math.isclose(got["grpo"][3], 5 / (1 + 1e-6))
    assert np.allclose([got["rloo"][i] for i in range(3)], (a - a.mean()) * 1.5) and got["rloo"][3] == 5
    assert math.isclose(got["opo"][0], 1 - (2 + 12 + 3) / 7) and math.isclose(got["gpg"][3], 5.0)
    best = {r.row: r.advantage for r in advantages.estimate("grpo_passk", df.where("uid = 'a'")).collect()}
    assert best == {0: 0.0, 1: 0.0, 2: 0.0}
    with pytest.raises(Exception, match="two rows"):
        advantages.estimate("grpo_passk", df).collect()
    with pytest.raises(KeyError):
        advantages.estimate("nope", df)


def test_folds(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.25, 0.125], [1, 0, 1])], "r array<double>, v array<double>, m array<int>")
    r = df.select(advantages.discounted_returns(F.col("r"), F.array(F.lit(1), F.lit(1), F.lit(1)), 0.5).alias("a"), advantages.discounted_returns(F.col("r"), F.col("m"), 0.5).alias("b"), advantages.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("g"), advantages.position_ids(F.col("m")).alias("p")).first()
    assert r.a == [2.75, 3.5, 3.0] and r.b == [1.0, 3.5, 3.0]
    last = 3 - 0.125
    assert np.allclose(r.g, [1 + 0.9 * 0.125 - 0.5 + 0.72 * last, last, last]) and r.p == [0, 0, 1]


def test_losses(spark):
    d = spark.range(1)
    assert math.isclose(d.select(losses.kl("k3", F.lit(-1.0), F.lit(-2.0))).first()[0], math.exp(-1) + 1 - 1)
    with pytest.raises(NotImplementedError):
        losses.kl("k3+", F.lit(0.0), F.lit(0.0))
    assert d.select(losses.reward_at_end(F.lit(4), F.lit(3), F.lit(2.0))).first()[0] == [0.0, 0.0, 2.0, 0.0]
    assert d.select(losses.overlong_penalty(F.lit(11), 12, 4, 1.0)).first()[0] == -0.75


def test_sampling(spark):
    df = spark.range(50).withColumn("w", F.when(F.col("id") == 7, 9.0).otherwise(0.0) + 1e-8)
    drawn = sampling.weighted_resample(df, "w", 200, 1, "id").collect()
    assert len(drawn) == 200 and sum(r.id == 7 for r in drawn) >= 198
    s = sampling.exact_sample(spark.range(10), 23, 1, "id").groupBy("id").count().collect()
    assert sum(r["count"] for r in s) == 23 and {r["count"] for r in s} == {2, 3}
    parts = [spark.range(4).withColumnRenamed("id", "row"), spark.range(2).withColumnRenamed("id", "row")]
    assert sampling.interleave(parts, "row").count() == 4 and sampling.interleave(parts, "row", stop="all").count() == 8


def test_bootstrap_in_blocks_draws_the_same(monkeypatch):
    """Blocks of rows, and of columns of a single row, continue the sequence of one call."""
    x = np.random.default_rng(1).normal(size=977)
    want = x[np.random.RandomState(42).choice(977, size=(60, 500), replace=True)]
    for bound in (10**9, 30_000, 7_000, 1_700, 333):
        monkeypatch.setattr(metrics, "DRAWS", bound)
        high, low = metrics._extremes(x, 500, 60, 42)
        assert (high == want.max(axis=1)).all() and (low == want.min(axis=1)).all(), bound


def test_members_of_a_hot_group(spark):
    rows = spark.range(700).selectExpr("IF(id % 7 = 0, NULL, IF(id < 600, 'hot', 'cold')) AS k", "id % 3 AS j", "IF(id = 5, NULL, id) AS i")
    got = sampling.group_members(rows, ["k", "j"], "i", per_row=32).collect()
    want = {}
    for r in rows.collect():
        if r.i is not None:
            want.setdefault((r.k, r.j), []).append(r.i)
    assert all(len(r.ids) <= 32 for r in got)
    for key, ids in want.items():
        mine = sorted((r for r in got if (r.k, r.j) == key), key=lambda r: r.part)
        assert sum((r.ids for r in mine), []) == sorted(ids) and {(r.first, r.members) for r in mine} == {(min(ids), len(ids))} and [r.part for r in mine] == list(range(len(mine)))
