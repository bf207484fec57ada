"""Tokens chosen by covariance, over a table whose rows arrive in another order each time that it is read."""

import random

import pytest
from pyspark.sql import functions as F
from tessera.operators import losses

KINDS = [(a / 7, l) for a in (-3.1, 0.2, 1.7) for l in (-1e3 / 3, -0.1, -1e-3 / 7, -1e6 / 9)]
N = 3000


@pytest.fixture()
def tokens(spark):
    def rows(batches):
        import numpy as np
        import pandas as pd

        for _ in batches:
            i = np.random.default_rng().permutation(N)  # the order differs from pass to pass, the rows do not
            kind = [KINDS[k] for k in i * 7 % len(KINDS)]
            yield pd.DataFrame({"row": i // 5, "t": i % 5, "adv": [k[0] for k in kind], "logp": [k[1] for k in kind], "old_logp": [k[1] - 0.25 for k in kind], "mask": (i % 3 > 0).astype(int)})

    return spark.range(1, numPartitions=1).mapInPandas(rows, "row long, t long, adv double, logp double, old_logp double, mask int")


def kept():
    """Masked (row, t, advantage, log-prob) and the covariance of each kind by exact means."""
    from fractions import Fraction

    rows = [(i // 5, i % 5, *KINDS[i * 7 % len(KINDS)]) for i in random.Random(1).sample(range(N), N) if i % 3]
    mean = lambda k: sum(Fraction(r[k]) for r in rows) / len(rows)
    a, l = mean(2), mean(3)
    return [(r[0], r[1], float((Fraction(r[2]) - a) * (Fraction(r[3]) - l))) for r in rows]


def test_largest_covariance_where_means_vary(spark, tokens):
    """The cut falls inside equal values: a mean that differed by a last digit between passes took all of them or none."""
    rows = kept()
    for ratio in (0.03, 0.1, 0.2):
        want = {(r, t) for r, t, _ in sorted(rows, key=lambda x: (-x[2], x[0], x[1]))[: int(len(rows) * ratio)]}
        l = losses.token_losses("kl_cov", tokens, ratio=ratio)
        extra = F.abs(F.col("loss") + F.col("adv") * F.exp(F.lit(0.25))) > 0.2
        assert {(r.row, r.t) for r in l.where(extra).collect()} == want and l.count() == N
        assert {(r.row, r.t) for r in losses.kl_cov_top(tokens, "logp", "adv", "mask", ratio, "row", "t").collect()} == want


def test_no_masked_tokens(spark, tokens):
    assert losses.token_losses("kl_cov", tokens.withColumn("mask", F.lit(0))).where(F.abs(F.col("loss") + F.col("adv") * F.exp(F.lit(0.25))) > 0.2).count() == 0


def test_drawn_tokens_are_marked_in_one_pass(spark, tokens):
    """The tokens drawn are those of smallest digest, and the result reads the tokens once: no join meets them again."""
    from hashlib import md5

    from tessera.plans import catalogue

    got = losses.token_losses("clip_cov", tokens, ratio=0.05, cov_low=-1e9, cov_high=1e9, seed=3)
    below = {(x.row, x.t) for x in tokens.where("adv < 0").collect()}
    ids = sorted((md5(f"3|{r}|{t}".encode()).hexdigest(), r, t) for r, t, _ in kept() if (r, t) in below)
    most = int(len(kept()) * 0.05)
    # the ratio is exp(0.25): only tokens of negative advantage are left alone by the clipping
    assert {(x.row, x.t) for x in got.where("dropped").collect()} == {(r, t) for _, r, t in ids[:most]} and got.where("dropped and loss <> 0").count() == 0
    none = losses.token_losses("clip_cov", tokens, cov_low=1e20, cov_high=1e21)
    assert none.where("dropped").count() == 0 and none.count() == N
    plan = catalogue.QUERIES["clip_cov_draw"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") + plan.count("BatchScan") == 1 and "HashJoin" not in plan and "MergeJoin" not in plan, plan
