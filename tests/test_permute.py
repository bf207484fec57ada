"""Permutations without a sort, selection without a top-k, draws and mixtures: edges that the queries do not reach."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.operators import permute, sampling, selection
from tessera.operators.rows import dense_index


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@settings(deadline=None, max_examples=80)
@given(st.integers(1, 3000), st.integers(0, 50))
def test_permutation_is_a_bijection(n, seed):
    k = permute.keys(seed, 0)
    there = [permute.permuted(x, n, k) for x in range(n)]
    assert sorted(there) == list(range(n)) and all(permute.permuted(there[x], n, k, True) == x for x in range(0, n, 7))


def test_permutations_look_random():
    n = 2000
    a, b = ([permute.permuted(x, n, permute.keys(4, e)) for x in range(n)] for e in range(2))
    assert sum(x == y for x, y in zip(a, b, strict=True)) < 12 and sum(x == i for i, x in enumerate(a)) < 12
    mean = (n - 1) / 2
    for lag in (1, 2, 44, 45, 46):  # neighbours, and neighbours in the grid, are uncorrelated
        r = sum((a[i] - mean) * (a[i + lag] - mean) for i in range(n - lag)) / sum((x - mean) ** 2 for x in a)
        assert abs(r) < 0.1
    halves = Counter((x < n // 2, i < n // 2) for i, x in enumerate(a))
    assert all(abs(v - n / 4) < 80 for v in halves.values())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 101])
def test_epochs_and_resume(spark, n):
    rows = spark.range(n).withColumn("t", F.concat(F.lit("x"), "id")).withColumn("keys", F.lit("clash"))
    whole = permute.epoch_batches(rows, "id", n, 4, 3, 9)
    assert whole.columns == ["id", "t", "keys", "epoch", "place", "batch"]
    whole = sorted(map(tuple, whole.collect()), key=str)
    want = [(x, f"x{x}", "clash", e, p, p // 4) for e in range(3) for x in range(n) for p in [permute.permuted(x, n, permute.keys(9, e))]]
    assert whole == sorted(want, key=str)
    for step in range(0, 3 * -(-n // 4) + 1, 3):
        epoch, batch = permute.position(step, n, 4)
        tail = permute.epoch_batches(rows, "id", n, 4, 3, 9, first_epoch=epoch, first_batch=batch).collect()
        assert sorted(map(tuple, tail), key=str) == sorted((r for r in want if (r[3], r[5]) >= (epoch, batch)), key=str)
    for b in (0, n // 4, n // 4 + 1):
        assert sorted((r.id, r.place) for r in permute.one_batch(rows, "id", n, 4, 1, b, 9).collect()) == sorted((r[0], r[4]) for r in want if r[3] == 1 and r[5] == b)
    full = permute.epoch_batches(rows, "id", n, 4, 2, 9, drop_last=True).collect()
    assert Counter((r.epoch, r.batch) for r in full) == {(e, b): 4 for e in range(2) for b in range(n // 4)}


def test_an_epoch_neither_sorts_nor_shuffles(spark):
    p = plan(permute.epoch_batches(spark.range(10**9), "id", 10**9, 512, 2, 1))
    assert "Sort" not in p and "Window" not in p and "Exchange" not in p
    assert permute.epoch_batches(spark.range(0), "id", 0, 4, 2).count() == 0


def test_drawn_positions_differ_and_reach_every_subset(spark):
    rows = spark.range(1500).select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("d"))
    got = permute.drawn(rows, "at", F.col("d"), F.lit(4), F.lit("s"), F.col("id").cast("string")).groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("s")).collect()
    seen = Counter(tuple(r.s) for r in got)
    assert set(seen) == {(i, j) for i in range(4) for j in range(i + 1, 4)} and all(abs(v - 250) < 70 for v in seen.values())


HEAVY = [None, float("nan"), float("inf"), -float("inf")] + [1.0] * 400 + [2.0] * 3 + [-5.0, 0.0, 1e300, -1e300] + [k / 7 for k in range(90)]


@pytest.mark.parametrize("small", [3, 50, 10_000])
@pytest.mark.parametrize("largest", [False, True])
def test_selection_with_heavy_ties(spark, small, largest):
    """Ties at the cut over and under ``small``, infinities, NaN and null, every kind of k."""
    rows = spark.createDataFrame([(k, v, {"m": 1}) for k, v in enumerate(HEAVY)], "id long, v double, m map<string,int>").repartition(3)

    def key(i):
        v = HEAVY[i]
        return (float("inf") if v is None or v != v else -v if largest else v, i)

    order = sorted(range(len(HEAVY)), key=key)
    for k in (0, 1, 2, 5, 60, 250, 409, len(HEAVY) - 1, len(HEAVY), len(HEAVY) + 5):
        got = selection.smallest(rows, k, F.col("v"), "id", largest=largest, small=small)
        assert got.columns == ["id", "v", "m"] and sorted(r.id for r in got.collect()) == sorted(order[:k]), k
    assert selection.smallest(rows.limit(0), 3, F.col("v"), "id").count() == 0


def test_selection_of_longs_is_exact(spark):
    """Values that a double can't tell apart, and nulls."""
    base = 2**60
    rows = spark.createDataFrame([(k, None if k % 50 == 0 else base + (k * 7919) % 211) for k in range(600)], "id long, v long")
    order = sorted(range(600), key=lambda k: (k % 50 == 0, 0 if k % 50 == 0 else base + (k * 7919) % 211, k))
    down = sorted(range(600), key=lambda k: (k % 50 == 0, 0 if k % 50 == 0 else -(base + (k * 7919) % 211), k))
    for k in (1, 77, 300, 590):
        assert sorted(r.id for r in selection.smallest(rows, k, F.col("v"), "id", small=20).collect()) == sorted(order[:k])
        assert sorted(r.id for r in selection.smallest(rows, k, F.col("v"), "id", largest=True, small=20).collect()) == sorted(down[:k])


def test_selection_has_no_growing_limit(spark):
    rows = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(997)).cast("double"))
    p = plan(selection.smallest(rows, 2500, F.col("v"), "id", small=100))
    assert "TakeOrdered" not in p and "Limit" not in p and "Sort" not in p
    assert "percentile" not in plan(rows.agg(F.lit(selection.percentile(rows, "v", 0.9)[0])))


@pytest.mark.parametrize("small", [5, 10_000])
def test_percentile_is_the_functions(spark, small):
    rows = spark.createDataFrame([(v,) for v in [None, *[3.0] * 40, *[k * k / 3 for k in range(120)]]], "v double")
    for share in (0.0, 0.1, 0.25, 0.5, 0.777, 0.9, 1.0):
        assert selection.percentile(rows, "v", share, small) == (rows.agg(F.percentile("v", share)).first()[0], 160)
    assert selection.percentile(rows.limit(0), "v", 0.5) == (None, 0)


def test_splits_take_exactly_their_share(spark):
    rows = spark.range(1000).withColumn("k", F.lit("same"))
    assert Counter(r.split for r in sampling.hash_split(rows, 0.25, "id").collect()) == {"validation": 250, "train": 750}
    assert Counter(r.split for r in sampling.hash_split(rows, 0.25, "k", "id").collect()) == {"validation": 250, "train": 750}
    assert Counter(r.copy for r in sampling.exact_sample(rows, 1333, 3, "id").collect()) == {0: 1000, 1: 333}


def test_dense_index_of_few_values(spark, monkeypatch):
    """A first column of two values, nulls among them: ranges are of the whole key, and none holds a value's rows."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("h")).repartition(7)
    got = dense_index(rows, "h", "id", rows_per_bucket=100).collect()
    order = sorted(range(3000), key=lambda k: (k % 5 > 0, k % 2 if k % 5 > 0 else 0, k))
    assert [r.id for r in sorted(got, key=lambda r: r["row"])] == order and sorted(r["row"] for r in got) == list(range(3000))


@pytest.mark.parametrize("sizes", [{}, {"rows_per_part": 9, "draws_per_task": 40}])
def test_weighted_draws_of_hot_and_odd_rows(spark, sizes):
    """One row of nine tenths of the weight, and rows of zero, negative, null and fractional weight."""
    rows = spark.createDataFrame([(k, 1000.0 if k == 3 else [1.9, 0.4, -2.0, None][k % 4], {"a": k}) for k in range(200)], "k long, w double, m map<string,int>")
    got = sampling.weighted_resample(rows, "w", 3000, 5, "k", **sizes).collect()
    assert sorted(r.draw for r in got) == list(range(3000)) and got[0].asDict().keys() == {"draw", "k", "w", "m"}
    seen = Counter(r.k for r in got)
    assert set(seen) <= {3, *range(0, 200, 4)} and abs(seen[3] / 3000 - 1000 / 1050) < 0.02 and all(r.m == {"a": r.k} for r in got)
    scaled = Counter(r.k % 4 for r in sampling.weighted_resample(rows.where("k <> 3"), "w", 4000, 5, "k", scale=10, **sizes).collect())
    assert set(scaled) == {0, 1} and abs(scaled[1] / 4000 - 4 / 23) < 0.03
    assert sampling.weighted_resample(rows.where("w < 0"), "w", 5, 1, "k").count() == 0 and sampling.weighted_resample(rows.limit(0), "w", 5, 1, "k").count() == 0


def drawn_plainly(sizes, probabilities, stop, seed):
    """Turn by turn."""
    import hashlib

    at, ended, out, t = [0] * len(sizes), {i for i, q in enumerate(probabilities) if not q}, [], 0
    live = [i for i, q in enumerate(probabilities) if q]
    while True:
        u = int(hashlib.md5(f"{seed}|{t}".encode()).hexdigest()[:8], 16) / 2**32
        total, part = 0.0, live[-1]
        for i in live[:-1]:
            total += probabilities[i] / sum(probabilities)
            if u < total:
                part = i
                break
        out.append((t, part, at[part] % sizes[part]))
        at[part] += 1
        ended |= {part} if at[part] == sizes[part] else set()
        t += 1
        if (stop == "first" and any(at[i] == sizes[i] for i in live)) or (stop == "all" and len(ended) == len(sizes)):
            return out


@pytest.mark.parametrize("stop", ["first", "all"])
@pytest.mark.parametrize("block", [5, 16, 65_536])
def test_drawn_mixtures(spark, stop, block):
    for sizes, probabilities in (([30, 7, 12], [0.5, 0.2, 0.3]), ([4, 9], [1, 0]), ([1, 1, 40], [0.05, 0.05, 0.9])):
        parts = [spark.range(n).withColumn("name", F.lit(f"p{i}")) for i, n in enumerate(sizes)]
        got = sampling.interleave_drawn(parts, "id", probabilities, stop=stop, seed=6, block=block).collect()
        assert sorted((r.turn, r.part, r.id) for r in got) == drawn_plainly(sizes, probabilities, stop, 6) and all(r.name == f"p{r.part}" for r in got)
    parts = [spark.range(3), spark.range(0)]
    if stop == "first":
        assert sampling.interleave_drawn(parts, "id", [0.5, 0.5], stop=stop).count() == 0
    else:
        with pytest.raises(ValueError):
            sampling.interleave_drawn(parts, "id", [0.5, 0.5], stop=stop)
    with pytest.raises(ValueError):
        sampling.interleave_drawn(parts, "id", [0.5, -0.5], stop=stop)
