"""Metric aggregations: reductions by name, validation summaries, votes, bootstrap, data and timing metrics."""

from __future__ import annotations

import functools

import numpy as np
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reduce_by_name(values: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """One value per metric name: the maximum where the name holds ``max``, else the minimum where it holds
    ``min``, else the mean."""
    n = F.col(name)
    g = values.groupBy(name).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.avg(value).alias("mid"))
    return g.select(name, F.when(n.contains("max"), F.col("hi")).when(n.contains("min"), F.col("lo")).otherwise(F.col("mid")).alias("value"))


def mean_and_std(samples: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """Long form ``source, metric, value``: mean@n of each prompt's samples and, for n > 1, std@n (population),
    averaged over prompts of the same n without weights."""
    per = samples.groupBy(source, uid).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    long = per.select(source, F.explode(F.array(F.struct(F.concat(F.lit("mean@"), F.col("n")).alias("metric"), F.col("m").alias("v")), F.struct(F.when(F.col("n") > 1, F.concat(F.lit("std@"), F.col("n"))).alias("metric"), F.col("s").alias("v")))).alias("x")).where("x.metric is not null")
    return long.groupBy(source, F.col("x.metric").alias("metric")).agg(F.count("*").alias("uids"), F.avg("x.v").alias("value"))


def majority(samples: DataFrame, keys: list[str], order: str, vote: str, value: str) -> DataFrame:
    """Per group: the most frequent vote (ties to the one seen first) and the first value of that vote."""
    votes = samples.groupBy(*keys, vote).agg(F.count("*").alias("votes"), F.min(order).alias("first"), F.min_by(value, order).alias("vote_value"))
    return votes.groupBy(*keys).agg(F.min_by(F.struct(F.col(vote).alias("vote"), "votes", "vote_value"), F.struct(-F.col("votes"), "first")).alias("w")).select(*keys, "w.*")


#: Positions drawn at once by a task; more draws come block by block from the same sequence.
DRAWS = 4_000_000


@functools.lru_cache(maxsize=64)
def _kept(n: int, k: int, repeats: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice(n, size=(repeats, k), replace=True)


def _extremes(x: np.ndarray, k: int, repeats: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest value of each resample of k. Small position tables are kept for further groups of the
    same size; large ones are drawn in blocks of rows, which continue one sequence, so that memory is bounded."""
    n = len(x)
    if repeats * k <= DRAWS // 64:
        got = x[_kept(n, k, repeats, seed)]
        return got.max(axis=1), got.min(axis=1)
    source, high, low = np.random.RandomState(seed), np.full(repeats, -np.inf), np.full(repeats, np.inf)
    rows, width = max(1, DRAWS // k), min(k, DRAWS)
    for r in range(0, repeats, rows):
        m = min(rows, repeats - r)
        for c in range(0, k, width):  # one row at a time where a row alone is larger
            got = x[source.choice(n, size=(m, min(width, k - c)), replace=True)]
            np.maximum(high[r : r + m], got.max(axis=1), out=high[r : r + m])
            np.minimum(low[r : r + m], got.min(axis=1), out=low[r : r + m])
    return high, low


def bootstrap_best(samples: DataFrame, keys: list[str], order: str, value: str, *, repeats: int = 1000, seed: int = 42) -> DataFrame:
    """``keys, k, best_mean, best_std, worst_mean, worst_std`` for k = 2, 4, 8, ... below n, and n itself.

    The resampled positions depend only on (n, k, seed); small tables of them are drawn once per (n, k) in a worker,
    large ones block by block, so that a task holds a group's values and ``DRAWS`` positions. Groups of one value give
    no rows.
    """
    g = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s")).select(*keys, F.col("s.v").alias("values"))
    kinds = {c: t for c, t in g.dtypes}

    def run(it):
        for p in it:
            rows = []
            for r in p.itertuples(index=False):
                x = np.asarray(r[-1], dtype=float)
                n, k, ks = len(x), 2, []
                while k < n:
                    ks.append(k)
                    k *= 2
                for k in [*ks, n] if n > 1 else []:
                    hi, lo = _extremes(x, k, repeats, seed)
                    rows.append((*r[:-1], k, hi.mean(), hi.std(), lo.mean(), lo.std()))
            import pandas as pd

            yield pd.DataFrame(rows, columns=[*keys, "k", "best_mean", "best_std", "worst_mean", "worst_std"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return g.mapInPandas(run, f"{schema}, k int, best_mean double, best_std double, worst_mean double, worst_std double")


def expected_best(samples: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Expected maximum and minimum of k draws with replacement, in closed form from the sorted values."""
    w = Window.partitionBy(*keys).orderBy(value)
    r = samples.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    i, n, v = F.col("i"), F.col("n"), F.col(value)
    best = F.sum(v * (F.pow(i / n, F.lit(k)) - F.pow((i - 1) / n, F.lit(k))))
    worst = F.sum(v * (F.pow((n - i + 1) / n, F.lit(k)) - F.pow((n - i) / n, F.lit(k))))
    return r.groupBy(*keys).agg(best.alias("expected_best"), worst.alias("expected_worst"))


def explained_variance(ret: Column, val: Column, where: Column) -> Column:
    r, d = F.when(where, ret), F.when(where, ret - val)
    return 1 - F.var_samp(d) / (F.var_samp(r) + 1e-5)


def sequence_metrics(rows: DataFrame, *, score: str, length: str, width: int | None = None) -> DataFrame:
    """One row: mean, max and min of the score over rows that are not aborted (length > 0), length statistics,
    the share of rows at the maximum length (``width``, or the longest) and of aborted rows."""
    ok = F.col(length) > 0
    top = F.lit(width) if width is not None else F.max(F.col(length))
    first = rows.agg(F.count_if(ok).alias("valid"), top.alias("top")) if width is None else rows.agg(F.count_if(ok).alias("valid"), F.lit(width).alias("top"))
    at_top = rows.groupBy(F.col(length).alias("len")).count()
    clipped = at_top.join(F.broadcast(first), at_top.len == first.top).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("at_top"))
    main = rows.agg(*(f(F.when(ok, F.col(score))).alias(f"score_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))), *(f(F.col(length).cast("double")).alias(f"length_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))), F.avg((~ok).cast("double")).alias("aborted_ratio"), F.count("*").alias("n"))
    return main.crossJoin(clipped).withColumn("clip_ratio", F.col("at_top") / F.col("n")).drop("at_top", "n")


def timing_metrics(timing: DataFrame, response_tokens: int | float, all_tokens: int | float, gen: str = "gen") -> DataFrame:
    """``name, seconds, ms_per_token``: generation by response tokens, everything else by all tokens."""
    per = F.when(F.col("name") == gen, F.lit(float(response_tokens))).otherwise(F.lit(float(all_tokens)))
    return timing.select("name", "seconds", (F.col("seconds") * 1000 / per).alias("ms_per_token"))


def throughput(rows: DataFrame, tokens: str, seconds: float, devices: int) -> DataFrame:
    t = F.sum(tokens)
    return rows.agg(t.alias("total_tokens"), F.lit(float(seconds)).alias("seconds"), (t / (seconds * devices)).alias("tokens_per_device_second"))


def by_source(rows: DataFrame, source: str, scores: str) -> DataFrame:
    """Mean over each row's responses (array column), then mean per source."""
    per = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return rows.groupBy(source).agg(F.avg(per).alias("test_score"))


def accuracy_by_category(rows: DataFrame, category: str, correct: str) -> DataFrame:
    """Accuracy in percent per category and, in the same pass, over all rows as ``Average``."""
    g = rows.rollup(category).agg(F.avg(F.col(correct).cast("double")).alias("a"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, F.lit("Average")).otherwise(F.col(category)).alias("category"), "n", F.round(F.col("a") * 100, 2).alias("accuracy"))


def length_cdf(lengths: DataFrame, length: str, interval: int) -> DataFrame:
    """Histogram of lengths by interval with running counts and percentages; the window runs over the histogram."""
    h = lengths.groupBy((F.floor(F.col(length) / interval) * interval).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return h.select("bin", "n", F.sum("n").over(w).alias("running"), (F.sum("n").over(w) / total * 100).alias("percent"))


def slowest(rows: DataFrame, a: str, b: str, order: str, *carry: str) -> DataFrame:
    """Minimum, maximum and mean of two timings, and the row where their sum is largest (ties: first row)."""
    stats = [f(c).alias(f"{c}_{n}") for c in (a, b) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return rows.agg(*stats, F.max_by(F.struct(order, a, b, *carry), F.struct(F.col(a) + F.col(b), -F.col(order))).alias("slowest")).select(*(c for c in [f"{x}_{n}" for x in (a, b) for n in ("min", "max", "mean")]), *(F.col(f"slowest.{c}").alias(f"slowest_{c}") for c in (order, a, b, *carry)))


def imbalance(parts: DataFrame, partition: str, length: str, balanced: str) -> DataFrame:
    """Spread of partition sums before (``partition``) and after (``balanced``) balancing."""
    a = parts.groupBy(partition).agg(F.sum(length).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("mean"))
    b = parts.groupBy(balanced).agg(F.sum(length).alias("s")).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return a.crossJoin(b).withColumn("minmax_diff", F.col("max") - F.col("min"))


def token_accuracy(pred: Column, label: Column, ignore: int = -100) -> Column:
    """Share of labels, ignored ones left out, that the prediction one position before matches; null if none."""
    z = F.filter(F.zip_with(F.slice(pred, F.lit(1), F.size(pred) - 1), F.slice(label, F.lit(2), F.size(label) - 1), lambda p, y: F.struct(p.alias("p"), y.alias("y"))), lambda s: s["y"] != ignore)
    return F.try_divide(F.size(F.filter(z, lambda s: s["p"] == s["y"])).cast("double"), F.size(z))


def mismatches(a: Column, b: Column, mask: Column) -> Column:
    """Number of masked positions at which two arrays differ."""
    return F.size(F.filter(F.zip_with(F.zip_with(a, b, lambda x, y: x != y), mask, lambda d, m: d & (m != 0)), lambda t: t))


def drift(tokens: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """Largest, mean and sample deviation of the probability difference of two log-prob columns, and their
    correlation, over masked tokens."""
    t = tokens.where(F.col(mask) != 0).withColumn("d", F.abs(F.exp(a) - F.exp(b)))
    return t.agg(F.max("d").alias("max_diff"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("std_diff"), F.corr(F.exp(a), F.exp(b)).alias("pearson"))


def perplexity(tokens: DataFrame, row: str, nll: str, mask: str) -> DataFrame:
    """exp of the masked mean negative log-likelihood per row, and its mean over rows."""
    per = tokens.groupBy(row).agg(F.exp(F.sum(F.col(nll) * F.col(mask)) / F.sum(mask)).alias("ppl"))
    return per.agg(F.count("ppl").alias("rows"), F.avg("ppl").alias("perplexity"))


def status_lists(runs: DataFrame, key: str, ident: str, status: str, terminal: list[str]) -> DataFrame:
    """Sorted ids per key: all, running, expanded, terminal."""
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(ident))))
    return runs.groupBy(key).agg(pick(F.lit(True)).alias("all_ids"), pick(F.col(status) == "running").alias("running"), pick(F.col(status) == "expanded").alias("expanded"), pick(F.col(status).isin(terminal)).alias("terminal"))


def preference_accuracy(pairs: DataFrame, chosen: str, rejected: str) -> DataFrame:
    c, r = F.col(chosen), F.col(rejected)
    return pairs.agg(F.avg((c > r).cast("double")).alias("accuracy"), F.avg(c).alias("chosen"), F.avg(r).alias("rejected"), F.avg(c - r).alias("margin"))


def two_level_mean(rows: DataFrame, rank: str, value: str) -> DataFrame:
    """Unweighted mean over ranks of each rank's mean."""
    return rows.groupBy(rank).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_of_means"))


def partial_sums(rows: DataFrame, side: str, value: str) -> DataFrame:
    """NaN-ignoring mean per side ("chosen", "rejected") and the difference of the two means."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    g = rows.groupBy().agg(*(F.avg(F.when(F.col(side) == s, v)).alias(s) for s in ("chosen", "rejected")), *(F.count(F.when(F.col(side) == s, v)).alias(f"n_{s}") for s in ("chosen", "rejected")))
    return g.withColumn("margin", F.col("chosen") - F.col("rejected"))


def tail_ratio(rows: DataFrame, value: str, share: float) -> DataFrame:
    """The percentile at 1 - share and the share of the total that lies at or above it."""
    from .selection import percentile

    cut, _ = percentile(rows, value, 1 - share)
    at = F.lit(cut).cast("double")
    return rows.agg(at.alias("cut"), (F.sum(F.when(F.col(value) >= at, F.col(value))) / F.sum(value)).alias("tail_share"), F.avg(value).alias("mean"))


def flops_estimate(rows: DataFrame, length: str, *, params: float, head_dim: int, heads: int, layers: int, seconds: float) -> DataFrame:
    """6 N tokens + 12 sum(len^2) head_dim heads layers, in TFLOP/s."""
    n, q = F.sum(F.col(length).cast("double")), F.sum(F.col(length).cast("double") * F.col(length))
    return rows.agg(((6 * params * n + 12 * q * head_dim * heads * layers) / seconds / 1e12).alias("tflops"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def effective_tokens_per_second(rows: DataFrame, lengths: list[str], epochs: float, seconds: float, world: int) -> DataFrame:
    total = functools.reduce(lambda a, b: a + b, [F.col(c) for c in lengths])
    return rows.agg((F.sum(total) * epochs / seconds / world).alias("effective_tokens_per_second"))


def reward_accuracy(chosen: Column, rejected: Column) -> Column:
    """Share of pairs whose chosen answer scores higher; an aggregate."""
    return F.avg((chosen > rejected).cast("double"))


def masked_statistics(tokens: DataFrame, mask: str, *values: str, returns: str | None = None, value: str | None = None) -> DataFrame:
    """One row: mean, max and min of each column over masked tokens, and with ``returns`` and ``value`` the explained
    variance of a critic (``vf_explained_var``)."""
    on = F.col(mask) != 0
    out = [f(F.when(on, F.col(c))).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    if returns and value:
        out.append(explained_variance(F.col(returns), F.col(value), on).alias("vf_explained_var"))
    return tokens.agg(*out)


def prompt_metrics(rows: DataFrame, prompt_length: str, width: int, turns: str | None = None) -> DataFrame:
    """One row: mean, max and min of prompt lengths and the share of prompts as wide as ``width``; with ``turns`` also the
    statistics of the numbers of turns."""
    spread = lambda c, name: [f(F.col(c)).cast("double").alias(f"{name}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    clip = F.avg((F.col(prompt_length) == width).cast("double")).alias("prompt_length_clip_ratio")
    return rows.agg(*spread(prompt_length, "prompt_length"), clip, *(spread(turns, "num_turns") if turns else []))


def group_reduced(rows: DataFrame, keys: list[str], value: str, reducers: dict[str, Callable]) -> DataFrame:
    """One column a reducer over the values of each group. A reducer is a function of a column (an aggregate, which
    combines before the shuffle) or, marked by :func:`whole_group`, of a pandas series that holds the group (a bounded
    group: all responses to one prompt)."""
    plain = {n: f for n, f in reducers.items() if not getattr(f, "whole_group", False)}
    out = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *(f(F.col(value)).alias(n) for n, f in plain.items())).drop("__n")
    whole = [F.pandas_udf(f, "double")(F.col(value)).alias(n) for n, f in reducers.items() if n not in plain]
    if whole:  # one kind of aggregate does not stand beside the other
        other = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(*whole)
        out = out.join(other, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)))
    return out.select(*keys, *reducers)


def whole_group(f: Callable) -> Callable:
    """Marks a reducer that needs all values of a group at once."""
    import pandas as pd

    f.__annotations__ = {"x": pd.Series, "return": float}
    f.whole_group = True
    return f


def cross_rank_timing(rows: DataFrame, name: str = "name", rank: str = "rank", seconds: str = "seconds") -> DataFrame:
    """``name, mean, min, max`` over the ranks' times (a rank's repeated sections add up)."""
    per = rows.groupBy(name, rank).agg(F.sum(seconds).alias("__s"))
    return per.groupBy(name).agg(F.avg("__s").alias("mean"), F.min("__s").alias("min"), F.max("__s").alias("max"))


def appended_series(history: DataFrame, new: DataFrame, name: str = "name", values: str = "values") -> DataFrame:
    """Named series (arrays) with further values behind them; names on one side only stay."""
    n = new.select(F.col(name).alias("__n"), F.col(values).alias("__v"))
    j = history.join(n, F.col(name) == F.col("__n"), "full")
    none = F.filter(F.coalesce(values, "__v"), lambda x: F.lit(False))
    return j.select(F.coalesce(name, "__n").alias(name), F.concat(F.coalesce(values, none), F.coalesce("__v", none)).alias(values))


def balanced_preferences(rows: DataFrame, tag: str, most: float = 0.9) -> DataFrame:
    """One row ``desirable, undesirable, one_kind, dominant``: dominant if one preference holds over ``most`` of the rows."""
    good, bad = F.count_if(F.col(tag)), F.count_if(~F.col(tag))
    return rows.agg(good.alias("desirable"), bad.alias("undesirable"), ((good == 0) | (bad == 0)).alias("one_kind"), (F.greatest(good, bad) > most * (good + bad)).alias("dominant"))
