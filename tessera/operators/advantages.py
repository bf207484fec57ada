"""Group-relative advantages, returns and ordered per-row state, as window expressions and array folds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

_EPS = 1e-6
ADVANTAGES: dict[str, Callable[..., DataFrame]] = {}


def advantage(name: str):
    """Registers an estimator; it adds a column ``advantage`` to rows of (uid, score, ...)."""

    def keep(f):
        ADVANTAGES[name] = f
        return f

    return keep


def estimate(name: str, rows: DataFrame, **settings) -> DataFrame:
    if name not in ADVANTAGES:
        raise KeyError(f"unknown advantage estimator {name!r}; known: {sorted(ADVANTAGES)}")
    return ADVANTAGES[name](rows, **settings)


def _group(uid: str):
    return Window.partitionBy(uid)


@advantage("grpo")
def grpo(rows: DataFrame, uid: str = "uid", score: str = "score", by_std: bool = True) -> DataFrame:
    """(s - mean) / (sample std + 1e-6) in the group; a single row keeps mean 0 and std 1."""
    w, s = _group(uid), F.col(score)
    n = F.count(s).over(w)
    centred = s - F.when(n > 1, F.avg(s).over(w)).otherwise(0.0)
    return rows.withColumn("advantage", centred / (F.when(n > 1, F.stddev_samp(s).over(w)).otherwise(1.0) + _EPS) if by_std else centred)


@advantage("grpo_passk")
def grpo_passk(rows: DataFrame, uid: str = "uid", score: str = "score", order: str = "row", by_std: bool = True) -> DataFrame:
    """Only a group's best row (ties: first) gets its lead over the runner-up; groups of one are an error."""
    w = _group(uid)
    ranked = w.orderBy(F.desc(score), order)
    full = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.first(score).over(full) - F.nth_value(score, 2).over(full)
    if by_std:
        lead = lead / (F.stddev_samp(score).over(w) + _EPS)
    checked = F.when(F.count(score).over(w) < 2, F.raise_error(F.lit("a group needs at least two rows")).cast("double")).otherwise(lead)
    return rows.withColumn("advantage", F.when(F.row_number().over(ranked) == 1, checked).otherwise(F.when(F.count(score).over(w) < 2, checked).otherwise(0.0)))


@advantage("rloo")
def rloo(rows: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """Leave-one-out baseline: (s - mean) n / (n - 1); a single row keeps its score."""
    w, s = _group(uid), F.col(score)
    n = F.count(s).over(w)
    return rows.withColumn("advantage", F.when(n > 1, s * n / (n - 1) - F.avg(s).over(w) * n / (n - 1)).otherwise(s))


@advantage("opo")
def opo(rows: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """Length-weighted baseline; a single row keeps its score."""
    w, s, n = _group(uid), F.col(score), F.col(length)
    return rows.withColumn("advantage", F.when(F.count(s).over(w) > 1, s - F.sum(n * s).over(w) / F.sum(n).over(w)).otherwise(s))


@advantage("gpg")
def gpg(rows: DataFrame, uid: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """alpha (s - mean) / f_norm with alpha = rows / max(1, rows with a non-zero score); single rows: mean 0."""
    w, s = _group(uid), F.col(score)
    alpha = rows.agg((F.count("*") / F.greatest(F.lit(1), F.count_if(s != 0))).alias("__alpha"))
    mean = F.when(F.count(s).over(w) > 1, F.avg(s).over(w)).otherwise(0.0)
    return rows.withColumn("__c", s - mean).crossJoin(F.broadcast(alpha)).withColumn("advantage", F.col("__alpha") * F.col("__c") / f_norm).drop("__c", "__alpha")  # alpha is one row


def whiten(rows: DataFrame, value: str, weight: str, shift_mean: bool = True, out: str = "whitened") -> DataFrame:
    """(x - mean) * rsqrt(var + 1e-8) with weights as token counts and Bessel's correction; optionally the mean
    is added back. A total weight of 0 or 1 has no variance and is an error."""
    x, m = F.col(value), F.col(weight)
    stat = rows.agg((F.sum(m * x) / (F.sum(m) + 1e-8)).alias("__mean"), F.sum(m).alias("__n"))
    dev = rows.crossJoin(F.broadcast(stat)).agg(F.first("__mean").alias("__mean"), F.first("__n").alias("__n"), (F.sum(m * (x - F.col("__mean")) * (x - F.col("__mean"))) / (F.first("__n") + 1e-8)).alias("__v"))
    n = F.col("__n")
    var = F.when(n > 1, F.col("__v") * n / (n - 1)).otherwise(F.raise_error(F.lit("no variance: the mask sums to 0 or 1")).cast("double"))
    one = dev.select("__mean", (1 / F.sqrt(var + 1e-8)).alias("__r"))
    w = (x - F.col("__mean")) * F.col("__r") + (F.lit(0.0) if shift_mean else F.col("__mean"))
    return rows.crossJoin(F.broadcast(one)).withColumn(out, w).drop("__mean", "__r")  # one row of statistics


@advantage("reinforce_plus_plus_baseline")
def rfpp_baseline(rows: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """Group-centred scores, whitened over all tokens (a row's weight is its number of tokens)."""
    w, s = _group(uid), F.col(score)
    centred = rows.withColumn("__c", s - F.when(F.count(s).over(w) > 1, F.avg(s).over(w)).otherwise(0.0))
    return whiten(centred, "__c", length, out="advantage").drop("__c")


def sequences(tokens: DataFrame, row: str, t: str, *values: str) -> DataFrame:
    """Token rows to one row per sequence: ``row`` and the value columns as arrays in token order."""
    g = tokens.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("__t"), *values))).alias("__s"))
    return g.select(row, *(F.col(f"__s.{v}").alias(v) for v in values))


def _from_the_end(columns: list[pd.Series], carries: int, step) -> pd.Series:
    """Runs a recursion over ragged sequences from their last token, all sequences of a batch at a time: ``step`` takes
    the tokens' values and the carries, and gives the outputs and the new carries."""
    size = columns[0].map(len).to_numpy()
    ends, flat = np.cumsum(size), [np.concatenate([np.zeros(0), *c]).astype(np.float64) for c in columns]
    order = np.argsort(-size, kind="stable")
    falling, out, carry = size[order], np.zeros(int(size.sum())), np.zeros((carries, len(size)))
    for s in range(int(size.max(initial=0))):
        k = int(np.searchsorted(-falling, -s, side="left"))  # sequences of more than s tokens
        at = ends[order[:k]] - 1 - s
        out[at], *new = step(*(f[at] for f in flat), *carry[:, :k])
        carry[:, :k] = new
    return pd.Series(np.split(out, ends[:-1])) if len(size) else pd.Series([], dtype=object)


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """R_t = r_t + gamma R_(t+1), the carry reset where the mask is 0; an array in token order. Linear in the length."""

    def step(r, m, carry):
        returns = r + gamma * carry
        return returns, returns * m

    @F.pandas_udf("array<double>")
    def run(r: pd.Series, m: pd.Series) -> pd.Series:
        return _from_the_end([r, m], 1, step)

    return run(rewards.cast("array<double>"), mask.cast("array<double>"))


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages in token order; masked tokens leave both carries as they are. Linear in the length."""

    def step(r, v, m, following, last):
        live = m != 0
        new = np.where(live, r + gamma * following - v + gamma * lam * last, last)
        return new, np.where(live, v, following), new

    @F.pandas_udf("array<double>")
    def run(r: pd.Series, v: pd.Series, m: pd.Series) -> pd.Series:
        return _from_the_end([r, v, m], 2, step)

    return run(*(c.cast("array<double>") for c in (rewards, values, mask)))


@advantage("reinforce_plus_plus")
def rfpp(tokens: DataFrame, row: str = "row", t: str = "t", reward: str = "reward", mask: str = "mask", gamma: float = 1.0) -> DataFrame:
    """Token rows with returns (column ``returns``) and their whitened advantage over masked tokens."""
    s = sequences(tokens, row, t, t, reward, mask)
    r = s.select(row, F.explode(F.arrays_zip(F.col(t).alias("tt"), discounted_returns(F.col(reward), F.col(mask), gamma).alias("ret"), F.col(mask).alias("mm"))).alias("x"))
    flat = r.select(row, F.col("x.tt").alias(t), F.col("x.ret").alias("returns"), F.col("x.mm").alias(mask))
    flat = written(flat.sparkSession)(flat)  # whitening reads it several times: the recursion runs once
    return whiten(flat, "returns", mask, out="__w").withColumn("advantage", F.col("__w") * F.col(mask)).drop("__w")


@advantage("remax")
def remax(tokens: DataFrame, row: str = "row", t: str = "t", reward: str = "reward", mask: str = "mask", baseline: str = "baseline") -> DataFrame:
    """Reward to go over masked tokens, and that minus the baseline times the mask."""
    w = Window.partitionBy(row).orderBy(t).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    r = tokens.withColumn("returns", F.sum(F.col(reward) * F.col(mask)).over(w))
    return r.withColumn("advantage", F.col("returns") - F.col(baseline) * F.col(mask))


@advantage("gae")
def gae_tokens(tokens: DataFrame, row: str = "row", t: str = "t", reward: str = "reward", value: str = "value", mask: str = "mask", gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Token rows with raw ``gae``, ``returns`` = gae + value, and ``advantage`` whitened over masked tokens."""
    s = sequences(tokens, row, t, t, reward, value, mask)
    z = s.select(row, F.explode(F.arrays_zip(F.col(t).alias("tt"), gae(F.col(reward), F.col(value), F.col(mask), gamma, lam).alias("a"), F.col(value).alias("v"), F.col(mask).alias("mm"))).alias("x"))
    flat = z.select(row, F.col("x.tt").alias(t), F.col("x.a").alias("gae"), (F.col("x.a") + F.col("x.v")).alias("returns"), F.col("x.mm").alias(mask))
    flat = written(flat.sparkSession)(flat)  # whitening reads it several times: the recursion runs once
    return whiten(flat, "gae", mask, out="advantage")


def shifted_pairs(rows: DataFrame, order: str, response: str, batch: int = 1000) -> DataFrame:
    """Adds ``kl_response``: the previous row's response inside batches of ``batch`` rows; a batch's first row
    gets its last row's."""
    w = Window.partitionBy(F.floor(F.col(order) / batch)).orderBy(order)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("kl_response", F.when(F.row_number().over(w) == 1, F.last(response).over(full)).otherwise(F.lag(response).over(w)))


def run_numbers(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds ``rollout_n``: 0-based position in the run of equal neighbouring values."""
    w = Window.partitionBy(group).orderBy(order)
    new = (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("long")
    run = rows.withColumn("__run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.withColumn("rollout_n", F.row_number().over(Window.partitionBy(group, "__run").orderBy(order)) - 1).drop("__run")


def position_ids(mask: Column) -> Column:
    """max(running sum of the mask - 1, 0), as an array."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("o"))
    return F.aggregate(mask, start, lambda a, m: F.struct((a["s"] + m).cast("long").alias("s"), F.concat(a["o"], F.array(F.greatest(a["s"] + m - 1, F.lit(0)).cast("long"))).alias("o")), lambda a: a["o"])


def response_mask(tokens: DataFrame, row: str, t: str, eos: Column, out: str = "response_mask") -> DataFrame:
    """1 up to and including a sequence's first end token, else 0."""
    before = Window.partitionBy(row).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn(out, (F.coalesce(F.sum(eos.cast("long")).over(before), F.lit(0)) == 0).cast("int"))


def tool_necessity(rows: DataFrame, uid: str, score: str, used: str) -> DataFrame:
    """Adds group counts and mean scores with and without tools, and ``correct_without_tool``."""
    w = _group(uid)
    u, s = F.col(used), F.col(score)
    return rows.withColumns({"with_tool": F.count_if(u).over(w), "acc_with_tool": F.avg(F.when(u, s)).over(w), "acc_without_tool": F.avg(F.when(~u, s)).over(w), "correct_without_tool": F.count_if(~u & (s > 0)).over(w)})


def smooth(losses: Column) -> Column:
    """Exponential smoothing whose weight grows with the series: 1.8 (1 / (1 + e^(-0.05 n)) - 0.5)."""
    n = F.size(losses)
    w = 1.8 * (1 / (1 + F.exp(-0.05 * n)) - 0.5)
    start = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<double>").alias("o"))
    step = lambda a, x: F.when(a["s"].isNull(), x.cast("double")).otherwise(a["s"] * w + (1 - w) * x)
    return F.aggregate(losses, start, lambda a, x: F.struct(step(a, x).alias("s"), F.concat(a["o"], F.array(step(a, x))).alias("o")), lambda a: a["o"])


def improvement_penalty(rows: DataFrame, instance: str, order: str, reward: str) -> DataFrame:
    """0.0 where the reward rose over the instance's previous one (0.0 at first), else -0.05."""
    w = Window.partitionBy(instance).orderBy(order)
    return rows.withColumn("penalty", F.when(F.col(reward) > F.lag(reward, 1, 0.0).over(w), 0.0).otherwise(-0.05))


def progress(steps: DataFrame, step: str, seconds: str, total: int) -> DataFrame:
    """Percentage done (2 places) and the remaining time as H:MM:SS from the mean time per step."""
    p = steps.agg(F.max(step).alias("done"), F.sum(seconds).alias("elapsed"))
    left = ((total - F.col("done")) * F.col("elapsed") / F.col("done")).cast("long")
    return p.select("done", F.round(F.col("done") / total * 100, 2).alias("percentage"), F.concat_ws(":", (left / 3600).cast("long").cast("string"), F.lpad(((left % 3600) / 60).cast("long").cast("string"), 2, "0"), F.lpad((left % 60).cast("string"), 2, "0")).alias("remaining"))
