"""Loss and KL formulas over token rows or token arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def reduce_loss(tokens: DataFrame, row: str, loss: str, mask: str, width: int | None = None) -> DataFrame:
    """All four reductions at once: ``mode, value``. width: the padded length (default: the longest sequence)."""
    l, m = F.col(loss), F.col(mask)
    per = tokens.groupBy(row).agg(F.sum(l * m).alias("s"), F.sum(m).alias("n"), F.count("*").alias("w"))
    wide = F.max("w") if width is None else F.lit(width)
    a = per.agg((F.sum("s") / F.sum("n")).alias(LOSS_MODES[0]), F.avg("s").alias(LOSS_MODES[1]), F.avg(F.try_divide(F.col("s"), F.col("n"))).alias(LOSS_MODES[2]), (F.sum("s") / wide).alias(LOSS_MODES[3]))
    return a.select(F.explode(F.array(*(F.struct(F.lit(k).alias("mode"), F.col(f"`{k}`").alias("value")) for k in LOSS_MODES))).alias("x")).select("x.*")


def kl(kind: str, logp: Column, ref: Column) -> Column:
    """Per-token KL estimates: ``k1`` (or ``kl``), ``abs``, ``k2`` (``mse``), ``k3`` (``low_var_kl``)."""
    d = logp - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        back = F.greatest(F.least(-d, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(back) - back - 1, F.lit(10.0)), F.lit(-10.0))
    raise NotImplementedError(f"unknown KL estimator {kind!r}")


def kl_penalty(scores: Column, kls: Column, mask: Column, beta: float) -> Column:
    """score - beta * kl * mask, over arrays."""
    return F.zip_with(F.zip_with(kls, mask, lambda k, m: k * m), scores, lambda k, s: s - beta * k)


def mean_kl(tokens: DataFrame, row: str, value: str, mask: str) -> DataFrame:
    """Mean over rows of each row's masked mean."""
    per = tokens.groupBy(row).agg((F.sum(F.col(value) * F.col(mask)) / (F.sum(mask) + 1e-8)).alias("k"))
    return per.agg(F.avg("k").alias("current_kl"))


def adaptive_coefficient(steps: DataFrame, order: str, kl_col: str, n: str, *, start: float, target: float, horizon: float) -> DataFrame:
    """Adds ``coefficient`` after each step: multiplied by 1 + clip(kl / target - 1, +-0.2) n / horizon."""
    e = F.greatest(F.least(F.col(kl_col) / target - 1, F.lit(0.2)), F.lit(-0.2))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per training step
    return steps.withColumn("coefficient", start * F.exp(F.sum(F.ln(1 + e * F.col(n) / horizon)).over(w)))


def clipped_policy(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Dual-clip PPO token loss."""
    ratio = F.exp(F.greatest(F.least(logp - old, F.lit(20.0)), F.lit(-20.0)))
    plain = F.greatest(-adv * ratio, -adv * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)))
    return F.when(adv < 0, F.least(-adv * dual, plain)).otherwise(plain)


def clip_fractions(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> tuple[Column, Column]:
    """(clipped, dual-clipped) indicators of a token as 0/1."""
    ratio = F.exp(F.greatest(F.least(logp - old, F.lit(20.0)), F.lit(-20.0)))
    a, b = -adv * ratio, -adv * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))
    return (b > a).cast("double"), ((F.greatest(a, b) > -adv * dual) & (adv < 0)).cast("double")


def sequence_ratio(tokens: DataFrame, row: str, logp: str, old: str, mask: str) -> DataFrame:
    """Adds ``log_ratio`` per row: the masked mean of the log-prob difference."""
    w = Window.partitionBy(row)
    return tokens.withColumn("log_ratio", F.sum((F.col(logp) - F.col(old)) * F.col(mask)).over(w) / F.greatest(F.sum(mask).over(w), F.lit(1)))


def gspo(tokens: DataFrame, row: str, logp: str, old: str, adv: str, mask: str, low: float = 3e-4, high: float = 4e-4) -> DataFrame:
    """Sequence-level ratios: adds ``loss`` per token; reduce by sequence means."""
    t = sequence_ratio(tokens, row, logp, old, mask)
    r = F.exp(F.least(F.col("log_ratio"), F.lit(10.0)))
    return t.withColumn("loss", F.greatest(-F.col(adv) * r, -F.col(adv) * F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low)))).drop("log_ratio")


def geo_mean(tokens: DataFrame, row: str, logp: str, old: str, adv: str, mask: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """One row per sequence: loss from the geometric mean of token ratios clipped on the advantage's side."""
    s = F.signum(adv)
    d = F.col(logp) - F.col(old)
    clipped = F.greatest(F.least(d, F.lit(high)), F.lit(-low))
    use = s * F.least(s * d, s * clipped)
    per = tokens.groupBy(row).agg((F.sum(use * F.col(mask)) / (F.sum(mask) + 1e-8)).alias("__g"), (F.sum(F.col(adv) * F.col(mask)) / (F.sum(mask) + 1e-8)).alias("__a"))
    return per.select(row, (-F.col("__a") * F.exp("__g")).alias("loss"))


def _masked_means(tokens: DataFrame, logp: str, adv: str, mask: str) -> tuple[Column, Column, float]:
    """Mean advantage and mean log-prob of the masked tokens, and the mask's sum. They are worked out once, as literals:
    a mean of doubles depends on the order in which parts arrive, and passes that compare for equality must see one value."""
    m = F.col(mask) != 0
    a, l, n = tokens.agg(F.avg(F.when(m, F.col(adv)).cast("double")), F.avg(F.when(m, F.col(logp)).cast("double")), F.sum(mask)).first()
    return F.lit(a).cast("double"), F.lit(l).cast("double"), n or 0


def _banded(tokens: DataFrame, a: Column, l: Column, logp: str, adv: str, mask: str, low: float, high: float) -> DataFrame:
    t = tokens.withColumn("cov", (F.col(adv) - a) * (F.col(logp) - l))
    return t.withColumn("in_band", (F.col(mask) != 0) & (F.col("cov") > low) & (F.col("cov") < high))


def clip_cov_band(tokens: DataFrame, logp: str, adv: str, mask: str, low: float, high: float) -> DataFrame:
    """Adds ``cov`` = (adv - mean adv)(logp - mean logp) over masked tokens, and whether it lies in the band."""
    a, l, _ = _masked_means(tokens, logp, adv, mask)
    return _banded(tokens, a, l, logp, adv, mask, low, high)


def clip_cov_loss(tokens: DataFrame, logp: str, old: str, adv: str, mask: str, *order: str, low: float = 0.2, high: float = 0.2, ratio: float = 0.0002, cov_low: float = 1.0, cov_high: float = 5.0, seed: int = 0) -> DataFrame:
    """Adds ``loss`` and ``dropped``: of the masked tokens that plain clipping leaves alone and whose covariance lies in the
    band, max(1, int(N ratio)) are drawn (in seeded order of ``order``) and lose their gradient; the others keep the
    clipped loss."""
    from ..sources.scratch import written
    from .sampling import shuffled
    from .selection import hex_value, smallest

    r = F.exp(F.col(logp) - F.col(old))
    plain, cut = -F.col(adv) * r, -F.col(adv) * F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low))
    a, l, n = _masked_means(tokens, logp, adv, mask)
    free = F.col("in_band") & ~(cut > plain)
    banded = _banded(tokens, a, l, logp, adv, mask, cov_low, cov_high)
    # the passes of the selection read the open tokens' keys and numbers, written once; the tokens are read once more
    place = F.struct(hex_value(shuffled(seed, *order)).alias("v"), shuffled(seed, *order).alias("m"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    open_ = written(tokens.sparkSession)(banded.where(free).select(*order, hex_value(shuffled(seed, *order)).alias("__v"))).withColumn("__m", shuffled(seed, *order))
    drawn = smallest(open_, max(1, int(n * ratio)), F.col("__v"), "__m", *order).select(F.struct(F.col("__v").alias("v"), F.col("__m").alias("m"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order))).alias("p")).agg(F.max("p").alias("__last"))
    last = tokens.sparkSession.createDataFrame(drawn.collect(), drawn.schema)  # one row; null if no token is open
    j = banded.crossJoin(F.broadcast(last))
    dropped = F.coalesce(free & (place <= F.col("__last")), F.lit(False))
    return j.withColumn("dropped", dropped).withColumn("loss", F.when(F.col("dropped"), 0.0).otherwise(F.greatest(plain, cut))).select(*tokens.columns, "dropped", "loss")


def kl_cov_loss(tokens: DataFrame, logp: str, old: str, adv: str, mask: str, *order: str, ratio: float = 0.0002, weight: float = 1.0) -> DataFrame:
    """Adds ``loss``: -adv times the ratio, and for the tokens of largest covariance (those of :func:`kl_cov_top`) also
    ``weight`` times the absolute log-prob difference. The tokens are marked in place, not joined to those found."""
    from .selection import among_smallest

    m = F.col(mask) != 0
    t = clip_cov_band(tokens, logp, adv, mask, 0.0, 0.0).drop("in_band")
    marked = among_smallest(t, "__top", max(1, int(tokens.where(m).count() * ratio)), F.when(m, F.col("cov")), *order, largest=True)
    plain = -F.col(adv) * F.exp(F.col(logp) - F.col(old))
    return marked.withColumn("loss", plain + F.when(m & F.col("__top"), weight * F.abs(F.col(logp) - F.col(old))).otherwise(0.0)).select(*tokens.columns, "loss")


def truncated_importance(loss: Column, old: Column, rollout: Column, cap: float) -> Column:
    """A token's loss times the ratio of the policy that trains to the one that sampled, at most ``cap``; a cap of 0 or
    less, or no sampled log-prob, leaves it."""
    if cap <= 0:
        return loss
    return loss * F.coalesce(F.least(F.exp(old - rollout), F.lit(float(cap))), F.lit(1.0))


POLICY_LOSSES: dict[str, Callable[..., DataFrame]] = {}


def policy_loss(name: str):
    """Registers a function of tokens (and the names of their logp, old, adv, mask columns and of the key) that adds a
    ``loss`` column."""

    def keep(f):
        POLICY_LOSSES[name] = f
        return f

    return keep


def token_losses(name: str, tokens: DataFrame, *, row: str = "row", t: str = "t", logp: str = "logp", old: str = "old_logp", adv: str = "adv", mask: str = "mask", **settings) -> DataFrame:
    """The tokens with their ``loss`` by a registered policy loss."""
    if name not in POLICY_LOSSES:
        raise KeyError(f"unknown policy loss {name!r}; known: {sorted(POLICY_LOSSES)}")
    return POLICY_LOSSES[name](tokens, row, t, logp, old, adv, mask, **settings)


@policy_loss("vanilla")
def _vanilla(tokens, row, t, logp, old, adv, mask, rollout: str | None = None, cap: float = 0.0, **clip):
    loss = clipped_policy(F.col(logp), F.col(old), F.col(adv), **clip)
    return tokens.withColumn("loss", truncated_importance(loss, F.col(old), F.col(rollout), cap) if rollout else loss)


@policy_loss("gpg")
def _gpg(tokens, row, t, logp, old, adv, mask):
    return tokens.withColumn("loss", -F.col(logp) * F.col(adv))


@policy_loss("gspo")
def _gspo(tokens, row, t, logp, old, adv, mask, **clip):
    return gspo(tokens, row, logp, old, adv, mask, **clip)


@policy_loss("clip_cov")
def _clip_cov(tokens, row, t, logp, old, adv, mask, **settings):
    return clip_cov_loss(tokens, logp, old, adv, mask, row, t, **settings)


@policy_loss("kl_cov")
def _kl_cov(tokens, row, t, logp, old, adv, mask, **settings):
    return kl_cov_loss(tokens, logp, old, adv, mask, row, t, **settings)


def kl_cov_top(tokens: DataFrame, logp: str, adv: str, mask: str, ratio: float, *order: str) -> DataFrame:
    """The max(1, int(N ratio)) masked tokens of largest covariance (ties by ``order``)."""
    t = clip_cov_band(tokens.where(F.col(mask) != 0), logp, adv, mask, 0.0, 0.0).drop("in_band")
    from .selection import smallest

    return smallest(t, max(1, int(t.count() * ratio)), F.col("cov"), *order, largest=True)


def value_loss(pred: Column, old: Column, ret: Column, clip: float) -> tuple[Column, Column]:
    """(clipped value loss, clipped indicator) of a token."""
    near = F.greatest(F.least(pred, old + clip), old - clip)
    a, b = (pred - ret) * (pred - ret), (near - ret) * (near - ret)
    return F.greatest(a, b), (b > a).cast("double")


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (most - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def reward_at_end(width: Column, length: Column, reward: Column) -> Column:
    """An array of zeros with the reward at the last valid position."""
    return F.transform(F.sequence(F.lit(0), width.cast("int") - 1), lambda i: F.when(i == length - 1, reward).otherwise(0.0))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def preference_loss(kind: str, chosen: Column, rejected: Column, *, beta: float = 0.1, gamma: float = 0.5, ref_chosen: Column | None = None, ref_rejected: Column | None = None) -> Column:
    """``simpo``, ``orpo`` (from mean log-probs) and ``dpo`` (with reference log-probs)."""
    if kind == "simpo":
        return -log_sigmoid(beta * (chosen - rejected - gamma / beta))
    if kind == "orpo":
        odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
        return -chosen + beta * -log_sigmoid(odds)
    if kind == "dpo":
        return -log_sigmoid(beta * ((chosen - ref_chosen) - (rejected - ref_rejected)))
    if kind == "bco":
        # gamma is the running mean of both answers' rewards (bco_baseline)
        return -log_sigmoid(beta * (chosen - ref_chosen) - gamma) - log_sigmoid(-(beta * (rejected - ref_rejected) - gamma))
    raise NotImplementedError(f"unknown preference loss {kind!r}")


def bco_baseline(rows: DataFrame, batch: str, chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> DataFrame:
    """``batch, baseline``: after each batch, the mean of the batches' mean rewards weighted by their numbers of rewards,
    batches in order (one row a batch)."""
    reward = (beta * (chosen - ref_chosen) + beta * (rejected - ref_rejected)) / 2
    per = rows.groupBy(batch).agg(F.avg(reward).alias("__m"), F.lit(1.0).alias("__one"))
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a batch
    return per.select(batch, (F.sum("__m").over(w) / F.sum("__one").over(w)).alias("baseline"))


def resample_weights(kind: str, score: Column, hi: Column, lo: Column, power: float = 2.0) -> Column:
    """Importance-resampling weights: ``pow`` |s|^p, ``max_min`` 1 at the extremes else 0, ``max_random`` 0.4 at
    the maximum else 0.1; each plus 1e-8."""
    if kind == "pow":
        w = F.pow(F.abs(score), F.lit(power))
    elif kind == "max_min":
        w = F.when((score == hi) | (score == lo), 1.0).otherwise(0.0)
    elif kind == "max_random":
        w = F.when(score == hi, 0.4).otherwise(0.1)
    else:
        raise NotImplementedError(f"unknown weighting {kind!r}")
    return w + 1e-8
