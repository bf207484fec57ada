"""Losses, returns and masks over the token matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advantages, losses, metrics
from .catalogue import query
from .metric_queries import R
from .views import TOKENS, tokens

_WHITE = "s AS (SELECT sum(m * x) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM x), v AS (SELECT any_value(mean) AS mean, sum(m * (x - mean) * (x - mean)) / (any_value(s.n) + 1e-8) * any_value(s.n) / (any_value(s.n) - 1) AS var FROM x, s)"


@query("returns_remax", f"""
WITH {TOKENS}, r AS (SELECT row, t, mask, sum(reward * mask) OVER (PARTITION BY row ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM tokens)
SELECT row, t, round(ret, 6) AS returns, round(ret - 0.1 * mask, 6) AS advantage FROM r""")
def returns_remax(spark, d):
    r = advantages.remax(tokens(spark, d).withColumn("baseline", F.lit(0.1)))
    return r.select("row", "t", R("returns"), R("advantage"))


@query("returns_rfpp", f"""
WITH RECURSIVE {TOKENS}, z AS (SELECT *, max(t) OVER (PARTITION BY row) AS last FROM tokens),
r AS (SELECT row, t, mask, reward AS ret FROM z WHERE t = last UNION ALL SELECT z.row, z.t, z.mask, z.reward + 0.9 * r.ret * r.mask FROM r JOIN z ON z.row = r.row AND z.t = r.t - 1),
x AS (SELECT row, t, mask AS m, ret AS x FROM r), {_WHITE} SELECT row, t, round(x, 6) AS returns, round((x - mean) / sqrt(var + 1e-8) * m, 6) AS advantage FROM x, v""")
def returns_rfpp(spark, d):
    return advantages.rfpp(tokens(spark, d), gamma=0.9).select("row", "t", R("returns"), R("advantage"))


@query("adv_gae", f"""
WITH RECURSIVE {TOKENS}, z AS (SELECT *, max(t) OVER (PARTITION BY row) AS last FROM tokens),
r AS (SELECT row, t, mask, value, CASE WHEN mask = 1 THEN value ELSE 0 END AS nv, CASE WHEN mask = 1 THEN reward - value ELSE 0 END AS a FROM z WHERE t = last
 UNION ALL SELECT z.row, z.t, z.mask, z.value, CASE WHEN z.mask = 1 THEN z.value ELSE r.nv END, CASE WHEN z.mask = 1 THEN z.reward + 0.9 * r.nv - z.value + 0.9 * 0.8 * r.a ELSE r.a END FROM r JOIN z ON z.row = r.row AND z.t = r.t - 1),
x AS (SELECT row, t, mask AS m, a AS x, a + value AS ret FROM r), {_WHITE} SELECT row, t, round(x, 6) AS gae, round(ret, 6) AS returns, round((x - mean) / sqrt(var + 1e-8), 6) AS advantage FROM x, v""")
def adv_gae(spark, d):
    return advantages.gae_tokens(tokens(spark, d), gamma=0.9, lam=0.8).select("row", "t", R("gae"), R("returns"), R("advantage"))


@query("response_mask", f"""
WITH {TOKENS} SELECT row, t, CAST(coalesce(sum(CAST(reward > 0.08 AS INTEGER)) OVER (PARTITION BY row ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS INTEGER) AS response_mask FROM tokens""")
def response_mask(spark, d):
    return advantages.response_mask(tokens(spark, d), "row", "t", F.col("reward") > 0.08).select("row", "t", "response_mask")


@query("position_ids", f"WITH {TOKENS} SELECT row, t, CAST(greatest(sum(mask) OVER (PARTITION BY row ORDER BY t ROWS UNBOUNDED PRECEDING) - 1, 0) AS BIGINT) AS position FROM tokens")
def position_ids(spark, d):
    s = advantages.sequences(tokens(spark, d), "row", "t", "t", "mask")
    return s.select("row", F.explode(F.arrays_zip("t", advantages.position_ids(F.col("mask")).alias("p"))).alias("x")).select("row", "x.t", F.col("x.p").alias("position"))


@query("whiten_values", f"WITH {TOKENS}, x AS (SELECT row, t, mask AS m, value AS x FROM tokens), {_WHITE} SELECT row, t, round((x - mean) / sqrt(var + 1e-8) + mean, 6) AS whitened FROM x, v")
def whiten_values(spark, d):
    return advantages.whiten(tokens(spark, d), "value", "mask", shift_mean=False).select("row", "t", R("whitened"))


@query("loss_modes", f"""
WITH {TOKENS}, p AS (SELECT row, sum(value * mask) AS s, sum(mask) AS n, count(*) AS w FROM tokens GROUP BY row),
a AS (SELECT sum(s) / sum(n) AS a, avg(s) AS b, avg(CASE WHEN n > 0 THEN s / n END) AS c, sum(s) / max(w) AS d FROM p)
SELECT unnest(['token-mean', 'seq-mean-token-sum', 'seq-mean-token-mean', 'seq-mean-token-sum-norm']) AS mode, round(unnest([a, b, c, d]), 6) AS value FROM a""")
def loss_modes(spark, d):
    return losses.reduce_loss(tokens(spark, d), "row", "value", "mask").select("mode", R("value"))


@query("kl_estimators", f"""
WITH {TOKENS}, k AS (SELECT row, t, logp - old_logp AS d FROM tokens)
SELECT row, t, round(d, 6) AS k1, round(abs(d), 6) AS abs_kl, round(0.5 * d * d, 6) AS k2, round(greatest(least(exp(greatest(least(-d, 20), -20)) + greatest(least(d, 20), -20) - 1, 10), -10), 6) AS k3 FROM k""")
def kl_estimators(spark, d):
    a, b = F.col("logp"), F.col("old_logp")
    return tokens(spark, d).select("row", "t", *(F.round(losses.kl(k, a, b), 6).alias(n) for k, n in (("k1", "k1"), ("abs", "abs_kl"), ("k2", "k2"), ("k3", "k3"))))


@query("kl_penalised_reward", f"""
WITH {TOKENS}, p AS (SELECT row, sum(abs(logp - old_logp) * mask) / (sum(mask) + 1e-8) AS k, sum(reward - 0.05 * abs(logp - old_logp) * mask) AS s FROM tokens GROUP BY row)
SELECT row, round(s, 6) AS penalised, round(k, 6) AS kl, round((SELECT avg(k) FROM p), 6) AS current_kl FROM p""")
def kl_penalised_reward(spark, d):
    t = tokens(spark, d).withColumn("k", losses.kl("abs", F.col("logp"), F.col("old_logp")))
    s = advantages.sequences(t, "row", "t", "reward", "k", "mask")
    per = s.select("row", F.round(F.aggregate(losses.kl_penalty(F.col("reward"), F.col("k"), F.col("mask"), 0.05), F.lit(0.0), lambda a, x: a + x), 6).alias("penalised"))
    kls = t.groupBy("row").agg(F.round(F.sum(F.col("k") * F.col("mask")) / (F.sum("mask") + 1e-8), 6).alias("kl"))
    return per.join(kls, "row").crossJoin(F.broadcast(losses.mean_kl(t, "row", "k", "mask"))).select("row", "penalised", "kl", R("current_kl"))


@query("ppo_dualclip", f"""
WITH {TOKENS}, r AS (SELECT row, t, mask, adv, exp(greatest(least(logp - old_logp, 20), -20)) AS ratio FROM tokens), l AS (SELECT row, mask, adv, greatest(-adv * ratio, -adv * greatest(least(ratio, 1.02), 0.98)) AS p, CAST(-adv * greatest(least(ratio, 1.02), 0.98) > -adv * ratio AS DOUBLE) AS c, CAST(greatest(-adv * ratio, -adv * greatest(least(ratio, 1.02), 0.98)) > -adv * 1.01 AND adv < 0 AS DOUBLE) AS low FROM r)
SELECT row, round(sum(CASE WHEN adv < 0 THEN least(-adv * 1.01, p) ELSE p END * mask), 6) AS loss, round(sum(c * mask), 6) AS clipped, round(sum(low * mask), 6) AS dual_clipped FROM l GROUP BY row""")
def ppo_dualclip(spark, d):
    a = (F.col("logp"), F.col("old_logp"), F.col("adv"))
    clipped, dual = losses.clip_fractions(*a, low=0.02, high=0.02, dual=1.01)
    t = tokens(spark, d).select("row", "mask", losses.clipped_policy(*a, low=0.02, high=0.02, dual=1.01).alias("l"), clipped.alias("c"), dual.alias("d"))
    return t.groupBy("row").agg(*(F.round(F.sum(F.col(c) * F.col("mask")), 6).alias(n) for c, n in (("l", "loss"), ("c", "clipped"), ("d", "dual_clipped"))))


@query("gspo", f"""
WITH {TOKENS}, q AS (SELECT *, exp(least(sum((logp - old_logp) * mask) OVER (PARTITION BY row) / greatest(sum(mask) OVER (PARTITION BY row), 1), 10)) AS r FROM tokens), l AS (SELECT row, mask, greatest(-adv * r, -adv * greatest(least(r, 1.0004), 0.9997)) AS loss FROM q), p AS (SELECT row, sum(loss * mask) AS s, sum(mask) AS n FROM l GROUP BY row)
SELECT round(avg(CASE WHEN n > 0 THEN s / n END), 6) AS loss FROM p""")
def gspo(spark, d):
    t = losses.gspo(tokens(spark, d), "row", "logp", "old_logp", "adv", "mask")
    return losses.reduce_loss(t, "row", "loss", "mask").where("mode = 'seq-mean-token-mean'").select(F.round("value", 6).alias("loss"))


@query("gmpo", f"""
WITH {TOKENS}, u AS (SELECT *, sign(adv) AS s, logp - old_logp AS d FROM tokens), m AS (SELECT row, mask, adv, s * least(s * d, s * greatest(least(d, 0.02), -0.02)) AS x FROM u)
SELECT row, round(-(sum(adv * mask) / (sum(mask) + 1e-8)) * exp(sum(x * mask) / (sum(mask) + 1e-8)), 6) AS loss FROM m GROUP BY row""")
def gmpo(spark, d):
    return losses.geo_mean(tokens(spark, d), "row", "logp", "old_logp", "adv", "mask", 0.02, 0.02).select("row", R("loss"))


@query("value_loss", f"""
WITH {TOKENS}, n AS (SELECT mask, (reward - logp) * (reward - logp) AS a, (greatest(least(reward, value + 0.01), value - 0.01) - logp) * (greatest(least(reward, value + 0.01), value - 0.01) - logp) AS b FROM tokens)
SELECT round(0.5 * sum(greatest(a, b) * mask) / sum(mask), 6) AS loss, round(sum(CAST(b > a AS INTEGER) * mask) / sum(mask), 6) AS clipped FROM n""")
def value_loss(spark, d):
    l, c = losses.value_loss(F.col("reward"), F.col("value"), F.col("logp"), 0.01)
    t = tokens(spark, d).select("mask", l.alias("l"), c.alias("c"))
    return t.agg(F.round(0.5 * F.sum(F.col("l") * F.col("mask")) / F.sum("mask"), 6).alias("loss"), F.round(F.sum(F.col("c") * F.col("mask")) / F.sum("mask"), 6).alias("clipped"))


@query("clip_cov_band", f"""
WITH {TOKENS}, s AS (SELECT avg(adv) AS a, avg(logp) AS l FROM tokens WHERE mask = 1), c AS (SELECT mask, (adv - a) * (logp - l) AS cov FROM tokens, s)
SELECT count(*) FILTER (mask = 1 AND cov > 0.001 AND cov < 0.005) AS in_band, round(avg(cov) FILTER (mask = 1), 6) AS mean_cov FROM c""")
def clip_cov_band(spark, d):
    t = losses.clip_cov_band(tokens(spark, d), "logp", "adv", "mask", 0.001, 0.005)
    return t.agg(F.count_if("in_band").alias("in_band"), F.round(F.avg(F.when(F.col("mask") == 1, F.col("cov"))), 6).alias("mean_cov"))


@query("kl_cov_top", f"""
WITH {TOKENS}, s AS (SELECT avg(adv) AS a, avg(logp) AS l FROM tokens WHERE mask = 1), c AS (SELECT (adv - a) * (logp - l) AS cov FROM tokens, s WHERE mask = 1), r AS (SELECT cov, row_number() OVER (ORDER BY cov DESC) AS k FROM c)
SELECT count(*) AS n, round(sum(cov), 4) AS total FROM r WHERE k <= greatest(1, CAST(floor((SELECT count(*) FROM c) * 0.01) AS BIGINT))""")
def kl_cov_top(spark, d):
    t = losses.kl_cov_top(tokens(spark, d), "logp", "adv", "mask", 0.01, "row", "t")
    return t.agg(F.count("*").alias("n"), F.round(F.sum("cov"), 4).alias("total"))


@query("preference_losses", f"""
WITH {TOKENS}, p AS (SELECT row, avg(logp) - 0.2 AS c, avg(old_logp) - 0.3 AS r FROM tokens GROUP BY row),
x AS (SELECT row, c, r, 2.0 * (c - r - 0.25) AS sp, 2.0 * (c - r + 0.05) AS dp, (c - r) - (ln(1 - exp(c)) - ln(1 - exp(r))) AS od FROM p)
SELECT row, round(ln(1 + exp(-sp)), 6) AS simpo, round(ln(1 + exp(-dp)), 6) AS dpo, round(-c + 2.0 * ln(1 + exp(-od)), 6) AS orpo FROM x""")
def preference_losses(spark, d):
    p = tokens(spark, d).groupBy("row").agg((F.avg("logp") - 0.2).alias("c"), (F.avg("old_logp") - 0.3).alias("r"))
    c, r = F.col("c"), F.col("r")
    return p.select("row", F.round(losses.preference_loss("simpo", c, r, beta=2.0, gamma=0.5), 6).alias("simpo"), F.round(losses.preference_loss("dpo", c, r, beta=2.0, ref_chosen=F.lit(-0.05), ref_rejected=F.lit(0.0)), 6).alias("dpo"), F.round(losses.preference_loss("orpo", c, r, beta=2.0), 6).alias("orpo"))


@query("logprob_drift", f"WITH {TOKENS}, t AS (SELECT exp(logp) AS a, exp(old_logp) AS b FROM tokens WHERE mask = 1) SELECT round(max(abs(a - b)), 6) AS max_diff, round(avg(abs(a - b)), 6) AS mean_diff, round(stddev_samp(abs(a - b)), 6) AS std_diff, round(corr(a, b), 6) AS pearson FROM t")
def logprob_drift(spark, d):
    return metrics.drift(tokens(spark, d), "logp", "old_logp", "mask").select(R("max_diff"), R("mean_diff"), R("std_diff"), R("pearson"))


@query("perplexity", f"WITH {TOKENS}, p AS (SELECT exp(sum(-logp * mask) / sum(mask)) AS ppl FROM tokens GROUP BY row HAVING sum(mask) > 0) SELECT count(ppl) AS rows, round(avg(ppl), 6) AS perplexity FROM p")
def perplexity(spark, d):
    t = tokens(spark, d).where("mask = 1").withColumn("nll", -F.col("logp"))
    return metrics.perplexity(t, "row", "nll", "mask").select("rows", R("perplexity"))


@query("token_accuracy", f"""
WITH {TOKENS}, z AS (SELECT row, t, CAST(reward * 100 AS INTEGER) % 3 AS p, CASE WHEN mask = 1 THEN CAST(value * 100 AS INTEGER) % 3 ELSE -100 END AS y, lag(CAST(reward * 100 AS INTEGER) % 3) OVER (PARTITION BY row ORDER BY t) AS prev FROM tokens)
SELECT row, round(avg(CAST(prev = y AS DOUBLE)) FILTER (t > 0 AND y <> -100), 6) AS accuracy, count(*) FILTER (p <> y AND y <> -100) AS mismatches FROM z GROUP BY row""")
def token_accuracy(spark, d):
    t = tokens(spark, d).withColumn("p", F.round(F.col("reward") * 100).cast("int") % 3).withColumn("y", F.when(F.col("mask") == 1, F.round(F.col("value") * 100).cast("int") % 3).otherwise(-100))
    s = advantages.sequences(t, "row", "t", "p", "y", "mask")
    return s.select("row", F.round(metrics.token_accuracy(F.col("p"), F.col("y")), 6).alias("accuracy"), metrics.mismatches(F.col("p"), F.col("y"), F.col("mask")).cast("long").alias("mismatches"))


@query("overlong_penalty", f"WITH {TOKENS}, l AS (SELECT row, count(*) AS n FROM tokens GROUP BY row) SELECT row, round(least(-(n - (12 - 8)) / 8 * 1.0, 0), 6) AS penalty FROM l")
def overlong_penalty(spark, d):
    l = tokens(spark, d).groupBy("row").agg(F.count("*").alias("n"))
    return l.select("row", F.round(losses.overlong_penalty(F.col("n"), 12, 8, 1.0), 6).alias("penalty"))


@query("adaptive_kl", f"""
WITH s AS (SELECT CAST(date_trunc('day', l_shipdate) AS DATE) AS day, avg(l_tax) AS kl, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, round(0.001 * exp(sum(ln(1 + greatest(least(kl / 0.04 - 1, 0.2), -0.2) * n / 100000)) OVER (ORDER BY day)), 9) AS coefficient FROM s""")
def adaptive_kl(spark, d):
    s = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_tax").alias("kl"), F.count("*").alias("n"))
    return losses.adaptive_coefficient(s, "day", "kl", "n", start=0.001, target=0.04, horizon=100000).select(F.col("day").cast("string").alias("day"), F.round("coefficient", 9).alias("coefficient"))


@query("clip_cov_draw", f"""
WITH {TOKENS}, a AS (SELECT avg(adv) FILTER (mask <> 0) AS a, avg(logp) FILTER (mask <> 0) AS l, CAST(sum(mask) AS BIGINT) AS n FROM tokens),
c AS (SELECT row, t, mask, -adv * exp(logp - old_logp) AS x, -adv * greatest(least(exp(logp - old_logp), 1.2), 0.8) AS y, (adv - a.a) * (logp - a.l) AS cov, a.n FROM tokens, a),
f AS (SELECT row, t, row_number() OVER (ORDER BY md5('3|' || row || '|' || t), row, t) AS k, n FROM c WHERE mask <> 0 AND cov > 0.0001 AND cov < 0.01 AND NOT y > x)
SELECT c.row, c.t, f.row IS NOT NULL AS dropped, round(CASE WHEN f.row IS NOT NULL THEN 0.0 ELSE greatest(x, y) END, 6) AS loss FROM c LEFT JOIN f ON f.row = c.row AND f.t = c.t AND f.k <= greatest(1, CAST(floor(f.n * 0.01) AS BIGINT))""")
def clip_cov_draw(spark, d):
    r = losses.token_losses("clip_cov", tokens(spark, d), ratio=0.01, cov_low=0.0001, cov_high=0.01, seed=3)
    return r.select("row", "t", "dropped", F.round("loss", 6).alias("loss"))


@query("kl_cov_loss", f"""
WITH {TOKENS}, a AS (SELECT avg(adv) FILTER (mask <> 0) AS a, avg(logp) FILTER (mask <> 0) AS l, CAST(floor(greatest(sum(mask) * 0.01, 1)) AS BIGINT) AS k FROM tokens),
c AS (SELECT tokens.*, CASE WHEN mask <> 0 THEN row_number() OVER (PARTITION BY mask <> 0 ORDER BY (adv - a.a) * (logp - a.l) DESC, row, t) <= a.k ELSE false END AS top FROM tokens, a)
SELECT row, t, round(-adv * exp(logp - old_logp) + CASE WHEN top THEN abs(logp - old_logp) ELSE 0 END, 6) AS loss FROM c""")
def kl_cov_loss(spark, d):
    return losses.token_losses("kl_cov", tokens(spark, d), ratio=0.01).select("row", "t", F.round("loss", 6).alias("loss"))


@query("importance_cap", f"WITH {TOKENS} SELECT row, t, round(-adv * logp, 6) AS gpg, round(CASE WHEN adv < 0 THEN least(-adv * 3, greatest(-adv * exp(logp - old_logp), -adv * greatest(least(exp(logp - old_logp), 1.2), 0.8))) ELSE greatest(-adv * exp(logp - old_logp), -adv * greatest(least(exp(logp - old_logp), 1.2), 0.8)) END * least(exp(old_logp - (old_logp - value)), 1.03), 6) AS loss FROM tokens")
def importance_cap(spark, d):
    t = tokens(spark, d).withColumn("sampled", F.col("old_logp") - F.col("value"))
    v = losses.token_losses("vanilla", t, rollout="sampled", cap=1.03)
    return v.select("row", "t", F.round(-F.col("logp") * F.col("adv"), 6).alias("gpg"), F.round("loss", 6).alias("loss"))


@query("masked_statistics", f"WITH {TOKENS}, m AS (SELECT * FROM tokens WHERE mask <> 0) SELECT avg(adv) AS adv_mean, max(adv) AS adv_max, min(adv) AS adv_min, avg(reward) AS reward_mean, max(reward) AS reward_max, min(reward) AS reward_min, 1 - var_samp(reward - value) / (var_samp(reward) + 1e-5) AS vf_explained_var FROM m")
def masked_statistics(spark, d):
    from ..operators import metrics

    return metrics.masked_statistics(tokens(spark, d), "mask", "adv", "reward", returns="reward", value="value")


@query("prompt_metrics", "SELECT avg(n_chars % 50) AS prompt_length_mean, max(n_chars % 50)::DOUBLE AS prompt_length_max, min(n_chars % 50)::DOUBLE AS prompt_length_min, avg(CAST(n_chars % 50 = 49 AS DOUBLE)) AS prompt_length_clip_ratio, avg(n_chars % 7) AS num_turns_mean, max(n_chars % 7)::DOUBLE AS num_turns_max, min(n_chars % 7)::DOUBLE AS num_turns_min FROM documents")
def prompt_metrics(spark, d):
    from ..operators import metrics
    from .views import table

    docs = table(spark, d, "documents").select((F.col("n_chars") % 50).alias("p"), (F.col("n_chars") % 7).alias("t"))
    return metrics.prompt_metrics(docs, "p", 49, "t")


@query("group_reducers", "SELECT user_id AS uid, max(value) AS best, median(value) AS middle FROM events GROUP BY 1")
def group_reducers(spark, d):
    from ..operators import metrics
    from .views import rollouts

    middle = metrics.whole_group(lambda x: float(x.median()))
    return metrics.group_reduced(rollouts(spark, d), ["uid"], "score", {"best": F.max, "middle": middle})


@query("bco_losses", """
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_orderkey // 1000 AS b, -l_discount AS c, -l_tax AS j, -l_quantity / 100 AS rc, -l_linenumber / 50.0::DOUBLE AS rj FROM lineitem),
m AS (SELECT b, avg((0.1 * (c - rc) + 0.1 * (j - rj)) / 2) AS m FROM r GROUP BY 1), d AS (SELECT b, avg(m) OVER (ORDER BY b) AS d FROM m)
SELECT k, n, p, s, round(ln(1 + exp(-(0.1 * (c - rc) - d))) + ln(1 + exp(0.1 * (j - rj) - d)), 6) AS loss FROM r JOIN d USING (b)""")
def bco_losses(spark, d):
    from .views import table

    l = table(spark, d, "lineitem")
    r = l.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.floor(F.col("l_orderkey") / 1000).alias("b"), (-F.col("l_discount")).alias("c"), (-F.col("l_tax")).alias("j"), (-F.col("l_quantity") / 100).alias("rc"), (-F.col("l_linenumber") / 50.0).alias("rj"))
    base = losses.bco_baseline(r, "b", *(F.col(x) for x in ("c", "j", "rc", "rj")))
    loss = losses.preference_loss("bco", F.col("c"), F.col("j"), gamma=F.col("baseline"), ref_chosen=F.col("rc"), ref_rejected=F.col("rj"))
    return r.join(base, "b").select("k", "n", "p", "s", F.round(loss, 6).alias("loss"))

