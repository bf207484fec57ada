"""Validation metrics, group advantages and aggregations over rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advantages, metrics, sampling
from .catalogue import query
from .views import ROLLOUTS, rollouts, table


def R(c: str):  # noqa: N802
    """Six decimals: sums of floats depend on their order."""
    return F.round(F.col(c), 6).alias(c)


def _advantage(name: str, places: int = 6, **settings):
    def run(spark, d):
        r = rollouts(spark, d)
        return advantages.estimate(name, r, **settings).select("row", F.round(F.col("advantage") + (3e-7 if places < 6 else 0.0), places).alias("advantage"))  # off the rounding edge of the input's two decimals

    return run


@query("val_mean_std", f"""
WITH {ROLLOUTS}, p AS (SELECT source, uid, count(score) AS n, avg(score) AS m, stddev_pop(score) AS s FROM rollouts GROUP BY 1, 2),
l AS (SELECT source, 'mean@' || n AS metric, m AS v FROM p UNION ALL SELECT source, 'std@' || n, s FROM p WHERE n > 1)
SELECT source, metric, count(*) AS uids, round(avg(v), 6) AS value FROM l GROUP BY 1, 2""")
def val_mean_std(spark, d):
    return metrics.mean_and_std(rollouts(spark, d), "source", "uid", "score").select("source", "metric", "uids", R("value"))


@query("val_majority", f"""
WITH {ROLLOUTS}, v AS (SELECT source, uid, pred, count(*) AS votes, min(row) AS f, min_by(score, row) AS vote_value FROM rollouts GROUP BY 1, 2, 3)
SELECT source, uid, pred AS vote, votes, vote_value FROM (SELECT *, row_number() OVER (PARTITION BY source, uid ORDER BY votes DESC, f) AS rn FROM v) WHERE rn = 1""")
def val_majority(spark, d):
    return metrics.majority(rollouts(spark, d), ["source", "uid"], "row", "pred", "score")


@query("val_bootstrap")
def val_bootstrap(spark, d):
    return metrics.bootstrap_best(rollouts(spark, d), ["source", "uid"], "row", "score")


@query("val_expected_max", f"""
WITH {ROLLOUTS}, r AS (SELECT source, uid, score, row_number() OVER (PARTITION BY source, uid ORDER BY score) AS i, count(*) OVER (PARTITION BY source, uid) AS n FROM rollouts)
SELECT source, uid, round(sum(score * (pow(i / n, 4) - pow((i - 1) / n, 4))), 6) AS expected_best,
       round(sum(score * (pow((n - i + 1) / n, 4) - pow((n - i) / n, 4))), 6) AS expected_worst FROM r GROUP BY 1, 2""")
def val_expected_max(spark, d):
    return metrics.expected_best(rollouts(spark, d), ["source", "uid"], "score", 4).select("source", "uid", R("expected_best"), R("expected_worst"))


@query("reduce_metrics", """
WITH u AS (SELECT unnest(['loss', 'max_price', 'min_tax', 'discount_min_max']) AS name, unnest([l_quantity, l_extendedprice, l_tax, l_discount]) AS value FROM lineitem)
SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM u GROUP BY name""")
def reduce_metrics(spark, d):
    l = table(spark, d, "lineitem")
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("loss", "l_quantity"), ("max_price", "l_extendedprice"), ("min_tax", "l_tax"), ("discount_min_max", "l_discount"))))
    return metrics.reduce_by_name(l.select(F.explode(pairs).alias("x")).select("x.*")).select("name", R("value"))


def _group_sql(expr: str, places: int = 6) -> str:
    return f"WITH {ROLLOUTS}, g AS (SELECT *, avg(score) OVER w AS mu, stddev_samp(score) OVER w AS sd, count(score) OVER w AS n, sum(length * score) OVER w AS ls, sum(length) OVER w AS l FROM rollouts WINDOW w AS (PARTITION BY uid)) SELECT row, round({expr}, {places}) AS advantage FROM g"


query("adv_grpo", _group_sql("(score - CASE WHEN n > 1 THEN mu ELSE 0 END) / (CASE WHEN n > 1 THEN sd ELSE 1 END + 1e-6)"))(_advantage("grpo"))
query("adv_drgrpo", _group_sql("score - CASE WHEN n > 1 THEN mu ELSE 0 END + 3e-7", 4))(_advantage("grpo", places=4, by_std=False))
query("adv_rloo", _group_sql("CASE WHEN n > 1 THEN score * n / (n - 1) - mu * n / (n - 1) ELSE score END"))(_advantage("rloo"))
query("adv_opo", _group_sql("CASE WHEN n > 1 THEN score - ls / l ELSE score END"))(_advantage("opo"))
query("adv_gpg", _group_sql("(SELECT count(*) / greatest(1, count(*) FILTER (score <> 0)) FROM rollouts) * (score - CASE WHEN n > 1 THEN mu ELSE 0 END) + 3e-7", 4))(_advantage("gpg", places=4))
query("adv_passk", f"""
WITH {ROLLOUTS}, g AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row) AS k, stddev_samp(score) OVER (PARTITION BY uid) AS sd, nth_value(score, 2) OVER (PARTITION BY uid ORDER BY score DESC, row ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM rollouts)
SELECT row, round(CASE WHEN k = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END, 6) AS advantage FROM g""")(_advantage("grpo_passk"))
query("adv_rfpp_baseline", f"""
WITH {ROLLOUTS}, c AS (SELECT row, length AS m, score - avg(score) OVER (PARTITION BY uid) AS x, count(*) OVER (PARTITION BY uid) AS n, score FROM rollouts), d AS (SELECT row, m, CASE WHEN n > 1 THEN x ELSE score END AS x FROM c),
s AS (SELECT sum(m * x) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM d), v AS (SELECT any_value(mean) AS mean, sum(m * (x - mean) * (x - mean)) / (any_value(s.n) + 1e-8) * any_value(s.n) / (any_value(s.n) - 1) AS var FROM d, s)
SELECT row, round((x - mean) / sqrt(var + 1e-8), 6) AS advantage FROM d, v""")(_advantage("reinforce_plus_plus_baseline"))


@query("data_metrics", f"""
WITH {ROLLOUTS}, t AS (SELECT *, CASE WHEN row % 10 = 0 THEN 0 ELSE length END AS len FROM rollouts), x AS (SELECT max(len) AS top FROM t)
SELECT round(avg(CASE WHEN len > 0 THEN score END), 6) AS score_mean, max(CASE WHEN len > 0 THEN score END) AS score_max, min(CASE WHEN len > 0 THEN score END) AS score_min,
 round(avg(CAST(len AS DOUBLE)), 6) AS length_mean, max(CAST(len AS DOUBLE)) AS length_max, min(CAST(len AS DOUBLE)) AS length_min,
 round(avg(CASE WHEN len > 0 THEN 0.0 ELSE 1.0 END), 6) AS aborted_ratio, round(count(*) FILTER (len = (SELECT top FROM x)) / count(*), 6) AS clip_ratio FROM t""")
def data_metrics(spark, d):
    t = rollouts(spark, d).withColumn("len", F.when(F.col("row") % 10 == 0, 0).otherwise(F.col("length")))
    m = metrics.sequence_metrics(t, score="score", length="len")
    return m.select(R("score_mean"), "score_max", "score_min", R("length_mean"), "length_max", "length_min", R("aborted_ratio"), R("clip_ratio"))


@query("timing_metrics", """
WITH t AS (SELECT event_type AS name, sum(value) AS seconds FROM events GROUP BY 1), n AS (SELECT sum(length(props)) AS r, sum(length(props) + length(event_type)) AS a FROM events)
SELECT name, round(seconds, 6) AS seconds, round(seconds * 1000 / CASE WHEN name = 'click' THEN r ELSE a END, 6) AS ms_per_token FROM t, n""")
def timing_metrics(spark, d):
    e = table(spark, d, "events")
    r, a = e.agg(F.sum(F.length("props")), F.sum(F.length("props") + F.length("event_type"))).first()
    t = e.groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("seconds"))
    return metrics.timing_metrics(t, r, a, gen="click").select("name", R("seconds"), R("ms_per_token"))


@query("throughput", f"WITH {ROLLOUTS} SELECT CAST(sum(length) AS BIGINT) AS total_tokens, CAST(12.5 AS DOUBLE) AS seconds, round(sum(length) / (12.5 * 8), 6) AS tokens_per_device_second FROM rollouts")
def throughput(spark, d):
    return metrics.throughput(rollouts(spark, d), "length", 12.5, 8).select("total_tokens", "seconds", R("tokens_per_device_second"))


@query("eval_by_source", f"""
WITH {ROLLOUTS}, r AS (SELECT source, uid, avg(score) AS m FROM rollouts GROUP BY 1, 2) SELECT source, round(avg(m), 6) AS test_score FROM r GROUP BY 1""")
def eval_by_source(spark, d):
    g = rollouts(spark, d).groupBy("source", "uid").agg(F.collect_list("score").alias("scores"))
    return metrics.by_source(g, "source", "scores").select("source", R("test_score"))


@query("category_accuracy", """
SELECT CASE WHEN grouping(lang) = 1 THEN 'Average' ELSE lang END AS category, count(*) AS n, round(avg(CAST(quality = 1 AS DOUBLE)) * 100, 2) AS accuracy
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def category_accuracy(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").withColumn("ok", F.col("quality") == 1)
    return metrics.accuracy_by_category(j, "lang", "ok")


@query("slowest_row", f"""
WITH {ROLLOUTS}, b AS (SELECT row, score, length FROM rollouts ORDER BY score + length DESC, row LIMIT 1)
SELECT min(r.score) AS score_min, max(r.score) AS score_max, round(avg(r.score), 6) AS score_mean, min(r.length) AS length_min, max(r.length) AS length_max, round(avg(r.length), 6) AS length_mean,
 any_value(b.row) AS slowest_row, any_value(b.score) AS slowest_score, any_value(b.length) AS slowest_length FROM rollouts r, b""")
def slowest_row(spark, d):
    s = metrics.slowest(rollouts(spark, d), "score", "length", "row")
    return s.withColumn("score_mean", F.round("score_mean", 6)).withColumn("length_mean", F.round("length_mean", 6))


@query("imbalance", f"""
WITH {ROLLOUTS}, a AS (SELECT sum(length) AS s FROM rollouts GROUP BY row % 8), b AS (SELECT sum(length) AS s FROM rollouts GROUP BY uid % 8)
SELECT CAST((SELECT min(s) FROM a) AS BIGINT) AS min, CAST((SELECT max(s) FROM a) AS BIGINT) AS max, round((SELECT avg(s) FROM a), 6) AS mean, CAST((SELECT min(s) FROM b) AS BIGINT) AS balanced_min, CAST((SELECT max(s) FROM b) AS BIGINT) AS balanced_max, CAST((SELECT max(s) - min(s) FROM a) AS BIGINT) AS minmax_diff""")
def imbalance(spark, d):
    r = rollouts(spark, d).withColumn("p", F.col("row") % 8).withColumn("b", F.col("uid") % 8)
    return metrics.imbalance(r, "p", "length", "b").withColumn("mean", F.round("mean", 6))


@query("preference_metrics", f"""
WITH {ROLLOUTS}, p AS (SELECT uid, max(score) AS c, avg(score) * 1.5 AS r FROM rollouts GROUP BY uid)
SELECT round(avg(CAST(c > r AS DOUBLE)), 6) AS accuracy, round(avg(c), 6) AS chosen, round(avg(r), 6) AS rejected, round(avg(c - r), 6) AS margin FROM p""")
def preference_metrics(spark, d):
    p = rollouts(spark, d).groupBy("uid").agg(F.max("score").alias("c"), (F.avg("score") * 1.5).alias("r"))
    return metrics.preference_accuracy(p, "c", "r").select(R("accuracy"), R("chosen"), R("rejected"), R("margin"))


@query("kto_metrics", f"""
WITH {ROLLOUTS}, s AS (SELECT CASE WHEN length % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, score AS v FROM rollouts WHERE row % 11 <> 0)
SELECT round(avg(v) FILTER (side = 'chosen'), 6) AS chosen, round(avg(v) FILTER (side = 'rejected'), 6) AS rejected, count(*) FILTER (side = 'chosen') AS n_chosen, count(*) FILTER (side = 'rejected') AS n_rejected,
 round(avg(v) FILTER (side = 'chosen') - avg(v) FILTER (side = 'rejected'), 6) AS margin FROM s""")
def kto_metrics(spark, d):
    r = rollouts(spark, d).withColumn("side", F.when(F.col("length") % 2 == 0, "chosen").otherwise("rejected")).withColumn("v", F.when(F.col("row") % 11 == 0, float("nan")).otherwise(F.col("score")))
    return metrics.partial_sums(r, "side", "v").select(R("chosen"), R("rejected"), "n_chosen", "n_rejected", R("margin"))


@query("mean_of_means", f"WITH {ROLLOUTS}, r AS (SELECT avg(score) AS m FROM rollouts GROUP BY uid % 8) SELECT round(avg(m), 6) AS mean_of_means FROM r")
def mean_of_means(spark, d):
    return metrics.two_level_mean(rollouts(spark, d).withColumn("rank", F.col("uid") % 8), "rank", "score").select(R("mean_of_means"))


@query("tail_ratio", f"""
WITH {ROLLOUTS}, c AS (SELECT quantile_cont(score, 0.9) AS cut, sum(score) AS total FROM rollouts)
SELECT round(any_value(cut), 6) AS cut, round(sum(score) FILTER (score >= cut) / any_value(total), 6) AS tail_share, round(avg(score), 6) AS mean FROM rollouts, c""")
def tail_ratio(spark, d):
    return metrics.tail_ratio(rollouts(spark, d), "score", 0.1).select(R("cut"), R("tail_share"), R("mean"))


@query("flops_estimate", f"WITH {ROLLOUTS} SELECT round((6 * 5e8 * sum(length) + 12 * sum(length * length) * 64.0 * 14 * 24) / 10 / 1e12, 6) AS tflops, round(sum(length * 2) * 3 / 100 / 8, 6) AS effective FROM rollouts")
def flops_estimate(spark, d):
    r = rollouts(spark, d)
    a = metrics.flops_estimate(r, "length", params=5e8, head_dim=64, heads=14, layers=24, seconds=10)
    return a.crossJoin(metrics.effective_tokens_per_second(r, ["length", "length"], 3, 100, 8)).select(R("tflops"), F.round("effective_tokens_per_second", 6).alias("effective"))


@query("weighted_mean", f"WITH {ROLLOUTS} SELECT round(sum(score * length) / sum(length), 6) AS weighted_mean FROM rollouts")
def weighted_mean(spark, d):
    return metrics.weighted_mean(rollouts(spark, d), "score", "length").select(R("weighted_mean"))


@query("status_lists", f"""
WITH {ROLLOUTS} SELECT uid, array_to_string(list_sort(list(row)), ',') AS all_ids, coalesce(array_to_string(list_sort(list(row) FILTER (source = 'click')), ','), '') AS running,
 coalesce(array_to_string(list_sort(list(row) FILTER (source = 'view')), ','), '') AS expanded, coalesce(array_to_string(list_sort(list(row) FILTER (source IN ('error', 'view'))), ','), '') AS terminal FROM rollouts GROUP BY uid""")
def status_lists(spark, d):
    r = rollouts(spark, d).withColumn("status", F.when(F.col("source") == "click", "running").when(F.col("source") == "view", "expanded").otherwise(F.col("source")))
    s = metrics.status_lists(r, "uid", "row", "status", ["error", "expanded"])
    return s.select("uid", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("all_ids", "running", "expanded", "terminal")))


@query("kto_shift", f"""
WITH {ROLLOUTS}, b AS (SELECT row, pred, row // 1000 AS k FROM rollouts)
SELECT row, coalesce(lag(pred) OVER (PARTITION BY k ORDER BY row), last_value(pred) OVER (PARTITION BY k ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl_response FROM b""")
def kto_shift(spark, d):
    return advantages.shifted_pairs(rollouts(spark, d), "row", "pred").select("row", "kl_response")


@query("rollout_n", f"""
WITH {ROLLOUTS}, n AS (SELECT uid, row, source, CASE WHEN lag(source) OVER (PARTITION BY uid ORDER BY row) = source THEN 0 ELSE 1 END AS new FROM rollouts),
g AS (SELECT uid, row, sum(new) OVER (PARTITION BY uid ORDER BY row ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT row, row_number() OVER (PARTITION BY uid, run ORDER BY row) - 1 AS rollout_n FROM g""")
def rollout_n(spark, d):
    return advantages.run_numbers(rollouts(spark, d), "uid", "row", "source").select("row", F.col("rollout_n").cast("long").alias("rollout_n"))


@query("tool_necessity", f"""
WITH {ROLLOUTS} SELECT row, count(*) FILTER (length % 2 = 0) OVER w AS with_tool, round(avg(score) FILTER (length % 2 = 0) OVER w, 6) AS acc_with_tool, round(avg(score) FILTER (length % 2 <> 0) OVER w, 6) AS acc_without_tool,
 count(*) FILTER (length % 2 <> 0 AND score > 0) OVER w AS correct_without_tool FROM rollouts WINDOW w AS (PARTITION BY uid)""")
def tool_necessity(spark, d):
    r = advantages.tool_necessity(rollouts(spark, d).withColumn("used", F.col("length") % 2 == 0), "uid", "score", "used")
    return r.select("row", "with_tool", R("acc_with_tool"), R("acc_without_tool"), "correct_without_tool")


@query("improvement_penalty", f"WITH {ROLLOUTS} SELECT row, CASE WHEN score > lag(score, 1, 0) OVER (PARTITION BY uid ORDER BY row) THEN CAST(0.0 AS DOUBLE) ELSE CAST(-0.05 AS DOUBLE) END AS penalty FROM rollouts")
def improvement_penalty(spark, d):
    return advantages.improvement_penalty(rollouts(spark, d), "uid", "row", "score").select("row", "penalty")


@query("loss_smoothing", f"""
WITH RECURSIVE {ROLLOUTS}, s AS (SELECT source, uid, score, row_number() OVER (PARTITION BY source, uid ORDER BY row) AS i, count(*) OVER (PARTITION BY source, uid) AS n FROM rollouts),
w AS (SELECT *, 1.8 * (1 / (1 + exp(-0.05 * n)) - 0.5) AS w FROM s), r AS (SELECT source, uid, i, score AS v FROM w WHERE i = 1 UNION ALL SELECT w.source, w.uid, w.i, r.v * w.w + (1 - w.w) * w.score FROM r JOIN w ON w.source = r.source AND w.uid = r.uid AND w.i = r.i + 1)
SELECT source, uid, round(max_by(v, i), 6) AS smoothed FROM r GROUP BY 1, 2""")
def loss_smoothing(spark, d):
    g = rollouts(spark, d).groupBy("source", "uid").agg(F.array_sort(F.collect_list(F.struct("row", "score"))).alias("s"))
    return g.select("source", "uid", F.round(F.element_at(advantages.smooth(F.col("s.score")), -1), 6).alias("smoothed"))


@query("progress", f"""
WITH {ROLLOUTS}, p AS (SELECT max(row) AS done, sum(score) AS elapsed FROM rollouts), l AS (SELECT done, CAST(trunc((1000000 - done) * elapsed / done) AS BIGINT) AS s FROM p)
SELECT done, round(done / 1000000 * 100, 2) AS percentage, CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS remaining FROM l""")
def progress(spark, d):
    return advantages.progress(rollouts(spark, d), "row", "score", 1_000_000)


@query("resample_weights", f"""
WITH {ROLLOUTS}, x AS (SELECT max(score) AS hi, min(score) AS lo FROM rollouts)
SELECT row, round(pow(abs(score), 2) + 1e-8, 6) AS pow_weight, CASE WHEN score = hi OR score = lo THEN CAST(1.0 AS DOUBLE) ELSE 0.0 END + 1e-8 AS max_min_weight, CASE WHEN score = hi THEN CAST(0.4 AS DOUBLE) ELSE 0.1 END + 1e-8 AS max_random_weight FROM rollouts, x""")
def resample_weights(spark, d):
    from ..operators.losses import resample_weights as weight

    r = rollouts(spark, d)
    x = r.crossJoin(F.broadcast(r.agg(F.max("score").alias("hi"), F.min("score").alias("lo"))))
    s, hi, lo = F.col("score"), F.col("hi"), F.col("lo")
    return x.select("row", F.round(weight("pow", s, hi, lo), 6).alias("pow_weight"), weight("max_min", s, hi, lo).alias("max_min_weight"), weight("max_random", s, hi, lo).alias("max_random_weight"))


@query("preferred_sample", f"WITH {ROLLOUTS} SELECT row, source FROM rollouts ORDER BY (source = 'error') DESC, md5('42|' || row), row LIMIT 3000")
def preferred_sample(spark, d):
    return sampling.preferred_sample(rollouts(spark, d), F.col("source") == "error", 3000, 42, "row").select("row", "source")
