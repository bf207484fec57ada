"""Trajectory search, tool rewards, boxes and OCR over events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import ocr, toolreward, trajectory
from ..sources.scratch import written
from .catalogue import query
from .views import STEPS, steps, table


@query("frontier_topk", f"WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY suggestion_order, trajectory_id) AS n FROM steps) SELECT trajectory_id, parent_id, suggestion_order, parent_score FROM r WHERE n <= 20 ORDER BY (suggestion_order > 0), parent_score DESC, suggestion_order, trajectory_id LIMIT 500")
def frontier_topk(spark, d):
    return trajectory.frontier(steps(spark, d), 500, requested=20).select("trajectory_id", "parent_id", "suggestion_order", "parent_score")


@query("status_decide", f"WITH {STEPS} SELECT trajectory_id, CASE WHEN stage = 'error' THEN 'failed' WHEN suggestion_order = 3 THEN 'pruned' WHEN score < 25 THEN 'pruned' WHEN greatest(budget - 1, 0) <= 0 THEN 'max_step_reached' ELSE 'running' END AS status, greatest(budget - 1, 0) AS budget FROM steps")
def status_decide(spark, d):
    left = trajectory.child_budget(F.col("budget"))
    return steps(spark, d).select("trajectory_id", trajectory.next_status(F.col("stage") == "error", F.when(F.col("suggestion_order") == 3, " ").otherwise("x"), F.col("score") >= 25, left).alias("status"), left.alias("budget"))


@query("latest_judge", f"WITH {STEPS}, p AS (SELECT DISTINCT parent_id FROM steps), l AS (SELECT parent_id, max_by(score, trajectory_id) AS s FROM steps WHERE stage = 'click' GROUP BY 1) SELECT p.parent_id, coalesce(l.s, 0) AS latest_score FROM p LEFT JOIN l USING (parent_id)")
def latest_judge(spark, d):
    s = steps(spark, d)
    return trajectory.latest_by_stage(s.select("parent_id").distinct(), s, "parent_id", "trajectory_id", "stage", "score", "click")


@query("upsert_steps", f"WITH {STEPS}, n AS (SELECT trajectory_id, suggestion_order, -score AS score FROM steps WHERE suggestion_order > 1), o AS (SELECT trajectory_id, suggestion_order, score FROM steps WHERE suggestion_order < 3) SELECT * FROM n UNION ALL SELECT * FROM o WHERE trajectory_id NOT IN (SELECT trajectory_id FROM n)")
def upsert_steps(spark, d):
    """The stored records have suggestions 0 to 2, the new ones 2 and 3: together all steps, and a third of both."""
    s = steps(spark, d).select("trajectory_id", "suggestion_order", "score")
    return trajectory.upsert(s.where("suggestion_order < 3"), s.where("suggestion_order > 1").withColumn("score", -F.col("score")), "trajectory_id")


@query("parents_expanded", f"WITH {STEPS}, s AS (SELECT DISTINCT parent_id FROM steps WHERE parent_score > 300) SELECT DISTINCT parent_id, CASE WHEN parent_id IN (SELECT parent_id FROM s) THEN 'expanded' ELSE 'answered' END AS status FROM steps")
def parents_expanded(spark, d):
    s = steps(spark, d)
    grow, stop = trajectory.split_parents(s.select("parent_id").distinct(), s.where("parent_score > 300").select(F.col("parent_id").alias("p")), "parent_id", "p")
    return grow.withColumn("status", F.lit("expanded")).unionByName(stop.withColumn("status", F.lit("answered")))


@query("ancestors", """
WITH RECURSIVE e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey > 0 THEN o_orderkey // 4 END AS p FROM orders), a AS (SELECT k, k AS ancestor, 0 AS depth FROM e UNION ALL SELECT a.k, e.p, a.depth + 1 FROM a JOIN e ON e.k = a.ancestor WHERE e.p IS NOT NULL) SELECT k, ancestor, depth FROM a""")
def ancestors(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 4).cast("long")).alias("p"))
    return trajectory.ancestors(o, "k", "p", written(spark))


@query("lineage_roots", """
WITH RECURSIVE e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 > 0 THEN o_orderkey // 2 END AS p, o_totalprice AS s FROM orders),
a AS (SELECT k, k AS ancestor, p, 0 AS depth, s FROM e UNION ALL SELECT a.k, e.k, e.p, a.depth + 1, e.s FROM a JOIN e ON e.k = a.p)
SELECT k, arg_max(ancestor, depth) AS root, CAST(max(depth) AS BIGINT) AS depth, max(s) AS best FROM a GROUP BY k""")
def lineage_roots(spark, d):
    """A forest of orders: every fiftieth is a root."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 50 > 0, F.call_function("div", F.col("o_orderkey"), F.lit(2))).alias("p"), "o_totalprice")
    return trajectory.lineage(o, "k", "p", written(spark), "o_totalprice")


@query("artifact_priority", f"WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY suggestion_order, trajectory_id DESC) AS n FROM steps) SELECT parent_id, trajectory_id, suggestion_order FROM r WHERE n = 1")
def artifact_priority(spark, d):
    s = steps(spark, d).withColumn("neg", -F.col("trajectory_id"))
    return trajectory.first_by_priority(s, "parent_id", "suggestion_order", "neg").select("parent_id", "trajectory_id", "suggestion_order")


@query("record_violations", f"WITH {STEPS} SELECT trajectory_id, concat_ws(',', CASE WHEN NOT score > 10 THEN 'score' END, CASE WHEN NOT budget >= 0 THEN 'budget' END) AS broken FROM steps WHERE NOT (score > 10 AND budget >= 0)")
def record_violations(spark, d):
    v = trajectory.violations(steps(spark, d), score=F.col("score") > 10, budget=F.col("budget") >= 0)
    return v.select("trajectory_id", F.array_join("broken", ",").alias("broken"))


@query("judge_scores", f"WITH {STEPS} SELECT trajectory_id, greatest(least(score / 100, 1.0::DOUBLE), 0.0) AS clamped, greatest(least(score / 100, 1.0), 0.0) >= 0.25 AS keep, greatest(least(score / 100, 1.0), 0.0) >= 0.85 AS exportable FROM steps")
def judge_scores(spark, d):
    s = geo.unit_score(F.col("score") / 100)
    return steps(spark, d).select("trajectory_id", s.alias("clamped"), (s >= 0.25).alias("keep"), (s >= 0.85).alias("exportable"))


_BOX = "box AS (SELECT l_orderkey AS uid, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS e, [CAST(l_linenumber AS DOUBLE), l_quantity, l_linenumber + 10.0::DOUBLE, l_quantity + 20.0] AS a, [5.0::DOUBLE, 10.0, 15.0 + l_linenumber, 40.0] AS b, l_discount > 0.05 AS correct, l_returnflag = 'A' AS used_any, l_linenumber AS cnt FROM lineitem)"
_IOU = "greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0)"


def boxes(spark, d):
    n, q = F.col("l_linenumber").cast("double"), F.col("l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("e"), F.array(n, q, n + 10, q + 20).alias("a"), F.array(F.lit(5.0), F.lit(10.0), n + 15, F.lit(40.0)).alias("b"), (F.col("l_discount") > 0.05).alias("correct"), (F.col("l_returnflag") == "A").alias("used_any"), F.col("l_linenumber").cast("int").alias("cnt"))


@query("box_iou", f"WITH {_BOX}, i AS (SELECT uid, n, p, s, {_IOU} AS x, (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) AS t FROM box) SELECT uid, n, p, s, round(x / CASE WHEN t - x <= 0 THEN 1e-6 ELSE t - x END, 6) AS iou FROM i")
def box_iou(spark, d):
    return boxes(spark, d).select("uid", "n", "p", "s", F.round(geo.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("tool_reward", f"""
WITH {_BOX}, i AS (SELECT *, {_IOU} / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - {_IOU}) AS iou FROM box),
g AS (SELECT *, count(*) FILTER (used_any) OVER w AS wt, count(*) FILTER (NOT used_any) OVER w AS wo, count(*) FILTER (used_any AND correct) OVER w AS ct, count(*) FILTER (NOT used_any AND correct) OVER w AS cw FROM i WINDOW w AS (PARTITION BY uid)),
r AS (SELECT *, CASE WHEN wo > 0 THEN greatest(coalesce(ct / nullif(wt, 0), 0) - coalesce(cw / nullif(wo, 0), 0), 0) ELSE 0 END AS gain, CASE WHEN used_any THEN least((1 + iou) / 2, 1) ELSE least(iou / 2, 1) END AS mand FROM g),
f AS (SELECT *, CASE WHEN correct THEN 1.0 ELSE 0.0 END * CASE WHEN mand < 0.1 THEN mand ELSE 1 END AS acc, CASE WHEN NOT mand < 0.1 AND correct AND used_any AND cw < 2 THEN gain ELSE 0 END AS nec, CASE WHEN cnt >= 2 THEN cnt - 2 ELSE 0 END AS pen FROM r)
SELECT uid, n, p, s, e, round(mand, 6) AS r_mandatory, round(nec, 6) AS r_necessity, round(acc + 0.1 + 0.5 * mand + 0.3 * nec - 0.1 * pen, 6) AS r_total FROM f""")
def tool_reward(spark, d):
    t = boxes(spark, d).withColumns({"used": F.when(F.col("used_any"), F.array(F.lit("rotate_270"))).otherwise(F.array().cast("array<string>")), "required": F.array(F.lit("rotate_90"), F.lit("crop")), "truth_box": F.col("a"), "boxes": F.array("b"), "code_count": F.col("cnt"), "format_reward": F.lit(1.0)})
    r = toolreward.tool_reward(t)
    return r.select("uid", "n", "p", "s", "e", *(F.round(c, 6).alias(c) for c in ("r_mandatory", "r_necessity", "r_total")))


@query("box_pixels", """
WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, [l_quantity * 3, l_quantity * 5, l_quantity * 9, l_quantity * 30] AS b FROM lineitem)
SELECT k, n, p, least(greatest(least(CAST(round_even(b[2] / 1000 * 640, 0) AS INTEGER), 640), 0), 639) AS x1, least(greatest(least(CAST(round_even(b[1] / 1000 * 480, 0) AS INTEGER), 480), 0), 479) AS y1 FROM x""")
def box_pixels(spark, d):
    q = F.col("l_quantity")
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), geo.to_pixels(F.array(q * 3, q * 5, q * 9, q * 30), F.lit(640), F.lit(480)).alias("b"))
    return b.select("k", "n", "p", F.col("b")[0].alias("x1"), F.col("b")[1].alias("y1"))


@query("expected_transforms", "SELECT p_partkey, array_to_string(list_filter(list_distinct(CASE p_size % 3 WHEN 0 THEN ['rotate_270'] WHEN 1 THEN ['crop'] ELSE [] END), lambda x: x IS NOT NULL), ',') AS expected FROM part")
def expected_transforms(spark, d):
    k = F.col("p_size") % 3
    required = F.when(k == 0, F.array(F.lit("rotate_90"), F.lit("rotate_45"))).when(k == 1, F.array(F.lit("crop"), F.lit("crop"))).otherwise(F.array(F.lit("rotate_30")))
    return table(spark, d, "part").select("p_partkey", F.array_join(toolreward.expected_transforms(required), ",").alias("expected"))


@query("ocr_items", """
WITH x AS (SELECT l_orderkey AS k, l_shipdate, l_partkey AS p, CAST(l_quantity AS INTEGER) AS y, l_linenumber * 10 AS x, l_returnflag AS t FROM lineitem)
SELECT k, array_to_string(list(t ORDER BY y, x, t), '') AS texts, count(*) AS n FROM x GROUP BY k""")
def ocr_items(spark, d):
    y, x = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int") * 10
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("t"), F.array(x, y, x + 5, y + 8).alias("b"))).alias("s"))
    i = ocr.items(F.col("s.t"), F.lit(None).cast("array<double>"), F.col("s.b"))
    return g.select("k", F.array_join(F.transform(i, lambda r: r["text"]), "").alias("texts"), F.size(i).cast("long").alias("n"))


@query("ocr_lines")
def ocr_lines(spark, d):
    y, x = (F.col("l_quantity") * 4).cast("int"), F.col("l_linenumber").cast("int") * 10
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("t"), F.array(x, y, x + 5, y + 8).alias("b"))).alias("s"))
    i = ocr.items(F.col("s.t"), F.lit(None).cast("array<double>"), F.col("s.b"))
    return g.select("k", ocr.page_text(ocr.lines(i), fallback="(empty)").alias("page"))


@query("search_rounds")
def search_rounds(spark, d):
    roots = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("trajectory_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(3).alias("budget"), (F.pmod("c_custkey", F.lit(5)) / 4).alias("score"))

    def plan(front, r):
        return front.where("score > 0.2").select(F.col("trajectory_id").alias("parent_id"), F.col("score").alias("parent_score"), "budget", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("suggestion_order")).withColumn("trajectory_id", F.concat_ws(".", "parent_id", F.col("suggestion_order").cast("string")))

    def execute(chosen, r):
        h = F.pmod(F.xxhash64("trajectory_id"), F.lit(10))
        return chosen.select("trajectory_id", "parent_id", "budget", (h == 0).alias("failed"), F.lit("out").alias("output"), (h < 8).alias("keep"), (F.col("parent_score") * 0.9).alias("score"))

    return trajectory.run_rounds(roots, plan, execute, written(spark), width=500)


@query("record_rules", """
WITH r AS (
  SELECT event_id, event_id % 3 = 0 AS can, CASE WHEN value > 50 THEN event_type WHEN value > 25 THEN '' END AS answer, greatest(event_id % 4 - 1, 0) AS suggested,
         user_id % 3 AS counted, event_id % 3 AS called, value > 20 AS success, event_id % 5 = 0 AS failed, event_type = 'click' AS step, user_id % 2 = 0 AS named FROM events
), b AS (
  SELECT event_id, concat_ws(',', CASE WHEN can AND coalesce(answer, '') = '' THEN 'direct_answer' END, CASE WHEN can AND suggested > 0 THEN 'no_suggestions' END, CASE WHEN NOT can AND suggested = 0 THEN 'suggestions' END,
    CASE WHEN counted <> called THEN 'helper_call_count' END, CASE WHEN success = failed THEN 'success_xor_error' END, CASE WHEN step AND NOT named THEN 'scope_step_idx' END) AS broken FROM r
)
SELECT event_id, broken FROM b WHERE broken <> ''""")
def record_rules(spark, d):
    """Events as planner outputs, executor results and judge records in one; which rules each breaks."""
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    some = F.array_repeat(F.col("event_type"), F.greatest(i % 4 - 1, F.lit(0)).cast("int"))
    e = table(spark, d, "events").select(
        "event_id", (i % 3 == 0).alias("can_answer_now"), F.when(v > 50, F.col("event_type")).when(v > 25, "").alias("direct_answer"), some.alias("suggestions"),
        (u % 3).alias("observed_helper_call_count"), F.array_repeat(F.col("event_type"), (i % 3).cast("int")).alias("observed_helper_calls"), (v > 20).alias("success"), F.when(i % 5 == 0, "failed").alias("error"),
        F.when(F.col("event_type") == "click", "step").otherwise("trajectory").alias("scope_type"), F.when(u % 2 == 0, u).alias("scope_step_idx"))
    broken = trajectory.violations(e, **trajectory.planner_invariants(), **trajectory.runtime_invariants(), **trajectory.judge_invariants())
    return broken.select("event_id", F.array_join("broken", ",").alias("broken"))
