"""Tool calls as a table function, lineage by pointer doubling, and masks as intervals."""

import pytest
from pyspark.sql import functions as F
from tessera.functions import tables
from tessera.operators import packing, trajectory
from tessera.sources.scratch import written


def test_tool_calls_in_sql(spark):
    """By partitions, alone and in a join: broken blocks are neither given nor numbered, and values keep to their types."""
    good = '<tool_call>{"name": "f", "arguments": {"city": "Rom", "days": 3, "sure": true, "x": 1.5}}</tool_call>'
    odd = '<tool_call>\n{"name": "g", "arguments": {"city": {"a": 1}, "days": "3", "sure": 1}}\n</tool_call>'
    bad = '<tool_call>{"name": "f"</tool_call><tool_call>[1]</tool_call><tool_call>{"name": "f", "arguments": 4}</tool_call><tool_call>{"arguments": {}}</tool_call>'
    rows = [(1, 1, "x" + good + bad + odd), (1, 2, None), (1, 3, good), (2, 1, bad), (None, 1, odd), (3, 1, "")]
    spark.createDataFrame(rows, "conv long, turn int, text string").createOrReplaceTempView("turns_of_tests")
    tables.register(spark, "calls_of_tests")
    want = [(1, 1, 0, "f", "Rom", 3, True, 1.5), (1, 1, 1, "g", '{"a": 1}', None, None, None), (1, 3, 2, "f", "Rom", 3, True, 1.5), (None, 1, 0, "g", '{"a": 1}', None, None, None)]
    got = spark.sql("SELECT * FROM calls_of_tests(TABLE(turns_of_tests) PARTITION BY conv ORDER BY (turn), 'city string, days int, sure boolean, x double')")
    assert got.columns == ["conv", "turn", "call_no", "name", "city", "days", "sure", "x"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    joined = spark.sql("SELECT k.conv, f.name FROM (SELECT DISTINCT conv FROM turns_of_tests) k JOIN calls_of_tests(TABLE(turns_of_tests) PARTITION BY conv ORDER BY (turn), '') f ON f.conv = k.conv")
    assert sorted(map(tuple, joined.collect())) == [(1, "f"), (1, "f"), (1, "g")]
    assert tables.tool_call_table(spark.table("turns_of_tests"), "conv", "turn", "text", "days bigint").count() == 4
    for wrong in ("'days'", "'days blob'", "7"):
        with pytest.raises(Exception, match=r"days|constant"):
            spark.sql(f"SELECT * FROM calls_of_tests(TABLE(turns_of_tests) PARTITION BY conv ORDER BY (turn), {wrong})").collect()


def test_lineage_of_a_long_chain(spark):
    """Ten thousand deep, beside a star of as many leaves, a parent that is no node, and a node alone."""
    n = 10_000
    chain = spark.range(n).select("id", (F.col("id") - 1).alias("up"))
    star = spark.range(n, 2 * n).select("id", F.when(F.col("id") > n, F.lit(n)).alias("up"))
    rest = spark.createDataFrame([(3 * n, 5 * n), (3 * n + 1, None)], "id long, up long")
    nodes = chain.unionByName(star).unionByName(rest).withColumn("score", F.pmod(F.col("id") * 7, F.lit(10_007)).cast("double"))
    got = {r.id: r for r in trajectory.lineage(nodes, "id", "up", written(spark), "score").collect()}
    assert len(got) == 2 * n + 2
    best = -1.0
    for k in range(n):
        best = max(best, k * 7 % 10_007)
        assert (got[k].root, got[k].depth, got[k].best) == (0, k, best)
    assert all((got[k].root, got[k].depth) == (n, int(k > n)) for k in range(n, 2 * n)) and (got[3 * n].root, got[3 * n].depth) == (3 * n, 0) == (got[3 * n + 1].root - 1, 0)
    assert trajectory.lineage(nodes.limit(0), "id", "up", written(spark)).count() == 0
    with pytest.raises(ValueError, match="circle"):
        trajectory.lineage(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "id long, up long"), "id", "up", written(spark))


def test_rounds_end_or_say_so(spark):
    roots = spark.createDataFrame([(1, None, 9, 1.0)], "trajectory_id long, parent_id long, budget int, score double")

    def plan(running, r):
        return running.select((F.col("trajectory_id") + 1).alias("trajectory_id"), F.col("trajectory_id").alias("parent_id"), F.col("score").alias("parent_score"), F.lit(0).alias("suggestion_order"), "budget")

    def execute(chosen, r):
        return chosen.select("trajectory_id", "parent_id", "budget", F.lit(1.0).alias("score"), F.lit(False).alias("failed"), F.lit("x").alias("output"), F.lit(True).alias("keep"))

    with pytest.raises(RuntimeError):
        trajectory.run_rounds(roots, plan, execute, written(spark), width=2, max_rounds=3)
    done = trajectory.run_rounds(roots, plan, execute, written(spark), width=2)
    assert [r.status for r in done.orderBy("round").collect()] == ["expanded"] * 9 + ["max_step_reached"]


def test_mask_intervals(spark):
    rows = [(0, [1, 1, 2, 2, 2, 0]), (1, [1, 2, 2, 3, 3, 3]), (2, [1]), (3, []), (4, [0, 0]), (5, None), (6, [4] * 3000)]
    df = spark.createDataFrame(rows, "id int, m array<int>")
    got = {r.id: (r.runs, r.at) for r in df.select("id", packing.segment_runs(F.col("m")).alias("runs"), packing.mask_intervals(F.col("m")).alias("at")).collect()}
    assert [(r.start, r.end, r.segment) for r in got[0][0]] == [(0, 2, 1), (2, 5, 2), (5, 6, 0)] and [r.end - r.start for r in got[1][0]] == [1, 2, 3]
    for k, m in rows:
        if m is None:
            assert got[k][1] is None or got[k][1] == []
            continue
        assert len(got[k][1]) == len(m)
        for i, at in enumerate(got[k][1]) if len(m) < 100 else []:
            assert [j for j in range(len(m)) if m[i] == m[j] and m[i] and j <= i] == list(range(at.low, at.high))
    assert [(a.low, a.high) for a in got[6][1][-2:]] == [(0, 2999), (0, 3000)]
