"""Planner and executor outputs, synthesised messages and record upkeep."""

import json

import pytest
from pyspark.sql import functions as F
from tessera.functions import text
from tessera.operators import trajectory
from tessera.sources import files

PLANS = [
    ('{"mode": "answer", "think": " t ", "answer": " 42 "}', (True, "t", "42", None, [], None)),
    ('{"mode": "ANSWER ", "think": null, "answer": 42, "stop_reason": "done"}', (True, "(Model omitted 'think' in JSON; placeholder.)", "42", "done", [], None)),
    ('{"mode": "suggestions", "think": " ", "suggestions": [{"a": 1}, "x"], "answer": ""}', (False, "(Empty think in JSON; placeholder.)", None, None, ['{"a":1}', '"x"'], None)),
    ('{"think": "t", "mode": "answer", "answer": "a", "suggestions": []}', "answer and suggestions"), ('{"think": "t", "mode": "answer"}', "answer is missing"), ('{"think": "t", "mode": "answer", "answer": "  "}', "answer is empty"), ('{"think": "t", "mode": "suggestions", "suggestions": {}}', "suggestions are no array"),
    ('{"think": "t", "mode": "suggestions", "answer": "a", "suggestions": []}', "answer and suggestions"), ('{"think": "t", "mode": "guess"}', "unknown mode"), ('{"think": "t", "mode": "answer", "answer": "a", "stop_reason": 3}', "stop reason is no text"),
    ("<think> t </think>\n<answer> a </answer>", (True, "t", "a", None, [], None)), ('<think>t</think><suggestions>[{"p": "q"}]</suggestions>', (False, "t", None, None, ['{"p":"q"}'], None)),
    ("<answer>a</answer><think>t</think>", "think comes late"), ("<answer>a</answer>", "think is missing"), ("<think>t</think><think>u</think><answer>a</answer>", "repeated tag"), ("<think> </think><answer>a</answer>", "think is empty"), ('{"mode": "answer", "answer": "a"}', "think is missing"), ("nothing", "think is missing"), ("<think>t</think>", "neither answer nor suggestions"), ("<think>t</think><answer>a</answer><suggestions>[]</suggestions>", "answer and suggestions"),
    ("<think>t</think><answer> </answer>", "answer is empty"), ("<think>t</think><suggestions>{}</suggestions>", "suggestions are no array"), (None, "no text"),
]


def call(**over):
    args = {"code": " x = 1 ", "description": "d"} | over.pop("arguments", {})
    return json.dumps({"think": "why", "tool_call": {"name": "code_image_tool", "arguments": args}} | over)


RUNS = [
    (call(), ("why", "x = 1", "d", None)), ("```json\n" + call() + "\n```", ("why", "x = 1", "d", None)), ("no object", "no JSON object"), (call(think=" "), "empty think"), (call(tool_call=3), "no tool call"), ('{"tool_call": {}}', "no JSON object"), (call(tool_call={"name": "other", "arguments": {}}), "wrong tool name"),
    (call(tool_call={"name": "code_image_tool"}), "no arguments"), (call(arguments={"code": ""}), "empty code"), (call(arguments={"description": " "}), "empty description"), (None, "no JSON object"),
]


def test_planner(spark):
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PLANS)], "k int, s string").select("k", text.planner_output(F.col("s")).alias("p")).orderBy("k").collect()
    for (plan, want), r in zip(PLANS, rows, strict=True):
        got = tuple(r.p)
        if isinstance(want, str):
            assert got == (None, None, None, None, None, want), plan
        else:
            assert got == want, plan


def test_executor(spark):
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(RUNS)], "k int, s string").select("k", text.executor_output(F.col("s")).alias("e")).orderBy("k").collect()
    for (out, want), r in zip(RUNS, rows, strict=True):
        assert tuple(r.e) == (want if isinstance(want, tuple) else (None, None, None, want)), out


def test_messages(spark):
    df = spark.createDataFrame([(3, 'say "é"\n', ["a.png", "b.png"]), (12, "", [])], "n int, t string, i array<string>")
    a = trajectory.assistant_step_message(F.col("n"), F.lit(2), F.lit("hm"), F.col("t"), F.lit("d"), F.lit(0))
    rows = df.select("n", a.alias("a"), trajectory.tool_step_message(F.col("n"), F.col("t"), F.col("i")).alias("t"), trajectory.final_answer_message(F.lit("42"), F.lit(1)).alias("f")).orderBy("n").collect()
    for r, t in zip(rows, ['say "é"\n', ""], strict=True):
        payload = {"name": "code_image_tool", "arguments": {"code": t, "description": "d", "image_index": 0}}
        assert r.a.content == f"<think>\nhm\n</think>\n<tool_call>\n{json.dumps(payload, ensure_ascii=False, indent=2)}\n</tool_call>"
        assert r.a.message_id == f"m_step_{r.n:03d}_assistant" and r.a.metadata["planner_round_idx"] == "2" and r.t.role == "tool" and r.t.content == t
        assert r.f.content == "<answer>\n42\n</answer>" and r.f.metadata == {"message_kind": "final_answer", "planner_round_idx": "1"}
    assert rows[0].t.metadata["primary_image_artifact_id"] == "a.png" and rows[1].t.metadata["primary_image_artifact_id"] is None
    both = df.select(trajectory.appended_messages(trajectory.appended_messages(F.lit(None), trajectory.final_answer_message(F.lit("a"), F.lit(0))), trajectory.tool_step_message(F.col("n"), F.col("t"), F.col("i"))).alias("m")).first().m
    assert [m.role for m in both] == ["assistant", "tool"]


def test_records(spark):
    df = spark.createDataFrame([([(2, "b"), (5, "e")],)], "s array<struct<step_idx:int,v:string>>")
    put = lambda k, v: trajectory.registered(F.col("s"), F.struct(F.lit(k).alias("step_idx"), F.lit(v).alias("v")), "step_idx")
    r = df.select(put(3, "c").alias("x"), put(5, "E").alias("y")).first()
    assert [tuple(s) for s in r.x] == [(2, "b"), (3, "c"), (5, "e")] and [tuple(s) for s in r.y] == [(2, "b"), (5, "E")]
    parent = spark.createDataFrame([("t1", "/r/t1", 1, 4)], "trajectory_id string, root string, budget int, round_idx int").withColumn("messages", F.array(trajectory.tool_step_message(F.lit(1), F.lit("x"), F.array(F.lit("/r/t1/a.png"), F.lit("/other/b.png")))))
    c = trajectory.child_of(parent, F.lit("t1__r1"), F.lit("try")).first()
    assert (c.trajectory_id, c.parent_trajectory_id, c.budget, c.status, c.root) == ("t1__r1", "t1", 0, "running", "/r/t1/t1__r1") and c.messages[0].image_artifact_ids == ["/r/t1/t1__r1/a.png", "/other/b.png"]
    rec = spark.createDataFrame([(1, "a", [], True, None, 1), (2, "a", ["s"], True, None, 1), (3, None, ["s"], False, None, -1)], "k int, final_answer string, suggestions array<string>, success boolean, error string, budget int")
    assert {r.k: list(r.broken) for r in trajectory.violations(rec, **trajectory.record_invariants()).collect()} == {2: ["answer_xor_suggestions"], 3: ["success_xor_error", "budget"]}
    done = spark.createDataFrame([("a", "answered"), ("b", "failed")], "trajectory_id string, status string").withColumn("messages", F.array(trajectory.final_answer_message(F.lit("7"), F.lit(0)))).withColumn("final_answer", F.lit("7"))
    assert [(r.trajectory_id, r.messages[0].role) for r in trajectory.canonical_export(done).collect()] == [("a", "assistant")]
    with pytest.raises(Exception, match="not terminal"):
        trajectory.canonical_export(done.withColumn("status", F.lit("running"))).collect()
    refs, known = spark.createDataFrame([(1, "x"), (2, "y")], "k int, ref string"), spark.createDataFrame([("x", "/x.png")], "i string, path string")
    assert {r.k: r.path for r in trajectory.resolve_artifacts(refs, known, "ref", "i", "path", strict=False).collect()} == {1: "/x.png", 2: None}
    with pytest.raises(Exception, match="unknown artifact y"):
        trajectory.resolve_artifacts(refs, known, "ref", "i", "path").collect()


def test_times(spark):
    r = spark.sql("SELECT timestamp'2024-01-02 03:04:05.000006' AS a, timestamp'2024-01-02 03:04:06.5' AS b").select(text.iso_time(F.col("a")).alias("i"), text.stamp(F.col("a")).alias("s"), text.elapsed_seconds(F.col("a"), F.col("b")).alias("e")).first()
    assert r.i in ("2024-01-02T03:04:05.000006Z", "2024-01-02T03:04:05.000006+00:00") and r.s == "20240102T030405000006Z" and abs(r.e - 1.499994) < 1e-9


def test_layout_pages(spark):
    page = {"markdown": {"text": "# a"}}
    bare = {"prunedResult": {"k": 1}}
    shapes = [{"meta": {"layout_result": {"layoutParsingResults": [page, bare, {}]}}}, {"layout_result": {"layoutParsingResults": [page]}}, {"result": {"layoutParsingResults": []}}, {"layoutParsingResults": [page]}]
    df = spark.createDataFrame([(k, json.dumps(s)) for k, s in enumerate(shapes)], "k int, s string")
    got = {r.k: list(r.p) for r in df.select("k", files.layout_pages(F.col("s")).alias("p")).collect()}
    assert got == {0: ["# a", '```json\n{"k":1}\n```', ""], 1: ["# a"], 2: [], 3: ["# a"]}
    with pytest.raises(Exception, match="no layoutParsingResults"):
        df.select(files.layout_pages(F.lit("{}"))).collect()


def test_planner_runtime_and_judge_rules(spark):
    """Nulls count as no answer, no suggestions, no calls; a record is told every rule that it breaks."""
    plan = spark.createDataFrame([(1, True, "a", []), (2, True, "", ["s"]), (3, False, None, None), (4, False, "a", ["s"]), (5, None, None, ["s"])], "k int, can_answer_now boolean, direct_answer string, suggestions array<string>")
    assert {r.k: list(r.broken) for r in trajectory.violations(plan, **trajectory.planner_invariants()).collect()} == {2: ["direct_answer", "no_suggestions"], 3: ["suggestions"]}
    run = spark.createDataFrame([(1, 2, ["a", "b"], True, None), (2, 1, None, False, "e"), (3, None, [], True, "e"), (4, 0, None, False, None)], "k int, observed_helper_call_count int, observed_helper_calls array<string>, success boolean, error string")
    assert {r.k: list(r.broken) for r in trajectory.violations(run, **trajectory.runtime_invariants()).collect()} == {2: ["helper_call_count"], 3: ["success_xor_error"], 4: ["success_xor_error"]}
    judge = spark.createDataFrame([(1, "step", 0), (2, "step", None), (3, "trajectory", None)], "k int, scope_type string, scope_step_idx int")
    assert [r.k for r in trajectory.violations(judge, **trajectory.judge_invariants()).collect()] == [2]


def test_prose_that_starts_like_json(spark):
    """A number, string, list or object ahead of the call is prose: JSON is the whole text or what the braces hold."""
    ahead = ["12 apples", '"so" he said', "[1, 2] holds", "null and", "3.5", "1, 2", "1],["]
    rows = spark.createDataFrame([(k, f"{a} {call()}") for k, a in enumerate(ahead)], "k int, s string")
    assert {tuple(r.e) for r in rows.select(text.executor_output(F.col("s")).alias("e")).collect()} == {("why", "x = 1", "d", None)}
    own = spark.createDataFrame([(1, "{} {}"), (2, '{"a": 1} x'), (3, " [1, 2] "), (4, "12"), (5, "12 x"), (6, None), (7, "1, 2"), (8, '{"a": 1}}')], "k int, s string")
    assert {r.k: r.j for r in own.select("k", text.fenced_json(F.col("s")).alias("j")).collect()} == {1: None, 2: '{"a": 1}', 3: "[1, 2]", 4: "12", 5: None, 6: None, 7: None, 8: None}
