import pytest
from pyspark.sql import functions as F
from tessera.functions import geometry, math_scorers, registry, text
from tessera.operators import convert, ocr, toolreward, trajectory


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_gsm8k(spark):
    f = lambda s: one(spark, text.gsm8k_strict(F.lit(s)), text.gsm8k_flexible(F.lit(s)))
    assert f("so #### 1,234") == ("1234", "1,234") and f("7 then .") == (None, "7") and f("none") == (None, None) and f("...")[1] == "..."
    assert f("#### 5 " + "x" * 300) == (None, None)


def test_answers(spark):
    f = lambda s: one(spark, text.final_answer(F.lit(s)))[0]
    assert f("<answer>a</answer> <answer> b </answer>") == "b" and f("x <answer> c") == "c" and f("l1\nl2 ") == "l2" and f("") is None
    g = lambda a, b: one(spark, text.equivalent_answers(F.lit(a), F.lit(b)))[0]
    assert g("1.0", "1") and g("B it is", "b") and g("about 0.5", "1/2") and not g("3", "4") and not g("", "1")
    n = lambda s: one(spark, text.qa_normalize(F.lit(s)))[0]
    assert n("The  Cat, a hat!") == "cat hat" and n("théa éa") == "théa éa"


@pytest.mark.parametrize(("s", "want"), [("<think>a</think><answer>b</answer>", 1.0), ("<think>a</think><tool_response><answer></tool_response><answer>b</answer> \n", 1.0), ("x<think>a</think><answer>b</answer>", 0.0), ("<think>a<answer>b</answer></think>", 0.0), ("<think>a</think><answer>b</answer> tail", 0.0), ("<think>a</think><answer>b</answer><answer>c</answer>", 0.0), ("<think>a<answer>b</answer>", 0.0)])
def test_format(spark, s, want):
    assert one(spark, text.format_reward(F.lit(s)))[0] == want


def test_json_and_tools(spark):
    assert one(spark, text.fenced_json(F.lit('```json\n{"a": 1}\n```')))[0] == '{"a": 1}' and one(spark, text.fenced_json(F.lit('x {"a": 1} y')))[0] == '{"a": 1}' and one(spark, text.fenced_json(F.lit("no")))[0] is None
    c, e = one(spark, *text.single_tag(F.lit("<a> x </a>"), "a"))
    assert (c, e) == ("x", None) and one(spark, text.single_tag(F.lit("<a>1</a><a>2</a>"), "a")[1])[0] == "more than one <a>"
    assert one(spark, text.fill_slots("a {{x}} b {{x}}", x=F.lit("1")))[0] == "a 1 b {{x}}"
    with pytest.raises(Exception, match="separators"):
        one(spark, text.child_id(F.lit("a/b"), F.lit(1), F.lit("c")))
    assert one(spark, text.default_tool_format(F.lit("tool_name"), F.lit('{"foo": "bar", "size": 10}')))[0] == 'Action: tool_name\nAction Input: {"foo": "bar", "size": 10}'


def test_math():
    assert math_scorers.last_boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}" and math_scorers.last_boxed("none") is None and math_scorers.last_boxed("\\boxed{1") is None
    for a, b, same in [("\\frac12", "0.5", True), ("50\\%", "50", True), ("1,000", "1000", True), ("(1, \\frac{1}{2})", "(1,0.5)", True), ("(1,2]", "(1,2)", False), ("x", "y", False), ("2", "3", False)]:
        assert math_scorers.math_equal(a, b) is same, (a, b)
    assert math_scorers.rouge_f("a b c".split(), "a c".split(), None) == pytest.approx(0.8) and math_scorers.bleu4("a b c d e".split(), "a b c d e".split()) == pytest.approx(1.0)


def test_scorer_registry(spark, tmp_path):
    (tmp_path / "f.py").write_text("def f(s, a, b, e):\n    return {'score': float(a == b), 'pred': a, 'n': 1}\n\ndef bad(*a):\n    raise ValueError('x')\n")
    df = spark.createDataFrame([("s", "1", "1", None), ("s", "1", "2", None)], "data_source string, solution string, ground_truth string, extra string")
    f = registry.load_function(str(tmp_path / "f.py"), "f")
    got = df.select(registry.scorer(f)("data_source", "solution", "ground_truth", "extra").alias("r")).collect()
    assert [(r.r.score, r.r.pred, r.r.extra) for r in got] == [(1.0, "1", '{"n": 1}'), (0.0, "1", '{"n": 1}')]
    bad = registry.load_function(str(tmp_path / "f.py"), "bad")
    assert [r.rm_scores for r in registry.MANAGERS["prime"](df, bad).collect()] == [0.0, 0.0]
    with pytest.raises(AttributeError):
        registry.load_function(str(tmp_path / "f.py"), "nope")
    routed = spark.createDataFrame([("openai/gsm8k", "#### 4", "4"), ("aime24", "Answer: 3", "4")], "data_source string, solution string, ground_truth string")
    assert [r.rm_scores for r in registry.MANAGERS["naive"](routed).collect()] == [1.0, -1.0]
    with pytest.raises(Exception, match="no scorer"):
        registry.MANAGERS["naive"](routed.withColumn("data_source", F.lit("??"))).collect()


def test_converters(spark):
    a = spark.createDataFrame([("Solve the math problem.", "3 + 4", "The answer is 7.", [["q", "r"]])], "instruction string, input string, output string, history array<array<string>>")
    r = convert.align(a, "alpaca").first()
    assert [tuple(m) for m in r._prompt] == [("user", "q"), ("assistant", "r"), ("user", "Solve the math problem.\n3 + 4")] and [tuple(m) for m in r._response] == [("assistant", "The answer is 7.")] and r._system == ""
    s = "c array<struct<from:string,value:string>>"
    good = [("system", "S"), ("human", "q"), ("gpt", "r")]
    rows = spark.createDataFrame([(good,), ([("human", "a"), ("human", "b")],), ([("human", "a")],), ([],)], s)
    got = convert.align(rows, "sharegpt", messages="c", keep=["is_broken"]).collect()
    assert (got[0]._system, [tuple(m) for m in got[0]._prompt], got[0]._response[0].content) == ("S", [("user", "q")], "r")
    assert [g.is_broken for g in got] == [False, True, True, True] and all(g._prompt == [] and g._response == [] for g in got[1:])
    o = spark.createDataFrame([([("user", "q"), ("assistant", "f"), ("tool", "1"), ("tool", "2"), ("assistant", "r"), ("tool", "lost")],)], "messages array<struct<role:string,content:string>>")
    m = convert.align(o, "openai").first()
    assert [x.role for x in m._prompt] == ["user", "assistant", "observation"] and m._prompt[2].content == "1\n</tool_response>\n<tool_response>\n2" and m._response[0].content == "r"
    assert m._system == "detailed thinking off"
    cases = [("", ""), ("", "[]"), ("S", ""), ("S", "[]"), ("be brief, detailed thinking on", ""), (None, "")]
    said = spark.createDataFrame([([("user", "q"), ("assistant", "r")], *c) for c in cases], "messages array<struct<role:string,content:string>>, system string, tools string")
    assert [r._system for r in convert.align(said, "openai").collect()] == ["detailed thinking off", "", "S\ndetailed thinking off", "S\n", "be brief, detailed thinking on", "detailed thinking off"]
    with pytest.raises(KeyError):
        convert.align(o, "nope")
    with pytest.raises(Exception, match="not first"):
        o.select(convert.with_system(F.array(convert.message("user", F.lit("q")), convert.message("system", F.lit("s"))), "x")).collect()


def test_ocr_and_boxes(spark):
    assert ocr.group_lines([("a", [0, 0, 5, 10]), ("c", [0, 40, 5, 50]), ("b", [8, 2, 12, 11])], 0.6) == ["a b", "c"]
    df = spark.createDataFrame([(["x", "", "y", "z"], [0.5], [[5, 9, 6, 12], [0, 0, 1, 1], None, [1, 1, 2, 3]])], "t array<string>, s array<double>, b array<array<int>>")
    items = df.select(ocr.items(F.col("t"), F.col("s"), F.col("b"))).first()[0]
    assert [(i.text, i.score) for i in items] == [("z", 1.0), ("x", 1.0)]
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, geometry.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)))[0] == pytest.approx(1 / 7)
    assert one(spark, geometry.box_from_points(F.array(box(0.5, 1.5), box(2.5, 9))))[0] == [0, 2, 2, 9]
    assert one(spark, geometry.zoom_box(box(10, 10, 12, 12), F.lit(100), F.lit(100)))[0] == [0, 0, 28, 28] and one(spark, geometry.zoom_box(box(5, 5, 5, 9), F.lit(9), F.lit(9)))[0] is None
    assert one(spark, geometry.frame_positions(F.lit(10), F.lit(4)))[0] == [0, 3, 6, 9] and one(spark, geometry.frame_positions(F.lit(10), F.lit(1)))[0] == [0]
    assert one(spark, toolreward.expected_transforms(F.array(F.lit("rotate_90"), F.lit("rotate_45"), F.lit("crop"), F.lit("crop"))))[0] == ["rotate_270", "crop"]


def test_trajectories(spark):
    c = spark.createDataFrame([("t1", "p1", 0, 0.5), ("t2", "p1", 1, 0.5), ("t3", "p2", 0, 0.9), ("t4", "p2", 1, 0.9)], "trajectory_id string, parent_id string, suggestion_order int, parent_score double")
    assert [r.trajectory_id for r in trajectory.frontier(c, 3).collect()] == ["t3", "t1", "t4"]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, trajectory.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="not terminal"):
        trajectory.export_ready(spark.createDataFrame([("running",)], "status string")).collect()


def test_scripted_search(spark):
    """Three suggestions, two rounds: one branch answers at once, one fails, one runs out of steps."""
    roots = spark.createDataFrame([("root", None, 2, 1.0)], "trajectory_id string, parent_id string, budget int, score double")
    script = {1: [("s1", "root", 0), ("s2", "root", 1), ("s3", "root", 2)], 2: [("s21", "s2", 0), ("s31", "s3", 0)]}

    def plan(front, r):
        rows = spark.createDataFrame(script.get(r, []), "trajectory_id string, parent_id string, suggestion_order int")
        return rows.join(front.select(F.col("trajectory_id").alias("p"), F.col("score").alias("parent_score"), "budget"), F.col("parent_id") == F.col("p")).drop("p")

    def execute(chosen, r):
        return chosen.select("trajectory_id", "parent_id", "budget", (F.col("trajectory_id") == "s31").alias("failed"), F.lit("x").alias("output"), F.lit(True).alias("keep"), F.lit(0.5).alias("score"))

    got = {r.trajectory_id: r.status for r in trajectory.run_rounds(roots, plan, execute, lambda d: d.persist(), width=3).collect()}
    assert got == {"root": "expanded", "s1": "answered", "s2": "expanded", "s3": "expanded", "s21": "max_step_reached", "s31": "failed"}
