"""Batch columns, masks, formats and records that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import math_scorers, registry, text, tools
from ..operators import convert, metrics, packing, trajectory
from ..operators.batch import Batch
from .catalogue import query
from .document_queries import conversations, documents
from .views import STEPS, rollouts, steps, table

_CONV = "conv AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY 1)"


@query("batch_columns", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, doc_id AS id, source, lang FROM documents")
def batch_columns(spark, d):
    """A column popped, another renamed, the popped one put back by position."""
    b = Batch.of(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id", meta={"kept": 1, "gone": 2})
    popped, left = b.select(["doc_id", "lang", "source"], ["kept"]).pop(["lang"])
    return left.rename(["doc_id"], ["id"]).union(popped).df.select("row", "id", "source", "lang")


@query("valid_rows", f"""
WITH {_CONV}, b AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS b FROM conv),
k AS (SELECT conv_id, len(b) AS n, len(b) % 2 = 1 OR len(b) = 0 OR len(list_filter(b, lambda x, i: CASE WHEN i % 2 = 1 THEN x.role <> 'user' ELSE x.role <> 'assistant' END)) > 0 AS broken FROM b)
SELECT conv_id, NOT broken AS sft, false AS rm, NOT broken AS pt FROM k""")
def valid_rows(spark, d):
    a = convert.align(conversations(spark, d), "openai", keep=["conv_id"])
    return a.select("conv_id", *(convert.valid_rows(s).alias(s) for s in ("sft", "rm", "pt")))


@query("token_mismatches", """
WITH a AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS a FROM documents), b AS (SELECT doc_id, a, list_transform(a, lambda x, i: CASE WHEN i % 5 = 0 THEN x + 1 ELSE x END) AS b FROM a)
SELECT doc_id, len(list_filter(a, lambda x, i: x <> b[i] AND x % 3 <> 0)) AS mismatches FROM b""")
def token_mismatches(spark, d):
    a = F.transform(F.split("text", " "), lambda w: F.length(w))
    b = F.transform(a, lambda x, i: F.when((i + 1) % 5 == 0, x + 1).otherwise(x))
    return documents(spark, d).select("doc_id", metrics.mismatches(a, b, F.transform(a, lambda x: x % 3)).cast("long").alias("mismatches"))


@query("samples_by_row", "SELECT user_id AS uid, array_to_string(list(round(value, 2)::DECIMAL(18,2) ORDER BY event_id), ',') AS responses FROM events GROUP BY 1")
def samples_by_row(spark, d):
    s = convert.samples_by_row(rollouts(spark, d).withColumn("v", F.round("score", 2).cast("decimal(18,2)").cast("string")), "uid", "row", "v")
    return s.select("uid", F.array_join("responses", ",").alias("responses"))


@query("turn_loss_mask", f"WITH {_CONV} SELECT conv_id, array_to_string(flatten(list_transform(m, lambda x: list_transform(range(len(string_split(x.content, ' '))), lambda i: CASE WHEN x.role = 'assistant' AND i >= 1 THEN 1 ELSE 0 END))), '') AS mask FROM conv")
def turn_loss_mask(spark, d):
    """The first word of an answer stands for its generation prompt."""
    m = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), F.lit(1).alias("n_prompt"), F.size(F.split(x["content"], " ")).alias("n_tokens")))
    return conversations(spark, d).select("conv_id", F.array_join(packing.turn_loss_mask(m).cast("array<string>"), "").alias("mask"))


@query("block_mask", """
WITH p AS (SELECT doc_id, list_transform(range(n_chars % 12), lambda i: CASE WHEN i < n_chars % 5 THEN 1 WHEN i < n_chars % 5 + n_chars % 4 THEN 2 ELSE 0 END) AS m FROM documents)
SELECT doc_id, array_to_string(list_transform(m, lambda a, i: array_to_string(list_transform(m, lambda b, j: CASE WHEN a = b AND a <> 0 AND j <= i THEN 1 ELSE 0 END), '')), '|') AS mask, array_to_string(list_transform(range(1, coalesce(list_max(m), 0) + 1), lambda s: len(list_filter(m, lambda x: x = s))), ',') AS segments FROM p""")
def block_mask(spark, d):
    n = F.col("n_chars")
    i = F.filter(F.sequence(F.lit(0), (n % 12).cast("int")), lambda x: x < n % 12)
    m = F.transform(i, lambda x: F.when(x < n % 5, 1).when(x < n % 5 + n % 4, 2).otherwise(0))
    rows = documents(spark, d, "doc_id", "n_chars").select("doc_id", m.alias("m"))
    return rows.select("doc_id", F.array_join(F.transform(packing.block_mask(F.col("m")), lambda r: F.array_join(r.cast("array<string>"), "")), "|").alias("mask"), F.array_join(packing.segment_lengths(F.col("m")).cast("array<string>"), ",").alias("segments"))


@query("mask_intervals", """
WITH p AS (SELECT doc_id, list_concat(list_concat(list_transform(range(n_chars % 37), lambda i: 1), list_transform(range(n_chars % 23), lambda i: 2)), list_concat(list_transform(range(n_chars % 11), lambda i: 3), list_transform(range(n_chars % 7), lambda i: 0))) AS m FROM documents),
c AS (SELECT doc_id, m, unnest(range(len(m))) AS i FROM p), k AS (SELECT *, unnest(range(i + 1)) AS j FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS place, CAST(min(j) AS INTEGER) AS low, CAST(max(j) + 1 AS INTEGER) AS high, count(*) AS keys FROM k WHERE m[i + 1] = m[j + 1] AND m[i + 1] <> 0 GROUP BY doc_id, i""")
def mask_intervals(spark, d):
    """Packed rows of three segments and padding; the SQL expands all pairs of places."""
    n = F.col("n_chars")
    m = F.concat(*(F.array_repeat(F.lit(v), (n % k).cast("int")) for v, k in ((1, 37), (2, 23), (3, 11), (0, 7))))
    rows = documents(spark, d, "doc_id", "n_chars").select("doc_id", F.posexplode(packing.mask_intervals(m)).alias("place", "k"))
    return rows.select("doc_id", "place", "k.low", "k.high", (F.col("k.high") - F.col("k.low")).cast("long").alias("keys")).where("keys > 0")


@query("tool_calls_udtf", """
WITH c AS (SELECT conv_id, turn, role, text, unnest(CASE WHEN role = 'user' THEN [1] ELSE [1, 2] END) AS i FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS call_no, role || '_' || i AS name, text AS said, CASE WHEN i = 1 THEN turn END AS n FROM c""")
def tool_calls_udtf(spark, d):
    """Each turn calls once with its text and number (users), or a second time with its text and a number that is none;
    a broken block stands between. Numbers run over the turns of a conversation."""
    from ..functions.tables import tool_call_table

    def call(i: int, n):
        arguments = F.struct(F.col("text").alias("said"), n.alias("n"))
        return F.concat(F.lit("<tool_call>"), F.to_json(F.struct(F.concat("role", F.lit(f"_{i}")).alias("name"), arguments.alias("arguments"))), F.lit("</tool_call>"))

    two = F.concat(F.lit('<tool_call>{"name": "broken</tool_call>'), call(2, F.lit("none")))
    c = table(spark, d, "conversations").withColumn("turn_text", F.concat("text", call(1, F.col("turn")), F.when(F.col("role") == "user", F.lit("")).otherwise(two)))
    return tool_call_table(c, "conv_id", "turn", "turn_text", "said string, n bigint")


@query("rollout_steps", """
SELECT event_id // 500 AS step, 'user ' || user_id AS input, props AS output, event_type AS gts, value AS score FROM events WHERE event_id // 500 >= 1 AND event_id // 500 < 15""")
def rollout_steps(spark, d):
    """Events written as steps of 500 and read back through the data source, without the steps that a filter leaves out."""
    from ..sources.rollouts import RolloutSource
    from ..sources.scratch import folder

    spark.dataSource.register(RolloutSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # so that steps that are left out are not opened
    e = table(spark, d, "events").select(F.call_function("div", F.col("event_id"), F.lit(500)).alias("step"), F.concat(F.lit("user "), "user_id").alias("input"), F.col("props").alias("output"), F.col("event_type").alias("gts"), F.col("value").alias("score"))
    path = folder(spark)
    e.repartition("step").write.format("rollouts").mode("append").option("path", path).save()
    rows = spark.read.format("rollouts").option("path", path).option("mode", "strict").load()
    return rows.where("step >= 1 AND step < 15").select("step", "input", "output", "gts", "score")


@query("tag_formats", r"""
WITH s AS (SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN '<think>' || text || '</think> \boxed{' || doc_id || '}' WHEN 1 THEN '<think>x</think>' || text ELSE text || '<answer>a</answer><answer> ' || doc_id || ' </answer>' END AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(s, '(?s)<think>.*</think>.*\\boxed\{.*\}.*') THEN 1.0::DOUBLE ELSE 0.0 END AS boxed, trim(regexp_extract_all(s, '(?s)<answer>(.*?)</answer>', 1)[-1]) AS answer FROM s""")
def tag_formats(spark, d):
    k, i = F.col("n_chars") % 3, F.col("doc_id").cast("string")
    s = F.when(k == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> \\boxed{"), i, F.lit("}"))).when(k == 1, F.concat(F.lit("<think>x</think>"), "text")).otherwise(F.concat("text", F.lit("<answer>a</answer><answer> "), i, F.lit(" </answer>")))
    return documents(spark, d, "doc_id", "text", "n_chars").select("doc_id", text.boxed_format(s).alias("boxed"), text.last_tag(s, "answer").alias("answer"))


@query("slots", "SELECT doc_id, 'Q (' || lang || '): ' || text || ' in {{lang}} -' AS prompt FROM documents")
def slots(spark, d):
    """The first occurrence of a slot is filled, the second stays."""
    return documents(spark, d).select("doc_id", text.fill_slots("Q ({{lang}}): {{content}} in {{lang}} -", lang=F.col("lang"), content=F.col("text")).alias("prompt"))


@query("tool_formats", "SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN 'Action: f' || n_chars % 7 || chr(10) || 'Action Input: {\"k\": ' || n_chars || '}' WHEN 1 THEN '<tool_call>' || chr(10) || '{\"name\": \"f' || n_chars % 7 || '\", \"arguments\": {\"k\": ' || n_chars || '}}' || chr(10) || '</tool_call>' ELSE '{\"name\": \"f' || n_chars % 7 || '\", \"parameters\": {\"k\": ' || n_chars || '}}' END AS written, 'f' || n_chars % 7 AS name, n_chars AS k FROM documents")
def tool_formats(spark, d):
    """One call a row in three formats, written and read back behind the whole text."""
    n = F.col("n_chars")
    call = F.array(F.struct(F.concat(F.lit("f"), (n % 7).cast("string")).alias("name"), F.concat(F.lit('{"k": '), n.cast("string"), F.lit("}")).alias("arguments")))
    kinds = ("default", "qwen", "llama3")
    rows = documents(spark, d, "doc_id", "text", "n_chars").withColumn("call", call)
    for k in kinds:
        rows = rows.withColumn(k, tools.formatted(k, F.col("call")))
    for k in kinds:
        rows = rows.withColumn(f"{k}_read", tools.extracted(k, F.col(k) if k == "llama3" else F.concat(F.coalesce(F.replace("text", F.lit("Action"), F.lit("")), F.lit("")), F.lit("\n"), F.col(k))))
    pick = lambda suffix: F.when(n % 3 == 0, F.col(f"default{suffix}")).when(n % 3 == 1, F.col(f"qwen{suffix}")).otherwise(F.col(f"llama3{suffix}"))
    return rows.select("doc_id", pick("").alias("written"), pick("_read")[0]["name"].alias("name"), F.get_json_object(pick("_read")[0]["arguments"], "$.k").cast("long").alias("k"))


@query("stage_errors", f"WITH {STEPS} SELECT trajectory_id, CASE WHEN stage = 'error' THEN 'planner' WHEN budget < 0 THEN 'child_init' WHEN score > 40 THEN 'executor' END AS stage, CASE WHEN stage = 'error' THEN 'p' || suggestion_order WHEN budget < 0 THEN 'budget ' || budget WHEN score > 40 THEN 'high' END AS message FROM steps")
def stage_errors(spark, d):
    s = steps(spark, d).withColumnRenamed("stage", "event")
    s = trajectory.attempt(s, "planner", F.col("event") == "error", F.concat(F.lit("p"), F.col("suggestion_order").cast("string")))
    s = trajectory.attempt(s, "child_init", F.col("budget") < 0, F.concat(F.lit("budget "), F.col("budget").cast("string")))
    s = trajectory.attempt(s, "executor", F.col("score") > 40, F.lit("high"))
    return s.select("trajectory_id", "error.stage", "error.message")


@query("tool_call_rows", """
WITH t AS (SELECT conv_id, turn, text, '<tool_call>{"name": "a", "arguments": {"n": ' || length(text) || '}}</tool_call>' AS c FROM conversations), u AS (SELECT conv_id * 100 + turn AS k, text, c, unnest(range(turn % 3)) AS i FROM t)
SELECT k, CAST(i AS INTEGER) AS call_no, 'a' AS name, regexp_extract(c, '"n": (\\d+)', 1) AS n FROM u""")
def tool_call_rows(spark, d):
    """No, one or two calls between copies of a turn's text, one row a call."""
    one = F.concat(F.lit('<tool_call>{"name": "a", "arguments": {"n": '), F.length("text").cast("string"), F.lit("}}</tool_call>"))
    s = F.concat(F.col("text"), F.array_join(F.array_repeat(F.concat(one, F.col("text")), (F.col("turn") % 3).cast("int")), ""))
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), s.alias("s"))
    return registry.tool_call_rows(c, "k", "s").select("k", "call_no", "name", F.get_json_object("arguments", "$.n").alias("n"))


@query("equal_answers", """
SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN true WHEN 1 THEN doc_id % 2 = 0 WHEN 2 THEN true WHEN 3 THEN doc_id % 2 = 0 ELSE true END AS equal FROM documents""")
def equal_answers(spark, d):
    """Percent forms, intervals (closed or not), tuples of fractions, matrices (one entry off in half the rows), products."""
    k, i = F.col("n_chars") % 5, F.col("n_chars").cast("string")
    odd = F.col("doc_id") % 2 == 1
    given = F.when(k == 0, F.concat(i, F.lit("%"))).when(k == 1, F.concat(F.lit("Interval"), F.when(odd, ".open").otherwise(""), F.lit("(0, "), i, F.lit(")"))).when(k == 2, F.concat(F.lit("(0.5, "), i, F.lit(")")))
    given = given.when(k == 3, F.concat(F.lit("[["), i, F.lit(", 0], [0, "), F.when(odd, "3").otherwise("2"), F.lit("]]"))).otherwise(F.concat(F.lit("2(x+"), i, F.lit(")")))
    truth = F.when(k == 0, (F.col("n_chars") / 100).cast("string")).when(k == 1, F.concat(F.lit("[0, "), i, F.lit("]"))).when(k == 2, F.concat(F.lit("(\\frac{1}{2}, "), i, F.lit(")")))
    truth = truth.when(k == 3, F.concat(F.lit("\\begin{pmatrix} "), i, F.lit(" & 0 \\\\ 0 & 2 \\end{pmatrix}"))).otherwise(F.concat(F.lit("2x+"), (F.col("n_chars") * 2).cast("string")))
    return documents(spark, d, "doc_id", "n_chars").select("doc_id", math_scorers.answers_equal(given, truth).alias("equal"))


@query("plain_answers", r"""
SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN '\frac{' || n_chars % 9 || '}{' || doc_id % 9 || '}' WHEN 1 THEN CAST(n_chars * 1000 AS VARCHAR) WHEN 2 THEN CAST(n_chars AS VARCHAR) ELSE '\sqrt{' || n_chars % 9 || '}' END AS plain,
CASE n_chars % 4 WHEN 0 THEN '\frac{' || n_chars % 9 || '}{' || doc_id % 9 || '}' WHEN 1 THEN 'a=' || n_chars || ',000units' WHEN 2 THEN CAST(n_chars AS VARCHAR) ELSE '\sqrt{' || n_chars % 9 || '}' END AS latex FROM documents""")
def plain_answers(spark, d):
    k, n, i = F.col("n_chars") % 4, F.col("n_chars"), F.col("doc_id")
    nine = lambda c: (c % 9).cast("string")
    s = F.when(k == 0, F.concat(F.lit("\\frac"), nine(n), nine(i))).when(k == 1, F.concat(F.lit("a = "), n.cast("string"), F.lit(",000 units"))).when(k == 2, F.concat(n.cast("string"), F.lit("\\text{ cm}"))).otherwise(F.concat(F.lit("\\sqrt"), nine(n)))
    latex = F.when(k == 1, F.concat(F.lit("a="), n.cast("string"), F.lit(",000units"))).otherwise(math_scorers.latex_normal(s))
    return documents(spark, d, "doc_id", "n_chars").select("doc_id", math_scorers.answer_plain(s).alias("plain"), latex.alias("latex"))
