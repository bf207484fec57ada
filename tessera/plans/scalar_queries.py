"""Further scalar functions, lookups and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text, tools
from ..operators import convert, losses, packing, sampling, trajectory
from .catalogue import query
from .views import STEPS, steps, table


@query("score_order", f"WITH {STEPS} SELECT trajectory_id, score FROM steps ORDER BY coalesce(CASE WHEN budget > 0 THEN score END, parent_score, 0) DESC, trajectory_id")
def score_order(spark, d):
    s = steps(spark, d).withColumn("raw", F.col("score")).withColumn("score_1", F.col("parent_score")).withColumn("score", F.when(F.col("budget") > 0, F.col("raw")))
    return sampling.score_order(s, "trajectory_id").select("trajectory_id", F.col("raw").alias("score"))


@query("resumable", "SELECT event_id, ts::VARCHAR AS updated_at FROM events WHERE event_type = 'click' ORDER BY ts")
def resumable(spark, d):
    e = trajectory.resumable(table(spark, d, "events"), "event_type", "ts", "event_id", "click")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at")).withColumn("updated_at", F.regexp_replace("updated_at", r"\.?0+$", ""))


@query("nonempty_labels", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND text IS NOT NULL")
def nonempty_labels(spark, d):
    c = table(spark, d, "conversations").withColumn("label", F.when(F.col("role") == "assistant", F.col("text")))
    return convert.nonempty_labels(c, "label").select("conv_id", "turn")


@query("request_lookup", "SELECT page_id, url FROM pages WHERE replace(url, '-', '') = (SELECT replace(url, '-', '') FROM pages WHERE page_id = 3)")
def request_lookup(spark, d):
    from ..sources.files import by_request

    p = table(spark, d, "pages")
    wanted = p.where("page_id = 3").first()["url"]
    return by_request(p.withColumnRenamed("url", "request_id"), wanted).select("page_id", F.col("request_id").alias("url"))


@query("dedup_boxes", """
WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, [round(l_discount + l_linenumber * 1e-8, 6), l_tax, 1.0, l_quantity] AS b FROM lineitem), f AS (SELECT k, b, min(n) AS n FROM b GROUP BY 1, 2)
SELECT k, count(*) AS boxes, array_to_string(list(b[1]::DECIMAL(9,2) ORDER BY n, b), ',') AS lefts FROM f GROUP BY 1""")
def dedup_boxes(spark, d):
    """The first of boxes that are equal to six places stays; lines with equal numbers stand in the order of their boxes."""
    box = F.array(F.col("l_discount") + F.col("l_linenumber") * 1e-8, F.col("l_tax"), F.lit(1.0), F.col("l_quantity"))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", box.alias("b")))).alias("s"))
    u = geo.distinct_boxes(F.col("s.b"))
    return g.select("k", F.size(u).cast("long").alias("boxes"), F.array_join(F.transform(u, lambda b: b[0].cast("decimal(9,2)").cast("string")), ",").alias("lefts"))


@query("kto_classes", "SELECT count(*) FILTER (quality = 1) AS desirable, count(*) FILTER (quality = 0) AS undesirable, count(*) FILTER (quality = 1) = 0 OR count(*) FILTER (quality = 0) = 0 AS one_kind FROM labels")
def kto_classes(spark, d):
    from ..operators import encode

    return encode.one_preference(table(spark, d, "labels").select((F.col("quality") == 1).alias("kto_tags")))


@query("resolve_artifacts", "SELECT o_orderkey, c_name AS path FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def resolve_artifacts(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("path"))
    return trajectory.resolve_artifacts(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "c_custkey", "path", strict=False).select("o_orderkey", "path")


@query("tool_sets", "SELECT p_partkey, array_to_string(list_sort(list_intersect([p_type, 'crop'], ['crop', p_brand])), ',') AS both_sides, CAST(p_type <> 'ECONOMY' AS INTEGER) AS outside FROM part")
def tool_sets(spark, d):
    used, expected = F.array("p_type", F.lit("crop")), F.array(F.lit("crop"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_intersect(used, expected)), ",").alias("both_sides"), F.size(F.array_except(used, F.array(F.lit("ECONOMY"), F.lit("crop")))).alias("outside"))


@query("zip_shortest", """
WITH g AS (SELECT l_orderkey AS k, list({'t': l_returnflag || l_linenumber, 'y': CAST(l_quantity AS INTEGER)} ORDER BY l_linenumber, l_returnflag, l_quantity) AS s FROM lineitem GROUP BY 1),
u AS (SELECT k, unnest(list_transform(s[1:3], lambda x, i: {'t': x.t, 'y': x.y, 'i': i, 'n': len(s)})) AS x FROM g)
SELECT k, array_to_string(list(x.t || ':' || CASE WHEN x.n = 2 THEN '0.5' ELSE '1.0' END ORDER BY x.y, x.t), ',') AS pairs FROM u GROUP BY 1""")
def zip_shortest(spark, d):
    """At most three boxes a row of texts, and two scores: they count where there are just two texts."""
    from ..operators import ocr

    y = F.col("l_quantity").cast("int")
    row = F.struct("l_linenumber", "l_returnflag", "l_quantity", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("t"), F.array(F.lit(0), y, F.lit(1), F.lit(1)).alias("b"))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("s"))
    i = ocr.items(F.col("s.t"), F.array(F.lit(0.5), F.lit(0.5)), F.slice(F.col("s.b"), 1, 3))
    return g.select("k", F.array_join(F.transform(i, lambda r: F.concat_ws(":", r["text"], r["score"].cast("string"))), ",").alias("pairs"))


_W = "w AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q, l_linenumber * 3 AS z FROM lineitem)"


def _rows(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), (F.col("l_linenumber") * 3).alias("z"))


@query("normal_boxes", f"""
WITH {_W} SELECT k, n, p, s, CAST(greatest(least(round_even(least(q, q + 2.5) - 1, 0), 100), 0) AS INTEGER) AS x1, CAST(greatest(least(round_even(q + 2.5 + 1, 0), 100), 0) AS INTEGER) AS x2 FROM w""")
def normal_boxes(spark, d):
    q = F.col("q")
    b = geo.normal_box(F.array(q + 2.5, F.lit(40.0), q, F.lit(2.0)), F.lit(100), F.lit(100), 1)
    return _rows(spark, d).select("k", "n", "p", "s", b[0].alias("x1"), b[2].alias("x2"))


@query("centre_boxes", f"WITH {_W} SELECT k, n, p, s, round((q / 100 - 0.05) * 640, 6) AS x1, CAST(288.0 AS DOUBLE) AS y2, q / 60 < 200 AND z > 0 AS valid FROM w")
def centre_boxes(spark, d):
    b = geo.centre_to_corners(F.array(F.col("q") / 100, F.lit(0.5), F.lit(0.1), F.lit(0.2)), F.lit(640), F.lit(480))
    return _rows(spark, d).select("k", "n", "p", "s", F.round(b[0], 6).alias("x1"), F.round(b[3], 6).alias("y2"), geo.valid_size(F.col("q"), F.col("z"), 200.0).alias("valid"))


@query("round_up", f"WITH {_W} SELECT k, n, p, s, CAST(ceil(q / 8) AS BIGINT) AS blocks, CAST(ceil(q / 8) * 8 AS BIGINT) AS padded FROM w")
def round_up(spark, d):
    return _rows(spark, d).select("k", "n", "p", "s", geo.ceil_div(F.col("q"), 8).cast("long").alias("blocks"), geo.round_up(F.col("q"), 8).cast("long").alias("padded"))


@query("reward_at_end", f"WITH {_W} SELECT k, n, p, s, z + 1 AS place, q AS reward FROM w")
def reward_at_end(spark, d):
    a = losses.reward_at_end(F.lit(32), F.col("z") + 1, F.col("q"))
    return _rows(spark, d).select("k", "n", "p", "s", a.alias("a")).select("k", "n", "p", "s", F.array_position("a", F.array_max("a")).cast("int").alias("place"), F.array_max("a").alias("reward"))


@query("sft_loss_mask", """
WITH p AS (SELECT doc_id, n_chars % 20 AS t, greatest(n_chars % 7, 1) AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(range(t), lambda i: CASE WHEN i < p - 1 OR i = t - 1 THEN 0 ELSE 1 END), '') AS mask FROM p""")
def sft_loss_mask(spark, d):
    t, p = (F.col("n_chars") % 20).cast("int"), F.greatest(F.col("n_chars") % 7, F.lit(1)).cast("int")
    m = packing.sft_loss_mask(F.array_repeat(F.lit(1), t), p, F.greatest(t - p, F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.array_join(m.cast("array<string>"), "").alias("mask"))


@query("media_mismatch", "SELECT conv_id, turn, CAST(turn % 3 - 1 AS INTEGER) AS mismatch FROM conversations")
def media_mismatch(spark, d):
    c = table(spark, d, "conversations")
    text_ = F.concat(F.array_join(F.array_repeat(F.lit("<image>"), (F.col("turn") % 3).cast("int")), ""), F.col("text"))
    return c.select("conv_id", "turn", convert.media_mismatch(F.array(convert.message("user", text_)), F.array(F.lit("a.png"))).alias("mismatch"))


@query("restore_order", """
WITH p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars % 97, doc_id) - 1 AS place, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents)
SELECT row, place, doc_id, n_chars + place AS result FROM p""")
def restore_order(spark, d):
    """Rows dealt in another order (by length modulo 97); results of the dealt order, which know their place only, are
    put back by the inverse of the permutation and meet the rows of the former order again."""
    from ..operators.rows import dense_index, restored

    docs = dense_index(table(spark, d, "documents").select("doc_id", "n_chars", (F.col("n_chars") % 97).alias("h")), "doc_id", name="origin")
    dealt = dense_index(docs, "h", "doc_id", name="place")
    results = dealt.select("place", (F.col("n_chars") + F.col("place")).alias("result"))
    back = restored(results, dealt.select("place", "origin"))
    return back.join(docs.select(F.col("origin").alias("row"), "doc_id"), "row").select("row", "place", "doc_id", "result")


@query("preference_blocks", "WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, quality, toxic) - 1 AS r, count(*) OVER () AS n FROM labels) SELECT doc_id, 'chosen' AS kind, r AS place FROM l UNION ALL SELECT doc_id, 'rejected', r + n FROM l")
def preference_blocks(spark, d):
    from ..operators.rows import dense_index

    l = dense_index(table(spark, d, "labels"), "doc_id", "quality", "toxic")
    return convert.preference_blocks(l.select("doc_id", "row"), "row").select("doc_id", "kind", "place")


@query("log_tail", "SELECT doc_id, right(text, 200) AS tail FROM documents")
def log_tail(spark, d):
    from ..sources.files import log_tail as tail

    return table(spark, d, "documents").select("doc_id", tail(F.col("text"), 200).alias("tail"))


@query("last_progress", "SELECT max_by(event_id, ts) AS event_id, max_by(value, ts) AS value FROM events")
def last_progress(spark, d):
    from ..sources.files import latest

    return latest(table(spark, d, "events").select("event_id", "value", "ts"), "ts").select("event_id", "value")


@query("data_urls", "SELECT item_id, text FROM benchmark")
def data_urls(spark, d):
    b = table(spark, d, "benchmark")
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    return b.select("item_id", F.decode(text.from_data_url(url), "UTF-8").alias("text"))


@query("passages", "SELECT item_id, 'Doc 1(Title: ' || split_part(text, chr(10), 1) || ') ' || regexp_replace(text, '^[^\\n]*\\n?', '') || chr(10) AS shown FROM benchmark")
def passages(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.passages_text(F.array("text")).alias("shown"))


@query("described_tools", r"""
WITH s AS (SELECT p_partkey, p_name || CASE p_size % 6 WHEN 0 THEN ': Mirror horizontally, then CROP [' || p_size || ', 2, 30.5, 40]' WHEN 1 THEN ' vertical flip of ' || p_type WHEN 2 THEN ' crop (' || p_size || ',' || p_partkey || ' , 3, 4) or [1, 2, 3]' WHEN 3 THEN ' FLIP it, Horizontal and vertical, no box [1, 2, x, 4]' WHEN 4 THEN ' crops [1.2.3, 2, 3, 4] and (1, 2, 3, 4)' ELSE p_type END AS s FROM part),
t AS (SELECT p_partkey, lower(s) AS low, regexp_extract_all(s, '\[\s*-?[\d.]+\s*,\s*-?[\d.]+\s*,\s*-?[\d.]+\s*,\s*-?[\d.]+\s*\]')[1] AS square, regexp_extract_all(s, '\(\s*-?[\d.]+\s*,\s*-?[\d.]+\s*,\s*-?[\d.]+\s*,\s*-?[\d.]+\s*\)')[1] AS curved FROM s),
n AS (SELECT *, list_transform(regexp_extract_all(coalesce(square, curved), '-?[\d.]+'), lambda x: TRY_CAST(x AS DOUBLE)) AS box FROM t)
SELECT p_partkey, concat_ws(',', CASE WHEN contains(low, 'horizontal') AND (contains(low, 'flip') OR contains(low, 'mirror')) THEN 'flip_horizontal' END, CASE WHEN contains(low, 'vertical') AND contains(low, 'flip') THEN 'flip_vertical' END, CASE WHEN contains(low, 'crop') THEN 'crop' END) AS used,
 CASE WHEN list_count(box) = 4 THEN box[1] END AS x1, CASE WHEN list_count(box) = 4 THEN box[2] END AS y1, CASE WHEN list_count(box) = 4 THEN box[3] END AS x2 FROM n""")
def described_tools(spark, d):
    """Descriptions around the parts' names and types: transforms named in them, boxes in either bracket, and none."""
    k, n = F.col("p_size") % 6, F.col("p_size").cast("string")
    s = F.when(k == 0, F.concat(F.lit(": Mirror horizontally, then CROP ["), n, F.lit(", 2, 30.5, 40]"))).when(k == 1, F.concat(F.lit(" vertical flip of "), "p_type")).when(k == 2, F.concat(F.lit(" crop ("), n, F.lit(","), F.col("p_partkey").cast("string"), F.lit(" , 3, 4) or [1, 2, 3]")))
    s = F.concat("p_name", s.when(k == 3, " FLIP it, Horizontal and vertical, no box [1, 2, x, 4]").when(k == 4, " crops [1.2.3, 2, 3, 4] and (1, 2, 3, 4)").otherwise(F.col("p_type")))
    box = tools.described_box(s)
    return table(spark, d, "part").select("p_partkey", F.array_join(tools.described_transforms(s), ",").alias("used"), box[0].alias("x1"), box[1].alias("y1"), box[2].alias("x2"))


_STRIP = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_JSON_BODY = rf"""b AS (SELECT doc_id, s, {_STRIP("regexp_replace(regexp_replace(" + _STRIP("s") + r", '^```[a-zA-Z]*\s*', ''), '\s*```$', '')")} AS bare FROM s),
o AS (SELECT *, regexp_extract(bare, '(?s)\{{.*\}}') AS outer_ FROM b), j AS (SELECT doc_id, s, CASE WHEN json_valid(bare) THEN bare WHEN json_valid(outer_) THEN outer_ END AS j FROM o)"""


@query("planner_contract", rf"""
WITH k AS (SELECT doc_id, text AS t, n_chars % 10 AS k FROM documents),
s AS (SELECT doc_id, CASE k WHEN 0 THEN '```json' || chr(10) || CAST(to_json({{'mode': 'Answer ', 'think': 'x', 'answer': t}}) AS VARCHAR) || chr(10) || '```' WHEN 1 THEN CAST(to_json({{'mode': 'answer', 'think': t, 'answer': t, 'suggestions': [{{'plan': t}}, {{'plan': 'b'}}]}}) AS VARCHAR)
  WHEN 2 THEN CAST(to_json({{'mode': 'guess', 'think': t, 'answer': t}}) AS VARCHAR) WHEN 3 THEN CAST(to_json({{'mode': 'suggestions', 'think': t, 'suggestions': [{{'plan': t}}, {{'plan': 'b'}}]}}) AS VARCHAR) WHEN 4 THEN '<think>a</think>' || chr(10) || '<answer>' || t || '</answer>' WHEN 5 THEN '<think>a</think> no more'
  WHEN 6 THEN '<think>a</think><suggestions>' || CAST(to_json([t, t, 'c']) AS VARCHAR) || '</suggestions>' WHEN 7 THEN '<answer>' || t || '</answer><think>late</think>' WHEN 8 THEN 'So it is: ' || CAST(to_json({{'mode': 'suggestions', 'think': ' ', 'answer': t, 'suggestions': [1]}}) AS VARCHAR) ELSE t || '<think>a</think><answer>b</answer><answer>c</answer>' END AS s FROM k), {_JSON_BODY},
f AS (SELECT doc_id, s, coalesce(json_type(j) = 'OBJECT' AND json_exists(j, '$.mode') AND json_exists(j, '$.think'), false) AS is_json, lower({_STRIP("json_extract_string(j, '$.mode')")}) AS mode, json_extract_string(j, '$.answer') AS answer, nullif(json_type(j, '$.suggestions'), 'NULL') AS offered, json_array_length(j, '$.suggestions') AS listed,
  regexp_extract_all(s, '(?s)<think>(.*?)</think>', 1) AS th, regexp_extract_all(s, '(?s)<answer>(.*?)</answer>', 1) AS an, regexp_extract_all(s, '(?s)<suggestions>(.*?)</suggestions>', 1) AS su FROM j),
e AS (SELECT *, CASE WHEN is_json THEN CASE WHEN mode = 'answer' AND offered IS NOT NULL THEN 'answer and suggestions' WHEN mode = 'answer' AND answer IS NULL THEN 'answer is missing' WHEN mode = 'answer' AND {_STRIP("answer")} = '' THEN 'answer is empty'
    WHEN mode = 'suggestions' AND coalesce(answer, '') <> '' THEN 'answer and suggestions' WHEN mode = 'suggestions' AND coalesce(offered, '') <> 'ARRAY' THEN 'suggestions are no array' WHEN mode NOT IN ('answer', 'suggestions') THEN 'unknown mode' END
  WHEN (contains(s, '<answer>') AND instr(s, '<answer>') < instr(s, '<think>')) OR (contains(s, '<suggestions>') AND instr(s, '<suggestions>') < instr(s, '<think>')) THEN 'think comes late' WHEN len(th) > 1 OR len(an) > 1 OR len(su) > 1 THEN 'repeated tag' WHEN len(th) = 0 THEN 'think is missing' WHEN {_STRIP("th[1]")} = '' THEN 'think is empty'
  WHEN len(an) + len(su) = 2 THEN 'answer and suggestions' WHEN len(an) + len(su) = 0 THEN 'neither answer nor suggestions' WHEN {_STRIP("an[1]")} = '' THEN 'answer is empty' WHEN len(su) = 1 AND NOT (json_valid(su[1]) AND json_type(CASE WHEN json_valid(su[1]) THEN su[1] END) = 'ARRAY') THEN 'suggestions are no array' END AS error,
  CASE WHEN is_json THEN mode = 'answer' ELSE len(an) > 0 END AS can FROM f)
SELECT doc_id, error, CASE WHEN error IS NULL AND can THEN {_STRIP("CASE WHEN is_json THEN answer ELSE an[1] END")} END AS answer, CASE WHEN error IS NOT NULL OR can THEN 0 WHEN is_json THEN CAST(listed AS INTEGER) ELSE CAST(json_array_length(su[1]) AS INTEGER) END AS suggestions, CASE WHEN error IS NULL THEN can END AS can_answer_now FROM e""")
def planner_contract(spark, d):
    """Planner outputs around whole texts: JSON answers and suggestions, both, a wrong mode, prose around them, and tags,
    late, repeated or left out. The SQL builds the same texts and reads them by the contract."""
    k = F.col("n_chars") % 10
    json = lambda **c: F.to_json(F.struct(*(v.alias(n) for n, v in c.items())), {"ignoreNullFields": "false"})
    t = F.col("text")
    two = F.array(F.struct(t.alias("plan")), F.struct(F.lit("b").alias("plan")))
    s = F.when(k == 0, F.concat(F.lit("```json\n"), json(mode=F.lit("Answer "), think=F.lit("x"), answer=t), F.lit("\n```"))).when(k == 1, json(mode=F.lit("answer"), think=t, answer=t, suggestions=two)).when(k == 2, json(mode=F.lit("guess"), think=t, answer=t)).when(k == 3, json(mode=F.lit("suggestions"), think=t, suggestions=two))
    s = s.when(k == 4, F.concat(F.lit("<think>a</think>\n<answer>"), t, F.lit("</answer>"))).when(k == 5, F.lit("<think>a</think> no more")).when(k == 6, F.concat(F.lit("<think>a</think><suggestions>"), F.to_json(F.array(t, t, F.lit("c"))), F.lit("</suggestions>")))
    s = s.when(k == 7, F.concat(F.lit("<answer>"), t, F.lit("</answer><think>late</think>"))).when(k == 8, F.concat(F.lit("So it is: "), json(mode=F.lit("suggestions"), think=F.lit(" "), answer=t, suggestions=F.array(F.lit(1))))).otherwise(F.concat(t, F.lit("<think>a</think><answer>b</answer><answer>c</answer>")))
    p = text.planner_output(s)
    return table(spark, d, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.error", F.col("p.direct_answer").alias("answer"), F.coalesce(F.size("p.suggestions"), F.lit(0)).alias("suggestions"), "p.can_answer_now")


@query("executor_contract", rf"""
WITH k AS (SELECT doc_id, text AS t, n_chars % 7 AS k FROM documents),
s AS (SELECT doc_id, CASE k WHEN 3 THEN 'no braces here' WHEN 5 THEN '```' || CAST(to_json({{'think': t, 'tool_call': t}}) AS VARCHAR) || '```' ELSE CASE WHEN k = 6 THEN t || ' ' ELSE '' END || CAST(to_json({{'think': CASE WHEN k = 4 THEN ' ' ELSE 'why' END, 'tool_call': {{'name': CASE WHEN k = 1 THEN 'another_tool' ELSE 'code_image_tool' END, 'arguments': {{'code': CASE WHEN k = 2 THEN ' code ' ELSE t END, 'description': CASE WHEN k = 2 THEN t ELSE 'd' END}}}}}}) AS VARCHAR) END AS s FROM k), {_JSON_BODY},
f AS (SELECT doc_id, coalesce(json_type(j) = 'OBJECT' AND json_exists(j, '$.think') AND json_exists(j, '$.tool_call'), false) AS ok, coalesce({_STRIP("json_extract_string(j, '$.think')")}, '') AS think, coalesce(json_type(j, '$.tool_call') = 'OBJECT', false) AS called, coalesce({_STRIP("json_extract_string(j, '$.tool_call.name')")}, '') AS name, coalesce(json_type(j, '$.tool_call.arguments') = 'OBJECT', false) AS given,
  coalesce({_STRIP("json_extract_string(j, '$.tool_call.arguments.code')")}, '') AS code, coalesce({_STRIP("json_extract_string(j, '$.tool_call.arguments.description')")}, '') AS said FROM j),
e AS (SELECT *, CASE WHEN NOT ok THEN 'no JSON object' WHEN think = '' THEN 'empty think' WHEN NOT called THEN 'no tool call' WHEN name <> 'code_image_tool' THEN 'wrong tool name' WHEN NOT given THEN 'no arguments' WHEN code = '' THEN 'empty code' WHEN said = '' THEN 'empty description' END AS error FROM f)
SELECT doc_id, error, CASE WHEN error IS NULL THEN code END AS code FROM e""")
def executor_contract(spark, d):
    """Executor outputs around whole texts: sound calls, bare and behind prose, and six faults. The SQL builds the same
    texts and reads them by the contract."""
    k, t = F.col("n_chars") % 7, F.col("text")
    call = lambda name, code, said, think=F.lit("why"): F.to_json(F.struct(think.alias("think"), F.struct(F.lit(name).alias("name"), F.struct(code.alias("code"), said.alias("description")).alias("arguments")).alias("tool_call")), {"ignoreNullFields": "false"})
    s = F.when(k == 0, call("code_image_tool", t, F.lit("d"))).when(k == 1, call("another_tool", t, F.lit("d"))).when(k == 2, call("code_image_tool", F.lit(" code "), t)).when(k == 3, F.lit("no braces here")).when(k == 4, call("code_image_tool", t, F.lit("d"), F.lit(" ")))
    s = s.when(k == 5, F.concat(F.lit("```"), F.to_json(F.struct(t.alias("think"), t.alias("tool_call")), {"ignoreNullFields": "false"}), F.lit("```"))).otherwise(F.concat(t, F.lit(" "), call("code_image_tool", t, F.lit("d"))))
    return table(spark, d, "documents").select("doc_id", text.executor_output(s).alias("e")).select("doc_id", "e.error", "e.code")


@query("fenced_json", r"""
WITH s AS (SELECT doc_id, n_chars % 4 AS k, CAST(to_json({'k': doc_id, 't': text}) AS VARCHAR) AS j FROM documents)
SELECT doc_id, CASE WHEN k < 3 THEN doc_id END AS k, CASE WHEN k < 3 THEN json_extract_string(j, '$.t') END AS t FROM s""")
def fenced_json(spark, d):
    """Objects that hold whole texts: fenced, bare, inside prose, and a broken one."""
    k = F.col("n_chars") % 4
    j = F.to_json(F.struct(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("t")))
    s = F.when(k == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(k == 1, j).when(k == 2, F.concat(F.lit("say "), j, F.lit(" so"))).otherwise(F.concat(F.lit("none {"), j))
    got = text.fenced_json(s)
    return table(spark, d, "documents").select("doc_id", F.get_json_object(got, "$.k").cast("long").alias("k"), F.get_json_object(got, "$.t").alias("t"))


@query("flatten_struct", "SELECT event_id, value AS \"a/v\", user_id AS \"a/b/u\" FROM events")
def flatten_struct(spark, d):
    e = table(spark, d, "events").select("event_id", F.struct(F.col("value").alias("v"), F.struct(F.col("user_id").alias("u")).alias("b")).alias("a"))
    return text.flatten_struct(e.withColumn("a", F.struct(F.col("a").alias("a"))), "a")


@query("zoom_boxes", f"""
WITH {_W}, c AS (SELECT *, 0.7::DOUBLE * p % 150 - 20 AS a, 0.3::DOUBLE * s % 120 AS b FROM w),
x AS (SELECT k, n, p, s, greatest(a, 0) AS x1, greatest(b, 0) AS y1, least(a + q, 100) AS x2, least(b + z, 90) AS y2 FROM c),
g AS (SELECT *, x2 > x1 AND y2 > y1 AND greatest(x2 - x1, y2 - y1) / least(x2 - x1, y2 - y1) <= 100 AS ok, greatest(x2 - x1, 28) / 2 AS hw, greatest(y2 - y1, 28) / 2 AS hh, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM x),
l AS (SELECT *, greatest(least(cx - hw, 100 - 2 * hw), 0) AS lx, greatest(least(cy - hh, 90 - 2 * hh), 0) AS ly FROM g)
SELECT k, n, p, s, CASE WHEN ok THEN array_to_string([CAST(floor(lx) AS BIGINT), CAST(floor(ly) AS BIGINT), CAST(ceil(least(lx + 2 * hw, 100)) AS BIGINT), CAST(ceil(least(ly + 2 * hh, 90)) AS BIGINT)], ',') END AS box FROM l""")
def zoom_boxes(spark, d):
    a, b = F.lit(0.7) * F.col("p") % 150 - 20, F.lit(0.3) * F.col("s") % 120
    box = geo.zoom_box(F.array(a, b, a + F.col("q"), b + F.col("z")), F.lit(100), F.lit(90))
    return _rows(spark, d).select("k", "n", "p", "s", F.array_join(F.transform(box, lambda v: v.cast("long").cast("string")), ",").alias("box"))


@query("row_accuracy", "SELECT lang, avg(CAST(chosen > rejected AS DOUBLE)) AS accuracy FROM (SELECT lang, n_chars % 13 AS chosen, n_chars % 7 AS rejected FROM documents) GROUP BY 1")
def row_accuracy(spark, d):
    from ..operators import metrics

    docs = table(spark, d, "documents").select("lang", (F.col("n_chars") % 13).alias("c"), (F.col("n_chars") % 7).alias("r"))
    return docs.groupBy("lang").agg(metrics.reward_accuracy(F.col("c"), F.col("r")).alias("accuracy"))
