"""Text scorers, converters, truncation and packing over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import math_scorers, text
from ..operators import convert, metrics, packing
from ..operators.rows import dense_index
from .catalogue import query
from .views import table


def documents(spark, d, *columns):
    return table(spark, d, "documents").select(*(columns or ("doc_id", "text", "lang")))


@query("length_cdf", """
WITH h AS (SELECT n_chars // 500 * 500 AS bin, count(*) AS n FROM documents GROUP BY 1)
SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS running, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER () * 100, 6) AS percent FROM h""")
def length_cdf(spark, d):
    return metrics.length_cdf(documents(spark, d, "n_chars"), "n_chars", 500).withColumn("percent", F.round("percent", 6))


@query("prompt_filter", "SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '')) AS words FROM documents WHERE words <= 256")
def prompt_filter(spark, d):
    from ..operators.sampling import not_overlong, word_count

    return not_overlong(documents(spark, d), word_count(F.col("text")), 256, name="words").select("doc_id", "words")


@query("truncate_lengths", """
WITH l AS (SELECT doc_id, n_chars AS s, n_chars % 977 AS t FROM documents), m AS (SELECT *, CASE WHEN t * 2 < 1000 THEN 1000 WHEN s * 2 < 1000 THEN 1000 - s ELSE floor(1000 * (t / (s + t))) END AS most FROM l), n AS (SELECT *, CAST(least(most, t) AS BIGINT) AS nt FROM m)
SELECT doc_id, least(greatest(1000 - nt, 0), s) AS source, nt AS target FROM n""")
def truncate_lengths(spark, d):
    s, t = packing.truncated_lengths(F.col("n_chars"), F.col("n_chars") % 977, 1000)
    return documents(spark, d, "doc_id", "n_chars").select("doc_id", s.alias("source"), t.alias("target"))


@query("pretrain_blocks", "WITH b AS (SELECT doc_id // 100 AS batch_no, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY 1) SELECT batch_no, tokens, tokens // 2048 AS blocks, tokens % 2048 AS dropped FROM b")
def pretrain_blocks(spark, d):
    return packing.block_counts(documents(spark, d, "doc_id", "n_chars"), "doc_id", "n_chars", 2048, batch=100)


@query("pretrain_block_ids", """
WITH t AS (SELECT doc_id // 100 AS b, doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS v FROM documents), s AS (SELECT *, sum(len(v)) OVER (PARTITION BY b ORDER BY doc_id) - len(v) AS start FROM t),
w AS (SELECT b, start + unnest(range(len(v))) AS place, unnest(v) AS id FROM s), p AS (SELECT b, place // 64 AS k, list(id ORDER BY place) AS ids FROM w GROUP BY 1, 2)
SELECT b AS batch_no, CAST(k AS BIGINT) AS block_no, array_to_string(ids, ',') AS ids FROM p WHERE len(ids) = 64""")
def pretrain_block_ids(spark, d):
    """Whole texts; a word's id is its length."""
    ids = documents(spark, d).select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    return packing.pretrain_blocks(ids, "doc_id", "ids", 64, batch=100).select("batch_no", "block_no", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("knapsack_pack")
def knapsack_pack(spark, d):
    return packing.knapsack_pack(documents(spark, d, "doc_id", "n_chars"), "doc_id", "n_chars", 4096)


@query("kk_balance")
def kk_balance(spark, d):
    b = documents(spark, d, "doc_id", "n_chars").withColumn("batch", F.floor(F.col("doc_id") / 64).cast("long"))
    return packing.balance(b, "batch", "doc_id", "n_chars", 8)


@query("greedy_balance", """
WITH RECURSIVE b AS (SELECT doc_id // 64 AS batch, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) AS k FROM documents),
r AS (SELECT DISTINCT batch, CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS s, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS n_chars, CAST(NULL AS INTEGER) AS part FROM b
UNION ALL SELECT b.batch, b.k, list_transform(s, lambda x, i: CASE WHEN i = list_position(s, list_min(s)) THEN x + b.n_chars ELSE x END), b.doc_id, b.n_chars, CAST(list_position(s, list_min(s)) - 1 AS INTEGER) FROM r JOIN b ON b.batch = r.batch AND b.k = r.k + 1)
SELECT batch, doc_id, n_chars, part FROM r WHERE k > 0""")
def greedy_balance(spark, d):
    b = documents(spark, d, "doc_id", "n_chars").withColumn("batch", F.floor(F.col("doc_id") / 64).cast("long"))
    return packing.balance(b, "batch", "doc_id", "n_chars", 8, method="least_loaded")


@query("pad_to_batch", "SELECT doc_id, n_chars % 40 AS len, max(n_chars % 40) OVER (PARTITION BY doc_id // 16) AS padded FROM documents")
def pad_to_batch(spark, d):
    ids = documents(spark, d, "doc_id", "n_chars").select("doc_id", F.floor(F.col("doc_id") / 16).alias("b"), F.array_repeat(F.lit(1), (F.col("n_chars") % 40).cast("int")).alias("ids"))
    p = packing.pad_to_batch(ids, "b", "ids", 0)
    return p.select("doc_id", F.aggregate("padded", F.lit(0).cast("long"), lambda a, x: a + x).alias("len"), F.size("padded").cast("long").alias("padded"))


@query("pad_or_cut", "WITH i AS (SELECT doc_id, range(n_chars % 40) AS v FROM documents) SELECT doc_id, CASE WHEN len(v) > 16 THEN array_to_string(list_concat(v[1:8], v[len(v) - 7:]), ',') ELSE array_to_string(list_concat([0 FOR i IN range(16 - len(v))], v), ',') END AS ids FROM i")
def pad_or_cut(spark, d):
    ids = documents(spark, d, "doc_id", "n_chars").select("doc_id", F.filter(F.sequence(F.lit(0), (F.col("n_chars") % 40).cast("int")), lambda i: i < F.col("n_chars") % 40).alias("v"))
    return ids.select("doc_id", F.array_join(packing.pad_or_cut(F.col("v"), 16, 0, truncation="middle").cast("array<string>"), ",").alias("ids"))


@query("qa_normalize", r"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '(^|[^\pL\pN_])(a|an|the)($|[^\pL\pN_])', '\1 \3', 'g'), '(^|[^\pL\pN_])(a|an|the)($|[^\pL\pN_])', '\1 \3', 'g'), '\s+', ' ', 'g')) AS normal FROM benchmark")
def qa_normalize(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.qa_normalize(F.col("text")).alias("normal"))


@query("qa_em", r"""
WITH n AS (SELECT item_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '(^|[^\pL\pN_])(a|an|the)($|[^\pL\pN_])', '\1 \3', 'g'), '(^|[^\pL\pN_])(a|an|the)($|[^\pL\pN_])', '\1 \3', 'g'), '\s+', ' ', 'g')) AS x FROM benchmark)
SELECT p.item_id, CAST(max(CAST(p.x = g.x AS INTEGER)) AS INTEGER) AS em, CAST(max(CAST(contains(p.x, g.x) AS INTEGER)) AS INTEGER) AS sub_em FROM n p JOIN n g ON g.item_id = p.item_id // 2 GROUP BY 1""")
def qa_em(spark, d):
    b = table(spark, d, "benchmark")
    j = b.join(b.select(F.col("item_id").alias("g"), F.array(F.col("text")).alias("golds")), F.floor(F.col("item_id") / 2) == F.col("g"))
    return j.select("item_id", text.exact_match(F.col("text"), F.col("golds")).alias("em"), text.sub_exact_match(F.col("text"), F.col("golds")).alias("sub_em"))


_SOLVED = "solved AS (SELECT doc_id, text || ' #### ' || CASE WHEN doc_id % 3 = 0 THEN '$1,' || doc_id ELSE CAST(doc_id AS VARCHAR) END || CASE WHEN doc_id % 4 = 0 THEN '.' ELSE ' done' END AS s FROM documents)"


def solved(spark, d):
    n = F.col("doc_id").cast("string")
    return documents(spark, d).select("doc_id", F.concat(F.col("text"), F.lit(" #### "), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("$1,"), n)).otherwise(n), F.when(F.col("doc_id") % 4 == 0, ".").otherwise(" done")).alias("s"))


@query("gsm8k_extract", rf"""
WITH {_SOLVED}, x AS (SELECT doc_id, regexp_extract_all(right(s, 300), '#### (-?[0-9.,]+)', 1) AS a, regexp_extract_all(right(s, 300), '(-?[0-9.,]+)', 1) AS f FROM solved)
SELECT doc_id, regexp_replace(a[-1], '[,$]', '', 'g') AS strict, coalesce(list_filter(f, lambda v: v NOT IN ('', '.'))[-1], f[1]) AS flexible, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE WHEN regexp_replace(a[-1], '[,$]', '', 'g') = CAST(doc_id AS VARCHAR) THEN 1.0 ELSE 0.1 END AS score FROM x""")
def gsm8k_extract(spark, d):
    s = F.col("s")
    return solved(spark, d).select("doc_id", text.gsm8k_strict(s).alias("strict"), text.gsm8k_flexible(s).alias("flexible"), text.gsm8k_score(s, F.col("doc_id").cast("string"), format_score=0.1).alias("score"))


_TAGGED = "tagged AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<think>x</think> <answer> ' || text || ' </answer>' WHEN 1 THEN '<think>a</think><tool_response>t</tool_response>no tag' || chr(10) || ' last ' || doc_id WHEN 2 THEN 'open <answer> ' || doc_id ELSE '<think><answer>1</answer></think><answer>' || doc_id || '</answer>' END AS s FROM documents)"


def tagged(spark, d):
    n = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 4
    s = F.when(k == 0, F.concat(F.lit("<think>x</think> <answer> "), F.col("text"), F.lit(" </answer>"))).when(k == 1, F.concat(F.lit("<think>a</think><tool_response>t</tool_response>no tag\n last "), n)).when(k == 2, F.concat(F.lit("open <answer> "), n)).otherwise(F.concat(F.lit("<think><answer>1</answer></think><answer>"), n, F.lit("</answer>")))
    return documents(spark, d).select("doc_id", s.alias("s"))


@query("answer_extract", rf"""
WITH {_TAGGED}, c AS (SELECT doc_id, s, regexp_replace(s, '(?s)<tool_response>.*?</tool_response>', '', 'g') AS x FROM tagged), a AS (SELECT *, regexp_extract_all(x, '(?s)<answer>(.*?)</answer>', 1) AS m, string_split(trim(x), '<answer>') AS p, string_split(trim(x), chr(10)) AS l FROM c)
SELECT doc_id, trim(CASE WHEN len(m) > 0 THEN m[-1] WHEN len(p) > 1 THEN p[-1] ELSE l[-1] END, ' ' || chr(10) || chr(9)) AS answer FROM a""")
def answer_extract(spark, d):
    return tagged(spark, d).select("doc_id", text.final_answer(F.col("s")).alias("answer"))


@query("format_reward", rf"""
WITH {_TAGGED}, x AS (SELECT doc_id, trim(regexp_replace(s, '(?s)<tool_response>.*?</tool_response>', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM tagged),
n AS (SELECT *, len(regexp_extract_all(x, '<think>')) AS o, len(regexp_extract_all(x, '</think>')) AS c, len(regexp_extract_all(x, '(?s)<answer>.*?</answer>')) AS a, list_filter(regexp_extract_all(x, '(?s)<think>.*?</think>'), lambda b: contains(b, '<answer>')) AS reach FROM x)
SELECT doc_id, CASE WHEN starts_with(x, '<think>') AND o = c AND o > 0 AND a = 1 AND regexp_matches(x, '(?s)<answer>.*?</answer>\s*$') AND len(reach) = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reward FROM n""")
def format_reward(spark, d):
    return tagged(spark, d).select("doc_id", text.format_reward(F.col("s")).alias("reward"))


@query("rule_verify", r"""
WITH p AS (SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN text || ' (' || chr(65 + CAST(doc_id % 5 AS INTEGER)) || ') ' WHEN 1 THEN 'about ' || n_chars || '.50 units' WHEN 2 THEN CAST(n_chars AS VARCHAR) ELSE text || ' is ' || n_chars END AS pred, CASE n_chars % 4 WHEN 0 THEN chr(65 + CAST(n_chars % 4 AS INTEGER)) WHEN 1 THEN n_chars || '.5' WHEN 2 THEN CAST(n_chars + doc_id % 2 AS VARCHAR) ELSE n_chars * 2 || '/2' END AS truth FROM documents),
u AS (SELECT *, upper(pred) AS up, regexp_extract_all(upper(pred), '(?:^|[^\pL\pN_])([A-D])(?:$|[^\pL\pN_])', 1) AS letters, regexp_extract_all(upper(pred), '[-+]?\d*\.?\d+') AS numbers, string_split(truth, '/') AS f FROM p),
v AS (SELECT *, CASE WHEN truth IN ('A', 'B', 'C', 'D') THEN letters[-1] ELSE coalesce(CAST(try_cast(trim(pred) AS DOUBLE) AS VARCHAR), numbers[-1]) END AS got, CASE WHEN len(f) = 2 THEN try_cast(f[1] AS DOUBLE) / try_cast(f[2] AS DOUBLE) ELSE try_cast(truth AS DOUBLE) END AS t FROM u)
SELECT doc_id, coalesce(pred = truth OR try_cast(pred AS DOUBLE) = try_cast(truth AS DOUBLE), false) OR coalesce(got = truth, false) OR coalesce(abs(try_cast(got AS DOUBLE) - t) <= 1e-4, false) AS correct FROM v""")
def rule_verify(spark, d):
    """Answers behind whole texts against a letter, a decimal, a whole number that is off by one in half the rows, and a
    fraction."""
    n, k = F.col("n_chars").cast("string"), F.col("n_chars") % 4
    pred = F.when(k == 0, F.concat("text", F.lit(" ("), F.char(F.lit(65) + F.col("doc_id") % 5), F.lit(") "))).when(k == 1, F.concat(F.lit("about "), n, F.lit(".50 units"))).when(k == 2, n).otherwise(F.concat("text", F.lit(" is "), n))
    truth = F.when(k == 0, F.char(F.lit(65) + F.col("n_chars") % 4)).when(k == 1, F.concat(n, F.lit(".5"))).when(k == 2, (F.col("n_chars") + F.col("doc_id") % 2).cast("string")).otherwise(F.concat((F.col("n_chars") * 2).cast("string"), F.lit("/2")))
    return documents(spark, d, "doc_id", "text", "n_chars").select("doc_id", text.equivalent_answers(pred, truth).alias("correct"))


@query("text_preview", r"WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS preview FROM x")
def text_preview(spark, d):
    return documents(spark, d).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("thought_removal", "SELECT doc_id, ltrim(regexp_replace('<think>' || text || '</think>' || chr(10) || chr(10) || text || '<think>b</think>', '(?s)<think>(.*?)</think>', '', 'g'), chr(10)) AS answer FROM documents")
def thought_removal(spark, d):
    s = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\n\n"), F.col("text"), F.lit("<think>b</think>"))
    return documents(spark, d).select("doc_id", text.without_thoughts(s).alias("answer"))


@query("child_ids", "SELECT doc_id, source || '__r' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '_' || lang AS child FROM documents")
def child_ids(spark, d):
    return documents(spark, d, "doc_id", "source", "lang").select("doc_id", text.child_id(F.col("source"), (F.col("doc_id") % 1000).cast("int"), F.col("lang")).alias("child"))


@query("tool_calls", """
WITH t AS (SELECT doc_id, text || '<tool_call>{"name": "a' || n_chars % 5 || '", "arguments": {"k": ' || n_chars || '}}</tool_call>y<tool_call>' || CASE n_chars % 3 WHEN 0 THEN 'bad' WHEN 1 THEN '{"name": "b"}' ELSE '{"name": "b", "arguments": {"k": 1}}' END || '</tool_call>' || text AS s FROM documents),
b AS (SELECT doc_id, s, regexp_extract_all(s, '(?s)<tool_call>(.*?)</tool_call>', 1) AS b FROM t),
g AS (SELECT *, list_filter(b, lambda x: CASE WHEN json_valid(x) THEN json_extract_string(x, '$.name') IS NOT NULL AND json_extract(x, '$.arguments') IS NOT NULL ELSE false END) AS g FROM b)
SELECT doc_id, len(g) AS calls, json_extract_string(g[1], '$.name') || json_extract_string(g[1], '$.arguments.k') AS first, regexp_replace(s, '(?s)<tool_call>.*?</tool_call>', '', 'g') AS rest, len(g) = len(b) AS all_good FROM g""")
def tool_calls(spark, d):
    """Two calls around and between whole texts; the second is broken or without arguments in two thirds of the rows."""
    k, n = F.col("n_chars") % 3, F.col("n_chars").cast("string")
    second = F.when(k == 0, "bad").when(k == 1, '{"name": "b"}').otherwise('{"name": "b", "arguments": {"k": 1}}')
    s = F.concat("text", F.lit('<tool_call>{"name": "a'), (F.col("n_chars") % 5).cast("string"), F.lit('", "arguments": {"k": '), n, F.lit("}}</tool_call>y<tool_call>"), second, F.lit("</tool_call>"), "text")
    t = documents(spark, d, "doc_id", "text", "n_chars").withColumn("s", s)
    c = text.tool_calls(F.col("s"))
    return t.select("doc_id", F.size(c).cast("long").alias("calls"), F.concat(c[0]["name"], F.get_json_object(c[0]["arguments"], "$.k")).alias("first"), text.without_tool_calls(F.col("s")).alias("rest"), text.strict_tool_calls(F.col("s")).isNotNull().alias("all_good"))


@query("page_titles", r"SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def page_titles(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.coalesce(text.single_tag(F.col("html"), "title")[0], F.lit("")).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("hellaswag_clean", r"SELECT item_id, replace(regexp_replace(replace(trim('[step] ' || text), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS clean, upper(left(text, 1)) || lower(substring(text, 2)) AS capital FROM benchmark")
def hellaswag_clean(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.hellaswag_clean(F.concat(F.lit("[step] "), F.col("text"))).alias("clean"), text.capitalized(F.col("text")).alias("capital"))


_CONV = "conv AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY 1)"


def conversations(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content")))).alias("s"))
    return g.select("conv_id", F.transform("s", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query("align_sharegpt", f"""
WITH {_CONV}, s AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m[1].content ELSE '' END AS sys, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS b FROM conv),
k AS (SELECT *, len(b) % 2 = 1 OR len(b) = 0 OR len(list_filter(b, lambda x, i: CASE WHEN i % 2 = 1 THEN x.role NOT IN ('user', 'observation') ELSE x.role NOT IN ('assistant', 'function') END)) > 0 AS broken FROM s)
SELECT conv_id, sys AS system, broken AS is_broken, CASE WHEN broken THEN 0 ELSE len(b) - 1 END AS prompts, CASE WHEN broken THEN '' ELSE array_to_string(list_transform(b[1:len(b) - 1], lambda x: x.role || ':' || x.content), '|') END AS prompt, CASE WHEN broken THEN NULL ELSE b[len(b)].content END AS response FROM k""")
def align_sharegpt(spark, d):
    tags = {"user": "user", "assistant": "assistant", "system": "system"}
    a = convert.align(conversations(spark, d), "sharegpt", messages="messages", role="role", content="content", tags=tags, keep=["conv_id", "is_broken"])
    return a.select("conv_id", F.col("_system").alias("system"), "is_broken", F.size("_prompt").cast("long").alias("prompts"), F.array_join(F.transform("_prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("prompt"), F.try_element_at("_response", F.lit(1))["content"].alias("response"))


@query("align_openai", f"""
WITH {_CONV}, s AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m[1].content ELSE '' END AS sys, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS b FROM conv),
k AS (SELECT *, len(b) % 2 = 1 OR len(b) = 0 OR len(list_filter(b, lambda x, i: CASE WHEN i % 2 = 1 THEN x.role <> 'user' ELSE x.role <> 'assistant' END)) > 0 AS broken FROM s)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN sys = '' THEN '' ELSE sys || chr(10) END WHEN sys = '' THEN 'detailed thinking off' WHEN contains(sys, 'detailed thinking on') OR contains(sys, 'detailed thinking off') THEN sys ELSE sys || chr(10) || 'detailed thinking off' END AS system,
  CASE WHEN broken THEN '' ELSE array_to_string(list_transform(b[1:len(b) - 1], lambda x: x.role || ':' || x.content), '|') END AS prompt, CASE WHEN broken THEN NULL ELSE b[len(b)].content END AS response FROM k""")
def align_openai(spark, d):
    c = conversations(spark, d).withColumn("tools", F.when(F.col("conv_id") % 3 == 0, F.lit("[]")))
    a = convert.align(c, "openai", keep=["conv_id"])
    return a.select("conv_id", F.col("_system").alias("system"), F.array_join(F.transform("_prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("prompt"), F.try_element_at("_response", F.lit(1))["content"].alias("response"))


@query("align_alpaca", "SELECT doc_id, 'user:' || CASE WHEN lang = 'en' THEN source ELSE source || chr(10) || lang END AS prompt, text AS response FROM documents")
def align_alpaca(spark, d):
    rows = documents(spark, d, "doc_id", "source", "lang", "text").select("doc_id", F.col("source").alias("instruction"), F.when(F.col("lang") != "en", F.col("lang")).alias("input"), F.col("text").alias("output"))
    a = convert.align(rows, "alpaca", keep=["doc_id"])
    return a.select("doc_id", F.array_join(F.transform("_prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("prompt"), F.col("_response")[0]["content"].alias("response"))


@query("weighted_messages", "SELECT doc_id, 'user:' || source || coalesce(lang, '') || ':0.0' || CASE WHEN text = '' THEN '' ELSE '|assistant:' || text || ':1.0' END AS messages FROM documents")
def weighted_messages(spark, d):
    rows = documents(spark, d, "doc_id", "source", "lang", "text").select("doc_id", F.col("source").alias("instruction"), F.col("lang").alias("input"), F.col("text").alias("output"))
    return convert.weighted_messages(rows).select("doc_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"][0]["value"], m["loss_weight"].cast("string"))), "|").alias("messages"))


@query("system_replace", f"WITH {_CONV} SELECT conv_id, 'system' AS first_role, 'You judge.' AS first, len(m) + CASE WHEN m[1].role = 'system' THEN 0 ELSE 1 END AS n FROM conv")
def system_replace(spark, d):
    s = conversations(spark, d).select("conv_id", convert.with_system(F.col("messages"), "You judge.").alias("m"))
    return s.select("conv_id", F.col("m")[0]["role"].alias("first_role"), F.col("m")[0]["content"].alias("first"), F.size("m").cast("long").alias("n"))


@query("content_parts", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CASE WHEN text = '' THEN 'image,video' ELSE 'image,text,video' END WHEN text = '' THEN '' ELSE 'text' END AS kinds, CASE WHEN text = '' THEN '' ELSE text END AS said FROM conversations")
def content_parts(spark, d):
    s = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>"), F.col("text"), F.lit("<video>"))).otherwise(F.col("text"))
    p = convert.content_parts(s)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(p, lambda x: x["type"]), ",").alias("kinds"), F.array_join(F.transform(F.filter(p, lambda x: x["type"] == "text"), lambda x: x["text"]), "").alias("said"))


@query("chat_template", f"WITH {_CONV} SELECT conv_id, array_to_string(list_transform(m, lambda x: CASE x.role WHEN 'system' THEN '<s>' || x.content || chr(10) WHEN 'user' THEN 'U: ' || x.content ELSE 'A: ' || x.content || '</s>' END), '') AS prompt FROM conv")
def chat_template(spark, d):
    f = {"system": "<s>{content}\n", "user": "U: {content}", "assistant": "A: {content}</s>"}
    return conversations(spark, d).select("conv_id", convert.template(F.col("messages"), f).alias("prompt"))


@query("last_assistant", f"WITH {_CONV} SELECT conv_id, coalesce(list_filter(m, lambda x: x.role = 'assistant')[-1].content, '') AS answer FROM conv")
def last_assistant(spark, d):
    return conversations(spark, d).select("conv_id", text.last_assistant(F.col("messages")).alias("answer"))


@query("choice_prompt", "SELECT p_partkey, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'Answer:' AS prompt FROM part")
def choice_prompt(spark, d):
    return table(spark, d, "part").select("p_partkey", convert.choice_prompt(F.col("p_name"), [F.col("p_brand"), F.col("p_type")]).alias("prompt"))


@query("rl_rows", "SELECT doc_id, source AS question, CAST(doc_id AS VARCHAR) AS truth, 'train' AS split FROM documents")
def rl_rows(spark, d):
    rows = documents(spark, d, "doc_id", "source")
    r = convert.rl_row(rows, source="docs", question=F.col("source"), truth=convert.gsm8k_truth(F.concat(F.lit("so #### "), F.col("doc_id").cast("string"))), ability="math", split="train", index="doc_id")
    return r.select(F.col("extra_info.index").alias("doc_id"), F.col("prompt")[0]["content"].alias("question"), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.split").alias("split"))


@query("dedup_group", """
WITH p AS (SELECT lang, source, doc_id, (row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) // 50 AS part, min(doc_id) OVER (PARTITION BY lang, source) AS first, count(*) OVER (PARTITION BY lang, source) AS members FROM documents)
SELECT lang, source, part, min(first) AS first, min(members) AS members, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM p GROUP BY 1, 2, 3""")
def dedup_group(spark, d):
    """The documents of a language and source, as rows that share an image: 50 ids a row."""
    from ..operators.sampling import group_members

    g = group_members(documents(spark, d, "lang", "source", "doc_id"), ["lang", "source"], "doc_id", per_row=50)
    return g.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("choice_argmax", "SELECT vec_id, substring('ABCD', CAST(list_position(embedding[1:4], list_max(embedding[1:4])) AS INTEGER), 1) AS letter FROM embeddings")
def choice_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", geo.choice_letter(F.slice("embedding", 1, 4)).alias("letter"))


@query("frame_positions", "SELECT doc_id, array_to_string([CAST(trunc(i * (n_chars - 1) / 7) AS BIGINT) FOR i IN range(8)], ',') AS frames FROM documents")
def frame_positions(spark, d):
    return documents(spark, d, "doc_id", "n_chars").select("doc_id", F.array_join(geo.frame_positions(F.col("n_chars"), F.lit(8)).cast("array<string>"), ",").alias("frames"))


@query("resize_pixels", """
WITH s AS (SELECT doc_id, 100 + n_chars AS w, 300 + n_chars % 500 AS h FROM documents), a AS (SELECT doc_id, CASE WHEN w * h > 500000 THEN floor(w * sqrt(500000.0::DOUBLE / (w * h))) ELSE w END AS w, CASE WHEN w * h > 500000 THEN floor(h * sqrt(500000.0::DOUBLE / (w * h))) ELSE h END AS h FROM s)
SELECT doc_id, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height FROM a""")
def resize_pixels(spark, d):
    r = geo.resized(F.lit(100) + F.col("n_chars"), F.lit(300) + F.col("n_chars") % 500, 500_000, 1)
    return documents(spark, d, "doc_id", "n_chars").select("doc_id", r.alias("r")).select("doc_id", F.col("r")[0].alias("width"), F.col("r")[1].alias("height"))


@query("math_boxed", r"""
WITH m AS (SELECT doc_id, n_chars, n_chars % 4 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN '\frac{' || doc_id || '}{' || n_chars || '}' WHEN 1 THEN '\text{' || doc_id || '}' WHEN 2 THEN doc_id || '\text{ cm}' END AS boxed, CASE k WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN CAST(doc_id % 2 = 0 AS DOUBLE) ELSE 0.0 END AS score FROM m""")
def math_boxed(spark, d):
    r"""Boxed answers behind whole texts: an unreduced \dfrac, nested braces, a unit (right in half the rows), none."""
    k, n, i = F.col("n_chars") % 4, F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    inner = F.when(k == 0, F.concat(F.lit("\\frac{"), i, F.lit("}{"), n, F.lit("}"))).when(k == 1, F.concat(F.lit("\\text{"), i, F.lit("}"))).otherwise(F.concat(i, F.lit("\\text{ cm}")))
    s = F.concat(F.coalesce("text", F.lit("")), F.when(k == 3, F.lit(" none")).otherwise(F.concat(F.lit(" so \\boxed{"), inner, F.lit("} so"))))
    g = F.when(k == 0, F.concat(F.lit("\\dfrac{"), i, F.lit("}{"), n, F.lit("}"))).when(k == 1, i).otherwise((F.col("doc_id") + F.col("doc_id") % 2).cast("string"))
    rows = documents(spark, d, "doc_id", "text", "n_chars").select("doc_id", s.alias("s"), g.alias("g"))
    return rows.select("doc_id", math_scorers.boxed_answer("s").alias("boxed"), math_scorers.math_score("s", "g").alias("score"))


@query("signed_answers", """
SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -1.0 WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE -1.0 END ELSE 1.0 END AS score FROM documents""")
def signed_answers(spark, d):
    """Answer lines behind whole texts: separators and a unit, no line, off by one in half the rows, an equation."""
    k, n, i = F.col("n_chars") % 4, F.format_number("n_chars", 0), F.col("n_chars").cast("string")
    said = F.when(k == 0, F.concat(F.lit("Answer: "), n, F.lit(" cm"))).when(k == 1, F.lit("none")).when(k == 2, F.concat(F.lit("answer : "), i)).otherwise(F.concat(F.lit("Answer: x = $"), i, F.lit("$.")))
    truth = F.when(k == 2, (F.col("n_chars") + F.col("doc_id") % 2).cast("string")).otherwise(i)
    rows = documents(spark, d, "doc_id", "text", "n_chars").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("s"), truth.alias("g"))
    return rows.select("doc_id", math_scorers.signed_math_score("s", "g").alias("score"))


@query("graded_answers", """
SELECT doc_id, CASE n_chars % 6 WHEN 0 THEN true WHEN 1 THEN doc_id % 2 = 0 WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS graded FROM documents""")
def graded_answers(spark, d):
    """Separators, a unit (off by one in half the rows), an unreduced fraction, a sum, a tuple, another bracket."""
    k, n, i = F.col("n_chars") % 6, F.format_number("n_chars", 0), F.col("n_chars").cast("string")
    more = (F.col("n_chars") + F.col("doc_id") % 2).cast("string")
    given = F.when(k == 0, n).when(k == 1, F.concat(i, F.lit(" meters"))).when(k == 2, F.concat((F.col("n_chars") * 2 + 2).cast("string"), F.lit("/4"))).when(k == 3, F.concat(F.lit("x+"), i)).when(k == 4, F.concat(F.lit("("), i, F.lit(", 2)"))).otherwise(F.concat(F.lit("["), i, F.lit(",2)")))
    truth = F.when(k == 0, i).when(k == 1, more).when(k == 2, F.concat((F.col("n_chars") + 1).cast("string"), F.lit("/2"))).when(k == 3, F.concat(i, F.lit("+x"))).when(k == 4, F.concat(F.lit("("), i, F.lit(",2)"))).otherwise(F.concat(F.lit("("), i, F.lit(",2)")))
    return documents(spark, d, "doc_id", "n_chars").select("doc_id", math_scorers.answers_graded(given, truth).alias("graded"))


@query("text_overlap")
def text_overlap(spark, d):
    rows = documents(spark, d).select("doc_id", F.col("text").alias("p"), F.substring("text", 41, 2**31 - 1).alias("g"))
    return rows.select("doc_id", math_scorers.text_overlap("p", "g").alias("o")).select("doc_id", "o.*")


@query("dense_rows", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS row FROM documents")
def dense_rows(spark, d):
    return dense_index(documents(spark, d, "doc_id", "n_chars"), "n_chars", "doc_id", rows_per_bucket=200).select("doc_id", "row")


@query("template_qwen3", f"""
WITH {_CONV}, s AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m[1].content ELSE '' END AS sys, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS b FROM conv), g AS (SELECT * FROM s WHERE len(b) > 0 AND len(b) % 2 = 0),
u AS (SELECT conv_id, sys, b, unnest(range(1, len(b) + 1, 2)) AS i FROM g)
SELECT conv_id, CAST(i // 2 AS INTEGER) AS turn, CASE WHEN i = 1 AND sys <> '' THEN '<|im_start|>system' || chr(10) || sys || '<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || b[i].content || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || CASE WHEN i % 4 = 1 THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END AS source,
CASE WHEN i % 4 = 3 THEN '<think>' || chr(10) || 'why' || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || b[i + 1].content || '<|im_end|>' || chr(10) AS target FROM u""")
def template_qwen3(spark, d):
    """Every other answer has a thought; the others get an empty one on their source."""
    from ..operators import templates

    c = conversations(spark, d)
    led = F.col("messages")[0]["role"] == "system"
    c = c.select("conv_id", F.when(led, F.col("messages")[0]["content"]).alias("sys"), F.when(led, F.slice("messages", F.lit(2), F.size("messages"))).otherwise(F.col("messages")).alias("b")).where((F.size("b") > 0) & (F.size("b") % 2 == 0))
    think = F.transform("b", lambda m, i: F.struct(m["role"].alias("role"), F.when(i % 4 == 3, F.concat(F.lit("<think>\nwhy\n</think>\n\n"), m["content"])).otherwise(m["content"]).alias("content")))
    return c.select("conv_id", F.posexplode(templates.multi_turn(think, "qwen3", system=F.col("sys"))).alias("turn", "p")).select("conv_id", "turn", "p.source", "p.target")


@query("template_llama2", f"""
WITH {_CONV}, s AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN '<<SYS>>' || chr(10) || m[1].content || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END AS sys, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS b FROM conv), g AS (SELECT * FROM s WHERE len(b) > 0 AND len(b) % 2 = 0)
SELECT conv_id, array_to_string(list_transform(b[1:len(b) - 1], lambda x, i: CASE WHEN i % 2 = 1 THEN '<s>[INST] ' || CASE WHEN i = 1 THEN sys ELSE '' END || x.content || ' [/INST]' ELSE x.content || '</s>' END), '') AS prompt, b[len(b)].content || '</s>' AS response FROM g""")
def template_llama2(spark, d):
    from ..operators import templates

    c = conversations(spark, d)
    led = F.col("messages")[0]["role"] == "system"
    c = c.select("conv_id", F.when(led, F.col("messages")[0]["content"]).alias("sys"), F.when(led, F.slice("messages", F.lit(2), F.size("messages"))).otherwise(F.col("messages")).alias("b")).where((F.size("b") > 0) & (F.size("b") % 2 == 0))
    return c.select("conv_id", templates.one_turn(F.col("b"), "llama2", system=F.col("sys")).alias("p")).select("conv_id", "p.prompt", "p.response")


def _prompt_sql(kind: str, text: str, names: str = "''") -> str:
    """A tool prompt as SQL, with SQL for the text of the tools and their names."""
    from ..operators.tool_prompts import PROMPTS

    whole = "'" + PROMPTS[kind].replace("'", "''") + "'"
    for slot, value in (("tool_text", text), ("tool_names", names), ("date", "'09 Mar 2024'")):
        whole = whole.replace("{" + slot + "}", f"' || {value} || '")
    return whole


_ARGS = """'{"query": {"type": "string", "description": ' || q || '}, "langs": {"type": "array", "enum": ["' || lang || '", "xx"], "items": {"type": "string"}}}'"""
_FIND = f"""'{{"name": "find_' || lang || '", "description": ' || q || ', "parameters": {{"type": "object", "properties": ' || {_ARGS} || ', "required": ["query"]}}}}'"""
_PING = """'{"name": "ping", "parameters": {"type": "object", "properties": {}}}'"""
_WRAP = lambda x: f"""'{{"type": "function", "function": ' || {x} || '}}'"""
_WORDS = """'> Tool Name: find_' || lang || chr(10) || 'Tool Description: ' || text || chr(10) || 'Tool Args:' || chr(10) || '  - query (string, required): ' || text || chr(10) || '  - langs (array): , should be one of [' || lang || ', xx], where each item should be string' || chr(10) || chr(10) || '> Tool Name: ping' || chr(10) || 'Tool Description: ' || chr(10) || 'Tool Args:' || chr(10) || chr(10)"""


@query("tool_prompts", f"""
WITH t AS (SELECT doc_id, lang, text, CAST(to_json(text) AS VARCHAR) AS q FROM documents)
SELECT doc_id, 'default' AS kind, {_prompt_sql("default", _WORDS, "'find_' || lang || ', ping'")} AS prompt FROM t
UNION ALL SELECT doc_id, 'mistral', {_prompt_sql("mistral", f"'[' || {_WRAP(_FIND)} || ', ' || {_WRAP(_PING)} || ']'")} FROM t
UNION ALL SELECT doc_id, 'qwen', {_prompt_sql("qwen", f"chr(10) || {_WRAP(_FIND)} || chr(10) || {_WRAP(_PING)}")} FROM t
UNION ALL SELECT doc_id, 'seed_oss', {_prompt_sql("seed_oss", f"chr(10) || '[' || {_FIND} || ', ' || {_PING} || ']'")} FROM t""")
def tool_prompts(spark, d):
    """Two tools a document, one described by its whole text, in four formats."""
    from ..operators.tool_prompts import PARAMETER, TOOL, tool_prompt

    none = F.lit(None)
    parameter = lambda name, kind, *more: F.struct(F.lit(name), F.lit(kind), *more).cast(PARAMETER)
    find = F.struct(F.concat(F.lit("find_"), "lang").alias("name"), F.col("text").alias("description"), F.array(parameter("query", "string", F.col("text"), F.lit(True), none.cast("array<string>"), none.cast("string")), parameter("langs", "array", none.cast("string"), none.cast("boolean"), F.array(F.col("lang"), F.lit("xx")), F.lit("string"))).alias("parameters"))
    tools_of = F.array(*(x.cast(TOOL) for x in (find, F.struct(F.lit("ping"), none.cast("string"), none.cast(f"array<{PARAMETER}>")))))
    rows = documents(spark, d).select("doc_id", tools_of.alias("tools"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), tool_prompt(F.col("tools"), k).alias("prompt")) for k in ("default", "mistral", "qwen", "seed_oss")))
    return rows.select("doc_id", F.inline(kinds))
