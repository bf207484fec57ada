"""Encoded training rows of the conversations; a text's ids are the lengths of its words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode
from .catalogue import query
from .document_queries import conversations

_CUT = 48
_IDS = "list_transform(string_split({0}, ' '), lambda w: CAST(length(w) AS INTEGER))"
_FIT = "CASE WHEN g * 2 < c THEN c WHEN s * 2 < c THEN c - s ELSE floor(c * (g / (s + g))) END"
_TURNS = f"""conv AS (SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY turn) AS m FROM conversations GROUP BY 1),
body AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS b FROM conv),
good AS (SELECT * FROM body WHERE len(b) > 0 AND len(b) % 2 = 0 AND len(list_filter(b, lambda x, i: x.role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0),
ids AS (SELECT conv_id, list_transform(b, lambda x: {_IDS.format('x.content')}) AS v FROM good)"""


def _good(spark, d):
    """Conversations of whole user and assistant turns, as one id array a message."""
    c = conversations(spark, d).select("conv_id", F.when(F.col("messages")[0]["role"] == "system", F.slice("messages", F.lit(2), F.size("messages"))).otherwise(F.col("messages")).alias("b"))
    roles = F.forall(F.transform("b", lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: ok)
    ids = F.transform("b", lambda m: F.transform(F.split(m["content"], " "), lambda w: F.length(w)))
    return c.where((F.size("b") > 0) & (F.size("b") % 2 == 0) & roles).select("conv_id", ids.alias("v"))


def _turns():
    return F.transform(F.sequence(F.lit(0), F.size("v") - 2, F.lit(2)), lambda i: F.struct(F.get("v", i).alias("source_ids"), F.get("v", i + 1).alias("target_ids")))


def _joined(*names):
    return [F.array_join(F.col(n).cast("array<string>"), ",").alias(n.replace(".", "_").removeprefix("e_")) for n in names]


def _supervised_sql(back: bool, eos: int | None) -> str:
    """The recursion over turns restated: i counts turns in the order in which they use the budget."""
    pick = lambda k: f"v[len(v) - 2 * i - {2 - k}]" if back else f"v[2 * i + {k}]"
    mark = f"CASE WHEN i > 0 THEN list_concat([{eos}], list_transform(range(greatest(ns - 1, 0)), lambda _: -100)) ELSE list_transform(range(ns), lambda _: -100) END" if eos is not None else "list_transform(range(ns), lambda _: -100)"
    trained = "CASE WHEN i > 0 THEN list_transform(range(nt), lambda _: -100) ELSE target[1:nt] END" if back else "target[1:nt]"
    order = lambda new, old: f"list_concat({new}, {old})" if back else f"list_concat({old}, {new})"
    end = f"list_concat({{}}, [{eos}])" if eos is not None else "{}"
    return f"""
WITH RECURSIVE {_TURNS},
r AS (SELECT conv_id, v, 0 AS i, CAST([] AS BIGINT[]) AS a, CAST([] AS BIGINT[]) AS l, {0 if eos is None else 1} AS total FROM ids
UNION ALL
SELECT conv_id, v, i + 1, CASE WHEN total < {_CUT} THEN {order("list_concat(source[1:ns], target[1:nt])", "a")} ELSE a END, CASE WHEN total < {_CUT} THEN {order(f"list_concat({mark}, {trained})", "l")} ELSE l END, CASE WHEN total < {_CUT} THEN total + ns + nt ELSE total END
FROM (SELECT *, CAST(least({_FIT}, g) AS BIGINT) AS nt, CAST(least(greatest(c - nt, 0), s) AS BIGINT) AS ns FROM (SELECT *, {_CUT} - total AS c, {pick(1)} AS source, {pick(2)} AS target, len(source) AS s, len(target) AS g FROM r WHERE 2 * i < len(v))))
SELECT conv_id, array_to_string({end.format('a')}, ',') AS input_ids, array_to_string({end.format('l')}, ',') AS labels FROM r WHERE 2 * i = len(v)"""


def _supervised(spark, d, **settings):
    return _good(spark, d).select("conv_id", encode.encode_supervised(_turns(), _CUT, **settings).alias("e")).select("conv_id", *_joined("e.input_ids", "e.labels"))


@query("sft_encode", _supervised_sql(False, None))
def sft_encode(spark, d):
    return _supervised(spark, d)


@query("sft_encode_history", _supervised_sql(True, None))
def sft_encode_history(spark, d):
    return _supervised(spark, d, mask_history=True)


@query("sft_encode_eos", _supervised_sql(False, 2))
def sft_encode_eos(spark, d):
    return _supervised(spark, d, eos=2)


_PAIR = f"""{_TURNS},
p AS (SELECT conv_id, v[1] AS p, list_concat(v[2], [2]) AS y, list_concat(v[len(v)], [2]) AS n, len(p) AS s, greatest(len(y), len(n)) AS g, {_CUT} AS c FROM ids),
f AS (SELECT *, CAST(least({_FIT}, g) AS BIGINT) AS nt, CAST(least(greatest(c - nt, 0), s) AS BIGINT) AS ns FROM p),
e AS (SELECT conv_id, list_concat(p[1:ns], y[1:nt]) AS ci, list_concat(list_transform(range(ns), lambda _: -100), y[1:nt]) AS cl, list_concat(p[1:ns], n[1:nt]) AS ri, list_concat(list_transform(range(ns), lambda _: -100), n[1:nt]) AS rl FROM f)"""


def _pairs(spark, d):
    v = F.col("v")
    return _good(spark, d).select("conv_id", encode.encode_pairwise(v[0], v[1], F.element_at(v, -1), _CUT, eos=2).alias("e")).select("conv_id", "e.*")


@query("pairwise_encode", f"WITH {_PAIR} SELECT conv_id, array_to_string(ci, ',') AS chosen_input_ids, array_to_string(cl, ',') AS chosen_labels, array_to_string(ri, ',') AS rejected_input_ids, array_to_string(rl, ',') AS rejected_labels FROM e")
def pairwise_encode(spark, d):
    return _pairs(spark, d).select("conv_id", *_joined("chosen_input_ids", "chosen_labels", "rejected_input_ids", "rejected_labels"))


@query("pairwise_collate", f"""
WITH {_PAIR}, t AS (SELECT conv_id, conv_id // 8 AS batch, 'chosen' AS kind, ci AS a, cl AS l FROM e UNION ALL SELECT conv_id, conv_id // 8, 'rejected', ri, rl FROM e),
w AS (SELECT *, CAST(ceil(max(len(a)) OVER (PARTITION BY batch) / 8) * 8 AS BIGINT) AS wide, row_number() OVER (PARTITION BY batch ORDER BY kind, conv_id) - 1 AS place FROM t)
SELECT conv_id, kind, place, array_to_string(list_concat(a, list_transform(range(wide - len(a)), lambda _: 0)), ',') AS input_ids, array_to_string(list_concat(l, list_transform(range(wide - len(a)), lambda _: -100)), ',') AS labels, array_to_string(list_concat(list_transform(a, lambda _: 1), list_transform(range(wide - len(a)), lambda _: 0)), ',') AS attention_mask FROM w""")
def pairwise_collate(spark, d):
    rows = _pairs(spark, d).withColumn("batch", F.floor(F.col("conv_id") / 8))
    return encode.collate_pairwise(rows, "batch", "conv_id", 0, multiple=8).select("conv_id", "kind", F.col("place").cast("long").alias("place"), *_joined("input_ids", "labels", "attention_mask"))


def _kl_sql() -> str:
    one = lambda a, p: f"{p} AS (SELECT conv_id, p, y, len(p) AS s, len(y) AS g, {_CUT} AS c FROM (SELECT conv_id, p, {a} AS y FROM k)), {p}f AS (SELECT *, CAST(least({_FIT}, g) AS BIGINT) AS nt, CAST(least(greatest(c - nt, 0), s) AS BIGINT) AS ns FROM {p})"
    show = lambda p, n: f"array_to_string(list_concat({p}f.p[1:{p}f.ns], {p}f.y[1:{p}f.nt]), ',') AS {n}input_ids, array_to_string(list_concat(list_transform(range({p}f.ns), lambda _: -100), {p}f.y[1:{p}f.nt]), ',') AS {n}labels"
    return f"""
WITH {_TURNS}, o AS (SELECT conv_id, v[1] AS p, v[2] AS y, conv_id // 100 AS batch, len(v) > 2 AS tag FROM ids),
k AS (SELECT conv_id, p, y, coalesce(lag(y) OVER w, last(y) OVER (PARTITION BY batch ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl, tag FROM o WINDOW w AS (PARTITION BY batch ORDER BY conv_id)),
{one('y', 'q')}, {one('kl', 'z')}
SELECT conv_id, {show('q', '')}, {show('z', 'kl_')}, tag AS kto_tags FROM qf JOIN zf USING (conv_id) JOIN k USING (conv_id)"""


@query("feedback_encode", _kl_sql())
def feedback_encode(spark, d):
    rows = _good(spark, d).select("conv_id", F.col("v")[0].alias("p"), F.col("v")[1].alias("y"), (F.size("v") > 2).alias("tag"))
    e = encode.mismatched(rows, "conv_id", "y", batch=100).select("conv_id", encode.encode_feedback(F.col("p"), F.col("y"), F.col("kl"), F.col("tag"), _CUT).alias("e"))
    return e.select("conv_id", *_joined("e.input_ids", "e.labels", "e.kl_input_ids", "e.kl_labels"), F.col("e.kto_tags").alias("kto_tags"))


@query("unsupervised_encode", f"""
WITH {_TURNS}, p AS (SELECT conv_id, v[1] AS p, list_concat(v[2], [2]) AS y, len(p) AS s, len(y) AS g, {_CUT} AS c FROM ids),
f AS (SELECT *, CAST(least({_FIT}, g) AS BIGINT) AS nt, CAST(least(greatest(c - nt, 0), s) AS BIGINT) AS ns FROM p)
SELECT conv_id, array_to_string(p[1:ns], ',') AS input_ids, array_to_string(y[1:nt], ',') AS labels FROM f""")
def unsupervised_encode(spark, d):
    return _good(spark, d).select("conv_id", encode.encode_unsupervised(F.col("v")[0], F.col("v")[1], _CUT, eos=2).alias("e")).select("conv_id", *_joined("e.input_ids", "e.labels"))


@query("one_preference", f"WITH {_TURNS} SELECT count(*) FILTER (len(v) > 2) AS desirable, count(*) FILTER (len(v) <= 2) AS undesirable, count(*) FILTER (len(v) > 2) = 0 OR count(*) FILTER (len(v) <= 2) = 0 AS one_kind FROM ids")
def one_preference(spark, d):
    return encode.one_preference(_good(spark, d).select((F.size("v") > 2).alias("kto_tags")))


@query("packed_examples")
def packed_examples(spark, d):
    """No SQL: the knapsack is sequential; tests hold it against a restatement."""
    rows = _good(spark, d).select("conv_id", encode.encode_supervised(_turns(), _CUT).alias("e")).select("conv_id", "e.*")
    p = encode.packed_examples(rows, "conv_id", "input_ids", "labels", 2 * _CUT, 0, batch=100, neat=True)
    return p.select("batch_no", "knapsack", *_joined("input_ids", "attention_mask", "position_ids", "labels"))
