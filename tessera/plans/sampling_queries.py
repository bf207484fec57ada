"""Seeded epochs, draws and mixtures, each restated in SQL by its rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import permute, sampling
from .batch_queries import _C, _parts
from .catalogue import query
from .views import ROLLOUTS, rollouts, table


def _bits(text: str, first: int, digits: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {first}, {digits}) AS BIGINT)"


def _keyed(value: str) -> str:
    text = f"key || '|' || (s % {permute.ROUNDS})"
    k = [_bits(text, 7 * i + 1, 7) for i in range(4)]
    return f"((({value} * {k[0]} + {k[1]}) % {permute.P}) * {k[2]} + {k[3]}) % {permute.Q}"


#: Recursive table ``w`` over ``src(id, x, n, key)``: rounds are added to a place's two coordinates, six at a time, until
#: the place is below n; ``placed(id, x, n, place)`` has the ends.
_WALK = f"""
w AS (
  SELECT src.*, CAST(greatest(ceil(sqrt(CAST(n AS DOUBLE))), 1) AS BIGINT) AS a, 0 AS s, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r FROM src
  UNION ALL
  SELECT id, x, n, key, a, CASE WHEN b IS NULL THEN 0 ELSE s + 1 END, greatest((n + a - 1) // a, 1),
         CASE WHEN b IS NULL THEN x % a WHEN s % 2 = 0 THEN (l + ({_keyed('r')}) % a) % a ELSE l END,
         CASE WHEN b IS NULL THEN x // a WHEN s % 2 = 1 THEN (r + ({_keyed('l')}) % b) % b ELSE r END
  FROM w WHERE b IS NULL OR NOT (s > 0 AND s % {permute.ROUNDS} = 0 AND l + r * a < n)
), placed AS (SELECT id, x, n, l + r * a AS place FROM w WHERE b IS NOT NULL AND s > 0 AND s % {permute.ROUNDS} = 0 AND l + r * a < n)"""

_EPOCHS = f"""
WITH RECURSIVE src AS (
  SELECT event_id * 3 + e AS id, event_id AS x, (SELECT count(*) FROM events) AS n, '17|' || e AS key FROM events, range(3) t(e)
), {_WALK}
, epochs AS (SELECT x AS event_id, CAST(id % 3 AS INTEGER) AS epoch, place // 64 AS batch, place FROM placed)"""


def _epochs(spark, d, **start):
    """``event_id`` is a dense position."""
    e = table(spark, d, "events").select("event_id")
    return permute.epoch_batches(e, "event_id", e.count(), 64, 3, 17, **start)


@query("epoch_batches", f"{_EPOCHS} SELECT event_id, epoch, batch, place FROM epochs")
def epoch_batches(spark, d):
    return _epochs(spark, d).select("event_id", "epoch", "batch", "place")


@query("epoch_resumed", f"{_EPOCHS} SELECT event_id, epoch, batch, place FROM epochs WHERE epoch > 1 OR epoch = 1 AND batch >= 5")
def epoch_resumed(spark, d):
    """The tail of the run of ``epoch_batches`` from batch 5 of epoch 1 on."""
    return _epochs(spark, d, first_epoch=1, first_batch=5).select("event_id", "epoch", "batch", "place")


@query("one_batch", f"{_EPOCHS} SELECT event_id, place FROM epochs WHERE epoch = 2 AND batch = 3")
def one_batch(spark, d):
    """One batch, by the inverse permutation of its 64 places."""
    e = table(spark, d, "events")
    return permute.one_batch(e, "event_id", e.count(), 64, 2, 3, 17).select("event_id", "place")


@query("few_shot", f"""
WITH RECURSIVE p AS (
  SELECT lang, doc_id AS shot_id, row_number() OVER (PARTITION BY lang ORDER BY {_bits("CAST(doc_id AS VARCHAR)", 1, 7)} % 256, doc_id) - 1 AS at, count(*) OVER (PARTITION BY lang) AS n
  FROM documents WHERE doc_id % 2 = 1
), src AS (
  SELECT doc_id * 3 + shot - 1 AS id, CAST(shot - 1 AS BIGINT) AS x, m.n, '11|' || doc_id AS key
  FROM documents d JOIN (SELECT DISTINCT lang, n FROM p) m USING (lang), (SELECT unnest([1, 2, 3]) AS shot) WHERE doc_id % 2 = 0 AND shot <= n
), {_WALK}
SELECT d.lang, d.doc_id, CAST(q.x + 1 AS INTEGER) AS shot, p.shot_id FROM placed q JOIN documents d ON d.doc_id = q.id // 3 JOIN p ON p.lang = d.lang AND p.at = q.place""")
def few_shot(spark, d):
    """Every even document is a test, every odd one is in the pool."""
    docs = table(spark, d, "documents").select("lang", "doc_id")
    return sampling.few_shot(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "lang", "doc_id", 3, 11)


@query("weighted_resample", f"""
WITH {ROLLOUTS}, r AS (
  SELECT row, score, CAST(floor(score * score * 1000) AS BIGINT) AS w, {_bits("CAST(row AS VARCHAR)", 1, 7)} % (SELECT CAST(ceil(count(*) / 700) AS BIGINT) FROM rollouts) AS part FROM rollouts
), c AS (SELECT row, score, coalesce(sum(w) OVER (ORDER BY part, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM r WHERE w > 0),
d AS (SELECT i AS draw, {_bits("'7|' || i", 1, 15)} % (SELECT sum(w) FROM r) AS at FROM range((SELECT count(*) FROM rollouts)) t(i))
SELECT d.draw, c.row, c.score FROM d ASOF JOIN c ON d.at >= c.at""")
def weighted_resample(spark, d):
    """As many draws as rollouts, weights from the squared score; parts of about 700 rows, tasks of about 500 draws."""
    r = rollouts(spark, d)
    w = r.withColumn("w", F.floor(F.col("score") * F.col("score") * 1000))
    return sampling.weighted_resample(w, "w", r.count(), 7, "row", rows_per_part=700, draws_per_task=500).select("draw", "row", "score")


_MIX = (0.5, 0.25, 0.125, 0.125)
_DRAWN = f"""
WITH {_C}, part AS (SELECT DISTINCT lang, n, dense_rank() OVER (ORDER BY lang) - 1 AS part FROM c),
t AS (SELECT t, {_bits("'23|' || t", 1, 8)} / 4294967296.0 AS u FROM range((SELECT CAST(12 * sum(n) AS BIGINT) FROM part)) r(t)),
k AS (SELECT t, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 WHEN u < 0.875 THEN 2 ELSE 3 END AS part FROM t),
f AS (SELECT k.t, part.lang, part.n, row_number() OVER (PARTITION BY part ORDER BY k.t) - 1 AS rank FROM k JOIN part USING (part)),
e AS (SELECT lang, t FROM f WHERE rank = n - 1)
SELECT f.t AS turn, c.lang, c.doc_id FROM f JOIN c ON c.lang = f.lang AND c.row = f.rank % f.n"""


@query("interleave_drawn_under", f"{_DRAWN} WHERE f.t <= (SELECT min(t) FROM e)")
def interleave_drawn_under(spark, d):
    """Every language is a part; the first that ends ends the mixture."""
    return sampling.interleave(_parts(spark, d), "row", probabilities=list(_MIX), seed=23).select("turn", "lang", "doc_id")


@query("interleave_drawn_over", f"{_DRAWN} WHERE f.t <= (SELECT max(t) FROM e)")
def interleave_drawn_over(spark, d):
    return sampling.interleave(_parts(spark, d), "row", stop="all", probabilities=list(_MIX), seed=23).select("turn", "lang", "doc_id")


@query("hash_split_share", "WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= n // 10 THEN 'validation' ELSE 'train' END AS split FROM h")
def hash_split_share(spark, d):
    """A tenth of the documents."""
    return sampling.hash_split(table(spark, d, "documents").select("doc_id"), 0.1, "doc_id")
