"""Batch algebra over orders, mixing and splits over documents and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.batch import Batch
from .catalogue import query
from .views import table

_B = "b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey AS k, o_orderpriority AS p FROM orders), n AS (SELECT count(*) AS n FROM b)"


def batch(spark, d) -> Batch:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    return Batch.of(o, "k")


@query("batch_slice", f"WITH {_B} SELECT row_number() OVER (ORDER BY row) - 1 AS row, k FROM b, n WHERE row >= 7 AND row < n - 5 AND (row - 7) % 3 = 0")
def batch_slice(spark, d):
    return batch(spark, d).slice(7, -5, 3).df.select("row", "k")


@query("batch_slice_back", f"WITH {_B} SELECT row_number() OVER (ORDER BY row DESC) - 1 AS row, k FROM b, n WHERE (n - 1 - row) % 4 = 0")
def batch_slice_back(spark, d):
    return batch(spark, d).slice(None, None, -4).df.select("row", "k")


@query("batch_take", f"WITH {_B}, i AS (SELECT unnest([3, 3, 0, 99, 7]) AS at, unnest([0, 1, 2, 3, 4]) AS row) SELECT CAST(i.row AS BIGINT) AS row, b.k FROM i JOIN b ON b.row = i.at")
def batch_take(spark, d):
    return batch(spark, d).take([3, 3, 0, 99, 7]).df.select("row", "k")


@query("batch_mask", f"WITH {_B} SELECT row_number() OVER (ORDER BY row) - 1 AS row, k FROM b WHERE p = '5-LOW'")
def batch_mask(spark, d):
    return batch(spark, d).where_mask(F.col("p") == "5-LOW").df.select("row", "k")


@query("batch_reorder", f"WITH {_B} SELECT n - 1 - row AS row, k FROM b, n")
def batch_reorder(spark, d):
    b = batch(spark, d)
    return b.slice(None, None, -1).df.select("row", "k")


@query("batch_repeat", f"WITH {_B} SELECT row * 2 + i AS row, k, row + i * n AS stacked FROM b, n, (SELECT unnest([0, 1]) AS i)")
def batch_repeat(spark, d):
    b = batch(spark, d)
    a = b.repeat(2).df.select("row", "k")
    s = b.repeat(2, interleave=False).df.select(F.col("row").alias("stacked"), F.col("k").alias("sk"))
    n = len(b)
    return a.join(s, (F.col("k") == F.col("sk")) & (F.floor(F.col("stacked") / n) == F.col("row") % 2)).select("row", "k", "stacked")


@query("batch_repeat_each", f"WITH {_B}, r AS (SELECT row AS o, k, unnest(range(k % 3)) AS i FROM b) SELECT row_number() OVER (ORDER BY o, i) - 1 AS row, k FROM r")
def batch_repeat_each(spark, d):
    return batch(spark, d).repeat_each(F.col("k") % 3).df.select("row", "k")


@query("batch_chunk", f"WITH {_B} SELECT row // CAST(ceil(n / 4) AS BIGINT) AS chunk, count(*) AS rows, min(k) AS first, max(k) AS last FROM b, n GROUP BY 1")
def batch_chunk(spark, d):
    b = batch(spark, d)
    return b.df.groupBy(b.chunk_of(4, auto_pad=True).alias("chunk")).agg(F.count("*").alias("rows"), F.min("k").alias("first"), F.max("k").alias("last"))


@query("batch_split", f"WITH {_B} SELECT row // 128 AS part, count(*) AS rows, min(k) AS first FROM b GROUP BY 1")
def batch_split(spark, d):
    b = batch(spark, d)
    return b.df.groupBy(b.split_of(128).alias("part")).agg(F.count("*").alias("rows"), F.min("k").alias("first"))


@query("batch_pad", f"WITH {_B}, p AS (SELECT n, unnest(range((4096 - n % 4096) % 4096)) AS i FROM n) SELECT row, k FROM b UNION ALL SELECT p.n + p.i, b.k FROM p JOIN b ON b.row = p.i % p.n")
def batch_pad(spark, d):
    return batch(spark, d).pad_to_divisor(4096)[0].df.select("row", "k")


@query("batch_padding", f"WITH {_B} SELECT row, k FROM b UNION ALL SELECT n + i, k FROM b, n, (SELECT unnest(range(3)) AS i) WHERE row = n - 1")
def batch_padding(spark, d):
    return batch(spark, d).padding(3, "last").df.select("row", "k")


@query("batch_fold", f"WITH {_B} SELECT row // 8 AS row, array_to_string(list(k ORDER BY row), ',') AS keys FROM b GROUP BY 1")
def batch_fold(spark, d):
    return batch(spark, d).fold(8).df.select("row", F.array_join(F.col("k").cast("array<string>"), ",").alias("keys"))


@query("batch_unfold_chunks", f"WITH {_B}, x AS (SELECT row, [k, k + 1, k + 2, k + 3] AS v FROM b) SELECT row * 2 + i AS row, v[i * 2 + 1] AS a, v[i * 2 + 2] AS b FROM x, (SELECT unnest([0, 1]) AS i)")
def batch_unfold_chunks(spark, d):
    b = batch(spark, d)
    v = Batch(b.df.withColumn("v", F.array(*(F.col("k") + i for i in range(4)))), rows=len(b)).unfold_chunks(2, ["v"])
    return v.df.select("row", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


@query("batch_union", f"WITH {_B} SELECT row, k, k * 2 AS twice FROM b")
def batch_union(spark, d):
    b = batch(spark, d)
    other = Batch(b.df.select("row", "k", (F.col("k") * 2).alias("twice")), rows=len(b))
    return b.select(["k"]).union(other).df.select("row", "k", "twice")


@query("batch_concat", f"WITH {_B} SELECT row, k FROM b UNION ALL SELECT row + n, k FROM b, n")
def batch_concat(spark, d):
    b = batch(spark, d).select(["k"])
    return Batch.concat([b, b]).df.select("row", "k")


@query("mini_batches", f"WITH {_B} SELECT e AS epoch, row // 100 AS batch, count(*) AS rows, CAST(sum(k) AS BIGINT) AS keys FROM b, (SELECT unnest([0, 1]) AS e) WHERE row < (SELECT n // 100 * 100 FROM n) GROUP BY 1, 2")
def mini_batches(spark, d):
    b = batch(spark, d)
    whole = b.slice(0, len(b) // 100 * 100)
    return whole.mini_batches(100, 2).groupBy("epoch", "batch").agg(F.count("*").alias("rows"), F.sum("k").alias("keys"))


@query("preview_page", f"WITH {_B} SELECT row, k FROM b WHERE row >= 40 AND row < 60")
def preview_page(spark, d):
    return sampling.page(batch(spark, d).df, "row", 2, 20).select("row", "k")


@query("drop_last", f"WITH {_B} SELECT count(*) AS rows, max(row) AS last FROM b, n WHERE row < n // 64 * 64")
def drop_last(spark, d):
    return sampling.full_batches(batch(spark, d).df, "row", 64).agg(F.count("*").alias("rows"), F.max("row").alias("last"))


@query("round_robin", f"WITH {_B} SELECT row % 7 AS part, count(*) AS rows, CAST(sum(k) AS BIGINT) AS keys FROM b GROUP BY 1")
def round_robin(spark, d):
    return batch(spark, d).df.groupBy(sampling.round_robin(F.col("row"), 7).alias("part")).agg(F.count("*").alias("rows"), F.sum("k").alias("keys"))


_C = "c AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL)"


def _parts(spark, d) -> list[DataFrame]:
    """One part a language, every language of the table."""
    docs = table(spark, d, "documents").select("lang", "doc_id").where("lang is not null")
    return [Batch.of(docs.where(F.col("lang") == x.lang), "doc_id").df for x in docs.select("lang").distinct().orderBy("lang").collect()]


@query("interleave_under", f"WITH {_C} SELECT row AS turn, lang, doc_id FROM c WHERE row < (SELECT min(n) FROM c)")
def interleave_under(spark, d):
    return sampling.interleave(_parts(spark, d), "row").select("turn", "lang", "doc_id")


@query("interleave_over", f"WITH {_C}, m AS (SELECT max(n) AS m FROM c), k AS (SELECT c.*, unnest(range(m // n + 1)) AS i, m FROM c, m) SELECT row + i * n AS turn, lang, doc_id FROM k WHERE row + i * n < m")
def interleave_over(spark, d):
    return sampling.interleave(_parts(spark, d), "row", stop="all").select("turn", "lang", "doc_id")


@query("concat_mix", f"WITH {_C} SELECT dense_rank() OVER (ORDER BY lang) - 1 AS part, row, doc_id FROM c")
def concat_mix(spark, d):
    return sampling.concatenated(_parts(spark, d)).select(F.col("part").cast("long").alias("part"), "row", "doc_id")


@query("hash_split", "WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k FROM documents) SELECT doc_id, CASE WHEN k <= 100 THEN 'validation' ELSE 'train' END AS split FROM h")
def hash_split(spark, d):
    return sampling.hash_split(table(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query("exact_sample", "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('5|' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, unnest(CASE WHEN r <= 17 THEN [0, 1, 2] ELSE [0, 1] END) AS copy FROM d")
def exact_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return sampling.exact_sample(docs, docs.count() * 2 + 17, 5, "doc_id").select("doc_id", "copy")


@query("dpo_to_sft", "SELECT prompt, kind, response FROM (SELECT CAST(doc_id AS VARCHAR) AS prompt, 'chosen' AS kind, text AS response FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'rejected', text || 'x' FROM documents)")
def dpo_to_sft(spark, d):
    from ..operators.convert import preference_to_sft

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("prompt"), F.col("text").alias("c"), F.concat("text", F.lit("x")).alias("r"))
    return preference_to_sft(docs, "prompt", "c", "r").select("prompt", "kind", "response")
