"""Token counts through a digest cache.

Each text's digest, joined with the tokenizer's version digest, looks up a stored count; only distinct
texts that the cache lacks are encoded, and their counts are appended to it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder, tokenizer_digest
from .util import fresh_path, materialize, path_exists

HOT_SHARE = 1000
CACHE_SCHEMA = "content_digest binary, n_tokens long, tokenizer_digest string"


def content_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version. A digest stored twice (two runs at once) gives one row."""
    if not path_exists(spark, cache_path):
        return spark.createDataFrame([], "content_digest binary, n_tokens long")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
    return stored.groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    docs: needs ``id_col`` and ``text_col``; other columns are ignored. Repeated rows each get a row.
    tokenizer: a file name or path; its content and the library version are part of the cache key.
    cache_path: Parquet folder of ``CACHE_SCHEMA``, partitioned by tokenizer digest; created at need.

    Null texts count as empty (0 bytes, 0 tokens). A null id keeps its row. An empty table gives an empty
    result. Counts are of whole texts, however long. Content is normalised by null to empty and UTF-8 only: what a
    tokenizer's own normaliser does depends on its added tokens, so the digest is of what the library is given.

    Plan: the digests (a few dozen bytes a row) are written once. A distinct digest is represented by its
    smallest id and only texts of representatives that the cache lacks are joined, by id and digest together, so a
    group of copies puts one text, and not itself, into a task, and an id that many texts share is spread by their
    digests. A row that is repeated as a whole is encoded once a task, and one row a digest is stored. The closing
    join on digests has tiny rows; digests of over 1/HOT_SHARE of the rows, at most HOT_SHARE of them, get their counts
    by a broadcast, so that no group of copies is one task's.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digests = materialize(rows.select("doc_id", content_digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = read_cache(spark, cache_path, version)
    first = materialize(digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "digest-groups")
    missing = first.join(known, first.digest == known.content_digest, "left_anti").select("digest", "rep")
    texts = rows.withColumn("own", content_digest(F.col("text"))).join(missing, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("digest"))).select("digest", "text")

    def count(it):
        enc, done = encoder(tokenizer), set()
        for b in it:
            fresh = [k for k, d in enumerate(b.column(0).to_pylist()) if d not in done and not done.add(d)]
            part = b.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([enc.count(t) for t in part.column(1).to_pylist()], pa.int64())], ["content_digest", "n_tokens"])

    fresh = texts.mapInArrow(count, "content_digest binary, n_tokens long").groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))
    fresh.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    # fewer than HOT_SHARE rows: the bound that makes them fit for a broadcast
    hot = first.crossJoin(F.broadcast(first.agg(F.sum("rows").alias("total")))).where(F.col("rows") * HOT_SHARE > F.col("total")).select(F.col("digest").alias("hot"))
    hot_counts = counts.join(F.broadcast(hot), counts.content_digest == hot.hot, "left_semi")
    common = digests.join(F.broadcast(hot_counts), digests.digest == hot_counts.content_digest)
    other = digests.join(F.broadcast(hot), digests.digest == hot.hot, "left_anti").join(counts, F.col("digest") == F.col("content_digest"))
    out = ["doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")]
    return common.select(*out).unionByName(other.select(*out))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, "byte_bpe_50k.json", fresh_path(spark, "token-count-cache"))
