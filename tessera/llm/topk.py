"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are integers in vertical layout (one row per dimension, those of most mass first). A few similar queries at a
time meet a block of candidates in slices, longest vectors first. Within a slice the inner products are accumulated
dimension block by dimension block; after each block a candidate whose partial sum plus the largest possible
remainder (the Cauchy-Schwarz bound on the dimensions left) cannot reach a query's k-th score so far, from earlier
slices or from the lower bounds of this one, is struck out, and candidates that none of the queries can use any more are
compacted away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a group's two sides: candidates are copied once per query block, queries once per candidate block.
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 16384
#: Queries that are bounded together, candidates of a slice, dimensions between bounds, share of candidates to compact at.
GROUP, SLICE, DIM_BLOCK, COMPACT = 8, 4096, 8, 0.9
_LONG = (-(2**63), 2**63 - 1)


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``vec_id, v array<double>``: floor(scale * x) for every component; vectors that are null or hold null,
    NaN or infinite components are left out."""
    v = F.col(vec_col)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))


def _exact_type(q: np.ndarray, c: np.ndarray) -> type:
    """float64 while every partial sum is below 2**53, int64 below 2**63, Python integers beyond."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[0])
    return np.float64 if most < 2**52 else np.int64 if most < 2**62 else object


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if s.dtype == object:
        return np.array(sorted(range(len(s)), key=lambda i: (-s[i], ids[i]))[:k], dtype=np.int64)
    at = np.arange(len(s))
    if len(s) > k:  # everything that ties with the k-th stays for the id order
        at = np.flatnonzero(s >= -np.partition(-s, k - 1)[k - 1])
    return at[np.lexsort((ids[at], -s[at]))[:k]]


def _left(x: np.ndarray) -> np.ndarray:
    """Norm of what each column has from each dimension on, slightly raised against rounding."""
    return np.sqrt(np.vstack([np.cumsum((x**2)[::-1], axis=0)[::-1], np.zeros(x.shape[1])])) * (1 + 1e-9)


def _alike(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """An order of the queries in which similar ones follow each other: by the nearest two of 32 candidates."""
    if q.shape[1] <= GROUP or not c.shape[1]:
        return np.arange(q.shape[1])
    s = q.T @ c[:, np.linspace(0, c.shape[1] - 1, min(32, c.shape[1])).astype(int)]
    near = np.argsort(-s, axis=1, kind="stable")
    return np.lexsort((near[:, min(1, near.shape[1] - 1)], near[:, 0]))


def block_topk(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, dim_block: int = DIM_BLOCK, struck: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The k best candidates of every query within one block; a query's own id is no candidate.

    q, c: vertical layout, one row per dimension. Returns query ids, candidate ids and scores. To ``struck``, if given,
    is added how many (query, dimension, candidate) products the bounds have saved.
    """
    kind = _exact_type(q, c)
    if kind is object:
        q, c = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c))
    else:
        q, c = q.astype(kind), c.astype(kind)
    dims, bounded = q.shape[0], kind is np.float64
    if bounded:
        mass = np.argsort(-((q**2).sum(axis=1) * (c**2).sum(axis=1)), kind="stable")
        q, c = q[mass], c[mass]
        long = np.argsort(-(c**2).sum(axis=0), kind="stable")
        c, cid = c[:, long], cid[long]
        order = _alike(q, c)
        q, qid = q[:, order], qid[order]
        q_left, c_left = _left(q), _left(c)
    out_q, out_c, out_s = [], [], []
    for g in range(0, len(qid), GROUP):
        own, mine = qid[g : g + GROUP], q[:, g : g + GROUP]
        best = [(np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)) for _ in own]
        kth = np.full(len(own), -np.inf)
        for at in range(0, len(cid), SLICE):
            ids, part = cid[at : at + SLICE], np.zeros((len(own), len(cid[at : at + SLICE])), dtype=kind)
            place, rest = np.arange(at, at + len(ids)), c[:, at : at + SLICE]
            alive = own[:, None] != ids[None, :]
            for d in range(0, dims, dim_block):
                e = min(d + dim_block, dims)
                part = part + mine[d:e].T @ rest[d:e]
                if not bounded or e == dims or len(ids) <= 4 * k:
                    continue
                slack = q_left[e, g : g + GROUP, None] * c_left[e, place][None, :] + 0.5
                low = np.where(alive, part - slack, -np.inf)
                kth = np.maximum(kth, -np.partition(-low, k - 1, axis=1)[:, k - 1])
                alive &= part + slack >= kth[:, None]
                keep = alive.any(axis=0)
                if keep.mean() < COMPACT:
                    if struck is not None:
                        struck.append(int((~keep).sum()) * (dims - e) * len(own))
                    part, alive, rest, ids, place = part[:, keep], alive[:, keep], rest[:, keep], ids[keep], place[keep]
            for row, (s, near) in enumerate(best):
                live = np.flatnonzero(alive[row] & (part[row] >= kth[row])) if bounded else np.flatnonzero(alive[row])
                s, near = np.concatenate([s, part[row, live]]), np.concatenate([near, ids[live]])
                top = _best(s, near, k)
                best[row] = s[top], near[top]
                if bounded and len(top) == k:
                    kth[row] = max(kth[row], best[row][0][-1])
        for query, (s, near) in zip(own, best, strict=True):
            out_q += [query] * len(near)
            out_c += near.tolist()
            out_s += [min(max(int(x), _LONG[0]), _LONG[1]) for x in s]
    return np.array(out_q, dtype=np.int64), np.array(out_c, dtype=np.int64), out_s


def top_k(vectors: DataFrame, is_query, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products.

    vectors: rows of an id and an array of numbers. is_query: predicate column on ``vec_id`` that states the
    query set. Components become floor(scale * x). Ties go to the smaller vec_id; fewer candidates than k give
    fewer rows. Null vectors, null ids and vectors with null or non-finite components take no part; missing
    trailing dimensions of a shorter vector count as zero. A repeated vec_id is a candidate once per row for
    other queries and asks once, with its first vector in order. An empty table gives no rows. Scores beyond a long
    saturate.

    Plan: queries go in blocks of at most ``query_block``, candidates in blocks of about ``candidate_block``
    (or more blocks, to use every core). One group holds one query block and one candidate block, so its
    memory is bounded whatever the table's size; only k rows per query and block are shuffled on.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vec_col, scale)
    n_q, n_c = rows.agg(F.count_if(is_query), F.count("*")).first()
    qbs = max(1, -(-n_q // query_block))
    cbs = max(1, -(-n_c // candidate_block), min(n_c // 128, 8 * spark.sparkContext.defaultParallelism))
    salted = F.xxhash64("vec_id")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("qb", F.pmod(salted, F.lit(qbs))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cbs - 1).cast("long"))))
    cands = rows.withColumn("cb", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(cbs))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qbs - 1).cast("long"))))

    def matrix(p: pd.DataFrame, dims: int) -> np.ndarray:
        m = np.zeros((dims, len(p)))
        for j, v in enumerate(p["v"]):
            m[: len(v), j] = v
        return m

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        dims = max(1, max(map(len, q["v"])), max(map(len, c["v"])))
        cm, cid = matrix(c, dims), c["vec_id"].to_numpy()
        query, near, score = block_topk(q["vec_id"].to_numpy(), matrix(q, dims), cid, cm, k)
        return pd.DataFrame({"query_id": query, "vec_id": near, "score": pd.Series(score, dtype="int64")})

    part = queries.groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb")).applyInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""
