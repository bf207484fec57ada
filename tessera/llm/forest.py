"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Every tree hashes a vector to a long string of bits (signs of random projections), and holds the strings sorted.
Inner products are angles once each vector has one more component that makes all norms equal. A query descends
every tree to the longest prefixes it shares with stored strings, then ascends all trees together, a bit at a
time, until enough rows share its prefix in some tree; those are scored on the original vectors. How many are
enough is found on a few queries, which are compared with every row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .codes import finite
from .util import materialize

K, TREES, BITS, SEED = 20, 16, 64, 20250301
#: Recall that the ascent is set for, and the queries on which it is measured (against all rows).
TARGET, SAMPLE = 0.95, 64
#: Rows of a tree's cell (equal first bits) on average, most bits of a cell (their counts are broadcast), rows of a
#: cell that one task opens with vectors, and with strings only.
CELL_ROWS, CELL_BITS, BLOCK, KEY_BLOCK = 2048, 16, 16384, 1 << 20
_CHUNK = 2048


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """A column of number lists as rows of doubles, padded with zeros."""
    size = np.asarray(lists.value_lengths())
    out = np.zeros((len(size), dims))
    out[np.arange(dims)[None, :] < size[:, None]] = np.asarray(lists.flatten(), dtype=np.float64)
    return out


def planes(dims: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims, trees]).standard_normal((trees * BITS, dims + 1))


def strings(x: np.ndarray, last: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """rows x trees strings of 64 bits as unsigned numbers, so that order is the order of strings."""
    side = np.concatenate([x, last[:, None]], axis=1) @ directions.T > 0
    return np.packbits(side, axis=1).view(">u8").astype(np.uint64)


def _hashed(rows: DataFrame, dims: int, trees: int, seed: int, scale: float, norm: float, stored: bool) -> DataFrame:
    """``rows`` (one column, then the vector) with ``keys``. Stored vectors get the component that fills their norm."""

    def run(it):
        directions = planes(dims, trees, seed)
        for b in it:
            for at in range(0, b.num_rows, _CHUNK):
                part = b.slice(at, _CHUNK)
                x = matrix(part.column(1), dims) / scale
                last = np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0)) if stored else np.zeros(len(x))
                keys = strings(x, last, directions).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, trees, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], [*part.schema.names[:2], "keys"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, keys array<long>")


def _keys(column: pa.Array, trees: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).view(np.uint64).reshape(-1, trees)


def _prefix(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(BITS - bits)).astype(np.int64) if bits else np.zeros(keys.shape, dtype=np.int64)


def cell_counts(index: DataFrame, trees: int, bits: int) -> np.ndarray:
    """trees x 2**bits counts of stored strings by their first bits."""

    def run(it):
        total = np.zeros((trees, 1 << bits), dtype=np.int64)
        for b in it:
            cell = _prefix(_keys(b.column(0), trees), bits)
            for t in range(trees):
                total[t] += np.bincount(cell[:, t], minlength=1 << bits)
        t, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(c), pa.array(total[t, c])], ["tree", "cell", "n"])

    out = np.zeros((trees, 1 << bits), dtype=np.int64)
    for t, c, n in index.select("keys").mapInArrow(run, "tree int, cell long, n long").groupBy("tree", "cell").agg(F.sum("n")).collect():
        out[t, c] = n
    return out


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits in which strings agree (to one bit, where a difference of over 2**53 rounds up)."""
    return np.maximum(BITS - np.frexp((a ^ b).astype(np.float64))[1], 0)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


def _scored(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row, score) that hold each query's k best of the rows; equal vectors score exactly alike, because
    what a matrix product selects is summed again row by row."""
    with np.errstate(all="ignore"):
        s = np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
        slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
        i, j = np.nonzero(s >= (least - np.where(np.isfinite(slack), slack, 0))[:, None])
        exact = (q[i] * x[j]).sum(axis=1)
    ok = ~np.isnan(exact)
    return i[ok], j[ok], exact[ok]


def _spread(i: np.ndarray, j: np.ndarray, score: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with each id of a row."""
    size = offsets[j + 1] - offsets[j]
    at = np.repeat(offsets[j] - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum()) if len(j) else np.zeros(0, dtype=np.int64)
    return np.repeat(i, size), ids[at], np.repeat(score, size)


def enough(index: DataFrame, queries: DataFrame, k: int, dims: int, trees: int, target: float, sample: int) -> int:
    """Rows, counted in every tree in which they are met, that an ascent must gather so that a share ``target`` of the
    true neighbours of ``sample`` queries (the smallest by hash), found among all rows, is gathered."""
    asked = queries.orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    q = matrix(pa.array([r.embedding for r in asked], type=pa.list_(pa.float64())), dims)
    own = np.array([r.node for r in asked], dtype=np.int64)
    keys = np.array([r["keys"] for r in asked], dtype=np.int64).view(np.uint64).reshape(len(asked), trees)

    def run(it):
        total = np.zeros((len(q), BITS + 1), dtype=np.int64)
        held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)]
        for b in it:
            for at in range(0, b.num_rows, _CHUNK):
                part = b.slice(at, _CHUNK)
                x, stored = matrix(part.column(1), dims), _keys(part.column(2), trees)
                level = np.zeros((len(q), len(x)), dtype=np.int64)
                for s in range(len(q)):
                    shared = shared_prefix(stored, keys[s])
                    total[s] += np.bincount(shared.ravel(), minlength=BITS + 1)
                    level[s] = shared.max(axis=1)
                i, j, score = _scored(q, x, k + 1)
                offsets = np.concatenate([[0], np.cumsum(np.asarray(part.column(0).value_lengths()))])
                qi, ids, score = _spread(i, np.asarray(j), score, offsets, np.asarray(part.column(0).flatten(), dtype=np.int64))
                size = offsets[j + 1] - offsets[j]
                new = [qi, ids, score, np.repeat(level[i, j], size)]
                held = [np.concatenate(c) for c in zip(held, new, strict=True)]
                best = _best(held[0], held[2], held[1], k + 1)
                held = [c[best] for c in held]
        s, n = np.nonzero(total)
        none = lambda m, t: pa.nulls(m, type=t)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n), pa.array(total[s, n]), none(len(s), pa.int64()), none(len(s), pa.float64())], ["q", "level", "n", "vec_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[3]), none(len(held[0]), pa.int64()), pa.array(held[1]), pa.array(held[2])], ["q", "level", "n", "vec_id", "score"])

    seen = materialize(index.select("ids", "embedding", "keys").mapInArrow(run, "q long, level long, n long, vec_id long, score double"), "forest-sample")
    reach = np.zeros((len(q), BITS + 1), dtype=np.int64)
    for s, level, n in seen.where("n is not null").groupBy("q", "level").agg(F.sum("n")).collect():
        reach[s, level] = n
    reach = reach[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows met at a level or deeper
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found: list[list[int]] = [[] for _ in range(len(q))]
    for r in seen.where("n is null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).orderBy("q", "place").collect():
        if r.vec_id != own[r.q] and len(found[r.q]) < k:
            found[r.q].append(r.level)
    share = np.array([[sum(v >= x for v in f) / len(f) if f else 1.0 for x in range(BITS + 1)] for f in found])

    def recall(m: int) -> float:
        return float(share[np.arange(len(q)), np.maximum((reach >= m).sum(axis=1) - 1, 0)].mean())

    low, high = 1, int(reach.max(initial=1))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if recall(middle) >= target else (middle + 1, high)
    return low


def _runs(it, keys: list[str]):
    """Slices of Arrow batches in which ``keys`` are equal, with their values."""
    for b in it:
        cols = [np.asarray(b.column(b.schema.get_field_index(c))) for c in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows else []
        for lo, hi in zip([0, *change], [*change, b.num_rows], strict=True):
            if hi > lo:
                yield tuple(int(c[lo]) for c in cols), b.slice(lo, hi - lo)


def _deal(index: DataFrame, queries: DataFrame, counts, trees: int, bits: int, block: int, vectors: bool) -> DataFrame:
    """Both sides as rows by (tree, cell, sub), rows before queries: a stored row once a tree, a query in every cell
    of its prefix at ``level``. Cells of over ``block`` rows are cut by hash; their queries go to each cut."""
    nodes, kind = ["ids", "embedding"], index.schema["embedding"].dataType.simpleString()

    def stored(it):
        cuts = -(-counts.value // block)
        for b in it:
            keys = _keys(b.column(2), trees)
            cell = _prefix(keys, bits)
            first = np.asarray(b.column(0).flatten(), dtype=np.int64)[np.concatenate([[0], np.cumsum(np.asarray(b.column(0).value_lengths()))[:-1]])] if b.num_rows else np.zeros(0, dtype=np.int64)
            mixed = (first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for t in range(trees):
                sub = (mixed % np.maximum(cuts[t][cell[:, t]], 1).astype(np.uint64)).astype(np.int32)
                cols = [pa.array(np.full(len(first), t, dtype=np.int32)), pa.array(cell[:, t]), pa.array(sub), pa.array(np.zeros(len(first), dtype=np.int32)), pa.array(np.ascontiguousarray(keys[:, t]).view(np.int64)), pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *(b.columns[:2] if vectors else [pa.nulls(len(first), b.schema.field(c).type) for c in range(2)])], names)

    def asking(it):
        cuts = -(-counts.value // block)
        for b in it:
            keys, level, node = _keys(b.column(2), trees), np.asarray(b.column(3), dtype=np.int64), np.asarray(b.column(0), dtype=np.int64)
            wide = np.maximum(bits - level, 0)
            for t in range(trees):
                start = _prefix(keys[:, t], bits) >> wide << wide
                for at in range(0, len(node), 256):
                    own = np.arange(at, min(at + 256, len(node)))
                    n = 1 << wide[own]
                    row = np.repeat(own, n)
                    cell = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    n = cuts[t][cell]
                    sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, cell = np.repeat(row, n), np.repeat(cell, n)
                    m = len(row)
                    cols = [pa.array(np.full(m, t, dtype=np.int32)), pa.array(cell), pa.array(sub.astype(np.int32)), pa.array(np.ones(m, dtype=np.int32)), pa.array(keys[row, t].view(np.int64)), pa.array(level[row].astype(np.int32)), pa.array(node[row])]
                    yield pa.RecordBatch.from_arrays([*cols, pa.nulls(m, pa.list_(pa.int64())), b.column(1).take(pa.array(row)) if vectors else pa.nulls(m, b.schema.field(1).type)], names)

    names = ["tree", "cell", "sub", "side", "key", "level", "node", *nodes]
    schema = f"tree int, cell long, sub int, side int, key long, level int, node long, ids array<long>, embedding {kind}"
    rows = index.select("ids", "embedding", "keys").mapInArrow(stored, schema).unionByName(queries.select("node", "embedding", "keys", "level").mapInArrow(asking, schema))
    return rows.repartition("tree", "cell", "sub").sortWithinPartitions("tree", "cell", "sub", "side")


def _range(keys: np.ndarray, prefix: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted strings share the first ``level`` bits of ``prefix``."""
    free = np.where(level > 0, np.uint64((1 << BITS) - 1) >> np.minimum(level, BITS - 1).astype(np.uint64), np.uint64((1 << BITS) - 1))
    free = np.where(level >= BITS, np.uint64(0), free)
    return np.searchsorted(keys, prefix & ~free, "left"), np.searchsorted(keys, prefix | free, "right")


def deep_levels(index: DataFrame, queries: DataFrame, counts, trees: int, bits: int, need: int, key_block: int = KEY_BLOCK) -> DataFrame:
    """``node, level``: the ascent of queries that meet enough rows before they leave their cells. Tasks hold sorted
    strings only and count by level; the counts of the trees are added by query."""
    levels = list(range(bits, BITS + 1))

    def run(it):
        at, held, keys = None, [], None
        for k, part in _runs(it, ["tree", "cell", "sub", "side"]):
            if k[:3] != at:
                at, held, keys = k[:3], [], None
            if k[3] == 0:
                held.append(np.asarray(part.column(4), dtype=np.int64).view(np.uint64))
                continue
            keys = np.sort(np.concatenate(held)) if keys is None and held else keys
            if keys is None:
                continue
            asked = np.asarray(part.column(4), dtype=np.int64).view(np.uint64)
            n = np.empty((len(asked), len(levels)), dtype=np.int64)
            for c, x in enumerate(levels):
                lo, hi = _range(keys, asked, np.full(len(asked), x))
                n[:, c] = hi - lo
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n.size + 1, len(levels), dtype=np.int32)), pa.array(n.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(6), lists], ["node", "n"])

    met = _deal(index, queries, counts, trees, bits, key_block, False).mapInArrow(run, "node long, n array<long>")
    total = met.groupBy("node").agg(*(F.sum(F.col("n")[c]).alias(f"n{x}") for c, x in enumerate(levels)))
    return total.select("node", F.greatest(*(F.when(F.col(f"n{x}") >= need, F.lit(x)).otherwise(F.lit(bits)) for x in [*levels, bits])).cast("int").alias("level"))


def nearest(vectors: DataFrame, is_query: Column, *, k: int = K, trees: int = TREES, target: float = TARGET, sample: int = SAMPLE, seed: int = SEED, cell_rows: int = CELL_ROWS, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: up to k rows of largest inner product that the forest finds for each query.

    is_query: predicate on ``vec_id`` that states the query set; candidates are all rows but the query's own. Vectors
    that are null, all zero or hold null or non-finite components, and null ids, take no part; shorter vectors count
    as padded with zeros. A repeated vec_id counts once, with its first vector in order. Ranks go by score downwards,
    ties to the smaller vec_id; scores are double sums over the original vectors (a sum that is no number is left out).
    A query finds fewer than k rows only where there are fewer. An empty table or query set gives no rows.

    Plan: equal vectors are one node with its k + 1 smallest ids, and ask once. Strings are hashed once and written.
    What the driver holds is trees x 2**16 counts at most and ``sample`` queries. A stored vector is shuffled once a
    tree, by (tree, first bits); queries go to the cells of their prefix, and k + 1 rows leave each. There is no cap on
    candidates: a level is taken whole, in cuts of at most about ``block`` rows.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col)
    good = vectors.where(F.col(id_col).isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(v).alias("embedding"))
    good = materialize(good, "vectors")
    n, dims, scale, asked = good.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))), F.count_if(is_query)).first()
    if not asked or n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = good.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") / scale) * (x.cast("double") / scale)))).first()[0]
    first = Window.partitionBy("embedding").orderBy("vec_id")
    members = good.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = materialize(_hashed(members.select("ids", "embedding"), dims, trees, seed, scale, norm, True), "forest")
    own = good.where(is_query)
    nodes = materialize(_hashed(own.groupBy("embedding").agg(F.min("vec_id").alias("node")).select("node", "embedding"), dims, trees, seed, scale, norm, False), "forest-queries")
    bits = min(CELL_BITS, max(0, math.ceil(math.log2(max(1, n / cell_rows)))))
    counts = cell_counts(index, trees, bits)
    need = max(enough(index, nodes, k, dims, trees, target, sample), trees * (k + 1))  # a row counts once a tree at most, so k + 1 rows are met
    shared = spark.sparkContext.broadcast(counts)

    def levels(it):
        by_level = [shared.value.reshape(trees, 1 << x, -1).sum(axis=2) for x in range(bits + 1)]
        for b in it:
            keys = _keys(b.column(2), trees)
            met = np.stack([sum(by_level[x][t][_prefix(keys[:, t], x)] for t in range(trees)) for x in range(bits + 1)], axis=1)
            level = np.maximum((met >= need).sum(axis=1) - 1, 0)
            deep = met[:, bits] >= need
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(level.astype(np.int32)), pa.array(deep)], [*b.schema.names, "level", "deep"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    asking = materialize(nodes.mapInArrow(levels, f"node long, embedding {kind}, keys array<long>, level int, deep boolean"), "forest-asking")
    deep = asking.where("deep")
    if not deep.isEmpty():
        below = deep_levels(index, deep, shared, trees, bits, need)
        asking = materialize(asking.drop("level").join(below, "node", "left").join(asking.select("node", F.col("level").alias("upper")), "node").withColumn("level", F.coalesce("level", "upper")), "forest-asking")

    def search(it):
        at, held, opened = None, [], None
        for g, part in _runs(it, ["tree", "cell", "sub", "side"]):
            if g[:3] != at:
                at, held, opened = g[:3], [], None
            if g[3] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if opened is None:
                rows = pa.Table.from_batches(held).combine_chunks()
                keys = np.asarray(rows.column("key").chunk(0), dtype=np.int64).view(np.uint64)
                order = np.argsort(keys, kind="stable")
                ids = rows.column("ids").chunk(0).take(pa.array(order))
                opened = (keys[order], matrix(rows.column("embedding").chunk(0), dims)[order], np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]), np.asarray(ids.flatten(), dtype=np.int64))
            keys, x, offsets, ids = opened
            for lo in range(0, part.num_rows, 128):
                some = part.slice(lo, 128)
                q, node, level = matrix(some.column(8), dims), np.asarray(some.column(6), dtype=np.int64), np.asarray(some.column(5), dtype=np.int64)
                begin, end = _range(keys, np.asarray(some.column(4), dtype=np.int64).view(np.uint64), level)
                begin[level <= bits], end[level <= bits] = 0, len(keys)
                found = [_scored(q[w := np.flatnonzero((begin == 0) & (end == len(keys)))], x, k + 1)]
                found[0] = (w[found[0][0]], *found[0][1:])
                for i in np.flatnonzero((end > begin) & ((begin > 0) | (end < len(keys)))):
                    _, j, s = _scored(q[i : i + 1], x[begin[i] : end[i]], k + 1)
                    found.append((np.full(len(j), i), j + begin[i], s))
                i, near, score = _spread(*(np.concatenate([f[c] for f in found]) for c in range(3)), offsets, ids)
                best = _best(i, score, near, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(node[i[best]]), pa.array(near[best]), pa.array(score[best])], ["node", "vec_id", "score"])

    met = _deal(index, asking, shared, trees, bits, block, True).mapInArrow(search, "node long, vec_id long, score double")
    by_node, by_query = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id"), Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = materialize(met.dropDuplicates(["node", "vec_id"]).withColumn("place", F.row_number().over(by_node)).where(F.col("place") <= k + 1).select("node", "vec_id", "score"), "forest-found")
    who = own.select(F.col("vec_id").alias("query_id"), "embedding").join(nodes.select("node", "embedding"), "embedding").select("query_id", "node")
    found = who.join(top, "node").where("query_id <> vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
