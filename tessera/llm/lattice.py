"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random, eight dimensions to a block, and each block is decoded to the nearest
point of the E8 lattice; a table's cell is the tuple of its blocks' points. Several tables are built, and a
vector also probes the neighbouring cells (a minimal lattice vector away) that lie closest to it. Pairs that
meet in a cell are verified by their cosine in double precision.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, local_roots
from .mixing import _mixed
from .simhash import _SUB, group_pairs, sorted_groups, with_blocks
from .util import materialize

COSINE, SEED = 0.9, 20240917
#: The projection's scale against the lattice, and the numbers of probed neighbour cells to choose from.
SCALE, PROBES = 0.42, 4
PROBE_CHOICES = (2, 4, 8)
#: Share of pairs at the threshold itself that the tables together should meet; closer pairs meet more often.
RECALL = 0.97
#: Work of one shuffled row and of one verified pair, in microseconds.
ROW_COST, PAIR_COST = 8.0, 0.005
BLOCK_ROWS = 4096


def minimal_vectors() -> np.ndarray:
    """The 240 minimal vectors of E8: two entries +-1, or all entries +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


MINIMAL = minimal_vectors()


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer entries of even sum."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    if len(odd):
        e = y[odd] - r[odd]
        k = np.abs(e).argmax(axis=1)
        r[odd, k] += np.where(e[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row of eight numbers: the better of the two cosets of D8."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    """Hash of rows of lattice coordinates (twice them are integers)."""
    h = np.full(len(points), np.uint64(salt + 1))
    for c in range(points.shape[1]):
        h = _mixed(h ^ (points[:, c] * 2).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def projections(dims: int, tables: int, blocks: int, seed: int) -> np.ndarray:
    """tables x (8 * blocks) x dims Gaussian directions."""
    return np.random.default_rng([seed, dims, blocks]).standard_normal((tables, 8 * blocks, dims))


def cells(u: np.ndarray, projection: np.ndarray, table: int, scale: float = SCALE, probes: int = PROBES) -> np.ndarray:
    """Keys of one table for unit vectors: column 0 the home cell, then the ``probes`` closest neighbour cells."""
    y = u @ projection.T * scale
    blocks = y.shape[1] // 8
    points = np.concatenate([decode_e8(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
    out = [_key(points, table)]
    if probes:
        rest = y - points
        gain = np.concatenate([rest[:, 8 * b : 8 * b + 8] @ MINIMAL.T for b in range(blocks)], axis=1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            moved = points.copy()
            b, v = best[:, p] // 240, best[:, p] % 240
            for k in range(8):
                moved[np.arange(len(y)), 8 * b + k] += MINIMAL[v, k]
            out.append(_key(moved, table))
    return np.stack(out, axis=1)


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows meet in a table: equal homes, or one's home among the other's probes."""
    return (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)


def meeting_rates(dims: int, blocks: int, cosine: float, scale: float = SCALE, probes: int = PROBES, seed: int = SEED, trials: int = 4000) -> tuple[float, float]:
    """Chance that a pair at the threshold, and a pair of independent vectors, meet in one table (simulated)."""
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((trials, dims)), rng.standard_normal((trials, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
    y = cosine * x + math.sqrt(1 - cosine**2) * z if dims > 1 else x
    near = far = 0.0
    for t in range(2):
        g = projections(dims, 2, blocks, seed)[t]
        a, b, c = (cells(v, g, t, scale, probes) for v in (x, y, z))
        near += meet(a, b).mean() / 2
        far += meet(a, c).mean() / 2
    return near, far


def choose(n: int, dims: int, cosine: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(blocks, probes, tables) of least estimated work for n vectors."""
    best, far1 = None, {}
    for blocks in (1, 2, 3):
        for probes in PROBE_CHOICES:
            near, far = meeting_rates(dims, blocks, cosine, SCALE, probes, trials=1000)
            far1.setdefault(probes, max(far, 1e-4))
            far = max(far, far1[probes] ** blocks)
            tables = max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(near, 0.9999)))) if near > 0 else 10_000  # at least two tables
            work = n * tables * (1 + probes) * ROW_COST + n * n / 2 * tables * far * PAIR_COST
            if best is None or work < best[0]:
                best = (work, (blocks, probes, tables))
    return best[1]


def _links(g: dict, cosine: float, tables: int, width: int):
    """Verified pairs of sorted groups, each counted once over all tables, as index arrays in pieces."""
    u, home = g["vec"], g["cells"].reshape(len(g["key"]), tables, width)

    def once(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ti = g["t"][i]
        a, b = home[i, ti], home[j, ti]
        first = ~(b[:, :1] == a[:, 1:]).any(axis=1) | (a[:, 0] < b[:, 0]) | (a[:, 0] == b[:, 0])
        for t in range(tables):
            later = np.flatnonzero(ti > t)
            if len(later):
                first[later] &= ~meet(home[i[later], t], home[j[later], t])
        return first

    changed = np.concatenate([[True], (g["key"][1:] != g["key"][:-1]) | (g["sub"][1:] != g["sub"][:-1])])
    start = np.flatnonzero(changed)
    size = np.diff(np.append(start, len(changed)))
    large = size >= 24
    for s, n in zip(start[large], size[large], strict=True):
        homes = int((g["side"][s : s + n] == 0).sum())
        sub = int(g["sub"][s])
        cross = sub >= 0 and sub // _SUB != sub % _SUB
        other = u[s + homes : s + n] if cross else u[s : s + n]
        base = s + homes if cross else s
        for r in range(0, homes, 1024):
            i, j = np.nonzero(u[s + r : s + min(r + 1024, homes)] @ other.T >= cosine)
            i, j = i + s + r, j + base
            keep = i < j
            i, j = i[keep], j[keep]
            for k in range(0, len(i), 1 << 18):
                a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                keep = once(a, b)
                yield a[keep], b[keep]
    rest = np.repeat(~large, size)
    if rest.any():
        at = np.flatnonzero(rest)
        for i, j in group_pairs({c: g[c][at] for c in ("key", "sub", "side")}, 1 << 18):
            i, j = at[i], at[j]
            near = np.einsum("ij,ij->i", u[i], u[j]) >= cosine
            i, j = i[near], j[near]
            keep = once(i, j)
            yield i[keep], j[keep]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, embedding`` of rows that can link: an id, and a vector that is not null, not all zero and
    holds finite numbers only."""
    return vectors.where(_can_link(id_col, vec_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))


def _can_link(id_col: str, vec_col: str) -> Column:
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.col(id_col).isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED, recall: float = RECALL) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    n_links: other rows linked directly (cosine >= ``cosine``); component_id: the smallest id reachable;
    kept: vec_id = component_id. Vectors that are null, all zero, or hold null or non-finite components link
    with nothing and are their own component. Rows without an id link with nothing, have a null component and
    are not kept. Shorter vectors count as padded with zeros. Rows that repeat an id are joined by it.
    An empty table gives no rows.

    Plan: equal vectors are one node with a weight. (cell, node) rows are shuffled first, a fixed number per
    vector; only rows whose cell holds a home and one row more fetch their vectors. Pairs are verified by matrix
    products inside the task, counted in the first table and cell in which they meet, and leave it as one sum per
    row and a spanning forest. Cells with over ``BLOCK_ROWS`` rows, homes or probes, are dealt as pairs of blocks.
    """
    from pyspark.sql import types as T

    good = usable(vectors, id_col, vec_col)
    members = materialize(good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "vectors")
    n, dims = members.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dims = max(dims or 1, 1)
    blocks, probes, tables = choose(n, dims, cosine, recall) if n > 1 else (1, 2, 2)
    width = 1 + probes
    kind = good.schema["embedding"].dataType.elementType
    store = pa.float32() if isinstance(kind, T.FloatType) else pa.float64()
    spark_store = "float" if isinstance(kind, T.FloatType) else "double"

    def unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x / np.abs(x).max(axis=1)[:, None]  # against overflow and underflow of the squares
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def emit(it):
        g = projections(dims, tables, blocks, seed)
        for b in it:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = np.zeros((part.num_rows, dims))
                for i, v in enumerate(part.column(0)):
                    v = v.values.to_numpy(zero_copy_only=False)
                    x[i, : len(v)] = v
                u = unit(x)
                keys = np.stack([cells(u, g[t], t, SCALE, probes) for t in range(tables)], axis=1)
                vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()).cast(store), dims).cast(pa.list_(store))
                cell = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), tables * width).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), vec, cell], ["node", "weight", "vec", "cells"])

    # projected once; what looks for company is (cell, node), without the vectors
    hashed = materialize(members.mapInArrow(emit, f"node long, weight long, vec array<{spark_store}>, cells array<long>"), "lattice-cells")
    rows = hashed.select("node", F.posexplode("cells").alias("at", "key")).select("key", "node", F.expr(f"int(at div {width})").alias("t"), (F.col("at") % width > 0).cast("byte").alias("side"))
    home = F.count_if(F.col("side") == 0)
    company = rows.groupBy("key").agg(home.alias("homes"), F.count("*").alias("n")).where("homes > 0 and n > 1").select("key")
    met = materialize(rows.join(company, "key", "left_semi"), "lattice-met")
    dealt = with_blocks(met, met.select("key", "side"), BLOCK_ROWS).join(hashed, "node").repartition("key", "sub").sortWithinPartitions("key", "sub", "side")

    def verify(it):
        for g in sorted_groups(it, ["key", "sub"], ["side", "node", "t", "weight", "vec", "cells"]):
            g["vec"] = unit(g["vec"])
            links = np.zeros(len(g["key"]), dtype=np.int64)
            left, right = [], []
            for i, j in _links(g, cosine, tables, width):
                np.add.at(links, i, g["weight"][j])
                np.add.at(links, j, g["weight"][i])
                root = local_roots(len(links), i, j)
                i = np.flatnonzero(root != np.arange(len(root)))
                left.append(i)
                right.append(root[i])
            if not left:
                continue
            at = np.flatnonzero(links)
            i, j = np.concatenate(left), np.concatenate(right)
            root = local_roots(len(links), i, j)
            i = np.flatnonzero(root != np.arange(len(root)))
            a = np.concatenate([g["node"][at], g["node"][i]])
            b = pa.array(np.concatenate([np.zeros(len(at), dtype=np.int64), g["node"][root[i]]]), mask=np.arange(len(a)) < len(at))
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[at], np.zeros(len(i), dtype=np.int64)]))], ["a", "b", "links"])

    found = materialize(dealt.mapInArrow(verify, "a long, b long, links long"), "lattice-links")
    linked = components(found.where("b is not null").select("a", "b"))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("far_links"))
    classes = members.join(degree, "node", "left").join(linked, "node", "left").select(F.col("embedding").alias("of"), (F.coalesce("far_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    inside = good.join(classes, good.embedding == classes.of).select("vec_id", "n_links", F.col("component").alias("component_id"))
    outside = vectors.where(~_can_link(id_col, vec_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), r AS (
  SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id
), c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
