"""Product codes of vectors, learnt and assigned with segment-mean lower bounds in exact integer arithmetic.

Vectors become integers and are cut into equal parts, each with a small codebook. An entry is compared with a
part coarse to fine: the sums of its segments and the norms of what the segment means leave over give a lower
bound of the squared distance. Entries whose bound exceeds a distance already reached are dropped; what survives
gets its exact integer distance. A codebook round is one pass over the rows: tasks add up the parts by entry and
send the sums in 32-bit limbs, which Spark adds, so that a sum is exact at any size.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import materialize, unused

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_CHUNK = 2048
_LONG = (-(2**63), 2**63 - 1)


def finite(c: Column) -> Column:
    """Whether a vector is not null and holds no null or non-finite component."""
    return F.coalesce(c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))), F.lit(False))


def integers(lists: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a column of number lists, padded with zeros to ``width``: int64, or Python integers where
    a value does not fit 53 bits."""
    size = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten()).astype(np.float64)
    with np.errstate(over="ignore"):
        f = np.floor(flat * scale)
    if np.abs(f).max(initial=0) < 2**53:
        values = f.astype(np.int64)
    else:
        values = np.array([math.floor(Fraction(x) * Fraction(scale)) for x in flat.tolist()], dtype=object)
    out = np.zeros((len(size), width), dtype=values.dtype)
    out[np.arange(width)[None, :] < size[:, None]] = values
    return out


def ladder(width: int) -> list[int]:
    """Numbers of equal segments, coarse to fine, each a multiple of the one before; ``width`` itself is exact."""
    out, s = [], 1
    while s < width:
        out.append(s)
        rest = width // s
        s *= next(p for p in range(2, rest + 1) if rest % p == 0)
    return out


def _isqrt(x: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(x)
    return np.sqrt(x.astype(np.float64)).astype(np.int64)


def _summary(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each row's segments, and the root of L * (what the segments' means leave over), L their length."""
    length = x.shape[1] // segments
    s = x.reshape(len(x), segments, length).sum(axis=2)
    return s, _isqrt(length * (x * x).sum(axis=1) - (s * s).sum(axis=1))


def _bound(s: np.ndarray, t: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """L times a lower bound of the squared distance. Roots are whole numbers within 2 of the true ones, so their
    difference is taken 4 smaller."""
    gap = np.maximum(abs(r - q) - 4, 0)
    d = s - t
    return (d * d).sum(axis=-1) + gap * gap


def nearest(x: np.ndarray, book: np.ndarray, spared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to each row's nearest entry, ties to the lower index; all in integers.

    spared: if given, the number of pairs that the bounds dropped is appended.
    """
    n, width = x.shape
    most = max(int(abs(x).max(initial=0)), int(abs(book).max(initial=0)))
    kind = np.int64 if 4 * width * width * most * most < 2**62 else object
    x, book = (m if m.dtype == kind else np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) if kind is object else m.astype(np.int64) for m in (x, book))
    alive, best = np.ones((n, len(book)), dtype=bool), None
    for segments in ladder(width):
        length = width // segments
        (s, r), (t, q) = _summary(x, segments), _summary(book, segments)
        if best is None:
            b = _bound(s[:, None, :], t[None, :, :], r[:, None], q[None, :])
            d = x - book[b.argmin(axis=1)]
            best = (d * d).sum(axis=1)
            alive = np.asarray(b <= best[:, None] * length, dtype=bool)
        else:
            i, j = np.nonzero(alive)
            far = np.asarray(_bound(s[i], t[j], r[i], q[j]) > best[i] * length, dtype=bool)
            alive[i[far], j[far]] = False
    i, j = np.nonzero(alive)
    d = x[i] - book[j]
    d = (d * d).sum(axis=1)
    full = np.full(alive.shape, (d.max() if len(d) else 0) + 1, dtype=kind)
    full[i, j] = d
    code = full.argmin(axis=1) if n else np.zeros(0, dtype=np.int64)
    if spared is not None:
        spared.append(n * len(book) - len(i))
    return code, full[np.arange(n), code]


def _limbs(v: int) -> list[int]:
    """v in signed base 2**32, lowest first; the last limb has the sign."""
    out = []
    while not -(2**31) <= v < 2**31:
        out.append(v & 0xFFFFFFFF)
        v >>= 32
    return [*out, v]


def _sums(books: list[np.ndarray], scale: float):
    """Rows (slot, limb, value) of a task: per part and entry the sum of each component and the number of rows."""
    width = books[0].shape[1]

    def run(it):
        total = np.zeros((len(books), len(books[0]), width + 1), dtype=object)
        for b in it:
            for at in range(0, b.num_rows, _CHUNK):
                x = integers(b.column(0).slice(at, _CHUNK), width * len(books), scale)
                for p, book in enumerate(books):
                    part = x[:, p * width : (p + 1) * width]
                    code = nearest(part, book)[0]
                    for e in np.unique(code):
                        own = part[code == e]
                        total[p, e] += np.array([*map(int, own.sum(axis=0)), len(own)], dtype=object)
        rows = [(slot, k, limb) for slot, v in enumerate(total.ravel().tolist()) if v for k, limb in enumerate(_limbs(int(v)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["slot", "limb", "value"])

    return run


def learn(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> list[np.ndarray]:
    """The codebooks, one integer matrix (entry x component) per part; an empty list if no vector can be used.

    They start as the parts of the vectors of smallest id (null ids last, rows that share an id by vector). A round
    assigns every part to its nearest entry and replaces each entry by the floor of its parts' mean; an entry
    without parts stays. What reaches the driver is one number a component of an entry, whatever the table's size.
    The table is read once a round.
    """
    kept = vectors.where(finite(F.col(vec_col)))
    dims = kept.agg(F.max(F.size(vec_col))).first()[0]
    if dims is None:
        return []
    width = max(1, -(-dims // parts))
    v = F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v")
    first = kept.orderBy(F.col(id_col).asc_nulls_last(), v).limit(entries).select(v).collect()
    seeds = integers(pa.array([r.v for r in first], type=pa.list_(pa.float64())), width * parts, scale)
    books = [seeds[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        total = np.zeros((parts, len(seeds), width + 1), dtype=object)
        for slot, limb, value in kept.select(v).mapInArrow(_sums(books, scale), "slot int, limb int, value long").groupBy("slot", "limb").agg(F.sum("value")).collect():
            total.ravel()[slot] += value << (32 * limb)
        for p in range(parts):
            book = books[p].astype(object)
            for e in range(len(book)):
                if total[p, e, width]:
                    book[e] = [s // total[p, e, width] for s in total[p, e, :width]]
            books[p] = book if max(abs(x) for x in book.ravel()) >= 2**62 else book.astype(np.int64)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], *, scale: float = SCALE, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` with ``code`` (two hex digits a part) and ``error`` (long, the parts' squared distances added up;
    beyond a long it is the largest long) instead of the vector. Rows whose vector can't be used are dropped."""
    kept = vectors.where(finite(F.col(vec_col)))
    names = [c for c in vectors.columns if c not in (vec_col, "code", "error")]
    if not books:
        return kept.select(*(F.col(f"`{c}`") for c in names), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    width, v = books[0].shape[1], unused(vectors, "v")

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, _CHUNK):
                part = b.slice(at, _CHUNK)
                x = integers(part.column(part.num_columns - 1), width * len(books), scale)
                found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
                code = [row.tobytes().hex() for row in np.stack([f[0] for f in found], axis=1).astype(np.uint8)]
                error = [min(sum(int(d) for d in row), _LONG[1]) for row in zip(*(f[1] for f in found), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(code, type=pa.string()), pa.array(error, type=pa.int64())], [*names, "code", "error"])

    chosen = kept.select(*(F.col(f"`{c}`") for c in names), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias(v))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}code string, error long")


def vector_codes(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, one row per usable vector.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components are dropped;
    zero vectors are not. A shorter vector counts as padded with zeros, and all are padded to a length that
    ``parts`` divides. At most 256 entries; with fewer vectors than entries there are as many as vectors. Equal
    vectors, whatever their ids, get equal codes. label_error: the errors of all rows of equal label, null labels
    together. Sums beyond a long are the largest long. An empty table gives no rows.

    Plan: ``rounds`` + 2 scans of the table, none of which shuffles a vector; codes are written once, and their sum
    by label (partial before its shuffle) is joined to them, so a hot label is a skewed join at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    books = learn(vectors, parts=parts, entries=entries, rounds=rounds, scale=scale, id_col=id_col, vec_col=vec_col)
    coded = materialize(encode(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding")), books, scale=scale), "codes")
    total = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG[1]).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds written out: c0 to c6 are codebooks, a0 to a6 assignments."""
    square = "CAST(list_sum(list_transform(range(1, len(x.s) + 1), lambda i: (x.s[i] - c.c[i]) * (x.s[i] - c.c[i]))) AS BIGINT)"
    steps = ""
    for r in range(ROUNDS + 1):
        steps += f"""
, a{r} AS MATERIALIZED (
  SELECT vec_id, p, s, k, d FROM (SELECT x.vec_id, x.p, x.s, c.k, {square} AS d FROM x JOIN c{r} c USING (p))
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1
)"""
        if r < ROUNDS:
            steps += f"""
, m{r} AS (
  SELECT p, k, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT p, k, i, sum(s[i]) AS t, count(*) AS n FROM a{r}, unnest(range(1, len(s) + 1)) u(i) GROUP BY p, k, i) GROUP BY p, k
)
, c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (p, k))"""
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
, x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS s FROM e, range({PARTS}) r(p))
, c0 AS MATERIALIZED (
  SELECT p, k, s AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e) USING (vec_id) WHERE k < {ENTRIES}
){steps}
, h AS (SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, k, i)) AS sha FROM c{ROUNDS}, unnest(range(1, len(c) + 1)) u(i))
, o AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT o.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, h.sha AS codebooks_sha256
FROM o JOIN e USING (vec_id), h
"""


OP11_SQL = _sql()
