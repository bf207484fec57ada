"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature after the other, on per-bin gradient sums; their leaves add
up to one lookup table per feature. Then the feature pairs with the most interaction left in the residuals
get two-dimensional tables in the same way. A score is the logistic of a sum of table entries.
"""

from __future__ import annotations

import itertools
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import crc32_text

#: Bound on the labelled rows that a model is fitted to (a seeded choice of them); scoring has no bound.
MAX_TRAIN = 20_000
MAX_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES, PENALTY = 32, 120, 8, 40, 0.1, 4, 2.0
THRESHOLD = 0.7

_CLASS = np.zeros(256, dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == "\n" else 5 if _c.isspace() else 6 if _c in ".,;:?'\"-()" else 7
FEATURES = ["log_chars", "log_words", "mean_word", "other_bytes", "lower", "upper", "digit", "newline", "space", "prose_marks", "symbols", "entropy", "same_next", "mark_ends", "upper_after_upper", "distinct_words", "repeated_words_log", "repeated_lines", "mean_line", "short_words", "end_marks"]


def features(text: str | None) -> list[float]:
    """Feature values of a whole text; a null text is empty and an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    count = np.bincount(b, minlength=256)
    n = len(b)
    kinds = np.bincount(_CLASS, weights=count, minlength=8) / n
    p = count[count > 0] / n
    kind = _CLASS[b]
    mark, blank = kind >= 6, (kind == 4) | (kind == 5)
    words = text.split()
    nw = max(len(words), 1)
    distinct = len(set(words)) / nw
    lines = [x for x in text.split("\n") if x.strip()]
    short = sum(1 for w in words if len(w) <= 3)
    stops = int(count[46] + count[33] + count[63])
    return [
        math.log1p(n), math.log1p(len(words)), n / nw, kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        float(-(p * np.log2(p)).sum()), float((b[1:] == b[:-1]).mean()) if n > 1 else 0.0, float((mark[:-1] & blank[1:]).sum() / nw), float(((kind[1:] == 2) & (kind[:-1] == 2)).mean()) if n > 1 else 0.0,
        distinct, (1 - distinct) * math.log1p(len(words)), 1 - len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)), short / nw, stops / nw,
    ]


@dataclass
class QualityModel:
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of feature values: a sum of table entries per row."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values per bin of a tree with at most ``leaves`` leaves on one binned feature."""
    gc, hc = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])

    def value(a: int, b: int) -> float:
        return (gc[b] - gc[a]) / (hc[b] - hc[a] + PENALTY)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        c = np.arange(a + 1, b)
        gain = (gc[c] - gc[a]) ** 2 / (hc[c] - hc[a] + PENALTY) + (gc[b] - gc[c]) ** 2 / (hc[b] - hc[c] + PENALTY) - (gc[b] - gc[a]) ** 2 / (hc[b] - hc[a] + PENALTY)
        k = int(gain.argmax())
        return float(gain[k]), int(c[k])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(*best(a, b), i) for i, (a, b) in enumerate(parts)]
        gain, cut, i = max(options, key=lambda o: (o[0], -o[2]))
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


def _grid(key: np.ndarray, w: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(key, weights=w, minlength=shape[0] * shape[1]).reshape(shape)


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Table of the best pair of cuts (one in each feature) on gradient sums of a bin grid."""
    if min(g.shape) < 2:
        return np.zeros(g.shape)
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(c: np.ndarray) -> list[np.ndarray]:
        low = c[:-1, :-1]
        return [low, c[:-1, -1:] - low, c[-1:, :-1] - low, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + low]

    gs, hs = four(gc), four(hc)
    gain = sum(a**2 / (b + PENALTY) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [a[i, j] / (b[i, j] + PENALTY) for a, b in zip(gs, hs, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out


def fit(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Fit to feature rows and 0/1 labels. With no rows scores are 0.5; with one class, near its label."""
    n = len(y)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, MAX_BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(len(FEATURES))]
    rate = (y.sum() + 0.5) / (n + 1.0)
    model = QualityModel(edges, math.log(rate / (1 - rate)), [np.zeros(len(e) + 1) for e in edges])
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(n, model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            g, h = residual()
            step = RATE * _tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)), LEAVES)
            table += step
            total += step[b[:, f]]
    g, h = residual()
    rank = []
    for i, j in itertools.combinations(range(len(edges)), 2):
        shape = (len(model.tables[i]), len(model.tables[j]))
        if min(shape) < 2:
            continue
        key = b[:, i] * shape[1] + b[:, j]
        table = _quadrants(_grid(key, g, shape), _grid(key, h, shape))
        rank.append((float((table[b[:, i], b[:, j]] * g).sum()), i, j))
    for _, i, j in sorted(rank, key=lambda r: (-r[0], r[1], r[2]))[:PAIRS]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(model.tables[i]), len(model.tables[j]))))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = residual()
            key = b[:, i] * table.shape[1] + b[:, j]
            step = RATE * _quadrants(_grid(key, g, table.shape), _grid(key, h, table.shape))
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def held_out(id_col: str | Column = "doc_id", mod: int = 4, rest: int = 2) -> Column:
    """True where crc32 of the id as text leaves ``rest``; a null id is not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(crc32_text(c), F.lit(mod)) == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learns from labelled documents that are not held out, at most ``max_train`` (document, label) pairs in order of a
    seeded hash of the id, then by content. Labels other than 0 and 1, null ids and labels without a document count for
    nothing and use nothing of the bound; an id labelled twice, or of several documents, counts for each pair. Only
    text features are inputs."""
    ids = docs.select(F.col(id_col).cast("long").alias("known_id"))
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("y"))
    usable = usable.join(ids, F.col("label_id") == F.col("known_id"), "left_semi")
    chosen = usable.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(max_train)

    def run(it):
        for b in it:
            x = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["label_id", "y", "x"])

    # max_train rows of two numbers: the bound that makes this side fit for a broadcast.
    joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    # Ids of several documents bring more pairs than labels: the bound holds for what reaches the driver.
    rows = joined.select("label_id", "text", "y").mapInArrow(run, "label_id long, y int, x array<double>").orderBy(F.xxhash64("label_id"), "label_id", "y", "x").limit(max_train).collect()
    rows.sort(key=lambda r: (r["label_id"], r["y"], r["x"]))
    return fit(np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], dtype=float))


def _scores(model: QualityModel, texts) -> np.ndarray:
    return model.score(np.array([features(t.as_py()) for t in texts], dtype=float).reshape(len(texts), len(FEATURES)))


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row: one pass, no shuffle. Null and empty texts get the score of a
    text whose features are all zero; repeated rows get equal scores."""
    packed = pickle.dumps(model)

    def run(it):
        m = pickle.loads(packed)
        for b in it:
            s = _scores(m, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def accept(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model scores at ``threshold`` or more."""
    packed, at = pickle.dumps(model), docs.columns.index(text_col)

    def run(it):
        m = pickle.loads(packed)
        for b in it:
            yield b.filter(pa.array(_scores(m, b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
