"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Source targets share the token budget by weight, stopped at a number of epochs of the source. Blocks of
``block_words`` words are apportioned to sources, and inside a source to its shards, by highest quotients
(votes / 1, 3, 5, ...). A shard then takes whole passes of its documents while its quota allows and fills the
rest with blocks of its word stream in seeded order. Users of whole documents take ``copies``, which fill the same
quota with documents in seeded order.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import WORD, materialize, row_hash, unused

BLOCK_WORDS = 32
#: Documents of a shard, on average, and shards whose quotas one task apportions.
SHARD_DOCS, GROUP_SHARDS = 1024, 1024
SEED = 20240917
BROADCAST_SOURCES = 10_000


def source_targets(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Shares of ``budget`` by weight; a share stops at ``cap`` times its size and the excess is reshared."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total if total else 0.0 for i in open_}
        over = [i for i in sorted(open_) if share[i] > cap * sizes[i]]
        if not over:
            for i, x in share.items():
                out[i] = x
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def sainte_lague(votes, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1); ties to the earlier entry. Entries without votes get none.

    Starts from the divisor that is right on average and adds or takes single seats by quotient, so the work
    follows the number of entries, not of seats.
    """
    v = np.asarray(votes, dtype=float)
    out = np.zeros(len(v), dtype=np.int64)
    if seats <= 0 or not (v > 0).any():
        return out
    out = np.floor(v / (v.sum() / seats) + 0.5).astype(np.int64)
    gap = seats - int(out.sum())
    if gap > 0:
        heap = [(-x / (2 * s + 1), i) for i, (x, s) in enumerate(zip(v, out, strict=True)) if x > 0]
        heapq.heapify(heap)
        for _ in range(gap):
            _, i = heap[0]
            out[i] += 1
            heapq.heapreplace(heap, (-v[i] / (2 * out[i] + 1), i))
    elif gap < 0:
        heap = [(x / (2 * s - 1), -i) for i, (x, s) in enumerate(zip(v, out, strict=True)) if s > 0]
        heapq.heapify(heap)
        for _ in range(-gap):
            _, j = heapq.heappop(heap)
            out[-j] -= 1
            if out[-j] > 0:
                heapq.heappush(heap, (v[-j] / (2 * out[-j] - 1), j))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def take_blocks(sizes: np.ndarray, quota: int, block: int, seed: int) -> np.ndarray:
    """Words taken of each document of one shard: whole passes, then blocks of the word stream in seeded order,
    the last one cut so that the sum is ``quota``."""
    total = int(sizes.sum())
    if total == 0 or quota <= 0:
        return np.zeros(len(sizes), dtype=np.int64)
    passes, rest = divmod(int(quota), total)
    taken = sizes.astype(np.int64) * passes
    if rest:
        n = -(-total // block)
        order = np.argsort(_mixed(np.arange(n, dtype=np.uint64) ^ np.uint64(seed & (2**64 - 1))), kind="stable")
        length = np.full(n, block, dtype=np.int64)
        length[-1] = total - block * (n - 1)
        before = np.concatenate([[0], np.cumsum(length[order])[:-1]])
        use = np.zeros(n, dtype=np.int64)
        use[order] = np.clip(rest - before, 0, length[order])
        # covered(x): words taken among the first x of the stream
        edges = np.concatenate([[0], np.cumsum(use)])
        ends = np.cumsum(sizes.astype(np.int64))

        def covered(x: np.ndarray) -> np.ndarray:
            b = np.minimum(x // block, n - 1)
            return edges[b] + np.minimum(x - b * block, use[b])

        taken = taken + covered(ends) - covered(ends - sizes)
    return taken


def take_documents(sizes: np.ndarray, quota: int) -> np.ndarray:
    """Copies of each whole document of one shard: whole passes, then documents in the given (seeded) order while
    they fit; the one at the edge is taken if that comes nearer to ``quota``. Wordless documents are not taken."""
    sizes = sizes.astype(np.int64)
    total = int(sizes.sum())
    if total == 0 or quota <= 0:
        return np.zeros(len(sizes), dtype=np.int64)
    passes, rest = divmod(int(quota), total)
    before = np.cumsum(sizes) - sizes
    return np.where(sizes > 0, passes + (2 * (rest - before) > sizes), 0)


def mix(docs: DataFrame, *, weights: dict | None = None, share: float = 1.0, cap: int = 3, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies, source, text_hash``.

    size: words of the text (null: 0). weights: by source (None as a key: the null source); by default sources
    in code-point order, null last, weigh 1, 2, 3, repeating. The budget is ``share`` of all sizes. taken: words
    the mix takes of the document, repeats counted, at most ``cap`` times its size; copies: how often the mix
    takes the document as a whole, at most ``cap``: whole documents fill the quota of their shard in seeded order, so
    the words of copies come as near the target as whole documents can. A source without words has target 0. Ties and
    reruns: all orders are by seeded hash, then id, so reruns agree. Rows with equal ids each get a row. An empty
    table gives no rows.

    Plan: texts are scanned once into (id, source, size, hash). What reaches the driver is one row per source, the
    size of a mix's configuration. Documents are dealt by id and content to shards of about ``shard_docs`` rows of
    their source, so a hot source, or a hot id, is spread over as many groups as its size asks for. A source's seats
    go to groups of ``GROUP_SHARDS`` shards first and from there to the shards, by highest quotients both times.
    """
    spark = docs.sparkSession
    if weights is not None and any(w < 0 for w in weights.values()):
        raise ValueError("weights are at least 0")
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    sized = materialize(sized, "mix-sizes")
    per_source = {r["source"]: (r["n"], r["s"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("s")).toLocalIterator()}
    names = sorted((s for s in per_source if s is not None)) + ([None] if None in per_source else [])
    sizes = [int(per_source[s][1]) for s in names]
    w = [float(weights.get(s, 0)) if weights is not None else float(i % 3 + 1) for i, s in enumerate(names)]
    targets = source_targets(sizes, w, share * sum(sizes), cap)
    seats = sainte_lague(targets, int(sum(targets) / block_words + 0.5))
    config = spark.createDataFrame(
        [(i, s, sizes[i], targets[i], int(seats[i]), max(1, -(-per_source[s][0] // shard_docs))) for i, s in enumerate(names)],
        "source_no long, name string, source_size long, target double, seats long, shards long",
    )
    # One row per source: broadcast while that is few, else written, so that the planner knows its size.
    config = F.broadcast(config) if len(names) <= BROADCAST_SOURCES else materialize(config, "mix-config")
    shard = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), "shards")
    keyed = sized.join(config, sized.source.eqNullSafe(config.name)).select("doc_id", "text_hash", "source", "size", "source_no", "source_size", "target", "seats", shard.alias("shard"))

    def quotas(names: tuple[str, ...]):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by(names[0])
            return pa.table({"q_source": t["source_no"], "q_part": t[names[0]], "q": sainte_lague(t["part_size"].to_numpy(), t[names[1]][0].as_py())})

        return run

    shards = materialize(keyed.groupBy("source_no", "seats", "shard").agg(F.sum("size").alias("part_size")).withColumn("grp", F.expr(f"shard div {GROUP_SHARDS}")), "mix-shards")
    schema = "q_source long, q_part long, q long"
    groups = shards.groupBy("source_no", "seats", "grp").agg(F.sum("part_size").alias("part_size")).groupBy("source_no").applyInArrow(quotas(("grp", "seats")), schema)
    groups = groups.select(F.col("q_source").alias("g_source"), F.col("q_part").alias("g_part"), F.col("q").alias("group_seats"))
    of_shard = shards.join(groups, (F.col("source_no") == F.col("g_source")) & (F.col("grp") == F.col("g_part"))).groupBy("source_no", "grp").applyInArrow(quotas(("shard", "group_seats")), schema)
    quota = of_shard.join(shards.select(F.col("source_no").alias("s_source"), F.col("shard").alias("s_shard"), "part_size"), (F.col("q_source") == F.col("s_source")) & (F.col("q_part") == F.col("s_shard")))
    quota = materialize(quota.select("q_source", "q_part", F.least(F.col("q") * block_words, cap * F.col("part_size")).alias("quota")), "mix-quotas")

    def taken(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("text_hash", "ascending")])
        size = t["size"].to_numpy()
        key = (t["source_no"][0].as_py() * 1_000_003 + t["shard"][0].as_py()) * 2_654_435_761 + seed
        got = take_blocks(size, t["quota"][0].as_py(), block_words, key)
        copies = take_documents(size, t["quota"][0].as_py())
        return pa.table({"doc_id": t["doc_id"], "size": t["size"], "source_size": t["source_size"], "target": t["target"], "taken": got, "copies": copies, "source": t["source"], "text_hash": t["text_hash"]})

    dealt = keyed.withColumn("h", F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash")).join(quota, (F.col("source_no") == F.col("q_source")) & (F.col("shard") == F.col("q_part")))
    return dealt.groupBy("source_no", "shard").applyInArrow(taken, "doc_id long, size long, source_size long, target double, taken long, copies long, source string, text_hash long")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """``docs`` with every row as often as the mix (:func:`mix`) takes it as a whole; columns as they are.

    Rows with equal id, text and source stand for each other: the first of them by a hash of all columns is written
    as often as the mix takes them together. Wordless rows are not taken. Columns of ``docs`` may have any names.
    """
    key = [unused(docs, c) for c in ("mix_id", "mix_text", "mix_source")]
    times, n, row = unused(docs, "mix_copies"), unused(docs, "mix_rows"), unused(docs, "mix_row")
    found = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    found = found.groupBy(F.col("doc_id").alias(key[0]), F.col("text_hash").alias(key[1]), F.col("source").alias(key[2])).agg(F.sum("copies").cast("int").alias(times), F.count("*").alias(n))
    found = materialize(found.where(F.col(times) > 0), "mix-taken")

    def repeated(part: DataFrame) -> DataFrame:
        part = part.hint("shuffle_hash")
        return docs.join(part, docs[id_col].cast("long").eqNullSafe(part[key[0]]) & (F.xxhash64(docs[text_col]) == part[key[1]]) & docs[source_col].cast("string").eqNullSafe(part[key[2]]))

    spread = F.explode(F.sequence(F.lit(1), F.col(times)))
    out = repeated(found.where(F.col(n) == 1)).withColumn(row, spread).select(*docs.columns)
    many = found.where(F.col(n) > 1)
    if not many.isEmpty():
        first = repeated(many).groupBy(*key, times).agg(F.min_by(F.struct(*docs.columns), row_hash(docs)).alias(row))
        out = out.unionByName(first.withColumn(n, spread).select(f"{row}.*"))
    return out


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
