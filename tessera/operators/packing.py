"""Truncation, loss masks, packing and load balancing of token sequences."""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truncated_lengths(source: Column, target: Column, cutoff: Column | int) -> tuple[Column, Column]:
    """(source, target) lengths that fit the cutoff: the short side is kept whole while it is under half."""
    c = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    most = F.when(target * 2 < c, c).when(source * 2 < c, c - source).otherwise(F.floor(c * (target / (source + target))))
    t = F.least(most, target).cast("long")
    return F.least(F.greatest(c - t, F.lit(0)), source).cast("long"), t


def encode_turns(turns: Column, cutoff: int, ignore: int = -100, train_on_prompt: bool = False) -> Column:
    """Struct (ids, labels) of an array of (source_ids, target_ids): each turn is cut to the budget left."""
    empty = F.array().cast("array<int>")
    state = F.struct(empty.alias("ids"), empty.alias("labels"))

    def step(a, x):
        left = F.greatest(F.lit(cutoff) - F.size(a["ids"]), F.lit(0))
        s, t = truncated_lengths(F.size(x["source_ids"]).cast("long"), F.size(x["target_ids"]).cast("long"), left.cast("long"))
        src, tgt = F.slice(x["source_ids"], F.lit(1), s.cast("int")), F.slice(x["target_ids"], F.lit(1), t.cast("int"))
        label = src if train_on_prompt else F.transform(src, lambda _: F.lit(ignore))
        return F.struct(F.concat(a["ids"], src, tgt).alias("ids"), F.concat(a["labels"], label, tgt).alias("labels"))

    return F.aggregate(turns, state, step)


def pretrain_blocks(rows: DataFrame, order: str, ids: str, block: int, batch: int = 1000) -> DataFrame:
    """``batch_no, block_no, ids``: the ids of every ``batch`` rows joined and cut into full blocks."""
    b = rows.withColumn("batch_no", F.floor(F.col(order) / batch).cast("long"))
    w = Window.partitionBy("batch_no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.size(ids).cast("long")
    at = b.select("batch_no", ids, n.alias("n"), F.coalesce(F.sum(n).over(w), F.lit(0)).alias("start")).where("n > 0")
    # a row is cut at block borders into one piece a block; pieces alone go on, never beside the whole row's ids
    last = F.floor((F.col("start") + F.col("n") - 1) / block)

    def piece(k: Column) -> Column:
        first = F.greatest(k * block - F.col("start"), F.lit(0))
        stop = F.least((k + 1) * block - F.col("start"), F.col("n"))
        return F.struct(k.alias("block_no"), (F.col("start") + first).alias("place"), F.slice(ids, (first + 1).cast("int"), (stop - first).cast("int")).alias("part"))

    pieces = at.select("batch_no", F.explode(F.transform(F.sequence(F.floor(F.col("start") / block), last), piece)).alias("p")).select("batch_no", "p.*")
    g = pieces.groupBy("batch_no", "block_no").agg(F.sum(F.size("part")).alias("n"), F.array_sort(F.collect_list(F.struct("place", "part"))).alias("s"))
    return g.where(F.col("n") == block).select("batch_no", "block_no", F.flatten(F.col("s.part")).alias("ids"))


def block_counts(rows: DataFrame, order: str, length: str, block: int, batch: int = 1000) -> DataFrame:
    """``batch_no, tokens, blocks, dropped`` of the same packing from lengths alone."""
    g = rows.groupBy(F.floor(F.col(order) / batch).cast("long").alias("batch_no")).agg(F.sum(length).alias("tokens"))
    return g.select("batch_no", "tokens", F.floor(F.col("tokens") / block).cast("long").alias("blocks"), (F.col("tokens") % block).alias("dropped"))


def greedy_knapsack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions by knapsack: again and again the largest length that still fits; lengths over the capacity are
    left out; of equal lengths the last position goes first."""
    left = sorted((n, i) for i, n in enumerate(lengths) if n <= capacity)
    sizes = [n for n, _ in left]
    out = []
    while left:
        room, sack = capacity, []
        while (k := bisect.bisect_right(sizes, room)) > 0:
            n, i = left.pop(k - 1)
            sizes.pop(k - 1)
            room -= n
            sack.append(i)
        out.append(sack)
    return out


def knapsack_pack(rows: DataFrame, order: str, length: str, capacity: int, batch: int = 1000) -> DataFrame:
    """``order, batch_no, knapsack, place``: rows packed inside batches of ``batch`` rows (a bounded group)."""
    kind = dict(rows.dtypes)[order]

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        where = [(i, k, j) for k, sack in enumerate(greedy_knapsack(p[length].tolist(), capacity)) for j, i in enumerate(sack)]
        at = [w[0] for w in where]
        return pd.DataFrame({order: p[order].to_numpy()[at], "batch_no": p["batch_no"].to_numpy()[at], "knapsack": [w[1] for w in where], "place": [w[2] for w in where]})

    b = rows.select(order, length).withColumn("batch_no", F.floor(F.col(order) / batch).cast("long"))
    return b.groupBy("batch_no").applyInPandas(pack, f"{order} {kind}, batch_no long, knapsack int, place int")


def karmarkar_karp(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k sets of positions by largest differencing; with ``equal_size`` every set has as many members.

    A state is k sets in falling order of (sum, members); the two states of largest spread are merged, largest
    set to smallest. Ties follow the members' order."""
    order = sorted((n, i) for i, n in enumerate(lengths))
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} lengths do not make {k} equal sets")
    falling = lambda sets: sorted(sets, key=lambda s: (s[0], len(s[1]), s[1]), reverse=True)
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal_size else [[x] for x in order]

    class State:
        def __init__(self, sets):
            self.sets = falling(sets)

        def __lt__(self, other):
            a, b = self.sets[0][0] - self.sets[-1][0], other.sets[0][0] - other.sets[-1][0]
            if a != b:
                return a > b
            x, y = self.sets[0], other.sets[0]
            return (x[0], len(x[1]), x[1]) > (y[0], len(y[1]), y[1])

    heap: list[State] = []
    for g in groups:
        sets = [(n, [(i, n)]) for n, i in g] + [(0, [])] * (k - len(g))
        heapq.heappush(heap, State(sets))
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, State([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a.sets, reversed(b.sets), strict=True)]))
    return [[i for i, _ in s[1]] for s in heap[0].sets] if heap else [[] for _ in range(k)]


def least_loaded(lengths: list[int], k: int) -> list[list[int]]:
    """Positions to the set with the smallest sum so far, in the given order."""
    heap = [(0, i) for i in range(k)]
    out: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        total, j = heapq.heappop(heap)
        out[j].append(i)
        heapq.heappush(heap, (total + n, j))
    return out


def balance(rows: DataFrame, group: str, order: str, length: str, k: int, *, equal_size: bool = False, method: str = "karmarkar_karp") -> DataFrame:
    """``group, order, length, part``: each group's rows (one training batch) dealt to k balanced parts."""
    kinds = dict(rows.dtypes)

    def deal(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order).reset_index(drop=True)
        parts = karmarkar_karp(p[length].tolist(), k, equal_size) if method == "karmarkar_karp" else least_loaded(p[length].tolist(), k)
        part = pd.Series(0, index=p.index)
        for j, at in enumerate(parts):
            part.iloc[at] = j
        return p.assign(part=part)[[group, order, length, "part"]]

    return rows.select(group, order, length).groupBy(group).applyInPandas(deal, f"{group} {kinds[group]}, {order} {kinds[order]}, {length} {kinds[length]}, part int")


def micro_batches(lengths: list[int], max_tokens: int, multiple: int = 1) -> list[list[int]]:
    """Positions by micro-batch: as many as the token budget asks for, balanced, those with the largest sum of
    squared lengths first."""
    n = min(len(lengths), -(-sum(lengths) // max_tokens))
    n = -(-n // multiple) * multiple
    parts = karmarkar_karp(lengths, n)
    return sorted(parts, key=lambda p: sum(lengths[i] ** 2 for i in p), reverse=True)


def micro_batched(rows: DataFrame, group: str, order: str, length: str, max_tokens: int, *, multiple: int = 1) -> DataFrame:
    """``group, order, length, micro``: each group's rows (one training batch) dealt to micro-batches by
    :func:`micro_batches`; ``micro`` counts from the heaviest."""
    kinds = dict(rows.dtypes)

    def deal(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order).reset_index(drop=True)
        micro = pd.Series(0, index=p.index)
        for j, at in enumerate(micro_batches(p[length].tolist(), max_tokens, multiple)):
            micro.iloc[at] = j
        return p.assign(micro=micro)[[group, order, length, "micro"]]

    return rows.select(group, order, length).groupBy(group).applyInPandas(deal, f"{group} {kinds[group]}, {order} {kinds[order]}, {length} {kinds[length]}, micro int")


def pad_or_cut(ids: Column, width: int, pad: int, *, left_pad: bool = True, truncation: str = "error") -> Column:
    """An id array of exactly ``width``; too long ones are cut ``left``, ``right``, ``middle`` or are an error."""
    n = F.size(ids)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(width) - n, F.lit(0)))
    padded = F.concat(fill, ids) if left_pad else F.concat(ids, fill)
    half = width // 2
    cut = {
        "left": F.slice(ids, F.greatest(n - width + 1, F.lit(1)), F.lit(width)),
        "right": F.slice(ids, 1, width),
        "middle": F.concat(F.slice(ids, 1, half), F.slice(ids, F.greatest(n - (width - half) + 1, F.lit(1)), F.lit(width - half))),
        "error": F.raise_error(F.concat(F.lit("sequence of "), n.cast("string"), F.lit(f" ids is over {width}"))).cast("array<int>"),
    }[truncation]
    return F.when(n > width, cut).otherwise(padded)


def sft_loss_mask(attention: Column, prompt: Column, response: Column) -> Column:
    """The attention mask with the prompt's tokens but its last, and the response's last token, set to 0."""
    return F.transform(attention, lambda m, i: F.when((i < prompt - 1) | (i == F.least(prompt + response, F.size(attention)) - 1), 0).otherwise(m))


def turn_loss_mask(messages: Column) -> Column:
    """Token mask of an array of (role, n_prompt, n_tokens): assistant tokens after the generation prompt."""
    return F.flatten(F.transform(messages, lambda m: F.when(m["role"] == "assistant", F.concat(F.array_repeat(F.lit(0), m["n_prompt"]), F.array_repeat(F.lit(1), m["n_tokens"] - m["n_prompt"]))).otherwise(F.array_repeat(F.lit(0), m["n_tokens"]))))


def segment_lengths(mask: Column) -> Column:
    """Lengths of the packed segments 1..k of a row's mask."""
    top = F.coalesce(F.array_max(mask), F.lit(0))
    return F.when(top > 0, F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda s: F.size(F.filter(mask, lambda x: x == s)))).otherwise(F.array().cast("array<int>"))


def block_mask(mask: Column) -> Column:
    """Rows of the 4-D mask: 1 where both places are in one segment and the key is not later."""
    return F.transform(mask, lambda a, i: F.transform(mask, lambda b, j: F.when((a == b) & (a != 0) & (j <= i), 1).otherwise(0)))


def segment_runs(mask: Column) -> Column:
    """Runs of equal neighbours as (start, end, segment), end behind the last place; padding (0) is a run too."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(mask) - 1, F.lit(0))), lambda i: (i < F.size(mask)) & ((i == 0) | (F.get(mask, i) != F.get(mask, i - 1))))
    ends = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.size(mask)))
    runs = F.arrays_zip(places.alias("start"), ends.alias("end"))
    return F.when(F.size(mask) > 0, F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.get(mask, r["start"]).alias("segment")))).otherwise(
        F.array().cast("array<struct<start:int,end:int,segment:int>>"))


def mask_intervals(mask: Column) -> Column:
    """The block-diagonal causal mask of a packed row without its n x n cells: for each place the keys it may see as
    (low, high), from low to before high; none for padding. A row's segments do not recur, as packing numbers them."""
    def places(r: Column) -> Column:
        return F.transform(F.sequence(r["start"], r["end"] - 1), lambda i: F.struct(F.when(r["segment"] == 0, i).otherwise(r["start"]).alias("low"), F.when(r["segment"] == 0, i).otherwise(i + 1).alias("high")))

    return F.flatten(F.transform(segment_runs(mask), places))


def pad_to_batch(rows: DataFrame, batch: str, ids: str, pad: int, out: str = "padded") -> DataFrame:
    """Right-pads id arrays to the longest of their batch."""
    w = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return rows.withColumn("__w", w).withColumn(out, F.concat(ids, F.array_repeat(F.lit(pad), F.col("__w") - F.size(ids)))).drop("__w")
