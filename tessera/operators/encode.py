"""Token-id rows of training examples: supervised, pairwise, feedback and unsupervised encodings, packing, collation.

All take id arrays (``array<int>``) that a tokenizer made; they are column expressions, so nothing leaves the JVM but
the bounded knapsack groups of :func:`packed_examples`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import knapsack_pack, truncated_lengths

IGNORE = -100
_IDS = "array<int>"


def _none() -> Column:
    return F.array().cast(_IDS)


def _repeat(value: int | Column, times: Column) -> Column:
    """An id ``times`` times; no entries for 0."""
    return F.array_repeat(F.lit(value) if isinstance(value, int) else value, times.cast("int"))


def _first(ids: Column, n: Column) -> Column:
    return F.slice(ids, F.lit(1), n.cast("int"))


def _size(ids: Column) -> Column:
    return F.size(ids).cast("long")


def encode_supervised(turns: Column, cutoff: int, *, ignore: int = IGNORE, train_on_prompt: bool = False, mask_history: bool = False, eos: int | None = None) -> Column:
    """Struct (input_ids, labels) of an array of (source_ids, target_ids).

    Each turn is cut to the budget that earlier turns left; without budget the rest is dropped. Labels are ``ignore``
    on sources (unless ``train_on_prompt``). With ``mask_history`` the last turns come first in the budget and only the
    last target is trained. With ``eos`` the example ends in that id, and every source after the first taken turn
    starts its labels with it: the end of the answer before.
    """
    whole = F.struct(_none().alias("ids"), _none().alias("labels"), F.lit(0 if eos is None else 1).cast("long").alias("total"), F.lit(0).alias("turn"))

    def step(a, x):
        s, t = truncated_lengths(_size(x["source_ids"]), _size(x["target_ids"]), (F.lit(cutoff) - a["total"]).cast("long"))
        source, target = _first(x["source_ids"], s), _first(x["target_ids"], t)
        masked = _repeat(ignore, s)
        if train_on_prompt:
            masked = source
        elif eos is not None:
            # an empty source keeps the mark of the answer before it
            masked = F.when(a["turn"] > 0, F.concat(F.array(F.lit(eos)), _repeat(ignore, F.greatest(s - 1, F.lit(0))))).otherwise(masked)
        trained = F.when(a["turn"] > 0, _repeat(ignore, t)).otherwise(target) if mask_history else target
        ids = F.concat(source, target, a["ids"]) if mask_history else F.concat(a["ids"], source, target)
        labels = F.concat(masked, trained, a["labels"]) if mask_history else F.concat(a["labels"], masked, trained)
        taken = F.struct(ids.alias("ids"), labels.alias("labels"), (a["total"] + s + t).alias("total"), (a["turn"] + 1).alias("turn"))
        return F.when(a["total"] >= cutoff, a).otherwise(taken)

    end = _none() if eos is None else F.array(F.lit(eos))
    return F.aggregate(F.reverse(turns) if mask_history else turns, whole, step, lambda a: F.struct(F.concat(a["ids"], end).alias("input_ids"), F.concat(a["labels"], end).alias("labels")))


def _ended(ids: Column, eos: int | None) -> Column:
    return ids if eos is None else F.concat(ids, F.array(F.lit(eos)))


def encode_pairwise(prompt: Column, chosen: Column, rejected: Column, cutoff: int, *, ignore: int = IGNORE, eos: int | None = None) -> Column:
    """Struct (chosen_input_ids, chosen_labels, rejected_input_ids, rejected_labels): the prompt and both answers are
    cut together, by the longer answer."""
    c, r = _ended(chosen, eos), _ended(rejected, eos)
    s, t = truncated_lengths(_size(prompt), F.greatest(_size(c), _size(r)), cutoff)
    p, c, r = _first(prompt, s), _first(c, t), _first(r, t)
    hidden = _repeat(ignore, s)
    return F.struct(F.concat(p, c).alias("chosen_input_ids"), F.concat(hidden, c).alias("chosen_labels"), F.concat(p, r).alias("rejected_input_ids"), F.concat(hidden, r).alias("rejected_labels"))


def encode_feedback(prompt: Column, response: Column, kl_response: Column, tag: Column, cutoff: int, *, ignore: int = IGNORE, eos: int | None = None) -> Column:
    """Struct (input_ids, labels, kl_input_ids, kl_labels, kto_tags): the answer, and the mismatched answer of another
    row to the same prompt, each cut with the prompt by itself."""
    out = []
    for name, answer in (("", response), ("kl_", kl_response)):
        a = _ended(answer, eos)
        s, t = truncated_lengths(_size(prompt), _size(a), cutoff)
        out += [F.concat(_first(prompt, s), _first(a, t)).alias(f"{name}input_ids"), F.concat(_repeat(ignore, s), _first(a, t)).alias(f"{name}labels")]
    return F.struct(*out, tag.alias("kto_tags"))


def mismatched(rows: DataFrame, order: str, value: str, batch: int = 1000, name: str = "kl") -> DataFrame:
    """``rows`` with the ``value`` of the row before in its batch of ``batch`` positions; the first takes the last's."""
    w = Window.partitionBy(F.floor(F.col(order) / batch)).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(name, F.coalesce(F.lag(F.struct(value)).over(w), F.last(F.struct(value)).over(whole))[value])


def encode_unsupervised(prompt: Column, response: Column, cutoff: int, *, eos: int | None = None) -> Column:
    """Struct (input_ids, labels): the cut prompt, and the cut answer for generation to be held against."""
    a = _ended(response, eos)
    s, t = truncated_lengths(_size(prompt), _size(a), cutoff)
    return F.struct(_first(prompt, s).alias("input_ids"), _first(a, t).alias("labels"))


def one_preference(rows: DataFrame, tag: str = "kto_tags") -> DataFrame:
    """One row ``desirable, undesirable, one_kind``: counts of both preferences, and whether one of them is absent."""
    good = F.count_if(F.col(tag))
    bad = F.count_if(~F.col(tag))
    return rows.agg(good.alias("desirable"), bad.alias("undesirable"), ((good == 0) | (bad == 0)).alias("one_kind"))


def packed_examples(rows: DataFrame, order: str, ids: str, labels: str, cutoff: int, pad: int, *, batch: int = 1000, neat: bool = False, ignore: int = IGNORE) -> DataFrame:
    """``batch_no, knapsack, input_ids, attention_mask, position_ids, labels``: the rows of a batch packed by knapsack and
    padded to ``cutoff`` + 1. Longer rows are left out. The mask numbers the examples 1..k with ``neat`` (0 on padding),
    and is 1 throughout without it.
    """
    sized = rows.withColumn("__n", F.size(ids))
    places = knapsack_pack(sized.select(order, "__n"), order, "__n", cutoff, batch)
    packed = rows.select(order, ids, labels).join(places, order)
    g = packed.groupBy("batch_no", "knapsack").agg(F.array_sort(F.collect_list(F.struct("place", F.col(ids).alias("i"), F.col(labels).alias("l")))).alias("x"))
    n = F.aggregate("x", F.lit(0), lambda a, e: a + F.size(e["i"]))
    fill = lambda v: F.array_repeat(F.lit(v), F.lit(cutoff + 1) - F.col("__used"))
    mark = F.flatten(F.transform("x", lambda e: F.transform(e["i"], lambda _: e["place"] + 1 if neat else F.lit(1))))
    place = F.flatten(F.transform("x", lambda e: F.transform(e["i"], lambda _, k: k)))
    g = g.withColumn("__used", n)
    return g.select(
        "batch_no",
        "knapsack",
        F.concat(F.flatten(F.transform("x", lambda e: e["i"])), fill(pad)).alias("input_ids"),
        F.concat(mark, fill(0 if neat else 1)).alias("attention_mask"),
        F.concat(place, fill(0)).alias("position_ids"),
        F.concat(F.flatten(F.transform("x", lambda e: e["l"])), fill(ignore)).alias("labels"),
    )


def collate(rows: DataFrame, batch: str, ids: str, labels: str, pad: int, *, ignore: int = IGNORE, multiple: int = 1) -> DataFrame:
    """``rows`` with ``ids`` and ``labels`` right-padded to the longest of their batch (rounded up to ``multiple``), and
    the ``attention_mask``."""
    longest = F.ceil(F.max(F.size(ids)).over(Window.partitionBy(batch)) / multiple) * multiple
    r = rows.withColumn("__w", (longest - F.size(ids)).cast("int")).withColumn("attention_mask", F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.col("__w"))))
    for c, fill in ((ids, pad), (labels, ignore)):
        r = r.withColumn(c, F.concat(F.col(c), F.array_repeat(F.lit(fill), F.col("__w"))))
    return r.drop("__w")


def collate_pairwise(rows: DataFrame, batch: str, order: str, pad: int, **settings) -> DataFrame:
    """Encoded pairs as one batch of 2n rows: all chosen ones in order, then all rejected ones, padded together;
    ``kind`` and ``place`` tell them apart."""
    parts = [rows.select(batch, order, F.lit(kind).alias("kind"), F.col(f"{kind}_input_ids").alias("input_ids"), F.col(f"{kind}_labels").alias("labels")) for kind in ("chosen", "rejected")]
    both = parts[0].unionByName(parts[1])
    w = Window.partitionBy(batch).orderBy("kind", order)
    return collate(both.withColumn("place", F.row_number().over(w) - 1), batch, "input_ids", "labels", pad, **settings)


def collate_feedback(rows: DataFrame, batch: str, pad: int, **settings) -> DataFrame:
    """Encoded feedback with both id sets padded, each to its own longest: plain and ``kl_`` columns."""
    plain = collate(rows, batch, "input_ids", "labels", pad, **settings).withColumnRenamed("attention_mask", "__mask")
    both = collate(plain, batch, "kl_input_ids", "kl_labels", pad, **settings).withColumnRenamed("attention_mask", "kl_attention_mask")
    return both.withColumnRenamed("__mask", "attention_mask")
