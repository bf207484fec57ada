"""Seeded permutations of row positions that are computed, not sorted.

A position x of n is a pair (x mod a, x div a) of a grid of a * b >= n places, where a is about the square root of n.
Rounds add to one coordinate a keyed function of the other, which is a bijection of the grid; places beyond n are
walked on until they fall below n, which makes it a bijection of 0..n-1. A row's place in an epoch is then an
expression of its position, the rows of a batch are the inverse of its places, and an epoch can be left and
entered again at any batch.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Two primes below 2**31, so that a product with a 28-bit key stays below 2**59.
P, Q = 2147483647, 2147483629
#: Longest walk. A walk of k steps has odds of about n**(-k/2); small grids have fewer spare places than this.
WALK = 64


def _div(x: Column, d: Column) -> Column:
    return F.call_function("div", x, d)


def keys(*text, rounds: int = ROUNDS) -> list[list[int]]:
    """Four 28-bit keys a round: the first 28 hex digits of the MD5 of ``text|round``."""
    digests = [hashlib.md5("|".join(map(str, (*text, r))).encode()).hexdigest() for r in range(rounds)]
    return [[int(d[7 * k : 7 * k + 7], 16) for k in range(4)] for d in digests]


def key_columns(*text: Column, rounds: int = ROUNDS) -> Column:
    """:func:`keys` as an array of arrays, for keys that differ by row; the text is columns of strings."""
    digests = F.transform(F.array(*(F.lit(str(r)) for r in range(rounds))), lambda r: F.md5(F.concat_ws("|", *text, r)))
    return F.transform(digests, lambda d: F.array(*(F.conv(F.substring(d, 7 * k + 1, 7), 16, 10).cast("long") for k in range(4))))


def _keyed(v, k):
    return ((v * k[0] + k[1]) % P * k[2] + k[3]) % Q


def grid(n):
    """Width and height of the grid for n places (a number or a column)."""
    if isinstance(n, Column):
        a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
        return a, F.greatest(_div(n + a - 1, a), F.lit(1))
    a = max(1, math.ceil(math.sqrt(n)))
    return a, max(1, -(-n // a))


def _turn(r: int, left, right, a, b, k, inverse: bool):
    """One round: the coordinate that changes, and its new value."""
    if r % 2 == 0:
        f = _keyed(right, k) % a
        return "left", (left - f + a) % a if inverse else (left + f) % a
    f = _keyed(left, k) % b
    return "right", (right - f + b) % b if inverse else (right + f) % b


def permuted(x: int, n: int, k: list[list[int]], inverse: bool = False) -> int:
    """Place of position ``x`` among n under the keys ``k``, or with ``inverse`` the position at place ``x``."""
    a, b = grid(n)
    while True:
        at = {"left": x % a, "right": x // a}
        for r in range(ROUNDS)[:: -1 if inverse else 1]:
            side, value = _turn(r, at["left"], at["right"], a, b, k[r], inverse)
            at[side] = value
        x = at["left"] + at["right"] * a
        if x < n:
            return x


def placed(rows: DataFrame, name: str, x: Column, n: Column | int, k: Column, inverse: bool = False) -> DataFrame:
    """``rows`` with :func:`permuted` of column ``x`` as ``name``; ``n`` (up to 2**52) and the keys may differ by row.

    A round is a projection of its own, so that it is computed once and the plan grows with the rounds only; the few
    rows whose place is beyond n walk on inside an aggregate expression."""
    n = (n if isinstance(n, Column) else F.lit(n)).cast("long")
    t = rows.withColumn("__n", n).withColumn("__k", k)
    a, b = F.col("__a"), F.col("__b")
    t = t.withColumn("__a", grid(F.col("__n"))[0]).withColumn("__b", grid(F.col("__n"))[1]).withColumn("__from", x.cast("long"))
    t = t.withColumn("__left", F.col("__from") % a).withColumn("__right", _div(F.col("__from"), a))
    order = list(range(ROUNDS)[:: -1 if inverse else 1])
    for r in order:
        side, value = _turn(r, F.col("__left"), F.col("__right"), a, b, F.col("__k")[r], inverse)
        t = t.withColumn(f"__{side}", value)
    t = t.withColumn("__x", F.col("__left") + F.col("__right") * a)

    def again(z: Column) -> Column:
        def turn(at: Column, r: Column) -> Column:
            key = F.col("__k")[r]
            new = {s: _turn(i, at["left"], at["right"], a, b, key, inverse)[1] for i, s in ((0, "left"), (1, "right"))}
            return F.struct(*(F.when(r % 2 == i, new[s]).otherwise(at[s]).alias(s) for i, s in ((0, "left"), (1, "right"))))

        start = F.struct((z % a).alias("left"), _div(z, a).alias("right"))
        return F.aggregate(F.array(*map(F.lit, order)), start, turn, lambda at: at["left"] + at["right"] * a)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("__x"), lambda z, _: F.when(z < F.col("__n"), z).otherwise(again(z)))
    t = t.withColumn("__x", F.when(F.col("__x") < F.col("__n"), F.col("__x")).otherwise(walk))
    wrong = lambda text: F.raise_error(F.lit(text)).cast("long")
    place = F.when(~F.coalesce((F.col("__from") >= 0) & (F.col("__from") < F.col("__n")), F.lit(False)), wrong("a position to permute is not below the number of rows"))
    place = place.when(F.col("__x") < F.col("__n"), F.col("__x")).otherwise(wrong("a walk of a permutation did not end"))
    # the id is never taken: as it is not deterministic, filters and joins on the place are computed after the rounds,
    # and not from a copy of all their expressions below them
    return t.withColumn(name, F.coalesce(place, F.monotonically_increasing_id())).drop("__n", "__k", "__a", "__b", "__x", "__from", "__left", "__right")


def key_literal(k: list[list[int]]) -> Column:
    return F.array(*(F.array(*(F.lit(v).cast("long") for v in r)) for r in k))


def epoch_batches(rows: DataFrame, row: str, n: int, size: int, epochs: int = 1, seed: int = 0, *, first_epoch: int = 0, first_batch: int = 0, drop_last: bool = False) -> DataFrame:
    """Every row once an epoch with its ``epoch``, its ``place`` in it and the ``batch`` of that place.

    ``row`` is a dense position 0..n-1. The run resumes at batch ``first_batch`` of epoch ``first_epoch``: what comes
    back is the tail of the whole run, and no earlier batch is computed beyond its places. The last batch of an
    epoch may be short; ``drop_last`` leaves it out. No row is sorted, numbered or shuffled.
    """
    runs = [F.struct(F.lit(e).alias("epoch"), key_literal(keys(seed, e)).alias("keys")) for e in range(first_epoch, epochs)]
    e = rows.withColumn("__e", F.explode(F.array(*runs) if runs else F.lit(None).cast("array<struct<epoch:int,keys:array<array<bigint>>>>")))
    e = placed(e.withColumn("epoch", F.col("__e.epoch")), "place", F.col(row), n, F.col("__e.keys")).drop("__e")
    e = e.withColumn("batch", _div(F.col("place"), F.lit(size).cast("long")))
    if first_batch:
        e = e.where((F.col("epoch") > first_epoch) | (F.col("batch") >= first_batch))
    return e.where(F.col("batch") < n // size) if drop_last else e


def one_batch(rows: DataFrame, row: str, n: int, size: int, epoch: int, batch: int, seed: int = 0) -> DataFrame:
    """The rows of one batch with their ``place``: the inverse of its places, joined to the rows. Only the batch's
    positions are made, whatever n is."""
    last = max(batch * size, min(n, (batch + 1) * size))
    places = placed(rows.sparkSession.range(batch * size, last), "__row", F.col("id"), n, key_literal(keys(seed, epoch)), inverse=True).select("__row", F.col("id").alias("place"))
    return rows.join(places, F.col(row) == F.col("__row")).drop("__row")


def position(step: int, n: int, size: int, drop_last: bool = False) -> tuple[int, int]:
    """(epoch, batch) of a run's global step, from which :func:`epoch_batches` resumes."""
    per = n // size if drop_last else -(-n // size)
    if per == 0:
        raise ValueError(f"{n} rows make no batch of {size}")
    return divmod(step, per)


def drawn(rows: DataFrame, name: str, draw: Column, n: Column, *key: Column) -> DataFrame:
    """Adds as ``name`` the ``draw``-th of a seeded permutation of 0..n-1 of the row's own key (columns of strings):
    draws 0, 1, ... are different positions, and every subset can occur."""
    return placed(rows, name, draw, n, key_columns(*key))
