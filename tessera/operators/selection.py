"""The k smallest or largest rows of a table where k grows with the table.

A top-k operator keeps k rows in every task and merges them in one. Here the cut is found instead: a bracket around
the k-th value is narrowed by counts (each pass counts below, inside and in two parts of the bracket) until few rows
or one value are left, and the rows are taken by a filter. Nothing is sorted but what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import dense_index

#: Rows that may be sorted to find the last ones, and the accuracy of the sketch that proposes a bracket.
SMALL, ACCURACY = 50_000, 10_000


def _numeric(c: Column) -> Column:
    """The value as a double that orders like it (integers beyond 2**53 by their rounded value, ties are resolved
    later); null and NaN come last."""
    d = c.cast("double")
    return F.coalesce(F.when(F.isnan(d), F.lit(float("inf"))).otherwise(d), F.lit(float("inf")))


def bracket(values: DataFrame, rank: int, small: int = SMALL) -> tuple[float, float, int, int]:
    """(low, high, below, inside) for the column ``v`` of doubles: the value of ``rank`` (0-based) lies in [low, high],
    ``below`` rows are less than low, and ``inside`` of them are at most ``small`` unless low = high.

    A sketch over what the bracket holds proposes two values close to the rank; one pass counts, and the bracket
    becomes the piece that holds the rank, whether the sketch was right or not. Where a sketch does not narrow it, the
    middle does."""
    low, high, inside = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    below, last = 0, None
    if rank >= inside:
        return low, high, 0, inside
    while low < high and inside > small:
        at = (rank - below) / inside
        held = values.where((F.col("v") >= low) & (F.col("v") <= high))
        if last != inside:
            slack = 2 / ACCURACY
            near = held.agg(F.percentile_approx("v", [max(0.0, at - slack), min(1.0, at + slack)], ACCURACY)).first()[0]
        else:  # infinities are cut off first
            near = [low, high] if float("inf") in (-low, high) else [low / 2 + high / 2]
        last = inside
        a, b = max(low, min(near)), min(high, max(near))
        # pieces: [low, a), [a, a], (a, b), [b, b], (b, high]
        v = F.col("v")
        piece = F.when(v < a, 0).when(v == a, 1).when(v < b, 2).when(v == b, 3).otherwise(4)
        found = {r.piece: r for r in held.groupBy(piece.alias("piece")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()}
        for k in range(5):
            if k in found:
                r = found[k]
                if rank < below + r.n:
                    low, high, inside = r.lo, r.hi, r.n
                    break
                below += r.n
    return low, high, below, inside


def among_smallest(rows: DataFrame, name: str, k: int, value: Column, *order: str, largest: bool = False, small: int = SMALL) -> DataFrame:
    """``rows`` with the boolean ``name``: whether a row is one of the ``k`` of smallest numeric ``value`` (of largest
    with ``largest``), ties by the columns ``order``, upwards. Null and NaN values come last either way. Exactly ``k``
    rows are marked (all, if there are fewer): rows that tie in ``order`` too are told apart by a hash of their columns,
    and should be told apart by ``order`` where equal rows occur.

    Two or three passes over the value, and one over the rows; at most about ``small`` rows are sorted at once, unless
    more of them share the very value of the cut: these are numbered by ranges of ``order``."""
    if k <= 0:
        return rows.withColumn(name, F.lit(False))
    v = _numeric(-value.cast("double") if largest else value)
    low, high, below, inside = bracket(rows.select(v.alias("v")), k - 1, small)
    if k >= below + inside:
        return rows.withColumn(name, v <= high if inside else F.lit(True))
    exact = v
    if rows.select(value.alias("v")).dtypes[0][1] == "bigint":  # compared as such: doubles round them
        exact = F.coalesce((-value.cast("decimal(38,0)") if largest else value.cast("decimal(38,0)")), F.lit("1" + "0" * 37).cast("decimal(38,0)"))
    parts = {"__v": exact, **{f"__o{i}": F.col(c) for i, c in enumerate(order)}, "__h": F.xxhash64(*(c for c, t in rows.dtypes if "map<" not in t))}
    own = F.struct(*(c.alias(n) for n, c in parts.items()))
    edge = rows.where((v >= low) & (v <= high)).select(own.alias("cut"))
    if inside <= small:
        last = edge.orderBy("cut").limit(k - below).agg(F.max("cut").alias("cut"))
    else:
        last = dense_index(edge.select("cut.*"), *parts, name="__at").where(F.col("__at") == k - below - 1).select(F.struct(*parts).alias("cut"))
    cut = rows.sparkSession.createDataFrame(last.collect(), last.schema)  # one row
    return rows.crossJoin(F.broadcast(cut.withColumnRenamed("cut", "__cut"))).withColumn(name, (v < low) | ((v <= high) & (own <= F.col("__cut")))).drop("__cut")


def smallest(rows: DataFrame, k: int, value: Column, *order: str, largest: bool = False, small: int = SMALL) -> DataFrame:
    """The rows that :func:`among_smallest` marks."""
    return among_smallest(rows, "__taken", k, value, *order, largest=largest, small=small).where("__taken").drop("__taken")


def hex_value(digest: Column) -> Column:
    """The first 60 bits of a digest in hexadecimal: a number that orders like the text."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def percentile(rows: DataFrame, value: str, share: float, small: int = SMALL) -> tuple[float | None, int]:
    """The exact percentile of ``value`` at ``share``, interpolated between the two values around its rank as the
    ``percentile`` function does, and the number of values; nulls are left out."""
    values = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = values.count()
    if not n:
        return None, 0
    at = (n - 1) * share
    lower, upper = int(at), min(n - 1, int(at) + 1)

    def nth(rank: int) -> float:
        low, high, below, inside = bracket(values, rank, small)
        if low == high:
            return low
        return values.where((F.col("v") >= low) & (F.col("v") <= high)).orderBy("v").offset(rank - below).limit(1).first()[0]

    a = nth(lower)
    b = nth(upper) if upper != lower and at > lower else a
    return (a if a == b else (upper - at) * a + (at - lower) * b), n
