"""Dense row positions without sending the whole table through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def dense_index(df: DataFrame, *order: str, name: str = "row", rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``df`` with a 0-based position by ``order`` (a total order; nulls come first).

    A table of over ``rows_per_bucket`` rows is dealt into ranges of the whole order key, so that a first column of few
    values does not make large ranges, and sorted inside them; a row's place in its range and the range's number
    are written with it. A range's offset is the number of rows before it (one row a range). Written once, the ranges
    do not change when a task is computed again. Rows that tie in the whole key share a range.
    """
    n = df.count()
    buckets = -(-n // rows_per_bucket)
    if buckets <= 1:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("long"))
    # an id is the task's number (the range's, as ranges are dealt to tasks in order) above 33 bits of place
    dealt = written(df.sparkSession)(df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return dealt.withColumn("__part", part).join(offsets, "__part").select(*df.columns, (F.col("__before") + place).cast("long").alias(name))


def restored(results: DataFrame, permutation: DataFrame, *, place: str = "place", origin: str = "origin", name: str = "row") -> DataFrame:
    """Results that were worked out in a permuted order, each with its former position.

    ``results`` has one row a ``place`` of the permuted order, ``permutation`` (place, origin) its former position: the
    inverse is a join on the place, so results need not carry anything of their origin. Places without a result give
    no row; a place that the permutation lacks is an error of the caller and gives none either.
    """
    back = permutation.select(F.col(place).alias("__place"), F.col(origin).cast("long").alias(name))
    return results.join(back, F.col(place) == F.col("__place")).drop("__place")
