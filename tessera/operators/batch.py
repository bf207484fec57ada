"""Columnar batch algebra: tables with a dense row position and a driver-side dictionary of metadata.

Every operation keeps ``row`` (0-based, dense) as the order of the batch. Row counts that an operation needs
are taken once and remembered.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import dense_index

ROW = "row"


@dataclass
class Batch:
    df: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)
    rows: int | None = None

    @classmethod
    def of(cls, df: DataFrame, *order: str, meta: dict | None = None) -> Batch:
        return cls(dense_index(df, *order, name=ROW), dict(meta or {}))

    def __len__(self) -> int:
        if self.rows is None:
            self.rows = self.df.count()
        return self.rows

    def _with(self, df: DataFrame, rows: int | None = None, **meta) -> Batch:
        return Batch(df, {**self.meta, **meta}, rows)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    # projections
    def select(self, columns: list[str] | None = None, meta: list[str] | None = None) -> Batch:
        kept = {k: v for k, v in self.meta.items() if meta is None or k in meta}
        return Batch(self.df.select(ROW, *(self.columns if columns is None else columns)), kept, self.rows)

    def pop(self, columns: list[str], meta: list[str] | None = None) -> tuple[Batch, Batch]:
        """(the popped columns, what is left); an absent column is an error."""
        absent = [c for c in columns if c not in self.columns] + [k for k in meta or [] if k not in self.meta]
        if absent:
            raise KeyError(f"not in the batch: {absent}")
        rest = {k: v for k, v in self.meta.items() if k not in (meta or [])}
        return self.select(columns, meta or []), Batch(self.df.drop(*columns), rest, self.rows)

    def rename(self, old: list[str], new: list[str]) -> Batch:
        if len(old) != len(new):
            raise ValueError(f"{len(old)} names cannot become {len(new)}")
        return self._with(self.df.withColumnsRenamed(dict(zip(old, new, strict=True))), self.rows)

    # row selection
    def where_mask(self, mask: Column) -> Batch:
        """Rows where the mask holds, renumbered in order."""
        return self._with(dense_index(self.df.where(mask).withColumnRenamed(ROW, "__old"), "__old", name=ROW).drop("__old"))

    def take(self, positions: list[int]) -> Batch:
        """Gather with duplicates, in the given order; negative positions count from the end."""
        n = len(self)
        at = [(i, p + n if p < 0 else p) for i, p in enumerate(positions)]
        if any(not 0 <= p < n for _, p in at):
            raise IndexError("position outside the batch")
        table = self.df.sparkSession.createDataFrame(at, "__new long, __at long")
        return self._with(table.join(self.df, F.col("__at") == F.col(ROW)).drop(ROW, "__at").withColumnRenamed("__new", ROW), len(at))

    reorder = take

    def slice(self, start: int | None = None, end: int | None = None, step: int | None = None) -> Batch:
        s, e, st = slice(start, end, step).indices(len(self))
        if st > 0:
            keep = (F.col(ROW) >= s) & (F.col(ROW) < e) & ((F.col(ROW) - s) % st == 0)
        else:
            keep = (F.col(ROW) <= s) & (F.col(ROW) > e) & ((F.lit(s) - F.col(ROW)) % -st == 0)
        return self._with(self.df.where(keep).withColumn(ROW, ((F.col(ROW) - s) / st).cast("long")), len(range(s, e, st)))

    # replication
    def repeat(self, times: int, interleave: bool = True) -> Batch:
        n = len(self)
        k = self.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else self.df.limit(0).withColumn("__k", F.lit(0))
        place = F.col(ROW) * times + F.col("__k") if interleave else F.col("__k") * n + F.col(ROW)
        return self._with(k.withColumn(ROW, place.cast("long")).drop("__k"), n * times)

    def repeat_each(self, counts: Column) -> Batch:
        """Row replication by a count per row; zero drops the row."""
        c = self.df.withColumn("__c", counts.cast("int")).where("__c > 0")
        c = c.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__c") - 1))).withColumnRenamed(ROW, "__old")
        return self._with(dense_index(c, "__old", "__k", name=ROW).drop("__old", "__k", "__c"))

    def unfold_chunks(self, n: int, columns: list[str]) -> Batch:
        """Cut array columns into n equal chunks, one row each; other columns are repeated."""
        k = self.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        for c in columns:
            width = (F.size(c) / n).cast("int")
            k = k.withColumn(c, F.slice(c, F.col("__k") * width + 1, width))
        return self._with(k.withColumn(ROW, (F.col(ROW) * n + F.col("__k")).cast("long")).drop("__k"))

    def fold(self, size: int) -> Batch:
        """Groups of ``size`` rows as arrays in row order."""
        g = self.df.groupBy(F.floor(F.col(ROW) / size).alias("__g")).agg(F.array_sort(F.collect_list(F.struct(ROW, *self.columns))).alias("__s"))
        return self._with(g.select(F.col("__g").cast("long").alias(ROW), *(F.col(f"__s.{c}").alias(c) for c in self.columns)))

    def unfold(self, size: int) -> Batch:
        z = self.df.select(ROW, F.posexplode(F.arrays_zip(*self.columns)))
        return self._with(z.select((F.col(ROW) * size + F.col("pos")).cast("long").alias(ROW), *(F.col(f"col.{c}").alias(c) for c in self.columns)))

    # partitions
    def chunk_of(self, k: int, auto_pad: bool = False) -> Column:
        """The chunk number of each row for k chunks of ceil size; uneven only with ``auto_pad``."""
        n = len(self)
        if n % k and not auto_pad:
            raise ValueError(f"{n} rows do not make {k} equal chunks")
        return F.floor(F.col(ROW) / max(1, -(-n // k))).cast("long")

    def chunks(self, k: int, auto_pad: bool = False) -> list[Batch]:
        b = self.pad_to_divisor(k)[0] if auto_pad else self
        of = b.chunk_of(k)
        size = len(b) // k
        return [b._with(b.df.where(of == i).withColumn(ROW, F.col(ROW) - i * size), size) for i in range(k)]

    def split_of(self, size: int) -> Column:
        return F.floor(F.col(ROW) / size).cast("long")

    def pad_to_divisor(self, d: int) -> tuple[Batch, int]:
        """Rows from the start, in cycles, until the count divides; (padded batch, pad size)."""
        n = len(self)
        pad = -n % d if n else 0
        if not pad:
            return self, 0
        times = self.df.withColumn("__i", F.explode(F.sequence(F.col(ROW), F.lit(pad - 1).cast("long"), F.lit(n).cast("long")))) if pad > n else self.df.where(F.col(ROW) < pad).withColumn("__i", F.col(ROW))
        if pad > n:
            times = times.where("__i < " + str(pad))
        more = times.withColumn(ROW, F.col("__i") + n).drop("__i")
        return self._with(self.df.unionByName(more), n + pad, pad_size=pad), pad

    def unpad(self, pad: int) -> Batch:
        n = len(self) - pad
        return self._with(self.df.where(F.col(ROW) < n), n)

    def padding(self, size: int, which: str = "") -> Batch:
        """``size`` further copies of the first row ("first") or of the last."""
        n = len(self)
        at = 0 if which == "first" else n - 1
        more = self.df.where(F.col(ROW) == at).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))) if size > 0 else self.df.limit(0).withColumn("__k", F.lit(0))
        return self._with(self.df.unionByName(more.withColumn(ROW, (F.col("__k") + n).cast("long")).drop("__k")), n + size)

    def mini_batches(self, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
        """Every row with its ``epoch`` and ``batch``; in the order of a keyed permutation of the rows per epoch when a
        seed is given (nothing is sorted)."""
        n = len(self)
        if n % size:
            raise ValueError(f"{n} rows do not make batches of {size}")
        if seed is None:
            e = self.df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
            return e.withColumn("batch", F.floor(F.col(ROW) / size).cast("long"))
        from .permute import epoch_batches

        return epoch_batches(self.df, ROW, n, size, epochs, seed).drop("place")

    # combination
    def union(self, other: Batch) -> Batch:
        """Positional zip of columns; columns in both must be equal (null and NaN equal themselves)."""
        if len(self) != len(other):
            raise ValueError("batches differ in their number of rows")
        for k in self.meta.keys() & other.meta.keys():
            if self.meta[k] != other.meta[k]:
                raise ValueError(f"metadata {k!r} differs")
        both = [c for c in other.columns if c in self.columns]
        right = other.df.select(F.col(ROW).alias("__r"), *(F.col(c).alias(f"__{c}" if c in both else c) for c in other.columns))
        out = self.df.join(right, F.col(ROW) == F.col("__r"))
        same = F.lit(True)
        for c in both:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        if both and not out.where(~same).isEmpty():
            raise ValueError(f"columns {both} differ between the batches")
        return Batch(out.drop("__r", *(f"__{c}" for c in both)), {**self.meta, **other.meta}, self.rows)

    @staticmethod
    def concat(parts: list[Batch]) -> Batch:
        """Rows of all parts one after the other; column sets must match, the first part's metadata is kept."""
        if any(set(p.columns) != set(parts[0].columns) for p in parts):
            raise ValueError("batches differ in their columns")
        out, at = None, 0
        for p in parts:
            moved = p.df.withColumn(ROW, F.col(ROW) + at)
            out = moved if out is None else out.unionByName(moved)
            at += len(p)
        return Batch(out, dict(parts[0].meta), at)
