"""Tool-use reward: expected transforms, overlap, penalties and group necessity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import best_iou

CORE = ("rotate_90", "rotate_180", "rotate_270", "flip_horizontal", "flip_vertical", "crop")


def expected_transforms(required: Column) -> Column:
    """Inverse of the required transforms: rotations turn back (only quarter turns stay), others are themselves."""

    def one(r):
        back = ((360 - F.regexp_extract(r, r"^rotate_(\d+)$", 1).try_cast("int")) % 360).cast("string")
        return F.when(r.rlike(r"^rotate_\d+$"), F.when(back.isin("90", "180", "270"), F.concat(F.lit("rotate_"), back))).otherwise(r)

    return F.array_distinct(F.filter(F.transform(F.coalesce(required, F.array().cast("array<string>")), one), lambda x: x.isNotNull()))


def mandatory(expected: Column, used: Column, truth: Column, boxes: Column) -> Column:
    """Share of expected transforms used (crop aside) plus the best overlap of a crop over their number, at most 1."""
    n = F.size(expected)
    plain = F.size(F.array_except(F.array_intersect(expected, used), F.array(F.lit("crop"))))
    crop = F.when(F.array_contains(expected, "crop") & truth.isNotNull(), best_iou(truth, boxes)).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.least((plain + crop) / n, F.lit(1.0)))


def usage_penalty(count: Column, expected: Column) -> Column:
    t = F.greatest(F.lit(2), F.size(expected))
    return F.when(count >= t, count - t).otherwise(0).cast("double")


def spurious(expected: Column, used: Column, allowed: tuple[str, ...] = ()) -> Column:
    extra = F.array_except(F.array_except(used, expected), F.array(*map(F.lit, allowed))) if allowed else F.array_except(used, expected)
    return F.size(extra).cast("double")


def exact(expected: Column, used: Column, core: tuple[str, ...] = CORE, bonus: float = 0.1) -> Column:
    mine = F.array_intersect(used, F.array(*map(F.lit, core)))
    return F.when((F.size(expected) > 0) & (F.array_sort(mine) == F.array_sort(expected)), bonus).otherwise(0.0)


def emerging(correct: Column, used: Column, weight: float, core: tuple[str, ...] = CORE) -> Column:
    return F.when(correct & (F.size(F.array_except(used, F.array(*map(F.lit, core)))) > 0), weight).otherwise(0.0)


def tool_reward(rows: DataFrame, *, uid: str = "uid", correct: str = "correct", used_any: str = "used_any", used: str = "used", required: str = "required", truth: str = "truth_box", boxes: str = "boxes", count: str = "code_count", fmt: str = "format_reward", alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.1, fmt_weight: float = 0.1, emerge_weight: float = 0.05, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Adds the reward's parts and ``r_total``. Group statistics are windows over ``uid``: necessity is the gain
    in accuracy with tools over without, paid to correct rows that used tools while fewer than two rows of the
    group were correct without."""
    w = Window.partitionBy(uid)
    c, u = F.col(correct), F.col(used_any)
    with_, without = F.count_if(u).over(w), F.count_if(~u).over(w)
    right, plain = F.count_if(u & c).over(w), F.count_if(~u & c).over(w)
    gain = F.when(without > 0, F.greatest(F.coalesce(F.try_divide(right, with_), F.lit(0.0)) - F.coalesce(F.try_divide(plain, without), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    t = rows.withColumns({"expected": expected_transforms(F.col(required)), "__gain": gain, "__plain": plain})
    e = F.col("expected")
    t = t.withColumns({"r_mandatory": mandatory(e, F.col(used), F.col(truth), F.col(boxes)), "c_usage": usage_penalty(F.col(count), e), "r_spurious": spurious(e, F.col(used), allowed), "r_exact": exact(e, F.col(used)), "r_emerge": emerging(c, F.col(used), emerge_weight)})
    gate = F.array_contains(e, "crop") & (F.col("r_mandatory") < 0.1)
    t = t.withColumns({"r_acc": F.when(c, 1.0).otherwise(0.0) * F.when(gate, F.col("r_mandatory")).otherwise(1.0), "r_necessity": F.when(~gate & c & u & (F.col("__plain") < 2), F.col("__gain")).otherwise(0.0)})
    total = F.col("r_acc") + fmt_weight * F.col(fmt) + alpha * F.col("r_mandatory") + beta * F.col("r_necessity") + F.col("r_exact") + F.col("r_emerge") - gamma * (F.col("c_usage") + F.col("r_spurious"))
    return t.withColumn("r_total", total).drop("__gain", "__plain")
