"""Boxes, pixels and frame positions as column expressions. A box is array(x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; a union of nothing counts as 1e-6."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / F.when(union <= 0, 1e-6).otherwise(union)


def best_iou(box: Column, boxes: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(boxes, lambda b: iou(box, b))), F.lit(0.0))


def box_from_points(points: Column) -> Column:
    """Bounding box of an array of (x, y) arrays, rounded half to even."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(*(F.bround(f(v)).cast("int") for f, v in ((F.array_min, xs), (F.array_min, ys), (F.array_max, xs), (F.array_max, ys))))


def to_pixels(box: Column, width: Column, height: Column, scale: float = 1000.0, order: str = "yxyx") -> Column:
    """A box in 0..scale to pixels: clamped, at least one pixel wide and high."""
    x1, y1, x2, y2 = (box[1], box[0], box[3], box[2]) if order == "yxyx" else (box[0], box[1], box[2], box[3])

    def px(v, size):
        return F.greatest(F.least(F.bround(v / scale * size).cast("int"), size.cast("int")), F.lit(0))

    a, b = F.least(px(x1, width), width.cast("int") - 1), F.least(px(y1, height), height.cast("int") - 1)
    return F.array(a, b, F.greatest(px(x2, width), a + 1), F.greatest(px(y2, height), b + 1))


def normal_box(box: Column, width: Column, height: Column, pad: int = 0) -> Column:
    """Corners in order, padded, rounded half to even and clipped; an empty box is an error."""
    x1, x2 = F.least(box[0], box[2]) - pad, F.greatest(box[0], box[2]) + pad
    y1, y2 = F.least(box[1], box[3]) - pad, F.greatest(box[1], box[3]) + pad
    clip = lambda v, hi: F.greatest(F.least(F.bround(v).cast("int"), hi.cast("int")), F.lit(0))
    a, b, c, d = clip(x1, width), clip(y1, height), clip(x2, width), clip(y2, height)
    return F.when((c <= a) | (d <= b), F.raise_error(F.lit("empty box")).cast("array<int>")).otherwise(F.array(a, b, c, d))


def centre_to_corners(box: Column, width: Column, height: Column) -> Column:
    """Normalised (cx, cy, w, h) to pixel corners."""
    return F.array((box[0] - box[2] / 2) * width, (box[1] - box[3] / 2) * height, (box[0] + box[2] / 2) * width, (box[1] + box[3] / 2) * height)


def valid_size(width: Column, height: Column, ratio: float = 200.0) -> Column:
    return (width > 0) & (height > 0) & (F.greatest(width, height) / F.least(width, height) < ratio)


def zoom_box(box: Column, width: Column, height: Column, least: int = 28, ratio: float = 100.0) -> Column:
    """A box clamped to the image and grown to ``least`` pixels a side around its centre, shifted inside; null if
    its corners are out of order, it is empty, or too narrow."""
    x1, y1 = F.greatest(box[0], F.lit(0.0)), F.greatest(box[1], F.lit(0.0))
    x2, y2 = F.least(box[2], width.cast("double")), F.least(box[3], height.cast("double"))
    w, h = x2 - x1, y2 - y1
    ok = (x2 > x1) & (y2 > y1) & (F.greatest(w, h) / F.least(w, h) <= ratio)

    def grow(a, b, size):
        half = F.greatest(b - a, F.lit(float(least))) / 2
        c = (a + b) / 2
        lo = F.greatest(F.least(c - half, size - 2 * half), F.lit(0.0))
        return lo, F.least(lo + 2 * half, size.cast("double"))

    (a, c), (b, d) = grow(x1, x2, width), grow(y1, y2, height)
    return F.when(ok, F.array(F.floor(a), F.floor(b), F.ceil(c), F.ceil(d)))


def best_mask(scores: Column, masks: Column) -> Column:
    """The mask of the highest score, the first of equal ones; null without scores."""
    return F.get(masks, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def distinct_boxes(boxes: Column, places: int = 6) -> Column:
    """Boxes without those that equal an earlier one to so many places, rounded to them, in order."""
    return F.array_distinct(F.transform(boxes, lambda b: F.transform(b, lambda x: F.round(x.cast("double"), places))))


def softmax(logits: Column) -> Column:
    """Probabilities of logits, shifted by their maximum."""
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def resized(width: Column, height: Column, most: int, least: int) -> Column:
    """(width, height) scaled down to at most and up to at least a number of pixels."""

    def scaled(w, h, pixels, apply):
        f = F.sqrt(F.lit(float(pixels)) / (w * h))
        return F.when(apply, F.floor(w * f)).otherwise(w), F.when(apply, F.floor(h * f)).otherwise(h)

    w, h = scaled(width, height, most, width * height > most)
    w, h = scaled(w, h, least, w * h < least)
    return F.array(w.cast("long"), h.cast("long"))


def frame_positions(total: Column, k: Column) -> Column:
    """k whole positions spread evenly over 0..total-1; one position is 0."""
    return F.when(k <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: (i * (total - 1) / (k - 1)).cast("long")))


def choice_letter(logits: Column, letters: str = "ABCD") -> Column:
    return F.substring(F.lit(letters), F.array_position(logits, F.array_max(logits)).cast("int"), F.lit(1))


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / b)


def round_up(a: Column, b: int) -> Column:
    return F.ceil(a / b) * b


def unit_score(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
