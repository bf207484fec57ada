"""OCR record shaping: items, reading order, lines and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def items(texts: Column, scores: Column, boxes: Column) -> Column:
    """Array of (text, score, box) of the shortest of texts and boxes; scores count as 1.0 unless there is one for
    every text; items without text or box are dropped; sorted by (y1, x1, y2, x2)."""
    n = F.least(F.size(texts), F.size(boxes))
    has = F.coalesce(F.size(scores) == F.size(texts), F.lit(False))
    raw = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.struct(texts[i].alias("text"), F.when(has, F.get(scores, i)).otherwise(1.0).alias("score"), boxes[i].alias("box")))
    good = F.filter(raw, lambda r: (F.coalesce(r["text"], F.lit("")) != "") & r["box"].isNotNull())
    keyed = F.array_sort(F.transform(good, lambda r: F.struct(r["box"][1].alias("a"), r["box"][0].alias("b"), r["box"][3].alias("c"), r["box"][2].alias("d"), r["text"].alias("text"), r["score"].alias("score"), r["box"].alias("box"))))
    return F.transform(keyed, lambda r: F.struct(r["text"].alias("text"), r["score"].alias("score"), r["box"].alias("box")))


def group_lines(rows: list[tuple[str, list[int]]], threshold: float) -> list[str]:
    """Texts by line: an item joins the first line whose centre is within threshold times the larger height of
    its own; a line's extent grows with its items. Lines go from top, items from left."""
    lines: list[dict] = []
    for text, (x1, y1, x2, y2) in rows:
        h, centre = max(1, y2 - y1), (y1 + y2) / 2
        for line in lines:
            if abs(centre - (line["top"] + line["bottom"]) / 2) <= max(h, max(1, line["bottom"] - line["top"])) * threshold:
                line["items"].append((x1, y1, text))
                line["top"], line["bottom"] = min(line["top"], y1), max(line["bottom"], y2)
                break
        else:
            lines.append({"top": y1, "bottom": y2, "items": [(x1, y1, text)]})
    lines.sort(key=lambda line: line["top"])
    out = [" ".join(t for _, _, t in sorted(line["items"], key=lambda i: i[:2])).strip() for line in lines]
    return [x for x in out if x]


def lines(items_: Column, threshold: float = 0.6) -> Column:
    """Array of line texts of an item array."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda rows: [] if rows is None else group_lines([(r["text"], list(r["box"])) for r in rows], threshold))

    return run(items_)


def page_text(line_texts: Column, most: int = 8000, fallback: str = "") -> Column:
    """Lines joined by line feeds, cut to ``most`` characters; the fallback if nothing is there."""
    t = F.left(F.array_join(line_texts, "\n"), F.lit(most))
    return F.when(t == "", F.lit(fallback)).otherwise(t)


def document_text(pages: Column, most: int = 8000) -> Column:
    return F.left(F.array_join(F.filter(pages, lambda p: p != ""), "\n\n"), F.lit(most))
