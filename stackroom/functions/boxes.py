"""Boxes [x, y, w, h] on a page, as struct columns or arrays of four doubles; and the grouped
functions over all boxes of a page, whose results depend on their order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_AREA, MAX_AREA, GAP, SAME_IOU, NESTED = 0.01, 0.95, 0.02, 0.8, 0.9
CAPTION_DISTANCE, CAPTION_OVERLAP, MARGIN = 0.15, 0.3, 0.15


def _c(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(_c(a, 0) + _c(a, 2), _c(b, 0) + _c(b, 2)) - F.greatest(_c(a, 0), _c(b, 0))
    h = F.least(_c(a, 1) + _c(a, 3), _c(b, 1) + _c(b, 3)) - F.greatest(_c(a, 1), _c(b, 1))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: Column) -> Column:
    return _c(a, 2) * _c(a, 3)


def iou(a: Column, b: Column) -> Column:
    both = area(a) + area(b) - intersection(a, b)
    return F.when(both > 0, intersection(a, b) / both).otherwise(F.lit(0.0))


def share_inside(inner: Column, outer: Column) -> Column:
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(F.lit(0.0))


def union_box(a: Column, b: Column) -> Column:
    x, y = F.least(_c(a, 0), _c(b, 0)), F.least(_c(a, 1), _c(b, 1))
    return F.array(x, y, F.greatest(_c(a, 0) + _c(a, 2), _c(b, 0) + _c(b, 2)) - x, F.greatest(_c(a, 1) + _c(a, 3), _c(b, 1) + _c(b, 3)) - y)


def near(a: Column, b: Column, gap: float = GAP) -> Column:
    return (
        (_c(a, 0) <= _c(b, 0) + _c(b, 2) + gap)
        & (_c(b, 0) <= _c(a, 0) + _c(a, 2) + gap)
        & (_c(a, 1) <= _c(b, 1) + _c(b, 3) + gap)
        & (_c(b, 1) <= _c(a, 1) + _c(a, 3) + gap)
    )


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width over the narrower width."""
    width = F.least(_c(a, 0) + _c(a, 2), _c(b, 0) + _c(b, 2)) - F.greatest(_c(a, 0), _c(b, 0))
    least = F.least(_c(a, 2), _c(b, 2))
    return F.when(least > 0, F.greatest(width, F.lit(0.0)) / least).otherwise(F.lit(0.0))


def caption_parts(text: Column) -> Column:
    """struct<kind, label> of a caption block ('Figure 3. ...'), or null."""
    kind = F.regexp_extract(text, r"(?i)^\s*(fig(?:ure)?|table)\.?\s*([A-Z]?\d+)\s*[.:]", 1)
    return F.when(kind != "", F.struct(F.when(F.lower(kind) == "table", "table").otherwise("figure").alias("kind"), F.regexp_extract(text, r"(?i)^\s*(?:fig(?:ure)?|table)\.?\s*([A-Z]?\d+)", 1).alias("label")))


def _overlap(a, b):
    return max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def merge_boxes(boxes: list[list[float]], min_area=MIN_AREA, max_area=MAX_AREA, gap=GAP, same=SAME_IOU) -> list[list[float]]:
    """Drops boxes that are too small or large, or lie in or on a larger one; joins near ones until
    none are left."""
    boxes = sorted((b for b in boxes if min_area <= b[2] * b[3] <= max_area), key=lambda b: (-b[2] * b[3], b))
    kept: list[list[float]] = []
    for b in boxes:
        both = [_overlap(b, k) for k in kept]
        if not any(o >= NESTED * b[2] * b[3] or o >= same * (b[2] * b[3] + k[2] * k[3] - o) for o, k in zip(both, kept, strict=True)):
            kept.append(list(b))
    merged = True
    while merged:
        merged = False
        for i in range(len(kept)):
            for j in range(i + 1, len(kept)):
                a, b = kept[i], kept[j]
                if all(a[k] <= b[k] + b[k + 2] + gap and b[k] <= a[k] + a[k + 2] + gap for k in (0, 1)):
                    x, y = min(a[0], b[0]), min(a[1], b[1])
                    kept[i] = [x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y]
                    del kept[j]
                    merged = True
                    break
            if merged:
                break
    return sorted(kept, key=lambda b: (b[1], b[0]))


def merge_regions(boxes: DataFrame, page_cols: list[str]) -> DataFrame:
    """boxes: page columns and x, y, w, h. One row per merged region."""
    schema = ", ".join(f"{c} {dict(boxes.dtypes)[c]}" for c in page_cols) + ", x double, y double, w double, h double"

    def page(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(merge_boxes(rows[["x", "y", "w", "h"]].values.tolist()), columns=["x", "y", "w", "h"])
        for c, v in zip(page_cols, key, strict=True):
            out.insert(page_cols.index(c), c, v)
        return out

    return boxes.groupBy(*page_cols).applyInPandas(page, schema)


def match_captions(regions: list[list[float]], captions: list[list[float]]) -> list[tuple[int, int, float, str]]:
    """Greedy pairs (region, caption, score, confidence): nearness counts .5, shared width .3, a caption
    below its region .2. Confidence is low where the next choice scores within MARGIN."""
    scored = []
    for r, a in enumerate(regions):
        for c, b in enumerate(captions):
            below, above = b[1] - (a[1] + a[3]), a[1] - (b[1] + b[3])
            distance = max(0.0, below, above)
            least = min(a[2], b[2])
            shared = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) / least if least > 0 else 0.0
            if distance <= CAPTION_DISTANCE and shared >= CAPTION_OVERLAP:
                scored.append((0.5 * (1 - distance / CAPTION_DISTANCE) + 0.3 * shared + 0.2 * (below >= -1e-9), r, c))
    scored.sort(key=lambda s: (-s[0], s[1], s[2]))
    regions_left, captions_left, out = {r for _, r, _ in scored}, {c for _, _, c in scored}, []
    for score, r, c in scored:
        if r in regions_left and c in captions_left:
            rival = max((s for s, r2, c2 in scored if (r2 == r) != (c2 == c) and r2 in regions_left and c2 in captions_left), default=0.0)
            out.append((r, c, score, "high" if score - rival >= MARGIN else "low"))
            regions_left.discard(r)
            captions_left.discard(c)
    return out
