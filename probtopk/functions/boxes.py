"""Arithmetic of bounding boxes as column expressions.

A box is four columns: corners x1, y1, x2, y2, or centre and size cx, cy, w, h.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]
#: Keep divisors off 0, as the two definitions of overlap have them.
TINY, EPS = 1e-16, 1e-9


def columns(prefix: str = "", names: Sequence[str] = ("x1", "y1", "x2", "y2")) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def xywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def _shared(a: Box, b: Box, pixel: float) -> tuple[Column, Column]:
    """Width and height of the overlap, 0 where boxes are apart; pixel is the size of an inclusive edge."""
    zero = F.lit(0.0)
    return (
        F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + pixel, zero),
        F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + pixel, zero),
    )


def iou(a: Box, b: Box, corners: bool = True) -> Column:
    """Overlap of boxes whose corners are pixels, so that sides count one more."""
    if not corners:
        a, b = xywh_to_xyxy(*a), xywh_to_xyxy(*b)
    w, h = _shared(a, b, 1.0)
    area = lambda c: (c[2] - c[0] + 1.0) * (c[3] - c[1] + 1.0)
    return w * h / (area(a) + area(b) - w * h + TINY)


def iou_variant(a: Box, b: Box, kind: str = "iou", corners: bool = True) -> Column:
    """Continuous overlap: iou, or giou, diou, ciou, which also tell boxes that are apart from each other."""
    if not corners:
        a, b = xywh_to_xyxy(*a), xywh_to_xyxy(*b)
    w, h = _shared(a, b, 0.0)
    inter = w * h
    w_a, h_a, w_b, h_b = a[2] - a[0], a[3] - a[1] + EPS, b[2] - b[0], b[3] - b[1] + EPS
    union = w_a * h_a + w_b * h_b - inter + EPS
    plain = inter / union
    if kind == "iou":
        return plain
    hull_w = F.greatest(a[2], b[2]) - F.least(a[0], b[0])
    hull_h = F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    if kind == "giou":
        hull = hull_w * hull_h + EPS
        return plain - (hull - union) / hull
    dx, dy = b[0] + b[2] - a[0] - a[2], b[1] + b[3] - a[1] - a[3]
    apart = (dx * dx + dy * dy) / 4 / (hull_w * hull_w + hull_h * hull_h + EPS)
    if kind == "diou":
        return plain - apart
    if kind != "ciou":
        raise ValueError(kind)
    turn = F.atan(w_b / h_b) - F.atan(w_a / h_a)
    shape = turn * turn * (4 / math.pi**2)
    return plain - (apart + shape * shape / (F.lit(1.0 + EPS) - plain + shape))


def wh_iou(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Overlap of two sizes at one centre."""
    inter = F.least(w1, w2) * F.least(h1, h2)
    return inter / (w1 * h1 + TINY + w2 * h2 - inter)


def rescale(box: Box, dim: float, height: Column, width: Column) -> list[Column]:
    """Boxes of an image padded to a square of side `dim`, in pixels of the original; half a padding is rounded down."""
    scale = F.lit(float(dim)) / F.greatest(height, width)
    pad_x, pad_y = F.greatest(height - width, F.lit(0)) * scale, F.greatest(width - height, F.lit(0)) * scale
    fit = lambda v, pad, side: (v - F.floor(pad / 2)) / (F.lit(float(dim)) - pad) * side
    return [fit(v, *((pad_y, height) if i % 2 else (pad_x, width))) for i, v in enumerate(box)]


def to_relative(box: Box, height: Column, width: Column) -> list[Column]:
    return [v / (height if i % 2 else width) for i, v in enumerate(box)]


def to_absolute(box: Box, height: Column, width: Column) -> list[Column]:
    return [v * (height if i % 2 else width) for i, v in enumerate(box)]


def flip_horizontal(cx: Column) -> Column:
    """The centre of a relative box in the mirrored image."""
    return F.lit(1.0) - cx


def detection_scores(obj: Column, cls_prob: Column) -> dict[str, Column]:
    """cls, cls_conf and rank score (objectness times class confidence) of a detection."""
    best = F.array_max(cls_prob)
    return {"cls": (F.array_position(cls_prob, best) - 1).cast("int"), "cls_conf": best, "rank_score": obj * best}
