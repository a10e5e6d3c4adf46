"""Vector arithmetic over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or all zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity_of_distance(d: Column) -> Column:
    return 1 - d


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x0, y0, x1, y1; 0 where they don't overlap."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    inter = w * h
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - inter
    return F.when((w > 0) & (h > 0) & (union > 0), inter / union).otherwise(0.0)
