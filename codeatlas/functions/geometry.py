"""Level of detail, camera and easing as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeatlas.functions import tables as t


def container_rung(h: Column, w: Column) -> Column:
    """Dot, Label, Card, Detail or Full by pixel height and width; null where merged away."""
    by = F.when(h < t.LABEL_PX, "Dot").when(h < t.CARD_PX, "Label").when(h < t.DETAIL_PX, "Card").when(h < t.FULL_PX, "Detail").otherwise("Full")
    return F.when(h < t.MERGE_PX, None).when(w < t.LABEL_MIN_W, "Dot").when((by == "Full") & (w < t.CODE_MIN_W), "Detail").otherwise(by)


def leaf_draw(h: Column, w: Column, natural: Column) -> Column:
    """Dot, Label, Minimap or Text; null where merged away."""
    text = (F.lit(t.FONT_PX) * h / natural >= t.MIN_TEXT_FONT_PX) & (w >= t.CODE_MIN_W)
    return F.when(h < t.MERGE_PX, None).when((w < t.LABEL_MIN_W) | (h < t.LABEL_PX), "Dot").when(h < t.CARD_PX, "Label").when(text, "Text").otherwise("Minimap")


def project(x: Column, y: Column, w: Column, h: Column, cam_x: float, cam_y: float, zoom: float) -> list[Column]:
    """World rectangle to screen pixels."""
    return [(x - cam_x) * zoom, (y - cam_y) * zoom, w * zoom, h * zoom]


def ease_in_out(p: Column) -> Column:
    """Cubic."""
    return F.when(p < 0.5, 4 * p * p * p).otherwise(1 - F.pow(-2 * p + 2, F.lit(3)) / 2)


def envelope_area(w: Column, h: Column, aspect: float) -> Column:
    e = F.greatest(w, h * aspect)
    return e * (e / aspect)
