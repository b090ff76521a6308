"""Boxes on a page and in a picture of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels that a burn goes beyond its box; a fixed value.
BLEED = 3


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def project(box: Column, view: Column, shot: Column) -> Column:
    """A box relative to the viewport (``view``: scroll_x, scroll_y) in a picture (``shot``: origin_x, origin_y, scale)."""
    s = shot["scale"]
    return _box((box["x"] + view["scroll_x"] - shot["origin_x"]) * s, (box["y"] + view["scroll_y"] - shot["origin_y"]) * s, box["w"] * s, box["h"] * s)


def unproject(box: Column, view: Column, shot: Column) -> Column:
    """The way back."""
    s = shot["scale"]
    return _box(box["x"] / s + shot["origin_x"] - view["scroll_x"], box["y"] / s + shot["origin_y"] - view["scroll_y"], box["w"] / s, box["h"] / s)


def burn_box(box: Column, view: Column, shot: Column, width: Column, height: Column) -> Column:
    """struct<fate, x, y, w, h>: the pixels to burn for a box, in a picture of that size.
    ``fate`` is burned, skipped (an empty box) or outside (nothing in the picture)."""
    p = project(box, view, shot)
    left, top = F.floor(p["x"]) - BLEED, F.floor(p["y"]) - BLEED
    right, bottom = left + F.ceil(p["w"]) + 2 * BLEED, top + F.ceil(p["h"]) + 2 * BLEED
    x0, y0, x1, y1 = F.greatest(F.lit(0), left), F.greatest(F.lit(0), top), F.least(width, right), F.least(height, bottom)
    fate = F.when((box["w"] <= 0) | (box["h"] <= 0), "skipped").when((x1 <= x0) | (y1 <= y0), "outside").otherwise("burned")
    kept = lambda v: F.when(fate == "burned", v.cast("long"))
    return F.struct(fate.alias("fate"), kept(x0).alias("x"), kept(y0).alias("y"), kept(x1 - x0).alias("w"), kept(y1 - y0).alias("h"))
