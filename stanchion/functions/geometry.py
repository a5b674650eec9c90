"""Boxes as columns (centre and size), and the measures between them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

PERSON, HELMET, VEST = 0, 1, 2
CLASS_NAMES = {PERSON: "person", HELMET: "helmet", VEST: "vest"}
REQUIRED = (HELMET, VEST)
#: Least containment that binds, least overlap that matches, least containment of a duplicate.
CONTAINMENT, MATCH_IOU, DUPLICATE = 0.80, 0.5, 0.80
#: Where a class sits on a person, as a share of the height from the top.
ANCHOR = {HELMET: 0.05, VEST: 0.35}
ANCHOR_ELSE = 0.5


class Box(NamedTuple):
    xc: Column
    yc: Column
    w: Column
    h: Column


def box(prefix: str = "") -> Box:
    """The box in columns <prefix>xc, <prefix>yc, <prefix>w, <prefix>h."""
    return Box(*(F.col(prefix + c) for c in Box._fields))


def corners(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.xc - b.w / 2, b.yc - b.h / 2, b.xc + b.w / 2, b.yc + b.h / 2


def area(b: Box) -> Column:
    return b.w * b.h


def intersection(a: Box, b: Box) -> Column:
    return common(corners(a), corners(b))


def common(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """intersection() of boxes whose corners are known: where each box meets several, these are worked out once."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
    width = F.least(ax2, bx2) - F.greatest(ax1, bx1)
    height = F.least(ay2, by2) - F.greatest(ay1, by1)
    return F.when((width > 0) & (height > 0), width * height).otherwise(0.0)


def containment(inner: Box, outer: Box) -> Column:
    """Share of inner's area inside outer; 0 for an empty inner."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def anchor_distance(item: Box, cls: Column, person: Box) -> Column:
    """From the item's centre to where its class sits on the person, over the person's diagonal; infinite for a degenerate person."""
    diagonal = F.sqrt(person.w * person.w + person.h * person.h)
    share = F.lit(ANCHOR_ELSE)
    for k, v in ANCHOR.items():
        share = F.when(cls == k, v).otherwise(share)
    dx = item.xc - person.xc
    dy = item.yc - (person.yc - person.h / 2 + share * person.h)
    return F.when(diagonal > 0, F.sqrt(dx * dx + dy * dy) / diagonal).otherwise(float("inf"))


def overlaps(a: Box, b: Box) -> Column:
    """Whether the boxes share inner points; touching is not enough."""
    ax1, ay1, ax2, ay2 = corners(a)
    bx1, by1, bx2, by2 = corners(b)
    return (ax1 < bx2) & (bx1 < ax2) & (ay1 < by2) & (by1 < ay2)


def from_pixels(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Box:
    """A normalised box from pixel corners in either order."""
    w, h = width.cast("double"), height.cast("double")
    return Box((x1 + x2) / 2 / w, (y1 + y2) / 2 / h, F.abs(x2 - x1) / w, F.abs(y2 - y1) / h)


def out_of_range(b: Box) -> Column:
    """Whether any coordinate lies outside 0..1."""
    return F.exists(F.array(*b), lambda x: (x < 0) | (x > 1))


def bad_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 <= x1) | (y2 <= y1)


def beyond(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Whether a pixel box leaves its image."""
    return (x1 < 0) | (y1 < 0) | (x2 > width) | (y2 > height)


def feet(b: Box) -> tuple[Column, Column]:
    """The point that decides whether a person stands in a zone: the middle of the lower edge."""
    return b.xc, b.yc + b.h / 2


def size_bin(b: Box, side: int = 640) -> Column:
    """small, medium or large by area in pixels of a side x side image (bounds 32 and 96 squared)."""
    pixels = area(b) * (side * side)
    return F.when(pixels < 32 * 32, "small").when(pixels < 96 * 96, "medium").otherwise("large")


def fitted(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size after shrinking the longer side to `most`: never larger, at least 1, halves to even."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return tuple(F.greatest(F.bround(x * scale), F.lit(1)).cast("int") for x in (width, height))


def drag_box(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    """Corners of a dragged rectangle, in order and inside 0..1."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return clamp(F.least(x1, x2)), clamp(F.least(y1, y2)), clamp(F.greatest(x1, x2)), clamp(F.greatest(y1, y2))


def state_code(helmet: Column, vest: Column) -> Column:
    """W, WH, WV or WHV."""
    return F.concat(F.lit("W"), F.when(helmet, "H").otherwise(""), F.when(vest, "V").otherwise(""))


def decode_state(code: Column) -> tuple[Column, Column]:
    """(helmet, vest) of the codes 0..3; null for others."""
    known = code.isin(0, 1, 2, 3)
    return F.when(known, code.isin(1, 3)), F.when(known, code.isin(2, 3))


def unknown_state(code: Column) -> Column:
    """Whether a code is none of 0..3; such rows are counted and left out, not decoded."""
    return ~F.coalesce(code.isin(0, 1, 2, 3), F.lit(False))


def brightness(red: Column, green: Column, blue: Column) -> Column:
    """Mean of a pixel's (or an image's mean) channels."""
    return (red + green + blue) / 3


def saturation(red: Column, green: Column, blue: Column) -> Column:
    high, low = F.greatest(red, green, blue), F.least(red, green, blue)
    return (high - low) / F.greatest(high, F.lit(1))
