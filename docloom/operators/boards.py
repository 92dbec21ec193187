"""Boards: shapes of diagram elements and whole drawings as SVG, by column expressions.

An element is a row with a board, a z-index, a shape, a box (x, y, width, height), paint and a label.
Null paint takes the defaults; an unknown or null shape is a plain rectangle; null coordinates count
as 0. A board's elements are gathered by their board alone, one drawing each.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx

#: Room around a drawing; size of a swimlane without one. Fixed values.
PADDING, LANE_WIDTH, LANE_HEIGHT = 72, 120, 240
STROKE, FILL, STROKE_WIDTH = "#333", "none", 1
STYLE = "background:#fff; font-family:-apple-system,BlinkMacSystemFont,'Segoe UI',Roboto,sans-serif;"


def filled(template: str, **values: Column) -> Column:
    """The template with numbers in place of its fields; fields of text end in an underscore."""
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if field:
            parts.append(values[field] if field.endswith("_") else tx.number_text(values[field].cast("double")))
    return F.concat(*parts)


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column
    fill: Column
    stroke: Column
    width: Column

    @staticmethod
    def of(x: str = "x", y: str = "y", w: str = "width", h: str = "height", fill: str = "fill", stroke: str = "stroke", width: str = "stroke_width") -> Box:
        number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return Box(number(x), number(y), number(w), number(h), tx.missing_as(F.col(fill), FILL), tx.missing_as(F.col(stroke), STROKE), F.coalesce(F.nullif(F.col(width).cast("double"), F.lit(0.0)), F.lit(float(STROKE_WIDTH))))

    def at(self, across: float, down: float, dx: Column | float = 0.0, dy: Column | float = 0.0) -> tuple[Column, Column]:
        """A point by its shares of the box's width and height, and a shift."""
        shift = lambda d: d if isinstance(d, Column) else F.lit(float(d))
        return self.x + self.w * across + shift(dx), self.y + self.h * down + shift(dy)

    def paint(self, fill: Column | None = None) -> Column:
        return filled('fill="{f_}" stroke="{s_}" stroke-width="{w}"', f_=self.fill if fill is None else fill, s_=self.stroke, w=self.width)

    @property
    def outline(self) -> Column:
        return self.paint(F.lit("none"))

    def polygon(self, *points: tuple[Column, Column]) -> Column:
        spots = F.concat_ws(" ", *[filled("{x},{y}", x=x, y=y) for x, y in points])
        return filled('<polygon points="{p_}" {paint_}/>', p_=spots, paint_=self.paint())

    def rect(self, rx: Column | None = None, inset: Column | None = None) -> Column:
        """The box, or a frame within it that is at least 1 wide and high."""
        by = F.lit(0.0) if inset is None else inset
        side = lambda s: s if inset is None else F.greatest(s - by * 2, F.lit(1.0))
        corner = F.lit("") if rx is None else filled(' rx="{r}"', r=rx)
        return filled('<rect x="{x}" y="{y}" width="{w}" height="{h}"{rx_} {paint_}/>', x=self.x + by, y=self.y + by, w=side(self.w), h=side(self.h), rx_=corner, paint_=self.paint() if inset is None else self.outline)

    def line(self, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        return filled('<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="{s_}" stroke-width="{w}"/>', a=a[0], b=a[1], c=b[0], d=b[1], s_=self.stroke, w=self.width)

    def circle(self, radius: Column, paint: Column) -> Column:
        cx, cy = self.at(0.5, 0.5)
        return filled('<circle cx="{x}" cy="{y}" r="{r}" {paint_}/>', x=cx, y=cy, r=radius, paint_=paint)

    def ellipse(self, at: tuple[Column, Column], ry: Column, paint: Column) -> Column:
        return filled('<ellipse cx="{x}" cy="{y}" rx="{rx}" ry="{ry}" {paint_}/>', x=at[0], y=at[1], rx=self.w / 2, ry=ry, paint_=paint)

    def path(self, template: str, paint: Column, **values: Column) -> Column:
        return filled('<path d="{d_}" {paint_}/>', d_=filled(template, **values), paint_=paint)


def _note(b: Box) -> Column:
    fold = F.least(F.lit(18.0), b.w * 0.2, b.h * 0.25)
    v = {"l": b.x, "t": b.y, "r": b.x + b.w, "b": b.y + b.h, "c": b.x + b.w - fold, "f": b.y + fold}
    return F.concat(b.path("M{l},{t} H{c} L{r},{f} V{b} H{l} Z", b.paint(), **v), b.path("M{c},{t} V{f} H{r}", b.outline, **v))


def _frame(b: Box) -> Column:
    tab, down = F.least(F.greatest(b.w * 0.16, F.lit(56.0)), F.lit(110.0)), F.least(F.lit(28.0), b.h * 0.18)
    v = {"l": b.x, "t": b.y, "r": b.x + b.w, "b": b.y + b.h, "e": b.x + tab, "s": b.x + tab + down * 0.5, "d": b.y + down}
    return F.concat(b.path("M{l},{t} H{e} L{s},{d} H{r} V{b} H{l} Z", b.paint(), **v), b.path("M{l},{d} H{s}", b.outline, **v))


def _package(b: Box) -> Column:
    tab, down = F.least(b.w * 0.42, F.lit(110.0)), F.least(b.h * 0.22, F.lit(28.0))
    v = {"l": b.x, "t": b.y, "r": b.x + b.w, "b": b.y + b.h, "e": b.x + tab, "s": b.x + tab + 10, "d": b.y + down}
    return b.path("M{l},{d} V{t} H{e} L{s},{d} H{r} V{b} H{l} Z", b.paint(), **v)


def _cylinder(b: Box) -> Column:
    ry = F.least(b.h * 0.18, F.lit(14.0))
    v = {"l": b.x, "r": b.x + b.w, "t": b.y + ry, "o": b.y - ry / 3, "b": b.y + b.h - ry, "u": b.y + b.h + ry / 3}
    return F.concat(b.path("M{l},{t} C{l},{o} {r},{o} {r},{t} L{r},{b} C{r},{u} {l},{u} {l},{b} Z", b.paint(), **v), b.ellipse(b.at(0.5, 0, 0, ry), ry, b.outline))


def shape(kind: Column, b: Box, corner: Column | None = None) -> Column:
    """Markup of a shape; ``corner`` is the radius of a rounded rectangle, 8 if null or 0."""
    half = F.least(b.w, b.h) / 2
    slant, inset = F.least(b.w * 0.16, F.lit(18.0)), F.least(b.w * 0.18, F.lit(24.0))
    oval = b.ellipse(b.at(0.5, 0.5), b.h / 2, b.paint())
    dot = b.circle(F.greatest(half - b.width * 2, F.lit(1.0)), filled('fill="{s_}" stroke="none"', s_=b.stroke))
    rounded = F.coalesce(F.nullif((corner if corner is not None else F.lit(0.0)).cast("double"), F.lit(0.0)), F.lit(8.0))
    by_name = [
        (["rect"], b.rect(F.lit(2.0))),
        (["start-end"], b.rect(b.h / 2)),
        (["state"], b.rect(F.least(F.lit(12.0), b.h / 4))),
        (["rounded-rect"], b.rect(rounded)),
        (["weak-entity"], F.concat(b.rect(F.lit(1.0)), b.rect(F.lit(1.0), F.least(F.lit(5.0), b.w * 0.08, b.h * 0.08)))),
        (["simple-class"], F.concat(b.rect(), *[b.line((b.x, b.y + b.h * k / 3), (b.x + b.w, b.y + b.h * k / 3)) for k in (1, 2)])),
        (["subroutine"], F.concat(b.rect(), b.line(b.at(0, 0, 8), b.at(0, 1, 8)), b.line(b.at(1, 0, -8), b.at(1, 1, -8)))),
        (["decision"], b.polygon(b.at(0.5, 0), b.at(1, 0.5), b.at(0.5, 1), b.at(0, 0.5))),
        (["manual-input"], b.polygon(b.at(0, 0, 0, 10), b.at(1, 0), b.at(1, 1), b.at(0, 1))),
        (["data", "input-output", "parallelogram"], b.polygon(b.at(0, 0, slant), b.at(1, 0), b.at(1, 1, -slant), b.at(0, 1))),
        (["hexagon"], b.polygon(b.at(0, 0, inset), b.at(1, 0, -inset), b.at(1, 0.5), b.at(1, 1, -inset), b.at(0, 1, inset), b.at(0, 0.5))),
        (["use-case", "ellipse", "circle", "start"], oval),
        (["finish"], F.concat(b.circle(half, b.paint(F.lit("#fff"))), dot)),
        (["connector"], b.circle(half, b.paint())),
        (["note"], _note(b)),
        (["frame"], _frame(b)),
        (["package"], _package(b)),
        (["database", "cylinder"], _cylinder(b)),
    ]
    out = b.rect()
    for names, markup in by_name:
        out = F.when(kind.isin(*names), markup).otherwise(out)
    return out


def element(kind: Column, b: Box, rotate: Column | None = None, label: Column | None = None, corner: Column | None = None) -> Column:
    """A shape in its group, turned about its centre, with its label in the middle."""
    cx, cy = b.at(0.5, 0.5)
    turn = F.lit("") if rotate is None else F.when(F.coalesce(rotate, F.lit(0)) != 0, filled(' transform="rotate({r} {x} {y})"', r=rotate, x=cx, y=cy)).otherwise("")
    text = F.lit("") if label is None else F.when(F.coalesce(label, F.lit("")) != "", filled('<text x="{x}" y="{y}" text-anchor="middle" dominant-baseline="central">{t_}</text>', x=cx, y=cy, t_=tx.escape_xml(label))).otherwise("")
    return F.concat(F.lit("<g"), turn, F.lit(">"), shape(kind, b, corner), text, F.lit("</g>"))


def lane_size(width: Column, height: Column, children: Column, splits: Column) -> Column:
    """Size of a swimlane: its own, or 120 a lane (children, or splits and one, or one) by 240."""
    lanes = F.greatest(F.coalesce(children, F.lit(0)), F.coalesce(splits, F.lit(0)) + 1, F.lit(1))
    return F.struct(F.coalesce(width.cast("double"), lanes * float(LANE_WIDTH)).alias("width"), F.coalesce(height.cast("double"), F.lit(float(LANE_HEIGHT))).alias("height"))


def drawings(elements: DataFrame, key: str, order: list[str], box: Box, markup: Column) -> DataFrame:
    """``svg``, ``width`` and ``height`` of each board: its elements in order (z-index first) over a
    white ground that leaves 72 around their union."""
    bodies = F.array_sort(F.collect_list(F.struct(*[F.coalesce(F.col(order[0]), F.lit(0)).alias("_z")], *order[1:], markup.alias("_m"))))
    drawn = elements.groupBy(key).agg(
        F.min(box.x).alias("_x"), F.min(box.y).alias("_y"), F.max(box.x + box.w).alias("_r"), F.max(box.y + box.h).alias("_b"),
        F.array_join(F.transform(bodies, lambda e: e["_m"]), "\n").alias("_body"),
    )
    v = {"x": F.col("_x") - PADDING, "y": F.col("_y") - PADDING, "w": F.col("_r") - F.col("_x") + 2 * PADDING, "h": F.col("_b") - F.col("_y") + 2 * PADDING}
    svg = filled(
        '<svg xmlns="http://www.w3.org/2000/svg" viewBox="{x} {y} {w} {h}" width="{w}" height="{h}" style="{style_}">\n<rect x="{x}" y="{y}" width="{w}" height="{h}" fill="#fff"/>\n{body_}\n</svg>',
        **v, body_=F.col("_body"), style_=F.lit(STYLE),
    )
    return drawn.select(key, svg.alias("svg"), F.ceil(v["w"]).cast("long").alias("width"), F.ceil(v["h"]).cast("long").alias("height"))
