"""Glyphs: duplicates of a text layer, glyph-to-span assignment and span text.

Glyphs have page_id, char_idx, ch, font, rotation (radians) and a box.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import boxes as B
from leafmill.functions import text as X
from leafmill.session import checkpointed

# Tolerances of duplicate glyphs.
NEAR = 1.0
SHADOW_REACH = 2.5
SHADOW_RIGID = 0.1
SHADOW_OVERLAP = 0.45
# Closing and opening punctuation.
CLOSING = [
    ".", "!", "?", "。", "！", "？", ")", "）", '"', "”", ":", "：", ";", "；", "]", "】", "}", "}", ">", "》", "、",
    ",", "，", "-", "—", "–",
]
OPENING = ["(", "（", '"', "“", "【", "{", "《", "<", "「", "『", "【", "["]


def _is_blank(ch: Column) -> Column:
    return (ch == "") | ch.rlike(r"^\s+\z")


def is_upright(rotation: Column) -> Column:
    """Within 0.1 degree of 0, 90, 180 or 270."""
    degrees = rotation * (180.0 / math.pi)
    out = F.lit(False)
    for angle in (0, 90, 180, 270):
        out = out | (F.abs(degrees - angle) < 0.1)
    return out


def drop_skewed(glyphs: DataFrame) -> DataFrame:
    """Upright glyphs, and skewed ones inside an upright line (line_id, line_rotation) with a visible upright glyph."""
    b = B.box()
    visible = ~_is_blank(F.col("ch")) & B.is_valid(b) & is_upright(F.col("rotation"))
    lines = (
        glyphs.groupBy("page_id", "line_id").agg(F.max(visible).alias("__v"), F.max(is_upright(F.col("line_rotation"))).alias("__u"))
        .where("__v and __u")
    )
    upright = is_upright(F.col("rotation"))
    skewed = glyphs.where(~upright).join(lines, ["page_id", "line_id"], "left_semi")
    return glyphs.where(upright).unionByName(skewed)


def _is_shadow(a: B.Box, b: B.Box) -> Column:
    """b is a shifted copy of a: a rigid diagonal shift between the tolerance and its reach, still overlapping."""
    dx0, dy0, dx1, dy1 = b.x0 - a.x0, b.y0 - a.y0, b.x1 - a.x1, b.y1 - a.y1
    rigid = (F.abs(dx0 - dx1) <= SHADOW_RIGID) & (F.abs(dy0 - dy1) <= SHADOW_RIGID)
    w = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    h = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    smaller = F.least(a.area, b.area)
    overlap = F.when(smaller > 0, w * h / smaller).otherwise(0.0)
    reach = (F.abs(dx0) > NEAR) & (F.abs(dx0) <= SHADOW_REACH) & (F.abs(dy0) > NEAR) & (F.abs(dy0) <= SHADOW_REACH)
    return rigid & reach & (overlap >= SHADOW_OVERLAP)


#: Glyphs of a page that one fold decides.
PAGE_GLYPHS = 256
#: Side of the grid cells in which glyphs of larger pages meet; a copy goes to the next cell only from within the tolerance of its border.
CELL = 4.0


def deduplicate_glyphs(glyphs: DataFrame, shadows: bool = True, page_glyphs: int = PAGE_GLYPHS) -> DataFrame:
    """Drop glyphs near-identical to an earlier kept one (same glyph, font, rotation; every box edge within 1),
    and shifted shadows of the glyph kept just before. Blanks stay.

    Whether a glyph is kept depends only on earlier ones of its page. A page of at most ``page_glyphs`` with distinct indices is one
    fold in their order, so its glyphs are shuffled once; larger pages are decided in rounds.
    """
    page = Window.partitionBy("page_id")
    told = glyphs.withColumn("__again", F.lag("char_idx").over(page.orderBy("char_idx")).eqNullSafe(F.col("char_idx")))
    told = told.withColumns({"__size": F.count("*").over(page), "__again": F.max("__again").over(page)})
    folds = F.col("page_id").isNotNull() & (F.col("__size") <= page_glyphs) & ~F.col("__again")
    small, large = (told.where(c).select(*glyphs.columns) for c in (folds, ~folds))
    return _folded(small, shadows).unionByName(_in_rounds(large, shadows))


def _folded(glyphs: DataFrame, shadows: bool) -> DataFrame:
    """``deduplicate_glyphs`` for small pages: a fold over the glyphs of a page that carries the kept ones."""
    rest = [c for c in glyphs.columns if c not in ("page_id", "char_idx")]
    told = glyphs.select("page_id", F.struct("char_idx", F.struct(*rest).alias("g"), F.round("rotation", 3).alias("rot"), _is_blank(F.col("ch")).alias("blank")).alias("x"))
    pages = told.groupBy("page_id").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def same(p: Column, x: Column) -> Column:
        return (p["g"]["ch"] == x["g"]["ch"]) & (p["g"]["font"] == x["g"]["font"]) & (p["rot"] == x["rot"])

    def close(p: Column, x: Column) -> Column:
        out = same(p, x)
        for e in ("x0", "y0", "x1", "y1"):
            out = out & (F.abs(x["g"][e] - p["g"][e]) <= NEAR)
        return out

    def add(kept: Column, x: Column) -> Column:
        drop = F.coalesce(~x["blank"] & F.exists(kept, lambda p: close(p, x)), F.lit(False))
        if shadows:
            last = F.get(kept, F.size(kept) - 1)
            edges = lambda v: B.Box(*[v["g"][e] for e in ("x0", "y0", "x1", "y1")])
            drop = drop | F.coalesce(same(last, x) & _is_shadow(edges(last), edges(x)), F.lit(False))
        return F.when(F.coalesce(x["blank"], F.lit(False)) | ~drop, F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate("x", F.slice("x", 1, 0), add)
    return pages.select("page_id", F.explode(kept).alias("x")).select("page_id", "x.char_idx", "x.g.*").select(*glyphs.columns)


def _in_rounds(glyphs: DataFrame, shadows: bool) -> DataFrame:
    """``deduplicate_glyphs`` for pages of any size: repeating the decision for all glyphs at once from any start settles on the
    sequential answer, as each round settles at least one more glyph of every page. The start keeps the first glyph per unit cell, so the
    kept glyphs a place offers are few, and glyphs meet them in grid cells.
    """
    signature = ["page_id", "ch", "font", "__rot"]
    base = glyphs.withColumns(
        {
            "__rot": F.round("rotation", 3),
            "__ux": F.floor(F.col("x0") / NEAR), "__uy": F.floor(F.col("y0") / NEAR),
            "__blank": _is_blank(F.col("ch")),
        }
    )
    first = F.min("char_idx").over(Window.partitionBy(*signature, "__ux", "__uy")) == F.col("char_idx")
    cells = {"__cx": F.floor(F.col("x0") / CELL), "__cy": F.floor(F.col("y0") / CELL)}
    state = checkpointed(base.withColumn("__kept", F.col("__blank") | first).drop("__ux", "__uy").withColumns(cells))
    edges = ["x0", "y0", "x1", "y1"]
    order = Window.partitionBy("page_id").orderBy("char_idx").rowsBetween(Window.unboundedPreceding, -1)
    # a little more than the tolerance, as sums of the ends are rounded
    reach = lambda e: F.explode(F.array_distinct(F.array(*[F.floor((F.col(e) + d * 1.001 * NEAR) / CELL) for d in (-1, 1)])))
    while True:
        seen = (
            state.where("__kept and not __blank")
            .groupBy(*signature, *edges).agg(F.min("char_idx").alias("k_idx"))
            .withColumn("__cx", reach("x0")).withColumn("__cy", reach("y0"))
            .withColumnsRenamed({e: f"k_{e}" for e in edges})
        )
        close = F.lit(True)
        for e in edges:
            close = close & (F.abs(F.col(e) - F.col(f"k_{e}")) <= NEAR)
        near = (
            state.where("not __blank").join(seen, [*signature, "__cx", "__cy"])
            .where(close & (F.col("k_idx") < F.col("char_idx")))
            .select("page_id", "char_idx").distinct().withColumn("__near", F.lit(True))
        )
        decided = state.join(near, ["page_id", "char_idx"], "left")
        drop = F.coalesce(F.col("__near"), F.lit(False))
        if shadows:
            me = F.struct("ch", "font", "__rot", *edges)
            decided = decided.withColumn("__p", F.last(F.when(F.col("__kept"), me), ignorenulls=True).over(order))
            same = (F.col("__p.ch") == F.col("ch")) & (F.col("__p.font") == F.col("font")) & (F.col("__p.__rot") == F.col("__rot"))
            drop = drop | F.coalesce(same & _is_shadow(B.box("__p."), B.box()), F.lit(False))
        after = checkpointed(
            decided.withColumn("__new", F.col("__blank") | ~drop)
            .withColumn("__moved", F.col("__new") != F.col("__kept"))
            .withColumn("__kept", F.col("__new")).drop("__near", "__p", "__new")
        )
        settled = after.where("__moved").isEmpty()
        state = after.drop("__moved")
        if settled:
            return state.where("__kept").select(*glyphs.columns)


def assign_glyphs_to_spans(glyphs: DataFrame, spans: DataFrame, cell: int = 16) -> DataFrame:
    """Glyphs with ``span_idx``: the first span by top edge whose middle band holds the glyph's centre.

    Closing punctuation may also enter by its left edge near the span's right end, opening punctuation by its
    right edge near the left end. Both sides meet on the grid row of the glyph's centre.
    """
    s = spans.select("page_id", "span_idx", *[F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")])
    s = s.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("s_y0") / cell), F.floor(F.col("s_y1") / cell))))
    g = glyphs.withColumn("__cell", F.floor(B.box().center_y / cell))
    me, it = B.box(), B.box("s_")
    band = (me.center_y > it.y0) & (me.center_y < it.y1) & (F.abs(me.center_y - it.center_y) < it.height * 0.33)
    centre = (me.center_x > it.x0) & (me.center_x < it.x1)
    closing = F.col("ch").isin(*CLOSING) & (me.x0 > it.x1 - it.height) & (me.x0 < it.x1) & (me.center_x > it.x0)
    opening = (
        F.col("ch").isin(*OPENING) & ~F.col("ch").isin(*CLOSING)
        & (me.x1 > it.x0) & (me.x1 < it.x0 + it.height) & (me.center_x < it.x1)
    )
    hits = g.join(s, ["page_id", "__cell"]).where(band & (centre | closing | opening))
    owner = hits.groupBy("page_id", "char_idx").agg(F.min(F.struct("s_y0", "span_idx"))["span_idx"].alias("span_idx"))
    return glyphs.join(owner, ["page_id", "char_idx"])


def script_roles(owned: DataFrame) -> DataFrame:
    """Add ``role`` (body, sup, sub) from the span's body axis: among visible glyphs of at least 0.9 of the
    greatest height, median centre and height; off the axis by over 0.15 heights is a script."""
    span = Window.partitionBy("page_id", "span_idx")
    b = B.box()
    valid = ~F.col("ch").isin(" ", "\r", "\n") & (b.height > 1) & (b.width > 0)
    with_top = owned.withColumn("__top", F.max(F.when(valid, b.height)).over(span))
    body = valid & (b.height >= F.col("__top") * 0.9)
    axis = with_top.withColumns(
        {
            "axis_y": F.median(F.when(body, b.center_y)).over(span),
            "axis_h": F.median(F.when(body, b.height)).over(span),
        }
    )
    off = F.col("axis_h") * 0.15
    usable = valid & F.coalesce(F.col("axis_h") > 0, F.lit(False))
    role = (
        F.when(usable & (b.center_y < F.col("axis_y") - off), "sup")
        .when(usable & (b.center_y > F.col("axis_y") + off), "sub")
        .otherwise("body")
    )
    return axis.withColumn("role", role).drop("__top")


def span_texts(owned: DataFrame) -> DataFrame:
    """Text per span: glyphs by index without line breaks, a blank where the gap exceeds a quarter of the
    median width, script runs in ``<sup>`` / ``<sub>``; ligatures expanded."""
    visible = owned.where(~F.col("ch").isin("\r", "\n"))
    span = Window.partitionBy("page_id", "span_idx")
    w = span.orderBy("char_idx")
    wide = script_roles(visible).withColumns(
        {
            "__median": F.median(B.box().width).over(span),
            "__nx": F.lead("x0").over(w), "__nch": F.lead("ch").over(w), "__nrole": F.lead("role").over(w),
        }
    )
    gap = (F.col("__nx") - F.col("x1") > F.col("__median") * 0.25) & (F.col("ch") != " ") & (F.col("__nch") != " ")
    blank_role = F.when(F.col("role") == F.col("__nrole"), F.col("role")).otherwise("body")

    def part(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    parts = F.when(F.coalesce(gap, F.lit(False)), F.array(part(F.col("role"), F.col("ch")), part(blank_role, F.lit(" ")))).otherwise(
        F.array(part(F.col("role"), F.col("ch")))
    )
    grouped = wide.withColumn("__parts", parts).groupBy("page_id", "span_idx").agg(
        F.sort_array(F.collect_list(F.struct("char_idx", "__parts"))).alias("g")
    )
    flat = grouped.select("page_id", "span_idx", F.flatten(F.transform("g", lambda x: x["__parts"])).alias("p"))

    def tag(role: Column, closing: str) -> Column:
        return F.when(role == "body", "").otherwise(F.concat(F.lit("<" + closing), role, F.lit(">")))

    def piece(x: Column, i: Column) -> Column:
        before, after = F.get(F.col("p"), i - 1)["role"], F.get(F.col("p"), i + 1)["role"]
        opens = before.isNull() | (before != x["role"])
        closes = after.isNull() | (after != x["role"])
        return F.concat(
            F.when(opens, tag(x["role"], "")).otherwise(""), x["text"], F.when(closes, tag(x["role"], "/")).otherwise("")
        )

    text = F.array_join(F.transform("p", piece), "")
    return flat.select("page_id", "span_idx", F.trim(X.expand_ligatures(text), F.lit(" \t\r\n")).alias("text"))
