"""Layout on pages of boxes: lines, columns, interval and box merges, spatial joins, reading order.

Spans have page_id, span_idx, type and a box. Spatial joins meet in (page, y-cell) buckets, so a page's boxes
are spread over many keys and only neighbours are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import boxes as B
from leafmill.operators.ordered import Scan, islands, scan
from leafmill.session import checkpointed, written

ALONE = ("image", "table", "interline_equation")


def _assemble(spans: DataFrame, order: list, overlap, threshold: float, lonely: bool, out: str) -> DataFrame:
    prev = F.struct("type", "x0", "y0", "x1", "y1") if lonely else F.struct("x0", "y0", "x1", "y1")
    seen = scan(spans, ["page_id"], order, {"__p": Scan("lag", prev)})
    starts = F.col("__p").isNull() | ~(overlap(B.box(), B.box("__p.")) > threshold)
    if lonely:
        starts = starts | F.col("type").isin(*ALONE) | F.coalesce(F.col("__p.type").isin(*ALONE), F.lit(False))
    return islands(seen, ["page_id"], order, starts, out).drop("__p")


def assign_lines(spans: DataFrame, threshold: float = 0.6, lonely: bool = True) -> DataFrame:
    """Add ``line_id``: spans by top edge; a new line starts where a span shares too little height with the one
    before it. Pictures, tables and display equations stand alone."""
    return _assemble(spans, ["y0", "span_idx"], B.y_overlap_in_smaller, threshold, lonely, "line_id")


def assign_columns(spans: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Vertical text: columns from right to left by shared width."""
    return _assemble(spans, [F.col("x1").desc(), F.col("span_idx")], B.x_overlap_in_smaller, threshold, True, "line_id")


def order_in_lines(lined: DataFrame, vertical: bool = False) -> DataFrame:
    """Add ``pos``: position in the line, by left edge (top edge in columns), ties as in the line."""
    first = ["x0", "y0", "span_idx"] if not vertical else ["y0", F.col("x1").desc(), F.col("span_idx")]
    w = Window.partitionBy("page_id", "line_id").orderBy(*first)
    return lined.withColumn("pos", F.row_number().over(w))


def line_boxes(lined: DataFrame, keys: Sequence[str] = ("page_id", "line_id")) -> DataFrame:
    """Enclosing box, span count and area density per line (or any group)."""
    area = F.sum(B.box().area.cast("double"))
    return (
        lined.groupBy(*keys)
        .agg(
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
            F.count("*").alias("n"), area.alias("__area"),
        )
        .withColumn("density", F.when(B.box().area > 0, F.least(F.lit(1.0), F.col("__area") / B.box().area)).otherwise(1.0))
        .drop("__area")
    )


def vertical_pages(spans: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """``vertical`` per block: more than 0.8 of its non-empty spans are over twice as high as wide."""
    b = B.box()
    valid = (b.width > 0) & (b.height > 0)
    tall = valid & (b.height / b.width > 2)
    n = F.count_if(valid)
    return spans.groupBy(*keys).agg(F.when(n > 0, F.count_if(tall) / n > 0.8).otherwise(False).alias("vertical"))


def fix_text_blocks(spans: DataFrame) -> DataFrame:
    """Text blocks to ordered lines: display equations become inline, vertical blocks are read in columns."""
    inline = spans.withColumn("type", F.when(F.col("type") == "interline_equation", "inline_equation").otherwise(F.col("type")))
    marked = inline.join(vertical_pages(inline), "page_id")
    rows = order_in_lines(assign_lines(marked.where("not vertical")))
    columns = order_in_lines(assign_columns(marked.where("vertical")), vertical=True)
    return rows.unionByName(columns)


def merge_intervals(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of intervals (lo, hi) per group; touching ones join."""
    order = ["lo", "hi"]
    seen = scan(intervals, keys, order, {"__end": Scan("max", F.col("hi"), inclusive=False)})
    # the island flag needs the running end of all earlier rows, ties in (lo, hi) included
    starts = F.col("__end").isNull() | (F.col("__end") < F.col("lo"))
    return islands(seen, keys, order, starts, "__i").groupBy(*keys, "__i").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).drop("__i")


def subtract_intervals(ranges: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole-number ranges (keys, lo, hi) minus the masks of the same keys, with a gap of 1 on both sides."""
    merged = merge_intervals(masks, keys)
    hits = ranges.join(merged.select(*keys, F.col("lo").alias("m0"), F.col("hi").alias("m1")), list(keys))
    hits = hits.where("m0 <= hi and m1 >= lo")
    w = Window.partitionBy(*keys).orderBy("m0")
    cut = hits.withColumns({"__from": F.coalesce(F.lag("m1").over(w) + 1, F.col("lo")), "__last": F.lead("m0").over(w).isNull()})
    before = cut.select(*keys, F.col("__from").alias("a"), (F.col("m0") - 1).alias("b")).where("b >= a")
    after = cut.where("__last").select(*keys, F.greatest(F.col("m1") + 1, F.col("lo")).alias("a"), F.col("hi").alias("b")).where("b >= a")
    whole = ranges.join(hits.select(*keys).distinct(), list(keys), "left_anti").where("hi >= lo").select(
        *keys, F.col("lo").alias("a"), F.col("hi").alias("b")
    )
    return before.unionAll(after).unionAll(whole).toDF(*keys, "lo", "hi")


def cut_text_by_formulas(texts: DataFrame, formulas: DataFrame) -> DataFrame:
    """Pieces (page_id, span_idx, x0, x1, y0, y1) of text boxes left by formulas that share over 0.8 of the
    height. Boxes meet through the rows of a y-grid."""
    pairs = neighbours_by_y(texts, formulas, ["page_id"])
    masks = pairs.where(B.y_overlap_in_smaller(B.box(), B.box("o_")) > 0.8).select(
        "page_id", "span_idx", F.col("o_x0").alias("lo"), F.col("o_x1").alias("hi")
    )
    ranges = texts.select("page_id", "span_idx", F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    pieces = subtract_intervals(ranges, masks, ["page_id", "span_idx"])
    heights = texts.select("page_id", "span_idx", "y0", "y1")
    return pieces.join(heights, ["page_id", "span_idx"]).select(
        "page_id", "span_idx", F.col("lo").alias("x0"), F.col("hi").alias("x1"), "y0", "y1"
    )


def merge_detected_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes of wide lines (over four times as wide as high) merged where they overlap in x; others as they
    are; ``skewed`` boxes untouched."""
    lined = assign_lines(boxes.where("not skewed"), lonely=False)
    extents = line_boxes(lined).select(
        "page_id", "line_id", (B.box().width > 4 * B.box().height).alias("__wide")
    )
    marked = lined.join(extents, ["page_id", "line_id"])
    order = ["x0", "y0", "span_idx"]
    keys = ["page_id", "line_id"]
    seen = scan(marked, keys, order, {"__end": Scan("max", F.col("x1"), inclusive=False)})
    starts = ~F.col("__wide") | F.col("__end").isNull() | (F.col("__end") < F.col("x0"))
    merged = islands(seen, keys, order, starts, "__i").groupBy(*keys, "__i").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    columns = ["page_id", "x0", "y0", "x1", "y1"]
    return merged.select(*columns).unionAll(boxes.where("skewed").select(*columns))


CELL = 16


def _cells(df: DataFrame, cell: int) -> DataFrame:
    return df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))


def neighbours_by_y(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int = CELL) -> DataFrame:
    """Pairs of the same keys whose y-ranges meet: left columns, right columns prefixed ``o_``.

    Both sides spread over the grid rows they cover and meet in the first row they share, so every pair
    appears once without a final distinct.
    """
    other = right.select(*keys, *[F.col(c).alias(f"o_{c}") for c in right.columns if c not in keys])
    other = other.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("o_y0") / cell), F.floor(F.col("o_y1") / cell))))
    first = F.greatest(F.floor(F.col("y0") / cell), F.floor(F.col("o_y0") / cell))
    return _cells(left, cell).join(other, [*keys, "__cell"]).where(F.col("__cell") == first).drop("__cell")


def assign_spans_to_blocks(spans: DataFrame, blocks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every span with ``block_idx``: the first block covering over half of its area, null for leftovers."""
    pairs = neighbours_by_y(spans.select("page_id", "span_idx", "x0", "y0", "x1", "y1"), blocks, ["page_id"])
    hits = pairs.where(B.overlap_in_own(B.box(), B.box("o_")) > threshold)
    owner = hits.groupBy("page_id", "span_idx").agg(F.min("o_block_idx").alias("block_idx"))
    return spans.join(owner, ["page_id", "span_idx"], "left")


def drop_contained(boxes: DataFrame) -> DataFrame:
    """Boxes not inside another box of their page. Equal boxes lie in each other, so all of them go.

    Exact copies collapse to one row with a count first; candidates meet in y-grid rows.
    """
    keys = ["page_id", "x0", "y0", "x1", "y1"]
    distinct = boxes.groupBy(*keys).agg(F.count("*").alias("__n"))
    single = distinct.where("__n = 1").drop("__n")
    other = distinct.drop("__n")
    pairs = neighbours_by_y(single, other, ["page_id"])
    same = (
        (F.col("x0") == F.col("o_x0")) & (F.col("y0") == F.col("o_y0")) & (F.col("x1") == F.col("o_x1")) & (F.col("y1") == F.col("o_y1"))
    )
    inside = pairs.where(B.is_inside(B.box(), B.box("o_")) & ~same).select(*keys).distinct()
    kept = single.join(inside, keys, "left_anti")
    return boxes.join(kept, keys, "left_semi")


def assign_members_to_containers(members: DataFrame, containers: DataFrame, ratio: float = 0.9) -> DataFrame:
    """Members with the container that covers at least ``ratio`` of them (best cover, then smallest, then
    first) and their box relative to it."""
    pairs = neighbours_by_y(members, containers, ["page_id"])
    me, box = B.box(), B.box("o_")
    cover = B.overlap_in_own(me, box)
    rank = F.struct((-cover).alias("a"), box.area.alias("b"), F.col("o_block_idx").alias("c"))
    best = pairs.where(cover >= ratio).groupBy("page_id", "block_idx").agg(
        F.min_by(F.struct(F.col("o_block_idx").alias("container_idx"), B.relative_box(me, box).alias("rel")), rank).alias("r")
    )
    return best.select("page_id", "block_idx", "r.container_idx", "r.rel.*")


def span_triage(spans: DataFrame) -> DataFrame:
    """Add ``tall`` (over 2.3 times the page's median height and its own width) and ``reread`` (too little text
    for the width, or private-use text)."""
    from leafmill.functions.text import private_use_signal

    b = B.box()
    counts = spans.groupBy("page_id", b.height.alias("h")).agg(F.count("*").alias("n"))
    medians = counts.groupBy("page_id").agg(F.percentile("h", F.lit(0.5), F.col("n")).alias("__median"))
    thin = F.length("content") * b.height < 0.5 * b.width
    return (
        spans.join(medians, "page_id")
        .withColumns(
            {
                "tall": (b.height > F.col("__median") * 2.3) & (b.height > b.width * 2.3),
                "reread": thin | private_use_signal(F.col("content"))["flagged"],
            }
        )
        .drop("__median")
    )


def compose_transforms(groups: DataFrame, shapes: DataFrame) -> DataFrame:
    """Boxes of shapes in page space: the affine maps of all enclosing groups applied.

    groups: page_id, group_id, parent_id, sx, sy, tx, ty. Each round doubles the resolved chain; they end when no
    group has an unresolved parent, after the logarithm of the nesting depth. A round always resolves a group unless parents form a
    circle, which is an error.
    """
    maps = groups.select("page_id", "group_id", "parent_id", "sx", "sy", "tx", "ty")
    unresolved = maps.where("parent_id is not null").count()
    while True:
        up = maps.select(
            "page_id", F.col("group_id").alias("parent_id"), F.col("parent_id").alias("__next"),
            *[F.col(c).alias(f"u_{c}") for c in ("sx", "sy", "tx", "ty")],
        )
        maps = checkpointed(maps.join(up, ["page_id", "parent_id"], "left").select(
            "page_id", "group_id", F.col("__next").alias("parent_id"),
            (F.coalesce("u_sx", F.lit(1.0)) * F.col("sx")).alias("sx"),
            (F.coalesce("u_sy", F.lit(1.0)) * F.col("sy")).alias("sy"),
            (F.coalesce("u_sx", F.lit(1.0)) * F.col("tx") + F.coalesce("u_tx", F.lit(0.0))).alias("tx"),
            (F.coalesce("u_sy", F.lit(1.0)) * F.col("ty") + F.coalesce("u_ty", F.lit(0.0))).alias("ty"),
        ))
        before, unresolved = unresolved, maps.where("parent_id is not null").count()
        if not unresolved:
            break
        if unresolved == before:
            page = maps.where("parent_id is not null").select("page_id").first()[0]
            raise ValueError(f"groups of page {page} enclose each other in a circle")
    return shapes.join(maps.drop("parent_id"), ["page_id", "group_id"], "left").withColumns(
        {
            "x0": F.coalesce("sx", F.lit(1.0)) * F.col("x0") + F.coalesce("tx", F.lit(0.0)),
            "y0": F.coalesce("sy", F.lit(1.0)) * F.col("y0") + F.coalesce("ty", F.lit(0.0)),
            "x1": F.coalesce("sx", F.lit(1.0)) * F.col("x1") + F.coalesce("tx", F.lit(0.0)),
            "y1": F.coalesce("sy", F.lit(1.0)) * F.col("y1") + F.coalesce("ty", F.lit(0.0)),
        }
    ).drop("sx", "sy", "tx", "ty")


#: Children of a node of slabs; a rectangle ends inside two of them at most.
FAN = 16


#: Rectangles of a group that one fold measures; larger groups go down the tree of slabs.
FOLDED = 64


def _folded_area(r: Column, kind: str) -> Column:
    """Area covered by an array of rectangles: the edges cut it into slabs, and the heights of each slab are merged in order."""
    zero = F.lit(0).cast(kind)
    xs = F.sort_array(F.array_distinct(F.concat(F.transform(r, lambda b: b["x0"]), F.transform(r, lambda b: b["x1"]))))
    slabs = F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def height(slab: Column) -> Column:
        inside = F.filter(r, lambda b: (b["x0"] <= slab["a"]) & (b["x1"] >= slab["b"]))
        spans = F.sort_array(F.transform(inside, lambda b: F.struct(b["y0"].alias("lo"), b["y1"].alias("hi"))))
        # nothing ends before the first: greatest() passes over the null
        start = F.struct(F.lit(None).cast(kind).alias("end"), zero.alias("n"))
        return F.aggregate(
            spans, start, lambda s, v: F.struct(F.greatest(s["end"], v["hi"]).alias("end"), (s["n"] + F.greatest(v["hi"] - F.greatest(s["end"], v["lo"]), zero)).alias("n"))
        )["n"]

    return F.aggregate(F.transform(slabs, lambda s: (s["b"] - s["a"]) * height(s)), zero, lambda total, v: total + v)


def union_area(rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area covered by the rectangles of a group (x0, y0, x1, y1), overlap counted once; empty ones count nothing. A null key is no group.

    Groups of at most ``FOLDED`` rectangles are one fold each, over at most twice as many slabs; larger ones go down a tree.
    """
    box = ["x0", "y0", "x1", "y1"]
    whole_numbers = all(rects.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in box)
    kind = "long" if whole_numbers else "double"
    whole = rects.where("x0 < x1 and y0 < y1").dropna(subset=list(keys))
    sized = whole.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    boxes = F.collect_list(F.struct(*[F.col(c).cast(kind).alias(c) for c in box]))
    small = sized.where(F.col("__n") <= FOLDED).groupBy(*keys).agg(boxes.alias("__r")).select(*keys, _folded_area(F.col("__r"), kind).alias("area"))
    large = written(sized.where(F.col("__n") > FOLDED).select(*keys, *box))
    return small if large.isEmpty() else small.unionByName(_slab_area(large, keys))


def _slab_area(rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area covered by the rectangles of groups of any size.

    The vertical edges of a group cut it into slabs, ranges of slabs form a tree of ``FAN`` children a node. A rectangle goes down to
    the children it touches. In a child that rectangles span from side to side their heights are merged and count with the
    child's whole width; then those heights are taken out: the rectangles that end inside the child are moved up by what is covered
    below them. What is left of them is new area in any case, so nothing is compared twice. A rectangle ends inside two children at most, so
    the rows are n log n, whatever nests in what, and there are as many rounds as the tree is deep.
    """
    whole = rects.where("x0 < x1 and y0 < y1")
    edges = whole.select(*keys, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    ranked = edges.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("x")) - 1)
    ranked = written(ranked.withColumn("last", F.max("r").over(Window.partitionBy(*keys))))
    at = lambda x, r: ranked.select(*keys, F.col("x").alias(x), F.col("r").alias(r))
    told = whole.join(at("x0", "r0").join(ranked.select(*keys, "last").distinct(), list(keys)), [*keys, "x0"]).join(at("x1", "r1"), [*keys, "x1"])
    open_ = written(told.select(*keys, "r0", "r1", "last", F.col("y0").alias("lo"), F.col("y1").alias("hi"), F.monotonically_increasing_id().alias("__id")))
    width = 1
    while width < (ranked.agg(F.max("last")).first()[0] or 0):
        width *= FAN
    covered = []
    while True:
        w = F.lit(width)
        down = open_.withColumn("child", F.explode(F.sequence(F.expr(f"r0 div {width}"), F.expr(f"(r1 - 1) div {width}"))))
        left, right = F.col("child") * w, F.least((F.col("child") + 1) * w, F.col("last"))
        down = down.withColumn("spans", (F.col("r0") <= left) & (F.col("r1") >= right))
        down = down.withColumns({"r0": F.greatest("r0", left), "r1": F.least("r1", right)})
        side = lambda y, d, s: F.struct(F.col(y).alias("y"), F.when(F.col("spans"), d).otherwise(0).alias("d"), F.lit(s).alias("s"))
        events = down.withColumn("e", F.explode(F.array(side("lo", 1, 0), side("hi", -1, 1)))).select("*", "e.*").drop("e")
        sweep = Window.partitionBy(*keys, "child").orderBy("y")
        depth = F.sum("d").over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        step = events.withColumn("depth", depth).withColumn("next", F.lead("y").over(sweep))
        step = step.withColumn("part", F.when((F.col("depth") > 0) & F.col("next").isNotNull(), F.col("next") - F.col("y")).otherwise(F.lit(0)))
        below = F.coalesce(F.sum("part").over(sweep.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        swept = written(step.withColumn("y", F.col("y") - below).drop("depth", "next", "d", "lo", "hi"))
        lengths = swept.groupBy(*keys, "child").agg(F.sum("part").alias("h"), F.max("last").alias("last")).where("h > 0")
        covered.append(lengths.select(*keys, F.col("child") * w, F.least((F.col("child") + 1) * w, F.col("last")), "h").toDF(*keys, "r0", "r1", "h"))
        if width == 1:
            break
        rest = swept.where("not spans").groupBy(*keys, "child", "__id").agg(
            F.max("r0").alias("r0"), F.max("r1").alias("r1"), F.max("last").alias("last"),
            F.max(F.when(F.col("s") == 0, F.col("y"))).alias("lo"), F.max(F.when(F.col("s") == 1, F.col("y"))).alias("hi"),
        )
        # a rectangle goes on under a number of its own in each child
        open_ = rest.where("lo < hi").select(*keys, "r0", "r1", "last", "lo", "hi", F.xxhash64("__id", "child").alias("__id"))
        width //= FAN
    parts = covered[0]
    for more in covered[1:]:
        parts = parts.unionByName(more)
    measured = parts.join(at("x0", "r0"), [*keys, "r0"]).join(at("x1", "r1"), [*keys, "r1"])
    return measured.groupBy(*keys).agg(F.sum(F.col("h") * (F.col("x1") - F.col("x0"))).alias("area"))


def background_pictures(pictures: DataFrame, texts: DataFrame, share: float = 0.1) -> DataFrame:
    """Pictures (page_id, block_idx) of which later text covers at least ``share``."""
    pairs = neighbours_by_y(pictures, texts, ["page_id"]).where("o_block_idx > block_idx")
    clipped = pairs.select(
        "page_id", "block_idx",
        F.greatest("x0", "o_x0").alias("x0"), F.greatest("y0", "o_y0").alias("y0"),
        F.least("x1", "o_x1").alias("x1"), F.least("y1", "o_y1").alias("y1"),
    ).where("x0 < x1 and y0 < y1")
    covered = union_area(clipped, ["page_id", "block_idx"])
    return pictures.join(covered, ["page_id", "block_idx"]).where(
        (B.box().area > 0) & (F.col("area") / B.box().area >= share)
    ).select("page_id", "block_idx", "area")


def reading_order(boxes: DataFrame, out: str = "position") -> DataFrame:
    """By top, then left."""
    w = Window.partitionBy("page_id").orderBy("y0", "x0", "span_idx")
    return boxes.withColumn(out, F.row_number().over(w))


def tolerant_reading_order(boxes: DataFrame, tolerance: float = 10) -> DataFrame:
    """Sort by (top, left), then move each box left past boxes less than ``tolerance`` away in top that start
    further right, one after the other as an insertion.

    Boxes more than the tolerance below their predecessor never move up past it, so only runs of close tops
    are folded, each in its own array.
    """
    order = ["y0", "x0", "span_idx"]
    seen = scan(boxes, ["page_id"], order, {"__py": Scan("lag", F.col("y0"))})
    gap = F.col("__py").isNull() | (F.col("y0") - F.col("__py") >= tolerance)
    runs = islands(seen, ["page_id"], order, gap, "__run").groupBy("page_id", "__run").agg(
        F.sort_array(F.collect_list(F.struct("y0", "x0", "span_idx"))).alias("b")
    )

    def insert(acc: Column, new: Column) -> Column:
        # how many boxes at the end of acc the new one passes: up to the last it cannot pass
        stays = F.transform(acc, lambda o, i: F.when((F.abs(new["y0"] - o["y0"]) < tolerance) & (new["x0"] < o["x0"]), F.lit(0)).otherwise(i + 1))
        at = F.coalesce(F.array_max(stays), F.lit(0))
        return F.concat(F.slice(acc, F.lit(1), at), F.array(new), F.slice(acc, at + 1, F.size(acc)))

    empty = F.expr("filter(b, x -> false)")
    folded = runs.withColumn("b", F.aggregate("b", empty, insert))
    placed = folded.select("page_id", "__run", F.posexplode("b").alias("__i", "x"))
    w = Window.partitionBy("page_id").orderBy("__run", "__i")
    return placed.select("page_id", F.col("x.span_idx").alias("span_idx"), F.row_number().over(w).alias("position"))


def _widest_gap(df: DataFrame, lo: str, hi: str, out: str) -> DataFrame:
    """Per (page, path): the first widest empty stretch between sorted extents, as (gap, cut)."""
    seen = scan(df, ["page_id", "path"], [lo, hi, "span_idx"], {"__end": Scan("max", F.col(hi), inclusive=False)})
    gap = F.col(lo) - F.col("__end")
    best = F.min(F.when(gap > 0, F.struct((-gap).alias("g"), F.col(lo).alias("at"), ((F.col("__end") + F.col(lo)) / 2).alias("cut"))))
    return seen.groupBy("page_id", "path").agg(best.alias("b")).select(
        "page_id", "path", F.coalesce(-F.col("b.g"), F.lit(0)).cast("double").alias(f"{out}_gap"), F.col("b.cut").cast("double").alias(f"{out}_cut")
    )


#: Boxes of a page that ``xy_cut_order`` cuts in one task.
HELD_PAGE = 1024
#: Pairs of boxes that are compared at once there.
_PAIRS = 1 << 20


def xy_cut_order(boxes: DataFrame, beta: float = 2.0, min_gap: float = 5.0) -> DataFrame:
    """Recursive XY-cut reading order, one round of cuts for all pages and regions at a time.

    A region is split at its widest empty stretch (at least ``min_gap``; the wider direction, vertical on a
    tie), and boxes go to the side of their centre. When no vertical cut is found, boxes under a tenth of the
    region's width are ignored once. Rounds stop when no region splits. Boxes at least ``beta`` times the
    widest box that share a tenth of width with two others are held out and merged back by top.

    Pages of at most ``HELD_PAGE`` boxes are read once, in order, and the rounds run over the pages of an Arrow batch; larger pages, and pages with
    coordinates beyond 2^40 or no numbers, are cut in rounds of joins. Boxes without a page are left out.
    """
    valid = boxes.where(B.is_valid(B.box()) & F.col("page_id").isNotNull())
    sides = ("x0", "y0", "x1", "y1")
    plain = F.lit(all(boxes.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "double") for c in sides))
    for c in sides:
        plain = plain & (F.abs(F.col(c).cast("double")) <= 2.0**40)
    pages = valid.groupBy("page_id").agg(F.count("*").alias("n"), F.min(plain).alias("plain"))
    odd = pages.where(~F.col("plain") | (F.col("n") > HELD_PAGE)).select("page_id")
    if odd.isEmpty():
        return _cut_in_batches(valid, beta, min_gap)
    odd = written(odd)
    rounds = _cut_in_rounds(valid.join(odd, "page_id", "left_semi"), beta, min_gap)
    return _cut_in_batches(valid.join(odd, "page_id", "left_anti"), beta, min_gap).unionByName(rounds)


def _cut_in_batches(valid: DataFrame, beta: float, min_gap: float) -> DataFrame:
    """Reading order of pages that fit in a batch."""
    w = Window.partitionBy("page_id").orderBy("span_idx")
    rank = F.when(F.col("span_idx").isNull(), F.lit(0)).otherwise(F.dense_rank().over(w)).cast("long")
    ordered = valid.select(
        "page_id", "span_idx", F.row_number().over(w).alias("__nth"), rank.alias("__rank"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    )
    kinds = [f"{c} {valid.schema[c].dataType.simpleString()}" for c in ("page_id", "span_idx")]
    return ordered.mapInArrow(_cut_pages(beta, min_gap), f"{', '.join(kinds)}, position int")


def _cut_pages(beta: float, min_gap: float):
    def numbered(rows: pa.Table) -> pa.RecordBatch:
        page = np.cumsum(rows.column("__nth").to_numpy() == 1) - 1
        at, position = _page_positions(page, *[rows.column(c).to_numpy() for c in ("__rank", "x0", "y0", "x1", "y1")], beta, min_gap)
        out = rows.select(["page_id", "span_idx"]).take(pa.array(at)).append_column("position", pa.array(position, pa.int32())).combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in out.columns], out.column_names)

    def cut(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            starts = np.flatnonzero(rows.column("__nth").to_numpy() == 1)
            last = int(starts[-1]) if len(starts) else 0
            if last:
                yield numbered(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None and rest.num_rows:
            yield numbered(rest)

    return cut


def _running_max(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The highest value so far in each group, groups ascending."""
    ranked, rank = np.unique(value, return_inverse=True)
    return ranked[np.maximum.accumulate(group * len(ranked) + rank.ravel()) % len(ranked)] if len(value) else value


def _gaps(region: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n regions the first widest empty stretch between sorted extents, and its middle."""
    order = np.lexsort((hi, lo, region))
    region, lo = region[order], lo[order]
    end = np.r_[0.0, _running_max(region, hi[order])[:-1]] if len(order) else lo
    gap = np.where(np.r_[True, region[1:] != region[:-1]][: len(region)], 0.0, lo - end)
    best = np.lexsort((lo, -gap, region))
    first = best[np.r_[True, region[best][1:] != region[best][:-1]][: len(best)]]
    first = first[gap[first] > 0]
    width, cut = np.zeros(n), np.full(n, np.nan)
    width[region[first]], cut[region[first]] = gap[first], (end[first] + lo[first]) / 2
    return width, cut


def _page_positions(page, rank, x0, y0, x1, y1, beta: float, min_gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the boxes that have a position, and the position. Pages ascend; a rank of 0 is a box without a number."""
    n = np.bincount(page)
    starts = np.cumsum(n) - n
    wide = x1 - x0
    # boxes across the layout: those with a number that share a tenth of width with two of other numbers
    key = np.unique(page * (int(rank.max()) + 1) + rank, return_inverse=True)[1].ravel()
    across = np.flatnonzero((n[page] >= 3) & (wide >= beta * np.maximum.reduceat(wide, starts)[page]) & (rank > 0))
    near = np.zeros(len(page), np.int64)
    done = np.cumsum(n[page[across]])
    lo = 0
    while lo < len(across):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + _PAIRS, "right")))
        i = np.repeat(across[lo:hi], n[page[across[lo:hi]]])
        new = np.r_[True, i[1:] != i[:-1]]
        j = starts[page[i]] + np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        shared = np.maximum(0, np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j]))
        meets = (rank[j] > 0) & (rank[i] != rank[j]) & (shared / np.minimum(wide[i], wide[j]) >= 0.1)
        near += np.bincount(key[i[meets]], minlength=len(near))
        lo = hi
    held = across[near[key[across]] >= 2]
    out = np.zeros(len(page), bool)
    out[key[held]] = True
    main = np.flatnonzero(~out[key])
    # the rounds: a region is split in two, regions ascend by page and path
    region, open_ = page[main], np.ones(len(main), bool)
    while open_.any():
        at = np.flatnonzero(open_)
        box = main[at]
        ids, r = np.unique(region[at], return_inverse=True)
        r, k = r.ravel(), len(ids)
        size = np.bincount(r, minlength=k)
        left, right = np.full(k, np.inf), np.full(k, -np.inf)
        np.minimum.at(left, r, x0[box])
        np.maximum.at(right, r, x1[box])
        broad = wide[box] >= (right - left)[r] * 0.1
        broad_n = np.bincount(r[broad], minlength=k)
        h, h_cut = _gaps(r, y0[box], y1[box], k)
        v, v_cut = _gaps(r, x0[box], x1[box], k)
        f, f_cut = _gaps(r[broad], x0[box][broad], x1[box][broad], k)
        retry = (v < min_gap) & (size >= 3) & (broad_n >= 2) & (broad_n < size) & (f > v) & (f >= min_gap)
        v, v_cut = np.where(retry, f, v), np.where(retry, f_cut, v_cut)
        has_h, has_v = h >= min_gap, v >= min_gap
        rows = has_h & (~has_v | (h > v))
        cut = np.where((size > 1) & (has_h | has_v), np.where(rows, h_cut, v_cut), np.nan)
        first = np.where(rows[r], (y0[box] + y1[box]) / 2, (x0[box] + x1[box]) / 2) < cut[r]
        lower = np.bincount(r[first], minlength=k)
        splits = (lower > 0) & (lower < size) & ~np.isnan(cut)
        side = np.zeros(len(main), np.int64)
        side[at] = splits[r] & ~first
        open_[at] = splits[r]
        region = np.unique(region * 2 + side, return_inverse=True)[1].ravel()
    main = main[np.lexsort((rank[main], x0[main], y0[main], region))]
    place = np.arange(len(main))
    # held boxes go before the first main box whose running top reaches them
    top = np.r_[_running_max(page[main], y0[main]), y0[held]]
    at, own = np.r_[main, held], np.r_[np.ones(len(main)), np.zeros(len(held))]
    order = np.lexsort((rank[at], np.r_[0.0 * place, x0[held]], np.r_[place, 0 * held], own, top, page[at]))
    at = at[order]
    of = page[at]
    begin = np.maximum.accumulate(np.where(np.r_[True, of[1:] != of[:-1]][: len(of)], np.arange(len(of)), 0)) if len(of) else of
    return at, np.arange(len(of)) - begin + 1


def _cut_in_rounds(valid: DataFrame, beta: float, min_gap: float) -> DataFrame:
    """Reading order of pages of any size, by rounds of joins."""
    held = _cross_layout(valid, beta)
    rest = valid.join(held.select("page_id", "span_idx"), ["page_id", "span_idx"], "left_anti")
    open_ = checkpointed(rest.select("page_id", "span_idx", "x0", "y0", "x1", "y1").withColumn("path", F.lit("")))
    done = None
    while True:  # every split leaves smaller regions
        size = open_.groupBy("page_id", "path").agg(
            F.count("*").alias("n"), (F.max("x1") - F.min("x0")).alias("__w")
        )
        wide = open_.join(size, ["page_id", "path"]).where(B.box().width >= F.col("__w") * 0.1)
        wide_n = wide.groupBy("page_id", "path").agg(F.count("*").alias("wn"))
        cuts = (
            size.where("n > 1")
            .join(_widest_gap(open_, "y0", "y1", "h"), ["page_id", "path"])
            .join(_widest_gap(open_, "x0", "x1", "v"), ["page_id", "path"])
            .join(_widest_gap(wide, "x0", "x1", "f"), ["page_id", "path"], "left")
            .join(wide_n, ["page_id", "path"], "left")
        )
        retry = (
            (F.col("v_gap") < min_gap) & (F.col("n") >= 3) & (F.col("wn") >= 2) & (F.col("wn") < F.col("n"))
            & (F.col("f_gap") > F.col("v_gap")) & (F.col("f_gap") >= min_gap)
        )
        retry = F.coalesce(retry, F.lit(False))
        v_gap = F.when(retry, F.col("f_gap")).otherwise(F.col("v_gap"))
        v_cut = F.when(retry, F.col("f_cut")).otherwise(F.col("v_cut"))
        has_h, has_v = F.col("h_gap") >= min_gap, v_gap >= min_gap
        rule = cuts.where(has_h | has_v).select(
            "page_id", "path",
            (has_h & (~has_v | (F.col("h_gap") > v_gap))).alias("__rows"),
            F.when(has_h & (~has_v | (F.col("h_gap") > v_gap)), F.col("h_cut")).otherwise(v_cut).alias("__cut"),
        )
        tried = open_.join(rule, ["page_id", "path"], "left")
        centre = F.when(F.col("__rows"), B.box().center_y).otherwise(B.box().center_x)
        side = F.when(F.col("__cut").isNull(), "").when(centre < F.col("__cut"), "0").otherwise("1")
        # a cut that leaves one side empty ends the region
        split = tried.withColumn("__side", side)
        sides = split.groupBy("page_id", "path").agg((F.count_if(F.col("__side") == "0") * F.count_if(F.col("__side") == "1") > 0).alias("__ok"))
        moved = checkpointed(
            split.join(sides, ["page_id", "path"])
            .withColumn("path", F.when(F.col("__ok"), F.concat("path", "__side")).otherwise(F.col("path")))
            .select("page_id", "span_idx", "x0", "y0", "x1", "y1", "path", "__ok")
        )
        closed = moved.where("not __ok").drop("__ok")
        done = closed if done is None else done.unionAll(closed)
        open_ = moved.where("__ok").drop("__ok")
        if open_.isEmpty():
            break
    w = Window.partitionBy("page_id").orderBy("path", "y0", "x0", "span_idx")
    main = done.withColumn("position", F.row_number().over(w))
    return _merge_back(main, held)


def _cross_layout(boxes: DataFrame, beta: float) -> DataFrame:
    """Boxes at least ``beta`` times the widest box of their page, sharing a tenth of width with two others."""
    widths = boxes.groupBy("page_id").agg(F.max(B.box().width).alias("__max"), F.count("*").alias("__n"))
    wide = boxes.join(widths, "page_id").where((F.col("__n") >= 3) & (B.box().width >= F.lit(beta) * F.col("__max"))).drop("__max", "__n")
    other = boxes.select("page_id", F.col("span_idx").alias("o_idx"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = wide.join(other, "page_id").where(
        (F.col("span_idx") != F.col("o_idx")) & (B.x_overlap_in_smaller(B.box(), B.box("o_")) >= 0.1)
    )
    enough = pairs.groupBy("page_id", "span_idx").agg(F.count("*").alias("n")).where("n >= 2")
    return wide.join(enough, ["page_id", "span_idx"], "left_semi")


def _merge_back(main: DataFrame, held: DataFrame) -> DataFrame:
    """Ordered merge of held-out boxes: each goes before the first main box whose running top reaches it."""
    runtop = Window.partitionBy("page_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    left = main.select(
        "page_id", "span_idx", F.max("y0").over(runtop).alias("k"), F.lit(1).alias("s"),
        F.col("position").alias("a"), F.lit(0).cast("double").alias("b"),
    )
    right = held.select(
        "page_id", "span_idx", F.col("y0").alias("k"), F.lit(0).alias("s"), F.lit(0).alias("a"), F.col("x0").cast("double").alias("b")
    )
    w = Window.partitionBy("page_id").orderBy("k", "s", "a", "b", "span_idx")
    return left.unionByName(right).select("page_id", "span_idx", F.row_number().over(w).alias("position"))
