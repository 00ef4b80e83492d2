"""Captions and footnotes of visuals by geometry: fragments next to captions, clusters above tables, parents.

Blocks have doc_id, page_idx, block_idx, type, content, a box, and ``lines`` (number of lines, null = one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import boxes as B
from leafmill.functions.text import is_table_continuation
from leafmill.session import checkpointed, written

PAGE = ("doc_id", "page_idx")
KEYS = (*PAGE, "block_idx")
# Roles of block types.
FRAGMENTS = ("text", "footnote")
FURNITURE = ("header", "footer", "page_number", "page_footnote", "aside_text")
MAINS = {"image_body": "image", "image_block_body": "image", "chart_body": "chart", "table_body": "table", "code_body": "code"}
CHILDREN = ("caption", "footnote")


def _height(b: B.Box) -> Column:
    return F.greatest(b.height, F.lit(1))


def _max_gap(height: Column) -> Column:
    return F.greatest(F.lit(12), height * 1.5)


def _near_table(b: B.Box, t: B.Box) -> Column:
    slack = F.greatest(F.lit(12), F.greatest(t.width, F.lit(1)) * 0.03)
    return ~((b.x1 < t.x0 - slack) | (b.x0 > t.x1 + slack))


def inline_caption_fragments(blocks: DataFrame, mains: tuple[str, ...]) -> DataFrame:
    """A text or footnote between a caption and a visual, on the caption's line and close above the visual,
    becomes a caption."""
    effective = blocks.where(~F.col("type").isin(*FURNITURE))
    w = Window.partitionBy(*PAGE).orderBy("block_idx")
    neighbour = F.struct("type", "x0", "y0", "x1", "y1")
    seen = effective.withColumns({"__p": F.lag(neighbour).over(w), "__n": F.lead(neighbour).over(w)})
    cap, me, vis = B.box("__p."), B.box(), B.box("__n.")
    ch, th = _height(cap), _height(me)
    shared = F.least(cap.y1, me.y1) - F.greatest(cap.y0, me.y0)
    same_line = (shared / F.greatest(F.least(ch, th), F.lit(1)) >= 0.6) | (
        F.abs(cap.center_y - me.center_y) <= F.greatest(ch, th) * 0.5
    )
    gap = vis.y0 - F.greatest(cap.y1, me.y1)
    hit = (
        F.col("type").isin(*FRAGMENTS) & (F.col("__p.type") == "caption") & F.col("__n.type").isin(*mains)
        & same_line & (gap >= 0) & (gap <= _max_gap(F.greatest(ch, th)))
    )
    promoted = seen.withColumn("type", F.when(hit, "caption").otherwise(F.col("type"))).drop("__p", "__n")
    return promoted.unionByName(blocks.where(F.col("type").isin(*FURNITURE)))


def stacked_caption_fragments(blocks: DataFrame, tables: tuple[str, ...] = ("table", "table_body")) -> DataFrame:
    """Single-line fragments below the last caption of the cluster stacked right above a table become captions, table after table
    in the order of blocks: what one table has made a caption is one for the tables after it.

    The cluster walks up from the table while each block ends at most max(12, 1.5 × greatest height so far) above the next. Clusters
    do not depend on what is a caption, so they are found once. A table's promotions depend only on those of earlier tables:
    each round judges all tables by the round before, and settles at least one more table of a page; it ends when nothing changes.
    """
    t = blocks.where(F.col("type").isin(*tables)).select(
        *PAGE, F.col("block_idx").alias("t_idx"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")]
    )
    candidates = blocks.where(F.col("type").isin("caption", *FRAGMENTS)).join(t, list(PAGE)).where(
        (F.col("y1") <= F.col("t_y0")) & _near_table(B.box(), B.box("t_"))
    )
    w = Window.partitionBy(*PAGE, "t_idx").orderBy(F.col("y0").desc(), F.col("block_idx").desc())
    below = F.coalesce(F.lag("y0").over(w), F.col("t_y0"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    tallest = F.greatest(F.lit(1), F.max(_height(B.box())).over(upto))
    gap = below - F.col("y1")
    walked = candidates.withColumn("__bad", F.when((gap >= 0) & (gap <= _max_gap(tallest)), 0).otherwise(1))
    fragment = F.col("type").isin(*FRAGMENTS) & (F.coalesce("lines", F.lit(1)) <= 1)
    cluster = written(
        walked.withColumn("__out", F.sum("__bad").over(upto)).where("__out = 0")
        .select(*KEYS, "t_idx", F.row_number().over(w).alias("nth"), (F.col("type") == "caption").alias("caption"), fragment.alias("fragment"))
    )
    whole = Window.partitionBy(*PAGE, "t_idx")
    promoted = cluster.select(*KEYS, F.col("t_idx").alias("by")).limit(0)
    while True:
        told = cluster.join(promoted, list(KEYS), "left")
        lowest = F.min(F.when(F.col("caption") | (F.col("by") < F.col("t_idx")), F.col("nth"))).over(whole)
        hits = told.withColumn("__c", lowest).where(F.col("fragment") & (F.col("nth") < F.col("__c")))
        now = written(hits.groupBy(*KEYS).agg(F.min("t_idx").alias("by")))
        changed = now.exceptAll(promoted).limit(1).unionAll(promoted.exceptAll(now).limit(1))
        promoted, settled = now, changed.isEmpty()
        if settled:
            return _promote(blocks, promoted.select(*KEYS, F.lit(True).alias("__hit")))


def _promote(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    joined = blocks.join(hits, list(KEYS), "left")
    return joined.withColumn("type", F.when(F.col("__hit"), "caption").otherwise(F.col("type"))).drop("__hit")


def leading_continuations(blocks: DataFrame, tables: tuple[str, ...] = ("table", "table_body")) -> DataFrame:
    """Single-line "continued" texts that open a page right above a table become captions."""
    effective = blocks.where(~F.col("type").isin(*FURNITURE))
    w = Window.partitionBy(*PAGE).orderBy("block_idx")
    leads = (
        F.col("type").isin(*FRAGMENTS) & (F.coalesce("lines", F.lit(1)) <= 1) & is_table_continuation(F.col("content"))
    )
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    box = F.struct("x0", "y0", "x1", "y1")
    marked = effective.withColumn("__lead", leads)
    marked = marked.withColumns(
        {"__ok": F.min("__lead").over(upto), "__ny": F.lead("y0").over(w)}
    )
    whole = Window.partitionBy(*PAGE)
    # the first block after the leading run
    follower = F.min(F.when(~F.col("__ok"), F.struct("block_idx", F.col("type").alias("t"), box.alias("b")))).over(whole)
    run = marked.withColumn("__f", follower).where(F.col("__ok") & F.col("__f.t").isin(*tables))
    after = w.rowsBetween(0, Window.unboundedFollowing)
    me, table = B.box(), B.box("__f.b.")
    tallest = F.max(_height(me)).over(after)
    gap = F.col("__ny") - me.y1
    fits = (gap <= _max_gap(tallest)) & (gap >= -F.greatest(F.lit(2), _height(me) * 0.3)) & _near_table(me, table)
    good = run.withColumn("__fits", fits).withColumn("__all", F.min("__fits").over(whole)).where("__all")
    return _promote(blocks, good.select(*KEYS).withColumn("__hit", F.lit(True)))


def _pair_valid(pairs: DataFrame, blockers: DataFrame) -> DataFrame:
    """Child–visual pairs no block in between forbids.

    A block between them in reading order is harmless when it is of an allowed kind, or lies outside the
    vertical gap between the two without touching either. Pairs with nothing else in between (a difference of
    running counts) pass at once; only the others look at their blockers.
    """
    gap_top, gap_bottom = F.least("y1", "m_y1"), F.greatest("y0", "m_y0")
    has_gap = (F.col("y1") <= F.col("m_y0")) | (F.col("m_y1") <= F.col("y0"))
    free = pairs.where("hard = 0")
    checked = pairs.where((F.col("hard") > 0) & has_gap)
    other = blockers.select(
        *PAGE, F.col("pos").alias("b_pos"), F.col("type").alias("b_type"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]
    )
    between = (F.col("b_pos") > F.least("pos", "m_pos")) & (F.col("b_pos") < F.greatest("pos", "m_pos"))
    allowed = (F.col("b_type") == "caption") | ((F.col("type") == "footnote") & (F.col("b_type") == "footnote"))
    b = B.box("b_")
    harmful = (
        B.intersects(b, B.box()) | B.intersects(b, B.box("m_")) | ((b.y0 < gap_bottom) & (b.y1 > gap_top))
    )
    blocked = checked.join(other, list(PAGE)).where(between & ~allowed & harmful).select(*KEYS, "m_idx").distinct()
    return free.unionByName(checked.join(blocked, [*KEYS, "m_idx"], "left_anti"))


def visual_parents(blocks: DataFrame) -> DataFrame:
    """Captions and footnotes with ``parent_idx``: the nearest visual that is their neighbour.

    Distance counts positions in between except blocks of the child's own kind and grows with every further
    visual on a side, so the nearest visual before and after are tried first; only children left without one
    look further on their page. Ties: edge distance when it differs by more than 2; a caption between tables
    takes the later, a footnote the earlier, anything else the closer centre.
    """
    relation = blocks.where(~((F.col("type") == "list") & (F.trim(F.coalesce("content", F.lit(""))) == "")))
    w = Window.partitionBy(*PAGE).orderBy("block_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def running(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).over(upto)

    kind = F.col("type")
    main = kind.isin(*MAINS)
    # children, visuals and blockers all come from this table
    placed = relation.withColumns(
        {
            "pos": F.row_number().over(w),
            "n_cap": running(kind == "caption"), "n_foot": running(kind == "footnote"),
        }
    )
    placed = checkpointed(placed)
    me = F.struct(
        F.col("block_idx").alias("m_idx"), F.col("pos").alias("m_pos"), F.col("n_cap").alias("m_cap"), F.col("n_foot").alias("m_foot"),
        kind.alias("m_type"), *[F.col(c).alias(f"m_{c}") for c in ("x0", "y0", "x1", "y1")],
    )
    after = w.rowsBetween(1, Window.unboundedFollowing)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    children = placed.withColumns(
        {
            "__p": F.last(F.when(main, me), ignorenulls=True).over(before),
            "__n": F.first(F.when(main, me), ignorenulls=True).over(after),
        }
    ).where(kind.isin(*CHILDREN))

    def measured(pairs: DataFrame) -> DataFrame:
        inside = F.abs(F.col("pos") - F.col("m_pos")) - 1
        # children strictly between: running counts include the child itself when it comes first
        first = F.col("pos") < F.col("m_pos")

        def between(c: str, own: Column) -> Column:
            return F.when(first, F.col(f"m_{c}") - F.col(f"n_{c}")).otherwise(F.col(f"n_{c}") - F.col(f"m_{c}") - F.when(own, 1).otherwise(0))

        caps = between("cap", F.col("type") == "caption")
        feet = between("foot", F.col("type") == "footnote")
        is_cap = F.col("type") == "caption"
        return pairs.withColumns(
            {
                "hard": inside - caps - F.when(is_cap, 0).otherwise(feet),
                "diff": inside + 1 - F.when(is_cap, caps).otherwise(feet),
            }
        ).where(~((F.col("type") == "footnote") & (F.col("block_idx") < F.col("m_idx"))))

    plain = [c for c in children.columns if c not in ("__p", "__n")]
    nearest = children.select(*plain, F.explode(F.array_compact(F.array("__p", "__n"))).alias("m")).select(*plain, "m.*")
    nearest = checkpointed(nearest)
    one = checkpointed(_pair_valid(measured(nearest), placed))
    # a side whose nearest visual is blocked may still have a farther one that is not
    sides = one.select(*KEYS, (F.col("m_idx") > F.col("block_idx")).alias("__later")).distinct()
    tried = nearest.select(*KEYS, (F.col("m_idx") > F.col("block_idx")).alias("__later"), F.col("m_idx").alias("__tried"))
    open_sides = tried.join(sides, [*KEYS, "__later"], "left_anti")
    mains = placed.where(main).select(*PAGE, me.alias("m")).select(*PAGE, "m.*")
    farther = (
        children.select(*plain).join(open_sides, list(KEYS)).join(mains, list(PAGE))
        .where(((F.col("m_idx") > F.col("block_idx")) == F.col("__later")) & (F.abs(F.col("m_idx") - F.col("block_idx")) > F.abs(F.col("__tried") - F.col("block_idx"))))
        .drop("__later", "__tried")
    )
    two = _pair_valid(measured(farther), placed)
    valid = one.unionByName(two)
    child = Window.partitionBy(*KEYS)
    edge, centre = B.edge_distance(B.box(), B.box("m_")), B.center_distance(B.box(), B.box("m_"))
    tied = valid.withColumn("__min", F.min("diff").over(child)).where("diff = __min").withColumns({"__e": edge, "__c": centre})
    tied = tied.withColumns(
        {
            "__spread": F.max("__e").over(child) - F.min("__e").over(child),
            "__tables": F.min(F.col("m_type") == "table_body").over(child),
        }
    )
    key = (
        F.when(F.col("__spread") > 2, F.col("__e"))
        .when((F.col("type") == "caption") & F.col("__tables"), -F.col("m_idx").cast("double"))
        .when(F.col("type") == "footnote", F.col("m_idx").cast("double"))
        .otherwise(F.col("__c"))
    )
    best = tied.groupBy(*KEYS).agg(F.min(F.struct(key.alias("k"), F.col("m_idx").alias("i")))["i"].alias("parent_idx"))
    return best


def regroup_visuals(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visuals with their children (type, block_idx, content) in block order, and the children left over."""
    parents = visual_parents(blocks)
    children = blocks.where(F.col("type").isin(*CHILDREN)).join(parents, list(KEYS), "left")
    taken = children.where("parent_idx is not null").groupBy(*PAGE, F.col("parent_idx").alias("block_idx")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("block_idx").alias("child_idx"), "type", "content"))).alias("children")
    )
    visual = F.lit(None).cast("string")
    for raw, name in MAINS.items():
        visual = F.when(F.col("type") == raw, name).otherwise(visual)
    mains = blocks.where(F.col("type").isin(*MAINS)).withColumn("visual", visual)
    return mains.join(taken, list(KEYS), "left"), children.where("parent_idx is null").drop("parent_idx")
