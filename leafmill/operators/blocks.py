"""Blocks of document pages: routing, captions, numbering, lists, anchors and page assembly.

A blocks table has doc_id, page_idx, block_idx, type, content and, where present, level, numbered, anchor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import boxes as B
from leafmill.functions import text as X
from leafmill.operators.ordered import Scan, islands, scan
from leafmill.session import checkpointed

PAGE = ("doc_id", "page_idx")
VISUALS = ("table", "image", "chart")
# What a caption directly after a visual starts with.
CAPTION_STARTS = {"table": ("表", "table"), "image": ("图", "fig"), "chart": ("图", "fig", "chart")}
# Block vocabulary.
BODY_TYPES = {"image": "image_body", "table": "table_body", "chart": "chart_body", "equation": "interline_equation"}
TEXTUAL = ("text", "title", "image_caption", "table_caption", "chart_caption", "header", "footer", "page_footnote")
NESTED = ("list", "index")
FURNITURE = ("header", "footer", "page_number", "aside_text", "page_footnote")


def promote_captions(blocks: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Text directly after a visual that starts like its caption becomes ``caption``."""
    seen = scan(blocks, PAGE, ["block_idx"], {"__prev": Scan("lag", F.col("type"))}, "block_idx", slice_rows)
    text = F.lower(F.trim(F.col("content"), F.lit(" \t\r\n")))
    starts = F.lit(False)
    for visual, prefixes in CAPTION_STARTS.items():
        for p in prefixes:
            starts = starts | ((F.col("__prev") == visual) & text.startswith(p))
    is_caption = (F.col("type") == "text") & F.coalesce(starts, F.lit(False))
    return seen.withColumn("type", F.when(is_caption, "caption").otherwise(F.col("type"))).drop("__prev")


def type_captions(blocks: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """``caption`` takes the kind of the visual before it, else after it, through captions only; else text."""
    other = F.when(F.col("type") != "caption", F.col("type"))
    seen = scan(
        blocks, PAGE, ["block_idx"],
        {"__before": Scan("last", other), "__after": Scan("next", other)},
        "block_idx", slice_rows,
    )

    def visual(c: str) -> Column:
        return F.when(F.col(c).isin(*VISUALS), F.concat(F.col(c), F.lit("_caption")))

    kind = F.coalesce(visual("__before"), visual("__after"), F.lit("text"))
    return seen.withColumn("type", F.when(F.col("type") == "caption", kind).otherwise(F.col("type"))).drop(
        "__before", "__after"
    )


def classify_captions(blocks: DataFrame, slice_rows: int | None = None) -> DataFrame:
    return type_captions(promote_captions(blocks, slice_rows), slice_rows)


def route_blocks(blocks: DataFrame) -> DataFrame:
    """Drop empty blocks (not charts) and unknown types, name bodies, and mark page furniture ``discarded``."""
    kind = F.col("type")
    body = kind
    for raw, name in BODY_TYPES.items():
        body = F.when(kind == raw, F.lit(name)).otherwise(body)
    known = kind.isin(*TEXTUAL, *BODY_TYPES, *NESTED)
    filled = (F.coalesce(F.col("content"), F.lit("")) != "") | (kind == "chart")
    return blocks.where(known & filled).withColumns(
        {"type": body, "discarded": kind.isin(*FURNITURE)}
    )


def nearest_owner_by_index(
    blocks: DataFrame,
    owner: Column,
    member: Column,
    member_kind: str = "object",
    with_boxes: bool = True,
    group: Sequence[str] = PAGE,
    slice_rows: int | None = None,
    keep_rest: bool = False,
) -> DataFrame:
    """Members with ``owner_idx``: the owner at the smallest index distance, other members not counted.

    That distance grows strictly with every further owner on a side, so only the nearest owner on each side
    can win and two ordered scans replace a join. Ties: edge distance when it differs by more than 2; else a
    table caption takes the later owner, a footnote the earlier, anything else the closer centre. Without
    boxes the earlier owner wins. Members without any owner on the page are left out, and so are other rows
    unless ``keep_rest`` (they get a null owner).
    """
    here = F.struct("block_idx", *(["x0", "y0", "x1", "y1"] if with_boxes else []))
    count = F.when(member, F.lit(1)).otherwise(F.lit(0)).cast("long")
    marked = blocks.withColumns({"__owner": F.when(owner, here), "__member": member})
    counted = scan(marked, group, ["block_idx"], {"__seen": Scan("sum", count)}, "block_idx", slice_rows)
    owner_state = F.when(F.col("__owner").isNotNull(), F.struct(F.col("__owner").alias("o"), F.col("__seen").alias("n")))
    found = scan(
        counted, group, ["block_idx"],
        {"__p": Scan("last", owner_state, False), "__n": Scan("next", owner_state, False)},
        "block_idx", slice_rows,
    )
    idx = F.col("block_idx")
    # members strictly between: before the member, or up to the later owner
    cost_before = idx - F.col("__p.o.block_idx") - (F.col("__seen") - 1 - F.col("__p.n"))
    cost_after = F.col("__n.o.block_idx") - idx - (F.col("__n.n") - F.col("__seen"))
    before, after = F.col("__p.o.block_idx"), F.col("__n.o.block_idx")
    if with_boxes:
        me, p, n = B.box(), B.box("__p.o."), B.box("__n.o.")
        edge_p, edge_n = B.edge_distance(me, p), B.edge_distance(me, n)
        if member_kind == "table_caption":
            close = after
        elif member_kind.endswith("footnote"):
            close = before
        else:
            close = F.when(B.center_distance(me, p) <= B.center_distance(me, n), before).otherwise(after)
        tie = F.when(F.abs(edge_p - edge_n) > 2, F.when(edge_p < edge_n, before).otherwise(after)).otherwise(close)
    else:
        tie = before
    chosen = (
        F.when(before.isNull(), after)
        .when(after.isNull(), before)
        .when(cost_before < cost_after, before)
        .when(cost_after < cost_before, after)
        .otherwise(tie)
    )
    out = found.withColumn("owner_idx", F.when(F.col("__member"), chosen)).drop(
        "__owner", "__member", "__seen", "__p", "__n"
    )
    return out if keep_rest else out.where("owner_idx is not null")


def contiguous_captions(members: DataFrame, group: Sequence[str] = PAGE) -> DataFrame:
    """Add ``kept``: walking down from the last caption of an owner, steps of 1 or only over the owner."""
    w = Window.partitionBy(*group, "owner_idx").orderBy(F.col("block_idx").desc())
    following = F.lag("block_idx").over(w)
    step = following - F.col("block_idx")
    over_owner = (step == 2) & (F.col("owner_idx") == F.col("block_idx") + 1)
    breaks = F.when(following.isNotNull() & ~((step == 1) | over_owner), 1).otherwise(0)
    flagged = members.withColumn("__break", breaks)
    return flagged.withColumn("kept", F.sum("__break").over(w) == 0).drop("__break")


def attach_captions(routed: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Routed blocks with ``owner_idx``: bodies own themselves, kept captions point to their body, and
    captions left over turn into text. One scan serves all kinds of visuals."""
    is_body = F.col("type").isin(*[f"{v}_body" for v in VISUALS])
    is_caption = F.col("type").isin(*[f"{v}_caption" for v in VISUALS])
    kind = F.when(is_body | is_caption, F.regexp_replace("type", "_(body|caption)$", "")).otherwise("")
    group = [*PAGE, "__kind"]
    owned = nearest_owner_by_index(
        routed.withColumn("__kind", kind), is_body, is_caption, "caption", False, group, slice_rows, keep_rest=True
    )
    kept = contiguous_captions(owned, group)
    owner = F.when(is_body, F.col("block_idx")).when(is_caption & F.col("kept"), F.col("owner_idx"))
    attached = kept.withColumn("owner_idx", owner)
    left_over = is_caption & F.col("owner_idx").isNull()
    return attached.withColumn("type", F.when(left_over, "text").otherwise(F.col("type"))).drop("__kind", "kept")


def two_layer_blocks(attached: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per top-level block; a visual takes its captions as arrays in block order: ``captions`` (raw
    content) and ``caption_<c>`` for every further column in ``carry``."""
    child = F.col("owner_idx").isNotNull() & (F.col("owner_idx") != F.col("block_idx"))
    own = [c for c in attached.columns if c not in (*PAGE, "owner_idx")]
    caption = F.when(child, F.struct("block_idx", "content", *carry))
    grouped = (
        attached.withColumn("__top", F.coalesce("owner_idx", "block_idx"))
        .groupBy(*PAGE, "__top")
        .agg(
            F.first(F.when(~child, F.struct(*own)), ignorenulls=True).alias("b"),
            F.array_sort(F.collect_list(caption)).alias("m"),
        )
    )
    return grouped.select(
        *PAGE,
        "b.*",
        F.col("m.content").alias("captions"),
        *[F.col(f"m.{c}").alias(f"caption_{c}") for c in carry],
    )


def section_numbers(
    blocks: DataFrame, max_level: int | None = None, is_title: Column | None = None, slice_rows: int | None = None
) -> DataFrame:
    """Add ``section_number`` to titles of numbered style (all rows are titles unless ``is_title`` says).

    Per level the counter is a running value with three events: a reset (a shallower title, or a title whose
    text brings its own number), +1 (a numbered title of the level), and "at least 1" (a deeper numbered
    title). "At least 1" only acts right after a reset to 0, so every counter is a difference of running sums.
    """
    order = ["page_idx", "block_idx"]
    group = ["doc_id"]
    title = F.lit(True) if is_title is None else is_title
    if max_level is None:
        max_level = blocks.where(title).agg(F.max("level")).first()[0] or 1
    numbered = title & F.coalesce(F.col("numbered"), F.lit(False))
    parts = F.when(title & ~numbered, X.section_parts_at(F.col("content"), F.col("level")))
    levels = range(1, max_level + 1)
    level, event = F.col("level"), F.col("__num") | F.col("__parts").isNotNull()

    def reset_to(k: int) -> Column:
        own = F.when(~F.col("__num"), F.get("__parts", F.lit(k - 1)))
        return F.when(event, F.when(level < k, F.lit(0).cast("long")).otherwise(own))

    work = blocks.withColumns({"__num": numbered, "__parts": parts})
    first = scan(
        work.withColumns({f"__r{k}": reset_to(k) for k in levels}), group, order,
        {
            **{f"__base{k}": Scan("last", F.col(f"__r{k}")) for k in levels},
            **{f"__after{k}": Scan("last", F.when(event, F.col(f"__r{k}").isNotNull()), False) for k in levels},
        },
        "page_idx", slice_rows,
    )

    def step(k: int) -> Column:
        base = F.coalesce(F.col(f"__base{k}"), F.lit(0))
        fresh = F.coalesce(F.col(f"__after{k}"), F.lit(True))
        live = F.col("__num") & F.col(f"__r{k}").isNull()
        plus = live & (level == k)
        raised = live & (level > k) & fresh & (base == 0)
        return F.when(plus | raised, 1).otherwise(0).cast("long")

    second = scan(first, group, order, {f"__s{k}": Scan("sum", step(k)) for k in levels}, "page_idx", slice_rows)
    third = scan(
        second, group, order,
        {f"__at{k}": Scan("last", F.when(F.col(f"__r{k}").isNotNull(), F.col(f"__s{k}"))) for k in levels},
        "page_idx", slice_rows,
    )
    counters = F.array(
        *[
            (F.coalesce(F.col(f"__base{k}"), F.lit(0)) + F.col(f"__s{k}") - F.coalesce(F.col(f"__at{k}"), F.lit(0))).cast("string")
            for k in levels
        ]
    )
    number = F.array_join(F.slice(counters, F.lit(1), level.cast("int")), ".")
    return third.select(*blocks.columns, F.when(F.col("__num"), number).alias("section_number"))


def flatten_lists(items: DataFrame) -> DataFrame:
    """List items as prefixed lines.

    Items have list_id (the root), node_id (the nested list they sit in), item_idx (order in the root),
    ilevel, root_ilevel, attribute, start, text. Empty items vanish without taking a number.
    """
    filled = items.where(F.trim("text", F.lit(" \t\r\n")) != "")
    w = Window.partitionBy("list_id", "node_id").orderBy("item_idx")
    number = F.coalesce(F.col("start"), F.lit(1)) + F.row_number().over(w) - 1
    depth = F.greatest(F.coalesce(F.col("ilevel"), F.lit(0)) - F.coalesce(F.col("root_ilevel"), F.lit(0)), F.lit(0))
    mark = F.when(F.col("attribute") == "ordered", F.concat(number.cast("string"), F.lit("."))).otherwise(F.lit("-"))
    return filled.withColumn("prefix", F.concat(F.repeat(F.lit("    "), depth.cast("int")), mark)).withColumn(
        "line", F.concat_ws(" ", "prefix", "text")
    )


def explode_list_tree(lists: DataFrame) -> DataFrame:
    """Nested list JSON (``list_id``, ``tree``) to flat rows, of any depth: one level a round, until no list is open.

    A node is ``{attribute, ilevel, start, content: [{type: text, content} | {type: list, …}]}``; item_idx is the path of
    positions, so it sorts in reading order.
    """
    path = F.array().cast("array<int>")
    level = lists.select("list_id", F.col("tree").alias("node"), path.alias("node_id"))
    out = None
    while True:
        node = F.from_json("node", "attribute string, ilevel int, start int, content array<string>")
        opened = level.withColumn("n", node)
        children = checkpointed(opened.select(
            "list_id", "node_id",
            F.coalesce("n.attribute", F.lit("unordered")).alias("attribute"),
            F.coalesce("n.ilevel", F.lit(0)).alias("ilevel"),
            F.col("n.start").alias("start"),
            F.posexplode("n.content").alias("pos", "child"),
        ).withColumn("item_idx", F.concat("node_id", F.array("pos"))).withColumn("kind", F.get_json_object("child", "$.type")))
        texts = children.where("kind = 'text'").select(
            "list_id", "node_id", "item_idx", "attribute", "ilevel", "start",
            F.get_json_object("child", "$.content").alias("text"), F.get_json_object("child", "$.anchor").alias("anchor"),
        )
        out = texts if out is None else out.unionAll(texts)
        level = children.where("kind in ('list', 'index')").select(
            "list_id", F.col("child").alias("node"), F.col("item_idx").alias("node_id")
        )
        if level.isEmpty():
            return out


def list_tree(rows: DataFrame) -> DataFrame:
    """The way back: (list_id, tree) from rows as ``explode_list_tree`` gives them, the deepest lists folded first.

    A list stands where its node_id says among its parent's items. Lists in which no text stands anywhere are lost.
    """
    item = F.struct(F.col("item_idx").alias("at"), F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("content"), "anchor")).alias("json"))
    heads = rows.groupBy("list_id", "node_id").agg(F.first("attribute").alias("attribute"), F.first("ilevel").alias("ilevel"), F.first("start").alias("start"))
    # nodes without texts of their own still stand between their children and the root
    above = heads.select("list_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("node_id")), lambda n: F.slice("node_id", F.lit(1), n))).alias("node_id")).distinct()
    nodes = checkpointed(above.join(heads, ["list_id", "node_id"], "left").withColumn("depth", F.size("node_id")))
    items = checkpointed(rows.select("list_id", "node_id", item.alias("i")))
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    for d in range(depth, -1, -1):
        folded = items.where(F.size("node_id") == d).groupBy("list_id", "node_id").agg(F.sort_array(F.collect_list("i"))["json"].alias("content"))
        head = F.to_json(F.struct(F.lit("list").alias("type"), F.coalesce("attribute", F.lit("unordered")).alias("attribute"), F.coalesce("ilevel", F.lit(0)).alias("ilevel"), "start"))
        open_head = F.regexp_replace(head, r"\}$", "")
        made = nodes.where(F.col("depth") == d).join(folded, ["list_id", "node_id"]).select(
            "list_id", "node_id", F.concat(open_head, F.lit(',"content":['), F.array_join("content", ","), F.lit("]}")).alias("json")
        )
        if d == 0:
            return made.select("list_id", F.col("json").alias("tree"))
        up = made.select("list_id", F.slice("node_id", F.lit(1), F.size("node_id") - 1).alias("node_id"), F.struct(F.col("node_id").alias("at"), "json").alias("i"))
        items = checkpointed(items.where(F.size("node_id") < d).unionByName(up))


def validate_anchors(entries: DataFrame, body: DataFrame) -> DataFrame:
    """Null the ``anchor`` of table-of-contents entries that no body block of the document carries.

    Documents without any body anchor keep their entries as they are.
    """
    valid = body.select("doc_id", F.trim("anchor").alias("__t")).where("__t <> ''").distinct()
    documents = valid.select("doc_id").distinct().withColumn("__any", F.lit(True))
    joined = (
        entries.withColumn("__t", F.trim("anchor"))
        .join(valid.withColumn("__hit", F.lit(True)), ["doc_id", "__t"], "left")
        .join(documents, "doc_id", "left")
    )
    kept = F.when(F.col("__any").isNull(), F.col("anchor")).when(F.col("__hit"), F.col("__t"))
    return joined.withColumn("anchor", kept).select(*entries.columns)


def header_footer_texts(parts: DataFrame) -> DataFrame:
    """Header and footer texts per section: parts joined by a blank, digits-only and empty ones dropped,
    the first of equal texts kept. Parts have doc_id, section, kind, story_idx, part_idx, content."""
    joined = (
        parts.where(F.coalesce("content", F.lit("")) != "")
        .groupBy("doc_id", "section", "kind", "story_idx")
        .agg(F.sort_array(F.collect_list(F.struct("part_idx", "content"))).alias("p"))
        .select("doc_id", "section", "kind", "story_idx", F.array_join(F.transform("p", lambda x: x["content"]), " ").alias("text"))
        .where((F.col("text") != "") & ~F.col("text").rlike(r"^\d+\z"))
    )
    w = Window.partitionBy("doc_id", "section", "kind", "text").orderBy("story_idx")
    return joined.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def assemble_pages(*kinds: DataFrame) -> DataFrame:
    """Union of block kinds with ``position``: reading order inside the document."""
    everything = kinds[0]
    for k in kinds[1:]:
        everything = everything.unionByName(k, allowMissingColumns=True)
    w = Window.partitionBy(*PAGE).orderBy("block_idx")
    return everything.withColumn("position", F.row_number().over(w))


def heading_lists(items: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """(doc_id, numid) of lists used as headings: body content between their items, and several indents.

    Items are body elements in order: doc_id, seq, numid (null for content), ilevel.
    """
    content = F.when(F.col("numid").isNull(), 1).otherwise(0).cast("long")
    counted = scan(items, ["doc_id"], ["seq"], {"__c": Scan("sum", content)}, "seq", slice_rows).where("numid is not null")
    # content between two neighbouring items of a list <=> the running count differs between its first and last item
    return (
        counted.groupBy("doc_id", "numid")
        .agg(F.min("__c").alias("lo"), F.max("__c").alias("hi"), F.min("ilevel").alias("l0"), F.max("ilevel").alias("l1"))
        .where("hi > lo and l1 > l0")
        .select("doc_id", "numid")
    )


def promote_titles(blocks: DataFrame) -> DataFrame:
    """Slide text with the largest bold size becomes a level-2 title, the next bold size level 3.

    Blocks have doc_id, page_idx, block_idx, type, font_size, bold. Level 2: that size is used once, is at
    least 4 above the body size (most common size of plain text) and 2 above the next bold size. Level 3
    needs a level 2, at least 2 above body and 2 below level 2.
    """
    sized = blocks.where("type = 'text' and font_size is not null")
    plain_counts = sized.where("not bold").groupBy(*PAGE, "font_size").agg(F.count("*").alias("n"))
    body = plain_counts.groupBy(*PAGE).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("font_size").alias("s")))["s"].alias("body")
    )
    bold_counts = sized.where("bold").groupBy(*PAGE, "font_size").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*PAGE).orderBy(F.col("font_size").desc())
    ranked = bold_counts.withColumn("r", F.row_number().over(w)).where("r <= 2")
    top = ranked.groupBy(*PAGE).agg(
        F.max(F.when(F.col("r") == 1, F.col("font_size"))).alias("s1"),
        F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n1"),
        F.max(F.when(F.col("r") == 2, F.col("font_size"))).alias("s2"),
    )
    rules = top.join(body, list(PAGE), "left").withColumn(
        "two",
        (F.col("n1") == 1)
        & (F.col("body").isNull() | (F.col("s1") >= F.col("body") + 4))
        & (F.col("s2").isNull() | (F.col("s1") >= F.col("s2") + 2)),
    )
    three = F.col("two") & F.coalesce(
        (F.col("s2") >= F.col("body") + 2) & (F.col("s1") >= F.col("s2") + 2), F.lit(False)
    )
    rules = rules.select(*PAGE, F.when(F.col("two"), F.col("s1")).alias("__two"), F.when(three, F.col("s2")).alias("__three"))
    candidate = (F.col("type") == "text") & F.col("bold")
    level = (
        F.when(candidate & (F.col("font_size") == F.col("__two")), 2)
        .when(candidate & (F.col("font_size") == F.col("__three")), 3)
    )
    return (
        blocks.join(rules, list(PAGE), "left")
        .withColumn("level", level)
        .withColumn("type", F.when(F.col("level").isNotNull(), "title").otherwise(F.col("type")))
        .drop("__two", "__three")
    )


def title_groups(titles: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """``title_group``: paragraph titles between two document titles share a number."""
    return islands(
        titles, ["doc_id"], ["page_idx", "block_idx"], F.col("type") == "doc_title", "title_group", "page_idx", slice_rows
    )


def apply_title_levels(titles: DataFrame, levels: DataFrame) -> DataFrame:
    """Document titles are level 1; paragraph titles take the supplied level, where level 1 becomes 2."""
    keys = [*PAGE, "block_idx"]
    given = levels.select(*keys, F.col("level").alias("__given"))
    level = F.when(F.col("type") == "doc_title", 1).otherwise(F.when(F.col("__given") == 1, 2).otherwise(F.col("__given")))
    return titles.join(given, keys, "left").withColumn("level", level).drop("__given")


def synchronise_titles(target: DataFrame, source: DataFrame) -> DataFrame:
    """Copy type and level of titles to blocks of another table with the same index, else same box and text."""
    by_index = source.where("block_idx is not null").select(
        *PAGE, "block_idx", F.struct("type", "level").alias("__i")
    )
    box = ["x0", "y0", "x1", "y1", "content"]
    w = Window.partitionBy(*PAGE, *box).orderBy("block_idx")
    by_box = (
        source.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
        .select(*PAGE, *box, F.struct("type", "level").alias("__b"))
    )
    found = F.coalesce(F.col("__i"), F.when(F.col("block_idx").isNull(), F.col("__b")))
    return (
        target.join(by_index, [*PAGE, "block_idx"], "left")
        .join(by_box, [*PAGE, *box], "left")
        .withColumn("__f", found)
        .withColumns({"type": F.coalesce("__f.type", "type"), "level": F.coalesce("__f.level", "level")})
        .drop("__i", "__b", "__f")
    )


def title_line_height(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """``line_height`` of a title: the stored value, else the mean of its lines' positive whole heights, else
    the block height."""
    keys = [*PAGE, "block_idx"]
    height = F.col("y1") - F.col("y0")
    means = lines.where(height > 0).groupBy(*keys).agg(F.avg(F.floor(height)).alias("__avg"))
    own = F.greatest(F.floor(F.col("y1") - F.col("y0")), F.lit(0)).cast("double")
    stored = F.when(F.col("stored_height") > 0, F.col("stored_height")).cast("double")
    return (
        titles.join(means, keys, "left")
        .withColumn("line_height", F.coalesce(stored, F.col("__avg"), own))
        .drop("__avg")
    )
