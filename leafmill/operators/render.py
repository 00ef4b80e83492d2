"""Routed, numbered, captioned blocks to Markdown and content lists.

Blocks are rows of ``two_layer_blocks(with_inline(...), carry=["inline", "inline_spans"])``: doc_id, page_idx,
block_idx, type, content, inline, inline_spans, captions, caption_inline, caption_inline_spans, discarded;
``level``, ``numbered``, ``section_number``, ``anchor``, ``image_path`` and ``list_items`` are used when present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import inline as I
from leafmill.functions import text as X
from leafmill.session import where_computed

BODY_ONLY = ("image_body", "table_body", "chart_body")
VISUAL_MODES = ("mm_markdown", "nlp_markdown")


def _optional(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _media_path(folder: str, path: Column) -> Column:
    prefixed = F.concat(F.lit(f"{folder}/"), path) if folder else path
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).otherwise(prefixed)


def with_inline(attached: DataFrame) -> DataFrame:
    """Render every row's inline text once, before captions are folded into their visuals."""
    return I.with_inline_markdown(attached)


def with_text(blocks: DataFrame) -> DataFrame:
    """Add ``text``: the block's Markdown text, titles with their number."""
    kind = F.col("type")
    number = _optional(blocks, "section_number", "string")
    title = F.concat(F.when(number.isNotNull(), F.concat(number, F.lit(" "))).otherwise(""), F.col("inline"))
    body = (
        F.when(kind == "title", title)
        .when(kind == "interline_equation", F.concat(F.lit("$$\n"), F.col("content"), F.lit("\n$$")))
        .when(kind == "text", I.finish_paragraph(F.col("inline")))
        .otherwise(F.col("inline"))
    )
    return blocks.withColumn("text", body)


def block_markdown(blocks: DataFrame, mode: str = "mm_markdown", folder: str = "") -> DataFrame:
    """Non-empty blocks with ``markdown``; ``nlp_markdown`` leaves visuals out."""
    if mode not in VISUAL_MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {VISUAL_MODES}")
    kept = blocks.where("not discarded")
    if mode == "nlp_markdown":
        kept = kept.where(~F.col("type").isin(*BODY_ONLY))
    df = with_text(kept)
    kind, anchor = F.col("type"), F.trim(F.coalesce(_optional(df, "anchor", "string"), F.lit("")))
    bookmark = F.concat(F.lit('<a id="'), anchor, F.lit('"></a>\n'))
    heading = F.concat(F.repeat(F.lit("#"), _optional(df, "level", "int").cast("int")), F.lit(" "), F.col("text"))
    image = _optional(df, "image_path", "string")
    captions = F.array_join(F.transform("caption_inline", lambda c: F.concat(F.lit("  \n"), c)), "")
    html = F.concat(F.lit("\n"), X.embedded_html(F.col("content"), folder), F.lit("\n"))
    picture = F.when(
        F.coalesce(image, F.lit("")) != "", F.concat(F.lit(f"![]({folder}/"), image, F.lit(")"))
    ).otherwise("")
    chart = F.when(F.coalesce(F.col("content"), F.lit("")) != "", html).otherwise(
        F.when(
            F.coalesce(image, F.lit("")) != "", F.concat(F.lit("![]("), _media_path(folder, image), F.lit(")"))
        )
    )
    lines = F.concat(F.array_join(_optional(df, "list_items", "array<string>"), "\n"), F.lit("\n"))
    markdown = (
        F.when(kind == "text", F.concat(F.when(anchor.startswith("_Toc"), bookmark).otherwise(""), F.col("text")))
        .when(kind == "interline_equation", F.col("text"))
        .when(kind.isin("list", "index"), lines)
        .when(kind == "title", F.concat(F.when(anchor != "", bookmark).otherwise(""), heading))
        .when(kind == "image_body", F.concat(picture, captions))
        .when(kind == "table_body", F.concat(html, captions))
        .when(kind == "chart_body", F.concat(chart, captions))
    )
    rendered = df.withColumn("markdown", F.trim(markdown, F.lit("\r\n")))
    return where_computed(rendered, F.trim("markdown", F.lit(" \t\r\n")) != "").drop("text")


def document_markdown(rendered: DataFrame) -> DataFrame:
    """One Markdown text per document: blocks in page order, a blank line between them."""
    return rendered.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("page_idx", "block_idx", "markdown"))).alias("b")
    ).select("doc_id", F.array_join(F.transform("b", lambda x: x["markdown"]), "\n\n").alias("markdown"))


def content_list(blocks: DataFrame, folder: str = "") -> DataFrame:
    """One flat JSON object per block (``entry``), with ``part`` 0 for the body and 1 for discarded blocks."""
    df = with_text(blocks)
    kind = F.col("type")

    def only(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    textual = kind.isin("text", "header", "footer", "page_footnote", "title", "interline_equation")
    name = (
        F.when(kind == "title", "text")
        .when(kind == "interline_equation", "equation")
        .when(kind.isin(*BODY_ONLY), F.regexp_replace(kind, "_body$", ""))
        .otherwise(kind)
    )
    image, chart, table = kind == "image_body", kind == "chart_body", kind == "table_body"
    level = _optional(df, "level", "int")
    anchor = F.trim(F.coalesce(_optional(df, "anchor", "string"), F.lit("")))
    entry = F.to_json(
        F.struct(
            name.alias("type"),
            only(textual, F.col("text")).alias("text"),
            only((kind == "title") & (level != 0), level).alias("text_level"),
            only(kind == "interline_equation", F.lit("latex")).alias("text_format"),
            only(kind.isin("list", "index"), _optional(df, "list_items", "array<string>")).alias("list_items"),
            only(image | chart, _media_path(folder, _optional(df, "image_path", "string"))).alias("img_path"),
            only(chart, X.embedded_html(F.coalesce("content", F.lit("")), folder)).alias("content"),
            only(table, X.embedded_html(F.col("content"), folder)).alias("table_body"),
            only(image, F.col("caption_inline")).alias("image_caption"),
            only(table, F.col("caption_inline")).alias("table_caption"),
            only(chart, F.col("caption_inline")).alias("chart_caption"),
            F.col("page_idx"),
            only(anchor != "", anchor).alias("anchor"),
        )
    )
    return df.select("doc_id", "page_idx", F.col("discarded").cast("int").alias("part"), "block_idx", entry.alias("entry"))


# Names of page furniture and inline formulas in the second list format.
FURNITURE_NAMES = {"header": "page_header", "footer": "page_footer", "page_footnote": "page_footnote"}


def _v2_spans(spans: Column) -> Column:
    """Spans with visible content; formulas renamed, empty style and url left out."""
    visible = F.filter(
        spans,
        lambda s: (F.trim(s["content"], F.lit(" \t\r\n")) != "")
        | ((s["content"] != "") & (F.array_contains(s["style"], "underline") | F.array_contains(s["style"], "strikethrough"))),
    )
    return F.transform(
        visible,
        lambda s: F.struct(
            F.when(s["type"] == "inline_equation", "equation_inline").otherwise(s["type"]).alias("type"),
            s["content"].alias("content"),
            F.when(F.size(s["style"]) > 0, s["style"]).alias("style"),
            F.when(s["url"] != "", s["url"]).alias("url"),
        ),
    )


def content_list_v2(blocks: DataFrame, folder: str = "") -> DataFrame:
    """One JSON object per block with a typed ``content`` object and inline spans."""
    df = blocks
    kind = F.col("type")
    level = _optional(df, "level", "int")
    spans = _v2_spans(F.col("inline_spans"))
    number = _optional(df, "section_number", "string")
    nothing = F.lit(None)
    lead = F.when(
        number.isNotNull(),
        F.array(
            F.struct(
                F.lit("text").alias("type"), F.concat(number, F.lit(" ")).alias("content"),
                nothing.cast("array<string>").alias("style"), nothing.cast("string").alias("url"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<type:string,content:string,style:array<string>,url:string>>"))
    title_spans = F.concat(lead, spans)
    captions = _v2_spans(F.flatten("caption_inline_spans"))
    nesting = X.table_nesting(F.coalesce("content", F.lit("")))
    html = X.embedded_html(F.coalesce("content", F.lit("")), folder)
    path = F.struct(_media_path(folder, _optional(df, "image_path", "string")).alias("path"))
    titled = (kind == "title") & (level != 0)
    plain = (kind == "text") | ((kind == "title") & (level == 0))
    table, image, chart = kind == "table_body", kind == "image_body", kind == "chart_body"
    math = kind == "interline_equation"
    fields = [
        F.when(titled, title_spans).alias("title_content"),
        F.when(titled, level).alias("level"),
        F.when(plain, F.when(kind == "title", title_spans).otherwise(spans)).alias("paragraph_content"),
        F.when(math, F.col("content")).alias("math_content"),
        F.when(math, F.lit("latex")).alias("math_type"),
        F.when(image | chart, path).alias("image_source"),
        F.when(image, captions).alias("image_caption"),
        F.when(table, captions).alias("table_caption"),
        F.when(table, html).alias("html"),
        F.when(table, nesting["kind"]).alias("table_type"),
        F.when(table, nesting["nest_level"]).alias("table_nest_level"),
        F.when(chart, html).alias("content"),
        F.when(chart, captions).alias("chart_caption"),
        F.when(kind.isin("list", "index"), F.lit("text_list")).alias("list_type"),
        F.when(kind.isin("list", "index"), _optional(df, "list_items", "array<string>")).alias("list_items"),
        *[F.when(kind == k, spans).alias(f"{v}_content") for k, v in FURNITURE_NAMES.items()],
    ]
    name = (
        F.when(titled, "title").when(plain, "paragraph").when(math, "equation_interline")
        .when(kind.isin(*BODY_ONLY), F.regexp_replace(kind, "_body$", ""))
    )
    for k, v in FURNITURE_NAMES.items():
        name = name.when(kind == k, v)
    anchor = F.trim(F.coalesce(_optional(df, "anchor", "string"), F.lit("")))
    entry = F.to_json(
        F.struct(name.otherwise(kind).alias("type"), F.struct(*fields).alias("content"), F.when(anchor != "", anchor).alias("anchor"))
    )
    return df.select("doc_id", "page_idx", F.col("discarded").cast("int").alias("part"), "block_idx", entry.alias("entry"))


def document_json(entries: DataFrame, by_page: bool = False) -> DataFrame:
    """One JSON list per document: of entries, or of pages holding their entries."""
    keys = ["doc_id", "page_idx"]
    pages = entries.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("part", "block_idx", "entry"))).alias("e")
    ).select(*keys, F.array_join(F.transform("e", lambda x: x["entry"]), ",").alias("j"))
    page_text = F.concat(F.lit("["), F.col("j"), F.lit("]")) if by_page else F.col("j")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("page_idx"), page_text.alias("t"))))
    return pages.groupBy("doc_id").agg(ordered.alias("p")).select(
        "doc_id", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["t"]), ","), F.lit("]")).alias("json")
    )
