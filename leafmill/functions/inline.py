"""Inline rich text: tagged text to typed spans, and spans to Markdown or HTML, as Column expressions.

A span is a struct (type, content, style, url); a paragraph's spans are one array in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X

SPAN_TYPE = "array<struct<type:string,content:string,style:array<string>,url:string>>"
_TOKENS = (
    r"(?s)(<eq>.*?</eq>|<hyperlink>.*?</hyperlink>|<text(?:\s+style=\"[^\"]*\")?>.*?</text>"
    r"|(?:(?!<eq>|<hyperlink>|<text(?:\s+style=\"[^\"]*\")?>).)+|.+)"
)
_TEXT_TAG = r"(?s)<text(?:\s+style=\"([^\"]*)\")?>(.*?)</text>"
_BLANK = " \t\r\n"


def _styles(listed: Column) -> Column:
    names = F.transform(F.split(listed, ","), lambda s: F.trim(s))
    return F.filter(names, lambda s: s != "")


def _span(kind: str, content: Column, style: Column | None = None, url: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        content.alias("content"),
        (F.array().cast("array<string>") if style is None else style).alias("style"),
        (F.lit("") if url is None else url).alias("url"),
    )


def parse_spans(content: Column) -> Column:
    """``<eq>``, ``<hyperlink>`` and ``<text style>`` tags to spans, in text order.

    An unclosed tag, or a link without text or target, stays plain text.
    """
    def one(token: Column) -> Column:
        inner = F.regexp_extract_all(token, F.lit(_TEXT_TAG), F.lit(2))
        inner_styles = F.regexp_extract_all(token, F.lit(_TEXT_TAG), F.lit(1))
        url = F.regexp_extract(token, r"(?s)<url>(.*?)</url>", 1)
        is_link = token.startswith("<hyperlink>") & token.endswith("</hyperlink>") & (F.size(inner) > 0) & (url != "")
        link_style = F.when(F.size(inner) == 1, _styles(F.get(inner_styles, F.lit(0)))).otherwise(
            F.array().cast("array<string>")
        )
        is_math = token.startswith("<eq>") & token.endswith("</eq>")
        is_text = token.rlike(r"(?s)^<text(?:\s+style=\"[^\"]*\")?>.*</text>\z")
        return (
            F.when(is_math, _span("inline_equation", F.substring(token, F.lit(5), F.length(token) - 9)))
            .when(is_link, _span("hyperlink", F.array_join(inner, ""), link_style, url))
            .when(is_text, _span("text", F.get(inner, F.lit(0)), _styles(F.get(inner_styles, F.lit(0)))))
            .otherwise(_span("text", token))
        )

    tokens = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(_TOKENS), F.lit(1))
    return F.transform(tokens, one)


def merge_text_runs(spans: Column) -> Column:
    """Join neighbouring text spans of one style; links and formulas are borders."""
    def add(acc: Column, span: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        same = (
            (last["type"] == "text")
            & (span["type"] == "text")
            & (X.style_key(last["style"]) == X.style_key(span["style"]))
        )
        joined = F.struct(
            last["type"].alias("type"),
            F.concat(last["content"], span["content"]).alias("content"),
            last["style"].alias("style"),
            last["url"].alias("url"),
        )
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(span))
        )

    filled = F.filter(spans, lambda s: s["content"] != "")
    return F.aggregate(filled, F.array().cast(SPAN_TYPE), add)


def needs_html(spans: Column) -> Column:
    """Complex styles, or more than one simple style set in a block, need HTML."""
    styled = F.filter(spans, lambda s: (s["content"] != "") & (F.size(s["style"]) > 0))
    keys = F.array_distinct(F.transform(styled, lambda s: X.style_key(s["style"])))
    simple = [F.lit(k) for k in X.MARKDOWN_WRAPPERS]
    return F.exists(keys, lambda k: ~k.isin(*simple)) | (F.size(keys) > 1)


def _visible_blanks(content: Column, style: Column) -> Column:
    """Blanks at the edges of underlined (``_``) or struck (``-``) text as visible marks."""
    mark = F.when(F.array_contains(style, "underline"), "_").when(F.array_contains(style, "strikethrough"), "-")
    lead = F.length(content) - F.length(F.ltrim(content))
    trail = F.when(F.trim(content) == "", 0).otherwise(F.length(content) - F.length(F.rtrim(content)))
    core = X.escape_markdown(F.trim(content))
    return F.when(mark.isNull(), X.escape_markdown(content)).otherwise(
        F.concat(F.repeat(mark, lead), core, F.repeat(mark, trail))
    )


def _render_text(content: Column, style: Column, html: Column) -> Column:
    visible = F.array_contains(style, "underline") | F.array_contains(style, "strikethrough")
    blank = F.trim(content, F.lit(_BLANK)) == ""
    source = F.when(html, X.escape_html(content)).otherwise(content)
    body = F.trim(source, F.lit(_BLANK))
    lead = F.regexp_extract(source, r"^(\s*)", 1)
    trail = F.regexp_extract(source, r"(\s*)\z", 1)
    escaped = X.escape_markdown(body)

    def styled(t: Column, s: Column) -> Column:
        return F.when(html, X.html_style(t, s)).otherwise(X.markdown_style(t, s))

    all_blanks = content.rlike(r"^ +\z")
    marked_style = F.when(
        all_blanks & F.array_contains(style, "underline"), F.array_remove(style, "underline")
    ).when(all_blanks, F.array_remove(style, "strikethrough")).otherwise(style)
    return (
        F.when(visible, styled(_visible_blanks(source, style), marked_style))
        .when(blank, content)
        .otherwise(F.concat(lead, styled(escaped, style), trail))
    )


def render_runs(runs: Column, html: Column, left: str = "$", right: str = "$") -> Column:
    """Merged spans as Markdown, or as HTML where ``html`` says so. Pass plain column references: every run
    looks at the one before it."""

    def link(s: Column) -> Column:
        label = _render_text(F.trim(s["content"], F.lit(_BLANK)), s["style"], html)
        anchor = F.concat(F.lit('<a href="'), X.escape_html(s["url"], quote=True), F.lit('">'), label, F.lit("</a>"))
        plain = F.concat(F.lit("["), label, F.lit("]("), s["url"], F.lit(")"))
        return F.when(F.trim(s["content"], F.lit(_BLANK)) == "", F.lit("")).when(html, anchor).otherwise(plain)

    def wrapped(s: Column) -> Column:
        return ~html & X.style_key(s["style"]).isin(*[F.lit(k) for k in X.MARKDOWN_WRAPPERS])

    def piece(s: Column, i: Column) -> Column:
        before = F.get(runs, i - 1)
        math = F.concat(F.lit(left), s["content"], F.lit(right))
        first, last = i == 0, i == F.size(runs) - 1
        # blanks around a formula: one before unless the text already ends in one, one after unless last
        ends_blank = F.coalesce(before["content"].endswith(" ") | (before["type"] == "inline_equation"), F.lit(False))
        math = F.concat(F.when(first | ends_blank, "").otherwise(" "), math, F.when(last, "").otherwise(" "))
        space = F.when(
            ~first & X.needs_boundary_space(before["content"], wrapped(before) & (before["type"] == "text"), s["content"], s["type"]),
            " ",
        ).otherwise("")
        return (
            F.when(s["type"] == "inline_equation", math)
            .when(s["type"] == "hyperlink", link(s))
            .otherwise(F.concat(space, _render_text(s["content"], s["style"], html)))
        )

    return F.array_join(F.transform(runs, piece), "")


def finish_paragraph(text: Column) -> Column:
    """Edges trimmed, and a leading block marker or a lone rule escaped."""
    return X.escape_block_prefix(X.escape_lone_rule(F.trim(text, F.lit(_BLANK))))


def with_inline_markdown(df: DataFrame, content: str = "content", out: str = "inline") -> DataFrame:
    """Add ``out`` (tagged text as Markdown) and ``{out}_spans`` (its spans)."""
    spans, runs, html = f"{out}_spans", f"__{out}_runs", f"__{out}_html"
    text = F.coalesce(F.col(content), F.lit(""))
    tagged = text.contains("<")  # most text has no tags and needs no parsing
    plain = F.when(text == "", F.array().cast(SPAN_TYPE)).otherwise(F.array(_span("text", text)))
    return (
        df.withColumn(spans, F.when(tagged, parse_spans(text)).otherwise(plain))
        .withColumn(runs, F.when(tagged, merge_text_runs(F.col(spans))))
        .withColumn(html, F.when(tagged, needs_html(F.col(runs))))
        .withColumn(out, F.when(tagged, render_runs(F.col(runs), F.col(html))).otherwise(X.escape_markdown(text)))
        .drop(runs, html)
    )
