"""Styled text segments of a paragraph to one tagged text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ordered import islands

VISIBLE_BLANKS = ("underline", "strikethrough")
_BLANK = " \t\r\n"


def trim_plain_edges(segments: DataFrame) -> DataFrame:
    """Segments (para_id, seg_idx, text, style, url) without plain blanks at the paragraph's edges; underlined and
    struck blanks show and therefore stay."""
    shows = F.col("style").rlike("underline|strikethrough")
    solid = shows | (F.trim("text", F.lit(_BLANK)) != "")
    ends = segments.groupBy("para_id").agg(
        F.min(F.when(solid, F.col("seg_idx"))).alias("__a"), F.max(F.when(solid, F.col("seg_idx"))).alias("__b")
    )
    kept = segments.join(ends, "para_id").where((F.col("seg_idx") >= F.col("__a")) & (F.col("seg_idx") <= F.col("__b")))
    left = F.when((F.col("seg_idx") == F.col("__a")) & ~shows, F.ltrim("text", F.lit(_BLANK))).otherwise(F.col("text"))
    kept = kept.withColumn("text", left)
    right = F.when((F.col("seg_idx") == F.col("__b")) & ~shows, F.rtrim("text", F.lit(_BLANK))).otherwise(F.col("text"))
    return kept.withColumn("text", right).drop("__a", "__b")


def merge_segments(segments: DataFrame) -> DataFrame:
    """Runs of equal style (outside links and formulas) or of one link as single rows: para_id, run, style, url,
    parts (texts with their styles, in order)."""
    order = ["seg_idx"]
    w = Window.partitionBy("para_id").orderBy(*order)
    me = F.struct("style", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("type", F.lit("text")).alias("type"))
    seen = segments.withColumns({"__me": me, "__p": F.lag(me).over(w)})
    both_plain = (F.col("__me.url") == "") & (F.col("__p.url") == "") & (F.col("__me.style") == F.col("__p.style"))
    one_link = (F.col("__me.url") != "") & (F.col("__me.url") == F.col("__p.url"))
    text = (F.col("__me.type") != "equation") & (F.col("__p.type") != "equation")
    joins = F.coalesce(text & (both_plain | one_link), F.lit(False))
    runs = islands(seen, ["para_id"], order, ~joins, "run")
    return runs.groupBy("para_id", "run").agg(
        F.first("__me.url").alias("url"), F.first("__me.type").alias("type"),
        F.sort_array(F.collect_list(F.struct("seg_idx", "style", "text"))).alias("parts"),
    )


def tagged_text(segments: DataFrame) -> DataFrame:
    """One tagged text per paragraph: styled runs as ``<text style>``, links as ``<hyperlink>``, formulas as ``<eq>``."""
    filled = segments.where(F.coalesce("text", F.lit("")) != "")
    runs = merge_segments(trim_plain_edges(filled))

    def styled(p):
        return F.when(p["style"] == "", F.concat(F.lit("<text>"), p["text"], F.lit("</text>"))).otherwise(
            F.concat(F.lit('<text style="'), p["style"], F.lit('">'), p["text"], F.lit("</text>"))
        )

    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    style = F.col("parts")[0]["style"]
    link = F.concat(F.lit("<hyperlink>"), F.array_join(F.transform("parts", styled), ""), F.lit("<url>"), "url", F.lit("</url></hyperlink>"))
    plain = F.when(style == "", text).otherwise(F.concat(F.lit('<text style="'), style, F.lit('">'), text, F.lit("</text>")))
    piece = F.when(F.col("url") != "", link).when(F.col("type") == "equation", F.concat(F.lit("<eq>"), text, F.lit("</eq>"))).otherwise(plain)
    return runs.select("para_id", "run", piece.alias("t")).groupBy("para_id").agg(
        F.sort_array(F.collect_list(F.struct("run", "t"))).alias("r")
    ).select("para_id", F.array_join("r.t", "").alias("tagged"))
