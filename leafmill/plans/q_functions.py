"""Queries: text functions and box predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import boxes as B
from leafmill.functions import text as X
from leafmill.plans.registry import derived, query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("text_width_folding", """
with t as (select doc_id, translate(text, 'abcXYZ019,.!', 'ａｂｃＸＹＺ０１９，．！') as wide, text from documents)
select doc_id, md5(text) as folded, md5(translate(wide, 'ａｂｃＸＹＺ０１９', 'abcXYZ019')) as alnum from t""")
def text_width_folding(spark, sf):
    wide = F.translate("text", "abcXYZ019,.!", "ａｂｃＸＹＺ０１９，．！")
    return docs(spark, sf).select(
        "doc_id", F.md5(X.full_to_half(wide)).alias("folded"), F.md5(X.full_to_half_alphanumeric(wide)).alias("alnum"))


@query("text_line_end_hyphen", r"""
select l.doc_id, count(*) as lines, cast(sum(case when regexp_matches(ln || case when length(ln) % 3 = 0 then '-' else '' end,
   '[A-Za-z]+[-\x{00ad}\x{2010}\x{2011}\x{2043}]\s*$') then 1 else 0 end) as bigint) as broken
from (select doc_id, unnest(string_split(text, chr(10))) as ln from documents) l group by 1""")
def text_line_end_hyphen(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("ln"))
    shown = F.concat("ln", F.when(F.length("ln") % 3 == 0, "-").otherwise(""))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(X.ends_with_word_hyphen(shown)).alias("broken"))


@query("text_ligatures", """
select doc_id, md5(replace(replace(replace(replace(text,'fi','fi'),'oi','-oi'), chr(10), ''),'st','st')) as expanded from documents""")
def text_ligatures(spark, sf):
    folded = F.replace(F.replace(F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("oi"), F.lit("\u0002oi")),
                                 F.lit("\n"), F.lit("\r\n")), F.lit("st"), F.lit("ﬆ"))
    return docs(spark, sf).select("doc_id", F.md5(X.expand_ligatures(folded)).alias("expanded"))


@query("text_strip_control", """
select doc_id, md5(regexp_replace(text, '[\\x00-\\x1f]', '', 'g')) as clean from documents""")
def text_strip_control(spark, sf):
    noisy = F.replace("text", F.lit("e"), F.lit("e\u0001"))
    return docs(spark, sf).select("doc_id", F.md5(X.strip_control(noisy)).alias("clean"))


@query("text_hashes", """
select doc_id, upper(md5(text)) as bytes_md5, md5(text) as str_md5, sha256(text) as str_sha256,
  md5('{"doc": ' || doc_id || ', "lang": "' || lang || '"}') as object_md5 from documents""")
def text_hashes(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id", X.bytes_md5(F.encode(t, "UTF-8")).alias("bytes_md5"), X.text_md5(t).alias("str_md5"),
        X.text_sha256(t).alias("str_sha256"),
        X.object_md5({"lang": F.col("lang"), "doc": F.col("doc_id")}).alias("object_md5"))


@query("nested_object_hashes", """
select o_orderkey, md5('{"customer": {"id": ' || o_custkey || ', "rank": null, "tags": ["' || o_orderstatus || '", "' || o_orderpriority || '"]}, "flags": {"a": '
  || case when o_custkey % 2 = 0 then 'true' else 'false' end || ', "b": false}, "half": ' || cast(o_custkey / 2.0 as double) || ', "price": ' || o_totalprice || ', "small": ' || case when o_custkey % 3 = 0 then '1e-07' else '0.0025' end || '}') as object_md5
from orders""")
def nested_object_hashes(spark, sf):
    nested = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "named_struct('small', if(o_custkey % 3 = 0, 1e-7, 25e-4), 'price', o_totalprice, 'half', o_custkey / 2, 'flags', map('b', false, 'a', o_custkey % 2 = 0), "
        "'customer', named_struct('tags', array(o_orderstatus, o_orderpriority), 'id', o_custkey, 'rank', cast(null as int))) as o")
    return nested.select("o_orderkey", X.typed_object_md5(nested, "o").alias("object_md5"))


@query("markdown_escape", r"""
select page_id, md5(array_to_string(list_transform(regexp_extract_all(html, '(?s)\\.|.'),
    lambda t: case when t in ('*', '_', '`', '~', '$') then '\' || t else t end), '')) as escaped,
  regexp_replace((case when page_id % 2 = 0 then '## ' else '- ' end) || url, '^([ \t]{0,3})(#{1,6}|[+-])([ \t])', '\\\2\3') as prefixed,
  '\' || repeat(case when page_id % 2 = 0 then '_' else '-' end, 3) as lone
from pages""")
def markdown_escape(spark, sf):
    p = table(spark, sf, "pages")
    even = F.col("page_id") % 2 == 0
    return p.select(
        "page_id", F.md5(X.escape_markdown(F.col("html"))).alias("escaped"),
        X.escape_block_prefix(F.concat(F.when(even, "## ").otherwise("- "), "url")).alias("prefixed"),
        X.escape_lone_rule(F.repeat(F.when(even, "_").otherwise("-"), F.lit(3))).alias("lone"))


STYLES = ["", "bold", "italic", "bold,italic", "strikethrough", "underline", "bold,underline", "superscript,italic"]


@query("inline_styles", """
with t as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, 'p' || l_partkey as txt, l_partkey % 8 as k from lineitem)
select l_orderkey, l_partkey, l_suppkey,
 case k when 1 then '**'||txt||'**' when 2 then '*'||txt||'*' when 3 then '***'||txt||'***' when 4 then '~~'||txt||'~~' else txt end as md,
 case k when 0 then txt when 1 then '<strong>'||txt||'</strong>' when 2 then '<em>'||txt||'</em>'
   when 3 then '<em><strong>'||txt||'</strong></em>' when 4 then '<s>'||txt||'</s>' when 5 then '<u>'||txt||'</u>'
   when 6 then '<strong><u>'||txt||'</u></strong>' else '<em><sup>'||txt||'</sup></em>' end as html,
 k in (1,2,3,4) and l_suppkey % 2 = 0 and l_linenumber % 2 = 0 as spaced
from t""")
def inline_styles(spark, sf):
    li = table(spark, sf, "lineitem")
    k = (F.col("l_partkey") % 8).cast("int")
    styles = F.filter(F.split(F.element_at(F.array(*[F.lit(s) for s in STYLES]), k + 1), ","), lambda s: s != "")
    txt = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    before = F.concat(txt, F.when(F.col("l_suppkey") % 2 == 0, ".").otherwise(""))
    after = F.when(F.col("l_linenumber") % 2 == 0, "word").otherwise("(x)")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", X.markdown_style(txt, styles).alias("md"), X.html_style(txt, styles).alias("html"),
        X.needs_boundary_space(before, k.isin(1, 2, 3, 4), after, F.lit("text")).alias("spaced"))


@query("section_number_parse", """
select l_orderkey, l_partkey, l_suppkey,
  case when l_linenumber % 3 = 0 then l_linenumber || '.' || (l_suppkey % 5)
       when l_linenumber % 3 = 1 then cast(l_linenumber as string) else '' end as parts,
  case when l_linenumber % 3 = 0 then l_linenumber || '.' || (l_suppkey % 5) end as at_two,
  cast(case when l_linenumber % 3 = 0 then 1 else 3 end as int) as toc_level
from lineitem""")
def section_number_parse(spark, sf):
    number = F.when(F.col("l_linenumber") % 3 == 0, F.expr("l_linenumber || '.' || (l_suppkey % 5)")).when(
        F.col("l_linenumber") % 3 == 1, F.col("l_linenumber").cast("string")).otherwise("")
    text = F.concat(F.lit(" "), number, F.lit("建立 model"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.array_join(X.section_parts(text), ".").alias("parts"),
        F.array_join(X.section_parts_at(text, F.lit(2)), ".").alias("at_two"),
        X.corrected_toc_level(F.lit(3), text).alias("toc_level"))


@query("toc_page_tail", """
select l_orderkey, l_partkey, l_suppkey, case l_partkey % 4
   when 0 then 'Part ' || l_partkey when 1 then 'Part ' || l_partkey || ' x' when 2 then 'Part ' || l_partkey
   else 'Part ' || l_partkey || ' page nine' end as entry from lineitem""")
def toc_page_tail(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        X.strip_toc_page(F.expr("""case l_partkey % 4 when 0 then 'Part\t' || l_partkey || '\t' || l_linenumber
            when 1 then 'Part\t' || l_partkey || '\tx\txiv' when 2 then 'Part\t' || l_partkey || '\tb'
            else 'Part\t' || l_partkey || '\tpage nine' end""")).alias("entry"))


@query("table_html_clean", """
select l_orderkey, l_partkey, l_suppkey,
  '<table><tr><td colspan="' || l_linenumber || '">a' || l_partkey || '</td><td><a' ||
  case l_partkey % 3 when 0 then ' href="https://x.y/' || l_partkey || '"' when 1 then '' else ' href="/p?a=1&amp;b=2"' end ||
  '>t</a><img src="i' || l_suppkey || '.png" width="3"/></td></tr></table>' as clean from lineitem""")
def table_html_clean(spark, sf):
    raw = F.expr("""'<table class="k" border=1><TR style="x"><td colspan="' || l_linenumber || '" width="9">a' || l_partkey ||
      '</td><td><a target=_blank href="' || case l_partkey % 3 when 0 then 'https://x.y/' || l_partkey
        when 1 then 'JavaScript:alert(1)' else '/p?a=1&amp;b=2' end ||
      '">t</a><img src="i' || l_suppkey || '.png" width="3" style="z"/></td></TR></table>'""")
    clean = F.replace(X.clean_table_html(raw), F.lit("</TR>"), F.lit("</tr>"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", clean.alias("clean"))


@query("embedded_html", """
select page_id, '<b> $a' || page_id || '$ </b><img src="out/p' || page_id || '.png"/><img src="data:x"/>' as html from pages""")
def embedded_html(spark, sf):
    raw = F.expr("""'<b><eq>a' || page_id || '</eq></b><img src="p' || page_id || '.png"/><img src="data:x"/>'""")
    return table(spark, sf, "pages").select("page_id", X.embedded_html(raw, "out").alias("html"))


@query("formula_and_code_cleanup", """
with t as (select *, trim(text, chr(9) || chr(10) || chr(13) || ' ') as inner_text from documents)
select doc_id, md5(inner_text) as formula, md5(inner_text) as code, '[' || lang || '] and [' || source || ']' as brackets from t""")
def formula_and_code_cleanup(spark, sf):
    d = docs(spark, sf)
    return d.select(
        "doc_id", F.md5(X.strip_display_math(F.concat(F.lit("\\[ "), "text", F.lit(" \\]")))).alias("formula"),
        F.md5(X.strip_code_fence(F.concat(F.lit("```py\n"), "text", F.lit("\n ```\n")))).alias("code"),
        X.unescape_brackets(F.expr(r"'\\[' || lang || '\\] and \\[' || source || '\\]'")).alias("brackets"))


@query("serial_dates", """
with t as (select l_orderkey, l_partkey, l_suppkey, l_partkey % 50000 + (l_suppkey % 4) / 4.0 as v from lineitem)
select l_orderkey, l_partkey, l_suppkey,
  case when v < 1 then strftime(timestamp '1899-12-30' + to_seconds(cast(v * 86400 as bigint)), '%H:%M:%S')
       when v = floor(v) then strftime(timestamp '1899-12-30' + to_days(cast(floor(v) + (case when v < 60 then 1 else 0 end) as int)), '%Y-%m-%d')
       else strftime(timestamp '1899-12-30' + to_days(cast(floor(v) + (case when v < 60 then 1 else 0 end) as int))
             + to_seconds(cast((v-floor(v)) * 86400 as bigint)), '%Y-%m-%d %H:%M:%S') end as iso,
  case when v = floor(v) then cast(cast(v as bigint) as string) else cast(v as string) end as plain
from t""")
def serial_dates(spark, sf):
    v = F.col("l_partkey") % 50000 + (F.col("l_suppkey") % 4) / F.lit(4.0)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", X.serial_to_iso(v).alias("iso"), X.number_text(v).alias("plain"))


@query("split_text_number", """
select p_partkey, 'part-' || p_size as joined, 'part-' as head, cast(p_size as string) as tail from part""")
def split_text_number(spark, sf):
    parts = X.split_text_and_number(F.expr("'part-' || p_size"))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(parts, "").alias("joined"), parts[0].alias("head"), parts[1].alias("tail"))


@query("bucket_paths", """
select page_id, 'b' || (page_id % 7) as bucket, regexp_replace(url, '^[a-z]+://', '') as key from pages""")
def bucket_paths(spark, sf):
    p = table(spark, sf, "pages")
    s = X.bucket_and_key(F.concat(F.expr("' s3://b' || (page_id % 7) || '/'"), F.regexp_replace("url", "^[a-z]+://", "")))
    return p.select("page_id", s["bucket"].alias("bucket"), s["key"].alias("key"))


@query("block_quotes", r"""
select doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when trim(x, ' ') = '' then '>' else '> ' || x end), chr(10))) as quoted
from documents""")
def block_quotes(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.block_quote(F.col("text"))).alias("quoted"))


@query("algorithm_preformatted", """
select l_orderkey, l_partkey, l_suppkey, '<div class="algorithm" style="white-space: pre-wrap; font-family:monospace;">' || chr(10) ||
  'x &lt; ' || l_partkey || '$a$ $b' || l_suppkey || '$' || chr(10) || '</div>' as html from lineitem""")
def algorithm_preformatted(spark, sf):
    spans = F.array(*[
        F.struct(F.lit(t).alias("type"), c.alias("content")) for t, c in [
            ("text", F.expr("'x < ' || l_partkey")), ("inline_equation", F.lit("a")), ("inline_equation", F.lit(" ")),
            ("inline_equation", F.expr("'b' || l_suppkey"))]])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", X.algorithm_html(spans).alias("html"))


@query("private_use_signal", """
select doc_id, doc_id % 4 as "count", round((doc_id % 4) * 1.0 / (length(regexp_replace(text, '\\s', '', 'g')) + doc_id % 4), 6) as ratio,
  cast(case when doc_id % 4 < 3 then least(doc_id % 4, 1) else 2 end as int) as longest_run,
  doc_id % 4 = 3 or (doc_id % 4 = 2 and 2.0 / (length(regexp_replace(text, '\\s', '', 'g')) + 2) >= 0.05) as flagged from documents""")
def private_use_signal(spark, sf):
    extra = F.element_at(F.array(F.lit(""), F.lit(""), F.lit(" "), F.lit(" ")),
                         (F.col("doc_id") % 4 + 1).cast("int"))
    s = X.private_use_signal(F.concat("text", F.lit(" "), extra))
    return docs(spark, sf).select("doc_id", s["count"].alias("count"), F.round(s["ratio"], 6).alias("ratio"),
                                  s["longest_run"].alias("longest_run"), s["flagged"].alias("flagged"))


@query("table_continuation_marker", """
select l_orderkey, l_partkey, l_suppkey, l_partkey % 6 in (1, 2, 3, 5) as continued from lineitem""")
def table_continuation_marker(spark, sf):
    caption = F.expr("""case l_partkey % 6 when 0 then 'Table ' || l_suppkey || ' discontinued'
        when 1 then '表' || l_suppkey || '（续表）' when 2 then 'Table ' || l_suppkey || ' (Continued) of stock'
        when 3 then 'Table ' || l_suppkey || ' CONTINUED ' when 4 then '' else '续表' end""")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", X.is_table_continuation(caption).alias("continued"))


@query("table_nesting", """
select l_orderkey, l_partkey, l_suppkey, case when l_partkey % 3 = 0 then 'simple_table' else 'complex_table' end as kind,
  cast(case when l_partkey % 3 = 2 then 2 else 1 end as int) as nest_level from lineitem""")
def table_nesting(spark, sf):
    html = F.expr("""'<table><tr><td' || case when l_partkey % 3 = 1 then ' rowspan="2"' else '' end || '>' || l_suppkey ||
        case when l_partkey % 3 = 2 then '<table></table>' else '' end || '</td></tr></table>'""")
    s = X.table_nesting(html)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", s["kind"].alias("kind"), s["nest_level"].alias("nest_level"))


@query("object_names", """
select p_partkey, case p_partkey % 3 when 0 then 'Scanner' when 1 then 'bolt' else 'lamp' end as category,
  case p_partkey % 3 when 0 then 'big scanner' || p_size when 1 then 'bolt' || p_size else 'lamp' end as label,
  case when p_partkey % 3 = 1 then cast(p_size as bigint) - 1 else -1 end as "index",
  case p_partkey % 3 when 0 then 'big scanner' when 1 then 'bolt' else 'lamp' end as base
from part""")
def object_names(spark, sf):
    name = F.expr("case p_partkey % 3 when 0 then ' big scanner' || p_size when 1 then 'bolt' || p_size else 'lamp ' end")
    s = X.object_category(name, ["Scanner", "tray"])
    return table(spark, sf, "part").select("p_partkey", s["category"].alias("category"), s["label"].alias("label"),
                                           F.coalesce(s["index"], F.lit(-1)).alias("index"), X.base_name(name).alias("base"))


PAIRS = """select a.doc_id, a.page_idx, a.block_idx, a.x0, a.y0, a.x1, a.y1, b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1
  from b2 a join b2 b on a.doc_id=b.doc_id and a.page_idx=b.page_idx and a.block_idx + 1 = b.block_idx"""
SHRUNK = "b2 as (select doc_id, page_idx, block_idx, x0 % 90 as x0, y0 % 50 as y0, x0 % 90 + x1 - x0 as x1, y0 % 50 + y1 - y0 as y1 from blocks)"


def box_pairs(spark, sf):
    """Consecutive blocks of a page, moved close together so that many overlap."""
    b = derived(spark, sf, "blocks").selectExpr(
        "doc_id", "page_idx", "block_idx", "x0 % 90 as x0", "y0 % 50 as y0", "x0 % 90 + x1 - x0 as x1", "y0 % 50 + y1 - y0 as y1")
    nxt = b.selectExpr("doc_id", "page_idx", "block_idx - 1 as block_idx", "x0 as bx0", "y0 as by0", "x1 as bx1", "y1 as by1")
    return b.join(nxt, ["doc_id", "page_idx", "block_idx"])


@query("box_predicates", f"""
with {SHRUNK}, p as ({PAIRS}), q as (select *, least(x1,bx1)-greatest(x0,bx0) as w, least(y1,by1)-greatest(y0,by0) as h,
   (x1-x0)*(y1-y0) as aa, (bx1-bx0)*(by1-by0) as ba from p),
 r as (select *, case when w<0 or h<0 then 0.0 else w*h end as i from q)
select doc_id, page_idx, block_idx, x0>=bx0 and y0>=by0 and x1<=bx1 and y1<=by1 as inside, w>0 and h>0 as meets,
 round(i/(aa+ba-i),9) as iou, round(i/aa,9) as own, round(i/least(aa,ba),9) as smaller,
 case when i/least(aa,ba) > 0.3 then case when aa<=ba then x0 else bx0 end else -1 end as small_x0,
 round(case when w<0 then 0 else w*1.0/(x1-x0) end,9) as x_share,
 round(greatest(0,h)*1.0/least(y1-y0,by1-by0),9) as y_share,
 round(greatest(0,w)*1.0/least(x1-x0,bx1-bx0),9) as x_min_share,
 bx1<x0 as b_left, x1<bx0 as b_right, by1<y0 as b_above, y1<by0 as b_below,
 round(sqrt(power(greatest(0,-w),2)+power(greatest(0,-h),2)),6) as edge,
 round(sqrt(power((x0+x1)/2.0-(bx0+bx1)/2.0,2)+power((y0+y1)/2.0-(by0+by1)/2.0,2)),6) as center
from r""", uses=("blocks",))
def box_predicates(spark, sf):
    a, b = B.box(), B.box("b")
    pos = B.relative_position(a, b)
    return box_pairs(spark, sf).select(
        "doc_id", "page_idx", "block_idx", B.is_inside(a, b).alias("inside"), B.intersects(a, b).alias("meets"),
        F.round(B.iou(a, b), 9).alias("iou"), F.round(B.overlap_in_own(a, b), 9).alias("own"),
        F.round(B.overlap_in_smaller(a, b), 9).alias("smaller"), F.coalesce(B.smaller_if_overlapping(a, b, 0.3)["x0"], F.lit(-1)).alias("small_x0"),
        F.round(B.x_projection_overlap(a, b), 9).alias("x_share"), F.round(B.y_overlap_in_smaller(a, b), 9).alias("y_share"),
        F.round(B.x_overlap_in_smaller(a, b), 9).alias("x_min_share"),
        pos["left"].alias("b_left"), pos["right"].alias("b_right"), pos["bottom"].alias("b_above"), pos["top"].alias("b_below"),
        F.round(B.edge_distance(a, b), 6).alias("edge"), F.round(B.center_distance(a, b), 6).alias("center"))


@query("box_normalization", """
with t as (select doc_id, page_idx, block_idx, x0 - 20.5 as a, y0 - 10.25 as b, x1 + 0.5 as c, y1 + 0.75 as d from blocks),
 u as (select *, greatest(0,least(300,floor(a))) xa, greatest(0,least(200,floor(b))) ya, greatest(0,least(300,ceil(c))) xb, greatest(0,least(200,ceil(d))) yb from t)
select doc_id, page_idx, block_idx, x0, y0, x1, y1, valid from (
 select doc_id, page_idx, block_idx, cast(xa as int) as x0, cast(ya as int) as y0, cast(xb as int) as x1, cast(yb as int) as y1, a<c and b<d as valid
 from u where xa<xb and ya<yb)""", uses=("blocks",))
def box_normalization(spark, sf):
    b = derived(spark, sf, "blocks").selectExpr(
        "doc_id", "page_idx", "block_idx", "double(x0) - 20.5 as x0", "double(y0) - 10.25 as y0", "double(x1) + 0.5 as x1", "double(y1) + 0.75 as y1")
    polygon = F.array("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")
    return (b.withColumn("n", B.normalized_int_box(polygon, F.lit(300), F.lit(200))).where("n is not null")
            .select("doc_id", "page_idx", "block_idx", F.col("n.x0").alias("nx0"), F.col("n.y0").alias("ny0"),
                    F.col("n.x1").alias("nx1"), F.col("n.y1").alias("ny1"), B.is_valid(B.box()).alias("valid"))
            .toDF("doc_id", "page_idx", "block_idx", "x0", "y0", "x1", "y1", "valid"))


@query("small_pictures", """
select doc_id, page_idx, block_idx from blocks where type='image' and
  ((x1-x0)/700.0 < 0.1 or (y1-y0)/600.0 < 0.1 or (x1-x0)/700.0*((y1-y0)/600.0) < 0.01)""", uses=("blocks",))
def small_pictures(spark, sf):
    b = derived(spark, sf, "blocks").where("type = 'image'")
    return b.where(B.is_small_picture(B.box(), F.lit(700.0), F.lit(600.0))).select("doc_id", "page_idx", "block_idx")
