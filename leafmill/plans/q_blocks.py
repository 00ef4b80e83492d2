"""Queries: blocks, captions, numbering, lists and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import inline as I
from leafmill.operators import blocks as K
from leafmill.operators import render as R
from leafmill.plans.registry import derived, query, table

KEYS = ["doc_id", "page_idx", "block_idx"]

# promoted captions, then typed captions, as SQL
PROMOTED = """prev as (select *, lag(type) over (partition by doc_id, page_idx order by block_idx) as pt, lower(trim(content)) as lc from blocks),
 promoted as (select doc_id, page_idx, block_idx, content, level, numbered, anchor, x0, y0, x1, y1,
   case when type='text' and ((pt='table' and (lc like '表%' or lc like 'table%')) or (pt='image' and (lc like '图%' or lc like 'fig%'))
        or (pt='chart' and (lc like '图%' or lc like 'fig%' or lc like 'chart%'))) then 'caption' else type end as type from prev)"""
TYPED = PROMOTED + """,
 near as (select *, last_value(case when type<>'caption' then type end ignore nulls) over (partition by doc_id, page_idx order by block_idx) as bt,
   first_value(case when type<>'caption' then type end ignore nulls) over (partition by doc_id, page_idx order by block_idx rows between current row and unbounded following) as aft
   from promoted),
 typed as (select doc_id, page_idx, block_idx, content, level, numbered, anchor, x0, y0, x1, y1,
   case when type<>'caption' then type when bt in ('table','image','chart') then bt || '_caption'
        when aft in ('table','image','chart') then aft || '_caption' else 'text' end as type from near)"""
ROUTED = TYPED + """,
 routed as (select doc_id, page_idx, block_idx, content, level, numbered, anchor, x0, y0, x1, y1,
    case type when 'image' then 'image_body' when 'table' then 'table_body' when 'chart' then 'chart_body'
              when 'equation' then 'interline_equation' else type end as type,
    type in ('header','footer','page_number','aside_text','page_footnote') as discarded
  from typed where type in ('text','title','image_caption','table_caption','chart_caption','header','footer','page_footnote',
      'image','table','chart','equation','list','index') and (content <> '' or type='chart'))"""
# each caption of a kind with the nearest body of that kind; other captions of the kind do not count as distance
ATTACHED = ROUTED + """,
 mem as (select *, replace(type,'_caption','') as k from routed where type like '%_caption'),
 own as (select *, replace(type,'_body','') as k from routed where type like '%_body'),
 cand as (select m.doc_id, m.page_idx, m.block_idx, m.k, o.block_idx as owner_idx, abs(m.block_idx-o.block_idx) -
    (select count(*) from mem z where z.doc_id=m.doc_id and z.page_idx=m.page_idx and z.k=m.k
       and z.block_idx > least(m.block_idx,o.block_idx) and z.block_idx < greatest(m.block_idx,o.block_idx)) as cost
  from mem m join own o on m.doc_id=o.doc_id and m.page_idx=o.page_idx and m.k=o.k),
 owned as (select doc_id, page_idx, block_idx, k, owner_idx from
   (select *, row_number() over (partition by doc_id, page_idx, block_idx order by cost, owner_idx) rn from cand) where rn=1),
 steps as (select *, lag(block_idx) over (partition by doc_id, page_idx, owner_idx order by block_idx desc) as nx from owned),
 kept as (select * from (select *, sum(case when nx is null or nx - block_idx = 1 or (nx - block_idx = 2 and owner_idx = block_idx + 1) then 0 else 1 end)
   over (partition by doc_id, page_idx, owner_idx order by block_idx desc) as breaks from steps) where breaks = 0),
 attached as (select r.doc_id, r.page_idx, r.block_idx, r.content, r.level, r.numbered, r.anchor, r.discarded,
   case when r.type like '%_caption' and k.owner_idx is null then 'text' else r.type end as type,
   case when r.type like '%_body' then r.block_idx else k.owner_idx end as owner_idx
  from routed r left join kept k on r.doc_id=k.doc_id and r.page_idx=k.page_idx and r.block_idx=k.block_idx)"""


def blocks(spark, sf):
    return derived(spark, sf, "blocks")


def routed(spark, sf):
    return K.route_blocks(K.classify_captions(blocks(spark, sf)))


@query("caption_promotion", f"with {PROMOTED} select doc_id, page_idx, block_idx, type from promoted", uses=("blocks",))
def caption_promotion(spark, sf):
    return K.promote_captions(blocks(spark, sf)).select(*KEYS, "type")


@query("caption_typing", f"with {TYPED} select doc_id, page_idx, block_idx, type from typed", uses=("blocks",))
def caption_typing(spark, sf):
    return K.classify_captions(blocks(spark, sf)).select(*KEYS, "type")


@query("block_routing", f"with {ROUTED} select doc_id, page_idx, block_idx, type, discarded from routed", uses=("blocks",))
def block_routing(spark, sf):
    return routed(spark, sf).select(*KEYS, "type", "discarded")


@query("caption_attachment", f"""with {ATTACHED}
select doc_id, page_idx, block_idx, type, coalesce(owner_idx, -1) as owner_idx from attached""", uses=("blocks",))
def caption_attachment(spark, sf):
    return K.attach_captions(routed(spark, sf)).select(*KEYS, "type", F.coalesce("owner_idx", F.lit(-1)).alias("owner_idx"))


@query("two_layer_blocks", f"""with {ATTACHED}
select a.doc_id, a.page_idx, a.block_idx, a.type, coalesce((select string_agg(c.content, '|' order by c.block_idx) from attached c
  where c.doc_id=a.doc_id and c.page_idx=a.page_idx and c.owner_idx=a.block_idx and c.block_idx<>a.block_idx), '') as captions
from attached a where owner_idx is null or owner_idx = block_idx""", uses=("blocks",))
def two_layer_blocks(spark, sf):
    t = K.two_layer_blocks(K.attach_captions(routed(spark, sf)))
    return t.select(*KEYS, "type", F.coalesce(F.array_join("captions", "|"), F.lit("")).alias("captions"))


def owner_sql(kind: str, tie: str) -> str:
    """Nearest table for each caption by all pairs, with the tie rules spelled out."""
    return f"""
with m as (select * from blocks where type='caption'), o as (select * from blocks where type='table'),
 c as (select m.doc_id, m.page_idx, m.block_idx, o.block_idx as owner_idx, abs(m.block_idx-o.block_idx) -
    (select count(*) from m z where z.doc_id=m.doc_id and z.page_idx=m.page_idx
       and z.block_idx > least(m.block_idx,o.block_idx) and z.block_idx < greatest(m.block_idx,o.block_idx)) as cost,
    sqrt(power(greatest(0, o.x0-m.x1, m.x0-o.x1),2) + power(greatest(0, o.y0-m.y1, m.y0-o.y1),2)) as edge,
    sqrt(power((m.x0+m.x1-o.x0-o.x1)/2.0,2) + power((m.y0+m.y1-o.y0-o.y1)/2.0,2)) as center
  from m join o on m.doc_id=o.doc_id and m.page_idx=o.page_idx),
 best as (select *, min(cost) over (partition by doc_id, page_idx, block_idx) as mc from c),
 two as (select *, max(edge) over w - min(edge) over w as spread from best where cost = mc window w as (partition by doc_id, page_idx, block_idx))
select doc_id, page_idx, block_idx, owner_idx from (select *, row_number() over (partition by doc_id, page_idx, block_idx
   order by case when spread > 2 then edge else 0 end, {tie}, owner_idx) rn from two) where rn = 1"""


@query("nearest_owner_center", owner_sql("caption", "center"), uses=("blocks",))
def nearest_owner_center(spark, sf):
    b = blocks(spark, sf).where("type in ('caption','table')")
    return K.nearest_owner_by_index(b, F.col("type") == "table", F.col("type") == "caption", "image_caption").select(*KEYS, "owner_idx")


@query("nearest_owner_table_caption", owner_sql("table_caption", "-owner_idx"), uses=("blocks",))
def nearest_owner_table_caption(spark, sf):
    b = blocks(spark, sf).where("type in ('caption','table')")
    return K.nearest_owner_by_index(b, F.col("type") == "table", F.col("type") == "caption", "table_caption").select(*KEYS, "owner_idx")


@query("nearest_owner_footnote", owner_sql("table_footnote", "owner_idx"), uses=("blocks",))
def nearest_owner_footnote(spark, sf):
    b = blocks(spark, sf).where("type in ('caption','table')")
    return K.nearest_owner_by_index(b, F.col("type") == "table", F.col("type") == "caption", "table_footnote").select(*KEYS, "owner_idx")


TITLES = "titles as (select *, block_idx as bi from blocks where type in ('title','table','text') and content <> '')"
NUMBERS = f"""with recursive {TITLES},
 t as (select *, row_number() over (partition by doc_id order by page_idx, bi) rn,
    regexp_extract(trim(content), '^(\\d+(?:\\.\\d+)*)', 1) as num from titles),
 p as (select *, case when num <> '' and length(num) - length(replace(num,'.','')) + 1 = level then string_split(num,'.') end as parts from t),
 s as (
  select doc_id, page_idx, bi, rn, level, numbered,
    cast(case when numbered then case when level > 1 then 1 else 1 end when parts is not null then cast(parts[1] as bigint) else 0 end as bigint) as c1,
    cast(case when numbered then case when level = 1 then 0 when level >= 2 then 1 end when parts is not null and level >= 2 then cast(parts[2] as bigint) else 0 end as bigint) as c2,
    cast(case when numbered then case when level = 3 then 1 else 0 end when parts is not null and level >= 3 then cast(parts[3] as bigint) else 0 end as bigint) as c3
  from p where rn = 1
  union all
  select p.doc_id, p.page_idx, p.bi, p.rn, p.level, p.numbered,
    case when p.numbered then case when p.level = 1 then s.c1 + 1 else greatest(s.c1, 1) end
         when p.parts is not null then cast(p.parts[1] as bigint) else s.c1 end,
    case when p.numbered then case when p.level = 1 then 0 when p.level = 2 then s.c2 + 1 else greatest(s.c2, 1) end
         when p.parts is not null then case when p.level >= 2 then cast(p.parts[2] as bigint) else 0 end else s.c2 end,
    case when p.numbered then case when p.level = 3 then s.c3 + 1 else 0 end
         when p.parts is not null then case when p.level >= 3 then cast(p.parts[3] as bigint) else 0 end else s.c3 end
  from s join p on p.doc_id = s.doc_id and p.rn = s.rn + 1)
select doc_id, page_idx, bi as block_idx,
  case when numbered then case level when 1 then cast(c1 as string) when 2 then c1 || '.' || c2 else c1 || '.' || c2 || '.' || c3 end else '' end as section_number
from s"""


@query("section_numbers", NUMBERS, uses=("blocks",))
def section_numbers(spark, sf):
    t = blocks(spark, sf).where("type in ('title','table','text') and content <> ''")
    return K.section_numbers(t, max_level=3).select(*KEYS, F.coalesce("section_number", F.lit("")).alias("section_number"))


@query("flat_lists", """
with i as (select l_orderkey as list_id, l_linenumber % 3 as lv, l_partkey, case when l_suppkey % 4 = 0 then '' else 'item ' || l_suppkey end as text,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as item_idx from lineitem),
 n as (select *, row_number() over (partition by list_id, lv order by item_idx) as k from i where text <> '')
select list_id, item_idx, repeat('    ', cast(lv as int)) || case when lv = 1 then cast(4 + k as string) || '.' else '-' end || ' ' || text as line from n""")
def flat_lists(spark, sf):
    items = derived(spark, sf, "numbered").selectExpr(
        "l_orderkey as list_id", "l_linenumber % 3 as node_id", "block_idx + 1 as item_idx", "l_linenumber % 3 + 1 as ilevel",
        "1 as root_ilevel", "case when l_linenumber % 3 = 1 then 'ordered' else 'unordered' end as attribute", "5 as start",
        "case when l_suppkey % 4 = 0 then '' else 'item ' || l_suppkey end as text")
    return K.flatten_lists(items).select("list_id", "item_idx", "line")


@query("list_tree_rows", """
select p_partkey as list_id, path, text, ilevel from (
  select p_partkey, '0' as path, 'top ' || p_size as text, 0 as ilevel from part
  union all select p_partkey, '1.0', p_brand, 1 from part
  union all select p_partkey, '1.1.0', p_type, 2 from part
  union all select p_partkey, '2', 'end', 0 from part)""")
def list_tree_rows(spark, sf):
    tree = F.expr("""'{"attribute":"ordered","ilevel":0,"content":[{"type":"text","content":"top ' || p_size || '"},' ||
      '{"type":"list","ilevel":1,"content":[{"type":"text","content":"' || p_brand || '"},{"type":"list","ilevel":2,"content":[{"type":"text","content":"' ||
      p_type || '"}]}]},{"type":"text","content":"end"}]}'""")
    rows = K.explode_list_tree(table(spark, sf, "part").select(F.col("p_partkey").alias("list_id"), tree.alias("tree")))
    return rows.select("list_id", F.array_join("item_idx", ".").alias("path"), "text", "ilevel")


@query("anchor_validation", """
with body as (select distinct doc_id, trim(anchor) as a from blocks where type='title' and anchor is not null),
 d as (select distinct doc_id from body)
select e.doc_id, e.page_idx, e.block_idx, coalesce(case when d.doc_id is null then e.anchor when b.a is not null then trim(e.anchor) end, '') as anchor
from (select doc_id, page_idx, block_idx, ' ' || anchor as anchor from blocks where type='text') e left join d on e.doc_id=d.doc_id
 left join body b on e.doc_id=b.doc_id and trim(e.anchor)=b.a""", uses=("blocks",))
def anchor_validation(spark, sf):
    b = blocks(spark, sf)
    entries = b.where("type = 'text'").select(*KEYS, F.concat(F.lit(" "), "anchor").alias("anchor"))
    return K.validate_anchors(entries, b.where("type = 'title'")).select(*KEYS, F.coalesce("anchor", F.lit("")).alias("anchor"))


@query("header_footer_texts", """
with p as (select doc_id, page_idx as section, block_idx % 2 as kind, cast(floor(block_idx / 2) % 2 as bigint) as story_idx, block_idx as part_idx,
    case when l_partkey % 3 = 0 then '' else cast(l_partkey % 2 as string) || case when l_suppkey % 2 = 0 then '' else 'x' end end as content from numbered),
 j as (select doc_id, section, kind, story_idx, string_agg(content, ' ' order by part_idx) as text from p where content <> '' group by 1,2,3,4)
select doc_id, section, kind, min(story_idx) as story_idx, text from j where not regexp_matches(text, '^\\d+$') group by 1,2,3,5""", uses=("numbered",))
def header_footer_texts(spark, sf):
    parts = derived(spark, sf, "numbered").selectExpr(
        "doc_id", "page_idx as section", "block_idx % 2 as kind", "cast(floor(block_idx / 2) % 2 as bigint) as story_idx", "block_idx as part_idx",
        "case when l_partkey % 3 = 0 then '' else cast(l_partkey % 2 as string) || case when l_suppkey % 2 = 0 then '' else 'x' end end as content")
    return K.header_footer_texts(parts)


@query("page_assembly", """
select doc_id, page_idx, block_idx, type, row_number() over (partition by doc_id, page_idx order by block_idx) as position
from blocks where type in ('text','title','table')""", uses=("blocks",))
def page_assembly(spark, sf):
    b = blocks(spark, sf).select(*KEYS, "type")
    return K.assemble_pages(*[b.where(F.col("type") == t) for t in ("table", "title", "text")])


@query("heading_lists", """
with i as (select doc_id, row_number() over (partition by doc_id order by page_idx, block_idx) as seq,
    case when l_partkey % 3 < 2 then l_suppkey % 2 end as numid, l_partkey % 2 as ilevel from numbered),
 c as (select *, sum(case when numid is null then 1 else 0 end) over (partition by doc_id order by seq) as n from i),
 g as (select *, lag(n) over (partition by doc_id, numid order by seq) as pn from c where numid is not null)
select doc_id, numid from g group by 1,2 having max(case when pn is not null and n > pn then 1 else 0 end) = 1 and count(distinct ilevel) > 1""", uses=("numbered",))
def heading_lists(spark, sf):
    items = derived(spark, sf, "numbered").selectExpr(
        "doc_id", "page_idx * 100 + block_idx as seq", "case when l_partkey % 3 < 2 then l_suppkey % 2 end as numid", "l_partkey % 2 as ilevel")
    return K.heading_lists(items)


SLIDES = """s as (select doc_id, page_idx, block_idx, case when l_partkey % 5 = 0 then 'image' else 'text' end as type,
   cast(10 + (l_suppkey % 3) * 3 + (case when l_linenumber % 2 = 0 then 4 else 0 end) as double) as font_size, l_linenumber % 2 = 0 as bold from numbered)"""


@query("title_promotion", f"""
with {SLIDES}, body as (select doc_id, page_idx, font_size as b from (select doc_id, page_idx, font_size,
     row_number() over (partition by doc_id, page_idx order by count(*) desc, font_size) rn from s where type='text' and not bold group by 1,2,3) where rn=1),
 bs as (select doc_id, page_idx, font_size as f, count(*) n, row_number() over (partition by doc_id, page_idx order by font_size desc) r
   from s where type='text' and bold group by 1,2,3),
 l2 as (select a.doc_id, a.page_idx, a.f as f1, c.f as f2, body.b from bs a left join bs c on c.doc_id=a.doc_id and c.page_idx=a.page_idx and c.r=2
    left join body on body.doc_id=a.doc_id and body.page_idx=a.page_idx
   where a.r=1 and a.n=1 and (b is null or a.f >= b + 4) and (c.f is null or a.f >= c.f + 2))
select s.doc_id, s.page_idx, s.block_idx, case when lv > 0 then 'title' else type end as type, lv as level from (
 select s.*, case when type='text' and bold and font_size = f1 then 2
    when type='text' and bold and font_size = f2 and f2 >= b + 2 and f1 >= f2 + 2 then 3 else 0 end as lv
 from s left join l2 on s.doc_id=l2.doc_id and s.page_idx=l2.page_idx) s""", uses=("numbered",))
def title_promotion(spark, sf):
    s = derived(spark, sf, "numbered").selectExpr(
        "doc_id", "page_idx", "block_idx", "case when l_partkey % 5 = 0 then 'image' else 'text' end as type",
        "cast(10 + (l_suppkey % 3) * 3 + (case when l_linenumber % 2 = 0 then 4 else 0 end) as double) as font_size", "l_linenumber % 2 = 0 as bold")
    return K.promote_titles(s).select(*KEYS, "type", F.coalesce("level", F.lit(0)).alias("level"))


@query("title_groups_and_levels", """
with t as (select doc_id, page_idx, block_idx, case when type='header' then 'doc_title' else 'paragraph_title' end as type, level from blocks where type in ('header','title','table'))
select doc_id, page_idx, block_idx, cast(sum(case when type='doc_title' then 1 else 0 end) over (partition by doc_id order by page_idx, block_idx) as bigint) as title_group,
 case when type='doc_title' then 1 when level = 1 then 2 else level end as level from t""", uses=("blocks",))
def title_groups_and_levels(spark, sf):
    t = blocks(spark, sf).where("type in ('header','title','table')").withColumn(
        "type", F.when(F.col("type") == "header", "doc_title").otherwise("paragraph_title"))
    grouped = K.title_groups(t.drop("level"))
    return K.apply_title_levels(grouped, t).select(*KEYS, "title_group", "level")


@query("title_synchronisation", """
select doc_id, page_idx, case when type='title' and block_idx % 2 = 0 then -1 else block_idx end as block_idx,
  case when type='title' then 'TITLE' else type end as type, case when type='title' then level + 10 else level end as level from blocks""", uses=("blocks",))
def title_synchronisation(spark, sf):
    b = blocks(spark, sf)
    source = b.where("type = 'title'").withColumns({"type": F.lit("TITLE"), "level": F.col("level") + 10})
    hidden = (F.col("type") == "title") & (F.col("block_idx") % 2 == 0)
    target = b.withColumn("block_idx", F.when(~hidden, F.col("block_idx")))
    return K.synchronise_titles(target, source).select(
        "doc_id", "page_idx", F.coalesce("block_idx", F.lit(-1)).alias("block_idx"), "type", "level")


@query("title_line_height", """
select b.doc_id, b.page_idx, b.block_idx, round(coalesce(case when b.level = 3 then 12.5 end, m.h, cast(b.y1-b.y0 as double)), 6) as line_height
from blocks b left join (select doc_id, page_idx, block_idx - 1 as block_idx, avg(y1 - y0) as h from blocks where type='text' group by 1,2,3) m
 on b.doc_id=m.doc_id and b.page_idx=m.page_idx and b.block_idx=m.block_idx where b.type='title'""", uses=("blocks",))
def title_line_height(spark, sf):
    b = blocks(spark, sf)
    lines = b.where("type = 'text'").select("doc_id", "page_idx", (F.col("block_idx") - 1).alias("block_idx"), "y0", "y1")
    titles = b.where("type = 'title'").withColumn("stored_height", F.when(F.col("level") == 3, 12.5))
    return K.title_line_height(titles, lines).select(*KEYS, F.round("line_height", 6).alias("line_height"))


@query("tagged_spans", """
select l_orderkey, l_partkey, l_suppkey, i as span_idx, case i when 0 then 'text' when 1 then 'inline_equation' when 2 then 'text' when 3 then 'hyperlink' else 'text' end as type,
  case i when 0 then 'see ' || l_partkey when 1 then 'x^' || l_suppkey when 2 then 'styled' when 3 then 'go' else ' end<eq>' end as content,
  case i when 2 then 'bold,italic' when 3 then 'underline' else '' end as style, case i when 3 then 'http://a/' || l_suppkey else '' end as url
from lineitem, range(5) r(i)""")
def tagged_spans(spark, sf):
    raw = F.expr("""'see ' || l_partkey || '<eq>x^' || l_suppkey || '</eq><text style="bold, italic">styled</text>' ||
       '<hyperlink><text style="underline">go</text><url>http://a/' || l_suppkey || '</url></hyperlink> end<eq>'""")
    spans = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.posexplode(I.merge_text_runs(I.parse_spans(raw))).alias("span_idx", "s"))
    return spans.select("l_orderkey", "l_partkey", "l_suppkey", "span_idx", "s.type", "s.content",
                        F.array_join("s.style", ",").alias("style"), "s.url")


@query("inline_markdown", """
select l_orderkey, l_partkey, l_suppkey, case l_partkey % 4
  when 0 then 'plain\\*' || l_suppkey || ' $x$ tail' when 1 then '**bold' || l_suppkey || '.** next'
  when 2 then '<strong>b' || l_suppkey || '</strong><em>i &lt; 2</em>' else '[go](http://a/' || l_suppkey || ')' end as md from lineitem""")
def inline_markdown(spark, sf):
    raw = F.expr("""case l_partkey % 4 when 0 then 'plain*' || l_suppkey || '<eq>x</eq>tail'
      when 1 then '<text style="bold">bold</text><text style="bold">' || l_suppkey || '.</text>next'
      when 2 then '<text style="bold">b' || l_suppkey || '</text><text style="italic">i < 2</text>'
      else '<hyperlink><text>go</text><url>http://a/' || l_suppkey || '</url></hyperlink>' end""")
    rendered = I.with_inline_markdown(table(spark, sf, "lineitem").withColumn("content", raw))
    return rendered.select("l_orderkey", "l_partkey", "l_suppkey", I.finish_paragraph(F.col("inline")).alias("md"))


def prepared(spark, sf):
    """Blocks through the whole structuring pipeline."""
    attached = R.with_inline(K.attach_captions(routed(spark, sf)))
    top = K.two_layer_blocks(attached, ["inline", "inline_spans"])
    numbered = K.section_numbers(top, 3, F.col("type") == "title")
    return numbered.withColumn("image_path", F.when(F.col("type") == "image_body", F.concat("content", F.lit(".png"))))


# numbers of real titles only (the recursion of the section query over titles)
T_NUMBERS = NUMBERS.replace("type in ('title','table','text') and content <> ''", "type = 'title' and content <> ''").replace("with recursive", "", 1)
SPLIT = T_NUMBERS.rindex("select doc_id, page_idx, bi as block_idx")
RENDER = "with recursive " + T_NUMBERS[:SPLIT].strip() + ", numbers as (" + T_NUMBERS[SPLIT:] + "), " + ATTACHED + """,
 tl as (select a.*, coalesce((select string_agg('  ' || chr(10) || c.content, '' order by c.block_idx) from attached c
     where c.doc_id=a.doc_id and c.page_idx=a.page_idx and c.owner_idx=a.block_idx and c.block_idx<>a.block_idx), '') as caps,
   coalesce(n.section_number, '') as num
  from attached a left join numbers n on a.doc_id=n.doc_id and a.page_idx=n.page_idx and a.block_idx=n.block_idx
  where a.owner_idx is null or a.owner_idx = a.block_idx),
 md as (select doc_id, page_idx, block_idx, type, trim(case type
   when 'text' then trim(content) when 'interline_equation' then '$$' || chr(10) || content || chr(10) || '$$'
   when 'title' then (case when anchor is not null then '<a id="' || anchor || '"></a>' || chr(10) else '' end) || repeat('#', cast(level as int)) || ' '
        || (case when num <> '' then num || ' ' else '' end) || content
   when 'image_body' then '![](img/' || content || '.png)' || caps
   when 'table_body' then chr(10) || content || chr(10) || caps
   when 'chart_body' then case when content <> '' then chr(10) || content || chr(10) || caps else '' end end, chr(10)) as markdown
  from tl where not discarded)"""


@query("block_markdown", RENDER + " select doc_id, page_idx, block_idx, markdown from md where trim(markdown) <> ''", uses=("blocks",))
def block_markdown(spark, sf):
    return R.block_markdown(prepared(spark, sf), folder="img").select(*KEYS, "markdown")


@query("block_markdown_text_only", RENDER + " select doc_id, page_idx, block_idx, markdown from md where trim(markdown) <> '' and type not like '%_body'", uses=("blocks",))
def block_markdown_text_only(spark, sf):
    return R.block_markdown(prepared(spark, sf), "nlp_markdown").select(*KEYS, "markdown")


@query("document_markdown", RENDER + """ select doc_id, md5(string_agg(markdown, chr(10) || chr(10) order by page_idx, block_idx)) as h
 from md where trim(markdown) <> '' group by 1""", uses=("blocks",))
def document_markdown(spark, sf):
    doc = R.document_markdown(R.block_markdown(prepared(spark, sf), folder="img"))
    return doc.select("doc_id", F.md5("markdown").alias("h"))


@query("content_list_entries", RENDER + """ select doc_id, page_idx, block_idx, cast(discarded as int) as part,
  '{"type":"' || (case type when 'title' then 'text' when 'interline_equation' then 'equation' else replace(type,'_body','') end) || '",' ||
  (case when type='text' then '"text":"' || trim(content) || '",' when type='header' then '"text":"' || content || '",' when type='title' then '"text":"' || (case when num <> '' then num || ' ' else '' end) || content || '","text_level":' || level || ','
        when type='interline_equation' then '"text":"$$\\n' || content || '\\n$$","text_format":"latex",' else '' end) ||
  (case when type='image_body' then '"img_path":"img/' || content || '.png",' when type='chart_body' then '"img_path":"","content":"' || content || '",'
        when type='table_body' then '"table_body":"' || content || '",' else '' end) ||
  (case when type like '%_body' then '"' || replace(type,'_body','') || '_caption":[' || coalesce((select string_agg('"' || c.content || '"', ',' order by c.block_idx) from attached c
     where c.doc_id=tl.doc_id and c.page_idx=tl.page_idx and c.owner_idx=tl.block_idx and c.block_idx<>tl.block_idx), '') || '],' else '' end) ||
  '"page_idx":' || page_idx || (case when anchor is not null then ',"anchor":"' || anchor || '"' else '' end) || '}' as entry from tl""", uses=("blocks",))
def content_list_entries(spark, sf):
    return R.content_list(prepared(spark, sf), "img").select(*KEYS, "part", "entry")


@query("content_list_v2_pages", RENDER + """, e as (select doc_id, page_idx, block_idx, cast(discarded as int) as part,
  '{"type":"' || (case type when 'text' then 'paragraph' when 'interline_equation' then 'equation_interline' when 'header' then 'page_header' else replace(type,'_body','') end) || '","content":{' ||
  (case type when 'title' then '"title_content":[' || (case when num <> '' then '{"type":"text","content":"' || num || ' "},' else '' end) || '{"type":"text","content":"' || content || '"}],"level":' || level
    when 'text' then '"paragraph_content":[{"type":"text","content":"' || content || '"}]'
    when 'header' then '"page_header_content":[{"type":"text","content":"' || content || '"}]'
    when 'interline_equation' then '"math_content":"' || content || '","math_type":"latex"'
    when 'image_body' then '"image_source":{"path":"img/' || content || '.png"},"image_caption":[' || cs || ']'
    when 'table_body' then '"table_caption":[' || cs || '],"html":"' || content || '","table_type":"simple_table","table_nest_level":1'
    else '"image_source":{"path":""},"content":"' || content || '","chart_caption":[' || cs || ']' end) || '}' ||
  (case when anchor is not null then ',"anchor":"' || anchor || '"' else '' end) || '}' as entry
  from (select *, coalesce((select string_agg('{"type":"text","content":"' || c.content || '"}', ',' order by c.block_idx) from attached c
     where c.doc_id=tl.doc_id and c.page_idx=tl.page_idx and c.owner_idx=tl.block_idx and c.block_idx<>tl.block_idx and trim(c.content) <> ''), '') as cs from tl)),
 pg as (select doc_id, page_idx, '[' || string_agg(entry, ',' order by part, block_idx) || ']' as j from e group by 1,2)
 select doc_id, md5('[' || string_agg(j, ',' order by page_idx) || ']') as h from pg group by 1""", uses=("blocks",))
def content_list_v2_pages(spark, sf):
    entries = R.content_list_v2(prepared(spark, sf), "img")
    return R.document_json(entries, by_page=True).select("doc_id", F.md5("json").alias("h"))
