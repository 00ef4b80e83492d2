"""Queries: glyph duplicates, span text, and captions by geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import glyphs as G
from leafmill.operators import visuals as V
from leafmill.plans.registry import derived, query

NEAR_GLYPHS = """select cast(floor(l_orderkey / 8) as bigint) as page_id, (l_orderkey % 8) * 100 + block_idx as char_idx,
  substr('ab .', cast(1 + l_partkey % 4 as int), 1) as ch, cast(l_suppkey % 2 as string) as font, cast(0.0 as double) as rotation,
  cast((l_partkey % 3) * 8 + (l_suppkey % 5) * 0.5 as double) as x0, cast((l_partkey % 2) * 12 + (l_linenumber % 4) * 0.5 as double) as y0,
  cast((l_partkey % 3) * 8 + (l_suppkey % 5) * 0.5 + 6 as double) as x1, cast((l_partkey % 2) * 12 + (l_linenumber % 4) * 0.5 + 9 as double) as y1 from numbered"""


def as_spark(sql: str) -> str:
    return sql.replace("from numbered", "from {numbered}")


def near_glyphs(spark, sf):
    return spark.sql(as_spark(NEAR_GLYPHS), numbered=derived(spark, sf, "numbered"))


@query("glyph_near_duplicates")
def glyph_near_duplicates(spark, sf):
    return G.deduplicate_glyphs(near_glyphs(spark, sf), shadows=False)


@query("glyph_duplicates_and_shadows")
def glyph_duplicates_and_shadows(spark, sf):
    return G.deduplicate_glyphs(near_glyphs(spark, sf))


LOOSE = """select l_orderkey as page_id, cast(block_idx as bigint) as char_idx, substr('ab.(', cast(1 + l_partkey % 4 as int), 1) as ch,
  (l_partkey * 7) % 300 + l_suppkey % 20 as x0, l_suppkey % 60 + l_partkey % 7 as y0, (l_partkey * 7) % 300 + l_suppkey % 20 + 4 as x1, l_suppkey % 60 + l_partkey % 7 + 8 as y1 from numbered"""


@query("glyphs_to_spans", f"""
with g as ({LOOSE}), h as (select g.page_id, g.char_idx, s.span_idx, row_number() over (partition by g.page_id, g.char_idx order by s.y0, s.span_idx) rn
  from g join spans s on g.page_id=s.page_id and (g.y0+g.y1)/2.0 > s.y0 and (g.y0+g.y1)/2.0 < s.y1 and abs((g.y0+g.y1)/2.0-(s.y0+s.y1)/2.0) < (s.y1-s.y0)*0.33
  and (((g.x0+g.x1)/2.0 > s.x0 and (g.x0+g.x1)/2.0 < s.x1) or (ch='.' and g.x0 > s.x1-(s.y1-s.y0) and g.x0 < s.x1 and (g.x0+g.x1)/2.0 > s.x0)
    or (ch='(' and g.x1 > s.x0 and g.x1 < s.x0+(s.y1-s.y0) and (g.x0+g.x1)/2.0 < s.x1)))
select page_id, char_idx, span_idx from h where rn = 1""", uses=("spans",))
def glyphs_to_spans(spark, sf):
    g = spark.sql(as_spark(LOOSE), numbered=derived(spark, sf, "numbered"))
    return G.assign_glyphs_to_spans(g, derived(spark, sf, "spans")).select("page_id", "char_idx", "span_idx")


OWNED = """select l_orderkey as page_id, l_linenumber % 2 as span_idx, cast(block_idx as bigint) as char_idx, substr('abc d', cast(1 + l_partkey % 5 as int), 1) as ch,
  block_idx * 7 + l_partkey % 3 as x0, block_idx * 7 + l_partkey % 3 + 5 + l_suppkey % 2 as x1,
  case l_suppkey % 6 when 0 then 95 when 1 then 105 else 100 end as y0, case l_suppkey % 6 when 0 then 101 when 1 then 111 else 110 end as y1 from numbered"""
AXIS = f"""o as ({OWNED}), t as (select *, ch <> ' ' as ok, max(case when ch <> ' ' then y1-y0 end) over (partition by page_id, span_idx) as top from o),
 a as (select *, median(case when ok and y1-y0 >= top*0.9 then (y0+y1)/2.0 end) over (partition by page_id, span_idx) as ay,
   median(case when ok and y1-y0 >= top*0.9 then y1-y0 end) over (partition by page_id, span_idx) as ah from t),
 r as (select *, case when ok and ah > 0 and (y0+y1)/2.0 < ay - ah*0.15 then 'sup' when ok and ah > 0 and (y0+y1)/2.0 > ay + ah*0.15 then 'sub' else 'body' end as role from a)"""


@query("glyph_script_roles", f"with {AXIS} select page_id, span_idx, char_idx, coalesce(ay, -1) as axis_y, coalesce(ah, -1) as axis_h, role from r", uses=("numbered",))
def glyph_script_roles(spark, sf):
    o = spark.sql(as_spark(OWNED), numbered=derived(spark, sf, "numbered"))
    return G.script_roles(o).select("page_id", "span_idx", "char_idx", F.coalesce("axis_y", F.lit(-1.0)).alias("axis_y"),
                                    F.coalesce("axis_h", F.lit(-1.0)).alias("axis_h"), "role")


@query("span_texts", f"""with {AXIS},
 n as (select *, median(x1-x0) over (partition by page_id, span_idx) as mw, lead(x0) over w as nx, lead(ch) over w as nch, lead(role) over w as nrole from r window w as (partition by page_id, span_idx order by char_idx)),
 p as (select page_id, span_idx, char_idx * 2 as k, role, ch as txt from n
   union all select page_id, span_idx, char_idx * 2 + 1, case when role = nrole then role else 'body' end, ' ' from n where nx - x1 > mw * 0.25 and ch <> ' ' and nch <> ' '),
 q as (select *, lag(role) over w as pr, lead(role) over w as nr from p window w as (partition by page_id, span_idx order by k))
select page_id, span_idx, trim(string_agg((case when role <> 'body' and pr is distinct from role then '<' || role || '>' else '' end) || txt ||
  (case when role <> 'body' and nr is distinct from role then '</' || role || '>' else '' end), '' order by k)) as text from q group by 1,2""", uses=("numbered",))
def span_texts(spark, sf):
    return G.span_texts(spark.sql(as_spark(OWNED), numbered=derived(spark, sf, "numbered")))


@query("skewed_glyphs_dropped", """
with g as (select l_orderkey as page_id, cast(block_idx as bigint) as char_idx, l_linenumber % 2 as line_id, l_partkey % 3 = 0 as skew, l_orderkey % 2 = 0 as up, l_suppkey % 4 = 0 as blank from numbered),
 l as (select page_id, line_id, max(case when not skew and not blank then 1 else 0 end) as v from g where up group by 1,2)
select g.page_id, g.char_idx from g left join l on g.page_id=l.page_id and g.line_id=l.line_id where not skew or v = 1""", uses=("numbered",))
def skewed_glyphs_dropped(spark, sf):
    g = derived(spark, sf, "numbered").selectExpr(
        "l_orderkey as page_id", "block_idx as char_idx", "l_linenumber % 2 as line_id", "case when l_suppkey % 4 = 0 then ' ' else 'x' end as ch",
        "case when l_partkey % 3 = 0 then 0.7D else case when l_partkey % 2 = 0 then 0.0D else 1.5708D end end as rotation",
        "case when l_orderkey % 2 = 0 then 0.0D else 0.3D end as line_rotation", "0 as x0", "0 as y0", "5 as x1", "9 as y1")
    return G.drop_skewed(g).select("page_id", "char_idx")


VBLOCKS = """select doc_id, page_idx, block_idx, case type when 'image' then 'image_body' when 'table' then 'table_body' when 'chart' then 'chart_body' when 'equation' then 'footnote' else type end as type,
  case when doc_id % 2 = 0 then 'Table 1 (continued)' else content end as content, x0, y0, x1, y1, case when level = 3 then 2 else 1 end as lines from blocks"""


def vblocks(spark, sf):
    return spark.sql(VBLOCKS.replace("from blocks", "from {blocks}"), blocks=derived(spark, sf, "blocks"))


@query("inline_caption_fragments", f"""
with b as ({VBLOCKS}), e as (select * from b where type not in ('header','footer','page_number','page_footnote','aside_text')),
 n as (select *, lag(type) over w as pt, lag(y0) over w as py0, lag(y1) over w as py1, lead(type) over w as nt, lead(y0) over w as ny0 from e window w as (partition by doc_id, page_idx order by block_idx)),
 h as (select doc_id, page_idx, block_idx, type in ('text','footnote') and pt='caption' and nt in ('image_body','table_body','chart_body')
   and ((least(py1,y1)-greatest(py0,y0))*1.0/least(py1-py0,y1-y0) >= 0.6 or abs((py0+py1)/2.0-(y0+y1)/2.0) <= greatest(py1-py0,y1-y0)*0.5)
   and ny0 - greatest(py1,y1) between 0 and greatest(12, greatest(py1-py0,y1-y0)*1.5) as hit from n)
select b.doc_id, b.page_idx, b.block_idx, case when hit then 'caption' else type end as type from b left join h using (doc_id, page_idx, block_idx)""", uses=("blocks",))
def inline_caption_fragments(spark, sf):
    return V.inline_caption_fragments(vblocks(spark, sf), ("image_body", "table_body", "chart_body")).select(*V.KEYS, "type")


# rows moved close together so that clusters form
TIGHT = f"select doc_id, page_idx, block_idx, type, content, lines, x0, block_idx * 30 + (y0 % 5) as y0, x1, block_idx * 30 + (y0 % 5) + 22 as y1 from ({VBLOCKS})"


def tight(spark, sf):
    return vblocks(spark, sf).selectExpr("doc_id", "page_idx", "block_idx", "type", "content", "lines", "x0", "block_idx * 30 + (y0 % 5) as y0", "x1", "block_idx * 30 + (y0 % 5) + 22 as y1")


@query("stacked_caption_fragments", f"""
with recursive b as ({TIGHT}), t as (select * from b where type='table_body'),
 c as (select b.*, t.block_idx as t_idx, t.y0 as ty0 from b join t on b.doc_id=t.doc_id and b.page_idx=t.page_idx and b.type in ('caption','text','footnote') and b.y1 <= t.y0
   and not (b.x1 < t.x0 - greatest(12,(t.x1-t.x0)*0.03) or b.x0 > t.x1 + greatest(12,(t.x1-t.x0)*0.03))),
 w as (select *, coalesce(lag(y0) over (partition by doc_id, page_idx, t_idx order by y0 desc, block_idx desc), ty0) - y1 as gap from c),
 k as (select *, sum(case when gap between 0 and 33 then 0 else 1 end) over (partition by doc_id, page_idx, t_idx order by y0 desc, block_idx desc) as out from w),
 m as (select *, row_number() over (partition by doc_id, page_idx, t_idx order by y0 desc, block_idx desc) as p, dense_rank() over (partition by doc_id, page_idx order by t_idx) as r from k where out=0),
 cl as (select doc_id, page_idx, r, list({{'p': p, 'b': block_idx, 'cap': type = 'caption', 'ok': type <> 'caption' and lines <= 1}}) as xs from m group by 1, 2, 3),
 rc as (select distinct doc_id, page_idx, cast(0 as bigint) as r, cast([] as bigint[]) as pr from cl
  union all
  select rc.doc_id, rc.page_idx, rc.r + 1, list_concat(rc.pr, list_transform(list_filter(cl.xs, lambda x: x.ok and x.p < list_min(list_transform(list_filter(cl.xs, lambda y: y.cap or list_contains(rc.pr, y.b)), lambda z: z.p))), lambda x: x.b))
  from rc join cl on cl.doc_id = rc.doc_id and cl.page_idx = rc.page_idx and cl.r = rc.r + 1),
 h as (select distinct doc_id, page_idx, unnest(pr) as block_idx, true as hit from rc)
select b.doc_id, b.page_idx, b.block_idx, case when hit then 'caption' else type end as type from b left join h using (doc_id, page_idx, block_idx)""", uses=("blocks",))
def stacked_caption_fragments(spark, sf):
    return V.stacked_caption_fragments(tight(spark, sf)).select(*V.KEYS, "type")


@query("leading_continuation_captions", f"""
with b as ({TIGHT}), e as (select *, row_number() over w as pos, lead(y0) over w as ny from b where type not in ('header','footer','page_number','page_footnote','aside_text') window w as (partition by doc_id, page_idx order by block_idx)),
 l as (select *, type in ('text','footnote') and lines <= 1 and content like '%(continued)' as ld from e),
 f as (select doc_id, page_idx, min(pos) as fp from l where not ld group by 1,2),
 r as (select l.*, t.type as tt, t.x0 as tx0, t.x1 as tx1 from l join f on l.doc_id=f.doc_id and l.page_idx=f.page_idx and l.pos < f.fp join l t on t.doc_id=f.doc_id and t.page_idx=f.page_idx and t.pos=f.fp),
 g as (select doc_id, page_idx, min(case when tt='table_body' and ny - y1 <= 33 and ny - y1 >= -6.6
    and not (x1 < tx0 - greatest(12,(tx1-tx0)*0.03) or x0 > tx1 + greatest(12,(tx1-tx0)*0.03)) then 1 else 0 end) as good from r group by 1,2)
select b.doc_id, b.page_idx, b.block_idx, case when h.block_idx is not null then 'caption' else b.type end as type from b left join
 (select r.doc_id, r.page_idx, r.block_idx from r join g on r.doc_id=g.doc_id and r.page_idx=g.page_idx and good=1) h
 on b.doc_id=h.doc_id and b.page_idx=h.page_idx and b.block_idx=h.block_idx""", uses=("blocks",))
def leading_continuation_captions(spark, sf):
    return V.leading_continuations(tight(spark, sf)).select(*V.KEYS, "type")


PARENTS = f"""b as ({VBLOCKS}), o as (select *, row_number() over (partition by doc_id, page_idx order by block_idx) as pos from b),
 p as (select c.doc_id, c.page_idx, c.block_idx, c.type, c.pos, c.x0, c.y0, c.x1, c.y1, m.block_idx as mi, m.type as mt, m.pos as mp, m.x0 as mx0, m.y0 as my0, m.x1 as mx1, m.y1 as my1
   from o c join o m on c.doc_id=m.doc_id and c.page_idx=m.page_idx and c.type in ('caption','footnote') and m.type in ('image_body','table_body','chart_body')
   and not (c.type='footnote' and c.block_idx < m.block_idx)),
 v as (select *, abs(pos-mp) - (select count(*) from o z where z.doc_id=p.doc_id and z.page_idx=p.page_idx and z.pos > least(p.pos,p.mp) and z.pos < greatest(p.pos,p.mp) and z.type=p.type) as diff
   from p where not exists (select 1 from o z where z.doc_id=p.doc_id and z.page_idx=p.page_idx and z.pos > least(p.pos,p.mp) and z.pos < greatest(p.pos,p.mp)
     and not (z.type='caption' or (p.type='footnote' and z.type='footnote'))
     and not ((p.y1 <= p.my0 or p.my1 <= p.y0)
       and not (z.x1 > p.x0 and z.x0 < p.x1 and z.y1 > p.y0 and z.y0 < p.y1) and not (z.x1 > p.mx0 and z.x0 < p.mx1 and z.y1 > p.my0 and z.y0 < p.my1)
       and not (z.y0 < greatest(p.y0,p.my0) and z.y1 > least(p.y1,p.my1))))),
 d as (select *, sqrt(power(greatest(0, mx0-x1, x0-mx1),2)+power(greatest(0, my0-y1, y0-my1),2)) as e,
   sqrt(power((x0+x1-mx0-mx1)/2.0,2)+power((y0+y1-my0-my1)/2.0,2)) as ce from (select *, min(diff) over (partition by doc_id, page_idx, block_idx) as md from v) where diff=md),
 s as (select *, max(e) over w - min(e) over w as spread, min(case when mt='table_body' then 1 else 0 end) over w as tabs from d window w as (partition by doc_id, page_idx, block_idx)),
 par as (select doc_id, page_idx, block_idx, type, mi as parent_idx from (select *, row_number() over (partition by doc_id, page_idx, block_idx order by
   case when spread > 2 then e when type='caption' and tabs=1 then -mi when type='footnote' then mi else ce end, mi) rn from s) where rn=1)"""


@query("visual_parents", f"with {PARENTS} select doc_id, page_idx, block_idx, parent_idx from par", uses=("blocks",))
def visual_parents(spark, sf):
    return V.visual_parents(vblocks(spark, sf))


@query("visual_groups", f"""with {PARENTS}
select b.doc_id, b.page_idx, b.block_idx, replace(b.type,'_body','') as visual, coalesce((select string_agg(cast(c.block_idx as string) || c.type, ',' order by c.block_idx) from par c
  where c.doc_id=b.doc_id and c.page_idx=b.page_idx and c.parent_idx=b.block_idx), '') as children from b where type like '%_body'
union all select b.doc_id, b.page_idx, b.block_idx, 'unmatched', b.type from b left join par on b.doc_id=par.doc_id and b.page_idx=par.page_idx and b.block_idx=par.block_idx
 where b.type in ('caption','footnote') and par.block_idx is null""", uses=("blocks",))
def visual_groups(spark, sf):
    mains, rest = V.regroup_visuals(vblocks(spark, sf))
    kids = F.array_join(F.transform("children", lambda c: F.concat(c["child_idx"].cast("string"), c["type"])), ",")
    a = mains.select(*V.KEYS, "visual", F.coalesce(kids, F.lit("")).alias("children"))
    return a.unionAll(rest.select(*V.KEYS, F.lit("unmatched"), "type"))
