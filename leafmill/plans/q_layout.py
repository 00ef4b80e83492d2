"""Queries: lines, columns, spatial joins and reading order."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import boxes as B
from leafmill.operators import layout as L
from leafmill.plans.registry import derived, query

LINES = """prev as (select *, lag(type) over w as pt, lag(y0) over w as py0, lag(y1) over w as py1 from spans window w as (partition by page_id order by y0, span_idx)),
 lined as (select *, sum(case when py0 is null or type in ('image','table','interline_equation') or pt in ('image','table','interline_equation')
    or not (greatest(0, least(y1,py1)-greatest(y0,py0)) * 1.0 / least(y1-y0,py1-py0) > 0.6) then 1 else 0 end)
  over (partition by page_id order by y0, span_idx) as line_id from prev)"""


def spans(spark, sf):
    return derived(spark, sf, "spans")


@query("lines_from_spans", f"""with {LINES}
select page_id, span_idx, cast(line_id as bigint) as line_id, row_number() over (partition by page_id, line_id order by x0, y0, span_idx) as pos from lined""", uses=("spans",))
def lines_from_spans(spark, sf):
    return L.order_in_lines(L.assign_lines(spans(spark, sf))).select("page_id", "span_idx", "line_id", "pos")


@query("line_boxes", f"""with {LINES}
select page_id, cast(line_id as bigint) as line_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n,
  round(least(1.0, sum((x1-x0)*(y1-y0)) * 1.0 / ((max(x1)-min(x0))*(max(y1)-min(y0)))), 9) as density from lined group by 1,2""", uses=("spans",))
def line_boxes(spark, sf):
    return L.line_boxes(L.assign_lines(spans(spark, sf))).withColumn("density", F.round("density", 9))


@query("vertical_text_blocks", """
select page_id, count(case when (y1-y0)*1.0/(x1-x0) > 2 then 1 end) * 1.0 / count(*) > 0.8 as vertical from tall_spans group by 1""", uses=("tall_spans",))
def vertical_text_blocks(spark, sf):
    return L.vertical_pages(derived(spark, sf, "tall_spans"))


@query("text_blocks_to_lines", """
with s as (select page_id, span_idx, x0, y0, x1, y1, case when type='interline_equation' then 'inline_equation' else type end as type from tall_spans),
 v as (select page_id, count(case when (y1-y0)*1.0/(x1-x0) > 2 then 1 end) * 1.0 / count(*) > 0.8 as vertical from s group by 1),
 o as (select s.*, v.vertical, case when v.vertical then -x1 else y0 end as k, case when v.vertical then x0 else y0 end as lo, case when v.vertical then x1 else y1 end as hi
    from s join v using (page_id)),
 p as (select *, lag(type) over w as pt, lag(lo) over w as plo, lag(hi) over w as phi from o window w as (partition by page_id order by k, span_idx)),
 l as (select *, sum(case when plo is null or type='image' or pt='image' or not (greatest(0, least(hi,phi)-greatest(lo,plo))*1.0/least(hi-lo,phi-plo) > 0.6) then 1 else 0 end)
    over (partition by page_id order by k, span_idx) as line_id from p)
select page_id, span_idx, type, vertical, cast(line_id as bigint) as line_id,
  row_number() over (partition by page_id, line_id order by case when vertical then y0 else x0 end, k, span_idx) as pos from l""", uses=("tall_spans",))
def text_blocks_to_lines(spark, sf):
    return L.fix_text_blocks(derived(spark, sf, "tall_spans")).select("page_id", "span_idx", "type", "vertical", "line_id", "pos")


@query("interval_union", """
with i as (select page_id, x0 as lo, x1 as hi from spans),
 e as (select *, max(hi) over (partition by page_id order by lo, hi rows between unbounded preceding and 1 preceding) as pe from i),
 g as (select *, sum(case when pe is null or pe < lo then 1 else 0 end) over (partition by page_id order by lo, hi rows unbounded preceding) as k from e)
select page_id, min(lo) as lo, max(hi) as hi from g group by page_id, k""", uses=("spans",))
def interval_union(spark, sf):
    return L.merge_intervals(spans(spark, sf).selectExpr("page_id", "x0 as lo", "x1 as hi"), ["page_id"])


@query("interval_subtraction", """
with r as (select page_id, 0 as lo, 250 as hi from spans group by 1), m as (select page_id, x0, x1 from spans where type='image'),
 pts as (select page_id, unnest(range(0, 251)) as x from r),
 free as (select p.page_id, p.x from pts p where not exists (select 1 from m where m.page_id=p.page_id and p.x between m.x0 and m.x1)),
 g as (select page_id, x, x - row_number() over (partition by page_id order by x) as k from free)
select page_id, min(x) as lo, max(x) as hi from g group by page_id, k""", uses=("spans",))
def interval_subtraction(spark, sf):
    s = spans(spark, sf)
    ranges = s.select("page_id").distinct().selectExpr("page_id", "cast(0 as bigint) as lo", "cast(250 as bigint) as hi")
    masks = s.where("type = 'image'").selectExpr("page_id", "x0 as lo", "x1 as hi")
    # neighbouring masks may leave one free point between them, as in the point model
    return L.subtract_intervals(ranges, masks, ["page_id"])


@query("text_cut_by_formulas", """
with t as (select * from spans where type='text'), f as (select * from spans where type='interline_equation'),
 m as (select t.page_id, t.span_idx, f.x0, f.x1 from t join f on t.page_id=f.page_id
    and greatest(0, least(t.y1,f.y1)-greatest(t.y0,f.y0))*1.0/least(t.y1-t.y0,f.y1-f.y0) > 0.8),
 pts as (select page_id, span_idx, y0, y1, unnest(range(x0, x1 + 1)) as x from t),
 free as (select * from pts p where not exists (select 1 from m where m.page_id=p.page_id and m.span_idx=p.span_idx and p.x between m.x0 and m.x1)),
 g as (select *, x - row_number() over (partition by page_id, span_idx order by x) as k from free)
select page_id, span_idx, min(x) as x0, max(x) as x1, min(y0) as y0, min(y1) as y1 from g group by page_id, span_idx, k""", uses=("spans",))
def text_cut_by_formulas(spark, sf):
    s = spans(spark, sf)
    return L.cut_text_by_formulas(s.where("type = 'text'"), s.where("type = 'interline_equation'").select("page_id", "x0", "y0", "x1", "y1"))


@query("detected_box_merge", """
with b as (select *, span_idx % 7 = 6 as skewed from spans),
 p as (select *, lag(y0) over w as py0, lag(y1) over w as py1 from b where not skewed window w as (partition by page_id order by y0, span_idx)),
 l as (select *, sum(case when py0 is null or not (greatest(0, least(y1,py1)-greatest(y0,py0))*1.0/least(y1-y0,py1-py0) > 0.6) then 1 else 0 end)
   over (partition by page_id order by y0, span_idx) as line_id from p),
 e as (select page_id, line_id, max(x1)-min(x0) > 4*(max(y1)-min(y0)) as wide from l group by 1,2),
 n as (select l.*, e.wide, max(x1) over (partition by l.page_id, l.line_id order by x0, y0, span_idx rows between unbounded preceding and 1 preceding) as pe
   from l join e on l.page_id=e.page_id and l.line_id=e.line_id),
 g as (select *, sum(case when not wide or pe is null or pe < x0 then 1 else 0 end) over (partition by page_id, line_id order by x0, y0, span_idx rows unbounded preceding) as k from n)
select page_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from g group by page_id, line_id, k
union all select page_id, x0, y0, x1, y1 from b where skewed""", uses=("spans",))
def detected_box_merge(spark, sf):
    return L.merge_detected_boxes(spans(spark, sf).withColumn("skewed", F.col("span_idx") % 7 == 6))


BLOCK_GRID = "bl as (select page_id, span_idx as block_idx, x0 - 40 as x0, y0 - 6 as y0, x1 + 40 as x1, y1 + 6 as y1 from spans where span_idx % 3 = 0)"


def block_grid(s):
    return s.where("span_idx % 3 = 0").selectExpr("page_id", "span_idx as block_idx", "x0 - 40 as x0", "y0 - 6 as y0", "x1 + 40 as x1", "y1 + 6 as y1")


@query("spans_to_blocks", f"""with {BLOCK_GRID}
select s.page_id, s.span_idx, coalesce(min(b.block_idx), -1) as block_idx from spans s left join bl b on s.page_id=b.page_id
  and least(s.x1,b.x1) > greatest(s.x0,b.x0) and least(s.y1,b.y1) > greatest(s.y0,b.y0)
  and (least(s.x1,b.x1)-greatest(s.x0,b.x0))*(least(s.y1,b.y1)-greatest(s.y0,b.y0))*1.0/((s.x1-s.x0)*(s.y1-s.y0)) > 0.5 group by 1,2""", uses=("spans",))
def spans_to_blocks(spark, sf):
    s = spans(spark, sf)
    return L.assign_spans_to_blocks(s, block_grid(s)).select("page_id", "span_idx", F.coalesce("block_idx", F.lit(-1)).alias("block_idx"))


@query("contained_boxes_dropped", """
with b as (select page_id, span_idx, (x0 % 40) as x0, y0 % 9 as y0, x0 % 40 + 10 + (x1 % 40) as x1, y0 % 9 + y1 - y0 as y1 from spans)
select page_id, span_idx from b where not exists (select 1 from b o where o.page_id=b.page_id and o.span_idx<>b.span_idx
  and b.x0>=o.x0 and b.y0>=o.y0 and b.x1<=o.x1 and b.y1<=o.y1)""", uses=("spans",))
def contained_boxes_dropped(spark, sf):
    b = spans(spark, sf).selectExpr("page_id", "span_idx", "x0 % 40 as x0", "y0 % 9 as y0", "x0 % 40 + 10 + (x1 % 40) as x1", "y0 % 9 + y1 - y0 as y1")
    return L.drop_contained(b).select("page_id", "span_idx")


@query("members_in_containers", f"""with {BLOCK_GRID},
 c as (select s.page_id, s.span_idx as block_idx, b.block_idx as container_idx,
   (least(s.x1,b.x1)-greatest(s.x0,b.x0))*(least(s.y1,b.y1)-greatest(s.y0,b.y0))*1.0/((s.x1-s.x0)*(s.y1-s.y0)) as cover, (b.x1-b.x0)*(b.y1-b.y0) as area,
   s.x0 as a0, s.y0 as a1, s.x1 as a2, s.y1 as a3, b.x0 as b0, b.y0 as b1, b.x1 as b2, b.y1 as b3
  from spans s join bl b on s.page_id=b.page_id and s.span_idx % 3 <> 0 and least(s.x1,b.x1) > greatest(s.x0,b.x0) and least(s.y1,b.y1) > greatest(s.y0,b.y0)),
 r as (select *, row_number() over (partition by page_id, block_idx order by cover desc, area, container_idx) rn from c where cover >= 0.9)
select page_id, block_idx, container_idx, round(least(greatest((a0-b0)*1.0/(b2-b0),0.0),1.0),3) as x0, round(least(greatest((a1-b1)*1.0/(b3-b1),0.0),1.0),3) as y0,
  round(least(greatest((a2-b0)*1.0/(b2-b0),0.0),1.0),3) as x1, round(least(greatest((a3-b1)*1.0/(b3-b1),0.0),1.0),3) as y1 from r where rn=1""", uses=("spans",))
def members_in_containers(spark, sf):
    s = spans(spark, sf)
    members = s.where("span_idx % 3 <> 0").selectExpr("page_id", "span_idx as block_idx", "x0", "y0", "x1", "y1")
    return L.assign_members_to_containers(members, block_grid(s))


@query("span_triage", """
with t as (select *, median(y1-y0) over (partition by page_id) as m from tall_spans)
select page_id, span_idx, (y1-y0) > 2.3*m and (y1-y0) > 2.3*(x1-x0) as tall, (x0 % 3)*(y1-y0) < 0.5*(x1-x0) as reread from t""", uses=("tall_spans",))
def span_triage(spark, sf):
    s = derived(spark, sf, "tall_spans").withColumn("content", F.expr("repeat('a', cast(x0 % 3 as int))"))
    return L.span_triage(s).select("page_id", "span_idx", "tall", "reread")


@query("nested_group_boxes", """
select page_id, span_idx, case span_idx % 3 when 0 then x0 * 1.0 when 1 then x0 * 2.0 + 10 else (x0 * 0.5 + 4) * 2.0 + 10 end as x0,
  case span_idx % 3 when 0 then y1 * 1.0 when 1 then y1 * 1.0 + 20 else (y1 * 3.0 + 1) * 1.0 + 20 end as y1 from spans""", uses=("spans",))
def nested_group_boxes(spark, sf):
    s = spans(spark, sf)
    ids = s.select("page_id").distinct()
    outer = ids.selectExpr("page_id", "1 as group_id", "cast(null as int) as parent_id", "2.0D as sx", "1.0D as sy", "10.0D as tx", "20.0D as ty")
    inner = ids.selectExpr("page_id", "2 as group_id", "1 as parent_id", "0.5D as sx", "3.0D as sy", "4.0D as tx", "1.0D as ty")
    shapes = s.selectExpr("page_id", "span_idx", "cast(nullif(span_idx % 3, 0) as int) as group_id", "double(x0) x0", "double(y0) y0", "double(x1) x1", "double(y1) y1")
    return L.compose_transforms(outer.unionAll(inner), shapes).select("page_id", "span_idx", "x0", "y1")


@query("rectangle_union_area", """
with c as (select page_id, x, y from (select page_id, unnest(range(x0, x1)) as x, y0, y1 from (select page_id, x0 % 60 as x0, x0 % 60 + x1 - x0 as x1, y0, y1 from spans)) a, lateral (select unnest(range(a.y0, a.y1)) as y) b)
select page_id, count(distinct x * 1000 + y) as area from c group by 1""", uses=("spans",))
def rectangle_union_area(spark, sf):
    s = spans(spark, sf).selectExpr("page_id", "x0 % 60 as x0", "x0 % 60 + x1 - x0 as x1", "y0", "y1")
    return L.union_area(s, ["page_id"])


@query("background_pictures", """
with p as (select * from spans where type='image'), t as (select * from spans where type='text'),
 c as (select p.page_id, p.span_idx as block_idx, (p.x1-p.x0)*(p.y1-p.y0) as whole, unnest(range(greatest(p.x0,t.x0), least(p.x1,t.x1))) as x, greatest(p.y0,t.y0) as y0, least(p.y1,t.y1) as y1
   from p join t on p.page_id=t.page_id and t.span_idx > p.span_idx and least(p.x1,t.x1) > greatest(p.x0,t.x0) and least(p.y1,t.y1) > greatest(p.y0,t.y0)),
 d as (select page_id, block_idx, whole, x, unnest(range(y0, y1)) as y from c),
 a as (select page_id, block_idx, min(whole) as whole, count(distinct x * 1000 + y) as area from d group by 1,2)
select page_id, block_idx, area from a where area * 1.0 / whole >= 0.1""", uses=("spans",))
def background_pictures(spark, sf):
    s = spans(spark, sf).selectExpr("page_id", "span_idx as block_idx", "type", "x0", "y0", "x1", "y1")
    return L.background_pictures(s.where("type = 'image'").drop("type"), s.where("type = 'text'").drop("type"))


@query("reading_order_top_left", """
select page_id, span_idx, row_number() over (partition by page_id order by y0, x0, span_idx) as position from spans""", uses=("spans",))
def reading_order_top_left(spark, sf):
    return L.reading_order(spans(spark, sf)).select("page_id", "span_idx", "position")


@query("reading_order_tolerant")
def reading_order_tolerant(spark, sf):
    return L.tolerant_reading_order(spans(spark, sf))


@query("reading_order_xy_cut")
def reading_order_xy_cut(spark, sf):
    return L.xy_cut_order(spans(spark, sf))


@query("reading_order_xy_cut_cross_layout")
def reading_order_xy_cut_cross_layout(spark, sf):
    return L.xy_cut_order(spans(spark, sf), beta=0.7)
