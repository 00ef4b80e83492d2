"""Queries: table structure, merging over pages, chart data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import tables as T
from leafmill.operators.page_merge import merge_page_tables
from leafmill.plans.registry import derived, query
from leafmill.session import checkpointed, written

# cells one after the other, remembering occupied squares as row * 100 + column (spans are at most 2)
PLACED = """with recursive o as (select *, row_number() over (partition by table_id order by row_idx, cell_idx) as n from cells),
 s as (select table_id, n, row_idx, cell_idx, text, rowspan, colspan, cast(0 as bigint) as col,
    list_distinct([row_idx*100, row_idx*100+colspan-1, (row_idx+rowspan-1)*100, (row_idx+rowspan-1)*100+colspan-1]) as occ from o where n=1
  union all
  select t.table_id, t.n, t.row_idx, t.cell_idx, t.text, t.rowspan, t.colspan, t.col,
    list_concat(t.occ, list_distinct([t.row_idx*100+t.col, t.row_idx*100+t.col+t.colspan-1, (t.row_idx+t.rowspan-1)*100+t.col, (t.row_idx+t.rowspan-1)*100+t.col+t.colspan-1]))
  from (select o.*, s.occ, list_filter(range(case when o.row_idx=s.row_idx then s.col+s.colspan else 0 end, 40), lambda c: not list_contains(s.occ, o.row_idx*100+c))[1] as col
    from s join o on o.table_id=s.table_id and o.n=s.n+1) t),
 placed as (select table_id, row_idx, cell_idx, text, rowspan, colspan, col from s),
 grid as (select table_id, row_idx, cell_idx, text, row_idx + a.i as row, col + b.i as c from placed, range(2) a(i), range(2) b(i) where a.i < rowspan and b.i < colspan)"""


def cells(spark, sf):
    return derived(spark, sf, "cells")


def placed(spark, sf):
    return T.place_cells(cells(spark, sf))


@query("table_grid_placement", PLACED + " select table_id, row_idx, cell_idx, col from placed", uses=("cells",))
def table_grid_placement(spark, sf):
    return placed(spark, sf).select("table_id", "row_idx", "cell_idx", "col")


@query("table_row_metrics", PLACED + """ select p.table_id, p.row_idx, cast(sum(colspan) as bigint) as actual_cols, count(*) as visual_cols,
  (select max(c) + 1 from grid g where g.table_id=p.table_id and g.row=p.row_idx) as effective_cols from placed p group by 1,2""", uses=("cells",))
def table_row_metrics(spark, sf):
    return T.row_metrics(placed(spark, sf))


@query("table_metrics", PLACED + """ select table_id, max(col+colspan) as total_cols, max(row_idx)+1 as rows, max(row_idx) as last_row,
  max(row_idx+rowspan-1)-max(row_idx) as tail_rows from placed group by 1""", uses=("cells",))
def table_metrics(spark, sf):
    return T.table_metrics(placed(spark, sf))


@query("table_carried_columns", PLACED + """ select distinct g.table_id, g.row - m.last - 1 as row_offset, g.c as col from grid g
  join (select table_id, max(row_idx) as last from placed group by 1) m on g.table_id=m.table_id and g.row > m.last""", uses=("cells",))
def table_carried_columns(spark, sf):
    return T.carried_columns(placed(spark, sf))


@query("table_rendered_segments", PLACED + """,
 g1 as (select table_id, row, c, max(row_idx * 1000 + cell_idx) as src from grid group by 1,2,3),
 g2 as (select *, case when lag(src) over w = src and lag(c) over w = c - 1 then 0 else 1 end as st from g1 window w as (partition by table_id, row order by c)),
 g3 as (select *, sum(st) over (partition by table_id, row order by c) as k from g2)
 select table_id, row, min(c) as start_col, max(c)+1 as end_col, min(src) as src from g3 group by table_id, row, k""", uses=("cells",))
def table_rendered_segments(spark, sf):
    p = placed(spark, sf).withColumn("text", (F.col("row_idx") * 1000 + F.col("cell_idx")).cast("string"))
    return T.rendered_segments(p).select("table_id", "row", "start_col", "end_col", F.col("text").cast("long").alias("src"))


HTML = """select table_id, '<table>' || string_agg('<tr>' || r || '</tr>', '' order by row_idx) || '</table>' as html from (
  select table_id, row_idx, string_agg('<' || t || case when rowspan > 1 then ' rowspan="' || rowspan || '"' else '' end || case when colspan > 1 then ' colspan="' || colspan || '"' else '' end
    || '>' || text || '</' || t || '>', '' order by cell_idx) as r from (select *, case when row_idx = 0 then 'th' else 'td' end as t from cells) group by 1,2) group by 1"""


@query("cells_to_html", HTML, uses=("cells",))
def cells_to_html(spark, sf):
    return T.cells_to_html(cells(spark, sf))


@query("html_to_cells", "select table_id, row_idx, cell_idx, text, rowspan, colspan from cells", uses=("cells",))
def html_to_cells(spark, sf):
    return T.parse_cells(T.cells_to_html(cells(spark, sf)))


NESTED = """with k as (select *, row_number() over (partition by table_id // 4 order by table_id) as r from (select distinct table_id from cells)),
 c as (select cells.*, table_id // 4 as doc, r from cells join k using (table_id))"""
for _r in (4, 3, 2, 1):
    _inner = "c.text" if _r == 4 else f"c.text || case when c.row_idx = 0 and c.cell_idx = 0 then coalesce(h{_r + 1}.html, '') else '' end"
    _join = "" if _r == 4 else f" left join h{_r + 1} on h{_r + 1}.doc = c.doc"
    NESTED += f""",
 c{_r} as (select c.doc, c.r, c.row_idx, c.cell_idx, {_inner} as text, c.rowspan, c.colspan from c{_join} where c.r = {_r}),
 h{_r} as (select doc, '<table>' || string_agg('<tr>' || x || '</tr>', '' order by row_idx) || '</table>' as html from (
   select doc, row_idx, string_agg('<' || t || case when rowspan > 1 then ' rowspan="' || rowspan || '"' else '' end || case when colspan > 1 then ' colspan="' || colspan || '"' else '' end
     || '>' || text || '</' || t || '>', '' order by cell_idx) as x from (select *, case when row_idx = 0 then 'th' else 'td' end as t from c{_r}) group by 1, 2) group by 1)"""


@query("nested_table_cells", NESTED + """, a as (select * from c1 union all select * from c2 union all select * from c3 union all select * from c4)
select doc as table_id, r as table_no, r as depth, r - 1 as parent_no, case when r > 1 then 0 else -1 end as parent_row, case when r > 1 then 0 else -1 end as parent_cell,
  row_idx, cell_idx, md5(text) as text_md5, rowspan, colspan from a""", uses=("cells",))
def nested_table_cells(spark, sf):
    """Four tables in each other: every next one lies in the first cell of the one before."""
    c = cells(spark, sf).withColumn("doc", F.expr("table_id div 4"))
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy("table_id"))
    c = c.withColumn("r", rank).drop("table_id").withColumnRenamed("doc", "table_id")
    html = None
    for r in (4, 3, 2, 1):
        here = c.where(F.col("r") == r)
        if html is not None:
            first = (F.col("row_idx") == 0) & (F.col("cell_idx") == 0)
            here = here.join(html, "table_id", "left").withColumn("text", F.concat("text", F.when(first, F.coalesce("html", F.lit(""))).otherwise("")))
        html = written(T.cells_to_html(here, escape=False))
    found = T.parse_nested_cells(html)
    parent = {c: F.coalesce(c, F.lit(d)) for c, d in (("parent_no", 0), ("parent_row", -1), ("parent_cell", -1))}
    return found.withColumns({**parent, "text": F.md5("text")}).withColumnRenamed("text", "text_md5")


@query("colspan_normalization", """
with r as (select table_id, row_idx, sum(colspan) as w, max(rowspan) as mr from cells group by 1,2),
 f as (select table_id, w, count(*) n, min(row_idx) f0 from r group by 1,2),
 t as (select table_id, w as target from (select *, row_number() over (partition by table_id order by n desc, f0) k from f) where k=1),
 ok as (select table_id from r group by 1 having max(mr) = 1),
 c as (select cells.*, greatest(coalesce(case when ok.table_id is not null then r.w - t.target end, 0), 0) as ex,
    coalesce(sum(colspan-1) over (partition by cells.table_id, cells.row_idx order by cell_idx rows between unbounded preceding and 1 preceding), 0) as given
  from cells join r on cells.table_id=r.table_id and cells.row_idx=r.row_idx join t on t.table_id=cells.table_id left join ok on ok.table_id=cells.table_id)
select table_id, row_idx, cell_idx, cast(colspan - greatest(least(colspan-1, ex-given), 0) as int) as colspan from c""", uses=("cells",))
def colspan_normalization(spark, sf):
    return T.normalize_colspans(cells(spark, sf)).select("table_id", "row_idx", "cell_idx", "colspan")


@query("table_signatures", """
select table_id, count(distinct row_idx) as rows, count(*) as cells, cast(sum(case when text = '' then 1 else 0 end) as bigint) as images,
  string_agg(text, '' order by row_idx, cell_idx) as text from cells group by 1""", uses=("cells",))
def table_signatures(spark, sf):
    c = cells(spark, sf).withColumn("text", F.when(F.col("text") == "", "<img src='x'>").otherwise(F.concat(F.lit(" "), "text")))
    return T.table_signatures(c)


@query("table_alignment", """with recursive sg as (
  select table_id // 8 as doc_id, table_id % 8 as ord, count(distinct row_idx) as n_rows, count(*) as n_cells,
    string_agg(regexp_replace(text, '\\s+', '', 'g'), '' order by row_idx, cell_idx) as body from cells group by table_id),
 lt as (select *, row_number() over (partition by doc_id order by ord) as k from sg where ord % 3 <> 1),
 mt as (select lt.doc_id, lt.k, lt.ord as l_ord, r.ord as r_ord from lt join sg r on r.doc_id = lt.doc_id where
   (lt.body <> '' and r.body <> '' and (starts_with(lt.body, r.body) or starts_with(r.body, lt.body)) and (lt.n_rows = r.n_rows or lt.n_cells = r.n_cells))
   or (lt.body = '' and r.body = '' and lt.n_rows = r.n_rows and lt.n_cells = r.n_cells)),
 sz as (select doc_id, max(k) as m from lt group by 1),
 wk as (select doc_id, cast(0 as bigint) as k, cast(-1 as bigint) as last_r, cast(null as bigint) as l_ord, cast(null as bigint) as r_ord from sz
  union all
  select doc_id, k + 1, coalesce(nxt, last_r), l, nxt from (
    select wk.doc_id, wk.k, wk.last_r, (select min(mt.r_ord) from mt where mt.doc_id = wk.doc_id and mt.k = wk.k + 1 and mt.r_ord > wk.last_r) as nxt, lt.ord as l
    from wk join sz on sz.doc_id = wk.doc_id and wk.k < sz.m join lt on lt.doc_id = wk.doc_id and lt.k = wk.k + 1) t)
select doc_id, l_ord, r_ord from wk where r_ord is not null""", uses=("cells",))
def table_alignment(spark, sf):
    sig = T.table_signatures(cells(spark, sf))
    listed = sig.selectExpr("cast(floor(table_id / 8) as bigint) as doc_id", "table_id % 8 as ord", "rows", "cells", "images", "text")
    return T.align_tables(listed.where("ord % 3 <> 1"), listed)


def page_tables(spark, sf):
    """Every order is a page with one table; its first row repeats on the pages of a document."""
    c = cells(spark, sf)
    head = c.where("row_idx = 0").selectExpr("table_id", "row_idx", "cell_idx", "'h' || cell_idx as text", "1 as rowspan", "1 as colspan")
    body = c.selectExpr("table_id", "row_idx + 1 as row_idx", "cell_idx", "text", "rowspan", "colspan")
    ids = written(c.select("table_id").distinct())
    pages = ids.selectExpr(
        "cast(floor(table_id / 4) as bigint) as doc_id", "table_id % 4 as page_idx", "cast(0 as bigint) as block_idx", "'table' as type", "table_id",
        "cast(0 as bigint) as x0", "100 + table_id % 3 * 9 as x1")
    notes = ids.selectExpr(
        "table_id", "case when table_id % 5 = 0 then 1 else 0 end as captions", "case when table_id % 10 = 0 then 1 else 0 end as continued", "case when table_id % 7 = 0 then 1 else 0 end as footnotes")
    return head.unionByName(body), pages, notes


@query("adjacent_page_tables", """
with t as (select distinct table_id, cast(floor(table_id / 4) as bigint) as doc_id, table_id % 4 as page_idx, 100 + table_id % 3 * 9 as w from cells)
select b.doc_id, b.page_idx, b.table_id, a.table_id as prev_id, b.w as width, a.w as prev_width from t a join t b on a.doc_id=b.doc_id and a.page_idx+1=b.page_idx""", uses=("cells",))
def adjacent_page_tables(spark, sf):
    return T.adjacent_tables(page_tables(spark, sf)[1])


# the tables of page_tables, their rows measured and compared row by row, and how many leading rows a pair shares
HEADERS = PLACED.replace("from cells)", "from pc)").replace("with recursive o as", """with recursive pc as (
  select table_id, row_idx, cell_idx, 'h' || cell_idx as text, 1 as rowspan, 1 as colspan from cells where row_idx = 0
  union all select table_id, row_idx + 1, cell_idx, text, rowspan, colspan from cells), o as""") + """,
 g1 as (select table_id, row, c, max(row_idx * 1000 + cell_idx) as src from grid group by 1,2,3),
 g2 as (select *, case when lag(src) over w = src and lag(c) over w = c - 1 then 0 else 1 end as st from g1 window w as (partition by table_id, row order by c)),
 sg as (select table_id, row as row_idx, sum(st) as segments, max(c) + 1 as eff from g2 group by 1, 2),
 ow as (select table_id, row_idx, sum(colspan) as act, list(text order by cell_idx) as texts, list([colspan, rowspan] order by cell_idx) as spans, max(row_idx + rowspan) as reach from placed group by 1, 2),
 mt as (select ow.*, sg.segments, sg.eff from ow join sg using (table_id, row_idx)),
 pr as (select b.t // 4 as doc_id, b.t % 4 as page_idx, b.t as table_id, a.t as prev_id, 100 + b.t % 3 * 9 as width, 100 + a.t % 3 * 9 as prev_width
   from (select distinct table_id as t from cells) a join (select distinct table_id as t from cells) b on a.t // 4 = b.t // 4 and a.t + 1 = b.t),
 al as (select pr.prev_id, pr.table_id, x.row_idx, x.texts = y.texts and x.spans = y.spans and x.eff = y.eff as same, x.texts = y.texts and x.segments = y.segments as looks
   from pr join mt x on x.table_id = pr.prev_id join mt y on y.table_id = pr.table_id and y.row_idx = x.row_idx),
 pf as (select prev_id, table_id, coalesce(min(row_idx) filter (where not same), max(row_idx) + 1) as a, coalesce(min(row_idx) filter (where not looks), max(row_idx) + 1) as b from al group by 1, 2),
 bs as (select table_id, row_idx from (select *, max(reach) over (partition by table_id order by row_idx rows between unbounded preceding and 1 preceding) as r from mt) where r is null or r <= row_idx),
 sz as (select table_id, max(row_idx) + 1 as n from mt group by 1),
 hd as (select pf.prev_id, pf.table_id, cast(case when greatest(a, b) = 0 then 0 else coalesce((select min(bs.row_idx) from bs where bs.table_id = pf.table_id and bs.row_idx >= case when a > 0 then a else b end),
   (select n from sz where sz.table_id = pf.table_id)) end as bigint) as header_rows from pf)"""

# pairs whose notes, widths and columns or boundary rows say that they are one table
MERGES = HEADERS + """,
 tc as (select table_id, max(col + colspan) as total_cols from placed group by 1),
 mg as (select pr.*, hd.header_rows, t.total_cols, u.total_cols as prev_cols from pr join hd on hd.prev_id = pr.prev_id and hd.table_id = pr.table_id
   join tc t on t.table_id = pr.table_id join tc u on u.table_id = pr.prev_id join sz on sz.table_id = pr.prev_id
   join mt l on l.table_id = pr.prev_id and l.row_idx = sz.n - 1 left join mt f on f.table_id = pr.table_id and f.row_idx = hd.header_rows
   where case when pr.table_id % 5 = 0 then pr.table_id % 10 = 0 else pr.prev_id % 7 <> 0 end and abs(width - prev_width) < least(width, prev_width) * 0.1
     and (t.total_cols = u.total_cols or coalesce(l.eff = f.eff or l.act = f.act or l.segments = f.segments, false))),
 ch as (select t as table_id, t as root, 0 as pos from (select distinct table_id as t from cells) where t not in (select table_id from mg)
   union all select mg.table_id, ch.root, ch.pos + 1 from ch join mg on mg.prev_id = ch.table_id)"""


def merge_plan(spark, sf):
    c, pages, notes = page_tables(spark, sf)
    c = written(c)
    p = T.place_cells(c)
    merges = checkpointed(T.mergeable_pairs(T.adjacent_tables(pages), p, notes))
    return c, pages, p, merges


@query("table_header_rows", HEADERS + " select prev_id, table_id, header_rows from hd", uses=("cells",))
def table_header_rows(spark, sf):
    c, pages, _ = page_tables(spark, sf)
    return T.common_header_rows(T.adjacent_tables(pages).select("prev_id", "table_id"), T.place_cells(c))


@query("table_merge_pairs", MERGES + " select doc_id, page_idx, table_id, prev_id, width, prev_width, header_rows, total_cols, prev_cols from mg", uses=("cells",))
def table_merge_pairs(spark, sf):
    return merge_plan(spark, sf)[3]


@query("table_page_merge", MERGES + """,
 kp as (select pc.*, ch.root, ch.pos, coalesce(mg.header_rows, 0) as h from pc join ch using (table_id) left join mg using (table_id) where pc.row_idx >= coalesce(mg.header_rows, 0)),
 ks as (select root, pos, max(row_idx) + 1 - max(h) as n from kp group by 1, 2),
 ko as (select root, pos, coalesce(sum(n) over (partition by root order by pos rows between unbounded preceding and 1 preceding), 0) as at from ks)
select kp.root as table_id, cast(kp.row_idx - kp.h + ko.at as bigint) as row_idx, cell_idx, text, rowspan, colspan, table_id as source_id from kp join ko using (root, pos)""", uses=("cells",))
def table_page_merge(spark, sf):
    c, pages, _, merges = merge_plan(spark, sf)
    return T.merge_tables(c, merges, T.merge_chains(merges, pages))


@query("table_cell_continuation")
def table_cell_continuation(spark, sf):
    c, pages, _, merges = merge_plan(spark, sf)
    merged = T.merge_tables(c, merges, T.merge_chains(merges, pages))
    starts = merged.where("source_id <> table_id").groupBy("table_id", "source_id").agg(F.min("row_idx").alias("row_idx")).select(
        "table_id", "row_idx", F.array(F.lit(1), F.lit(0), F.lit(1)).alias("flags"))
    return T.continue_cells(checkpointed(merged.drop("source_id")), checkpointed(starts))


@query("table_merge_over_pages")
def table_merge_over_pages(spark, sf):
    """Documents of three pages: headers, padding, clipped spans and continued cells decided as the tables merge from the last page back."""
    c, pages, _ = page_tables(spark, sf)
    pages = pages.selectExpr("cast(floor(table_id / 3) as bigint) as doc_id", "table_id % 3 as page_idx", "block_idx", "type", "table_id", "x0", "x1")
    notes = pages.selectExpr(
        "table_id", "0 as note_idx", "case when table_id % 7 = 0 then 'footnote' else 'caption' end as kind",
        "case when table_id % 10 = 0 then 'Table 4 (continued)' else 'Table 4' end as text", "table_id % 5 <> 0 as below")
    flags = pages.where("table_id % 2 = 0").select("table_id", F.array(F.lit(1), F.lit(0), F.lit(1)).alias("flags"))
    return merge_page_tables(c, pages, notes, flags).cells


@query("table_column_padding", PLACED + """,
 rw as (select table_id, row_idx, sum(colspan) as act, count(*) as n, list(colspan order by cell_idx) as spans, (select max(c) + 1 from grid g where g.table_id = p.table_id and g.row = p.row_idx) as eff from placed p group by 1, 2)
select p.table_id, p.row_idx, p.cell_idx, text, rowspan, cast(case when rw.eff < 5 and rw.act < 5 and rw.spans <> r0.spans and p.cell_idx = rw.n - 1 then colspan + 5 - rw.eff else colspan end as int) as colspan
from placed p join rw on rw.table_id = p.table_id and rw.row_idx = p.row_idx join rw r0 on r0.table_id = p.table_id and r0.row_idx = 0""", uses=("cells",))
def table_column_padding(spark, sf):
    c = cells(spark, sf)
    shape = c.where("row_idx = 0").groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("cell_idx", "colspan"))).alias("s"))
    targets = shape.select("table_id", F.lit(5).alias("target_cols"), F.lit(0).alias("first_row"), F.col("s.colspan").alias("ref_spans"), F.col("s.colspan").alias("own_spans"))
    return T.pad_columns(c, targets)


@query("table_notes_after_merge", MERGES + """,
 ls as (select root, max(pos) as last from ch group by 1)
select case when table_id % 2 = 0 and pos > 0 then table_id else ch.root end as table_id, 0 as note_idx,
  case when table_id % 2 = 1 then 'footnote' when pos > 0 then 'text' else 'caption' end as kind, 'note' as text
from ch join ls on ls.root = ch.root where (table_id % 2 = 1 and pos = last) or table_id % 2 = 0""", uses=("cells",))
def table_notes_after_merge(spark, sf):
    c, pages, _, merges = merge_plan(spark, sf)
    notes = pages.selectExpr("table_id", "0 as note_idx", "case when table_id % 2 = 0 then 'caption' else 'footnote' end as kind", "'note' as text", "true as below")
    return T.merged_notes(notes, T.merge_chains(merges, pages))


SERIES = """with p as (select user_id as chart_id, cast(row_number() over (partition by user_id, event_type order by event_id) - 1 as bigint) as point_idx,
    cast(dense_rank() over (partition by user_id order by event_type) - 1 as bigint) as series_idx, cast(event_id % 7 as string) as value, event_id from events)"""


def series(spark, sf):
    p = spark.sql(SERIES.replace("from events", "from {events}") + " select * from p", events=derived(spark, sf, "events"))
    y = p.selectExpr("chart_id", "cast(series_idx as bigint) as series_idx", "'y' as axis", "point_idx", "value")
    x = p.where("chart_id % 2 = 0 or series_idx = 0").selectExpr(
        "chart_id", "cast(series_idx as bigint) as series_idx", "'x' as axis", "point_idx", "cast(point_idx + case when chart_id % 4 = 0 then 0 else series_idx end as string) as value")
    return y.unionAll(x)


@query("chart_series_to_wide", SERIES + """,
 x as (select *, case when chart_id % 2 = 0 or series_idx = 0 then cast(point_idx + case when chart_id % 4 = 0 then 0 else series_idx end as string) end as xv from p),
 n as (select chart_id, count(distinct series_idx) as n from p group by 1),
 pt as (select x.chart_id, point_idx, min(xv) = max(xv) and count(xv) = min(n.n) as ok, min(xv) as lo from x join n on x.chart_id=n.chart_id group by 1,2),
 sh as (select chart_id, coalesce(bool_and(ok), false) as shared_x from pt group by 1),
 gr as (select pt.chart_id, pt.point_idx, pt.lo, unnest(range(n.n)) as series_idx from pt join n on n.chart_id = pt.chart_id),
 ys as (select gr.chart_id, gr.point_idx, any_value(gr.lo) as lo, string_agg(coalesce(p.value, ''), '|' order by gr.series_idx) as ys
   from gr left join p on p.chart_id=gr.chart_id and p.point_idx=gr.point_idx and p.series_idx=gr.series_idx group by 1, 2)
select ys.chart_id, ys.point_idx, sh.shared_x, coalesce(case when sh.shared_x then lo end, '') as x, ys.ys from ys join sh on ys.chart_id=sh.chart_id""")
def chart_series_to_wide(spark, sf):
    w = T.wide_series(series(spark, sf))
    return w.select("chart_id", "point_idx", "shared_x", F.coalesce("x", F.lit("")).alias("x"), F.array_join("ys", "|").alias("ys"))


@query("chart_points_densified", """
with p as (select user_id as chart_id, event_id // 50 as point_idx, max(cast(value as string)) as value from events group by 1,2),
 m as (select chart_id, max(point_idx) as m from p group by 1), s as (select chart_id, unnest(range(m + 1)) as point_idx from m)
select s.chart_id, s.point_idx, coalesce(p.value, '') as value from s left join p on s.chart_id=p.chart_id and s.point_idx=p.point_idx""")
def chart_points_densified(spark, sf):
    e = derived(spark, sf, "events").selectExpr("user_id as chart_id", "event_id div 50 as point_idx", "cast(value as string) as value")
    return T.densify_points(e.groupBy("chart_id", "point_idx").agg(F.max("value").alias("value")), ["chart_id"])


@query("multilevel_categories", """
select o_orderkey as chart_id, o_custkey as point_idx, o_orderpriority || ' / ' || o_orderstatus as value from orders where o_orderkey % 3 <> 0
union all select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 3 = 0""")
def multilevel_categories(spark, sf):
    o = derived(spark, sf, "orders")
    inner = o.selectExpr("o_orderkey as chart_id", "o_custkey as point_idx", "0 as level", "o_orderstatus as value")
    outer = o.selectExpr("o_orderkey as chart_id", "o_custkey as point_idx", "1 as level", "case when o_orderkey % 3 = 0 then '' else o_orderpriority end as value")
    return T.multilevel_categories(inner.unionAll(outer), ["chart_id"])


@query("blank_borders_trimmed", """
with f as (select table_id, min(row_idx) r0, max(row_idx) r1, max(cell_idx) c1 from cells where text <> '' group by 1),
 g as (select table_id, unnest(range(r0, r1+1)) as row_idx, c1 from f), h as (select table_id, row_idx, unnest(range(c1+1)) as col from g)
select h.table_id, h.row_idx, h.col, coalesce(c.text, '') as text from h left join cells c on c.table_id=h.table_id and c.row_idx=h.row_idx and c.cell_idx=h.col""", uses=("cells",))
def blank_borders_trimmed(spark, sf):
    return T.trim_blank_borders(cells(spark, sf).selectExpr("table_id", "row_idx", "cell_idx as col", "text"))
