"""Queries: styled segments to tagged text."""

from __future__ import annotations

from leafmill.operators import richtext as T
from leafmill.plans.registry import derived, query


@query("rich_text_runs", """
with s as (select page_id, span_idx, case when type='hyperlink' then 'u' || span_idx % 2 else '' end as url, type,
    style, case when content like '%5' then '  ' else content || ' ' end as txt from spans),
 f as (select *, style = 'underline' as shows, style = 'underline' or trim(txt) <> '' as solid from s),
 e as (select page_id, min(case when solid then span_idx end) as a, max(case when solid then span_idx end) as b from f group by 1),
 t as (select f.*, case when not shows and span_idx=a and span_idx=b then trim(txt) when not shows and span_idx=a then ltrim(txt) when not shows and span_idx=b then rtrim(txt) else txt end as tx
   from f join e on f.page_id=e.page_id and span_idx between a and b),
 p as (select *, case when type='interline_equation' then 'equation' else 'text' end as ty, lag(style) over w as ps, lag(url) over w as pu, lag(type) over w as pt from t window w as (partition by page_id order by span_idx)),
 g as (select *, sum(case when pt is not null and pt <> 'interline_equation' and type <> 'interline_equation' and ((url='' and pu='' and style=ps) or (url<>'' and url=pu)) then 0 else 1 end)
   over (partition by page_id order by span_idx) as run from p),
 r as (select page_id, run, min(url) as url, min(ty) as ty, string_agg(tx, '' order by span_idx) as tx, arg_min(style, span_idx) as style,
   string_agg('<text' || case when style='' then '' else ' style="' || style || '"' end || '>' || tx || '</text>', '' order by span_idx) as lt from g group by 1,2)
select page_id as para_id, string_agg(case when url <> '' then '<hyperlink>' || lt || '<url>' || url || '</url></hyperlink>' when ty='equation' then '<eq>' || tx || '</eq>'
  when style='' then tx else '<text style="' || style || '">' || tx || '</text>' end, '' order by run) as tagged from r group by 1""", uses=("spans",))
def rich_text_runs(spark, sf):
    s = derived(spark, sf, "spans").selectExpr(
        "page_id as para_id", "span_idx as seg_idx", "case when content like '%5' then '  ' else content || ' ' end as text", "style",
        "case when type = 'hyperlink' then 'u' || span_idx % 2 end as url", "case when type = 'interline_equation' then 'equation' else 'text' end as type")
    return T.tagged_text(s)
