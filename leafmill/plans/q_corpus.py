"""Queries: chunking, change detection, ranking, link graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import graph as G
from leafmill.operators import retrieval as R
from leafmill.plans.registry import derived, query, table
from leafmill.session import checkpointed


def docs(spark, sf):
    return table(spark, sf, "documents")


# the folds of the chunkers, one recursion step for each piece of a document
PIECES = r"""paras as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as ps from documents),
 p as (select doc_id, flatten(list_transform(ps, lambda x: case when length(x) <= 1400 then [x] else
    flatten(list_transform(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda y: list_transform(range(1, greatest(length(y), 1) + 1, 1400), lambda i: substr(y, cast(i as int), 1400)))) end)) as pieces from paras)"""


@query("paragraph_chunks", f"""with recursive {PIECES},
 r as (select doc_id, 0 as i, '' as buf, cast([] as varchar[]) as done from p
  union all
  select doc_id, i + 1, case when length(b) >= 800 then '' else b end, case when length(b) >= 800 then list_append(o, b) else o end from (
    select r.doc_id, i, case when buf = '' or length(buf) + 2 + length(pieces[i + 1]) > 1400 then pieces[i + 1] else buf || chr(10) || chr(10) || pieces[i + 1] end as b,
      case when buf <> '' and length(buf) + 2 + length(pieces[i + 1]) > 1400 then list_append(done, buf) else done end as o
    from r join p on r.doc_id = p.doc_id where i < len(pieces)) t),
 f as (select r.doc_id, buf, done from r join p on r.doc_id = p.doc_id where i = len(pieces)),
 c as (select doc_id, case when buf = '' then done
    when len(done) > 0 and length(buf) < 200 and length(done[-1]) + 2 + length(buf) <= 1400 then list_append(done[:len(done) - 1], done[-1] || chr(10) || chr(10) || buf)
    else list_append(done, buf) end as chunks from f)
select doc_id, cast(k as int) as chunk_idx, md5(chunks[k + 1]) as h, length(chunks[k + 1]) as n from (select *, unnest(range(len(chunks))) as k from c) u""")
def paragraph_chunks(spark, sf):
    return R.paragraph_chunks(docs(spark, sf), separator="\n+").select("doc_id", "chunk_idx", F.md5("chunk").alias("h"), F.length("chunk").alias("n"))


@query("heading_chunks", r"""with recursive p as (
  select doc_id, list_filter(regexp_split_to_array('# Doc ' || doc_id || chr(10) || text, '\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '') as ps from documents),
 r as (select doc_id, 0 as i, '' as buf, '' as crumb, cast([] as struct(lv int, title varchar)[]) as heads, cast([] as struct(chunk varchar, crumb varchar)[]) as done from p
  union all
  select doc_id, i + 1, case when buf = '' then x when is_full then right(buf, 512) || chr(10) || chr(10) || x else buf || chr(10) || chr(10) || x end,
    case when buf = '' or is_full then array_to_string(list_transform(hs, lambda h: h.title), ' > ') else crumb end, hs,
    case when is_full then list_append(done, {'chunk': buf, 'crumb': crumb}) else done end
  from (select *, buf <> '' and (length(buf) + 2 + length(x)) // 4 > 512 as is_full,
      case when marks <> '' then list_append(list_filter(heads, lambda h: h.lv < length(marks)), {'lv': length(marks), 'title': trim(regexp_extract(x, '^#{1,6}\s+([^\n]*)', 1), ' ')}) else heads end as hs
    from (select r.*, ps[i + 1] as x, regexp_extract(ps[i + 1], '^(#{1,6})\s', 1) as marks from r join p on r.doc_id = p.doc_id where i < len(ps)) a) b),
 f as (select r.doc_id, case when buf = '' then done else list_append(done, {'chunk': buf, 'crumb': crumb}) end as chunks from r join p on r.doc_id = p.doc_id where i = len(ps)),
 e as (select doc_id, k, chunks[k + 1].chunk as chunk, chunks[k + 1].crumb as crumb from (select *, unnest(range(len(chunks))) as k from f) u),
 s as (select doc_id, k, crumb, case when length(chunk) <= 10000 then [chunk] else
    flatten(list_transform(string_split(regexp_replace(chunk, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda y: list_transform(range(1, greatest(length(y), 1) + 1, 10000), lambda i: substr(y, cast(i as int), 10000)))) end as cut from e),
 t as (select doc_id, k, crumb, unnest(cut) as chunk, unnest(range(len(cut))) as j from s)
select doc_id, cast(row_number() over (partition by doc_id order by k, j) - 1 as int) as chunk_idx, crumb as breadcrumb, length(chunk) // 4 as token_count, md5(chunk) as h from t""")
def heading_chunks(spark, sf):
    d = docs(spark, sf).withColumn("text", F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), "text"))
    return R.heading_chunks(d, separator="\n+").select("doc_id", "chunk_idx", "breadcrumb", "token_count", F.md5("chunk").alias("h"))


@query("window_chunks", r"""with recursive d as (select doc_id, text, length(text) as n from documents),
 w as (select doc_id, text, n, 0 as i, 0 as pos from d where n > 0
  union all
  select doc_id, text, n, i + 1, pos + wide - 400 from (select *, case when blank > 4000 then blank else 8000 end as wide
    from (select *, length(regexp_extract(substr(text, pos + 1, 8000), '(?s)^(.*)\s', 1)) as blank from w where pos + 8000 < n) a) b)
select doc_id, i as chunk_idx, pos as start, md5(substr(text, pos + 1, case when pos + 8000 >= n then n - pos
  when length(regexp_extract(substr(text, pos + 1, 8000), '(?s)^(.*)\s', 1)) > 4000 then length(regexp_extract(substr(text, pos + 1, 8000), '(?s)^(.*)\s', 1)) else 8000 end)) as h from w""")
def window_chunks(spark, sf):
    return R.window_chunks(docs(spark, sf)).select("doc_id", "chunk_idx", "start", F.md5("chunk").alias("h"))


CHANGED = "case when doc_id % 10 = 3 then text || '!' else text end"


@query("change_detection", f"""
with o as (select doc_id, sha256(text) h from documents where doc_id % 10 <> 1), n as (select doc_id, sha256({CHANGED}) h from documents where doc_id % 10 <> 2)
select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.h is null then 'new' when n.h is null then 'deleted' when o.h = n.h then 'unchanged' else 'changed' end as state
from o full join n on o.doc_id = n.doc_id""")
def change_detection(spark, sf):
    d = docs(spark, sf)
    return R.change_detection(d.where("doc_id % 10 <> 1"), d.where("doc_id % 10 <> 2").withColumn("text", F.expr(CHANGED)))


@query("cache_verdicts", """
select 'd/' || doc_id as path, case doc_id % 5 when 0 then 'MISS:no_entry' when 1 then 'MISS:hash_changed' when 2 then 'MISS:no_source' else 'HIT' end as verdict from documents""")
def cache_verdicts(spark, sf):
    d = docs(spark, sf).select(F.expr("'d/' || doc_id").alias("path"), F.col("text").alias("content"), "doc_id")
    cache = d.where("doc_id % 5 <> 0").select(
        "path", F.sha2(F.concat("path", F.lit("\u0000"), "content", F.when(F.col("doc_id") % 5 == 1, "x").otherwise("")), 256).alias("hash"),
        F.concat(F.lit("s/"), F.col("doc_id").cast("string")).alias("source_page"))
    pages = d.where("doc_id % 5 <> 2").select(F.concat(F.lit("s/"), F.col("doc_id").cast("string")).alias("source_page"))
    return R.cache_verdicts(d.drop("doc_id"), cache, pages)


@query("chunk_reuse", """
select cast(conv_id as string) as slug, k as chunk_idx, substr(sha256(text), 1, 16) as hash, k % 3 = 0 as reused
from (select *, row_number() over (partition by conv_id order by turn, role, text) as k from conversations)""")
def chunk_reuse(spark, sf):
    c = table(spark, sf, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    chunks = c.select(F.col("conv_id").cast("string").alias("slug"), place.alias("chunk_idx"), F.col("text").alias("chunk"))
    stored = chunks.where("chunk_idx % 3 < 2").select("slug", "chunk_idx", F.substring(F.sha2(F.concat("chunk", F.when(F.col("chunk_idx") % 3 == 0, "").otherwise("x")), 256), 1, 16).alias("hash"))
    return R.chunk_reuse(chunks, stored).select("slug", "chunk_idx", "hash", "reused")


TERMS = ["the", "and", "is", "le"]
TF = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) as t{i}" for i, t in enumerate(TERMS))
BM25 = f"""k as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as toks from documents), c as (select doc_id, len(toks) as l, {TF} from k),
 s as (select count(*) as n, avg(l) as a, {', '.join(f'count(case when t{i} > 0 then 1 end) as d{i}' for i in range(len(TERMS)))} from c),
 bm as (select doc_id, {' + '.join(f'case when t{i} > 0 then ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * l / a)) else 0 end' for i in range(len(TERMS)))} as score
   from c, s where {' or '.join(f't{i} > 0' for i in range(len(TERMS)))})"""


@query("bm25_ranking", f"with {BM25} select doc_id, round(score + (doc_id % 7) * 0.5, 6) as score from bm")
def bm25_ranking(spark, sf):
    return R.bm25(docs(spark, sf), TERMS, base=F.col("doc_id") % 7).select("doc_id", F.round("score", 6).alias("score"))


COS = """v as (select vec_id, label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings),
 q as (select label, i, avg(cast(x as double)) as y from v group by 1,2),
 s as (select v.label, vec_id, sum(cast(x as double) * y) / (sqrt(sum(cast(x as double) * cast(x as double))) * sqrt(sum(y * y))) as score from v join q on v.label=q.label and v.i=q.i group by 1,2)"""


def centroids(vectors, keys):
    parts = vectors.select(*keys, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("y"))
    return means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "y")))["y"].alias("embedding"))


@query("cosine_top_k_per_group", f"""with {COS}, r as (select *, row_number() over (partition by label order by score desc, vec_id) as rank from s where score >= 0)
select label, vec_id, round(score, 6) as score from r where rank <= 15""")
def cosine_top_k_per_group(spark, sf):
    e = table(spark, sf, "embeddings")
    return R.cosine_top_k_per_group(e, centroids(e, ["label"]), "label").select("label", "vec_id", F.round("score", 6).alias("score"))


@query("cosine_top_k", """
with v as (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings), q as (select i, avg(cast(x as double)) as y from v group by 1),
 s as (select vec_id, sum(cast(x as double) * y) / (sqrt(sum(cast(x as double) * cast(x as double))) * sqrt(sum(y * y))) as score from v join q on v.i=q.i group by 1)
select vec_id, round(score, 6) as score from s where score >= 0 order by s.score desc, vec_id limit 30""")
def cosine_top_k(spark, sf):
    e = table(spark, sf, "embeddings")
    centre = centroids(e, []).scalar()
    return R.cosine_top_k(e, centre).select("vec_id", F.round("score", 6).alias("score"))


@query("cosine_second_cut", f"""
with {BM25}, cv as (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings), cq as (select i, avg(cast(x as double)) as y from cv group by 1),
 cs as (select vec_id, sum(cast(x as double) * y) / (sqrt(sum(cast(x as double) * cast(x as double))) * sqrt(sum(y * y))) as score  from cv join cq on cv.i=cq.i group by 1),
 ch as (select vec_id as doc_id, round(score, 6) as score from cs where score >= 0 order by cs.score desc, vec_id limit 30),
 cj as (select ch.doc_id, ch.score, coalesce(round(bm.score, 6), 0) as l from ch left join bm on bm.doc_id = ch.doc_id)
select doc_id, round(0.5 * score + 0.5 * case when (select max(l) from cj) > 0 then l / (select max(l) from cj) else 0 end, 5) as score from cj order by 0.5 * score + 0.5 * case when (select max(l) from cj) > 0 then l / (select max(l) from cj) else 0 end desc, doc_id limit 12""")
def cosine_second_cut(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = R.cosine_top_k(e, centroids(e, []).scalar()).select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"))
    lexical = R.bm25(docs(spark, sf), TERMS).withColumn("score", F.round("score", 6))
    return R.rerank_hits(hits, lexical).withColumn("score", F.round("score", 5))


@query("query_token_stems", r"""
select doc_id, list_aggregate(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w not in ('the','der','que')),
  lambda w: regexp_replace(w, '^([a-z]{3,}?)(ings|ing|edly|ed|ies|es|ly|s)$', '\1')))), 'string_agg', ' ') as tokens from documents""")
def query_token_stems(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(F.array_sort(R.query_tokens(F.col("text"), ["the", "der", "que"], stems=True)), " ").alias("tokens"))


@query("rank_fusion", f"""with {BM25}, a as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as ra from bm),
 b as (select doc_id, row_number() over (order by n_chars desc, doc_id) as rb from documents where lang = 'en')
select coalesce(a.doc_id, b.doc_id) as doc_id, round(coalesce(1.0/(60+ra), 0) + coalesce(1.0/(60+rb), 0), 9) as score from a full join b on a.doc_id=b.doc_id""")
def rank_fusion(spark, sf):
    d = docs(spark, sf)
    a = R.rank_scores(R.bm25(d, TERMS).withColumn("score", F.round("score", 6)), "rank")
    b = R.rank_scores(d.where("lang = 'en'").select("doc_id", F.col("n_chars").alias("score")), "rank")
    return R.reciprocal_rank_fusion(a, b).select("doc_id", F.round("score", 9).alias("score"))


@query("tiered_results", """
with p as (select p_partkey, lower(p_type) as name, lower(p_brand) || '/' || lower(p_name) as path, (p_size % 10) / 10.0 as body from part),
 b as (select *, case when name = 'blue' then 700 when path = 'blue' then 650 when name like 'blue%' then 600 when path like 'blue%' or path like '%/blue%' then 550
    when name like '%blue%' then 500 when path like '%blue%' then 450 else -1 end as bracket from p),
 c as (select *, case when bracket = 450 then 'path_only' when bracket > 0 then 'lexical' else 'body' end as category, greatest(bracket, 0) * 1000 + body as score from b where bracket > 0 or body > 0),
 r as (select *, row_number() over (partition by category order by score desc, path, p_partkey) as k from c)
select p_partkey, bracket, category, round(score, 3) as score from r where k <= case category when 'lexical' then 100 when 'body' then 6 else 4 end""")
def tiered_results(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("name"), F.lower(F.concat("p_brand", F.lit("/"), "p_name", F.lit("\u0001"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))).alias("path"), (F.col("p_size") % 10 / 10).alias("body"))
    return R.tiered_results(p, "blue", caps={"lexical": 100, "body": 6, "path_only": 4}).select("p_partkey", "bracket", "category", F.round("score", 3).alias("score"))


@query("field_match_scores", """
with p as (select p_partkey, lower(p_name) as title, lower(p_brand) as tag, lower(p_type) as summary, p_size as degree, p_partkey % 3 as t from part),
 s as (select *, case when title = 'brand#13' then 10.0 when contains(title, 'brand#13') then 6.0 when tag = 'brand#13' then 4.0 when contains(summary, 'brand#13') then 2.0 else 0.0 end as f from p)
select p_partkey, round(case when f > 0 then (f + least(degree * 0.1, 2.0)) * case t when 0 then 1.3 when 1 then 1.0 else 0.7 end else 0.0 end, 6) as score from s""")
def field_match_scores(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "p_name as slug", "p_name as title", "array(p_brand) as tags", "p_type as summary", "p_size as degree",
                                            "case p_partkey % 3 when 0 then 'core' when 1 then 'supporting' else 'peripheral' end as tier")
    return p.select("p_partkey", F.round(R.field_match_score("Brand#13"), 6).alias("score"))


@query("query_tokens", """
select doc_id, list_aggregate(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
  lambda w: w not in ('a','an','and','are','in','is','of','on','or','the','to','what','with')), ['中文字','中文','文字','中','文','字']))), 'string_agg', ' ') as tokens from documents""")
def query_tokens(spark, sf):
    t = R.query_tokens(F.concat("text", F.lit(" 中文字")))
    return docs(spark, sf).select("doc_id", F.array_join(F.array_sort(t), " ").alias("tokens"))


@query("token_match_scores", """
select doc_id, (case when contains(lower(text), 'the') then 1 else 0 end) * 0 + cast(contains(lower(text), 'elle') as int) + cast(contains(lower(text), 'tion') as int)
  + 10 * (cast(contains('tion ' || lang, 'elle') as int) + cast(contains('tion ' || lang, 'tion') as int)) as score from documents""")
def token_match_scores(spark, sf):
    return docs(spark, sf).select("doc_id", R.token_match_score("the elle tion", F.concat(F.lit("Tion "), "lang"), F.col("text")).alias("score"))


@query("budgeted_context", """
with r as (select doc_id, source, n_chars, sum(n_chars) over (partition by source order by n_chars % 97 desc, doc_id rows unbounded preceding) as running from documents)
select doc_id, source, cast(running as bigint) as running from r where running <= 8000""")
def budgeted_context(spark, sf):
    d = docs(spark, sf).withColumn("score", F.col("n_chars") % 97)
    return R.budgeted(d, ["source"], 8000, size="n_chars").select("doc_id", "source", "running")


@query("confidence_and_staleness", """
with l as (select l_orderkey as page, l_suppkey % 5 as lineage, avg((l_partkey % 10) / 10.0) as q from lineitem group by 1,2),
 c as (select page, least(count(*) / 3.0, 1.0) * 0.5 + avg(q) * 0.5 as confidence from l group by 1)
select o_orderkey as page, round(coalesce(confidence, 0), 6) as confidence, date_diff('day', cast(o_orderdate as date), date '2000-01-01') > 90 as stale from orders left join c on page = o_orderkey""")
def confidence_and_staleness(spark, sf):
    evidence = table(spark, sf, "lineitem").selectExpr("l_orderkey as page", "l_suppkey % 5 as lineage", "(l_partkey % 10) / 10.0D as quality")
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderdate").alias("updated"))
    return R.confidence(evidence, pages, F.lit("2000-01-01").cast("date")).select("page", F.round("confidence", 6).alias("confidence"), "stale")


@query("similar_names", """
with p as (select distinct p_name as n from part), t as (select n, list_distinct(list_filter(regexp_extract_all(lower(n), '[a-z0-9]+'), lambda w: w not in ('a','an','and','are','in','is','of','on','or','the','to','what','with'))) as k,
   list_filter(regexp_extract_all(lower(n), '[a-z0-9]+'), lambda w: w not in ('a','an','and','are','in','is','of','on','or','the','to','what','with')) as o from p),
 x as (select a.n as name, b.n as candidate, a.k as ka, b.k as kb, ' ' || array_to_string(a.o, ' ') || ' ' as sa, ' ' || array_to_string(b.o, ' ') || ' ' as sb from t a join t b on list_has_any(a.k, b.k)),
 j as (select *, len(list_intersect(ka, kb)) * 1.0 / len(list_distinct(list_concat(ka, kb))) as j from x)
select name, candidate, round(case when sa = sb then 1.0 when (contains(sa, sb) and len(kb) >= 2) or (contains(sb, sa) and len(ka) >= 2) then 0.85 when j >= 0.7 then j else 0.4 + (j - 0.4) * 0.5 end, 6) as score
from j where sa = sb or (contains(sa, sb) and len(kb) >= 2) or (contains(sb, sa) and len(ka) >= 2) or j >= 0.4""")
def similar_names(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_name").alias("name"))
    return R.similar_names(n, n.withColumnRenamed("name", "candidate")).select("name", "candidate", F.round("score", 6).alias("score"))


@query("entity_field_search", "select p_partkey from part where p_size >= 20 and p_brand <> 'Brand#13' and p_retailprice < 1500 and p_size % 2 = 0")
def entity_field_search(spark, sf):
    p = table(spark, sf, "part").withColumn("tags", F.when(F.col("p_size") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array(F.lit("odd"))))
    return R.find_entities(p, {"p_size": ">=20", "p_brand": "!=Brand#13", "p_retailprice": "<1500", "tags": "even"}).select("p_partkey")


@query("proposed_without_experiment", "select p_partkey as idea_id from part where p_size % 3 = 0 and not exists (select 1 from lineitem where l_partkey = p_partkey and l_suppkey % 50 = 0)")
def proposed_without_experiment(spark, sf):
    ideas = table(spark, sf, "part").selectExpr("p_partkey as idea_id", "case when p_size % 3 = 0 then 'proposed' else 'done' end as status")
    tests = table(spark, sf, "lineitem").where("l_suppkey % 50 = 0").select(F.col("l_partkey").alias("idea_id"))
    return R.proposed_without(ideas, tests).select("idea_id")


@query("source_coverage", """
select p_partkey as page, case when p_partkey % 5 = 4 then 'not_applicable' when p_partkey % 5 = 0 then 'missing_sources' when p_partkey % 5 = 1 then 'invalid_sources' when p_partkey % 5 = 2 then 'empty_sources' else 'ok' end as coverage from part""")
def source_coverage(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey as page", "case when p_partkey % 5 = 4 then 'session' else 'entity' end as type",
                                            "case p_partkey % 5 when 0 then null when 1 then 'not json' when 2 then '[]' else '[\"a\"]' end as sources")
    return R.source_coverage(p, ["session", "query"])


@query("projected_edges", """
select 'o' || l_orderkey as "from", 'p' || l_partkey as "to", 'fm_orders_parts' as type from lineitem union all
select 'o' || o_orderkey, 'c' || o_custkey, 'fm_orders_customer' from orders where exists (select 1 from lineitem where l_orderkey=o_orderkey)""")
def projected_edges(spark, sf):
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("parts"))
    o = table(spark, sf, "orders").join(parts, "o_orderkey").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), "parts", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"))
    return R.project_edges(o, "orders", ["parts", "customer"])


# link graph of the pages: the navigation targets are page names
LINKED = """l as (select page_id, unnest(regexp_extract_all(html, '<a href="/([^"#|\\[\\]]+)">', 1)) as target from pages),
 pg as (select page_id, case when page_id % 2 = 0 and t is not null then t else 'page' || page_id end as page from (select p.page_id, min(target) as t from pages p left join l on l.page_id = p.page_id group by 1)),
 nm as (select distinct page from pg), dl as (select distinct pg.page, trim(l.target) as target from l join pg on l.page_id=pg.page_id where trim(l.target) <> '' and lower(pg.page) <> lower(trim(l.target))),
 rs as (select dl.*, k.page as resolved from dl left join (select lower(page) as lk, min(page) as page from nm group by 1) k on lower(dl.target)=lk)"""


def wiki_pages(spark, sf):
    p = table(spark, sf, "pages")
    found = F.regexp_extract_all("html", F.lit(r'<a href="/([^"#|\[\]]+)">'), F.lit(1))
    text = F.array_join(F.transform(found, lambda t: F.concat(F.lit("[["), t, F.lit("|x]] and [ext](https://e.org/) "))), "")
    name = F.when((F.col("page_id") % 2 == 0) & (F.size("t") > 0), F.array_min("t")).otherwise(F.concat(F.lit("page"), F.col("page_id").cast("string")))
    return p.withColumn("t", found).select(name.alias("page"), text.alias("text"))


def resolved(spark, sf):
    pages = wiki_pages(spark, sf)
    return G.resolve_links(G.extract_links(pages), pages), pages.select("page").distinct()


@query("link_extraction", f"with {LINKED} select page, target, coalesce(resolved, '') as resolved from rs")
def link_extraction(spark, sf):
    return resolved(spark, sf)[0].select("page", "target", F.coalesce("resolved", F.lit("")).alias("resolved"))


@query("backlink_index", f"with {LINKED} select coalesce(resolved, target) as target, string_agg(distinct page, '|' order by page) as sources, count(distinct page) as n from rs group by 1")
def backlink_index(spark, sf):
    return G.backlinks(resolved(spark, sf)[0]).select("target", F.array_join("sources", "|").alias("sources"), "n")


@query("link_index", f"""with {LINKED} select resolved as page, 'backlink' as kind, page as other from rs where resolved is not null union select page, 'forward', resolved from rs where resolved is not null
union select page, 'missing', target from rs where resolved is null
union select page, 'external', 'https://e.org/' from pg join l on l.page_id = pg.page_id""")
def link_index(spark, sf):
    pages = wiki_pages(spark, sf)
    found = G.extract_links(pages)
    return G.link_index(found, G.resolve_links(found, pages))


@query("link_lint", f"""with {LINKED} select 'broken_link' as kind, page || ' -> ' || target as name from rs where resolved is null
union all select 'orphan', page from nm where page not in (select resolved from rs where resolved is not null)
union all select 'dead_end', page from nm where page not in (select page from rs where resolved is not null)
union all select 'phantom_hub', lower(target) from rs where resolved is null group by 2 having count(distinct page) >= 3""")
def link_lint(spark, sf):
    links, pages = resolved(spark, sf)
    return G.link_lint(pages, links)


@query("index_consistency", """
select cast(coalesce(a.p_partkey, b.p_partkey) as string) as page, case when b.p_partkey is null then 'missing_page' else 'not_indexed' end as problem
from (select p_partkey from part where p_size % 5 <> 0) a full join (select p_partkey from part where p_size % 7 <> 0) b on a.p_partkey=b.p_partkey where a.p_partkey is null or b.p_partkey is null
union all select min(cast(p_partkey as string)), 'duplicate_title' from part where p_size % 7 <> 0 group by lower(p_name) having count(*) > 1""")
def index_consistency(spark, sf):
    p = table(spark, sf, "part").selectExpr("cast(p_partkey as string) as page", "p_name as title", "p_size")
    return G.index_consistency(p.where("p_size % 5 <> 0"), p.where("p_size % 7 <> 0"))


@query("field_completeness", "select p_partkey as page, case when p_size % 4 = 0 then 'fail' when p_size % 3 = 0 then 'warn' else 'pass' end as verdict from part")
def field_completeness(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey as page", "case when p_size % 4 <> 0 then p_name end as title", "case when p_size % 3 = 0 then ' ' else p_brand end as tag")
    return G.field_completeness(p, ["title"], ["tag"])


DEG = "e as (select src as node, 1 as o from links union all select dst, 0 from links), d as (select node, cast(sum(1-o) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, count(*) as degree from e group by 1)"


def links(spark, sf):
    return derived(spark, sf, "links")


@query("graph_degrees", f"with {DEG} select * from d", uses=("links",))
def graph_degrees(spark, sf):
    return G.degrees(links(spark, sf))


@query("graph_hubs", f"with {DEG} select node, degree from d where degree > (select avg(degree) + 2 * stddev_pop(degree) from d)", uses=("links",))
def graph_hubs(spark, sf):
    return G.hubs(G.degrees(links(spark, sf))).select("node", "degree")


@query("graph_top_nodes", f"with {DEG} select node, degree from d order by degree desc, node limit 20", uses=("links",))
def graph_top_nodes(spark, sf):
    return G.top_nodes(G.degrees(links(spark, sf))).select("node", "degree")


EDGES = "select l_partkey as \"from\", l_suppkey as \"to\", case l_linenumber % 3 when 0 then 'same' else 'cites' end as type, l_orderkey * 1000 + block_idx as seq, case when l_linenumber % 2 = 0 then l_linenumber end as confidence from numbered"


@query("edge_deduplication", f"""
with e as ({EDGES}), s as (select case when type='same' then least("from","to") else "from" end as "from", case when type='same' then greatest("from","to") else "to" end as "to", type, seq from e)
select "from", "to", type, min(seq) as seq from s group by 1,2,3""", uses=("numbered",))
def edge_deduplication(spark, sf):
    e = spark.sql(EDGES.replace('"', "`").replace("from numbered", "from {numbered}"), numbered=derived(spark, sf, "numbered"))
    return G.deduplicate_edges(e, ["same"]).select("from", "to", "type", "seq")


@query("edge_confidence_merge", f'with e as ({EDGES}) select "from", "to", coalesce(max(confidence), -1) as confidence from e group by 1,2', uses=("numbered",))
def edge_confidence_merge(spark, sf):
    e = spark.sql(EDGES.replace('"', "`").replace("from numbered", "from {numbered}"), numbered=derived(spark, sf, "numbered"))
    return G.merge_edge_confidence(e).select("from", "to", F.coalesce("confidence", F.lit(-1)).alias("confidence"))


UND = "u as (select distinct src as a, dst as b from links where src <> dst union select distinct dst, src from links where src <> dst)"


@query("graph_neighbourhood", """with recursive b as (select p_partkey as node, 0 as depth from part where p_size = 1
  union select l.dst, b.depth + 1 from b join links l on l.src = b.node where b.depth < 2)
select node, min(depth) as depth from b group by 1""", uses=("links",))
def graph_neighbourhood(spark, sf):
    seeds = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"))
    return G.neighbourhood(links(spark, sf), seeds, 2, "out")


@query("graph_shortest_paths", f"""with recursive {UND}, b as (select p_partkey as node, 0 as hops from part where p_size = 1
  union select u.b, b.hops + 1 from b join u on u.a = b.node where b.hops < 4)
select node, min(hops) as hops from b group by 1""", uses=("links",))
def graph_shortest_paths(spark, sf):
    seeds = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"))
    return G.shortest_paths(links(spark, sf), seeds)


@query("graph_typed_paths", """with recursive e as (select distinct src, dst, case (src + dst) % 3 when 0 then 'cites' when 1 then 'extends' else 'uses' end as type from links),
 s as (select src as a, dst as b, type, 'out' as d from e where type <> 'uses' union all select dst, src, type, 'in' from e where type <> 'uses'),
 r as (select p_partkey as node, 0 as hops from part where p_size = 1 union select s.b, r.hops + 1 from r join s on s.a = r.node where r.hops < 3),
 lv as (select node, min(hops) as hops from r group by 1),
 pt as (select lv.node, lv.hops, min(row(s.a, s.type, s.d)) as p from lv join s on s.b = lv.node join lv u on u.node = s.a and u.hops = lv.hops - 1 group by 1, 2),
 w as (select node, hops, cast(node as varchar) as path, '' as steps from lv where hops = 0
   union all select pt.node, pt.hops, w.path || '>' || pt.node, w.steps || '|' || pt.p[2] || ' ' || pt.p[3] from w join pt on pt.p[1] = w.node and pt.hops = w.hops + 1)
select node, hops, path, steps from w""", uses=("links",))
def graph_typed_paths(spark, sf):
    kind = F.expr("case (src + dst) % 3 when 0 then 'cites' when 1 then 'extends' else 'uses' end")
    seeds = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"))
    found = G.typed_paths(links(spark, sf).withColumn("type", kind), seeds, 3, "both", ["cites", "extends"])
    steps = F.array_join(F.zip_with("types", "directions", lambda t, d: F.concat(F.lit("|"), t, F.lit(" "), d)), "")
    return found.select("node", "hops", F.array_join("path", ">").alias("path"), steps.alias("steps"))


SIG = """ed as (select distinct least(src,dst) as a, greatest(src,dst) as b from links where src <> dst), ci as (select distinct src, dst from links),
 ind as (select dst, count(*) as n from ci group by 1),
 sh as (select ed.a, ed.b, count(*) as k from ed join ci x on x.dst=ed.a join ci y on y.dst=ed.b and y.src=x.src group by 1,2),
 so as (select distinct l_partkey as node, l_suppkey as s from lineitem), sn as (select node, count(*) as n from so group by 1),
 ss as (select ed.a, ed.b, count(*) as k from ed join so x on x.node=ed.a join so y on y.node=ed.b and y.s=x.s group by 1,2)"""


def node_sources(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("source")).distinct(), table(spark, sf, "part").selectExpr("p_partkey as node", "p_partkey % 3 as type")


@query("edge_weights_three_signals", f"""with {SIG}
select ed.a, ed.b, round((coalesce(sh.k,0) * 1.0 / greatest(coalesce(ia.n,0), coalesce(ib.n,0), 1) + coalesce(ss.k,0) * 1.0 / least(na.n, nb.n) + case when ed.a % 3 = ed.b % 3 then 1.0 else 0.3 end) / 3, 6) as weight
from ed left join sh on sh.a=ed.a and sh.b=ed.b left join ind ia on ia.dst=ed.a left join ind ib on ib.dst=ed.b left join ss on ss.a=ed.a and ss.b=ed.b join sn na on na.node=ed.a join sn nb on nb.node=ed.b""", uses=("links",))
def edge_weights_three_signals(spark, sf):
    s, t = node_sources(spark, sf)
    return G.edge_weights(links(spark, sf), s, F.when(F.col("type_a") == F.col("type_b"), 1.0).otherwise(0.3), t).select("a", "b", F.round("weight", 6).alias("weight"))


@query("edge_relevance_four_signals", f"""with {SIG}, {UND}, dg as (select a, count(*) as d from u group by 1),
 di as (select least(src,dst) as a, greatest(src,dst) as b, count(*) as n from ci where src <> dst group by 1,2),
 aa as (select ed.a, ed.b, sum(1 / ln(dg.d)) as v from ed join u x on x.a=ed.a join u y on y.a=ed.b and y.b=x.b join dg on dg.a=x.b group by 1,2)
select di.a, di.b, round(di.n * 3.0 + coalesce(ss.k,0) * 4.0 + coalesce(aa.v,0) * 1.5 + case when di.a % 3 = di.b % 3 then 1.2 else 0.5 end, 5) as relevance
from di left join ss on ss.a=di.a and ss.b=di.b left join aa on aa.a=di.a and aa.b=di.b""", uses=("links",))
def edge_relevance_four_signals(spark, sf):
    s, t = node_sources(spark, sf)
    return G.relevance(links(spark, sf), s, F.when(F.col("type_a") == F.col("type_b"), 1.2).otherwise(0.5), t).select("a", "b", F.round("relevance", 5).alias("relevance"))


@query("label_propagation")
def label_propagation(spark, sf):
    return G.label_propagation(links(spark, sf))


@query("label_propagation_fixpoint", f"""with {UND} select count(distinct a) as nodes, cast(0 as bigint) as outnumbered, cast(0 as bigint) as strange from u""", uses=("links",))
def label_propagation_fixpoint(spark, sf):
    """Nodes, those whose neighbours have another label more often than theirs, and those whose label is no node's name."""
    labels = checkpointed(G.label_propagation(links(spark, sf)))
    near = G.undirected(links(spark, sf))
    votes = near.join(labels.toDF("b", "label"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
    told = votes.join(labels.toDF("a", "mine"), "a").groupBy("a").agg(F.max("n").alias("most"), F.coalesce(F.max(F.when(F.col("label") == F.col("mine"), F.col("n"))), F.lit(0)).alias("had"))
    known = labels.join(labels.select(F.col("node").alias("label")).distinct(), "label", "left_anti")
    return told.agg(F.count("*").alias("nodes"), F.count_if(F.col("most") > F.col("had")).alias("outnumbered")).withColumn("strange", F.lit(known.count()))


def by_remainder(spark, sf):
    """Given communities, so that the measures on them can be compared."""
    return G.undirected(links(spark, sf)).select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node") % 40)


@query("community_cohesion", f"""with {UND}, n as (select distinct a as node, a % 40 as label from u), s as (select label, count(*) as size from n group by 1),
 i as (select a % 40 as label, count(*) as k from u where a < b and a % 40 = b % 40 group by 1)
select s.label, s.size, coalesce(i.k, 0) as intra_edges, round(coalesce(i.k, 0) / (s.size * (s.size - 1) / 2.0), 6) as cohesion, coalesce(i.k, 0) / (s.size * (s.size - 1) / 2.0) < 0.15 as sparse
from s left join i on s.label=i.label""", uses=("links",))
def community_cohesion(spark, sf):
    return G.community_cohesion(links(spark, sf), by_remainder(spark, sf)).withColumn("cohesion", F.round("cohesion", 6))


@query("bridge_nodes", f"with {UND} select a as node, count(distinct b % 40) as communities from u group by 1 having count(distinct b % 40) >= 3", uses=("links",))
def bridge_nodes(spark, sf):
    return G.bridge_nodes(links(spark, sf), by_remainder(spark, sf))


@query("surprising_edges", f"""with {UND}, x as (select * from u where a % 40 <> b % 40), c as (select a, count(*) as d from x group by 1)
select x.a, x.b, round(1 / sqrt(p.d * q.d), 6) as score from x join c p on p.a=x.a join c q on q.a=x.b where x.a < x.b""", uses=("links",))
def surprising_edges(spark, sf):
    return G.surprising_edges(links(spark, sf), by_remainder(spark, sf)).withColumn("score", F.round("score", 6))
