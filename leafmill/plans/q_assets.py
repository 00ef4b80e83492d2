"""Queries: binary scans, assets in documents, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import annotations as N
from leafmill.plans.registry import derived, query, scratch, table
from leafmill.sources import assets as A
from leafmill.sources import documents as D
from leafmill.sources.ranges import read_ranges


@query("binary_scan_byte_range")
def binary_scan_byte_range(spark, sf):
    """The first and the last four bytes of every file, read by seeking; the listing reads no content."""
    files = D.scan_binary(spark, sf, [".parquet"]).select("path", "length")
    ends = [(r["path"], at, 4) for r in files.collect() for at in (0, r["length"] - 4)]  # the file listing
    told = read_ranges(spark, ends).groupBy("path").agg(
        F.min_by("content", "offset").cast("string").alias("magic"), F.max_by("content", "offset").cast("string").alias("tail"))
    return files.join(told, "path").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "magic", "tail")


def assets(spark, sf):
    """Every document text is one picture reference; equal texts are equal pictures."""
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return A.content_names(d, F.lit(".png"))


HASHED = "a as (select doc_id, sha256(text) as hash, text from documents), f as (select hash, min(doc_id) as first, count(*) as n from a group by 1), s as (select *, row_number() over (order by first) as k from f)"


@query("asset_content_addressing", f"with {HASHED} select first as doc_id, hash || '.png' as name from s")
def asset_content_addressing(spark, sf):
    return A.unique_assets(assets(spark, sf), ["doc_id"]).select("doc_id", "name")


@query("asset_sink", "select distinct sha256(text) || '.png' as name, md5(text) as content from documents")
def asset_sink(spark, sf):
    path = scratch(spark)
    A.write_assets(assets(spark, sf), path, ["doc_id"])
    return spark.read.parquet(path).select("name", F.md5("bytes").alias("content"))


@query("document_sink", "select doc_id, md5('# ' || text) as content from documents")
def document_sink(spark, sf):
    path = scratch(spark)
    D.write_documents(table(spark, sf, "documents").withColumn("md", F.concat(F.lit("# "), "text")), path, "md")
    return spark.read.parquet(path).select("doc_id", F.md5("value").alias("content"))


@query("asset_sequential_names", f"with {HASHED} select a.doc_id, a.hash || '.png' as name, k || '.png' as new_name from a join s on a.hash=s.hash")
def asset_sequential_names(spark, sf):
    return A.sequential_names(assets(spark, sf), ["doc_id"], F.lit(".PNG")).select("doc_id", "name", "new_name")


@query("asset_statistics", f"""with {HASHED} select cast(sum(n) as bigint) as total_refs, count(*) as "unique", cast(sum(n) - count(*) as bigint) as duplicates,
  count(case when first % 2 = 0 then 1 end) as described from s""")
def asset_statistics(spark, sf):
    a = assets(spark, sf)
    described = A.unique_assets(a, ["doc_id"]).select("hash", F.when(F.col("doc_id") % 2 == 0, "text").otherwise("").alias("description"))
    return A.reference_statistics(a, described)


def markdown_docs(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("doc_id"), F.expr("""'![](img/a' || page_id % 50 || '.png) text <img src="img/a' || page_id % 7 || '.png"> ![](x/none.png) end' || page_id || html""").alias("markdown"))


@query("asset_path_rewrite", """
select page_id as doc_id, '![](out/n' || page_id % 50 || '.jpg) text <img src="out/n' || page_id % 7 || '.jpg"> ![](out/none.png) end' || page_id || html as markdown from pages""")
def asset_path_rewrite(spark, sf):
    mapping = table(spark, sf, "pages").selectExpr("'a' || page_id % 50 || '.png' as old_name", "'n' || page_id % 50 || '.jpg' as new_name").distinct()
    return A.rewrite_paths(markdown_docs(spark, sf), mapping, "out")


@query("description_injection", """
select page_id as doc_id, '![](img/a' || page_id % 50 || '.png)' || case when page_id % 50 % 2 = 0 then chr(10) || chr(10) || '> **图像说明**' || chr(10) || '> line ' || page_id % 50 || chr(10) || '>' || chr(10) || '> end' else '' end ||
 ' text <img src="img/a' || page_id % 7 || '.png"> ![](x/none.png) end' || page_id || html as markdown from pages""")
def description_injection(spark, sf):
    told = table(spark, sf, "pages").selectExpr("'a' || page_id % 50 || '.png' as name", "case when page_id % 50 % 2 = 0 then ' line ' || page_id % 50 || '\n\nend' else '' end as description").distinct()
    return A.inject_descriptions(markdown_docs(spark, sf), told)


INLINE = "select page_id, 'data:image/JPEG;base64,' || to_base64(encode(url)) as uri from pages"


def inline_pages(spark, sf):
    uri = F.concat(F.lit("data:image/JPEG;base64,"), F.base64(F.encode("url", "UTF-8")))
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit('<td><img src="'), uri, F.lit('" alt="x"></td><img src="data:bad">')).alias("markup"))


@query("inline_image_extraction", f"""with u as ({INLINE}) select page_id, '<td><img src="' || sha256(uri) || '.jpg" alt="x"></td><img src="data:bad">' as markup from u""")
def inline_image_extraction(spark, sf):
    return A.extract_inline_images(inline_pages(spark, sf))[0]


@query("inline_image_assets", "select distinct sha256('data:image/JPEG;base64,' || to_base64(encode(url))) || '.jpg' as name, md5(url) as content from pages")
def inline_image_assets(spark, sf):
    return A.extract_inline_images(inline_pages(spark, sf))[1].select("name", F.md5("bytes").alias("content"))


@query("natural_file_order", """
select p_partkey, row_number() over (partition by p_brand order by case when p_partkey % 3 = 0 then 99999 else p_size end, case when p_partkey % 3 = 0 then 'x' || p_partkey else p_size || '_' || p_partkey end) as position from part""")
def natural_file_order(spark, sf):
    from pyspark.sql import Window

    name = F.expr("case when p_partkey % 3 = 0 then 'x' || p_partkey else p_size || '_' || p_partkey end")
    w = Window.partitionBy("p_brand").orderBy(*A.natural_order(name))
    return table(spark, sf, "part").select("p_partkey", F.row_number().over(w).alias("position"))


# replies: plain, fenced, or wrapped in talk; one object per line of an order
REPLY = """case l_orderkey % 4 when 0 then j when 1 then 'Here:\n```json\n' || j || '\n```\nok' when 2 then 'Result ' || j || ' done' else 'nothing found' end"""


def replies(spark, sf):
    n = derived(spark, sf, "numbered")
    obj = F.expr("""'{"name":"' || case when l_partkey % 3 = 0 then 'cup' when l_partkey % 3 = 1 then 'box1' else 'box' || l_linenumber end || '","bbox":[' || l_partkey % 90 || ',' || l_suppkey % 40 || ',200,300],' ||
      '"iterations":[{"round":1,"bbox":[1,2,3,4]},{"round":2,"bbox":[1,2,3,' || l_partkey % 2 || ']},{"round":3,"bbox":[1,2,3,' || l_partkey % 2 || ']},{"round":4,"bbox":[1,2,' || l_suppkey % 12 div 11 || ',' || l_partkey % 2 || ']}]}'""")
    j = n.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", obj.alias("o")))), lambda x: x["o"]), ",").alias("objs"))
    return j.select("l_orderkey", F.concat(F.lit('{"objects":['), "objs", F.lit("]}")).alias("j")).select(
        F.col("l_orderkey").alias("image_id"), F.expr(REPLY.replace("\n", "\\n")).alias("reply"))


def objects(spark, sf):
    parsed = replies(spark, sf).select("image_id", D.parse_annotations(F.col("reply")).alias("objects"))
    return N.explode_objects(parsed)


NAMES = "o as (select l_orderkey as image_id, block_idx as obj_idx, case when l_partkey % 3 = 0 then 'cup' when l_partkey % 3 = 1 then 'box1' else 'box' || l_linenumber end as name, case when l_partkey % 3 = 0 then 'cup' else 'box' end as category, l_partkey, l_suppkey from numbered where l_orderkey % 4 < 3)"


@query("annotation_parse", f"with {NAMES} select image_id, obj_idx, name, (l_partkey % 90) || ',' || (l_suppkey % 40) || ',200,300' as bbox from o", uses=("numbered",))
def annotation_parse(spark, sf):
    return objects(spark, sf).select("image_id", "obj_idx", "name", F.array_join(F.transform("bbox", lambda v: v.cast("int").cast("string")), ",").alias("bbox"))


@query("annotation_category_counts", f"with {NAMES} select image_id, category, count(*) as n from o group by 1,2", uses=("numbered",))
def annotation_category_counts(spark, sf):
    return N.count_categories(objects(spark, sf))


@query("annotation_numbering", f"""with {NAMES} select image_id, obj_idx, case when count(*) over (partition by image_id, category) > 1
  then category || row_number() over (partition by image_id, category order by obj_idx) else name end as label from o""", uses=("numbered",))
def annotation_numbering(spark, sf):
    return N.number_objects(objects(spark, sf)).select("image_id", "obj_idx", "label")


@query("annotation_convergence", f"""with {NAMES}, m as (select image_id, max(case when (case when l_suppkey % 12 = 11 then 1 else 0 end) <> 3 then 4 when l_partkey % 2 <> 4 then 2 else 1 end) as last_move from o group by 1)
select image_id, 4 as last_round, last_move, case when 4 - last_move >= 2 then 'converged' else 'continue' end as status from m""", uses=("numbered",))
def annotation_convergence(spark, sf):
    return N.convergence(objects(spark, sf))


@query("annotation_records", f"""with {NAMES}, j as (select image_id, string_agg('{{"name":"' || name || '","bbox":[' || (l_partkey % 90) || '.0,' || (l_suppkey % 40) || '.0,200.0,300.0]}}', ',' order by obj_idx) as objs from o group by 1)
select image_id, '{{"image":{{"path":"i' || image_id || '.jpg","width":640,"height":480}},"iterations":' || (image_id % 3 + 1) || ',"objects":[' || objs || ']}}' as record from j""", uses=("numbered",))
def annotation_records(spark, sf):
    o = objects(spark, sf)
    images = o.select("image_id").distinct().selectExpr("image_id", "'i' || image_id || '.jpg' as path", "640 as width", "480 as height", "image_id % 3 as iterations")
    return N.result_records(images, o)
