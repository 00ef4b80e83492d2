"""The registered queries of this package, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=100)


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.mixing import mix_sources, taken_words

    return taken_words(mix_sources(table(spark, sf_dir, "documents")))


ORACLE["op1_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number
  FROM sized GROUP BY source
), dealt AS (
  SELECT *, CAST(1 + number % 3 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM sources
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM dealt) - coalesce(sum(cap) OVER before, 0))
            / ((SELECT sum(weight) FROM dealt) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM dealt WINDOW before AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap, weight * greatest((SELECT max(level) FROM levels), 0)) AS target FROM levels
), placed AS (
  SELECT s.*, t.source_size, t.target, least(CAST(round(t.target) AS BIGINT), 3 * t.source_size) AS take,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, take - begin)) + greatest(0, least(size, take - source_size - begin))
            + greatest(0, least(size, take - 2 * source_size - begin)) AS BIGINT) AS taken
FROM placed
"""


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.toxicity import fit_toxicity, held_out, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    scored = score_toxicity(docs, fit_toxicity(docs, learned))
    return scored.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@query
def op10_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.metric_join import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


ORACLE["op10_metric_range_join"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), unit AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT v.vec_id, CAST((SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS BIGINT) AS n_links,
       (SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id) AS component_id,
       v.vec_id = (SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id) AS kept
FROM v
"""


@query
def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.hash_search import nearest_by_codes

    return nearest_by_codes(table(spark, sf_dir, "embeddings"), queries=F.col("id") % 20 == 0, k=20)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.language_id import learn_languages, predict_language
    from leafmill.llm.toxicity import held_out

    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.select("doc_id", "text", "lang").where(~held_out("doc_id", 4, 2)))
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op4_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.quality import fit_quality, score_quality
    from leafmill.llm.toxicity import held_out

    docs, meta = table(spark, sf_dir, "documents"), ["source", "lang"]
    learned = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    model = fit_quality(docs.where(~held_out("doc_id", 5, 0)), learned, meta, "n_chars")
    scored = score_quality(docs, model, meta, "n_chars")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.passage_dedup import near_passages

    return near_passages(table(spark, sf_dir, "documents"))


@query
def op12_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.sharding import shard_documents

    sharded = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("home").alias("home_shard"),
    )


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.conversations import damaged, repair_conversations

    turns = table(spark, sf_dir, "conversations")
    found = repair_conversations(damaged(turns)).withColumnRenamed("conv", "conv_id")
    every = turns.select("conv_id").unionByName(found, allowMissingColumns=True)  # conversations that lost all rows too
    zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    return every.groupBy("conv_id").agg(
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op11_golub_kahan_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.whitening import fit_whitening, whiten

    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit_whitening(vectors, components=16))
