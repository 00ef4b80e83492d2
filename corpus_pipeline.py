"""From raw documents to packed training sequences, one operator of ``leafmill.llm`` a stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.mixing import mix_sources
from leafmill.llm.near_dedup import near_duplicates
from leafmill.llm.packing import pack_documents
from leafmill.llm.suffix_dedup import remove_repeats
from leafmill.llm.tables import shared_folder, with_keys, written
from leafmill.llm.toxicity import fit_toxicity, score_toxicity

#: No stage but the mix can be said in SQL: two train models or sample hashes, two work on bytes and token ids.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under names c0, c1, … that no stage adds, and the name each column has got."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that the operator rejects: those with a score of one half or more.

    Learns from all labelled documents. Texts that are null, empty or without a word stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    plain, names = _plain(docs)
    scored = score_toxicity(plain, model, id_column=names["doc_id"], text_column=names["text"])
    return scored.where(F.col("toxicity") < 0.5).select(*names.values()).toDF(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays. Rows that repeat an id, or null, with the same text are one
    document, with different texts they are different ones."""
    plain, names = _plain(docs)
    ident, text = names["doc_id"], names["text"]
    kept = near_duplicates(plain, id_column=ident, text_column=text).where("kept").select("key").distinct()
    keyed = with_keys(plain, ident, text)
    return keyed.join(kept, "key").dropDuplicates(["key"]).select(*names.values()).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 100 that occur earlier; a document of which nothing is left stays with an empty text."""
    plain, names = _plain(docs)
    others = [n for c, n in names.items() if c not in ("doc_id", "text")]
    cut = remove_repeats(plain, keep_text=True, carry=others, id_column=names["doc_id"], text_column=names["text"])
    renewed = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[renewed.get(c, F.col(n)).alias(n) for c, n in names.items()]).toDF(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (none to three times), by output shard, in the order of the shard.

    A document whose last words fall outside its source's target is taken whole, so texts stay whole; sources end at most one
    document above their target. Documents without words are not taken. Every row is a document, whatever ids repeat.
    """
    plain, names = _plain(docs)
    rows = written(plain.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    mix = mix_sources(rows, id_column=names["doc_id"], text_column=names["text"], source_column=names["source"], row_column="row")
    taken = mix.pieces.where("start = 0").select("row", "round", "shard", "shuffle_key").dropDuplicates(["row", "round"])
    shards = rows.join(taken, "row").repartition("shard").sortWithinPartitions("shard", "shuffle_key")
    return shards.select(*names.values()).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids; a row for each piece of a document."""
    return pack_documents(docs, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_to_weights),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
