"""Small helpers around Spark tables for this package: written tables, chunks, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.textbytes import CHUNK_PRIME, NULL_KEY

KEY_ROWS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``. Only a local master without one, as in tests, gets its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and sc.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="leafmill-")
        sc.setCheckpointDir(folder)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def with_keys(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``rows`` with ``key``: one number for each pair of an id and a text (null counts as empty), in the order of the ids, null ids last.

    It is the id where every id, null too, has a single text. Otherwise the distinct pairs are numbered and joined back.
    """
    pair = rows.select(F.col(id_column).cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("__text"))
    if pair.groupBy("__id").agg((F.min("__text") < F.max("__text")).alias("several")).where("several").isEmpty():
        return rows.withColumn("key", doc_key(id_column))
    order = [F.col("__id").isNull(), F.col("__id"), F.col("__text")]
    pairs = pair.distinct()
    ranged = written(pairs.repartitionByRange(parts(pairs.count(), KEY_ROWS), *order).withColumn("__part", F.spark_partition_id()), "keys")
    before, shift = 0, []
    for r in ranged.groupBy("__part").count().orderBy("__part").collect():  # a row for each part
        shift.append((r["__part"], before))
        before += r["count"]
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    shifts = rows.sparkSession.createDataFrame(shift, "__part int, __before long")
    numbered = ranged.withColumn("__nth", nth).join(F.broadcast(shifts), "__part").select(F.col("__id").alias("__i"), F.col("__text").alias("__t"), (F.col("__before") + F.col("__nth")).cast("long").alias("key"))
    told = rows.withColumn("__id", F.col(id_column).cast("long")).withColumn("__text", F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
    return told.join(numbered, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t"))).select(*rows.columns, "key")


def chunk_column(key: Column, n: int) -> Column:
    return F.pmod(F.pmod(key, F.lit(CHUNK_PRIME)), F.lit(n)).cast("int")


def text_volume(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parts(amount: int, each: int) -> int:
    """How many parts of about ``each`` an amount makes."""
    return max(1, -(-amount // each))
