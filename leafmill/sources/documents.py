"""Binary documents and annotation JSON in, document texts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "array<struct<name:string,bbox:array<double>,iterations:array<struct<round:int,bbox:array<double>,feedback:string>>>>"


def scan_binary(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """Files below a folder whose name ends in one of the suffixes: path, length, content."""
    pattern = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_at(content: Column, offset: int = 0, limit: int = -1) -> Column:
    """A byte range; a negative limit reads to the end."""
    if limit < 0:
        return F.substring(content, F.lit(offset + 1), F.octet_length(content))
    return F.substring(content, offset + 1, limit)


def _objects(text: Column) -> Column:
    """Objects of ``{"objects": […]}`` or of a bare list; null when the text is neither."""
    wrapped = F.from_json(text, f"objects {OBJECTS}")["objects"]
    bare = F.when(F.ltrim(text).startswith("["), F.from_json(text, OBJECTS))
    return F.coalesce(wrapped, bare)


def parse_annotations(text: Column) -> Column:
    """Objects of a model reply: the whole text, a fenced JSON block, or the outermost braces."""
    trimmed = F.trim(text, F.lit(" \t\r\n"))
    fence = F.regexp_extract(trimmed, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(trimmed, r"(?s)(\{.*\})", 1)
    return F.coalesce(
        F.when(trimmed.rlike(r"^[\[{]"), _objects(trimmed)), F.when(fence != "", _objects(fence)),
        F.when(braces != "", F.from_json(braces, f"objects {OBJECTS}")["objects"]),
    )


def write_documents(documents: DataFrame, path: str, column: str, by: str = "doc_id") -> None:
    """The texts of documents as (``by``, ``value``) rows in Parquet files, dealt and sorted by document: as many files as
    shuffle partitions, whatever the number of documents. Texts are single rows and never collected."""
    keyed = documents.select(by, F.col(column).alias("value"))
    keyed.repartition(by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)
