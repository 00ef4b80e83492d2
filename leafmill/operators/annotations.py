"""Detection annotations: counting, numbering, convergence, result records.

Objects are rows: image_id, obj_idx, name, bbox, iterations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import base_name


def explode_objects(annotations: DataFrame) -> DataFrame:
    """One row per object of an ``objects`` array."""
    return annotations.select("image_id", F.posexplode("objects").alias("obj_idx", "o")).select("image_id", "obj_idx", "o.*")


def count_categories(objects: DataFrame) -> DataFrame:
    """Objects per image and category (name without its trailing number)."""
    return objects.groupBy("image_id", base_name(F.col("name")).alias("category")).agg(F.count("*").alias("n"))


def number_objects(objects: DataFrame) -> DataFrame:
    """Add ``label``: category and running number; an object alone in its category keeps its name."""
    named = objects.withColumn("category", base_name(F.col("name")))
    w = Window.partitionBy("image_id", "category")
    number = F.row_number().over(w.orderBy("obj_idx"))
    label = F.when(F.count("*").over(w) > 1, F.concat("category", number.cast("string"))).otherwise(F.trim("name"))
    return named.withColumn("label", label)


def convergence(objects: DataFrame, stable_rounds: int = 2, max_rounds: int = 5) -> DataFrame:
    """Per image the last round and its ``status``: ``converged`` when no box moved for the last two rounds,
    ``review`` after five rounds without that, else ``continue``."""
    rounds = objects.select("image_id", "obj_idx", F.explode("iterations").alias("i")).select("image_id", "obj_idx", "i.round", "i.bbox")
    w = Window.partitionBy("image_id", "obj_idx").orderBy("round")
    moved = rounds.withColumn("__m", ~F.coalesce(F.col("bbox") == F.lag("bbox").over(w), F.lit(False)))
    per_image = moved.groupBy("image_id").agg(
        F.max("round").alias("last_round"), F.max(F.when(F.col("__m"), F.col("round"))).alias("last_move")
    )
    still = F.col("last_round") - F.col("last_move")
    status = F.when(still >= stable_rounds, "converged").when(F.col("last_round") >= max_rounds, "review").otherwise("continue")
    return per_image.withColumn("status", status)


def result_records(images: DataFrame, objects: DataFrame) -> DataFrame:
    """One JSON record per image: its size, rounds so far + 1, and its objects in order.

    images: image_id, path, width, height, iterations.
    """
    listed = objects.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("obj_idx", "name", "bbox"))).alias("o"))
    record = F.to_json(
        F.struct(
            F.struct("path", "width", "height").alias("image"),
            (F.coalesce("iterations", F.lit(0)) + 1).alias("iterations"),
            F.coalesce(F.transform("o", lambda x: F.struct(x["name"].alias("name"), x["bbox"].alias("bbox"))),
                       F.array().cast("array<struct<name:string,bbox:array<double>>>")).alias("objects"),
        )
    )
    return images.join(listed, "image_id", "left").select("image_id", record.alias("record"))
