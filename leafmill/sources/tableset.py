"""Table sets: an ordered mapping of table name to lazy DataFrame, its scan, sink and preview."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.cleaning import observe_operations, run_operations, validate_config

TableSet = dict[str, DataFrame]



def list_members(spark: SparkSession, path: str, fmt: str = "parquet") -> list[str]:
    """Names of the tables below a folder, on any file system Hadoop knows."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n[: -len(fmt) - 1] for n in names if n.endswith(f".{fmt}"))


def select_members(names: Sequence[str], skip: Sequence[str] = (), only: Sequence[str] | None = None) -> list[str]:
    """Drop ``skip``, then keep ``only`` (None keeps all); an empty choice is an error."""
    kept = [n for n in names if n not in set(skip) and (only is None or n in set(only))]
    if not kept:
        raise ValueError("no table left to process")
    return kept


def scan_tables(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    skip: Sequence[str] = (),
    only: Sequence[str] | None = None,
    **options: Any,
) -> TableSet:
    """Every chosen member as a lazy scan; nothing is read but file footers."""
    names = select_members(list_members(spark, path, fmt), skip, only)
    return {n: spark.read.format(fmt).options(**options).load(f"{path}/{n}.{fmt}") for n in names}


def output_path(config: dict[str, Any]) -> str:
    if config.get("output_path"):
        return config["output_path"]
    return config["input_path"].rstrip("/") + config.get("output_suffix", "_cleaned")


def write_tables(tables: TableSet, path: str, fmt: str = "parquet") -> None:
    """Same names, overwriting."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}.{fmt}")


def clean_tables(tables: TableSet, config: dict[str, Any], orders: dict[str, Sequence[str]]) -> TableSet:
    """Apply each table's configured operations; tables without any pass through."""
    sheets = config.get("sheets", {})
    return {
        name: run_operations(df, sheets.get(name, {}).get("operations", []), orders.get(name, ()))
        for name, df in tables.items()
    }


def clean_and_write(
    spark: SparkSession, config: dict[str, Any], orders: dict[str, Sequence[str]], fmt: str = "parquet"
) -> list[dict[str, Any]]:
    """The whole cleaner: validate, scan, clean, write; returns row counts per table and stage.

    Counts ride along with the write, so they cost no extra pass. Folder writes list members by name.
    """
    rules = config.get("global", {})
    errors = validate_config(config)
    if errors:
        raise ValueError("; ".join(errors))
    tables = scan_tables(
        spark, config["input_path"], fmt, rules.get("skip_sheets") or (), rules.get("only_sheets")
    )
    errors = validate_config(config, {n: df.columns for n, df in tables.items()})
    if errors:
        raise ValueError("; ".join(errors))
    report = []
    for name, df in tables.items():
        steps = config.get("sheets", {}).get(name, {}).get("operations", [])
        cleaned, watch = observe_operations(df, steps, orders.get(name, ()))
        write_tables({name: cleaned}, output_path(config), fmt)
        report.append({"table": name, "rows": [w.get["rows"] for w in watch]})
    return report


def preview(tables: TableSet, samples: int = 3, order: dict[str, str] | None = None, chars: int = 50) -> DataFrame:
    """(table, column, dtype, rows, columns, samples): every column with the values of its first rows by the order key.

    One pass per table: each column's smallest non-null (key, value) pairs are kept, ``samples`` of them at most, by
    ``min`` over what is left after the one before. Values are cut to ``chars``.
    """
    parts = []
    for name, df in tables.items():
        key = (order or {}).get(name) or df.columns[0]
        cells = df.select(
            F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(key).alias("k"), F.substring(F.col(c).cast("string"), 1, chars).alias("s")) for i, c in enumerate(df.columns)])).alias("x")
        ).select("x.*")
        # the window group limit keeps a column's first rows in every task before anything is shuffled
        place = F.row_number().over(Window.partitionBy("i").orderBy("k", "s"))
        first = cells.where("s is not null").withColumn("r", place).where(F.col("r") <= samples)
        shown = first.groupBy("i").agg(F.array_join(F.sort_array(F.collect_list(F.struct("r", "s")))["s"], ", ").alias("samples"))
        kinds = [(i, c, df.schema[c].dataType.simpleString()) for i, c in enumerate(df.columns)]
        columns = df.sparkSession.createDataFrame(kinds, "i int, column string, dtype string")
        total = df.agg(F.count("*").alias("rows")).scalar()
        parts.append(
            columns.join(shown, "i", "left").select(
                F.lit(name).alias("table"), "column", "dtype", total.alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce("samples", F.lit("")).alias("samples")
            )
        )
    return reduce(DataFrame.unionAll, parts)
