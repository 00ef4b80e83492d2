"""Exact column statistics as one-row DataFrames that stay inside the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import checkpointed

STATISTICS = ("median", "mean", "mode", "outlier_lower", "outlier_upper")
OUTLIER_FACTORS = {"iqr": 1.5, "iqr_3": 3.0}


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """One row ``q0, q1, …``: exact linear-interpolated quantiles of the non-null values."""
    many = quantiles(df, {column: list(probs)})
    return many.select(*[F.col(f"c0_q{i}").alias(f"q{i}") for i in range(len(probs))])


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> DataFrame:
    """One row ``c<i>_q<j>``: exact linear-interpolated quantiles j of column i, for all columns in one pass.

    Values are counted per distinct value before they are shuffled, and the distinct values are cut into ranges, as many
    as the session has shuffle partitions. Ranges are sized by their sums; only those that hold a wanted rank are put
    in order, each in its own task. The counted ranges are checkpointed, so the table is read once.
    """
    names = list(wanted)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)])).alias("x"))
    counts = values.select("x.c", "x.v").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    ranged = checkpointed(counts.repartitionByRange(parts, "c", "v").withColumn("part", F.spark_partition_id()))
    by_range = Window.partitionBy("c").orderBy("part")  # a row for each range of a column
    sizes = ranged.groupBy("c", "part").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumns({"start": F.sum("size").over(by_range) - F.col("size"), "rows": F.sum("size").over(Window.partitionBy("c"))})

    def position(p: float):
        return F.lit(float(p)) * (F.col("rows") - 1)

    def ranks(ps: list[float]):
        return F.array(*[f(position(p)).cast("long") for p in ps for f in (F.floor, F.ceil)])

    asked = ranks(wanted[names[0]])
    for i, n in enumerate(names[1:], 1):
        asked = F.when(F.col("c") == i, ranks(wanted[n])).otherwise(asked)
    needed = sizes.where(F.exists(asked, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("size")))).select("c", "part", "start", "rows")
    inside = (
        ranged.join(F.broadcast(needed), ["c", "part"])  # at most two rows per column and probability
        .withColumn("end", F.col("start") + F.sum("n").over(Window.partitionBy("c", "part").orderBy("v")))
        .withColumn("begin", F.col("end") - F.col("n"))
    )

    def at(i: int, p: float, rounding):
        rank = rounding(position(p))
        return F.max(F.when((F.col("c") == i) & (F.col("begin") <= rank) & (rank < F.col("end")), F.col("v")))

    every = [(i, j, p) for i, n in enumerate(names) for j, p in enumerate(wanted[n])]
    picked = inside.agg(
        *[F.max(F.when(F.col("c") == i, F.col("rows"))).alias(f"rows{i}") for i in range(len(names))],
        *[at(i, p, F.floor).alias(f"lo{i}_{j}") for i, j, p in every],
        *[at(i, p, F.ceil).alias(f"hi{i}_{j}") for i, j, p in every],
    )

    def between(i: int, j: int, p: float):
        place = F.lit(float(p)) * (F.col(f"rows{i}") - 1)
        return F.col(f"lo{i}_{j}") + (F.col(f"hi{i}_{j}") - F.col(f"lo{i}_{j}")) * (place - F.floor(place))

    return picked.select(*[between(i, j, p).alias(f"c{i}_q{j}") for i, j, p in every])


def mode_value(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null value, the lowest on ties; counts are pre-aggregated per value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(*group).agg(best["v"].alias("mode"))


def _probs(kind: str) -> list[float]:
    return {"median": [0.5], "outlier_lower": [0.25, 0.75], "outlier_upper": [0.25, 0.75]}.get(kind, [])


def _from_quantiles(kind: str, method: str, q: list):
    if kind == "median":
        return q[0]
    k = OUTLIER_FACTORS[method]
    return q[0] - k * (q[1] - q[0]) if kind == "outlier_lower" else q[1] + k * (q[1] - q[0])


def statistic(df: DataFrame, column: str, kind: str, outlier_method: str = "iqr") -> DataFrame:
    """One row, one column ``stat``: median, mean, mode, outlier_lower or outlier_upper of a column.

    Null on an empty or all-null column.
    """
    kind = kind.lower()
    if kind == "mean":
        return df.agg(F.avg(column).alias("stat"))
    if kind == "mode":
        return mode_value(df, column).select(F.col("mode").alias("stat"))
    if kind in STATISTICS:
        q = exact_quantiles(df, column, _probs(kind))
        return q.select(_from_quantiles(kind, outlier_method, [F.col(c) for c in q.columns]).alias("stat"))
    raise ValueError(f"unknown statistic {kind!r}; expected one of {STATISTICS}")


def statistics_of(df: DataFrame, wanted: Sequence[tuple[str, str, str]]) -> dict[tuple[str, str, str], object]:
    """Values of several (column, kind, outlier method) at once: one pass for all quantiles, one for all means, one for each
    mode. None on an empty or all-null column."""
    out: dict[tuple[str, str, str], object] = {}
    for column, kind, method in wanted:
        if kind.lower() not in STATISTICS:
            raise ValueError(f"unknown statistic {kind!r}; expected one of {STATISTICS}")
        if kind.lower().startswith("outlier") and method not in OUTLIER_FACTORS:
            raise KeyError(method)
    probs: dict[str, list[float]] = {}
    for column, kind, _ in wanted:
        for p in _probs(kind.lower()):
            if p not in probs.setdefault(column, []):
                probs[column].append(p)
    means = sorted({c for c, kind, _ in wanted if kind.lower() == "mean"})
    quantile_row = quantiles(df, probs).first() if probs else None
    mean_row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(means)]).first() if means else None
    columns = list(probs)
    for column, kind, method in wanted:
        name = kind.lower()
        if name == "mean":
            value = mean_row[f"m{means.index(column)}"]
        elif name == "mode":
            row = mode_value(df, column).first()
            value = row["mode"] if row else None
        else:
            i = columns.index(column)
            q = [quantile_row[f"c{i}_q{probs[column].index(p)}"] for p in _probs(name)]
            value = None if any(x is None for x in q) else _from_quantiles(name, method, q)
        out[column, kind, method] = value
    return out


def required_statistic(df: DataFrame, column: str, kind: str, **kw) -> DataFrame:
    """Like ``statistic`` but the query fails on an empty or all-null column."""
    message = F.lit(f"column {column!r} has no values for {kind}")
    return statistic(df, column, kind, **kw).agg(F.max("stat").alias("stat")).select(
        F.coalesce(F.col("stat"), F.raise_error(message)).alias("stat")
    )
