"""Ordered scans (lag, lead, running sum/min/max, last/next known value) over groups of any size.

Every scan is a window over (group). Pages, tables and documents are far smaller than a task, so that is the
whole plan. Where one group may be huge (a third of a table under one document id, say) pass ``slice_rows``
or set ``leafmill.sliceRows`` on the session: a group whose integer position runs past that many rows is then
cut into slices, the window runs inside (group, slice), and one small row per slice carries the state across
slice borders. The carry branch reads the input once more, so give it a table that is already written or
checkpointed rather than a long chain of operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS_CONF = "leafmill.sliceRows"
_SLICE = "__slice"


@dataclass(frozen=True)
class Scan:
    """One output column of a scan.

    kind: ``lag``, ``lead`` (neighbour's value), ``sum``, ``min``, ``max`` (running), ``last``, ``next``
    (nearest non-null value before / after). ``inclusive`` counts the current row.
    """

    kind: str
    value: Column
    inclusive: bool = True


def _inside(scan: Scan, w) -> Column:
    before = (Window.unboundedPreceding, 0 if scan.inclusive else -1)
    after = (0 if scan.inclusive else 1, Window.unboundedFollowing)
    if scan.kind == "lag":
        return F.lag(F.struct(scan.value.alias("v"))).over(w)
    if scan.kind == "lead":
        return F.lead(F.struct(scan.value.alias("v"))).over(w)
    if scan.kind == "last":
        return F.last(scan.value, ignorenulls=True).over(w.rowsBetween(*before))
    if scan.kind == "next":
        return F.first(scan.value, ignorenulls=True).over(w.rowsBetween(*after))
    return getattr(F, scan.kind)(scan.value).over(w.rowsBetween(*before))


def _slice_state(scan: Scan, order: Column) -> Column:
    """What a whole slice contributes to the slices after (or before) it."""
    if scan.kind == "lag":
        return F.max_by(F.struct(scan.value.alias("v")), order)
    if scan.kind == "lead":
        return F.min_by(F.struct(scan.value.alias("v")), order)
    known = F.when(scan.value.isNotNull(), order)
    if scan.kind == "last":
        return F.max_by(scan.value, known)
    if scan.kind == "next":
        return F.min_by(scan.value, known)
    return getattr(F, scan.kind)(scan.value)


def _carry(scan: Scan, state: str, w) -> Column:
    if scan.kind == "lag":
        return F.last(state).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if scan.kind == "lead":
        return F.first(state).over(w.rowsBetween(1, Window.unboundedFollowing))
    if scan.kind == "last":
        return F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if scan.kind == "next":
        return F.first(state, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return getattr(F, scan.kind)(state).over(w.rowsBetween(Window.unboundedPreceding, -1))


def _combine(scan: Scan, inside: Column, carry: Column) -> Column:
    if scan.kind == "sum":
        return F.when(inside.isNull() & carry.isNull(), F.lit(None)).otherwise(
            F.coalesce(inside, F.lit(0)) + F.coalesce(carry, F.lit(0))
        )
    if scan.kind == "max":
        return F.greatest(inside, carry)
    if scan.kind == "min":
        return F.least(inside, carry)
    return F.coalesce(inside, carry)


def _finish(scan: Scan, value: Column) -> Column:
    return value["v"] if scan.kind in ("lag", "lead") else value


def scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    scans: dict[str, Scan],
    position: str | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Add the scan columns. ``position`` is the integer column to slice on (ascending with ``order``).

    Slicing groups on null-free ``group`` keys only; without slicing nulls form a group like any value.
    """
    rows = int(df.sparkSession.conf.get(SLICE_ROWS_CONF, "0")) if slice_rows is None else slice_rows
    if position is None or rows <= 0:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumns({name: _finish(s, _inside(s, w)) for name, s in scans.items()})

    sliced = df.withColumn(_SLICE, F.floor(F.col(position) / F.lit(rows)))
    oversized = df.where(F.col(position) >= rows).select(*group).distinct()
    order_key = F.struct(*order)
    states = (
        sliced.join(oversized, list(group), "left_semi")
        .groupBy(*group, _SLICE)
        .agg(*[_slice_state(s, order_key).alias(f"__s_{name}") for name, s in scans.items()])
    )
    across = Window.partitionBy(*group).orderBy(_SLICE)
    carry = states.select(
        *group,
        _SLICE,
        *[_carry(s, f"__s_{name}", across).alias(f"__c_{name}") for name, s in scans.items()],
    )
    w = Window.partitionBy(*group, _SLICE).orderBy(*order)
    inside = sliced.withColumns({f"__i_{name}": _inside(s, w) for name, s in scans.items()})
    joined = inside.join(carry, [*group, _SLICE], "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in scans],
        *[
            _finish(s, _combine(s, F.col(f"__i_{name}"), F.col(f"__c_{name}"))).alias(name)
            for name, s in scans.items()
        ],
    )


def islands(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    starts: Column,
    out: str,
    position: str | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Number the runs of a group 1, 2, …; a run begins on every row where ``starts`` is true."""
    flag = F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return scan(df, group, order, {out: Scan("sum", flag)}, position, slice_rows)


def global_row_number(df: DataFrame, order: Sequence[Column | str], out: str, parts: int | None = None) -> DataFrame:
    """0-based position in one total order over the whole table, without a single-task window.

    Rows are range-partitioned, numbered inside their partition, and shifted by the size of the partitions
    before it. The sizes are one row per partition. The ranged table is checkpointed so that both uses see
    the same partition boundaries.
    """
    from leafmill.session import checkpointed

    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.select(
        "__part",
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__offset"),
    )
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        ranged.withColumn("__local", local)
        .join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumn(out, F.col("__offset") + F.col("__local") - 1)
        .drop("__part", "__local", "__offset")
    )
