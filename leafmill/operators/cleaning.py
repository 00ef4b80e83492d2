"""Table cleaning: filters, null removal, deduplication, and pipelines of them."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.statistics import STATISTICS, statistics_of
from leafmill.session import written

COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "==": operator.eq,
    "!=": operator.ne,
}
RANGES = ("between", "not_between")

# The accepted date-time text formats, in the order they are tried.
SPARK_DATETIME_PATTERNS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyyMMdd",
]


def parse_datetime_column(text: Column) -> Column:
    """Text as a timestamp, by the first format that fits; null where none does."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(p)) for p in SPARK_DATETIME_PATTERNS])


def _literal(value: Any, dtype: T.DataType) -> Any:
    """A configuration value to compare with a column; for dates a timestamp: text by format, numbers as epoch seconds."""
    if not isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) or isinstance(value, bool):
        return value
    if isinstance(value, str):
        return parse_datetime_column(F.lit(value))
    if isinstance(value, (int, float)):
        return F.timestamp_seconds(F.lit(float(value)))
    if isinstance(value, dt.date):
        # text + cast keeps the session time zone, whatever the driver's zone is
        return F.lit(value.isoformat()).cast("timestamp")
    return value


def _needs_statistic(condition: dict[str, Any]) -> tuple[str, str, str] | None:
    kind = condition.get("value_type", "literal")
    if kind == "literal" or condition.get("operator") in RANGES:
        return None
    return condition.get("value_column", condition["column"]), kind, condition.get("outlier_method", "iqr")


def _check_condition(df: DataFrame, condition: dict[str, Any]) -> None:
    for needed in (condition["column"], condition.get("value_column", condition["column"])):
        if needed not in df.columns:
            raise KeyError(f"column {needed!r} not found; available: {', '.join(df.columns[:10])}")


def condition_column(df: DataFrame, condition: dict[str, Any], known: dict[tuple[str, str, str], Any] | None = None) -> Column:
    """One filter condition as a Column. ``known`` holds statistics of ``df``; one that is not there is computed.

    A statistic of a column without any value is an error, unless the table has no row at all.
    """
    name, op = condition["column"], condition["operator"]
    kind = condition.get("value_type", "literal")
    _check_condition(df, condition)
    if op not in COMPARISONS and op not in RANGES:
        raise ValueError(f"unknown operator {op!r}; expected one of {[*COMPARISONS, *RANGES]}")
    column, dtype = F.col(name), df.schema[name].dataType
    value = condition.get("value")
    if op in RANGES:
        if kind != "literal" or not isinstance(value, (list, tuple)) or len(value) != 2:
            raise ValueError(f"operator {op!r} needs a literal value [low, high], got {value!r}")
        inside = column.between(*[_literal(v, dtype) for v in value])
        return ~inside if op == "not_between" else inside
    if kind == "literal":
        if value is None:
            raise ValueError(f"condition on {name!r} has no value")
        return COMPARISONS[op](column, _literal(value, dtype))
    asked = _needs_statistic(condition)
    value = (known if known is not None else statistics_of(df, [asked]))[asked]
    if value is None and not df.isEmpty():
        raise ValueError(f"column {asked[0]!r} has no values for {kind}")
    return COMPARISONS[op](column, F.lit(value))


def filter_rows(df: DataFrame, conditions: Sequence[dict[str, Any]], logic: str = "and") -> DataFrame:
    """Keep rows meeting all (``and``) or any (``or``) of the conditions; no condition keeps all.

    Statistics in the conditions are computed here, all of a step together.
    """
    if logic not in ("and", "or"):
        raise ValueError(f"unknown logic {logic!r}; expected and, or")
    if not conditions:
        return df
    join = operator.and_ if logic == "and" else operator.or_
    for c in conditions:
        _check_condition(df, c)
    asked = list(dict.fromkeys(x for x in map(_needs_statistic, conditions) if x))
    known = statistics_of(df, asked) if asked else {}
    return df.where(reduce(join, [condition_column(df, c, known) for c in conditions]))


def drop_nulls(
    df: DataFrame, columns: Sequence[str] | None = None, logic: str = "or", nan_as_null: bool = False
) -> DataFrame:
    """Drop rows with any (``or``) or only (``and``) nulls in the columns; no columns means no change."""
    if logic not in ("and", "or"):
        raise ValueError(f"unknown logic {logic!r}; expected and, or")
    if not columns:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")

    def absent(c: str) -> Column:
        null = F.col(c).isNull()
        if nan_as_null and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            return null | F.isnan(c)
        return null

    join = operator.or_ if logic == "or" else operator.and_
    return df.where(~reduce(join, [absent(c) for c in columns]))


def deduplicate(
    df: DataFrame, columns: Sequence[str], logic: str = "and", order: Sequence[str] = ()
) -> DataFrame:
    """Keep first occurrences in ``order`` (a unique key).

    ``and``: the first row of each combination. Rank 1 is cut to one row per map task before the shuffle
    (window group limit), so a hot combination does not travel.
    ``or``: rows at the first occurrence of *every* column's value, judged on the whole input. The first
    position per value is a map-side combined minimum; only those positions are joined back.
    """
    if logic not in ("and", "or"):
        raise ValueError(f"unknown logic {logic!r}; expected and, or")
    if not columns:
        return df
    missing = [c for c in [*columns, *order] if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    if not order:
        raise ValueError("deduplicate needs an order key: rows of a DataFrame have no position")
    if logic == "and":
        w = Window.partitionBy(*columns).orderBy(*order)
        return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    firsts = [df.groupBy(c).agg(F.min(key).alias("__first")).select("__first") for c in columns]
    common = reduce(lambda a, b: a.join(b, "__first", "left_semi"), firsts)
    return df.withColumn("__first", key).join(common, "__first", "left_semi").drop("__first")


OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "filter": filter_rows,
    "drop_nulls": drop_nulls,
    "deduplicate": deduplicate,
}


def register_operation(name: str, handler: Callable[..., DataFrame]) -> None:
    """Add a named operation; its parameters arrive as keywords from the configuration."""
    OPERATIONS[name] = handler


def apply_operation(df: DataFrame, step: dict[str, Any], order: Sequence[str] = ()) -> DataFrame:
    kind = step.get("type", "")
    if kind not in OPERATIONS:
        raise ValueError(f"unknown operation {kind!r}; expected one of {list(OPERATIONS)}")
    params = {k: v for k, v in step.items() if k != "type"}
    if kind == "deduplicate":
        params.setdefault("order", order)
    return df.transform(OPERATIONS[kind], **params)


def run_operations(df: DataFrame, operations: Sequence[dict[str, Any]], order: Sequence[str] = ()) -> DataFrame:
    """Fold the operations in order into one lazy plan.

    A filter that compares with a statistic reads its input twice, for the statistic and for the filter: what the steps
    before it make is written first, so that no step runs again.
    """
    for i, step in enumerate(operations):
        if i and any(_needs_statistic(c) for c in step.get("conditions") or () if isinstance(c, dict) and "column" in c):
            df = written(df)
        df = apply_operation(df, step, order)
    return df


def _metric_row(rows_in: Column, rows_out: Column) -> list[Column]:
    return [
        rows_in.alias("rows_in"),
        rows_out.alias("rows_out"),
        (rows_in - rows_out).alias("removed"),
        F.round(rows_out / F.greatest(rows_in, F.lit(1)) * 100, 1).alias("retention_pct"),
    ]


def stage_metrics(df: DataFrame, operations: Sequence[dict[str, Any]], order: Sequence[str] = ()) -> DataFrame:
    """Rows in, out, removed and retention per stage.

    Every stage but the last is written, so each step runs once; ``observe_operations`` counts without that in the run of a sink.
    """
    stages = [df]
    for i, step in enumerate(operations):
        done = apply_operation(stages[-1], step, order)
        stages.append(written(done) if i + 1 < len(operations) else done)
    counts = [
        s.agg(F.count("*").alias("rows")).select(F.lit(i).alias("stage"), "rows") for i, s in enumerate(stages)
    ]
    per_stage = reduce(DataFrame.unionAll, counts)
    previous = F.lag("rows").over(Window.orderBy("stage"))  # one row per stage
    kinds = F.element_at(F.array(*[F.lit(s["type"]) for s in operations]), F.col("stage"))
    return (
        per_stage.withColumn("rows_before", previous)
        .where("stage > 0")
        .select("stage", kinds.alias("operation"), *_metric_row(F.col("rows_before"), F.col("rows")))
    )


def observe_operations(
    df: DataFrame, operations: Sequence[dict[str, Any]], order: Sequence[str] = ()
) -> tuple[DataFrame, list[Observation]]:
    """The pipeline with a row counter after each stage; the counts fill in when a sink runs.

    Unlike ``stage_metrics`` this needs no pass of its own.
    """
    watch = [Observation("input")]
    current = df.observe(watch[0], F.count(F.lit(1)).alias("rows"))
    for i, step in enumerate(operations, 1):
        seen = Observation(f"stage {i} {step.get('type')}")
        current = apply_operation(current, step, order).observe(seen, F.count(F.lit(1)).alias("rows"))
        watch.append(seen)
    return current, watch


def validate_config(config: dict[str, Any], schemas: dict[str, Sequence[str]] | None = None) -> list[str]:
    """Errors in a cleaning configuration; empty when it is valid.

    ``schemas`` (table → columns) adds checks of the named columns.
    """
    errors: list[str] = []
    if not isinstance(config.get("input_path"), str):
        errors.append("input_path must be a string")
    if not isinstance(config.get("global", {}), dict):
        errors.append("global must be an object")
    sheets = config.get("sheets", {})
    if not isinstance(sheets, dict):
        return [*errors, "sheets must be an object"]
    for sheet, body in sheets.items():
        steps = body.get("operations", []) if isinstance(body, dict) else None
        if not isinstance(steps, list):
            errors.append(f"{sheet}: must be an object with a list of operations")
            continue
        for i, step in enumerate(steps, 1):
            columns = schemas.get(sheet) if schemas else None
            errors.extend(f"{sheet}, operation {i}: {e}" for e in _step_errors(step, columns))
    return errors


def _step_errors(step: Any, columns: Sequence[str] | None) -> list[str]:
    if not isinstance(step, dict):
        return ["must be an object"]
    kind = step.get("type", "")
    if kind not in OPERATIONS:
        return [f"unknown operation {kind!r}"]
    errors = []
    if step.get("logic", "and") not in ("and", "or"):
        errors.append(f"logic {step['logic']!r} is not and / or")
    if kind != "filter":
        for c in step.get("columns") or []:
            if columns is not None and c not in columns:
                errors.append(f"unknown column {c!r}")
        return errors
    conditions = step.get("conditions", [])
    if not isinstance(conditions, list):
        return [*errors, "conditions must be a list"]
    for j, cond in enumerate(conditions, 1):
        errors.extend(f"condition {j}: {e}" for e in _condition_errors(cond, columns))
    return errors


def _condition_errors(cond: Any, columns: Sequence[str] | None) -> list[str]:
    if not isinstance(cond, dict):
        return ["must be an object"]
    errors = [f"missing {k}" for k in ("column", "operator") if k not in cond]
    op, kind = cond.get("operator"), cond.get("value_type", "literal")
    if op is not None and op not in COMPARISONS and op not in RANGES:
        errors.append(f"unknown operator {op!r}")
    if kind != "literal" and kind not in STATISTICS:
        errors.append(f"unknown value_type {kind!r}")
    if kind == "literal" and "value" not in cond:
        errors.append("a literal condition needs a value")
    if op in RANGES and (kind != "literal" or not isinstance(cond.get("value"), (list, tuple)) or len(cond["value"]) != 2):
        errors.append(f"{op} needs a literal [low, high]")
    for key in ("column", "value_column"):
        if columns is not None and key in cond and cond[key] not in columns:
            errors.append(f"unknown column {cond[key]!r}")
    return errors
