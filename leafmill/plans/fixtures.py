"""Derived tables: documents, pages, spans, glyphs and cells made of the driver's tables.

The texts below are plain SQL that both engines read alike (integer arithmetic only), so a check compares
the operator and not its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.session import dealt

BASE = {
    "lineitem", "orders", "customer", "supplier", "part", "nation", "region",
    "events", "documents", "pages", "labels", "embeddings", "benchmark", "conversations",
}

# name -> (tables read, SQL)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    # one row per lineitem; page = order, document = four orders
    "numbered": (
        ("lineitem",),
        """select cast(floor(l_orderkey / 4) as bigint) as doc_id,
                  l_orderkey % 4 as page_idx,
                  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as block_idx,
                  l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber
           from lineitem""",
    ),
    "blocks": (
        ("numbered",),
        """select doc_id, page_idx, cast(block_idx as bigint) as block_idx,
                  case l_partkey % 12
                    when 0 then 'text' when 1 then 'caption' when 2 then 'image' when 3 then 'table'
                    when 4 then 'chart' when 5 then 'title' when 6 then 'text' when 7 then 'caption'
                    when 8 then 'header' when 9 then 'footnote' when 10 then 'equation' else 'table' end as type,
                  case when l_suppkey % 11 = 0 then ''
                       when l_suppkey % 5 = 0 then 'Table ' || cast(l_linenumber as string)
                       when l_suppkey % 5 = 1 then ' fig. ' || cast(l_partkey as string)
                       when l_suppkey % 5 = 2 then cast(l_linenumber as string) || '.' || cast(l_suppkey % 3 as string) || ' part'
                       else 'word' || cast(l_partkey as string) end as content,
                  l_partkey % 400 as x0,
                  block_idx * 40 + l_suppkey % 30 as y0,
                  l_partkey % 400 + 50 + l_suppkey % 150 as x1,
                  block_idx * 40 + l_suppkey % 30 + 10 + l_partkey % 25 as y1,
                  l_suppkey % 3 + 1 as level,
                  l_partkey % 2 = 0 as numbered,
                  case when l_partkey % 3 = 0 then 'a' || cast(l_partkey % 50 as string) end as anchor
           from numbered""",
    ),
    "spans": (
        ("numbered",),
        """select l_orderkey as page_id, cast(block_idx as bigint) as span_idx,
                  case l_partkey % 10 when 0 then 'image' when 1 then 'interline_equation' when 2 then 'hyperlink'
                       else 'text' end as type,
                  case when l_suppkey % 7 = 0 then 'bold' when l_suppkey % 7 = 1 then 'underline' else '' end as style,
                  'w' || cast(l_partkey % 97 as string) as content,
                  (l_partkey * 7) % 300 as x0,
                  l_suppkey % 60 as y0,
                  (l_partkey * 7) % 300 + 5 + l_partkey % 80 as x1,
                  l_suppkey % 60 + 8 + l_partkey % 9 as y1
           from numbered""",
    ),
    # pages with few spans give short lines; tall ones give columns
    "tall_spans": (
        ("numbered",),
        """select l_orderkey as page_id, cast(block_idx as bigint) as span_idx,
                  case l_partkey % 10 when 0 then 'image' when 1 then 'interline_equation' else 'text' end as type,
                  l_suppkey % 60 as x0,
                  (l_partkey * 7) % 300 as y0,
                  l_suppkey % 60 + 8 + l_partkey % 9 as x1,
                  (l_partkey * 7) % 300 + (case when l_orderkey % 3 = 0 then 10 else 40 end) + l_partkey % 80 as y1
           from numbered""",
    ),
    # parts that follow each other in an order
    "links": (
        ("numbered",),
        """select src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by block_idx) as dst
             from numbered) t where dst is not null""",
    ),
    "cells": (
        ("numbered",),
        """select l_orderkey as table_id, cast(floor(block_idx / 3) as bigint) as row_idx,
                  cast(block_idx % 3 as bigint) as cell_idx,
                  case when l_suppkey % 9 = 0 then '' else 'c' || cast(l_partkey % 40 as string) end as text,
                  1 + (case when l_partkey % 7 = 0 then 1 else 0 end) as rowspan,
                  1 + (case when l_suppkey % 5 = 0 then 1 else 0 end) as colspan
           from numbered""",
    ),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in ordered:
            return
        for dep in DERIVED[name][0]:
            visit(dep)
        ordered.append(name)

    for n in names:
        visit(n)
    return ordered


def with_clause(names: tuple[str, ...], sql: str) -> str:
    """Put the derived tables in front of an oracle query (which may bring CTEs of its own)."""
    ctes = [f"{n} as ({DERIVED[n][1]})" for n in _closure(names)]
    if not ctes:
        return sql
    body = sql.strip()
    head = "with recursive " if body.lower().startswith("with recursive") else "with "
    if body.lower().startswith("with recursive"):
        body = ", " + body[len("with recursive"):].lstrip()
    elif body.lower().startswith("with "):
        body = ", " + body[len("with"):].lstrip()
    return head + ", ".join(ctes) + " " + body


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table on Spark."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    deps, sql = DERIVED[name]
    frames = {d: build(spark, sf_dir, d) for d in deps}
    if name == "numbered":
        frames["lineitem"] = dealt(frames["lineitem"], "l_orderkey")
    text = sql
    for d in deps:
        text = text.replace(f"from {d}", f"from {{{d}}}").replace(f"join {d} ", f"join {{{d}}} ")
    return spark.sql(text, **frames)
