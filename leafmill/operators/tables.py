"""HTML tables as rows of cells: parsing, grid placement, headers, merging over pages, rendering; chart data.

Cells have table_id, row_idx, cell_idx, text, rowspan, colspan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.functions.text import escape_html, full_to_half
from leafmill.operators.ordered import Scan, scan
from leafmill.session import dealt, written

#: Slots of a chart series that one array holds.
STRETCH = 1 << 10
#: Slots that one task of ``densify_points`` aims at.
TASK_SLOTS = 1 << 25


#: Tags (quoted attribute values may hold ``>``), comments, runs of text, and a stray ``<``.
_TOKEN = re.compile(r"""(?s)<!--.*?-->|<[a-zA-Z/!](?:[^>"']|"[^"]*"|'[^']*')*>|[^<]+|<""")
_TAG = re.compile(r"<(/?(?:table|tr|td|th))(?=[\s/>])", re.IGNORECASE | re.ASCII)

#: Cells that one batch of parsed documents holds before it is handed on.
BATCH_CELLS = 10_000


def _nested_cells(html: str) -> list[list]:
    """Cells of a document, each as table_no, depth, parent_no, parent_row, parent_cell, row_idx, cell_idx, its start tag and its pieces."""
    out, tables, depth = [], 0, 0
    # the current table of each level: its number, parent cell, row, cell, whether a row is open, and the pieces of the open cell
    levels: list[dict] = []
    for piece in _TOKEN.findall(html):
        found = _TAG.match(piece)
        tag = found[1].lower().replace("th", "td") if found else ""
        if tag == "table":
            depth += 1
        elif not depth:
            continue
        for above in levels[: depth - 1]:
            if above["pieces"] is not None:
                above["pieces"].append(piece)
        if tag == "table":
            tables += 1
            holder = levels[depth - 2] if depth > 1 else None
            inside = holder is not None and holder["pieces"] is not None
            parent = (holder["no"], holder["row"], holder["cell"]) if inside else (None, None, None)
            levels[depth - 1 :] = [{"no": tables, "parent": parent, "row": -1, "cell": -1, "open": False, "pieces": None}]
            continue
        here = levels[depth - 1]
        if tag == "td" and here["open"]:
            here["cell"] += 1
            here["pieces"] = []
            out.append([here["no"], depth, *here["parent"], here["row"], here["cell"], piece, here["pieces"]])
        elif tag in ("tr", "/tr", "/table"):
            here["open"], here["pieces"] = tag == "tr", None
            if tag == "tr":
                here["row"], here["cell"] = here["row"] + 1, -1
            elif tag == "/table":
                depth -= 1
        elif tag in ("td", "/td"):
            here["pieces"] = None
        elif here["pieces"] is not None:
            here["pieces"].append(piece)
    return out


def _parsed(batches):
    for batch in batches:
        held: list[list] = []
        for table_id, html in zip(batch.column(0), batch.column(1)):
            held.extend([table_id, *cell[:-1], "".join(cell[-1])] for cell in _nested_cells(html.as_py()))
            if len(held) >= BATCH_CELLS:
                yield _cell_batch(held, batch.schema.field(0).type)
                held = []
        if held:
            yield _cell_batch(held, batch.schema.field(0).type)


def _cell_batch(cells: list[list], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, *[pa.int64()] * 7, pa.string(), pa.string()]
    names = ["table_id", "table_no", "depth", "parent_no", "parent_row", "parent_cell", "row_idx", "cell_idx", "head", "text"]
    return pa.record_batch([pa.array([v.as_py() for v in c] if i == 0 else c, k) for i, (c, k) in enumerate(zip(zip(*cells), kinds))], names)


def parse_nested_cells(tables: DataFrame, html: str = "html") -> DataFrame:
    """Cells of HTML tables of any depth: table_id, table_no, depth, parent_no, parent_row, parent_cell, row_idx, cell_idx, text, rowspan, colspan.

    ``table_no`` counts the tables of a document from 1 in the order they open, ``depth`` is 1 for one in no other; the parent is
    the cell that holds a table (null for depth 1). ``text`` is all markup of the cell, inner tables included, and their
    cells are rows of their own. A cell ends at its end tag or at the next cell, row or table end of its own table; cells outside a row are
    left out. A document without a ``<table>`` is one table, one without a table_id is left out.

    Each document is read once from left to right with the open tables on a stack, and a piece counts once on each level it lies in. Nothing
    is shuffled, sorted or held but the cells of one document and one batch.
    """
    rooted = F.when(F.col(html).rlike(r"(?i)<table\b"), F.col(html)).otherwise(F.concat(F.lit("<table>"), F.col(html), F.lit("</table>")))
    documents = tables.select("table_id", rooted.alias("html")).where("table_id is not null and html is not null")
    key = tables.schema["table_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in ("table_no", "depth", "parent_no", "parent_row", "parent_cell", "row_idx", "cell_idx"))
    cells = documents.mapInArrow(_parsed, f"table_id {key}, {numbers}, head string, text string")

    def span(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?is)\s{name}\s*=\s*[\"']?\s*(\d+)", 1)
        return F.when(found.isin("", "0"), 1).otherwise(found.cast("int"))

    return cells.withColumns({"rowspan": span("rowspan"), "colspan": span("colspan")}).drop("head")


def parse_cells(tables: DataFrame, html: str = "html") -> DataFrame:
    """Cells of the first outermost table of each document; the texts of cells hold the markup of tables inside them."""
    return parse_nested_cells(tables, html).where("table_no = 1").select("table_id", "row_idx", "cell_idx", "text", "rowspan", "colspan")


def row_bands(cells: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """One row per table row with its cells (array in order) and ``band``: the first row of the stretch of rows
    tied together by row spans. Placement in one band never looks at another. Spans ``carried`` in tie the first rows."""
    rows = cells.groupBy("table_id", "row_idx").agg(
        F.sort_array(F.collect_list(F.struct("cell_idx", "rowspan", "colspan"))).alias("cells"),
        F.max(F.col("row_idx") + F.col("rowspan")).alias("reach"),
    )
    if carried is not None:
        into = carried.groupBy("table_id").agg((F.max("row_offset") + 1).alias("__into"))
        rows = rows.join(into, "table_id", "left").withColumn("reach", F.greatest("reach", F.when(F.col("row_idx") == 0, F.col("__into")))).drop("__into")
    seen = scan(rows, ["table_id"], ["row_idx"], {"__r": Scan("max", F.col("reach"), inclusive=False)})
    starts = F.col("__r").isNull() | (F.col("__r") <= F.col("row_idx"))
    return scan(
        seen.withColumn("__s", F.when(starts, F.col("row_idx"))), ["table_id"], ["row_idx"], {"band": Scan("last", F.col("__s"))}
    ).drop("__r", "__s")


#: Rows of a band that one fold places; the columns still occupied below them are handed to the next stretch.
BAND_ROWS = 64


def _fold_rows(rows: Column, rem: Column, first: Column) -> Column:
    """Place the cells of consecutive rows under ``rem`` (rows each column is still occupied, counted from row ``first``): struct of ``rem``
    after the last row, ``row`` (the one after it) and ``out``, the placements."""

    def free_from(rem: Column, at: Column) -> Column:
        tried = F.sequence(at, F.greatest(at, F.size(rem).cast("long")))
        return F.array_min(F.filter(tried, lambda c: F.coalesce(F.get(rem, c.cast("int")), F.lit(0)) <= 0))

    def occupy(rem: Column, col: Column, width: Column, rows: Column) -> Column:
        columns = F.sequence(F.lit(0).cast("long"), F.greatest(F.size(rem).cast("long"), col + width) - 1)
        return F.transform(
            columns,
            lambda c: F.when(
                (c >= col) & (c < col + width), F.greatest(F.coalesce(F.get(rem, c.cast("int")), F.lit(0).cast("long")), rows)
            ).otherwise(F.coalesce(F.get(rem, c.cast("int")), F.lit(0).cast("long"))),
        )

    def lowered(rem: Column, rows: Column) -> Column:
        return F.transform(rem, lambda v: F.greatest(v - rows, F.lit(0).cast("long")))

    def add_row(state: Column, row: Column) -> Column:
        rem = lowered(state["rem"], row["row_idx"] - state["row"])
        first = F.struct(rem.alias("rem"), F.lit(0).cast("long").alias("at"), state["out"].alias("out"))

        def add_cell(s: Column, c: Column) -> Column:
            col = free_from(s["rem"], s["at"])
            placed = F.struct(row["row_idx"].cast("long").alias("row_idx"), c["cell_idx"].cast("long").alias("cell_idx"), col.alias("col"))
            return F.struct(
                occupy(s["rem"], col, c["colspan"].cast("long"), c["rowspan"].cast("long")).alias("rem"),
                (col + c["colspan"]).cast("long").alias("at"),
                F.concat(s["out"], F.array(placed)).alias("out"),
            )

        done = F.aggregate(row["cells"], first, add_cell)
        return F.struct(done["rem"].alias("rem"), row["row_idx"].cast("long").alias("row"), done["out"].alias("out"))

    def finish(state: Column) -> Column:
        left = lowered(state["rem"], F.lit(1).cast("long"))
        # trailing free columns say nothing
        used = F.coalesce(F.array_max(F.transform(left, lambda v, i: F.when(v > 0, i + 1))), F.lit(0))
        return F.struct(F.slice(left, F.lit(1), used).alias("rem"), (state["row"] + 1).alias("row"), state["out"].alias("out"))

    placements = F.from_json(F.lit("[]"), "array<struct<row_idx:long,cell_idx:long,col:long>>")
    return F.aggregate(rows, F.struct(rem.alias("rem"), first.cast("long").alias("row"), placements.alias("out")), add_row, finish)


#: Rows of a table that are read together; spans that reach further go into every slice they cover.
SLICE_ROWS = 4096


def _values(column: pa.Array) -> list:
    """Values of a column; whole numbers without nulls go through numpy, which is faster."""
    plain = column.null_count == 0 and pa.types.is_integer(column.type)
    return column.to_numpy().tolist() if plain else column.to_pylist()


def _with_columns(names: list[str]):
    """Cells in the order of table, row and cell with their first column; only the open cell and the columns occupied below are held."""

    def place(batches):
        held, held_cols = None, []
        reach, row, at = [], None, 0  # the row from which each column is free again
        for batch in batches:
            cols = []
            for nth, r, rowspan, colspan in zip(*(_values(batch.column(c)) for c in ("__nth", "row_idx", "rowspan", "colspan"))):
                rowspan, colspan = 1 if rowspan is None else rowspan, 1 if colspan is None else colspan
                if nth == 1:
                    reach, row = [], None
                if r != row:
                    row, at = r, 0
                while at < len(reach) and reach[at] > r:
                    at += 1
                cols.append(at)
                end = at + colspan
                if end > len(reach):
                    reach.extend([r] * (end - len(reach)))
                if rowspan > 0:
                    for c in range(at, end):
                        if reach[c] < r + rowspan:
                            reach[c] = r + rowspan
                at = end
            if not cols:
                continue
            # the last cell may go on in the next batch, where a cell repeats
            batch, cols = batch if held is None else pa.concat_batches([held, batch]), held_cols + cols
            groups = repeats(batch)
            last = groups[-1] if groups else batch.num_rows - 1
            yield from emit(batch.slice(0, last), groups[:-1] if groups else None, cols[:last])
            held, held_cols = batch.slice(last), cols[last:]
        if held is not None:
            yield from emit(held, repeats(held), held_cols)

    def repeats(batch) -> list[int] | None:
        """Where the cells of a batch begin, if one repeats or has no number."""
        rows, cells, nth = (_values(batch.column(c)) for c in ("row_idx", "cell_idx", "__nth"))
        new = [True, *(n == 1 or c != d or r != q for n, c, d, r, q in zip(nth[1:], cells[1:], cells, rows[1:], rows))]
        if all(new) and batch.column("cell_idx").null_count == 0:
            return None
        return [i for i, n in enumerate(new) if n]

    def emit(batch, groups, cols):
        kept = batch.select(names)
        if groups is not None:
            # a cell that repeats gets every column of its copies, one without a number is left out
            cells, ends = batch.column("cell_idx").to_pylist(), [*groups[1:], len(cols)]
            pairs = [(i, cols[j]) for g, e in zip(groups, ends) if cells[g] is not None for i in range(g, e) for j in range(g, e)]
            kept, cols = kept.take(pa.array([i for i, _ in pairs], pa.int64())), [c for _, c in pairs]
        if kept.num_rows:
            yield kept.append_column("col", pa.array(cols, pa.int64()))

    return place


def place_cells(cells: DataFrame, carried: DataFrame | None = None, band_rows: int = BAND_ROWS) -> DataFrame:
    """Add ``col`` (first visual column) to every cell: cells fill the columns row spans from above leave free. The result is a written table.

    ``carried`` (table_id, row_offset, col) are columns that spans of a table before still occupy in the first rows, as
    ``carried_columns`` gives them; rows then count from 0.

    Tables of up to ``SLICE_ROWS`` rows are read once in order. Longer ones, and tables under ``carried`` spans, are placed by bands of
    tied rows. A null span counts as 1, cells without a table, row or number are left out.
    """
    if carried is not None:
        return _placed_by_bands(cells, carried, band_rows)
    keys = ["table_id", "row_idx", "cell_idx"]
    names = [*keys, *[c for c in cells.columns if c not in keys]]
    slices = cells.where("table_id is not null and row_idx is not null").withColumn("__slice", F.floor(F.col("row_idx") / F.lit(SLICE_ROWS)))
    w = Window.partitionBy("table_id", "__slice").orderBy("row_idx", "cell_idx", "rowspan", "colspan")
    ordered = slices.withColumn("__nth", F.row_number().over(w)).drop("__slice")
    found = StructType([*[cells.schema[c] for c in names], StructField("col", LongType())])
    placed = written(ordered.mapInArrow(_with_columns(names), found))
    long = placed.where((F.col("row_idx") >= SLICE_ROWS) | (F.col("row_idx") < 0)).select("table_id").distinct()
    if long.isEmpty():
        return placed
    long = written(long)
    again = _placed_by_bands(cells.join(long, "table_id", "left_semi"), None, band_rows).select(placed.columns)
    return written(placed.join(long, "table_id", "left_anti").unionByName(again))


def _placed_by_bands(cells: DataFrame, carried: DataFrame | None, band_rows: int) -> DataFrame:
    """Placement of tables of any length.

    A band of tied rows is cut into stretches of ``band_rows``. A stretch needs only the columns that the one before it leaves
    occupied: all stretches are placed at once under the state known so far, and those whose state turns out
    to be another are placed again until none is. Spans seldom reach over a whole stretch, so that is a round or two.
    """
    rows = row_bands(cells, carried)
    nth = F.row_number().over(Window.partitionBy("table_id", "band").orderBy("row_idx")) - 1
    stretches = rows.withColumn("part", F.floor(nth / F.lit(band_rows)))
    bands = stretches.groupBy("table_id", "band", "part").agg(F.sort_array(F.collect_list(F.struct("row_idx", "cells"))).alias("rows"))
    nothing = F.array().cast("array<long>")
    if carried is None:
        bands = bands.withColumn("rem", nothing).withColumn("first", F.col("rows")[0]["row_idx"])
    else:
        held = carried.groupBy("table_id", F.col("col").cast("long").alias("col")).agg((F.max("row_offset") + 1).cast("long").alias("n"))
        vector = held.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "n"))).alias("__m"), F.max("col").alias("__c"))
        rem = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__c")), lambda c: F.coalesce(F.element_at("__m", c), F.lit(0).cast("long")))
        head = (F.col("part") == 0) & (F.col("band") == 0) & F.col("__m").isNotNull()
        bands = bands.join(vector, "table_id", "left").withColumn("rem", F.when(head, rem).otherwise(nothing))
        bands = bands.withColumn("first", F.when(head, F.lit(0)).otherwise(F.col("rows")[0]["row_idx"])).drop("__m", "__c")
    # a single row without spans from above needs no fold: columns are running sums
    single = (F.size("rows") == 1) & (F.size("rem") == 0) & (F.col("part") == 0)
    plain = F.transform(
        F.col("rows")[0]["cells"],
        lambda c, i: F.struct(
            F.col("rows")[0]["row_idx"].cast("long").alias("row_idx"), c["cell_idx"].cast("long").alias("cell_idx"),
            F.aggregate(F.slice(F.col("rows")[0]["cells"], F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["colspan"]).alias("col"),
        ),
    )
    fold = _fold_rows(F.col("rows"), F.col("rem"), F.col("first"))
    alone = F.struct(nothing.alias("rem"), (F.col("first") + 1).cast("long").alias("row"), plain.alias("out"))
    parts = F.max("part").over(Window.partitionBy("table_id", "band")) + 1
    tried = written(bands.withColumn("parts", parts).withColumn("done", F.when(single & (F.col("parts") == 1), alone).otherwise(fold)))
    placed = tried.where("parts = 1").select("table_id", F.explode("done.out").alias("p")).select("table_id", "p.*")
    long = tried.where("parts > 1").drop("parts")
    while not long.isEmpty():
        above = F.lag(F.struct(F.col("done.rem").alias("rem"), F.col("done.row").alias("row"))).over(Window.partitionBy("table_id", "band").orderBy("part"))
        told = long.withColumn("above", above).withColumn("__new", F.col("above").isNotNull() & ~F.col("above").eqNullSafe(F.struct(F.col("rem"), F.col("first").cast("long").alias("row"))))
        told = told.withColumn("rem", F.when(F.col("__new"), F.col("above.rem")).otherwise(F.col("rem"))).withColumn("first", F.when(F.col("__new"), F.col("above.row")).otherwise(F.col("first")))
        again = F.when(F.col("__new"), _fold_rows(F.col("rows"), F.col("rem"), F.col("first"))).otherwise(F.col("done"))
        after = written(told.drop("above").withColumn("done", again))
        if after.where("__new").isEmpty():
            placed = placed.unionByName(after.select("table_id", F.explode("done.out").alias("p")).select("table_id", "p.*"))
            break
        long = after.drop("__new")
    return cells.join(placed, ["table_id", "row_idx", "cell_idx"])


def expand_grid(placed: DataFrame) -> DataFrame:
    """One row per covered grid square: table_id, row, col and the source cell (row_idx, cell_idx, text)."""
    return placed.select(
        "table_id", "row_idx", "cell_idx", "text", "rowspan", "colspan",
        F.explode(F.sequence(F.col("row_idx"), F.col("row_idx") + F.col("rowspan") - 1)).alias("row"),
        F.col("col").alias("__from"),
    ).select(
        "table_id", "row_idx", "cell_idx", "text", "row",
        F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("colspan") - 1)).alias("col"),
    )


def row_metrics(placed: DataFrame) -> DataFrame:
    """Per row: effective columns (row spans from above included), actual (sum of column spans) and visual
    (number of cells)."""
    own = placed.groupBy("table_id", "row_idx").agg(
        F.sum("colspan").cast("long").alias("actual_cols"), F.count("*").alias("visual_cols")
    )
    covered = placed.select(
        "table_id", F.explode(F.sequence(F.col("row_idx"), F.col("row_idx") + F.col("rowspan") - 1)).alias("row_idx"),
        (F.col("col") + F.col("colspan")).alias("end"),
    ).groupBy("table_id", "row_idx").agg(F.max("end").alias("effective_cols"))
    return own.join(covered, ["table_id", "row_idx"])


def table_metrics(placed: DataFrame) -> DataFrame:
    """Per table: total columns, rows, last non-empty row, and how far row spans reach past the end."""
    return placed.groupBy("table_id").agg(
        F.max(F.col("col") + F.col("colspan")).alias("total_cols"),
        (F.max("row_idx") + 1).alias("rows"),
        F.max("row_idx").alias("last_row"),
        F.max(F.col("row_idx") + F.col("rowspan") - 1).alias("reach"),
    ).withColumn("tail_rows", F.col("reach") - F.col("last_row")).drop("reach")


def carried_columns(placed: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Columns (table_id, row_offset, col) that row spans still occupy below the last row: those of the table itself, and
    those of ``carried`` in spans that reach past it."""
    last = placed.groupBy("table_id").agg(F.max("row_idx").alias("__last"))
    # only a span reaches past a row
    squares = expand_grid(placed.where("rowspan > 1")).select("table_id", "row", "col")
    if carried is not None:
        squares = squares.unionByName(carried.select("table_id", F.col("row_offset").alias("row"), "col"))
    return (
        squares.join(last, "table_id").where(F.col("row") > F.col("__last"))
        .select("table_id", (F.col("row") - F.col("__last") - 1).alias("row_offset"), "col").distinct()
    )


def rendered_segments(placed: DataFrame) -> DataFrame:
    """Per row the runs of columns shown by one source cell: (start_col, end_col, text)."""
    # where spans collide the cell placed last wins
    shown = expand_grid(placed).groupBy("table_id", "row", "col").agg(
        F.max(F.struct("row_idx", "cell_idx", "text")).alias("s")
    )
    source = F.struct("s.row_idx", "s.cell_idx")
    w = Window.partitionBy("table_id", "row").orderBy("col")
    starts = F.coalesce((F.lag(source).over(w) != source) | (F.lag("col").over(w) != F.col("col") - 1), F.lit(True))
    numbered = shown.withColumn("__start", starts).withColumn("segment", F.sum(F.when(F.col("__start"), 1).otherwise(0)).over(w))
    return numbered.groupBy("table_id", "row", "segment").agg(
        F.min("col").alias("start_col"), (F.max("col") + 1).alias("end_col"), F.first("s.text").alias("text")
    )


def segment_counts(placed: DataFrame) -> DataFrame:
    return rendered_segments(placed).groupBy("table_id", F.col("row").alias("row_idx")).agg(F.count("*").alias("segments"))


def normalized_text(text: Column) -> Column:
    """Text of a cell without markup and white space, full-width forms as ASCII."""
    return F.regexp_replace(full_to_half(F.regexp_replace(text, r"(?s)<[^>]*>", "")), r"\s+", "")


def says_nothing(text: Column) -> Column:
    """A cell without visible text, picture, formula, inner table or embedded object."""
    shown = r"(?i)<(img|svg|math|eq|table|figure|object|embed|canvas)\b"
    return (F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<[^>]*>|\s", "")) == "") & ~F.coalesce(text, F.lit("")).rlike(shown)


_FACTS = "row_idx long, actual_cols long, visual_cols long, effective_cols long, segments long, starts boolean, colspans array<int>, rowspans array<int>, texts array<string>"


def _shown_runs(cells: list[tuple]) -> int:
    """Runs of columns shown by one cell (col, end, source); where cells collide the last one wins."""
    shown = {}
    for col, end, source in cells:
        for c in range(col, end):
            shown[c] = source
    runs, before = 0, None
    for c in sorted(shown):
        runs += before is None or c != before + 1 or shown[c] != shown[before]
        before = c
    return runs


def _measured_row(row: int, own: list[tuple], above: list[tuple]) -> tuple:
    """Facts of a row with its own cells (cell_idx, rowspan, colspan, col, text) under the cells (reach, col, end, source) that span into it."""
    if len(own) == 1 and not above and own[0][2] > 0:
        cell, rowspan, colspan, col, text = own[0]
        return row, colspan, 1, col + colspan, 1, True, (colspan,), (rowspan,), (text,)
    if len({o[0] for o in own}) < len(own):
        own = sorted(own, key=lambda o: (o[0] is not None, o[0] or 0, o[2], o[1], o[4] is not None, o[4] or ""))
    end = max(o[3] + o[2] for o in own)
    runs, at = len(own), None
    for o in own:
        if at is not None and o[3] < at or o[2] < 1:
            runs = None
            break
        at = o[3] + o[2]
    if above:
        end = max(end, max(a[2] for a in above))
    if above or runs is None:
        runs = _shown_runs([a[1:] for a in above] + [(o[3], o[3] + o[2], (row, o[0])) for o in own])
    return row, sum(o[2] for o in own), len(own), end, runs, not above, [o[2] for o in own], [o[1] for o in own], [o[4] for o in own]


def _row_facts(batches):
    """One row per table row of cells in the order of table, slice, row and cell; only the cells of one row and those spanning into it are held."""
    names = [f.split()[0] for f in _FACTS.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    table = row = None
    own, active = [], []

    def close(out: list, ids: list) -> None:
        nonlocal active
        active = [a for a in active if a[0] > row] if active else active
        ids.append(table)
        out.append(_measured_row(row, own, active))
        active.extend((row + o[1], o[3], o[3] + o[2], (row, o[0])) for o in own if o[1] > 1)
        own.clear()

    def pack(ids: list, out: list, key: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out))
        ends = pa.array(np.r_[0, np.cumsum(columns[2])], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(v)), k)) for v, k in zip(columns[6:], kinds[6:])]
        return pa.record_batch([pa.array(ids, key), *[pa.array(v, k) for v, k in zip(columns[:6], kinds)], *lists], ["table_id", *names])

    key = None
    for batch in batches:
        ids, out, key = [], [], batch.schema.field(0).type
        for t, nth, above, r, cell, rowspan, colspan, col, text in zip(*map(_values, batch.columns)):
            if own and (nth == 1 or r != row):
                close(out, ids)
            if nth == 1:
                table, active = t, []
            if above:
                active.append((r + rowspan, col, col + colspan, (r, cell)))
            else:
                row = r
                own.append((cell, rowspan, colspan, col, text))
        if out:
            yield pack(ids, out, key)
    if own:
        ids, out = [], []
        close(out, ids)
        yield pack(ids, out, key)


def row_facts(placed: DataFrame, texts_to: int | None = None) -> DataFrame:
    """Per row what decides on merges, as ``row_metrics`` and ``segment_counts`` give it for rows with cells: ``actual_cols, visual_cols, effective_cols,
    segments``, whether the row ``starts`` a band (no span from above reaches it), and in order of the cells ``colspans``, ``rowspans``
    and normalised ``texts``, with ``texts_to`` only for rows up to that one.

    Tables are cut into slices of ``SLICE_ROWS`` rows, each read once in order.
    """
    text = normalized_text(F.col("text"))
    if texts_to is not None:
        text = F.when(F.col("row_idx") <= texts_to, text)
    step = F.lit(SLICE_ROWS)
    slices = F.sequence(F.floor(F.col("row_idx") / step), F.floor((F.col("row_idx") + F.greatest("rowspan", F.lit(1)) - 1) / step))
    row = F.col("row_idx").cast("long")
    cells = placed.where("table_id is not null and row_idx is not null").select(
        "table_id", F.explode(slices).alias("__slice"), row.alias("row_idx"), F.col("cell_idx").cast("long").alias("cell_idx"),
        F.col("rowspan").cast("int").alias("rowspan"), F.col("colspan").cast("int").alias("colspan"), F.col("col").cast("long").alias("col"), text.alias("text"),
    )
    w = Window.partitionBy("table_id", "__slice").orderBy("row_idx", "cell_idx", "col")
    ordered = dealt(cells, "table_id", "__slice").withColumn("__nth", F.row_number().over(w)).select(
        "table_id", "__nth", (F.col("row_idx") < F.col("__slice") * step).alias("__above"), "row_idx", "cell_idx", "rowspan", "colspan", "col", "text"
    )
    key, kind = (placed.schema[c].dataType.simpleString() for c in ("table_id", "row_idx"))
    facts = ordered.mapInArrow(_row_facts, f"table_id {key}, {_FACTS}")
    return facts.withColumn("row_idx", F.col("row_idx").cast(kind))


def common_header_rows(
    pairs: DataFrame, placed: DataFrame, most: int | None = None, own_rows: DataFrame | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """Pairs (prev_id, table_id) with ``header_rows``: leading rows (all, or at most ``most``) equal in structure and text,
    else equal in text and shown segments; stretched over the second table's row spans. ``own_rows`` (table_id, own_rows) keeps rows
    that an earlier merge has added out of the comparison. ``facts`` are those of the rows, where they are known already."""
    facts = written(row_facts(placed, most)) if facts is None else facts
    mine = facts if most is None else facts.where(F.col("row_idx") < most)
    if own_rows is not None:
        mine = mine.join(own_rows, "table_id").where("row_idx < own_rows").drop("own_rows")
    mine = mine.select("table_id", "row_idx", "effective_cols", "segments", "colspans", "rowspans", "texts")
    other = mine.select(F.col("table_id").alias("prev_id"), "row_idx", *[F.col(c).alias(f"p_{c}") for c in mine.columns if c not in ("table_id", "row_idx")])
    aligned = pairs.join(mine, "table_id").join(other, ["prev_id", "row_idx"])
    texts = F.col("texts") == F.col("p_texts")
    structure = (
        texts & (F.col("colspans") == F.col("p_colspans")) & (F.col("rowspans") == F.col("p_rowspans"))
        & (F.col("effective_cols") == F.col("p_effective_cols"))
    )
    looks = texts & (F.col("segments") == F.col("p_segments"))

    def prefix(match: Column) -> Column:
        # rows are 0, 1, …: the prefix ends at the first mismatch or at the number of shared rows
        return F.coalesce(F.min(F.when(~match, F.col("row_idx"))), F.max("row_idx") + 1)

    counted = aligned.groupBy("prev_id", "table_id").agg(prefix(structure).alias("a"), prefix(looks).alias("b"))
    header = counted.select("prev_id", "table_id", F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b")).alias("h"))
    # a header count inside a band of row spans moves to the band's end, or to that of the table
    ends = header.join(facts.select("table_id", "row_idx", "starts"), "table_id")
    first_free = ends.groupBy("prev_id", "table_id", "h").agg(
        F.min(F.when(F.col("starts") & (F.col("row_idx") >= F.col("h")), F.col("row_idx"))).alias("e"), (F.max("row_idx") + 1).alias("n")
    )
    return first_free.select("prev_id", "table_id", F.when(F.col("h") == 0, 0).otherwise(F.coalesce("e", "n")).cast("long").alias("header_rows"))


def adjacent_tables(blocks: DataFrame) -> DataFrame:
    """Pairs of tables: the last block of a page and the first of the next, both tables.

    blocks: doc_id, page_idx, block_idx, type, table_id and a box.
    """
    ends = blocks.groupBy("doc_id", "page_idx").agg(
        F.min_by(F.struct("type", "table_id", "x0", "x1"), "block_idx").alias("f"),
        F.max_by(F.struct("type", "table_id", "x0", "x1"), "block_idx").alias("l"),
    )
    previous = ends.where("l.type = 'table'").select("doc_id", (F.col("page_idx") + 1).alias("page_idx"), F.col("l").alias("p"))
    return ends.where("f.type = 'table'").join(previous, ["doc_id", "page_idx"]).select(
        "doc_id", "page_idx", F.col("f.table_id").alias("table_id"), F.col("p.table_id").alias("prev_id"),
        (F.col("f.x1") - F.col("f.x0")).alias("width"), (F.col("p.x1") - F.col("p.x0")).alias("prev_width"),
    )


def mergeable_pairs(pairs: DataFrame, placed: DataFrame, notes: DataFrame, most: int | None = None, own_rows: DataFrame | None = None) -> DataFrame:
    """Adjacent pairs that form one table, with ``header_rows``.

    notes (table_id, captions, continued, footnotes) counts a table's captions above its body, those that say
    "continued", and its footnotes. A new caption must say so (then at most one footnote before), else no
    footnote may precede; widths differ by less than a tenth of the narrower; columns or boundary rows match.
    Pairs are judged on the tables as given. At most ``most`` rows count as header; a boundary row must be among
    the second table's ``own_rows`` (table_id, own_rows) and the first ``most`` + 1, where these are given.
    """
    mine = notes.select("table_id", "captions", "continued")
    before = notes.select(F.col("table_id").alias("prev_id"), F.col("footnotes").alias("prev_footnotes"))
    told = pairs.join(mine, "table_id", "left").join(before, "prev_id", "left").fillna(0, ["captions", "continued", "prev_footnotes"])
    words = F.when(F.col("captions") > 0, (F.col("continued") > 0) & (F.col("prev_footnotes") <= 1)).otherwise(F.col("prev_footnotes") == 0)
    narrow = F.least("width", "prev_width")
    close = (narrow > 0) & (F.abs(F.col("width") - F.col("prev_width")) < narrow * 0.1)
    kept = told.where(words & close)
    facts = written(row_facts(placed, most))
    # every cell counts in its own row: the widest row is as wide as the table
    total = facts.groupBy("table_id").agg(F.max("effective_cols").alias("total_cols"), F.max("row_idx").alias("last_row"))
    prev_total = total.toDF("prev_id", "prev_cols", "prev_last")
    sized = (
        kept.join(total.drop("last_row"), "table_id").join(prev_total, "prev_id")
        .join(common_header_rows(kept.select("prev_id", "table_id"), placed, most, own_rows, facts), ["prev_id", "table_id"], "left")
        .fillna(0, ["header_rows"])
    )
    rows = facts.select("table_id", "row_idx", "effective_cols", "actual_cols", "segments")
    columns = ["effective_cols", "actual_cols", "segments"]
    last = rows.select(F.col("table_id").alias("prev_id"), F.col("row_idx").alias("prev_last"), *[F.col(c).alias(f"l_{c}") for c in columns])
    first = rows if most is None else rows.where(F.col("row_idx") <= most)
    first = first if own_rows is None else first.join(own_rows, "table_id").where("row_idx < own_rows")
    first = first.select("table_id", F.col("row_idx").alias("header_rows"), *[F.col(c).alias(f"f_{c}") for c in columns])
    compared = sized.join(last, ["prev_id", "prev_last"], "left").join(first, ["table_id", "header_rows"], "left")
    boundary = F.lit(False)
    for c in columns:
        boundary = boundary | F.coalesce(F.col(f"l_{c}") == F.col(f"f_{c}"), F.lit(False))
    return compared.where((F.col("total_cols") == F.col("prev_cols")) | boundary).select(
        *pairs.columns, "header_rows", "total_cols", "prev_cols"
    )


def merge_chains(merges: DataFrame, tables: DataFrame) -> DataFrame:
    """Every table with ``root_id``: the first table of its chain, and ``chain_pos``.

    Links point to the previous page's table. Each round follows the link of the link, so a chain of n pages
    takes log n rounds.
    """
    links = tables.select("table_id").join(merges.select("table_id", "prev_id"), "table_id", "left").select(
        "table_id", F.coalesce("prev_id", "table_id").alias("root_id"), F.when(F.col("prev_id").isNull(), 0).otherwise(1).alias("chain_pos")
    )
    links = written(links)
    while True:
        up = links.toDF("root_id", "__next", "__n")
        after = written(
            links.join(up, "root_id").select(
                "table_id", F.col("__next").alias("root_id"), (F.col("chain_pos") + F.col("__n")).alias("chain_pos"),
                (F.col("__next") != F.col("root_id")).alias("__moved"),
            )
        )
        links = after.drop("__moved")
        if after.where("__moved").isEmpty():
            return links


def merge_tables(cells: DataFrame, merges: DataFrame, chains: DataFrame) -> DataFrame:
    """Cells of the merged tables: table_id is the chain's first table, rows follow each other, and repeated
    header rows of later parts are left out."""
    headers = merges.select("table_id", "header_rows")
    parts = cells.join(chains, "table_id").join(headers, "table_id", "left")
    kept = parts.where(F.col("header_rows").isNull() | (F.col("row_idx") >= F.col("header_rows")))
    sizes = kept.groupBy("root_id", "chain_pos").agg((F.max("row_idx") + 1 - F.coalesce(F.max("header_rows"), F.lit(0))).alias("n"))
    w = Window.partitionBy("root_id").orderBy("chain_pos").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("root_id", "chain_pos", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__at"))
    return kept.join(offsets, ["root_id", "chain_pos"]).select(
        F.col("root_id").alias("table_id"),
        (F.col("row_idx") - F.coalesce("header_rows", F.lit(0)) + F.col("__at")).alias("row_idx"),
        "cell_idx", "text", "rowspan", "colspan", F.col("table_id").alias("source_id"),
    )


def merged_notes(notes: DataFrame, chains: DataFrame) -> DataFrame:
    """Footnotes and captions (table_id, note_idx, kind, text, below) after merging.

    A merged table ends with the footnotes of its last part; captions of later parts that say nothing of a
    continuation and stand below their body come back as text blocks of their own page.
    """
    from leafmill.functions.text import is_table_continuation

    last = Window.partitionBy("root_id")
    placed = notes.join(chains.withColumn("__last", F.max("chain_pos").over(last)), "table_id")
    stray = (F.col("kind") == "caption") & (F.col("chain_pos") > 0) & F.col("below") & ~is_table_continuation(F.col("text"))
    keep = (
        ((F.col("kind") == "footnote") & (F.col("chain_pos") == F.col("__last")))
        | ((F.col("kind") == "caption") & (F.col("chain_pos") == 0)) | stray
    )
    return placed.where(keep).select(
        F.when(stray, F.col("table_id")).otherwise(F.col("root_id")).alias("table_id"), "note_idx",
        F.when(stray, "text").otherwise(F.col("kind")).alias("kind"), "text",
    )


def pad_columns(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows narrower than ``target_cols`` widened.

    targets: table_id, target_cols, first_row (rows before it stay), ref_spans (column spans of the reference
    row) and own_spans (column spans of the row that must look like it). A row shaped like the reference takes
    its column spans; any other has its last cell widened by the missing columns.
    """
    placed = place_cells(cells)
    rows = row_facts(placed, -1).select("table_id", "row_idx", F.col("colspans").alias("spans"), F.col("visual_cols").alias("__n"), "effective_cols", "actual_cols")
    told = placed.join(rows, ["table_id", "row_idx"]).join(targets, "table_id", "left")
    narrow = (
        (F.col("row_idx") >= F.col("first_row")) & (F.col("effective_cols") < F.col("target_cols"))
        & (F.col("actual_cols") < F.col("target_cols"))
    )
    like = (F.col("__n") == F.size("ref_spans")) & (F.col("spans") == F.col("own_spans"))
    reference = F.get("ref_spans", F.col("cell_idx").cast("int"))
    last = F.col("cell_idx") == F.col("__n") - 1
    span = (
        F.when(narrow & like & (reference > 1), reference)
        .when(narrow & ~like & last, F.col("colspan") + F.col("target_cols") - F.col("effective_cols"))
        .otherwise(F.col("colspan"))
    )
    return told.withColumn("colspan", span.cast("int")).select(*cells.columns)


def continue_cells(merged: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Text of a part's first row appended to the row above in flagged visual columns.

    merged: cells of merged tables; boundaries: table_id, row_idx (first row of a later part), flags (array, 1 =
    continue). A source cell is emptied once moved, and the row goes when nothing visible is left in it;
    blank cells spanning further down move to the next row with one row less.
    """
    placed = place_cells(merged)
    flagged = boundaries.select("table_id", F.col("row_idx").alias("src_row"), F.posexplode("flags").alias("vcol", "flag")).where("flag = 1")
    wide = placed.select(
        "table_id", "row_idx", "cell_idx", "text", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)).alias("vcol")
    )
    src = wide.join(flagged.withColumnRenamed("src_row", "row_idx"), ["table_id", "row_idx", "vcol"]).select(
        "table_id", F.col("row_idx").alias("src_row"), "vcol", F.col("cell_idx").alias("src_cell"), F.col("text").alias("src_text")
    )
    dst = wide.select("table_id", (F.col("row_idx") + 1).alias("src_row"), "vcol", F.col("cell_idx").alias("dst_cell"))
    moves = src.join(dst, ["table_id", "src_row", "vcol"]).groupBy("table_id", "src_row", "src_cell", "src_text").agg(
        F.min(F.struct("vcol", "dst_cell"))["dst_cell"].alias("dst_cell")
    )
    added = moves.groupBy("table_id", (F.col("src_row") - 1).alias("row_idx"), F.col("dst_cell").alias("cell_idx")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("src_cell", "src_text"))), lambda m: m["src_text"]), "").alias("__add")
    )
    emptied = moves.select("table_id", F.col("src_row").alias("row_idx"), F.col("src_cell").alias("cell_idx")).withColumn("__gone", F.lit(True))
    keys = ["table_id", "row_idx", "cell_idx"]
    updated = (
        placed.join(added, keys, "left").join(emptied, keys, "left")
        .withColumn("text", F.concat(F.when(F.col("__gone"), "").otherwise(F.col("text")), F.coalesce("__add", F.lit(""))))
        .drop("__add", "__gone")
    )
    heads = boundaries.select("table_id", "row_idx").withColumn("__head", F.lit(True))
    blank_rows = (
        updated.join(heads, ["table_id", "row_idx"], "left_semi").groupBy("table_id", "row_idx")
        .agg(F.max(~says_nothing(F.col("text"))).alias("__any")).where("not __any").select("table_id", "row_idx").withColumn("__drop", F.lit(True))
    )
    marked = updated.join(blank_rows, ["table_id", "row_idx"], "left")
    # below the last row there is nothing left to align
    ends = placed.groupBy("table_id").agg(F.max("row_idx").alias("__end"))
    carried = marked.where("__drop and rowspan > 1").join(ends, "table_id").where("row_idx < __end").drop("__end").withColumns({"row_idx": F.col("row_idx") + 1, "rowspan": F.col("rowspan") - 1})
    stay = marked.where("__drop is null")
    rows = stay.unionByName(carried)
    cell = Window.partitionBy("table_id", "row_idx").orderBy("col", "cell_idx")
    renumbered = rows.withColumn("cell_idx", F.row_number().over(cell) - 1)
    # close the gaps of dropped rows
    order = Window.partitionBy("table_id").orderBy("row_idx")
    return renumbered.withColumn("row_idx", F.dense_rank().over(order) - 1).select(*[c for c in merged.columns])


def clip_blank_spans(part: DataFrame, carried: DataFrame) -> DataFrame:
    """Blank spanning cells at the head of a later part that a row span of the part before already covers are
    cut: they go where they are covered and start below with the rows left.

    part: placed cells of the part's data rows, rows counted from 0; carried: table_id, row_offset, col.
    """
    blank = (F.col("rowspan") > 1) & says_nothing(F.col("text"))
    keys = ["table_id", "row_idx", "cell_idx"]
    squares = part.where(blank).select(
        *keys, "rowspan", "colspan",
        F.explode(F.sequence(F.col("row_idx"), F.col("row_idx") + F.col("rowspan") - 1)).alias("row_offset"), F.col("col").alias("__from"),
    )
    wide = squares.select("*", F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("colspan") - 1)).alias("col"))
    hits = wide.join(carried.withColumn("__c", F.lit(1)), ["table_id", "row_offset", "col"], "left")
    rows = hits.groupBy(*keys, "row_offset").agg((F.sum(F.coalesce("__c", F.lit(0))) == F.max("colspan")).alias("__full"))
    w = Window.partitionBy(*keys).orderBy("row_offset")
    lead = rows.withColumn("__all", F.min("__full").over(w)).groupBy(*keys).agg(F.count_if("__all").alias("__cut"))
    size = part.groupBy("table_id").agg((F.max("row_idx") + 1).alias("__n"))
    told = part.join(lead, keys, "left").join(size, "table_id")
    cut = F.coalesce("__cut", F.lit(0))
    left = F.col("rowspan") - cut
    cut = F.when((left > 0) & (F.col("row_idx") + cut >= F.col("__n")), 0).otherwise(cut)
    moved = told.withColumn("__cut", cut).where((F.col("__cut") == 0) | (F.col("rowspan") > F.col("__cut")))
    shifted = moved.withColumns({"row_idx": F.col("row_idx") + F.col("__cut"), "rowspan": F.col("rowspan") - F.col("__cut")})
    order = Window.partitionBy("table_id", "row_idx").orderBy("col", "cell_idx")
    return shifted.withColumn("cell_idx", F.row_number().over(order) - 1).select("table_id", "row_idx", "cell_idx", "text", "rowspan", "colspan")


def cells_to_html(cells: DataFrame, escape: bool = True) -> DataFrame:
    """One HTML table per table_id; the first row is the head, spans above 1 are written out."""
    tag = F.when(F.col("row_idx") == 0, "th").otherwise("td")

    def attribute(name: str) -> Column:
        return F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))).otherwise("")

    text = escape_html(F.col("text")) if escape else F.col("text")
    markup = F.concat(F.lit("<"), tag, attribute("rowspan"), attribute("colspan"), F.lit(">"), text, F.lit("</"), tag, F.lit(">"))
    rows = cells.groupBy("table_id", "row_idx").agg(F.sort_array(F.collect_list(F.struct("cell_idx", markup.alias("m")))).alias("c"))
    lines = rows.withColumn("r", F.concat(F.lit("<tr>"), F.array_join("c.m", ""), F.lit("</tr>")))
    return lines.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", "r"))).alias("t")).select(
        "table_id", F.concat(F.lit("<table>"), F.array_join("t.r", ""), F.lit("</table>")).alias("html")
    )


def normalize_colspans(cells: DataFrame) -> DataFrame:
    """Rows wider than their table's most common width give up column spans from the left.

    Tables with any row span are left alone. On equal counts the width met first wins.
    """
    rows = cells.groupBy("table_id", "row_idx").agg(F.sum("colspan").alias("w"), F.max("rowspan").alias("r"))
    widths = rows.groupBy("table_id", "w").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"), F.max("r").alias("r"))
    target = widths.groupBy("table_id").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("w").alias("w")))["w"].alias("__t"), F.max("r").alias("__r")
    ).where("__r <= 1").drop("__r")
    told = cells.join(rows.drop("r"), ["table_id", "row_idx"]).join(target, "table_id", "left")
    excess = F.greatest(F.coalesce(F.col("w") - F.col("__t"), F.lit(0)), F.lit(0))
    spare = F.col("colspan") - 1
    before = Window.partitionBy("table_id", "row_idx").orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, -1)
    given = F.coalesce(F.sum(spare).over(before), F.lit(0))
    cut = F.greatest(F.least(spare, excess - given), F.lit(0))
    return told.withColumn("colspan", (F.col("colspan") - cut).cast("int")).select(*cells.columns)


def table_signatures(cells: DataFrame) -> DataFrame:
    """Rows, cells, pictures and whitespace-free text per table."""
    tagless = F.regexp_replace(F.col("text"), r"<[^>]*>", "")
    return cells.groupBy("table_id").agg(
        F.count_distinct("row_idx").alias("rows"), F.count("*").alias("cells"),
        F.sum(F.regexp_count("text", F.lit("(?i)<img"))).alias("images"),
        F.sort_array(F.collect_list(F.struct("row_idx", "cell_idx", F.regexp_replace(tagless, r"\s+", "").alias("t")))).alias("c"),
    ).select("table_id", "rows", "cells", "images", F.array_join("c.t", "").alias("text"))


def wide_series(points: DataFrame, keys: Sequence[str] = ("chart_id",)) -> DataFrame:
    """Long chart points (chart_id, series_idx, axis, point_idx, value) as one row per point index.

    Charts whose series share one x vector get ``shared_x`` and one ``x`` value; ``ys`` holds every series'
    value in series order ("" where it has none), ``xs`` their own x values otherwise.
    """
    series = points.groupBy(*keys, "series_idx", "point_idx").agg(
        F.max(F.when(F.col("axis") == "x", F.col("value"))).alias("x"), F.max(F.when(F.col("axis") == "y", F.col("value"))).alias("y")
    )
    # equal vectors have equal sizes and, point by point, one distinct value
    size = series.groupBy(*keys).agg(F.count_distinct("series_idx").alias("n"))
    per_point = series.groupBy(*keys, "point_idx").agg(
        F.count("x").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.sort_array(F.collect_list(F.struct("series_idx", F.coalesce("x", F.lit("")).alias("x"), F.coalesce("y", F.lit("")).alias("y")))).alias("s"),
    )
    shared = per_point.join(size, list(keys)).groupBy(*keys).agg(
        F.min((F.col("lo") == F.col("hi")) & (F.col("k") == F.col("n"))).alias("shared_x"), F.first("n").alias("n")
    )
    slots = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)

    def value(field: str):
        by_series = F.map_from_arrays(F.transform("s", lambda v: v["series_idx"].cast("long")), F.transform("s", lambda v: v[field]))
        return F.transform(slots, lambda i: F.coalesce(F.element_at(by_series, i), F.lit("")))

    return per_point.join(shared, list(keys)).select(
        *keys, "point_idx", F.coalesce("shared_x", F.lit(False)).alias("shared_x"),
        F.when(F.col("shared_x"), F.col("lo")).alias("x"), value("x").alias("xs"), value("y").alias("ys"),
    )


def densify_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sparse points (keys, point_idx, value) filled from 0 to the highest index with "", whatever the span.

    Every point makes the slots after the point before it, up to its own. Such gaps are cut into stretches, so no array grows with a
    series, and only points and stretches are shuffled: slots are made where they are used, by about ``TASK_SLOTS`` a task. Under a null key
    all slots are "".
    """
    rest = [c for c in points.columns if c not in (*keys, "point_idx")]
    placed = points.withColumn("point_idx", F.col("point_idx").cast("long")).where("point_idx >= 0")
    before = F.lag("point_idx").over(Window.partitionBy(*keys).orderBy("point_idx"))
    unnamed = F.lit(False)
    for k in keys:
        unnamed = unnamed | F.col(k).isNull()
    gaps = placed.withColumns({"__before": before, "__unnamed": unnamed}).where("not __unnamed or __before is null or __before < point_idx")
    step = F.lit(STRETCH).cast("long")
    low = F.least(F.coalesce(F.col("__before") + 1, F.lit(0)), F.col("point_idx"))
    stretches = gaps.withColumn("__low", low).withColumn("__s", F.explode(F.sequence(F.floor(F.col("__low") / step), F.floor(F.col("point_idx") / step))))
    slots = F.sequence(F.greatest("__low", F.col("__s") * step), F.least(F.col("point_idx"), (F.col("__s") + 1) * step - 1))
    size = gaps.agg(F.sum(F.col("point_idx") - low + 1)).first()[0] or 0
    n = max(-(-size // TASK_SLOTS), points.sparkSession.sparkContext.defaultParallelism)
    # the same stretch of all series of a task, slot by slot: a columnar file repeats itself then, and stays small
    laid = stretches.repartition(n, *keys, "__s").sortWithinPartitions("__s", *keys, "point_idx")
    made = laid.withColumn("__slot", F.explode(slots))
    own = (F.col("__slot") == F.col("point_idx")) & ~F.col("__unnamed")
    held = made.select(*keys, F.col("__slot").alias("point_idx"), *[F.when(own, F.col(c)).alias(c) for c in rest])
    return held.withColumn("value", F.coalesce("value", F.lit("")))


def multilevel_categories(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Category levels (keys, point_idx, level, value) joined outermost first by `` / ``."""
    return levels.where("value <> ''").groupBy(*keys, "point_idx").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("level")).alias("l"), "value"))).alias("v")
    ).select(*keys, "point_idx", F.array_join("v.value", " / ").alias("value"))


def trim_blank_borders(cells: DataFrame) -> DataFrame:
    """Cut blank rows at both ends and blank cells at the right; every row padded to the widest one left.

    Cells: table_id, row_idx, col, text.
    """
    filled = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    extent = filled.groupBy("table_id").agg(F.min("row_idx").alias("r0"), F.max("row_idx").alias("r1"), F.max("col").alias("c1"))
    grid = extent.select("table_id", "r0", F.explode(F.sequence("r0", "r1")).alias("row_idx"), "c1").select(
        "table_id", "row_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c1").cast("long"))).alias("col")
    )
    return grid.join(cells, ["table_id", "row_idx", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def align_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ordered alignment of two lists of table signatures per document (doc_id, ord, rows, cells, images, text).

    Each left table in turn takes the first right table after the last one taken that matches: equal or
    prefix text with equal row or cell count; without text all three counts. Matching pairs are found per
    text prefix; the ordered walk folds each document's left tables over their candidate positions.
    """
    short = 16

    def keyed(df: DataFrame, side: str) -> DataFrame:
        renamed = df.select("doc_id", *[F.col(c).alias(f"{side}_{c}") for c in ("ord", "rows", "cells", "images", "text")])
        text = F.col(f"{side}_text")
        # texts that are prefixes of each other agree on their first min(length, 16) characters
        cuts = F.when(text == "", F.array(F.lit(""))).otherwise(
            F.transform(F.sequence(F.lit(1), F.least(F.length(text), F.lit(short))), lambda n: F.substring(text, F.lit(1), n))
        )
        full = F.substring(text, 1, short)
        return renamed.withColumns({"cuts": cuts, "full": full})

    a, b = keyed(left, "l"), keyed(right, "r")

    def by(df: DataFrame, side: str, key: Column) -> DataFrame:
        return df.select("doc_id", *[f"{side}_{c}" for c in ("ord", "rows", "cells", "images", "text")], key.alias("k"))

    # the shorter text's own cut is among the longer text's cuts
    pairs = by(a, "l", F.col("full")).join(by(b, "r", F.explode("cuts")), ["doc_id", "k"]).unionByName(
        by(a, "l", F.explode("cuts")).join(by(b, "r", F.col("full")), ["doc_id", "k"])
    )
    lt, rt = F.col("l_text"), F.col("r_text")
    same_rows, same_cells = F.col("l_rows") == F.col("r_rows"), F.col("l_cells") == F.col("r_cells")
    with_text = (lt != "") & (rt != "") & (lt.startswith(rt) | rt.startswith(lt)) & (same_rows | same_cells)
    without = (lt == "") & (rt == "") & same_rows & same_cells & (F.col("l_images") == F.col("r_images"))
    found = pairs.where(with_text | without).select("doc_id", "l_ord", "r_ord").distinct()
    options = found.groupBy("doc_id", "l_ord").agg(F.sort_array(F.collect_list("r_ord")).alias("r")).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("l_ord", "r"))).alias("o")
    )
    state = "struct<last:long,out:array<struct<l_ord:long,r_ord:long>>>"

    def step(s: Column, x: Column) -> Column:
        nxt = F.array_min(F.filter(x["r"], lambda v: v > s["last"]))
        taken = F.struct(x["l_ord"].cast("long").alias("l_ord"), nxt.cast("long").alias("r_ord"))
        return F.struct(
            F.coalesce(nxt.cast("long"), s["last"]).alias("last"),
            F.when(nxt.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(taken))).alias("out"),
        )

    walked = options.select("doc_id", F.aggregate("o", F.from_json(F.lit('{"last":-1,"out":[]}'), state), step)["out"].alias("m"))
    return walked.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.l_ord", "m.r_ord")
