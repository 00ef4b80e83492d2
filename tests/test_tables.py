"""Nested tables, placement under spans carried in, and merging over pages, against sequential models."""

import html.parser
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import page_merge as M
from leafmill.operators import tables as T

CELL = "table_id long, row_idx long, cell_idx long, text string, rowspan int, colspan int"


class Reader(html.parser.HTMLParser):
    """Tables one tag after the other, a stack of open tables."""

    def __init__(self, text):
        super().__init__(convert_charrefs=False)
        self.text, self.stack, self.out, self.count = text, [], [], 0
        self.feed(text)
        self.close()

    def at(self):
        line, col = self.getpos()
        return sum(len(x) + 1 for x in self.text.split("\n")[: line - 1]) + col

    def finish(self):
        t = self.stack[-1]
        if t["cell"]:
            t["cell"][-1] = self.text[t["cell"].pop() : self.at()]
            self.out.append(tuple(t["cell"]))
            t["cell"] = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.count += 1
            up = self.stack[-1] if self.stack else None
            inside = up["cell"] if up and up["cell"] else None
            parent = (up["no"], inside[5], inside[6]) if inside else (None, None, None)
            self.stack.append({"no": self.count, "row": -1, "cells": 0, "cell": None, "in_row": False, "parent": parent})
        elif self.stack and tag in ("tr", "td", "th"):
            self.finish()
            t = self.stack[-1]
            if tag == "tr":
                t.update(row=t["row"] + 1, cells=0, in_row=True)
            elif t["in_row"]:
                a = dict(attrs)
                span = lambda n: int(a.get(n) or 1) or 1
                t["cell"] = [t["no"], len(self.stack), *t["parent"], t["row"], t["cells"], span("rowspan"), span("colspan"), None, self.at() + len(self.get_starttag_text())]
                t["cells"] += 1

    def handle_endtag(self, tag):
        if self.stack and tag in ("table", "tr", "td", "th"):
            self.finish()
            if tag == "tr":
                self.stack[-1]["in_row"] = False
            if tag == "table":
                self.stack.pop()


def random_html(rng, depth):
    rows = []
    for _ in range(rng.randint(1, 3)):
        cells = []
        for _ in range(rng.randint(0, 3)):
            tag = rng.choice(["td", "th", "TD"])
            attrs = rng.choice(["", ' rowspan="2"', " colspan='3' title=\"a > b\"", " class=x rowspan=0"])
            text = rng.choice(["", "a", " b <b>c</b>", "1 < 2", "<!-- <td> -->", "é\nx"])
            if depth and rng.random() < 0.5:
                text += random_html(rng, depth - 1) + rng.choice(["", "after"])
            cells.append(f"<{tag}{attrs}>{text}" + rng.choice([f"</{tag}>", f"</{tag}>", ""]))
        rows.append("<tr>" + "".join(cells) + rng.choice(["</tr>", "</tr>", ""]))
    body = "".join(rows)
    return f"<table id='t'>{rng.choice(['', '<tbody>'])}{body}</table>"


def test_nested_cells(spark):
    rng = random.Random(8)
    docs = [random_html(rng, 3) for _ in range(60)]
    docs += [None, "", "no table", "</table><table><tr><td>x</td></tr></table></table><table><tr><td>y", "<tr><td>bare</td><td>two</td></tr>", "<table>" * 6 + "<tr><td>deep"]
    four = "<table><tr><td>1<table><tr><td>2<table><tr><td>3<table><tr><td>4</td></tr></table></td></tr></table></td><td>z</td></tr></table></td><td>end</td></tr></table>"
    docs.append(four)
    got = {}
    for r in T.parse_nested_cells(spark.createDataFrame(list(enumerate(docs)), "table_id long, html string").repartition(4)).collect():
        row = (r["table_no"], r["depth"], r["parent_no"], r["parent_row"], r["parent_cell"], r["row_idx"], r["cell_idx"], r["rowspan"], r["colspan"], r["text"])
        got.setdefault(r["table_id"], []).append(row)
    for i, doc in enumerate(docs[:60]):
        assert sorted(got.get(i, []), key=str) == sorted(Reader(doc).out, key=str), doc
    assert [g for g in got if g in (60, 61, 62)] == [] and [(g[1], g[-1]) for g in got[65]] == [(6, "deep")]
    assert sorted(g[-1] for g in got[63]) == ["x", "y"] and sorted(g[-1] for g in got[64]) == ["bare", "two"]
    by = {(g[1], g[6]): g for g in got[66]}
    assert by[4, 0][-1] == "4" and by[4, 0][2:5] == (3, 0, 0) and by[1, 1][-1] == "end" and by[2, 1][-1] == "z"


def test_nested_cells_are_read_in_place(spark):
    docs = spark.createDataFrame([(1, "<table><tr><td>a<table><tr><th>b</table></td><td rowspan=2>c"), (None, "<table><tr><td>lost")], "table_id long, html string")
    cells = T.parse_nested_cells(docs)
    assert sorted((r["table_no"], r["parent_no"], r["cell_idx"], r["text"], r["rowspan"]) for r in cells.collect()) == [
        (1, None, 0, "a<table><tr><th>b</table>", 1), (1, None, 1, "c", 2), (2, 1, 0, "b", 1)]
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_partitions_of_derived_rows_hold_a_bounded_number(spark, monkeypatch):
    from leafmill import session
    from leafmill.plans import fixtures

    monkeypatch.setattr(session, "TASK_ROWS", 200)
    numbered = fixtures.build(spark, "/root/testdata/sf0.001", "numbered")
    sizes = numbered.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert numbered.count() == 6000 and len(sizes) >= 25 and max(r["count"] for r in sizes) <= 500


def scan(rows, carry=None):
    """Start columns of each row's cells, effective columns, occupied columns past the end, and who shows in each square."""
    taken = {(r, c): ("above", c) for r, cols in (carry or {}).items() for c in cols}
    starts = []
    for r, row in enumerate(rows):
        col, mine = 0, []
        for k, (_, down, right) in enumerate(row):
            while (r, col) in taken:
                col += 1
            mine.append(col)
            for i in range(down):
                for j in range(right):
                    taken[r + i, col + j] = (r, k)
            col += right
        starts.append(mine)
    wide = [max([c for (a, c) in taken if a == r], default=-1) + 1 for r in range(len(rows))]
    tail = {}
    for a, c in taken:
        if a >= len(rows):
            tail.setdefault(a - len(rows), set()).add(c)
    return starts, wide, tail, taken


def total(rows):
    return max((c + 1 for _, c in scan(rows)[3]), default=0)


def segments(rows, r):
    taken = scan(rows)[3]
    shown = [taken.get((r, c)) for c in range(total(rows))]
    return sum(1 for c, who in enumerate(shown) if who is not None and (c == 0 or shown[c - 1] != who))


def headers(before, rows, own, most=5):
    texts = lambda row: [t.replace(" ", "") for t, _, _ in row]
    limit = min(len(before), own, most)
    same = lambda r: before[r] is not None and texts(before[r]) == texts(rows[r])
    spans = lambda row: [x[1:] for x in row]
    a = 0
    while a < limit and same(a) and spans(before[a]) == spans(rows[a]) and scan(before)[1][a] == scan(rows)[1][a]:
        a += 1
    if a == 0:
        while a < limit and same(a) and segments(before, a) == segments(rows, a):
            a += 1
    r = 0
    while r < a:
        a = min(len(rows), max([a, *[r + d for _, d, _ in rows[r]]]))
        r += 1
    return a


def model(chain, widths, notes, flags):
    """The tables of one document, page after page, merged from the last one back."""
    merged, current = {}, None
    out = {}
    for k in range(len(chain) - 1, -1, -1):
        rows = [list(map(tuple, r)) for r in chain[k]]
        if current is None:
            current = (rows, len(rows), [k])
            continue
        late, own, members = current
        first = members[0]
        captions, continued, _ = notes[first]
        ok = (continued > 0 and notes[k][2] <= 1) if captions else notes[k][2] == 0
        ok = ok and abs(widths[k] - widths[first]) < 0.1 * min(widths[k], widths[first])
        h = headers(rows, late, own)
        if ok and total(rows) != total(late):
            ok = h < min(own, 6) and (
                scan(rows)[1][-1] == scan(late)[1][h] or sum(x[2] for x in rows[-1]) == sum(x[2] for x in late[h]) or segments(rows, len(rows) - 1) == segments(late, h)
            )
        if not ok:
            out[first] = late
            current = (rows, len(rows), [k])
            continue
        heads, part = late[:h], late[h:]
        # clip
        starts, _, _, _ = scan(part)
        covered = scan(rows)[2]
        placed = [[(starts[r][c], cell) for c, cell in enumerate(row)] for r, row in enumerate(part)]
        moved = []
        for r, row in enumerate(placed):
            for item in list(row):
                col, (text, down, right) = item
                if down > 1 and not text.strip():
                    n = 0
                    while n < down and set(range(col, col + right)) <= covered.get(r + n, set()):
                        n += 1
                    if n and not (down > n and r + n >= len(part)):
                        row.remove(item)
                        if down > n:
                            moved.append((r + n, (col, (text, down - n, right))))
        for r, item in moved:
            placed[r].append(item)
        part = [[cell for _, cell in sorted(row, key=lambda x: x[0])] for row in placed]
        cols = max(total(heads + part), total(part))
        # pad
        if part:
            a, b = total(rows), cols
            last, head = [x[2] for x in rows[-1]], [x[2] for x in part[0]]
            def pad(table, target, ref, like):
                wide = scan(table)[1]
                new = []
                for r, row in enumerate(table):
                    spans = [x[2] for x in row]
                    if row and wide[r] < target and sum(spans) < target:
                        if len(row) == len(ref) and spans == like:
                            row = [(t, d, ref[i] if ref[i] > 1 else c) for i, (t, d, c) in enumerate(row)]
                        else:
                            t, d, c = row[-1]
                            row = row[:-1] + [(t, d, c + target - wide[r])]
                    new.append(row)
                return new
            if a > b:
                part = pad(part, a, last, head)
            elif b > a:
                rows = pad(rows, b, head, last)
            # continued cells
            marks = flags.get(first)
            if marks:
                whole = scan(rows + part)[0]
                n = len(rows)
                cover = lambda r, row: {c: i for i, x in enumerate(row) for c in range(whole[r][i], whole[r][i] + x[2])}
                up, down = cover(n - 1, rows[-1]), cover(n, part[0])
                emptied = {}
                for c, mark in enumerate(marks):
                    if mark == 1 and c in up and c in down and down[c] not in emptied:
                        emptied[down[c]] = up[c]
                last_row, first_row = list(rows[-1]), list(part[0])
                for i, j in sorted(emptied.items()):
                    t, d, c = last_row[j]
                    last_row[j] = (t + first_row[i][0], d, c)
                for i in emptied:
                    first_row[i] = ("", *first_row[i][1:])
                rows[-1] = last_row
                part[0] = first_row
                if not any(t.strip() for t, _, _ in first_row):
                    down_cells = [(whole[n][i], (t, d - 1, c)) for i, (t, d, c) in enumerate(first_row) if d > 1]
                    part = part[1:]
                    if part:
                        there = [(whole[n + 1][i], x) for i, x in enumerate(part[0])]
                        part[0] = [x for _, x in sorted(there + down_cells, key=lambda x: x[0])]
        current = (rows + part, len(rows), [k, *members])
        # rows of its own: those as read
        current = (current[0], len(chain[k]), current[2])
    out[current[2][0]] = current[0]
    return out


def as_cells(table, rows):
    return [(table, r, c, t, d, w) for r, row in enumerate(rows) for c, (t, d, w) in enumerate(row)]


def run_merge(spark, docs):
    """docs: (tables, widths, notes, flags) each; table k of document d is d * 100 + k."""
    cells, blocks, notes, flags = [], [], [], []
    for d, (chain, widths, told, marks) in enumerate(docs):
        for k, rows in enumerate(chain):
            t = d * 100 + k
            cells += as_cells(t, rows)
            blocks.append((d, k, 0, "table", t, 0, widths[k]))
            captions, continued, footnotes = told[k]
            notes += [(t, i, "caption", "Table 2 (continued)" if i < continued else "Table 3", False) for i in range(captions)]
            notes += [(t, 10 + i, "footnote", "note", True) for i in range(footnotes)]
            if marks.get(k):
                flags.append((t, marks[k]))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    return M.merge_page_tables(
        df(cells, CELL), df(blocks, "doc_id long, page_idx long, block_idx long, type string, table_id long, x0 long, x1 long"),
        df(notes, "table_id long, note_idx int, kind string, text string, below boolean"), df(flags, "table_id long, flags array<int>"),
    )


def found(merge):
    got = {}
    for r in merge.cells.collect():
        got.setdefault(r["table_id"], {}).setdefault(r["row_idx"], []).append((r["cell_idx"], (r["text"], r["rowspan"], r["colspan"])))
    return {t: [[c for _, c in sorted(cells)] for _, cells in sorted(rows.items())] for t, rows in got.items()}


def test_merge_over_pages(spark):
    """Random chains against the model, and one of four pages: page 0 has three columns, pages 1 and 2 two, page 3 three, so page 1 fits
    page 0 only once what follows has widened it."""
    three = [("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]
    p0 = [three, [("x", 1, 1), ("y", 1, 1), ("z", 1, 1)]]
    p1 = [[("k", 1, 1), ("l", 1, 1)], [("m", 1, 1), ("n", 1, 1)]]
    p2 = [[("o", 1, 1), ("p", 1, 1)], [("q", 1, 1), ("r", 1, 1)], [("u", 1, 1), ("v", 2, 1), ("w", 2, 1)]]
    p3 = [[("", 1, 1)], [("s", 1, 1), ("t", 1, 1), ("e", 1, 1)]]
    quiet = [(0, 0, 0)] * 4
    docs = [([p0, p1, p2, p3], [100] * 4, quiet, {}), ([p0, p1], [100] * 2, quiet, {})]
    rng = random.Random(21)
    for _ in range(90):
        head = [(rng.choice("ABC"), rng.choice([1, 1, 2]), rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 3))]
        chain = []
        for _ in range(rng.randint(2, 4)):
            rows = [head] if rng.random() < 0.6 else []
            for _ in range(rng.randint(1, 4)):
                rows.append([(rng.choice(["", "", "x", "y", "long text", " "]), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2])) for _ in range(rng.randint(1, 4))])
            chain.append(rows)
        n = len(chain)
        widths = [rng.choice([100] * 8 + [104, 130]) for _ in range(n)]
        notes = [rng.choice([(0, 0, 0)] * 12 + [(1, 1, 0), (1, 0, 0), (0, 0, 1), (2, 1, 1)]) for _ in range(n)]
        flags = {k: [rng.randint(0, 1) for _ in range(4)] for k in range(n) if rng.random() < 0.5}
        docs.append((chain, widths, notes, flags))
    merge = run_merge(spark, docs)
    got = found(merge)
    assert {(r["table_id"], r["root_id"], r["chain_pos"]) for r in merge.chains.collect() if r["table_id"] < 100} == {(k, 0, k) for k in range(4)}
    assert {t for t in got if t < 200} == {0, 100, 101}
    bad, merges = [], 0
    for d, doc in enumerate(docs):
        want = {d * 100 + k: [r for r in rows if r] for k, rows in model(*doc).items()}
        merges += len(doc[0]) - len(want)
        mine = {t: rows for t, rows in got.items() if t // 100 == d}
        if mine != want:
            bad.append((d, doc, want, mine))
    assert merges > 40
    assert not bad, (len(bad), bad[0])


@pytest.mark.parametrize("band_rows", [2, 64])
def test_placement_under_carried_spans(spark, band_rows):
    rng = random.Random(31)
    tables, carried, want = [], [], {}
    for t in range(40):
        rows = [[("", rng.choice([1, 1, 2, 5]), rng.choice([1, 2])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 12))]
        carry = {}
        for c in range(5):
            for r in range(rng.choice([0, 0, 1, 3])):
                carry.setdefault(r, set()).add(c)
        tables += as_cells(t, rows)
        carried += [(t, r, c) for r, cols in carry.items() for c in cols]
        want.update({(t, r, c): col for r, cols in enumerate(scan(rows, carry)[0]) for c, col in enumerate(cols)})
    placed = T.place_cells(spark.createDataFrame(tables, CELL), spark.createDataFrame(carried, "table_id long, row_offset long, col long"), band_rows=band_rows)
    assert {(r["table_id"], r["row_idx"], r["cell_idx"]): r["col"] for r in placed.collect()} == want


def test_one_span_over_three_pages(spark):
    """A span of the first page covers the second page whole and the head of the third."""
    pages = [[[("s", 6, 1), ("a", 1, 1)], [("b", 1, 1)]], [[("c", 1, 1)], [("d", 1, 1)]], [[("e", 1, 1)], [("f", 1, 1)], [("g", 1, 1), ("h", 1, 1)]]]
    carried, cols = None, []
    for t, rows in enumerate(pages):
        placed = T.place_cells(spark.createDataFrame(as_cells(0, rows), CELL), carried)
        cols.append(sorted((r["row_idx"], r["col"]) for r in placed.collect()))
        carried = T.carried_columns(placed, carried)
    assert cols == [[(0, 0), (0, 1), (1, 1)], [(0, 1), (1, 1)], [(0, 1), (1, 1), (2, 0), (2, 1)]]
    assert carried.count() == 0


def test_band_of_many_rows(spark):
    """One band of 100,000 tied rows: two-row spans that overlap like bricks."""
    n = 100_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("table_id"), F.col("id").alias("row_idx"), F.lit(0).cast("long").alias("cell_idx"), F.lit("").alias("text"),
        F.lit(2).alias("rowspan"), F.lit(1).alias("colspan"),
    )
    got = T.place_cells(rows).agg(F.count("*"), F.count_if(F.col("col") != F.col("row_idx") % 2)).first()
    assert tuple(got) == (n, 0)


def test_placement_in_order_against_bands(spark):
    """Tables that are read once in order are placed as by bands, repeated and unnumbered cells too."""
    rng = random.Random(7)
    cells = []
    for t in range(30):
        cells += as_cells(t, [[("x", rng.choice([1, 1, 2, 4]), rng.choice([1, 1, 3])) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 9))])
    cells += [(40, 0, 0, "a", 2, 1), (40, 0, 0, "b", 1, 2), (40, 0, None, "n", 1, 1), (40, 1, 0, "c", 1, 1), (None, 0, 0, "d", 1, 1), (41, None, 0, "e", 1, 1), (41, 3, 0, "f", 1, 1)]
    given = spark.createDataFrame(cells, CELL)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = T.place_cells(given).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = lambda rows: sorted((tuple(r) for r in rows))
    assert order(got) == order(T._placed_by_bands(given, None, 64).collect())


@pytest.mark.parametrize("slice_rows", [2, 4096])
def test_row_facts_against_the_grid(spark, monkeypatch, slice_rows):
    """Facts of rows in one pass are those counted on the expanded grid, whatever the slices."""
    rng = random.Random(11)
    cells = []
    for t in range(30):
        cells += as_cells(t, [[(rng.choice(["x", " Y ", "<b>z</b>"]), rng.choice([1, 1, 2, 5]), rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 9))])
    placed = T.place_cells(spark.createDataFrame(cells, CELL))
    monkeypatch.setattr(T, "SLICE_ROWS", slice_rows)
    facts = T.row_facts(placed)
    columns = ["table_id", "row_idx", "actual_cols", "visual_cols", "effective_cols", "segments"]
    want = T.row_metrics(placed).join(T.segment_counts(placed), ["table_id", "row_idx"]).select(columns)
    assert sorted(map(tuple, facts.select(columns).collect())) == sorted(map(tuple, want.collect()))
    bands = T.row_bands(placed).where("row_idx = band").select("table_id", "row_idx")
    assert sorted(map(tuple, facts.where("starts").select("table_id", "row_idx").collect())) == sorted(map(tuple, bands.collect()))
    own = {}
    for t, r, c, text, rowspan, colspan in sorted(cells):
        own.setdefault((t, r), []).append((colspan, rowspan, text.strip().replace("<b>", "").replace("</b>", "")))
    assert {(f["table_id"], f["row_idx"]): list(zip(f["colspans"], f["rowspans"], f["texts"])) for f in facts.collect()} == own


def test_merges_measure_rows_once(spark):
    """Pairs are judged without expanding the grid of cells or sorting it by squares."""
    cells = as_cells(1, [[("h", 1, 1)], [("a", 1, 1)]]) + as_cells(2, [[("h", 1, 1)], [("b", 1, 1)]])
    placed = T.place_cells(spark.createDataFrame(cells, CELL))
    pairs = spark.createDataFrame([(1, 1, 2, 1, 100, 100)], "doc_id long, page_idx long, table_id long, prev_id long, width long, prev_width long")
    notes = spark.createDataFrame([], "table_id long, captions long, continued long, footnotes long")
    merges = T.mergeable_pairs(pairs, placed, notes)
    assert [(r["prev_id"], r["table_id"], r["header_rows"], r["total_cols"]) for r in merges.collect()] == [(1, 2, 1, 1)]
    plan = merges._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_densified_points_stay_small_when_written(spark, tmp_path):
    """Sparse series of the same length: a task lays the same stretch of all its series side by side, so what is written repeats itself."""
    points = spark.range(512).selectExpr("id as chart_id", "20000L as point_idx", "'v' as value")
    T.densify_points(points, ["chart_id"]).write.parquet(str(tmp_path / "dense"))
    got = spark.read.parquet(str(tmp_path / "dense"))
    assert got.count() == got.distinct().count() == 512 * 20001 and got.where("value = 'v' and point_idx = 20000").count() == 512
    assert sum(f.stat().st_size for f in (tmp_path / "dense").glob("*.parquet")) < 512 * 20001
