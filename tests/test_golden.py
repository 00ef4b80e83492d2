"""Worked examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leafmill.functions import inline as I
from leafmill.functions import text as X
from leafmill.operators import cleaning as C
from leafmill.operators import statistics as S
from leafmill.operators import tables as T
from leafmill.sources import assets as A
from leafmill.sources import documents as D
from leafmill.sources import tableset as TS


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_independent_dedup(spark):
    df = spark.createDataFrame([(1, "张", 100), (2, "李", 200), (3, "张", 300), (4, "王", 200), (5, "赵", 400)], "n int, a string, b int")
    assert [r[0] for r in rows(C.deduplicate(df, ["a", "b"], "or", ["n"]), "n")] == [1, 2, 5]


def test_combined_dedup(spark):
    df = spark.createDataFrame([(1, "张", 1), (2, "张", 1), (3, "张", 2), (4, None, 1), (5, None, 1)], "n int, a string, b int")
    once = C.deduplicate(df, ["a", "b"], "and", ["n"])
    assert [r[0] for r in rows(once, "n")] == [1, 3, 4]
    assert rows(C.deduplicate(once, ["a", "b"], "and", ["n"]), "n") == rows(once, "n")
    with pytest.raises(ValueError):
        C.deduplicate(df, ["a"], "and")


@pytest.mark.parametrize("text", ["2020-12-19", "2020/12/19", "20201219"])
def test_dates(spark, text):
    assert value(spark, C.parse_datetime_column(F.lit(text)).cast("string")) == "2020-12-19 00:00:00"


@pytest.mark.parametrize("text", ["2020-12-19 15:19:27.000000", "2020-12-19T15:19:27"])
def test_datetimes(spark, text):
    assert value(spark, C.parse_datetime_column(F.lit(text)).cast("string")) == "2020-12-19 15:19:27"


def test_unparsed_dates(spark):
    assert value(spark, C.parse_datetime_column(F.lit("soon"))) is None
    days = spark.createDataFrame([(1, dt.date(1969, 12, 31)), (2, dt.date(1970, 1, 2))], "n int, d date")
    for literal in (0, dt.date(1970, 1, 1), dt.datetime(1970, 1, 1), "1970-01-01"):
        kept = C.filter_rows(days, [{"column": "d", "operator": ">", "value": literal}])
        assert [r["n"] for r in kept.collect()] == [2]
    assert C.filter_rows(days, [{"column": "d", "operator": ">", "value": "soon"}]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_distributed_quantiles_match_percentile(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % 101 + F.col("id") / 3).alias("v")).unionAll(spark.range(n).select(F.lit(5.0)))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    a = S.exact_quantiles(df, "v", probs).first()
    b = df.agg(*[F.percentile("v", F.lit(p)) for p in probs]).first()
    assert [round(x, 9) for x in a] == [round(x, 9) for x in b]


def test_statistics_errors_and_nulls(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert S.statistic(df, "v", "median").first()["stat"] is None
    with pytest.raises(Exception, match="no values"):
        S.required_statistic(df, "v", "median").collect()
    with pytest.raises(ValueError):
        S.statistic(df, "v", "variance")
    by_median = [{"column": "v", "operator": ">=", "value_type": "median"}]
    with pytest.raises(ValueError, match="no values"):
        C.filter_rows(df, by_median)
    assert C.filter_rows(df.limit(0), by_median).count() == 0


def test_statistics_of_a_step_in_one_pass(spark):
    df = spark.range(200).selectExpr("double(id * 7 % 101) as a", "case when id % 3 = 0 then null else double(id) end as b", "'x' || id % 4 as c")
    wanted = [("a", "median", "iqr"), ("a", "outlier_upper", "iqr_3"), ("b", "median", "iqr"), ("b", "mean", "iqr"), ("c", "mode", "iqr")]
    got = S.statistics_of(df, wanted)
    for key in wanted:
        assert got[key] == S.statistic(df, *key).first()["stat"]


def test_mode_lowest_on_ties(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (2,), (None,)], "v int")
    assert S.statistic(df, "v", "mode").first()["stat"] == 1


def test_filter_errors(spark):
    df = spark.range(3)
    assert C.filter_rows(df, []).count() == 3
    with pytest.raises(KeyError):
        C.filter_rows(df, [{"column": "x", "operator": ">", "value": 1}])
    with pytest.raises(ValueError):
        C.filter_rows(df, [{"column": "id", "operator": "~", "value": 1}])
    with pytest.raises(ValueError):
        C.filter_rows(df, [{"column": "id", "operator": "between", "value_type": "median"}])
    with pytest.raises(ValueError):
        C.apply_operation(df, {"type": "explode"})


def test_nan_is_not_null_by_default(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double")
    assert C.drop_nulls(df, ["v"]).count() == 2
    assert C.drop_nulls(df, ["v"], nan_as_null=True).count() == 1


def test_validation():
    bad = {"sheets": {"t": {"operations": [
        {"type": "filter", "conditions": [{"operator": "?", "value_type": "max"}]}, {"type": "sort"}, {"type": "deduplicate", "logic": "xor", "columns": ["z"]}]}}}
    errors = C.validate_config(bad, {"t": ["a"]})
    assert len(errors) == 7, errors
    assert C.validate_config({"input_path": "x", "sheets": {}}) == []


def test_clean_and_write(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).selectExpr("id", "id % 3 as k").write.parquet(f"{src}/a.parquet")
    spark.range(4).write.parquet(f"{src}/b.parquet")
    config = {"input_path": src, "output_path": str(tmp_path / "out"), "sheets": {"a": {"operations": [
        {"type": "filter", "conditions": [{"column": "id", "operator": ">", "value": 1}]}, {"type": "deduplicate", "columns": ["k"]}]}}}
    report = TS.clean_and_write(spark, config, {"a": ["id"]})
    assert report == [{"table": "a", "rows": [10, 8, 3]}, {"table": "b", "rows": [4]}]
    assert rows(spark.read.parquet(str(tmp_path / "out/a.parquet")).select("id"), "id") == [(2,), (3,), (4,)]
    with pytest.raises(ValueError):
        TS.select_members(["a"], skip=["a"])
    assert TS.output_path({"input_path": "d/x"}) == "d/x_cleaned"


@pytest.mark.parametrize("text,level,want", [("1.1 LYSO", 2, 1), ("1.1.1 LYSO", 2, 2), ("本章小结", 0, 0)])
def test_toc_levels(spark, text, level, want):
    assert value(spark, X.corrected_toc_level(F.lit(level), F.lit(text))) == want


def test_section_parts(spark):
    assert value(spark, X.section_parts_at(F.lit("1.2.1建立…"), F.lit(3))) == [1, 2, 1]
    assert value(spark, X.section_parts_at(F.lit("1.2 x"), F.lit(3))) is None


@pytest.mark.parametrize("text,want", [("discontinued", False), ("续表", True), ("Table 1 (continued)", True), ("Table 2 continued", True), ("表１（续）", True), ("", False)])
def test_continuations(spark, text, want):
    assert value(spark, X.is_table_continuation(F.lit(text))) is want


def test_bucket(spark):
    assert tuple(value(spark, X.bucket_and_key(F.lit("s3://bucket/path/to/my/file.txt")))) == ("bucket", "path/to/my/file.txt")


@pytest.mark.parametrize("text,want", [("a*b", "a\\*b"), ("a\\*b", "a\\*b"), ("a\\\\*b", "a\\\\\\*b"), ("**", "\\*\\*"), ("$x_y$", "\\$x\\_y\\$")])
def test_markdown_escape(spark, text, want):
    assert value(spark, X.escape_markdown(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("# x", "\\# x"), ("#x", "#x"), ("  - x", "  \\- x"), ("---", "\\---")])
def test_block_prefixes(spark, text, want):
    assert value(spark, X.escape_block_prefix(X.escape_lone_rule(F.lit(text)))) == want


@pytest.mark.parametrize("serial,want", [(1.0, "1900-01-01"), (59.0, "1900-02-28"), (61.0, "1900-03-01"), (0.5, "12:00:00"), (43831.25, "2020-01-01 06:00:00")])
def test_serial_dates(spark, serial, want):
    assert value(spark, X.serial_to_iso(F.lit(serial))) == want


def test_table_html(spark):
    raw = '<TD class="a" colspan=2 disabled><a href="javascript:x">t</a><img src="p" style="s"/></TD>'
    assert value(spark, X.clean_table_html(F.lit(raw))) == '<td colspan="2>"><a>t</a><img src="p"/></TD>'.replace('"2>"', '"2"')


def test_inline_rendering(spark):
    df = spark.createDataFrame(
        [('<text style="bold">Note.</text>next',), ('x<eq>a</eq>y',), ('<text style="underline">  </text>',), ("a<eq>b",),
         ('<text style="bold">a</text><text style="italic">b</text>',)], "content string")
    got = [r["inline"] for r in I.with_inline_markdown(df).collect()]
    assert got == ["**Note.** next", "x $a$ y", "__", "a<eq\\>b".replace("\\", ""), "<strong>a</strong><em>b</em>"]


def test_annotation_replies(spark):
    good = '{"objects":[{"name":"a1","bbox":[1,2,3,4]}]}'
    for text in (good, f"x\n```json\n{good}\n```", f"so {good} ok", '[{"name":"a1","bbox":[1,2,3,4]}]'):
        assert value(spark, D.parse_annotations(F.lit(text)))[0]["name"] == "a1"
    assert value(spark, D.parse_annotations(F.lit("none"))) is None


def test_document_sink(spark, tmp_path):
    D.write_documents(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, md string"), str(tmp_path / "o"), "md")
    assert rows(spark.read.parquet(str(tmp_path / "o")), "doc_id") == [(1, "a"), (2, "b")]


def test_asset_sink(spark, tmp_path):
    df = A.content_names(spark.createDataFrame([(1, b"x"), (2, b"x"), (3, b"y")], "doc_id long, bytes binary"), F.lit(".png"))
    A.write_assets(df, str(tmp_path / "o"), ["doc_id"])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


CELLS = "table_id int, row_idx int, cell_idx int, text string, rowspan int, colspan int"


def test_page_merge(spark):
    """Two pages with the same head: the second head goes, rows follow."""
    cells = spark.createDataFrame(
        [(t, 0, c, f"h{c}", 1, 1) for t in (1, 2) for c in (0, 1)] + [(1, 1, 0, "a", 1, 1), (1, 1, 1, "b", 1, 1), (2, 1, 0, "c", 1, 1), (2, 1, 1, "", 1, 1)], CELLS)
    blocks = spark.createDataFrame([(7, 0, 3, "table", 1, 0, 100), (7, 1, 0, "table", 2, 0, 105), (7, 1, 1, "text", None, 0, 9)],
                                   "doc_id int, page_idx int, block_idx int, type string, table_id int, x0 int, x1 int")
    notes = spark.createDataFrame([], "table_id int, captions int, continued int, footnotes int")
    placed = T.place_cells(cells)
    merges = T.mergeable_pairs(T.adjacent_tables(blocks), placed, notes)
    assert [(r["prev_id"], r["table_id"], r["header_rows"]) for r in merges.collect()] == [(1, 2, 1)]
    chains = T.merge_chains(merges, cells.select("table_id").distinct())
    merged = T.merge_tables(cells, merges, chains)
    assert [r[:4] for r in rows(merged.select("table_id", "row_idx", "cell_idx", "text"), "row_idx", "cell_idx")] == [
        (1, 0, 0, "h0"), (1, 0, 1, "h1"), (1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "c"), (1, 2, 1, "")]
    start = spark.createDataFrame([(1, 2, [1, 0])], "table_id int, row_idx int, flags array<int>")
    joined = T.continue_cells(merged.drop("source_id"), start)
    assert [(r["row_idx"], r["text"]) for r in joined.orderBy("row_idx", "cell_idx").collect()] == [(0, "h0"), (0, "h1"), (1, "ac"), (1, "b")]
    one_note = spark.createDataFrame([(1, 0, 0, 1)], "table_id int, captions int, continued int, footnotes int")
    assert T.mergeable_pairs(T.adjacent_tables(blocks), placed, one_note).count() == 0


def test_blank_span_clipped(spark):
    """A blank cell over two rows, the first of which the part before still covers, starts one row lower."""
    part = T.place_cells(spark.createDataFrame([(1, 0, 0, "", 2, 1), (1, 0, 1, "x", 1, 1), (1, 1, 0, "y", 1, 1)], CELLS))
    carried = spark.createDataFrame([(1, 0, 0)], "table_id int, row_offset int, col int")
    got = rows(T.clip_blank_spans(part, carried).select("row_idx", "cell_idx", "text", "rowspan"), "row_idx", "cell_idx")
    assert got == [(0, 0, "x", 1), (1, 0, "", 1), (1, 1, "y", 1)]


def test_column_padding(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a", 1, 1), (1, 0, 1, "b", 1, 1), (1, 1, 0, "c", 1, 1)], CELLS)
    target = spark.createDataFrame([(1, 3, 0, [2, 1], [1, 1])], "table_id int, target_cols int, first_row int, ref_spans array<int>, own_spans array<int>")
    got = rows(T.pad_columns(cells, target).select("row_idx", "cell_idx", "colspan"), "row_idx", "cell_idx")
    assert got == [(0, 0, 2), (0, 1, 1), (1, 0, 3)]


def test_table_alignment(spark):
    sig = "doc_id int, ord int, rows int, cells int, images int, text string"
    left = spark.createDataFrame([(1, 0, 1, 1, 0, "ab"), (1, 1, 2, 2, 0, ""), (1, 2, 1, 1, 0, "zz")], sig)
    right = spark.createDataFrame([(1, 0, 9, 9, 0, "ab"), (1, 1, 1, 3, 0, "abc"), (1, 2, 2, 2, 0, ""), (1, 3, 2, 2, 0, "")], sig)
    assert rows(T.align_tables(left, right), "l_ord") == [(1, 0, 1), (1, 1, 2)]


def test_links_with_character_references(spark):
    from leafmill.functions import text as X

    html = (
        '<td nowrap colspan=2><a href="http&#58;//e.org/?a=1&amp;b=&#x41;">x</a><a href="&#106;avascript:x">y</a>'
        "<a href='java&#10;script:x'>w</a><img src=a/b.png alt='q\"r' onload=\"z\"/></td>"
    )
    got = value(spark, X.clean_table_html(F.lit(html)))
    assert got == (
        '<td colspan="2"><a href="http://e.org/?a=1&amp;b=A">x</a><a>y</a><a>w</a><img src="a/b.png" alt="q"r"/></td>'
    )
    assert value(spark, X.decode_references(F.lit("&#x1F600; &amp;lt; &bogus; & &#0;"))) == "😀 &lt; &bogus; & \x00"
