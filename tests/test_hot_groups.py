"""Operators on groups that hold most of a table, and results SQL does not state."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as X
from leafmill.operators import graph as G
from leafmill.operators import layout as L
from leafmill.operators import retrieval as R
from leafmill.operators import visuals as V


def test_union_area_of_nested_rectangles(spark):
    """10,000 rectangles in each other on one page: the outermost covers all; shifted ones make a staircase."""
    n = 10_000
    nested = spark.range(n).selectExpr("1L as page", "id as x0", "id as y0", f"{2 * n} - id as x1", f"{2 * n} - id as y1")
    stairs = spark.range(n).selectExpr("2L as page", "id as x0", "id as y0", "id + 2 as x1", "id + 2 as y1")
    got = {r["page"]: r["area"] for r in L.union_area(nested.unionByName(stairs), ["page"]).collect()}
    assert got == {1: 4 * n * n, 2: 4 + 3 * (n - 1)}


@pytest.mark.parametrize("seed", range(2))
def test_union_area_against_a_grid(spark, seed):
    rng = random.Random(seed)
    rects = []
    for g in range(12):
        for _ in range(rng.randint(1, 60)):
            x, y = rng.randrange(60), rng.randrange(60)
            rects.append((g, x, y, x + rng.randint(0, 25), y + rng.randint(-1, 25)))
    want = {}
    for g, x0, y0, x1, y1 in rects:
        want.setdefault(g, set()).update(itertools.product(range(x0, x1), range(y0, y1)))
    got = {r["g"]: r["area"] for r in L.union_area(spark.createDataFrame(rects, "g int, x0 int, y0 int, x1 int, y1 int"), ["g"]).collect()}
    assert got == {g: len(v) for g, v in want.items() if v}


def test_union_area_of_small_groups_is_one_fold(spark, monkeypatch):
    rng = random.Random(5)
    rects = [(g if g else None, x, y, x + rng.randint(0, 9), y + rng.randint(0, 9)) for g in range(9) for x, y in ((rng.randrange(20), rng.randrange(20)) for _ in range(4 * g + 1))]
    rows = spark.createDataFrame(rects, "g int, x0 int, y0 int, x1 int, y1 int")
    area = L.union_area(rows, ["g"])
    plan = area._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    monkeypatch.setattr(L, "FOLDED", 12)  # the larger groups go down the tree
    mixed = L.union_area(rows, ["g"])
    assert area.schema == mixed.schema and sorted(area.collect()) == sorted(mixed.collect()) and area.where("g is null").isEmpty()


def test_budget_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else rng.choice("abc"), rng.randrange(50), rng.randrange(9)) for i in range(6000)] + [(9000 + i, None, 1, 3) for i in range(40)]
    got = {(r["doc_id"], r["running"]) for r in R.budgeted(spark.createDataFrame(rows, "doc_id long, source string, score int, size int").repartition(5), ["source"], 60).collect()}
    want = set()
    for source in {r[1] for r in rows}:
        running = 0
        for i, _, _, size in sorted((r for r in rows if r[1] == source), key=lambda r: (-r[2], r[0])):
            running += size
            if running <= 60:
                want.add((i, running))
    assert got == want


def test_shared_members_start_at_the_smaller_end(spark):
    """A hub linked to by 3,000 nodes: its edges list the few members of the other end."""
    hub = [(0, i) for i in range(3000)] + [(i, m) for i in range(1, 3000) for m in (i, 5000)]
    edges = [(0, i) for i in range(1, 3000)]
    members = spark.createDataFrame(hub, "node long, member long")
    got = G.shared_members(spark.createDataFrame(edges, "a long, b long"), members)
    assert got.count() == 2999 and got.where("member <> b").count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("listed", [0, 3, 512])
def test_shared_members_by_lists_and_by_rows(spark, listed):
    rng = random.Random(3)
    members = {(n, rng.randrange(12)) for n in range(30) for _ in range(rng.randrange(9))} | {(n, None) for n in range(5)}
    edges = {(rng.randrange(32), rng.randrange(32)) for _ in range(120)} | {(4, 4), (None, 3)}
    own = lambda n: {m for k, m in members if k == n and m is not None}
    want = sorted((a, b, m) for a, b in edges if a is not None for m in own(a) & own(b))
    got = G.shared_members(spark.createDataFrame(sorted(edges, key=str), "a long, b long"), spark.createDataFrame(sorted(members, key=str), "node long, member long"), listed)
    assert sorted(map(tuple, got.collect())) == want


def test_typed_paths(spark):
    edges = [(1, 2, "cites"), (1, 2, "uses"), (3, 2, "cites"), (3, 4, "uses"), (5, 4, "cites"), (4, 1, "extends")]
    df = spark.createDataFrame(edges, "src long, dst long, type string")
    seeds = spark.createDataFrame([(1,), (1,)], "node long")
    got = {r["node"]: (r["hops"], r["path"], r["types"], r["directions"]) for r in G.typed_paths(df, seeds, 3).collect()}
    assert got == {1: (0, [1], [], []), 2: (1, [1, 2], ["cites"], ["out"]), 4: (1, [1, 4], ["extends"], ["in"]), 3: (2, [1, 2, 3], ["cites", "cites"], ["out", "in"]), 5: (2, [1, 4, 5], ["extends", "cites"], ["in", "in"])}
    assert {r["node"] for r in G.typed_paths(df, seeds, 3, "out", ["cites"]).collect()} == {1, 2}


NESTED = T.StructType(
    [
        T.StructField("z", T.DoubleType()), T.StructField("a", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))), T.StructField("é\"\n", T.StringType()),
        T.StructField("m", T.StructType([T.StructField("y", T.LongType()), T.StructField("b", T.BooleanType()), T.StructField("n", T.ArrayType(T.StringType()))])),
    ]
)


def test_canonical_json_of_nested_objects(spark):
    rng = random.Random(2)
    texts = ["", "plain", "q\"uo\\te", "\x0b\x1f\x01\t\r\n\b\f/", "ü 中 😀", "\\u001F", None]
    numbers = [0.0, -0.0, 1.0, 100.0, 1e16, 123456789012345678.0, 1e-4, 1e-5, 2.5e-7, 1 / 3, -1234.5, 9999999.0, 1e7, 12345678.9, 1e22, 5e-324 * 2**60, math.inf, -math.inf, None]
    rows = []
    for _ in range(200):
        number = lambda: rng.choice(numbers) if rng.random() < 0.6 else rng.uniform(-1, 1) * 10.0 ** rng.randint(-9, 19)
        rows.append(({"z": number(), "a": rng.choice([None, [], [{"k": number(), "b": number()}, None, {}]]), "é\"\n": rng.choice(texts), "m": rng.choice([None, {"y": rng.randint(-9, 9), "b": rng.choice([True, False, None]), "n": [rng.choice(texts), None]}])},))
    df = spark.createDataFrame(rows, T.StructType([T.StructField("o", NESTED)]))
    got = df.select(X.canonical_value(F.col("o"), NESTED).alias("j")).collect()
    assert [r["j"] for r in got] == [json.dumps(o, sort_keys=True, ensure_ascii=False) for (o,) in rows]


def test_stacked_captions_table_after_table(spark):
    """The upper table makes a block a caption that the lower table then finds below its own caption's place."""
    rng = random.Random(6)
    pages, rows = [], []
    for page in range(40):
        blocks, y = [], 0
        for i in range(rng.randint(4, 14)):
            kind = rng.choice(["caption", "text", "text", "footnote", "table_body"])
            height = rng.choice([10, 20])
            blocks.append((page, 0, i, kind, "", 0, y, 100, y + height, rng.choice([1] * 6 + [2])))
            y += height + rng.choice([0, 3, 3, 3, 30])
        order = rng.sample(range(len(blocks)), len(blocks)) if page % 2 else range(len(blocks))
        blocks = [(*b[:2], i, *b[3:]) for i, b in zip(order, blocks)]
        pages.append(blocks)
        rows += blocks
    schema = "doc_id int, page_idx int, block_idx int, type string, content string, x0 int, y0 int, x1 int, y1 int, lines int"
    got = {(r["doc_id"], r["block_idx"]): r["type"] for r in V.stacked_caption_fragments(spark.createDataFrame(rows, schema), ("table_body",)).collect()}
    alone = 0
    for blocks in pages:
        kind = {b[2]: b[3] for b in blocks}
        for t in sorted((b for b in blocks if b[3] == "table_body"), key=lambda b: b[2]):
            top, tall, cluster = t[6], 1, []
            for b in sorted((b for b in blocks if kind[b[2]] in ("caption", "text", "footnote") and b[8] <= t[6]), key=lambda b: (b[6], b[2]), reverse=True):
                height = max(1, b[8] - b[6])
                tall = max(tall, height)
                if not 0 <= top - b[8] <= max(12, 1.5 * tall):
                    break
                cluster.append(b)
                top = b[6]
            first = next((k for k, b in enumerate(cluster) if kind[b[2]] == "caption"), None)
            for b in cluster[: first or 0]:
                if kind[b[2]] in ("text", "footnote") and b[9] <= 1:
                    kind[b[2]] = "caption"
                    alone += 1
        assert {b[2]: got[b[0], b[2]] for b in blocks} == kind
    assert alone > 20


def test_byte_ranges(spark, tmp_path):
    from leafmill.sources.ranges import read_ranges

    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.truncate(1 << 30)  # a sparse file
        f.seek(123_456_789)
        f.write(b"leaf")
    asked = [(str(big), 123_456_789, 4), (f"file:{big}", (1 << 30) - 2, 10), (str(big), 5 << 30, 4), (str(big), (1 << 30) - 3, -1)]
    got = read_ranges(spark, asked)
    assert got.rdd.getNumPartitions() == 4
    assert {(r["offset"], bytes(r["content"])) for r in got.collect()} == {(123_456_789, b"leaf"), ((1 << 30) - 2, b"\0\0"), (5 << 30, b""), ((1 << 30) - 3, b"\0\0\0")}


def test_filters_run_each_step_once(spark):
    from leafmill.operators.cleaning import run_operations, stage_metrics

    df = spark.range(1000).selectExpr("id", "id % 100 as v")
    step = {"type": "filter", "conditions": [{"column": "v", "operator": ">=", "value_type": "median"}]}
    assert [r["v"] for r in run_operations(df, [step, step, step]).select("v").distinct().orderBy("v").collect()] == list(range(87, 100))
    assert [(r["rows_in"], r["rows_out"]) for r in stage_metrics(df, [step, step]).orderBy("stage").collect()] == [(1000, 500), (500, 250)]


def test_chunkers_on_one_long_text(spark):
    """A text of some megabytes: chunks cover it, in time that grows with its length."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    paragraphs = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 200))) + "." for _ in range(4000)]
    paragraphs[7] = "x" * 900_000
    text = "\n\n".join(paragraphs)
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    windows = R.window_chunks(df).orderBy("chunk_idx").collect()
    assert {r["doc_id"] for r in windows} == {1} and all(text[r["start"] : r["start"] + len(r["chunk"])] == r["chunk"] for r in windows)
    assert all(a["start"] < b["start"] <= a["start"] + len(a["chunk"]) - 400 for a, b in zip(windows, windows[1:])) and windows[-1]["start"] + len(windows[-1]["chunk"]) == len(text)
    chunks = [r["chunk"] for r in R.paragraph_chunks(df).where("doc_id = 1").orderBy("chunk_idx").collect()]
    assert "".join(chunks).replace("\n", "") == text.replace("\n", "") and max(map(len, chunks)) <= 1400
    assert R.heading_chunks(df).where("doc_id = 1").count() > 400


def test_groups_in_a_circle(spark):
    groups = "page_id int, group_id int, parent_id int, sx double, sy double, tx double, ty double"
    chain = [(1, i, i - 1 if i else None, 2.0, 1.0, 0.0, 1.0) for i in range(6)]
    shapes = spark.createDataFrame([(1, 5, 1.0, 1.0, 2.0, 2.0)], "page_id int, group_id int, x0 double, y0 double, x1 double, y1 double")
    got = L.compose_transforms(spark.createDataFrame(chain, groups), shapes).first()
    assert (got["x0"], got["y0"], got["x1"], got["y1"]) == (64.0, 7.0, 128.0, 8.0)
    with pytest.raises(ValueError, match="page 2"):
        L.compose_transforms(spark.createDataFrame([*chain, (2, 1, 2, 1.0, 1.0, 0.0, 0.0), (2, 2, 3, 1.0, 1.0, 0.0, 0.0), (2, 3, 1, 1.0, 1.0, 0.0, 0.0)], groups), shapes)


def test_edges_are_dealt_in_bounded_partitions(spark, monkeypatch):
    """Edges, and what is measured on them, lie in partitions of a bounded number of rows."""
    from leafmill import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    links = spark.range(4000).selectExpr("id as src", "id + 1 as dst").unionAll(spark.range(0, 4000, 7).selectExpr("id + 1 as src", "id as dst"))
    edges = G.undirected(links)
    assert edges.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
    assert edges.count() == 8000
    labels = spark.range(4001).selectExpr("id as node", "id % 4 as label")
    assert G.bridge_nodes(links, labels, 2).count() == 3999
    found = {(r["a"], r["b"]): round(r["score"], 6) for r in G.surprising_edges(links, labels).collect()}
    # ends of the line have one neighbour, all others two
    assert found == {(i, i + 1): round(0.5 if 0 < i < 3999 else 0.5**0.5, 6) for i in range(4000)}
    paths = G.shortest_paths(links, spark.createDataFrame([(10,)], "node long"))
    assert sorted(map(tuple, paths.collect())) == [(10 + d, abs(d)) for d in range(-4, 5)]


def test_xy_cut_in_batches_and_in_rounds(spark):
    """Small pages are cut in one ordered pass; it gives what rounds of joins give, for boxes that repeat or lack a number, and pages of one box."""
    rng = random.Random(11)
    boxes = []
    for page in range(20):
        for i in range(rng.choice([1, 2, 5, 8])):
            x, y = rng.randrange(0, 300), rng.randrange(0, 300)
            boxes.append((page, None if rng.random() < 0.1 else rng.randrange(12) + 20 * (page % 2) * i, x, y, x + rng.choice([0, 4, 40, 200]), y + rng.choice([5, 30])))
    boxes += [(None, 1, 0, 0, 5, 5), (40, 1, None, 0, 5, 5)] + [b for b in boxes[:20] for _ in range(2)]
    df = spark.createDataFrame(boxes, "page_id long, span_idx long, x0 long, y0 long, x1 long, y1 long")
    valid = df.where("x0 < x1 and y0 < y1 and page_id is not null")
    want = sorted(map(str, L._cut_in_rounds(valid, 0.7, 5.0).collect()))
    assert sorted(map(str, L.xy_cut_order(df, 0.7).collect())) == want
    assert "MapInArrow" in L.xy_cut_order(df)._jdf.queryExecution().toString()
