"""Sequential and iterative operators against small plain models on random input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import blocks as K
from leafmill.operators import glyphs as G
from leafmill.operators import graph as N
from leafmill.operators import layout as L
from leafmill.operators import ordered as O
from leafmill.operators import retrieval as R

PAGES = range(12)


def random_boxes(seed, n=14, spread=200):
    rnd = random.Random(seed)
    out = []
    for page in PAGES:
        for i in range(rnd.randint(1, n)):
            x, y = rnd.randint(0, spread), rnd.randint(0, spread)
            out.append((page, i, x, y, x + rnd.randint(5, 60), y + rnd.randint(5, 30)))
    return out


def boxes_frame(spark, boxes):
    return spark.createDataFrame(boxes, "page_id long, span_idx long, x0 long, y0 long, x1 long, y1 long")


def by_page(boxes):
    pages = {}
    for b in boxes:
        pages.setdefault(b[0], []).append(b)
    return pages


@pytest.mark.parametrize("rows", [1, 3, 7])
def test_sliced_scan_equals_plain(spark, rows):
    rnd = random.Random(rows)
    data = [(g, p, rnd.choice([None, rnd.randint(0, 9)])) for g in range(5) for p in range(rnd.randint(1, 25))]
    df = spark.createDataFrame(data, "g int, pos long, v int")
    v = F.col("v")
    scans = {
        "lag": O.Scan("lag", v), "lead": O.Scan("lead", v), "sum": O.Scan("sum", v), "sum_x": O.Scan("sum", v, False),
        "max": O.Scan("max", v, False), "min": O.Scan("min", v), "last": O.Scan("last", v, False), "next": O.Scan("next", v, False),
    }
    plain = O.scan(df, ["g"], ["pos"], scans, "pos", 0)
    sliced = O.scan(df, ["g"], ["pos"], scans, "pos", rows)
    columns = ["g", "pos", *scans]
    assert plain.select(columns).orderBy("g", "pos").collect() == sliced.select(columns).orderBy("g", "pos").collect()


def test_global_row_number(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), "id")
    got = O.global_row_number(df, ["k", "id"], "n", parts=7).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(500))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def random_titles(seed):
    rnd = random.Random(seed)
    out = []
    for doc in range(20):
        for page in range(4):
            for i in range(rnd.randint(0, 5)):
                text = rnd.choice(["intro", "2 a", "3.4 b", "1.2.3 c", "5.6.7.8 d"])
                out.append((doc, page, i, text, rnd.randint(1, 4), rnd.random() < 0.6))
    return out


@pytest.mark.parametrize("seed,slice_rows", [(1, None), (2, None), (3, 1), (4, 2)])
def test_section_numbers(spark, seed, slice_rows):
    import re

    data = random_titles(seed)
    want, counters, doc = {}, None, None
    for d, p, i, text, level, numbered in data:
        if d != doc:
            counters, doc = [0] * 10, d
        number = None
        if numbered:
            for a in range(1, level):
                counters[a] = max(counters[a], 1)
            counters[level] += 1
            counters[level + 1:] = [0] * (9 - level)
            number = ".".join(str(c) for c in counters[1: level + 1])
        else:
            m = re.match(r"\d+(\.\d+)*", text)
            parts = [int(x) for x in m.group().split(".")] if m else []
            if len(parts) == level:
                counters[1: level + 1] = parts
                counters[level + 1:] = [0] * (9 - level)
        want[d, p, i] = number
    df = spark.createDataFrame(data, "doc_id long, page_idx long, block_idx long, content string, level int, numbered boolean")
    got = K.section_numbers(df, max_level=4, slice_rows=slice_rows).collect()
    assert {(r["doc_id"], r["page_idx"], r["block_idx"]): r["section_number"] for r in got} == want


@pytest.mark.parametrize("slice_rows", [1, 2])
def test_captions_sliced(spark, slice_rows):
    rnd = random.Random(slice_rows)
    kinds = ["text", "caption", "image", "table", "chart", "title"]
    data = [(d, 0, i, rnd.choice(kinds), rnd.choice(["Table x", "fig y", "word"])) for d in range(15) for i in range(rnd.randint(1, 12))]
    df = spark.createDataFrame(data, "doc_id long, page_idx long, block_idx long, type string, content string")

    def run(rows):
        routed = K.route_blocks(K.classify_captions(df, rows))
        return K.attach_captions(routed, rows).select("doc_id", "block_idx", "type", "owner_idx").orderBy("doc_id", "block_idx").collect()

    assert run(0) == run(slice_rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_tolerant_reading_order(spark, seed):
    boxes = random_boxes(seed, 16, 60)
    want = {}
    for page, items in by_page(boxes).items():
        line = sorted(items, key=lambda b: (b[3], b[2], b[1]))
        for i in range(len(line) - 1):
            j = i
            while j >= 0 and abs(line[j + 1][3] - line[j][3]) < 10 and line[j + 1][2] < line[j][2]:
                line[j], line[j + 1] = line[j + 1], line[j]
                j -= 1
        want[page] = [b[1] for b in line]
    got = {}
    for r in L.tolerant_reading_order(boxes_frame(spark, boxes)).orderBy("page_id", "position").collect():
        got.setdefault(r["page_id"], []).append(r["span_idx"])
    assert got == want


def widest(items, lo, hi):
    best, cut, end = 0, None, None
    for b in sorted(items, key=lambda b: (b[lo], b[hi], b[1])):
        if end is not None and b[lo] - end > best:
            best, cut = b[lo] - end, (b[lo] + end) / 2
        end = b[hi] if end is None else max(end, b[hi])
    return best, cut


def cut_order(items):
    rest = sorted(items, key=lambda b: (b[3], b[2], b[1]))
    if len(items) < 2:
        return rest
    hg, hc = widest(items, 3, 5)
    vg, vc = widest(items, 2, 4)
    if vg < 5 and len(items) >= 3:
        width = max(b[4] for b in items) - min(b[2] for b in items)
        wide = [b for b in items if b[4] - b[2] >= width * 0.1]
        if 2 <= len(wide) < len(items):
            g, c = widest(wide, 2, 4)
            if g > vg and g >= 5:
                vg, vc = g, c
    if hg < 5 and vg < 5:
        return rest
    rows = hg >= 5 and (vg < 5 or hg > vg)
    side = (lambda b: (b[3] + b[5]) / 2 < hc) if rows else (lambda b: (b[2] + b[4]) / 2 < vc)
    a, b = [x for x in items if side(x)], [x for x in items if not side(x)]
    return rest if not a or not b else cut_order(a) + cut_order(b)


@pytest.mark.parametrize("beta", [2.0, 0.7])
def test_xy_cut(spark, beta):
    boxes = random_boxes(5, 14, 150)
    want = {}
    for page, items in by_page(boxes).items():
        top = max(b[4] - b[2] for b in items)
        held = []
        if len(items) >= 3:
            for b in items:
                near = [o for o in items if o is not b and (min(b[4], o[4]) - max(b[2], o[2])) / min(b[4] - b[2], o[4] - o[2]) >= 0.1]
                if b[4] - b[2] >= beta * top and len(near) >= 2:
                    held.append(b)
        main = cut_order([b for b in items if b not in held])
        merged = []
        for h in sorted(held, key=lambda b: (b[3], b[2], b[1])):
            while main and main[0][3] < h[3]:
                merged.append(main.pop(0))
            merged.append(h)
        want[page] = [b[1] for b in merged + main]
    got = {}
    for r in L.xy_cut_order(boxes_frame(spark, boxes), beta=beta).orderBy("page_id", "position").collect():
        got.setdefault(r["page_id"], []).append(r["span_idx"])
    assert got == want


@pytest.mark.parametrize("shadows", [False, True])
def test_glyph_duplicates(spark, shadows):
    rnd = random.Random(9)
    data = []
    for page in range(8):
        for i in range(40):
            x, y = rnd.randint(0, 12) * 0.5, rnd.randint(0, 6) * 0.5
            data.append((page, i, rnd.choice("aab "), rnd.choice("FG"), 0.0, x, y, x + 6, y + rnd.choice([9.0, 9.5])))
    want = set()
    for page in range(8):
        kept = []
        for g in [d for d in data if d[0] == page]:
            if g[2] != " ":
                if shadows and kept and kept[-1][2:4] == g[2:4]:
                    a, b = kept[-1][5:], g[5:]
                    d = [q - p for p, q in zip(a, b)]
                    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
                    small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
                    if (abs(d[0] - d[2]) <= 0.1 and abs(d[1] - d[3]) <= 0.1 and 1 < abs(d[0]) <= 2.5 and 1 < abs(d[1]) <= 2.5
                            and w * h / small >= 0.45):
                        continue
                if any(k[2:4] == g[2:4] and all(abs(p - q) <= 1 for p, q in zip(k[5:], g[5:])) for k in kept):
                    continue
            kept.append(g)
        want |= {(page, k[1]) for k in kept}
    df = spark.createDataFrame(data, "page_id long, char_idx long, ch string, font string, rotation double, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page_id"], r["char_idx"]) for r in G.deduplicate_glyphs(df, shadows=shadows).collect()}
    assert got == want


@pytest.mark.parametrize("shadows", [False, True])
def test_glyphs_of_a_page_in_one_fold_or_in_rounds(spark, shadows):
    rnd = random.Random(4)
    data = []
    for page in (1, 2, 3, None):
        for i in range(60):
            x, y = rnd.choice([rnd.randint(0, 20) * 0.5, rnd.randint(-3, 3) * 4.0, 3.9999]), rnd.randint(0, 12) * 0.4
            ch, font = rnd.choice(["a", "b", " ", None]), rnd.choice(["F", "F", None])
            data.append((page, i, ch, font, rnd.choice([0.0, 0.0, None]), x, y, x + 6, rnd.choice([y + 9.0, y + 9.0, None])))
    data += [(2, 7, "a", "F", 0.0, 0.0, 0.0, 6.0, 9.0)]  # an index that comes twice
    df = spark.createDataFrame(data, "page_id long, char_idx long, ch string, font string, rotation double, x0 double, y0 double, x1 double, y1 double")
    rows = lambda got: sorted(map(str, got.collect()))
    folded = rows(G.deduplicate_glyphs(df, shadows=shadows))
    assert folded == rows(G.deduplicate_glyphs(df, shadows=shadows, page_glyphs=0)) and len(folded) < len(data)


def paragraphs(seed):
    rnd = random.Random(seed)
    docs = []
    for d in range(12):
        parts = []
        for _ in range(rnd.randint(1, 12)):
            words = ["w" * rnd.randint(1, 9) for _ in range(rnd.randint(5, 300))]
            parts.append(" ".join(w + (". " if rnd.random() < 0.1 else "") for w in words).strip())
        docs.append((d, "\n\n".join(parts)))
    return docs


def squeezed(text):
    return "".join(text.split())


def test_paragraph_chunks_keep_the_text(spark):
    docs = paragraphs(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    chunks = {}
    for r in R.paragraph_chunks(df).orderBy("doc_id", "chunk_idx").collect():
        chunks.setdefault(r["doc_id"], []).append(r["chunk"])
    for d, text in docs:
        assert squeezed("".join(chunks[d])) == squeezed(text)
        assert all(len(c) <= 1400 for c in chunks[d])
        assert all(len(c) >= 200 for c in chunks[d][:-1])


def test_window_chunks_cover_the_text(spark):
    docs = [(d, t * 5) for d, t in paragraphs(4)] + [(99, "x" * 20_001)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {}
    for r in R.window_chunks(df).orderBy("doc_id", "chunk_idx").collect():
        rows.setdefault(r["doc_id"], []).append((r["start"], r["chunk"]))
    for d, text in docs:
        at = 0
        for start, chunk in rows[d]:
            assert start <= at and text[start: start + len(chunk)] == chunk and len(chunk) <= 8000
            at = start + len(chunk)
        assert at == len(text)


def test_heading_chunks(spark):
    text = "# A\n\n" + "one two. " * 150 + "\n\n## B\n\n" + "three. " * 300 + "\n\n# C\n\nend"
    got = R.heading_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_idx").collect()
    assert [r["breadcrumb"] for r in got][0] == "A"
    assert len(got) >= 2 and all(len(r["chunk"]) <= 10_000 for r in got)
    assert all(r["token_count"] == len(r["chunk"]) // 4 for r in got)


def test_label_propagation(spark):
    rnd = random.Random(2)
    edges = {(min(a, b), max(a, b)) for a, b in ((rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(45)) if a != b}
    edges |= {(100, 101)} | {(200 + i, 300 + j) for i in range(4) for j in range(4)}  # a pair and a bipartite part
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    labels = {r["node"]: r["label"] for r in N.label_propagation(df).collect()}
    assert labels.keys() == near.keys()
    for n, others in near.items():
        votes = {}
        for o in others:
            votes[labels[o]] = votes.get(labels[o], 0) + 1
        assert max(votes.values()) == votes.get(labels[n], 0)
    assert labels[100] == labels[101]
    assert len({labels[n] for n in near if 200 <= n < 400}) == 1


def test_label_propagation_carries_no_constraints(spark):
    links = spark.createDataFrame([(i, j) for i in range(12) for j in range(i) if (i * j) % 3], "src long, dst long")
    plan = N.label_propagation(links)._jdf.queryExecution().optimizedPlan()
    # a checkpoint would bring those of all rounds along
    assert "LogicalRDD" not in plan.toString() and plan.constraints().size() <= 2


def test_similar_names_find_all_pairs(spark):
    rnd = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    names = sorted({" ".join(rnd.sample(words, rnd.randint(1, 5))) for _ in range(60)})
    want = {}
    for a in names:
        for b in names:
            x, y = a.split(), b.split()
            j = len(set(x) & set(y)) / len(set(x) | set(y))
            pa, pb = f" {a} ", f" {b} "
            if a == b:
                s = 1.0
            elif (pb in pa and len(y) >= 2) or (pa in pb and len(x) >= 2):
                s = 0.85
            elif j >= 0.7:
                s = j
            elif j >= 0.4:
                s = 0.4 + (j - 0.4) * 0.5
            else:
                continue
            want[a, b] = round(s, 9)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = R.similar_names(df, df.withColumnRenamed("name", "candidate")).collect()
    assert {(r["name"], r["candidate"]): round(r["score"], 9) for r in got} == want


def test_lines_cover_every_span_once(spark):
    boxes = random_boxes(6)
    df = boxes_frame(spark, boxes).withColumn("type", F.lit("text"))
    got = L.order_in_lines(L.assign_lines(df)).collect()
    assert sorted((r["page_id"], r["span_idx"]) for r in got) == sorted((b[0], b[1]) for b in boxes)
    for page in PAGES:
        ids = sorted({r["line_id"] for r in got if r["page_id"] == page})
        assert ids == list(range(1, len(ids) + 1))


def test_upright_rotation(spark):
    angles = {0.0: True, math.pi / 2: True, 0.3: False, math.pi: True}
    for a, want in angles.items():
        assert spark.range(1).select(G.is_upright(F.lit(a)).alias("v")).first()["v"] is want


def test_nothing_is_cut_at_a_depth_or_length(spark):
    import json

    from leafmill.operators import tables as T

    # lists nested 30 deep, and back
    node = {"attribute": "ordered", "ilevel": 29, "start": 3, "content": [{"type": "text", "content": "t29"}]}
    for d in range(28, -1, -1):
        node = {"attribute": "unordered", "ilevel": d, "content": [{"type": "text", "content": f"t{d}"}, {"type": "list", **node}]}
    rows = K.explode_list_tree(spark.createDataFrame([(1, json.dumps(node)), (2, '{"content":[]}')], "list_id int, tree string"))
    got = rows.collect()
    assert sorted(r["text"] for r in got) == sorted(f"t{d}" for d in range(30)) and max(len(r["item_idx"]) for r in got) == 30
    back = K.list_tree(rows).collect()
    again = K.explode_list_tree(spark.createDataFrame([(r["list_id"], r["tree"]) for r in back], "list_id int, tree string")).collect()
    assert {(tuple(r["item_idx"]), r["text"], r["attribute"], r["ilevel"], r["start"]) for r in got} == {
        (tuple(r["item_idx"]), r["text"], r["attribute"], r["ilevel"], r["start"]) for r in again
    }
    # groups nested 40 deep
    groups = spark.createDataFrame([(1, i, i - 1 if i else None, 1.0, 1.0, 1.0, 2.0) for i in range(40)], "page_id int, group_id int, parent_id int, sx double, sy double, tx double, ty double")
    shape = spark.createDataFrame([(1, 39, 0.0, 0.0, 1.0, 1.0)], "page_id int, group_id int, x0 double, y0 double, x1 double, y1 double")
    assert L.compose_transforms(groups, shape).select("x0", "y0").first() == (40.0, 80.0)
    # titles of 12 levels
    titles = spark.createDataFrame([(1, 0, i, f"t{i}", i + 1, True) for i in range(12)], "doc_id int, page_idx int, block_idx int, content string, level int, numbered boolean")
    assert max((r["section_number"] for r in K.section_numbers(titles).collect()), key=len) == ".".join(["1"] * 12)
    # a series with a point far out
    points = spark.createDataFrame([(1, 0, "a"), (1, 150_000, "b")], "chart_id int, point_idx long, value string")
    dense = T.densify_points(points, ["chart_id"])
    assert dense.count() == 150_001 and dense.where("value <> ''").count() == 2


def test_dense_points_shuffle_no_slots(spark):
    """Gaps are filled where they are used: no join of slots. Repeated points stay, a null chart has blank slots."""
    from leafmill.operators import tables as T

    data = [(1, 3, "a"), (1, 3, "b"), (1, 0, None), (2, 1, "c"), (None, 2, "d"), (None, 2, "e"), (3, None, "f")]
    dense = T.densify_points(spark.createDataFrame(data, "chart_id int, point_idx long, value string"), ["chart_id"])
    want = [(1, 0, ""), (1, 1, ""), (1, 2, ""), (1, 3, "a"), (1, 3, "b"), (2, 0, ""), (2, 1, "c"), (None, 0, ""), (None, 1, ""), (None, 2, "")]
    assert sorted(map(str, map(tuple, dense.collect()))) == sorted(map(str, want))
    assert "Join" not in dense._jdf.queryExecution().optimizedPlan().toString()
