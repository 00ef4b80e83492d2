"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

random.seed(7)
WORDS = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, chunk int, blob string, id string, size int, row string, h int"


def prose(n):
    return " ".join(random.choice(WORDS) + random.choice(["", "", "", ".", ",", " é"]) for _ in range(n))


def edit(text, share):
    return " ".join(w if random.random() > share else random.choice(WORDS) for w in text.split(" "))


@pytest.fixture(scope="module")
def documents():
    base, shared = prose(300), prose(80)
    texts = [None, "", " \n", "one", "two words", base, base, edit(base, 0.01), edit(base, 0.02), edit(base, 0.5)]
    texts += [prose(60) + shared + prose(60) for _ in range(5)]
    texts += ["ab " * 400, "<|endoftext|> 中文 " + prose(20), "x" * 3000, prose(9000)]
    texts += [prose(random.randint(10, 200)) for _ in range(20)] + ["", "one"]
    rows = [(i, t, random.choice(["en", "fr", None]), random.choice(["a", "b", "c", None]), len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[20], (None, prose(30), None, None, None), (None, None, None, None, None)]
    return [(*r, 1, 2, "b", "c", 3, "d", 4) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, none, documents):
    from leafmill.llm.mixing import mix_sources, taken_words

    mix = mix_sources(docs, block_words=64, shard_words=3000)
    got = taken_words(mix).collect()
    assert len(got) == len(documents)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in mix.rows.join(taken_words(mix).groupBy("doc_id").agg(F.sum("taken").alias("taken")), "doc_id", "left").collect():
        by[r["number"]][1] += r["size"]
        by[r["number"]][2] = r["target"]
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
    taken = {r["number"]: r["w"] for r in mix.pieces.groupBy("number").agg(F.sum("words").alias("w")).collect()}
    for number, (_, size, target) in by.items():
        assert target <= 3 * size + 1e-6 and abs(taken.get(number, 0) - target) <= 1
    assert abs(sum(v[2] for v in by.values()) - sum(v[1] for v in by.values())) < 1e-6
    pieces = mix.pieces.collect()
    assert len({(p["number"], p["block"]) for p in pieces}) == len({(p["number"], p["block"], p["shard"]) for p in pieces})
    assert len({p["shard"] for p in pieces}) > 1
    assert {tuple(r) for r in got} == {tuple(r) for r in taken_words(mix_sources(docs, block_words=64, shard_words=3000)).collect()}
    assert taken_words(mix_sources(none)).count() == 0


def test_splitting_tree(spark):
    from leafmill.llm.mixing import hypergeometric, split_quotas

    quotas = {0: 5, 1: 1000, 2: 0, 3: 37}
    rows = split_quotas(spark.createDataFrame(list(quotas.items()), "number int, quota long"), 7, 3).collect()
    assert {s: sum(r["blocks"] for r in rows if r["number"] == s) for s in quotas} == quotas
    sizes = [sum(r["blocks"] for r in rows if r["shard"] == s) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(r["blocks"] >= 0 for r in rows)
    u = (F.col("id") + 0.5) / 4000
    got = collections.Counter(r["x"] for r in spark.range(4000).select(hypergeometric(F.lit(50), F.lit(20), F.lit(10), u).alias("x")).collect())
    for x in range(11):
        p = math.comb(20, x) * math.comb(30, 10 - x) / math.comb(50, 10)
        assert abs(got[x] / 4000 - p) < 1e-3


def test_packing(docs, none, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    from leafmill.llm.packing import fullest, pack_documents

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack_documents(docs, capacity=128).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in {r[0]: r[1] for r in documents if r[0] is not None}.items():
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for r in pieces[d]:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        copies = sum(1 for x in documents if x[0] == d)
        assert sum(r["length"] for r in pieces[d]) == copies * len(ids)
        assert len(ids) > 128 or len(pieces[d]) == copies
        assert all(r["length"] == 128 for r in pieces[d] if r["piece"])
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= sum(r["length"] for r in rows) / 128 * 1.02 + 1
    assert pack_documents(none).count() == 0
    for _ in range(50):
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(5)}
        room, sums = random.randint(0, 60), {0}
        for x, c in counts.items():
            sums |= {s + i * x for s in sums for i in range(c + 1)}
        chosen = fullest(counts, room)
        assert sum(x * c for x, c in chosen.items()) == max(s for s in sums if s <= room)
        assert all(c <= counts[x] for x, c in chosen.items())


def test_tokenizer_is_the_named_one():
    import public_tokenizers
    from tokenizers import Tokenizer

    from leafmill.llm.packing import tokenizer

    exact, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokenizer()
    pool = [chr(c) for c in [*range(0, 0x180), 0x2013, 0x2019, 0x20AC, 0x4E2D, 0x1F600]] + [" the", "'s", " 12", "\n\n", "  ", "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 40)))
        assert ours(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def brute_classes(documents, threshold):
    from leafmill.llm import near_dedup as nd
    from leafmill.llm import textbytes as tb

    raw = [(r[1] or "").encode() for r in documents]
    df = np.zeros(1 << 18, np.int64)
    for b in raw:
        w = tb.words(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        df += np.bincount(np.unique((w & np.uint64((1 << 18) - 1)).astype(int)), minlength=1 << 18)
    idf = nd.inverse_frequency(df, len(raw))
    bags = []
    for b in raw:
        _, s, m, c = nd.weighted_shingles(np.frombuffer(b, np.uint8), np.array([0, len(b)]), idf)
        bags.append({x: (y, z) for x, y, z in zip(s.tolist(), m.tolist(), c.tolist())})
    root = list(range(len(raw)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(raw)):
        for j in range(i):
            common = sum(min(bags[i][x][1], bags[j][x][1]) * bags[i][x][0] for x in bags[i].keys() & bags[j].keys())
            total = sum(m * c for m, c in [*bags[i].values(), *bags[j].values()])
            if raw[i] == raw[j] or (common and common >= threshold * (total - common)):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    groups = collections.defaultdict(set)
    for i in range(len(raw)):
        groups[find(i)].add(documents[i][0])
    return {frozenset(g) for g in groups.values()}


def test_near_duplicates(docs, none, documents):
    from leafmill.llm.near_dedup import consistent_samples, near_duplicates

    rows = near_duplicates(docs).collect()
    assert len(rows) == len(documents)
    groups, kept = collections.defaultdict(set), collections.Counter()
    for r in rows:
        groups[r["class_id"]].add(r["doc_id"])
        kept[r["class_id"]] += r["kept"]
    got = {frozenset(g - {None}) for g in groups.values()} - {frozenset()}
    assert got == {frozenset(g - {None}) for g in brute_classes(documents, 0.8)} - {frozenset()}
    assert all(kept[c] >= 1 for c in groups)
    assert near_duplicates(none).count() == 0
    rng = np.random.default_rng(0)
    x, w = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64)), rng.uniform(3, 9, 300)
    w2 = w * rng.choice([0.5, 1, 1, 1, 2], 300)
    s = consistent_samples(np.repeat([0, 1], 300), np.r_[x, x], np.r_[w, w2], 2, 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, w2).sum() / np.maximum(w, w2).sum()) < 0.03


def test_large_cluster_of_near_copies(spark):
    from leafmill.llm import near_dedup

    base = prose(150)
    rows = [(i, edit(base, 0.004)) for i in range(400)] + [(1000 + i, prose(150)) for i in range(50)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("class_id").count().collect()
    sizes = sorted(r["count"] for r in got)
    assert sizes[:50] == [1] * 50 and sizes[-1] >= 395  # more than one block


def test_near_copies_in_rows_that_share_an_id(spark, tmp_path):
    """Rows of one id, or of none, with different texts are documents of their own, in the operator and in the pipeline's stage."""
    import corpus_pipeline
    from leafmill.llm.near_dedup import near_duplicates

    a, b, c, d = (prose(60) for _ in range(4))
    rows = [(1, a), (7, a + " one"), (7, b + " one"), (2, b), (None, c), (None, d), (3, d + " two"), (9, c), (9, c)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["class_id"], r["kept"]) for r in near_duplicates(table).collect())
    want = [(1, 1, True), (7, 1, False), (7, 2, False), (2, 2, True), (None, 9, False), (None, 3, False), (3, 3, True), (9, 9, True), (9, 9, True)]
    assert got == collections.Counter(want)
    stayed = corpus_pipeline.keep_one_of_near_copies(spark, table, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in stayed) == sorted([(1, a), (2, b), (3, d + " two"), (9, c)])
    lonely = near_duplicates(spark.createDataFrame([(None, a), (None, b), (None, a + " one")], "doc_id long, text string")).collect()
    assert len({r["class_id"] for r in lonely}) == 2 and all(r["class_id"] is not None for r in lonely) and sum(r["kept"] for r in lonely) == 2


def brute_repeats(rows, length):
    seen, out = {}, {}
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], (d, i)) != (d, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length, often, split", [(16, 64, 1000), (100, 64, 1000), (16, 2, 2), (100, 2, 1)])
def test_repeated_bytes(docs, none, documents, length, often, split, monkeypatch):
    from leafmill.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 10_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    monkeypatch.setattr(suffix_dedup, "SPLIT_TASK", split)
    monkeypatch.setattr(suffix_dedup, "SPLIT_ALL", 50 * split)
    known = {r[0]: r[1] for r in documents if r[0] is not None}
    want = brute_repeats(sorted(known.items()), length)
    rows = suffix_dedup.remove_repeats(docs, length=length, keep_text=True, carry=["chunk", "blob"]).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert (r["chunk"], r["blob"]) == (2, "b")
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
            assert sum(b - a for a, b in zip(r["span_start"], r["span_end"])) == r["n_removed"]
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_in_rows_that_share_an_id(spark):
    from leafmill.llm.suffix_dedup import remove_repeats

    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    old = some(400)
    rows = [(1, old), (None, old + some(300)), (None, some(700)), (None, None), (7, some(500)), (7, old[:300] + some(300)), (42, some(200))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in remove_repeats(table.withColumn("t", F.col("text")), carry=["t"]).withColumnRenamed("t", "text").collect()}
    want = {row: 0 for row in rows} | {rows[1]: 400, rows[5]: 300}
    assert got == want


def test_suffix_array():
    from leafmill.llm.suffix_dedup import equal_prefix_groups, suffix_ranks

    rng = np.random.default_rng(0)
    for _ in range(200):
        n, length = int(rng.integers(1, 200)), int(rng.integers(1, 40))
        text = rng.integers(0, int(rng.integers(1, 4)), n).astype(np.uint8)
        if n > 60:
            text[40:60] = text[:20]
        ranks = suffix_ranks(text.astype(np.int64) + 1, n + 1)
        assert sorted(range(n), key=lambda i: bytes(text[i:])) == np.argsort(ranks).tolist()
        if n > length:
            starts = np.arange(n - length + 1)
            names = {}
            for i, g in zip(starts, equal_prefix_groups(text, starts, length)):
                assert names.setdefault(bytes(text[i : i + length]), g) == g
            assert len(set(names.values())) == len(names)


def test_passages(docs, none, documents):
    from leafmill.llm.passage_dedup import near_passages

    rows = near_passages(docs, least_words=50).collect()
    known = {r[0]: r[1] or "" for r in documents if r[0] is not None}
    words = {d: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower()) for d, t in known.items()}
    found = collections.defaultdict(set)
    for r in rows:
        assert r["similarity"] >= 0.8
        for d, a, b in ((r["doc_id"], r["start_word"], r["end_word"]), (r["other_id"], r["other_start"], r["other_end"])):
            assert b - a >= 50
            found[d].update(range(a, b))
    place = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 59):
            place[tuple(w[i : i + 60])].add((d, i))
    for where in place.values():
        if len({d for d, _ in where}) > 1:
            for d, i in where:
                assert found[d] & set(range(i, i + 60)), (d, i)
    assert near_passages(none).count() == 0


def test_passages_with_edits(spark):
    from leafmill.llm import textbytes as tb
    from leafmill.llm.passage_dedup import near_passages

    rng = random.Random(3)
    some = lambda n: [rng.choice(WORDS) for _ in range(n)]
    texts, due = [], []
    for i in range(300):
        passage, at = some(50), [rng.randint(30, 60) for _ in range(2)]
        other = list(passage)
        other[rng.choice([0, 1, 2, 3, 10, 25, 40, 46, 47, 48, 49])] = "edited"
        pair = [some(at[0]) + passage + some(40), some(at[1]) + other + some(40)]
        texts += pair
        tokens = []
        for words in pair:
            raw = np.frombuffer(" ".join(words).encode(), np.uint8)
            word, row, _, _ = tb.words(raw, np.array([0, len(raw)]))
            tokens.append(tb.shingles(word, row, 1)[0])
        one, two = (t[p : p + 46] for t, p in zip(tokens, at))
        agree = sum(tb.mix(one, 500 + f).argmin() == tb.mix(two, 500 + f).argmin() and tb.mix(one, 500 + f).min() == tb.mix(two, 500 + f).min() for f in range(6))
        if agree >= 4 and len(set(one) & set(two)) / len(set(one) | set(two)) >= 0.8:
            due.append((2 * i, at))
    assert len(due) > 200
    found = collections.defaultdict(set)
    for r in near_passages(spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")).collect():
        assert r["similarity"] >= 0.8
        if r["other_id"] == r["doc_id"] + 1:
            found[r["doc_id"]].add((r["start_word"], r["end_word"], r["other_start"], r["other_end"]))
    lost = [(d, at) for d, at in due if not any(s <= at[0] and at[0] + 50 <= e and u <= at[1] and at[1] + 50 <= v for s, e, u, v in found[d])]
    assert not lost, (len(lost), len(due))


def test_compact_windows_cover_each_passage_once():
    from leafmill.llm.passage_dedup import compact_windows

    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 30, 70).astype(np.uint64)
    row = np.repeat([0, 1], [40, 30])
    got = compact_windows(tokens, row, 2, 6, 2)
    for r, (at, n) in enumerate(((0, 40), (40, 30))):
        for f in range(2):
            own = [(le, c, ri) for rr, ff, _, le, c, ri in zip(*got) if rr == r and ff == f]
            for x in range(n):
                for y in range(x + 5, n):
                    assert sum(le <= x <= c <= y <= ri for le, c, ri in own) == 1


def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.15 * rng.normal(size=16)).tolist(), 1, "x", 2) for i in range(160)]
    rows += [(200 + i, rng.normal(size=16).tolist(), 1, "x", 2) for i in range(150)] + [(400, rows[7][1], 1, "x", 2), (401, rows[7][1], 1, "x", 2)]
    rows += [(500, None, 1, "x", 2), (501, [0.0] * 16, 1, "x", 2), (502, [None] + [1.0] * 15, 1, "x", 2), (503, [float("nan")] * 16, 1, "x", 2), (504, [float("inf")] * 16, 1, "x", 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, id string, n int").repartition(4)


def test_metric_join(spark, monkeypatch):
    from leafmill.llm import metric_join

    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 20)
    rows, table = vectors(spark)
    good = [(i, np.array(v)) for i, v, *_ in rows if i < 500]
    links = {i: {j for j, w in good if j != i and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9} for i, v in good}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near_vectors(table, cosine=0.9, pivots=8).collect()}
    assert len(got) == len(rows)
    for i, *_ in rows:
        reach, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert got[i] == (len(links.get(i, ())), min(reach), i == min(reach)), i
    assert metric_join.near_vectors(table.limit(0)).count() == 0


def test_metric_join_with_repeated_ids_and_lengths(spark):
    from leafmill.llm import metric_join

    v, w, x = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [1.0, 0.05, 0.1]
    rows = [(1, v), (1, v), (2, w), (2, x), (3, w), (4, [1.0, 0.0]), (4, v), (None, v), (5, None)]
    got = collections.Counter(tuple(r) for r in metric_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    # 1 and 4 hold v, one of the rows of 2 holds x beside them; the other one holds w as 3 does
    want = [(1, 2, 1, True)] * 2 + [(2, 1, 2, True), (2, 2, 1, False), (3, 1, 2, False), (4, 0, 4, True), (4, 2, 1, False), (None, 0, None, False), (5, 0, 5, True)]
    assert got == collections.Counter(want)


def test_metric_join_with_parallel_pivots(spark):
    from leafmill.llm import metric_join

    rng = np.random.default_rng(9)
    base = rng.normal(size=64)
    rows = [(i, (base * rng.uniform(0.5, 2)).tolist()) for i in range(150)]
    rows += [(200 + i, (base + rng.uniform(0.2, 0.6) * rng.normal(size=64)).tolist()) for i in range(250)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = metric_join.units(np.array([v for _, v in rows]))
    want = ((u[:, None, :] * u[None, :, :]).sum(2) >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in metric_join.near_vectors(table, cosine=0.9, pivots=40).collect()}
    assert [got[i] for i, _ in rows] == want.tolist()


def test_hash_search_probes_clusters():
    from leafmill.llm.hash_search import ShardIndex, encode, learn_rotations, search_shard

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 32))
    x = np.repeat(centres, 40, 0) + 0.15 * rng.normal(size=(8000, 32))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    none, ids, asked = np.zeros(len(x)), np.arange(len(x)), np.arange(0, len(x), 40)
    codes = encode(x, learn_rotations(np.c_[x, none], 256), none)
    out, probed = search_shard(ids, x, ShardIndex(codes), ids[asked], x[asked], codes[asked], 20, 109, 201, 1.0)
    assert probed.mean() > 0.9
    hits = 0
    for i, (near, score) in zip(asked, out):
        true = x @ x[i]
        true[i] = -9
        hits += len(set(near.tolist()) & set(np.argsort(-true, kind="stable")[:20].tolist()))
        assert np.allclose(score, true[near])
    assert hits >= 0.99 * 20 * len(asked)


def test_hash_search(spark):
    from leafmill.llm.hash_search import ShardIndex, nearest_by_codes

    rows, table = vectors(spark)
    good = [(i, np.array(v)) for i, v, *_ in rows if i < 500]
    got = collections.defaultdict(list)
    for r in nearest_by_codes(table, queries=F.col("id") % 20 == 0, k=20, shard_rows=100, least=60).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q, v in [(i, v) for i, v in good if i % 20 == 0]:
        want = sorted(((-(v @ w), j) for j, w in good if j != q))[:20]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        assert all(abs(s - v @ dict(good)[j]) < 1e-9 for j, s in got[q])
        hits += len({j for _, j in want} & {j for j, _ in got[q]})
    assert hits >= 0.9 * 20 * len(got)
    assert nearest_by_codes(table.limit(0), queries=F.col("id") % 20 == 0).count() == 0
    assert len(nearest_by_codes(table.where("vec_id < 5"), queries=F.col("id") % 20 == 0).collect()) == 4
    codes = np.random.default_rng(2).integers(0, 2**63, (500, 2), dtype=np.uint64)
    codes[100:] = codes[:400] ^ (np.uint64(1) << np.arange(400).astype(np.uint64) % np.uint64(60))[:, None]
    index = ShardIndex(codes)
    for radius in range(0, 30, 7):
        for c in codes[:20]:
            assert index.probe(c, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ c).sum(1) <= radius).tolist()


def test_toxicity(spark, docs, none):
    from leafmill.llm.toxicity import fit_toxicity, score_toxicity

    rows, labels = [], []
    for i in range(1200):
        sentences = [prose(8).replace(".", "") for _ in range(6)]
        if i % 4 == 0:
            sentences[i % 6] += " vilebad" + random.choice(["er", "est", "ness"])
        rows.append((i, ". ".join(sentences), 1))
        labels.append((i, None if i % 50 == 7 else int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, y int")
    known = spark.createDataFrame([*labels, (None, 1), (3, 0)], "doc_id long, toxic int")
    model = fit_toxicity(table, known.where("doc_id < 1000 or doc_id is null"))
    held = [r for r in score_toxicity(table, model).collect() if r["doc_id"] >= 1000]
    assert np.mean([(r["toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    for r in held:
        if r["offending"]:
            assert any("vilebad" in r["text"].encode()[o["start"] : o["end"]].decode() for o in r["offending"])
    scored = score_toxicity(docs, model)
    assert scored.columns == [*docs.columns, "toxicity", "offending"] and scored.count() == docs.count()
    assert {r["toxicity"] for r in scored.where("text is null or trim(text) = ''").collect()} == {0.0}
    assert score_toxicity(none, model).count() == 0
    unlearned = fit_toxicity(none, known.limit(0))
    assert score_toxicity(docs, unlearned).agg(F.max("toxicity")).first()[0] < 0.5


def test_pipeline_drops_what_toxicity_rejects(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from leafmill.llm import toxicity

    table = spark.createDataFrame([(1, "all good here"), (2, "mean words. mean looks. mean ends."), (3, None)], "doc_id long, text string")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # a model that gives every sentence a probability of about 0.3
    model = toxicity.ToxicityModel(np.zeros(1 << 18, np.float32), -0.85, 18)
    monkeypatch.setattr(corpus_pipeline, "fit_toxicity", lambda *_: model)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(table, model).collect()}
    assert scored[2]["toxicity"] >= 0.5 and not scored[2]["offending"]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, table, str(tmp_path)).collect()}
    assert kept == {i for i, r in scored.items() if r["toxicity"] < 0.5} and 3 in kept and 2 not in kept


def test_language(spark, docs, none):
    from leafmill.llm.language_id import learn_languages, predict_language

    rows = [(i, "".join(random.choice("abcde " if i % 2 else "vwxyz é") for _ in range(60)), "left" if i % 2 else "right") for i in range(60)] + [(99, None, "left"), (None, "abc", "left"), (98, "abc", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn_languages(table.where("doc_id < 40 or doc_id >= 98 or doc_id is null"))
    assert model.languages == ["left", "right"]
    got = {r["doc_id"]: r for r in predict_language(table, model).collect()}
    assert all(got[i]["lang_pred"] == ("left" if i % 2 else "right") and got[i]["score"] > 0.9 for i in range(40, 60))
    assert (got[99]["lang_pred"], got[99]["score"]) == ("und", 0.0)
    all_ = predict_language(docs, model).collect()
    assert len(all_) == docs.count() and all(0 <= r["score"] <= 1 for r in all_)
    assert predict_language(none, model).count() == 0
    assert {r["lang_pred"] for r in predict_language(docs, learn_languages(none)).collect()} == {"und"}


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_code_lengths(order):
    from leafmill.llm.language_id import code_lengths, fit_languages

    learned = {name: [bytes(random.choice(b"abc de" if name == "x" else b"abd e\xc3") for _ in range(random.randint(0, 60))) for _ in range(5)] for name in "xy"}
    texts = [bytes(random.choice(b"abcdez \xc3") for _ in range(random.randint(0, 30))) for _ in range(20)]
    got = code_lengths(fit_languages(learned, order), np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    for column, name in enumerate("xy"):
        follow = collections.defaultdict(collections.Counter)
        for t in learned[name]:
            p = b"\n" * order + t
            for i in range(order, len(p)):
                for k in range(order + 1):
                    follow[p[i - k : i]][p[i]] += 1
        for row, t in enumerate(texts):
            p, bits = b"\n" * order + t, 0.0
            for i in range(order, len(p)):
                for k in range(order, -1, -1):
                    seen = follow.get(p[i - k : i])
                    if seen is None:
                        continue
                    n, d = sum(seen.values()), len(seen)
                    if p[i] in seen:
                        bits -= math.log2(seen[p[i]] / (n + d))
                        break
                    bits -= math.log2(d / (n + d))
                else:
                    bits += 8
            assert abs(bits - got[row, column]) < 1e-3 * max(1, bits)


def test_quality(spark, docs, none):
    from leafmill.llm.quality import fit_quality, score_quality

    rows = [(i, prose(40) if i % 3 else "BUY!! NOW!! " * 20, "s" if i % 3 else "junk", i % 2, 1) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang int, n_chars int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = fit_quality(table, labels, ["source", "lang"], "n_chars")
    got = score_quality(table, model, ["source", "lang"], "n_chars").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] >= 120]) > 0.95
    scored = score_quality(docs, model, ["source", "lang"], "n_chars").collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert score_quality(none, model, ["source"], "n_chars").count() == 0
    fit_quality(none, labels.limit(0), ["source"], None)


def test_language_with_long_texts_only(spark):
    from leafmill.llm.language_id import learn_languages, predict_language

    rng = random.Random(3)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, text("abcde ", 80), "short") for i in range(20)] + [(50 + i, text("vwxyzé ", 9000), "long") for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = predict_language(table, learn_languages(table, sample_text_bytes=4096)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {r[0]: r[2] for r in rows}


def test_components(spark):
    from leafmill.llm.components import components

    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 400), (400, 500)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {400: 400, 500: 400}


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, int(i == 12)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, none):
            out = stage(spark, table, str(tmp_path))
            last = name == corpus_pipeline.STAGES[-1][0]
            assert last or out.columns == docs.columns
            rows = out.collect()
            assert rows or table is none
            if table is docs and not last:
                assert {r["blob"] for r in rows} == {"b"}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


#: Every name that a stage adds on its way.
ADDED = ["toxicity", "offending", "__key", "kept", "shard", "round", "shuffle_key", "row", "own_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_start"]
ADDED += ["span_end", "carried0", "c0", "c1", "id", "y", "class_id", "class_key", "rep", "digest", "bands", "__id", "__text", "absent", "name", "slot", "block", "start"]


def test_pipeline_stages_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, int(i == 12)) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i % 9 if i < 12 else None, prose(40), "en", "ab"[i % 2], 1, *[f"{c}{i}" for c in ADDED]) for i in range(15)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ADDED))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns
        got = out.collect()
        assert {r["shard"][5:] for r in got} <= {str(i) for i in range(15)} and all(r["row"][3:] == r["shard"][5:] for r in got)
        # different texts under one id, or none, are different documents
        assert {r["shard"] for r in got} == {f"shard{i}" for i in range(15)} or name == "source_mixing", name
