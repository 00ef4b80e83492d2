"""The ring with bounded loads against a walk of one document after the other."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot string, home string, row string, arc int, h int, node int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "t", "u", "v", 1, 2, 3) for r in rows], SCHEMA).repartition(5)


def check(got, rows, shards):
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
    per = collections.defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    sizes = [len(per[s]) for s in range(shards)]
    assert set(per) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_rows_are_balanced_and_few_move(spark):
    rows = [(i, f"text {i}") for i in range(3000)]
    docs = table(spark, rows)
    eight, again, nine = (sharding.shard_documents(d, shards=n, virtual_nodes=64, positions=1 << 12).collect() for d, n in ((docs, 8), (docs.repartition(3), 8), (docs, 9)))
    check(eight, rows, 8)
    check(nine, rows, 9)
    at = lambda got, c="shard": {r["doc_id"]: r[c] for r in got}
    assert at(eight) == at(again) and at(eight, "slot") == at(again, "slot")
    # only the excess of overfull shards leaves its home
    homes = collections.Counter(at(eight, "home").values())
    assert sum(r["home"] != r["shard"] for r in eight) == sum(max(0, n - 375) for n in homes.values())
    # on the ring alone a further shard takes rows only into itself
    assert all(b in (a, 8) for a, b in zip(at(eight, "home").values(), (at(nine, "home")[i] for i in at(eight, "home"))))
    moved = sum(at(eight)[i] != at(nine)[i] for i in at(eight))
    assert moved < 3000 * (1 / 9 + 0.25)


def test_walk_against_a_model(spark):
    """Ranges of ranks go clockwise, round by round, as single rows would."""
    rng = random.Random(4)
    shards, loads = 4, [rng.choice([0, 3, 5, 40]) for _ in range(24)]
    owners = [0, 1, 2, 3] + [rng.randrange(shards) for _ in range(20)]
    total = sum(loads)
    ring = spark.createDataFrame([(i, i * 10, s) for i, s in enumerate(owners)], "node int, position long, shard int")
    dealt = sharding.walk(spark.createDataFrame(list(enumerate(loads)), "arc int, n long"), ring, total, shards).collect()
    got = {(r["arc"], k): r["shard"] for r in dealt for k in range(r["lo"], r["hi"])}
    free = [total // shards * (s + 1) + total % shards * (s + 1) // shards - total // shards * s - total % shards * s // shards for s in range(shards)]
    waiting, want = [(arc, k, arc) for arc, n in enumerate(loads) for k in range(n)], {}
    while waiting:
        left = []
        for arc, k, node in sorted(waiting):
            if free[owners[node]]:
                free[owners[node]] -= 1
                want[arc, k] = owners[node]
            else:
                left.append((arc, k, node))
        waiting = [(arc, k, next(x % 24 for x in range(node + 1, node + 25) if free[owners[x % 24]])) for arc, k, node in left]
    assert got == want


@pytest.mark.parametrize("block_bits, cell_rows", [(16, 4096), (2, 8)])
def test_hot_ids_copies_nulls(spark, monkeypatch, block_bits, cell_rows):
    monkeypatch.setattr(sharding, "BLOCK_BITS", block_bits)
    monkeypatch.setattr(sharding, "CELL_ROWS", cell_rows)
    rows = [(7, f"t{i}") for i in range(120)] + [(8, "copy")] * 100 + [(None, f"n{i}") for i in range(60)] + [(None, None)] * 9 + [(1, ""), (2, None), (3, "x" * 50000)]
    check(sharding.shard_documents(table(spark, rows), shards=8, virtual_nodes=16, positions=1 << 10).collect(), rows, 8)


def test_few_rows_and_none(spark):
    assert sharding.shard_documents(table(spark, [])).count() == 0
    check(sharding.shard_documents(table(spark, [(1, "a"), (2, "b"), (3, None)])).collect(), [(1, "a"), (2, "b"), (3, None)], 8)
    with pytest.raises(ValueError):
        sharding.shard_documents(table(spark, []), virtual_nodes=1 << 16)


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)]
    sharding.write_shards(table(spark, rows), f"{tmp_path}/shards", shards=4)
    got = spark.read.parquet(f"{tmp_path}/shards")
    check(got.collect(), rows, 4)
    assert got.groupBy("shard").agg(F.count("*").alias("n")).where("n not in (12, 13)").count() == 0
