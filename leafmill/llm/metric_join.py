"""Near-duplicate vectors: an exact metric range join over pivots.

Cosine of unit vectors is a metric matter: cos(x, y) >= c means |x - y| <= r with r = sqrt(2 - 2 c). A bounded sample of
vectors are pivots. A vector's home is the cell of its nearest pivot; it is copied to each earlier cell that a partner
within r could live in: by the triangle inequality such a cell j has d(x, p_j) - d(x, p_home) <= 2 r, its bisector with
the home is no farther than r, and d(x, p_j) <= R_j + r for the cell's radius R_j. Then every close pair meets in exactly one
cell, the earlier of the two homes.

Cells join independently. The homes of a cell are cut into blocks, its copies from other cells too; blocks of homes meet
each other and the blocks of copies, each such pair in a task of its own, so a group that holds a third of all vectors is
spread as well. A task counts the links of its vectors and returns a spanning forest of
them, never the pairs. Equal vectors collapse first onto one weighted vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.components import components
from leafmill.llm.near_dedup import _forest
from leafmill.llm.tables import parts, with_keys, written

BLOCK_ROWS = 8192
#: Rows for each pivot, and the most pivots (they are sent to every task).
PIVOT_ROWS, MOST_PIVOTS = 4096, 1024
#: Pivots closer than this to an earlier one are left out: a bisector between them would be made of rounding errors.
LEAST_GAP = 1e-3
#: Distances near 0 come out of products with an error of about 2e-8.
SLACK = 1e-7


def clean_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v`` (array of doubles) of the vectors that can take part: an id, not null, not zero, every component finite, and of the most
    frequent length (of equally frequent ones the longest)."""
    v = F.col(vector_column).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = table.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(good & F.col("id").isNotNull())
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows if length is None else rows.where(F.size("v") == length["d"])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def apart(p: np.ndarray) -> np.ndarray:
    """The rows that are not within ``LEAST_GAP`` of an earlier row that stays."""
    kept: list[int] = []
    for i in range(len(p)):
        if not kept or ((p[kept] - p[i]) ** 2).sum(1).min() > LEAST_GAP**2:
            kept.append(i)
    return p[kept]


def _homes(pivots, radii, reach: float):
    """Cells of vectors; with ``radii`` also the copies for earlier cells."""

    def place(batches):
        p = pivots.value
        gaps = np.array([np.sqrt(((p - x) ** 2).sum(1)) for x in p])
        for batch in batches:
            u = units(matrix(batch.column("v")))
            for lo in range(0, len(u), 4096):
                part = u[lo : lo + 4096]
                dot = part @ p.T
                home = dot.argmax(1)
                far = np.sqrt(np.maximum(0, 2 - 2 * dot))
                own = far[np.arange(len(part)), home]
                ids = batch.column("id").slice(lo, len(part))
                if radii is None:
                    cell = pa.array(home, pa.int32())
                    yield pa.record_batch({"cell": cell, "d": pa.array(own)})
                    continue
                near = far - own[:, None] <= 2 * reach + SLACK
                near &= far <= radii.value[None, :] + reach + SLACK
                with np.errstate(divide="ignore", invalid="ignore"):
                    bisector = (dot[np.arange(len(part)), home][:, None] - dot) / gaps[home]
                near &= ~(bisector > reach + SLACK)
                near &= np.arange(len(p))[None, :] < home[:, None]
                row, cell = np.nonzero(near)
                row, cell = np.r_[np.arange(len(part)), row], np.r_[home, cell]
                take = pa.array(row, pa.int64())
                yield pa.record_batch(
                    {"cell": pa.array(cell, pa.int32()), "id": ids.take(take), "guest": pa.array(np.arange(len(row)) >= len(part)), "n": batch.column("n").slice(lo, len(part)).take(take), "v": batch.column("v").slice(lo, len(part)).take(take)}
                )

    return place


class _Union:
    """Components of local numbers, fed with many links at a time; keeps a spanning forest."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def labels(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        # one link of every node first: in a dense group that joins nearly all, and the many other links fall away
        for node in (i, j):
            first = np.unique(node, return_index=True)[1]
            self._join(i[first], j[first])
        label = self.labels()
        apart = np.flatnonzero(label[i] != label[j])
        if len(apart):
            pair = np.unique(label[i[apart]] * len(label) + label[j[apart]], return_index=True)[1]
            self._join(i[apart][pair], j[apart][pair])

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        new = _forest_over(self.labels(), i, j)
        self.edges += new
        for p, q in new:
            p, q = self._find(p), self._find(q)
            self.root[max(p, q)] = min(p, q)

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            x = int(self.root[x])
        return x


def _forest_over(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    tree = _forest(len(label), label[i], label[j])
    where = {}
    for x, y, p, q in zip(label[i].tolist(), label[j].tolist(), i.tolist(), j.tolist()):
        where.setdefault((x, y), (p, q))
    return [where[x, y] for x, y in tree]


def _join_cell(cosine: float):
    def join(table: pa.Table) -> pa.Table:
        ids, n, right = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("right").to_numpy()
        order = np.lexsort((ids, right))
        ids, n, u = ids[order], n[order], units(matrix(table.column("v")))[order]
        lefts = int((~right).sum())
        own = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        links, union = np.zeros(len(ids), np.int64), _Union(len(ids))
        for lo in range(0, lefts, 512):
            hi = min(lo + 512, lefts)
            base = lo if own else lefts
            i, j = np.nonzero(u[lo:hi] @ u[base:].T >= cosine - 1e-9)
            i, j = i + lo, j + base
            i, j = (i[i < j], j[i < j]) if own else (i, j)
            exact = np.zeros(len(i), bool)
            for k in range(0, len(i), 65536):
                exact[k : k + 65536] = (u[i[k : k + 65536]] * u[j[k : k + 65536]]).sum(1) >= cosine
            i, j = i[exact], j[exact]
            links += np.bincount(i, n[j], minlength=len(ids)).astype(np.int64) + np.bincount(j, n[i], minlength=len(ids)).astype(np.int64)
            if len(i):
                union.add(i, j)
        hit = np.flatnonzero(links)
        p, q = (np.array([e[k] for e in union.edges], np.int64) for k in (0, 1))
        a, b = np.r_[ids[hit], ids[p]], np.r_[np.full(len(hit), -1), ids[q]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(np.r_[links[hit], np.full(len(p), -1)], pa.int64())})

    return join


def near_vectors(table: DataFrame, cosine: float = 0.9, pivots: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    A link is a pair of different vectors with a cosine of ``cosine`` (above 0) or more in double precision. ``n_links`` counts the links of a
    vector, ``component_id`` is the smallest id it reaches by links, ``kept`` marks rows that have it. Rows that repeat an id with the
    same vector are one vector, each is returned with its result; with another vector they are vectors of their own. Vectors that are null,
    zero, of another length than most or hold null or non-finite components link with nothing; so do rows without an id, whose component
    is null. An empty table gives an empty table. Other columns are ignored.
    """
    spark = table.sparkSession
    good = clean_vectors(table, id_column, vector_column)
    told = with_keys(good.withColumn("h", F.xxhash64("v")).withColumn("print", F.col("h").cast("string")), "id", "print")
    keyed = written(told.select("id", "key", "h", "v"), "vectors")
    # equal vectors: one of them stands for all, with their number
    once = keyed.dropDuplicates(["key"])
    groups = once.groupBy("h", "v").agg(F.min("key").alias("id"), F.min_by("id", "key").alias("own"), F.count(F.lit(1)).alias("n"))
    stand = written(groups.select("id", "own", "n", "h", "v"), "stand")
    if pivots is None:
        pivots = min(MOST_PIVOTS, parts(stand.count(), PIVOT_ROWS))
    sample = stand.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    result = table.select(F.col(id_column).cast("long").alias("vec_id"), F.xxhash64(F.col(vector_column).cast("array<double>")).alias("vec_h"))
    if not sample:
        return result.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    p = apart(units(np.array([r["v"] for r in sample], np.float64)))
    sc, reach = spark.sparkContext, float(np.sqrt(2 - 2 * cosine))
    shared = sc.broadcast(p)  # at most ``pivots`` vectors
    cells = stand.mapInArrow(_homes(shared, None, reach), "cell int, d double").groupBy("cell").agg(F.max("d").alias("r")).collect()  # a row for each pivot
    radii = np.full(len(p), -np.inf)
    for r in cells:
        radii[r["cell"]] = r["r"]
    placed = written(stand.mapInArrow(_homes(shared, sc.broadcast(radii), reach), "cell int, id long, guest boolean, n long, v array<double>"), "cells")
    sizes = placed.groupBy("cell").agg(*[F.ceil(F.count_if(F.col("guest") == g) / BLOCK_ROWS).cast("int").alias(c) for g, c in ((False, "hb"), (True, "gb"))])
    dealt = placed.join(F.broadcast(sizes), "cell")  # a row for each pivot
    block = F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("gb")).otherwise(F.col("hb"))).cast("int")
    # blocks of homes meet themselves, each other, and all blocks of guests; guests do not meet guests
    dealt = dealt.withColumn("block", block)
    task = lambda x, y, right: F.struct(x.alias("x"), y.alias("y"), F.lit(right).alias("right"))
    here, hb, gb = F.col("block"), F.col("hb"), F.col("gb")
    numbers = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    of_home = F.concat(F.transform(numbers(here, hb + gb), lambda y: task(here, y, False)), F.transform(numbers(F.lit(0), here), lambda x: task(x, here, True)))
    of_guest = F.transform(numbers(F.lit(0), hb), lambda x: task(x, hb + here, True))
    dealt = dealt.withColumn("task", F.explode(F.when(F.col("guest"), of_guest).otherwise(of_home))).select("cell", "task.*", "id", "n", "v")
    met = written(dealt.groupBy("cell", "x", "y").applyInArrow(_join_cell(cosine), "a long, b long, links long"), "links")
    counts = met.where("links >= 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    tree = components(met.where("links < 0").select("a", "b"))
    of_stand = stand.select("id", "n", "h", "v").join(counts, "id", "left").join(tree, "id", "left")
    of_stand = of_stand.select("h", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("root"))
    named = of_stand.join(stand.select(F.col("id").alias("root"), F.col("own").alias("component_id")), "root").drop("root")
    told = keyed.dropDuplicates(["key"]).join(named, ["h", "v"]).select("id", F.col("h").alias("h"), "n_links", "component_id")
    return result.join(told, (F.col("vec_id") == F.col("id")) & (F.col("vec_h") == F.col("h")), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")) & F.col("vec_id").isNotNull()).alias("kept"),
    )
