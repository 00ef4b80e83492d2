"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

*Codes.* Inner products become angles by one more component, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries).
Rotations are learned on a bounded sample by alternating signs and Procrustes steps; several rotations give ``bits`` bits.
*Index.* Every vector has a code; shards of about ``shard_rows`` vectors hold, for each substring of 16 bits, the vectors in
the order of its value, so a value is a bucket.
*Search.* Two codes within a radius agree in some substring up to radius // substrings bits (pigeonhole). A query first probes
the buckets that equal its substrings, then those one bit away, two bits and so on, and ranks what it finds by the true
inner product of the original vectors. Codes at an angle a differ in about bits * a / pi bits, so it stops at the radius that
covers this distance for the angle of its k-th best, with ``SURE`` standard deviations to spare. If the next buckets to look
up and their entries would pass the number of codes in the shard, the query is left to a comparison with the codes one by one, which keeps those
within ``radius`` bits, or the ``least`` nearest if these are more.
Shards answer blocks of queries independently; the best of all shards are merged by rank.
"""

from __future__ import annotations

from functools import cache
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.metric_join import clean_vectors, matrix
from leafmill.llm.tables import parts, written

SUBSTRING = 16
QUERY_BLOCK = 2048
SURE = 3.0


def learn_rotations(x: np.ndarray, bits: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """An orthogonal matrix for each ``d`` bits, turned so that rows of x lie near the corners of a cube."""
    rng, d, out = np.random.default_rng(seed), x.shape[1], []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ vt
        out.append(r)
    return np.concatenate(out, 1)[:, :bits]


def encode(x: np.ndarray, rotation: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    bits = (np.concatenate([x, extra[:, None]], 1) @ rotation) > 0
    return np.packbits(bits, axis=1).view(np.uint64)


@cache
def _flips(near: int) -> np.ndarray:
    """The values of a substring with ``near`` bits set."""
    values = np.arange(1 << SUBSTRING, dtype=np.uint16)
    return values[np.bitwise_count(values) == near]


def covered(angle: float, radius: int, bits: int) -> bool:
    """Whether codes of vectors within the angle lie within the radius, but for ``SURE`` standard deviations."""
    p = min(1.0, angle / pi)
    return bits * p + SURE * sqrt(max(1.0, bits * p * (1 - p))) <= radius


class ShardIndex:
    """Codes of a shard and the buckets of their substrings."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view(np.uint16)
        self._buckets: list[tuple[np.ndarray, np.ndarray]] | None = None

    def buckets(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if self._buckets is None:
            self._buckets = []
            for column in self.parts.T:
                order = np.argsort(column, kind="stable")
                self._buckets.append((order, np.searchsorted(column[order], np.arange((1 << SUBSTRING) + 1))))
        return self._buckets

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within the radius, by pigeonhole over substrings."""
        m = self.parts.shape[1]
        near, rest = radius // m, radius % m
        values = np.arange(1 << SUBSTRING, dtype=np.uint16)
        found = np.zeros(len(self.codes), bool)
        for j, (part, (order, start)) in enumerate(zip(code.view(np.uint16), self.buckets())):
            reach = near if j <= rest else near - 1
            if reach < 0:
                continue
            hit = np.flatnonzero(np.bitwise_count(values ^ part) <= reach)
            lo, n = start[hit], start[hit + 1] - start[hit]
            found[order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = True
        at = np.flatnonzero(found)
        return at[np.bitwise_count(self.codes[at] ^ code).sum(1) <= radius]

    def widen(self, code: np.ndarray, enough) -> np.ndarray | None:
        """Positions of all codes within the first radius at which ``enough(positions, radius)`` holds; None if the buckets would
        cost more than the codes themselves. The radius grows by one bit in every substring."""
        m, cost, own = self.parts.shape[1], 0, code.view(np.uint16)
        found = np.zeros(len(self.codes), bool)
        for near in range(SUBSTRING + 1):
            cost += m * comb(SUBSTRING, near)
            if cost > len(self.codes):
                return None
            hit = [(order, start, own[j] ^ _flips(near)) for j, (order, start) in enumerate(self.buckets())]
            ranges = [(order, start[v], start[v + np.int64(1)]) for order, start, v in hit]
            cost += sum(int((hi - lo).sum()) for _, lo, hi in ranges)
            if cost > len(self.codes):
                return None
            for order, lo, hi in ranges:
                full = np.flatnonzero(hi > lo)
                lo, n = lo[full], (hi - lo)[full]
                found[order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = True
            radius = m * (near + 1) - 1
            at = np.flatnonzero(found)
            at = at[np.bitwise_count(self.codes[at] ^ code).sum(1) <= radius]
            if enough(at, radius):
                return at
        return None

    def within(self, codes: np.ndarray, radius: int, least: int) -> list[np.ndarray]:
        """By comparison with every code: for each query code the positions of all codes within the radius, which grows to hold ``least`` codes at least."""
        out, least = [np.zeros(0, np.int64)] * len(codes), min(least, len(self.codes))
        for lo in range(0, len(codes), 256):
            rows = list(range(lo, min(lo + 256, len(codes))))
            far = np.zeros((len(rows), len(self.codes)), np.uint16)
            for w in range(codes.shape[1]):
                far += np.bitwise_count(codes[rows, w][:, None] ^ self.codes[None, :, w])
            bound = np.maximum(radius, np.partition(far, least - 1, axis=1)[:, least - 1])
            for i, row, b in zip(rows, far, bound):
                out[i] = np.flatnonzero(row <= b)
        return out


def search_shard(ids: np.ndarray, x: np.ndarray, shard: ShardIndex, q_ids: np.ndarray, q: np.ndarray, codes: np.ndarray, k: int, radius: int, least: int, longest: float):
    """For each query the ids and scores of its best k rows, and whether probing settled it."""
    bits, out = 64 * codes.shape[1], [None] * len(q)

    def ranked(i: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = near[ids[near] != q_ids[i]]
        score = (x[near] * q[i]).sum(1)
        best = np.lexsort((ids[near], -score))[:k]
        return ids[near][best], score[best]

    for i in range(len(q)):
        size = sqrt(float(q[i] @ q[i])) * longest

        def enough(near: np.ndarray, reached: int) -> bool:
            if len(near) <= k:
                return False
            out[i] = ranked(i, near)
            return covered(acos(max(-1.0, min(1.0, float(out[i][1][-1]) / size))), reached, bits)

        if shard.widen(codes[i], enough) is None:
            out[i] = None
    probed = np.array([o is not None for o in out], bool)
    left = np.flatnonzero(~probed)
    for i, near in zip(left, shard.within(codes[left], radius, least)):
        out[i] = ranked(i, near)
    return out, probed


def _searcher(k: int, radius: int, least: int, longest: float):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if len(index) and len(queries):
            order = np.argsort(index.column("id").to_numpy())
            ids, x = index.column("id").to_numpy()[order], matrix(index.column("v"))[order]
            words = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint64).reshape(len(t), -1)
            q_ids, q, codes = queries.column("id").to_numpy(), matrix(queries.column("v")), words(queries)
            for q_id, (near, score) in zip(q_ids, search_shard(ids, x, ShardIndex(words(index)[order]), q_ids, q, codes, k, radius, least + 1, longest)[0]):
                out_q.append(np.full(len(near), q_id))
                out_v.append(near)
                out_s.append(score)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query_id": pa.array(join(out_q, np.int64), pa.int64()), "vec_id": pa.array(join(out_v, np.int64), pa.int64()), "score": pa.array(join(out_s, np.float64), pa.float64())})

    return search


def nearest_by_codes(
    table: DataFrame, queries, k: int = 20, bits: int = 256, radius: int = 109, least: int = 200, fit_rows: int = 8192, shard_rows: int = 16384, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """For each row that meets the condition ``queries`` (on the id) the k rows with the largest inner product that were found.

    Returns ``query_id, rank, vec_id, score``; the nearest first, ties to the smaller id, never the query itself. The rotations are
    learned on ``fit_rows`` rows; the index holds every row. Vectors that are null, zero or hold null or non-finite components and
    rows without an id take no part; all others must have one length. Ids are unique. An empty table gives an empty table.
    """
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    spark = table.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    good = clean_vectors(table, id_column, vector_column)
    row = good.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m"), F.sum(queries.cast("long")).alias("q") if queries is not None else F.lit(0)).first()
    n, longest, n_queries = int(row["n"]), float(row["m"] or 0.0), int(row["q"] or 0)
    sample = [r["v"] for r in good.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    x = np.array(sample, np.float64)
    extra = np.sqrt(np.maximum(0, longest**2 - (x * x).sum(1)))
    rotation = spark.sparkContext.broadcast(learn_rotations(np.concatenate([x, extra[:, None]], 1), bits))

    def coded(batches):
        for batch in batches:
            v = matrix(batch.column("v"))
            gap = np.sqrt(np.maximum(0, longest**2 - (v * v).sum(1))) if len(v) else np.zeros(0)
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            for rows, role, e in ((np.arange(len(v)), False, gap), (asks, True, np.zeros(len(asks)))):
                if len(rows):
                    codes = encode(v[rows], rotation.value, e)
                    take = pa.array(rows, pa.int64())
                    yield pa.record_batch({"id": batch.column("id").take(take), "asks": pa.array([role] * len(rows)), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "v": batch.column("v").take(take)})

    both = written(good.withColumn("asks", queries).mapInArrow(coded, "id long, asks boolean, code binary, v array<double>"), "codes")
    shards, blocks = parts(n, shard_rows), parts(n_queries, QUERY_BLOCK)
    number = F.xxhash64("id")
    index = both.where("not asks").withColumn("shard", F.pmod(number, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = both.where("asks").withColumn("block", F.pmod(F.shiftright(number, 20), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_searcher(k, radius, least, longest), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
