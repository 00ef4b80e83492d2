"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. *Weights.* A shingle of five words weighs its count in the document times the mean inverse document frequency of its
   words, from a table of ``2 ** bits`` hashed words that is counted over all documents. (The document frequency of a
   shingle itself grows with its group of copies; weighing by it would hide just the large groups.)
2. *Sketches.* Improved consistent weighted sampling draws ``bands * rows`` samples; two documents agree in a sample with
   the probability of their weighted Jaccard similarity. Exact copies collapse first: one representative of each text goes on.
3. *Candidates.* Representatives that agree in all rows of a band share a bucket. Each links to the smallest of its bucket
   (no pairs are listed); the components of these links are candidate clusters.
4. *Verification.* The texts of clusters meet, small clusters together, large ones in pairs of blocks of bounded size. Pairs
   that share a bucket and whose weighted Jaccard similarity reaches the threshold are links; a task returns a spanning
   forest of its links, never the pairs. The components of these are the classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textbytes as tb
from leafmill.llm.components import components
from leafmill.llm.tables import parts, with_keys, written

UNIT_BYTES = 1 << 20
BLOCK_DOCS = 256
_PART = 4096


# --- weights -------------------------------------------------------------------------------------------------------


def word_frequencies(texts: DataFrame, bits: int) -> np.ndarray:
    """In how many rows of ``texts`` (column ``text``) each hashed word occurs: ``2 ** bits`` numbers."""

    def count(batches):
        seen = np.zeros(1 << bits, np.int64)
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column("text"))
            for lo, hi in tb.slices(offsets):
                word, row, _, _ = tb.words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                pair = np.unique((row.astype(np.int64) << bits) | (word & np.uint64((1 << bits) - 1)).astype(np.int64))
                seen += np.bincount(pair & ((1 << bits) - 1), minlength=1 << bits)
        split = seen.reshape(-1, min(_PART, 1 << bits))
        used = np.flatnonzero(split.any(1))
        yield pa.record_batch({"part": pa.array(used, pa.int32()), "blob": pa.array([split[p].tobytes() for p in used], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table.column("blob").combine_chunks())
        return pa.table({"part": table.column("part")[:1], "blob": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((max(1, (1 << bits) // _PART), min(_PART, 1 << bits)), np.int64)
    for r in texts.select("text").mapInArrow(count, "part int, blob binary").groupBy("part").applyInArrow(add, "part int, blob binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["blob"]), np.int64)
    return out.ravel()


def inverse_frequency(counts: np.ndarray, documents: int) -> np.ndarray:
    return (1 + np.log((documents + 1) / (counts + 1))).astype(np.float32)


def weighted_shingles(buf: np.ndarray, offsets: np.ndarray, idf: np.ndarray, width: int = 5):
    """Distinct shingles of each row: row, hash, idf and count; ordered by row and hash."""
    word, row, _, _ = tb.words(buf, offsets)
    n = len(offsets) - 1
    shingle, at_row, first = tb.shingles(word, row, n, width)
    value = idf[(word & np.uint64(len(idf) - 1)).astype(np.int64)].astype(np.float64)
    sums = np.r_[0.0, np.cumsum(value)]
    size = np.minimum(width, np.bincount(row, minlength=n)[at_row]) if len(at_row) else np.zeros(0, np.int64)
    mean = (sums[first + size] - sums[first]) / np.maximum(size, 1)
    order = np.lexsort((shingle, at_row))
    shingle, at_row, mean = shingle[order], at_row[order], np.round(mean[order], 3)
    new = np.r_[True, (shingle[1:] != shingle[:-1]) | (at_row[1:] != at_row[:-1])] if len(order) else np.zeros(0, bool)
    i = np.flatnonzero(new)
    return at_row[i], shingle[i], mean[i], np.diff(np.r_[i, len(order)])


# --- improved consistent weighted sampling -------------------------------------------------------------------------


def consistent_samples(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, samples: int) -> np.ndarray:
    """For each row and sample a number that two rows share with the probability of their weighted Jaccard similarity.

    For an element of weight w: r, c from Gamma(2, 1), b uniform, t = floor(ln w / r + b), y = exp(r (t - b)),
    a = c / (y exp(r)); the sample is the element with the smallest a, with its t. The smallest a of a row is exponential
    with the row's total weight W. Since c >= 1 - exp(-c) and y <= w, a is at least (1 - exp(-c)) exp(-r) / w, which
    needs no logarithm: elements whose bound is above 4 / W are passed over, the rest is computed in full. A row whose
    smallest a is above 4 / W after all (one in fifty) is computed without passing over any.
    """
    out = np.zeros((n, samples), np.uint64)
    if not len(row):
        return out
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    counts = np.diff(np.r_[first, len(row)])
    group = np.repeat(np.arange(len(first), dtype=np.int32), counts)
    limit = 4 / np.add.reduceat(weight, first)
    log_limit = np.log(limit)
    bar = ((limit[group] * weight) * (65536.0**4 * (1 + 1e-4))).astype(np.float32)
    log_w = np.log(weight)
    h = np.empty(len(row), np.uint64)
    shifted = np.empty_like(h)
    fields = h.view(np.uint16).reshape(-1, 4)
    c_part, r_part, f = (np.empty(len(row), np.float32) for _ in range(3))

    def exact(i: np.ndarray, k: int):
        more = tb.mix(shingle[i], 4 * k + 2).view(np.uint16).reshape(-1, 4)
        u = [(fields[i, j].astype(np.float64) * 65536 + more[:, j] + 0.5) / 2.0**32 for j in range(4)]
        beta = (tb.mix(shingle[i], 4 * k + 3) >> np.uint64(11)).astype(np.float64) / 2.0**53
        c, r = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
        t = np.floor(log_w[i] / r + beta)
        return np.log(c) - r * (t - beta) - r, t.astype(np.int64)

    def choose(i: np.ndarray, k: int):
        ln_a, t = exact(i, k)
        g = group[i]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        low = np.minimum.reduceat(ln_a, cut)
        win = np.flatnonzero(ln_a == np.repeat(low, np.diff(np.r_[cut, len(g)])))
        win = win[np.r_[True, g[win][1:] != g[win][:-1]]]
        out[row[i[win]], k] = tb.mix(shingle[i[win]] ^ tb.mix(t[win].astype(np.uint64), 99), k)
        return g[win], low

    for k in range(samples):
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ^ (k << 40)) & (2**64 - 1) | 1)
        np.multiply(shingle, odd, out=h)
        np.right_shift(h, np.uint64(31), out=shifted)
        np.bitwise_xor(h, shifted, out=h)
        np.multiply(h, np.uint64(0xD6E8FEB86659FD93), out=h)
        np.right_shift(h, np.uint64(32), out=shifted)
        np.bitwise_xor(h, shifted, out=h)
        c_part[:] = fields[:, 0]
        f[:] = fields[:, 1]
        c_part += 1
        f += 1
        c_part *= f
        np.subtract(np.float32(65536.0**2), c_part, out=c_part)
        r_part[:] = fields[:, 2]
        f[:] = fields[:, 3]
        r_part *= f
        c_part *= r_part
        alive = np.flatnonzero(c_part <= bar)
        settled = np.zeros(len(first), bool)
        if len(alive):
            g, low = choose(alive, k)
            settled[g[low <= log_limit[g]]] = True
        if not settled.all():
            choose(np.flatnonzero(~settled[group]), k)
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(samples), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            keys[:, b] = tb.mix(keys[:, b] ^ samples[:, b * rows + r], 1000 + b)
    return keys.view(np.int64)


def _sketcher(idf, bands: int, rows: int, width: int):
    def sketch(batches):
        weights = idf.value
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column("text"))
            n = len(offsets) - 1
            keys, has = np.zeros((n, bands), np.int64), np.zeros(n, bool)
            for lo, hi in tb.slices(offsets, 1 << 18):
                row, shingle, mean, count = weighted_shingles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], weights, width)
                keys[lo:hi] = band_keys(consistent_samples(row, shingle, mean * count, hi - lo, bands * rows), bands, rows)
                has[lo + row] = True
            digests = [hashlib.blake2b(buf[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(digests, pa.binary()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([k.tolist() if ok else [] for k, ok in zip(keys, has)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "digest", "bytes", "bands"],
            )

    return sketch


# --- verification --------------------------------------------------------------------------------------------------


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links a-b among n items."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def similar_pairs(row, shingle, idf, count, n: int, pairs: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Which of the pairs of rows reach the weighted Jaccard similarity."""
    total = np.bincount(row, idf * count, minlength=n)
    a, b = pairs
    bounds = np.searchsorted(row, np.arange(n + 1))
    if len(a) <= 8 * n:
        common = np.zeros(len(a))
        for i, (x, y) in enumerate(zip(a, b)):
            p, q = slice(bounds[x], bounds[x + 1]), slice(bounds[y], bounds[y + 1])
            where = np.searchsorted(shingle[p], shingle[q])
            where = np.minimum(where, bounds[x + 1] - bounds[x] - 1)
            same = shingle[p][where] == shingle[q]
            common[i] = (np.minimum(count[p][where], count[q]) * np.minimum(idf[p][where], idf[q]))[same].sum()
    else:
        # copies of a shingle are features of their own, so that the minimum of counts becomes a product of matrices
        rep = np.repeat(np.arange(len(row)), count)
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
        feature, name = np.unique(tb.mix(shingle[rep] ^ tb.mix(nth.astype(np.uint64), 5)), return_inverse=True)
        shared = np.bincount(name) > 1
        keep = shared[name]
        column = (np.cumsum(shared) - 1)[name[keep]]
        r, v = row[rep[keep]], np.sqrt(idf[rep[keep]])
        order = np.argsort(column, kind="stable")
        column, r, v = column[order], r[order], v[order]
        grid = np.zeros((n, n), np.float64)
        for lo in range(0, int(shared.sum()), 4096):
            p, q = np.searchsorted(column, lo), np.searchsorted(column, lo + 4096)
            x = np.zeros((n, 4096))
            x[r[p:q], column[p:q] - lo] = v[p:q]
            grid += x @ x.T
        common = grid[a, b]
    union = total[a] + total[b] - common
    return common >= threshold * union * (1 - 1e-6)


def _verifier(idf, width: int, threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        buf, offsets = tb.text_bytes(table.column("text"))
        ids = table.column("key").to_numpy()
        cluster, block = table.column("cluster").to_numpy(), table.column("block").to_numpy()
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(ids), -1)
        out_a, out_b = [], []
        for _, i in tb.by_group(np.unique(cluster, return_inverse=True)[1], np.arange(len(ids))):
            i = i[np.lexsort((ids[i], block[i]))]
            part = np.concatenate([buf[offsets[x] : offsets[x + 1]] for x in i])
            at = np.r_[0, np.cumsum(np.diff(offsets)[i])]
            row, shingle, mean, count = weighted_shingles(part, at, idf.value, width)
            own = bands[i]
            other = block[i][:, None] != block[i][None, :] if block[i].min() != block[i].max() else None
            meet = np.zeros((len(i), len(i)), bool)
            for column in own.T:
                meet |= column[:, None] == column[None, :]
            if other is not None:
                meet &= other
            a, b = np.nonzero(np.triu(meet, 1))
            good = similar_pairs(row, shingle, mean, count, len(i), (a, b), threshold)
            for x, y in _forest(len(i), a[good], b[good]):
                out_a.append(int(ids[i[x]]))
                out_b.append(int(ids[i[y]]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return verify


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 14, rows: int = 4, bits: int = 18, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Classes of near-duplicate documents: ``doc_id, key, class_id, kept`` for every row.

    Links are pairs of texts with a weighted Jaccard similarity of ``threshold`` or more over shingles of ``width`` words (a
    text with fewer words is one shingle), found with probability 1 - (1 - s ** rows) ** bands for similarity s. A class is a
    component of links; ``class_id`` is the smallest id in it (a hash of its first text where none has an id) and ``kept`` marks its first
    document. Equal texts are always in one class, empty and null ones too (null counts as empty); other texts without a word link
    with nothing. Rows that repeat an id, or null, with the same text are one document, with different texts they are different ones:
    ``key`` tells them apart, as ``with_keys`` numbers them. Null ids come last. Other columns are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = with_keys(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    idf = spark.sparkContext.broadcast(inverse_frequency(word_frequencies(texts, bits), texts.count()))  # 2 ** bits floats
    sketches = written(texts.mapInArrow(_sketcher(idf, bands, rows, width), "doc_id long, key long, digest binary, bytes long, bands array<long>"), "sketches")
    reps = written(sketches.groupBy("digest").agg(F.min("key").alias("rep"), F.min_by("doc_id", "key").alias("rep_id"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")), "reps")
    members = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    leaders = members.groupBy("band", "bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = members.join(leaders, ["band", "bucket"]).where("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    clusters = components(links).withColumnRenamed("component", "cluster")
    grouped = written(clusters.join(reps, clusters["id"] == reps["rep"]).select("cluster", F.col("id").alias("key"), "bands", "bytes"), "clusters")
    size = grouped.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK_DOCS).cast("int")
    volume = grouped.agg(F.sum("bytes")).first()[0] or 0
    units = parts(volume, UNIT_BYTES)
    placed = grouped.join(size, "cluster").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # a block meets every block of its cluster, itself too; a unit is a pair of blocks, or many small clusters
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    small = F.pmod(F.xxhash64("cluster"), F.lit(units)).cast("long")
    met = met.withColumn("unit", F.when(F.col("blocks") == 1, small).otherwise(F.xxhash64("cluster", low, high))).select("key", "cluster", "block", "unit", "bands")
    shipped = texts.select("key", "text").join(met, "key").dropDuplicates(["key", "cluster", "block", "unit"])
    edges = shipped.groupBy("unit").applyInArrow(_verifier(idf, width, threshold), "a long, b long")
    classes = components(edges)
    resolved = reps.join(classes, reps["rep"] == classes["id"], "left").select("digest", F.coalesce("component", "rep").alias("class_key"))
    named = reps.select(F.col("rep").alias("class_key"), F.coalesce("rep_id", F.xxhash64("digest")).alias("class_id"))
    told = sketches.join(resolved.join(named, "class_key"), "digest")
    return told.select("doc_id", "key", "class_id", (F.col("key") == F.col("class_key")).alias("kept"))
