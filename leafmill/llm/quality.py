"""Quality by co-training: a classifier of the text and one of the metadata teach each other.

Both are logistic models over hashed features: the text view sees words and the shape of the text, the metadata view sees
source, language and length. They start from a bounded sample of labelled documents; in each round either view labels the
documents of a bounded unlabelled pool that it is most sure of, in the proportion of the classes, and hands them to the
other. Each view is then calibrated on labelled documents that it has not learned from, and the calibrated log-odds are
added, less the prior counted twice. Every document is scored over its whole text in Arrow tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textbytes as tb


@dataclass(frozen=True)
class View:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


@dataclass(frozen=True)
class QualityModel:
    text: View
    meta: View
    prior: float
    bits: int


_UPPER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SIGN[[ord(c) for c in "!?#$%&*+<=>@[]^_{|}~/\\"]] = True


def text_features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed feature and value; words weigh the root of their count, scaled to length one, shape features one."""
    n, mask = len(offsets) - 1, np.uint64((1 << bits) - 1)
    word, row, s, e = tb.words(buf, offsets)
    size = np.diff(offsets)
    words = np.bincount(row, minlength=n)
    pair = (row.astype(np.int64) << bits) | (tb.mix(word, 21) & mask).astype(np.int64)
    pair, count = np.unique(pair, return_counts=True)
    r, f, v = pair >> bits, pair & ((1 << bits) - 1), np.sqrt(count)
    norm = np.sqrt(np.bincount(r, v * v, minlength=n))
    v = v / norm[r] if len(r) else v
    whole = np.repeat(np.arange(n), size)
    share = lambda flag: np.bincount(whole, flag[buf], minlength=n) / np.maximum(size, 1)
    shape = [
        10 * share(_UPPER),
        20 * share(_DIGIT),
        20 * share(_SIGN),
        8 * np.bincount(r, minlength=n) / np.maximum(words, 1),
        np.bincount(row, e - s, minlength=n) / np.maximum(words, 1),
        np.log2(1 + words),
    ]
    dense = [(tb.mix(np.floor(np.minimum(x, 30)).astype(np.uint64), 100 + i) & mask).astype(np.int64) for i, x in enumerate(shape)]
    rows = np.tile(np.arange(n), len(dense))
    return np.r_[r, rows], np.r_[f, np.concatenate(dense)], np.r_[v, np.ones(len(rows))]


def meta_column(columns: list[str], length_column: str | None) -> Column:
    """The metadata of a document as an array of strings: each column with its value, the length by powers of two."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("(none)"))) for c in columns]
    if length_column:
        size = F.when(F.col(length_column) >= 0, F.floor(2 * F.log2(F.col(length_column) + 1)).cast("string"))
        parts.append(F.concat(F.lit("size="), F.coalesce(size, F.lit("(none)"))))
    return F.array(*parts)


def _hash_strings(strings: list[str], bits: int) -> np.ndarray:
    raw = [s.encode() for s in strings]
    buf, at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    return (tb.mix(tb.RangeHash(buf).of(at[:-1], at[1:]), 33) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _logits(row, feature, value, n, view: View) -> np.ndarray:
    return np.bincount(row, view.weights[feature] * value, minlength=n) + view.bias


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, bits: int, epochs: int = 15, rate: float = 0.3, decay: float = 1e-3, seed: int = 9) -> View:
    w, b = np.zeros(1 << bits), 0.0
    square, square_b = np.full(1 << bits, 1e-3), 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            ids = order[lo : lo + 64]
            f = np.concatenate([rows[i][0] for i in ids])
            v = np.concatenate([rows[i][1] for i in ids])
            r = np.repeat(np.arange(len(ids)), [len(rows[i][0]) for i in ids])
            z = np.bincount(r, w[f] * v, minlength=len(ids)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[ids]) * weight[ids]
            grad = np.bincount(f, g[r] * v, minlength=1 << bits) / len(ids)
            hit = np.flatnonzero(grad)
            step = grad[hit] + decay * w[hit]
            square[hit] += step * step
            w[hit] -= rate * step / np.sqrt(square[hit])
            gb = g.mean()
            square_b += gb * gb
            b -= rate * gb / square_b**0.5
    return View(w, float(b))


def _calibrated(view: View, z: np.ndarray, y: np.ndarray) -> View:
    """Slope and shift of the log-odds on documents the view has not learned from (Newton steps, smoothed targets)."""
    if len(z) < 10 or y.min() == y.max():
        return view
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        p = p - np.linalg.solve(h, x.T @ (q - target) + 1e-3 * (p - [1, 0]))
    return View(view.weights, view.bias, float(max(p[0], 0.0)), float(p[1]))


def co_train(text: list, meta: list, y: np.ndarray, bits: int, rounds: int, added: int, seed: int = 4) -> QualityModel:
    """``y``: 1, 0, or -1 for the unlabelled pool. A fifth of the labelled rows is kept for calibration."""
    rng = np.random.default_rng(seed)
    labelled = np.flatnonzero(y >= 0)
    held = np.zeros(len(y), bool)
    held[labelled[rng.random(len(labelled)) < 0.2]] = True
    prior = float(np.clip(y[labelled].mean(), 1e-3, 1 - 1e-3)) if len(labelled) else 0.5
    known = {"text": np.where(held, -1, y), "meta": np.where(held, -1, y)}
    pool = y < 0
    views = {"text": text, "meta": meta}

    def fit(name: str) -> View:
        own = known[name]
        use = np.flatnonzero(own >= 0)
        if not len(use) or own[use].min() == own[use].max():
            return View(np.zeros(1 << bits), float(np.log(prior / (1 - prior))))
        return fit_logistic([views[name][i] for i in use], own[use].astype(float), np.where(y[use] >= 0, 1.0, 0.5), bits)

    def logits(name: str, view: View, ids: np.ndarray) -> np.ndarray:
        return np.array([view.weights[views[name][i][0]] @ views[name][i][1] + view.bias for i in ids])

    fitted = {name: fit(name) for name in views}
    for _ in range(rounds):
        new = []
        for name, other in (("text", "meta"), ("meta", "text")):
            ids = np.flatnonzero(pool & (known[other] < 0))
            z = logits(name, fitted[name], ids)
            order = np.argsort(z, kind="stable")
            good, bad = int(round(added * prior)), max(1, int(round(added * (1 - prior))))
            sure_bad, sure_good = order[:bad][z[order[:bad]] < -1], order[::-1][:good][z[order[::-1][:good]] > 1]
            new += [(other, ids[sure_bad], 0), (other, ids[sure_good], 1)]
        for other, ids, label in new:
            known[other][ids] = label
        fitted = {name: fit(name) for name in views}
    ids = np.flatnonzero(held)
    final = {name: _calibrated(fitted[name], logits(name, fitted[name], ids), y[ids].astype(float)) for name in views}
    return QualityModel(final["text"], final["meta"], float(np.log(prior / (1 - prior))), bits)


def fit_quality(
    docs: DataFrame, labels: DataFrame, meta: list[str], length_column: str | None, sample_docs: int = 3000, pool_docs: int = 3000, sample_text_bytes: int = 1 << 18, bits: int = 16, rounds: int = 4, added: int = 300,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
) -> QualityModel:
    """Fit on at most ``sample_docs`` labelled rows and ``pool_docs`` others (texts up to ``sample_text_bytes``), chosen by
    hash. Null labels and ids are left out; an id with several labels takes the smallest."""
    ids = docs.select(F.col(id_column).alias("id")).where(F.col("id").isNotNull())
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.min(label_column).cast("int").alias("y"))
    first = known.join(ids.distinct(), "id").orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    rest = ids.distinct().join(labels.select(F.col(id_column).alias("id")), "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(pool_docs).withColumn("y", F.lit(-1))
    chosen = first.unionByName(rest)  # sample_docs + pool_docs rows of two numbers
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), meta_column(meta, length_column).alias("meta")).where(F.octet_length("text") <= sample_text_bytes).join(F.broadcast(chosen), "id")

    def describe(batches):
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column("text"))
            blobs = []
            for i, m in enumerate(batch.column("meta").to_pylist()):
                _, f, v = text_features(buf[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), bits)
                blobs.append(tb.pack(f.astype(np.int32), v.astype(np.float32), _hash_strings(m, bits).astype(np.int32)))
            yield pa.record_batch({"id": batch.column("id"), "y": batch.column("y"), "blob": pa.array(blobs, pa.binary())})

    got = sorted(rows.select("id", "y", "text", "meta").mapInArrow(describe, "id long, y int, blob binary").collect(), key=lambda r: (r["id"], r["blob"]))
    got = [r for i, r in enumerate(got) if not i or got[i - 1]["id"] != r["id"]]
    parts = [tb.unpack(bytes(r["blob"]), np.int32, np.float32, np.int32) for r in got]
    return co_train([(f, v) for f, v, _ in parts], [(m, np.ones(len(m))) for _, _, m in parts], np.array([r["y"] for r in got], np.int64), bits, rounds, added)


def score_quality(docs: DataFrame, model: QualityModel, meta: list[str], length_column: str | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, text_score, meta_score`` (0 to 1, higher is better) for every row; null texts count as empty, a null in
    the metadata is a value of its own."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2 ** bits floats

    def score(batches):
        m = sent.value
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column("text"))
            n = len(offsets) - 1
            z = np.zeros(n)
            for lo, hi in tb.slices(offsets):
                r, f, v = text_features(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], m.bits)
                z[lo:hi] = _logits(r, f, v, hi - lo, m.text)
            strings = batch.column("meta").to_pylist()
            flat = [s for row in strings for s in row]
            row = np.repeat(np.arange(n), [len(x) for x in strings])
            y = _logits(row, _hash_strings(flat, m.bits) if flat else np.zeros(0, np.int64), np.ones(len(row)), n, m.meta)
            z, y = m.text.slope * z + m.text.shift, m.meta.slope * y + m.meta.shift
            one = lambda x: pa.array(1 / (1 + np.exp(-np.clip(x, -40, 40))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), one(z + y - m.prior), one(z), one(y)], names=["doc_id", "score", "text_score", "meta_score"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), meta_column(meta, length_column).alias("meta"))
    return rows.mapInArrow(score, "doc_id long, score double, text_score double, meta_score double")
