"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence is scored by a logistic model over hashed words and word beginnings; a document by the noisy-or of its
sentences, 1 - prod(1 - p). The model is trained on document labels alone, by gradient steps on the noisy-or likelihood, so it
learns which sentences carry the label; those are returned as byte spans.

The fit uses a bounded sample of labelled rows (``sample_docs`` of each class, in the order of a hash, texts up to
``sample_text_bytes``); clean rows are weighted back to their share. Scoring covers every whole text in Arrow tasks
that hold the weights (``2 ** bits`` floats) as a broadcast of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textbytes as tb

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".!?\n\r"]] = True
FEATURES_A_WORD = 3


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    bits: int


def sentence_features(buf: np.ndarray, offsets: np.ndarray, bits: int):
    """Hashed features (three for each word), and for each sentence its row, first word, first byte and end."""
    folded, row, s, e = tb.words(buf, offsets)
    if not len(s):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.int32), empty, empty, empty, empty
    ranges = tb.RangeHash(tb._FOLD[buf])
    mask = np.uint64((1 << bits) - 1)
    whole = tb.mix(folded, 1) & mask
    four = tb.mix(ranges.of(s, np.minimum(e, s + 4)), 2) & mask
    five = tb.mix(ranges.of(s, np.minimum(e, s + 5)), 3) & mask
    features = np.stack([whole, four, five], 1).astype(np.int32).ravel()
    breaks = np.cumsum(_BREAKS[buf])[s]
    new = np.r_[True, (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(s)] - 1
    return features, row[first], first, s[first], e[last]


def _sentence_logits(features: np.ndarray, first_word: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return np.add.reduceat(weights[features].astype(np.float64), first_word * FEATURES_A_WORD) + bias if len(first_word) else np.zeros(0)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit_noisy_or(features: list[np.ndarray], firsts: list[np.ndarray], labels: np.ndarray, clean_weight: float, bits: int, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 5, batch: int = 128):
    """Adagrad on the noisy-or likelihood. ``firsts``: first word of each sentence of a document."""
    w, b = np.zeros(1 << bits, np.float32), -6.0
    square, square_b = np.full(1 << bits, 1e-4, np.float32), 1e-2
    rng = np.random.default_rng(seed)
    used = [i for i in range(len(labels)) if len(firsts[i])]
    for _ in range(epochs):
        order = rng.permutation(used)
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            words = np.array([len(features[i]) // FEATURES_A_WORD for i in ids])
            base = np.cumsum(words) - words
            f = np.concatenate([features[i] for i in ids])
            first = np.concatenate([firsts[i] + o for i, o in zip(ids, base)])
            n = np.array([len(firsts[i]) for i in ids])
            doc = np.repeat(np.arange(len(ids)), n)
            z = _sentence_logits(f, first, w, b)
            sure = np.add.reduceat(_softplus(z), np.cumsum(n) - n)
            y = labels[ids]
            pull = np.where(y == 1, -1.0 / np.expm1(np.clip(sure, 1e-6, 50)), clean_weight)[doc]
            g = np.clip(pull * (1 / (1 + np.exp(-np.clip(z, -40, 40)))), -5, 5)
            per_word = np.repeat(g, np.diff(np.r_[first, words.sum()]) * FEATURES_A_WORD)
            grad = (np.bincount(f, per_word, minlength=1 << bits) / len(ids)).astype(np.float32)
            hit = np.flatnonzero(grad)
            grad = grad[hit] + decay * w[hit]
            square[hit] += grad * grad
            w[hit] -= rate * grad / np.sqrt(square[hit])
            gb = float(g.sum() / len(ids))
            square_b += gb * gb
            b -= rate * gb / square_b**0.5
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, sample_text_bytes: int = 1 << 20, bits: int = 18, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """Fit on at most ``sample_docs`` rows of each class of ``labels`` (rows with a null label or id are left out; if an id has
    several labels the highest counts). Without labelled rows every score is near 0."""
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * sample_docs rows of two numbers: small enough to be sent to every task
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.octet_length("text") <= sample_text_bytes).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def describe(batches):
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column("text"))
            blobs = []
            for i in range(len(offsets) - 1):
                features, _, first, _, _ = sentence_features(buf[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), bits)
                blobs.append(tb.pack(features, first))
            yield pa.record_batch({"id": batch.column("id"), "y": batch.column("y"), "blob": pa.array(blobs, pa.binary())})

    got = sorted(rows.mapInArrow(describe, "id long, y int, blob binary").collect(), key=lambda r: (r["id"], r["blob"]))
    got = [r for i, r in enumerate(got) if not i or got[i - 1]["id"] != r["id"]]
    split = [tb.unpack(bytes(r["blob"]), np.int32, np.int64) for r in got]
    y = np.array([r["y"] for r in got], np.int64)
    clean = max(1, int((y == 0).sum()))
    toxic = max(1, int((y == 1).sum()))
    weight = (totals.get(0, 0) / clean) / max(1e-9, totals.get(1, 0) / toxic) if totals.get(1) else 1.0
    if not len(y):
        return ToxicityModel(np.zeros(1 << bits, np.float32), -20.0, bits)
    w, b = fit_noisy_or([s[0] for s in split], [s[1] for s in split], y, weight, bits)
    return ToxicityModel(w, b, bits)


def score_toxicity(docs: DataFrame, model: ToxicityModel, offending: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``toxicity`` (0 to 1) and ``offending``: the sentences whose own probability is
    ``offending`` or more (first byte, end, probability). Texts without a word, null ones too, have score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits floats
    names = docs.columns

    def score(batches):
        m = sent.value
        for batch in batches:
            buf, offsets = tb.text_bytes(batch.column(names.index(text_column)))
            n = len(offsets) - 1
            scores, spans = np.zeros(n), [[] for _ in range(n)]
            for lo, hi in tb.slices(offsets):
                part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                features, row, first, s, e = sentence_features(part, at, m.bits)
                z = _sentence_logits(features, first, m.weights, m.bias)
                sure = np.bincount(row, _softplus(z), minlength=hi - lo) if len(row) else np.zeros(hi - lo)
                scores[lo:hi] = -np.expm1(-sure)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                for j in np.flatnonzero(p >= offending):
                    spans[lo + row[j]].append({"start": int(s[j] - at[row[j]]), "end": int(e[j] - at[row[j]]), "p": float(p[j])})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(spans, kind)], names=[f"c{i}" for i in range(len(names))] + ["t", "o"])

    fields = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)] + ["t double", "o array<struct<start:bigint,end:bigint,p:double>>"])
    return docs.mapInArrow(score, fields).toDF(*names, "toxicity", "offending")


def held_out(id_column: str, folds: int, fold: int):
    """Whether crc32 of the id as text has this remainder; a null id never is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
