"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts of order 0 to ``order`` is counted on a bounded sample of labelled rows and then
frozen. A symbol seen c times after a context that was followed n times by d different symbols has probability c / (n + d)
there; the escape to the next shorter context has d / (n + d) (method C); below order 0 all bytes are alike. The code length
of a text under a language is the sum of -log2 of these, over every byte of the text; the shortest code wins.

The trees of all languages are one table for each length of byte strings: for a string, the log-probability of its last byte
after the others in each language (escapes included), and the log of the escape after the string. Most bytes need one
look-up; those whose string is in no tree go down an order for each miss, as the escapes say.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import textbytes as tb

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_PAD = 10


class StringTable:
    """An open-addressing table of packed byte strings, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.rows[slot[todo]] < 0
            _, one = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][one]
            self.keys[slot[put]], self.rows[slot[put]] = keys[put], put
            done = np.zeros(len(keys), bool)
            done[put] = True
            todo = todo[~done[todo]]
            slot[todo] = np.where(self.rows[slot[todo]] < 0, slot[todo], (slot[todo] + 1) & self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where absent."""
        slot = self._slot(keys)
        rows = self.rows[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (rows >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            rows[todo] = self.rows[slot[todo]]
            todo = todo[(self.keys[slot[todo]] != keys[todo]) & (rows[todo] >= 0)]
        return rows


@dataclass
class LanguageModel:
    """``tables[m]``: strings of m + 1 bytes with ``log_p[m]`` and ``log_escape[m]`` (a column for each language)."""

    languages: list[str]
    order: int
    tables: list[StringTable]
    log_p: list[np.ndarray]
    log_escape: list[np.ndarray]
    log_none: np.ndarray


def _padded(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``order`` line feeds before each, and the positions of the true bytes."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    at = np.arange(len(buf)) + (row + 1) * order
    out = np.full(len(buf) + n * order, _PAD, np.uint8)
    out[at] = buf
    return out, at


def _strings(padded: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes that end at each position, packed, with the length on top."""
    out = np.full(len(at), length, np.uint64)
    for back in range(length - 1, -1, -1):
        out = (out << np.uint64(8)) | padded[at - back].astype(np.uint64)
    return out


def fit_languages(samples: dict[str, list[bytes]], order: int = 4) -> LanguageModel:
    """Count the context trees of each language's texts and freeze them."""
    names = sorted(samples)
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for name in names:
        texts = samples[name]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        padded, at = _padded(buf, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), order)
        grams.append([np.unique(_strings(padded, at, m), return_counts=True) for m in range(1, order + 2)])
    width = len(names)
    # follow[l][m]: contexts of m bytes with how often and by how many symbols they are followed; of no bytes: one context
    follow = []
    for per in grams:
        own = []
        for m in range(order + 1):
            keys, counts = per[m]
            top = np.uint64(m) << np.uint64(8 * m)
            context = ((keys >> np.uint64(8)) & np.uint64((1 << (8 * m)) - 1)) | top
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, int)
            own.append((context[first], np.add.reduceat(counts, first) if len(first) else counts, np.diff(np.r_[first, len(keys)])))
        follow.append(own)

    def escape(of: int, m: int, contexts: np.ndarray) -> np.ndarray:
        """Log of the escape after contexts of m bytes; 0 for those not seen."""
        known, n, d = follow[of][m]
        out = np.zeros(len(contexts))
        if len(known):
            i = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
            hit = known[i] == contexts
            out[hit] = np.log2(d[i[hit]] / (n[i[hit]] + d[i[hit]]))
        return out

    none = np.array([escape(i, 0, np.zeros(1, np.uint64))[0] for i in range(width)]) - 8.0
    tables, log_p, log_escape = [], [], []
    for m in range(order + 1):
        contexts = [own[m + 1][0] for own in follow] if m < order else []
        keys = np.unique(np.concatenate([per[m][0] for per in grams] + contexts)) if grams else np.zeros(0, np.uint64)
        p, e = np.zeros((len(keys), width)), np.zeros((len(keys), width))
        context = ((keys >> np.uint64(8)) & np.uint64((1 << (8 * m)) - 1)) | (np.uint64(m) << np.uint64(8 * m))
        shorter = (keys & np.uint64((1 << (8 * m)) - 1)) | (np.uint64(m) << np.uint64(8 * m))
        lower = log_p[m - 1][tables[m - 1].find(shorter)] if m and len(keys) else np.tile(none - np.array([escape(i, 0, np.zeros(1, np.uint64))[0] for i in range(width)]), (len(keys), 1))
        for i, per in enumerate(grams):
            own, counts = per[m]
            known, n, d = follow[i][m]
            p[:, i] = lower[:, i] + escape(i, m, context)
            if len(own):
                at = np.searchsorted(keys, own)
                j = np.searchsorted(known, context[at])
                p[at, i] = np.log2(counts / (n[j] + d[j]))
            if m < order:
                e[:, i] = escape(i, m + 1, keys)
        tables.append(StringTable(keys))
        log_p.append(p.astype(np.float32))
        log_escape.append(e.astype(np.float32))
    return LanguageModel(names, order, tables, log_p, log_escape, none)


def code_lengths(model: LanguageModel, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    n, width = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, width))
    padded, at = _padded(buf, offsets, model.order)
    if not len(at):
        return out
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    rows = model.tables[model.order].find(_strings(padded, at, model.order + 1))
    missed = np.flatnonzero(rows < 0)
    shown = np.maximum(rows, 0)
    for i in range(width):
        column = np.ascontiguousarray(model.log_p[model.order][:, i]) if len(model.log_p[model.order]) else np.zeros(1, np.float32)
        got = column[shown].astype(np.float64)
        got[missed] = 0
        out[some, i] = np.add.reduceat(got, offsets[some])
    extra = np.zeros((len(missed), width))
    open_ = np.arange(len(missed))
    for m in range(model.order - 1, -1, -1):
        if not len(open_):
            break
        table, place = model.tables[m], at[missed[open_]]
        context = table.find(_strings(padded, place - 1, m + 1))
        extra[open_] += np.where(context[:, None] >= 0, model.log_escape[m][np.maximum(context, 0)], 0)
        rows = table.find(_strings(padded, place, m + 1))
        hit = rows >= 0
        extra[open_[hit]] += model.log_p[m][rows[hit]]
        open_ = open_[~hit]
    extra[open_] += model.log_none
    row = np.searchsorted(offsets, missed, "right") - 1
    for i in range(width):
        out[:, i] += np.bincount(row, extra[:, i], minlength=n)
    return -out


def learn_languages(docs: DataFrame, sample_docs: int = 300, sample_text_bytes: int = 1 << 16, order: int = 4, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """Fit on at most ``sample_docs`` rows of each language, in the order of a hash, and on the first ``sample_text_bytes`` bytes of each, so a
    language that has long texts only is learned too. Rows with a null language, text or id teach nothing."""
    rows = docs.where(F.col(lang_column).isNotNull() & F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
    order_by = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang")).withColumn("n", F.row_number().over(order_by)).where(F.col("n") <= sample_docs).select("id").distinct()
    # sample_docs ids for each language
    got = rows.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.substring(F.encode(text_column, "UTF-8"), 1, sample_text_bytes).alias("text")).join(F.broadcast(chosen), "id", "left_semi").collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["id"], bytes(r["text"]))):
        samples.setdefault(r["lang"], []).append(bytes(r["text"]))
    return fit_languages(samples, order)


def predict_language(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits``: the language with the shortest code (ties to the smaller name), its posterior
    probability among the languages, and its code length. Texts that are null or have no letter are ``und`` with
    score 0, as are all texts if no language was learned. Long texts are coded whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predict(batches):
        m = sent.value
        for batch in batches:
            text = batch.column("text")
            buf, offsets = tb.text_bytes(text)
            n = len(offsets) - 1
            letters = np.array([t is not None and _LETTER.search(t) is not None for t in text.to_pylist()], bool)
            best, score, bits = np.full(n, -1), np.zeros(n), np.zeros(n)
            if m.languages:
                for lo, hi in tb.slices(offsets):
                    length = code_lengths(m, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    win = length.argmin(1)
                    least = length[np.arange(hi - lo), win]
                    best[lo:hi], bits[lo:hi] = win, least
                    score[lo:hi] = 1 / np.exp2(np.maximum(least[:, None] - length, -1000)).sum(1)
            best[~letters] = -1
            score[best < 0] = 0
            names = [m.languages[b] if b >= 0 else UNDETERMINED for b in best]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "bits": pa.array(bits)})

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double, bits double")
