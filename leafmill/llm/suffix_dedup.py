"""Exact removal of repeated byte strings, decided by suffix arrays that are built with difference covers.

How the work is dealt out
-------------------------
1. *Anchors.* The anchor of a ``length``-byte string is the position with the smallest hash among its k-grams. Equal
   strings have the anchor at the same place, so they meet under one fingerprint. The run of starts that share an anchor
   is a *stretch* (at most ``length - k + 1`` starts). Documents send, for each stretch, a fingerprint and a content hash,
   packed in one blob for each bucket of fingerprints.
2. *Candidates.* A bucket answers with the stretches that can hold a repeated string: those whose fingerprint occurs more
   than once. A stretch whose whole content has occurred earlier is a copy (all its strings start earlier too): it is
   collapsed onto its first occurrence, so hot passages are pre-aggregated instead of sorted; a task that meets a content
   often sends its first occurrence only. A fingerprint that occurs once cannot repeat and is left out. A fingerprint
   with very many contents, as at the edges of a passage that a third of all documents share, is split: its strings go
   by themselves, by their hash, after each chunk has kept the first of each.
3. *Suffix arrays.* The remaining stretches, as bytes, go to shards of fingerprints. Each shard builds the suffix array of
   its stretches: triples at the positions of the difference cover {1, 2} mod 3 are sorted and named, the names are
   sorted by recursion until they cover ``length`` bytes, the suffixes at 0 mod 3 are merged in, and neighbours in the
   array with equal prefixes of ``length`` bytes form a group. All but the earliest start of a group are removed.
4. *Cutting.* Each document joins its own answers and drops the covered bytes.

Everything that moves is packed and keyed by chunk (documents), bucket or shard, whose numbers grow with the input, so a
task holds a bounded part. Every stage derives from the input and written tables, so lost executors only repeat tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textbytes as tb
from leafmill.llm.tables import chunk_column, parts, text_volume, with_keys, written

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
SHARD_BYTES = 4 << 20
#: A content that a task has seen so often is sent once; a fingerprint with more contents, in a task or in all, is split.
OFTEN, SPLIT_TASK, SPLIT_ALL = 64, 1000, 50_000
_NONE, _COPY, _SORT, _SPLIT = 0, 1, 2, 3
_ANSWER = "chunk int, bucket int, blob binary"


# --- stretches of a document -------------------------------------------------------------------------------------


def stretches(buf: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Stretches of some rows: row, first start, end of starts, fingerprint, content hash; all in order of position."""
    if len(buf) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ranges = tb.RangeHash(buf)
    grams = ranges.every(k)
    place = np.arange(len(grams), dtype=np.uint64)
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | place
    anchor = (tb.sliding_min(keyed, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = len(buf) - length + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = row[:n] == row[length - 1 :]
    begins = valid.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    stops = valid.copy()
    stops[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return row[a], a, b, grams[anchor[a]], ranges.of(a, b + length - 1)


def _bucket(fingerprint: np.ndarray, n: int) -> np.ndarray:
    return ((fingerprint >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _rank_in(rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    """Number of each stretch among those of its row and bucket."""
    group = rows * n + buckets
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    rank = np.empty(len(g), np.int64)
    rank[order] = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return rank


def _answers(bucket: int, chunks: int, key: np.ndarray, nth: np.ndarray, state: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(c, bucket, tb.pack(k, n.astype(np.int32), x.astype(np.int8))) for c, k, n, x in tb.by_group(tb.chunk_of(key, chunks), key, nth, state)]


def _new_runs(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _settle_here(bucket: int, chunks: int, often_from: int, split_from: int, key, nth, fp, content):
    """What a task can settle of a bucket: entries to send (first those of hot fingerprints, as marks), and answers."""
    order = np.lexsort((nth, key, content, fp))
    f, c = fp[order], content[order]
    new = _new_runs(f, c)
    run = np.cumsum(new) - 1
    often = np.bincount(run)[run] >= often_from
    kinds = np.bincount((np.cumsum(_new_runs(f)) - 1)[new])
    split = (kinds > split_from)[np.cumsum(_new_runs(f)) - 1]
    first = np.flatnonzero(new)[run]
    same = (key[order] == key[order][first]) & (nth[order] == nth[order][first])
    state = np.where(split, _SPLIT, np.where(often & ~same, _COPY, _NONE))
    told = state != _NONE
    answers = _answers(bucket, chunks, key[order][told], nth[order][told], state[told])
    marks = order[split & _new_runs(f)]
    stay = np.ones(len(order), bool)
    stay[order[told | (often & ~new)]] = False
    k, n = key[stay], nth[stay]
    begins = np.flatnonzero(_new_runs(k))
    counts = np.diff(np.r_[begins, len(k)]).astype(np.int32)
    if len(k) or len(marks):
        sent = tb.pack(
            np.r_[key[marks], k[begins]], np.r_[np.ones(len(marks), np.int32), counts].astype(np.int32),
            np.r_[np.full(len(marks), -1, np.int32), n].astype(np.int32), np.r_[fp[marks], fp[stay]], np.r_[np.zeros(len(marks), np.uint64), content[stay]],
        )
        return sent, answers
    return None, answers


def _sender(length: int, k: int, buckets: int, chunks: int, often_from: int, split_from: int):
    """Rows ``chunk, bucket, blob``: entries for the bucket (chunk -1), or answers that a task can give by itself."""

    def send(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            nonlocal size
            out = []
            for b, parts_ in held.items():
                blob, told = _settle_here(b, chunks, often_from, split_from, *[np.concatenate(c) for c in zip(*parts_)])
                out += ([(-1, b, blob)] if blob is not None else []) + told
            held.clear()
            size = 0
            return _rows(out)

        for batch in batches:
            keys = tb.doc_keys(batch.column("key"))
            buf, offsets = tb.text_bytes(batch.column("text"))
            for lo, hi in tb.slices(offsets):
                part = buf[offsets[lo] : offsets[hi]]
                row, _, _, fp, content = stretches(part, offsets[lo : hi + 1] - offsets[lo], length, k)
                bucket = _bucket(fp, buckets)
                nth = _rank_in(row, bucket, buckets)
                for b, r, n, f, c in tb.by_group(bucket, row, nth, fp, content):
                    held.setdefault(b, []).append((keys[lo:hi][r], n, (f & np.uint64(0xFFFFFFFF)).astype(np.uint32), c))
                size += 12 * len(fp)
                if size > 16 << 20:
                    yield flush()
        if held:
            yield flush()

    return send


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    c, b, x = zip(*rows) if rows else ((), (), ())
    return pa.record_batch({"chunk": pa.array(c, pa.int32()), "bucket": pa.array(b, pa.int32()), "blob": pa.array(x, pa.binary())})


def _judge_bucket(chunks: int, split_from: int):
    """Which stretches of a bucket are copies, and which have to be sorted."""

    def judge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py() if len(table) else 0
        got = [tb.unpack(blob.as_buffer(), np.int64, np.int32, np.int32, np.uint32, np.uint64) for blob in table.column("blob").combine_chunks()]
        keys, counts, nth, fp, content = (np.concatenate(x) for x in zip(*got))
        del got
        ordered = np.sort(fp)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        hot = np.unique(fp[nth < 0])
        again = np.union1d(again, hot)
        at = np.flatnonzero(again[np.minimum(np.searchsorted(again, fp), max(len(again) - 1, 0))] == fp) if len(again) else np.zeros(0, int)
        at = at[nth[at] >= 0]
        entry = np.searchsorted(np.cumsum(counts), at, "right")
        key, nth, f, c = keys[entry], nth[at], fp[at], content[at]
        order = np.lexsort((nth, key, c, f))
        key, f, c, nth = key[order], f[order], c[order], nth[order]
        new_f, new_c = _new_runs(f), _new_runs(f, c)
        first = np.flatnonzero(new_c)[np.cumsum(new_c) - 1]
        is_first = (key == key[first]) & (nth == nth[first])
        contents = np.bincount((np.cumsum(new_f) - 1)[new_c])[np.cumsum(new_f) - 1] if len(f) else np.zeros(0, int)
        state = np.where(~is_first, _COPY, np.where(contents < 2, _NONE, _SORT))
        state[(contents > split_from) | np.isin(f, hot)] = _SPLIT
        told = state != _NONE
        return pa.Table.from_batches([_rows(_answers(bucket, chunks, key[told], nth[told], state[told]))])

    return judge


def _answered(table: pa.Table, length: int, k: int, buckets: int, answers: pa.Table):
    """Stretches of a chunk that have an answer: row, start, end of starts (in the row), fingerprint, state; per slice."""
    keys = tb.doc_keys(table.column("key"))
    buf, offsets = tb.text_bytes(table.column("text"))
    told: dict[str, list] = {"key": [], "bucket": [], "nth": [], "state": []}
    for bucket, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").combine_chunks() if len(answers) else []):
        kk, nn, ss = tb.unpack(blob.as_buffer(), np.int64, np.int32, np.int8)
        told["key"].append(kk)
        told["nth"].append(nn)
        told["state"].append(ss)
        told["bucket"].append(np.full(len(kk), bucket, np.int64))
    if not told["key"]:
        return
    key, bucket, nth, state = (np.concatenate(told[c]) for c in ("key", "bucket", "nth", "state"))
    names = np.unique(key)
    wanted = np.flatnonzero(np.isin(keys, names))
    code = _code(np.searchsorted(names, key), bucket, nth, buckets)
    order = np.argsort(code)
    code, state = code[order], state[order]
    for i in _row_groups(wanted, offsets):
        part = np.concatenate([buf[offsets[r] : offsets[r + 1]] for r in i])
        at = np.r_[0, np.cumsum(np.diff(offsets)[i])]
        row, a, b, fp, _ = stretches(part, at, length, k)
        bk = _bucket(fp, buckets)
        mine = _code(np.searchsorted(names, keys[i])[row], bk, _rank_in(row, bk, buckets), buckets)
        where = np.minimum(np.searchsorted(code, mine), len(code) - 1)
        hit = code[where] == mine
        row, a, b, fp = row[hit], a[hit], b[hit], fp[hit]
        yield i, part, at, row, a, b, fp, state[where[hit]]


def _code(doc: np.ndarray, bucket: np.ndarray, nth: np.ndarray, buckets: int) -> np.ndarray:
    """One number for document (of a chunk), bucket and running number."""
    return (doc.astype(np.int64) * buckets + bucket) * (1 << 31) + nth


def _row_groups(rows: np.ndarray, offsets: np.ndarray):
    sizes = np.diff(offsets)[rows]
    for lo, hi in tb.slices(np.r_[0, np.cumsum(sizes)]):
        yield rows[lo:hi]


def _to_shards(length: int, k: int, buckets: int, shards: int):
    """Rows ``chunk, shard, blob``: the bytes of the stretches to sort (chunk -1), or removed starts of this chunk."""

    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = tb.doc_keys(docs.column("key"))
        held: dict[int, list] = {}
        singles: list[tuple] = []
        for i, part, at, row, a, b, fp, state in _answered(docs, length, k, buckets, answers):
            alone = np.flatnonzero(state == _SPLIT)
            if len(alone):
                # strings of a split fingerprint go by themselves, by their hash, and only the first of this chunk
                n = b[alone] - a[alone]
                start = np.repeat(a[alone] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                r = np.repeat(row[alone], n)
                name = tb.RangeHash(part).of(start, start + length)
                once = np.lexsort((start, keys[i][r], name))
                once = once[_new_runs(name[once])]
                text = part[start[once][:, None] + np.arange(length)]
                singles.append((name, keys[i][r], start - at[r], np.isin(np.arange(len(name)), once), dict(zip(name[once].tolist(), text))))
            take = state == _SORT
            row, a, b, fp = row[take], a[take], b[take], fp[take]
            size = b - a + length - 1
            for s, r, aa, bb, n in tb.by_group((tb.mix(fp, 11) % np.uint64(shards)).astype(np.int64), row, a, b, size):
                where = np.repeat(aa - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                held.setdefault(s, []).append((keys[i][r], (aa - at[r]).astype(np.int64), (bb - aa).astype(np.int32), part[where]))
        gone = []
        if singles:
            name, key, start = (np.concatenate([x[j] for x in singles]) for j in range(3))
            texts = {k_: v for x in singles for k_, v in x[4].items()}
            order = np.lexsort((start, key, name))
            name, key, start = name[order], key[order], start[order]
            new = _new_runs(name)
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (key != key[first]) | (start != start[first])
            gone = _runs_of_starts(key[later], start[later])
            for s, n_, k_, st in tb.by_group((tb.mix(name[new], 13) % np.uint64(shards)).astype(np.int64), name[new], key[new], start[new]):
                held.setdefault(s, []).append((k_, st.astype(np.int64), np.ones(len(k_), np.int32), np.concatenate([texts[x] for x in n_.tolist()])))
        out = [(-1, s, tb.pack(*[np.concatenate(c) for c in zip(*v)])) for s, v in held.items()]
        if len(gone) and len(gone[0]):
            chunk = docs.column("chunk")[0].as_py()
            out.append((chunk, -1, tb.pack(*gone)))
        return pa.Table.from_batches([_rows(out)])

    return send


def _runs_of_starts(doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Removed starts as runs: document, first start, end of starts."""
    if not len(doc):
        return [doc, at, at]
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)] if len(doc) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(doc)].astype(int) - 1
    return [doc[a], at[a], at[b] + 1]


# --- suffix array by difference cover ------------------------------------------------------------------------------


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Order-preserving names 1, 2, … of keys, and how many there are."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks (1, 2, …) of all suffixes of an integer text, in the order of their first ``depth`` symbols at least.

    Suffixes that agree so far may share a rank. Symbols are positive and below 2^21 at the first level; names take
    their place below it.
    """
    n = len(text)
    if n < 3:
        return _names(np.array([sum(int(x) << (40 - 20 * j) for j, x in enumerate(text[i : i + 2])) for i in range(n)], np.int64))[0]
    padded = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    i1, i2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # one empty suffix at 1 mod 3 keeps the halves apart
    sample = np.concatenate([i1, i2])
    if padded.max() < 1 << 21:
        triple = (padded[sample] << 42) | (padded[sample + 1] << 21) | padded[sample + 2]
        names, count = _names(triple)
    else:
        pair, _ = _names((padded[sample] << 32) | padded[sample + 1])
        names, count = _names((pair << 32) | padded[sample + 2])
    if count < len(sample) and depth > 3:
        names = suffix_ranks(names, -(-depth // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sa = sample[np.argsort(names, kind="stable")]
    sa = sa[sa < n]
    i0 = np.arange(0, n, 3)
    key0 = (padded[i0] << 32) | rank[i0 + 1]
    order0 = np.argsort(key0, kind="stable")
    i0, key0 = i0[order0], key0[order0]
    s1, s2 = sa[sa % 3 == 1], sa[sa % 3 == 2]
    before1 = np.searchsorted(np.sort((padded[s1] << 32) | rank[s1 + 1]), key0)
    key2, name2 = _key_of_three(padded, rank, s2, i0)
    before = before1 + np.searchsorted(np.sort(key2), name2)
    # one more than the number of strictly smaller suffixes; beyond the depth the order of equals is free
    ranks = np.empty(n, np.int64)
    ranks[i0] = np.searchsorted(key0, key0) + before + 1
    sorted_names = rank[sa]
    lower = np.searchsorted(sorted_names, sorted_names)
    ranks[sa] = lower + np.searchsorted(np.sort(before), lower, "right") + 1
    return ranks


def _key_of_three(padded, rank, s2, i0):
    """Comparable keys (symbol, symbol, rank) of the suffixes at 2 mod 3 and at 0 mod 3."""
    a = np.concatenate([padded[s2], padded[i0]])
    b = np.concatenate([padded[s2 + 1], padded[i0 + 1]])
    c = np.concatenate([rank[s2 + 2], rank[i0 + 2]])
    if padded.max() < 1 << 15:
        key = (a << 47) | (b << 32) | c
    else:
        pair, _ = _names((a << 32) | b)
        key = (pair << 32) | c
    return key[: len(s2)], key[len(s2) :]


def equal_prefix_groups(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A group number for each start: the same for starts whose ``length`` bytes agree.

    Sorts all suffixes of the text by difference cover, walks the array and compares neighbouring prefixes.
    """
    ranks = suffix_ranks(text.astype(np.int64) + 1, length)
    order = np.argsort(ranks[starts], kind="stable")
    s = starts[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
        left = np.arange(len(s) - 1)
        for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
            x = np.ascontiguousarray(wide[s[left] + at]).view(np.uint64)[:, 0]
            y = np.ascontiguousarray(wide[s[left + 1] + at]).view(np.uint64)[:, 0]
            left = left[x == y]
        if length < 8:
            left = left[[bytes(text[s[i] : s[i] + length]) == bytes(text[s[i + 1] : s[i + 1] + length]) for i in left]]
        same[left + 1] = True
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(~same)
    return group


def _sort_shard(length: int, chunks: int):
    def sort(table: pa.Table) -> pa.Table:
        got = [tb.unpack(blob.as_buffer(), np.int64, np.int64, np.int32, np.uint8) for blob in table.column("blob").combine_chunks()]
        key, start, count, text = (np.concatenate(x) for x in zip(*got))
        del got
        size = count + length - 1
        base = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        group = equal_prefix_groups(text, base[seg] + inside, length)
        doc, at = key[seg], start[seg] + inside
        order = np.lexsort((at, doc, group))
        g, doc, at = group[order], doc[order], at[order]
        new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(g) else np.zeros(0, int)
        later = (doc != doc[first]) | (at != at[first])
        runs = _runs_of_starts(doc[later], at[later])
        return pa.Table.from_batches([_rows([(c, -1, tb.pack(*cols)) for c, *cols in tb.by_group(tb.chunk_of(runs[0], chunks), *runs)])])

    return sort


# --- cutting -------------------------------------------------------------------------------------------------------


def _whole_characters(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> str:
    """The text without some byte ranges, less the characters they cut in half."""
    gone = np.zeros(len(text), bool)
    inner = (text & 0xC0) == 0x80
    for a, b in zip(lo.tolist(), hi.tolist()):
        while a > 0 and inner[a]:
            a -= 1
        while b < len(text) and inner[b]:
            b += 1
        gone[a:b] = True
    return text[~gone].tobytes().decode("utf-8", "ignore")


def _cutter(length: int, k: int, buckets: int, keep_text: bool, carried: list[str]):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = tb.doc_keys(docs.column("key"))
        buf, offsets = tb.text_bytes(docs.column("text"))
        n = len(keys)
        spans: dict[int, list] = {}
        is_sorted = np.array([b == -1 for b in answers.column("bucket").to_pylist()], bool)
        from_sort = answers.filter(pa.array(is_sorted)) if len(answers) else answers
        for i, _, at, row, a, b, _, state in _answered(docs, length, k, buckets, answers.filter(pa.array(~is_sorted)) if len(answers) else answers):
            take = state == _COPY
            for r, aa, bb in tb.by_group(row[take], a[take], b[take]):
                spans.setdefault(int(i[r]), []).append((aa - at[r], bb - at[r]))
        if len(from_sort):
            got = [tb.unpack(x.as_buffer(), np.int64, np.int64, np.int64) for x in from_sort.column("blob").combine_chunks()]
            kk, lo, hi = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(kk, kind="stable")
            kk, lo, hi = kk[order], lo[order], hi[order]
            for r in np.flatnonzero(np.isin(keys, np.unique(kk))):
                p, q = np.searchsorted(kk, keys[r]), np.searchsorted(kk, keys[r], "right")
                spans.setdefault(int(r), []).append((lo[p:q], hi[p:q]))
        removed, n_spans, digest, kept, begins, ends = np.zeros(n, np.int64), np.zeros(n, np.int64), [], [], [], []
        for r in range(n):
            text = buf[offsets[r] : offsets[r + 1]]
            lo = hi = np.zeros(0, np.int64)
            if r in spans:
                lo, hi = (np.concatenate(x) for x in zip(*spans[r]))
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, lo, 1)
                np.add.at(step, hi - 1 + length, -1)
                gone = np.r_[False, np.cumsum(step[:-1]) > 0, False]
                edge = np.flatnonzero(gone[1:] != gone[:-1])
                lo, hi = edge[::2], edge[1::2]
                removed[r], n_spans[r] = int((hi - lo).sum()), len(lo)
                if keep_text:
                    kept.append(_whole_characters(text, lo, hi))
                text = text[~gone[1:-1]]
            elif keep_text:
                kept.append(text.tobytes().decode("utf-8", "ignore"))
            digest.append(hashlib.sha256(text.tobytes()).hexdigest())
            if keep_text:
                begins.append(lo.tolist())
                ends.append(hi.tolist())
        out = {"doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array(digest, pa.string())}
        if keep_text:
            out |= {"kept": pa.array(kept, pa.string()), "span_start": pa.array(begins, pa.list_(pa.int64())), "span_end": pa.array(ends, pa.list_(pa.int64()))}
        out |= {c: docs.column(c) for c in carried}
        return pa.table(out)

    return cut


def remove_repeats(docs: DataFrame, length: int = 100, k: int | None = None, keep_text: bool = False, carry: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier.

    Earlier means a smaller id, or the same id and a smaller start; strings are judged on the input and never cross
    documents. ``length`` is at least 16. Returns one row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256``, with ``keep_text`` also ``kept`` (the text left, less characters cut in half), ``span_start`` and
    ``span_end`` (removed runs of bytes), and the columns of ``docs`` named in ``carry``, unchanged.

    Null text counts as empty; null ids sort last. Rows that repeat an id, or null, with the same text are one document, and each
    of them is returned with its result; with different texts they are documents in the order of a hash of the text. Other columns are ignored. An empty table gives an empty table.
    """
    if length < 16:
        raise ValueError("length must be 16 bytes or more")
    k = k or length // 2
    carry = list(carry or [])
    carried = [f"carried{i}" for i in range(len(carry))]
    rows = with_keys(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *[docs[c].alias(x) for c, x in zip(carry, carried)]))
    _, volume = text_volume(rows)
    chunks, buckets, shards = parts(volume, CHUNK_BYTES), parts(volume // 2, BUCKET_BYTES), parts(volume, SHARD_BYTES)
    sent = written(rows.select("key", "text").mapInArrow(_sender(length, k, buckets, chunks, OFTEN, SPLIT_TASK), _ANSWER), "stretches")
    judged = sent.where("chunk < 0").groupBy("bucket").applyInArrow(_judge_bucket(chunks, SPLIT_ALL), _ANSWER)
    answers = written(judged.unionByName(sent.where("chunk >= 0")), "repeats")
    by_chunk = rows.withColumn("chunk", chunk_column(F.col("key"), chunks))
    pieces = written(by_chunk.drop(*carried).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_to_shards(length, k, buckets, shards), _ANSWER), "pieces")
    sorted_ = pieces.where("chunk < 0").groupBy("bucket").applyInArrow(_sort_shard(length, chunks), _ANSWER)
    intervals = written(sorted_.unionByName(pieces.where("chunk >= 0")), "intervals")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        schema += ", kept string, span_start array<long>, span_end array<long>"
    schema += "".join(f", {x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(carry, carried))
    cut = by_chunk.groupBy("chunk").cogroup(answers.unionByName(intervals).groupBy("chunk")).applyInArrow(_cutter(length, k, buckets, keep_text, carried), schema)
    return cut.toDF(*cut.columns[: len(cut.columns) - len(carry)], *carry)
