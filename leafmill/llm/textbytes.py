"""Whole texts as byte arrays inside Arrow tasks: slices, rolling hashes, words and shingles, packed blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once inside a task. A longer single text is handled alone.
SLICE_BYTES = 1 << 20
#: Stands for a null document id inside operators: it sorts last.
NULL_KEY = (1 << 63) - 1
#: Key spread of ``chunk_of``: a prime, so that ids with a common step still spread.
CHUNK_PRIME = 1_000_003

_rng = np.random.default_rng(0x1EAF)
_BYTE_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one after the other, and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of a single row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit values (a finaliser of two multiplications)."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        out = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = (out[0], out[1])
    return _powers


class RangeHash:
    """Hashes of any byte range of a buffer from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position on."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, n = values, 1
    while n * 2 <= width:
        out, n = np.minimum(out[:-n], out[n:]), n * 2
    return np.minimum(out[: len(out) - (width - n)], out[width - n :]) if n < width else out


#: Bytes that belong to words: letters, digits and every byte of a longer UTF-8 sequence; upper case folds to lower.
_FOLD = np.zeros(256, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every word; words never cross rows."""
    folded = _FOLD[buf]
    inside = folded > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][(offsets[:-1] < offsets[1:])]
    starts[first] = inside[first]
    last = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return RangeHash(folded).of(s, e), np.searchsorted(offsets, s, "right") - 1, s, e


def shingles(word: np.ndarray, row: np.ndarray, n: int, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of ``width`` words. A row with fewer words (but at least one)
    has one shingle of all of them. ``n`` rows."""
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    up, _ = powers(width + 1)
    if len(word) >= width:
        at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
        h = np.zeros(len(at), np.uint64)
        for j in range(width):
            h += word[at + j] * up[j]
    else:
        at, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < width))
    hs = np.zeros(len(short), np.uint64)
    for j in range(width - 1):
        has = count[short] > j
        hs[has] += word[begin[short[has]] + j] * up[j]
    at = np.concatenate([at, begin[short]])
    h = np.concatenate([h, mix(hs, 7)])
    order = np.argsort(at, kind="stable")
    at = at[order]
    return mix(h[order], 3), row[at] if len(at) else np.zeros(0, np.int64), at


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as one blob: their lengths, then their bytes."""
    head = np.array([len(a) for a in arrays], np.int64)
    return b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    lengths, at, out = np.frombuffer(blob, np.int64, len(types)), 8 * len(types), []
    for n, kind in zip(lengths, types):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def doc_keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).fill_null(NULL_KEY).to_numpy()


def chunk_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The chunk of a document: what ``chunk_column`` computes in Spark."""
    return (keys % CHUNK_PRIME) % n


def by_group(group: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Split arrays by an integer group, keeping the order inside each."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(g)].astype(int)):
        yield (int(g[lo]), *[a[order[lo:hi]] for a in arrays])


def pack_texts(chunks: int, flush_bytes: int = 32 << 20):
    """A task's texts (columns key, text) as compressed blobs by chunk, so that less is shuffled."""

    def send(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        held: dict[int, list] = {}
        size = 0

        def flush():
            rows = [(c, press.compress(pack(*[np.concatenate(x) for x in zip(*v)]))) for c, v in held.items()]
            held.clear()
            return pa.record_batch({"chunk": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

        for batch in batches:
            keys = doc_keys(batch.column("key"))
            buf, offsets = text_bytes(batch.column("text"))
            for c, rows in by_group(chunk_of(keys, chunks), np.arange(len(keys))):
                texts = [buf[offsets[r] : offsets[r + 1]] for r in rows]
                held.setdefault(c, []).append((keys[rows], np.diff(offsets)[rows], np.concatenate(texts)))
            size += len(buf)
            if size > flush_bytes:
                yield flush()
                size = 0
        if held:
            yield flush()

    return send


def unpack_texts(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, bytes and offsets of the texts of a chunk."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    got = [unpack(open_.decompress(b), np.int64, np.int64, np.uint8) for b in blobs.to_pylist()]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    keys, lengths, buf = (np.concatenate(x) for x in zip(*got))
    return keys, buf, np.r_[0, np.cumsum(lengths)]
