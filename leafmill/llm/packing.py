"""Packing of tokenised documents into sequences by minimum bin slack.

Documents are tokenised in Arrow tasks; what moves on are the numbers of their pieces. Pieces are dealt by a hash of the
document into packing shards of about ``shard_docs`` documents, which are packed apart from each other: a shard's lengths
are a histogram of at most ``capacity`` counts. Each sequence starts with the longest piece left; a subset-sum bitset over the
lengths that are left finds the fullest feasible combination with it, which is then removed - as often as the counts allow,
since the fullest combination stays the fullest while it is there. A shard wastes part of its last few sequences only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textbytes as tb
from leafmill.llm.tables import doc_key, parts

TOKENIZER = "byte_bpe_50k"
_loaded: dict[str, tuple] = {}


def tokenizer(name: str = TOKENIZER):
    """A function from text to token ids, as the ``tokenizers`` file of this name gives them.

    The same vocabulary read as ranks is several times faster. It splits Latin text alike; texts with other scripts or
    with the name of a special token go through ``tokenizers`` itself.
    """
    if name not in _loaded:
        import base64
        import os
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [re.escape(t.content) for t in exact.get_added_tokens_decoder().values()]
        other = re.compile("|".join(["[^\t-\r\x20-\x7e\xa1-ɏ‐-‧]", *special]))

        def encode(text: str) -> np.ndarray:
            if other.search(text):
                return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
            return fast.encode_to_numpy(text, disallowed_special=())

        _loaded[name] = encode
    return _loaded[name]


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, before them a shorter one if something is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def _tokenise(capacity: int, end_id: int, name: str):
    def tokenise(batches):
        encode = tokenizer(name)
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            out = {c: [] for c in ("doc_id", "key", "piece", "start", "length", "ids_crc32")}
            for doc, key, text in zip(ids, keys, batch.column("text")):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut_pieces(len(tokens), capacity)):
                    for c, v in zip(out, (doc, key, piece, start, length, zlib.crc32(tokens[start : start + length].tobytes()))):
                        out[c].append(v)
            yield pa.record_batch([pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in out.items()], names=list(out))

    return tokenise


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills ``room`` best, by a bitset of reachable sums."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            more = (reach | (reach << (take * length))) & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left -= take
            take *= 2
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length (1 to ``capacity``)."""
    order = np.argsort(lengths, kind="stable")[::-1]
    waiting: dict[int, list[int]] = {}
    for i in order:
        waiting.setdefault(int(lengths[i]), []).append(int(i))
    counts = {x: len(v) for x, v in waiting.items()}
    sequence, offset, number = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for longest in list(counts):  # from the longest to the shortest
        while counts[longest]:
            counts[longest] -= 1
            chosen = fullest(counts, capacity - longest)
            counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            for _ in range(min(counts[x] // c for x, c in chosen.items())):
                at = 0
                for x, c in chosen.items():
                    for _ in range(c):
                        i = waiting[x].pop()
                        sequence[i], offset[i] = number, at
                        at += x
                    counts[x] -= c
                number += 1
    return sequence, offset


def _pack_shard(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        order = sorted(range(len(table)), key=list(zip(*[table.column(c).to_pylist() for c in ("length", "key", "piece", "ids_crc32")])).__getitem__)
        table = table.take(pa.array(order, pa.int64()))
        sequence, offset = pack_lengths(table.column("length").to_numpy(), capacity)
        shard = table.column("shard")[0].as_py() if len(table) else 0
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(sequence + (shard << 40))).append_column("offset", pa.array(offset))

    return pack


def pack_documents(
    docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_name: str = TOKENIZER, shard_docs: int = 16384, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as minimum bin slack finds.

    Only documents longer than a sequence are cut. Returns for each piece ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``. Null text counts as empty: a single end token. Rows that repeat an id are packed each for itself.
    An empty table gives an empty table. Other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), doc_key(id_column).alias("key"), F.col(text_column).alias("text"))
    shards = parts(docs.count(), shard_docs)
    pieces = rows.mapInArrow(_tokenise(capacity, end_id, tokenizer_name), "doc_id long, key long, piece int, start long, length long, ids_crc32 long")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), schema)
