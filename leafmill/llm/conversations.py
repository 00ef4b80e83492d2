"""Repair of conversations by bidirectional Dijkstra over the edit lattice.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. A node of the lattice is (turns consumed, state of that
pattern); edges keep, rerole or delete the next turn or insert an empty one. A forward heap starts at the first node, a reverse heap
at the accepting ends. Their labels are the least cost and, of that, the ASCII-least audit (the initials of the
edits). Two audits of one cost that lead to one node consume the same turns, so neither is a beginning of the other and the
lesser stays lesser whatever follows. The search goes on until the two heaps' least costs together exceed the best meeting, so
all crossings of that cost are seen, and takes the least concatenated audit.

Turns travel as flags. They are dealt out by ranges of (conversation, turn), so a conversation of any length is spread over
tasks: a task searches stretches of ``SEGMENT`` turns and hands on, for every state in which its stretch may begin, the best
way to every state in which it may end; these compose like matrices. Only the digest of a repaired conversation
is one value over all its texts: its rows stream through one task in order and are never held.
"""

from __future__ import annotations

import heapq
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tables import written

SEGMENT = 512
MARK = r"[^\x20\x09-\x0D]"
#: States: nothing yet, after the system turn, after a user, after an assistant. What comes next, and the state after it.
ASKS, THEN, ROLE = "uuau", (2, 2, 3, 2), {"u": "user", "a": "assistant"}
BEFORE = ((), (), (0, 1, 3), (2,))
ACCEPTING = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Faults of a turn as the lattice sees them.
SOUND, GONE, CUT = 0, 1, 2
LABEL = "struct<start:int,end:int,cost:long,audit:string>"


def _over(turn: tuple[str, int], state: int) -> Iterator[tuple[int, int, str]]:
    """Edges over one turn: the state after it, cost and audit."""
    initial, fault = turn
    yield state, DELETE, "D"
    if fault != GONE:
        extra = TRUNCATED if fault == CUT else 0
        if initial == ASKS[state]:
            yield THEN[state], extra, "K"
        if initial == "s" and state == 0:
            yield 1, extra, "K"
        yield THEN[state], REROLE + extra, "R"


def search(turns: list[tuple[str, int]], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """The least (cost, audit) from state ``start`` before the turns to one of the states ``ends`` after them; None without a way."""
    n = len(turns)
    into = [[[] for _ in range(4)] for _ in range(n + 1)]  # edges by the node they lead to

    def out(i: int, s: int):
        yield i, THEN[s], INSERT, "I"
        if i < n:
            for t, cost, audit in _over(turns[i], s):
                yield i + 1, t, cost, audit

    for i in range(n + 1):
        for s in range(4):
            for j, t, cost, audit in out(i, s):
                into[j][t].append((i, s, cost, audit))
    ahead, back = {(0, start): (0, "")}, {(n, e): (0, "") for e in ends}
    heap, behind = [(0, 0, start)], [(0, 0, e) for e in ends]
    done, met = set(), set()
    best = (0, "") if n == 0 and start in ends else None
    while heap or behind:
        top, low = heap[0][0] if heap else 0, behind[0][0] if behind else 0
        if best and top + low > best[0]:
            break
        if heap and (not behind or top <= low):
            _, i, s = heapq.heappop(heap)
            if (i, s) in done:
                continue
            done.add((i, s))
            cost, audit = ahead[i, s]
            for j, t, c, a in out(i, s):
                label = (cost + c, audit + a)
                if (j, t) in met:
                    rest = back[j, t]
                    whole = (label[0] + rest[0], label[1] + rest[1])
                    best = whole if best is None or whole < best else best
                if (j, t) not in done and ((j, t) not in ahead or label < ahead[j, t]):
                    ahead[j, t] = label
                    heapq.heappush(heap, (label[0], j, t))
        else:
            _, _, t = node = heapq.heappop(behind)
            j = n - node[1]
            if (j, t) in met:
                continue
            met.add((j, t))
            cost, audit = back[j, t]
            for i, s, c, a in into[j][t]:
                label = (c + cost, a + audit)
                if (i, s) in done:
                    first = ahead[i, s]
                    whole = (first[0] + label[0], first[1] + label[1])
                    best = whole if best is None or whole < best else best
                if (i, s) not in met and ((i, s) not in back or label < back[i, s]):
                    back[i, s] = label
                    # without cost only turns are kept, so later turns go first among equal costs
                    heapq.heappush(behind, (label[0], n - i, s))
    return best


class _Front:
    """Best ways from one state to the states reached so far. What all audits begin with is put away."""

    def __init__(self, start: int):
        self.head: list[str] = []
        self.tails: dict[int, tuple[int, str]] = {start: (0, "")}

    def advance(self, hops) -> None:
        """``hops(state)`` gives (end, cost, audit) of the ways on from a state."""
        tails: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.tails.items():
            for end, c, a in hops(state):
                label = (cost + c, audit + a)
                if end not in tails or label < tails[end]:
                    tails[end] = label
        if 3 in tails:  # whatever follows, from the last state it costs at most a deletion more than from any other
            tails = {s: x for s, x in tails.items() if x[0] <= tails[3][0] + DELETE}
        begin = os.path.commonprefix([a for _, a in tails.values()])
        self.head.append(begin)
        self.tails = {s: (c, a[len(begin) :]) for s, (c, a) in tails.items()}

    def labels(self) -> dict[int, tuple[int, str]]:
        head = "".join(self.head)
        return {s: (c, head + a) for s, (c, a) in self.tails.items()}


def _segment_hops(turns: list[tuple[str, int]]):
    def hops(state: int):
        for end in range(4):
            found = search(turns, state, (end,))
            if found:
                yield end, *found

    return hops


def _pieces(conv_type: pa.DataType):
    """Per conversation of a sorted partition one row: the ways through it, its illegal neighbours, its first and last initial."""

    def run(batches):
        piece = TaskContext.get().partitionId()
        out: dict[str, list] = {}

        def close(conv, fronts, turns, illegal, first, last, opened, ended):
            whole = opened and ended
            if whole and len(fronts[0].tails) == 1 and not fronts[0].head:
                cost, audit = search(turns, 0, ACCEPTING)
                labels = [(0, 3, cost, audit)]
            else:
                labels = []
                for start, front in enumerate(fronts):
                    if turns:
                        front.advance(_segment_hops(turns))
                    labels += [(start, end, cost, audit) for end, (cost, audit) in front.labels().items()]
            row = {"conv": conv, "piece": piece, "whole": whole, "labels": [dict(zip(("start", "end", "cost", "audit"), x)) for x in labels], "illegal": illegal, "first": first, "last": last}
            for name, value in row.items():
                out.setdefault(name, []).append(value)

        schema = pa.schema(
            {"conv": conv_type, "piece": pa.int32(), "whole": pa.bool_(), "labels": pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "cost": pa.int64(), "audit": pa.string()})), "illegal": pa.int64(), "first": pa.string(), "last": pa.string()}
        )
        current = None  # conversation, fronts, turns of the open stretch, illegal, first, last, whether it begins here
        for batch in batches:
            for conv, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "initial", "fault"))):
                if current is None or current[0] != conv:
                    opened = current is not None
                    if opened:
                        close(*current, True)
                    # the first of a partition may go on from the partition before
                    current = [conv, [_Front(s) for s in range(1 if opened else 4)], [], 0, initial, None, opened]
                _, fronts, turns, *_ = current
                if len(turns) == SEGMENT:
                    for front in fronts:
                        front.advance(_segment_hops(turns))
                    current[2] = turns = []
                turns.append((initial, fault))
                current[3] += current[5] is not None and current[5] + initial not in ("su", "ua", "au")
                current[5] = initial
            if len(out.get("conv", ())) > 4096:
                yield pa.RecordBatch.from_pydict(out, schema)
                out.clear()
        if current is not None:
            close(*current, False)
        if out:
            yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _compose(table: pa.Table) -> pa.Table:
    """All pieces of one conversation, in order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    front, illegal, last = _Front(0), 0, None
    for r in rows:
        ways: dict[int, list] = {}
        for x in r["labels"]:
            ways.setdefault(x["start"], []).append((x["end"], x["cost"], x["audit"]))
        front.advance(lambda state, ways=ways: ways.get(state, ()))
        illegal += r["illegal"] + (last is not None and last + r["first"] not in ("su", "ua", "au"))
        last = r["last"]
    cost, audit = min(label for s, label in front.labels().items() if s in ACCEPTING)
    return pa.table({"conv": table.column("conv").slice(0, 1), "cost": pa.array([cost], pa.int64()), "audit": pa.array([audit], pa.string()), "illegal": pa.array([illegal], pa.int64())})


def judged_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, k, copy, fault``: the turns with their first fault (blank, duplicate, truncated, or null).

    Turns of a conversation are in the order of ``turn`` (nulls first), then role, text digest ``k`` and ``copy``. Null roles and texts are one space.
    Equal turns are counted before they travel; the earliest turn with a role and text is a minimum, so hot groups never meet.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))
    units = plain.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.sha2("text", 256))
    units = written(units, "turns")
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = units.groupBy("conv", "role", "k").agg(F.min(place).alias("first")).select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("k").alias("t"), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("k") == F.col("t"))
    copies = units.join(first, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    fault = (
        F.when(~F.col("text").rlike(MARK), "blank")
        .when((F.col("copy") > 1) | (F.col("first") < place), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return written(copies.select("conv", "turn", "role", "text", "k", "copy", fault.alias("fault")), "judged")


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("k"), F.asc("copy")]


def repairs(judged: DataFrame) -> DataFrame:
    """``conv, cost, audit, illegal`` of every conversation: its cheapest repair, of equal ones the least audit, and its pairs of neighbours out of order."""
    kind = judged.schema["conv"].dataType
    lattice = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(SOUND)
    flags = judged.select("conv", "turn", "role", "k", "copy", F.substring("role", 1, 1).alias("initial"), lattice.alias("fault"))
    ranged = flags.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    conv = f"conv {kind.simpleString()}"
    arrow = pa.schema(judged.sparkSession.createDataFrame([], f"x {kind.simpleString()}").toArrow().schema).field("x").type
    pieces = written(ranged.mapInArrow(_pieces(arrow), f"{conv}, piece int, whole boolean, labels array<{LABEL}>, illegal long, first string, last string"), "pieces")
    ready = pieces.where("whole").select("conv", F.col("labels")[0]["cost"].alias("cost"), F.col("labels")[0]["audit"].alias("audit"), "illegal")
    joined = pieces.where("not whole").groupBy("conv").applyInArrow(_compose, f"{conv}, cost long, audit string, illegal long")  # two conversations a task at most
    return written(ready.unionByName(joined), "repairs")


def _rewrite(schema: pa.Schema):
    """Rows of sorted conversations, each led by its audit: the rows after the edits."""

    def run(batches):
        audit, at, state, place, conv = "", 0, 0, 0, None
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}

            def put(role, text, step):
                nonlocal place, state
                for name, value in zip(schema.names, (conv, place, role, text)):
                    out[name].append(value)
                place += role is not None
                state = step

            def inserts():
                nonlocal at
                while audit[at : at + 1] == "I":
                    at += 1
                    put(ROLE[ASKS[state]], "", THEN[state])

            rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text")))
            for conv, found, role, text in rows:
                if found is not None:
                    audit, at, state, place = found, 0, 0, 0
                    put(None, None, 0)  # a conversation of which nothing is left is still told of
                    inserts()
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(role, text, 1 if role[:1] == "s" and state == 0 else THEN[state])
                elif edit == "R":
                    put(ROLE[ASKS[state]], text, THEN[state])
                inserts()
            if out["conv"]:
                yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _digests(schema: pa.Schema):
    def run(batches):
        import hashlib

        conv, sha, begun = None, None, False
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            for conv_, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if role is None:
                    if sha is not None:
                        out["conv"].append(conv)
                        out["sha256"].append(sha.hexdigest())
                    conv, sha, begun = conv_, hashlib.sha256(), False
                    continue
                sha.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True
            if out["conv"]:
                yield pa.RecordBatch.from_pydict(out, schema)
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"conv": [conv], "sha256": [sha.hexdigest()]}, schema)

    return run


def _edited(judged: DataFrame, repaired: DataFrame) -> tuple[DataFrame, pa.DataType, str]:
    kind = judged.schema["conv"].dataType
    arrow = judged.sparkSession.createDataFrame([], f"x {kind.simpleString()}").toArrow().schema.field("x").type
    lead = repaired.select("conv", "audit")
    rows = lead.unionByName(judged.select("conv", "turn", "role", "text", "k", "copy"), allowMissingColumns=True)
    ordered = rows.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.col("audit").isNull(), *_order()[1:])
    schema = pa.schema({"conv": arrow, "place": pa.int64(), "role": pa.string(), "text": pa.string()})
    return ordered.select("conv", "audit", "role", "text").mapInArrow(_rewrite(schema), f"conv {kind.simpleString()}, place long, role string, text string"), arrow, kind.simpleString()


def repaired_turns(judged: DataFrame, repaired: DataFrame) -> DataFrame:
    """``conv, place, role, text``: the conversations after their repair, places from 0."""
    return _edited(judged, repaired)[0].where("role is not null")


def repaired_digests(judged: DataFrame, repaired: DataFrame) -> DataFrame:
    """``conv, sha256`` of the lines ``role:text`` of each repaired conversation, joined by newlines."""
    rows, arrow, kind = _edited(judged, repaired)
    return rows.mapInArrow(_digests(pa.schema({"conv": arrow, "sha256": pa.string()})), f"conv {kind}, sha256 string")


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``turns``: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256``.

    ``gaps`` counts the numbers missing between the least and the greatest turn. A turn's first fault counts: blank,
    a role and text seen earlier in its conversation, or a last mark other than ``.!?``. Null roles and texts are one space (blank, and a role that cannot be
    kept); a null conversation is a conversation of its own; null turns come first; equal turns are separate turns. An empty table gives
    an empty table. Other columns are ignored.
    """
    judged = judged_turns(turns, conv, turn, role, text)
    found = repairs(judged)
    of = lambda name: F.count_if(F.col("fault") == name).alias(name)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = judged.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), of("blank"), of("duplicate"), of("truncated"))
    every = stats.unionByName(found, allowMissingColumns=True).unionByName(repaired_digests(judged, found), allowMissingColumns=True)
    return every.groupBy("conv").agg(*[F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256")])


def damaged(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults dealt by ``crc32(conv:turn) % 20``: 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")), F.lit(20))
    dealt = table.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), fate.alias("fate")).where("fate > 0")
    worn = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = dealt.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), worn.alias("text"), F.explode(twice))
    return rows.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text))
