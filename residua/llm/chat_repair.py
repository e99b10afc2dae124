"""Damaged conversations audited and repaired by cheapest edits: shortest paths on (row, state of the grammar), by Dial's buckets.

The grammar of role initials, (s?(ua)+)?, has four states: 0 before anything, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
In each state at most one of u and a may follow, so an edit's initial decides where it leads: Keep, Rerole, Insert, Delete.
Rows that must go cost the same on every path and lead from each state to itself, so the graph holds the other rows only and
their Ds are put back where ties ask for them: before any other edit of the same gap, as D is the least initial.

A conversation is cut into segments of at most SEGMENT_ROWS rows. Distances from a segment's entry to each exit compose by
minimum and sum, so segments are searched in parallel and only 4 x 4 tables meet; texts are never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._cluster import checked, discard, released, written

SEGMENT_ROWS = 4096
#: What an edit costs, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The characters that are no words, and those that end a whole text.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"

STATES = 4
ENDS = (0, 3)
#: State after an initial (0 s, 1 u, 2 a, 3 any other), and the initial of the role that an inserted or reroled row takes.
AFTER = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
WANTED = (1, 1, 2, 1)
ROLE = {1: "user", 2: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: First faults of a row; a code is initial + 4 * fault.
SOUND, BLANK, REPEATED, CUT = range(4)
#: Rows of the texts seen more than once that may be broadcast.
SEEN_ROWS = 200_000


def _arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row that may stay: (initial, cost, next state), in the order of initials."""
    initial, extra = code % 4, TRUNCATED if code // 4 == CUT else 0
    out = []
    for s in range(STATES):
        arcs = [("D", DELETE, s)]
        if initial in AFTER[s]:
            arcs.append(("K", KEEP + extra, AFTER[s][initial]))
        arcs.append(("R", REROLE + extra, AFTER[s][WANTED[s]]))
        out.append(arcs)
    return out


ARCS = {code: _arcs(code) for code in range(16) if code // 4 in (SOUND, CUT)}
INTO = {code: [[(cost, s) for s in range(STATES) for _, cost, to in arcs[s] if to == t] for t in range(STATES)] for code, arcs in ARCS.items()}
INSERTED_INTO = [[s for s in range(STATES) if AFTER[s][WANTED[s]] == t] for t in range(STATES)]


def distances(codes: bytes, exits: list[int | None], last: bool) -> list[list[int]]:
    """Cheapest cost from each (row, state) to the end, by a bucket queue run backwards; exits holds the costs after the last
    row. Inserts stand before a row, and after the last one only where the conversation ends."""
    m = len(codes)
    best: list[list[int | None]] = [[None] * STATES for _ in range(m + 1)]
    buckets: list[list[tuple[int, int]]] = []

    def reach(cost: int, i: int, s: int) -> None:
        if best[i][s] is None or cost < best[i][s]:
            best[i][s] = cost
            while len(buckets) <= cost:
                buckets.append([])
            buckets[cost].append((i, s))

    for s, cost in enumerate(exits):
        if cost is not None:
            reach(cost, m, s)
    d = 0
    while d < len(buckets):
        for i, s in buckets[d]:  # grows while arcs of no cost are followed
            if best[i][s] != d:
                continue
            if i < m or last:
                for p in INSERTED_INTO[s]:
                    reach(d + INSERT, i, p)
            if i:
                for cost, p in INTO[codes[i - 1]][s]:
                    reach(d + cost, i - 1, p)
        buckets[d] = []
        d += 1
    return best


def walk(codes: bytes, best: list[list[int]], state: int, last: bool) -> tuple[int, str]:
    """(state after the last row, initials) of the least string along tight arcs."""
    i, out = 0, []
    while i < len(codes) or (last and best[i][state]):
        here = best[i][state]
        arcs = ARCS[codes[i]][state] if i < len(codes) else []
        to = AFTER[state][WANTED[state]]
        if arcs and arcs[0][1] + best[i + 1][state] == here:
            out.append("D")
            i += 1
        elif best[i][to] is not None and INSERT + best[i][to] == here:
            out.append("I")
            state = to
        else:
            initial, _, state = next(a for a in arcs[1:] if best[i + 1][a[2]] is not None and a[1] + best[i + 1][a[2]] == here)
            out.append(initial)
            i += 1
    return state, "".join(out)


@lru_cache(maxsize=1 << 14)
def _whole(codes: bytes) -> tuple[int, str]:
    best = distances(codes, [0 if s in ENDS else None for s in range(STATES)], True)
    return best[0][0], walk(codes, best, 0, True)[1]


def _live(codes: bytes) -> bytes:
    return bytes(c for c in codes if c // 4 in (SOUND, CUT))


def _with_forced(codes: bytes, copies: list[int] | None, edits: str) -> tuple[int, str]:
    """(cost of the rows that must go, edits with their Ds): each D directly follows the row before, ahead of inserts."""
    out, at, gone = [], 0, 0
    for k, code in enumerate(codes):
        n = copies[k] if copies is not None else 1
        if code // 4 in (SOUND, CUT):
            end = at
            while edits[end] == "I":
                end += 1
            out.append(edits[at : end + 1])
            at, n = end + 1, n - 1
        out.append("D" * n)
        gone += n
    return DELETE * gone, "".join(out) + edits[at:]


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, live, t, r, x, n): the rows after damage, equal ones counted in n; rows that were dropped leave one with live false."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(id_col).alias("c"), F.col(turn_col).cast("long").alias("t"), text(role_col).alias("r"), text(text_col).alias("x"), F.crc32(F.concat_ws(":", text(id_col), text(turn_col)).cast("binary")).alias("h"))
    h = F.col("h") % 20
    live = h != 0
    hit = rows.select(
        "c", live.alias("live"), F.when(live, F.col("t")).alias("t"),
        F.when(h == 0, "").when(h == 4, "user").otherwise(F.col("r")).alias("r"),
        F.when((h == 0) | (h == 1), "").when(h == 2, F.regexp_replace("x", "[.!?]", "")).otherwise(F.col("x")).alias("x"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("n"),
    )
    return hit.groupBy("c", "live", "t", "r", "x").agg(F.sum("n").alias("n"))


def _coded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with code: initial + 4 * first fault of the first of its n copies, the table of repeated texts that it reads)."""
    faced = rows.withColumns({"last": F.right(F.rtrim("x", F.lit(SPACE)), F.lit(1)), "digest": F.sha2(F.col("x").cast("binary"), 256), "when": F.struct(F.col("t").isNotNull().alias("k"), F.col("t").alias("t"))})
    seen = faced.where("live and last <> ''").groupBy("c", "r", "digest").agg(F.min("when").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    seen = written(seen, "seen")
    side = checked(seen, SEEN_ROWS).select(F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("digest").alias("digest2"), "first")
    on = F.col("c").eqNullSafe(F.col("c2")) & (F.col("r") == F.col("r2")) & (F.col("digest") == F.col("digest2"))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("first").isNotNull() & ~F.col("when").eqNullSafe(F.col("first")), REPEATED).when(~F.col("last").isin(*STOPS), CUT).otherwise(SOUND)
    initial = F.when(F.col("r").startswith("s"), 0).when(F.col("r").startswith("u"), 1).when(F.col("r").startswith("a"), 2).otherwise(3)
    return faced.join(side, on, "left").select("c", "live", "t", "r", "x", "n", (initial + 4 * fault).cast("int").alias("code")), seen


def _segments(id_type: pa.DataType, rows: int) -> Callable:
    """Task over rows in order: rows that may stay as (c, seg, pos, r, x), and after each segment one with pos -1, its codes,
    copies (null: all 1) and its first, last and number of turns. seg rises with the order of the whole table."""
    schema = pa.schema([("c", id_type), ("seg", pa.int64()), ("pos", pa.int32()), ("r", pa.string()), ("x", pa.string()), ("codes", pa.binary()), ("copies", pa.list_(pa.int64())), ("t0", pa.int64()), ("t1", pa.int64()), ("turns", pa.int64())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, current, codes, copies, t0, t1, turns = (TaskContext.get().partitionId() << 32) - 1, None, None, [], None, None, 0

        def closed() -> tuple:
            return (current, seg, -1, None, None, bytes(codes), copies if max(copies, default=1) > 1 else None, t0, t1, turns)

        for batch in batches:
            out = []
            ids, live, ts, roles, texts, ns, cs = (batch.column(k) for k in ("c", "live", "t", "r", "x", "n", "code"))
            for k, (c, alive, t, n, code) in enumerate(zip(ids.to_pylist(), live.to_pylist(), ts.to_pylist(), ns.to_pylist(), cs.to_pylist())):
                if codes is None or c != current or len(codes) >= rows:
                    if codes is not None:
                        out.append(closed())
                    seg, current, codes, copies, t0, t1, turns = seg + 1, c, bytearray(), [], None, None, 0
                if not alive:
                    continue
                if code // 4 in (SOUND, CUT):
                    out.append((c, seg, len(codes), roles[k].as_py(), texts[k].as_py(), None, None, None, None, None))
                codes.append(code)
                copies.append(n)
                if t is not None:
                    turns += t != t1
                    t0, t1 = (t if t0 is None else t0), t
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
        if codes is not None:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(closed()), schema)], schema=schema)

    return run


def _mapped(make: Callable, columns: list[str], schema: pa.Schema) -> Callable:
    """Task that turns each row's values of columns into one row of schema."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [make(*values) for values in zip(*(batch.column(c).to_pylist() for c in columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return run


def _table(codes: bytes, last: bool) -> list[list[int | None]]:
    """For each exit state the costs from the four entry states; for the last segment the one list to the end."""
    live = _live(codes)
    if last:
        return [distances(live, [0 if s in ENDS else None for s in range(STATES)], True)[0]]
    return [distances(live, [0 if s == t else None for s in range(STATES)], False)[0] for t in range(STATES)]


def _ends(group: pa.Table) -> pa.Table:
    """Group of one conversation's tables in order: each segment's costs after its last row, back from the end."""
    group = group.sort_by("seg")
    after, out = [0 if s in ENDS else None for s in range(STATES)], []
    for k, table in enumerate(reversed(group["table"].to_pylist())):
        out.append(after)
        after = table[0] if k == 0 else [min((row[s] + a for row, a in zip(table, after) if row[s] is not None and a is not None), default=None) for s in range(STATES)]
    return pa.table({"seg": group["seg"], "exits": pa.array(out[::-1], pa.list_(pa.int64()))})


def _chosen(group: pa.Table) -> pa.Table:
    """Group of one conversation's walks in order: the state in which each segment is entered."""
    group = group.sort_by("seg")
    state, out = 0, []
    for states in group["states"].to_pylist():
        out.append(state)
        state = states[state]
    return pa.table({"seg": group["seg"], "entry": pa.array(out, pa.int32())})


def _walks(codes: bytes, copies: list[int] | None, exits: list[int | None], last: bool) -> tuple[list, list, list]:
    """From each entry state: (state after, edits, cost) of a segment; exits are the costs after its last row."""
    live = _live(codes)
    least = min(e for e in exits if e is not None)
    best = distances(live, [None if e is None else e - least for e in exits], last)
    states, edits, costs = [], [], []
    for s in range(STATES):
        if best[0][s] is None:
            states.append(None), edits.append(None), costs.append(None)
            continue
        after, own = walk(live, best, s, last)
        gone, own = _with_forced(codes, copies, own)
        states.append(after), edits.append(own), costs.append(gone + best[0][s] - (0 if last else best[-1][after]))
    return states, edits, costs


def _audits(table: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(seg, edits, cost) of each segment, and the tables that it reads."""
    order = Window.partitionBy("c").orderBy("seg")
    segs = written(table.where("pos = -1").select("c", "seg", "codes", "copies", F.lag("seg").over(order).isNull().alias("first"), F.lead("seg").over(order).isNull().alias("last")), "segments")
    ddl = "seg long, edits string, cost long"

    def whole(seg: int, codes: bytes, copies: list[int] | None) -> tuple[int, str, int]:
        cost, edits = _whole(_live(codes))
        gone, edits = _with_forced(codes, copies, edits)
        return seg, edits, cost + gone

    one = segs.where("first and last").mapInArrow(_mapped(whole, ["seg", "codes", "copies"], pa.schema([("seg", pa.int64()), ("edits", pa.string()), ("cost", pa.int64())])), ddl)
    parts = segs.where("not (first and last)")
    if parts.isEmpty():
        return one, [segs]
    nested = pa.list_(pa.list_(pa.int64()))
    tables = parts.mapInArrow(_mapped(lambda c, seg, codes, last: (c, seg, _table(codes, last)), ["c", "seg", "codes", "last"], pa.schema([("c", _arrow_type(segs)), ("seg", pa.int64()), ("table", nested)])), f"c {_id_type(segs)}, seg long, table array<array<long>>")
    ends = written(tables.groupBy("c").applyInArrow(_ends, "seg long, exits array<long>"), "ends")
    found = pa.schema([("c", _arrow_type(segs)), ("seg", pa.int64()), ("states", pa.list_(pa.int32())), ("edits", pa.list_(pa.string())), ("costs", pa.list_(pa.int64()))])
    walked = parts.join(ends, "seg").mapInArrow(_mapped(lambda c, seg, *rest: (c, seg, *_walks(*rest)), ["c", "seg", "codes", "copies", "exits", "last"], found), f"c {_id_type(segs)}, seg long, states array<int>, edits array<string>, costs array<long>")
    walked = written(walked, "walks")
    entries = walked.select("c", "seg", "states").groupBy("c").applyInArrow(_chosen, "seg long, entry int")
    some = walked.join(entries, "seg").select("seg", F.col("edits")[F.col("entry")].alias("edits"), F.col("costs")[F.col("entry")].alias("cost"))
    return one.unionByName(some), [segs, ends, walked]


def _id_type(df: DataFrame) -> str:
    return df.schema["c"].dataType.simpleString()


def _arrow_type(df: DataFrame) -> pa.DataType:
    return to_arrow_type(df.schema["c"].dataType)


OUTPUT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


class _Answer:
    """One conversation in the making: counts, edits and the digest of its repaired rows."""

    def __init__(self, c: object) -> None:
        self.c, self.hash, self.any, self.state = c, hashlib.sha256(), False, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.t0 = self.t1 = self.before = None
        self.audit, self.edits, self.at, self.codes, self.copies, self.pos = [], "", 0, b"", None, 0

    def segment(self, codes: bytes, copies: list[int] | None, t0: int | None, t1: int | None, turns: int, edits: str, cost: int) -> None:
        self.finish()
        self.codes, self.copies, self.edits, self.at, self.pos = codes, copies, edits, 0, 0
        self.audit.append(edits)
        self.cost += cost
        if t0 is not None:
            self.turns += turns - (t0 == self.t1)
            self.t0, self.t1 = (t0 if self.t0 is None else self.t0), t1
        if not codes:
            return
        kind, n = np.frombuffer(codes, np.uint8), np.ones(len(codes), np.int64) if copies is None else np.array(copies, np.int64)
        initial, fault = kind % 4, kind // 4
        self.blank += int(n[fault == BLANK].sum())
        self.duplicate += int(n[fault == REPEATED].sum() + (n[(fault == SOUND) | (fault == CUT)] - 1).sum())
        self.truncated += int((fault == CUT).sum())
        chain = initial.tolist() if self.before is None else [self.before, *initial.tolist()]
        self.illegal += sum(p not in LEGAL for p in zip(chain, chain[1:])) + int((n - 1).sum())
        self.before = int(initial[-1])

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":").encode())
        self.hash.update(text.encode())
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            role = WANTED[self.state]
            self._say(ROLE[role], "")
            self.state, self.at = AFTER[self.state][role], self.at + 1

    def _skip(self, pos: int) -> None:
        """Past the Ds of rows that must go before row pos."""
        while self.pos < pos:
            self.at += 1 if self.copies is None else self.copies[self.pos]
            self.pos += 1

    def row(self, pos: int, role: str, text: str) -> None:
        self._skip(pos)
        self._inserts()
        edit, code = self.edits[self.at], self.codes[pos]
        if edit != "D":
            initial = code % 4 if edit == "K" else WANTED[self.state]
            self._say(role if edit == "K" else ROLE[initial], text)
            self.state = AFTER[self.state][initial]
        self.at += 1 if self.copies is None else self.copies[pos]
        self.pos = pos + 1

    def finish(self) -> None:
        self._skip(len(self.codes))
        self._inserts()

    def result(self) -> tuple:
        self.finish()
        gaps = 0 if self.t0 is None else min(self.t1 - self.t0 + 1 - self.turns, (1 << 63) - 1)
        return (self.c, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _answers(id_type: pa.DataType) -> Callable:
    """Task over segments, each before its rows, in order: one row per conversation, holding one batch and one digest."""
    types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["pos"] < 0:
                    if answer is None or row["c"] != answer.c:
                        if answer is not None:
                            out.append(answer.result())
                        answer = _Answer(row["c"])
                    answer.segment(*(row[k] for k in ("codes", "copies", "t0", "t1", "turns", "edits", "cost")))
                else:
                    answer.row(row["pos"], row["r"], row["x"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=["c", *OUTPUT])
        if answer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(answer.result(), types)], names=["c", *OUTPUT])

    return run


def repair_conversations(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation of the input: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are dealt out by ranges of (id, turn, role, text), so a conversation of any size is spread over tasks; segments are
    searched apart and their 4 x 4 tables joined (a list of one in segment_rows of its rows). Only the digest, one chain by
    its nature, passes a conversation's rows through one task, one batch at a time.

    Defined cases: a null role, text, and for the damage a null id or turn, is one space; null turns come first and count in
    no gap; rows of one turn go by role, then text; repeated rows are duplicates after the first; a conversation without
    rows after damage has zeros, an empty audit and the digest of nothing; a null id is a conversation of its own; other
    columns are left out; an empty table gives an empty table.
    """
    rows = written(damaged(conversations, id_col, turn_col, role_col, text_col), "damaged")
    coded, seen = _coded(rows)
    id_type, order = _arrow_type(rows), ["c", "live", "t", "r", "x"]
    cut = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(cut.mapInArrow(_segments(id_type, segment_rows), f"c {_id_type(rows)}, seg long, pos int, r string, x string, codes binary, copies array<long>, t0 long, t1 long, turns long"), "cut")
    audits, read = _audits(table)
    heads = table.where("pos = -1").join(audits, "seg").select(*table.columns, "edits", "cost")
    stream = heads.unionByName(table.where("pos >= 0"), allowMissingColumns=True).repartition("c").sortWithinPartitions("c", "seg", "pos")
    ddl = f"c {_id_type(rows)}, " + ", ".join(f"{k} long" for k in OUTPUT[:6]) + ", audit string, repaired_sha256 string"
    out = written(stream.mapInArrow(_answers(id_type), ddl), "repaired")
    discard(rows, seen, table, *read)
    return out.withColumnRenamed("c", id_col)


def repair_sql() -> str:
    """DuckDB SQL of the query: every cheapest (cost, edits) to each state, row by row forwards, CRC-32 by nibbles."""
    say = {"u": "user", "a": "assistant"}
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    moves, ends = [], []
    for start in follow:
        s, before, said = start, "", []
        for _ in range(3):  # two inserts reach every state that any number does
            for initial in "suax":
                edits = [("D", 4, s, "NULL")]
                if initial in follow[s]:
                    edits.append(("K", 0, follow[s][initial], "'keep'"))
                need = "a" if s == 2 else "u"
                edits.append(("R", 3, follow[s][need], f"'{say[need]}'"))
                moves += [f"({start}, '{initial}', '{before}{label}', {3 * len(before) + cost}, {to}, {[f'{r}:' for r in said]}::VARCHAR[], {how})" for label, cost, to, how in edits]
            if s in (0, 3):
                ends.append(f"({start}, '{before}', {3 * len(before)}, {[f'{r}:' for r in said]}::VARCHAR[])")
            need = "a" if s == 2 else "u"
            s, before, said = follow[s][need], before + "I", [*said, say[need]]
    return f"""
WITH RECURSIVE nib AS (
  SELECT list_transform(range(16), lambda k: list_reduce([k, 0, 1, 2, 3], lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(regexp_replace(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: (strpos('0123456789ABCDEF', x) - 1)::BIGINT) AS xs FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], xs), lambda c, x: xor(c // 16, t[(xor(c, x) % 16 + 1)::INT])), 4294967295::BIGINT) % 20 AS h FROM source, nib
), hit AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) k(k) WHERE h <> 0 AND (k = 0 OR h = 3)
), told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS stop, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM hit
), faced AS (
  SELECT *, CASE WHEN stop = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN stop NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM told
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faced GROUP BY conv_id
), moves(s, initial, edits, cost, goal, said, how) AS (VALUES {", ".join(moves)}
), ends(s, edits, cost, said) AS (VALUES {", ".join(ends)}
), paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM conversations
  UNION ALL
  SELECT conv_id, i, s, best.cost, best.audit, best.said FROM (
    SELECT p.conv_id, f.i, m.goal AS s, arg_min(struct_pack(cost := p.cost + m.cost + CASE WHEN m.how IS NOT NULL AND f.fault = 'truncated' THEN 3 ELSE 0 END, audit := p.audit || m.edits,
        said := list_concat(p.said, m.said, CASE WHEN m.how IS NULL THEN [] ELSE [CASE m.how WHEN 'keep' THEN f.role ELSE m.how END || ':' || f.text] END)),
      row(p.cost + m.cost + CASE WHEN m.how IS NOT NULL AND f.fault = 'truncated' THEN 3 ELSE 0 END, p.audit || m.edits)) AS best
    FROM paths p JOIN faced f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN moves m ON m.s = p.s AND m.initial = f.initial AND (m.how IS NULL OR f.fault NOT IN ('blank', 'duplicate'))
    GROUP BY p.conv_id, f.i, m.goal) b
), closed AS (
  SELECT p.conv_id, arg_min(struct_pack(cost := p.cost + e.cost, audit := p.audit || e.edits, said := list_concat(p.said, e.said)), row(p.cost + e.cost, p.audit || e.edits)) AS best
  FROM paths p JOIN ends e ON e.s = p.s LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(f.n, 0) GROUP BY p.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.said, chr(10))) AS repaired_sha256 FROM closed c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id"""
