"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from the model file into arc tables and composed with each input while it is read: the
normaliser (identity characters, space to U+2581, a leading U+2581), the pieces (a trie whose accepting arcs write one
id) and byte fallback (a character without a piece writes its UTF-8 bytes' ids). The output is the shortest path.

Weights. The model is BPE, so a piece's arc weighs the merges that build it: the ascending sequence of their (rank,
place). Weights are multiplied by merging their sequences and compared element by element, the longer being less where
one is the other's beginning; this order is total and kept by multiplication, so the least weight is found place by
place as in the tropical semiring of numbers. BPE always takes the open merge of least (rank, place); the sequence it
takes is therefore the least of all paths' sequences, and the shortest path is BPE's segmentation, ties among runs of
spaces included. This needs every piece's merges to rank no later than the piece, which compilation checks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from . import _units as N
from ._cluster import released

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Units of at most this many characters are searched together, longer ones one by one.
SHORT = 32
_PLACE_BITS = 6
_NONE = 1 << 30


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a serialised message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        elif tag & 7 == 1:
            value, i = b[i : i + 8], i + 8
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            value, i = struct.unpack_from("<f", b, i)[0], i + 4
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and kinds of a model file with the identity normaliser, BPE and byte fallback."""

    def __init__(self, path: str):
        raw = open(path, "rb").read()
        pieces = [dict(_fields(v)) for f, v in _fields(raw) if f == 1]
        trainer = next((dict(_fields(v)) for f, v in _fields(raw) if f == 2), {})
        normaliser = next((dict(_fields(v)) for f, v in _fields(raw) if f == 3), {})
        if trainer.get(3) != 2 or normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only BPE models with the identity normaliser that keep white space are compiled")
        self.text = [p[1].decode("utf-8") for p in pieces]
        self.score = [p.get(2, 0.0) for p in pieces]
        self.kind = [p.get(3, NORMAL) for p in pieces]
        self.prefix = bool(normaliser.get(3, 1))
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k in (NORMAL, USER)}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == BYTE}
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else t.encode("utf-8") for t, k in zip(self.text, self.kind)]

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)


class Transducer:
    """The compiled arcs: characters are numbered from 1 by the alphabet, 0 being any character of no piece."""

    def __init__(self, model: PieceModel):
        self.model = model
        chars = sorted(set("".join(model.ids)))
        self.alphabet = np.zeros(0x110000, np.uint16)
        self.alphabet[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {c: i + 1 for i, c in enumerate(chars)}
        order = {s: i for i, s in enumerate(sorted({-model.score[i] for t, i in model.ids.items() if len(t) > 1}))}
        # arcs: a piece's weight is the least over its last merges; bare characters weigh nothing
        weights: dict[str, tuple[tuple[int, int], ...]] = dict.fromkeys(chars, ())
        for t in sorted((t for t in model.ids if len(t) > 1), key=len):
            own = order[-model.score[model.ids[t]]]
            for k in range(1, len(t)):
                if (left := weights.get(t[:k])) is None or (right := weights.get(t[k:])) is None:
                    continue
                seq = tuple(sorted((*left, *[(r, p + k) for r, p in right], (own, 0))))
                if seq[-1][0] == own and (t not in weights or seq < weights[t]):
                    weights[t] = seq
            if t not in weights:
                raise ValueError(f"the merges of {t!r} rank later than itself")
        self.longest = max(map(len, weights))
        self.arcs = [(t, w) for t, w in weights.items()]
        self.weight = [w for _, w in self.arcs]
        self.table = np.full((len(self.arcs), self.longest), _NONE, np.int32)
        for i, (t, w) in enumerate(self.arcs):
            self.table[i, : len(w)] = [(r << _PLACE_BITS) + p for r, p in w]
        # what an arc writes: its piece's id, or the ids of the character's bytes
        writes = [[model.ids[t]] if t in model.ids else [model.bytes[x] for x in t.encode("utf-8", "surrogatepass")] for t, _ in self.arcs]
        self.out_count = np.array([len(w) for w in writes])
        self.out_start = np.cumsum(self.out_count) - self.out_count
        self.out_ids = np.array([i for w in writes for i in w], np.uint32)
        self.linked = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        steps: dict[tuple[int, int], int] = {}
        accepts = [-1]
        self.width = len(chars) + 1
        for i, (t, _) in enumerate(self.arcs):
            state = 0
            for c in t:
                nxt = steps.setdefault((state, number[c]), len(accepts))
                if nxt == len(accepts):
                    accepts.append(-1)
                state = nxt
            accepts[state] = i
            for x, y in zip(t, t[1:]):
                self.linked[number[x], number[y]] = True
        self.accepts = np.array(accepts)
        self.steps = N.Lookup()
        self.steps.put(T.mix(np.array([s * self.width + c for s, c in steps], np.uint64)), np.array(list(steps.values()), np.int32))
        self.steps_of = steps

    def units(self, chars: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units: no piece lies over the place between two of them, so paths meet there. fresh
        are places where a text begins."""
        apart = np.ones(len(chars), bool)
        apart[1:] = ~self.linked[chars[:-1], chars[1:]]
        apart[fresh] = True
        starts = np.flatnonzero(apart)
        return starts, np.append(starts[1:], len(chars))

    def shortest_paths(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of the shortest path of each row (rows of equally many characters, all of the alphabet), one row
        after the other, and how many each has."""
        n, size = rows.shape
        arriving: list[list] = [[] for _ in range(size + 1)]
        for i in range(size):
            row, state = np.arange(n), np.zeros(n, np.int64)
            for j in range(i + 1, min(i + self.longest, size) + 1):
                step = self.steps.get(T.mix((state * self.width + rows[row, j - 1]).astype(np.uint64)))
                row, state = row[step >= 0], step[step >= 0].astype(np.int64)
                if not len(row):
                    break
                arc = self.accepts[state]
                there = arc >= 0
                if there.any():
                    arriving[j].append((i, row[there], arc[there]))
        weight = [np.empty((n, 0), np.int32)]
        arcs, back = np.full((size + 1, n), -1), np.zeros((size + 1, n), np.int64)
        for j in range(1, size + 1):
            best = np.full((n, j), _NONE, np.int32)
            for i, row, arc in sorted(arriving[j], key=lambda x: -x[0]):  # the bare character first: every row has it
                new = np.concatenate((weight[i][row], np.minimum(self.table[arc, : j - i] + i, _NONE)), axis=1)
                new.sort(axis=1)
                if i < j - 1:
                    held = best[row]
                    at = (new != held).argmax(axis=1)
                    less = new[np.arange(len(row)), at] < held[np.arange(len(row)), at]
                    row, arc, new = row[less], arc[less], new[less]
                best[row], arcs[j, row], back[j, row] = new, arc, i
            weight.append(best)
        path, at, all_ = np.full((n, size), -1), np.full(n, size), np.arange(n)
        while len(all_):
            p = at[all_]
            path[all_, p - 1] = arcs[p, all_]
            at[all_] = back[p, all_]
            all_ = all_[at[all_] > 0]
        used = path >= 0
        return path[used], used.sum(axis=1)

    def long_path(self, chars: list[int]) -> list[int]:
        """As shortest_paths() for one unit of any length. What all open paths share is dropped from their weights."""
        size, last = len(chars), (1 << 62,)
        best: dict[int, tuple[int, ...]] = {0: last}
        back: dict[int, tuple[int, int]] = {}
        base = 0
        for i in range(size):
            state, own = 0, best[i][:-1]
            for j in range(i + 1, min(i + self.longest, size) + 1):
                state = self.steps_of.get((state, chars[j - 1]), -1)
                if state < 0:
                    break
                arc = int(self.accepts[state])
                if arc >= 0:
                    new = (*sorted((*own, *[(r << 32) + p + i for r, p in self.weight[arc]])), *last)
                    if j not in best or new < best[j]:
                        best[j], back[j] = new, (i, arc)
            del best[i]
            if i % SHORT == SHORT - 1:
                live = sorted(best)
                meet = set(live)
                while len(meet) > 1:
                    far = max(meet)
                    meet.discard(far)
                    meet.add(back[far][0])
                common = meet.pop()
                if common > base:
                    base = common
                    for j in live:
                        keys, at = [], j
                        while at > base:
                            at, arc = back[at]
                            keys += [(r << 32) + p + at for r, p in self.weight[arc]]
                        best[j] = (*sorted(keys), *last)
        path, at = [], size
        while at:
            at, arc = back[at]
            path.append(arc)
        return path[::-1]


class PieceIds:
    """Ids of texts. Distinct units are searched once; they are known by 64-bit hashes in a bounded table."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.machine = Transducer(self.model)
        self.table = N.IdTable()
        self.terms = T.mix(np.arange(1, self.machine.width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.byte_ids = np.zeros(len(self.model.kind), bool)
        self.byte_ids[list(self.model.bytes.values())] = True

    def _learn(self, codes: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        machine, lens = self.machine, ends - starts
        alien = chars[starts] == 0  # always a unit of its own
        at = np.flatnonzero(alien)
        if len(at):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[starts[at]].tolist()]
            self.table.add(keys[at], np.array([len(x) for x in raw]), np.array([self.model.bytes[b] for x in raw for b in x], np.uint32))
        for size in np.unique(lens[~alien]).tolist():
            of_size = np.flatnonzero(~alien & (lens == size))
            for lo in range(0, len(of_size), 4096):
                at = of_size[lo : lo + 4096]
                rows = chars[starts[at][:, None] + np.arange(size)].astype(np.int64)
                if size <= SHORT:
                    arcs, n = machine.shortest_paths(rows)
                else:
                    paths = [machine.long_path(r) for r in rows.tolist()]
                    arcs, n = np.array([a for p in paths for a in p]), np.array([len(p) for p in paths])
                counts = machine.out_count[arcs]
                whole = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(n)))]
                self.table.add(keys[at], np.diff(whole), machine.out_ids[N.slices(machine.out_start[arcs], counts)])

    def _buffer(self, text: str, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a normalised buffer, and where each unit starts and its ids end."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        chars = self.machine.alphabet[codes]
        starts, ends = self.machine.units(chars, fresh)
        terms = self.terms[chars]
        alien = np.flatnonzero(chars == 0)
        terms[alien] = T.mix(codes[alien].astype(np.uint64) + np.uint64(1 << 40))
        keys = N.unit_hashes(terms, starts, ends)
        for i in np.flatnonzero(ends - starts > N.HASHED_UNIT).tolist():
            keys[i] = N.long_hash(codes[starts[i] : ends[i]].tobytes())
        entries = self.table.lookup.get(keys)
        if (entries < 0).any():
            missing = np.flatnonzero(entries < 0)
            if self.table.full(len(missing)):
                self.table.clear()
                missing = np.arange(len(keys))
            _, at = np.unique(keys[missing], return_index=True)
            new = missing[at]
            self._learn(codes, chars, starts[new], ends[new], keys[new])
            entries = self.table.lookup.get(keys)
        return *self.table.ids(entries), starts

    def of_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text. A text over N.CHUNK characters is read in parts cut before a space or line end, where no
        piece lies over the cut; a longer run without any is read whole."""
        flat = [self.model.normalise(t or "") for t in texts]
        for lo, hi in N.groups([len(t) for t in flat]):
            if hi - lo == 1 and len(flat[lo]) > N.CHUNK:
                yield np.concatenate([self._buffer(part, np.zeros(1, int))[0] for part in self._parts(flat[lo])])
                continue
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in flat[lo:hi]])))
            if not bounds[-1]:
                yield from (np.empty(0, np.uint32) for _ in range(lo, hi))
                continue
            ids, closed, starts = self._buffer("".join(flat[lo:hi]), bounds[:-1][np.diff(bounds) > 0])
            cuts = np.concatenate(([0], closed))[np.searchsorted(starts, bounds)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield ids[a:b]

    def _parts(self, text: str) -> Iterator[str]:
        lo, alphabet, linked = 0, self.machine.alphabet, self.machine.linked
        while lo < len(text):
            hi = lo + N.CHUNK
            while hi < len(text) and linked[alphabet[ord(text[hi - 1])], alphabet[ord(text[hi])]]:
                hi += 1
            yield text[lo:hi]
            lo = hi

    def decode(self, ids: np.ndarray) -> str:
        """The inverse transducer: pieces to text, byte pieces to UTF-8 (broken sequences to U+FFFD)."""
        text = b"".join(map(self.model.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


@lru_cache(2)
def piece_ids(path: str) -> PieceIds:
    """One compiled machine and its bounded table for all tasks of a worker process."""
    return PieceIds(path)


def _encode(path: str, keep_ids: bool):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_ids(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column(1).to_pylist()
                rows: tuple[list, ...] = ([], [], [], [], [])
                for text, ids in zip(texts, own.of_all(texts)):
                    raw = ids.astype("<u4").tobytes()
                    back = own.decode(ids)
                    for to, x in zip(rows, (len(ids), int(own.byte_ids[ids].sum()), zlib.crc32(raw), back == (text or "").replace(SPACE, " "), raw if keep_ids else None)):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(rows, kinds)]], ["id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip", "ids"])

    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_ids, n_byte_ids, ids_crc32, round_trip (decoding gives the text back), and ids
    (little-endian uint32) if wanted. Whole texts are encoded; no shuffle.

    Defined cases: null and empty texts have no ids, CRC 0 and round_trip true; U+2581 in a text decodes to a space; a
    null id stays null; repeated rows get a row each; other columns are ignored; an empty table gives an empty table.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInArrow(released(_encode(model_path, keep_ids)), "id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean, ids binary")
    return (out if keep_ids else out.drop("ids")).withColumnRenamed("id", id_col)
