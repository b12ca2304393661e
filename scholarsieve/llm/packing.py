"""Packing documents into training sequences: bounded-space online best fit.

Every task encodes its documents in order and keeps a fixed number of open windows. A document's full windows are
sequences of their own; its rest goes where it leaves the least room. Where it fits nowhere and all windows are
open, the fullest one is emitted; when that has room for `LEAST_CUT` tokens or more, the head of the rest fills it
and only the tail goes on. Windows still open at the end of a task are leftovers: groups of `FAN_IN` tasks join
theirs and cut them into full sequences, round after round, until one group is left; its last tokens become
sequences whose lengths are powers of two, which need no padding. Each round is stored, a task holds at most its
open windows, and a group at most FAN_IN x OPEN_WINDOWS windows.

Encoding: the tokenizer encodes each word and each run of marks on its own, so a distinct one is encoded once and
remembered (up to about `REMEMBERED` a worker, in two generations). Texts of Latin-1 characters are divided as the tokenizer's own rules
divide them, and unseen parts are encoded together; pieces between blanks with other characters go to the tokenizer
as they are. Ids are those of the library on the whole text, which the tests check.

Nulls and edge cases: a null or empty text is its end id; repeated rows and null ids are packed like others; special
tokens' strings in texts get their special ids, as the library's plain call gives. An empty table has no sequences.
Other columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scholarsieve.llm.common import stored
from scholarsieve.llm.encoding import (
    BYTE_NAMES, CONTRACTIONS, NUMBER, PLAIN as _PLAIN, SEGMENT, SPACE, SPECIAL as _SPECIAL, PartEncoder, as_bytes, classes, part_contractions)

LENGTH = 4096
OPEN_WINDOWS = 64
LEAST_CUT = 16
FAN_IN = 32
END_ID = 2
REMEMBERED = 300_000
BATCH_TOKENS = 1 << 17

PIECES = "doc_id long, start long, ids array<int>, doc_tokens long, sequence_id long, offset long, origin long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32())), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("origin", pa.int64())])

# The letters and numbers of Latin-1.
LETTERS = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
# Words come first, because most parts are words and none begins like the other alternatives.
_PARTS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|{'|'.join(CONTRACTIONS)}|[^\\s{LETTERS}{NUMBERS}]+")
_KIND = classes(LETTERS, NUMBERS)
_NAMES = BYTE_NAMES | {32: " "}  # blanks part


class Encoder(PartEncoder):
    """Ids of texts under a word-level tokenizer with lower case."""

    def __init__(self, path: str):
        super().__init__(path, REMEMBERED)
        from tokenizers import Tokenizer, pre_tokenizers
        # For parts that are divided, in lower case and written in `BYTE_NAMES` already.
        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        suffix = "</w>"
        vocabulary = self.parts.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def divide(self, text: str) -> list[str]:
        """A blank begins the parts that the tokenizer has to divide itself."""
        found = []
        for piece in text.split(" "):
            if _PLAIN.fullmatch(piece) and _SPECIAL not in piece:
                found += _PARTS.findall(piece.lower())
            else:
                found.append(" " + piece)
        return found

    def plain(self, texts):
        """`_PARTS` for all texts at once, without the spaces."""
        data, bounds, first = as_bytes([text.lower() for text in texts])
        kind = _KIND[data]
        start = first.copy()
        start[1:-1] |= kind[1:] != kind[:-1]
        start[:-1] |= kind == NUMBER
        start[:-1] &= kind != SPACE
        part_contractions(data, kind, start, first)
        starts, kept = np.flatnonzero(start[:-1]), kind != SPACE
        return data[kept], np.append(0, np.cumsum(kept))[starts], np.searchsorted(starts, bounds)

    def learn(self) -> None:
        self.waiting, self.known.unseen = self.known.unseen, defaultdict(bytearray)
        odd = [part for part in self.waiting if part[0] == " "]
        for part, one in zip(odd, self.whole.encode_batch_fast([part[1:] for part in odd], add_special_tokens=False)):
            self._keep([part], raw := np.asarray(one.ids, "<u4").tobytes(), [len(raw)])
        unseen = [part for part in self.waiting if part[0] != " "]
        some = [unseen[k:k + 500] for k in range(0, len(unseen), 500)]
        lines = [" ".join(parts).encode().decode("latin-1").translate(_NAMES) for parts in some]
        for parts, one in zip(some, self.parts.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.asarray(one.ids, "<u4")
            self._keep(parts, ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist())
        self.known.age()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in super().encode(texts)]

    def segments(self, text: str):
        return segments(text)


def segments(text: str):
    begin = 0
    while len(text) - begin > SEGMENT:
        end = text.find(" ", begin + SEGMENT)
        if end < 0:
            break
        yield text[begin:end]
        begin = end + 1
    yield text[begin:]


_encoders: dict[str, Encoder] = {}


class Windows:
    """Open windows of one task; `place` returns the (pieces, used) windows that are done."""

    def __init__(self, length: int = LENGTH, most: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT):
        self.length, self.most, self.least_cut = length, most, least_cut
        self.room: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.pieces: dict[int, list] = {}
        self.next = 0

    def place(self, doc, ids: np.ndarray, start: int = 0) -> list[list]:
        """Add a rest shorter than a window: pieces are (doc, start, ids)."""
        done = []
        while len(ids):
            at = bisect_left(self.room, (len(ids), -1))
            if at < len(self.room):
                free, window = self.room.pop(at)
                self._add(window, free, (doc, start, ids), done)
                break
            if len(self.room) < self.most:
                self.next += 1
                self.pieces[self.next] = []
                self._add(self.next, self.length, (doc, start, ids), done)
                break
            free, window = self.room.pop(0)
            if free >= self.least_cut:
                self.pieces[window].append((doc, start, ids[:free]))
                ids, start = ids[free:], start + free
            done.append(self.pieces.pop(window))
        return done

    def _add(self, window, free, piece, done) -> None:
        self.pieces[window].append(piece)
        if free == len(piece[2]):
            done.append(self.pieces.pop(window))
        else:
            insort(self.room, (free - len(piece[2]), window))


class _Out:
    """Piece rows as Arrow batches."""

    def __init__(self, origin: int, base: int):
        self.origin, self.base, self.sequences = origin, base, 0
        self.rows: list = []
        self.held = 0

    def emit(self, pieces, sequence: bool = True) -> None:
        """(doc, start, ids, doc_tokens) pieces as one sequence, or as leftovers."""
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.base + self.sequences if sequence else None, offset if sequence else None))
            offset += len(ids)
        self.held += offset
        self.sequences += sequence

    def batch(self) -> pa.RecordBatch:
        docs, starts, ids, totals, sequences, offsets = zip(*self.rows) if self.rows else ((),) * 6
        bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        values = pa.array(np.concatenate(ids).view("<i4") if ids else np.zeros(0, np.int32), pa.int32())
        done = pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), values), pa.array(totals, pa.int64()),
             pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()), pa.array([self.origin] * len(docs), pa.int64())], schema=_SCHEMA)
        self.rows, self.held = [], 0
        return done


def named(pieces):
    return [(doc, start, ids, total) for (doc, total), start, ids in pieces]


def sequence_base(level: int, origin: int) -> int:
    """First sequence id of a task: ids of different rounds and tasks never meet."""
    return level << 56 | origin << 32


def _packer(path: str, length: int, windows: int, least_cut: int, end_id: int):
    end = np.array([end_id], "<u4")

    def pack(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        origin = TaskContext.get().partitionId()
        out = _Out(origin, sequence_base(0, origin))
        opened = Windows(length, windows, least_cut)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin in range(0, len(docs), 128):
                for doc, ids in zip(docs[begin:begin + 128], encoder.encode([text or "" for text in texts[begin:begin + 128]])):
                    ids = np.concatenate([ids, end])
                    whole = len(ids) - len(ids) % length
                    for start in range(0, whole, length):
                        out.emit([(doc, start, ids[start:start + length], len(ids))])
                        if out.held > BATCH_TOKENS:
                            yield out.batch()
                    for done in opened.place((doc, len(ids)), ids[whole:].copy(), whole):
                        out.emit(named(done))
                    if out.held > BATCH_TOKENS:
                        yield out.batch()
        for pieces in opened.pieces.values():
            out.emit(named(pieces), sequence=False)
            if out.held > BATCH_TOKENS:
                yield out.batch()
        yield out.batch()

    return pack


def cuts(total: int, length: int, last: bool) -> list[int]:
    """Lengths that joined leftovers are cut to: full sequences, then what waits for the next round, or powers of two."""
    found, rest = [length] * (total // length), total % length
    if not last:
        return found
    return found + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def _merger(level: int, length: int, last: bool):
    def merge(group, table):
        origin = group[0].as_py()
        table = table.sort_by([("origin", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        docs, starts, totals = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        lists = table.column("ids").combine_chunks()
        values, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        ends = np.cumsum(np.array(cuts(int(bounds[-1]), length, last), np.int64))
        # A piece ends where a leftover or a sequence ends.
        edges = np.unique(np.concatenate([bounds, ends]))
        begins, stops = edges[:-1], edges[1:]
        row = np.searchsorted(bounds, begins, side="right") - 1
        sequence = np.searchsorted(ends, begins, side="right")
        opens = np.concatenate([[0], ends])[sequence]
        waits = sequence == len(ends)
        base = sequence_base(level, origin)
        return pa.Table.from_arrays(
            [pa.array([docs[r] for r in row], pa.int64()), pa.array(np.array([starts[r] for r in row], np.int64) + begins - bounds[row]),
             pa.ListArray.from_arrays(pa.array(np.concatenate([begins, stops[-1:]]).astype(np.int32)), pa.array(values, pa.int32())),
             pa.array([totals[r] for r in row], pa.int64()), pa.array(base + sequence, mask=waits), pa.array(begins - opens, mask=waits),
             pa.array(np.full(len(row), origin))], schema=_SCHEMA)

    return merge


def pack(docs: DataFrame, path: str, length: int = LENGTH, windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT, fan_in: int = FAN_IN,
         end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, ids, doc_tokens, sequence_id, offset) of all documents, stored; every id lies in one piece."""
    spread = stored(docs.select("doc_id", "text").mapInArrow(_packer(path, length, windows, least_cut, end_id), PIECES), "packed")
    packed, left, level = [spread], spread, 0
    tasks = spread.agg(F.max("origin")).first()[0]
    while tasks is not None:
        level, last = level + 1, tasks < fan_in
        waiting = left.where("sequence_id is null").withColumn("group", F.floor(F.col("origin") / fan_in))
        left = stored(waiting.groupBy("group").applyInArrow(_merger(level, length, last), PIECES), "packed")
        packed.append(left)
        tasks = None if last else tasks // fan_in
    return union(packed).where("sequence_id is not null").drop("origin")


def union(tables: list[DataFrame]) -> DataFrame:
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    return found


def _checksums(batches):
    for batch in batches:
        lists = batch.column(2)
        values, bounds = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        raw = memoryview(values.tobytes())
        sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64()), *(batch.column(i) for i in (3, 4, 5))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def digest(pieces: DataFrame) -> DataFrame:
    """Places, lengths and checksums of the pieces."""
    return pieces.select("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset").mapInArrow(
        _checksums, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
