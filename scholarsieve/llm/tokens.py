"""Token-id files of patched frame-of-reference blocks, and their reader.

Documents are range-partitioned and sorted by doc_id; each partition becomes one shard of the file table.
A file row is one chunk of whole documents: their ids and lengths, the start of each block in the payload,
and the payload. A block holds up to 1024 ids: its minimum is subtracted, the differences are packed at the
bit width that a chosen percentile of them needs, and the high bits of the others go to an exception list.

Block layout, little-endian: minimum u32, width u8, unused u8, ids u16, exceptions u16, padding u16; the
packed words u32[32 * width] in 32 lanes; exception positions u16[n]; their high bits u32[n].

Nulls and edge cases: a null text is empty and still gets the end id; rows with equal doc_ids are kept and
ordered by text; null doc_ids come first; an empty table gives no rows. Other columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from scholarsieve.llm.common import small_enough, stored
from scholarsieve.llm.encoding import (
    BYTE_NAMES, CONTRACTIONS, PLAIN as _PLAIN, SEGMENT, SPACE, SPECIAL as _SPECIAL, PartEncoder, as_bytes, classes, part_contractions)

BLOCK = 1024
LANES = 32
CHUNK_IDS = 1 << 17
PERCENTILE = 90
END_ID = 2
BATCH_ROWS = 128
REMEMBERED = 400_000

FILE_SCHEMA = ("shard int, chunk long, first_id long, n_ids long, doc_ids array<long>, lengths array<int>, "
               "block_starts binary, payload binary")
_HEADER = np.dtype([("low", "<u4"), ("width", "u1"), ("_a", "u1"), ("n", "<u2"), ("extra", "<u2"), ("_b", "<u2")])


# Letters and numbers of Latin-1.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
# Words come first, because most parts are words and none begins like a contraction.
_PARTS = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|{'|'.join(CONTRACTIONS)}| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+")
#: Before a blank with a character behind it, a text may be cut without changing its ids.
_CUT = re.compile(r"(?= \S)")
_ODD = "\0"
LINE_PARTS = 100
_KIND = classes(LETTERS, NUMBERS)


class Encoder(PartEncoder):
    """Ids of texts under a byte-level tokenizer.

    The tokenizer encodes each word, number and run of marks or spaces on its own, so a distinct one is encoded once
    and remembered (up to about `REMEMBERED`, in two generations). Texts of Latin-1 characters are divided as the
    tokenizer's own rule divides them, and unseen parts are encoded together: many in one word, parted by a byte that
    no longer token of the vocabulary holds, so that nothing merges across it. Pieces between blanks with other
    characters, or with a special token's string, go to the tokenizer as they are. Ids are those of its plain call on
    the whole text.
    """

    def __init__(self, path: str):
        super().__init__(path, REMEMBERED)
        vocabulary = self.whole.get_vocab()
        merged = set().union(*(token for token in vocabulary if len(token) > 1))
        # A byte that no text of Latin-1 characters holds which `_PLAIN` lets through.
        self.gap = next(chr(b) for b in range(32) if not _PLAIN.fullmatch(chr(b)) and BYTE_NAMES[b] in vocabulary and BYTE_NAMES[b] not in merged)
        self.gap_id = vocabulary[BYTE_NAMES[ord(self.gap)]]
        self.rule = self.whole.pre_tokenizer

    def divide(self, text: str) -> list[str]:
        found = []
        for piece in _CUT.split(text):
            if _PLAIN.fullmatch(piece) and _SPECIAL not in piece:
                found += _PARTS.findall(piece)
            else:
                found.append(_ODD + piece)
        return found

    def plain(self, texts):
        """`_PARTS` for all texts at once: a blank goes to the word, number or marks behind it, other spaces in front of it are parted."""
        data, bounds, first = as_bytes(texts)
        kind = _KIND[data]
        start = first.copy()
        start[1:-1] |= kind[1:] != kind[:-1]
        led = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:-1]) + 1
        start[led - 1] = True
        start[led[data[led - 1] == 32]] = False
        part_contractions(data, kind, start, first)
        starts = np.flatnonzero(start[:-1])
        return data, starts, np.searchsorted(starts, bounds)

    def learn(self) -> None:
        self.waiting, self.known.unseen = self.known.unseen, defaultdict(bytearray)
        odd = [part for part in self.waiting if part[0] == _ODD]
        for part, one in zip(odd, self.whole.encode_batch_fast([part[1:] for part in odd], add_special_tokens=False)):
            self._keep([part], raw := np.asarray(one.ids, "<u4").tobytes(), [len(raw)])
        unseen = [part for part in self.waiting if part[0] != _ODD]
        some = [unseen[k:k + LINE_PARTS] for k in range(0, len(unseen), LINE_PARTS)]
        lines = [(self.gap.join(parts) + self.gap).encode().decode("latin-1").translate(BYTE_NAMES) for parts in some]
        self.whole.pre_tokenizer = None  # the parts are divided, and written in `BYTE_NAMES` already
        try:
            encoded = self.whole.encode_batch_fast(lines, add_special_tokens=False)
        finally:
            self.whole.pre_tokenizer = self.rule
        for parts, one in zip(some, encoded):
            ids = np.asarray(one.ids, "<u4")
            self._keep(parts, ids.tobytes(), (4 * np.flatnonzero(ids == self.gap_id)).tolist(), 4)
        self.known.age()

    def segments(self, text: str):
        return segments(text)


def segments(text: str):
    """A long text in slices that begin at a blank with a character behind it."""
    begin = 0
    while len(text) - begin > SEGMENT:
        cut = _CUT.search(text, begin + SEGMENT)
        if cut is None:
            break
        yield text[begin:cut.start()]
        begin = cut.start()
    yield text[begin:]


_encoders: dict[str, Encoder] = {}


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that unsigned 32-bit values need."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, bytes]:
    """(block starts as u32 bytes, payload) of unsigned 32-bit ids."""
    total = len(ids)
    blocks = -(-total // BLOCK)
    grid = np.empty((blocks, BLOCK), np.uint32)
    flat = grid.reshape(-1)
    flat[:total] = ids
    flat[total:] = ids[-1] if total else 0
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    grid -= low[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _widths(np.partition(grid, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        sub = grid[rows]
        high = (sub.astype(np.uint64) >> np.uint64(w)).astype(np.uint32)
        mask = np.uint32((1 << int(w)) - 1)
        cells = (sub & mask).reshape(len(rows), BLOCK // LANES, LANES)
        words = np.zeros((len(rows), int(w), LANES), np.uint32)
        for i in range(BLOCK // LANES if w else 0):
            word, shift = divmod(i * int(w), 32)
            words[:, word] |= cells[:, i] << np.uint32(shift)
            if shift + w > 32:
                words[:, word + 1] |= cells[:, i] >> np.uint32(32 - shift)
        for k, block in enumerate(rows):
            n = min(BLOCK, total - block * BLOCK)
            odd = np.flatnonzero(high[k, :n])
            head = np.zeros(1, _HEADER)
            head[0] = (low[block], w, 0, n, len(odd), 0)
            parts[block] = head.tobytes() + words[k].tobytes() + odd.astype("<u2").tobytes() + high[k, odd].astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:blocks].astype("<u4")
    return starts.tobytes(), b"".join(parts)


def unpack(starts: bytes, payload: bytes) -> np.ndarray:
    """All ids of a payload, as unsigned 32-bit values."""
    begin = np.frombuffer(starts, "<u4")
    heads = np.array([np.frombuffer(payload, _HEADER, 1, s)[0] for s in begin], _HEADER)
    out = np.zeros((len(begin), BLOCK), np.uint32)
    for w in np.unique(heads["width"]):
        rows = np.flatnonzero(heads["width"] == w)
        words = np.stack([np.frombuffer(payload, "<u4", LANES * int(w), begin[r] + _HEADER.itemsize) for r in rows]).reshape(len(rows), int(w), LANES)
        cells = np.zeros((len(rows), BLOCK // LANES, LANES), np.uint32)
        mask = np.uint32((1 << int(w)) - 1)
        for i in range(BLOCK // LANES if w else 0):
            word, shift = divmod(i * int(w), 32)
            value = words[:, word] >> np.uint32(shift)
            if shift + w > 32:
                value = value | (words[:, word + 1] << np.uint32(32 - shift))
            cells[:, i] = value & mask
        out[rows] = cells.reshape(len(rows), BLOCK)
    for r in np.flatnonzero(heads["extra"]):
        n, w = int(heads["extra"][r]), int(heads["width"][r])
        at = int(begin[r]) + _HEADER.itemsize + 4 * LANES * w
        out[r, np.frombuffer(payload, "<u2", n, at)] |= np.frombuffer(payload, "<u4", n, at + 2 * n) << np.uint32(w)
    out += heads["low"][:, None]
    return out.reshape(-1)[:int(heads["n"].sum())] if len(begin) else np.zeros(0, np.uint32)


def _writer(path: str, end_id: int):
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("block_starts", pa.binary()), ("payload", pa.binary())])
    end = np.asarray([end_id], "<u4").tobytes()

    def write(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        shard = TaskContext.get().partitionId()
        chunk = first = held = 0
        docs, sizes, parts = [], [], []

        def row():
            starts, payload = pack(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pylist([{"shard": shard, "chunk": chunk, "first_id": first, "n_ids": held, "doc_ids": docs,
                                                "lengths": sizes, "block_starts": starts, "payload": payload}], schema)

        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(begin, BATCH_ROWS)
                encoded = encoder.encode([text or "" for text in some.column(1).to_pylist()])
                for doc, ids in zip(some.column(0).to_pylist(), encoded):
                    ids += end
                    docs.append(doc)
                    sizes.append(len(ids) // 4)
                    parts.append(ids)
                    held += len(ids) // 4
                    if held >= CHUNK_IDS:
                        yield row()
                        chunk, first, held = chunk + 1, first + held, 0
                        docs, sizes, parts = [], [], []
        if docs:
            yield row()
        encoder.forget()

    return write


def write_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Encode every document and write the file table to the shared folder; returns it as stored."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(_writer(path, end_id), FILE_SCHEMA), "token-files")


def _reader(batches):
    for batch in batches:
        shard, first, docs, sizes, starts, payload = (batch.column(i) for i in range(6))
        for i in range(batch.num_rows):
            ids = unpack(starts[i].as_py(), payload[i].as_py())
            lengths = np.asarray(sizes[i].as_py(), np.int64)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            little = memoryview(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(docs[i].as_py(), pa.int64()), pa.array([shard[i].as_py()] * len(lengths), pa.int32()),
                pa.array(begins + first[i].as_py(), pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([zlib.crc32(little[4 * a:4 * b]) for a, b in zip(begins, ends)], pa.int64())],
                names=["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32"])


def read_digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    `start` adds the ids of all earlier shards: one row per shard (task), summed over a window.
    """
    rows = (files.select("shard", "first_id", "doc_ids", "lengths", "block_starts", "payload")
            .mapInArrow(_reader, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(small_enough(shards, 12), "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")
