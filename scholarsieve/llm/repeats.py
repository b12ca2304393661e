"""Repeated 100-byte strings, found by suffix sorting with hash comparisons, and removed.

A byte goes when a `LENGTH`-byte string covering it also starts earlier: in a smaller doc_id, or earlier in the
same document. Matches never cross documents and are judged on the input.

How equal strings meet: the anchor of a window is its smallest k-gram by hash (leftmost of equals), so equal
windows have equal anchors at equal offsets. Consecutive windows with one anchor form a segment. Segments are
dealt by anchor into buckets sized from the input's bytes; equal segments of a bucket are one (the earliest
stays, the others are repeats), and pre-aggregated within each block of text before the shuffle, so a passage in
a third of all documents sends one segment per block, not one per document. Where an anchor has several different
segments, their bytes are fetched and all their windows are suffix-sorted: a bottom-up mergesort whose comparisons
find the common extension of two suffixes by binary search over prefix polynomial hashes (logarithmic instead of
linear), then compare one byte. Neighbours that share `LENGTH` bytes are verified byte by byte against hash
collisions; all but the earliest of each class are repeats. Anchors with more than `HOT` different segments are
split by window content before this step, which keeps every group bounded and still lets equal windows meet.

Whole documents with equal bytes are one before all this: all but the smallest doc_id are repeats throughout.

Nulls and edge cases: null texts are empty; texts below `LENGTH` bytes keep everything; a null doc_id takes no part
in matching and keeps its text; rows that share a doc_id are documents of their own, in the order of their texts'
hashes; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from scholarsieve.llm.common import GOLDEN, byte_blocks, mix, prefix_hash, small_enough, span_hash, stored

LENGTH = 100
GRAM = 50
BUCKET_BYTES = 32 << 20  # text bytes whose segments share a bucket
HOT = 4096
SORT_BUCKETS = 4  # as many buckets for sorting, whose rows carry the segments' bytes, for one of segments
SORTED = 200_000  # windows sorted at once, and those of one more anchor

_CELL = "kind int, bucket int, docs binary, anchors binary, contents binary, owners binary, starts binary, sizes binary, offsets binary"
_CELL_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("docs", "anchors", "contents", "owners", "starts", "sizes", "offsets"))])
LEADER, REPEAT, NEED = 0, 1, 2


def window_anchors(prefix: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Place of the anchor of each window starting at `starts`, in a block with these prefix hashes.

    Sliding minimum by blocks: the minimum over a window is that of a block's suffix and the next one's prefix.
    """
    n, width = len(prefix) - gram, length - gram + 1
    value = mix(span_hash(prefix, slice(0, n), slice(gram, gram + n)))
    bits = np.uint64(max(1, int(n).bit_length()))
    value = value >> bits << bits | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = value
    cells = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(cells, axis=1).reshape(-1)
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    smallest = np.minimum(behind[starts], ahead[starts + width - 1])
    return (smallest & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, start in block, windows, anchor offset, anchor hash, content hash) of every segment of a block of texts."""
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    total = int(windows.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    row = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    prefix = prefix_hash(data)
    anchor = window_anchors(prefix, start, length, gram)
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, total))
    row, start, anchor = row[first], start[first], anchor[first]
    key = mix(span_hash(prefix, anchor, anchor + gram))
    content = mix(span_hash(prefix, start, start + count + length - 1) + mix((anchor - start).astype(np.uint64) * GOLDEN + count.astype(np.uint64)))
    return row, start, count, anchor - start, key, content


def firsts(keys: tuple, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then (doc, start); True where a new key group begins, in that order."""
    order = np.lexsort((start, doc, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for key in keys:
            same &= key[order][1:] == key[order][:-1]
        new[1:] = ~same
    return order, new


def _bytes(values) -> bytes:
    return b"" if values is None else values.tobytes()


def _cell(kind, bucket, doc, anchors, contents, start, size, offset):
    docs, owner = np.unique(doc, return_inverse=True)
    return {"kind": kind, "bucket": int(bucket), "docs": docs.tobytes(), "anchors": _bytes(anchors), "contents": _bytes(contents),
            "owners": owner.astype(np.uint32 if len(docs) > 65535 else np.uint16).tobytes(), "starts": start.astype(np.uint32).tobytes(), "sizes": size.astype(np.uint32).tobytes(),
            "offsets": b"" if offset is None else offset.astype(np.uint16).tobytes()}


def _spread(kind, bucket, doc, start, size, anchors=None, contents=None, offset=None):
    """One packed row per bucket; repeats carry no hashes."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    of = lambda values, part: None if values is None else values[part]
    rows = [_cell(kind, bucket[part[0]], doc[part], of(anchors, part), of(contents, part), start[part], size[part], of(offset, part)) for part in np.split(order, cuts) if len(part)]
    return pa.RecordBatch.from_pylist(rows, _CELL_SCHEMA)


def _deal(buckets: int, length: int, gram: int):
    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in byte_blocks(batch.column(1)):
                row, start, count, offset, key, content = segments(data, offsets, length, gram)
                doc, start = ids[first + row], start - offsets[row]
                order, new = firsts((key, content), doc, start)
                lead, rest = order[new], order[~new]
                yield _spread(LEADER, (key[lead] % np.uint64(buckets)).astype(np.int64), doc[lead], start[lead], count[lead], key[lead], content[lead], offset[lead])
                if len(rest):
                    yield _spread(REPEAT, (mix(doc[rest].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), doc[rest], start[rest], count[rest])
    return deal


_TYPES = {"docs": np.int64, "anchors": np.uint64, "contents": np.uint64, "starts": np.uint32, "sizes": np.uint32, "offsets": np.uint16}


def _arrays(table: pa.Table, kind: int):
    """Unpacked (doc, start, size, offset, anchor, content) of the rows of a kind, in the types that they are packed in."""
    parts = [tuple(np.zeros(0, _TYPES[n]) for n in ("docs", "starts", "sizes", "offsets", "anchors", "contents"))]
    for batch in table.to_batches():
        for i in np.flatnonzero(batch.column("kind").to_numpy() == kind).tolist():
            docs, anchors, contents, starts, sizes, offsets = (np.frombuffer(batch.column(n)[i].as_buffer(), of) for n, of in _TYPES.items())
            owners = np.frombuffer(batch.column("owners")[i].as_buffer(), np.uint32 if len(docs) > 65535 else np.uint16)
            parts.append((docs[owners], starts, sizes, offsets, anchors, contents))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _joined(values: pa.Array) -> np.ndarray:
    """Bytes of a binary column's values one after another, without a copy."""
    _, ends, body = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(body, np.uint8)[ends[0]:ends[-1]] if body is not None and body.size else np.zeros(0, np.uint8)


_FOUND = "doc_id long, kind int, starts array<int>, sizes array<int>, offsets array<int>, anchors array<long>, hot array<boolean>"


def _by_document(kind, doc, start, size, offset=None, anchor=None, hot=None):
    """One row per document with its segments."""
    if not len(doc):
        return None
    order = np.lexsort((start, doc))
    doc, start, size = doc[order], start[order], size[order]
    offset, anchor, hot = (np.zeros(len(doc), kind_) if values is None else values[order] for values, kind_ in ((offset, np.int64), (anchor, np.uint64), (hot, bool)))
    at = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)).astype(np.int32)

    def lists(values, kind_):
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind_))

    return pa.table({"doc_id": pa.array(doc[at[:-1]], pa.int64()), "kind": pa.array(np.full(len(at) - 1, kind), pa.int32()), "starts": lists(start.astype(np.int32), pa.int32()),
                     "sizes": lists(size.astype(np.int32), pa.int32()), "offsets": lists(offset.astype(np.int32), pa.int32()), "anchors": lists(anchor.view(np.int64), pa.int64()), "hot": lists(hot, pa.bool_())})


def _elect(hot_size: int):
    def elect(table: pa.Table) -> pa.Table:
        doc, start, size, offset, anchor, content = _arrays(table, LEADER)
        order, new = firsts((anchor, content), doc, start)
        lead, rest = order[new], order[~new]
        key = anchor[lead]
        begins = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        group = np.cumsum(begins) - 1
        versions = np.bincount(group)[group] if len(group) else np.zeros(0, np.int64)
        need = lead[versions > 1]
        out = [_by_document(NEED, doc[need], start[need], size[need], offset[need], anchor[need], (versions > hot_size)[versions > 1]),
               _by_document(REPEAT, doc[rest], start[rest], size[rest]), _by_document(REPEAT, *_arrays(table, REPEAT)[:3])]
        out = [t for t in out if t is not None]
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())),
                                                            ("anchors", pa.list_(pa.int64())), ("hot", pa.list_(pa.bool_()))]).empty_table()
    return elect


_PIECE = "bucket int, doc_id long, starts binary, sizes binary, offsets binary, anchors binary, bytes binary"


def _fetch(buckets: int, length: int):
    """Bytes of the needed segments, dealt by anchor; of hot anchors, window by window and by content."""
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), *((n, pa.binary()) for n in ("starts", "sizes", "offsets", "anchors", "bytes"))])

    def fetch(batches):
        for batch in batches:
            rows = []
            for doc, text, starts, sizes, offsets, anchors, hot in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                start, size, offset = np.array(starts, np.int64), np.array(sizes, np.int64), np.array(offsets, np.int64)
                key, hot = np.array(anchors, np.int64).view(np.uint64), np.array(hot, bool)
                if hot.any():
                    singles = np.concatenate([np.arange(a, a + n) for a, n in zip(start[hot], size[hot])])
                    content = np.array([int.from_bytes(hashlib.blake2b(data[a:a + length], digest_size=8).digest(), "little") for a in singles], np.uint64)
                    start, size, key = np.append(start[~hot], singles), np.append(size[~hot], np.ones(len(singles), np.int64)), np.append(key[~hot], content)
                    offset = np.append(offset[~hot], np.zeros(len(singles), np.int64))
                bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    rows.append({"bucket": int(bucket[part[0]]), "doc_id": doc, "starts": start[part].tobytes(), "sizes": size[part].tobytes(), "offsets": offset[part].tobytes(), "anchors": key[part].tobytes(),
                                 "bytes": b"".join([data[a:a + n + length - 1] for a, n in zip(start[part].tolist(), size[part].tolist())])})
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
    return fetch


class Suffixes:
    """Suffixes of a byte string compared over their first `length` bytes."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.data, self.length, self.prefix = data, length, prefix_hash(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        whole = span_hash(self.prefix, x, x + self.length) == span_hash(self.prefix, y, y + self.length)
        low[whole] = self.length
        open_ = np.flatnonzero(~whole)
        high[open_] -= 1
        while len(open_):
            middle = (low[open_] + high[open_] + 1) // 2
            a, b = x[open_], y[open_]
            same = span_hash(self.prefix, a, a + middle) == span_hash(self.prefix, b, b + middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Is suffix x smaller than y (or equal, where ties count)?"""
        n = self.common(x, y)
        at = np.minimum(n, self.length - 1)
        return np.where(n == self.length, ties, self.data[x + at] < self.data[y + at])

    def sort(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (`group` ascending): bottom-up mergesort.

        Each element's place in the merged run is its place in its own run plus its rank in the sibling run,
        found by binary search for all elements at once.
        """
        n = len(suffix)
        order = np.arange(n)
        begin = np.searchsorted(group, group, side="left")
        end = np.searchsorted(group, group, side="right")
        run = 1
        while True:
            rows = np.flatnonzero(end - begin > run)  # groups that still have more than one run
            if not len(rows):
                return order
            place = rows - begin[rows]
            number = place // run
            left = number % 2 == 0
            own = begin[rows] + number * run
            other = np.where(left, own + run, own - run)
            low = np.minimum(other, end[rows])
            high = np.minimum(other + run, end[rows])
            first = low.copy()
            mine = suffix[order[rows]]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                theirs = suffix[order[middle]]
                # The left run wins ties, so the sort is stable.
                ahead = np.where(left[open_], self.before(theirs, mine[open_], False), self.before(theirs, mine[open_], True))
                low[open_[ahead]] = middle[ahead] + 1
                high[open_[~ahead]] = middle[~ahead]
                open_ = open_[low[open_] < high[open_]]
            target = np.minimum(own, np.where(left, own, other)) + (rows - own) + (low - first)
            merged = order.copy()
            merged[target] = order[rows]
            order = merged
            run *= 2

    def equal_neighbours(self, sorted_: np.ndarray) -> np.ndarray:
        """True where a suffix shares `length` bytes with the one before it, verified byte by byte."""
        same = np.zeros(len(sorted_), bool)
        if len(sorted_) > 1:
            same[1:] = span_hash(self.prefix, sorted_[1:], sorted_[1:] + self.length) == span_hash(self.prefix, sorted_[:-1], sorted_[:-1] + self.length)
            at = np.flatnonzero(same)
            reach = np.arange(self.length)
            for some in np.array_split(at, max(1, len(at) // 5_000)):
                if len(some):
                    same[some] = (self.data[sorted_[some][:, None] + reach] == self.data[sorted_[some - 1][:, None] + reach]).all(axis=1)
        return same


def repeated_windows(data: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, offset: np.ndarray, anchor: np.ndarray, length: int = LENGTH):
    """(doc, start) of the windows in these segments that another one repeats from earlier.

    Equal windows have their anchor at one offset, so each (anchor, offset) is sorted on its own.
    """
    place = np.cumsum(size + length - 1) - (size + length - 1)
    each = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
    suffix, docs, starts = place[each] + step, doc[each], start[each] + step
    place_key = mix(anchor[each] + (offset[each] - step + 1).astype(np.uint64) * GOLDEN)
    group_order = np.argsort(place_key, kind="stable")
    suffix, docs, starts = suffix[group_order], docs[group_order], starts[group_order]
    key = place_key[group_order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1 if len(key) else np.zeros(0, np.int64)
    suffixes = Suffixes(data, length)
    order = suffixes.sort(suffix, group)
    same = suffixes.equal_neighbours(suffix[order])
    if len(same):
        same[1:] &= group[order][1:] == group[order][:-1]
    label = np.cumsum(~same)
    by_age = np.lexsort((starts[order], docs[order], label))
    first = np.append(True, label[by_age][1:] != label[by_age][:-1]) if len(label) else np.zeros(0, bool)
    rest = order[by_age[~first]]
    return docs[rest], starts[rest]


def _sort_bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        # The bytes stay where Arrow has them; of each segment it is known which batch holds it, and where.
        batches = table.to_batches()
        held = [_joined(batch.column("bytes")) for batch in batches]
        start, size, offset = (np.concatenate([_joined(batch.column(n)) for batch in batches]).view(np.int64) for n in ("starts", "sizes", "offsets"))
        anchor = np.concatenate([_joined(batch.column("anchors")) for batch in batches]).view(np.uint64)
        counts = [pc.binary_length(batch.column("starts")).to_numpy() // 8 for batch in batches]
        doc = np.repeat(table.column("doc_id").to_numpy(), np.concatenate(counts))
        in_batch = np.repeat(np.arange(len(batches)), [n.sum() for n in counts])
        place = np.cumsum(size + length - 1) - (size + length - 1)
        place -= (np.cumsum([0, *map(len, held)])[:-1])[in_batch]
        # Groups of anchors are sorted in batches of bounded size.
        order = np.argsort(anchor, kind="stable")
        begins = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1]))
        load = np.cumsum(size[order])[np.append(begins[1:], len(order)) - 1]
        found = []
        for part in np.split(begins, np.flatnonzero(np.diff(load // SORTED)) + 1):
            upto = begins[np.searchsorted(begins, part[-1]) + 1] if part[-1] != begins[-1] else len(order)
            some = order[part[0]:upto]
            piece = np.concatenate([held[k][a:a + n + length - 1] for k, a, n in zip(in_batch[some].tolist(), place[some].tolist(), size[some].tolist())])
            found.append(_runs(*repeated_windows(piece, doc[some], start[some], size[some], offset[some], anchor[some], length)))
        return pa.table([np.concatenate(values) for values in zip(*found)], pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32())]))
    return run


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, size) of the runs of consecutive windows."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))[:len(doc)])
    return doc[first], start[first].astype(np.int32), np.diff(np.append(first, len(doc))).astype(np.int32)


def _remove(length: int):
    def remove(batches):
        for batch in batches:
            out = []
            for doc, text, starts, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                spans = merged_spans(starts or [], [n + length - 1 for n in sizes or []])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append({"doc_id": doc, "n_bytes": len(data), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": kept.hexdigest(),
                            "spans": [{"start": a, "end": b} for a, b in spans]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                                                             ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
    return remove


def merged_spans(starts, lengths) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes."""
    out: list[list[int]] = []
    for a, n in sorted(zip(starts, lengths)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are byte ranges, end exclusive.

    Where rows share a doc_id, each row is given a key of its own in the order of (doc_id, text hash), and the work is
    done by keys: spans belong to rows, and of equal rows the first stays whole.
    """
    texts = docs.select("doc_id", "text")
    options = {"length": length, "gram": gram, "bucket_bytes": bucket_bytes, "hot": hot}
    if texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _repeats(texts, **options)
    ordered = texts.where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = stored(ordered.withColumn("key", F.monotonically_increasing_id()), "repeat-rows")
    nameless = texts.where("doc_id is null")
    found = _repeats(keyed.select(F.col("key").alias("doc_id"), "text").unionByName(nameless), **options)
    return found.withColumnRenamed("doc_id", "key").join(keyed.select("key", "doc_id"), "key", "left").select("doc_id", *(c for c in found.columns if c != "doc_id"))


def _repeats(texts: DataFrame, length: int, gram: int, bucket_bytes: int, hot: int) -> DataFrame:
    named = texts.where("doc_id is not null")
    sized = named.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.octet_length("text").alias("n")).where(F.col("n") >= length)
    leaders = sized.groupBy("hash").agg(F.min("doc_id").alias("leader"), F.count("*").alias("c"), F.max("n").alias("n"))
    leaders = stored(leaders, "repeat-leaders")
    total = leaders.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    copies = stored(sized.join(leaders.where("c > 1").select("hash", "leader"), "hash").where("doc_id <> leader").select("doc_id", (F.col("n") - length + 1).alias("size")), "repeat-copies")
    single = named.join(small_enough(copies, 20), "doc_id", "left_anti")
    dealt = single.where(F.octet_length("text") >= length).mapInArrow(_deal(buckets, length, gram), _CELL)
    found = stored(dealt.groupBy("bucket").applyInArrow(_elect(hot), _FOUND), "repeat-segments")
    need = found.where(F.col("kind") == NEED).groupBy("doc_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "sizes", "offsets", "anchors", "hot")))
    pieces = single.join(need, "doc_id").select("doc_id", "text", "starts", "sizes", "offsets", "anchors", "hot").mapInArrow(_fetch(SORT_BUCKETS * buckets, length), _PIECE)
    sorted_ = stored(pieces.groupBy("bucket").applyInArrow(_sort_bucket(length), "doc_id long, start int, size int"), "repeat-sorted")
    spans = (found.where(F.col("kind") == REPEAT).select("doc_id", F.explode(F.arrays_zip("starts", "sizes")).alias("s")).select("doc_id", F.col("s.starts").alias("start"), F.col("s.sizes").alias("size"))
             .unionByName(sorted_).unionByName(copies.select("doc_id", F.lit(0).alias("start"), F.col("size").cast("int").alias("size"))))
    lists = spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    return texts.join(lists, "doc_id", "left").select("doc_id", "text", "starts", "sizes").mapInArrow(
        _remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
