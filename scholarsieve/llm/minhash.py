"""MinHash near-duplicates by SuperMinHash signatures, banding, exact verification and union of links.

SuperMinHash draws, for every element, a random permutation of the signature slots together with a uniform
value per rank; a slot keeps the smallest rank + value over all elements. Ranks of one element are correlated
(each slot gets another rank), which lowers the variance of the estimate, and an element stops as soon as its
next rank exceeds every slot's value.

Bands of `rows` slots find candidates: at similarity 0.8, 32 bands of 5 slots miss a pair with probability
(1 - 0.8^5)^32 < 4e-6. Documents with equal shingle sets are one class before banding, so copies never pair.
Every member of a bucket meets the bucket's smallest member; links are confirmed on full shingle sets and united.
Buckets that are one component then are done. The members of the others form families (buckets that share members
belong together), and a family is compared in blocks: a task multiplies the shingle incidence of two blocks, which
gives all exact intersections at once, and returns a spanning forest of the links it finds, never a list of pairs.

Nulls and edge cases: null or wordless texts have no shingles and link with nothing; fewer words than the
shingle width make one shingle of all of them; a null doc_id links with nothing and has a null component; rows repeating a doc_id
are each compared by their own text (doc_id should be unique; repeats share the links of any of their texts); other columns are ignored.
Shingles are compared as 64-bit hashes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholarsieve.llm.common import GOLDEN, byte_blocks, components, hashed_shingles, mix, small_enough, stored

BANDS = 32
ROWS = 5
PERCENT = 80
BLOCK_DOCS = 256  # documents of a family that are compared with another such block in one task


def super_minhash(values: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """(rows, slots) signatures of the element sets values[bounds[i]:bounds[i + 1]]; empty rows stay infinite."""
    rows = len(bounds) - 1
    out = np.full((rows, slots), np.inf)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    seed = values
    order = np.tile(np.arange(slots, dtype=np.int16), (len(values), 1))
    for rank in range(slots):
        if not len(seed):
            break
        drawn = mix(seed + np.array([rank + 1], np.uint64) * GOLDEN)
        value = (drawn >> np.uint64(32)).astype(np.float64) / 4294967296.0 + rank
        pick = rank + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        each = np.arange(len(seed))
        slot = order[each, pick].copy()
        order[each, pick] = order[:, rank]
        np.minimum.at(flat, row * slots + slot, value)
        going = (out.max(axis=1) >= rank + 1)[row]  # rows with a slot that a later rank can still lower
        if not going.all():
            seed, row, order = seed[going], row[going], order[going]
    return out


def _signer(width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))])
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)

    def sign(batches):
        for batch in batches:
            for first, data, offsets in byte_blocks(batch.column(1)):
                values, bounds = hashed_shingles(data, offsets, width)
                count = np.diff(bounds)
                sums = [np.diff(np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ s), dtype=np.uint64)])[bounds]) for s in salt[:2]]
                signed = np.flatnonzero(count)
                keys = np.zeros((len(count), bands), np.uint64)
                for some in np.array_split(signed, max(1, count.sum() // 60_000)):
                    if len(some):
                        member = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
                        signature = super_minhash(values[member], np.concatenate([[0], np.cumsum(count[some])]), bands * rows)
                        bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(some), bands, rows)
                        key = np.broadcast_to(salt, (len(some), bands))
                        for k in range(rows):
                            key = mix(key * GOLDEN + bits[:, :, k])
                        keys[some] = key
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(count)), pa.array(count, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))], schema=schema)

    return sign


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, h1, h2, keys): set size, order-free 128-bit hash of the set, one bucket key per band."""
    return docs.select("doc_id", "text").mapInArrow(_signer(width, bands, rows), "doc_id long, n long, h1 long, h2 long, keys array<long>")


def _set_maker(width: int):
    def make(batches):
        for batch in batches:
            for first, data, offsets in byte_blocks(batch.column(1)):
                values, bounds = hashed_shingles(data, offsets, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(bounds) - 1), pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                                                  pa.array(np.diff(bounds), pa.int64()),
                                                  ], names=["doc_id", "shingles", "n"])
    return make


def _confirm(percent: int):
    def check(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return check


def _sets(ids: DataFrame, docs: DataFrame, width: int, known: DataFrame | None = None) -> DataFrame:
    """Stored (doc_id, shingles, n) of the documents `ids` (rep), besides those already known."""
    ids = ids.select(F.col("rep").alias("doc_id")).distinct()
    if known is not None:
        ids = ids.join(known.select("doc_id"), "doc_id", "left_anti")
    texts = docs.select("doc_id", "text").join(small_enough(stored(ids, "near-ids"), 16), "doc_id", "left_semi")
    made = stored(texts.mapInArrow(_set_maker(width), "doc_id long, shingles binary, n long"), "near-sets")
    return made if known is None else known.unionByName(made)


def _forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph given by its adjacency matrix."""
    waiting, edges = np.ones(len(adjacent), bool), []
    for root in range(len(adjacent)):
        if not waiting[root]:
            continue
        waiting[root] = False
        reached = [root]
        while reached:
            node = reached.pop()
            fresh = np.flatnonzero(adjacent[node] & waiting)
            waiting[fresh] = False
            edges += [(node, int(other)) for other in fresh]
            reached += fresh.tolist()
    return edges


def links_among(sets: list[np.ndarray], side: np.ndarray, percent: int, columns: int = 8192) -> list[tuple[int, int]]:
    """Spanning forest of the links between sets of different sides (of all sets where there is one side)."""
    count = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), count)
    value, column, uses = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = uses[column] > 1  # others are in no intersection
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [first, first + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        common += part @ part.T
    linked = 100 * common >= percent * (count[:, None] + count[None, :] - common)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    return _forest(linked)


def _compare(percent: int):
    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        side = np.asarray(table.column("block")) == np.asarray(table.column("high"))
        edges = links_among([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()], side, percent)
        return pa.table({"a": pa.array([ids[x] for x, _ in edges], pa.int64()), "b": pa.array([ids[y] for _, y in edges], pa.int64())})
    return compare


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest doc_id reachable by links."""
    signed = stored(signatures(docs, width, bands, rows), "near-signatures")
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(some.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "near-classes")
    members = classes.select("rep", "n", F.explode("keys").alias("key"))
    # Hub = smallest member; buckets of one member end here.
    shared = members.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("hub")).where("c > 1").drop("c")
    buckets = stored(members.join(shared, "key").select("key", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "near-buckets")

    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = stored(buckets.where((F.col("rep") != F.col("hub")) & fits).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "near-pairs")
    sets = _sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), docs, width)
    both = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb"))
    links = stored(both.mapInArrow(_confirm(percent), "a long, b long"), "near-links")

    found = stored(components(links), "near-components").withColumnRenamed("node", "rep")
    placed = buckets.select("key", "rep", "hub").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_ = stored(placed.join(parts, "key").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "near-open")
    families = stored(components(open_), "near-families").select(F.col("node").alias("rep"), F.col("component").alias("family"))
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("blocks"))
    blocked = (families.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
               .join(_sets(families, docs, width, sets).select(F.col("doc_id").alias("rep"), "shingles"), "rep"))
    met = (blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "shingles"))
    more = stored(met.groupBy("family", "low", "high").applyInArrow(_compare(percent), "a long, b long"), "near-links")
    united = stored(components(links.unionByName(more)), "near-components").withColumnRenamed("node", "rep")

    classed = (classes.select("n", "h1", "h2", "rep").join(united, "rep", "left")
               .select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id")))
    return (signed.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2")
            .join(classed.withColumnRenamed("n", "n_shingles"), ["n_shingles", "h1", "h2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the smallest doc_id of their component, all columns kept; null doc_ids stay."""
    dropped = near_duplicates(docs, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small_enough(dropped, 16), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
