"""Helpers shared by the corpus operators: stored intermediate tables, byte blocks, word hashes."""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a folder of our own only where none is named in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="corpus-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


BATCH_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    """Rows a batch sent to Python holds at most, unless the session already asks for fewer.

    Texts may be long: the default of 10,000 rows could hold gigabytes.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cut lineage that survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, row_bytes: int, most_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast when the counted rows fit `most_bytes`; otherwise leave the join to shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df


def byte_blocks(column: pa.Array, most: int = BLOCK_BYTES):
    """(first row, bytes, row offsets) of consecutive rows holding about `most` bytes; nulls count as empty.

    A row longer than that is a block of its own, so memory follows the longest text.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    rows = len(column)
    if rows == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + rows + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer over unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)  # one random value per byte
BASE = 0x9E3779B97F4A7C5B  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, BLOCK_BYTES) + 1, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; slice(i, j) hashes are `span_hash(prefix, i, j)`."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * powers(BASE, len(data))[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start, end) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]


def lowered_table(spaces: bytes) -> np.ndarray:
    """Byte map: A-Z to a-z, the given bytes to a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(spaces)] = 32
    return table


WHITE = lowered_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Everything in ASCII but letters and digits separates; bytes of other letters stay.
PLAIN = lowered_table(bytes(i for i in range(128) if not chr(i).isalnum()))


def hashed_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a byte block, and its row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = table[data]
    inside = text != 32
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return mix(span_hash(prefix_hash(text), begins, ends)), np.searchsorted(offsets, begins, side="right") - 1


def hashed_shingles(data: np.ndarray, offsets: np.ndarray, width: int, table: np.ndarray = WHITE):
    """Distinct word shingles of each row: sorted hashes and row bounds.

    Rows with fewer words than `width`, but some, have their whole word sequence as the one shingle.
    """
    words, row = hashed_words(data, offsets, table)
    rows = len(offsets) - 1
    counts = np.bincount(row, minlength=rows)
    full = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= width:
        at = np.flatnonzero(row[:len(row) - width + 1] == row[width - 1:])
        value = words[at]
        for k in range(1, width):
            value = mix(value * GOLDEN + words[at + k])
        full = value, row[at]
    starts = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < width))
    brief = words[starts[short]] if len(short) else np.zeros(0, np.uint64)
    for k in range(1, width - 1):
        more = counts[short] > k
        brief[more] = mix(brief[more] * GOLDEN + words[starts[short][more] + k])
    brief = mix(brief + counts[short].astype(np.uint64))
    value, row = np.concatenate([full[0], brief]), np.concatenate([full[1], short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(rows + 1))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is the smallest node.

    Alternating large-star and small-star steps: each moves edges to the smallest neighbour, so long
    chains shrink fast and one hub may have any number of neighbours (its edges are never gathered:
    minima are pre-aggregated, and the join back is one that Spark can split). Every round is stored.
    Null ends and loops are ignored.
    """
    spark = edges.sparkSession

    def low_high(df, a="a", b="b"):
        return df.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()

    now = stored(low_high(edges), name)
    seen = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        best = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = low_high(both.where("v > u").join(best, "u"), "v", "m")
        least_below = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.withColumnRenamed("hi", "u").join(least_below, "u")
        now = stored(low_high(small.select(F.col("lo").alias("a"), F.col("m").alias("b"))
                              .unionByName(least_below.select(F.col("u").alias("a"), F.col("m").alias("b")))), name)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    found = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return found.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
