"""How far sources of one language diverge in their words: exact price distances over a K-squared quadtree.

Terms of each (lang, source) group are counted, terms of enough documents kept, and each group gives every kept
term an integer price (its smoothed share in billionths). Two groups differ by the summed absolute differences of
their prices. Most cells of the group-term matrix are zero, and a group's price of a zero cell is one number, so
the matrix is stored as a quadtree whose all-zero quadrants have no children. Both groups of a pair walk the tree
together: where both quadrants are zero, they cost (columns x difference of the zero prices) without being
visited; where both ends hold leaves (8 x 8), prices are compared there. Rows are walked in bands, so quadrants
are shared by all pairs of groups in them.

Scale: tasks count terms before the shuffle; the matrix is dealt by hashed terms into blocks of about
`BLOCK_CELLS` cells, one tree each, so a language with most of the text is many blocks; blocks return one sum per
pair of groups, which are added up. A term's cells, one per source, share a block; accumulators are held for one
pair of row bands (`BAND` groups) at a time.

Nulls and edge cases: null text, lang and source are ''. A group without terms is a group. Where no term of a
language is kept, its pairs differ by 0 and it has no term rows. Ties go by the item's UTF-8 bytes. Repeated rows
each count, as documents too. An empty table gives no rows. Other columns and doc_id are ignored.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scholarsieve.llm.common import small_enough, stored

LEAST_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
HELD_TERMS = 400_000
SLICE_BYTES = 1 << 20
BLOCK_CELLS = 1 << 16
LEAF = 8
BAND = 1024
FRONTIER = 1 << 17

#: Letters of ASCII in lower case and all bytes of other characters stay, the rest parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _slices(text: bytes):
    """A long text in slices that end at a blank."""
    begin = 0
    while len(text) - begin > SLICE_BYTES:
        end = text.find(b" ", begin + SLICE_BYTES)
        if end < 0:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:]


def _count(batches):
    """Occurrences and documents of each group's terms, summed up until many are held; one row without a term per group."""
    held: dict = {}

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[term] for term in n)], pa.int64())], schema=_COUNTS)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, docs = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
            seen: set = set()
            for part in _slices(text.translate(_TERMS)):
                words = part.split()
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from rows()
    yield from rows()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs); every group has one row with a null term besides."""
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * kept)), in decimals that can't overflow."""
    wide = [c.cast("decimal(20,0)") for c in (count + SMOOTHING, total + SMOOTHING * kept)]
    return F.call_function("div", wide[0] * F.lit(UNIT).cast("decimal(10,0)"), wide[1]) + 1


class QuadTree:
    """K-squared tree over (row, column, price) cells of a matrix; zero quadrants have no node.

    Level 0 is the root. `ranks[l]` maps child slot 4 * node + 2 * lower half + right half of level l to the node
    below, or -1; the nodes of the last level are dense LEAF x LEAF leaves.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, zero: np.ndarray, width: int):
        side, self.depth = LEAF, 0
        while side < max(len(zero), width):
            side, self.depth = side * 2, self.depth + 1
        self.side, self.zero = side, zero
        bands = -(-len(zero) // LEAF)
        self.bands = np.zeros((bands, LEAF), np.int64)
        self.bands.reshape(-1)[:len(zero)] = zero
        nodes = np.zeros((1 if len(row) else 0, 2), np.int64)  # (row, column) of the level's nodes
        cells = np.zeros(len(row), np.int64)  # the node of each cell
        self.ranks = []
        for level in range(1, self.depth + 1):
            edge = side >> level
            slot = 4 * cells + 2 * (row // edge & 1) + (column // edge & 1)
            there = np.zeros(4 * len(nodes), bool)
            there[slot] = True
            rank = np.where(there, np.cumsum(there) - 1, -1)
            slots = np.flatnonzero(there)
            nodes = 2 * nodes[slots // 4] + np.stack([slots >> 1 & 1, slots & 1], axis=1)
            self.ranks.append(rank)
            cells = rank[slot]
        # Leaves, with the zero price where a cell is zero; then one all-zero leaf per band of rows.
        leaves = np.repeat(self.bands[nodes[:, 0]][:, :, None], LEAF, axis=2)
        leaves[cells, row % LEAF, column % LEAF] = value
        self.leaves = np.concatenate([leaves, np.repeat(self.bands[:, :, None], LEAF, axis=2)])
        self.zero_leaf = len(leaves)
        self.empty = not len(row)

    def below(self, level: int, node: np.ndarray, half: int) -> np.ndarray:
        """Children in one quadrant of nodes of `level`; -1 stays -1."""
        rank = self.ranks[level]
        return np.where(node >= 0, rank[np.maximum(4 * node + half, 0)], -1) if len(rank) else np.full(len(node), -1)


def joint_distances(tree: QuadTree, width: int):
    """Blocks (rows, rows, distances) of all pairs of rows, summed over `width` columns.

    Pairs of nodes in the same columns are walked down together. Columns past `width` are zero for every row, so
    they are counted like other zero quadrants and taken off at the end.
    """
    groups, top = len(tree.zero), 0
    while (tree.side >> top) > max(BAND, LEAF):
        top += 1
    edge = tree.side >> top
    grid = np.full((1, 1), -1 if tree.empty else 0)
    for level in range(top):  # nodes of the bands' level, by row and column; rows past the last group are left out
        half = [[tree.below(level, grid.ravel(), 2 * r + c).reshape(grid.shape) for c in (0, 1)] for r in (0, 1)]
        grid = np.stack([np.stack(pair, axis=2).reshape(grid.shape[0], -1) for pair in half], axis=1).reshape(2 * grid.shape[0], -1)
        grid = grid[:-(-groups // (tree.side >> (level + 1)))]
    for one in range(len(grid)):
        for other in range(one, len(grid)):
            yield _band_pair(tree, width, top, edge, one, other, grid)


def _band_pair(tree, width, top, edge, one, other, grid):
    groups = len(tree.zero)
    tall, wide = (min(edge, groups - band * edge) for band in (one, other))
    leaf_sums = np.zeros((-(-tall // LEAF), -(-wide // LEAF), LEAF, LEAF), np.int64)
    zero_columns = np.zeros((tall, wide), np.int64)
    columns = grid.shape[1]
    work = [(top, grid[one], grid[other], np.zeros(columns, np.int64), np.zeros(columns, np.int64))]
    while work:
        level, a, b, i, j = work.pop()  # nodes, and their places among the band's rows at this level
        span = tree.side >> level
        blank = (a < 0) & (b < 0)
        if blank.any():
            shape = -(-tall // span), -(-wide // span)
            seen = np.bincount(i[blank] * shape[1] + j[blank], minlength=shape[0] * shape[1]).reshape(shape) * span
            zero_columns += np.repeat(np.repeat(seen, span, 0)[:tall], span, 1)[:, :wide]
            a, b, i, j = (x[~blank] for x in (a, b, i, j))
        if not len(a):
            continue
        if level == tree.depth:
            _compare(tree, a, b, i, j, one * edge // LEAF, other * edge // LEAF, leaf_sums)
            continue
        below = []
        for down in (0, 1):
            for also in (0, 1):
                ii, jj = 2 * i + down, 2 * j + also
                inside = (ii * (span // 2) < tall) & (jj * (span // 2) < wide)
                if one == other:
                    inside &= ii <= jj
                for right in (0, 1):
                    below.append((tree.below(level, a[inside], 2 * down + right), tree.below(level, b[inside], 2 * also + right), ii[inside], jj[inside]))
        a, b, i, j = (np.concatenate(x) for x in zip(*below))
        work += [(level + 1, *(x[k:k + FRONTIER] for x in (a, b, i, j))) for k in range(0, len(a), FRONTIER)]
    apart = np.abs(tree.zero[one * edge:one * edge + tall, None] - tree.zero[None, other * edge:other * edge + wide])
    found = leaf_sums.transpose(0, 2, 1, 3).reshape(leaf_sums.shape[0] * LEAF, -1)[:tall, :wide]
    return one * edge, other * edge, found + (zero_columns - (tree.side - width)) * apart


def _compare(tree, a, b, i, j, first_i, first_j, sums):
    """Add up the differences of leaves, by pair of row bands."""
    key = i * sums.shape[1] + j
    order = np.argsort(key, kind="stable")
    a, b, i, j, key = (x[order] for x in (a, b, i, j, key))
    a, b = np.where(a < 0, tree.zero_leaf + first_i + i, a), np.where(b < 0, tree.zero_leaf + first_j + j, b)
    flat = sums.reshape(-1, LEAF, LEAF)
    for k in range(0, len(a), 2048):
        some = slice(k, k + 2048)
        apart = np.abs(tree.leaves[a[some]][:, :, None, :] - tree.leaves[b[some]][:, None, :, :]).sum(axis=-1)
        starts = np.flatnonzero(np.concatenate([[True], key[some][1:] != key[some][:-1]]))
        flat[key[some][starts]] += np.add.reduceat(apart, starts, axis=0)


def _block_distances(block, cells):
    """Distances of all pairs of a block's groups. Rows without a term name the groups and their zero prices."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
    source, term, value = (cells.column(c).combine_chunks() for c in ("source", "term", "price"))
    named = term.is_null().to_numpy(zero_copy_only=False)
    groups = source.filter(pa.array(named))
    order = np.argsort(np.array(groups.to_pylist(), object), kind="stable")
    groups = groups.take(pa.array(order))
    value = value.to_numpy()
    zero = value[named][order]
    row = source.filter(pa.array(~named)).dictionary_encode()
    place = {name: i for i, name in enumerate(groups.to_pylist())}
    row = np.array([place[name] for name in row.dictionary.to_pylist()], np.int64)[row.indices.to_numpy()] if len(row) else np.zeros(0, np.int64)
    column = term.filter(pa.array(~named)).dictionary_encode().indices.to_numpy().astype(np.int64)
    width = int(column.max()) + 1 if len(column) else 0
    if width:  # terms of the same groups lie together, so that zero quadrants are large
        count, low = np.bincount(column), np.full(width, len(groups))
        np.minimum.at(low, column, row)
        place = np.empty(width, np.int64)
        place[np.lexsort((low, -count))] = np.arange(width)
        column = place[column]
    tree = QuadTree(row, column, value[~named], zero, width)
    parts = []
    for first, second, found in joint_distances(tree, width):
        i, j = np.meshgrid(np.arange(first, first + found.shape[0]), np.arange(second, second + found.shape[1]), indexing="ij")
        pick = i < j
        parts.append(pa.Table.from_arrays([pa.array([block[0].as_py()] * int(pick.sum()), pa.string()), groups.take(pa.array(i[pick])),
                                           groups.take(pa.array(j[pick])), pa.array(found[pick])], schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources, and the terms that a
    source has more of than its language."""
    counts = stored(count_terms(docs), "term-counts")
    term = Window.partitionBy("lang", "term")
    cells = stored(counts.where("term is not null").withColumns({
        "all_docs": F.sum("docs").over(term), "all_n": F.sum("n").over(term), "one": (F.col("source") == F.min("source").over(term)).cast("long")})
        .where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "all_n", "one"), "term-cells")
    langs = cells.groupBy("lang").agg(F.sum("one").alias("kept"), F.sum("n").alias("lang_total"), F.count("*").alias("cells"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = stored(
        counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *(F.coalesce(F.col(c), none).alias(c) for c in ("total", "kept", "lang_total")),
                F.greatest(F.lit(1), F.ceil(F.coalesce(F.col("cells"), none) / BLOCK_CELLS).cast("long")).alias("blocks")), "term-groups")
    priced = (cells.join(small_enough(groups, 96), ["lang", "source"])
              .withColumn("price", price(F.col("n"), F.col("total"), F.col("kept")))
              .withColumn("lang_price", price(F.col("all_n"), F.col("lang_total"), F.col("kept"))))
    zero = F.when(F.col("kept") > 0, price(none, F.col("total"), F.col("kept"))).otherwise(0)
    rows = (priced.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "price")
            .unionByName(groups.select("lang", F.explode(F.sequence(none, F.col("blocks") - 1)).alias("block"), "source",
                                       F.lit(None).cast("string").alias("term"), zero.alias("price"))))
    apart = (rows.groupBy("lang", "block").applyInArrow(_block_distances, "lang string, a string, b string, value long")
             .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = apart.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                          F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    more = priced.where("price > lang_price").select("lang", "source", F.col("term").alias("item"), (F.col("price") - F.col("lang_price")).alias("value"))
    terms = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(terms.select(*columns))
