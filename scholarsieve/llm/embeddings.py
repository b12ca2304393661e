"""Embedding near-duplicates with hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label are one class with a multiplicity. The classes of a label are dealt into shards of a
bounded size by hash, each shard builds one graph, and every class queries every shard of its label, in blocks.
A beam is widened for a query while its last entry still passes the threshold, and for a whole block until an
audit finds its target share of known links: those of some of the block's queries, by all vectors of the shard, and
those of planted queries, vectors of the shard turned away until their cosine is the threshold, of which there are
always some. A beam that grows past an eighth of the shard is widened to all of it, and exact. Found pairs are verified by cosine in double precision. Tasks return link counts
and a spanning forest of their links, never all pairs, and the forests' edges are united into components.

Nulls and edge cases: null labels, null, empty or zero vectors, and vectors with null or non-finite components
link with nothing and are components of their own; vectors of different lengths never link; rows with a null
vec_id take no part and get null results; rows repeating a vec_id count as that many vectors; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scholarsieve.llm.common import components, stored

COSINE = 0.98
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
NEIGHBOURS = 12  # per node and upper layer; twice as many in the lowest
BUILD_BEAM = 32
FIRST_BEAM = 32
AUDIT_ROWS = 64
AUDIT_RECALL = 0.999
PLANTED_ROWS = 512  # planted queries of an audit, each with a link that is as weak as links may be
FULL_SHARE = 8  # a beam of at least a shard's rows / FULL_SHARE is widened to the whole shard: a scan then costs less than the walk
MARGIN = 1e-4  # of single-precision scores against the threshold; doubles decide


class Layer:
    """Neighbour lists of one layer over global node numbers; -1 fills."""

    def __init__(self, total: int, width: int):
        self.width = width
        self.links = np.full((total, width), -1, np.int32)

    def beam(self, vectors, queries, entries, ef, step: int = 4):
        """(ids, scores) of the ef best nodes that each query's beam search reaches, best first; -1 fills."""
        n, q = len(vectors), len(queries)
        ids = np.full((q, ef), -1, np.int64)
        scores = np.full((q, ef), -np.inf, np.float32)
        open_ = np.zeros((q, ef), bool)
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True  # the fill
        rows = np.arange(q)
        fresh = np.where(entries < 0, n, entries)
        while len(rows):
            # Distinct unseen nodes only: of equal numbers in one row the first counts.
            order = np.sort(fresh, axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = n
            order[seen[rows[:, None], order]] = n
            seen[rows[:, None], order] = True
            real = order < n
            got = np.where(real, np.einsum("qd,qkd->qk", queries[rows], vectors[np.where(real, order, 0)]), -np.inf).astype(np.float32)
            all_scores = np.concatenate([scores[rows], got], axis=1)
            best = np.argsort(-all_scores, axis=1, kind="stable")[:, :ef]
            scores[rows] = np.take_along_axis(all_scores, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(real, order, -1)], axis=1), best, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], real], axis=1), best, 1)
            rows = rows[open_[rows].any(axis=1)]
            if not len(rows):
                break
            pick = np.argsort(~open_[rows], axis=1, kind="stable")[:, :step]
            chosen = np.take_along_axis(open_[rows], pick, 1)
            nodes = np.where(chosen, np.take_along_axis(ids[rows], pick, 1), -1)
            open_[rows[:, None], pick] = False
            fresh = np.where(nodes[:, :, None] < 0, -1, self.links[nodes]).reshape(len(rows), -1)
            fresh = np.where(fresh < 0, n, fresh).astype(np.int64)
        return ids, scores


def _diverse(vectors, node: int, candidates: np.ndarray, scores: np.ndarray, most: int) -> list[int]:
    """Candidates nearer to the node than to any neighbour chosen before; the nearest others fill up."""
    order = np.argsort(-scores, kind="stable")
    candidates, scores = candidates[order], scores[order]
    among = vectors[candidates] @ vectors[candidates].T
    chosen: list[int] = []
    for i in range(len(candidates)):
        if len(chosen) == most:
            break
        if not chosen or scores[i] > among[i, chosen].max():
            chosen.append(i)
    rest = [i for i in range(len(candidates)) if i not in set(chosen)]
    return [int(candidates[i]) for i in chosen + rest[:most - len(chosen)]]


class Graph:
    def __init__(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS, build_beam: int = BUILD_BEAM):
        n = len(vectors)
        self.vectors = vectors.astype(np.float32)
        # Levels fall off geometrically; nodes are numbered by the caller, so their hash order is reproducible.
        uniform = np.random.default_rng(n).random(n)
        self.levels = np.minimum((-np.log(uniform + 1e-12) / np.log(neighbours)).astype(int), 6)
        order = np.argsort(-self.levels, kind="stable")
        self.top = int(self.levels.max()) if n else 0
        self.entry = int(order[0]) if n else -1
        self.layers = [Layer(n, neighbours * (2 if level == 0 else 1)) for level in range(self.top + 1)]
        for level in range(self.top, -1, -1):
            self._build(level, order[self.levels[order] >= level], build_beam, neighbours)

    def to_bytes(self, **more: np.ndarray) -> bytes:
        """The graph and further arrays as one array file."""
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, top_entry=np.array([self.top, self.entry]), **{f"layer{i}": layer.links for i, layer in enumerate(self.layers)}, **more)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["Graph", dict]:
        arrays = dict(np.load(io.BytesIO(data)))
        graph = cls.__new__(cls)
        graph.vectors = arrays.pop("vectors")
        graph.top, graph.entry = map(int, arrays.pop("top_entry"))
        graph.layers = []
        for i in range(graph.top + 1):
            links = arrays.pop(f"layer{i}")
            layer = Layer.__new__(Layer)
            layer.width, layer.links = links.shape[1], links
            graph.layers.append(layer)
        return graph, arrays

    def _entries(self, queries, down_to: int) -> np.ndarray:
        at = np.full((len(queries), 1), self.entry)
        for level in range(self.top, down_to, -1):
            at, _ = self.layers[level].beam(self.vectors, queries, at, 4)
        return at

    def _build(self, level: int, nodes: np.ndarray, beam: int, neighbours: int) -> None:
        layer, done = self.layers[level], 1
        while done < len(nodes):
            batch = nodes[done:done + max(1, min(256, done))]
            queries = self.vectors[batch]
            ids, scores = layer.beam(self.vectors, queries, self._entries(queries, level), beam)
            own = queries @ queries.T
            np.fill_diagonal(own, -np.inf)
            near = np.argsort(-own, axis=1)[:, :min(neighbours, len(batch) - 1)]
            ids = np.concatenate([ids, batch[near]], axis=1)
            scores = np.concatenate([scores, np.take_along_axis(own, near, 1)], axis=1)
            for node, candidates, score in zip(batch, ids, scores):
                real = (candidates >= 0) & (candidates != node)
                chosen = _diverse(self.vectors, node, candidates[real], score[real], neighbours)
                self._join(layer, int(node), chosen)
            done += len(batch)

    def _join(self, layer: Layer, node: int, chosen: list[int]) -> None:
        have = [int(x) for x in layer.links[node] if x >= 0]
        self._set(layer, node, list(dict.fromkeys(have + chosen)))
        for other in chosen:
            row = layer.links[other]
            if (row == node).any():
                continue
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
            else:
                self._set(layer, other, [*map(int, row), node])

    def _set(self, layer: Layer, node: int, links: list[int]) -> None:
        if len(links) > layer.width:
            at = np.array(links)
            links = _diverse(self.vectors, node, at, self.vectors[at] @ self.vectors[node], layer.width)
        layer.links[node] = -1
        layer.links[node, :len(links)] = links

    def nearest(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """The `beam` nodes per query that the search holds last; -1 fills."""
        queries = queries.astype(np.float32)
        return self.layers[0].beam(self.vectors, queries, self._entries(queries, 0), beam)[0]

    def near(self, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Nodes with a score of `least` or more that the search finds; each beam widens until its last entry is below."""
        n, found = len(self.vectors), [np.zeros(0, np.int64)] * len(queries)
        queries = queries.astype(np.float32)
        rows = np.arange(len(queries))
        while len(rows):
            if beam * FULL_SHARE >= n:
                scores = queries[rows] @ self.vectors.T
                for r, s in zip(rows, scores):
                    found[r] = np.flatnonzero(s >= least)
                break
            ids, scores = self.layers[0].beam(self.vectors, queries[rows], self._entries(queries[rows], 0), beam)
            for r, i, s in zip(rows, ids, scores):
                found[r] = i[(s >= least) & (i >= 0)]
            rows = rows[(scores[:, -1] >= least)]
            beam *= 2
        return found


def planted(unit: np.ndarray, least: float, rows: int = PLANTED_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries): unit vectors whose cosine with these rows is the threshold, in directions drawn at random."""
    goals = np.unique(np.linspace(0, len(unit) - 1, min(rows, len(unit))).astype(int))
    aside = np.random.default_rng(len(unit)).normal(size=(len(goals), unit.shape[1]))
    aside -= (aside * unit[goals]).sum(axis=1)[:, None] * unit[goals]
    norm = np.linalg.norm(aside, axis=1)[:, None]
    return goals, least * unit[goals] + np.sqrt(1 - least * least) * np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 1e-9)


def search(graph: Graph, index: np.ndarray, queries: np.ndarray, least: float = COSINE, beam: int = FIRST_BEAM, audit_rows: int = AUDIT_ROWS,
           recall: float = AUDIT_RECALL) -> tuple[list[np.ndarray], int]:
    """Verified links of each query (numbers of index rows) and the beam width, twice that which passed the audit."""
    unit = index / np.linalg.norm(index, axis=1)[:, None]
    asked = queries / np.linalg.norm(queries, axis=1)[:, None]

    def links_of(rows: np.ndarray) -> list[np.ndarray]:
        return [ids[unit[ids] @ q >= least] if len(ids) else ids for q, ids in zip(rows, graph.near(rows, least - MARGIN, beam))]

    sample = asked[np.unique(np.linspace(0, len(asked) - 1, min(audit_rows, len(asked))).astype(int))] if len(asked) else asked
    # Beams that become whole scans need no audit.
    if len(sample) and beam * FULL_SHARE < len(index):
        links = int((sample @ unit.T >= least).sum())
        goals, turned = planted(unit, least)
        while beam * FULL_SHARE < len(index):
            met = sum(int(goal in ids) for start in range(0, len(goals), 256)
                      for goal, ids in zip(goals[start:start + 256], graph.nearest(turned[start:start + 256], beam)))
            if met >= recall * len(goals) and sum(map(len, links_of(sample))) >= recall * links:
                break
            beam *= 2
        beam *= 2  # a sample shows no rare misses: twice what it asks for
    return [ids for start in range(0, len(asked), 256) for ids in links_of(asked[start:start + 256])], beam


def _unpacked(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _build_index(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    first = pdf.iloc[0]
    vectors = _unpacked(pdf["vector"], int(first["dim"]))
    graph = Graph(vectors / np.linalg.norm(vectors, axis=1)[:, None])
    data = graph.to_bytes(exact=vectors, reps=pdf["rep"].to_numpy(np.int64), copies=pdf["copies"].to_numpy(np.int64))
    return pd.DataFrame([{"label": first["label"], "dim": first["dim"], "shard": first["shard"], "blocks": first["blocks"], "graph": data}])


def _search_block(queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
    out = [np.zeros((0, 3), np.int64)]
    if len(queries) and len(shards):
        graph, arrays = Graph.from_bytes(shards["graph"].iloc[0])
        vectors, reps, copies = arrays["exact"], arrays["reps"], arrays["copies"]
        asked = queries["rep"].to_numpy(np.int64)
        links, _ = search(graph, vectors, _unpacked(queries["vector"], vectors.shape[1]))
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        counts, edges = [], []
        for a, ids in zip(asked, links):
            others = ids[reps[ids] != a]
            counts.append((a, -1, int(copies[others].sum())))
            for b in reps[others]:
                x, y = find(int(a)), find(int(b))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((a, b, 0))
        out += [np.array(counts, np.int64).reshape(-1, 3), np.array(edges, np.int64).reshape(-1, 3)]
    rows = np.concatenate(out)
    return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1], "is_edge": rows[:, 1] != -1, "n": rows[:, 2]})


def near_duplicates(table: DataFrame, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    doubles = F.col("embedding").cast("array<double>")
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
             & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0))
    numbered = table.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    # Vectors of equal components are one class.
    classes = stored(numbered.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "embedding-classes")

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, np.float64).tobytes())

    reps = classes.select("label", F.size("embedding").alias("dim"), "rep", "copies", packed(doubles).alias("vector"))
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).agg(
        F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = stored(reps.join(sizes, ["label", "dim"])
                   .withColumn("shard", F.pmod(F.xxhash64("rep", F.lit("shard")), F.col("shards")).cast("int"))
                   .withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int")), "embedding-shards")
    index = stored(dealt.groupBy("label", "dim", "shard").applyInPandas(
        _build_index, f"label {dict(table.dtypes)['label']}, dim int, shard int, blocks int, graph binary"), "embedding-graphs")
    keys = ["label", "dim", "shard", "block"]
    asked = dealt.select("label", "dim", "block", "rep", "vector", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    copies = index.select("label", "dim", "shard", "graph", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    found = stored(asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(_search_block, "a long, b long, is_edge boolean, n long"), "embedding-links")
    counts = found.where("not is_edge").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    united = components(found.where("is_edge").select("a", "b"), "embedding-components").withColumnRenamed("node", "rep")
    results = (classes.join(counts, "rep", "left").join(united, "rep", "left")
               .select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")))
    placed = numbered.where("sound").join(results, ["label", "embedding"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    alone = numbered.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
