"""Approximate nearest neighbours by vantage-point trees, one a shard.

Largest inner product becomes smallest Euclidean distance when each candidate gets one more component,
sqrt(M^2 - |x|^2) with M the longest norm, and each query a zero. In a tree a node has a vantage point and
its points split in two at the median distance from it, each half with the distances' range. A half is
skipped when ``factor`` times the triangle inequality's lower bound exceeds the query's k-th best distance
so far: factor 1 is exact, larger factors prune more.

Space is cut into cells by the upper part of such a tree, fitted on a bounded sample; every vector goes to
its cell, and the halves' ranges are taken over all vectors. A cell's vectors are dealt to shards of
bounded size, each with a tree of its own, so that equal vectors are no hot cell. A query first searches
its own cell; the k-th best distance there tells which other cells may hold a nearer one, and only those
are searched after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.llm.arrow import tidy
from parquill.runtime import checkpoint

#: Vectors of one shard, about: a tree of a few MB.
SHARD_VECTORS = 8_192
#: Cells at most, and vectors and their components of the sample that cells are fitted on, which the driver holds.
MAX_CELLS, SAMPLE_VECTORS, SAMPLE_FLOATS = 4_096, 16_384, 2_000_000
#: Points of a leaf.
LEAF = 128
#: Queries that walk a tree together.
QUERY_BLOCK = 512


@dataclass
class Leaf:
    number: int
    of: np.ndarray


@dataclass
class Node:
    point: int  # the vantage point
    low: tuple[float, float]  # range of distances from it, for each half
    high: tuple[float, float]
    inner: Node | Leaf
    outer: Node | Leaf


class VantageTree:
    """A tree over vectors for largest inner products."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order], ids[order]
        norms = (self.vectors**2).sum(1)
        self.longest = float(norms.max(initial=0.0))
        self.points = np.hstack([self.vectors, np.sqrt(np.maximum(0, self.longest - norms))[:, None]])
        self.leaf, self.leaves = leaf, 0
        self.root = self._build(np.arange(len(ids)))

    def _build(self, of: np.ndarray) -> Node | Leaf:
        if len(of) <= self.leaf:
            self.leaves += 1
            return Leaf(self.leaves - 1, of)
        # The vantage point: the one farthest from the first, so distances from it spread.
        far = ((self.points[of] - self.points[of[0]]) ** 2).sum(1)
        point = int(of[np.argmax(far)])
        away = np.sqrt(((self.points[of] - self.points[point]) ** 2).sum(1))
        order = np.argsort(away, kind="stable")
        half = len(of) // 2
        near, rest = order[:half], order[half:]
        return Node(point, (float(away[near[0]]), float(away[near[-1]])), (float(away[rest[0]]), float(away[rest[-1]])), self._build(np.sort(of[near])), self._build(np.sort(of[rest])))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each query's k best ids (-1: none) and scores among the tree's vectors but ``own``; ties to the smaller id.

        Only scores of ``floor``, a bound that the query brings along, and above are asked for.
        """
        n = len(queries)
        self._q, self._own, self._k, self._factor = queries, own, k, factor
        self._flat = np.hstack([queries, np.zeros((n, 1))])
        self._base = (queries**2).sum(1) + self.longest  # squared distance = base - 2 * inner product
        self._at = np.full((n, k), -1)
        self._score = np.full((n, k), -np.inf)
        self._floor = np.full(n, -np.inf) if floor is None else floor
        self._home = np.full(n, -1)
        if len(self.ids):
            self._descend(self.root, np.arange(n))
            self._walk(self.root, np.arange(n))
        return np.where(self._at >= 0, self.ids[self._at] if len(self.ids) else -1, -1), self._score

    def _away(self, node: Node, who: np.ndarray) -> np.ndarray:
        return np.sqrt(((self._flat[who] - self.points[node.point]) ** 2).sum(1))

    def _descend(self, node: Node | Leaf, who: np.ndarray) -> None:
        """Every query to the leaf it falls into, for a first bound on its k-th best distance."""
        if not len(who):
            return
        if isinstance(node, Leaf):
            self._home[who] = node.number
            self._leaf(node.of, who)
            return
        inside = self._away(node, who) <= (node.low[1] + node.high[0]) / 2
        self._descend(node.inner, who[inside])
        self._descend(node.outer, who[~inside])

    def _walk(self, node: Node | Leaf, who: np.ndarray) -> None:
        """All queries that a half may better go there together."""
        if not len(who):
            return
        if isinstance(node, Leaf):
            self._leaf(node.of, who[self._home[who] != node.number])
            return
        away = self._away(node, who)
        for child, span in ((node.inner, node.low), (node.outer, node.high)):
            bound = np.maximum(0, np.maximum(span[0] - away, away - span[1]))
            worst = np.sqrt(np.maximum(0, self._base[who] - 2 * np.maximum(self._score[who, -1], self._floor[who])))
            self._walk(child, who[self._factor * bound <= worst * (1 + 1e-9) + 1e-9])

    def _leaf(self, of: np.ndarray, who: np.ndarray) -> None:
        if not len(who):
            return
        own = self._own[who]
        rough = self._q[who] @ self.vectors[of].T
        hope = (rough >= np.maximum(self._score[who, -1], self._floor[who])[:, None] - 1e-9).any(1)
        who, rough, own = who[hope], rough[hope], own[hope]
        if not len(who):
            return
        rough = np.where(self.ids[of][None, :] == own[:, None], -np.inf, rough)
        floor = np.maximum(self._score[who, -1], self._floor[who])
        if len(of) > self._k:  # the best, and all within rounding of the k-th
            floor = np.maximum(floor, -np.partition(-rough, self._k - 1, axis=1)[:, self._k - 1])
        row, col = np.nonzero(rough >= np.where(np.isneginf(floor), -np.finfo(float).max, floor - 1e-9)[:, None])
        if not len(row):
            return
        # Only queries with new candidates, each with as many places as the most have.
        some, first, n = np.unique(row, return_index=True, return_counts=True)
        place = np.arange(len(row)) - np.repeat(first, n)
        line = np.repeat(np.arange(len(some)), n)
        shape = (len(some), int(n.max()))
        exact, where = np.full(shape, -np.inf), np.full(shape, -1)
        exact[line, place] = inner(self._q[who[row]], self.vectors[of[col]])
        where[line, place] = of[col]
        who = who[some]
        scores, at = np.hstack([self._score[who], exact]), np.hstack([self._at[who], where])
        best = np.lexsort((np.where(at >= 0, self.ids[at], np.iinfo(np.int64).max), -scores), axis=1)[:, : self._k]
        self._score[who] = np.take_along_axis(scores, best, 1)
        at = np.take_along_axis(at, best, 1)
        self._at[who] = np.where(np.isneginf(self._score[who]), -1, at)


class Cells:
    """The upper part of a vantage-point tree over sampled points: node i has a point, a radius and two ways, each to a node or (below 0) to a cell."""

    def __init__(self, vectors: np.ndarray, longest: float, cells: int) -> None:
        """longest: the square of the longest norm of all vectors."""
        self.longest = longest
        points = self.lift(vectors)
        self.at, self.radius, self.ways, self.cells = [], [], [], 0
        self._cut(points, np.arange(len(points)), cells)
        self.at = np.array(self.at).reshape(-1, points.shape[1])
        self.low, self.high = np.zeros((len(self.at), 2)), np.full((len(self.at), 2), np.inf)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors, np.sqrt(np.maximum(0, self.longest - (vectors**2).sum(1)))[:, None]])

    def _cut(self, points: np.ndarray, of: np.ndarray, cells: int) -> int:
        away = None
        if cells > 1 and len(of) > 1:
            point = points[of[np.argmax(((points[of] - points[of[0]]) ** 2).sum(1))]]
            away = np.sqrt(((points[of] - point) ** 2).sum(1))
        if away is None or away.max() == away.min():  # one cell, or all points are equal or equally far
            self.cells += 1
            return -self.cells
        number, order = len(self.at), np.argsort(away, kind="stable")
        half = len(of) * (cells // 2) // cells
        self.at.append(point)
        self.radius.append(float(away[order[half - 1]] + away[order[half]]) / 2)
        self.ways.append([0, 0])
        for side, (some, n) in enumerate(((order[:half], cells // 2), (order[half:], cells - cells // 2))):
            self.ways[number][side] = self._cut(points, of[some], n)
        return number

    def _away(self, node: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(((points - self.at[node]) ** 2).sum(1))

    def places(self, points: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], tuple[float, float]]]:
        """Each point's cell, and by node and side the range of distances of the points that went there."""
        cell, ranges = np.zeros(len(points), np.int64), {}
        todo = [(0 if len(self.at) else -1, np.arange(len(points)))]
        while todo:
            node, of = todo.pop()
            if node < 0:
                cell[of] = -node - 1
                continue
            away = self._away(node, points[of])
            inside = away <= self.radius[node]
            for side, some in ((0, inside), (1, ~inside)):
                if some.any():
                    ranges[node, side] = float(away[some].min()), float(away[some].max())
                    todo.append((self.ways[node][side], of[some]))
        return cell, ranges

    def reached(self, points: np.ndarray, worst: np.ndarray, factor: float) -> list[tuple[np.ndarray, int]]:
        """(points, cell) of all cells that may hold a point within ``worst`` of each, by the triangle inequality times ``factor``."""
        out, todo = [], [(0 if len(self.at) else -1, np.arange(len(points)))]
        while todo:
            node, of = todo.pop()
            if not len(of):
                continue
            if node < 0:
                out.append((of, -node - 1))
                continue
            away = self._away(node, points[of])
            for side in (0, 1):
                bound = np.maximum(0, np.maximum(self.low[node, side] - away, away - self.high[node, side]))
                todo.append((self.ways[node][side], of[factor * bound <= worst[of] * (1 + 1e-9) + 1e-9]))
        return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, so equal vectors tie and SQL sums alike."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def nearest(vectors: DataFrame, *, query: str, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """The k nearest rows, by largest inner product, of each row for which the SQL condition ``query`` holds.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (double precision, on the original
    vectors), nearest first, ties to the smaller id. A query's own row is no candidate of its.

    Rows with a null id and vectors that are null, empty, zero or hold null or non-finite components
    take no part. All vectors should have one length; others than the commonest (of two as common, the
    shorter) take no part. Rows that repeat an id are candidates each, for other ids; a repeated query id
    is searched once, by any of its rows. With fewer than k candidates all are returned; an empty table
    gives an empty result.
    """
    x = F.col(vector_col)
    usable = x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    of_kind = "array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"  # single precision travels as it is
    good = vectors.filter(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), x.cast(of_kind).alias("vector"), F.expr(query).alias("asks"))
    norm = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v)
    sizes = good.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("count"), F.max(norm).alias("longest")).orderBy(F.desc("count"), "size").limit(1).collect()
    width, n, longest = (sizes[0]["size"], sizes[0]["count"], sizes[0]["longest"]) if sizes else (0, 0, 0.0)
    good = good.filter(F.size("vector") == width)
    few = good.orderBy(F.xxhash64("id"), "id").limit(max(2, min(SAMPLE_VECTORS, SAMPLE_FLOATS // max(1, width)))).select("vector").toArrow()["vector"]
    sampled = few.combine_chunks().flatten().to_numpy().astype(float).reshape(-1, width) if width else np.zeros((0, 0))
    cells = Cells(sampled, longest, min(MAX_CELLS, max(1, -(-n // shard_vectors))))

    def points(part: pa.RecordBatch) -> np.ndarray:
        return part.column(part.schema.get_field_index("vector")).flatten().to_numpy().astype(float).reshape(len(part), width)

    kind = f"id long, vector {of_kind}, asks boolean, cell int"

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if len(part):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.places(cells.lift(points(part)))[0], pa.int32())], names=["id", "vector", "asks", "cell"])

    def extent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if len(part):
                found = [(node, side, *span) for (node, side), span in cells.places(cells.lift(points(part)))[1].items()]
                yield pa.RecordBatch.from_pylist([dict(zip(("node", "side", "low", "high"), f, strict=True)) for f in found], schema=pa.schema([("node", pa.int32()), ("side", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

    placed = checkpoint(good.mapInArrow(tidy(place), kind))
    for r in placed.select("vector").mapInArrow(tidy(extent), "node int, side int, low double, high double").groupBy("node", "side").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # two rows a cell at most
        cells.low[r["node"], r["side"]], cells.high[r["node"], r["side"]] = r["low"], r["high"]
    blocks = np.ones(cells.cells, np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row a cell
        blocks[r["cell"]] = -(-r["count"] // shard_vectors)
    of_cell = F.element_at(F.lit(blocks.tolist()), F.col("cell") + 1)
    block = F.expr("cast(pmod(xxhash64(id, 5), blocks) as int)")
    candidates = placed.withColumn("blocks", of_cell).select("cell", block.alias("block"), F.lit(False).alias("asks"), "id", "vector", F.lit(None).cast("double").alias("floor"))
    asked = checkpoint(placed.filter("asks").dropDuplicates(["id"]).select("id", "vector", "cell"))

    def home(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if len(part):
                q = points(part)
                cell = cells.places(np.hstack([q, np.zeros((len(q), 1))]))[0]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32())], names=["id", "vector", "cell"])

    at_home = checkpoint(asked.select("id", "vector").mapInArrow(tidy(home), f"id long, vector {of_kind}, cell int"))
    first = checkpoint(_searched(candidates, _to_blocks(at_home.withColumn("floor", F.lit(None).cast("double")), of_cell), width, k, factor))
    found = first
    if cells.cells > 1:
        place_of = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        bound = first.withColumn("_place", place_of).filter(F.col("_place") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("floor"))
        bounded = at_home.join(bound, F.col("id") == F.col("_id"), "left").select("id", "vector", "cell", "floor")

        def visits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if not len(part):
                    continue
                q, own = points(part), part.column(2).to_numpy()
                floor = part.column(3).to_numpy(zero_copy_only=False).astype(float)
                worst = np.sqrt(np.maximum(0, (q**2).sum(1) + longest - 2 * np.where(np.isnan(floor), -np.inf, floor)))
                for who, cell in cells.reached(np.hstack([q, np.zeros((len(q), 1))]), worst, factor):
                    some = pa.array(who[own[who] != cell])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(some), part.column(1).take(some), pa.array(np.full(len(some), cell), pa.int32()), part.column(3).take(some)], names=["id", "vector", "cell", "floor"])

        more = bounded.mapInArrow(tidy(visits), f"id long, vector {of_kind}, cell int, floor double")
        found = first.union(_searched(candidates, _to_blocks(more, of_cell), width, k, factor))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _to_blocks(queries: DataFrame, of_cell: Column) -> DataFrame:
    """Queries at all blocks of their cell."""
    return queries.select("cell", F.explode(F.sequence(F.lit(0), (of_cell - 1).cast("int"))).alias("block"), F.lit(True).alias("asks"), "id", "vector", "floor")


def _searched(candidates: DataFrame, queries: DataFrame, width: int, k: int, factor: float) -> DataFrame:
    """Each query's k best of each shard that it is at."""
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for part in parts:
            if not len(part):
                continue
            shard = part.column(0).to_numpy().astype(np.int64) * (1 << 31) + part.column(1).to_numpy()
            asks = part.column(2).to_numpy(zero_copy_only=False)
            ids = part.column(3).to_numpy()
            rows = part.column(4).flatten().to_numpy().astype(float).reshape(len(part), width)
            floor = part.column(5).to_numpy(zero_copy_only=False).astype(float)
            floor = np.where(np.isnan(floor), -np.inf, floor)
            change = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            start = [0, *change, len(shard)]
            for a, b in zip(start, start[1:], strict=False):
                if shard[a] != now:
                    now, held, tree = shard[a], [], None
                if not asks[a]:
                    held.append((rows[a:b].copy(), ids[a:b].copy()))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree, held = VantageTree(np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held])), []
                for c in range(a, b, QUERY_BLOCK):
                    q = slice(c, min(b, c + QUERY_BLOCK))
                    found, score = tree.search(rows[q], ids[q], k, factor, floor[q])
                    keep = ~np.isneginf(score)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[q], keep.sum(1))), pa.array(found[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    both = candidates.unionByName(queries).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
    return both.mapInArrow(tidy(search), out)
