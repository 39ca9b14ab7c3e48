"""Exact top-k by inner product, with best-first search in paged metric trees.

With one more coordinate that makes all candidates equally long, the largest inner product
is the smallest distance, and distances obey the triangle inequality. Candidates are dealt
by a hash into trees of bounded size, so a vector that occurs very often is spread. A task
builds a tree: nodes are pages, an entry of an inner page has the vector it routes by, the
radius that covers everything below, and its distance to the vector its own page is routed
by; leaf entries have that distance, too. Pages are stored as a table.

Queries are answered in blocks, each block by every tree: a heap gives the page of the
least possible distance, until that is farther than the k-th result so far. An entry whose
stored distance to the page's vector already puts it, by the triangle inequality, beyond
that result is passed over without computing anything. The results of the trees are
merged. Scores are integers; distances have a margin for rounding, so none is lost.

Defined cases: vectors that are null or hold a null or non-finite component, and rows
without an identifier, take no part; vectors are compared with those of equal length only;
rows of equal identifier and vector are one; rows of the query's identifier are its own;
different vectors of one identifier are queries of their own; ties go to the smaller
identifier; an empty table gives an empty result. Components beyond 2^62 / 256 are cut
there, and scores beyond 64 bits at their end.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.llm.common import as_long, tasks_for, written

TREE_ROWS = 16_384  # vectors of a tree
QUERY_ROWS = 16_384  # queries of a block
PAGE = 512  # entries
FAN_OUT = 32
PAGES = "tree int, page int, leaf boolean, slack double, ids binary, vectors binary, last binary, to_parent binary, radius binary, children binary"
RESULT = "number long, query_id long, vec_id long, score long"


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    width = len(rows[0])
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), width)


def _large_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products that doubles may not hold exactly."""
    found = vectors.astype(object) @ query.astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in found], np.int64)


class _Builder:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        points = vectors.astype(np.float64)
        norms = (points * points).sum(1)
        self.length = float(norms.max())
        self.points = np.concatenate([points, np.sqrt(np.maximum(0.0, self.length - norms))[:, None]], 1)
        self.pages: list[tuple] = []
        self.draw = np.random.Generator(np.random.PCG64(7))

    def _distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[to]) ** 2).sum(1))

    def _middle(self, rows: np.ndarray) -> int:
        return int(rows[((self.points[rows] - self.points[rows].mean(0)) ** 2).sum(1).argmin()])

    def _parts(self, rows: np.ndarray) -> list[np.ndarray]:
        seeds = self.points[self.draw.choice(rows, FAN_OUT, replace=False)]
        near = ((self.points[rows] ** 2).sum(1)[:, None] - 2 * self.points[rows] @ seeds.T + (seeds**2).sum(1)).argmin(1)
        parts = [rows[near == k] for k in range(FAN_OUT)]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(rows):  # many equal vectors
            return np.array_split(rows, FAN_OUT)
        return parts

    def build(self, rows: np.ndarray, parent: int) -> int:
        """The page of ``rows``, whose routing vector is ``parent``; returns its number."""
        if len(rows) <= PAGE:
            page = (True, rows, self._distances(rows, parent), np.zeros(len(rows)), np.full(len(rows), -1))
        else:
            pivots, radii, children = [], [], []
            for part in self._parts(rows):
                pivot = self._middle(part)
                pivots.append(pivot)
                radii.append(float(self._distances(part, pivot).max()))
                children.append(self.build(part, pivot))
            pivots = np.array(pivots)
            page = (False, pivots, self._distances(pivots, parent), np.array(radii), np.array(children))
        self.pages.append(page)
        return len(self.pages) - 1

    def table(self, tree: int) -> pa.Table:
        rows = np.arange(len(self.ids))
        self.build(rows, self._middle(rows))  # the last page is the root
        slack = 1e-9 * (1 + math.sqrt(self.length)) * self.points.shape[1]
        columns = list(zip(*self.pages))
        blob = lambda arrays, kind: pa.array([np.ascontiguousarray(a, kind).tobytes() for a in arrays], pa.binary())
        return pa.table({
            "tree": pa.array([tree] * len(self.pages), pa.int32()), "page": pa.array(range(len(self.pages)), pa.int32()), "leaf": pa.array(columns[0]),
            "slack": pa.array([slack] * len(self.pages)), "ids": blob([self.ids[r] for r in columns[1]], "<i8"), "vectors": blob([self.vectors[r] for r in columns[1]], "<i8"),
            "last": blob([self.points[r, -1] for r in columns[1]], "<f8"), "to_parent": blob(columns[2], "<f8"), "radius": blob(columns[3], "<f8"), "children": blob(columns[4], "<i8")})


class _Tree:
    def __init__(self, table: pa.Table, width: int):
        rows = sorted(table.to_pylist(), key=lambda r: r["page"])
        read = lambda row, name, kind: np.frombuffer(row[name], kind)
        self.slack = rows[0]["slack"]
        self.pages = [(r["leaf"], read(r, "ids", "<i8"), read(r, "vectors", "<i8").reshape(-1, width) if width else np.zeros((len(read(r, "ids", "<i8")), 0), np.int64),
                       read(r, "to_parent", "<f8"), read(r, "radius", "<f8"), read(r, "children", "<i8")) for r in rows]
        lasts = [read(r, "last", "<f8") for r in rows]
        self.points = [page[2].astype(np.float64) for page in self.pages]
        self.length = max((float(((p * p).sum(1) + last * last).max()) for p, last in zip(self.points, lasts)), default=0.0)
        self.largest = max((float(np.abs(p).max(initial=0)) for p in self.points), default=0.0)
        self.computed = 0

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) of rows other than the query's, best first."""
        point = query.astype(np.float64)
        base = float(point @ point) + self.length
        slack = self.slack + 1e-9 * math.sqrt(base)
        exact = self.largest * float(np.abs(point).max(initial=0)) * max(1, len(point)) < 2**53
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        reach = math.inf
        heap = [(0.0, len(self.pages) - 1, math.nan)]
        while heap:
            least, number, from_pivot = heapq.heappop(heap)
            if least > reach:
                break
            leaf, ids, vectors, to_parent, radius, children = self.pages[number]
            if from_pivot == from_pivot and reach < math.inf:  # stored distances: what they exclude is not computed
                kept = np.flatnonzero(np.abs(from_pivot - to_parent) - radius <= reach + slack)
                if not len(kept):
                    continue
                points = self.points[number][kept]
            else:
                kept, points = None, self.points[number]
            products = points @ point
            self.computed += len(products)
            if leaf:
                names = ids if kept is None else ids[kept]
                scores = products.astype(np.int64) if exact else _large_products(vectors if kept is None else vectors[kept], query)
                if len(best) == k:
                    worth = np.flatnonzero(scores >= best[0][0])
                    names, scores = names[worth], scores[worth]
                for name, score in zip(names.tolist(), scores.tolist()):
                    if name == query_id:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -name))
                    elif (score, -name) > best[0]:
                        heapq.heapreplace(best, (score, -name))
                if len(best) == k:
                    reach = math.sqrt(max(0.0, base - 2.0 * best[0][0])) + slack
            else:
                distances = np.sqrt(np.maximum(0.0, base - 2.0 * products))
                bounds = np.maximum(0.0, distances - (radius if kept is None else radius[kept]) - slack)
                below = children if kept is None else children[kept]
                for bound, child, distance in zip(bounds.tolist(), below.tolist(), distances.tolist()):
                    if bound <= reach:
                        heapq.heappush(heap, (bound, child, distance))
        return sorted(((score, -name) for score, name in best), key=lambda x: (-x[0], x[1]))


def build(vectors: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """The pages of the trees over ``vectors`` (vec_id, vector of whole numbers), with the vectors' length, as a written table."""
    groups = tasks_for(vectors, tree_rows)

    def grow(table: pa.Table) -> pa.Table:
        tree, dims = table.column("tree")[0].as_py(), table.column("dims")[0].as_py()
        found = _Builder(table.column("vec_id").to_numpy(), _matrix(table.column("vector"))).table(tree)
        return found.append_column("dims", pa.array([dims] * len(found), pa.int32()))

    dealt = vectors.withColumn("tree", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(groups)).cast("int")).withColumn("dims", F.size("vector"))
    return written(dealt.groupBy("dims", "tree").applyInArrow(grow, PAGES + ", dims int"), "metric-pages")


def search(pages: DataFrame, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` best rows of all trees for every query: query_id, rank (from 1), vec_id, score."""
    blocks = tasks_for(queries, query_rows)
    trees = pages.select(F.col("dims").alias("dims"), F.col("tree").alias("tree")).distinct()
    asked = queries.select(F.xxhash64("vec_id", "vector").alias("number"), F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dims"))
    asked = asked.withColumn("block", F.pmod("number", F.lit(blocks)).cast("int")).join(F.broadcast(trees), "dims")  # a row per tree: vectors / TREE_ROWS
    stored = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(table: pa.Table, questions: pa.Table) -> pa.Table:
        out = []
        if len(table) and len(questions):
            vectors = _matrix(questions.column("vector"))
            tree = _Tree(table, vectors.shape[1])
            for number, name, vector in zip(questions.column("number").to_pylist(), questions.column("query_id").to_pylist(), vectors):
                out += [(number, name, found, score) for score, found in tree.search(name, vector, k)]
        return pa.table({name: as_long([row[i] for row in out]) for i, name in enumerate(("number", "query_id", "vec_id", "score"))})

    found = stored.groupBy("dims", "tree", "block").cogroup(asked.groupBy("dims", "tree", "block")).applyInArrow(answer, RESULT)
    best = W.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(table: DataFrame, k: int, query_of: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """For every row that ``query_of`` selects, the ``k`` other rows of largest inner product."""
    rows = table.where(F.col(key).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), whole(F.col(vector), scale).alias("vector"), query_of.alias("asked")).dropDuplicates(["vec_id", "vector"])
    rows = written(rows, "metric-vectors")
    return search(build(rows.drop("asked")), rows.where("asked"), k)
