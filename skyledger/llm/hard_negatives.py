"""Hard negatives by inner product, with multiway hyperplane trees.

With one more coordinate that makes all rows equally long, a larger inner product is a smaller
distance, and a window of scores is an annulus around the anchor. A node of a tree has several
split points; every row belongs to the nearest one (the cells are bounded by hyperplanes), and
each split point stores the least and largest distance from itself to the rows of every sibling.
A search computes the anchor's distance to the split points of a node. A sibling whose
stored range, seen from any split point, does not meet the annulus holds nothing and is passed over; the
annulus shrinks as results are found. Leaves are compared exactly, in whole numbers.

The upper node is shared: split points from a bounded sample, each row dealt to the nearest one,
and each cell cut by a hash into trees that a task builds (rows that are equal, however many, thus spread over
trees). The trees store their ranges to the upper split points. Searches run in two passes: every anchor first in
the cell it lies in, then, with the annulus that this leaves, in the other cells that the upper ranges cannot
rule out. Anchors go to a tree in blocks; a block descends the tree together, as matrix products.

Defined cases: rows without an identifier or a label, and rows whose vector is null or holds a null or non-finite
component, take no part; vectors are compared with those of equal length only; repeated rows are rows of their own, also
as anchors (an anchor is not its own positive, but a row that repeats it may be); ties go to the smaller identifier; an
anchor without positives, or a positive whose window holds nothing, has no row; an empty table gives an empty result.
Components are cut at +-2^24 after scaling. Further columns of the table are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.llm.common import as_long, numbered, tasks_for, written
from skyledger.llm.metric_search import usable, whole

LARGEST = 1 << 24
TREE_BYTES = 1 << 24  # of the vectors of a tree
LEAF = 256  # rows of a leaf at most, unless more are equal
SPLITS = 16  # split points of a node within a tree
UPPER_SPLITS = 32
SAMPLE = 2048  # rows from which the upper split points are chosen
BLOCK_ROWS = 2048  # searches of a block
NONE = np.iinfo(np.int64).min
PAGES = "tree long, page long, rids binary, ids binary, labels binary, vectors binary, last binary, children binary, low binary, high binary"
ASKED = "search long, rid long, label long, same boolean, least long, most long, vector array<long>"


# --- Points ------------------------------------------------------------------------------

def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks)
    width = len(rows[0]) if len(rows) else 0
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), width)


def _lifted(vectors: np.ndarray, length: float) -> np.ndarray:
    """Rows with the coordinate that makes them all ``length`` long (squared)."""
    points = vectors.astype(np.float64)
    return np.concatenate([points, np.sqrt(np.maximum(0.0, length - (points * points).sum(1)))[:, None]], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)
    return np.sqrt(np.maximum(0.0, squares))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if largest < 2**53 else a @ b.T


def _margin(length: float) -> float:
    """What rounding can add to a distance between points of this squared length."""
    return 1e-6 * (1.0 + math.sqrt(length))


def _far_apart(points: np.ndarray, wanted: int) -> np.ndarray:
    """Rows chosen one after the other, each as far as possible from those before; fewer if the rest are equal to them."""
    chosen = [0]
    reach = _distances(points, points[:1])[:, 0]
    while len(chosen) < min(wanted, len(points)):
        following = int(reach.argmax())
        if reach[following] <= 0:
            break
        chosen.append(following)
        reach = np.minimum(reach, _distances(points, points[following:following + 1])[:, 0])
    return np.array(chosen)


# --- Trees -------------------------------------------------------------------------------

class _Builder:
    """Pages of one tree: a leaf holds rows; an inner page has split points, their children, and the ranges between them."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, length: float):
        order = np.lexsort((rids, ids))  # ties within a leaf are in order of the identifier
        self.rids, self.ids, self.labels, self.vectors = rids[order], ids[order], labels[order], vectors[order]
        self.points, self.margin = _lifted(self.vectors, length), _margin(length)
        self.pages: list[dict] = []
        self.draw = np.random.Generator(np.random.PCG64(11))

    def _page(self, rows: np.ndarray, children, low, high) -> int:
        blob = lambda a, kind: np.ascontiguousarray(a, kind).tobytes()
        self.pages.append({
            "page": len(self.pages), "rids": blob(self.rids[rows], "<i8"), "ids": blob(self.ids[rows], "<i8"), "labels": blob(self.labels[rows], "<i8"),
            "vectors": blob(self.vectors[rows], "<i4"), "last": blob(self.points[rows, -1], "<f8"), "children": blob(children, "<i8"), "low": blob(low, "<f8"), "high": blob(high, "<f8")})
        return len(self.pages) - 1

    def build(self, rows: np.ndarray) -> int:
        if len(rows) <= LEAF:
            return self._page(rows, [], [], [])
        drawn = self.draw.choice(rows, min(len(rows), 4 * SPLITS), replace=False)
        splits = drawn[_far_apart(self.points[drawn], SPLITS)]
        away = _distances(self.points[rows], self.points[splits])
        cell = away.argmin(1)
        if len(splits) == 1 or np.bincount(cell).max() == len(rows):
            return self._page(rows, [], [], [])  # nothing tells these rows apart
        there = [np.flatnonzero(cell == j) for j in range(len(splits))]
        there = [(splits[j], at) for j, at in enumerate(there) if len(at)]
        used = np.flatnonzero(np.bincount(cell, minlength=len(splits)))
        low = np.array([[away[at, i].min() for _, at in there] for i in used]) - self.margin
        high = np.array([[away[at, i].max() for _, at in there] for i in used]) + self.margin
        children = [self.build(rows[at]) for _, at in there]
        return self._page(np.array([s for s, _ in there]), children, low, high)

    def table(self, tree: int) -> pa.Table:
        self.build(np.arange(len(self.ids)))  # the last page is the root
        found = pa.Table.from_pylist(self.pages)
        return found.add_column(0, "tree", pa.array([tree] * len(found), pa.int64()))


@dataclass
class _Best:
    """The best results so far of each search: scores, identifiers and row numbers, best first."""

    scores: np.ndarray
    ids: np.ndarray
    rids: np.ndarray

    @classmethod
    def empty(cls, searches: int, k: int) -> _Best:
        return cls(np.full((searches, k), NONE), np.full((searches, k), np.iinfo(np.int64).max), np.full((searches, k), -1))

    def take(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        """Take what is better among ``scores`` (searches ``at`` x rows, rows in order of the identifier, NONE for no candidate)."""
        k = self.scores.shape[1]
        worth = np.flatnonzero((scores >= self.scores[at, -1:]).any(1) & (scores.max(1, initial=NONE) > NONE))
        if not len(worth):
            return
        at, scores = at[worth], scores[worth]
        if scores.shape[1] > k:
            first = np.argsort(-np.maximum(scores, NONE + 1), axis=1, kind="stable")[:, :k]
            scores, ids, rids = np.take_along_axis(scores, first, 1), ids[first], rids[first]
        else:
            ids, rids = np.broadcast_to(ids, scores.shape), np.broadcast_to(rids, scores.shape)
        scores, ids, rids = (np.concatenate([mine[at], new], 1) for mine, new in ((self.scores, scores), (self.ids, ids), (self.rids, rids)))
        order = np.lexsort((rids, ids, -np.maximum(scores, NONE + 1)), axis=1)[:, :k]
        self.scores[at], self.ids[at], self.rids[at] = (np.take_along_axis(x, order, 1) for x in (scores, ids, rids))


class _Searches:
    """A block of searches for the ``k`` best rows of the same or another label within a window of scores."""

    def __init__(self, asked: pa.Table, k: int, length: float):
        plain = lambda name: asked.column(name).to_numpy()
        self.number, self.rid, self.label = plain("search"), plain("rid"), plain("label")
        self.same, self.least, self.most = plain("same"), plain("least"), plain("most")
        self.vectors = _matrix(asked.column("vector"))
        points = self.vectors.astype(np.float64)
        self.points = np.concatenate([points, np.zeros((len(points), 1))], 1)
        self.base = (points * points).sum(1) + length
        self.margin = _margin(float(self.base.max(initial=0.0)))
        self.near = self._distance(self.most, self.base) - self.margin
        self.far = self._distance(self.least, self.base) + self.margin
        self.best = _Best.empty(len(self.number), k)
        self.compared = 0

    def _distance(self, score: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, base - 2.0 * score.astype(np.float64)))

    def leaf(self, at: np.ndarray, rids: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        scores = _products(self.vectors[at], vectors)
        self.compared += scores.size
        fits = (labels[None, :] == self.label[at][:, None]) == self.same[at][:, None]
        fits &= (rids[None, :] != self.rid[at][:, None]) & (scores >= self.least[at][:, None]) & (scores <= self.most[at][:, None])
        self.best.take(at, np.where(fits, scores, NONE), ids, rids)
        worst = self.best.scores[at, -1]
        self.far[at] = np.where(worst > NONE, np.minimum(self.far[at], self._distance(worst, self.base[at]) + self.margin), self.far[at])

    def meets(self, at: np.ndarray, away: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which cells an annulus meets, and how near each could be: ``away`` are distances to split points, the ranges are split points x cells."""
        nearest, farthest = np.full((len(at), low.shape[1]), 0.0), np.full((len(at), low.shape[1]), math.inf)
        for i in range(low.shape[0]):
            d = away[:, i:i + 1]
            np.maximum(nearest, np.maximum(d - high[i], low[i] - d), out=nearest)
            np.minimum(farthest, d + high[i], out=farthest)
        slack = 2 * self.margin
        return (nearest <= self.far[at][:, None] + slack) & (farthest >= self.near[at][:, None] - slack), nearest


class _Tree:
    def __init__(self, table: pa.Table, width: int):
        read = lambda value, kind: np.frombuffer(value, kind)
        self.pages = []
        for row in sorted(table.to_pylist(), key=lambda r: r["page"]):
            children = read(row["children"], "<i8")
            rids, ids, labels, vectors = read(row["rids"], "<i8"), read(row["ids"], "<i8"), read(row["labels"], "<i8"), read(row["vectors"], "<i4")
            vectors = vectors.astype(np.int64).reshape(len(rids), width)
            points = np.concatenate([vectors.astype(np.float64), read(row["last"], "<f8")[:, None]], 1) if len(children) else None
            ranges = [read(row[name], "<f8").reshape(len(children), -1) if len(children) else None for name in ("low", "high")]
            self.pages.append((children, rids, ids, labels, vectors, points, *ranges))

    def search(self, searches: _Searches) -> None:
        stack = [(len(self.pages) - 1, np.arange(len(searches.number)), None)]
        while stack:
            number, at, nearest = stack.pop()
            if nearest is not None:  # the annuli may have shrunk since
                at = at[nearest <= searches.far[at] + 2 * searches.margin]
            if not len(at):
                continue
            children, rids, ids, labels, vectors, points, low, high = self.pages[number]
            if not len(children):
                searches.leaf(at, rids, ids, labels, vectors)
                continue
            meets, nearest = searches.meets(at, _distances(searches.points[at], points), low, high)
            order = np.argsort(nearest.mean(0))[::-1]  # the nearest cell is searched first
            for j in order:
                mine = meets[:, j]
                if mine.any():
                    stack.append((int(children[j]), at[mine], nearest[mine, j]))


# --- The shared upper node -----------------------------------------------------------------

@dataclass
class Forest:
    """Trees over all rows of one length of vectors, and the split points that they hang below."""

    pages: DataFrame
    splits: np.ndarray  # whole numbers
    length: float  # the largest squared length of a row
    chunks: list[int]  # trees of each cell
    low: np.ndarray  # split points x cells
    high: np.ndarray


def plant(rows: DataFrame) -> Forest | None:
    """Trees over ``rows`` (rid, vec_id, label, vector), whose vectors are equally long."""
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    about = rows.agg(F.max(squares).alias("length"), F.max(F.size("vector")).alias("width")).first()
    if about.length is None:
        return None
    length, width = about.length * (1 + 1e-12), about.width
    sample = rows.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("vector").toArrow()  # SAMPLE rows
    vectors = _matrix(sample.column("vector"))
    splits = vectors[_far_apart(_lifted(vectors, length), UPPER_SPLITS)]
    upper = _lifted(splits, length)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(_lifted(_matrix(batch.column("vector")), length), upper)
                yield batch.append_column("cell", as_long(away.argmin(1)))

    dealt = written(rows.mapInArrow(deal, "rid long, vec_id long, label long, vector array<int>, cell long"), "negative-cells")
    sizes = {row.cell: row.n for row in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # UPPER_SPLITS rows
    tree_rows = max(LEAF, TREE_BYTES // (8 * max(1, width)))
    chunks = [-(-sizes.get(cell, 0) // tree_rows) for cell in range(len(splits))]
    bases = np.concatenate([[0], np.cumsum(chunks)])
    of_cell = lambda values: F.get(F.array(*(F.lit(int(v)).cast("long") for v in values)), F.col("cell").cast("int"))
    tree = of_cell(bases[:-1]) + F.pmod(F.xxhash64("rid"), of_cell(chunks))

    def grow(table: pa.Table) -> pa.Table:
        vectors = _matrix(table.column("vector"))
        plain = lambda name: table.column(name).to_numpy()
        found = _Builder(plain("rid"), plain("vec_id"), plain("label"), vectors, length).table(table.column("tree")[0].as_py())
        away, blank = _distances(_lifted(vectors, length), upper), [b""] * (len(found) - 1)  # the root has the ranges to the upper split points
        cell = table.column("cell")[0].as_py()
        found = found.append_column("from_low", pa.array([*blank, np.ascontiguousarray(away.min(0), "<f8").tobytes()], pa.binary()))
        found = found.append_column("from_high", pa.array([*blank, np.ascontiguousarray(away.max(0), "<f8").tobytes()], pa.binary()))
        return found.append_column("cell", as_long([cell] * len(found)))

    pages = written(dealt.withColumn("tree", tree).groupBy("tree").applyInArrow(grow, PAGES + ", from_low binary, from_high binary, cell long"), "negative-pages")

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, cell, float(lo), float(hi)) for cell, low, high in zip(*(batch.column(n).to_pylist() for n in ("cell", "from_low", "from_high"))) if low
                   for i, (lo, hi) in enumerate(zip(np.frombuffer(low, "<f8"), np.frombuffer(high, "<f8")))]
            yield pa.record_batch({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(
                (("split", pa.int64()), ("cell", pa.int64()), ("low", pa.float64()), ("high", pa.float64())))})

    low, high = np.full((len(splits), len(splits)), math.inf), np.full((len(splits), len(splits)), -math.inf)
    stored = pages.select("cell", "from_low", "from_high").mapInArrow(ranges, "split long, cell long, low double, high double")
    for row in stored.groupBy("split", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # UPPER_SPLITS squared
        low[row.split, row.cell], high[row.split, row.cell] = row.low - _margin(length), row.high + _margin(length)
    return Forest(pages.drop("from_low", "from_high", "cell"), splits, length, chunks, low, high)


def _routed(forest: Forest, asked: DataFrame, k: int, home: bool) -> DataFrame:
    """``asked`` with a row for each tree to search: those of the anchor's own cell, or of the others that its annulus meets."""
    chunks, bases = np.array(forest.chunks), np.concatenate([[0], np.cumsum(forest.chunks)])
    upper, length, low, high = _lifted(forest.splits, forest.length), forest.length, forest.low, forest.high

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            searches = _Searches(pa.Table.from_batches([batch]), k, length)
            away = _distances(searches.points, upper)
            occupied = np.where(chunks[None, :] > 0, away, math.inf)
            own = occupied.argmin(1)[:, None] == np.arange(len(chunks))[None, :]
            wanted = own if home else searches.meets(np.arange(batch.num_rows), away, low, high)[0] & ~own & (chunks > 0)[None, :]
            query, cell = np.nonzero(wanted)
            times = chunks[cell]
            at, first = np.repeat(query, times), np.repeat(bases[cell] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) if len(times) else np.zeros(0, np.int64)
            yield batch.take(pa.array(at)).append_column("tree", as_long(first + np.arange(len(at))))

    return asked.mapInArrow(run, ASKED + ", tree long")


def _pass(forest: Forest, asked: DataFrame, k: int, home: bool, blocks: int) -> DataFrame:
    routed = _routed(forest, asked, k, home).withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    if blocks == 1:
        stored = forest.pages.withColumn("block", F.lit(0).cast("long"))
    else:  # a page goes to the blocks that search its tree
        routed = written(routed, "negative-routes")
        pairs = routed.select(F.col("tree").alias("of_tree"), F.col("block").alias("block")).distinct()
        stored = forest.pages.join(pairs, F.col("tree") == F.col("of_tree")).drop("of_tree")
    length = forest.length

    def answer(key: tuple, table: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(table) and len(questions):
            searches = _Searches(questions, k, length)
            _Tree(table, searches.vectors.shape[1]).search(searches)
            which, place = np.nonzero(searches.best.scores > NONE)
            best = searches.best
            out = [searches.number[which], best.rids[which, place], best.ids[which, place], best.scores[which, place]]
        return pa.table({name: as_long(out[i] if out else []) for i, name in enumerate(("search", "found", "vec_id", "score"))})

    grouped = stored.groupBy("tree", "block").cogroup(routed.groupBy("tree", "block"))
    return written(grouped.applyInArrow(answer, "search long, found long, vec_id long, score long"), "negative-found")


def search(forest: Forest, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows for each of ``asked`` (search, rid, label, same, least, most, vector): search, rank (from 1), found (rid), vec_id, score."""
    blocks = tasks_for(asked, BLOCK_ROWS)
    near = _pass(forest, asked, k, True, blocks)
    reached = near.groupBy("search").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k).select("search", "worst")
    closer = F.greatest("least", F.coalesce("worst", "least")).alias("least")
    rest = asked.join(reached, "search", "left").select("search", "rid", "label", "same", closer, "most", "vector")
    found = near.unionByName(_pass(forest, written(rest, "negative-rest"), k, False, blocks))
    best = W.partitionBy("search").orderBy(F.desc("score"), "vec_id", "found")  # at most k rows of each tree
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# --- Mining ------------------------------------------------------------------------------

def mine(table: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least_pct: int = 30, most_pct: int = 90,
         key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """For every anchor and each of its best ``positives``, the best ``negatives`` of other labels whose score is within
    ``least_pct`` and ``most_pct`` percent of the positive's.

    ``anchor`` and ``label`` are expressions over the table's columns.
    """
    good = table.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("v"), anchor.alias("anchor"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    cut = F.transform(whole(F.col("v"), scale), lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x)).cast("int"))
    rows = numbered(good.select("vec_id", "label", cut.alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor")), "rid", "negative-rows")
    spark, parts = table.sparkSession, []
    for dims in sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect()):  # lengths of vectors: an embedding table has one
        parts.append(_mined(rows.where(F.size("vector") == dims), positives, negatives, least_pct, most_pct))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole_result = parts[0]
    for part in parts[1:]:
        whole_result = whole_result.unionByName(part)
    return whole_result


def _mined(rows: DataFrame, positives: int, negatives: int, least_pct: int, most_pct: int) -> DataFrame:
    forest = plant(rows.select("rid", "vec_id", "label", "vector"))
    anchors = written(rows.where("anchor").select("rid", "vec_id", "label", F.col("vector").cast("array<long>").alias("vector")), "negative-anchors")
    any_score = [F.lit(int(x)).cast("long") for x in (NONE + 1, -(NONE + 1))]
    asked = anchors.select(F.col("rid").alias("search"), "rid", "label", F.lit(True).alias("same"), any_score[0].alias("least"), any_score[1].alias("most"), "vector")
    # whole results, then numbers that both joins below agree on
    near = search(forest, asked, positives).select(F.col("search").alias("rid"), F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = written(near.withColumn("search", F.col("rid") * positives + F.col("nth") - 1), "negative-pairs")
    floor_of = lambda pct: F.expr(f"cast(floor(cast(positive_score as decimal(38,0)) * {pct} / 100) as long)")
    least = -F.expr(f"cast(floor(cast(-positive_score as decimal(38,0)) * {least_pct} / 100) as long)")  # rounded up
    windows = pairs.withColumns({"least": least, "most": floor_of(most_pct)}).where(F.col("least") <= F.col("most"))
    asked = windows.join(anchors.select("rid", "label", "vector"), "rid").select("search", "rid", "label", F.lit(False).alias("same"), "least", "most", "vector")
    found = search(forest, written(asked, "negative-asked"), negatives)
    named = pairs.join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return found.join(named, "search").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                                              "positive_score", F.col("score").alias("negative_score"))
