"""Vector codes: every vector as one small codebook index per part, learned in whole numbers.

Components become integers, vectors are cut into equal consecutive parts, and each part
position has a codebook of a few entries. A round assigns every part to its nearest entry and
moves every entry to the (floored) mean of its parts.

The distinct parts of all vectors are counted once and written in lexicographic order. A block
of them is a trie: parts that share their first dimensions share a node, and the distances to
all entries accumulated up to that node are computed once. A depth-first traversal carries
these distance vectors down; where a path belongs to one part alone the rest of it is computed
for all such parts together. Leaves take the nearest entry, and their sums are weighted by how
often the part occurs, so a vector that fills a third of the table costs one leaf. What
leaves a task is one row per position, entry and dimension.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped;
rows without an identifier are kept and come last; vectors of unequal length, or of one that
the parts do not divide, count as filled up with zeros; repeated rows are rows of their own;
rows of equal identifier are ordered by their vectors; with fewer rows than entries the codebooks are smaller;
an empty table gives an empty result. Components are cut at +-2^24 after scaling, so that
distances are exact in 64 bits. Further columns of the table are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.llm.common import as_long, tasks_for, written
from skyledger.llm.metric_search import usable, whole

LARGEST = 1 << 24
BLOCK = 65_536  # rows of a trie
TASK_ROWS = 500_000  # distinct parts of a written file, about
FEW_LABELS = 100_000  # sums of so many labels are sent to every task; of more, they are joined
SALTS = 64


@dataclass(frozen=True)
class Codebooks:
    """``entries[position][entry]`` is the list of an entry's components."""

    width: int
    entries: np.ndarray  # positions x entries x width
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and squared distance to the nearest entry for sorted distinct ``parts``; also how many distances to a component were computed."""
    rows, width = parts.shape
    index, distance, computed = np.zeros(rows, np.int64), np.zeros(rows, np.int64), 0
    if not rows or not width:
        return index, distance, computed
    stack = [(0, 0, rows, np.zeros(len(book), np.int64))]
    while stack:
        depth, begin, end, above = stack.pop()
        values = parts[begin:end, depth]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        ends = np.concatenate([first[1:], [end - begin]]) + begin
        children = first + begin
        below = above + (values[first][:, None] - book[:, depth]) ** 2
        computed += below.size
        alone = ends - children == 1
        if depth + 1 == width:
            alone[:] = True
        leaves, sums = children[alone], below[alone]
        for rest in range(depth + 1, width):
            sums += (parts[leaves, rest][:, None] - book[:, rest]) ** 2
            computed += sums.size
        index[leaves] = best = sums.argmin(1)  # the lower index of equal ones
        distance[leaves] = sums[np.arange(len(leaves)), best]
        for i in np.flatnonzero(~alone)[::-1]:
            stack.append((depth + 1, int(children[i]), int(ends[i]), below[i]))
    return index, distance, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The lexicographic order of ``rows``."""
    return np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows, and for every row which of them it is."""
    if not rows.shape[1]:
        return rows[:1], np.zeros(len(rows), np.int64)
    order = _sorted(rows)
    ordered = rows[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)]) if len(rows) else np.zeros(0, bool)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def integers(table: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """Usable rows as vec_id, label, vector of whole numbers, in a written table."""
    rows = table.where(usable(F.col(vector)))
    cut = F.transform(whole(F.col(vector), scale), lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x)).cast("int"))
    named = F.lit(None).cast("long") if label is None else F.col(label)
    return written(rows.select(F.col(key).cast("long").alias("vec_id"), named.alias("label"), cut.alias("vector")), "code-vectors")


def counted_parts(vectors: DataFrame, positions: int, width: int) -> DataFrame:
    """Distinct parts of every position with how often they occur, in lexicographic order, as a written table."""
    filled = F.concat("vector", F.array_repeat(F.lit(0), F.lit(positions * width) - F.size("vector")))
    if width:
        cut = F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), lambda p: F.slice(filled, p * width + 1, F.lit(width)))
    else:
        cut = F.array_repeat(F.array().cast("array<int>"), positions)
    parts = vectors.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count("*").alias("times"))
    spread = parts.repartitionByRange(tasks_for(vectors, max(1, TASK_ROWS // positions)), "position", "part")
    return written(spread.sortWithinPartitions("position", "part"), "code-parts")


def _round(parts: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry moved to the mean of the parts that are nearest to it."""
    entries, width = books.entries, books.width
    positions, size = entries.shape[:2]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times = np.zeros(entries.shape, object), np.zeros((positions, size), np.int64)
        for table in _blocks(batches):
            position = _column(table, "position").to_numpy(zero_copy_only=False)
            rows, weight = _matrix(_column(table, "part"), width), _column(table, "times").to_numpy(zero_copy_only=False)
            for p in np.unique(position):
                mine = np.flatnonzero(position == p)
                mine = mine[_sorted(rows[mine])]
                index, _, _ = nearest(rows[mine], entries[p])
                for e in np.unique(index):
                    chosen = mine[index == e]
                    times[p, e] += weight[chosen].sum()
                    total[p, e] += (rows[chosen] * weight[chosen][:, None]).sum(0)
        found = [(p, e, d, int(total[p, e, d]), int(times[p, e])) for p in range(positions) for e in range(size) if times[p, e] for d in range(width)]
        yield pa.record_batch({name: as_long([row[i] for row in found]) for i, name in enumerate(("position", "entry", "dimension", "total", "times"))})

    moved = parts.mapInArrow(sums, "position long, entry long, dimension long, total long, times long").groupBy("position", "entry", "dimension").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("times").alias("times")).collect()  # positions x entries x dimensions at most
    out = entries.copy()
    for row in moved:
        out[row.position, row.entry, row.dimension] = int(row.total) // row.times
    return Codebooks(width, out, books.scale)


def learn(vectors: DataFrame, positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks of ``vectors`` (vec_id, vector of integers). They start as the parts of the smallest identifiers."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // positions)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    start = np.zeros((positions, len(first), width), np.int64)
    for e, row in enumerate(first):
        filled = np.zeros(positions * width, np.int64)
        filled[:len(row.vector)] = row.vector
        start[:, e] = filled.reshape(positions, width)
    books = Codebooks(width, start, scale)
    if not len(first) or not width:
        return books
    parts = counted_parts(vectors, positions, width)
    for _ in range(rounds):
        books = _round(parts, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error (squared distance) of every row."""
    positions, size, width = books.entries.shape
    digits = np.array([f"{e:02x}" for e in range(size)], object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            rows = _matrix(_column(table, "vector"), positions * width)
            code, error = np.full(len(rows), "", object), np.zeros(len(rows), np.int64)
            for p in range(positions):
                parts, which = _distinct(rows[:, p * width:(p + 1) * width])
                index, distance, _ = nearest(parts, books.entries[p])
                code += digits[index[which]]
                error += distance[which]
            out = table.drop_columns(["vector"]).append_column("code", pa.array(code, pa.string())).append_column("error", as_long(error))
            yield from out.to_batches()

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over rows of equal label, rows without one together."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    sums = written(sums, "code-labels")
    same: Column = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.count() <= FEW_LABELS:
        return codes.join(F.broadcast(sums), same, "left").drop("of_label")
    salted = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("salt") == F.col("of_salt")), "left").drop("of_label", "salt", "of_salt")


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
             positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """Codes of every usable row (vec_id, label, code, error, label_error), and the codebooks."""
    vectors = integers(table, key, vector, label, scale)
    books = learn(vectors, positions, entries, rounds, scale)
    return with_label_errors(written(encode(vectors, books), "codes")), books


def restored(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with the vector that a code stands for, as doubles."""
    flat = F.array([F.array([F.array([F.lit(x / books.scale) for x in entry]) for entry in book]) for book in books.entries.tolist()])
    index = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)),
                        lambda p: F.struct(p.alias("p"), F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("e")))
    return codes.withColumn("vector", F.flatten(F.transform(index, lambda x: F.get(F.get(flat, x["p"]), x["e"]))))
