"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

The n-grams have one global order: those that more than ``frequent`` documents have come
last, and within either part the hash decides. A document's prefix in that order is as
long as it takes for similar documents to share some of it. The order is cut into
fragments. Every fragment counts, for itself, which documents share how many prefix
n-grams in it; the partial overlaps are added up per pair, and a pair is left when what
its prefixes share and what may follow cannot reach the threshold. In the frequent
fragments nobody is paired with everybody: documents of one n-gram are only chained, which
puts them into one group.

Candidates form groups, and within each group every pair is verified exactly, again by
fragments: overlaps of a block of documents with another are sums of products of 0/1
matrices over the fragments' n-grams. Large groups are cut into blocks, a task for each
pair of blocks. Links, and how many a document has, come from there.

Documents of equal sets are one vertex (copies are not expanded into pairs). Hashes of
n-grams are 64 bits for sizes and 48 bits in overlaps; sets are identified by 64 bits and
their size.

Defined cases: null and empty texts, and texts without words, have no n-grams and link
with nothing; a text of fewer words than ``width`` is one n-gram; repeated rows are equal
sets; rows without a key take part and get the least key among the others of their
component, or null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from skyledger.llm.common import as_long, fresh, hash_cache, numbered, shingle_set, slices, text_of, word_hashes, written
from skyledger.llm.components import components

FREQUENT = 32  # documents; more common n-grams come last in the order
MOST_FREQUENT = 4_000_000  # n-grams that may be sent to every task (32 MB); beyond, only more common ones count as frequent
FRAGMENT_BYTES = 16 << 20  # of text, for each fragment of the order
PREFIX_FRAGMENTS = 2  # fragments that are joined for the prefixes, which are a quarter of all n-grams
MOST_SENT = 1_000_000  # document numbers that may be sent to every task (8 MB); beyond, they are joined
BLOCK_NGRAMS = 4_000_000  # n-grams that a task holds of each side of a large group
TASK_NGRAMS = 1_000_000  # n-grams of small groups that share a task
_BITS = 48
_ROWS = 512
_FEW = 16  # sets that are compared one by one
_SUB_ROWS, _SUB_NGRAMS, _SUB_COLUMNS = 256, 1_000_000, 4096
_PAIR = np.dtype([("x", "<i8"), ("y", "<i8"), ("shared", "<i4"), ("needed", "<i4")])


def packed(ngrams: np.ndarray) -> bytes:
    """48-bit values as six bytes each."""
    return np.ascontiguousarray(ngrams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.int64)


def document_sets(docs: DataFrame, key: str, text: str, width: int, rid: str | None = None) -> DataFrame:
    """Row number, key, size, identity and packed n-grams of every document, as a written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = hash_cache()
        for batch in slices(batches, _ROWS):
            sizes, names, sets = [], [], []
            for passage in batch.column(2):
                found = shingle_set(word_hashes(passage.as_py().encode("utf-8", "surrogatepass").lower(), cache), width)
                sizes.append(len(found))
                names.append(int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found))).view(np.int64)) if len(found) else None)
                sets.append(packed(found >> np.uint64(64 - _BITS)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), as_long(sizes), as_long(names), pa.array(sets, pa.binary())], ["rid", "key", "n", "id", "ngrams"])

    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    rows = docs.select(number.alias("rid"), F.col(key).alias("key"), text_of(text).alias("x_text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n", T.LongType()), T.StructField("id", T.LongType()), T.StructField("ngrams", T.BinaryType())])
    return written(rows.mapInArrow(run, schema), "document-sets")


def order_fragments(docs: DataFrame, text: str) -> int:
    """A power of two, by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(text_of(text)).cast("long"))).first()[0] or 0
    return 1 << max(4, (size // FRAGMENT_BYTES).bit_length())


def _cut(sorted_values: np.ndarray, fragments: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted 48-bit values by fragment."""
    shift = _BITS - fragments.bit_length() + 1
    bounds = np.searchsorted(sorted_values, np.arange(fragments + 1, dtype=np.int64) << shift)
    for fragment in range(fragments):
        if bounds[fragment] < bounds[fragment + 1]:
            yield fragment, sorted_values[bounds[fragment]:bounds[fragment + 1]]


def frequent_ngrams(rows: DataFrame, ngrams_of, fragments: int, frequent: int = FREQUENT, most: int = MOST_FREQUENT, *, twice_bits: int = 0) -> tuple[np.ndarray, int] | tuple[np.ndarray, int, np.ndarray]:
    """Sorted prefixes (``24 + log2(fragments)`` bits) of the n-grams that occur more than ``frequent`` times, and their width.

    With ``twice_bits``, also a field of that many bits (a power of two) that has a one at the first bits of every
    n-gram that occurs more than once.

    ``rows`` has one column, of which ``ngrams_of`` makes the 48-bit n-grams of a batch of
    documents. N-grams that share these bits are counted together; that changes the order,
    never the result.
    """
    bits = min(_BITS, fragments.bit_length() - 1 + 24)
    each = min(1 << 24, (1 << twice_bits) // fragments) if twice_bits else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 * _ROWS):
            values = np.sort(ngrams_of(batch.column(0)))
            found = [(f, np.ascontiguousarray(((part >> (_BITS - bits)) & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes())
                     for f, part in _cut(values, fragments)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], ["fragment", "part"])

    def count(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("part").to_pylist()), np.uint8).reshape(-1, 3)
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, :3] = raw
        values, counts = np.unique(wide.view("<u4").ravel(), return_counts=True)
        common = counts > frequent
        fragment = table.column("fragment")[0].as_py()
        value, documents, twice = as_long(values[common].astype(np.int64) | (fragment << 24)), as_long(counts[common]), pa.nulls(int(common.sum()), pa.binary())
        if each:
            flags = np.zeros(each, bool)
            flags[values[counts > 1] >> (24 - each.bit_length() + 1)] = True
            value, documents = (pa.concat_arrays([x, as_long([y])]) for x, y in ((value, fragment), (documents, None)))
            twice = pa.concat_arrays([twice, pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())])
        return pa.table({"value": value, "documents": documents, "twice": twice})

    dealt = rows.mapInArrow(deal, "fragment int, part binary")
    found = written(dealt.groupBy("fragment").applyInArrow(count, "value long, documents long, twice binary"), "frequent-ngrams")
    least = frequent
    while found.where(F.col("documents") > least).count() > most:
        least *= 2
    chosen = found.where(F.col("documents") > least).select("value").toArrow()["value"].to_numpy()
    if not each:
        return np.sort(chosen), bits
    field = np.zeros((fragments, each // 8), np.uint8)
    for row in found.where(F.col("twice").isNotNull()).select("value", "twice").toLocalIterator():
        field[row[0]] = np.frombuffer(row[1], np.uint8)
    return np.sort(chosen), bits, field.ravel()


def is_frequent(ngrams: np.ndarray, common: np.ndarray, bits: int) -> np.ndarray:
    if not len(common):
        return np.zeros(len(ngrams), bool)
    short = ngrams >> (_BITS - bits)
    return common[np.minimum(np.searchsorted(common, short), len(common) - 1)] == short


def pairs_of(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within runs of equal n-grams; the runs are short."""
    left, right = [], []
    for size in np.unique(counts[counts > 1]).tolist():
        a, b = np.triu_indices(size, 1)
        begin = starts[counts == size][:, None]
        left.append((begin + a).ravel())
        right.append((begin + b).ravel())
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _summed(pairs: np.ndarray) -> np.ndarray:
    """One entry per pair, with the sum of what it shares and the least that it needs."""
    if not len(pairs):
        return pairs
    order = np.lexsort((pairs["y"], pairs["x"]))
    pairs = pairs[order]
    first = np.concatenate([[True], (pairs["x"][1:] != pairs["x"][:-1]) | (pairs["y"][1:] != pairs["y"][:-1])])
    out = pairs[first].copy()
    out["shared"] = np.add.reduceat(pairs["shared"], np.flatnonzero(first))
    out["needed"] = np.minimum.reduceat(pairs["needed"], np.flatnonzero(first))
    return out


def candidates(sets: DataFrame, fragments: int, common: np.ndarray, common_bits: int, share: tuple[int, int]) -> DataFrame:
    """Pairs (x, y) of set identities that may be similar, or belong to one frequent n-gram."""
    top, bottom = share
    shipped = sets.sparkSession.sparkContext.broadcast(common)
    parts = max(2, fragments // PREFIX_FRAGMENTS)
    arrays = ["ids", "sizes", "common", "ends", "counts", "ngrams"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The prefixes of a batch of documents, cut into the fragments of the order."""
        known = shipped.value
        for batch in slices(batches, 8 * _ROWS):
            names, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            once = np.sort(np.unique(names, return_index=True)[1])  # without copies
            names, sizes = names[once], sizes[once]
            document, value, ends, later = [], [], [], []
            for place, i in enumerate(once.tolist()):
                ngrams, size = unpacked(batch.column(2)[i].as_py()), int(sizes[place])
                length = size - -(-top * size // bottom) + 1
                if len(known):
                    often = is_frequent(ngrams, known, common_bits)
                    rare = ngrams[~often][:length]
                    chosen = np.concatenate([rare, ngrams[often][:length - len(rare)] | (1 << _BITS)]) if len(rare) < length else rare
                else:
                    chosen = ngrams[:length]
                document.append(np.full(len(chosen), place))
                value.append(chosen)
                ends.append(int(chosen[-1]))
                later.append(int((chosen >> _BITS).sum()))
            if not document:
                continue
            document, value = np.concatenate(document), np.concatenate(value)
            ends, later = np.array(ends, np.int64), np.array(later, np.int64)
            part = value >> (_BITS - parts.bit_length() + 1)
            order = np.lexsort((document, part))
            document, value, part = document[order], value[order], part[order]
            rows = []
            kinds, bounds = np.unique(part, return_index=True)
            for kind, begin, end in zip(kinds.tolist(), bounds.tolist(), [*bounds[1:].tolist(), len(part)]):
                here, own = np.unique(document[begin:end], return_counts=True)
                rows.append((kind, names[here].tobytes(), sizes[here].tobytes(), later[here].tobytes(), ends[here].tobytes(), own.astype("<i4").tobytes(),
                             packed(value[begin:end] & ((1 << _BITS) - 1))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 7))], ["part", *arrays])

    def overlaps(table: pa.Table) -> pa.Table:
        """Partial overlaps of one fragment, by bucket of pairs."""
        part = table.column("part")[0].as_py()
        ids, sizes, later, ends = (np.frombuffer(b"".join(table.column(name).to_pylist()), "<i8") for name in arrays[:4])
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4")
        value = unpacked(b"".join(table.column("ngrams").to_pylist()))
        names, vertex = np.unique(ids, return_inverse=True)  # a set comes from several batches
        first = np.zeros(len(names), np.int64)
        first[vertex] = np.arange(len(ids))
        sizes, later, ends = sizes[first], later[first], ends[first]
        owner = np.repeat(vertex, counts)
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
        value, owner = value[new], owner[new]
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        lengths = np.diff(np.append(starts, len(value)))
        if part >= parts:  # frequent n-grams: chain those of one n-gram by size, where the sizes allow a link
            run = np.repeat(np.arange(len(starts)), lengths)
            order = np.lexsort((owner, sizes[owner], run))
            run, owner = run[order], owner[order]
            x, y = owner[:-1], owner[1:]
            near = (run[1:] == run[:-1]) & (bottom * sizes[x] >= top * sizes[y])
            x, y, shared, needed = x[near], y[near], 0, -1
        else:
            a, b = pairs_of(lengths, starts)
            x, y = owner[a], owner[b]
            near = bottom * np.minimum(sizes[x], sizes[y]) >= top * np.maximum(sizes[x], sizes[y])
            x, y = x[near], y[near]
            rest = np.where(ends[x] <= ends[y], sizes[x], sizes[y])
            rest = -(-top * rest // bottom) - 1
            needed = -(-top * (sizes[x] + sizes[y]) // (top + bottom)) - rest - np.minimum(later[x], later[y])
            shared = 1
        pairs = np.zeros(len(x), _PAIR)
        low, high = np.minimum(names[x], names[y]), np.maximum(names[x], names[y])
        pairs["x"], pairs["y"], pairs["shared"], pairs["needed"] = low, high, shared, needed
        pairs = _summed(pairs)
        bucket = ((pairs["x"] ^ (pairs["y"] * 31)) >> 7) % parts
        order = np.argsort(bucket, kind="stable")
        kinds, at = np.unique(bucket[order], return_index=True)
        blobs = [chunk.tobytes() for chunk in np.split(pairs[order], at[1:])] if len(kinds) else []
        return pa.table({"bucket": pa.array(kinds.tolist(), pa.int32()), "pairs": pa.array(blobs, pa.binary())})

    def add_up(table: pa.Table) -> pa.Table:
        pairs = _summed(np.frombuffer(b"".join(table.column("pairs").to_pylist()), _PAIR))
        pairs = pairs[pairs["shared"] >= pairs["needed"]]
        return pa.table({"x": as_long(pairs["x"]), "y": as_long(pairs["y"])})

    schema = "part int, " + ", ".join(f"{name} binary" for name in arrays)
    dealt = sets.where(F.col("ngrams").isNotNull()).select("id", "n", "ngrams").mapInArrow(prefixes, schema)
    partial_overlaps = dealt.groupBy("part").applyInArrow(overlaps, "bucket int, pairs binary")
    return written(partial_overlaps.groupBy("bucket").applyInArrow(add_up, "x long, y long"), "join-candidates")


def _sub_blocks(sizes: np.ndarray) -> list[tuple[int, int]]:
    out, begin, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (i - begin >= _SUB_ROWS or held + size > _SUB_NGRAMS):
            out.append((begin, i))
            begin, held = i, 0
        held += size
    return [*out, (begin, len(sizes))]


def overlap_matrix(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, added up over fragments of the common n-grams."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.int64)

    def cells(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(side)), [len(s) for s in side])
        value = np.concatenate(side)
        place = np.minimum(np.searchsorted(common, value), max(0, len(common) - 1))
        known = common[place] == value if len(common) else np.zeros(len(value), bool)
        return row[known], place[known]

    (row_a, place_a), (row_b, place_b) = cells(left), cells(right)
    for begin in range(0, len(common), _SUB_COLUMNS):
        sides = []
        for rows, row, place in ((len(left), row_a, place_a), (len(right), row_b, place_b)):
            inside = (place >= begin) & (place < begin + _SUB_COLUMNS)
            dense = np.zeros((rows, min(_SUB_COLUMNS, len(common) - begin)), np.float32)
            dense[row[inside], place[inside] - begin] = 1
            sides.append(dense)
        total += (sides[0] @ sides[1].T).astype(np.int64)
    return total


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _similar_pairs(sizes: np.ndarray, block: np.ndarray, sets: list[np.ndarray], one_block: bool, share: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Positions of all similar pairs; with two blocks, only of pairs across them."""
    top, bottom = share
    if one_block and len(sets) <= _FEW:
        members = [set(s.tolist()) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                if bottom * min(sizes[i], sizes[j]) >= top * max(sizes[i], sizes[j]) and (top + bottom) * len(members[i] & members[j]) >= top * (sizes[i] + sizes[j]):
                    yield i, j
        return
    order = np.argsort(sizes, kind="stable")
    for begin_a, end_a in (blocks := _sub_blocks(sizes[order])):
        for begin_b, end_b in blocks:
            if begin_b < begin_a or bottom * sizes[order[end_a - 1]] < top * sizes[order[begin_b]]:
                continue
            a, b = order[begin_a:end_a], order[begin_b:end_b]
            shared = overlap_matrix([sets[i] for i in a], [sets[i] for i in b])
            similar = (top + bottom) * shared >= top * (sizes[a][:, None] + sizes[b][None, :])
            if begin_a == begin_b:
                similar &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            if not one_block:
                similar &= block[a][:, None] != block[b][None, :]
            for i, j in zip(*(x.tolist() for x in np.nonzero(similar))):
                yield int(a[i]), int(b[j])


def linked(names: np.ndarray, sizes: np.ndarray, block: np.ndarray, sets: list[np.ndarray], one_block: bool, share: tuple[int, int]) -> tuple[list[int], list[int]]:
    """For every document its least linked name in this task, and its number of links."""
    names = names.tolist()
    parent, degree = list(range(len(names))), [0] * len(names)
    for p, q in _similar_pairs(sizes, block, sets, one_block, share):
        degree[p] += 1
        degree[q] += 1
        p, q = _find(parent, p), _find(parent, q)
        if p != q:
            if names[p] < names[q]:
                p, q = q, p
            parent[p] = q
    return [names[_find(parent, i)] for i in range(len(names))], degree


def _verified(table: pa.Table, share: tuple[int, int]) -> pa.Table:
    """All groups of one task; a group in several blocks has its tasks to itself."""
    one = table.column("low")[0].as_py() == table.column("high")[0].as_py()
    ids, groups = table.column("id").to_numpy(), table.column("group").to_numpy()
    order = np.lexsort((ids, groups))
    new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (groups[order][1:] != groups[order][:-1])])
    table = table.take(pa.array(order[new]))
    ids, groups = table.column("id").to_numpy(), table.column("group").to_numpy()
    sizes, block, packed_sets = table.column("n").to_numpy(), table.column("block").to_numpy(), table.column("ngrams").to_pylist()
    bounds = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]])).tolist()
    roots, degrees = [], []
    for begin, end in zip(bounds[:-1], bounds[1:]):
        root, degree = linked(ids[begin:end], sizes[begin:end], block[begin:end], [unpacked(s) for s in packed_sets[begin:end]], one, share)
        roots += root
        degrees += degree
    return pa.table({"id": as_long(ids), "root": as_long(roots), "links": as_long(degrees)})


def links(sets: DataFrame, pairs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(id, root, links): verified links of every candidate, as a forest, and their number."""
    groups = components(pairs, "x", "y", "candidate-groups").withColumnsRenamed({"vertex": "id", "component": "group"})
    rows = sets.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("rid").alias("rid"), F.max("n").alias("n"))
    members = written(rows.join(groups, "id"), "group-members")  # one row per set
    blocks = members.groupBy("group").agg(F.ceil(F.sum("n") / F.lit(BLOCK_NGRAMS)).cast("int").alias("blocks"))
    placed = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows, ngrams = members.agg(F.count(F.lit(1)), F.sum("n")).first()
    tasks = max(1, -(-(ngrams or 0) // TASK_NGRAMS))  # small groups share a task
    task = F.when(F.col("blocks") > 1, F.col("group")).otherwise(F.pmod(F.xxhash64("group"), F.lit(tasks)))
    placed = placed.select("rid", "group", "blocks", "block", task.alias("task"), (F.col("blocks") > 1).alias("alone"))
    few = rows <= MOST_SENT
    held = sets.select("rid", "id", "n", "ngrams").join(F.broadcast(placed) if few else placed, "rid")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = held.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def verify(table: pa.Table) -> pa.Table:
        return _verified(table, share)

    return written(dealt.groupBy("alone", "task", "low", "high").applyInArrow(verify, "id long, root long, links long"), "join-links")


def _joined(docs: DataFrame, key: str, text: str, width: int, share: tuple[int, int], rid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' sets, and for every set its component and its number of links."""
    fragments = order_fragments(docs, text)
    sets = document_sets(docs, key, text, width, rid)
    common, bits = frequent_ngrams(sets.where(F.col("ngrams").isNotNull()).select("ngrams"), lambda column: unpacked(b"".join(column.to_pylist())), fragments)
    found = links(sets, candidates(sets, fragments, common, bits, share), share)
    groups = components(found, "id", "root", "join-components").withColumnsRenamed({"vertex": "id"})
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = sets.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("key").alias("least"))
    classes = classes.join(groups, "id", "left").join(degree, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return sets.drop("ngrams"), written(classes, "join-classes")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, share: tuple[int, int] = (3, 4)) -> DataFrame:
    """A row per row of ``docs``: key, ``n_shingles``, ``component_id`` and ``n_links`` (other sets it is similar to).

    Two documents link when their Jaccard similarity is at least ``share`` (a fraction).
    """
    sets, classes = _joined(docs, key, text, width, share)
    leasts = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = classes.join(leasts, "component").select("id", "component_id", "links")
    return sets.join(answers, "id", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, share: tuple[int, int] = (3, 4)) -> DataFrame:
    """``docs`` with one row of each component, that of the least key; rows without n-grams stay.

    Only row numbers are joined to the texts.
    """
    rid, = fresh(docs.columns, "x_rid")
    rows = numbered(docs, rid, "numbered-documents")
    sets, classes = _joined(rows, key, text, width, share, rid)
    members = sets.join(classes.select("id", "component"), "id")
    stays = members.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("missing"), "key", "rid")).alias("first")).select("component", F.col("first.rid").alias("stays"))
    gone = written(members.join(stays, "component").where(F.col("rid") != F.col("stays")).select(F.col("rid").alias(rid)), "join-removed")
    few = gone.count() <= MOST_SENT
    return rows.join(F.broadcast(gone) if few else gone, rid, "left_anti").select(*docs.columns)
