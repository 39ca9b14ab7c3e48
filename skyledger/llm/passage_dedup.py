"""Repeated passages inside documents, by paragraph MinHash banding.

Paragraphs are the lines of at least ``WIDTH`` words, as they stand, and, for passages that
were copied into other lines, runs of ``PARAGRAPH`` words. Where such a run starts is chosen by content: of
every ``PARAGRAPH`` places in a row, the one whose first words have the least hash. So a
passage that was copied into the middle of another text has the same paragraphs there, and
one of at least 2 * ``PARAGRAPH`` - 1 words (47) has at least one. The n-grams of a
paragraph get a MinHash signature; its bands are tuned so that similar paragraphs collide
with at least the target probability, colliding paragraphs are joined, their exact Jaccard
similarity is verified, and components of similar paragraphs are the clusters. The first
paragraph of a cluster, by document key and place, stays; the others are removals.

Runs leave at most ``PARAGRAPH`` - 1 words of an equal passage before the first and after the
last of them. So a paragraph is extended word by word as far as another one of its cluster has
the same words there, and the first to have them keeps them.

N-grams that occur more than 32 times would put every paragraph that touches a common passage
into one bucket. So signatures look at rare n-grams first, and paragraphs that are at
least three quarters common are compared by their common part and the number of their
rare n-grams: those of equal common part are one vertex, whatever else they hold. Both
parts are exact for pairs that collide; no bucket is cut.

A bucket joins only paragraphs whose sizes and sketches (64 bits of their n-grams) let them be
similar; bands whose n-gram occurs once make no entry. What takes part is told to the tasks by
bit fields of bounded size, which may let more through and change no result.

Defined cases: null and empty texts, and texts of fewer than ``WIDTH`` words, have no
passages, and shorter lines only as part of a run; a passage that occurs twice in one row, apart from each other, is repeated, but a
run of one and the same word in one row only is not; repeated rows are repeated passages; a
null key comes before others when the first paragraph is chosen, ties go to the row read
first; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, functions as F, types as T

from skyledger.llm.common import as_long, fresh, mixed, numbered, slices, tasks_for, text_of, written
from skyledger.llm.components import components
from skyledger.llm.ngram_join import frequent_ngrams, is_frequent, links, order_fragments, packed, pairs_of, unpacked
from skyledger.llm.word_arrays import Words

PARAGRAPH = 24  # words
WIDTH = 5  # words of an n-gram
MOST_BITS = 29  # of a filter that is sent to every task (64 MB); fuller ones let more through, results never depend on them
TASK_ROWS = 100_000  # paragraphs of a task, where those of a row are needed together
ENTRIES = np.dtype([("value", "<u4"), ("document", "<u4"), ("vertex", "<i8"), ("n", "<u4"), ("own", "<u4"), ("sketch", "<u8")])
MOST_PAIRED = 64  # vertices of a bucket whose pairs are listed; larger buckets are searched
_ROWS = 512
_SLICES = 16  # tasks that make a filter
_FILTERS = range(3)
_VERTEX, _HOLDER, _DOCUMENT = _FILTERS
_TOP = np.uint64(1 << 63)
_NAME = np.uint32(0xFFFFFFFE)  # the document of an entry; the last bit says that its bucket holds two places of it that are apart


def tuned(similarity: float, recall: float, most_bands: int = 16) -> tuple[int, int]:
    """The least number of bands, then the most rows of a band, that let ``similarity`` collide with probability ``recall``."""
    for bands in range(1, most_bands + 1):
        rows = [r for r in range(1, 9) if 1 - (1 - similarity**r) ** bands >= recall]
        if rows:
            return bands, max(rows)
    raise ValueError("no banding reaches the recall")


def _slid(values: np.ndarray, width: int, best, fill: int) -> np.ndarray:
    """``best`` over each value and the ``width`` - 1 after it."""
    out, have = values, 1

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.full(min(by, len(x)), fill, x.dtype)])

    while have < width:
        step = min(have, width - have)
        out = best(out, ahead(out, step))
        have += step
    return out


def short_names(rids: np.ndarray) -> np.ndarray:
    """31 bits, above a free one, that tell documents apart; equal ones only make two documents count as one in a bucket."""
    return (mixed(rids.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32) & _NAME


def _grams(flat: np.ndarray, count: int) -> np.ndarray:
    """Hashes of the n-grams that start at the first ``count`` words."""
    grams = np.full(count, WIDTH, np.uint64)
    for i in range(WIDTH):
        grams = mixed(grams ^ flat[i:count + i]) + np.uint64(0x165667B19E3779F9)
    return grams


def _bit(field: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The bits of a field at the first bits of some 64-bit values."""
    place = names >> np.uint64(64 - (8 * len(field)).bit_length() + 1)
    return (field[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def short_table(common: np.ndarray) -> np.ndarray:
    """Which last bits the common n-grams have: most others are told by them alone."""
    table = np.zeros(1 << min(25, max(16, 4 + len(common).bit_length())), bool)
    table[common & (len(table) - 1)] = True
    return table


def _is_common(ngrams: np.ndarray, common: np.ndarray, bits: int, often: np.ndarray | None) -> np.ndarray:
    if often is None:
        return is_frequent(ngrams, common, bits)
    out = often[(ngrams >> (48 - bits)) & (len(often) - 1)]
    maybe = np.flatnonzero(out)
    out[maybe] = is_frequent(ngrams[maybe], common, bits)
    return out


_BASE = 0x9E3779B97F4A7C15


class Paragraphs:
    """The paragraphs of a batch of texts: starts, sizes, owners, n-grams, and what identifies them.

    ``breaks`` are the words, counted over all texts, that begin a line; without it, there are only runs chosen by content.
    """

    def __init__(self, words: list[np.ndarray], common: np.ndarray, bits: int, breaks: np.ndarray | None = None, often: np.ndarray | None = None, twice: np.ndarray | None = None):
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate([*words, np.zeros(PARAGRAPH, np.uint64)])
        self.begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(int(sizes.sum())) - self.begins[owner]
        n = len(place)
        first = mixed(mixed(mixed(flat[:n]) + flat[1:n + 1]) + flat[2:n + 2])
        order = ((first >> np.uint64(6) << np.uint64(5)) | (place % PARAGRAPH).astype(np.uint64)).astype(np.int64)  # equal runs: one in PARAGRAPH
        starts = (sizes - PARAGRAPH + 1)[owner]  # places where a paragraph can start
        largest = np.iinfo(np.int64).max
        order = np.where(place < starts, order, largest)
        least = np.where((starts > 0) & (place <= np.maximum(0, starts - PARAGRAPH)), _slid(order, PARAGRAPH, np.minimum, largest), -1)
        chosen = (place < starts) & (_slid(least[::-1], PARAGRAPH, np.maximum, -1)[::-1] == order)
        at = np.flatnonzero(chosen)
        length = np.full(len(at), PARAGRAPH, np.int64)
        if breaks is not None and n:
            begin = np.union1d(breaks, self.begins[sizes > 0])
            extent = np.diff(np.append(begin, n))
            long = extent >= WIDTH
            at, length = np.concatenate([at, begin[long]]), np.concatenate([length, extent[long]])
            order = np.lexsort((length, at))
            at, length = at[order], length[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (length[1:] != length[:-1])
            at, length = at[new], length[new]
        self.at, self.length = at, length
        self.owner, self.place = owner[self.at], place[self.at]
        self.flat = flat
        self.flat_grams = _grams(flat, n)
        self.counts = self.length - WIDTH + 1
        self._bounds = np.stack([self.at, self.at + self.counts], 1).ravel()
        # a polynomial over the n-grams between two places, whatever comes before
        steps = np.full(n + 1, _BASE, np.uint64)
        steps[:1] = 1
        back = np.full(n + 1, pow(_BASE, -1, 2**64), np.uint64)
        back[:1] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.flat_grams) * np.cumprod(steps)[:n], dtype=np.uint64)])
        content = (sums[self.at + self.counts] - sums[self.at]) * np.cumprod(back)[self.at]
        self.content = mixed(mixed(content) ^ self.length.astype(np.uint64)).view(np.int64)
        self.flat_common = _is_common((self.flat_grams >> np.uint64(16)).astype(np.int64), common, bits, often)
        self.flat_twice = np.ones(n, bool) if twice is None else _bit(twice, self.flat_grams)
        rare = self.counts - self._over(np.add, self.flat_common.astype(np.int64))
        # the class of a mostly common paragraph: its common n-grams, whatever their order, and how many others it has
        mark = self._over(np.add, np.where(self.flat_common, mixed(self.flat_grams + np.uint64(97)), np.uint64(0)))
        self.rare = rare
        different = np.concatenate([[0], np.cumsum(flat[1:n] != flat[:n - 1])]) if n else np.empty(0, np.int64)
        self.uniform = different[self.at + self.length - 1] == different[self.at]
        self.mostly_common = 4 * rare <= self.counts
        self.kind = np.where(rare == 0, self.content, mixed(mark + rare.astype(np.uint64)).view(np.int64))

    def _over(self, ufunc, values: np.ndarray) -> np.ndarray:
        """``ufunc`` over the n-grams of every paragraph."""
        if not len(self.at):
            return np.empty(0, values.dtype)
        return ufunc.reduceat(np.append(values, values[:1]), self._bounds)[::2]

    def distinct(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct n-grams, and of distinct common ones, of some paragraphs."""
        n, often = np.empty(len(used), np.int64), np.empty(len(used), np.int64)
        order = np.argsort(self.counts[used], kind="stable")
        sizes, at = np.unique(self.counts[used[order]], return_index=True)
        ngrams = (self.flat_grams >> np.uint64(16)).astype(np.int64)
        only_common = np.where(self.flat_common, ngrams, -1)
        for count, here in zip(sizes.tolist(), np.split(order, at[1:])):
            places = self.at[used[here]][:, None] + np.arange(count)
            n[here] = _distinct(ngrams[places])
            common = self.flat_common[places].any(1)
            often[here] = 0
            if common.any():
                found = only_common[places[common]]
                often[here[common]] = _distinct(found) - (found < 0).any(1)
        return n, often

    def gram_set(self, i: int, only_common: bool) -> np.ndarray:
        """The distinct n-grams of a paragraph, 48 bits each."""
        here = slice(self.at[i], self.at[i] + self.counts[i])
        grams = self.flat_grams[here][self.flat_common[here]] if only_common else self.flat_grams[here]
        return np.unique((grams >> np.uint64(16)).astype(np.int64))

    def _repeated(self, values: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Whether a document has this value in paragraphs that do not overlap; runs of a single word aside."""
        out, of = np.zeros(int(used.sum()), bool), np.flatnonzero(used & ~self.uniform)
        names = mixed(values[of] ^ mixed(self.owner[of].astype(np.uint64)))
        order = np.argsort(names, kind="stable")  # paragraphs are in order of place
        starts = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]])) if len(of) else np.empty(0, np.int64)
        sizes, place = np.diff(np.append(starts, len(of))), self.place[of][order]
        wide = place[starts + sizes - 1] >= np.minimum.reduceat(place + self.length[of][order], starts) if len(of) else np.empty(0, bool)
        out[(np.cumsum(used) - 1)[of[order]]] = np.repeat(wide, sizes)
        return out

    def entries(self, bands: int, rows: int, rids: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
        """Fragment and (next 32 bits of the band value, document, vertex, number of its n-grams, of those it is compared by, and their bits) of every paragraph and band.

        Bands of an n-gram that occurs once are left out: nothing shares their bucket but paragraphs that overlap there.
        """
        parts, found, shift = [], [], np.uint64(64 - fragments.bit_length() + 1)
        documents, n, often = short_names(rids)[self.owner], np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        bit = np.uint64(1) << (self.flat_grams & np.uint64(63))
        all_bits, common_bits = self._over(np.bitwise_or, bit), self._over(np.bitwise_or, np.where(self.flat_common, bit, np.uint64(0)))
        bucket_of = []
        for band in range(bands):
            rare_value = np.full(len(self.at), band + 1, np.uint64)
            common_value, twice = rare_value.copy(), np.ones(len(self.at), bool)
            for row in range(rows):
                key = mixed(self.flat_grams + np.uint64((band * rows + row + 1) * _BASE % 2**64)) >> np.uint64(2) << np.uint64(1) | self.flat_twice  # the last bit tells about the least one
                least = self._over(np.minimum, np.where(self.flat_common, key | _TOP, key))
                twice &= least & np.uint64(1) > 0
                rare_value = mixed(rare_value ^ least)
                common_value = mixed(common_value ^ self._over(np.minimum, np.where(self.flat_common, key, _TOP)) ^ np.uint64(0x5555))
            bucket_of += [(rare_value, self.content, n, all_bits, (self.rare > 0) & twice), (common_value, self.kind, often, common_bits, self.mostly_common)]
        taken = np.flatnonzero(np.any([used for *_, used in bucket_of], axis=0))
        n[taken], often[taken] = self.distinct(taken)
        for values, vertex, own, sketch, used in bucket_of:
            part = np.zeros(int(used.sum()), ENTRIES)
            part["value"], part["document"] = (values[used] >> (shift - np.uint64(32))) & np.uint64(0xFFFFFFFF), documents[used] | self._repeated(values, used)
            part["vertex"], part["n"], part["own"], part["sketch"] = vertex[used], n[used], own[used], sketch[used]
            parts.append((values[used] >> shift).astype(np.int64))
            found.append(part)
        return np.concatenate(parts), np.concatenate(found)


def _paragraphs(words: Words, shipped) -> Paragraphs:
    return Paragraphs(words.texts(), *shipped.value[:2], words.breaks, *shipped.value[2:])


def _edges(docs: DataFrame, shipped, fragments: int, bands: int, rows: int, share: tuple[int, int], bits: int) -> DataFrame:
    """Pairs (x, y) of vertices that share a bucket and may be similar, and what is in such buckets, by filter.

    A bucket is cut into parts between which sizes and sketches rule similarity out, and a part is a star.
    Parts of a single document are left out where all its paragraphs overlap. ``places`` are the bits of a
    filter to set: for vertices, for documents that hold them, and for vertices of a pair together with the
    document of the least name that holds them: all that hold a vertex are in each of its buckets.
    """
    arrays = list(ENTRIES.names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dealt = [_paragraphs(Words(some.column(1)), shipped).entries(bands, rows, some.column(0).to_numpy(), fragments) for some in slices([batch], _ROWS)]
            if not dealt:
                continue
            part, found = (np.concatenate(x) for x in zip(*dealt))
            order = np.argsort(part, kind="stable")
            found = found[order]
            kinds, at = np.unique(part[order], return_index=True)
            blobs = [[x.tobytes() for x in np.split(found[name], at[1:])] if len(kinds) else [] for name in arrays]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["part", *arrays])

    def collide(table: pa.Table) -> pa.Table:
        value, document, vertex, n, own, sketch = (np.frombuffer(b"".join(table.column(name).to_pylist()), ENTRIES[name]) for name in arrays)
        order = np.argsort(value, kind="stable")
        again = value[order][1:] == value[order][:-1]
        order = order[np.concatenate([again, [False]]) | np.concatenate([[False], again])]  # without buckets of one entry
        if not len(order):
            return _collided([], [], [])
        order = order[np.lexsort((document[order], sketch[order], vertex[order], n[order], value[order]))]
        value, document, vertex, n, own, sketch = (x[order] for x in (value, document, vertex, n, own, sketch))
        names, apart = document & _NAME, document & ~_NAME
        new = np.ones(len(value), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in (value, n, vertex, sketch)], axis=0)
        at = np.flatnonzero(new)  # the first entry of each vertex in its bucket, that of the least document
        label = similar_parts(value[at], n[at].astype(np.int64), own[at].astype(np.int64), sketch[at], share)
        entries = np.diff(np.append(at, len(value)))
        by = np.argsort(label, kind="stable")
        v, low, high, repeated = (x[by] for x in (vertex[at], names[at], np.maximum.reduceat(names, at), np.maximum.reduceat(apart, at) > 0))
        start = np.ones(len(v), bool)
        start[1:] = label[by][1:] != label[by][:-1]
        starts = np.flatnonzero(start)
        counts = np.diff(np.append(starts, len(v)))
        several = (np.minimum.reduceat(low, starts) != np.maximum.reduceat(high, starts)) | np.logical_or.reduceat(repeated, starts)
        paired = np.repeat(several & (counts > 1), counts)
        taken = paired | (low != high) | repeated
        centre = np.repeat(v[starts], counts)
        later = paired & (v != centre)
        pairs = np.unique(np.stack([centre[later], v[later]], 1), axis=0)
        held = np.zeros(len(v), bool)
        held[by] = taken
        held = np.repeat(held, entries)
        return _collided(pairs[:, 0].tolist(), pairs[:, 1].tolist(), [_places(kind, x, bits) for kind, x in (
            (_VERTEX, v[taken].view(np.uint64)), (_HOLDER, _held_by(v[paired], low[paired])), (_DOCUMENT, names[held].astype(np.uint64)))])

    dealt = docs.select("rid", "x_text").mapInArrow(deal, "part int, " + ", ".join(f"{name} binary" for name in arrays))
    return written(dealt.groupBy("part").applyInArrow(collide, "x long, y long, kind int, slice int, places binary"), "passage-candidates")


def similar_parts(bucket: np.ndarray, size: np.ndarray, own: np.ndarray, sketch: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """For the vertices of some buckets, one after another and by size, the place of one of their part.

    Vertices that may be similar are in one part. Two have at most the n-grams in common that they are compared
    by, their ``own``, and a bit of the sketch of one that another lacks is an n-gram that the other lacks.
    """
    top, bottom = share

    def possible(a, b) -> np.ndarray:
        shared = np.minimum(own[a] - np.bitwise_count(sketch[a] & ~sketch[b]), own[b] - np.bitwise_count(sketch[b] & ~sketch[a]))
        return (top + bottom) * shared >= top * (size[a] + size[b])

    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    counts = np.diff(np.append(starts, len(bucket)))
    label = np.arange(len(bucket))
    few = counts <= MOST_PAIRED
    a, b = pairs_of(counts[few], starts[few])
    near = possible(a, b)
    a, b, before = a[near], b[near], None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    for begin, count in zip(starts[~few].tolist(), counts[~few].tolist()):
        rest = np.arange(begin, begin + count)
        rest = rest[bottom * own[rest] >= top * size[rest]]  # others are similar to none
        while len(rest):
            root, rest = rest[0], rest[1:]
            reached = [root]
            while reached and len(rest):
                i = reached.pop()
                low, high = np.searchsorted(size[rest], [-(-top * size[i] // bottom), bottom * size[i] // top + 1])
                near = low + np.flatnonzero(possible(i, rest[low:high]))
                label[rest[near]] = root
                reached += rest[near].tolist()
                rest = np.delete(rest, near)
    return label


def _held_by(vertices: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """What stands for a vertex and a document that holds it."""
    return vertices.view(np.uint64) ^ mixed(documents.astype(np.uint64))


def _places(kind: int, names: np.ndarray, bits: int) -> list[tuple[int, int, bytes]]:
    """The places of some names in a filter, by its slices."""
    places = np.unique(mixed(names) >> np.uint64(64 - bits)).astype(np.int64)
    each = (1 << bits) // _SLICES
    kinds, at = np.unique(places // each, return_index=True)
    return [(kind, k, x.tobytes()) for k, x in zip(kinds.tolist(), np.split((places % each).astype("<u4"), at[1:]))]


def _collided(x: list[int], y: list[int], places: list[list[tuple[int, int, bytes]]]) -> pa.Table:
    flat = [p for some in places for p in some]
    none = [None] * len(x)
    x, y = ([*some, *[None] * len(flat)] for some in (x, y))
    return pa.table({"x": as_long(x), "y": as_long(y), **{name: pa.array([*none, *(p[i] for p in flat)], kind) for i, (name, kind) in enumerate((("kind", pa.int32()), ("slice", pa.int32()), ("places", pa.binary())))}})


def _filters(collisions: DataFrame, bits: int):
    """A bit field for each filter, sent to every task."""
    each = (1 << bits) // _SLICES

    def fill(table: pa.Table) -> pa.Table:
        flags = np.zeros(each, bool)
        for places in table.column("places"):
            flags[np.frombuffer(places.as_py(), "<u4")] = True
        return pa.table({**{name: table.column(name).slice(0, 1) for name in ("kind", "slice")}, "places": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    filled = written(collisions.where(F.col("kind").isNotNull()).select("kind", "slice", "places").groupBy("kind", "slice").applyInArrow(fill, "kind int, slice int, places binary"), "passage-filters")
    fields = [np.zeros((1 << bits) // 8, np.uint8) for _ in _FILTERS]
    for row in filled.toLocalIterator():
        fields[row[0]][row[1] * each // 8:(row[1] + 1) * each // 8] = np.frombuffer(row[2], np.uint8)
    return collisions.sparkSession.sparkContext.broadcast(fields)


def _in(field: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether a filter holds the names; it may hold others as well."""
    return _bit(field, mixed(names))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Number of distinct values in each row."""
    ordered = np.sort(rows, axis=1)
    return 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(1)


def _word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of the words of one text."""
    return Words(pa.array([text])).spans()


def _colliding(batches: Iterator[pa.RecordBatch], filters) -> Iterator[pa.RecordBatch]:
    """The rows whose number, in the first column, is that of a document with a collision."""
    for batch in slices(batches, _ROWS):
        batch = batch.filter(pa.array(_in(filters.value[_DOCUMENT], short_names(batch.column(0).to_numpy()).astype(np.uint64))))
        if batch.num_rows:
            yield batch


def _occurrences(docs: DataFrame, shipped, filters) -> DataFrame:
    """Place and vertices of the paragraphs that take part, and the n-grams to verify a vertex by.

    ``at`` and ``size`` count words, ``room`` the words behind, as far as they may matter. The n-grams are
    in one document of the vertex. Filters let a few others through: vertices that occur once, which
    make no cluster, and n-grams that other documents have as well.
    """
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vertices, holders, _ = filters.value
        for batch in _colliding(batches, filters):
            words = Words(batch.column(1))
            p = _paragraphs(words, shipped)
            documents = short_names(batch.column(0).to_numpy())[p.owner]
            by_content = (p.rare > 0) & _in(vertices, p.content.view(np.uint64))
            by_kind = p.mostly_common & _in(vertices, p.kind.view(np.uint64))
            used = np.flatnonzero(by_content | by_kind)
            owner, place, size, content, kind, common_kind = (x[used] for x in (p.owner, p.place, p.length, p.content, p.kind, p.mostly_common))
            n, n_often = p.distinct(used)
            alike = common_kind & (7 * n_often >= 6 * n)  # two of this class are always similar
            begins, stops = words.spans()
            start, end = begins[p.at[used]], stops[p.at[used] + size - 1]
            behind = np.minimum(words.counts[owner] - place - size, _reach(size))
            sets: list[list[bytes | None]] = []
            for names_of, wanted, only_common in ((content, by_content[used], False), (kind, by_kind[used], True)):
                column: list[bytes | None] = [None] * len(used)
                chosen = np.flatnonzero(wanted & _in(holders, _held_by(names_of, documents[used])))
                for i in chosen[np.unique(names_of[chosen], return_index=True)[1]].tolist():
                    column[i] = packed(p.gram_set(used[i], only_common))
                sets.append(column)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), as_long(start), as_long(end), as_long(content), pa.array(kind, pa.int64(), mask=~common_kind), as_long(n), pa.array(alike), pa.array(p.uniform[used]),
                 *(pa.array(x, pa.int32()) for x in (place, size, behind)), *(pa.array(column, pa.binary()) for column in sets)], names)

    schema = "rid long, start long, end long, content long, kind long, n long, alike boolean, uniform boolean, at int, size int, room int, content_ngrams binary, kind_ngrams binary"
    names = [x.split()[0] for x in schema.split(", ")]
    return written(docs.select("rid", "x_text").mapInArrow(locate, schema), "passage-occurrences", "zstd")


def _clustered(found: DataFrame, edges: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``content`` and its ``component``, for contents that are similar to another one."""
    sets = found.where(F.col("content_ngrams").isNotNull()).select(F.col("content").alias("id"), "n", F.col("content_ngrams").alias("ngrams")).unionByName(
        found.where(F.col("kind_ngrams").isNotNull()).select(F.col("kind").alias("id"), "n", F.col("kind_ngrams").alias("ngrams")))
    sets = sets.withColumn("rid", F.col("id"))  # several rows of one set count once
    verified = links(sets, edges.where("x <> y"), share)
    linked = verified.groupBy("id").agg(F.sum("links").alias("links")).where("links > 0").select(F.col("id").alias("kind"))
    members = found.where(F.col("kind").isNotNull()).groupBy("content", "kind").agg(F.max("alike").alias("alike"))
    members = members.where("alike").select("content", "kind").unionByName(members.where("NOT alike").join(linked, "kind", "left_semi").select("content", "kind"))
    both = verified.select("id", "root").unionByName(members.select(F.col("content").alias("id"), F.col("kind").alias("root")))
    return components(both, "id", "root", "passage-components").withColumnRenamed("vertex", "content")


_SPAN = ["start", "end", "component", "uniform", "at", "size", "room"]


def _dealt(df: DataFrame, tasks: int, by: str = "rid") -> GroupedData:
    """The rows of a document together, about as many for each of some tasks."""
    return df.withColumn("task", F.pmod(F.xxhash64(by), F.lit(tasks))).groupBy("task")


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(name).to_numpy() for name in names]


def _apart(placed: DataFrame, order: DataFrame, tasks: int) -> DataFrame:
    """Paragraphs that overlap one of the same cluster before them in the same row are no repetition: they are judged with it, which is ``main``.

    ``lead`` are the first one of a cluster in its row and those that are judged with it.
    """
    schema = "rid long, order long, start long, end long, component long, uniform boolean, at int, size int, room int, main boolean, lead boolean"

    def run(spans: pa.Table, orders: pa.Table) -> pa.Table:
        rid, start, end, component = _columns(spans, "rid", "start", "end", "component")
        by = np.lexsort((end, start, component, rid))
        rid, start, end, component = rid[by], start[by], end[by], component[by]
        new = np.ones(len(rid), bool)
        new[1:] = (rid[1:] != rid[:-1]) | (component[1:] != component[:-1])
        main, lead, first = new.copy(), new.copy(), True
        several = np.flatnonzero(np.repeat(counts := np.diff(np.append(np.flatnonzero(new), len(rid))), counts) > 1)
        stop = 0
        for i, begins, s, e in zip(several.tolist(), new[several].tolist(), start[several].tolist(), end[several].tolist()):
            if begins:
                first, stop = True, e
            elif s >= stop:
                main[i], first, stop = True, False, e
            else:
                lead[i] = first
        known, numbers = _columns(orders, "rid", "order")
        at = np.argsort(known)
        number = numbers[at][np.searchsorted(known[at], rid)]
        rest = spans.take(pa.array(by))
        return pa.table([pa.array(rid), as_long(number), *(rest.column(name) for name in _SPAN), pa.array(main), pa.array(lead)], ["rid", "order", *_SPAN, "main", "lead"])

    return _dealt(placed, tasks).cogroup(_dealt(order, tasks)).applyInArrow(run, schema)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted (start, end, component) with those that meet joined; the least component stands for all."""
    out: list[list[int]] = []
    for start, end, component in sorted(spans):
        if out and start <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2] = min(out[-1][2], component)
        else:
            out.append([start, end, component])
    return [tuple(x) for x in out]


def _minus(spans: list[tuple[int, int, int]], kept: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for start, end, component in spans:
        while at < len(kept) and kept[at][1] <= start:
            at += 1
        k = at
        while start < end and k < len(kept) and kept[k][0] < end:
            if kept[k][0] > start:
                out.append((start, kept[k][0], component))
            start = kept[k][1]
            k += 1
        if start < end:
            out.append((start, end, component))
    return out


def _reach(size: np.ndarray) -> np.ndarray:
    """How many words of an equal passage no run may cover, before or after a paragraph."""
    return np.maximum(PARAGRAPH - 1, 2 * PARAGRAPH - 2 - size)


_FARTHEST = 2 * PARAGRAPH - 2 - WIDTH


def open_sides(row: np.ndarray, at: np.ndarray, size: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words before and after each paragraph no paragraph of its row holds, a bit per word, the nearest first; paragraphs of a row are adjacent."""
    most, stop = _reach(size), at + size
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    widths = np.maximum.reduceat(stop, starts) + _FARTHEST + 1 if len(row) else starts
    base = np.repeat(np.cumsum(widths) - widths, np.diff(np.append(starts, len(row))))
    depth = np.zeros(int(widths.sum()) + 1, np.int64)
    np.add.at(depth, base + at, 1)
    np.add.at(depth, base + stop, -1)
    free = np.cumsum(depth) == 0
    left, right = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    for d in range(_FARTHEST):
        left |= ((d < np.minimum(most, at)) & free[base + np.maximum(0, at - 1 - d)]).astype(np.int64) << d
        right |= ((d < np.minimum(most, room)) & free[base + stop + d]).astype(np.int64) << d
    return left, right


def _extensions(judged: DataFrame, texts: DataFrame, filters, fragments: int, tasks: int) -> DataFrame:
    """The words next to repeated paragraphs, outside of all of them, that another member of the cluster has in the same place.

    A row per word: which document it is in, from where to where, and whether another one keeps it. Words are
    compared only at the distances at which some member of the cluster has a word that no paragraph holds.
    They go to the tasks that compare them in arrays, an entry per word and not a row.
    """
    places = ["rid", "order", "component", "at", "size"]

    def sides(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("rid").to_numpy(), kind="stable")))
        rid, *spans = _columns(table, "rid", "at", "size", "room")
        left, right = open_sides(rid, *(x.astype(np.int64) for x in spans))
        return pa.table([*(table.column(name) for name in places), as_long(left), as_long(right)], [*places, "left", "right"])

    ends = written(_dealt(judged.select(*places, "room"), tasks).applyInArrow(sides, "rid long, order long, component long, at int, size int, left long, right long"), "passage-ends", "zstd")
    wanted = ends.groupBy("component").agg(F.bit_or("left").alias("any_left"), F.bit_or("right").alias("any_right")).where("any_left <> 0 OR any_right <> 0")
    spans = ends.join(wanted, "component")
    held = texts.select("rid", "x_text").mapInArrow(lambda batches: _colliding(batches, filters), "rid long, x_text string")
    arrays = ["names", "orders", "places", "open", "spans", "components"]

    def run(spans: pa.Table, texts: pa.Table) -> pa.Table:
        spans = spans.take(pa.array(np.argsort(spans.column("rid").to_numpy(), kind="stable")))
        rids = spans.column("rid").to_numpy()
        known = texts.column("rid").to_numpy()
        at = np.flatnonzero(np.isin(known, rids))
        at = at[np.argsort(known[at])]
        found = []
        for begin in range(0, len(at), _ROWS):
            some = at[begin:begin + _ROWS]
            low, high = np.searchsorted(rids, known[some[0]]), np.searchsorted(rids, known[some[-1]], "right")
            found.append(_neighbours(texts.column("x_text").take(pa.array(some)).combine_chunks(), np.searchsorted(known[some], rids[low:high]), spans.slice(low, high - low)))
        if not found:
            return pa.table({"part": pa.array([], pa.int32()), **{name: pa.array([], pa.binary()) for name in arrays}})
        name, order, place, free, start, end, component = (np.concatenate(x) for x in zip(*found))
        lead = np.uint64(fragments.bit_length() - 1)
        part = (name >> (np.uint64(64) - lead)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        kinds, cuts = np.unique(part[by], return_index=True)
        rows = []
        for x in np.split(by, cuts[1:]):
            own = x[free[x]]
            rows.append((packed(((name[x] << lead) >> np.uint64(16)).astype(np.int64)), *(pa.compress(y.tobytes(), "zstd", asbytes=True) for y in (order[x], place[x].astype("<u4"))), free[x].tobytes(),
                         np.stack([start[own], end[own]]).astype("<u4").tobytes(), component[own].tobytes()))
        return pa.table([pa.array(kinds, pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*rows))], ["part", *arrays])

    def compare(table: pa.Table) -> pa.Table:
        names, flags = table.column("names").to_pylist(), table.column("open").to_pylist()
        order, place = (np.frombuffer(b"".join(pa.decompress(x, len(y) * np.dtype(kind).itemsize, "zstd", asbytes=True) for x, y in zip(table.column(column).to_pylist(), flags)), kind)
                        for column, kind in (("orders", "<i8"), ("places", "<u4")))
        name, free = unpacked(b"".join(names)), np.frombuffer(b"".join(flags), bool)
        component = np.frombuffer(b"".join(table.column("components").to_pylist()), "<i8")
        start, end = (np.concatenate(x) for x in zip(*(np.frombuffer(x, "<u4").reshape(2, -1) for x in table.column("spans").to_pylist())))
        by = np.argsort(name, kind="stable")
        again = name[by][1:] == name[by][:-1]
        by = by[np.concatenate([again, [False]]) | np.concatenate([[False], again])]
        by = by[np.lexsort((place[by], order[by], name[by]))]
        later = np.zeros(len(by), bool)
        later[1:] = name[by][1:] == name[by][:-1]
        mine = free[by]
        own = (np.cumsum(free) - 1)[by[mine]]
        return pa.table([as_long(order[by[mine]]), *(as_long(x[own].astype(np.int64)) for x in (start, end)), as_long(component[own]), pa.array(later[mine])], ["order", "start", "end", "component", "removed"])

    words = _dealt(spans, max(tasks, fragments)).cogroup(_dealt(held, max(tasks, fragments))).applyInArrow(run, "part int, " + ", ".join(f"{name} binary" for name in arrays))
    return written(words.groupBy("part").applyInArrow(compare, "order long, start long, end long, component long, removed boolean"), "passage-words")


def _neighbours(texts: pa.Array, row: np.ndarray, spans: pa.Table) -> list[np.ndarray]:
    """For the words next to the paragraphs of some texts: name, document, place, whether it is open, start, end and component.

    The name of a word tells its cluster, side, and all words from the paragraph on.
    """
    words = Words(texts)
    begins, stops = words.spans()
    value = words.hashes >> np.uint64(16)
    order, component = _columns(spans, "order", "component")
    at, size, *masks = (x.astype(np.int64) for x in _columns(spans, "at", "size", "left", "right", "any_left", "any_right"))
    base, counts = (np.cumsum(words.counts) - words.counts)[row], words.counts[row]
    most, found = _reach(size), []
    for side, mask, needed in ((0, masks[0], masks[2]), (1, masks[1], masks[3])):
        name = mixed(mixed(component.view(np.uint64)) ^ np.uint64(side + 1))
        place = stops[base + at + size - 1] if side else begins[base + at]
        near, here = place.copy(), np.arange(len(row))
        for d in range(_FARTHEST):
            there = at[here] + size[here] + d if side else at[here] - 1 - d
            here = here[inside := (d < most[here]) & (there >= 0) & (there < counts[here]) & (needed[here] >> d != 0)]
            word = base[here] + there[inside]
            name[here] = mixed(name[here] ^ value[word]) + np.uint64(0x165667B19E3779F9)
            far = stops[word] if side else begins[word]
            chosen = needed[here] >> d & 1 > 0
            k = here[chosen]
            found.append((row[k], place[k], name[k], component[k], *((near[k], far[chosen]) if side else (far[chosen], near[k])), order[k], mask[k] >> d & 1 > 0))
            near[here] = far
    row, place, name, component, start, end, order, free = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((place, name, row))
    new = np.ones(len(by), bool)
    new[1:] = np.any([x[by][1:] != x[by][:-1] for x in (row, place, name)], axis=0)  # a line and a run may end at one word
    once = by[new]
    once = once[np.lexsort((place[once], row[once]))]  # close values side by side
    return [x[once] for x in (name, order, place, free, start, end, component)]


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", share: tuple[int, int] = (3, 4), recall: float = 0.95) -> DataFrame:
    """A row per repeated passage of a document: key, row number, start and end (code points), cluster, and whether it is removed."""
    return _passages(numbered(docs.select(F.col(key).alias("key"), text_of(text).alias("x_text")), "rid", "numbered-texts", "zstd"), key, share, recall)


def _passages(texts: DataFrame, key: str, share: tuple[int, int], recall: float) -> DataFrame:
    """``texts`` is a written table of rid, key and x_text."""
    texts.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # every step is written; its shuffles go when it ends
    bands, rows = tuned(share[0] / share[1], recall)
    fragments = order_fragments(texts, "x_text")
    bits = min(MOST_BITS, fragments.bit_length() + 19)  # a bit for each 16 bytes of text

    def ngrams_of(column: pa.Array) -> np.ndarray:
        found = []
        for begin in range(0, len(column), _ROWS):
            words = Words(column.slice(begin, _ROWS))
            left = np.repeat(np.cumsum(words.counts), words.counts) - np.arange(len(words.hashes))  # words to the end of the text
            found.append((_grams(np.concatenate([words.hashes, np.zeros(WIDTH, np.uint64)]), len(left))[left >= WIDTH] >> np.uint64(16)).astype(np.int64))
        return np.concatenate(found) if found else np.empty(0, np.int64)

    twice_bits = min(MOST_BITS, fragments.bit_length() + 21)  # a bit for each four bytes of text
    common, common_bits, twice = frequent_ngrams(texts.select("x_text"), ngrams_of, fragments, twice_bits=twice_bits)  # the order costs a pass, and saves most candidates
    shipped = texts.sparkSession.sparkContext.broadcast((common, common_bits, short_table(common), twice))
    collisions = _edges(texts, shipped, fragments, bands, rows, share, bits)
    edges = collisions.where(F.col("x").isNotNull()).select("x", "y")
    filters = _filters(collisions, bits)
    found = _occurrences(texts, shipped, filters)
    tasks = tasks_for(found, TASK_ROWS)
    clusters = _clustered(found, edges, share)
    order = written(texts.select("key", "rid").orderBy("key", "rid").withColumn("order", F.monotonically_increasing_id()), "passage-order")
    placed = found.select("rid", "content", *(n for n in _SPAN if n != "component")).join(clusters, "content", "left")
    placed = placed.withColumn("component", F.coalesce("component", "content")).select("rid", *_SPAN)
    placed = written(_apart(placed, order.select("rid", "order"), tasks), "passage-places", "zstd")
    firsts = placed.where("main").groupBy("component").agg(F.min("order").alias("first"), F.max("order").alias("last"), F.count(F.lit(1)).alias("times"), F.bool_or("uniform").alias("uniform"))
    firsts = firsts.where("first < last OR times > 1 AND NOT uniform").select("component", "first")
    judged = placed.join(firsts, "component").withColumn("removed", ~((F.col("order") == F.col("first")) & F.col("lead")))
    judged = written(judged.select("rid", "order", "start", "end", "component", "at", "size", "room", "removed"), "passage-judged", "zstd")
    whole = judged.select("order", "start", "end", "component", "removed").unionByName(_extensions(judged, texts, filters, fragments, tasks))

    def merge(table: pa.Table) -> pa.Table:
        number = table.column("order").to_numpy()
        table = table.take(pa.array(np.argsort(number, kind="stable")))
        number, start, end, component, removed = _columns(table, "order", "start", "end", "component", "removed")
        bounds = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])).tolist()
        spans, gone_, out = list(zip(start.tolist(), end.tolist(), component.tolist())), removed.tolist(), []
        for low, high in zip(bounds[:-1], bounds[1:]):
            document = int(number[low])
            kept = _merged([s for s, away in zip(spans[low:high], gone_[low:high]) if not away])
            gone = _minus(_merged([s for s, away in zip(spans[low:high], gone_[low:high]) if away]), kept)
            out += [(document, *s, False) for s in kept] + [(document, *s, True) for s in gone]
        return pa.table([*(as_long([r[i] for r in out]) for i in range(4)), pa.array([r[4] for r in out], pa.bool_())], ["order", "start", "end", "cluster", "removed"])

    merged = _dealt(whole, tasks, "order").applyInArrow(merge, "order long, start long, end long, cluster long, removed boolean")
    return merged.join(order, "order").select(F.col("key").alias(key), F.col("rid").alias("row_number"), "start", "end", "cluster", "removed")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", share: tuple[int, int] = (3, 4), recall: float = 0.95) -> DataFrame:
    """``docs`` with the removed passages cut out of the texts."""
    names, (rid, cuts) = docs.columns, fresh(docs.columns, "x_rid", "x_cuts")
    rows = numbered(docs, rid, "numbered-documents")
    texts = rows.select(F.col(key).alias("key"), text_of(text).alias("x_text"), F.col(rid).alias("rid"))
    gone = written(_passages(texts, key, share, recall).where("removed"), "passage-removals")
    spans = gone.groupBy(F.col("row_number").alias(rid)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    joined = rows.join(spans, rid, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, by = batch.schema.get_field_index(text), batch.schema.get_field_index(cuts)
            texts = []
            for passage, parts in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist()):
                for part in reversed(parts or []):
                    passage = passage[:part["start"]] + passage[part["end"]:]
                texts.append(passage)
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in (rid, cuts)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*docs.columns, rid, cuts).mapInArrow(cut, docs.schema)
