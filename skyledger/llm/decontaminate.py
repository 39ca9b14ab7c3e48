"""Benchmark passages in documents, found by embedded edit distance.

Texts are sequences of words in lower case without the marks around them; of scripts written
without spaces every character is a word. A random walk
writes the word it stands on and moves on or stays, as a hash of word and step says; two
sequences of small edit distance give embedded sequences of small Hamming distance, since
walks that fell out of step meet again. Sampling a few embedded places gives a key that
similar sequences share with a probability that follows from their distance, and enough
repetitions with other walks and places reach the target recall. Every pair that shares a
key is then verified: a document holds an item if some run of its words has an edit
distance of at most ``max_edits`` times the item's length.

Walks that fell out of step in a long item are lost for longer, the more edits it has. So
an item of more than ``SEGMENT`` words is cut into equal segments: if the item is held with the
allowed edits, one of its segments at least is held with the allowed edits of its own size.
Segments are looked for like items, and the whole item is verified around them.

Windows have the items' sizes: items are put into classes of nearly equal length, a class
embeds its items' first words, and windows of that many words start at every word of every
document. A window can only match when all but the allowed edits of its words occur in
items of the class, so others are left out before the walk; that loses nothing.

Items are a stated query set: they are sent to the tasks in blocks of ``BLOCK_BYTES``, one
pass over the documents for each block, and documents are never shuffled.

Items shorter than ``min_words`` words are held only word for word: a hash of every window of
their size is looked up, and the words are compared.

Defined cases: null and empty texts hold nothing; items without a word, null ones included,
are never held; equal items are all reported; repeated rows are reported each; ties between
places go to the first; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skyledger.llm.common import BoundedCache, as_long, fresh, mixed, slices, text_of, word_lists, written

BLOCK_BYTES = 16 << 20
CLASS_RATIO = 1.15
WORDS_AT_ONCE = 2_000_000
STEPS_PER_WORD = 2  # a walk moves at every other step
TABLE_WORDS = 1 << 15
PLACES = 2  # sampled for a key
SEGMENT = 60  # words; longer items are looked for by segments
CELLS_AT_ONCE = 4_000_000  # words of the regions that are verified together
#: Blocks of scripts that are written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han).
UNSPACED = re.compile("([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF])")
LOST_PER_EDIT = 3  # embedded places that an edit is taken to change, per word


def repetitions(max_edits: float, recall: float) -> int:
    """Keys needed to reach ``recall`` for pairs at the largest distance."""
    agree = max(0.1, 1 - LOST_PER_EDIT * max_edits)
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**PLACES))


_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())


def _lowered(text: str) -> bytes:
    """UTF-8 of the text in lower case, with spaces around every character of an unspaced script."""
    return (text if text.isascii() else UNSPACED.sub(r" \1 ", text)).lower().encode("utf-8", "surrogatepass")


def _plain(word: bytes) -> bytes:
    """A word in lower case without the marks around it."""
    if word.isascii():
        return word.strip(_MARKS)
    text = word.decode("utf-8", "surrogatepass")
    begin, end = 0, len(text)
    while begin < end and not text[begin].isalnum():
        begin += 1
    while end > begin and not text[end - 1].isalnum():
        end -= 1
    return text[begin:end].encode("utf-8", "surrogatepass")


def plain_words(text: str) -> list[str]:
    found = (_plain(w) for words in word_lists(_lowered(text)) for w in words)
    return [w.decode("utf-8", "surrogatepass") for w in found if w]


class WordNumbers:
    """Numbers of the words of texts, 0 for those that no item has; those that are only marks are left out.

    Most words without the ASCII marks around them are without any, so the items' words are asked for directly and
    words that no item has are not kept. Only words that begin or end beyond ASCII are looked at by character.
    """

    def __init__(self, vocabulary: dict[str, int]):
        self.known = {word.encode("utf-8", "surrogatepass"): number for word, number in vocabulary.items()} | {b"": -1}
        self.beyond = BoundedCache(lambda word: self.known.get(_plain(word), 0))

    def of(self, text: str) -> np.ndarray:
        data, get, beyond, parts = _lowered(text), self.known.get, self.beyond, []
        for words in word_lists(data):
            if data.isascii():
                numbers = [get(w.strip(_MARKS), 0) for w in words]
            else:
                numbers = [get(w, 0) or (beyond[w] if w[0] > 127 or w[-1] > 127 else 0) for w in [w.strip(_MARKS) for w in words]]
            parts.append(np.array(numbers, np.int64))
        found = np.concatenate(parts) if parts else np.empty(0, np.int64)
        return found[found >= 0]


def _moves(symbols: np.ndarray, repetition: int, part: int) -> np.ndarray:
    """64 steps of the walk's moves for each word: the bits of a hash of the word."""
    seed = np.uint64((repetition * 1_000_003 + part + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return mixed(symbols.astype(np.uint64) + seed)


class Walks:
    """Embeds windows; the moves of a small vocabulary are looked up, those of a large one computed."""

    def __init__(self, symbols: int):
        self.symbols, self.tables = symbols, {}

    def moves(self, here: np.ndarray, repetition: int, step: int) -> np.ndarray:
        place = repetition, step // 64
        if self.symbols > TABLE_WORDS:
            moves = _moves(here, *place)
        else:
            if place not in self.tables:
                self.tables[place] = _moves(np.arange(self.symbols), *place)
            moves = self.tables[place][here]
        return (moves >> np.uint64(step % 64)).view(np.int64) & 1

    def walk(self, words: np.ndarray, starts: np.ndarray, size: int, repetition: int, places: list[int], allowed: list[np.ndarray] | None):
        """Embedded symbols at ``places`` (sorted steps); starts whose symbol is not allowed stop there.

        Returns the starts that are left and their symbols, a column for each place.
        """
        at, taken = starts, []
        for step in range(places[-1] + 1):
            here = words[at] if step < size else np.where(at < starts + size, words[np.minimum(at, starts + size)], 0)
            if step in places:
                taken.append(here)
                if allowed is not None:
                    kept = allowed[len(taken) - 1][here]
                    starts, at, here, taken = starts[kept], at[kept], here[kept], [t[kept] for t in taken]
                    if not len(starts):
                        break
            at = at + self.moves(here, repetition, step)
        return starts, np.stack(taken, 1) if len(taken) == len(places) else np.empty((0, len(places)), np.int64)


def apart(starts: np.ndarray, slack: int) -> np.ndarray:
    """Sorted starts without those at most ``slack`` after one that stays."""
    kept, last = [], None
    for start in starts.tolist():
        if last is None or start > last + slack:
            kept.append(last := start)
    return np.array(kept, np.int64)


def _key(symbols: np.ndarray) -> np.ndarray:
    key = np.zeros(len(symbols), np.uint64)
    for column in symbols.T:
        key = mixed(key ^ column.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return key


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from ``first`` up to ``last`` of every pair, one after the other, and how many each pair has."""
    count = last - first
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), count


def _window_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    return _key(np.lib.stride_tricks.sliding_window_view(words, size)) if len(words) >= size else np.empty(0, np.uint64)


def edit_distances(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edit distance between ``item`` and a run of words of each region (a row), and where that run ends."""
    width = np.arange(regions.shape[1] + 1)
    row = np.zeros((len(regions), len(width)), np.int64)  # a run may start anywhere
    for i, word in enumerate(item, 1):
        below = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != word))
        below = np.concatenate([np.full((len(regions), 1), i), below], 1)
        row = np.minimum.accumulate(below - width, 1) + width
    return row.min(1), row.argmin(1)


class ItemIndex:
    """The items of one block: vocabulary, classes and keys."""

    def __init__(self, items: list[tuple[object, str]], max_edits: float, recall: float, min_words: int):
        sequences = [(number, plain_words(text)) for number, text in items]
        sequences = [(number, words) for number, words in sequences if words]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in sequences for w in words}), 1)}
        self.numbers = [number for number, _ in sequences]
        self.items = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in sequences]
        self.edits = [math.floor(max_edits * len(item)) if len(item) >= min_words else 0 for item in self.items]
        self.pad = max((len(i) + 4 * e for i, e in zip(self.items, self.edits)), default=0) + 1
        self.walks = Walks(len(self.vocabulary) + 1)
        cuts = [(k, round(j * len(item) / parts), round((j + 1) * len(item) / parts))
                for k, item in enumerate(self.items) if len(item) >= min_words for parts in [-(-len(item) // SEGMENT)] for j in range(parts)]
        self.segments = [self.items[k][begin:end] for k, begin, end in cuts]
        self.allowed = [math.floor(max_edits * len(segment)) for segment in self.segments]
        self.item_of, self.offset = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
        by_size: dict[int, list[int]] = {}
        for k, segment in enumerate(self.segments):
            by_size.setdefault(math.floor(CLASS_RATIO ** math.floor(math.log(len(segment), CLASS_RATIO) + 1e-9)), []).append(k)
        short: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            if len(item) < min_words:
                short.setdefault(len(item), []).append(k)
        self.short = [self._short(size, np.array(members)) for size, members in sorted(short.items())]
        self.classes = [self._class(size, members, repetitions(max_edits, recall)) for size, members in sorted(by_size.items())]

    def _class(self, size: int, members: list[int], times: int):
        known = np.zeros(len(self.vocabulary) + 1, bool)
        known[np.concatenate([self.items[k] for k in set(self.item_of[members].tolist())])] = True
        slack = max(self.allowed[k] for k in members)
        flat = np.concatenate([np.concatenate([self.segments[k], [0]]) for k in members])
        starts = np.cumsum([0, *(len(self.segments[k]) + 1 for k in members[:-1])])
        keys, steps = [], STEPS_PER_WORD * size
        for repetition in range(times):
            draw = np.random.Generator(np.random.PCG64([size, repetition]))
            places = sorted(draw.choice(steps, min(PLACES, steps), replace=False).tolist())
            _, symbols = self.walks.walk(flat, starts, size, repetition, places, None)
            allowed = []
            for column in symbols.T:
                mask = np.zeros(len(known), bool)
                mask[column] = True
                allowed.append(mask)
            order = np.argsort(key := _key(symbols), kind="stable")
            keys.append((repetition, places, allowed, key[order], np.array(members)[order]))
        return size, slack, known, keys

    def _short(self, size: int, members: np.ndarray):
        keys = np.concatenate([_window_keys(self.items[k], size) for k in members])
        order = np.argsort(keys, kind="stable")
        return size, keys[order], members[order]

    def word_for_word(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Short items that occur, and where they start."""
        for size, keys, members in self.short:
            own = _window_keys(words, size)
            first = np.searchsorted(keys, own, "left")
            starts = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == own)
            which, count = _ranges(first[starts], np.searchsorted(keys, own[starts], "right"))
            starts, items = np.repeat(starts, count), members[which]
            for k in np.unique(items).tolist():
                here = starts[items == k]
                same = (words[here[:, None] + np.arange(size)] == self.items[k]).all(1)
                if same.any():
                    yield k, here[same]

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (start, item) where a window shares a key with a segment of the item; the item would start there."""
        found = []
        for size, slack, known, keys in self.classes:
            inside = np.concatenate([[0], np.cumsum(known[words], dtype=np.int32)])
            starts = np.flatnonzero(inside[size:] - inside[:-size] >= max(1, size - slack)) if len(words) >= size else np.empty(0, np.int64)
            if not len(starts):
                continue
            for repetition, places, allowed, key, members in keys:
                left, symbols = self.walks.walk(words, starts, size, repetition, places, allowed)
                if len(left):
                    own = _key(symbols)
                    first, last = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
                    which, count = _ranges(first, last)
                    segment = members[which]
                    found.append(np.stack([np.repeat(left, count) - self.offset[segment], self.item_of[segment]], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]

    def matches(self, documents: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, first word) for every item a document holds."""
        gap = np.zeros(self.pad, np.int64)
        words = np.concatenate([gap, *(x for d in documents for x in (d, gap))])
        begins = np.cumsum([self.pad, *(len(d) + self.pad for d in documents[:-1])])
        starts, items = self.candidates(words)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k, here in self.word_for_word(words):
            owners, at = np.unique(np.searchsorted(begins, here, "right") - 1, return_index=True)
            for owner, start in zip(owners.tolist(), here[at].tolist()):
                best[owner, k] = (0, start - int(begins[owner]))
        for k in np.unique(items).tolist():
            item, slack, own = self.items[k], self.edits[k], apart(np.sort(starts[items == k]), self.edits[k])
            lead = slack if len(item) <= SEGMENT else 2 * slack  # edits before a segment move the item's start
            span = np.arange(-lead, len(item) + 2 * lead)
            step = max(1, min(4096, CELLS_AT_ONCE // len(span)))
            for begin in range(0, len(own), step):
                block = own[begin:begin + step]
                regions = words[np.minimum(block[:, None] + span, len(words) - 1)]
                edits, ends = edit_distances(item, regions)
                held = np.flatnonzero(edits <= slack)
                stops = block[held] - lead + ends[held]  # windows may start before the document
                owners = np.searchsorted(begins, stops - 1, "right") - 1
                firsts = np.maximum(0, stops - len(item) - begins[owners])
                for owner, distance, first in zip(owners.tolist(), edits[held].tolist(), firsts.tolist()):
                    here = (distance, first)
                    if here < best.get((owner, k), (slack + 1, 0)):
                        best[owner, k] = here
        return [(owner, k, *where) for (owner, k), where in sorted(best.items())]


def blocks(items: DataFrame, key: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for number, passage in items.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        if block and size + len(passage) > most:
            yield block
            block, size = [], 0
        block.append((number, passage))
        size += len(passage)
    yield block


def _scanned(batches: Iterable[pa.RecordBatch], index: ItemIndex, text: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int]]]]:
    """Batches with their matches; each of a bounded number of words, or one document."""
    numbers = WordNumbers(index.vocabulary)
    for batch in slices(batches):
        column, begin, held, size = batch.column(batch.schema.get_field_index(text)), 0, [], 0
        for i in range(batch.num_rows):
            held.append(numbers.of(column[i].as_py()))
            size += len(held[-1])
            if size >= WORDS_AT_ONCE or i == batch.num_rows - 1:
                yield batch.slice(begin, i + 1 - begin), index.matches(held) if index.items else []
                begin, held, size = i + 1, [], 0


_built: dict[str, ItemIndex] = {}


def index_of(name: str, items: list[tuple[object, str]], *how) -> ItemIndex:
    """The index of a block, built once for all tasks of a worker; ``name`` is the block's own, and one block is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = ItemIndex(items, *how)
    return _built[name]


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          max_edits: float = 0.2, recall: float = 0.95, min_words: int = 8) -> DataFrame:
    """A row per document and item it holds: edits, words of the item, and the word at which the passage starts."""
    rows = docs.select(F.col(key).alias("doc"), text_of(text).alias("x_text"))
    schema = T.StructType([T.StructField(key, rows.schema["doc"].dataType), T.StructField(item_key, items.schema[item_key].dataType),
                           *(T.StructField(name, T.LongType()) for name in ("edits", "item_words", "word_start"))])
    out = None
    for block in blocks(items, item_key, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = index_of(name, shipped.value, max_edits, recall, min_words)
            for batch, found in _scanned(batches, index, "x_text"):
                cells = [(k, edits, len(index.items[k]), first) for _, k, edits, first in found]
                columns = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([index.numbers[c[0]] for c in cells], item_type)]
                yield pa.RecordBatch.from_arrays([*columns, *(as_long([c[i] for c in cells]) for i in (1, 2, 3))], schema.names)

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(schema[1].dataType)
        found = rows.mapInArrow(run, schema)
        out = found if out is None else written(out, "leaks").unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          max_edits: float = 0.2, recall: float = 0.95, min_words: int = 8) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    copy, = fresh(docs.columns, "x_text")
    for number, block in enumerate(blocks(items, item_key, item_text)):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = index_of(name, shipped.value, max_edits, recall, min_words)
            for batch, found in _scanned(batches, index, copy):
                kept = np.ones(batch.num_rows, bool)
                kept[[f[0] for f in found]] = False
                at = batch.schema.get_field_index(copy)
                rows = batch.filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(rows.columns) if i != at], [n for n in rows.schema.names if n != copy])

        docs = (written(docs, "cleaned") if number else docs)
        docs = docs.withColumn(copy, text_of(text)).mapInArrow(run, docs.schema)
    return docs
