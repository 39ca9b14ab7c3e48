"""Toxicity of texts by two class-conditional Kneser-Ney models.

A word is a run of letters in lower case. Each class (toxic, ordinary) has an interpolated
Kneser-Ney model of the characters of a word, up to ``ORDER`` symbols with marks for the word's
beginning and end: counts with three discounts at the highest order and for word beginnings, numbers of distinct
left neighbours below. Both classes back off to the same model of at most ``SHARED`` symbols,
whose counts are the numbers of distinct words that hold an expression, over all documents. So an
expression that one class hardly knows is worth what the corpus says, and the difference of the classes comes from
what they have really seen. A stem that only toxic texts use is recognised in every inflected form.

A text's log-likelihood ratio, per symbol and per square root of symbols, becomes a probability by a logistic fit on
labelled documents that the models have not seen.

Class counts come from all labelled documents but those of the fit, and the fit from all of its own. How that is bounded: of the class
tables one block of at most ``MOST_ENTRIES`` is in memory at a time. A block holds the runs of a range of contexts, the two symbols
before the last one; whatever a symbol's estimate needs has its context, so each block gives exact terms and the sum over the blocks is the
ratio. Texts are read once for each block (one, as a rule). A context is never divided. The fit sums over rows in every step. Shared counts are of
single bytes: characters beyond ASCII are folded to 128 values, so a run of three symbols has at most 2^24 values. The corpus is gathered as its
distinct words, which meet in a shuffle.

Defined cases: a null or empty text, or one without letters, has ratio 0; a document labelled more than once is toxic if any label says so;
null labels and labels without a document are not looked at; repeated documents are learned each time they occur; with no labels of one class every
score is the other class's (1 if only toxic rows are labelled, else 0); an empty table gives an empty result. Further columns of the tables are
passed through by ``with_scores`` and not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from skyledger.llm.common import as_long, fresh, numbered, slices, written

ORDER = 6
SHARED = 3
BEGIN, END = 1, 2
CONTEXTS = 1 << 16  # of two symbols
MOST_ENTRIES = 6_000_000  # of the class tables at a time, 24 bytes each
BROADCAST_LABELS = 1_000_000  # more are joined in a shuffle
PIECE = 1 << 18  # symbols looked at together
TEXTS = 128  # texts whose words a task holds at a time
CACHED_WORDS = 400_000
SET_WORDS = 200_000  # distinct words that a task holds before it sends them on
SET_SYMBOLS = 1 << 22  # and their symbols, where it counts runs
TOXIC, ORDINARY = 1, 0

_WORD = re.compile(r"[^\W\d_]+")
_8 = np.uint64(8)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


# --- Words as symbols ------------------------------------------------------------------

def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words with their marks, the word each belongs to, and its place there."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    flat, inner = np.empty(int(lengths.sum()), np.uint64), np.ones(int(lengths.sum()), bool)
    inner[starts] = inner[ends - 1] = False
    flat[inner] = np.where(points < 128, points, 128 + points % 128)
    flat[starts], flat[ends - 1] = BEGIN, END
    return flat, np.repeat(np.arange(len(words)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)


def _pieces(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, word and place of bounded lots; a long word comes in overlapping pieces, where only the new symbols count."""
    lot, size, base = [], 0, 0
    for i, word in enumerate(words):
        if len(word) > PIECE:
            flat, _, place = _symbols([word])
            for begin in range(0, len(flat), PIECE):
                seen = max(0, begin - ORDER + 1)
                part = slice(seen, begin + PIECE)
                yield flat[part], np.full(len(flat[part]), i), place[part], place[part] >= begin
            continue
        lot.append((i, word))
        size += len(word) + 2
        if size >= PIECE:
            yield _lot(lot)
            lot, size = [], 0
    if lot:
        yield _lot(lot)


def _lot(lot: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat, word, place = _symbols([w for _, w in lot])
    return flat, np.array([i for i, _ in lot])[word], place, np.ones(len(flat), bool)


def _grams(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` symbols that end at each of ``at``, packed into bytes, the last one lowest."""
    key = np.zeros(len(at), np.uint64)
    for back in range(size - 1, -1, -1):
        key = (key << _8) | flat[at - back]
    return key


# --- Counts of the models --------------------------------------------------------------

def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(keys, return_inverse=True)
    return found, np.bincount(which, counts, len(found)).astype(np.int64)


def shared_counts(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """For every run of at most ``SHARED`` symbols in how many distinct words of all documents it occurs (each place counts)."""
    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for batch in slices(batches, TEXTS):
            for value in batch.column(0).to_pylist():
                held.update(words_of(value))
                if len(held) >= SET_WORDS:
                    yield pa.record_batch({"word": pa.array(list(held), pa.string())})
                    held = set()
        yield pa.record_batch({"word": pa.array(list(held), pa.string())})

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 65_536):
            found = [(size, _grams(flat, np.flatnonzero((place >= max(1, size - 1)) & new), size))
                     for flat, _, place, new in _pieces(batch.column(0).to_pylist()) for size in range(1, SHARED + 1)]
            keys, counts = _summed(np.concatenate([k for _, k in found]), np.ones(sum(len(k) for _, k in found)))
            yield pa.record_batch({"key": as_long(keys.astype(np.int64)), "n": as_long(counts)})

    words = documents.select(text).mapInArrow(distinct, "word string").distinct()
    table = written(words, "toxicity-words").mapInArrow(runs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most 2^24 rows
    return table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()


def class_counts(labelled: DataFrame, text: str, toxic: str) -> DataFrame:
    """(class, beginning, key, n): runs of ``ORDER`` symbols, and shorter ones from the beginning of a word."""
    def counted(kind: int, counts: dict[str, int]) -> pa.RecordBatch:
        weight = np.fromiter(counts.values(), np.int64, len(counts))
        keys, times = [], []
        for flat, word, place, new in _pieces(list(counts)):
            for size in range(2, ORDER + 1):
                at = np.flatnonzero(((place == size - 1) if size < ORDER else (place >= size - 1)) & new)
                keys.append(_grams(flat, at, size))
                times.append(weight[word[at]])
        found, n = _summed(np.concatenate(keys), np.concatenate(times))
        return pa.record_batch({"kind": pa.array([kind] * len(found), pa.int32()), "key": as_long(found.astype(np.int64)), "n": as_long(n)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str, int]] = {ORDINARY: {}, TOXIC: {}}
        symbols = 0
        for batch in slices(batches, TEXTS):
            for value, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = held[kind]
                for word in words_of(value):
                    if word not in counts:
                        symbols += len(word) + 2
                    counts[word] = counts.get(word, 0) + 1
            if symbols >= SET_SYMBOLS or sum(map(len, held.values())) >= SET_WORDS:
                yield from (counted(kind, counts) for kind, counts in held.items() if counts)
                held, symbols = {ORDINARY: {}, TOXIC: {}}, 0
        yield from (counted(kind, counts) for kind, counts in held.items() if counts)

    return labelled.select(text, toxic).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _few(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.array([(counts == i).sum() for i in (1, 2, 3, 4)], np.int64)


def _orders(keys: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of every order from the runs of a class; tails keep their context."""
    size, found = _size_of(keys), {}
    found[ORDER] = (keys[size == ORDER], n[size == ORDER])
    for order in range(ORDER - 1, 1, -1):
        begins = size == order
        parts = [(keys[begins], n[begins])]
        if order > SHARED:  # distinct left neighbours within a word
            tails, times = _summed(found[order + 1][0] & np.uint64((1 << 8 * order) - 1), np.ones(len(found[order + 1][0])))
            parts.append((tails, times))
        found[order] = tuple(np.concatenate(x) for x in zip(*parts))
    return found


class Level:
    """Kneser-Ney estimates of one order: discounted counts by key, backoff weights by history."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, few: np.ndarray | None = None):
        """``few``: how many keys of the whole table occur once to four times, where ``keys`` are a block of it."""
        order = np.argsort(keys)
        self.keys, counts = keys[order], counts[order]
        of = [max(1, int(n)) for n in (_few(counts) if few is None else few)]
        share = of[0] / (of[0] + 2 * of[1])
        discounts = np.array([0.0] + [min(max(i - (i + 1) * share * of[i] / of[i - 1], 0.1 * i), 0.99 * i) for i in (1, 2, 3)])
        taken = discounts[np.minimum(counts, 3)]
        histories = self.keys >> _8
        self.histories, which = np.unique(histories, return_inverse=True)
        total = np.bincount(which, counts, len(self.histories))
        self.value = ((counts - taken) / total[which]).astype(np.float32)
        self.backoff = (np.bincount(which, taken, len(self.histories)) / total).astype(np.float32)

    def __call__(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return lower
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        j = np.minimum(np.searchsorted(self.histories, keys >> _8), len(self.histories) - 1)
        own = np.where(self.keys[i] == keys, self.value[i], 0.0)
        return np.where(self.histories[j] == keys >> _8, own + self.backoff[j] * lower, lower)


def _size_of(keys: np.ndarray) -> np.ndarray:
    """How many symbols a key holds; no symbol is zero."""
    return sum(((keys >> np.uint64(8 * i)) > 0).astype(np.int64) for i in range(ORDER))


def _first(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys >> np.uint64(8 * (size - 1))) == BEGIN


@dataclass
class Model:
    """One block of the class tables, as a rule the only one; the driver's object knows how to make the ``further`` ones."""

    shared: list[Level]  # of 1 to SHARED symbols
    classes: tuple[list[Level], list[Level]]  # ordinary, toxic: of 2 to ORDER symbols
    weights: tuple[float, float, float] = (0.0, 1.0, 0.0)  # of the logistic fit
    constant: float | None = None
    contexts: tuple[int, int] = (0, CONTEXTS)  # of the keys that this block answers; others count 0
    further: list[Callable[[], Model]] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"further": []}  # tasks get one block

    @classmethod
    def of(cls, shared: list[Level], counts: dict[int, tuple[np.ndarray, np.ndarray]], few: dict[int, dict[int, np.ndarray]],
           contexts: tuple[int, int] = (0, CONTEXTS)) -> Model:
        def of_class(kind: int) -> list[Level]:
            found = _orders(*counts[kind])
            return [Level(*found[order], few[kind][order]) for order in range(2, ORDER + 1)]

        return cls(shared, (of_class(ORDINARY), of_class(TOXIC)), contexts=contexts)

    def blocks(self) -> Iterator[Model]:
        """All blocks in turn; each is made when it is asked for."""
        yield self
        yield from (make() for make in self.further)

    def _ratios(self, keys: np.ndarray) -> np.ndarray:
        """Log ratio (toxic to ordinary) of the last symbol of each key, which holds what goes before, up to ``ORDER`` symbols."""
        size, masked = _size_of(keys), lambda n: keys & np.uint64((1 << 8 * n) - 1)
        base = np.full(len(keys), 1 / 256)
        for n, level in enumerate(self.shared, 1):
            there = size >= n
            base[there] = level(masked(n)[there], base[there])
        logs = []
        for levels in self.classes:
            p = base.copy()
            for n, level in enumerate(levels, 2):
                key = masked(n)
                there = (size >= n) & ((n > SHARED) | _first(key, n))
                p[there] = level(key[there], p[there])
            logs.append(np.log(p))
        return logs[1] - logs[0]

    def of_words(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word, over all blocks that this object knows."""
        return sum(block._of_words(words) for block in self.blocks())

    def _of_words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for flat, word, place, new in _pieces(words):
            keys = np.zeros(len(flat), np.uint64)
            for back in range(ORDER - 1, -1, -1):
                at = np.flatnonzero(place >= back)
                at = at[at >= back]
                keys[at] = (keys[at] << _8) | flat[at - back]
            context = (keys >> _8) & np.uint64(CONTEXTS - 1)
            asked = np.flatnonzero((place >= 1) & new & (context >= self.contexts[0]) & (context < self.contexts[1]))
            distinct, which = np.unique(keys[asked], return_inverse=True)
            out += np.bincount(word[asked], self._ratios(distinct)[which], len(words))
        return out

    def score(self, ratio: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(ratio), self.constant)
        z = np.column_stack(features(ratio, symbols)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(ratio: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One, the ratio per symbol, and the ratio per square root of symbols."""
    n = np.maximum(symbols, 1)
    return np.ones(len(ratio)), 10 * ratio / n, ratio / np.sqrt(n)


def _ratios_of(model: Model, texts: list[str | None], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio and number of symbols of each text; ``cache`` remembers words and starts anew when it is full."""
    lists = [words_of(text) for text in texts]
    if len(cache) > CACHED_WORDS:
        cache.clear()
    lacking = list({word for words in lists for word in words if word not in cache})
    if lacking:
        cache.update(zip(lacking, model.of_words(lacking).tolist()))
    ratio = np.array([sum(map(cache.__getitem__, words)) for words in lists], float)
    return ratio, np.array([sum(map(len, words)) + len(words) for words in lists], np.int64)


# --- Learning and scoring --------------------------------------------------------------

def _logistic(rows: DataFrame, ridge: float = 1e-3, steps: int = 50) -> tuple[float, ...] | None:
    """Weights of a logistic fit to all ``rows`` (ratio, symbols, kind), whose targets are a little inside 0 and 1; None without both classes.

    Every step sums over all rows; a task sends one row of sums, and these are added in the order of the tasks.
    """
    def summed(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [of(np.column_stack(features(b.column(0).to_numpy(), b.column(1).to_numpy())), b.column(2).to_numpy()) for b in batches if b.num_rows]
            if total:
                yield pa.record_batch({"sums": pa.array([np.sum(total, axis=0)], pa.list_(pa.float64()))})

        parts = [r.sums for r in rows.select("ratio", "symbols", "kind").mapInArrow(run, "sums array<double>").collect()]
        return np.sum(parts, axis=0) if parts else np.zeros(2)

    toxic, ordinary = summed(lambda x, y: np.array([(y == TOXIC).sum(), (y != TOXIC).sum()], float))
    if not (toxic and ordinary):
        return None
    high, low, width = 1 - 1 / (toxic + 2), 1 / (ordinary + 2), 3
    w, penalty = np.zeros(width), ridge * np.diag([0.0] + [1.0] * (width - 1))
    for _ in range(steps):
        def of(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (np.where(y == TOXIC, high, low) - p)])

        sums = summed(of)
        curvature, slope = sums[:width * width].reshape(width, width), sums[width * width:]
        step = np.linalg.solve(curvature + penalty + 1e-9 * np.eye(width), slope - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def _spans(counts: DataFrame) -> list[tuple[int, int]]:
    """Ranges of contexts with at most ``MOST_ENTRIES`` entries each (a context is not divided)."""
    context = F.shiftright("key", 8).bitwiseAND(F.lit(CONTEXTS - 1))
    spans, begin, held = [], 0, 0
    for found, n in sorted(tuple(r) for r in counts.groupBy(context).count().collect()):  # at most CONTEXTS rows
        if held and held + n > MOST_ENTRIES:
            spans.append((begin, found))
            begin, held = found, 0
        held += n
    return [*spans, (begin, CONTEXTS)]


def _model(shared: tuple[np.ndarray, np.ndarray], counts: DataFrame) -> Model:
    """The model of a written table of class counts: its first block, which knows the others."""
    def of_block(span: tuple[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows = counts
        if span != (0, CONTEXTS):
            rows = rows.where(F.shiftright("key", 8).bitwiseAND(F.lit(CONTEXTS - 1)).between(span[0], span[1] - 1))
        table = rows.toArrow()
        kinds, keys, n = table.column("kind").to_numpy(), table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
        return {k: (keys[kinds == k], n[kinds == k]) for k in (ORDINARY, TOXIC)}

    sizes = _size_of(shared[0])
    levels = [Level(shared[0][sizes == n], shared[1][sizes == n]) for n in range(1, SHARED + 1)]
    spans = _spans(counts)
    few = {kind: {order: np.zeros(4, np.int64) for order in range(2, ORDER + 1)} for kind in (ORDINARY, TOXIC)}
    for span in spans:  # discounts are those of the whole tables
        block = of_block(span)
        for kind, runs in block.items():
            for order, (_, n) in _orders(*runs).items():
                few[kind][order] += _few(n)
    model = Model.of(levels, block if len(spans) == 1 else of_block(spans[0]), few, spans[0])
    model.further = [lambda span=span: Model.of(levels, of_block(span), few, span) for span in spans[1:]]
    return model


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", calibrating: Column | None = None) -> Model:
    """The models of all ``labels``' documents, backed by counts over all ``documents``.

    ``calibrating`` (of the column ``labelled``) selects the labels that the logistic fit uses and the models do not see; by default every sixteenth.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("labelled")).agg(
        (F.max(toxic) > 0).cast("int").alias("kind"))
    apart = F.pmod(F.crc32(F.col("labelled").cast("string").cast("binary")), F.lit(16)) == 3 if calibrating is None else calibrating
    marks = written(marks.withColumn("apart", apart), "toxicity-labels")
    there = {(row.kind, row.apart): row.n for row in marks.groupBy("kind", "apart").agg(F.count("*").alias("n")).collect()}
    kinds = {kind for kind, _ in there}
    if len(kinds) < 2:
        return Model([], ([], []), constant=float(TOXIC in kinds))
    rid, kind, fold = fresh(documents.columns, "labelled", "kind", "apart")
    marked = marks.select(F.col("labelled").alias(rid), F.col("kind").alias(kind), F.col("apart").alias(fold))

    def texts(of: DataFrame) -> DataFrame:
        return documents.join(of, F.col(key) == F.col(rid)).select(text, kind, fold)

    if sum(there.values()) <= BROADCAST_LABELS:
        labelled = lambda which: texts(F.broadcast(marked if which is None else marked.where(F.col(fold) == F.lit(which))))
    else:
        joined = written(texts(marked), "toxicity-labelled")
        labelled = lambda which: joined if which is None else joined.where(F.col(fold) == F.lit(which))

    def fold_of(which: bool) -> bool | None:
        """The labels of one side, None (all) if it lacks a class."""
        return which if all((k, which) in there for k in kinds) else None

    own, held = fold_of(False), fold_of(True)
    shared = shared_counts(documents, text)
    model = _model(shared, written(class_counts(labelled(own), text, kind), "toxicity-counts"))
    weights = _logistic(_measured(model, labelled(own if held is None else held), text, kind))
    return model if weights is None else replace(model, weights=weights)


def _in_blocks(model: Model, rows: DataFrame, text: str, rid: str) -> DataFrame:
    """(rid, ratio, symbols) of written rows: a pass over their texts for each block, whose terms are added in order."""
    def summing(shipped: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[str, float] = {}
            for batch in slices(batches, TEXTS):
                ratio, symbols = _ratios_of(shipped.value, batch.column(0).to_pylist(), cache)
                yield pa.record_batch({"rid": batch.column(1), "ratio": pa.array(ratio), "symbols": as_long(symbols)})

        return run

    parts = None
    for i, block in enumerate(model.blocks()):
        shipped = rows.sparkSession.sparkContext.broadcast(block)
        part = rows.select(text, rid).mapInArrow(summing(shipped), "rid long, ratio double, symbols long")
        part = written(part.select("rid", F.struct(F.lit(i).alias("block"), "ratio").alias("term"), "symbols"), "toxicity-terms")
        parts = part if parts is None else parts.unionByName(part)
        shipped.unpersist()
    total = F.aggregate(F.sort_array(F.collect_list("term")), F.lit(0.0), lambda sum, term: sum + term["ratio"])
    return parts.groupBy("rid").agg(total.alias("ratio"), F.max("symbols").alias("symbols"))


def _measured(model: Model, rows: DataFrame, text: str, kind: str) -> DataFrame:
    """(ratio, symbols, kind) of each row, written."""
    if model.further:
        rid, = fresh(rows.columns, "x_row")
        rows = numbered(rows.select(text, kind), rid, "toxicity-held")
        sums = _in_blocks(model, rows, text, rid)
        found = rows.join(sums, F.col(rid) == sums["rid"]).select("ratio", "symbols", F.col(kind).cast("long").alias("kind"))
        return written(found, "toxicity-measured")
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in slices(batches, TEXTS):
            ratio, symbols = _ratios_of(shipped.value, batch.column(0).to_pylist(), cache)
            yield pa.record_batch({"ratio": pa.array(ratio), "symbols": as_long(symbols), "kind": batch.column(1).cast(pa.int64())})

    return written(rows.select(text, kind).mapInArrow(run, "ratio double, symbols long, kind long"), "toxicity-measured")


def with_scores(documents: DataFrame, model: Model, text: str = "text", score: str = "score", keep_text: bool = True) -> DataFrame:
    """``documents`` with the probability of being toxic, in place of a column of that name; no shuffle if the model is one block."""
    if model.further:
        return _scored_in_blocks(documents, model, text, score, keep_text)
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    copy, = fresh([*documents.columns, score], "x_text")
    rows = documents.select(*(c for c in documents.columns if c != score and (keep_text or c != text)), F.col(text).alias(copy))
    kept = len(rows.columns) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in slices(batches, TEXTS):
            ratio, symbols = _ratios_of(shipped.value, batch.column(kept).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(shipped.value.score(ratio, symbols))], [*batch.schema.names[:kept], score])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:kept], T.StructField(score, T.DoubleType())]))


def _scored_in_blocks(documents: DataFrame, model: Model, text: str, score: str, keep_text: bool) -> DataFrame:
    rid, other, own = fresh([*documents.columns, score], "x_row", "x_other", "x_score")
    rows = numbered(documents, rid, "toxicity-rows")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"rid": batch.column(0), "score": pa.array(fit.score(batch.column(1).to_numpy(), batch.column(2).to_numpy()))})

    fit = Model([], ([], []), model.weights, model.constant)
    found = _in_blocks(model, rows, text, rid).mapInArrow(run, "rid long, score double").select(F.col("rid").alias(other), F.col("score").alias(own))
    kept = [c for c in documents.columns if c != score and (keep_text or c != text)]
    return rows.join(found, F.col(rid) == F.col(other)).select(*kept, F.col(own).alias(score))
