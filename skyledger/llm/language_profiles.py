"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. The vector of three letters in a row
is the product of their vectors, permuted (rotated) by the letter's place; the vector of a
text is the sum over its triples, and the prototype of a language the sum over its
labelled texts, each with the same weight. A text gets the language whose prototype has
the largest cosine with it, ties to the smaller name.

Letters are lower-cased; everything else is a gap, and runs of gaps are one. Letters
beyond a to z share ``SLOTS`` - 27 vectors, chosen by a hash.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is every
text when there is no labelled one; rows with a null language teach nothing; repeated
rows count as often as they occur; an empty table gives an empty result. A null key is
treated as an empty string when rows are held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyledger.llm.common import fresh, slices

DIMENSIONS = 1024
SLOTS = 128  # vectors for letters; slot 0 is the gap
GRAM = 3
NOT_KNOWN = "und"
MAX_LANGUAGES = 4096  # prototypes are sent to every task: at most 16 MB
SHARE = 1 << 24
_ROWS = 256
_GRAMS = 8192
_PIECE = 1 << 20


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """The slot of every code point."""
    slots = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        if chr(point).isalpha():
            slots[point] = 27 + (point * 2654435761 >> 7) % (SLOTS - 27)
    slots[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return slots


@lru_cache(maxsize=1)
def _letters() -> list[np.ndarray]:
    """The letters' vectors, rotated for each place of a triple."""
    plain = np.random.Generator(np.random.PCG64(20240601)).integers(0, 2, (SLOTS, DIMENSIONS), dtype=np.int8) * 2 - 1
    return [np.ascontiguousarray(np.roll(plain, GRAM - 1 - place, axis=1)) for place in range(GRAM)]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    first, second, third = _letters()
    return (first[grams // (SLOTS * SLOTS)] * second[grams // SLOTS % SLOTS] * third[grams % SLOTS]).astype(np.float32)


def _collapsed(text: str, before: np.ndarray, last: bool) -> np.ndarray:
    """Slots of the letters and gaps of ``text``, after the slots that came before."""
    slots = _slots()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    slots = np.concatenate([before, slots, np.zeros(1 if last else 0, np.int32)])
    kept = np.ones(len(slots), bool)
    kept[1:] = (slots[1:] != 0) | (slots[:-1] != 0)
    return slots[kept]


def _triples(slots: np.ndarray) -> np.ndarray:
    return (slots[:-2] * SLOTS + slots[1:-1]) * SLOTS + slots[2:]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct triples of a whole text and how often each occurs."""
    gap = np.zeros(1, np.int32)
    if not text:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    if len(text) <= _PIECE:
        return np.unique(_triples(_collapsed(text, gap, True)), return_counts=True)
    total: dict[int, int] = {}
    at, slots = 0, gap
    while at < len(text):  # cut between words, whose lower case may depend on their end
        end = min(at + _PIECE, len(text))
        while end < len(text) and text[end].isalpha() and end < at + 2 * _PIECE:
            end += 1
        slots = _collapsed(text[at:end], slots[-2:], end == len(text))
        for gram, n in zip(*(x.tolist() for x in np.unique(_triples(slots), return_counts=True))):
            total[gram] = total.get(gram, 0) + n
        at = end
    grams = np.array(sorted(total), np.int32)
    return grams, np.array([total[g] for g in grams.tolist()], np.int64)


def bundled(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row for each text: the sum of its triples' vectors divided by the number of triples."""
    out = np.zeros((len(counts), DIMENSIONS), np.float32)
    sizes = [len(g) for g, _ in counts]
    if not sum(sizes):
        return out
    row = np.repeat(np.arange(len(counts)), sizes)
    weight = np.concatenate([n / max(1, n.sum()) for _, n in counts]).astype(np.float32)
    distinct, place = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
    for begin in range(0, len(distinct), _GRAMS):
        block = distinct[begin:begin + _GRAMS]
        inside = (place >= begin) & (place < begin + len(block))
        dense = np.zeros((len(counts), len(block)), np.float32)
        dense[row[inside], place[inside] - begin] = weight[inside]
        out += dense @ gram_vectors(block)
    return out


def held_out(key: str | Column, folds: int = 4, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bundle of each language in a task.

    Shares of a text's triples are whole numbers of 1 / ``SHARE``, so sums are exact and do
    not depend on their order.
    """
    sums: dict[str, dict[int, int]] = {}
    for batch in slices(batches, _ROWS):
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams, counts = gram_counts(text)
            if len(grams):
                found.setdefault(lang, []).append((grams, np.round(counts * (SHARE / counts.sum()))))
        for lang, parts in found.items():
            distinct, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            known = sums.setdefault(lang, {})
            for gram, share in zip(distinct.tolist(), np.bincount(place, np.concatenate([n for _, n in parts])).tolist()):
                known[gram] = known.get(gram, 0) + int(share)
    for lang, known in sums.items():
        vector = np.zeros(DIMENSIONS, np.int64)
        grams = np.array(sorted(known), np.int32)
        shares = np.array([known[g] for g in grams.tolist()], np.int64)
        for begin in range(0, len(grams), _GRAMS):
            vector += shares[begin:begin + _GRAMS] @ gram_vectors(grams[begin:begin + _GRAMS]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(vector)], ["lang", "place", "value"])


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes of the languages of all labelled rows."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = rows.mapInArrow(_teach, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).select("lang", F.col("v.value")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    found = sorted((r[0], r[1]) for r in found)
    vectors = np.array([v for _, v in found], np.float64).reshape(len(found), DIMENSIONS)
    return [name for name, _ in found], (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _judged(texts: list[str | None], names: list[str], prototypes: np.ndarray) -> tuple[list[str], list[float], list[int]]:
    """Language, cosine (0 where negative) and number of letter triples of each text."""
    counts = [gram_counts(t) for t in texts]
    triples = [int(n.sum()) for _, n in counts]
    if not names:
        return [NOT_KNOWN] * len(texts), [0.0] * len(texts), triples
    vectors = bundled(counts)
    cosines = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    best = cosines.argmax(axis=1).tolist()
    langs = [names[b] if n else NOT_KNOWN for b, n in zip(best, triples)]
    return langs, [float(min(1.0, max(0.0, cosines[i, b]))) if n else 0.0 for i, (b, n) in enumerate(zip(best, triples))], triples


def classify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` without the text, with the predicted language and its cosine (0 where negative) in place of columns of these names; no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast((names, prototypes))
    copy, = fresh(docs.columns, "x_text")
    kept = [c for c in docs.columns if c not in (text, prediction, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            at = batch.schema.get_field_index(copy)
            langs, scores, _ = _judged(batch.column(at).to_pylist(), *shipped.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*(n for n in batch.schema.names if n != copy), prediction, score])

    rows = docs.select(*kept, F.col(text).alias(copy))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != copy), T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(run, schema)


def with_language(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", least_score: float = 0.1, sure_triples: int = 200) -> DataFrame:
    """``docs`` without the rows in no known language.

    Those are texts without letters, and texts of at least ``sure_triples`` letter triples
    whose best cosine is below ``least_score``; the cosine of short texts says too little.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _ROWS):
            langs, scores, triples = _judged(batch.column(batch.schema.get_field_index(text)).to_pylist(), *shipped.value)
            yield batch.filter(pa.array([n > 0 and (not known or n < sure_triples or score >= least_score) for score, n in zip(scores, triples)], pa.bool_()))

    known = bool(names)
    return docs.mapInArrow(run, docs.schema)
