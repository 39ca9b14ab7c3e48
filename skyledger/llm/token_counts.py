"""Exact token counts of byte-pair encodings, without producing identifiers.

A text is cut at the vocabulary's special strings, then by the pattern of byte-level
encodings; each piece starts as a linked list of byte symbols, and a heap gives the
adjacent pair of lowest rank (leftmost first) until none is left. The count of a piece is
its symbols minus its merges. Counts of short chunks are kept in a bounded cache, which
saves time only.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and null
keys are ordinary rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from skyledger.llm.common import BoundedCache, as_long, slices, text_of

#: Fixed value: the published split pattern of byte-level encodings.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A space next to other white space, or at the end: there chunks may not be cut at spaces.
_UNEVEN = regex.compile(r" \p{White_Space}|\p{White_Space} | \Z")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for every byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class PairMerger:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        assert model["type"] == "BPE" and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        assert not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
        symbol: dict[str, int] = {}
        number = lambda s: symbol.setdefault(s, len(symbol))
        self.first = [number(letter) for letter in _byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[number(left), number(right)] = (rank, number(left + right))
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PATTERN)
        self.pieces = BoundedCache(lambda piece: self.merged(piece.encode()), entries=400_000)  # small numbers; the dearest to compute
        self.at_start = BoundedCache(self._by_pattern)
        self.after_space = BoundedCache(lambda chunk: self._by_pattern(" " + chunk))

    def merged(self, piece: bytes) -> int:
        """Initial symbols minus merges."""
        merges, symbols = self.merges, [self.first[b] for b in piece]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, found[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := merges.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        count = n
        while heap:
            _, i, new, left, right = heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two went into another merge
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if found := merges.get((new, symbols[k])):
                    heappush(heap, (found[0], i, found[1], new, symbols[k]))
            if (h := before[i]) >= 0 and (found := merges.get((symbols[h], new))):
                heappush(heap, (found[0], h, found[1], symbols[h], new))
        return count

    def _by_pattern(self, text: str) -> int:
        return sum(self.pieces[m[0]] for m in self.split.finditer(text))

    def _ordinary(self, text: str) -> int:
        if not text:
            return 0
        if _UNEVEN.search(text):
            return self._by_pattern(text)
        chunks = text.split(" ")
        return self.at_start[chunks[0]] + sum(map(self.after_space.__getitem__, chunks[1:]))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        ordinary = self.special.split(text)
        return len(ordinary) - 1 + sum(map(self._ordinary, ordinary))


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, bytes, tokens, and whether the tokens exceed ``limit``; no shuffle.

    ``vocabulary`` is a file that every executor has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(vocabulary)
        for batch in slices(batches):
            texts = batch.column(1)
            counts = [counter.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), as_long(counts)], [key, "n_bytes", "n_tokens"])

    rows = docs.select(key, text_of(text).alias("x_text"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"))
    schema = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
