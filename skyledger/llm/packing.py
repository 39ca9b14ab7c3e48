"""Packing of documents into sequences by best-fit decreasing.

A document is its token ids and one end id. It is first cut into full windows, which are
sequences by themselves; what remains is shorter than a window. Remainders are dealt at
random into groups of bounded size, and each group is packed for itself: pieces from
longest to shortest, each into the open sequence with the least remaining capacity that
still holds it. A segment tree over the capacities finds that sequence.

Only lengths and checksums are shuffled, never texts or ids. The groups bound the memory
of a task; each wastes at most a few open sequences, which is the price of packing in
parallel.

Defined cases: a null or empty text is the end id alone; very long texts are tokenized
piece by piece; repeated rows and null keys are packed like any others; an empty table
gives an empty result. White space never joins tokens in this vocabulary, so words are
encoded one by one and kept in a bounded cache.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skyledger.llm.common import as_long, slices, tasks_for, text_of, word_lists, written

GROUP_ROWS = 50_000  # remainders that one task packs
END_ID = 1


class WordEncoder:
    """Ids (little-endian unsigned 32-bit) of texts under a vocabulary that drops white space.

    Words that are not known yet are encoded together. Their ids are cut apart again after the ids that end a
    word where every word is one run of letters, else at a special string between them.
    """

    def __init__(self, path: str, entries: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for each in (self.tokenizer, self.letters):
            each.no_truncation()
            each.no_padding()
        # lower-case letters up to U+00FF are what normalization gives, and one run of the pattern
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark, self.mark_id = next((t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()))
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.entries, self.words, self.old_words = entries, {}, {}  # the last: what was known when the cache was last full

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_all(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, "<u4")
        raw, ends = ids.tobytes(), [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
        return [raw[4 * begin:4 * end] for begin, end in zip([0, *(e + 1 for e in ends[:-1])], ends)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """The ids of words of lower-case letters up to U+00FF."""
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(ends) != len(words) or ends[-1] != len(raw):
            return self._encode_all(words)  # the vocabulary doesn't tell where words end
        return [raw[begin:end] for begin, end in zip([0, *ends], ends)]

    @staticmethod
    def _parts(text: str) -> tuple[str, str]:
        """Words of Latin letters share their entry with other cases, and with the marks after them.

        Up to U+00FF lower case is one letter for one and nothing composes, and a run of
        marks after a letter or digit is never part of the same token.
        """
        if not text.isascii() and max(text) >= "\u0100" or "<|" in text:
            return text, ""
        low = text.lower()
        stem = low.rstrip(punctuation)
        return (stem, low[len(stem):]) if stem and stem[-1].isalnum() else (low, "")

    def _encoded(self, words: set[str]) -> dict[str, bytes]:
        found = {"": b""}
        letters = [w for w in words if w.isalpha() and (w.isascii() or max(w) < "\u0100") and w == w.lower()]
        found.update(zip(letters, self._encode_letters(letters)) if letters else ())
        others = [w for w in words.difference(found) if "<|" not in w]
        found.update(zip(others, self._encode_all(others)) if others else ())
        found.update((w, self.encode(w)) for w in words.difference(found))
        return found

    def learn(self, words: set[bytes]) -> None:
        missing = words.difference(self.words)
        if len(self.words) + len(missing) > self.entries:
            self.old_words, self.words, missing = self.words, {}, set(words)
        if self.old_words:
            again = {word: self.old_words[word] for word in missing if word in self.old_words}
            self.words.update(again)
            missing = missing.difference(again)
        if not missing:
            return
        names = list(missing)
        stems, marks = zip(*map(self._parts, b"\n".join(names).decode("utf-8", "surrogatepass").split("\n")))
        found = self._encoded({*stems, *marks})
        ids = [found[stem] + found[rest] if rest else found[stem] for stem, rest in zip(stems, marks)]
        self.words.update(zip(names, ids))

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, in parts."""
        for words in word_lists(text.encode("utf-8", "surrogatepass")):
            self.learn(set(words))
            yield b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def windows(parts: Iterator[bytes], capacity: int) -> Iterator[bytes]:
    """Ids cut into full windows and a last one that is not empty and may be shorter."""
    rest, size = b"", 4 * capacity
    for part in parts:
        rest += part
        cut = len(rest) - len(rest) % size
        for begin in range(0, cut, size):
            yield rest[begin:begin + size]
        rest = rest[cut:]
    if rest:
        yield rest


class CapacityTree:
    """Which remaining capacities have an open sequence: the least one of at least ``n`` in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)  # open sequences below each node
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += n
            node >>= 1

    def put(self, capacity: int, sequence: int) -> None:
        self.stacks[capacity].append(sequence)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The open sequence of the smallest capacity that is at least ``least``."""
        node = self.leaves + least
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.stacks[capacity].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of every piece; the pieces come longest first."""
    tree, sequences, offsets, opened = CapacityTree(capacity), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        left, sequence = found
        sequences.append(sequence)
        offsets.append(capacity - left)
        if left > length:
            tree.put(left - length, sequence)
    return sequences, offsets


def cut(docs: DataFrame, vocabulary: str, capacity: int, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """A row per window of every document: start, length, checksum, tokens of the document, and the ids if asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, end, number = encoder(vocabulary), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            rows, starts, lengths, sums, totals, kept = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                start = 0

                def all_parts(t=t):
                    yield from words.pieces(t.as_py())
                    yield end

                for window in windows(all_parts(), capacity):
                    rows.append(i)
                    starts.append(start)
                    lengths.append(len(window) // 4)
                    sums.append(zlib.crc32(window))
                    kept.append(window if ids else None)
                    start += lengths[-1]
                totals += [start] * (len(rows) - len(totals))
            numbers = range(number, number + len(rows))
            number += len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *map(as_long, (starts, lengths, sums, totals, numbers)), pa.array(kept, pa.binary())],
                [key, "start", "length", "ids_crc32", "doc_tokens", "piece", "ids"])

    rows = docs.select(key, text_of(text).alias("x_text"))
    longs = [T.StructField(name, T.LongType()) for name in ("start", "length", "ids_crc32", "doc_tokens", "piece")]
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *longs, T.StructField("ids", T.BinaryType())]))


def pack(pieces: DataFrame, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with the sequence and the offset of each.

    Full windows are numbered by themselves (even ids), packed sequences by group and
    place in the group (odd ids). The piece number decides the group, so the result does
    not depend on which task or attempt packs it.
    """
    pieces = written(pieces, "pieces")
    full = pieces.where(F.col("length") == capacity).select("*", (2 * F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = tasks_for(rest, group_rows)
    light = rest.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    schema = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = table.drop_columns(["group"]).sort_by([("length", "descending"), ("piece", "ascending")])
        sequences, offsets = best_fit(table.column("length").to_pylist(), capacity)
        numbers = 2 * (np.array(sequences, np.int64) * groups + group) + 1
        return table.append_column("sequence_id", as_long(numbers)).append_column("offset", as_long(offsets))

    return full.unionByName(light.groupBy("group").applyInArrow(run, schema))


def sequences(packed: DataFrame, capacity: int, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from packed pieces with ids: ids of one sequence in order, padded to ``capacity``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                out.append(np.concatenate([ids, np.full(capacity - len(ids), pad_id, "<u4")]).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.mapInArrow(run, "sequence_id long, ids array<long>")
