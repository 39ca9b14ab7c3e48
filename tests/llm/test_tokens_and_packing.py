import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skyledger.llm import packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "b", "the", "The", "'s", "'", "1", "23", ".", "!!", "<|endoftext|>", "<|startoftext|>", "é", "e", "\u0301", "\u00a0", "\x1c", "\x85",
         "😀", "ß", "中", "||", "I'll", " \n", "\u2003", "٣", "²", "ª", "_", "Σ", "ς", "İ", "K", "\0", "secret", "Ä"]


@pytest.fixture(scope="module")
def strings():
    draw = random.Random(11)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(4000)]


def test_counts_are_those_of_the_library(strings):
    tokenizer, counter = Tokenizer.from_file(BYTES), token_counts.PairMerger(BYTES)
    for text in strings:
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_ids_are_those_of_the_library(strings):
    tokenizer, encoder = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS, entries=500)
    for text in strings:
        assert b"".join(encoder.pieces(text)) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_counts_of_a_table(documents, clashing):
    rows = [(1, None), (2, ""), (None, "Two words"), (4, "w" * 100_000), (5, "the cat " * 40_000), (6, "one"), (6, "one")]
    tokenizer = Tokenizer.from_file(BYTES)
    found = token_counts.count_tokens(clashing(documents(rows)), BYTES, limit=1024).collect()
    expected = [(k, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=str) == sorted(expected, key=str)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in found)
    assert token_counts.count_tokens(documents(rows).limit(0), BYTES, 1024).count() == 0


def test_best_fit_takes_the_tightest_sequence():
    draw = random.Random(2)
    for _ in range(300):
        capacity = draw.choice([1, 8, 16, 31, 32, 100])
        lengths = sorted((draw.randint(1, capacity) for _ in range(draw.randint(0, 60))), reverse=True)
        left = {}
        for length, sequence, offset in zip(lengths, *packing.best_fit(lengths, capacity)):
            before = left.get(sequence, capacity)
            fitting = [x for x in left.values() if x >= length]
            assert offset == capacity - before and before == (min(fitting) if fitting else capacity)
            left[sequence] = before - length


def test_packing_holds_every_id_once(llm, documents, clashing):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["token", "words", "Übung", "x1"]) for _ in range(draw.randint(0, 120)))) for i in range(150)]
    rows += [(None, None), (500, ""), (501, "long " * 20_000), (7, "again"), (7, "again")]
    tokenizer = Tokenizer.from_file(WORDS)
    ids = [(k, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for k, t in rows]
    pieces = packing.cut(clashing(documents(rows)), WORDS, 64, ids=True)
    packed = packing.pack(pieces, 64, group_rows=40)
    found = packed.collect()
    covered = {}
    for r in found:
        assert r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32
        covered.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for key, whole in ids:
        copies = sum(k == key and len(w) == len(whole) for k, w in ids)
        parts = sorted(covered[key, len(whole)])
        assert b"".join(p for i, (_, p) in enumerate(parts) if i % copies == 0) == whole.tobytes()
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(len(w) for _, w in ids) / (64 * len(by)) > 0.9
    sequences = {r.sequence_id: r.ids for r in packing.sequences(packed, 64).collect()}
    assert set(sequences) == set(by) and all(len(s) == 64 for s in sequences.values())
    for r in found:
        assert sequences[r.sequence_id][r.offset:r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()


def test_packing_nothing(documents):
    assert packing.pack(packing.cut(documents([(1, "x")]).limit(0), WORDS, 64), 64).count() == 0


def test_words_of_letters_are_cut_apart_where_words_end():
    encoder = packing.WordEncoder(WORDS, entries=50)
    words = ["rain", "a", "élan", "straße", "ªº", "µ", "ÿ", "zzxxqqyy", "thereraneation"]
    assert encoder._encode_letters(words) == [encoder.encode(w) for w in words]
    encoder.ends[:] = False  # a vocabulary that doesn't mark the ends
    assert encoder._encode_letters(words) == [encoder.encode(w) for w in words]
    texts = ["Rain, rain! RAIN 3.5 ÉLAN élan… <|endoftext|> don't Straße-straße ǅ Σ", " ".join(f"w{i} {'ab' * (i % 9)}" for i in range(300))] * 2
    for text in texts:
        assert b"".join(encoder.pieces(text)) == encoder.encode(text)
