import random

import numpy as np
import pyarrow as pa

from skyledger.llm import passage_dedup as P
from skyledger.llm.word_arrays import Words


def words(draw, count):
    return [f"w{draw.randrange(5000)}" for _ in range(count)]


def copies(docs=40):
    """Pairs of documents that hold the same 300 words."""
    draw, rows = random.Random(5), []
    for key in range(0, docs, 2):
        passage = words(draw, 300)
        rows += [(key + i, " ".join(words(draw, 30) + passage + words(draw, 30))) for i in range(2)]
    return rows


def test_paragraphs_that_only_overlap_make_no_candidates(documents, monkeypatch):
    """Runs of a copied stretch share n-grams with the next ones; most of these pairs can't be similar."""
    tables, written = {}, P.written

    def kept(df, label, *more):
        tables[label] = written(df, label, *more)
        return tables[label]

    monkeypatch.setattr(P, "written", kept)
    rows = copies()
    found = P.passages(documents(rows)).collect()
    assert {r.doc_id for r in found} == {key for key, _ in rows}
    assert tables["passage-candidates"].where("x <> y").select("x", "y").distinct().count() <= 3 * len(rows)  # the texts are lines of one size each


def test_full_filters_change_no_result(documents, monkeypatch):
    docs = documents(copies())
    key = lambda r: (r.doc_id, r.start, r.end, r.cluster, r.removed)
    wanted = sorted(map(key, P.passages(docs).collect()))
    monkeypatch.setattr(P, "MOST_BITS", 7)
    assert sorted(map(key, P.passages(docs).collect())) == wanted


def test_parts_of_a_bucket_are_the_components_of_what_may_be_similar(monkeypatch):
    draw = np.random.default_rng(3)
    size = draw.integers(4, 40, 300)
    bucket = np.sort(draw.integers(0, 4, 300))
    order = np.lexsort((size, bucket))
    bucket, size = bucket[order], size[order]
    own = size - draw.integers(0, 3, 300)
    sketch = np.array([sum(1 << int(b) for b in set(draw.integers(0, 8 if i % 3 else 64, n).tolist())) for i, n in enumerate(own)], np.uint64)

    def alike(i, j):
        shared = min(int(own[i]) - (int(sketch[i]) & ~int(sketch[j])).bit_count(), int(own[j]) - (int(sketch[j]) & ~int(sketch[i])).bit_count())
        return bucket[i] == bucket[j] and 7 * shared >= 3 * int(size[i] + size[j])

    part = list(range(300))
    for i in range(300):
        for j in range(i):
            if alike(i, j) and part[i] != part[j]:
                part = [part[j] if x == part[i] else x for x in part]
    for most in (1, 64, 1000):
        monkeypatch.setattr(P, "MOST_PAIRED", most)
        label = P.similar_parts(bucket, size, own, sketch, (3, 4))
        assert len(set(zip(label.tolist(), part))) == len(set(part)) == len(set(label.tolist())) < 300


def test_words_are_split_and_hashed_as_one_by_one():
    texts = ["", " x", "A b \U0001f600c\x0bd\n", "", "same", "same " + "y" * 65 + " " + "y" * 64 + " z\n\nsame", "A\x00 a a\x00\x00", "éÉ  "]
    column, seen = pa.array(texts), {}
    for part in (column, column.slice(2, 4), column.slice(0, 1), column.slice(0, 0), column.cast(pa.large_string())):
        found, at = Words(part), 0
        starts, stops = found.spans()
        for text, count in zip(part.to_pylist(), found.counts.tolist()):
            plain = text.encode().lower().split()
            assert len(plain) == count
            for k, word in enumerate(plain, at):
                assert text[starts[k]:stops[k]].encode().lower() == word
                assert seen.setdefault(word, found.hashes[k]) == found.hashes[k]
            at += count
        assert at == len(found.hashes)
    assert len({int(h) for h in seen.values()}) == len(seen)
