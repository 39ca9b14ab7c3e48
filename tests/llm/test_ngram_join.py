import random

import pytest

from skyledger.llm import ngram_join as J


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """n_shingles and component of every row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    least = lambda i: min((k for k in groups[find(i)] if k is not None), default=None)
    return sorted(((k, len(sets[i]), least(i)) for i, (k, _) in enumerate(rows)), key=str)


def texts(draw, count):
    """Families of edited copies, some with a passage that most texts share."""
    word = lambda: f"w{draw.randrange(3000)}"
    shared = [word() for _ in range(60)]
    rows, key = [], 0
    while len(rows) < count:
        base = [word() for _ in range(draw.randint(3, 120))]
        if draw.random() < 0.5:
            base += shared
        for _ in range(draw.choice((1, 1, 1, 3, 12))):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(copy) // 40))):
                copy[draw.randrange(len(copy))] = word()
            rows.append((key, " ".join(copy)))
            key += draw.randint(1, 3)
    return rows


def answer(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(documents, seed, monkeypatch):
    monkeypatch.setattr(J.frequent_ngrams, "__defaults__", (6, 4_000_000))  # so that some n-grams are frequent here
    rows = texts(random.Random(seed), 220)
    assert answer(J.join(documents(rows))) == brute(rows)


def test_large_groups_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_NGRAMS", 400)
    monkeypatch.setattr(J, "_SUB_ROWS", 5)
    monkeypatch.setattr(J, "MOST_SENT", 0)
    rows = texts(random.Random(5), 120)
    whole = J.join(documents(rows))
    assert answer(whole) == brute(rows)
    sets = dict(rows)
    links = {r.doc_id: r.n_links for r in whole.collect()}
    distinct = {frozenset(shingles(t)) for t in sets.values()}
    for key, text in sets.items():
        mine = shingles(text)
        assert links[key] == sum(frozenset(mine) != o and 100 * len(mine & o) >= 75 * len(mine | o) for o in distinct)


def test_defined_cases(documents, clashing):
    long = " ".join(f"x{i % 977}y{i}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, long), (8, long + " tail"), (9, "one two three four five six"), (9, "one two three four five six"), (None, "ONE two three four five six"), (None, None)]
    assert answer(J.join(documents(rows))) == brute(rows)
    docs = clashing(documents(rows))
    kept = J.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 9, None], key=str)


def test_empty_table(documents):
    none = documents([(1, "x")]).limit(0)
    assert J.join(none).count() == 0 and J.one_per_component(none).count() == 0
