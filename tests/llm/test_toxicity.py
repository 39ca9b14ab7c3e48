import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyledger.llm import queries, toxicity as X
from skyledger.llm.common import table

SF = "/root/testdata/sf0.01"


def symbols(word):
    return [X.BEGIN, *((ord(c) if ord(c) < 128 else 128 + ord(c) % 128) for c in word), X.END]


def estimate(counts):
    """Interpolated Kneser-Ney from a dict of n-gram -> count: gram, lower -> probability."""
    of = [max(1, sum(c == i for c in counts.values())) for i in (1, 2, 3, 4)]
    share = of[0] / (of[0] + 2 * of[1])
    d = [0.0] + [min(max(i - (i + 1) * share * of[i] / of[i - 1], 0.1 * i), 0.99 * i) for i in (1, 2, 3)]
    total, back = Counter(), defaultdict(float)
    for gram, c in counts.items():
        total[gram[:-1]] += c
        back[gram[:-1]] += d[min(c, 3)]

    def p(gram, lower):
        h = gram[:-1]
        if h not in total:
            return lower
        c = counts.get(gram, 0)
        return (c - d[min(c, 3)] if c else 0.0) / total[h] + back[h] / total[h] * lower

    return p


def plain_model(corpus, toxic, ordinary):
    """The same models with dicts and tuples of symbols."""
    grams = lambda word, n: [tuple(s[i - n + 1:i + 1]) for s in [symbols(word)] for i in range(max(1, n - 1), len(s))]
    shared = [estimate(Counter(g for w in {w for t in corpus for w in X.words_of(t)} for g in grams(w, n))) for n in range(1, X.SHARED + 1)]

    def of_class(texts):
        words = Counter(w for t in texts for w in X.words_of(t))
        found = {X.ORDER: Counter()}
        for w, c in words.items():
            for g in grams(w, X.ORDER):
                found[X.ORDER][g] += c
        for n in range(X.ORDER - 1, 1, -1):
            found[n] = Counter()
            for w, c in words.items():
                if len(symbols(w)) >= n:
                    found[n][tuple(symbols(w)[:n])] += c
            if n > X.SHARED:
                for g in found[n + 1]:
                    found[n][g[1:]] += 1
        return {n: estimate(c) for n, c in found.items()}

    classes = [of_class(ordinary), of_class(toxic)]

    def ratio(word):
        s, out = symbols(word), 0.0
        for i in range(1, len(s)):
            base = 1 / 256
            for n in range(1, min(X.SHARED, i + 1) + 1):
                base = shared[n - 1](tuple(s[i - n + 1:i + 1]), base)
            logs = []
            for levels in classes:
                p = base
                for n in range(2, min(X.ORDER, i + 1) + 1):
                    gram = tuple(s[i - n + 1:i + 1])
                    if n > X.SHARED or gram[0] == X.BEGIN:
                        p = levels[n](gram, p)
                logs.append(math.log(p))
            out += logs[1] - logs[0]
        return out

    return ratio


TOXIC = ["you idiot, stupid scum", "what a stupid idiotic thing", "scum and idiots über alles"]
FINE = ["what a nice thing", "you and the other people", "the people of the town", "über den wolken"]


def learned(documents, llm, docs, marks, **options):
    return X.learn(documents(docs), llm.createDataFrame(marks, "doc_id long, toxic int"), **options)


def test_models_equal_plain_dicts(documents, llm, monkeypatch):
    docs = list(enumerate(TOXIC + FINE + ["unlabelled words about idle stupor"]))
    marks = [(i, int(i < 3)) for i in range(7)]
    from pyspark.sql import functions as F

    model = learned(documents, llm, docs, marks, calibrating=F.lit(False))
    plain = plain_model([t for _, t in docs], TOXIC, FINE)
    words = ["idiot", "idiots", "stupid", "nice", "über", "a", "z" * 40, "unlabelled", "日本語"]
    assert np.allclose(model.of_words(words), [plain(w) for w in words], rtol=1e-4, atol=1e-4)
    whole = model.of_words(words)
    monkeypatch.setattr(X, "PIECE", 7)  # long words in overlapping pieces
    assert np.allclose(model.of_words(words), whole)


def test_counts_in_pieces_are_the_same(documents, llm, monkeypatch):
    docs = documents([(i, t) for i, t in enumerate([*TOXIC, *FINE, "x" * 50 + "yz"])])
    once = {k: dict(zip(*(a.tolist() for a in X.shared_counts(docs)))) for k in (0,)}
    monkeypatch.setattr(X, "PIECE", 9)
    monkeypatch.setattr(X, "SET_WORDS", 2)
    assert dict(zip(*(a.tolist() for a in X.shared_counts(docs)))) == once[0]


def test_rows_are_halved_until_the_tables_fit(documents, llm, monkeypatch):
    docs = [(i, f"{t} {'abcdefgh'[i % 8] * (i % 5 + 1)}") for i, t in enumerate((TOXIC + FINE) * 8)]
    marks = [(i, int("scum" in t or "idiot" in t)) for i, t in docs]
    monkeypatch.setattr(X, "MOST_ENTRIES", 200)
    model = learned(documents, llm, docs, marks)
    assert 0 < sum(len(level.keys) for levels in model.classes for level in levels[-1:]) <= 200


def test_tables_in_blocks_learn_from_every_label(documents, llm, monkeypatch):
    docs = [(i, f"{t} {'abcdefgh'[i % 8] * (i % 5 + 1)}") for i, t in enumerate((TOXIC + FINE) * 8)]
    marks = [(i, int("scum" in t or "idiot" in t)) for i, t in docs]
    words = ["idiot", "idiots", "stupid", "nice", "über", "a", "cccc", "z" * 40, "日本語"]

    def found():
        model = learned(documents, llm, docs, marks)
        rows = X.with_scores(documents([*docs, (90, None)]), model, keep_text=False).collect()
        return len(model.further), model.of_words(words), [*model.weights, *(r.score for r in sorted(rows, key=lambda r: r.doc_id))]

    none, ratios, scores = found()
    monkeypatch.setattr(X, "MOST_ENTRIES", 200)
    monkeypatch.setattr(X, "BROADCAST_LABELS", 0)
    further, in_blocks, scored = found()
    assert none == 0 and further > 0
    assert np.allclose(in_blocks, ratios, rtol=1e-5, atol=1e-5) and np.allclose(scored, scores, rtol=1e-4, atol=1e-5)


def test_class_counts_sent_on_in_parts_are_the_same(documents, llm, monkeypatch):
    rows = llm.createDataFrame([(t, int(t in TOXIC)) for t in [*TOXIC, *FINE, None, "x" * 50] * 3], "text string, kind int").coalesce(1)
    whole = sorted(tuple(r) for r in X.class_counts(rows, "text", "kind").collect())
    monkeypatch.setattr(X, "TEXTS", 2)
    monkeypatch.setattr(X, "SET_SYMBOLS", 30)
    assert sorted(tuple(r) for r in X.class_counts(rows, "text", "kind").collect()) == whole


def test_defined_cases(documents, llm, clashing):
    docs = [*((i, t) for i, t in enumerate(TOXIC * 6 + FINE * 6)), (90, None), (91, ""), (92, "12 !!"), (93, "long " * 100_000), (94, "w" * 600_000), (94, "w" * 600_000), (None, "idiot")]
    marks = [*((i, int(i < 18)) for i in range(42)), (0, 0), (1, None), (90, 0), (91, 1), (None, 1), (999, 1), (20, None)]
    model = learned(documents, llm, docs, marks)
    rows = clashing(documents(docs)).selectExpr("*", "'own' AS score")
    out = X.with_scores(rows, model)
    assert set(out.columns) == set(rows.columns)
    found = out.collect()
    scores = {r.doc_id: r.score for r in found}
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found) and scores[90] == scores[91] == scores[92]
    assert scores[0] > 0.5 > scores[18] and scores[None] > 0.5
    assert "text" not in X.with_scores(rows, model, keep_text=False).columns
    empty = documents([])
    assert X.with_scores(empty, model).count() == 0
    for marks, value in (([], 0.0), ([(1, 1)], 1.0), ([(20, 0)], 0.0)):
        alone = learned(documents, llm, docs, marks)
        assert {r.score for r in X.with_scores(documents(docs[:3]), alone).collect()} == {value}
    assert learned(documents, llm, [], [(1, 1), (2, 0)]).of_words(["a"]).tolist() == [0.0]


def test_held_out_accuracy(llm):
    """Stems that are toxic in one of two made-up languages, inflected in ways the labels never show."""
    draw = np.random.Generator(np.random.PCG64(7))
    syllables = [["ka", "lo", "mi", "ter", "an", "es"], ["zu", "der", "och", "lin", "ei", "ver"]]
    bad = ["grut", "plovik"]
    docs, marks = [], []
    for i in range(1200):
        lang, toxic = i % 2, int(i // 2 % 5 == 0)
        words = ["".join(draw.choice(syllables[lang], draw.integers(1, 4))) for _ in range(60)]
        if toxic:
            words[:3] = [bad[lang] + "".join(draw.choice(syllables[lang], draw.integers(0, 3))) for _ in range(3)]
        docs.append((i, " ".join(words)))
        marks.append((i, toxic))
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    frame = llm.createDataFrame(docs, "doc_id long, text string")
    model = X.learn(frame, llm.createDataFrame([m for m in marks if m[0] not in held], "doc_id long, toxic int"))
    scores = {r.doc_id: r.score for r in X.with_scores(frame, model).collect()}
    right = [(scores[i] >= 0.3) == bool(t) for i, t in marks if i in held]
    caught = [scores[i] >= 0.3 for i, t in marks if i in held and t]
    assert np.mean(right) > 0.95 and np.mean(caught) > 0.9


@pytest.fixture(scope="module")
def result(llm):
    return queries.registered()["op12_toxicity"](llm, SF).toPandas()


def test_registered_query(llm, result):
    docs = table(llm, SF, "documents", "doc_id", "text").toPandas()
    assert sorted(result.doc_id) == sorted(docs.doc_id) and list(result.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert ((result.score >= 0) & (result.score <= 1)).all() and (result.predicted == (result.score >= 0.3)).all()
    assert (result.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in result.doc_id]).all()
