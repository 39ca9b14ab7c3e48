import os
import random
import re

import numpy as np
import pytest

from skyledger.llm import passage_dedup as P


def words(draw, count):
    return [f"w{draw.randrange(5000)}" for _ in range(count)]


def corpus(seed, docs=120):
    """Texts of own words; some hold one of three passages, in the middle of other words."""
    draw = random.Random(seed)
    shared = [words(draw, 52), words(draw, 80), words(draw, 120)]
    rows, held = [], {}
    for key in range(docs):
        text = words(draw, draw.randint(0, 300))
        if key % 3 == 0:
            which, at = (key // 3) % 3, draw.randint(0, len(text))
            text[at:at] = shared[which]
            held[key] = which
        rows.append((key, " ".join(text).replace(" w1", "\n w1")))
    return rows, held, shared


def spans(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.start, r.end, r.removed))
    return out


@pytest.mark.parametrize("frequent", [32, 5])
def test_passages_of_fifty_words_are_found_and_others_left_alone(documents, monkeypatch, frequent):
    monkeypatch.setattr(P.frequent_ngrams, "__defaults__", (frequent, 4_000_000))
    rows, held, shared = corpus(3)
    found = spans(P.passages(documents(rows)))
    assert set(found) == set(held)
    firsts = {which: min(k for k, w in held.items() if w == which) for which in range(3)}
    for key, which in held.items():
        assert any(removed == (firsts[which] != key) for _, _, removed in found[key])
        for start, end, _ in found[key]:  # paragraphs at its borders may hold a few other words
            assert sum(w not in shared[which] for w in dict(rows)[key][start:end].split()) <= 8


def test_edited_passages_reach_the_recall(documents):
    draw = random.Random(8)
    rows = []
    for key in range(0, 400, 2):
        passage = words(draw, 80)
        edited = list(passage)
        edited[draw.randrange(80)] = "changed"
        rows += [(key, " ".join(words(draw, 40) + passage + words(draw, 40))), (key + 1, " ".join(words(draw, 40) + edited + words(draw, 40)))]
    found = spans(P.passages(documents(rows)))
    assert len(found) >= 0.95 * len(rows)


def test_defined_cases(documents, clashing):
    draw = random.Random(1)
    passage = " ".join(words(draw, 60))
    long = " ".join(f"x{i % 977}y{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "short text"), (4, passage), (4, passage), (None, passage + " tail"), (6, long), (7, "junk " * 500), (8, " ".join(words(draw, 30)) + " " + passage)]
    docs = clashing(documents(rows))
    found = spans(P.passages(docs))
    assert set(found) == {4, None, 8} and all(not removed for _, _, removed in found[None])
    cut = P.without_repeats(docs)
    assert cut.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in cut.collect()]
    assert len(texts) == len(rows) and (1, None) in texts and (6, long) in texts and (7, "junk " * 500) in texts and (None, passage + " tail") in texts
    assert all(passage not in t for k, t in texts if k in (4, 8))
    assert P.passages(docs.limit(0)).count() == 0


def test_repeats_within_one_document_are_found(documents):
    draw = random.Random(21)
    passage, near = words(draw, 60), words(draw, 60)
    changed = [*near[:2], "changed", *near[3:]]
    text = words(draw, 50) + passage + words(draw, 90) + near + passage + words(draw, 40) + changed + passage + words(draw, 30)
    docs = documents([(1, " ".join(text)), (2, " ".join(words(draw, 400))), (3, "same " * 300)])
    found = spans(P.passages(docs))
    assert set(found) == {1}
    assert sum(not removed for _, _, removed in found[1]) == 2 and sum(removed for _, _, removed in found[1]) == 2  # the last two adjoin
    texts = {r.doc_id: r.text for r in P.without_repeats(docs).collect()}
    assert texts[1].count(" ".join(passage)) == 1 and " ".join(changed) not in texts[1] and texts[3] == "same " * 300


def test_the_default_recall_is_the_stated_one():
    for operator in (P.passages, P.without_repeats):
        share, recall = operator.__defaults__[-2:]
        bands, rows = P.tuned(share[0] / share[1], recall)
        assert recall == 0.95 and 1 - (1 - 0.75**rows) ** bands >= 0.95


def test_lines_as_they_stand_reach_the_recall(documents):
    draw, rows, similar = random.Random(13), [], []

    def grams(line):
        return {tuple(line[i:i + 5]) for i in range(len(line) - 4)}

    def among(line):
        return "\n".join(" ".join(x) for x in (words(draw, 30), line, words(draw, 30)))

    for key in range(0, 600, 2):
        line = words(draw, draw.choice((12, 30, 50, 55, 80, 120)))
        edited = list(line)
        for _ in range(len(line) // 40):
            edited[draw.randrange(len(line))] = "changed"
        a, b = grams(line), grams(edited)
        if 4 * len(a & b) >= 3 * len(a | b):
            similar += [key, key + 1]
        rows += [(key, among(line)), (key + 1, among(edited))]
    found = spans(P.passages(documents(rows)))
    assert len(similar) > 400 and sum(key in found for key in similar) >= 0.95 * len(similar)
    left = {r.doc_id: r.text.split() for r in P.without_repeats(documents(rows)).collect()}
    lines = {key: dict(rows)[key].split("\n")[1].split() for key in similar if key % 2}
    assert sum(w in left[key] for key, line in lines.items() for w in line) <= 0.1 * sum(map(len, lines.values()))


def test_every_word_of_an_exact_passage_is_covered(documents):
    draw, rows, held = random.Random(31), [], {}
    for group in range(24):
        passage = words(draw, (47, 52, 60, 80, 120)[group % 5])
        for key in (3 * group, 3 * group + 1, 3 * group + 2):
            rows.append((key, " ".join(words(draw, 70) + passage + words(draw, 70))))
            held[key] = " ".join(passage)
    docs = documents(rows)
    found = spans(P.passages(docs))
    for key, text in rows:
        at, covered = text.index(held[key]), set()
        for start, end, _ in found[key]:
            covered.update(range(start, end))
        assert all(at + m.start() in covered for m in re.finditer(r"\S+", held[key]))


def test_banding_is_tuned():
    for similarity, recall in ((0.75, 0.9), (0.75, 0.95), (0.5, 0.8)):
        bands, rows = P.tuned(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall > 1 - (1 - similarity) ** (bands - 1)


def test_windows_hold_a_start_in_every_stretch():
    draw = random.Random(4)
    text = np.array([draw.randrange(1 << 60) for _ in range(500)], np.uint64)
    starts = P.Paragraphs([text], np.empty(0, np.int64), 28).place
    assert max(np.diff(starts)) <= P.PARAGRAPH and starts[0] < P.PARAGRAPH and starts[-1] > 500 - 2 * P.PARAGRAPH - 1
    moved = P.Paragraphs([np.concatenate([text[:7] + np.uint64(1), text[100:160], text[:9]])], np.empty(0, np.int64), 28)
    own = P.Paragraphs([text], np.empty(0, np.int64), 28)
    assert set(moved.content.tolist()) & set(own.content.tolist())


def test_spans():
    assert P._merged([(5, 9, 3), (0, 4, 7), (12, 15, 1)]) == [(0, 9, 3), (12, 15, 1)]
    assert P._minus([(0, 20, 1), (30, 40, 2)], [(5, 8, 0), (18, 35, 0)]) == [(0, 5, 1), (8, 18, 1), (35, 40, 2)]
    text = " a\u00a0b \U0001f600c\x0bd\n"
    assert [text[s:e] for s, e in zip(*P._word_spans(text))] == ["a\u00a0b", "\U0001f600c", "d"]


def test_open_sides_are_the_words_that_no_paragraph_holds():
    draw, rows = random.Random(17), []
    for row in range(40):
        total = draw.randint(30, 200)
        for _ in range(draw.randint(1, 6)):
            size = draw.choice((5, 9, 24, 24, 30))
            at = draw.randint(0, total - size)
            rows.append((row, at, size, min(total - at - size, 60)))
    left, right = P.open_sides(*(np.array(x, np.int64) for x in zip(*rows)))
    for (row, at, size, room), before, after in zip(rows, left.tolist(), right.tolist()):
        most = max(P.PARAGRAPH - 1, 2 * P.PARAGRAPH - 2 - size)
        held = {w for r, a, n, _ in rows if r == row for w in range(a, a + n)}
        assert before == sum(1 << d for d in range(min(most, at)) if at - 1 - d not in held)
        assert after == sum(1 << d for d in range(min(most, room)) if at + size + d not in held)


def test_working_tables_stay_small(documents, monkeypatch):
    """Copied texts of many paragraphs: rows of paragraphs carry no words along."""
    draw, sizes = random.Random(2), {}
    copied = [" ".join(words(draw, 600)) for _ in range(60)]
    docs = documents([(key, copied[key % 60] + " " + " ".join(words(draw, 60))) for key in range(300)])
    written = P.written

    def weighed(df, label, *more):
        out = written(df, label, *more)
        sizes[label] = sum(os.path.getsize(f.removeprefix("file:")) for f in map(str, out.inputFiles()))
        return out

    monkeypatch.setattr(P, "written", weighed)
    P.passages(docs).count()
    text = docs.agg({"n_chars": "sum"}).first()[0]
    assert sizes["passage-places"] + sizes["passage-judged"] + sizes["passage-ends"] < text, sizes
