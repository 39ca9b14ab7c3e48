import random

import numpy as np
import pytest

from skyledger.llm import decontaminate as D

ITEMS = [(1, " ".join(f"alpha{i}" for i in range(20))), (2, " ".join(f"beta{i}" for i in range(40))), (3, "only three words"), (4, None), (5, "")]


def plain_distance(item, words):
    """Least edit distance of the item to any run of words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        below = [i]
        for j, x in enumerate(words, 1):
            below.append(min(row[j] + 1, below[-1] + 1, row[j - 1] + (w != x)))
        row = below
    return min(row)


@pytest.fixture(scope="module")
def items(llm):
    return llm.createDataFrame(ITEMS, "item_id long, text string")


def test_edit_distance_against_the_plain_one():
    draw = random.Random(1)
    for _ in range(60):
        item = [draw.randint(1, 4) for _ in range(draw.randint(1, 8))]
        words = [draw.randint(0, 4) for _ in range(draw.randint(1, 14))]
        found, _ = D.edit_distances(np.array(item), np.array([words]))
        assert found[0] == plain_distance(item, words)


def test_passages_are_found_and_clean_documents_stay(llm, documents, items, clashing):
    passage, words = ITEMS[0][1], ITEMS[1][1].split()
    edited = " ".join([*words[:5], "strange", *words[6:20], *words[21:]])
    docs = documents([
        (1, f"Some text. {passage.upper()}, and more"), (2, edited), (3, "clean text " * 30), (4, None), (5, ""), (6, passage), (6, passage),
        (None, "before " + passage), (8, ("filler " * 50_000) + passage), (9, " ".join(words[:20])), (10, "only three words")])
    found = {(r.doc_id, r.item_id): (r.edits, r.item_words, r.word_start) for r in D.leaks(docs, items).collect()}
    assert found == {(1, 1): (0, 20, 2), (2, 2): (2, 40, found[2, 2][2]), (6, 1): (0, 20, 0), (None, 1): (0, 20, 1), (8, 1): (0, 20, 50_000), (10, 3): (0, 3, 0)}
    assert D.leaks(docs, items).where("doc_id = 6").count() == 2
    kept = D.clean(clashing(docs), items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 9] and kept.columns == clashing(docs).columns


def test_recall_of_edited_passages_reaches_the_target():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(12, 60)))) for k in range(40)]
    index = D.ItemIndex(items, 0.2, 0.95, 8)
    docs, truth = [], []
    for k, text in items * 4:
        words = text.split()
        for _ in range(int(0.2 * len(words))):
            at = draw.randrange(len(words))
            words[at:at + draw.choice((0, 1))] = draw.choice(([], [draw.choice(vocabulary)]))
        around = [draw.choice(vocabulary) for _ in range(80)]
        docs.append(np.array([index.vocabulary.get(w, 0) for w in around[:40] + words + around[40:]]))
        truth.append((len(docs) - 1, k, plain_distance(text.split(), around[:40] + words + around[40:])))
    found = {(d, k): e for d, k, e, _ in index.matches(docs)}
    near = [(d, k, e) for d, k, e in truth if e <= int(0.2 * len(items[k][1].split()))]
    assert sum(found.get((d, k)) == e for d, k, e in near) >= 0.95 * len(near)
    assert all(e <= 0.2 * len(items[k][1].split()) for (_, k), e in found.items())


@pytest.mark.parametrize("size", [120, 300, 800])
@pytest.mark.parametrize("kind", ["mixed", "deletions", "insertions"])
def test_recall_of_long_items_reaches_the_target(size, kind):
    draw = random.Random(size)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(size))) for k in range(40)]
    index = D.ItemIndex(items, 0.2, 0.95, 8)
    docs = []
    for _, text in items:
        words = text.split()
        for _ in range(size // 5):
            at, what = draw.randrange(len(words)), draw.choice(("deletions", "insertions", "change")) if kind == "mixed" else kind
            words[at:at + (what != "insertions")] = [] if what == "deletions" else [draw.choice(vocabulary)]
        docs.append(np.array([0] * 40 + [index.vocabulary.get(w, 0) for w in words] + [0] * 40))
    found = {(d, k): e for d, k, e, _ in index.matches(docs)}
    assert sum((k, k) in found for k in range(40)) >= 0.95 * 40
    assert all(e <= size // 5 for e in found.values())


def test_items_in_several_blocks_and_empty_tables(llm, documents, items, monkeypatch):
    monkeypatch.setattr(D.blocks, "__defaults__", (10,))
    docs = documents([(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "clean")])
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()) == [(1, 1), (2, 2)]
    assert [r.doc_id for r in D.clean(docs, items).collect()] == [3]
    assert D.leaks(docs, items.limit(0)).count() == 0 and D.clean(docs, items.limit(0)).count() == 3
    assert D.leaks(docs.limit(0), items).count() == 0 and D.clean(docs.limit(0), items).count() == 0


def test_short_items_are_held_word_for_word(llm, documents):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(6)]
    texts = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 40))), None, "a") for i in range(40)]
    passages = [(n, " ".join(draw.choices(vocabulary, k=1 + n % 7))) for n in range(35)] + [(90, "W1, w2!"), (91, "w1 w2"), (92, "nowhere"), (93, "w1 nowhere w2")]
    expected = set()
    for d, text, *_ in texts:
        words = text.split()
        for n, passage in passages:
            item = D.plain_words(passage)
            places = [i for i in range(len(words) - len(item) + 1) if words[i:i + len(item)] == item]
            if places:
                expected.add((d, n, 0, len(item), places[0]))
    found = D.leaks(documents(texts), llm.createDataFrame(passages, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.edits, r.item_words, r.word_start) for r in found.collect()} == expected and len(expected) > 100


def test_scripts_without_spaces(llm, documents):
    passage = "吾輩は猫である名前はまだ無いどこで生れたか見当がつかぬ"
    edited = passage.replace("名前", "名字")
    items = llm.createDataFrame([(1, passage), (2, "สวัสดีครับ"), (3, "短い文")], "item_id long, text string")
    docs = documents([(1, f"前置き。{passage}。後", None, "a"), (2, f"x {edited} y", None, "a"), (3, "これは別の文章で、同じ所は無い。", None, "a"), (4, "คุณสวัสดีครับทุกคน", None, "a"),
                      (5, "これは短い文です", None, "a"), (6, "これは短い言葉の文", None, "a")])
    found = {(r.doc_id, r.item_id): r.edits for r in D.leaks(docs, items).collect()}
    assert found == {(1, 1): 0, (2, 1): 1, (4, 2): 0, (5, 3): 0}
    assert sorted(r.doc_id for r in D.clean(docs, items).collect()) == [3, 6]


def test_an_item_of_20_000_words_takes_bounded_memory(monkeypatch):
    draw = random.Random(6)
    item = [f"v{draw.randint(1, 5000)}" for _ in range(20_000)]
    held = item.copy()
    for at in range(50, 20_000, 200):
        held[at] = "other"
    sizes, plain = [], D.edit_distances
    monkeypatch.setattr(D, "edit_distances", lambda one, regions: sizes.append(regions.size) or plain(one, regions[:, :]))
    index = D.ItemIndex([(1, " ".join(item))], 0.01, 0.95, 8)
    number = index.vocabulary.get
    document = np.array([0] * 30 + [number(w, 0) for w in held] + [0] * 30, np.int64)
    found = index.matches([document, np.zeros(1000, np.int64)])
    assert [(d, k, e) for d, k, e, _ in found] == [(0, 0, 100)] and max(sizes) <= D.CELLS_AT_ONCE


def test_one_index_for_all_tasks_of_a_worker():
    items = [(1, ITEMS[0][1])]
    first = D.index_of("a", items, 0.2, 0.95, 8)
    assert D.index_of("a", items, 0.2, 0.95, 8) is first and D.index_of("b", items, 0.2, 0.95, 8) is not first and list(D._built) == ["b"]


def test_words_are_numbered_without_keeping_those_of_no_item():
    def plain(word):  # by character
        low = word.lower()
        inside = [i for i, c in enumerate(low) if c.isalnum()]
        return low[inside[0]:inside[-1] + 1] if inside else ""

    words = ["Rain,", "(rain)", "RAIN", "ra-in", "--", "“rain”", "Élan", "“élan…", "élan", "¿élan?", "ΟΔΟΣ", "ΟΔΟΣ.", "Σ", "İn", "Nİ", "́á", "x\x1c", "\x85", "…", "3.5", "\ud800a", "a\ud800", "µ"]
    known = {w: i for i, w in enumerate(sorted({plain(w) for w in words[::2]} - {""}), 1)}
    numbers = D.WordNumbers(known)
    for text in (" ".join(words), *words, "rain RAIN, other --", ""):
        expected = [known.get(p, 0) for w in text.split(" ") if (p := plain(w))]
        assert numbers.of(text).tolist() == expected, repr(text)
        assert D.plain_words(text) == [p for w in text.split(" ") if (p := plain(w))]
    kept = len(numbers.beyond)
    assert numbers.of(" ".join(f"other{i}é{i}" for i in range(1000))).tolist() == [0] * 1000
    assert len(numbers.beyond) == kept and len(numbers.known) == len(known) + 1
