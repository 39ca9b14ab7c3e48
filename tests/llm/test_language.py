import numpy as np

from skyledger.llm import language_profiles as L, queries
from tests.conftest import SF_DIR

TEXTS = {"en": "the quick brown fox jumps over the lazy dog and then the other thing that they thought", "de": "der schnelle braune fuchs springt über den faulen hund und dann noch die schönen sachen",
         "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και μετά κοιμάται"}


def test_triples_are_bound_and_bundled():
    grams, counts = L.gram_counts("Ab, ab!")
    assert sorted(counts.tolist()) == [1, 2, 2]  # b-gap-a, and gap-a-b and a-b-gap twice
    vectors = L.gram_vectors(grams)
    assert vectors.shape == (3, L.DIMENSIONS) and set(np.unique(vectors)) == {-1.0, 1.0} and abs(float(vectors[0] @ vectors[1])) < 0.2 * L.DIMENSIONS
    assert np.allclose(L.bundled([(grams, counts)])[0], (counts[:, None] * vectors).sum(0) / 5)
    assert len(L.gram_counts("12 ..\n")[0]) == 0 and len(L.gram_counts(None)[0]) == 0


def test_long_texts_in_pieces_count_the_same(monkeypatch):
    text = "some words, and MORE words! " * 400
    whole = [x.tolist() for x in L.gram_counts(text)]
    monkeypatch.setattr(L, "_PIECE", 100)
    assert [x.tolist() for x in L.gram_counts(text)] == whole


def test_order_of_rows_and_partitions_does_not_matter(documents):
    rows = [(i, f"{t} {i}", lang) for i in range(30) for lang, t in TEXTS.items()]
    one = L.learn(documents(rows, 1))
    many = L.learn(documents(rows[::-1], 5))
    assert one[0] == many[0] == ["de", "el", "en"] and (one[1] == many[1]).all()


def test_defined_cases(documents, clashing):
    taught = documents([(i, t, lang) for i, (lang, t) in enumerate(TEXTS.items())] + [(8, "nothing", None), (9, None, "en"), (10, "", "xx"), (11, "123", "yy")])
    names, prototypes = L.learn(taught)
    assert names == ["de", "el", "en"]
    rows = [(1, None), (2, ""), (3, "12 ?!"), (4, "the dog and the fox"), (5, "der hund und der fuchs"), (6, "το σκυλί"), (7, "the dog " * 200_000), (7, "the dog " * 200_000), (None, "und die sachen")]
    docs = clashing(documents(rows))
    found = [(r.doc_id, r.lang_pred, r.score) for r in L.classify(docs, names, prototypes).collect()]
    assert sorted(((k, p) for k, p, _ in found), key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "el"), (7, "en"), (7, "en"), (None, "de")], key=str)
    assert all((s == 0) == (p == "und") and 0 <= s <= 1 for _, p, s in found)
    kept = L.with_language(docs, names, prototypes)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [4, 5, 6, 7, 7, None]
    assert L.with_language(documents([(1, "qx zv jk " * 100)]), names, prototypes).count() == 0
    assert L.classify(docs.limit(0), names, prototypes).count() == 0 and L.learn(taught.limit(0))[0] == []
    untaught = L.classify(docs, *L.learn(taught.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)} and L.with_language(docs, *L.learn(taught.limit(0))).count() == 6


def test_held_out_accuracy(llm):
    rows = queries.registered()["op10_language_profiles"](llm, SF_DIR).join(llm.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
