import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import hard_negatives as H, queries
from skyledger.llm.common import table
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, anchor=lambda i: i % 100 == 0, flip=lambda i, label: label):
    kept = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v], flip(i, label)) for n, (i, v, label) in enumerate(rows)
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v, label in kept:
        if not anchor(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other == label) for m, j, w, other in kept if m != n and len(w) == len(v))
        for s, j, _, _ in [x for x in scores if x[3]][:positives]:
            fits = [(t, k) for t, k, _, same in scores if not same and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fits, 1)]
    return sorted(out)


def clusters(n, dims, seed=5, groups=7):
    draw = np.random.Generator(np.random.PCG64(seed))
    centres = draw.normal(size=(groups, dims)) / 4
    return [(i, (centres[i % groups] + draw.normal(size=dims) / 12).astype(np.float32).tolist(), int(draw.integers(0, 4))) for i in range(n)]


def mined(df, **options):
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), **options).collect())


@pytest.mark.parametrize("tree_bytes", [1 << 24, 1])  # one tree for a cell, and several
def test_against_brute_force_with_a_hot_vector(llm, monkeypatch, tree_bytes):
    monkeypatch.setattr(H, "TREE_BYTES", tree_bytes)
    monkeypatch.setattr(H, "LEAF", 16)
    monkeypatch.setattr(H, "SPLITS", 4)
    monkeypatch.setattr(H, "UPPER_SPLITS", 3)
    monkeypatch.setattr(H, "BLOCK_ROWS", 9)
    rows = clusters(600, 6) + [(2000 + i, clusters(1, 6)[0][1], i % 2) for i in range(300)]  # one vector that is a third of all
    found = mined(llm.createDataFrame(rows, SCHEMA))
    assert found == brute(rows) and len(found) > 100


def test_defined_cases(llm, clashing):
    good = clusters(120, 4)
    rows = good + [(0, good[0][1], 1), (100, good[100][1], good[100][2]), (None, good[0][1], 1), (300, None, 1), (400, good[0][1], None), (500, [math.nan] * 4, 1),
                   (600, [None, 1.0, 1.0, 1.0], 1), (700, good[0][1] + [1.0], 1), (800, [], 1), (801, [], 2), (900, [1e9, 0.0, 0.0, -1e9], 1)]
    cut = [(i, None if v is None else [x if x is None or not math.isfinite(x) else max(-65536.0, min(x, 65536.0)) for x in v], label) for i, v, label in rows]
    assert mined(clashing(llm.createDataFrame(rows, SCHEMA))) == brute(cut)
    assert mined(llm.createDataFrame([], SCHEMA)) == [] and mined(llm.createDataFrame([(100, [1.0], 1)], SCHEMA)) == []


def test_windows_pass_siblings_over():
    draw = np.random.Generator(np.random.PCG64(2))
    centres = draw.normal(size=(60, 5)) * 2000
    vectors = np.floor(np.repeat(centres, 100, 0) + draw.normal(size=(6000, 5))).astype(np.int64)
    length = float((vectors.astype(float) ** 2).sum(1).max()) * (1 + 1e-12)
    import pyarrow as pa

    tree = H._Tree(H._Builder(np.arange(6000), np.arange(6000), np.zeros(6000, np.int64), vectors, length).table(0), 5)
    scores = vectors[17] @ vectors.T
    least, most = int(np.sort(scores)[-3000]), int(np.sort(scores)[-1500])
    asked = pa.table({"search": [0], "rid": [17], "label": [1], "same": [False], "least": [least], "most": [most], "vector": [vectors[17].tolist()]})
    searches = H._Searches(asked, 10, length)
    tree.search(searches)
    fit = np.flatnonzero((scores >= least) & (scores <= most) & (np.arange(6000) != 17))
    expected = sorted(zip(-scores[fit], fit))[:10]
    assert list(zip(-searches.best.scores[0], searches.best.ids[0])) == expected
    assert searches.compared < 0.25 * 6000


def test_registered_query_against_brute_force(llm):
    rows = [tuple(r) for r in table(llm, SF_DIR, "embeddings", "vec_id", "embedding", "label").collect()]
    result = queries.registered()["op13_hard_negatives"](llm, SF_DIR)
    assert sorted(tuple(r) for r in result.collect()) == brute(rows, flip=lambda i, label: (label + 1) % 10 if i % 7 == 0 else label)
    assert dict(result.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
