import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import metric_search as M

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, asked):
    clean = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in clean:
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in clean if j != i and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("page", [4, 512])
def test_against_brute_force(llm, monkeypatch, page):
    monkeypatch.setattr(M, "PAGE", page)
    monkeypatch.setattr(M, "FAN_OUT", 3)
    draw = np.random.Generator(np.random.PCG64(4))
    centres = draw.normal(size=(6, 8)) / 3
    rows = [(i, (centres[i % 6] + draw.normal(size=8) / 20).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one vector that is a third of all
    vectors = llm.createDataFrame(rows, SCHEMA)
    found = M.top_k(vectors, 5, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 5, lambda i: i % 50 == 0)


def test_several_trees_and_query_blocks(llm):
    draw = np.random.Generator(np.random.PCG64(9))
    rows = [(i, draw.normal(size=5).astype(np.float32).tolist()) for i in range(300)]
    whole = llm.createDataFrame(rows, SCHEMA).select("vec_id", M.whole(F.col("embedding"), 256).alias("vector"))
    pages = M.build(whole, tree_rows=40)
    assert pages.select("tree").distinct().count() > 3
    found = M.search(pages, whole.where("vec_id % 10 = 0"), 3, query_rows=7)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 3, lambda i: i % 10 == 0)


def test_tight_clusters_are_passed_over():
    draw = np.random.Generator(np.random.PCG64(1))
    centres = draw.normal(size=(40, 6)) * 1000
    vectors = np.floor(np.repeat(centres, 50, 0) + draw.normal(size=(2000, 6))).astype(np.int64)
    builder = M._Builder(np.arange(2000), vectors)
    builder_page, M.PAGE = M.PAGE, 32
    try:
        tree = M._Tree(builder.table(0), 6)
    finally:
        M.PAGE = builder_page
    for q in range(0, 2000, 100):
        tree.search(q, vectors[q], 5)
    assert tree.computed < 20 * 2000 / 2


def test_defined_cases(llm):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [9.0, 9.0]),
            (5, [3.0, 1.0]), (6, [3.0, 1.0]), (6, [3.0, 1.0]), (7, [1.0, 1.0, 1.0]), (50, [1e6, -1e6]), (100, []), (0, [0.5, 0.5]), (8, [-3e30, 3e30])]
    table = llm.createDataFrame(rows, SCHEMA)
    found = M.top_k(table.where("vec_id IS NULL OR vec_id <> 8").select("*", F.lit(1).alias("vector"), F.lit(2).alias("asked")), 5, F.col("vec_id") % 50 == 0)
    kept = [r for r in rows if r[0] != 8]
    assert sorted(tuple(r) for r in found.collect()) == brute(kept, 5, lambda i: i % 50 == 0)
    assert M.top_k(table, 5, F.col("vec_id") % 50 == 0).count() > 0  # values beyond 64 bits are cut, not an error
    assert M.top_k(table.limit(0), 5, F.col("vec_id") % 50 == 0).count() == 0
