import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from skyledger.llm import queries, vector_codes as V
from skyledger.llm.common import table
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positions=8, entries=16, rounds=6, scale=4096):
    """Plain Python, row by row."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // positions)
    parts = [[(v + [0] * (positions * width - len(v)))[p * width:(p + 1) * width] for p in range(positions)] for _, v, _ in kept]
    books = [[row[p] for row in parts[:entries]] for p in range(positions)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, part: min(range(len(books[p])), key=lambda e: (away(part, books[p][e]), e))
    for _ in range(rounds):
        for p in range(positions):
            members = {}
            for row in parts:
                members.setdefault(best(p, row[p]), []).append(row[p])
            for e, found in members.items():
                books[p][e] = [sum(column) // len(found) for column in zip(*found)]
    codes = [[best(p, row[p]) for p in range(positions)] for row in parts]
    errors = [sum(away(row[p], books[p][code[p]]) for p in range(positions)) for row, code in zip(parts, codes)]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    rows = [(i, "".join(f"{e:02x}" for e in code), error, by_label[label]) for (i, _, label), code, error in zip(kept, codes, errors)]
    return sorted(rows, key=str), digest


def found(spark, rows, **options):
    codes, books = V.compress(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted((tuple(r) for r in codes.select("vec_id", "code", "error", "label_error").collect()), key=str), books.digest()


def vectors(n, dims, seed=3, spread=0.3):
    draw = np.random.Generator(np.random.PCG64(seed))
    return [(i, (draw.normal(size=dims) * spread).astype(np.float32).tolist(), int(draw.integers(0, 4))) for i in range(n)]


def test_against_plain_python_with_a_hot_vector(llm):
    rows = vectors(150, 16)
    rows += [(1000 + i, rows[3][1], None if i % 2 else 1) for i in range(75)]  # one vector that is a third of all
    assert found(llm, rows) == brute(rows)


def test_many_blocks_and_tasks_give_the_same(llm, monkeypatch):
    rows = [(i, [round(x, 1) for x in v], label) for i, v, label in vectors(200, 24)]  # many shared prefixes
    once = found(llm, rows, entries=5, rounds=3)
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "TASK_ROWS", 400)
    monkeypatch.setattr(V, "FEW_LABELS", 0)  # label sums are joined, salted
    assert found(llm, rows, entries=5, rounds=3) == once == brute(rows, entries=5, rounds=3)


def test_defined_cases(llm):
    rows = [(5, [0.5, -0.5, 1e9], 1), (5, [0.5, -0.5, 1e9], 1), (2, None, 1), (3, [0.1, None, 0.2], 1), (4, [math.nan, 1.0, 1.0], 1), (6, [math.inf, 0.0, 0.0], 1),
            (None, [0.25] * 11, None), (7, [], None), (8, [-0.00001] * 9, 2)]
    codes, _ = found(llm, rows)
    assert [r[0] for r in codes] == [5, 5, 7, 8, None] and codes[0] == codes[1]
    cut = [(i, None if v is None else [x if x is None or not math.isfinite(x) else min(x, 4096.0) for x in v], label) for i, v, label in rows]
    assert (codes, found(llm, rows)[1]) == brute(cut)
    assert found(llm, [])[0] == [] and found(llm, [(1, [], 1), (2, [], 1)])[0] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]
    assert found(llm, [(1, [1.0] * 8, 1)])[0] == [(1, "00" * 8, 0, 0)]


def test_clashing_columns(llm, clashing):
    rows = clashing(llm.createDataFrame(vectors(30, 8), SCHEMA)).withColumns({n: F.lit("own") for n in ("code", "error", "label_error", "position", "times", "vector")})
    assert sorted(tuple(r) for r in V.compress(rows)[0].select("vec_id", "code", "error", "label_error").collect()) == sorted(brute(vectors(30, 8))[0])


def test_shared_prefixes_are_computed_once():
    parts = np.array(sorted({(i // 50, i // 10 % 5, i % 10, i % 3) for i in range(500)}), np.int64)
    book = np.array([[0, 0, 0, 0], [5, 2, 4, 1], [9, 4, 9, 2]], np.int64)
    index, distance, computed = V.nearest(parts, book)
    away = ((parts[:, None, :] - book) ** 2).sum(2)
    assert (index == away.argmin(1)).all() and (distance == away.min(1)).all()
    assert computed < 0.6 * parts.size * len(book)  # of rows x dimensions x entries


def test_restored_vectors_are_as_far_as_the_error_says(llm):
    rows = vectors(60, 16)
    codes, books = V.compress(llm.createDataFrame(rows, SCHEMA))
    whole = {i: [math.floor(4096 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    for r in V.restored(codes, books).collect():
        assert sum((a - round(4096 * b)) ** 2 for a, b in zip(whole[r.vec_id], r.vector)) == r.error


def test_registered_query_against_plain_python(llm):
    rows = [tuple(r) for r in table(llm, SF_DIR, "embeddings", "vec_id", "embedding", "label").collect()]
    result = queries.registered()["op11_vector_codes"](llm, SF_DIR).collect()
    expected, digest = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in result), key=str) == expected and {r.codebooks_sha256 for r in result} == {digest}
    assert {n: t for n, t in queries.registered()["op11_vector_codes"](llm, SF_DIR).dtypes} == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
