"""Vector codes against plain k-means on whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from facetide.llm import codes, queries

NAMES = "vec_id long, embedding array<float>, label int, part string, code string, error string, id string, vector string"


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], NAMES)


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // 4
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for _, v, _ in start] for k in range(4)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, k: min((gap(cut(v, k), e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(4):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(v, k)[1], []).append(cut(v, k))
            new.append([[sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else e for j, e in enumerate(books[k])])
        books = new
    found = [(i, [nearest(v, k) for k in range(4)], label) for i, v, label in kept]
    totals = {}
    for _, near, label in found:
        totals[label] = totals.get(label, 0) + sum(e for e, _ in near)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in near), sum(e for e, _ in near), totals[label], sha) for i, near, label in found), key=str)


def test_as_brute_force(spark, table):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 0.5) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([0, 1, 1, None])) for i in range(700)]
    rows += [rows[5]] * 3 + [(900 + i, rows[7][1], 1) for i in range(5)]
    out = codes.compressed(table(rows))
    assert out.columns == ["id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_few_vectors_nulls_and_ties(spark, table):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5, 0.0, 1.0], 1), (1, [0.5, -0.5, 0.0, 1.0], 1), (2, [0.25] * 4, None), (None, [0.1, 0.2, 0.3, 0.4], None), (3, None, 1), (4, [None, 1.0, 1.0, 1.0], 1), (5, [nan, 1.0, 1.0, 1.0], 2), (6, [-inf, 1.0, 1.0, 1.0], 2)]
    assert sorted((tuple(r) for r in codes.compressed(table(rows)).collect()), key=str) == brute(rows)
    assert codes.compressed(table([])).collect() == []
    assert codes.compressed(table([(1, None, 1)])).collect() == []
    assert len(codes.compressed(table([(1, [], 1), (2, [], 1)])).collect()) == 2


def test_wrong_vectors(spark, table):
    for rows in ([(1, [1.0] * 6, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [40000.0] * 4, 1)]):
        with pytest.raises(Exception, match="components|length|component"):
            codes.compressed(table(rows)).collect()


@pytest.mark.parametrize("most", [0, 3, 10_000])
def test_cells_keep_the_nearest(most):
    rng = np.random.default_rng(2)
    entries, points = rng.integers(-600, 600, (256, 4)), rng.integers(-900, 900, (3_000, 4))
    cells = codes.Cells(entries, most)
    for _ in range(2):  # new and remembered cells
        index, errors = cells.nearest(points)
        gaps = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == gaps.argmin(axis=1)).all() and (errors == gaps.min(axis=1)).all()
    assert len(cells.kept) <= most
    assert cells.candidates(points).mean() < 0.2


def test_query_as_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in queries.op13_vector_codes(spark, folder).collect()), key=str) == brute(rows)
