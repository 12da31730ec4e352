"""Hard negatives against all scores, and the bounds of tree nodes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=10, positives=5, negatives=10, low=30, high=90):
    seen = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen.add((i, tuple(math.floor(256 * x) for x in v), label))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for me in seen:
        i, v, label = me
        if i % every:
            continue
        scored = sorted(((-dot(v, w), j, m) for j, w, m in seen if len(w) == len(v) and (j, w, m) != me), key=lambda x: x[:2])
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fine = [(-t, n) for t, n, m in scored if m != label and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, r, n, -s, t) for r, (t, n) in enumerate(fine[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=10, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % every == 0, **how).collect()))


def vectors(seed, n, d=6, centres=5, copies=0.2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, d))
    rows = []
    for i in range(n):
        x = base[rng.integers(centres)] + 0.2 * rng.normal(size=d) if rng.random() > copies else base[0]
        rows.append((i, x.tolist(), int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("bound", [H.BLOCK, 60])
def test_equals_brute_force(spark, bound):
    rows = vectors(1, 300)
    got = mined(spark, rows, bound=bound)
    assert got and got == brute(rows)


def test_nulls_ties_repeats_and_lengths(spark):
    rows = vectors(2, 80, d=3)
    rows += [(10, rows[10][1], rows[10][2]), (10, [0.5, 0.1, 0.2], 1), (20, rows[20][1], None), (None, [1.0, 0.0, 0.0], 1)]
    rows += [(500, None, 1), (501, [1.0, None, 0.0], 1), (502, [1.0, float("nan"), 0.0], 2), (503, [float("inf"), 0.0, 0.0], 2)]
    rows += [(510 + i, [1.0, -1.0 * i], i % 2) for i in range(12)] + [(600, [], 1), (601, [], 2), (602, [0.0, 0.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows)


def test_all_equal_vectors(spark):
    """One class: ties go to smaller ids, and negatives above 90 % are out of the band."""
    rows = [(i, [1.0, 1.0], i % 2) for i in range(60)]
    rows += [(100 + i, [0.8, 0.8], i % 2) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [3e6 + i, 1.0 - 2e6 * (i % 3)], i % 2) for i in range(40)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        mined(spark, [*rows, (41, [1e30, 0.0], 1)])


def test_empty_table_clashing_columns_and_float_vectors(spark):
    assert mined(spark, []) == []
    rows = [(i, [i * 0.25, 1.0], i % 2) for i in range(30)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id int, embedding array<float>, label int, v int, anchor int")
    got = H.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_intervals_hold_all_products():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-900, 900, size=(n, 7)) for n in (150, 400))
    s, t = H.Tree(a, 16), H.Tree(b, 16)
    whole = a[s.order] @ b[t.order].T
    for x in s.levels:
        for y in t.levels:
            least, most = H.interval(x, y)
            for i in range(len(least)):
                for j in range(len(least[0])):
                    part = whole[x[0][i] : x[0][i + 1], y[0][j] : y[0][j + 1]]
                    assert least[i, j] <= part.min() and part.max() <= most[i, j]


def test_clusters_are_pruned(monkeypatch):
    """Most pairs of leaves of far clusters are never scored."""
    rng = np.random.default_rng(5)
    centres = 4000 * rng.normal(size=(16, 8))
    x = (np.repeat(centres, 256, 0) + rng.normal(size=(4096, 8)) * 60).astype(np.int64)
    q = x[::4]
    asked = H.Asked(np.arange(len(q)), q, np.zeros(len(q), object), np.full(len(q), H.LEAST + 1), np.full(len(q), H.MOST), 5)
    scored, real = [], H.products
    monkeypatch.setattr(H, "products", lambda a, b: scored.append(len(a) * len(b)) or real(a, b))
    asked.visit(x, np.zeros(len(x), object), [np.array([i]) for i in range(len(x))], True)
    assert sum(scored) < 0.3 * len(q) * len(x)
    best = np.sort(asked.x @ x.T, 1)[:, :-6:-1]
    assert (asked.score == best).all()
