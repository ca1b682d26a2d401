import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import negatives

from .helpers import write

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 0.5, "own") for i, v, y in rows], SCHEMA)


def brute(rows, every, k=5):
    """rows: (vec_id, vector, label) with floats as they are stored."""
    good = [(n, i, [math.floor(256 * x) for x in v], y) for n, (i, v, y) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, _, v, _ in good)
    size = min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 0
    good = [g for g in good if len(g[2]) == size]
    out = Counter()
    for n, i, q, y in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, m, z) for m, j, v, z in good if m != n)
        for s, j, _, _ in [x for x in scored if x[3] == y][:k]:
            inside = [x for x in scored if x[3] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out.update((i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside))
    return out


def as_float(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def clustered(n, dims, clusters, seed=0, labels=4, norm=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (clusters, dims))
    of = r.integers(0, clusters, n)
    x = centres[of] + r.normal(0, 0.15, (n, dims))
    return [(i, as_float((x[i] * norm).tolist()), int(r.integers(0, labels))) for i in range(n)]


def mined(spark, rows, every, **options):
    return Counter(map(tuple, negatives.mine(table(spark, rows).repartition(3), F.col("vec_id") % every == 0, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"group": 4, "chunk": 50, "pivots": 8}])
def test_against_all_pairs(spark, options):
    rows = clustered(600, 8, 12)
    rows += [(2_000 + i, rows[7][1], 2) for i in range(40)] + [(2_000, rows[7][1], 3)] * 2  # copies, repeated ids, ties
    want = brute(rows, 10)
    assert want and mined(spark, rows, 10, **options) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        *clustered(60, 4, 3, 5), (100, None, 1), (200, [1.0, 2.0, None, 1.0], 1), (300, [1.0, nan, 0.0, 1.0], 1), (400, [inf, 1.0, 0.0, 1.0], 2), (500, [1.0, 2.0], 1),
        (None, [1.0, 1.0, 1.0, 1.0], 1), (600, [1.0, 1.0, 1.0, 1.0], None), (700, [0.0, 0.0, 0.0, 0.0], 1), (800, [-90.0, 1.0, 1.0, 1.0], 0), (-900, [0.1, 0.2, 0.3, 0.4], 7),
    ]
    assert mined(spark, rows, 10, group=2) == brute(rows, 10)
    assert mined(spark, rows[:0], 10) == Counter()
    assert mined(spark, rows[:1], 1) == Counter() == mined(spark, [rows[0], rows[0]], 1)
    large = [(i, [x * 100_000 for x in v], y) for i, v, y in clustered(60, 4, 3, 6)]
    assert mined(spark, [(i, as_float(v), y) for i, v, y in large], 10) == brute([(i, as_float(v), y) for i, v, y in large], 10)
    with pytest.raises(ValueError):
        mined(spark, [(i, [x * 1e9 for x in v], y) for i, v, y in clustered(20, 4, 3)], 10)


def test_rows_go_only_where_they_might_serve(spark):
    rows = clustered(3_000, 6, 30, 7, labels=2)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    cells = negatives.Cells(x, float((x**2).sum(axis=1).max()), 32, 8)
    q = x[::50]
    group, d = cells.distances(q, True)[:, : cells.groups].argmin(axis=1), cells.distances(q, True)
    theta = np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2) + cells.largest - (x**2).sum(axis=1)), axis=1)[:, 20]
    near = np.array([(d - theta[:, None])[group == g].min(axis=0, initial=np.inf) for g in range(cells.groups)])
    far = np.array([(d + theta[:, None])[group == g].max(axis=0, initial=-np.inf) for g in range(cells.groups)])
    sent = negatives.Reach(cells, near, far).of(x, np.zeros(len(x)))
    needed = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert all(sent[needed[i], group[i]].all() for i in range(len(q)))
    assert sent.mean() < 0.5


def test_hot_cell_and_label(spark):
    r = np.random.default_rng(3)
    rows = [(i, [0.5, 0.5, 0.25], 1) for i in range(1_500)] + [(5_000 + i, as_float(r.normal(0, 1, 3).tolist()), int(r.integers(0, 3))) for i in range(500)]
    assert mined(spark, rows, 100, chunk=100, group=4) == brute(rows, 100)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", None])
def test_sql(spark, tmp_path, folder):
    files = "embeddings.parquet"
    if folder is None:
        files = "embeddings.parquet/*.parquet"
        folder = write(tmp_path, embeddings=table(spark, [*clustered(400, 8, 5, 9, labels=10), (900, None, 1), (910, [1.0] * 8, None)]))
    got = negatives.op12_hard_negatives(spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/{files}'")
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({negatives.OP12_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want
