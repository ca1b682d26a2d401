import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import ann, common

from .helpers import write

SHAPE = "vec_id long, embedding array<float>, label int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.0) for i, v in rows], SHAPE)


def brute(rows, k=10, kind=np.float32):
    """Every row that takes part is a candidate; each row that is asked has a result."""
    good = [(i, np.array(v, kind).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == len(rows[0][1]) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for n, (q, x) in enumerate(good):
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for m, (i, v) in enumerate(good) if m != n)[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d)]
    return sorted(out)


def clustered(n, dim=16, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (12, dim))
    return (centres[r.integers(0, 12, n)] + r.normal(0, 0.35, (n, dim))).astype(np.float32)


def test_exact_on_awkward_rows(spark):
    x = clustered(400)
    rows = [(i, x[i].tolist()) for i in range(400)]
    rows += [(500, x[0].tolist()), (600, None), (700, [0.0] * 16), (800, [float("nan")] + [1.0] * 15), (900, [float("inf")] + [1.0] * 15), (1000, [None] + [1.0] * 15), (1100, [1.0] * 3), (None, x[1].tolist()), (100, x[100].tolist())]
    rows += [(2_000 + i, x[7].tolist()) for i in range(300)]  # a hot group of copies
    rows += [(5_000, x[7].tolist()), (300, x[301].tolist())]  # an id with two vectors
    for frame, kind in ((table(spark, rows), np.float32), (table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>")), np.float64)):
        found = ann.search(frame, F.col("vec_id") % 100 == 0, part_rows=1 << 30).collect()
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
        want = brute(rows if kind is np.float32 else [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], kind=kind)
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def asked_share(index):
    return index.probes / index.parts


@pytest.mark.parametrize("flat", [256, 4])
def test_recall_with_many_parts(spark, flat):
    """One level, and two, with parts dealt to several tasks."""
    x = clustered(6_000, seed=2)
    rows = [(i, x[i].tolist()) for i in range(6_000)]
    found = {(r.query_id, r.vec_id) for r in ann.search(table(spark, rows), F.col("vec_id") % 100 == 0, sample=2_000, part_rows=150, flat=flat, chunk=100).collect()}
    want = {(w[0], w[2]) for w in brute(rows)}
    assert len(found & want) / len(want) >= 0.9


def test_half_of_the_parts_find_nine_tenths(spark, tmp_path):
    """On 50,000 vectors with structure, recall holds although under half of the parts are asked."""
    r = np.random.default_rng(5)
    centres = r.normal(0, 1, (60, 16))
    x = (centres[r.integers(0, 60, 50_000)] + r.normal(0, 0.3, (50_000, 16))).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist()}))
    sf = write(tmp_path, embeddings=frame)
    rows = common.stored(ann.valid(spark.read.parquet(f"{sf}/embeddings.parquet")), "test")
    index = ann.build(rows, 50_000)
    assert index.parts >= 150 and asked_share(index) < 0.5
    found = {}
    for row in ann.op7_learned_ann(spark, sf).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    hits, y = 0, x.astype(float)
    for q in range(0, 50_000, 100):
        d = ((y - y[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert len(found) == 500 and hits / 5_000 >= 0.9


def test_parts_are_balanced_and_routed():
    x = clustered(2_000, seed=3).astype(float)
    graph = ann.neighbours(x, 10)
    exact = np.argsort(((x[:5, None] - x[None]) ** 2).sum(2), axis=1)[:, 1:11]
    assert all(set(a) == set(b) for a, b in zip(graph[:5].tolist(), exact.tolist()))
    label = ann.balanced_parts(x, graph, 10)
    assert np.bincount(label, minlength=10).max() <= 2_000 / 10 * 1.15 + 1
    random_cut = (np.random.default_rng(0).permutation(label)[graph] != label[:, None]).mean()
    assert (label[graph] != label[:, None]).mean() < random_cut / 2
    index = ann.Index(ann.fit(x[400:], 10), {})
    index.measure(x[400:], x[:400], 10)
    assert 1 <= index.probes < 10


def test_small_tables(spark, tmp_path):
    assert ann.op7_learned_ann(spark, write(tmp_path / "a", embeddings=table(spark, []))).count() == 0
    assert ann.op7_learned_ann(spark, write(tmp_path / "b", embeddings=table(spark, [(100, [1.0, 2.0])]))).count() == 0
    rows = [(100, [1.0, 2.0]), (3, [1.0, 2.0]), (2, [1.0, 2.0]), (1, [9.0, 9.0])]
    assert [(r["rank"], r.vec_id) for r in ann.op7_learned_ann(spark, write(tmp_path / "c", embeddings=table(spark, rows))).orderBy("rank").collect()] == [(1, 2), (2, 3), (3, 1)]
