import zlib
from collections import Counter

import pytest

from lumenfold.llm import sharding

from .helpers import awkward, documents, write


def check(rows, docs, shards=40):
    assert len(rows) == len(docs)
    want = Counter((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return {s: sum(r.size for r in rows if r.shard == s) for s in range(shards)}


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    check(sharding.op9_kd_sharding(spark, write(tmp_path, documents=docs)).collect(), docs.collect())


def test_sizes_are_near_equal_with_a_hot_text(spark):
    rows = [(i, "word " * (i % 37 + 5) + str(i), ["en", "de", "fr"][i % 3], f"s{i % 7}") for i in range(4_000)]
    rows += [(10_000 + i, "copied page " * 10, "en", "s0") for i in range(2_000)]
    docs = documents(spark, rows)
    sizes = check(sharding.assign(docs).collect(), docs.collect()).values()
    mean = sum(sizes) / 40
    assert max(sizes) < 1.05 * mean and min(sizes) > 0.95 * mean


@pytest.mark.parametrize("doc_id", [7, None])
def test_sizes_are_near_equal_with_equal_rows(spark, doc_id):
    rows = [(i, "word " * (i % 37 + 5) + str(i), ["en", "de", "fr"][i % 3], f"s{i % 7}") for i in range(2_000)]
    docs = documents(spark, rows + [(doc_id, "one row " * 12, "en", "s0")] * 2_000)
    sizes = check(sharding.assign(docs).collect(), docs.collect()).values()
    mean = sum(sizes) / 40
    assert max(sizes) < 1.05 * mean + 213 and min(sizes) > 0.95 * mean - 213  # 213: the largest row


@pytest.mark.parametrize("shards", [1, 2, 3, 7])
def test_other_counts_of_shards(spark, shards):
    docs = documents(spark, [(i, "t" * (i % 11 * 9 + 30)) for i in range(500)])
    sizes = check(sharding.assign(docs, shards).collect(), docs.collect(), shards).values()
    assert max(sizes) < 1.1 * sum(sizes) / shards


def test_small_groups_stay_together(spark):
    docs = documents(spark, [(i, f"text number {i % 3_000} " + "pad " * (i % 50), f"l{i % 2}", f"s{i % 5}") for i in range(6_000)])
    shards = {}
    for r in sharding.assign(docs, 8).collect():
        shards.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7


def plain_tree(points, shards):
    """Shard of each (key, bytes, coordinates): a k-d tree cut node by node, positions and all in plain Python."""
    out, todo = {}, [(points, 0, shards)]
    while todo:
        own, first, k = todo.pop()
        if k == 1 or not own:
            out |= {p[0]: first for p in own}
            continue
        spans = [max(p[2][d] for p in own) - min(p[2][d] for p in own) for d in range(3)]
        axis = spans.index(max(spans))
        order = sorted(own, key=lambda p: (p[2][axis], p[3]))
        goal, run, best = sum(p[1] for p in own) * (k // 2) / k, 0, (None, 0)
        for i, p in enumerate(order):
            over = run + p[1] - goal
            if over >= 0:
                best = i + (1 if over <= goal - run else 0)
                break
            run += p[1]
        todo += [(order[:best], first, k // 2), (order[best:], first + k // 2, k - k // 2)]
    return out


@pytest.mark.parametrize("shards", [2, 5, 40])
def test_same_as_a_plain_tree(spark, shards):
    docs = documents(spark, [(i, f"text number {i} " + "pad " * (i * 7 % 90), f"l{i % 4}", f"s{i % 9}") for i in range(900)])
    point = docs.selectExpr(
        "doc_id", "octet_length(text) + 16L AS b", "pmod(xxhash64(source), 4096) AS x", "pmod(xxhash64(lang), 4096) AS y",
        "least(4095, floor(log2(octet_length(text) + 16L) * 128)) AS z", "pmod(xxhash64(text), 16384) AS t",
    ).collect()
    want = plain_tree([(r.doc_id, r.b, (r.x, r.y, r.z), r.t) for r in point], shards)
    assert {r.doc_id: r.shard for r in sharding.assign(docs, shards).collect()} == want


def test_repeated_rows_spread_over_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_RUN", 10)
    docs = documents(spark, [(1, "the same row")] * 1_500 + [(i, f"row {i}") for i in range(500)])
    check(sharding.assign(docs, 4).collect(), docs.collect(), 4)


def test_no_python_in_the_plan(spark):
    plan = sharding.assign(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark, tmp_path):
    assert sharding.op9_kd_sharding(spark, write(tmp_path, documents=documents(spark, []))).count() == 0
