import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import common, simhash

from .helpers import awkward, documents, write


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Smallest member of each fingerprint's component, by comparing all pairs."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= 3 and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def test_masks_cover_every_triple():
    masks = simhash.covering_masks()
    assert len(masks) == 15 and all(any(not m >> a & 1 and not m >> b & 1 and not m >> c & 1 for m in masks) for a, b, c in itertools.combinations(range(64), 3))
    assert all(28 <= m.bit_count() <= 36 for m in masks)


@pytest.mark.parametrize(("bits", "radius", "least"), [(64, 3, 28), (64, 6, 28), (33, 6, 6), (32, 3, 13)])
def test_masks_are_of_like_size_and_cover(bits, radius, least):
    masks, r = simhash.covering_masks(list(range(10, 10 + bits)) if bits < 64 else bits, radius), random.Random(1)
    places = range(10, 10 + bits) if bits < 64 else range(64)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= least
    for _ in range(3_000):
        differ = sum(1 << i for i in r.sample(places, radius))
        assert any(not m & differ for m in masks)


@pytest.mark.parametrize("text", [None, "", "one", "One TWO", "a b c", "A\tb\nc  d", "Ünï Ä É ÄÉ", "x " * 500, "the quick brown fox " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(4))
def test_bucket_stars_link_whole_components(seed):
    r = np.random.default_rng(seed)
    base = r.integers(-(2**62), 2**62, 4)
    fps = np.concatenate([np.bitwise_xor.reduce(np.stack([np.full(60, b), *[np.int64(1) << r.integers(0, 64, 60) for _ in range(3)]]), axis=0) for b in base])
    nodes, roots = simhash.bucket_stars(np.stack([fps, fps], axis=1))
    parent = dict(zip(nodes.tolist(), roots.tolist()))
    want = classes([f & (2**64 - 1) for f in fps.tolist()])
    groups = {}
    for f in set(fps.tolist()):
        groups.setdefault(want[f & (2**64 - 1)], set()).add(parent.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 103), (103, 101), (200, 200)]
    found = {r.node: r.root for r in simhash.components(spark, spark.createDataFrame(edges, "node long, root long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_query_against_all_pairs(spark, tmp_path):
    r = random.Random(5)
    base = [f"w{r.randint(0, 999)}" for _ in range(400)]
    near = []
    for i in range(40):
        words = list(base)
        words[r.randrange(400)] = f"v{i}"
        near.append((1_000 + i, " ".join(words)))
    docs = awkward(spark, *near, *[(2_000 + i, "an exact copy of one page") for i in range(300)])
    found = simhash.op6_simhash(spark, write(tmp_path, documents=docs)).collect()
    rows = [(x.doc_id, plain_fingerprint(x.text)) for x in docs.select("doc_id", "text").collect()]
    root = classes([f for _, f in rows])
    first = {}
    for i, f in rows:
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    assert sorted((str(x.doc_id), x.fingerprint, x.component_id) for x in found) == sorted((str(i), f"{f:016x}", first.get(root[f])) for i, f in rows)
    assert len({x.component_id for x in found if (x.doc_id or 0) >= 1_000 and x.doc_id < 2_000}) < 40  # near copies link


@pytest.mark.parametrize("seed", range(2))
def test_large_buckets_are_dealt_again(spark, seed):
    """Every bucket of over five nodes is split; the classes are those of all pairs."""
    r = random.Random(seed)
    fps = set()
    for base in (r.getrandbits(64), r.getrandbits(64)):
        for _ in range(150):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = common.stored(spark.createDataFrame([(f,) for f in signed], "fp long"), "test")
    found = {x.fp & (2**64 - 1): x.root for x in simhash.classes(prints, split=5).collect()}
    want = classes(list(fps))
    assert found.keys() == want.keys()
    assert len({(found[f], want[f]) for f in fps}) == len(set(found.values())) == len(set(want.values()))


def test_hot_roots_are_looked_up_apart(spark):
    left = common.stored(spark.range(9_000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k")), "test")
    right = spark.range(0, 9_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 70)], "k long, v long"))
    out = common.lookup(left, right, "k")
    assert out.count() == 9_000 and out.filter("k = 7").select("v").distinct().collect()[0].v == 70
    assert out.filter("k <> 7 and k % 2 = 1 and v is not null").count() == 0 == out.filter("k % 2 = 0 and v <> 2 * k").count()


def test_one_of_each_group_stays(spark):
    docs = awkward(spark, *[(50 + i, "five copies of this text") for i in range(5)])
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([1, 4, 6, 7, 8, 50, None], key=str) and kept.columns == docs.columns
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_keep_one_keeps_columns_and_one_row_of_repeated_ids(spark):
    names = ["text_key", "fp", "root", "row", "copies", "row_key", "chk", "node", "key", "times"]
    rows = [(3, "T t tt", 1), (5, "U u uu", 2), (5, "T t tt", 3), (None, "T t tt", 4), (None, "V v vv", 5), (None, "V v vv", 5), (9, "W w ww", 6), (9, "W w ww", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark long")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("mark").cast("string")))
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    out = sorted(kept.collect(), key=str)
    assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(str(x) for x in [(3, "T t tt"), (5, "U u uu"), (None, "V v vv"), (9, "W w ww")])
    assert all(r[n] == f"{n}{r.mark}" for r in out for n in names)


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(r, words, kind, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        if kind == "drop":
            del words[at]
        elif kind == "insert":
            words.insert(at, f"x{r.random()}")
        else:
            words[at] = words[r.randrange(len(words))] if kind == "other" else f"x{r.random()}"
    return words


def planted(seed=2, pairs=240):
    """Pairs of a text and an edited one: (text, text, similarity)."""
    r, out = random.Random(seed), []
    while len(out) < pairs:
        words = [f"w{int(r.paretovariate(0.6)) % 5_000}" for _ in range(r.randint(60, 500))]
        other = edited(r, words, r.choice(("drop", "insert", "other", "new")), r.randint(1, max(2, len(words) // 20)))
        a, b = " ".join(words), " ".join(other)
        out.append((a, b, jaccard(a, b)))
    return out


def test_keep_one_keeps_its_rule(spark):
    """Recall by similarity, and no pair below 0.8 links."""
    pairs = planted()
    rows = [(i, a) for i, (a, _, _) in enumerate(pairs)] + [(10_000 + i, b) for i, (_, b, _) in enumerate(pairs)]
    kept = {x.doc_id for x in simhash.keep_one(documents(spark, rows)).collect()}
    assert set(range(len(pairs))) <= kept
    gone = [10_000 + i not in kept for i in range(len(pairs))]
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = [g for g, (_, _, s) in zip(gone, pairs) if low <= s < high]
        assert len(own) >= 10 and sum(own) / len(own) >= 0.9
    assert not any(g for g, (_, _, s) in zip(gone, pairs) if s < 0.8)


@pytest.mark.parametrize("block", [4_000, 7])
def test_groups_against_all_pairs_of_shingles(spark, block):
    """Chains and groups of near copies, also compared block by block."""
    r, rows = random.Random(9), []
    for g in range(4):
        words = [f"g{g}w{r.randrange(900)}" for _ in range(300)]
        for i in range(25):
            rows.append((g * 1_000 + i, " ".join(words)))
            words = edited(r, words, "new", 3)  # each is like the one before
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if i // 1_000 == j // 1_000 and jaccard(a, b) >= 0.8:
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    kept = {x.doc_id for x in simhash.keep_one(documents(spark, rows), block=block).collect()}
    assert kept == {i for i, _ in rows if root(i) == i}


def test_exact_links_of_a_group():
    base = np.arange(100, dtype=np.uint64)
    sets = [base, base[:90], base[:80], base[:79], np.arange(500, 600, dtype=np.uint64)]
    near = np.zeros((5, simhash.SEEDS), np.int64)
    found, roots = simhash.exact_links(np.array([11, 12, 13, 14, 15]), near, sets)
    assert dict(zip(found, roots)) == {12: 11, 13: 11, 14: 11}  # 14 through 12 and 13
    far = near.copy()
    far[1:] = np.int64(0b1111)
    assert simhash.exact_links(np.array([11, 12]), far[:2], sets[:2]) == ([], [])


def test_attach_by_key_with_a_hot_key(spark):
    left = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    per = common.stored(left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")), "test")
    out = common.attach_by_key(left, per, "k", "n")
    assert out.count() == 3_000 and out.filter("k = 0").select("m").distinct().first()[0] == 2_997
