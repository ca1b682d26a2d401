import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from lumenfold.llm import decontam

from .helpers import awkward, documents, write

ITEMS = "item_id long, text string, doc_id long"


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = decontam.words_of(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    sizes, out = sorted({len(k) for k in windows}), []
    for i, t in docs:
        w, hit, found = decontam.words_of(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 300, 2_000])
def test_index(n):
    r = np.random.default_rng(n)
    seq = np.append(r.integers(1, 4, n), 0)
    order = decontam.suffix_order(seq)
    assert order.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
    index = decontam.FMIndex(seq)
    assert index.locate(np.arange(len(seq))).tolist() == order.tolist()
    low, high = index.ranges(np.array([[1, 2, 0], [3, 3, 1]]), np.array([2, 3]))
    text = seq.tolist()
    for phrase, a, b in (([1, 2], low[0], high[0]), ([3, 3, 1], low[1], high[1])):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if text[i : i + len(phrase)] == phrase]


def test_word_classes():
    text = "Äb9_c-D'é日x@a[Z`z{~\x7f0 ß"
    hashes, starts, ends = decontam.word_hashes(text.encode())
    assert [text.encode()[s:e].decode().lower() for s, e in zip(starts, ends)] == [w.lower() for w in decontam.words_of(text)]
    same = decontam.word_hashes(b"Word WORD word Wort " + b"q" * 100 + b" " + b"Q" * 100 + b" " + b"q" * 99)[0]
    assert same[0] == same[1] == same[2] != same[3] and same[4] == same[5] != same[6]


def test_documents_longer_than_a_shard(monkeypatch):
    r = random.Random(7)
    items = [(1, " ".join(r.choice("abc") for _ in range(30))), (2, "a b"), (3, "c")]
    texts = [" ".join(r.choice("abc") for _ in range(n)) + " " + items[0][1] for n in (0, 5, 39, 200)] + ["", "zz"]
    data, bounds = "\n".join(texts).encode(), []
    at = 0
    for t in texts:
        bounds.append((at, at + len(t)))
        at += len(t) + 1
    block = decontam.Block(items)
    whole = decontam.occurrences(data, bounds, lambda: [block])[1]
    monkeypatch.setattr(decontam, "SHARD_WORDS", 40)
    assert [set(x) for x in decontam.occurrences(data, bounds, lambda: [block])[1]] == [set(x) for x in whole]
    apart = [decontam.Block([i]) for i in items]  # each item a block of its own
    assert [set(x) for x in decontam.occurrences(data, bounds, lambda: apart)[1]] == [set(x) for x in whole]
    for (_, n, hit, *_), found in zip(brute(list(enumerate(texts)), items), whole):
        assert len({k for a, b, _ in found for k in range(a, b)}) == hit


def test_contract(spark, tmp_path):
    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "c", "Déjà", "x9"])
    passage = " ".join(word() for _ in range(40))
    items = [(1, passage), (2, "only four short words"), (3, None), (4, ""), (10, passage), (5, " ".join(["a"] * 20)), (6, "--- !!")]
    rows = [(100 + i, " ".join(word() for _ in range(r.randint(0, 200)))) for i in range(40)]
    rows += [(200, "x " * 500 + passage.upper() + " y" * 900), (201, passage), (202, "Only, four; SHORT words!"), (203, "a " * 3_000), (204, passage[: len(passage) // 2])]
    docs = awkward(spark, *rows)
    sf = write(tmp_path, documents=docs, benchmark=spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS))
    ours = sorted((tuple(x) for x in decontam.op2_decontamination(spark, sf).collect()), key=str)
    assert ours == sorted(brute([(x.doc_id, x.text) for x in docs.collect()], items), key=str)
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    assert ours == sorted(duck.execute(decontam.OP2_SQL).fetchall(), key=str)


def test_blocks_of_items_give_the_same(spark, tmp_path, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i} " + " ".join(f"k{j}" for j in range(i, i + 20)), 0) for i in range(6)], ITEMS)
    docs = documents(spark, [(i, " ".join(f"k{j}" for j in range(i, i + 25))) for i in range(10)] + [(99, "clean words")])
    read = lambda: sorted((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], sorted(r["items"]), [tuple(s) for s in r["cut"]], r.contaminated) for r in decontam.find(docs, items).collect())
    whole, kept = read(), sorted(r.doc_id for r in decontam.keep_clean(docs, items).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 30)
    assert len(list(decontam._blocks(items))) > 2 and len(list(decontam._groups(items))) == 1 and read() == whole
    assert sorted(r.doc_id for r in decontam.keep_clean(docs, items).collect()) == kept == [99]
    monkeypatch.setattr(decontam, "BLOCKS", 1)  # a pass for each block
    assert len(list(decontam._groups(items))) > 2 and read() == whole
    assert sorted(r.doc_id for r in decontam.keep_clean(docs, items).collect()) == kept


def test_one_index_for_all_blocks(monkeypatch):
    built = []
    index = decontam.FMIndex
    monkeypatch.setattr(decontam, "FMIndex", lambda seq: built.append(len(seq)) or index(seq))
    text = " ".join(f"w{k}" for k in range(200))
    blocks = [decontam.Block([(i, " ".join(f"w{k}" for k in range(i, i + 15)))]) for i in range(40)] + [decontam.Block([(99, "absent")]), decontam.Block([])]
    found = decontam.occurrences(text.encode(), [(0, len(text))], lambda: blocks)[1][0]
    assert len(built) == 1 and sorted(found) == sorted((k, k + 13, i) for i in range(40) for k in range(i, i + 3))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], ITEMS)
    sf = write(tmp_path, documents=documents(spark, []), benchmark=none)
    assert decontam.op2_decontamination(spark, sf).count() == 0
    assert [r.contaminated for r in decontam.find(documents(spark, [(1, "some words")]), none).collect()] == [False]
