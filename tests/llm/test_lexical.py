import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import lexical

from .helpers import awkward, documents, write

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n, total = len(found), sum(x for _, _, x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, length in found:
            m, s = 10 + (90 * length * n) // total, 0
            for t in set(plain_terms(text)):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return Counter(out)


def random_text(r, n):
    return " ".join(f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(n))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_terms(text):
    text = text.encode("utf-8", "replace").decode()
    assert [t.decode() for t in lexical.terms_of(text.encode())] == plain_terms(text)


def test_search_is_exact_and_prunes():
    r = random.Random(1)
    texts = [random_text(r, r.randint(1, 80)) for _ in range(3_000)]
    texts += [texts[5]] * 40  # ties
    run = lexical.Run()
    for i, t in enumerate(texts):
        run.add(7_000 - i, lexical.terms_of(t.encode()))
    b = run.batch(lexical.pa.int64())
    col = dict(zip(b.schema.names, b.columns))
    n, total = col["n_docs"][0].as_py(), col["n_terms"][0].as_py()
    dfs = col["dfs"][0].values.to_numpy()
    at = np.concatenate([[0], np.cumsum(dfs)])
    docs, tfs = np.frombuffer(col["docs"][0].as_py(), "<u2"), np.frombuffer(col["tfs"][0].as_py(), "<u1")
    m = 10 + (90 * col["lengths"][0].values.to_numpy() * n) // total
    trees = lexical.Trees(docs, tfs, np.stack([at[:-1], at[1:]], axis=1), m, col["doc_ids"][0].as_py())
    number = {t: i for i, t in enumerate(col["terms"][0].as_py())}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in dfs.tolist()])
    items = [(0, texts[5]), (1, "w250 w251 w299"), (2, "w1 w2 w270"), (3, "w290"), (4, texts[17])]
    got = Counter()
    for item, text in items:
        rows = np.array(sorted({number[t] for t in plain_terms(text) if t in number}))
        best = lexical.Best(10)
        trees.search(rows, weights[rows], best)
        got.update((item, k + 1, i, -s) for k, (s, _, i) in enumerate(best.rows))
    assert got == brute([(7_000 - i, t) for i, t in enumerate(texts)], items)
    assert trees.opened < 0.5 * len(items) * len(trees.levels[0][0]) and len(trees.levels) == 3


def test_tables(spark):
    r = random.Random(2)
    rows = [(100 + i, random_text(r, r.randint(1, 60))) for i in range(400)] + [(50, "w1 w2 Größe x"), (50, "w1 w2 Größe x"), (None, "w1 w2 größe X"), (49, "ß-w299,W299")]
    docs = awkward(spark, *rows)
    plain = [(x["doc_id"], x["text"]) for x in docs.collect()]
    items = [(1, "W1 größe x"), (1, "w299"), (1, "w299"), (2, "nothing known here zzz"), (3, None), (4, ""), (None, "same text w7"), (5, "w3 w3 w3 long")]
    bench = spark.createDataFrame([(*x, "own", 1) for x in items], "item_id long, text string, doc_id string, rank int")
    want = brute(plain, [x for x in items if x[1]])
    got = lambda **o: Counter(map(tuple, lexical.search(lexical.index(docs.repartition(3), **o), bench).collect()))
    assert got() == want
    assert got(docs_in_run=16) == want and got(postings=1) == want
    small = lexical.search(lexical.index(docs), bench, block_words=4)
    assert Counter(map(tuple, small.collect())) == want
    assert lexical.search(lexical.index(docs.limit(0)), bench).count() == 0 == lexical.search(lexical.index(docs), bench.limit(0)).count()


def test_many_copies(spark):
    r = random.Random(3)
    rows = [(i, "the hot text of many copies") for i in range(3_000)] + [(5_000 + i, random_text(r, 20)) for i in range(500)]
    bench = spark.createDataFrame([(1, "hot copies"), (2, "w5 w9")], "item_id long, text string")
    got = lexical.search(lexical.index(documents(spark, rows), docs_in_run=256), bench)
    assert Counter(map(tuple, got.collect())) == brute(rows, [(1, "hot copies"), (2, "w5 w9")])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", None])
def test_sql(spark, tmp_path, folder):
    files = "{}.parquet"
    if folder is None:
        files = "{}.parquet/*.parquet"
        bench = spark.createDataFrame([(1, "same text"), (1, "long 日本語 x"), (None, "here nul")], "item_id long, text string")
        folder = write(tmp_path, documents=awkward(spark), benchmark=bench)
    got = lexical.op11_lexical_search(spark, folder)
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{files.format(t)}'")
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({lexical.OP11_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want
