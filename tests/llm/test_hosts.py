import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import hosts

from .helpers import awkward, documents, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def failures(text):
    n, chars, symbols, dup, repeats, lines = measures(text)
    return n < 50, 2 * repeats > n, 10 * symbols > n, 10 * dup > 3 * lines, n > 0 and not 2 * n <= chars <= 12 * n


def kept_plainly(rows):
    per = defaultdict(list)
    for _, text, source in rows:
        if source is not None:
            found = re.match(hosts._ADDRESS, source)
            per[(found[1] if found else source).lower()].append(failures(text))
    bad = set()
    for rule in range(5):
        n, f = {h: len(x) for h, x in per.items()}, {h: sum(y[rule] for y in x) for h, x in per.items()}
        total = sum(n.values())
        mean = sum(f.values()) / total
        spread = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n)
        within, between = mean * (1 - mean), len(n) - 1
        room, beyond = within * (total - sum(x * x for x in n.values()) / total - between), spread - within * between
        k = 10_000 if room <= 0 or beyond <= 0 else min(10_000, max(2, room / beyond - 1))
        bad |= {h for h in n if (f[h] + mean * k) / (n[h] + k) > 0.5}
    return bad


def good(i):
    return " ".join(f"word{i}x{j}" for j in range(60))


HOSTS = [
    *[(i, good(i), f"https://User@News.example:8080/{i}") for i in range(90)],
    *[(1000 + i, good(i), f"page{i % 7}") for i in range(90)],
    *[(100 + i, good(i) if i < 2 else "buy now buy now buy now", "http://spam.example/?q=1") for i in range(30)],
    *[(200 + i, "one short text", f"single{i}.example") for i in range(3)],
    (300, good(300), None),
    *[(400 + i, good(i) + " | # $ | # $ | #" * 3, "SYMBOLS") for i in range(20)],
]


def test_hosts_against_plain_rules(spark):
    docs = documents(spark, [(i, t, "en", s) for i, t, s in HOSTS])
    got = {r["doc_id"]: r for r in hosts.judge(docs).collect()}
    bad = kept_plainly(HOSTS)
    assert bad == {"spam.example", "symbols"}
    for i, text, source in HOSTS:
        n, chars, symbols, dup, repeats, _ = measures(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeats)
        assert r["base_failed"] == (n < 50 or 2 * repeats > n) and r["host_failed"] == (r["host"] in bad)
        assert r["kept"] == (not r["base_failed"] and r["host"] not in bad)
    assert not got[100]["kept"] and not got[100]["base_failed"] and got[0]["kept"] and got[300]["kept"] and got[0]["host"] == "news.example"
    other = hosts.judge(docs, broadcast_hosts=0)  # the way without a broadcast
    assert Counter(map(tuple, other.collect())) == Counter(map(tuple, got.values()))


def test_awkward_rows(spark):
    docs = awkward(spark, (20, "a b c a b c a b"), (21, "x y z\n\nx y z\n \nx y z"), (22, "a b\vc\fd\re  a b c d"), (23, "é日😀 é日😀 é日😀 é日😀"), (24, "a b"), (25, "a b c"))
    got = Counter(tuple(r) for r in hosts.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept").collect())
    want = Counter()
    for r in docs.collect():
        n, chars, symbols, dup, repeats, _ = measures(r["text"])
        want[(r["doc_id"], n, chars, symbols, dup, repeats, not (n < 50 or 2 * repeats > n))] += 1
    assert got == want
    assert hosts.judge(docs.limit(0)).count() == 0


def test_hot_host(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("too short").alias("text"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("h"), F.col("id"))).alias("source"))
    rows = hosts.judge(docs).groupBy("host_failed").count().collect()
    assert sum(r["count"] for r in rows) == 20_000 and all(r["host_failed"] for r in rows)


def test_no_python_on_the_main_path(spark):
    plan = hosts.measure(documents(spark, [(1, "a b c", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", None])
def test_sql(spark, tmp_path, folder):
    folder = folder or write(tmp_path, documents=documents(spark, [(i, t, "en", s) for i, t, s in HOSTS]))
    got = hosts.op13_host_rules(spark, folder)
    duck = duckdb.connect()
    path = f"{folder}/documents.parquet" if folder.startswith("/root") else f"{folder}/documents.parquet/*.parquet"
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({hosts.OP13_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want
