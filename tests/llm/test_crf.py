import itertools
import random

import numpy as np

from pyspark.sql import functions as F

from lumenfold.llm import common, crf

from .helpers import awkward, documents, write

PARTS = {"aa": ["ing", "the", "sh", "ou"], "bb": ["ñé", "llo", "que", "ja"], "cc": ["sch", "keit", "ung", "ö"]}


def text(lang, r, n=40):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def chains(seed=0):
    r = random.Random(seed)
    return crf.training_chains([(text(lang, r), i) for _ in range(40) for i, lang in enumerate(PARTS)])


def fitted():
    field = crf.Field(list(PARTS))
    field.fit(chains())
    return field


def test_forward_backward_sums_over_all_paths():
    r = np.random.default_rng(1)
    field = crf.Field(["x", "y", "z"])
    field.step, field.start = r.normal(size=(3, 3)), r.normal(size=3)
    for n in (1, 2, 4):
        e = r.normal(size=(1, 5, 3))
        mask = np.arange(5)[None] < n
        e[~mask] = 0
        want, total = np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(field.start[path[0]] + sum(e[0, t, y] for t, y in enumerate(path)) + sum(field.step[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose(field.marginals(e, mask)[0, :n], want / total)


def test_code_switched_words():
    field, r = fitted(), random.Random(9)
    a, b = text("aa", r, 30), text("cc", r, 30)
    labels = [lang for _, lang in crf.label_words(field, a + " " + b)]
    assert sum(x == y for x, y in zip(labels, ["aa"] * 30 + ["cc"] * 30)) >= 55


def test_held_out_accuracy(spark, tmp_path):
    r = random.Random(2)
    rows = [(1_000 + i, text(lang, r, r.randint(5, 200)), lang) for i in range(300) for lang in [r.choice(list(PARTS))]]
    rows += [(5_000, "12 34 !?", "aa"), (5_001, "ing " * 100_000, None)]
    docs = awkward(spark, *rows)
    found = crf.op8_language_id(spark, write(tmp_path, documents=docs)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(found) == docs.count() and all(0 <= x.score <= 1 for x in found)
    held = [(x.lang_pred, truth[x.doc_id]) for x in found if x.held_out and 1_000 <= (x.doc_id or 0) < 5_000]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97
    by = {x.doc_id: x for x in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 5_000)) and by[5_001].lang_pred == "aa"


def test_rare_languages_are_learned(spark):
    r = random.Random(4)
    rows = [(i, text("aa", r, 12), "aa") for i in range(3_000)] + [(9_000 + i, text(lang, r, 12), lang) for i in range(6) for lang in ("bb", "cc")]
    docs = documents(spark, rows)
    field = crf.train(docs, 60)
    assert field.labels == ["aa", "bb", "cc"]
    assert [crf.label_words(field, text(lang, r, 40))[5][1] for lang in PARTS] == list(PARTS)


def test_numerals_are_no_letters():
    assert [crf.words_of(t) for t in ("½ ²", "Ⅷ", "①②", "x² y½z 3rd", "été")] == [[], [], [], ["x", "y", "z", "rd"], ["été"]]


def test_sample_is_bounded(spark):
    """One id, or none, in every row: the fit still takes so many rows and bytes at most."""
    for one in ("CAST(7 AS LONG)", "CAST(NULL AS LONG)"):
        docs = spark.range(20_000).selectExpr(f"{one} AS doc_id", "concat('text ', id) AS text")
        size = F.octet_length("text")
        assert common.bounded_sample(docs, 150, size).count() <= 150
        assert common.bounded_sample(docs, 150, size, 100).agg(F.sum(size)).first()[0] <= 100
    rows = docs.selectExpr("doc_id", "'one row' AS text")
    assert common.bounded_sample(rows, 150, F.octet_length("text")).count() <= 1


def test_repeats_take_no_room_in_samples(spark):
    size = F.octet_length("text")
    for doc_id in ("id", "CAST(NULL AS LONG)"):
        rows = spark.range(200_000).selectExpr(f"{doc_id} AS doc_id", "concat('text ', id % 300) AS text").select("text")
        assert common.bounded_sample(rows, 1_500, size).count() == 300
    few = spark.range(927).selectExpr("concat('text ', id) AS text")
    rows = few.union(spark.range(60_000).selectExpr("'one text' AS text"))
    assert common.bounded_sample(rows, 4_000, size).count() == 928
    assert common.bounded_sample(rows, 500, size).count() == 500
    # one very long row doesn't fill the bytes
    long = few.union(spark.range(1).selectExpr("repeat('long ', 20000) AS text"))
    assert common.bounded_sample(long, 2_000, size, 30_000).count() == 927


def test_samples_of_groups(spark):
    rows = spark.range(30_000).selectExpr("concat('a ', id) AS text", "'a' AS lang").union(spark.range(30_000).selectExpr("'one text' AS text", "'b' AS lang"))
    rows = rows.union(spark.range(70).selectExpr("concat('c ', id) AS text", "'c' AS lang")).union(spark.range(9).selectExpr("'x' AS text", "CAST(NULL AS STRING) AS lang"))
    counts = lambda *a: {r["lang"]: r["count"] for r in common.sample_of_each(rows, "lang", *a).groupBy("lang").count().collect()}
    found = counts(1_000, 50, F.octet_length("text"))
    assert set(found) == {"a", "b", "c"} and found["b"] == 1 and found["c"] == 50 and 990 <= found["a"] <= 1_000
    assert counts(1_000, 50, F.octet_length("text"), 1) == {"a": 1, "b": 1, "c": 1}
    assert counts(40_000, 50, F.octet_length("text"))["a"] == 30_000
    assert common.sample_of_each(rows.limit(0), "lang", 10, 5, F.octet_length("text")).count() == 0


def test_language_of_one_repeated_text(spark):
    r = random.Random(5)
    rows = documents(spark, [(i, text(lang, r, 12), lang) for i in range(300) for lang in ("aa", "bb")], extra=False)
    again = text("cc", r, 30)
    copies = spark.range(30_000).selectExpr("id + 1000 AS doc_id", f"'{again}' AS text", "'cc' AS lang", "'s' AS source", "0L AS n_chars")
    found = crf.predict(rows.union(copies), crf.train(rows.union(copies))).groupBy("lang_pred").count().collect()
    assert {x["lang_pred"]: x["count"] for x in found}["cc"] >= 30_000


def test_nothing_to_learn(spark, tmp_path):
    found = crf.op8_language_id(spark, write(tmp_path, documents=documents(spark, [(1, "some words")]))).collect()
    assert [(x.lang_pred, x.score) for x in found] == [("und", 0.0)]
    assert crf.op8_language_id(spark, write(tmp_path / "e", documents=documents(spark, []))).count() == 0
