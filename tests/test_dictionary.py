"""The dictionary search against a pattern for each name, and the merging of providers' replies."""

import random
import re

from pyspark.sql import functions as F

from lumenfold.operators import dictionary, reconcile

NAMES = [".net", "asp.net", "c++", "c#", "c", "node.js", "ci/cd", "spring boot", "spring", "r&d", "x y z", "a.", "(q)", "é tude", "--", ""]
BITS = [*NAMES, "Net", "boot", "js", ".", " ", "\n", "/", "#", "+", "_", "c", "9", "é", "tude", "x", "y", "z", "q", ")"]


def by_patterns(text, before="."):
    low = (text or "").lower()
    return {n for n in NAMES if re.search(r"[\w#+]", n) and re.search(rf"(?<![\w#+{before}]){re.escape(n)}(?![\w#+])", low)}


def test_names_against_patterns(spark):
    r = random.Random(4)
    texts = [None, "", "...", "C++ and .NET, ASP.NET; c#", *["".join(r.choice(BITS) + r.choice(["", " ", ""]) for _ in range(r.randint(1, 12))) for _ in range(1_500)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    names = spark.createDataFrame([(n, n.upper()) for n in NAMES], "name string, shown string")
    for before in (".", ""):
        found = {}
        for row in dictionary.find(docs, "k", F.col("t"), names, before).collect():
            assert row.shown == row.name.upper() and row.name not in found.setdefault(row.k, set())
            found[row.k].add(row.name)
        for k, t in enumerate(texts):
            assert found.get(k, set()) == by_patterns(t, before), t


def test_large_tables_of_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("term "), F.col("id")).alias("name"))
    docs = spark.range(500).select("id", F.concat_ws(", ", F.lit("Term 7"), F.concat(F.lit("TERM "), F.col("id") * 100), F.lit("term x")).alias("t"))
    assert dictionary.find(docs, "id", F.col("t"), names).count() == 1_000
    plan = dictionary.find(docs, "id", F.col("t"), names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "NestedLoop" not in plan
    assert dictionary.find(docs.limit(0), "id", F.col("t"), names).count() == 0 == dictionary.find(docs, "id", F.col("t"), names.limit(0)).count()


def test_replies_merge_in_order(spark):
    own = spark.createDataFrame([(i, f"text of {i} with me@x.org") for i in range(5)], "doc_id long, clean_text string")
    own = own.withColumn("profile", F.from_json(F.lit('{"contact":{"name":"Own","email":"own@x.org","phone":"1"},"skills":["SQL"]}'), reconcile.PROFILE))
    replies = [
        (1, "b", '{"contact":{"name":"B","email":"me@x.org","phone":"2"},"skills":["sql","Go"]}'), (1, "a", '{"contact":{"name":"A","email":"not@there.org"}}'), (1, "c", '{"contact":{"name":"C"}}'),
        (2, "a", "no json"), (2, "b", '{"contact":{"name":"B"}}'), (3, "a", "[]"), (3, "b", None), (4, "a", '{"summary":"S"}'), (4, "a", '{"summary":"T"}'), (9, "a", '{"summary":"S"}'),
    ]
    got = {r.doc_id: r for r in reconcile.merge_providers(own, spark.createDataFrame(replies, "doc_id long, provider string, reply string"), ["a", "b"]).collect()}
    assert len(got) == 5 and got[0].providers == [] and got[0].profile.contact.name == "Own"
    c = got[1].profile.contact
    assert (c.name, c.email, c.phone, got[1].profile.skills, got[1].providers) == ("A", "me@x.org", "2", ["Go", "sql"], ["a", "b"])
    assert got[2].profile.contact.name == "B" and got[2].providers == ["b"] and got[3].providers == [] and got[4].profile.summary == "S"
    bad = reconcile.parse_replies(spark.createDataFrame(replies, "doc_id long, provider string, reply string")).filter("error is not null").collect()
    assert sorted((r.doc_id, r.provider) for r in bad) == [(2, "a"), (3, "a"), (3, "b")]
