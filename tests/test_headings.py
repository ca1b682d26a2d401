"""The table of headings against the row-wise form and against patterns in plain Python."""

import random
import re

from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators import headings, sections

BITS = [
    "skills", "Skills &", "abilities", "EXPERIENCE", "Work", "history", "where", "I've", "I", "have", "worked", "expérience", "professionnelle", "Certifications", "obtenues", "profıle", "PROFİLE",
    "ſummary", "overview", "x", "é", "(", ")", "[", "]", ":", "|", "-", "=", "*", "#", "1.", "2)", "//", "&", "\t", "_", "tech", "stack", "of", "a longer run of words that says nothing", "🙂",
]


def texts():
    r = random.Random(8)
    line = lambda: "".join(r.choice(BITS) + r.choice([" ", " ", "", ": "]) for _ in range(r.randint(1, 6)))
    return [None, "", "\n\n", "Skills", "Skills: C", "Skills: c", "Work (History)\nA\nSkills\nB\n\nWork history | more\nC", *["\n".join(line() for _ in range(r.randint(1, 9))) for _ in range(700)]]


def test_fixed_headings_as_rows_and_as_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "k int, t string").repartition(4)
    got = {(r.k, r.line_no): (r.section, r.tail) for r in headings.find(docs, "k", F.col("t"), headings.fixed(spark)).collect()}
    one_by_one = docs.select("k", F.posexplode(F.transform(F.split("t", "\n"), T.strip)).alias("line_no", "line")).select("k", "line_no", sections.header(F.col("line")).alias("h")).filter("h is not null")
    want = {(r.k, r.line_no): (r.h.section, r.h.tail) for r in one_by_one.collect()}
    assert len(want) > 500 and got == want
    assert got[6, 0] == ("experience", None) and got[6, 5] == ("experience", "more")
    mine = {(r.k, r.section): r.content for r in headings.contents(docs, "k", F.col("t"), headings.fixed(spark)).collect()}
    maps = docs.select("k", F.explode(sections.section_map(F.col("t"))).alias("section", "content")).collect()
    assert mine == {(r.k, r.section): r.content for r in maps} and mine[6, "experience"] == "A\n\nmore\nC"


def test_own_headings(spark):
    names = [("Über uns", "about", 2), ("uns", "other", 3), ("C++ / C#", "code", 1), ("über  UNS", "late", 9), ("--", "none", 0), ("", "none", 0), (None, "none", 0), ("straße 9", None, 4)]
    table = spark.createDataFrame(names, "name string, section string, rank int")
    lines = ["ÜBER   UNS", "uns: a tail", "## c++ / C# ##", "c", "Über uns: x", "über uns - xy", "für uns alle", "runs", "straße 9", "*" * 60, "uns " * 13, "x " * 30 + "uns"]
    docs = spark.createDataFrame([("d", "\n".join(lines), "x"), ("e", None, "x"), ("f", "", "x")], "doc string, body string, section string")
    got = {r.line_no: (r.section, r.tail) for r in headings.find(docs, "doc", F.col("body"), table).collect()}
    assert got == {0: ("about", None), 1: ("other", "a tail"), 2: ("code", None), 4: ("about", None), 5: ("about", "xy"), 6: ("other", None), 8: (None, None), 10: ("other", " ".join(["uns"] * 12))}
    assert headings.find(docs, "doc", F.col("body"), table.limit(0)).count() == 0 == headings.find(docs.limit(0), "doc", F.col("body"), table).count()


def test_long_lines_are_read_by_their_beginning(spark):
    table = spark.createDataFrame([("ſtreet of İstanbul", "a", 1), ("uns", "b", 2), ("ς", "c", 3)], "name string, section string, rank int")
    words = "wort " * 40
    cases = {
        "Street OF  istanbul: " + words: ("a", words.strip()), "Street of " + words: None, "## uns | " + words: ("b", words.strip()), words + "uns": None, "(uns) " + words: None,
        "Ж" * 50 + " uns": None, "*" * 80 + "1. uns" + ":" * 80: ("b", None), "(" * 60 + "uns" + ")" * 60: ("b", None), "x" * 46 + " uns": ("b", None), "x" * 47 + " uns": None, "Σ - " + words: ("c", words.strip()),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    found = headings.find(docs, "k", F.col("t"), table)
    assert {r.k: (r.section, r.tail) for r in found.collect()} == {k: v for k, v in enumerate(cases.values()) if v}
    try:
        headings.BEGINNING = 2  # names with more words: the whole line is read
        assert sorted(headings.find(docs, "k", F.col("t"), table).collect()) == sorted(found.collect())
    finally:
        headings.BEGINNING = 100
    assert "translate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # which looks up each character


def test_large_tables_of_headings(spark):
    table = spark.range(100_000).select(F.concat(F.lit("chapter "), F.col("id"), F.lit(" of the book")).alias("name"), F.concat(F.lit("s"), F.col("id") % 7).alias("section"), F.col("id").alias("rank"))
    docs = spark.range(400).select("id", F.concat(F.lit("# Chapter "), F.col("id") * 200, F.lit(" OF THE book: ab\ntext\nchapter x of the book")).alias("t"))
    found = headings.find(docs, "id", F.col("t"), table)
    assert found.count() == 400 and found.filter("tail = 'ab' and line_no = 0").count() == 400
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "NestedLoop" not in plan and "Python" not in plan
    big = headings.BROADCAST
    try:
        headings.BROADCAST = 10  # joins without a hint give the same rows
        assert sorted(headings.find(docs, "id", F.col("t"), table).collect()) == sorted(found.collect())
    finally:
        headings.BROADCAST = big


def test_names_of_patterns():
    for section, patterns in sections.SECTIONS.items():
        for p in patterns:
            assert all(re.fullmatch(p, name) for name in headings._plain(p))


def test_documents_are_never_sent_to_the_driver(spark):
    """Composed texts look small to Spark: by its guess from the ids whole documents would be broadcast."""
    docs = spark.range(50).select("id", F.concat(F.lit("Skills\n"), F.col("id")).alias("t"))
    found = headings.contents(docs, "id", F.col("t"), headings.fixed(spark))
    last = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    joins = [line for line in last if "Join " in line]
    assert "SortMergeJoin [id" in joins[0] and not any("Join [id" in j for j in joins[1:]) and found.count() == 50
