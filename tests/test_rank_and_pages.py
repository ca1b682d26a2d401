"""Ranking without scoring all pairs, and packets as tables of pages, against the row-wise ways."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.operators import packets, rank, segment
from lumenfold.operators import score as rubric
from lumenfold.plans import registry, synth

from .conftest import SF


def test_best_candidates_are_those_of_all_pairs(spark, tmp_path):
    profiles = registry.profiles(spark, SF)
    posts = registry.composed(spark, SF, synth.POSTS, "part").filter("job_id <= 25").unionByName(registry.jobs(spark).withColumn("job_id", -F.col("job_id")))
    path = str(tmp_path / "p")
    profiles.select("doc_id", "profile").write.parquet(path)
    stored = spark.read.parquet(path)
    every = rubric.score(stored, posts).select("job_id", "doc_id", F.col("report.overall_score").alias("overall_score"))
    best = W.partitionBy("job_id").orderBy(F.desc("overall_score"), "doc_id")
    want = sorted(map(tuple, every.withColumn("rank", F.row_number().over(best)).filter("rank <= 10").collect()))
    got = sorted(map(tuple, rank.best_candidates(stored, posts).collect()))
    assert got == want
    sigs = rank.signatures(stored, 10)
    _, pairs = rank.candidates(sigs, rubric.with_requirements(posts), 10)
    assert pairs.count() < 0.1 * every.count()


def test_ties_repeated_ids_and_few_candidates(spark, tmp_path):
    profiles = registry.profiles(spark, SF).select("doc_id", "profile").limit(4)
    for docs in (profiles, profiles.limit(0)):
        got = rank.best_candidates(docs, registry.jobs(spark), 10).groupBy("job_id").count().collect()
        assert all(r["count"] == docs.count() for r in got)


LABELS = ["Official transcript", "We are looking for", "projects", "nothing", "", "Dear Hiring Manager,"]


@pytest.mark.parametrize("length", [3, 1_000])
def test_pages_as_rows(spark, monkeypatch, length):
    monkeypatch.setattr(packets, "RANGE", length)
    r = random.Random(6)
    rows = []
    for doc in range(60):
        label = r.choice(LABELS)
        for no in range(1, r.choice((1, 2, 30)) + 1):
            label = r.choice(LABELS) if r.random() < 0.4 else label
            rows.append((doc, no * r.choice((1, 2)) if doc % 2 == 0 and no == 1 else no * 2 + 5, f"{label} {no}"))
    pages = spark.createDataFrame(rows, "doc_id long, page_no long, page string")
    cuts = spark.createDataFrame([(d, 0, "RESUME", 1, 2) for d in range(0, 60, 4)] + [(d, 1, None, 2, None) for d in range(0, 60, 8)] + [(2, 0, "x", None, 99)], "doc_id long, cut_no int, category string, start_page int, end_page int")
    own = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page"))), lambda p: p["page"])
    whole = pages.groupBy("doc_id").agg(own.alias("pages")).withColumn("raw_text", F.array_join("pages", "\n\n"))
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("cut_no", "category", "start_page", "end_page", F.lit(None).cast("double").alias("confidence"), F.lit("t").alias("title")))), lambda c: c.dropFields("cut_no"))
    for outside in (None, cuts):
        plain = segment.split(whole, None if outside is None else outside.groupBy("doc_id").agg(ranges.alias("cuts")))
        plain = plain.select("doc_id", "engine", "is_packet", F.posexplode("segments").alias("i", "s")).select("doc_id", (F.col("i") + 1).alias("seg_no"), "s.category", "s.start_page", "s.end_page", "s.confidence", "is_packet", "engine", "s.text")
        want = sorted(map(tuple, plain.collect()))
        found = packets.split(pages, outside).join(packets.texts(packets.segment_pages(pages, outside)), ["doc_id", "seg_no"], "left")
        got = sorted(map(tuple, found.select("doc_id", "seg_no", "category", "start_page", "end_page", "confidence", "is_packet", "engine", F.coalesce("text", F.lit(""))).collect()))
        assert got == want


def test_a_packet_of_very_many_pages(spark):
    pages = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("page_no"), F.when(F.col("id") % 50_000 < 10, F.lit("projects")).otherwise(F.lit("nothing")).alias("page"))
    found = [(r.category, r.start_page, r.end_page) for r in packets.split(pages).orderBy("seg_no").collect()]
    assert found == [x for k in range(4) for x in (("resume", k * 50_000 + 1, k * 50_000 + 10), ("other", k * 50_000 + 11, (k + 1) * 50_000))]
