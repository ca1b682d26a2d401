"""Packets: pages are labelled, runs of one label become segments, résumé segments give the text.

A packet is a row with its array of pages, so segmenting shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T

SEGMENT = "array<struct<category:string,start_page:int,end_page:int,text:string,confidence:double,title:string>>"


def page_category(page: Column) -> Column:
    low = F.lower(page)
    n = sum((T.matches(low, p).cast("int") for p in X.RESUME[1:]), T.matches(low, X.RESUME[0]).cast("int"))
    reachable = T.matches(page, X.EMAIL) & T.matches(page, X.PAGE_PHONE)
    return (
        F.when(page.isNull() | (T.strip(page) == ""), "other").when(T.any_match(low, X.COVER_LETTER), "cover_letter")
        .when(T.any_match(low, X.TRANSCRIPT), "transcripts").when(T.any_match(low, X.JOB_POSTING), "job_description")
        .when((n >= 1) | reachable, "resume").otherwise("other")
    )


def _segment(category: Column, start: Column, end: Column, text: Column, confidence: Column, title: Column) -> Column:
    return F.struct(
        category.alias("category"), start.cast("int").alias("start_page"), end.cast("int").alias("end_page"), text.alias("text"),
        confidence.cast("double").alias("confidence"), title.alias("title"),
    )


def runs(pages: Column) -> Column:
    """Segments of neighbouring pages of one category; pages count from 1. Each text is joined once."""

    def cut(labels: Column) -> Column:
        firsts = F.filter(F.transform(labels, lambda c, i: F.when((i == 0) | (c != F.get(labels, i - 1)), i + 1)), lambda i: i.isNotNull())
        return T.let(firsts, lambda starts: F.transform(starts, lambda s, k: segment(labels, s, F.coalesce(F.get(starts, k + 1) - 1, F.size(labels)))))

    def segment(labels: Column, start: Column, end: Column) -> Column:
        text = F.array_join(F.slice(pages, start, end - start + 1), "\n\n")
        return _segment(F.get(labels, start - 1), start, end, text, F.lit(0.88), F.lit(None).cast("string"))

    return T.let(F.transform(pages, page_category), cut)


def external(pages: Column, cuts: Column) -> Column:
    """Segments from an external model's page ranges (category, start_page, end_page, confidence, title)."""

    def build(c: Column) -> Column:
        start = F.coalesce(c["start_page"], F.lit(1))
        end = F.coalesce(c["end_page"], start)
        own = F.filter(F.transform(pages, lambda p, i: F.struct((i + 1).alias("no"), p.alias("text"))), lambda p: p["no"].between(start, end))
        return _segment(F.lower(F.coalesce(c["category"], F.lit("other"))), start, end, F.array_join(F.transform(own, lambda p: p["text"]), "\n\n"), F.coalesce(c["confidence"], F.lit(0.95)), c["title"])

    return F.transform(cuts, build)


def split(packets: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """packets (doc_id, pages, raw_text) with segments, is_packet, primary_category, primary_text, engine.

    cuts: doc_id and `cuts`, an array of external ranges; where it gives segments they win.
    """
    pages = F.coalesce(F.col("pages"), F.array().cast("array<string>"))
    one = F.size(pages) <= 1
    df = packets
    if cuts is not None:
        df = df.join(cuts.select("doc_id", "cuts"), "doc_id", "left")
    own = F.when(one, F.array(_segment(page_category(F.col("raw_text")), F.lit(1), F.lit(1), F.col("raw_text"), F.lit(0.95), F.lit(None).cast("string")))).otherwise(runs(pages))
    outside = ~one & (F.size("cuts") > 0) if cuts is not None else F.lit(False)
    df = df.withColumn("segments", F.when(outside, external(pages, F.col("cuts"))).otherwise(own) if cuts is not None else own)
    resumes = F.filter("segments", lambda s: s["category"] == "resume")
    return df.withColumns({
        "is_packet": F.size("segments") > 1,
        "primary_category": F.when(F.size(resumes) > 0, "resume").otherwise(F.get("segments", 0)["category"]),
        "primary_text": F.when(~one & (F.size(resumes) > 0), F.array_join(F.transform(resumes, lambda s: s["text"]), "\n\n")).otherwise(F.col("raw_text")),
        "engine": F.when(one, "direct_single_page").when(outside, "external").otherwise("heuristic_boundary"),
    }).drop(*(["cuts"] if cuts is not None else []))


def is_scanned(pages: Column, below: int = X.SCANNED_BELOW) -> Column:
    """Whether the pages together hold too little text to be anything but images."""
    return (F.size(pages) >= 1) & (F.aggregate(pages, F.lit(0), lambda n, p: n + F.length(T.strip(F.coalesce(p, F.lit(""))))) < below)


def previews(pages: Column, n: int = 800) -> Column:
    return F.transform(pages, lambda p: T.strip(F.substring(p, 1, n)))
