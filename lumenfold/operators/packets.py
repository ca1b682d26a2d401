"""Packets as tables of pages (doc_id, page_no, page), for packets of any number of pages: none is ever one cell.

Pages are numbered and runs of one label found in ranges of `RANGE` pages, which are windows of bounded size; what a range needs
of those before it (the last label, how many pages and runs there were) comes from a table with a row for each range.
Page ranges of an external model meet the pages by ranges too. A segment is a row without its text;
segment_pages() says which pages it holds, and texts() joins the text of those that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segment import page_category

RANGE = 1_000


def numbered(pages: DataFrame) -> DataFrame:
    """pages with place (from 1, in the order of page_no), label and run (from 1) of each page in its packet."""
    at = F.floor(F.col("page_no") / RANGE)
    rows = pages.select("doc_id", "page_no", "page", page_category(F.col("page")).alias("label"), at.alias("range"))
    inside = W.partitionBy("doc_id", "range").orderBy("page_no")
    rows = rows.withColumn("before", F.lag("label").over(inside))
    ranges = rows.groupBy("doc_id", "range").agg(
        F.count("*").alias("n"), F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("label"))).alias("turns"), F.min_by("label", "page_no").alias("first"), F.max_by("label", "page_no").alias("last")
    )
    order = W.partitionBy("doc_id").orderBy("range")
    ranges = ranges.withColumn("ahead", F.lag("last").over(order))
    opens = (F.col("ahead").isNull() | (F.col("ahead") != F.col("first"))).cast("int")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c, name: F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(name)
    ranges = ranges.withColumn("opens", opens).select("doc_id", "range", "opens", so_far("n", "pages_before"), so_far(F.col("turns") + F.col("opens"), "runs_before"))
    rows = rows.join(ranges, ["doc_id", "range"])
    # the first page of a range opens a run if the range does, others where the label turns
    new = F.when(F.col("before").isNull(), F.col("opens")).otherwise((F.col("before") != F.col("label")).cast("int"))
    rows = rows.withColumn("new", new).withColumns({"place": (F.row_number().over(inside) + F.col("pages_before")).cast("int"), "run": (F.sum("new").over(inside) + F.col("runs_before")).cast("int")})
    return rows.select("doc_id", "page_no", "page", "label", "place", "run")


def _clipped(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts (doc_id, cut_no, category, start_page, end_page) of packets of over one page, with their ends filled in and n_pages."""
    sizes = rows.groupBy("doc_id").agg(F.max("place").alias("n_pages"))
    start = F.coalesce("start_page", F.lit(1))
    own = cuts.join(sizes, "doc_id").filter("n_pages > 1")
    return own.select("doc_id", (F.col("cut_no") + 1).alias("seg_no"), F.lower(F.coalesce("category", F.lit("other"))).alias("category"), start.cast("int").alias("start_page"), F.coalesce("end_page", start).cast("int").alias("end_page"), "n_pages")


def segment_pages(pages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """doc_id, seg_no, place, page: the pages of each segment; those of overlapping external ranges stand in each."""
    rows = numbered(pages)
    own = rows.select("doc_id", F.col("run").alias("seg_no"), "place", "page")
    if cuts is None:
        return own
    clipped = _clipped(rows, cuts)
    spans = clipped.filter((F.col("start_page") <= F.col("n_pages")) & (F.col("end_page") >= F.greatest("start_page", F.lit(1))))
    low, high = F.greatest("start_page", F.lit(1)), F.least("end_page", "n_pages")
    spans = spans.select("doc_id", "seg_no", low.alias("low"), high.alias("high")).withColumn("range", F.explode(F.sequence(F.floor(F.col("low") / RANGE), F.floor(F.col("high") / RANGE))))
    placed = rows.select("doc_id", "place", "page", F.floor(F.col("place") / RANGE).alias("range"))
    outside = placed.join(spans, ["doc_id", "range"]).filter(F.col("place").between(F.col("low"), F.col("high"))).select("doc_id", "seg_no", "place", "page")
    return own.join(clipped.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(outside)


def split(pages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """doc_id, seg_no, category, start_page, end_page, confidence, is_packet, engine of each segment, as segment.split() gives them."""
    rows = numbered(pages)
    runs = rows.groupBy("doc_id", F.col("run").alias("seg_no")).agg(F.first("label").alias("category"), F.min("place").alias("start_page"), F.max("place").alias("end_page"))
    size = rows.groupBy("doc_id").agg(F.max("run").alias("n_runs"), F.max("place").alias("n_pages"))
    one = F.col("n_pages") == 1
    own = runs.join(size, "doc_id").select(
        "doc_id", "seg_no", "category", "start_page", "end_page", F.when(one, 0.95).otherwise(0.88).alias("confidence"), (F.col("n_runs") > 1).alias("is_packet"),
        F.when(one, "direct_single_page").otherwise("heuristic_boundary").alias("engine"),
    )
    if cuts is None:
        return own
    clipped = _clipped(rows, cuts)
    counts = clipped.groupBy("doc_id").agg(F.count("*").alias("n_cuts"))
    outside = clipped.join(counts, "doc_id").select("doc_id", "seg_no", "category", "start_page", "end_page", F.lit(0.95).alias("confidence"), (F.col("n_cuts") > 1).alias("is_packet"), F.lit("external").alias("engine"))
    return own.join(counts.select("doc_id"), "doc_id", "left_anti").unionByName(outside)


def texts(pages_of: DataFrame) -> DataFrame:
    """doc_id, seg_no and text of segments, from segment_pages(); a text is one cell, so filter to those that fit."""
    own = F.array_sort(F.collect_list(F.struct("place", "page")))
    return pages_of.groupBy("doc_id", "seg_no").agg(F.array_join(F.transform(own, lambda p: p["page"]), "\n\n").alias("text"))
