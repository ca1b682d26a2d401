"""The engine's four calls over DataFrames: split, parse, score, analyze; and its capabilities."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import REFERENCE_YEAR, SUFFIXES
from ..operators import extract, reconcile, score as rubric, sections, segment


def split(docs: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    return segment.split(docs, cuts)


def segment_rows(packets: DataFrame, preview: int = 200) -> DataFrame:
    """A row for each segment, with a preview of its text."""
    s = F.posexplode("segments").alias("seg_no", "s")
    return packets.select("doc_id", s).select(
        "doc_id", "seg_no", "s.category", "s.start_page", "s.end_page", "s.confidence", extract.preview(F.col("s.text"), preview).alias("preview")
    )


def parse(docs: DataFrame, external: DataFrame | None = None, cuts: DataFrame | None = None, reference_year: int = REFERENCE_YEAR) -> DataFrame:
    """docs (doc_id, raw_text, pages if any) with profile. Without pages a document is one page."""
    if "pages" in docs.columns:
        docs = split(docs, cuts).withColumn("_text", F.col("primary_text"))
    else:
        docs = docs.withColumn("_text", F.col("raw_text"))
    out = extract.with_profile(sections.normalise(docs, "_text"), reference_year)
    return (reconcile.reconcile(out, external) if external is not None else out).drop("_text")


def score(profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    return rubric.score(profiles, jobs)


def analyze(docs: DataFrame, jobs: DataFrame, external: DataFrame | None = None, reference_year: int = REFERENCE_YEAR) -> DataFrame:
    return score(parse(docs, external, reference_year=reference_year), jobs)


class Metrics:
    """Rows, errors, scanned documents, characters and seconds of each layer, counted while the rows pass, by one action.

    analyze() goes through watch() at each layer; report() has the figures once an action on the result is done. They are
    of the attempts that gave the result; a lost executor's tasks that run again are not counted twice.
    """

    def __init__(self):
        self.layers: list[tuple[str, Observation]] = []
        self.began = time.time()

    def watch(self, df: DataFrame, layer: str) -> DataFrame:
        has = lambda name, value: value if name in df.columns else F.lit(0)
        text = "clean_text" if "clean_text" in df.columns else "raw_text"
        counts = {
            "rows": F.count(F.lit(1)), "errors": F.sum(has("error", F.col("error").isNotNull().cast("long"))),
            "scanned": F.sum(has("is_scanned", F.col("is_scanned").cast("long"))), "chars": F.sum(has(text, F.length(text).cast("long"))),
        }
        self.layers.append((layer, seen := Observation()))
        return df.observe(seen, *[F.coalesce(v.cast("long"), F.lit(0)).alias(k) for k, v in counts.items()])

    def report(self, spark: SparkSession) -> DataFrame:
        """layer, n_rows, n_errors, n_scanned, n_chars, seconds (since the plan was begun)."""
        seconds = time.time() - self.began
        rows = [(i, layer, *[int(seen.get[k]) for k in ("rows", "errors", "scanned", "chars")], seconds) for i, (layer, seen) in enumerate(self.layers)]
        return spark.createDataFrame(rows, "layer_no int, layer string, n_rows long, n_errors long, n_scanned long, n_chars long, seconds double")


def watched(docs: DataFrame, jobs: DataFrame, metrics: Metrics, reference_year: int = REFERENCE_YEAR) -> DataFrame:
    """analyze() with figures of each layer."""
    docs = metrics.watch(docs, "ingestion")
    clean = metrics.watch(sections.normalise(docs, "raw_text"), "normalisation")
    profiles = metrics.watch(extract.with_profile(clean, reference_year), "extraction")
    return metrics.watch(score(profiles, jobs), "scoring")


def capabilities(spark: SparkSession) -> DataFrame:
    """One row: what this engine reads and how it works."""
    return spark.range(1).select(
        F.lit("healthy").alias("status"), F.lit("heuristic").alias("mode"), F.array(*[F.lit(s) for s in SUFFIXES]).alias("formats"),
        F.lit(REFERENCE_YEAR).alias("reference_year"), F.array(*[F.lit(x) for x in ("ingestion", "segmentation", "normalisation", "extraction", "scoring")]).alias("layers"),
    )
