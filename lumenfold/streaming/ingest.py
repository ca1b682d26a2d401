"""Arriving files as a stream (an extension): the same stateless transforms as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lexicon import MAX_BYTES
from ..plans.pipeline import parse
from ..sources.files import read_bytes

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    listed = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_trigger).load(path)
    taken = listed.filter(F.col("length") <= MAX_BYTES)
    return read_bytes(taken.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content"))


def run_profiles(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Profiles of the files now under path, appended to out as Parquet; ends when all are read."""
    profiles = parse(stream_documents(spark, path)).select("doc_id", "filename", "profile", "error")
    return profiles.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
