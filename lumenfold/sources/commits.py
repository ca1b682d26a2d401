"""JSON in partitions with commits: readers see whole versions, reruns replace only the partitions that they write.

Below path, data/<run>/<column>=<value>/ holds what a run wrote and manifest/<version>.json names, for every
partition, the folder that is valid. A version is written last, under the next number, by a create that fails if
the file exists; then the run reads the newer version and tries again, so concurrent runs on different
partitions both stand (where the store's create is atomic, as on HDFS and local disks). A failed run leaves a folder
that no version names. The number of partitions is bounded: the manifest names each.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .shared import Store

TRIES = 100


def _folders(store: Store, at: str, columns: int) -> list[str]:
    """Partition folders of a run, `columns` deep."""
    inner = [n for n in store.names(at) if "=" in n]
    return inner if columns == 1 else [f"{n}/{m}" for n in inner for m in _folders(store, f"{at}/{n}", columns - 1)]


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in Store(spark, path).names(f"{path}/manifest") if n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """Partition -> folder below path, as of a version or the last one."""
    known = versions(spark, path)
    if not known:
        return {}
    number = known[-1] if version is None else version
    return json.loads(spark.read.option("wholetext", "true").text(f"{path}/manifest/{number:09d}.json").first()[0])["partitions"]


def write(df: DataFrame, path: str, *by: str) -> int:
    """Write df, replacing the partitions (by the columns `by`) that it has rows of; the new version's number."""
    spark, run = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("ignoreNullFields", "false").json(f"{path}/{run}")
    store = Store(spark, path)
    own = {p: f"{run}/{p}" for p in _folders(store, f"{path}/{run}", len(by))}
    for _ in range(TRIES):
        known = versions(spark, path)
        number = (known[-1] if known else 0) + 1
        body = {"by": list(by), "partitions": manifest(spark, path) | own}
        try:
            store.create(f"{path}/manifest/{number:09d}.json", json.dumps(body))
            return number
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
    raise RuntimeError(f"{TRIES} other runs committed meanwhile")


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one if none is named. schema: also of the partition columns."""
    found = manifest(spark, path, version)
    out = None
    runs = sorted({"/".join(f.split("/")[:2]) for f in found.values()})
    for run in runs:  # as many as runs that still hold a valid partition
        own = [f"{path}/{f}" for f in found.values() if f.startswith(run + "/")]
        part = spark.read.schema(schema).option("basePath", f"{path}/{run}").json(own)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
