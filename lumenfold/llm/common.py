"""What the corpus operators share: tables, shared storage, deterministic splits, skew-safe joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Used only where a session on one machine names no shared folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/lumenfold"
#: Bytes, at most, that a sample for a fit brings to the driver.
SAMPLE_BYTES = 64 << 20
#: Rows of an Arrow batch of texts, at most: at Spark's own 10,000, a few tasks' batches fill an executor's spare memory.
BATCH_ROWS, BATCH_CONF = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the driver and every executor share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *labels: str) -> list[str]:
    """Column names that df doesn't have."""
    return [f"{label}_{uuid.uuid4().hex[:12]}" for label in labels]


def stored(df: DataFrame, label: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df written once to shared storage and read back: a lineage cut that survives lost executors.

    instead_of: a stored table that nothing reads any more once this one stands; it is deleted.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if instead_of is not None:
        dropped(instead_of)
    return out


def dropped(table: DataFrame) -> None:
    """Delete a stored table."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_ROWS at most; the session keeps that setting, or a smaller one of its own."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    return id_crc(column) % modulus == remainder


def enough(rows: float) -> float:
    """How many rows a threshold on their hashes should let through on average, so that hardly ever fewer than `rows` come."""
    return 1.1 * (rows + 6 * rows**0.5)


def bounded_sample(df: DataFrame, rows: int, size: Column, max_bytes: int = SAMPLE_BYTES, distinct: int | None = None) -> DataFrame:
    """At most `rows` distinct rows of df, and at most max_bytes of them by `size`; only fits of models use it.

    Rows are picked by a hash of all their columns, so a repeated row counts once however often it
    stands, and repeats take no room: the threshold on the hash comes from the number of distinct rows
    (estimated, unless it is given). If there are no more than `rows`, all distinct ones come, up to max_bytes.
    """
    space, (key, upto) = 1 << 40, fresh(df, "key", "upto")
    if distinct is None:
        distinct = df.agg(F.approx_count_distinct(F.xxhash64(*df.columns), 0.02)).first()[0]
    keyed = df.withColumn(key, F.pmod(F.xxhash64(*df.columns), F.lit(space)))
    if distinct > enough(rows):
        keyed = keyed.filter(F.col(key) < max(1, int(space * enough(rows) / distinct)))
    few = keyed.distinct().orderBy(key, *df.columns).limit(rows)
    # few has at most `rows` rows, so one task may sum them up; a row of many times the mean doesn't keep others out
    long = F.coalesce(size, F.lit(0)) > 16 * max_bytes / rows
    running = W.partitionBy(F.lit(0)).orderBy(long, key, *df.columns).rowsBetween(W.unboundedPreceding, 0)
    return few.withColumn(upto, F.sum(size).over(running)).filter(F.coalesce(F.col(upto), F.lit(0)) <= max_bytes).select(*df.columns)


def sample_of_each(df: DataFrame, group: str, rows: int, least: int, size: Column, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Distinct rows of df, about `rows` in all, dealt to the groups by their distinct rows; of each group `least` at least, if it has so many.

    Each group has its share of max_bytes by `size`, but one row whatever its size. Rows whose group is null take no
    part. Groups are few: a row for each reaches the driver.
    """
    space, (key, quota, upto, place) = 1 << 40, fresh(df, "key", "quota", "upto", "place")
    of_group = df.filter(F.col(group).isNotNull())
    counts = of_group.groupBy(group).agg(F.approx_count_distinct(F.xxhash64(*df.columns), 0.02).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    quotas = [(r[group], max(least, -(-rows * r["n"] // total)), r["n"]) for r in counts]
    shares = sum(q for _, q, _ in quotas)
    table = [(g, q, max_bytes * q // shares, space if n <= enough(q) else int(space * enough(q) / n)) for g, q, n in quotas]
    kind = df.schema[group].dataType.simpleString()
    limits = F.broadcast(df.sparkSession.createDataFrame(table, f"`{group}` {kind}, `{quota}` long, bytes long, below long"))  # a row for each group
    keyed = of_group.withColumn(key, F.pmod(F.xxhash64(*df.columns), F.lit(space))).join(limits, group).filter(F.col(key) < F.col("below")).distinct()
    long = size > 16 * F.col("bytes") / F.col(quota)
    order = W.partitionBy(group).orderBy(long, key, *df.columns)  # enough(quota) rows at most, about
    keyed = keyed.withColumn(place, F.row_number().over(order)).withColumn(upto, F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return keyed.filter((F.col(place) <= F.col(quota)) & ((F.col(upto) <= F.col("bytes")) | (F.col(place) == 1))).select(*df.columns)


def attach_by_key(left: DataFrame, per_key: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """left inner-joined with per_key (one row per key, `count` holds its rows in left), whatever the skew.

    A key with over 1/share of the rows is hot. There are fewer than `share` of these, by the
    pigeonhole principle, so they are broadcast; the others are joined by a shuffle, in which
    no key exceeds that share. Null keys match nothing: give them a value before.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = per_key.filter(F.col(count) > max(total / share, 64))
    direct = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key, key)
    return direct.unionByName(rest)


def lookup(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """left outer join of a stored table with right, which has one row for each key, whatever the skew of left.

    Keys with over 1/share of left's rows, of which there are fewer than `share`, meet right by a broadcast.
    """
    least = max(left.count() // share, 1000)
    counts = left.groupBy(key).count().filter(F.col("count") > least).select(key)
    if not counts.limit(1).count():
        return left.join(right, key, "left")
    hot = F.broadcast(right.join(F.broadcast(counts), key, "left_semi"))  # fewer than `share` rows
    keys = F.broadcast(counts)
    return left.join(keys, key, "left_semi").join(hot, key, "left").unionByName(left.join(keys, key, "left_anti").join(right, key, "left"))


def inline(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of numbers and plain words as a literal relation: no Python worker reads it."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else f"{v}" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")
