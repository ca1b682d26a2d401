"""K-d tree sharding by distributed weighted medians, in DataFrame operations only.

Texts become points in a space of metadata (source, language, length). A node of the tree that is
to hold k shards is cut along its widest dimension where the bytes stand k//2 to k - k//2, until
each leaf is one shard; so leaves reach the target bytes. The weighted median of every node of a
level comes from three histograms (14 bits each of a 40-bit position), so a level costs four small
aggregations however large the table is. One task sums the bins of a node, 16,384 at most.

Defined cases: a null text has size 16 and the CRC of the empty text; null source and language are
values of their own; equal texts share one point and stay in one shard, except where their group
holds over 1/10,240 of the bytes or rows and a cut goes through it, also where its ids are equal or null; repeated rows each get a slot;
texts of any length count whole and the largest document bounds how equal sizes can be; of equal ids
slots go by the text's CRC, of equal rows any order is one; an empty table gives an empty result;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

DIMENSIONS = ("d_source", "d_lang", "d_length")
ROW_BYTES = 16
#: A group of equal texts with over 1/PIECES of the bytes or rows is dealt in pieces.
PIECES = 10_240
SLOT_RUN = 20_000
DIGIT = 14


def _along(axis: str) -> Column:
    value = F.lit(None).cast("int")
    for d in DIMENSIONS:
        value = F.when(F.col(axis) == d, F.col(d)).otherwise(value)
    return value


def _position(dimension: Column) -> Column:
    """40 bits: the dimension's 12, then 14 of the text's hash and 14 of the piece, of which there are fewer."""
    tie = F.pmod(F.col("thash"), F.lit(1 << DIGIT)) * (1 << DIGIT) + F.col("piece")
    return dimension.cast("long") * (1 << 2 * DIGIT) + tie


def _cuts(units: DataFrame, nodes: dict[int, int]) -> list[tuple[int, int, str, int]]:
    """For each node (first shard -> number of shards) of over one: its widest dimension and cut."""
    spark = units.sparkSession
    live = units.filter(F.col("shard").isin([n for n, k in nodes.items() if k > 1]))
    spans = [(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
    stats = {r["shard"]: r for r in live.groupBy("shard").agg(F.sum("bytes").alias("b"), *spans).collect()}
    if not stats:
        return []
    widest = {n: max(DIMENSIONS, key=lambda d: r[d]) for n, r in stats.items()}
    target = {n: r["b"] * (nodes[n] // 2) / nodes[n] for n, r in stats.items()}
    # tables of a row for each node, fewer than there are shards
    axes = common.inline(spark, list(widest.items()), "shard, axis")
    placed = live.join(F.broadcast(axes), "shard").select("shard", "bytes", _position(_along("axis")).alias("pos"))
    order = W.partitionBy("shard").orderBy("bin")

    def crossing(bins: DataFrame, goal: dict[int, float]) -> dict[int, tuple]:
        goals = F.broadcast(common.inline(spark, [(n, float(v)) for n, v in goal.items()], "shard, goal"))
        upto = bins.withColumn("upto", F.sum("bytes").over(order)).join(goals, "shard").filter(F.col("upto") >= F.col("goal"))
        rows = upto.groupBy("shard").agg(F.min(F.struct("bin", "upto", "bytes")).alias("at")).collect()
        return {r["shard"]: (r["at"]["bin"], r["at"]["upto"], r["at"]["bytes"]) for r in rows}

    # digit by digit from the left, as in a radix search; `at` holds the digits found so far
    at, own = {n: 0 for n in target}, {}
    for shift in (2 * DIGIT, DIGIT, 0):
        inside = placed
        if shift < 2 * DIGIT:
            chosen = F.broadcast(common.inline(spark, list(at.items()), "shard, prefix"))
            inside = placed.join(chosen, "shard").filter(F.shiftright("pos", shift + DIGIT) == F.col("prefix"))
        digit = F.pmod(F.shiftright("pos", shift), F.lit(1 << DIGIT)).alias("bin")
        found = crossing(inside.groupBy("shard", digit).agg(F.sum("bytes").alias("bytes")), target)
        at = {n: (at[n] << DIGIT) + bin_ for n, (bin_, _, _) in found.items()}
        own = {n: (upto - target[n], b - (upto - target[n])) for n, (_, upto, b) in found.items()}
        target = {n: target[n] - (upto - b) for n, (_, upto, b) in found.items()}
    # the last bin goes where the error is smaller: over the goal with it, or under the goal without
    return [(n, nodes[n] // 2, widest[n], at[n] - (0 if over <= under else 1)) for n, (over, under) in own.items()]


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ordinal = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(4096)).cast("int")
    size = F.octet_length(text).cast("long") + ROW_BYTES
    rows = common.stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("thash"),
            ordinal("source").alias("d_source"), ordinal("lang").alias("d_lang"),
            F.least(F.lit(4095), F.floor(F.log2(size) * 128)).cast("int").alias("d_length"),
        ),
        "kd-rows",
    )
    groups = rows.groupBy("thash").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    all_bytes, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    piece_bytes, piece_rows = max((all_bytes or 0) / PIECES, 1), max(n_rows / PIECES, 1)
    share = F.greatest(F.col("b") / piece_bytes, F.col("n") / piece_rows)
    # at most 2 * PIECES groups can exceed a share, so this side is bounded; their pieces are dealt by the row's number, as ids can repeat
    heavy = groups.filter((share > 1) & (F.col("n") > 1)).select("thash", F.ceil(share).alias("pieces"))
    pieces = F.coalesce("pieces", F.lit(1))
    rows = rows.join(F.broadcast(heavy), "thash", "left").withColumn("piece", F.pmod(F.xxhash64("row"), pieces)).drop("pieces")
    units = held = common.stored(
        rows.groupBy("thash", "piece").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(d) for d in DIMENSIONS]), "kd-units"
    )
    if heavy.limit(1).count():  # pieces of one text share its point
        point = units.join(F.broadcast(heavy.select("thash")), "thash").groupBy("thash").agg(*[F.min(d).alias(f"g_{d}") for d in DIMENSIONS])
        units = units.join(F.broadcast(point), "thash", "left")
        for d in DIMENSIONS:
            units = units.withColumn(d, F.coalesce(f"g_{d}", d)).drop(f"g_{d}")
    units, nodes = units.withColumn("shard", F.lit(0)), {0: shards}
    while any(k > 1 for k in nodes.values()):
        cuts = _cuts(units, nodes)
        if not cuts:
            break
        table = F.broadcast(common.inline(units.sparkSession, cuts, "shard, left, axis, cut"))
        beyond = F.coalesce(_position(_along("axis")) > F.col("cut"), F.lit(False))
        moved = F.when(beyond, F.col("shard") + F.col("left")).otherwise(F.col("shard"))
        # stored level by level: plans stay small, and a lost executor costs one level
        units = held = common.stored(units.join(table, "shard", "left").withColumn("shard", moved).drop("left", "axis", "cut"), "kd-level", held)
        before = nodes
        nodes = {}
        for n, left, _, _ in cuts:
            nodes |= {n: left, n + left: before[n] - left}
    runs = max(8, n_rows // (shards * SLOT_RUN))
    placed = common.stored(
        rows.join(units.select("thash", "piece", "shard"), ["thash", "piece"])
        .select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(runs)).cast("int").alias("run")),
        "kd-placed",
    )
    # one row for each shard and run of SLOT_RUN rows; as their number grows with the table, Spark picks the join by its size
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    upto = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "run", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32"))
    return (
        placed.withColumn("number", number)
        .join(offsets, ["shard", "run"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.table(spark, sf_dir, "documents"))
