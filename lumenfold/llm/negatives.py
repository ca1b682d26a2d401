"""Hard negatives by a kNN join over Voronoi partitions.

The largest inner product becomes the smallest distance: with M the largest norm, a row x becomes
(x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0), so |q' - x'|^2 = M^2 + |q|^2 - 2 q.x. Pivots are picked
far apart from a sample of at most `SAMPLE` rows; every row belongs to the cell of its nearest pivot, every
anchor to the group of the nearest of the first pivots (one for about `ANCHORS` anchors).

The join runs twice. For the positives a group's reach comes from partition bounds: of each cell and label the nearest rows
to the pivot are known, so the triangle inequality bounds every anchor's distance to its k-th row of the same
label. For the negatives the reach is exact: a score of 80 hundredths of the weakest positive. Around each pivot the reach is
an interval of distances; a row is sent only to groups in whose intervals (about all pivots) it lies, and for positives only
to groups that may hold its label. What is sent is joined exactly: whole numbers, all anchors of a group with
a chunk of its rows at a time. Groups of over `GROUP` anchors are cut into blocks, rows into chunks of
about `CHUNK`, so no task grows with a cell, a label or a group of copies. Each chunk gives an
anchor at most k rows, or k for each of its positives; these meet in a window.

Defined cases: rows with a null id, label or vector, with an empty vector, with a null or non-finite component or another length than most
(of equally frequent lengths the smaller one) take no part; a row isn't its own positive, other rows with its id may be;
repeated rows each count; ties go to the smaller id; positives of a score below 0 have no negatives, as no
score is within the bounds; fewer rows than asked give fewer results; an empty table gives an empty result; further
columns are ignored. Ids and labels are whole numbers. 100 times an inner product must fit 64 bits, else the
operator raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

POSITIVES = NEGATIVES = 5
#: Hundredths of a positive's score between which its negatives lie.
LOW, HIGH = 80, 100
SAMPLE = 2_000
#: Pivots at least and at most; anchors that a group holds about; anchors of a block and rows of a chunk.
PIVOTS, MOST_PIVOTS = 32, 256
ANCHORS, GROUP, CHUNK = 512, 2_048, 2_048


def valid(vectors: DataFrame, anchor: Column, label: Column) -> DataFrame:
    """row (a number for each), vec_id, label, anchor, v (whole numbers) and norm (squared) of the rows that take part, stored."""
    e = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), e.alias("e"))
    rows = rows.filter(ok).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", F.transform("e", lambda x: F.floor(x * 256)).alias("v"))
    rows = rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = common.stored(rows, "negatives-valid")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(2).collect()
    if len(sizes) < 2:
        return rows
    return common.stored(rows.filter(F.size("v") == sizes[0]["n"]), "negatives-valid", rows)


def spread_out(x: np.ndarray, count: int) -> np.ndarray:
    """Indices of up to `count` rows, each the farthest from those before."""
    if not len(x):
        return np.zeros(0, np.int64)
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


class Cells:
    """Pivots in the space with the norm's further coordinate."""

    def __init__(self, x: np.ndarray, largest: float, count: int, groups: int):
        self.largest = largest  # the largest squared norm
        lifted = np.column_stack([x, np.sqrt(np.maximum(largest - (x**2).sum(axis=1), 0))])
        self.pivots = lifted[spread_out(lifted, count)]
        self.groups = max(1, min(groups, len(self.pivots)))
        self.slack = 1e-6 * (largest**0.5 + 1)  # rounding of distances

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Of each row, or anchor, to each pivot."""
        own = (x**2).sum(axis=1)
        w = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest - own, 0))
        square = (own + w**2)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * (x @ self.pivots[:, :-1].T + w[:, None] * self.pivots[None, :, -1])
        return np.sqrt(np.maximum(square, 0))


class Reach:
    """For each group and pivot the interval of distances of rows that the group might need, and its labels' bits."""

    def __init__(self, cells: Cells, near: np.ndarray, far: np.ndarray, labels: np.ndarray | None = None):
        self.cells, self.labels = cells, labels
        self.near, self.far = near - cells.slack, far + cells.slack

    def of(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each row may serve each group."""
        d = self.cells.distances(x)
        out = np.empty((len(x), len(self.near)), bool)
        for g in range(len(self.near)):
            out[:, g] = ((d >= self.near[g]) & (d <= self.far[g])).all(axis=1)
        if self.labels is not None:
            out &= (self.labels[None] >> label_bit(labels)[:, None]) & np.uint64(1) > 0
        return out


def label_bit(labels: np.ndarray) -> np.ndarray:
    return (labels.astype(np.int64) % 64).astype(np.uint64)


def _lists(column: pa.Array, dtype=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def _vectors(column, dtype: str) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), dtype).reshape(len(cells), -1) if cells else np.zeros((0, 0), dtype)


def place(rows: DataFrame, cells: Cells, dtype: str) -> DataFrame:
    """row, vec_id, label, anchor, norm, v (packed), cell, dist (to its pivot); of anchors also reach (to all pivots) and grp. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = dict(zip(b.schema.names, b.columns))
            x, asks = _lists(col["v"]), col["anchor"].to_numpy(zero_copy_only=False).astype(bool)
            packed = [r.tobytes() for r in _lists(col["v"], np.int64).astype(dtype)]
            d = cells.distances(x) if len(x) else np.zeros((0, 1))
            q = iter(cells.distances(x[asks], True) if asks.any() else [])
            of = [next(q) if a else None for a in asks.tolist()]
            cell = d.argmin(axis=1)
            grp = [None if o is None else int(o[: cells.groups].argmin()) for o in of]
            yield pa.RecordBatch.from_arrays(
                [col["row"], col["vec_id"], col["label"], col["anchor"], col["norm"], pa.array(packed, pa.binary()), pa.array(cell.astype(np.int32)),
                 pa.array(d[np.arange(len(d)), cell] if len(d) else np.zeros(0)), pa.array(of, pa.list_(pa.float64())), pa.array(grp, pa.int32())],
                ["row", "vec_id", "label", "anchor", "norm", "v", "cell", "dist", "reach", "grp"],
            )

    schema = "row long, vec_id long, label long, anchor boolean, norm double, v binary, cell int, dist double, reach array<double>, grp int"
    return common.stored(rows.mapInArrow(run, schema), "negatives-placed", rows)


def _reach(anchors: DataFrame, cells: Cells, by_label: bool) -> Reach:
    """anchors: grp, label, reach and theta (how far an anchor's rows may be; null: none are needed)."""
    with_place = anchors.filter("theta is not null").select("grp", "theta", F.posexplode("reach").alias("pivot", "d"))
    table = with_place.groupBy("grp", "pivot").agg(F.min(F.col("d") - F.col("theta")), F.max(F.col("d") + F.col("theta"))).collect()  # groups x pivots rows
    n, p = cells.groups, len(cells.pivots)
    near, far = np.full((n, p), np.inf), np.full((n, p), -np.inf)
    for g, i, a, z in table:
        near[g, i], far[g, i] = a, z
    labels = None
    if by_label:
        labels = np.zeros(n, np.uint64)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("label", F.lit(64)).cast("int"))
        for g, x in anchors.groupBy("grp").agg(F.bit_or(bit)).collect():
            labels[g] = np.uint64(x & ((1 << 64) - 1))
    return Reach(cells, near, far, labels)


def _send(placed: DataFrame, reach: Reach, dtype: str, chunk: int) -> tuple[DataFrame, dict[int, int]]:
    """Each row once for each group that it might serve, with its chunk; and the number of chunks of each group."""
    held = placed.sparkSession.sparkContext.broadcast(reach)

    def mask(b: pa.RecordBatch) -> np.ndarray:
        return held.value.of(_vectors(b.column("v"), dtype).astype(np.float64), b.column("label").to_numpy())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(held.value.near), np.int64)
        for b in batches:
            if b.num_rows:
                n += mask(b).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)).astype(np.int32)), pa.array(n)], ["grp", "n"])

    sizes = placed.select("label", "v").mapInArrow(number, "grp int, n long").groupBy("grp").agg(F.sum("n")).collect()  # MOST_PIVOTS rows at most
    chunks = {g: -(-n // chunk) for g, n in sizes if n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, groups = np.nonzero(mask(b))
                # a hash of the row's number deals copies and cells evenly
                mixed = (b.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = mixed[at].astype(np.int64) % np.array([chunks.get(g, 1) for g in range(len(held.value.near))])[groups]
                picked = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(groups.astype(np.int32)), pa.array(own.astype(np.int32)), *picked.columns], ["grp", "chunk", *b.schema.names])

    sent = placed.select("row", "vec_id", "label", "v").mapInArrow(run, "grp int, chunk int, row long, vec_id long, label long, v binary")
    return sent, chunks


def _pair(anchors: DataFrame, sent: DataFrame, chunks: dict[int, int], run, schema: str) -> DataFrame:
    """run(key, anchors, rows) for each block of a group's anchors with each chunk of the rows sent to it."""
    spark = anchors.sparkSession
    table = F.broadcast(common.inline(spark, list(chunks.items()) or [(-1, 1)], "grp, chunks"))
    blocks = F.broadcast(anchors.groupBy("grp").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks")))  # a row for each group
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block")
    left = anchors.join(table, "grp").join(blocks, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("grp", block, F.col("chunk").cast("int").alias("chunk"), *[c for c in anchors.columns if c != "grp"])
    right = sent.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["grp", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _scores(anchors: pa.Table, rows: pa.Table, dtype: str, exact: bool) -> np.ndarray:
    """Inner products as whole numbers; in floating point only where every sum stays below 2^53."""
    a, b = _vectors(anchors.column("v"), dtype), _vectors(rows.column("v"), dtype)
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _order(s: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.lexsort((rows, ids, -s))


def _positives(anchors: DataFrame, sent: DataFrame, chunks: dict[int, int], k: int, dtype: str, exact: bool) -> DataFrame:
    """arow, prow, positive_id, score, place (from 0) of the k best other rows of each anchor's label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"arow": [], "prow": [], "positive_id": [], "score": []}
        if left.num_rows and right.num_rows:
            s = _scores(left, right, dtype, exact)
            ids, rows, labels = (right.column(c).to_numpy() for c in ("vec_id", "row", "label"))
            for i, (arow, label) in enumerate(zip(left.column("row").to_pylist(), left.column("label").to_pylist())):
                own = np.flatnonzero((labels == label) & (rows != arow))
                if len(own) > 4 * k:  # ties with the k-th stay
                    own = own[s[i, own] >= np.partition(s[i, own], len(own) - k)[len(own) - k]]
                own = own[_order(s[i, own], ids[own], rows[own])[:k]]
                out["arow"] += [arow] * len(own)
                out["prow"] += rows[own].tolist()
                out["positive_id"] += ids[own].tolist()
                out["score"] += s[i, own].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = _pair(anchors, sent, chunks, run, "arow long, prow long, positive_id long, score long")
    best = W.partitionBy("arow").orderBy(F.desc("score"), "positive_id", "prow")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def _negatives(anchors: DataFrame, sent: DataFrame, chunks: dict[int, int], k: int, dtype: str, exact: bool, low: int, high: int) -> DataFrame:
    """anchors: also pairs (place, positive_id, score), best first."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("arow", "place", "anchor_id", "positive_id", "positive_score", "nrow", "negative_id", "negative_score")
        out = {c: [] for c in names}
        if left.num_rows and right.num_rows:
            s = _scores(left, right, dtype, exact)
            ids, rows, labels = (right.column(c).to_numpy() for c in ("vec_id", "row", "label"))
            for i, a in enumerate(left.select(["row", "vec_id", "label", "pairs"]).to_pylist()):
                scores = [p["score"] for p in a["pairs"] if p["score"] >= 0]
                if not scores:
                    continue
                own = np.flatnonzero((labels != a["label"]) & (100 * s[i] >= low * min(scores)) & (100 * s[i] <= high * max(scores)))
                own = own[_order(s[i, own], ids[own], rows[own])]
                falling = 100 * s[i, own]
                for p in a["pairs"]:
                    begin = int(np.searchsorted(-falling, -high * p["score"]))  # the first within the upper bound
                    for j in own[begin : begin + k].tolist():
                        if 100 * s[i, j] < low * p["score"] or p["score"] < 0:
                            break
                        for c, v in zip(names, (a["row"], p["place"], a["vec_id"], p["positive_id"], p["score"], rows[j], ids[j], s[i, j])):
                            out[c].append(int(v))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = _pair(anchors, sent, chunks, run, "arow long, place long, anchor_id long, positive_id long, positive_score long, nrow long, negative_id long, negative_score long")
    best = W.partitionBy("arow", "place").orderBy(F.desc("negative_score"), "negative_id", "nrow")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _bounds(placed: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """anchors with theta: a bound of the distance to the k-th other row of the same label."""
    nearest = W.partitionBy("label", "cell").orderBy("dist")
    few = placed.select("label", "cell", "dist").withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1)
    cells = few.groupBy("label").agg(F.collect_list(F.struct("cell", "dist")).alias("known"))  # k + 1 for each pivot at most
    with_known = common.lookup(anchors, common.stored(cells, "negatives-cells"), "label")
    upper = F.sort_array(F.transform("known", lambda x: x["dist"] + F.col("reach")[x["cell"]]))
    # one of the k + 1 may be the anchor's own row
    theta = F.when(F.size(upper) > k, F.element_at(upper, k + 1)).otherwise(F.lit(float("inf")))
    return with_known.withColumn("theta", theta).drop("known")


def mine(
    vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    group: int = ANCHORS, chunk: int = CHUNK, pivots: int = PIVOTS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, embedding).

    anchor: which rows are anchors; label: what counts as a row's label, if not its column.
    """
    rows = valid(vectors, anchor, F.col("label") if label is None else label)
    n_anchors, largest, most, size = rows.agg(F.count_if("anchor"), F.max("norm"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.max(F.size("v"))).first()
    largest, most = largest or 0.0, most or 0
    if 100 * largest >= 2**63:
        raise ValueError("inner products of these vectors don't fit 64 bits")
    dtype, exact = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8", largest < 2**53
    groups = max(1, -(-n_anchors // group))
    picked = [r["v"] for r in common.bounded_sample(rows.select("v"), SAMPLE, F.size("v") * 8).collect()]
    sample = np.array(picked or [[0] * (size or 1)], np.float64)
    cells = Cells(sample, largest, min(MOST_PIVOTS, max(pivots, groups)), groups)
    placed = place(rows, cells, dtype)
    anchors = common.stored(placed.filter("anchor").select("row", "vec_id", "label", "norm", "v", "reach", "grp"), "negatives-anchors")

    bounded = common.stored(_bounds(placed, anchors, positives).select("row", "vec_id", "label", "norm", "v", "reach", "grp", "theta"), "negatives-bounds", anchors)
    sent, chunks = _send(placed, _reach(bounded, cells, True), dtype, chunk)
    pairs = _positives(bounded.select("grp", "row", "vec_id", "label", "v"), sent, chunks, positives, dtype, exact)
    of_anchor = pairs.groupBy(F.col("arow").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("pairs"))
    weakest = F.array_min(F.filter(F.transform("pairs", lambda p: p["score"]), lambda s: s >= 0))
    reach = F.sqrt(F.greatest(F.lit(largest) + F.col("norm") - F.lit(low / 50) * weakest, F.lit(0.0)))
    found = common.stored(bounded.drop("theta").join(of_anchor, "row").withColumn("theta", reach), "negatives-pairs", bounded)

    sent, chunks = _send(placed, _reach(found, cells, False), dtype, chunk)
    out = _negatives(found.select("grp", "row", "vec_id", "label", "v", "pairs"), sent, chunks, negatives, dtype, exact, low, high)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


#: The same result by every anchor with every row.
OP12_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS place FROM s WHERE same) WHERE place <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, place ORDER BY s.score DESC, s.vec_id, s.r) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
