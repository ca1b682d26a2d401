"""Approximate nearest neighbours over learned partitions.

On a sample of at most `SAMPLE` vectors the exact neighbour graph is built and cut into balanced
parts (principal-axis bisection, then moves that follow most neighbours while every part stays
within its capacity). A small classifier learns the parts; it files every vector of the table under
its most probable part and sends a query to several parts. There is a part for each `PART_ROWS`
vectors. Over `FLAT` parts there are two levels: each part of the first is cut alike, by a task of its
own, on a sample of at most `SAMPLE` of its vectors, up to `BRANCH` by `BRANCH` parts in all; larger
tables have larger parts. How many parts a query asks is measured on a fifth of the sample that
no classifier of the first level saw: the least number that finds `RECALL` of its neighbours among the
others. Candidates of these parts are compared exactly, in double precision.

The queries of a part are held by a task and its vectors stream past them. A part of over `CHUNK`
vectors is dealt to several tasks, so it may hold any share of the table. Of equal vectors the k+1
smallest ids stay: no query can need more of them (its own is one), so groups of copies shrink before
the shuffle and the result is unchanged.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows with a null id; components may be of any numeric type; each row
is a candidate, and each that is asked has its own result, also where ids repeat; ties go to the
smaller id; with fewer candidates than k all are returned; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Vectors, at most, that the partitions and the classifier are fitted on.
SAMPLE = 6_000
CHUNK = 20_000
PART_ROWS = 250
FLAT, BRANCH = 256, 64
RECALL = 0.95
K = 10


def neighbours(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Indices of each row's k nearest other rows."""
    k = min(k, len(x) - 1)
    norms, out = (x**2).sum(axis=1), np.zeros((len(x), max(k, 0)), np.int64)
    for a in range(0, len(x), block):
        d = norms[None] - 2 * x[a : a + block] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + block] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.15, rounds: int = 12) -> np.ndarray:
    """A part for each row: few graph edges cross, no part exceeds (1 + slack) of its fair share."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, k = todo.pop()
        if k == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * (k // 2) // k
        todo += [(order[:cut], first, k // 2), (order[cut:], first + k // 2, k - k // 2)]
    capacity = int(np.ceil(len(x) / parts * (1 + slack)))
    sizes = np.bincount(label, minlength=parts)
    source, target = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.bincount(source * parts + label[target], minlength=len(x) * parts) + np.bincount(target * parts + label[source], minlength=len(x) * parts)
        votes = votes.reshape(len(x), parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if sizes[best[i]] < capacity:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Standardised input, one hidden layer, softmax over parts."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 96, epochs: int = 25, seed: int = 0):
        r = np.random.default_rng(seed)
        self.mean, self.spread, self.parts = x.mean(axis=0), x.std(axis=0) + 1e-9, parts
        self.w = [r.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        z, onehot = (x - self.mean) / self.spread, np.eye(parts)
        m, v, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), 128):
                i = order[a : a + 128]
                h = np.maximum(z[i] @ self.w[0] + self.w[1], 0)
                s = h @ self.w[2] + self.w[3]
                p = np.exp(s - s.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - onehot[label[i]]) / len(i)
                back = (d @ self.w[2].T) * (h > 0)
                step += 1
                for j, g in enumerate((z[i].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g**2
                    self.w[j] = self.w[j] - 0.004 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the parts."""
        h = np.maximum(((x - self.mean) / self.spread) @ self.w[0] + self.w[1], 0)
        s = h @ self.w[2] + self.w[3]
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, parts: int, k: int = K) -> Router | None:
    """The router of a sample; None for one part."""
    parts = min(parts, len(x) // 2)
    return Router(x, balanced_parts(x, neighbours(x, k), parts), parts) if parts > 1 else None


class Index:
    """One router, or one of the first level and one for each of its parts."""

    def __init__(self, top: Router | None, inner: dict[int, Router | None]):
        self.top, self.inner = top, inner
        self.width = max((r.parts for r in inner.values() if r), default=1)
        self.parts = (top.parts if top else 1) * self.width
        self.probes = self.parts

    def file(self, x: np.ndarray) -> np.ndarray:
        """The part of each row."""
        first = self.top.scores(x).argmax(axis=1) if self.top and len(x) else np.zeros(len(x), np.int64)
        out = first * self.width
        for p in np.unique(first):
            if (router := self.inner.get(int(p))) is not None:
                own = first == p
                out[own] += router.scores(x[own]).argmax(axis=1)
        return out

    def ranked(self, x: np.ndarray, count: int) -> np.ndarray:
        """The `count` most probable parts of each row."""
        if not len(x):
            return np.zeros((0, count), np.int64)
        first = self.top.scores(x) if self.top else np.zeros((len(x), 1))
        whole = np.full((len(x), first.shape[1], self.width), -np.inf)
        for p in range(first.shape[1]):
            router = self.inner.get(p)
            inside = router.scores(x) if router else np.zeros((len(x), 1))
            whole[:, p, : inside.shape[1]] = first[:, p : p + 1] + inside
        return np.argsort(-whole.reshape(len(x), -1), axis=1, kind="stable")[:, :count]

    def measure(self, x: np.ndarray, asked: np.ndarray, k: int, recall: float = RECALL) -> None:
        """Set probes to the least number of parts that finds `recall` of the neighbours of asked in x."""
        if self.parts == 1 or not len(asked) or not len(x):
            return
        d = (x**2).sum(axis=1)[None] - 2 * asked @ x.T
        near = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, : min(k, len(x))]
        place = np.argsort(self.ranked(asked, self.parts), axis=1)  # of each part in a row's order
        depth = place[np.arange(len(asked))[:, None], self.file(x)[near]]
        found = np.bincount(depth.ravel(), minlength=self.parts).cumsum() / depth.size
        self.probes = int(min(self.parts, np.searchsorted(found, recall) + 1))


def valid(vectors: DataFrame) -> DataFrame:
    """row (a number for each), vec_id and v of the rows that take part, stored."""
    e = F.col("embedding").cast("array<double>")
    ok = (
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        & F.exists("v", lambda e: e != 0)
    )
    rows = vectors.select("vec_id", e.alias("v")).filter(F.coalesce(ok, F.lit(False)))
    rows = common.stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "ann-valid")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(2).collect()
    if len(sizes) < 2:
        return rows
    return common.stored(rows.filter(F.size("v") == sizes[0]["n"]), "ann-valid", rows)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Best:
    """The k nearest rows found so far of each of some queries; exact, ties to smaller ids."""

    def __init__(self, q: np.ndarray, rows: np.ndarray, k: int, block: int = 128):
        self.q, self.rows, self.k, self.block = q, rows, k, block
        self.d = [np.zeros(0)] * len(q)
        self.ids = [np.zeros(0, np.int64)] * len(q)
        self.far = np.full(len(q), np.inf)

    def offer(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """Compare with vectors, of which a query's own row is left out."""
        norms, k = (x**2).sum(axis=1), self.k
        for a in range(0, len(self.q), self.block):
            qs = self.q[a : a + self.block]
            own = (qs**2).sum(axis=1)[:, None]
            rough = norms[None] - 2 * qs @ x.T + own
            rough[self.rows[a : a + self.block, None] == rows[None]] = np.inf
            kth = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            slack = 1e-9 * (1 + own[:, 0] + norms.max(initial=0))  # the rough distances' error
            limit = np.minimum(kth, self.far[a : a + self.block] ** 2) + slack
            for i, j in enumerate(range(a, a + len(qs))):
                near = np.flatnonzero((rough[i] <= limit[i]) & np.isfinite(rough[i]))
                if len(near):
                    d = np.concatenate([self.d[j], np.sqrt(((x[near] - qs[i]) ** 2).sum(axis=1))])
                    own_ids = np.concatenate([self.ids[j], ids[near]])
                    best = np.lexsort((own_ids, d))[:k]
                    self.d[j], self.ids[j] = d[best], own_ids[best]
                    if len(best) == k:
                        self.far[j] = d[best[-1]]


def build(rows: DataFrame, total: int, k: int = K, sample: int = SAMPLE, part_rows: int = PART_ROWS, flat: int = FLAT) -> Index:
    """The index of stored rows; what reaches the driver is a sample and at most BRANCH small routers."""
    wanted = min(BRANCH * BRANCH, max(1, -(-total // part_rows)))
    dims = F.size("v") * 8
    picked = common.bounded_sample(rows.select("row", "v"), sample, dims, distinct=total).orderBy("row").collect()
    if len(picked) < 2:
        return Index(None, {})
    x = np.array([r["v"] for r in picked], np.float64)
    order = np.random.default_rng(1).permutation(len(x))
    asked, seen = x[order[: len(x) // 5]], x[order[len(x) // 5 :]]
    if wanted <= flat:
        index = Index(fit(seen, wanted, k), {})
    else:
        branch = int(np.ceil(wanted**0.5))
        top = fit(seen, branch, k)
        coarse = Index(top, {})

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coarse.file(_matrix(b.column(0))).astype(np.int32))], ["v", "part"])

        def cut(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [key[0]], "router": [pickle.dumps(fit(np.stack(part["v"].to_numpy()), branch, k))]})

        rate = min(1.0, sample * coarse.parts / total)
        keep = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 30)) < int(rate * (1 << 30))
        own = rows.filter(keep).select("v").mapInArrow(place, "v array<double>, part int")
        least = W.partitionBy("part").orderBy(F.xxhash64("v"))
        own = own.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= sample).drop("n")  # balanced parts: about `sample` rows each
        routers = own.groupBy("part").applyInPandas(cut, "part int, router binary").collect()  # `branch` rows of about 100 kB
        index = Index(top, {r["part"]: pickle.loads(bytes(r["router"])) for r in routers})
    index.measure(seen, asked, k)
    return index


def search(vectors: DataFrame, query: Column, k: int = K, sample: int = SAMPLE, part_rows: int = PART_ROWS, flat: int = FLAT, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of vectors where `query` (on vec_id) holds."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    index = build(rows, rows.count(), k, sample, part_rows, flat)
    shared = spark.sparkContext.broadcast(index)  # at most BRANCH + 1 routers of about 100 kB

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            x, asks = _matrix(b.column(2)), np.array(b.column(3).to_pylist(), bool)
            parts = [[p] for p in own.file(x).tolist()]
            for i, r in zip(np.flatnonzero(asks).tolist(), own.ranked(x[asks], own.probes).tolist()):
                parts[i] += r
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.list_(pa.int32()))], ["row", "vec_id", "v", "asks", "parts"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    filed = rows.withColumn("asks", F.coalesce(query, F.lit(False))).mapInArrow(file, f"row long, vec_id {kind}, v array<double>, asks boolean, parts array<int>")
    filed = common.stored(filed.withColumn("part", F.col("parts")[0]), "ann-filed")  # the part of its own, then those to ask
    common.dropped(rows)
    copies = W.partitionBy("part", F.xxhash64("v"), F.hash("v")).orderBy("vec_id", "row")
    kept = filed.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    kept = common.stored(kept.select("row", "vec_id", "v", "part"), "ann-kept")
    # one row for each part: BRANCH * BRANCH at most
    chunks = F.broadcast(kept.groupBy("part").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")))
    held = kept.join(chunks, "part").select("part", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("rank"), "row", "vec_id", "v")
    asked = (
        filed.filter("asks").select("row", "vec_id", "v", F.explode(F.expr("slice(parts, 2, size(parts))")).alias("part")).join(chunks, "part")
        .select("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("rank"), "row", "vec_id", "v")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, best = None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if best is None:
                return
            ids = np.concatenate([np.full(len(d), i) for i, d in zip(query_ids, best.d)])
            row = np.repeat(best.rows, [len(d) for d in best.d])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids.astype(np.int64)), pa.array(np.concatenate(best.ids).astype(np.int64)), pa.array(np.concatenate(best.d))], ["row", "query_id", "vec_id", "score"])

        query_ids = np.zeros(0, np.int64)
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            bounds = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for at, end in zip(bounds, bounds[1:]):
                part, n, rank = keys[at].tolist()
                own = b.slice(at, end - at)
                if (part, n) != group:
                    yield from flush()
                    group, queries, best = (part, n), [], None
                if rank == 0:  # a chunk's queries come first
                    queries.append(own)
                    continue
                if best is None and queries:
                    whole = pa.Table.from_batches(queries).combine_chunks()
                    query_ids = whole.column("vec_id").to_numpy()
                    best = Best(_matrix(whole.column("v").combine_chunks()), whole.column("row").to_numpy(), k)
                if best is not None:
                    best.offer(_matrix(own.column(5)), own.column(3).to_numpy(), own.column(4).to_numpy())
        yield from flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.unionByName(asked).repartition(n, "part", "chunk").sortWithinPartitions("part", "chunk", "rank")
    found = dealt.mapInArrow(scan, "row long, query_id long, vec_id long, score double")
    best = W.partitionBy("row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
