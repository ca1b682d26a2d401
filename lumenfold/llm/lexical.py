"""Ranked lexical search by max trees over document ranges.

One pass over the documents makes an inverted index: a row for each run of at most `DOCS` documents and
about `POSTINGS` postings, with its own terms, so nothing is shuffled and nothing grows with the vocabulary of the
corpus. The index knows no queries; its rows also give the corpus counts that scores need.

A search takes items in blocks of about `BLOCK_WORDS` words. Each task reads rows of the index and builds a
max tree for each of their terms that the block asks for: leaves are ranges of `FAN` documents, every node
holds the largest impact of the term below it. For an item the node with the highest bound (the sum of its terms'
weighted maxima) is opened first. Opened leaves score their documents exactly. As soon as the highest bound is under the
k-th score, the rest of the run can't matter; nodes whose bound equals it are opened, since a smaller id may win.
The k best found go from run to run, so most later runs end at their root. Each task gives at most k rows
for an item; these meet in one small window.

Defined cases: null and empty texts and texts without terms aren't counted and never found; an item without known
terms has no result; equal rows of the items count once, items that share an id have results of their own; repeated
documents each count and each can be found; documents without an id count and are found, after others of equal score;
texts of any length count whole (one of over POSTINGS distinct terms is a run of its own); empty tables give an empty result; further
columns are ignored, whatever their names. Numbers are 64-bit: 90 * (terms of a document) * (documents) must fit.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StructField, StructType

from . import common

K = 10
#: Documents (at most 65,536) and postings of a run.
DOCS, POSTINGS = 4_096, 1_000_000
FAN = 16
BLOCK_WORDS = 50_000
#: Bytes of terms stay, A-Z become small, all others part them. In UTF-8 every byte of a character beyond ASCII is 0x80 or more.
_BYTES = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_BYTES).split()


# ---------------------------------------------------------------- index

INDEX = "n_docs long, n_terms long, doc_ids array<{kind}>, lengths array<long>, terms array<string>, dfs array<int>, docs binary, tfs binary"


class Run:
    """Postings of documents as they come."""

    def __init__(self):
        self.ids, self.lengths, self.sizes, self.entries, self.tfs = [], [], [], [], []
        self.number = defaultdict(count().__next__)

    def add(self, doc_id, terms: list[bytes]) -> None:
        counts = Counter(terms)
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.sizes.append(len(counts))
        self.entries.extend(map(self.number.__getitem__, counts))
        self.tfs.extend(counts.values())

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        entries = np.array(self.entries, np.int32)
        order = np.argsort(entries, kind="stable")
        docs = np.repeat(np.arange(len(self.ids)), self.sizes).astype("<u2")[order]
        tfs = np.array(self.tfs, np.int64)[order]
        tfs = tfs.astype("<u1" if tfs.max() < 1 << 8 else "<u2" if tfs.max() < 1 << 16 else "<u4")
        terms = pa.array(list(self.number), pa.binary()).cast(pa.string())
        cells = {
            "n_docs": pa.array([len(self.ids)]), "n_terms": pa.array([sum(self.lengths)]), "doc_ids": pa.array([self.ids], pa.list_(kind)),
            "lengths": pa.array([self.lengths], pa.list_(pa.int64())), "terms": pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
            "dfs": pa.array([np.bincount(entries).astype(np.int32)]), "docs": pa.array([docs.tobytes()]), "tfs": pa.array([tfs.tobytes()]),
        }
        return pa.RecordBatch.from_pydict(cells)


def index(docs: DataFrame, docs_in_run: int = DOCS, postings: int = POSTINGS) -> DataFrame:
    """The inverted index of docs (doc_id, text), one row for each run; a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = Run(), None
        for b in batches:
            kind = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                terms = terms_of(text.as_py() or b"")
                if terms:
                    own.add(doc_id, terms)
                    if len(own.ids) >= docs_in_run or len(own.entries) >= postings:
                        yield own.batch(kind)
                        own = Run()
        if own.ids:
            yield own.batch(kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.stored(common.map_texts(docs.select("doc_id", "text"), run, INDEX.format(kind=kind)), "lexical-index")


# ---------------------------------------------------------------- search


class Best:
    """The k best documents of an item so far: score falling, then id rising, no id last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []
        self.least = 1  # no lower score gets in

    def offer(self, score: int, doc_id) -> None:
        insort(self.rows, (-score, doc_id is None, doc_id if doc_id is not None else 0))
        if len(self.rows) >= self.k:
            del self.rows[self.k :]
            self.least = -self.rows[-1][0]


class Trees:
    """The max trees of some terms over one run of documents.

    bounds: where each term's postings begin and end in docs and tfs. opened counts leaves that were scored.
    """

    def __init__(self, docs: np.ndarray, tfs: np.ndarray, bounds: np.ndarray, m: np.ndarray, ids: list):
        sizes = bounds[:, 1] - bounds[:, 0]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(bounds[:, 0] - (ends - sizes), sizes)
        self.docs, self.ids, self.opened = docs[at].astype(np.int64), ids, 0
        tf = tfs[at].astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1_000 * tf + 8 * m[self.docs])
        leaves = -(-len(ids) // FAN)
        key = np.repeat(np.arange(len(bounds)), sizes) * leaves + self.docs // FAN
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cells = key[starts]
        shape = (len(bounds), leaves)
        self.first, self.count, level = np.zeros(shape, np.int32), np.zeros(shape, np.int8), np.zeros(shape, np.int32)  # an impact is under 2^20
        self.first.ravel()[cells], self.count.ravel()[cells] = starts, np.diff(np.append(starts, len(key)))
        level.ravel()[cells] = np.maximum.reduceat(self.impact, starts)
        self.levels = [level]
        while level.shape[1] > 1:
            up = -(-level.shape[1] // FAN)
            level = np.pad(level, ((0, 0), (0, up * FAN - level.shape[1]))).reshape(len(bounds), up, FAN).max(axis=2)
            self.levels.append(level)

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer to best what may belong to it. rows: the item's terms."""
        top = len(self.levels) - 1
        heap = [(-int(weights @ self.levels[top][rows, 0]), top, 0)]
        while heap:
            bound, level, node = heappop(heap)
            if -bound < best.least:
                return
            if level == 0:
                self._score(rows, weights, node, best)
                continue
            a = node * FAN
            for i, b in enumerate((weights @ self.levels[level - 1][rows, a : a + FAN]).tolist()):
                if b >= best.least:
                    heappush(heap, (-b, level - 1, a + i))

    def _score(self, rows: np.ndarray, weights: np.ndarray, leaf: int, best: Best) -> None:
        self.opened += 1
        n = self.count[rows, leaf].astype(np.int64)
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.first[rows, leaf] - (ends - n), n)
        scores = np.zeros(FAN, np.int64)
        np.add.at(scores, self.docs[at] % FAN, self.impact[at] * np.repeat(weights, n))
        for i in np.flatnonzero(scores >= best.least).tolist():
            if scores[i] >= best.least:
                best.offer(int(scores[i]), self.ids[leaf * FAN + i])


class Block:
    """Some items as numbers of distinct terms."""

    def __init__(self, texts: list[str]):
        number = defaultdict(count().__next__)
        self.items = [np.array(sorted({number[t] for t in terms_of(t.encode("utf-8", "replace"))}), np.int64) for t in texts]
        self.terms = {t.decode("utf-8", "replace"): i for t, i in number.items()}


def _document_counts(runs: DataFrame, block: Block) -> np.ndarray:
    """The number of documents that hold each of the block's terms."""
    held = runs.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for b in batches:
            for terms, dfs in zip(b.column(0), b.column(1)):
                for term, n in zip(terms.values.to_pylist(), dfs.values.to_pylist()):
                    if (i := held.value.get(term)) is not None:
                        found[i] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    out = np.zeros(len(block.terms), np.int64)
    for r in runs.select("terms", "dfs").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        out[r["term"]] = r["n"]
    return out


def _search_block(runs: DataFrame, block: Block, n: int, total: int, k: int) -> DataFrame:
    """item (its place in the block), score, doc_id: the k best of each task."""
    df = _document_counts(runs, block)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    held = runs.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = held.value
        best, kind = [Best(k) for _ in block.items], pa.int64()
        for b in batches:
            col = dict(zip(b.schema.names, b.columns))
            kind = col["doc_ids"].type.value_type
            for i in range(b.num_rows):
                asked = [(j, t) for j, term in enumerate(col["terms"][i].values.to_pylist()) if (t := block.terms.get(term)) is not None]
                if not asked:
                    continue
                at = np.concatenate([[0], np.cumsum(col["dfs"][i].values.to_numpy())])
                local, number = np.array(asked).T
                place = np.full(len(block.terms), -1)
                place[number] = np.arange(len(number))
                docs = np.frombuffer(col["docs"][i].as_py(), "<u2")
                tfs = col["tfs"][i].as_py()
                tfs = np.frombuffer(tfs, f"<u{len(tfs) // len(docs)}")
                m = 10 + (90 * col["lengths"][i].values.to_numpy() * n) // total
                trees = Trees(docs, tfs, np.stack([at[local], at[local + 1]], axis=1), m, col["doc_ids"][i].as_py())
                for terms, own in zip(block.items, best):
                    rows = place[terms]
                    if (rows >= 0).any():
                        trees.search(rows[rows >= 0], weights[terms[rows >= 0]], own)
        flat = [(i, -s, None if null else d) for i, own in enumerate(best) for s, null, d in own.rows]
        items, scores, ids = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(scores, pa.int64()), pa.array(ids, kind)], ["item", "score", "doc_id"])

    kind = runs.schema["doc_ids"].dataType.elementType.simpleString()
    return runs.select("doc_ids", "lengths", "terms", "dfs", "docs", "tfs").mapInArrow(run, f"item int, score long, doc_id {kind}")


def search(runs: DataFrame, items: DataFrame, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text). runs: from index()."""
    spark = runs.sparkSession
    items = items.select("item_id", "text").filter("text is not null").distinct()
    n, total = runs.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    words = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(-(-words // block_words)) or 1
    schema = StructType([StructField("item", IntegerType()), StructField("item_id", items.schema["item_id"].dataType)])
    out = None
    for i in range(blocks):
        rows = (items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items).collect()  # block_words words, about
        found = _search_block(runs, Block([r["text"] for r in rows]), n or 0, total or 1, k)
        best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(rows)], schema)
        found = found.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        if blocks > 1:
            found = common.stored(found, "lexical-found")
        out = found if out is None else out.unionByName(found)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(common.table(spark, sf_dir, "documents")), common.table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The same result by scoring every document that shares a term with an item.
OP11_SQL = f"""
WITH d AS (SELECT r, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS w FROM documents) WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM d),
q AS (SELECT DISTINCT i, item_id, t FROM (SELECT i, item_id, unnest({_SQL_TERMS}) AS t FROM
     (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)))),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
v AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
s AS (SELECT i, item_id, r, sum(v.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * d.n * c.n) // c.l))))::BIGINT AS score
      FROM q JOIN p USING (t) JOIN v USING (t) JOIN d USING (r), c GROUP BY i, item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
WHERE rank <= {K}
"""
