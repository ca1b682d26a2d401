"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of documents of about `SHARD_WORDS` words. Its words become numbers (the ranks of
64-bit hashes of their lower-cased bytes), documents are set apart by unique marks, and the index is built over the numbers: suffix order by prefix doubling, the
Burrows-Wheeler transform, and a wavelet matrix whose bit ranks answer "how many of this word before
here". Every window of the test texts is sought at once by backward search; a range that is not
empty is an occurrence set, whose places are found by stepping to the next sampled suffix position.
The places of all windows are merged into removal spans for each document.

Test windows: WINDOW consecutive words of an item; an item of fewer, but not none, is one window. A
document word inside any occurrence is hit, and a document is contaminated if it has hits and they
are a twentieth of its words or more.

The test texts are cut into blocks of about `BLOCK_WORDS` words, of which the driver makes one at a time; a
task holds `BLOCKS` of them at most (about 9 bytes a word) and searches all of them in an index before it
builds the next one. So a benchmark of up to BLOCKS * BLOCK_WORDS words, 16 million, costs one reading of the
documents and one indexing, without a shuffle; a larger one costs as many as it has groups of blocks.

Defined cases: null and empty texts have no words and are clean; an item without words has no
window, nor has one without an id; a document longer than a shard is indexed in pieces that overlap by WINDOW - 1 words;
repeated rows each get their result; an item that stands twice is one item per row id; empty tables
give no hits or an empty result; further columns stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
SHARE = 20
SHARD_WORDS = 400_000
BLOCK_WORDS = 2_000_000
BLOCKS = 8
SAMPLE = 8

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.array([not (b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
_IS_WORD[0x41:0x5B] = True  # A-Z, which are lower-cased
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[0x41:0x5B] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if text else []


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of UTF-8 bytes; the hash is of the lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], _IS_WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    folded = (_FOLD[raw] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    folded ^= folded >> np.uint64(29)
    # sum of mixed bytes times powers of an odd factor, taken back to the word's start by the inverse power
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    live, k = np.arange(len(starts)), 0
    while len(live):  # one step for each letter position; long words are rare
        if k >= 64:
            for i in live:
                h = 0
                for x in folded[starts[i] + k : ends[i]].tolist():
                    h = (h * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
                out[i] ^= np.uint64(h * 2 + 1 & 0xFFFFFFFFFFFFFFFF)
            break
        out[live] = out[live] * _FACTOR + folded[starts[live] + k]
        k += 1
        live = live[lengths[live] > k]
    out ^= out >> np.uint64(32)
    return out * _FACTOR + lengths.astype(np.uint64), starts, ends


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array of numbers below 2^31 by prefix doubling; only suffixes not yet apart are sorted again."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64)
    pad = np.concatenate([seq.astype(np.int64) + 1, np.zeros(2, np.int64)])
    key = (pad[:n] << 32) | pad[1 : n + 1]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 2
    while True:
        same = np.flatnonzero(~fresh)
        if not len(same):
            return order
        member = ~fresh
        member[same - 1] = True
        slots = np.flatnonzero(member)
        suffix = order[slots]
        key = (rank[suffix] << 32) | (rank[np.minimum(suffix + step, n)] + 1)
        inner = np.argsort(key, kind="stable")
        order[slots], key = suffix[inner], key[inner]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[slots] |= new
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        step *= 2


class WaveletMatrix:
    """Bits of numbers, level by level; rank(symbol, place) counts the symbol before the place."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        current = values.astype(np.uint32)
        self.bits = max(1, int(top).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> np.uint32(level)) & np.uint32(1)
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(bit) - int(ones[-1])
            self.levels.append((ones, zeros))
            one = bit.astype(bool)
            current = np.concatenate([current[~one], current[one]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        begin, at = np.zeros(len(places), np.int64), places.astype(np.int64)
        for level, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            one = ((symbols >> level) & 1).astype(bool)
            b1, a1 = ones[begin], ones[at]
            begin, at = np.where(one, zeros + b1, begin - b1), np.where(one, zeros + a1, at - a1)
        return at - begin

    def access(self, places: np.ndarray) -> np.ndarray:
        at, out = places.astype(np.int64), np.zeros(len(places), np.int64)
        for ones, zeros in self.levels:
            one = ones[at + 1] - ones[at]
            out = out * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Index of a sequence of numbers that ends with its only 0."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        order = suffix_order(seq)
        top = int(seq.max(initial=0))
        self.n = len(seq)
        self.wavelet = WaveletMatrix(seq[order - 1], top)  # order - 1 is -1 for the first: the end mark
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        kept = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows of numbers padded on the right) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.below[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.marks[at[live] + 1] > self.marks[at[live]]
            hit = live[done]
            out[hit] = self.samples[self.marks[at[hit]]] + steps[hit]
            live = live[~done]
            symbol = self.wavelet.access(at[live])
            at[live] = self.below[symbol] + self.wavelet.rank(symbol, at[live])
            steps[live] += 1
        return out


class Block:
    """A block of items: their joined word hashes, where each item's begin, and the items' ids."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes = [word_hashes(text.encode("utf-8", "replace"))[0] for _, text in items]
        self.hashes = np.concatenate([*hashes, np.zeros(WINDOW, np.uint64)])  # so that every window has WINDOW places
        self.sizes, self.items = np.array([len(h) for h in hashes], np.int64), np.array([i for i, _ in items], np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window its place in the hashes, its length and its item."""
        n = np.where(self.sizes > 0, np.maximum(self.sizes - WINDOW + 1, 1), 0)
        shift = np.cumsum(self.sizes) - self.sizes - (np.cumsum(n) - n)
        return np.arange(n.sum()) + np.repeat(shift, n), np.repeat(np.minimum(self.sizes, WINDOW), n), np.repeat(self.items, n)


Occurrences = list[list[tuple[int, int, int]]]


def occurrences(data: bytes, bounds: list[tuple[int, int]], blocks: Callable[[], Iterable[Block]]) -> tuple[list[np.ndarray], Occurrences]:
    """For each document (byte bounds in data): its word bounds as bytes, and (first word, end word, item) of occurrences.

    Each run of words is indexed once, if any block needs it, and all blocks are searched in it.
    """
    hashes, starts, ends = word_hashes(data)
    first = np.searchsorted(starts, [a for a, _ in bounds])
    last = np.searchsorted(starts, [b for _, b in bounds])
    spans = [np.stack([starts[a:b], ends[a:b]], axis=1) for a, b in zip(first, last)]
    found: Occurrences = [[] for _ in bounds]
    for lo in range(0, len(hashes), SHARD_WORDS):  # one run, but for a document longer than a shard
        run = _Run(hashes[lo : lo + SHARD_WORDS + WINDOW - 1], lo, first, last)
        for block in blocks():
            run.search(block, found)
    return spans, found


class _Run:
    """Words of a shard: their numbers, the documents among them, and, once it is needed, their index."""

    def __init__(self, hashes: np.ndarray, lo: int, first: np.ndarray, last: np.ndarray):
        self.vocabulary, self.numbers = np.unique(hashes, return_inverse=True)
        self.docs = np.flatnonzero((last > lo) & (first < lo + len(hashes)) & (last > first))
        self.offset = len(self.docs) + 1  # 0 ends the sequence, 1..len(docs) end documents
        self.cuts = np.clip(last[self.docs] - lo, 0, len(hashes))
        self.first, self.lo = first[self.docs] - lo, lo

    @cached_property
    def index(self) -> FMIndex:
        seq = np.insert(self.numbers.astype(np.int64) + self.offset, self.cuts, np.arange(1, self.offset))
        return FMIndex(np.append(seq, 0))

    def search(self, block: Block, found: Occurrences) -> None:
        begin, length, owner = block.windows()
        at = np.minimum(np.searchsorted(self.vocabulary, block.hashes), len(self.vocabulary) - 1)
        known = np.concatenate([[0], np.cumsum(self.vocabulary[at] == block.hashes)])
        live = np.flatnonzero(known[begin + length] - known[begin] == length)
        if not len(live):
            return  # some word of every window is in no document here
        low, high = self.index.ranges(at[begin[live][:, None] + np.arange(WINDOW)] + self.offset, length[live])
        size = high - low
        hit = np.flatnonzero(size > 0)
        if not len(hit):
            return
        which = live[np.repeat(hit, size[hit])]
        place = self.index.locate(np.concatenate([np.arange(low[i], high[i]) for i in hit]))
        doc = np.searchsorted(self.cuts + np.arange(len(self.docs)), place, side="left")
        word = place - doc - self.first[doc]
        for d, w, n, item in zip(self.docs[doc].tolist(), word.tolist(), length[which].tolist(), owner[which].tolist()):
            found[d].append((w, w + n, item))


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_WORDS words at most, or one item; the driver holds one at a time."""
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    words = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n = int(-(-words // BLOCK_WORDS)) or 1
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Block(sorted((r["item_id"], r["text"]) for r in own.collect() if r["item_id"] is not None))


def _groups(benchmark: DataFrame) -> Iterator[list[Broadcast]]:
    """Groups of at most BLOCKS broadcast blocks, which tasks hold together."""
    spark = benchmark.sparkSession
    blocks = _blocks(benchmark)
    while group := [spark.sparkContext.broadcast(b) for b in islice(blocks, BLOCKS)]:
        yield group


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FOUND = "row long, doc_id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<long>, cut array<struct<start:long,end:long>>"


def _find_group(docs: DataFrame, group: list[Broadcast]) -> DataFrame:
    """docs: row, doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span, id_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), None

    def shard(rows: list[int], ids: list, texts: list[bytes]) -> pa.RecordBatch:
        bounds, at = [], 0
        for t in texts:
            bounds.append((at, at + len(t)))
            at += len(t) + 1
        words, found = occurrences(b"\n".join(texts), bounds, lambda: (b.value for b in group))
        spans = [_merged([(a, b) for a, b, _ in f]) for f in found]
        items = [sorted({item for *_, item in f}) for f in found]
        bytes_of = [[(int(w[a][0]) - z[0], int(w[b - 1][1]) - z[0]) for a, b in s] for w, s, z in zip(words, spans, bounds)]
        as_structs = lambda rows: pa.array([[{"start": a, "end": b} for a, b in r] for r in rows], span)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(ids, id_type), pa.array([len(w) for w in words], pa.int64()), as_structs(spans), pa.array(items, pa.list_(pa.int64())), as_structs(bytes_of)],
            ["row", "doc_id", "n_words", "spans", "items", "cut"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        rows, ids, texts, size = [], [], [], 0
        for b in batches:
            id_type = b.schema.field(1).type
            for row, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = (t.as_py() or "").encode("utf-8", "replace")
                if ids and size + len(text) > SHARD_WORDS * 6:
                    yield shard(rows, ids, texts)
                    rows, ids, texts, size = [], [], [], 0
                rows.append(row)
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield shard(rows, ids, texts)

    return common.map_texts(docs, run, FOUND.format(kind=kind))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, doc_id, n_words, n_hit, spans (merged, in words), items (ids with occurrences), cut (spans in UTF-8 bytes), contaminated.

    With one group of blocks this is one pass. With more, the rows are numbered in a stored copy, so that
    they stay apart even if ids repeat, each group's findings are stored, and they meet by that number.
    """
    groups = _groups(benchmark)
    first, second = next(groups), next(groups, None)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if second is not None:
        rows = common.stored(rows, "clean-rows")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = _find_group(rows, first)
    if second is not None:
        found = common.stored(found, "clean-found")
        for group in chain([second], groups):
            found = found.unionByName(common.stored(_find_group(rows, group).filter(F.size("spans") > 0), "clean-found"))
        whole = lambda c: F.array_sort(F.flatten(F.collect_list(c)))  # noqa: E731  one entry for each group of blocks
        union = lambda c: F.aggregate(
            whole(c), F.expr("cast(array() as array<struct<start:long,end:long>>)"),
            lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, F.greatest(F.size(out), F.lit(1))).getField("end") >= s["start"]),
                F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(out[F.size(out) - 1]["start"].alias("start"), F.greatest(out[F.size(out) - 1]["end"], s["end"]).alias("end")))))
            .otherwise(F.concat(out, F.array(s))),
        )
        found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), union("spans").alias("spans"), F.array_distinct(whole("items")).alias("items"), union("cut").alias("cut"))
    found = found.withColumn("n_hit", hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def _keep_clean_group(docs: DataFrame, group: list[Broadcast]) -> DataFrame:
    columns = docs.columns

    def clean(own: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [(t.as_py() or "").encode("utf-8", "replace") for b in own for t in b.column(columns.index("text"))]
        bounds, at = [], 0
        for t in texts:
            bounds.append((at, at + len(t)))
            at += len(t) + 1
        words, found = occurrences(b"\n".join(texts), bounds, lambda: (b.value for b in group))
        hits = [sum(b - a for a, b in _merged([(a, b) for a, b, _ in f])) for f in found]
        keep = pa.array([not (h and SHARE * h >= len(w)) for h, w in zip(hits, words)], pa.bool_())
        at = 0
        for b in own:
            yield b.filter(keep.slice(at, b.num_rows))
            at += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                own.append(b)
                size += b.column(columns.index("text")).nbytes
                if size > SHARD_WORDS * 6:
                    yield from clean(own)
                    own, size = [], 0
        if own:
            yield from clean(own)

    return common.map_texts(docs, run, docs.schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; the others stay as they are.

    With one group of blocks rows are judged and kept in one pass. With more, rows are numbered in a
    stored copy and the judgements meet them by that number.
    """
    groups = _groups(benchmark)
    first, second = next(groups), next(groups, None)
    if second is None:
        return _keep_clean_group(docs, first)
    (row,) = common.fresh(docs, "row")
    numbered = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "clean-docs")
    bad = find(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark).filter("contaminated").select(F.col("doc_id").alias(row))
    return numbered.join(bad, row, "left_anti").select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    items = F.array_distinct("items")
    joined = F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same result by joining every window of every document with the windows of the items.
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
c AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
o AS (SELECT DISTINCT r, i, c.n, item_id FROM c JOIN win ON win.k = c.k AND win.n = c.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""
