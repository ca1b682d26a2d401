"""Near-duplicate detection by SimHash, with covering locality-sensitive hashing.

Fingerprints of 64 bits link at `radius` or fewer differing bits. Each bit position i gets a vector
m(i) in F2^(radius+1); for each of the 2^(radius+1)-1 non-zero vectors v there is a table whose mask
keeps the bits with <m(i), v> = 1. Any set of radius bits spans less than the whole space, so some
v is orthogonal to all of them and its mask drops them: pairs within the radius agree in some table.
A table compares about half of the bits, so chance collisions are rare.

Equal fingerprints are collapsed before anything is compared, so a group of exact copies is one
node. A bucket of near copies is linked by a frontier search in numpy: each node leaves the
unvisited set once, and a bucket gives a star (node, root inside it), never its pairs. A bucket of
over `SPLIT` nodes is dealt again by covering masks of the bits that its own mask drops, which keeps
the guarantee; nodes of such a bucket agree in about three quarters of all bits.
The stars of all tables are joined into components by hooking each root to its smallest neighbour
and shortening paths, all as DataFrames; keys with many rows are joined apart.

Deduplication (`keep_one`) has a rule of its own: texts link if their sets of five-word shingles have a similarity of
0.8 or more. Its candidates are pairs of which one of `SEEDS` independent fingerprints (of a text's words, each weighted by
the square root of its count) differs in `RADIUS` or fewer bits, so 8 times 15 tables; linked buckets give coarse groups,
in which the candidates are compared by their shingles exactly. A coarse group of over `BLOCK` texts or
`BLOCK_BYTES` is compared block by block, so a task's memory is bounded whatever the group. What is not a candidate is
not found: of pairs of similarity 0.8 to 0.85 the fingerprints find over 0.95 where single words are changed, and about a
half to four fifths where one passage of a tenth of the text is (README).

Defined cases: a null text has no words; texts without words have fingerprint zero and link like
others; fewer words than a shingle's are one shingle; texts of any length are hashed whole, in
blocks; repeated rows stay in near_duplicates(), each with its own result; component_id is null
where no row of a class has an id; an empty table gives an empty result; further columns are ignored,
whatever their names. keep_one() keeps all columns, and of each class the row with the smallest id
(rows without an id last), of several such rows the one whose text's hash is smallest, once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

RADIUS = 3
BITS = 64
SEED = 42
SHINGLE = 3
#: Nodes of a bucket that one task compares; larger buckets are dealt again.
SPLIT = 20_000
#: The rule of keep_one: words of a shingle, and the similarity as a fraction.
FIVE, SIMILAR = 5, (4, 5)
#: Its fingerprints; odd factors that make independent hashes of one.
SEEDS = 8
FACTORS = np.random.default_rng(SEED).integers(1 << 62, (1 << 63) - 1, SEEDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts of a block, and bytes of their shingles, about.
BLOCK, BLOCK_BYTES = 4_000, 64 << 20
TABLE_BITS = 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # of bytes, lower() changes A-Z alone and split() parts at 9-13 and 32


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    return of_words(words_of(text), width)


def of_words(words: list[bytes], width: int) -> int:
    """Unsigned 64-bit SimHash of words: a bit is set if over half of their shingles' hashes set it."""
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(starts)
    for a in range(0, n, 1 << 15):  # blocks: a text of any length needs bounded memory
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts[a : a + (1 << 15)], ends[a + width - 1 :])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, row_key (a hash of id and text) and fp of each row: the fingerprint of shingles of width words as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "row_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_texts(docs.select("doc_id", row_key().alias("row_key"), "text"), run, f"doc_id {kind}, row_key long, fp long")


def word_prints(words: list[bytes]) -> np.ndarray:
    """SEEDS fingerprints, as signed longs, of a text's words, each word weighted by the square root of its count."""
    if not words:
        return np.zeros(SEEDS, np.int64)
    counts = Counter(words)
    weights = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts))
    sums = np.zeros(SEEDS * BITS, np.float32)
    for a in range(0, len(hashes), 1 << 14):
        x = hashes[a : a + (1 << 14), None] * FACTORS
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        sums += weights[a : a + (1 << 14)] @ np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).astype(np.float32)
    return np.packbits(sums * 2 > weights.sum()).view(">u8").astype(np.uint64).view(np.int64)


def shingle_set(words: list[bytes], width: int = FIVE) -> np.ndarray:
    """The distinct shingles' hashes, rising; of fewer words the whole sequence is one."""
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def covering_masks(bits: list[int] | int = BITS, radius: int = RADIUS) -> list[int]:
    """The tables' masks over the given bit positions, of nearly equal size.

    Any vectors m(i) cover; of some ways to deal them out, the one whose smallest mask is largest is taken:
    rounds through all non-zero vectors, the vectors with the top bit set, and shuffles.
    """
    bits = list(range(bits)) if isinstance(bits, int) else bits
    n, top = len(bits), 1 << radius
    every = np.arange(1, 2 * top)
    ways = [np.resize(every, n), np.resize(top + np.arange(top), n)]
    ways += [np.resize(np.random.default_rng(seed).permutation(every), n) for seed in range(60)]
    inside = np.bitwise_count(np.stack(ways)[:, None, :] & every[None, :, None]) & 1  # way, table, position
    chosen = inside[inside.sum(axis=2).min(axis=1).argmax()].tolist()
    return [sum(1 << i for i, own in zip(bits, row) if own) for row in chosen]


def _distance(a: np.ndarray, x: np.int64) -> np.ndarray:
    return np.bitwise_count((a ^ x).view(np.uint64))  # of signed numbers it would count the absolute value's


def bucket_stars(nodes: np.ndarray, radius: int = RADIUS, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) for the nodes of a bucket that link to another one, chosen as root. Rows are (fp, node).

    Only distinct fingerprints are compared; all nodes of a linked set get its root's smallest node.
    """
    fps, of = np.unique(nodes[:, 0], return_inverse=True)
    first = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(first, of, nodes[:, 1])
    root_of, left = np.arange(len(fps)), np.arange(len(fps))
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            head, frontier = frontier[:block], frontier[block:]
            near = np.zeros(len(left), bool)
            for x in fps[head]:
                near |= _distance(fps[left], x) <= radius
            if near.any():
                root_of[left[near]] = root
                frontier, left = np.concatenate([frontier, left[near]]), left[~near]
    roots = first[root_of[of]]
    linked = nodes[:, 1] != roots
    return nodes[linked, 1], roots[linked]


def _mix(bucket: int, masked: np.ndarray, table: int) -> np.ndarray:
    x = (masked.view(np.uint64) ^ np.uint64((bucket * 0x9E3779B97F4A7C15 + table + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xA0761D6478BD642F)).view(np.int64)


STAR = ["fp", "node", "root", "bucket"]


def _stars(keyed: DataFrame, radius: int, split: int | None) -> DataFrame:
    """keyed: bucket, fp, node, ordered by bucket inside partitions. Gives the stars of each bucket.

    Of a bucket with over `split` nodes it gives their further buckets instead, with null roots. The
    last TABLE_BITS bits of a bucket tell its table; tables of several fingerprints follow one another.
    """
    masks = covering_masks(BITS, radius)
    inner = [covering_masks([i for i in range(BITS) if not m >> i & 1], radius) for m in masks]

    def stars(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = bucket_stars(np.concatenate(own, axis=0), radius)
        if len(a):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b), none], STAR)

    def deal(bucket: int, own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(own, axis=0)
        fp, node = (pa.array(np.ascontiguousarray(x)) for x in rows.T)
        none = pa.nulls(len(rows), pa.int64())
        for t, m in enumerate(inner[(bucket & ((1 << TABLE_BITS) - 1)) % len(inner)]):
            yield pa.RecordBatch.from_arrays([fp, node, none, pa.array(_mix(bucket, rows[:, 0] & np.int64(m - (1 << BITS) if m >> (BITS - 1) else m), t))], STAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, large = None, [], 0, False

        def end() -> Iterator[pa.RecordBatch]:
            if large:
                yield from deal(key, held) if held else ()
            elif size > 1:
                yield from stars(held)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            rows = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else [0]
            sizes = np.diff(bounds)
            edge = (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)
            for i in np.flatnonzero((sizes > 1) | edge).tolist():
                a, b = bounds[i], bounds[i + 1]
                if keys[a] != key:
                    yield from end()
                    key, held, size, large = int(keys[a]), [], 0, False
                held.append(rows[a:b])
                size += b - a
                if split and size > split:  # from here on the bucket passes through
                    large = True
                    yield from deal(key, held)
                    held = []
        yield from end()

    return keyed.mapInArrow(run, ", ".join(f"{c} long" for c in STAR))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (node, root); root is the smallest node of its component.

    Each round hooks every root to its smallest neighbouring root and shortens paths, so paths
    collapse in about log(length) rounds. Nothing but counts reaches the driver, and nodes or roots
    with many rows are joined by common.lookup.
    """
    both = edges.select("node", "root").filter("node <> root")
    parents = common.stored(
        both.select(F.explode(F.array("node", "root")).alias("node")).distinct().select("node", F.col("node").alias("parent")), "cc-parents"
    )
    live = common.stored(both.select(F.greatest("node", "root").alias("hi"), F.least("node", "root").alias("lo")).distinct(), "cc-edges")
    while live.limit(1).count():
        held = common.stored(live.groupBy("hi").agg(F.min("lo").alias("lo")), "cc-hooks")
        while True:  # hooks form chains to smaller nodes; halve them until each points to a root
            nxt = held.select(F.col("hi").alias("lo"), F.col("lo").alias("further"))
            jumped = common.lookup(held, nxt, "lo").select("hi", F.coalesce("further", "lo").alias("lo"), F.col("further").isNotNull().alias("moved"))
            moved = common.stored(jumped, "cc-jumped")
            common.dropped(held)
            going = moved.filter("moved").limit(1).count()
            held = common.stored(moved.select("hi", "lo"), "cc-hooks", moved)
            if not going:
                break
        up = held.select(F.col("hi").alias("parent"), F.col("lo").alias("above"))
        parents = common.stored(common.lookup(parents, up, "parent").select("node", F.coalesce("above", "parent").alias("parent")), "cc-parents", parents)
        left = common.stored(common.lookup(live, held.select("hi", F.col("lo").alias("a")), "hi").select(F.coalesce("a", "hi").alias("a"), "lo"), "cc-left", live)
        right = common.lookup(left, held.select(F.col("hi").alias("lo"), F.col("lo").alias("b")), "lo").select("a", F.coalesce("b", "lo").alias("b"))
        live = common.stored(right.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc-edges", left)
        common.dropped(held)
    common.dropped(live)
    out = parents.select("node", F.col("parent").alias("root"))
    out.stored_at = parents.stored_at
    return out


def star_edges(nodes: DataFrame, prints: list[Column], radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """A stored table of edges (node, root) that join the nodes of which some fingerprint differs in radius or fewer bits."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in covering_masks(BITS, radius)]
    key = lambda fp, m, t: F.shiftleft(F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(m))), TABLE_BITS).bitwiseOR(F.lit(t))
    tables = [F.struct(key(fp, m, i * len(signed) + t).alias("bucket"), fp.alias("fp")) for i, fp in enumerate(prints) for t, m in enumerate(signed)]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.select("bucket", "fp", "node").repartition(n, "bucket").sortWithinPartitions("bucket")
    keyed = nodes.select("node", F.explode(F.array(*tables)).alias("t")).select("t.bucket", "t.fp", "node")
    found = common.stored(_stars(dealt(keyed), radius, split), "simhash-stars")
    again = found.filter(F.col("root").isNull()).distinct()
    stars = found.filter(F.col("root").isNotNull())
    if again.limit(1).count():
        stars = stars.unionByName(_stars(dealt(again), radius, None))  # a bucket of these has at most about 2^15 fingerprints
    # a node has a root for each of its buckets: it keeps the least, to which its others are joined instead; those are few
    edges = stars.select("node", "root").distinct().withColumn("least", F.min("root").over(W.partitionBy("node")))
    roots = edges.filter(F.col("root") != F.col("least")).select(F.col("root").alias("node"), F.col("least").alias("root"))
    return common.stored(edges.select("node", F.col("least").alias("root")).unionByName(roots).distinct(), "simhash-edges", found)


def classes(prints: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """prints: stored, with fp. A stored table of each distinct fp with its class, its number of rows and its class's."""
    nodes = common.stored(prints.groupBy("fp").agg(F.count("*").alias("copies")), "simhash-nodes")
    edges = star_edges(nodes.withColumn("node", F.col("fp")), [F.col("fp")], radius, split)
    roots = components(prints.sparkSession, edges)
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "copies", F.coalesce("root", "fp").alias("root"))
    out = common.stored(linked, "simhash-linked")
    for table in (nodes, edges, roots):
        common.dropped(table)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links) of each row of docs."""
    prints = common.stored(fingerprints(docs, width), "simhash-prints")
    linked = classes(prints, radius)
    rows = common.stored(common.attach_by_key(prints, linked, "fp", "copies").drop("copies"), "simhash-rows", prints)
    common.dropped(linked)
    ids = common.stored(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")), "simhash-ids")
    return common.attach_by_key(rows, ids, "root", "rows").select("doc_id", "fp", "component_id")


def exact_links(nodes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """(nodes, roots): a spanning set of the links of a group, among candidates by any fingerprint, by the similarity of shingle sets."""
    sizes, (part, whole) = np.array([len(s) for s in sets]), SIMILAR
    left, found, roots = np.arange(len(nodes)), [], []
    while len(left) > 1:
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = (np.bitwise_count((prints[left] ^ prints[x]).view(np.uint64)) <= radius).any(axis=1)
            near &= (whole * np.minimum(sizes[left], sizes[x]) >= part * np.maximum(sizes[left], sizes[x]))
            own = np.zeros(len(left), bool)
            for i in np.flatnonzero(near).tolist():
                common_ = len(np.intersect1d(sets[x], sets[left[i]], assume_unique=True))
                own[i] = whole * common_ >= part * (sizes[x] + sizes[left[i]] - common_)
            if own.any():
                new = left[own].tolist()
                found += nodes[new].tolist()
                roots += [int(nodes[root])] * len(new)
                frontier += new
                left = left[~own]
    return found, roots


def _similar(docs: DataFrame, nodes: DataFrame, groups: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """A stored table of edges (node, root) by the rule of keep_one inside coarse groups.

    nodes: node, key (the row_key of one of its rows), times (rows of that key), words and prints; groups: node, root.
    """
    of = nodes.join(groups, "node")
    sizes = of.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.col("words") * 8) / block_bytes)).cast("int").alias("blocks"))
    of = common.lookup(common.stored(of, "simhash-grouped"), common.stored(sizes, "simhash-sizes"), "root")
    of = common.stored(of.select(F.col("key").alias("row_key"), "times", "node", "root", "prints", "blocks"), "simhash-members")
    texts = common.attach_by_key(docs.select(row_key().alias("row_key"), "text"), of, "row_key", "times")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keep = [i for i, n in enumerate(b.column("node").to_pylist()) if not (n in seen or seen.add(n))]  # a repeated row once a task
            sets = [shingle_set(words_of(b.column("text")[i].as_py())).tobytes() for i in keep]
            own = b.select(["root", "blocks", "node", "prints"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sets, pa.binary())], [*own.schema.names, "shingles"])

    kind = "root long, blocks int, node long, prints array<long>, shingles binary"
    sets = common.map_texts(texts.select("root", "blocks", "node", "prints", "text"), shingles, kind)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = sets.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("root", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "node", "prints", "shingles")

    def compare(group: pa.Table) -> pa.Table:
        first = dict(zip(group.column("node").to_pylist(), range(group.num_rows)))
        at = sorted(first.values())
        own = group.take(pa.array(at, pa.int64()))
        found, roots = exact_links(own.column("node").to_numpy(), np.array(own.column("prints").to_pylist(), np.int64), [np.frombuffer(x, np.uint64) for x in own.column("shingles").to_pylist()])
        return pa.table({"node": pa.array(found, pa.int64()), "root": pa.array(roots, pa.int64())})

    edges = pairs.groupBy("root", "a", "b").applyInArrow(compare, "node long, root long")
    return common.stored(edges.distinct(), "simhash-links", of)


def keep_one(docs: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns; see the head of the module."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t.as_py()) for t in b.column(2)]
            node = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in words], np.uint64).view(np.int64)
            arrays = [b.column(0), b.column(1), pa.array(node), pa.array([len(w) for w in words], pa.int64()), pa.array([word_prints(w) for w in words], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_key", "node", "words", "prints"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = common.map_texts(docs.select("doc_id", row_key().alias("row_key"), "text"), prints, f"doc_id {kind}, row_key long, node long, words long, prints array<long>")
    # rows of one id and text, then texts
    rows = common.stored(found.groupBy("row_key").agg(*[F.any_value(c).alias(c) for c in ("doc_id", "node", "words", "prints")], F.count("*").alias("times")), "simhash-rows")
    nodes = rows.groupBy("node").agg(F.min(F.struct("row_key", "times")).alias("key"), *[F.any_value(c).alias(c) for c in ("words", "prints")])
    nodes = common.stored(nodes.select("node", F.col("key.row_key").alias("key"), F.col("key.times").alias("times"), "words", "prints"), "simhash-nodes")
    coarse = star_edges(nodes, [F.col("prints")[i] for i in range(SEEDS)])
    groups = components(docs.sparkSession, coarse)
    links = _similar(docs, nodes, groups, block, block_bytes)
    roots = components(docs.sparkSession, links)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("own_key"), "times")
    classed = common.lookup(rows.select("doc_id", "row_key", "node", "times"), roots, "node")
    best = classed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("first"))
    key, times = common.fresh(docs, "key", "times")
    firsts = best.select(F.col("first.own_key").alias(key), F.col("first.times").alias(times))
    firsts = common.stored(firsts.groupBy(key).agg(F.max(times).alias(times)), "simhash-firsts")
    for table in (rows, nodes, coarse, groups, links, roots):
        common.dropped(table)
    kept = common.attach_by_key(docs.withColumn(key, row_key()), firsts, key, times)
    once = kept.filter(F.col(times) == 1).unionByName(kept.filter(F.col(times) > 1).dropDuplicates([key, "doc_id"]))
    return once.select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
