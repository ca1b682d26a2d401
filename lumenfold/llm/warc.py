"""WARC archives of captures, and their index by an external merge.

Writing: a page becomes a response record, or a revisit record if an equal payload of at least
`MIN_REVISIT` bytes has a smaller page_id; Spark's text writer ends each record with the blank lines
that the format asks for, so archives are written to any file system, gzipped.

Reading: each archive is parsed by its Content-Length headers as a stream and gives one run of index
entries, sorted by URL key (host parts reversed), capture time and page_id. Runs are stored and cut at
sampled quantiles of their keys into ranges of about `RANGE_ROWS` entries; each range is a task, which
merges its parts of the runs by a loser tree, so the ranges in order are one globally ordered capture
history. The place of a record is the end of its key, so one URL, host or missing id is cut like any
other.

Defined cases: null html is an empty payload; a null URL has an empty key and no target header;
rows with a null page_id are responses and nothing refers to them; repeated rows with the smallest
page_id of a payload are all responses; line breaks in URLs are percent-encoded; empty tables give
an empty result; payloads of any length are whole, large ones stand in archives of few records; records of
one key are ordered by archive and place; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
#: Records of an archive, at most, and about the bytes of its payloads.
FILE_RECORDS, FILE_BYTES = 8_192, 256 << 20
RANGE_ROWS = 100_000
BREAK = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1_704_067_200

ENTRY = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, record_at long"
NAMES = [f.split()[0] for f in ENTRY.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def url_key(url: str | None) -> str:
    """The URL with its host's parts reversed, lower-cased, without scheme, www, default port and fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{where}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def with_revisits(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to (null for responses) of each page;
    and a stored table of the digests and sizes.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    every = common.stored(keyed.select("page_id", "payload_digest", "payload_bytes"), "warc-digests")
    small = every.filter((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    shared = small.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    shared = common.stored(shared, "warc-shared")
    revisits = common.attach_by_key(small, shared, "payload_digest", "copies").filter("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    revisits = common.stored(revisits, "warc-revisits", shared)
    # rows without an id never are revisits, and stay out of the join
    named = keyed.filter("page_id is not null").join(revisits, ["page_id", "payload_digest"], "left")
    return named.unionByName(keyed.filter("page_id is null").withColumn("refers_to", F.lit(None).cast(revisits.schema["refers_to"].dataType))), every


def record(captured: Column) -> Column:
    """The text of a record, without the two line breaks that end it."""
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    utc = F.date_format(F.to_utc_timestamp(captured, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", page("page_id")),
        line("WARC-Date", utc), F.coalesce(line("WARC-Target-URI", uri), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", page("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(BREAK), block,
    )


def write_archives(pages: DataFrame, path: str, captured: Column | None = None) -> None:
    """Archives under path. captured: the capture time; by default it follows from page_id.

    A row of over FILE_BYTES / FILE_RECORDS bytes goes to archives of fewer records, in proportion to its
    size class, so that no archive holds much over FILE_BYTES, or one record.
    """
    if captured is None:
        captured = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(300_000_000)))
    rows, sizes = with_revisits(pages)
    rows = rows.select("payload_bytes", record(captured).alias("value"))
    step = F.when(F.col("payload_bytes") * FILE_RECORDS <= FILE_BYTES, 0).otherwise(F.ceil(F.log2(F.col("payload_bytes") * FILE_RECORDS / FILE_BYTES) / 3)).cast("int")
    for (k,) in sorted(sizes.select(step).distinct().collect()) or [(0,)]:  # steps of eight times the size: a few
        own = rows.filter(step == k).select("value")
        own.write.mode("append").option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_RECORDS >> 3 * k)).text(path)
    common.dropped(sizes)


def parse(stream, archive: str) -> Iterator[tuple]:
    """Index entries of an archive, in the order of ENTRY; payloads of responses are hashed, not kept."""
    at = 0
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at} of {archive}")
        head, size = {}, len(first)
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8")
        block = stream.read(int(head[b"content-length"]))
        stream.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        full = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        kind, digest = head[b"warc-type"], head[b"warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and (len(payload) != full or sha256(payload).hexdigest() != digest):
            raise ValueError(f"damaged payload at byte {at} of {archive}")
        number = lambda x: int(v) if (v := x.removeprefix("<urn:page:").rstrip(">")) else None
        uri, refers = head.get(b"warc-target-uri"), head.get(b"warc-refers-to")
        yield (url_key(uri), head[b"warc-date"], number(head[b"warc-record-id"]), full, digest, kind, number(refers) if refers else None, uri, archive, at)
        at += size + 2 + len(block) + 4


def merge_key(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A run for each archive: entries sorted by merge_key, with run (its name) and seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                stream = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 16)
                rows = sorted(parse(stream, name), key=merge_key)
                columns = list(zip(*rows)) or [[] for _ in TYPES]
                arrays = [pa.array(c, t) for c, t in zip(columns, TYPES)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())], [*NAMES, "run", "seq"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, f"{ENTRY}, run string, seq long")


class LoserTree:
    """Merges sorted iterators: the inner nodes hold the losers of their matches, the winner stands at the root."""

    END = (1,)

    def __init__(self, runs: list[Iterator[tuple]], key=merge_key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [self.END if h is None else (0, *key(h)) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, building=True)

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + self.k) >> 1
        while node:
            other = self.losers[node]
            if other < 0 and building:  # the rival hasn't come yet
                self.losers[node] = i
                return
            if (self.keys[other], other) < (self.keys[i], i):
                self.losers[node], i = i, other
            node >>= 1
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[i := self.losers[0]] != self.END:
            yield self.heads[i]
            self.heads[i] = h = next(self.runs[i], None)
            self.keys[i] = self.END if h is None else (0, *self.key(h))
            self._play(i)


def merged_index(runs: DataFrame) -> DataFrame:
    """The entries of stored runs with range_no and position: ordered by these, they are ordered by merge_key.

    Spark cuts the keys at sampled quantiles. The place of the record is part of a key, so that no
    URL, host or null id holds a range together.
    """
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)  # the entries of one range, about RANGE_ROWS, by run and place
        if not own:
            return
        table = pa.Table.from_batches(own).combine_chunks()
        names, number = table.column("run").combine_chunks().dictionary_encode(), TaskContext.get().partitionId()
        cuts = [0, *(np.flatnonzero(np.diff(names.indices.to_numpy())) + 1).tolist(), table.num_rows]

        def entries(at: int, end: int) -> Iterator[tuple]:
            for i in range(at, end, 500):
                yield from zip(*(c.to_pylist() for c in table.slice(i, min(500, end - i)).select(NAMES).columns))

        merged, position = iter(LoserTree([entries(a, b) for a, b in zip(cuts, cuts[1:])])), 0
        while part := list(islice(merged, 10_000)):
            arrays = [pa.array(c, t) for c, t in zip(zip(*part), TYPES)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([number] * len(part), pa.int32()), pa.array(range(position, position + len(part)), pa.int64())], [*NAMES, "range_no", "position"])
            position += len(part)

    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(merge, f"{ENTRY}, range_no int, position long")


def capture_history(pages: DataFrame) -> DataFrame:
    """Archives of pages are written to shared storage and read back into one ordered index."""
    spark = pages.sparkSession
    path = common.shared_path(spark, "warc-archives")
    write_archives(pages, path)
    return merged_index(common.stored(read_runs(spark, path), "warc-runs"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_history(common.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 AND page_id IS NOT NULL THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f
"""
