"""A Spark data source of whole files: spark.read.format("documents").load(path), df.write.format("documents").save(path).

Reading. A row for each file below path (path, filename, file_type, size, content, error). The listing is
made once in planning; filters on path, filename, file_type and size are applied to it (with
spark.sql.python.filterPushdown.enabled) and partitions are cut from it by bytes and number of files. A schema without
content (`.schema("path string, size long")`) opens no file. A file that can't be opened, or is over the option
maxBytes, is a row with `error` and without content. Names that begin with _ or . are hidden. The driver lists folder by
folder and holds the files of the partitions packed, a few bytes each.

Writing. A row (filename, content) is a file. Each task writes into a hidden folder of its own, which gets its name when the
job commits, so failed or repeated tasks leave nothing to be read. Overwriting removes what was there before at that moment.

Spark plans and commits a Python data source in processes beside the driver, whose memory counts as the driver's (nine of 38 to
62 MB without any file). `read` and `write` here run the same reader and writer in tasks and need none of them.

Paths are those that pyarrow opens on driver and executors (file, hdfs, s3, gs, abfs). For other stores
`files.read_files` reads by Spark's own binary reader.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lexicon import MAX_BYTES
from . import files

SCHEMA = "path string, filename string, file_type string, size long, content binary, error string"
_TYPES = {"path": pa.string(), "filename": pa.string(), "file_type": pa.string(), "size": pa.int64(), "content": pa.binary(), "error": pa.string()}
#: Bytes and files of a partition, and bytes of a batch, about.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES = 64 << 20, 2_000, 16 << 20

_TESTS = {
    ds.EqualTo: lambda a, b: a == b, ds.In: lambda a, b: a in b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a,
}


@dataclass
class Files(ds.InputPartition):
    """Listed files; packed, as the driver holds those of all partitions."""

    packed: bytes

    @classmethod
    def of(cls, found: list[tuple[str, int]]) -> Files:
        paths, sizes = zip(*found) if found else ((), ())
        return cls(zlib.compress(pickle.dumps((paths, sizes))))

    @property
    def listed(self) -> list[tuple[str, str, str, int]]:
        """path, filename, file_type, size."""
        return [tuple(_described(path, size).values()) for path, size in zip(*pickle.loads(zlib.decompress(self.packed)))]


def _described(path: str, size: int) -> dict[str, str | int]:
    name = path.rpartition("/")[2]
    return {"path": path, "filename": name, "file_type": name.rpartition(".")[2].lower() if "." in name else "", "size": size}


def _below(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
    """path and size of the files below a folder, by path. Of each level one folder's listing is held."""
    ordered = lambda i: i.path + "/" * (i.type == fs.FileType.Directory)
    for info in sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=False)), key=ordered):
        if info.base_name[:1] in "._":
            continue
        if info.type == fs.FileType.Directory:
            yield from _below(store, info.path)
        elif info.type == fs.FileType.File:
            yield info.path, info.size


class DocumentReader(ds.DataSourceReader):
    def __init__(self, path: str, columns: list[str], max_bytes: int):
        self.path, self.columns, self.max_bytes, self.tests = path, columns, max_bytes, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in ("path", "filename", "file_type", "size"):
                self.tests.append((type(f), f.attribute[0], f.value))
            elif not (isinstance(f, ds.IsNotNull) and f.attribute[0] in ("path", "filename", "file_type", "size")):
                yield f

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path)
        out, own, size = [], [], 0
        for path, n in _below(store, root):
            if self.tests:
                row = _described(path, n)
                if not all(_TESTS[kind](row[column], value) for kind, column, value in self.tests):
                    continue
            own.append((path, n))
            size += n
            if size >= PARTITION_BYTES or len(own) >= PARTITION_FILES:
                out.append(Files.of(own))
                own, size = [], 0
        return [*out, Files.of(own)] if own or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        opened = "content" in self.columns
        rows, size = [], 0
        for path, name, kind, n in partition.listed:
            content = error = None
            if n > self.max_bytes:
                error = "413 file too large"
            elif opened:
                try:
                    with store.open_input_stream(path) as f:
                        content = f.read()
                except OSError as e:
                    error = f"404 {type(e).__name__}: {e}"[:500]
            rows.append((path, name, kind, n, content, error))
            size += len(content or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(_TYPES, zip(*rows))) if rows else dict.fromkeys(_TYPES, ())
        return pa.RecordBatch.from_arrays([pa.array(columns[c], _TYPES[c]) for c in self.columns], self.columns)


@dataclass
class Written(ds.WriterCommitMessage):
    folder: str


class DocumentWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        folder = f"task-{uuid.uuid4().hex}"  # of this attempt only
        store.create_dir(f"{root}/{self.job}/{folder}", recursive=True)
        for b in iterator:
            for name, content in zip(b.column("filename"), b.column("content")):
                with store.open_output_stream(f"{root}/{self.job}/{folder}/{name.as_py()}") as f:
                    f.write(content.as_py() or b"")
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name[:1] not in "._":
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        for m in filter(None, messages):
            store.move(f"{root}/{self.job}/{m.folder}", f"{root}/{m.folder}")
        self._clear()  # what failed or repeated tasks left

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class DocumentSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options["path"], schema.names, int(self.options.get("maxBytes", MAX_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters into the listing."""
    spark.dataSource.register(DocumentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, file_type and size of the files below path; none is opened."""
    register(spark)
    return spark.read.format("documents").schema("path string, filename string, file_type string, size long").load(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all files below path, empty ones too, listed now; those that can't be read or aren't taken have `error`."""
    reader = DocumentReader(path, [*_TYPES], MAX_BYTES)
    parts = [(p.packed,) for p in reader.partitions()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in (p for b in batches for p in b.column("packed")):
            yield from reader.read(Files(packed.as_py()))

    found = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)), "packed binary").mapInArrow(run, SCHEMA)
    docs = files.read_bytes(found.select(F.xxhash64("path").alias("doc_id"), "path", "size", "filename", "content", F.col("error").alias("read_error")))
    return docs.withColumn("error", F.coalesce("read_error", "error")).drop("read_error")


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each row (filename, content). mode: append or overwrite."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode {mode} is neither append nor overwrite")
    writer = DocumentWriter(path, mode == "overwrite")
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)  # a table without partitions has no task that would

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"folder": [writer.write(batches).folder]})

    try:
        messages = [Written(r.folder) for r in df.select("filename", "content").mapInArrow(run, "folder string").collect()]
    except Exception:
        writer.abort([])
        raise
    writer.commit(messages)
