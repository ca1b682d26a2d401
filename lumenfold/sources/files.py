"""Documents from files: TXT, DOCX and PDF by Spark's binary reader; JSON and Parquet for results.

A file that can't be read becomes a row with `error`, so one bad file never ends a job. Suffix and
size are tested on the listing, before contents are read (the size filter is pushed down).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import MAX_BYTES, SUFFIXES
from ..operators.layout import page_order, text_blocks
from ..operators.segment import is_scanned
from . import pdf

SCHEMA = "filename string, file_type string, raw_text string, blocks array<array<struct<block_no:int,page_width:double,x0:double,y0:double,x1:double,y1:double,text:string>>>, runs array<struct<width:double,runs:array<struct<x0:double,y0:double,x1:double,y1:double,size:double,text:string>>>>, page_count int, metadata map<string,string>, error string"
_BLOCK = [("block_no", pa.int32()), *[(f, pa.float64()) for f in ("page_width", "x0", "y0", "x1", "y1")], ("text", pa.string())]
PAGE_BLOCKS = pa.list_(pa.list_(pa.struct(_BLOCK)))
_RUN = [*[(f, pa.float64()) for f in ("x0", "y0", "x1", "y1", "size")], ("text", pa.string())]
PAGE_RUNS = pa.list_(pa.struct([("width", pa.float64()), ("runs", pa.list_(pa.struct(_RUN)))]))
#: Files whose runs are held as Python values at once.
FILES_AT_ONCE = 256
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def reject_reason(filename: Column, size: Column) -> Column:
    """Why a file is not taken: 400 no name, 415 unknown suffix, 413 too large; null if it is."""
    return (
        F.when(filename.isNull() | (F.trim(filename) == ""), "400 missing filename").when(~suffix(filename).isin(*SUFFIXES), "415 unsupported file type")
        .when(size > MAX_BYTES, "413 file too large")
    )


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def docx_text(data: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs, then table rows with cells joined by a bar."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text_of = lambda node: "".join((n.text or "") if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" for n in node.iter() if n.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    paragraphs = [t for p in body.findall(f"{_W}p") if (t := text_of(p)).strip()]
    tables = body.findall(f"{_W}tbl")
    rows = []
    for row in (r for t in tables for r in t.findall(f"{_W}tr")):
        cells = [c for cell in row.findall(f"{_W}tc") if (c := "\n".join(text_of(p) for p in cell.findall(f"{_W}p")).strip())]
        if cells:
            rows.append(" | ".join(cells))
    text = "\n".join(paragraphs)
    return (text + "\n\n" + "\n".join(rows) if rows else text), {"paragraphs": str(len(paragraphs)), "tables": str(len(tables))}


def _pdf_library(data: bytes) -> list[list[dict]] | None:
    """The text blocks of each page by an installed PDF library, or None if there is none."""
    try:
        import fitz
    except ImportError:
        return None
    with fitz.open(stream=data, filetype="pdf") as doc:
        return [_library_page(page) for page in doc]


def _library_page(page) -> list[dict]:
    """Text blocks sorted by place; a page without any gives its plain text as one block."""
    found = [_block(n, *b[:5], page.rect.width) for n, b in enumerate(page.get_text("blocks", sort=True)) if b[4].strip() and (len(b) < 7 or b[6] == 0)]
    return found or [_block(0, 0.0, 0.0, 0.0, 0.0, page.get_text("text") or "", page.rect.width)]


def _block(number: int, x0: float, y0: float, x1: float, y1: float, text: str, width: float) -> dict:
    return {"block_no": number, "page_width": width, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text}


def pdf_pages(data: bytes) -> tuple[list[list[dict]] | None, list[dict] | None, str]:
    """The blocks of the pages by a library, or else their glyph runs; and which reader gave them."""
    try:
        if (found := _pdf_library(data)) is not None:
            return found, None, "library"
    except Exception as first:  # noqa: BLE001  the other reader may still manage
        try:
            return None, _pdf_runs(data), "runs"
        except Exception as second:
            raise RuntimeError(f"both PDF readers failed: {first}; {second}") from second
    return None, _pdf_runs(data), "runs"


def _pdf_runs(data: bytes) -> list[dict]:
    return [{"width": width, "runs": [dict(zip(("x0", "y0", "x1", "y1", "size", "text"), r)) for r in runs]} for width, runs in pdf.pages(data)]


def read_bytes(files: DataFrame) -> DataFrame:
    """files (filename, content) as documents; keeps every other column of files."""
    others = [c for c in files.columns if c not in ("filename", "content")]
    ready = files.select(*others, "filename", "content", F.coalesce(suffix(F.col("filename")), F.lit("")).alias("file_type"), reject_reason(F.col("filename"), F.length("content")).alias("error"))
    text = F.when(F.col("error").isNull() & (F.col("file_type") == "txt"), decode_text(F.col("content")))
    binary = F.when(F.col("error").isNull() & (F.col("file_type") != "txt"), F.col("content"))  # text needs no Python
    ready = ready.withColumns({"raw_text": text, "content": binary})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, FILES_AT_ONCE) for whole in batches for i in range(0, max(whole.num_rows, 1), FILES_AT_ONCE)):
            n, column = b.num_rows, {c: b.column(c) for c in b.schema.names}
            text, blocks, runs, errors = column["raw_text"], [None] * n, [None] * n, column["error"]
            binary = np.flatnonzero(column["content"].is_valid().to_numpy(zero_copy_only=False)).tolist()
            texts, found, meta, counts = {}, {}, [[] for _ in range(n)], {}
            for i in binary:  # text files stay as they are
                try:
                    if column["file_type"][i].as_py() == "docx":
                        texts[i], own = docx_text(column["content"][i].as_py())
                        meta[i] = list(own.items())
                    else:
                        blocks[i], runs[i], engine = pdf_pages(column["content"][i].as_py())
                        meta[i], counts[i] = [("engine", engine)], len(blocks[i] if runs[i] is None else runs[i])
                except Exception as e:  # noqa: BLE001  a bad file is a row with its error
                    found[i] = f"422 {type(e).__name__}: {e}"[:500]
            if binary:
                text = pa.array([texts.get(i, t) for i, t in enumerate(text.to_pylist())], pa.string())
                errors = pa.array([found.get(i, e) for i, e in enumerate(errors.to_pylist())], pa.string())
            arrays = [column[c] for c in others] + [column["filename"], column["file_type"], text, pa.array(blocks, PAGE_BLOCKS), pa.array(runs, PAGE_RUNS), pa.array([counts.get(i) for i in range(n)], pa.int32()), pa.array(meta, pa.map_(pa.string(), pa.string())), errors]
            yield pa.RecordBatch.from_arrays(arrays, [*others, "filename", "file_type", "raw_text", "blocks", "runs", "page_count", "metadata", "error"])

    kept = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in others)
    docs = ready.mapInArrow(run, kept + SCHEMA)
    # lines, blocks and reading order of pages are found here; a text is one page
    by_runs = F.transform("runs", lambda p: page_order(text_blocks(p["runs"], p["width"])))
    pages = F.when(F.col("blocks").isNotNull(), F.transform("blocks", page_order)).when(F.col("runs").isNotNull(), by_runs).when(F.col("raw_text").isNotNull(), F.array("raw_text"))
    docs = docs.withColumn("pages", pages)
    docs = docs.withColumns({
        "raw_text": F.coalesce("raw_text", F.array_join("pages", "\n\n")),
        "page_count": F.when(F.col("pages").isNotNull(), F.coalesce("page_count", F.lit(1))),
        "is_scanned": F.coalesce((F.col("file_type") == "pdf") & is_scanned(F.col("pages")), F.lit(False)),
    })
    return docs.select(*others, "filename", "file_type", "raw_text", "pages", "page_count", "metadata", "error", "is_scanned")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all files under path, one row each, with doc_id from the path. Spark lists no empty files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    taken = listed.filter(F.col("length") <= MAX_BYTES)
    return read_bytes(taken.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content"))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """path and reason of files that are not taken; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return listed.withColumn("reason", reject_reason(F.col("path"), F.col("length"))).filter("reason is not null")


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def profiles_from_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with `profile` read from a JSON column; a text that is no profile gives null and an error."""
    parsed = df.withColumn("profile", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return parsed.withColumn("error", F.when(F.col(column).isNotNull() & F.col("profile").isNull(), "422 not a profile"))
