"""The data source of whole files and the JSON sink with commits."""

import pickle
import threading
import tracemalloc

import pytest
from pyspark.sql import functions as F

from lumenfold.plans import registry
from lumenfold.sources import commits, documents
from lumenfold.sources.shared import Store

from .test_packets_and_files import docx


def test_documents_by_path(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    root = tmp_path / "in"
    (root / "a.txt").write_bytes("Zoë".encode())
    (root / "sub" / "b.TXT").write_bytes("Zoë".encode("latin-1"))
    (root / "c.docx").write_bytes(docx(["One", "Two"], [["x", "y"]]))
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "empty.txt").write_bytes(b"")
    (root / "n.exe").write_bytes(b"MZ")
    (root / "_hidden.txt").write_text("no")
    (root / "noname").write_text("x")
    rows = {r.filename: r for r in documents.read(spark, f"file://{root}").collect()}
    assert set(rows) == {"a.txt", "b.TXT", "c.docx", "bad.docx", "empty.txt", "n.exe", "noname"}
    assert rows["a.txt"].raw_text == rows["b.TXT"].raw_text == "Zoë" and rows["c.docx"].raw_text == "One\nTwo\n\nx | y" and rows["empty.txt"].raw_text == ""
    assert rows["bad.docx"].error.startswith("422") and rows["n.exe"].error.startswith("415") and rows["noname"].error.startswith("415")
    assert {r.filename: r.size for r in documents.listed(spark, f"file://{root}").collect()}["a.txt"] == 4


def test_filters_reach_the_listing(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.{'txt' if i % 2 else 'docx'}").write_bytes(b"x" * i)
    reader = documents.DocumentReader(f"file://{tmp_path}", ["path"], 100)
    left = list(reader.pushFilters([documents.ds.EqualTo(("file_type",), "txt"), documents.ds.GreaterThan(("size",), 1), documents.ds.IsNotNull(("size",)), documents.ds.EqualTo(("error",), "x")]))
    assert [f.attribute for f in left] == [("error",)]
    assert [[x[1] for x in p.listed] for p in reader.partitions()] == [["3.txt", "5.txt"]]
    got = documents.listed(spark, f"file://{tmp_path}").filter((F.col("file_type") == "txt") & (F.col("size") > 1))
    assert sorted(r.filename for r in got.collect()) == ["3.txt", "5.txt"]
    assert "Filter" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_by_bytes_and_large_or_missing_files(tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * 10)
    monkeypatch.setattr(documents, "PARTITION_BYTES", 20)
    reader = documents.DocumentReader(f"file://{tmp_path}", ["filename", "content", "error"], 100)
    parts = reader.partitions()
    assert [len(p.listed) for p in parts] == [2, 2, 1]
    (tmp_path / "0.txt").unlink()
    rows = [r for b in reader.read(parts[0]) for r in b.to_pylist()]
    assert [r["content"] for r in rows] == [None, b"x" * 10] and rows[0]["error"].startswith("404")
    reader.max_bytes = 9
    assert {r["error"] for b in reader.read(parts[1]) for r in b.to_pylist()} == {"413 file too large"}
    names = documents.DocumentReader(f"file://{tmp_path}", ["filename"], 100)
    assert [c for b in names.read(parts[0]) for c in b.schema.names] == ["filename"]


def test_written_files(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.range(20).select(F.concat("id", F.lit(".txt")).alias("filename"), F.concat(F.lit("text "), "id").cast("binary").alias("content"))
    documents.write(rows, path)
    assert sorted(r.raw_text for r in documents.read(spark, path).collect()) == sorted(f"text {i}" for i in range(20))
    documents.write(rows.limit(3), path, "overwrite")
    assert documents.listed(spark, path).count() == 3
    broken = rows.withColumn("filename", F.when(F.col("filename") == "7.txt", F.lit("no/such/folder.txt")).otherwise(F.col("filename")))
    with pytest.raises(Exception):
        documents.write(broken, path)
    assert documents.listed(spark, path).count() == 3


def test_listing_is_small_on_the_driver(tmp_path):
    """Few bytes a file in the partitions, and while listing no more than the files of one folder."""
    for d in range(6):
        (tmp_path / f"task-{d}").mkdir()
        for i in range(1000):
            (tmp_path / f"task-{d}" / f"{d}{i}.txt").touch()

    def listed(path):
        tracemalloc.start()
        parts = documents.DocumentReader(f"file://{path}", ["path"], 100).partitions()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return parts, peak

    listed(tmp_path / "task-0")
    one, all_six = listed(tmp_path / "task-0")[1], listed(tmp_path)
    assert sum(len(p.listed) for p in all_six[0]) == 6000 and sum(len(pickle.dumps(p)) for p in all_six[0]) < 20 * 6000
    assert all_six[1] < 3 * one


def test_listing_by_path(tmp_path):
    names = ["a.txt", "a-b.txt", "a/x.txt", "a/b/y.PDF", "a/b.txt", "ab", "_h/x.txt", "a/.h/x.txt", ".x"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("abc")
    parts = documents.DocumentReader(f"file://{tmp_path}", ["path"], 100).partitions()
    seen = [f"{tmp_path}/{n}" for n in sorted(names) if "/." not in f"/{n}" and "_" not in n]
    assert [x[0] for p in parts for x in p.listed] == seen and len(seen) == 6
    assert (f"{tmp_path}/a/b/y.PDF", "y.PDF", "pdf", 3) in parts[0].listed


def test_files_pass_in_tasks_only(spark, tmp_path, monkeypatch):
    """No process beside the driver plans or commits, as it would for the format `documents`."""
    monkeypatch.setattr(documents, "register", lambda spark: pytest.fail("the format was used"))
    path = f"file://{tmp_path}/out"
    rows = spark.range(20).select(F.concat("id", F.lit(".txt")).alias("filename"), F.concat(F.lit("text "), "id").cast("binary").alias("content"))
    documents.write(rows, path)
    documents.write(rows.limit(3), path)  # appends
    found = documents.read(spark, path)
    assert "BatchScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.raw_text for r in found.collect()) == sorted(f"text {i}" for i in [*range(20), 0, 1, 2])
    with pytest.raises(Exception):
        documents.write(rows.withColumn("filename", F.when(F.col("filename") == "7.txt", F.lit("no/such/folder.txt")).otherwise(F.col("filename"))), path)
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")] and documents.read(spark, path).count() == 23
    documents.write(spark.createDataFrame([], "filename string, content binary"), path, "overwrite")
    assert documents.read(spark, path).count() == 0
    with pytest.raises(ValueError):
        documents.write(rows, path, "ignore")


def test_format_writes(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    documents.register(spark)
    rows = spark.range(20).select(F.concat("id", F.lit(".txt")).alias("filename"), F.col("id").cast("string").cast("binary").alias("content"))
    rows.write.format("documents").mode("append").save(path)
    got = lambda: sorted(bytes(r.content).decode() for r in spark.read.format("documents").load(path).collect())
    assert got() == sorted(map(str, range(20)))
    rows.limit(3).write.format("documents").mode("overwrite").save(path)
    assert got() == ["0", "1", "2"]
    with pytest.raises(Exception):
        rows.withColumn("filename", F.concat(F.lit("no/such/"), "filename")).write.format("documents").mode("overwrite").save(path)
    assert got() == ["0", "1", "2"] and not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


SCHEMA = "k long, v string, part string"


def table(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_reruns_replace_their_partitions_only(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    assert commits.read(spark, path, SCHEMA).count() == 0
    commits.write(table(spark, (1, "a", "x"), (2, None, "y"), (3, "c", None)), path, "part")
    assert commits.write(table(spark, (1, "A", "x"), (4, "d", "z")), path, "part") == 2
    got = lambda v=None: sorted(map(tuple, commits.read(spark, path, SCHEMA, v).collect()), key=str)
    assert got() == [(1, "A", "x"), (2, None, "y"), (3, "c", None), (4, "d", "z")]
    assert got(1) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]
    # a run that wrote data but no version changes nothing
    table(spark, (9, "q", "x")).write.partitionBy("part").json(f"{path}/data/lost")
    assert got() == [(1, "A", "x"), (2, None, "y"), (3, "c", None), (4, "d", "z")]


def test_concurrent_runs_both_stand(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    runs = [threading.Thread(target=commits.write, args=(table(spark, (i, str(i), f"p{i}")), path, "part")) for i in range(4)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert sorted(r.k for r in commits.read(spark, path, SCHEMA).collect()) == [0, 1, 2, 3] and commits.versions(spark, path) == [1, 2, 3, 4]
    with pytest.raises(Exception):
        Store(spark, path).create(f"{path}/manifest/000000001.json", "{}")


def test_tables_of_one_row_group_are_dealt_out(spark, tmp_path):
    """Such a file is cut into as many partitions as there are cores, of which one has all rows."""
    spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        table = spark.read.parquet(str(tmp_path / "t"))
        per_task = lambda df: [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert table.rdd.getNumPartitions() > 4 and per_task(table) == [2000]
        assert max(per_task(registry.spread(table))) < 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
