"""Packets, page layout and files."""

import io
import zipfile
import zlib

from pyspark.sql import functions as F

from lumenfold.operators import layout, segment
from lumenfold.plans import pipeline
from lumenfold.sources import files
from lumenfold.streaming import ingest

COVER = "Dear Hiring Manager,\nI am writing to express my interest.\nSincerely, Kim"
CV = "Kim Lee\nWORK EXPERIENCE\nEngineer 2019 - 2022\nEDUCATION\nDiploma"


def packet(spark, *pages):
    return spark.createDataFrame([(1, list(pages), "\n\n".join(pages))], "doc_id long, pages array<string>, raw_text string")


def test_packet(spark):
    r = pipeline.split(packet(spark, COVER, CV, CV, "")).first()
    assert [(s.category, s.start_page, s.end_page, s.confidence) for s in r.segments] == [("cover_letter", 1, 1, 0.88), ("resume", 2, 3, 0.88), ("other", 4, 4, 0.88)]
    assert r.is_packet and r.primary_category == "resume" and r.primary_text == CV + "\n\n" + CV and r.engine == "heuristic_boundary"


def test_single_page(spark):
    r = pipeline.split(packet(spark, COVER)).first()
    assert not r.is_packet and r.primary_category == "cover_letter" and r.primary_text == COVER and r.segments[0].confidence == 0.95 and r.engine == "direct_single_page"


def test_external_cuts_win_and_are_clipped(spark):
    cuts = spark.createDataFrame([(1, [("RESUME", 2, 9, None, "cv")])], "doc_id long, cuts array<struct<category:string,start_page:int,end_page:int,confidence:double,title:string>>")
    r = pipeline.split(packet(spark, COVER, CV), cuts).first()
    assert r.engine == "external" and r.primary_text == CV and r.segments[0].category == "resume" and r.segments[0].confidence == 0.95


def test_page_labels(spark):
    pages = ["Official  transcript", "What we offer: fruit", "a.b@example.com +1 415 555 0199", "a.b@example.com only", None, "projects"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, page string")
    from pyspark.sql import functions as F

    assert [r[1] for r in rows.select("i", segment.page_category(F.col("page"))).orderBy("i").collect()] == ["transcripts", "job_description", "resume", "other", "other", "resume"]


def test_two_columns(spark):
    cols = "doc_id long, page int, page_width double, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int"
    rows = [
        (1, 1, 600.0, 1, 20.0, 10.0, 580.0, 30.0, " Name ", 0), (1, 1, 600.0, 2, 320.0, 50.0, 580.0, 60.0, "R1", 0), (1, 1, 600.0, 3, 20.0, 55.0, 200.0, 65.0, "L1", 0),
        (1, 1, 600.0, 4, 20.0, 90.0, 200.0, 99.0, "L2", 0), (1, 1, 600.0, 5, 320.0, 80.0, 580.0, 95.0, "R2", 0), (1, 1, 600.0, 6, 20.0, 300.0, 580.0, 310.0, "foot", 0), (1, 1, 600.0, 7, 0.0, 0.0, 1.0, 1.0, "image", 1),
        (1, 2, 600.0, 1, 20.0, 90.0, 580.0, 99.0, "first", 0), (1, 2, 600.0, 2, 20.0, 10.0, 580.0, 20.0, "second", 0),
    ]
    found = {r.page: r.text for r in layout.page_text(spark.createDataFrame(rows, cols)).collect()}
    assert found == {1: "Name\n\nL1\n\nL2\n\nR1\n\nR2\n\nfoot", 2: "first\n\nsecond"}


def docx(paragraphs, table):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    body = "".join(map(p, paragraphs)) + (f"<w:tbl>{rows}</w:tbl>" if table else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(*pages):
    objects = []
    for i, text in enumerate(pages):
        stream = zlib.compress(f"BT /F1 12 Tf 72 700 Td ({text}) Tj ET".encode("latin-1"))
        objects.append(f"{10 + 2 * i} 0 obj << /Type /Page /Contents {11 + 2 * i} 0 R >> endobj\n".encode())
        objects.append(f"{11 + 2 * i} 0 obj << /Length {len(stream)} /Filter /FlateDecode >>\nstream\n".encode() + stream + b"\nendstream\nendobj\n")
    return b"%PDF-1.4\n" + b"".join(objects) + b"%%EOF"


def test_files(spark, tmp_path):
    long = "A page with enough words in it that nobody would take it for a scan"
    (tmp_path / "a.txt").write_bytes("Zoë".encode())
    (tmp_path / "b.TXT").write_bytes("Zoë".encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(docx(["One", " ", "Two"], [["x", "", "y"]]))
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "e.pdf").write_bytes(pdf(long, r"Second \(2\)"))
    (tmp_path / "f.pdf").write_bytes(pdf("x"))
    (tmp_path / "g.pdf").write_bytes(b"%PDF broken")
    (tmp_path / "h.exe").write_bytes(b"MZ")
    rows = {r.filename: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].raw_text == rows["b.TXT"].raw_text == "Zoë" and rows["a.txt"].page_count == 1
    assert rows["c.docx"].raw_text == "One\nTwo\n\nx | y" and rows["d.docx"].error.startswith("422 ")
    assert rows["e.pdf"].pages == [long, "Second (2)"] and rows["e.pdf"].page_count == 2 and not rows["e.pdf"].is_scanned
    assert rows["f.pdf"].is_scanned and rows["g.pdf"].error.startswith("422 ") and rows["h.exe"].error == "415 unsupported file type"
    assert [r.reason for r in files.rejected_files(spark, str(tmp_path)).collect()] == ["415 unsupported file type"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"Ada King\nSkills: Python\nk{i}@example.com")
    ingest.run_profiles(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.profile.contact.email for r in rows) == ["k0@example.com", "k1@example.com", "k2@example.com"] and {r.profile.contact.name for r in rows} == {"Ada King"}


def test_json_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = pipeline.parse(spark.createDataFrame([(1, CV)], "doc_id long, raw_text string")).select("doc_id", "profile")
    shape = rows.schema["profile"].dataType.simpleString()
    text = rows.select("doc_id", F.to_json("profile").alias("j")).unionByName(spark.createDataFrame([(2, "nonsense")], "doc_id long, j string"))
    back = {r.doc_id: r for r in files.profiles_from_json(text, "j", shape).collect()}
    assert back[1].profile.contact.name == "Kim Lee" and back[1].error is None
    files.write_json(rows, str(tmp_path / "json"))
    assert spark.read.schema(f"doc_id long, profile {shape}").json(str(tmp_path / "json")).first().profile.contact.name == "Kim Lee"


def test_blocks_are_put_into_reading_order(spark):
    """As the columns of a page come from a PDF library."""
    rows = [(20, 30, 250, 42, "left two"), (320, 10, 580, 22, "right one"), (30, 0, 570, 8, "title"), (20, 10, 250, 22, "left one"), (320, 30, 580, 42, "right two"), (0, 0, 9, 9, " ")]
    page = [{"block_no": i, "page_width": 600.0, "x0": float(a), "y0": float(b), "x1": float(c), "y1": float(d), "text": t} for i, (a, b, c, d, t) in enumerate(rows)]
    kind = "doc_id long, blocks array<array<struct<block_no:int,page_width:double,x0:double,y0:double,x1:double,y1:double,text:string>>>"
    found = spark.createDataFrame([(1, [page, []])], kind).select(F.transform("blocks", layout.page_order).alias("p")).first().p
    assert found == ["title\n\nleft one\n\nleft two\n\nright one\n\nright two", ""]
