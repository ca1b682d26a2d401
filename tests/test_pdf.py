"""The reader of PDF files without a library: files are written here, object by object."""

import sys
import types
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import layout
from lumenfold.sources import files, pdf

FONT = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"


def stream(body, head=""):
    body = body if isinstance(body, bytes) else body.encode("latin-1")
    return f"<< {head} /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"


def deflated(body, head=""):
    return stream(zlib.compress(body if isinstance(body, bytes) else body.encode("latin-1")), f"/Filter /FlateDecode {head}")


def predicted(body, columns):
    """PNG rows: the first plain, the others as differences to the row above, and Paeth on the last."""
    rows = [body[i : i + columns].ljust(columns, b" ") for i in range(0, len(body), columns)]
    out, before = b"", bytes(columns)
    for n, row in enumerate(rows):
        kind = 0 if n == 0 else 4 if n == len(rows) - 1 else 2
        line = bytearray()
        for i, v in enumerate(row):
            left, up, corner = row[i - 1] if i else 0, before[i], before[i - 1] if i else 0
            guess = {0: 0, 2: up, 4: min((left, up, corner), key=lambda x: abs(left + up - corner - x))}[kind]
            line.append((v - guess) & 255)
        out += bytes([kind]) + bytes(line)
        before = row
    return out


def write(objects, trailer="trailer << /Root 1 0 R >>"):
    body = b"".join(f"{n} 0 obj\n".encode() + (o if isinstance(o, bytes) else o.encode("latin-1")) + b"\nendobj\n" for n, o in objects.items())
    return b"%PDF-1.7\n" + body + trailer.encode() + b"\n%%EOF"


def one_page(content, font=FONT, more=None, page=""):
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] /Resources << /Font << /F1 5 0 R >> /XObject << /X1 9 0 R >> >> >>",
               3: f"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] {page} >>", 4: content if isinstance(content, bytes) and b"stream" in content else deflated(content), 5: font}
    return write(objects | (more or {}))


def texts(data):
    return [[r[5] for r in runs] for _, runs in pdf.pages(data)]


def read(spark, *contents):
    rows = spark.createDataFrame([(i, f"{i}.pdf", c) for i, c in enumerate(contents)], "doc_id int, filename string, content binary")
    return [r for r in files.read_bytes(rows).orderBy("doc_id").collect()]


COLUMNS = "BT /F1 10 Tf " + " ".join(f"1 0 0 1 {x} {y} Tm ({t}) Tj" for x, y, t in (
    (350, 700, "right one"), (350, 688, "goes on"), (350, 640, "right two"), (40, 760, "A TITLE THAT SPANS ALL OF THE PAGE FROM THE LEFT TO THE RIGHT EDGE OF THE TWO COLUMNS OF IT"),
    (40, 700, "left one"), (40, 640, "left two"), (40, 628, "and its end"), (40, 60, "a footer that spans all of the page from the left to the right edge of the two columns of it"))) + " ET"
ORDERED = ["A TITLE THAT SPANS ALL OF THE PAGE FROM THE LEFT TO THE RIGHT EDGE OF THE TWO COLUMNS OF IT", "left one", "left two\nand its end", "right one\ngoes on", "right two", "a footer that spans all of the page from the left to the right edge of the two columns of it"]


def test_two_columns_come_in_reading_order(spark):
    row = read(spark, one_page(COLUMNS))[0]
    assert row.raw_text == "\n\n".join(ORDERED) and row.page_count == 1 and row.metadata == {"engine": "runs"} and row.error is None


def test_objects_in_predicted_object_streams(spark):
    inner = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R 7 0 R] /Count 2 >>", 3: "<< /Type /Page /MediaBox [0 0 600 800] /Contents 4 0 R /Resources 6 0 R >>", 5: FONT,
             6: "<< /Font << /F1 5 0 R >> >>", 7: "<< /Type /Page /MediaBox [0 0 600 800] /Contents 8 0 R /Resources 6 0 R >>"}
    head, body = "", ""
    for n, o in inner.items():
        head, body = head + f"{n} {len(body)} ", body + o + " "
    packed = stream(zlib.compress(predicted((head + body).encode(), 7)), f"/Type /ObjStm /N {len(inner)} /First {len(head)} /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>")
    xref = deflated(bytes(20), "/Type /XRef /Root 1 0 R /W [1 2 1]")
    data = write({4: deflated(COLUMNS), 8: stream("BT /F1 12 Tf 72 700 Td (Second page) Tj ET"), 10: packed, 11: xref}, "startxref 0")
    row = read(spark, data)[0]
    assert row.pages == ["\n\n".join(ORDERED), "Second page"] and row.page_count == 2


def test_encoded_fonts():
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0004> <D83DDE00> endbfchar 2 beginbfrange <0010> <0029> <0061> <0030> <0031> [<00660066> <00E9>] endbfrange"
    wide = "<< /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R /DescendantFonts [7 0 R] >>"
    data = one_page("BT /F1 10 Tf 50 700 Td <00100011000300120004> Tj <00300031> Tj ET", wide, {6: deflated(cmap), 7: "<< /DW 500 /W [16 [600 600] 18 20 700] >>"})
    assert texts(data) == [["ab c😀", "ffé"]]
    x0, _, x1, _, _, _ = pdf.pages(data)[0][1][0]
    assert (x0, round(x1 - x0, 6)) == (50, round(10 * (0.6 + 0.6 + 0.5 + 0.7 + 0.5), 6))
    simple = "<< /Subtype /Type1 /FirstChar 1 /Widths [500 500] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /uni20AC 5 /Scaron /fi /seven] >> >>"
    assert texts(one_page(rb"BT /F1 10 Tf 5 5 Td (\001\002\005\006\007 \223x\224) Tj ET", simple)) == [["é€Šﬁ7 “x”"]]
    assert texts(one_page(b"BT /F1 10 Tf 5 5 Td (\x8e) Tj ET", "<< /Subtype /TrueType /Encoding /MacRomanEncoding >>")) == [["é"]]


def test_strings_gaps_and_operators():
    assert texts(one_page(r"BT /F1 10 Tf 5 50 Td (a \(b\) \\ \101\n(nested)) Tj ET")) == [["a (b) \\ A\n(nested)"]]
    assert texts(one_page("BT /F1 10 Tf 5 50 Td [(Hel) -20 (lo) -300 (there) -3000 (far)] TJ ET")) == [["Hello there", "far"]]
    assert texts(one_page("BT /F1 10 Tf 12 TL 5 50 Td (one) Tj T* (two) Tj (three) ' 1 2 (four) \" 0 -12 TD (five) Tj ET")) == [["one", "two", "three", "four", "five"]]
    image = b"q BI /W 2 /H 2 ID \x00(\xff)> EI Q BT /F1 10 Tf 5 5 Td (after) Tj ET"
    assert texts(one_page(image)) == [["after"]]
    assert texts(one_page("BT /F1 10 Tf (no place) Tj 1 Tm Td ET BT /F1 10 Tf /F1 Tf (kept) Tj ET")) == [["no place", "kept"]]


def test_matrices_forms_and_turned_pages():
    form = stream("BT /F1 10 Tf 10 20 Td (inside) Tj ET", "/Type /XObject /Subtype /Form /Matrix [2 0 0 2 0 0]")
    (_, runs), = pdf.pages(one_page("q 1 0 0 1 100 0 cm /X1 Do Q BT /F1 10 Tf 10 20 Td (outside) Tj ET", more={9: form}))
    assert [(r[5], r[0], round(r[3] - r[1], 6), r[4]) for r in runs] == [("inside", 120, 20, 20), ("outside", 10, 10, 10)]
    (width, runs), = pdf.pages(one_page("BT 0 1 -1 0 100 10 Tm /F1 10 Tf (up) Tj ET", page="/Rotate 90"))
    x0, y0, x1, y1, size, _ = runs[0]
    assert width == 800 and (round(x0, 6), round(y1, 6), size) == (10, 102, 10) and x1 > x0 and y1 - y0 == pytest.approx(10)
    loop = stream("/X1 Do BT /F1 10 Tf (again) Tj ET", "/Type /XObject /Subtype /Form")
    assert len(texts(one_page("/X1 Do", more={9: loop}))[0]) == pdf.MAX_FORMS


def test_later_definitions_win_and_bad_files_raise(spark):
    data = one_page("BT /F1 10 Tf 5 5 Td (old) Tj ET") + b"\n4 0 obj\n" + deflated("BT /F1 10 Tf 5 5 Td (new) Tj ET") + b"\nendobj\n"
    assert texts(data) == [["new"]]
    wrong = stream("BT /F1 10 Tf 5 5 Td (right) Tj ET").replace(b"/Length ", b"/Length 9")
    assert texts(one_page(wrong)) == [["right"]]
    assert texts(one_page(stream("425420 2F4631 203130 2054 66 20 2868 69 29 20 54 6A 20 45 54>", "/Filter /AHx"))) == [["hi"]]
    rows = read(spark, b"%PDF nothing", write({1: "<< /Pages 2 0 R >>"}, "trailer << /Root 1 0 R /Encrypt 3 0 R >>"), one_page(stream("x", "/Filter /JBIG2Decode")), one_page(""), b"")
    assert [bool(r.error) for r in rows] == [True, True, True, False, True] and "encrypted" in rows[1].error and rows[3].pages == [""] and rows[3].is_scanned


def test_lines_from_runs(spark):
    run = lambda x, y, t, size=10.0: (float(x), y - 0.8 * size, x + 5.0 * len(t), y + 0.2 * size, size, t)
    page = [run(60, 100.5, "two"), run(40, 100, "one"), run(300, 100, "far"), run(40, 112, "next line"), run(40, 180, "apart"), run(40, 192, "SMALL", 5.0)]
    kind = "runs array<struct<x0:double,y0:double,x1:double,y1:double,size:double,text:string>>"
    df = spark.createDataFrame([(page,), ([],)], kind)
    found = df.select(F.transform(layout.text_lines(F.col("runs")), lambda l: l["text"]).alias("l"), layout.text_blocks(F.col("runs"), F.lit(600)).alias("b")).collect()
    assert found[0].l == ["one two", "far", "next line", "apart", "SMALL"] and [b.text for b in found[0].b] == ["one two\nnext line", "far", "apart", "SMALL"]
    assert found[1].l == [] and found[1].b == [] and [b.block_no for b in found[0].b] == [0, 1, 2, 3]


def test_library_pages(monkeypatch):
    """Blocks come sorted by place; a page without text blocks gives its plain text."""

    class Fake:
        rect = types.SimpleNamespace(width=600.0)

        def __init__(self, blocks):
            self.blocks = blocks

        def get_text(self, kind, sort=False):
            return "plain" if kind == "text" else sorted(self.blocks, key=lambda b: (b[1], b[0])) if sort else self.blocks

    class Doc(list):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    pages = Doc([Fake([(0, 50, 9, 60, "lower", 0, 0), (0, 10, 9, 20, "upper", 1, 0), (0, 0, 9, 9, "image", 2, 1)]), Fake([(0, 0, 9, 9, " ", 0, 0)])])
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: pages))
    blocks, runs, engine = files.pdf_pages(b"")
    assert [[b["text"] for b in p] for p in blocks] == [["upper", "lower"], ["plain"]] and runs is None and engine == "library"


def test_long_pages_cost_their_length():
    """Codes are looked up once for each page, not once for each glyph."""
    shown = "".join(f"{ord(c):04X}" for c in "same few letters " * 40)
    content = "BT /F1 6 Tf " + "".join(f"1 0 0 1 40 {20 * i} Tm <{shown}> Tj " for i in range(20)) + "ET"
    cmap = "begincmap 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"
    body = "".join(f"{n} 0 obj {o} endobj " for n, o in {
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        5: "<< /Subtype /Type0 /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>", 6: "<< /DW 400 >>",
        4: f"<< /Length {len(content)} >> stream\n{content}\nendstream", 7: f"<< /Length {len(cmap)} >> stream\n{cmap}\nendstream",
    }.items())
    looked, get = [], pdf.UnicodeMap.get
    pdf.UnicodeMap.get = lambda self, code: looked.append(code) or get(self, code)
    try:
        [(_, runs)] = pdf.pages(f"%PDF-1.5 {body} trailer << /Root 1 0 R >>".encode())
    finally:
        pdf.UnicodeMap.get = get
    assert [r[5] for r in runs] == ["same few letters " * 40] * 20
    assert len(looked) == len(set("same few letters "))


def test_blocks_of_a_long_page(spark):
    """Blocks far above a line are put aside; each holds its two lines."""
    n = 300
    runs = "transform(sequence(0, 2 * n - 1), i -> named_struct('x0', 40D, 'y0', 10D * i + 20D * (i div 2), 'x1', 200D, 'y1', 10D * i + 20D * (i div 2) + 9D, 'size', 9D, 'text', concat('l', i)))"
    df = spark.range(1).selectExpr(f"{n} n").selectExpr(f"{runs} runs")
    [row] = df.select(layout.text_blocks(F.col("runs"), F.lit(600)).alias("b")).collect()
    assert [b.text for b in row.b] == [f"l{2 * i}\nl{2 * i + 1}" for i in range(n)]
