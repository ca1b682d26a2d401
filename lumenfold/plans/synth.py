"""Deterministic inputs made from the driver tables by SQL that Spark and DuckDB read alike.

The tables hold no résumés, so queries compose them here: only integer arithmetic, CASE and
concatenation are used, and ~ stands for an apostrophe until the end. Awkward cases are on purpose:
ligatures, composed and decomposed accents, no-break spaces, CRLF, bullets, missing sections,
open-ended dates, headers with text on their line, names to reject.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import JOBS

NL = "\n"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "~") + "'"


def pick(expr: str, options: list[str]) -> str:
    """The option whose number is expr modulo their count; {k} in an option is the key."""
    cases = " ".join(f"WHEN {i} THEN {_parts(o)}" for i, o in enumerate(options))
    return f"(CASE ({expr}) % {len(options)} {cases} END)"


def _parts(option: str) -> str:
    bits = []
    for i, piece in enumerate(option.split("{k}")):
        if i:
            bits.append("CAST(k AS STRING)")
        bits.append(_quoted(piece))
    return "(" + " || ".join(bits) + ")"


NAMES = ["Jane Miller", "Dr. José Müller", "RESUME", "Kavya N. Rao", "contact information", "john", "Anna-Lena O'Brien", "Page 1 of 2", "Wei Zhang Li Chen Xu", "Łukasz Nowak", "Prof.  Ada King", "José Álvarez"]
TITLES = ["Senior Backend Engineer", "Data Scientist", "Full Stack Developer", "Mary Poe", ""]
CONTACTS = ["Email: user{k}@mail.example.com | Phone: +49 30 1234567", "dev.{k}@ex-ample.org (415) 555-0199", "Tel 12", "WhatsApp: 0049 171 5550 123" + NL + "me_{k}@site.io", "reach me at 12345678", ""]
LINKS = ["linkedin.com/in/user-{k} github.com/dev{k}", "https://www.GitHub.com/dev_{k}", "portfolio.example.com", ""]
PLACES = ["City: Berlin, Germany", "Address: 12 Main St | Paris", "Springfield, IL 62704", "Stanford University, California", "Based in San Jose, Costa Rica", ""]
LONG = "Engineer who has built and run many large data systems for banks shops and public bodies over years"
SUMMARIES = ["PROFESSIONAL SUMMARY" + NL + LONG, "Summary: builds eﬃcient services", "## About me ##" + NL + "I like plain\ttools.", LONG, "Resumen Profesional" + NL + "Datos y nubes", ""]
EXPERIENCE = ["WORK EXPERIENCE", "Experience:", "01 | [ Employment History ]", "Berufserfahrung", "Professional Background -- ", ""]
FIRST_JOBS = ["Senior Engineer | Acme Corp | Jan 2018 - Present", "Developer at Globex (2015 to 2019)", "Lead - Initech - 03/2012 – 2016", "2010 - 2014 Analyst", "Q1 2019 — Current | Intern", "Consultant, no dates"]
POINTS = ["• Built APIs with Python and FastAPI" + NL + "• Cut costs by 20%", "- Ran Kubernetes and Docker" + NL + "plain line" + NL + "* Wrote Go services", "● Trained models in PyTorch", ""]
SECOND_JOBS = ["Engineer at Site Works 2001 - 2006", "Clerk | Shop | 1998 until 2003", "Tester - Lab - May 2005 – Now", ""]
SKILL_LINES = ["TECHNICAL SKILLS" + NL + "Python, Django, PostgreSQL, Redis, REST APIs, C++, R&D", "Skills: TypeScript, React.js, Next.js, Tailwind, rest api", "Kenntnisse" + NL + "Terraform, AWS, k8s, CI/CD, Scikit-Learn", "Tech Stack | Go; Kafka; gRPC; .NET; ASP.NET", "* Key Skills *" + NL + "Excel", ""]
SCHOOLING = ["EDUCATION" + NL + "Stanford University | B.S. in Computer Science | 2014", "Education: Master of Science - MIT 2010", "Formation" + NL + "MBA | Harvard Business School | 2009" + NL + "Ph.D. 2015", "ACADEMIC BACKGROUND" + NL + "Bachelor's of Arts - City College - 1999", "Ausbildung" + NL + "Technische Schule", "Education" + NL + "Diploma 2003", ""]
PROJECTS = ["PROJECTS" + NL + "Search engine for maps and trails that works offline on small devices" + NL + "- detail" + NL + "Tiny" + NL + "Compiler toy", "Proyectos" + NL + "One project" + NL + "Two project" + NL + "Three project" + NL + "Four project" + NL + "Five project" + NL + "Six project", ""]
CERTS = ["CERTIFICATIONS" + NL + "- AWS Solutions Architect" + NL + "• CKA" + NL + "abc", "Credentials" + NL + "* A1 cert" + NL + "* B2 cert" + NL + "* C3 cert" + NL + "* D4 cert" + NL + "* E5 cert" + NL + "* F6 cert" + NL + "* G7 cert", ""]

_LINES = [
    ("k", NAMES), ("k * 7 + 1", TITLES), ("k + k / 6", CONTACTS), ("k / 3", LINKS), ("k / 2", PLACES), ("k / 5", SUMMARIES), ("k + k / 7", EXPERIENCE), ("k / 4", FIRST_JOBS),
    ("k / 11", POINTS), ("k * 3 + k / 13", SECOND_JOBS), ("k / 9", POINTS), ("k + k / 17", SKILL_LINES), ("k * 5 + k / 19", SCHOOLING), ("k / 8", PROJECTS), ("k + k / 23", CERTS),
]


def _resume(lines: list[tuple[str, list[str]]]) -> str:
    """Integer division is written as a difference, so that both engines agree."""

    def whole(expr: str) -> str:
        out = []
        for term in expr.split(" + "):
            if " / " in term:
                n = term.split(" / ")[1]
                term = f"CAST((k - k % {n}) / {n} AS BIGINT)"
            out.append(term)
        return " + ".join(out)

    ends = f"(CASE k % 3 WHEN 0 THEN {_quoted(NL)} WHEN 1 THEN {_quoted(NL + NL + NL + NL)} ELSE {_quoted(chr(13) + NL)} END)"
    return f" || {ends} || ".join(pick(whole(e), o) for e, o in lines)


RESUMES = f"SELECT k AS doc_id, replace({_resume(_LINES)}, '~', chr(39)) AS raw_text FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) AS c"

_EXTRA = {
    "phd": "Position: Research Lead\nPh.D. required. 10+ years with Spark, Kafka and Hadoop.",
    "master": "Role: Data Engineer\nMaster degree or MBA. 5 yrs of SQL, Airflow and dbt.",
    "blank": "  ",
    "plain": "Looking for a kind colleague.",
}
JOB_ROWS = [(i + 1, key, text) for i, (key, text) in enumerate((JOBS | _EXTRA).items())]
JOB_TABLE = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS job_id, '{key}' AS title, replace({_quoted(text)}, '~', chr(39)) AS jd_text" for i, key, text in JOB_ROWS)

PAGE_TEXTS = [
    "Dear Hiring Manager, ", "WORK EXPERIENCE and Education ", "Official Transcript ", "We are looking for ", "Projects ", "Contact a.b@example.com +1 415 555 0199 ", "", "Sincerely, ", "Education ",
]
PAGES = f"SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS BIGINT) AS page_no, {pick('k', PAGE_TEXTS)} || text AS page FROM (SELECT *, CAST(conv_id * 5 + turn * turn - turn % 2 AS BIGINT) AS k FROM conversations) AS c"

BLOCKS = """
SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CAST(l_suppkey % 2 AS INT) AS page, CAST(600 AS DOUBLE) AS page_width, CAST(l_linenumber AS INT) AS block_no,
       CAST(CASE l_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 320 WHEN 2 THEN 30 ELSE 200 END AS DOUBLE) AS x0,
       CAST(l_quantity * 10 AS DOUBLE) AS y0,
       CAST(CASE l_partkey % 4 WHEN 0 THEN 250 WHEN 1 THEN 580 WHEN 2 THEN 570 ELSE 300 END AS DOUBLE) AS x1,
       CAST(l_quantity * 10 + 12 AS DOUBLE) AS y1,
       CASE WHEN l_partkey % 17 = 0 THEN '  ' ELSE ' block ' || CAST(l_linenumber AS STRING) || ' ' END AS text,
       CAST(CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE 0 END AS INT) AS block_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

#: Packets of which every third holds little more than its page numbers, as scans do.
SCANS = f"SELECT doc_id, page_no, CASE doc_id % 3 WHEN 0 THEN {pick('doc_id + page_no', [' 1 ', 'Page 2 of 3', '', 'scan'])} ELSE page END AS page FROM ({PAGES})"

#: What an external model might have said about the pages of every second packet: one range, two, or none.
CUTS = """
SELECT DISTINCT CAST(conv_id AS BIGINT) AS doc_id, CAST(1 + conv_id % 2 AS INT) AS first_end, CAST(conv_id % 3 AS INT) AS n_cuts
FROM conversations WHERE conv_id % 2 = 0
"""

#: Lists that an external model might give for every second candidate.
LISTS = """
SELECT k AS doc_id, 'Role ' || CAST(k AS STRING) AS role, CASE k % 4 WHEN 0 THEN 'Outside School' ELSE '' END AS school
FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) AS c WHERE k % 2 = 0
"""

#: Names as bytes, of which every second is written in Latin-1.
BYTES = f"SELECT k AS doc_id, replace({pick('k', [n for n in NAMES if n.encode('latin-1', 'ignore').decode('latin-1') == n])}, '~', chr(39)) AS name FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) AS c"

FILES = """
SELECT CAST(p_partkey AS BIGINT) AS doc_id,
       CASE p_partkey % 6 WHEN 0 THEN 'cv' || CAST(p_partkey AS STRING) || '.PDF' WHEN 1 THEN 'cv.docx' WHEN 2 THEN 'note.txt' WHEN 3 THEN 'run.exe' WHEN 4 THEN '' ELSE 'old.doc' END AS filename,
       CAST(p_size AS BIGINT) * 400000 AS size
FROM part
"""

#: What an external model might have said about two thirds of the candidates.
EXTERNAL = """
SELECT k AS doc_id,
       CASE k % 4 WHEN 0 THEN 'Full Name' WHEN 1 THEN 'Alex Reed' WHEN 2 THEN '' ELSE 'candidate' END AS name,
       CASE k % 5 WHEN 0 THEN 'USER' || CAST(k AS STRING) || '@mail.example.com' WHEN 1 THEN 'made.up@nowhere.org' ELSE '' END AS email,
       CASE k % 3 WHEN 0 THEN '+1-555-9999' ELSE '' END AS phone,
       CASE k % 4 WHEN 0 THEN 'python|AsyncIO|KAFKA' WHEN 1 THEN ' Rust |rust|Go' ELSE '' END AS skills,
       CAST(CASE k % 5 WHEN 2 THEN 7 ELSE 0 END AS DOUBLE) AS years
FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) AS c WHERE k % 3 <> 1
"""


#: Replies of three providers about candidates: whole profiles, parts of them, other JSON, and no JSON.
REPLIES = """
SELECT k AS doc_id, 'alpha' AS provider, CASE k % 5 WHEN 0 THEN '{\"contact\":{\"name\":\"Alpha ' || CAST(k AS STRING) || '\"},\"total_experience_years\":3}'
  WHEN 1 THEN '{\"contact\":{\"phone\":\"+1-555-1' || CAST(k AS STRING) || '\"}}' WHEN 2 THEN 'Sorry, I can not help with that.' WHEN 3 THEN '[1, 2]' ELSE '{\"note\":\"nothing\"}' END AS reply
FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) AS c
UNION ALL
SELECT k, 'beta', CASE k % 3 WHEN 0 THEN '{\"contact\":{\"name\":\"Candidate\",\"phone\":\"+1-555-2' || CAST(k AS STRING) || '\",\"location\":\"Bonn\"},\"total_experience_years\":8}'
  WHEN 1 THEN '{\"contact\":{\"name\":\"Beta ' || CAST(k AS STRING) || '\"}' ELSE '{\"contact\":{\"name\":\"Beta ' || CAST(k AS STRING) || '\"}}' END
FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) AS c WHERE k % 7 <> 0
UNION ALL
SELECT k, 'gamma', '{\"contact\":{\"name\":\"Gamma\",\"location\":\"Graz\"}}' FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) AS c WHERE k % 4 = 0
"""
PROVIDERS = ["alpha", "beta"]

#: Job posts composed from parts, a post for each.
POST_SKILLS = ["Python, Django and PostgreSQL", "React.js, Next.js and TypeScript", "Kubernetes, Docker and Terraform", "PyTorch, Spark and SQL", "", "Go, gRPC or Rust", "Excel and R"]
POST_YEARS = ["5+ years", "2 years of practice", "some years", "10+ yrs", ""]
POST_DEGREES = ["Master degree or MBA.", "Ph.D. wanted.", "Any degree.", ""]
POSTS = f"""SELECT k AS job_id, 'post' AS title, replace('Position: ' || p_type || {_quoted(NL)} || {pick('k', POST_SKILLS)} || '. ' || {pick('CAST((k - k % 7) / 7 AS BIGINT)', POST_YEARS)} || ' ' || {pick('CAST((k - k % 5) / 5 AS BIGINT)', POST_DEGREES)}, '~', chr(39)) AS jd_text
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, p_type FROM part) AS p"""


def pdf_file(text: Column, columns: Column, packed: Column) -> Column:
    """Bytes of a PDF file of one page that shows a text in pieces of 60 characters, in one column or two (of eight pieces or more), whose right one is drawn first.

    The font's codes have their meaning from a ToUnicode map only. packed: the page and the fonts stand in an object stream.
    """
    pieces = F.regexp_extract_all(F.regexp_replace(text, "[\n\t\r]", " "), F.lit("(?s).{1,60}"), F.lit(0))
    # the pieces and what draws them are computed once, however often the file names them
    return T.let(pieces, lambda ps: T.let(_drawn(ps, columns), lambda body: _pdf_parts(ps, columns, packed, body))).cast("binary")


def _half(n: Column, columns: Column) -> Column:
    return F.when((columns == 2) & (n >= 8), F.ceil(n / 2)).otherwise(n)  # two columns have two blocks each, as the reading order asks


def _height(n: Column, columns: Column) -> Column:
    return (100 + 12 * _half(n, columns)).cast("int")


def _drawn(pieces: Column, columns: Column) -> Column:
    """The content stream that shows the pieces."""
    half = lambda n: _half(n, columns)
    row = lambda i, n: i % F.greatest(half(n), F.lit(1))
    right = lambda i, n: i >= half(n)

    def shown(p: Column, i: Column, n: Column) -> Column:
        x, y = F.when(right(i, n), 330).otherwise(40), _height(n, columns) - 40 - 8 * row(i, n) - 10 * F.floor(row(i, n) / 3)
        return F.concat(F.lit("1 0 0 1 "), x.cast("string"), F.lit(" "), y.cast("int").cast("string"), F.lit(" Tm <"), F.hex(F.encode(p, "UTF-16BE")), F.lit("> Tj\n"))

    ops = lambda side: F.array_join(F.transform(pieces, lambda p, i: F.when(right(i, F.size(pieces)) == side, shown(p, i, F.size(pieces))).otherwise("")), "")
    return F.concat(F.lit("BT /F1 6 Tf\n"), ops(F.lit(True)), ops(F.lit(False)), F.lit("ET"))


def _pdf_parts(pieces: Column, columns: Column, packed: Column, drawn: Column) -> Column:
    cmap = "begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"
    objects = {
        1: F.lit("<< /Type /Catalog /Pages 2 0 R >>"), 2: F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 >>"),
        3: F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> /MediaBox [0 0 612 "), _height(F.size(pieces), columns).cast("string"), F.lit("] >>")),
        5: F.lit("<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>"), 6: F.lit("<< /Type /Font /DW 400 >>"),
    }
    stream = lambda n, head, body: F.concat(F.lit(f"{n} 0 obj << {head} /Length "), F.octet_length(body).cast("string"), F.lit(" >>\nstream\n"), body, F.lit("\nendstream\nendobj\n"))
    plain = F.concat(*[x for n, o in objects.items() for x in (F.lit(f"{n} 0 obj "), o, F.lit("\nendobj\n"))])
    bodies, offsets, at = F.concat_ws(" ", *objects.values()), [], F.lit(0)
    for n, o in objects.items():
        offsets.append(F.concat(F.lit(f"{n} "), at.cast("string"), F.lit(" ")))
        at = at + F.octet_length(o) + 1
    head = F.concat(*offsets)
    inside = F.concat(F.lit("8 0 obj << /Type /ObjStm /N 5 /First "), F.length(head).cast("string"), F.lit(" /Length "), (F.length(head) + F.length(bodies)).cast("string"), F.lit(" >>\nstream\n"), head, bodies, F.lit("\nendstream\nendobj\n"))
    return F.concat(F.lit("%PDF-1.5\n"), F.when(packed, inside).otherwise(plain), stream(4, "", drawn), stream(7, "", F.lit(cmap)), F.lit("trailer << /Root 1 0 R >>\n%%EOF"))


#: Texts that XML can't hold, or would change.
NO_XML = r"[\x00-\x08\x0b-\x1f\ufffe\uffff]"


def docx_files(rows: DataFrame) -> DataFrame:
    """rows with `content`: Word files with a paragraph for each line of `text` and a table of one row, `cells`."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def paragraph(text: str) -> str:
        return f"<w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for text, cells in zip(b.column("text").to_pylist(), b.column("cells").to_pylist()):
                row = "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in cells)
                body = "".join(map(paragraph, text.split("\n"))) + f"<w:tbl><w:tr>{row}</w:tr></w:tbl>"
                with zipfile.ZipFile(file := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
                files.append(file.getvalue())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(files, pa.binary())], [*b.schema.names, "content"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", content binary")


def document_files(docs: DataFrame) -> DataFrame:
    """A file (filename, content) for each of documents with a text: TXT in UTF-8 or Latin-1, DOCX, broken DOCX, PDF, or a kind that isn't taken."""
    k, text = F.col("doc_id") % 16, F.col("text")
    rows = docs.filter("text is not null").select("doc_id", "text", F.array("lang", "source").alias("cells"), (~F.regexp_like(text, F.lit(NO_XML)) & ~F.exists(F.array("lang", "source"), lambda c: c.isNull())).alias("xml"))
    kind = F.when((k % 4 == 2) & F.col("xml"), "docx").when(k == 3, "broken").when(k == 7, "exe").when(k % 4 == 3, "pdf").when((k % 4 == 1) & ~F.regexp_like(text, F.lit(r"[^\x00-\xff]")), "latin").otherwise("txt")
    rows = rows.withColumn("kind", kind)
    name = lambda suffix: F.concat("doc_id", F.lit(f".{suffix}")).alias("filename")
    of = lambda kind, suffix, content: rows.filter(F.col("kind") == kind).select(name(suffix), content.alias("content"))
    out = docx_files(rows.filter("kind = 'docx'").select("doc_id", "text", "cells")).select(name("docx"), "content")
    for part in (
        of("txt", "txt", text.cast("binary")), of("latin", "TXT", F.encode(text, "ISO-8859-1")), of("broken", "docx", F.lit(b"no archive")), of("exe", "exe", F.lit(b"MZ")),
        of("pdf", "pdf", pdf_file(text, F.lit(2), F.col("doc_id") % 8 == 3)),
    ):
        out = out.unionByName(part)
    return out
