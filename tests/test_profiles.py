"""Profiles and scores of hand-made résumés, with the values worked out by hand."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions.lexicon import JOBS
from lumenfold.operators import extract, reconcile, sections
from lumenfold.plans import pipeline

RESUME = """
Ines Falk
Email: ines.falk@post.example | Phone: +49 40 5550 123 | Location: Hamburg, Germany
LinkedIn: linkedin.com/in/inesfalk | GitHub: github.com/ifalk

SUMMARY
Writes the parts of ticket shops that nobody sees.

SKILLS
Go, Java, Kafka, Docker, Redis

EXPERIENCE
Platform Developer | Nordbahn | 2024 - Present
- Moved the seat plan to a log of events.

Junior Developer | Elbe Software | 2023 - 2024
- Kept the timetable service alive.

EDUCATION
M.S. in Physics | Hamburg University | 2022
"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, raw_text string")


@pytest.fixture(scope="module")
def reports(spark):
    jobs = spark.createDataFrame([(1, JOBS["backend"]), (2, " "), (3, None)], "job_id long, jd_text string")
    rows = pipeline.analyze(docs(spark, RESUME, "", None), jobs).select("doc_id", "job_id", "profile", "report").collect()
    return {(r.doc_id, r.job_id): r for r in rows}


def test_profile(reports):
    p = reports[1, 1].profile
    assert p.contact.asDict() == {
        "name": "Ines Falk", "email": "ines.falk@post.example", "phone": "+49 40 5550 123", "location": "Hamburg, Germany",
        "linkedin": "linkedin.com/in/inesfalk", "github": "github.com/ifalk", "portfolio": None,
    }
    assert p.skills == ["Docker", "GitHub", "Go", "Java", "Kafka", "Redis"]  # the link names one as well
    assert p.total_experience_years == 3.0  # 2026 - 2023
    assert [(e.role, e.company, e.start_date, e.end_date) for e in p.experience] == [("Platform Developer", "Nordbahn", "2024", "Present"), ("Junior Developer", "Elbe Software", "2023", "2024")]
    assert p.education[0].degree == "M.S" and p.education[0].institution == "Hamburg University"


def test_score(reports):
    """Eleven skills are asked for (Spring Boot names two), of which five are there: 45.45, and 6 times 0.5. Three of five years: 60 % of 85. 0.4 * 48.5 + 0.35 * 51 + 0.15 * 95 + 10 = 61.5."""
    r = reports[1, 1].report
    c = r.categories
    assert (c.technical_skills.score, c.experience.score, c.education.score, c.quality.score) == (48.5, 51.0, 95.0, 100.0)
    assert (r.overall_score, r.match_level, r.missing_skills) == (61.5, "Potential Match", ["AWS", "Kubernetes", "PostgreSQL", "Spring", "Spring Boot", "Terraform"])


def test_blank_job_is_neutral(reports):
    for job in (2, 3):
        assert reports[1, job].report.overall_score == 50.0 and reports[1, job].report.match_level == "Neutral"


def test_empty_documents(reports):
    for doc in (2, 3):
        p = reports[doc, 1].profile
        assert p.skills == [] and p.contact.name is None and p.total_experience_years is None and p.primary_domain is None


def test_cleaning(spark):
    raw = "  a\tb  c \r\n•x\rﬁn\n\n\n\n\n\nend é"
    assert docs(spark, raw).select(T.clean(F.col("raw_text"))).first()[0] == "a b c\n\n- x\nfin\n\n\nend é"
    assert len(docs(spark, "x" * 60_000).select(T.clean(F.col("raw_text"))).first()[0]) == 50_000


def test_composed_form_of_every_kind(spark):
    texts = ["e\u0301", "\u00e9 fine", "\u1100\u1161\u11a8", "\u212b", "\u0958", "a\u0323\u0307", "a\u0307\u0323", "\ud55c\uae00", "\u0915\u093c", "\u09c7\u09be", "plain", "\u1112\u1161", "\uac00\u11a8"]
    found = docs(spark, *texts).select("doc_id", T.nfc(F.col("raw_text")).alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in found] == [unicodedata.normalize("NFC", t) for t in texts]


def sectioned(spark, text):
    return sections.normalise(docs(spark, text)).first().sections


def test_headers(spark):
    s = sectioned(spark, "01 | PROFESSIONAL EXPERIENCE\nlead\n[ TECHNICAL SKILLS ]\nPython\nFORMATION ACADÉMIQUE\nParis")
    assert s == {"experience": "lead", "skills": "Python", "education": "ACADÉMIQUE\nParis"}
    s = sectioned(spark, "Experience: built tools\nmore\nSkills: Go\nExperience with Kubernetes\nSkills --\nRust")
    assert s == {"experience": "built tools\nmore\n\nwith Kubernetes", "skills": "Go\n\nRust"}
    assert sectioned(spark, "Where I've worked: Initech for years")["experience"] == "Initech for years"
    assert sectioned(spark, "no header here at all, only one long line of words that says nothing of note") == {}


def test_dates_and_roles(spark):
    text = "Tom R. Vale\nWORK EXPERIENCE\nLead | FinCo | Q1 2019 - Present\n* did it\nplain\nDeveloper at Startup Labs (Jan 2016 - Dec 2018)\nTester - Shop - 2001 until 2001"
    p = pipeline.parse(docs(spark, text)).first().profile
    assert [(e.role, e.company, e.duration, e.highlights) for e in p.experience] == [("Lead", "FinCo", "7 years", ["did it"]), ("Developer", "Startup Labs (", "2 years", []), ("Tester", "Shop", "1 years", [])]
    assert p.total_experience_years == 25.0


def test_contact_quirks(spark):
    c = docs(spark, "José Müller\nWhatsApp: +49 30 12345678\nCity: Berlin, Germany").select(extract.contact(F.col("raw_text")).alias("c")).first().c
    assert (c.name, c.phone, c.location) == ("José Müller", "+49 30 12345678", "Berlin, Germany")
    c = docs(spark, "Łukasz Nowak\nEmail Address: a@b.co\ncall 12345").select(extract.contact(F.col("raw_text")).alias("c")).first().c
    assert (c.name, c.phone, c.location) == (None, None, "a@b.co")


def test_skill_tokens(spark):
    found = lambda t: docs(spark, t).select(extract.all_skills(extract.categorised(F.col("raw_text")))).first()[0]
    assert found("R&D and react.js, asp.net") == ["Asp.Net", "R", "React", "React.js"]
    assert found("javascripty goes pythonic") == [] and found("C++/C# REST API") == ["C#", "C++", "REST APIs"]


def test_degrees(spark):
    rows = docs(spark, "x").select(extract.education(F.lit("bachelor's of Arts - City College - 1999\nHarvard Business School | MBA | 2009\nTrade school")).alias("e")).first().e
    assert [(e.institution, e.degree, e.graduation_year) for e in rows] == [("bachelor's of Arts", "Bachelor'S", "1999"), ("Harvard Business School", "Mba", "2009"), ("Trade school", "Degree / Certificate", None)]


def test_lists_are_bounded(spark):
    lines = "\n".join(f"Project number {i}" for i in range(9))
    s = docs(spark, "x").select(extract.projects(F.lit(lines)).alias("p"), extract.certifications(F.lit("- abc\n" + "\n".join(f"* cert {i}" for i in range(9)))).alias("c")).first()
    assert [p.name for p in s.p] == [f"Project number {i}" for i in range(5)] and [c.name for c in s.c] == [f"cert {i}" for i in range(6)]


def test_reconcile(spark):
    base = pipeline.parse(docs(spark, RESUME))
    shape = base.schema["profile"].dataType
    ext = {f.name: None for f in shape} | {
        "contact": dict.fromkeys([f.name for f in shape["contact"].dataType]) | {"name": "Full Name", "email": "made@up.org", "phone": "+1-555-9999"},
        "skills": ["java", "AsyncIO", " "], "total_experience_years": 4.0, "experience": [], "education": [], "projects": [], "certifications": [], "extraction_mode": "llm", "categorized_skills": {"Languages": ["java"], "Other": ["AsyncIO"]},
    }
    external = spark.createDataFrame([(1, ext)], base.select("doc_id", "profile").schema)
    p = reconcile.reconcile(base, external).first().profile
    assert (p.contact.name, p.contact.email, p.contact.phone) == ("Ines Falk", "ines.falk@post.example", "+1-555-9999")
    assert p.total_experience_years == 4.0 and p.extraction_mode == "hybrid" and len(p.experience) == 2
    assert "AsyncIO" in p.skills and "java" in p.skills and "Java" not in p.skills
    assert p.categorized_skills["Languages"] == ["java", "Go"] and p.categorized_skills["Other"] == ["AsyncIO"]


def test_skills_in_one_pass(spark):
    """As one pattern for each skill finds them: names within longer names, at ends of tokens, in all order."""
    import random
    import re

    from lumenfold.functions import lexicon as X
    from lumenfold.operators import score

    names = [s for group in X.SKILLS.values() for s in group]
    r = random.Random(5)
    texts = ["", "ASP.NET and .net", *["".join(r.choice(names) + r.choice([" ", ", ", ".", ".js", "+", "x", "", "/", "é"]) for _ in range(r.randint(1, 12))) for _ in range(300)]]
    rows = docs(spark, *texts).select("raw_text", extract.all_skills(extract.categorised(F.col("raw_text"))).alias("s")).collect()
    stands = lambda t, s, before: re.search(rf"(?<![\w#+{before}]){re.escape(s)}(?![\w#+])", t.lower())
    assert all(row.s == sorted(X.display(s) for s in names if stands(row.raw_text, s, ".")) for row in rows)
    asked = score.with_requirements(docs(spark, *texts), "raw_text").select("raw_text", "asks.skills").collect()
    assert all(row.skills == [s for s in names if stands(row.raw_text.strip(), s, "")] for row in asked)


def test_patterns_that_are_cheap_to_evaluate(spark):
    """What is done again for each value stays small: patterns are ASCII, and unread texts of categories are left out of the plan."""
    assert T.rx("é–[ſ]").isascii() and spark.range(1).select(T.matches(F.lit("aſ"), "[ſ]$")).first()[0]
    assert T.trie({"skills", "skill", "skim"}, any_case=False) == "ski(?:ll(?:s)?|m)"
    jobs = spark.createDataFrame([(1, JOBS["backend"])], "job_id long, jd_text string")
    total = pipeline.analyze(docs(spark, RESUME), jobs).select("doc_id", "report.overall_score")
    plan = total._jdf.queryExecution().optimizedPlan().toString()
    assert "Candidate has" not in plan and "Candidate holds" not in plan


def test_a_name_is_made_bare_once(spark):
    """What a line holds without its honorific is computed once a line, however many tests read it."""
    found = docs(spark, "Dr. José Müller").select(extract.name(F.array("raw_text")).alias("name"))
    assert found.first().name == "José Müller"
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Prof") == 1


def test_patterns_search_once(spark):
    """A pattern is in the plan once, wherever it stands; lines of a clean text are not stripped again by patterns."""
    found = docs(spark, "call me: +49 30 12345678").select(extract.contact(F.col("raw_text")).alias("c"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first().c.phone == "+49 30 12345678" and plan.count("WhatsApp") == 1 and plan.count("linkedin\\.com") == 1 and "^\\s+|" not in plan


def test_strip_as_by_pattern(spark):
    import re

    texts = [a + b + c for a in ["", *T.SPACES, " \t\u2003\n"] for b in ("", "x", "é y\u3000z", "\u200b") for c in ("", "\r\n", "\u2028", *T.SPACES)]
    rows = docs(spark, *texts).select("raw_text", T.strip(F.col("raw_text")).alias("s"), F.regexp_replace("raw_text", T.rx(r"^\s+|\s+$"), "").alias("p"), T.words(F.col("raw_text")).alias("w")).collect()
    assert all(r.s == r.p and r.w == [w for w in re.split(f"[{T.SPACES}]+", r.raw_text) if w] for r in rows)


def test_quick_looks_pass_all_names(spark):
    """What is looked at before a search lets every name pass, in any case and with any space."""
    import re

    plain = {n for names in sections.SECTIONS.values() for p in names for n in sections._plain(p)}
    quick = T.ahead(plain, 4)
    assert all(re.match(quick, form.replace(" ", " \t")) for n in plain for form in (n, n.upper(), n.title(), n.replace("s", "ſ"), n.replace("k", "\u212a")))
    assert not re.match(quick, "zebra") and all(re.match(extract._SCHOOLS, s) for s in extract.X.SCHOOLS)
    whole = [n for names in sections._exact()[1].values() for n in names]
    rows = docs(spark, *plain).select("raw_text", sections.header(F.col("raw_text")).alias("h")).collect()
    assert "skills" in whole and "experience & achievements" not in whole and all(r.h is not None for r in rows)


def test_dates_by_every_month(spark):
    months = ["Jan", "February", "Mar", "april", "MAY", "Jun", "July", "Aug", "ſep", "September", "Oct", "Nov", "December", "Q3", "7", "03"]
    rows = docs(spark, *[f"Clerk | {m} 2001 - {m} 2003" for m in months]).select(extract.jobs(F.col("raw_text")).alias("j")).collect()
    assert [(len(r.j), r.j[0].job.role, r.j[0].job.start, r.j[0].job.end) for r in rows] == [(1, "Clerk", 2001, 2003)] * len(months)
