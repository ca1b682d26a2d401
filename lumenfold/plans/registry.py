"""Named queries of the engine and their SQL equivalents.

Results are flat: lists become text joined by |, so that two engines can be compared row by row.
Queries over résumés read the texts composed in `synth`; `norm_basic`, `email_documents` read the
table `documents` as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import lexicon
from ..functions.lexicon import MAX_CHARS
from ..operators import dictionary, extract, headings, layout, packets as paged, rank as ranking, reconcile, score as rubric, sections, segment
from ..sources import commits, documents
from ..sources.files import decode_text, profiles_from_json, read_bytes, reject_reason, suffix
from ..sources.shared import shared_folder
from . import oracle, pipeline, synth

CATEGORIES = ("technical_skills", "experience", "education", "quality")


def composed(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread over the cluster before the texts are composed: the table behind it may be one file."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    keys.repartition(n, "c_custkey").createOrReplaceTempView("customer")
    return spark.sql(synth.RESUMES)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out before heavy work on them. The number of partitions tells nothing: a file of one row group is cut into many, of which one has all rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(4 * n, df.rdd.getNumPartitions()))


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.normalise(resumes(spark, sf_dir))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.parse(resumes(spark, sf_dir))


def jobs(spark: SparkSession) -> DataFrame:
    return spark.sql(synth.JOB_TABLE)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.score(profiles(spark, sf_dir), jobs(spark))


def packets(spark: SparkSession, sf_dir: str, sql: str = synth.PAGES) -> DataFrame:
    """A packet is one row by definition, so its pages come together in one task."""
    rows = composed(spark, sf_dir, sql, "conversations")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page"))), lambda p: p["page"])
    return rows.groupBy("doc_id").agg(pages.alias("pages")).withColumn("raw_text", F.array_join("pages", "\n\n"))


def shape_of(kind: str) -> StructType:
    return StructType.fromDDL("x " + kind)["x"].dataType


def bars(c: Column) -> Column:
    return F.array_join(c, "|")


def numbered(df: DataFrame, column: str | Column, *fields: str) -> DataFrame:
    """A row for each element of a column, numbered from 1.

    The outer form: before a plain explode Spark would test the array's size, and so compute it twice.
    """
    rows = df.select("doc_id", F.posexplode_outer(column).alias("i", "e")).filter("i is not null")
    return rows.select("doc_id", (F.col("i") + 1).cast("int").alias("seq"), *[F.col(f"e.{f}").alias(f) for f in fields])


def _norm(docs: DataFrame, column: str, max_chars: int | None = MAX_CHARS) -> DataFrame:
    t = T.clean(F.col(column), max_chars)
    return docs.select("doc_id", t.alias("clean_text")).select("doc_id", "clean_text", F.size(T.words(F.col("clean_text"))).alias("word_count"), F.length("clean_text").alias("char_count"))


def norm_basic(spark, d):
    """Whole documents: the cut at MAX_CHARS is a rule for résumés."""
    return _norm(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")), "text", None)


def norm_resumes(spark, d):
    return _norm(resumes(spark, d), "raw_text")


def section_lines(spark, d):
    heads = F.explode_outer(F.filter(F.transform(F.split(T.clean(F.col("raw_text")), "\n"), lambda l: sections.header(l)), lambda h: h.isNotNull()))
    rows = resumes(spark, d).select("doc_id", heads.alias("h")).filter("h is not null")
    return rows.groupBy("doc_id", F.col("h.section").alias("section")).agg(F.count("*").alias("n_headers"), F.count("h.tail").alias("n_inline"))


def section_assemble(spark, d):
    return normal(spark, d).select("doc_id", F.explode_outer("sections").alias("section", "content")).filter("section is not null")


def _cleaned(spark, d):
    return resumes(spark, d).select("doc_id", T.clean(F.col("raw_text")).alias("t"))


def heading_rows(spark, d):
    """The lines with a heading, by the fixed headings as a table."""
    return headings.find(_cleaned(spark, d), "doc_id", F.col("t"), headings.fixed(spark))


def section_table(spark, d):
    """The sections of `section_assemble`, by the fixed headings as a table."""
    return headings.contents(_cleaned(spark, d), "doc_id", F.col("t"), headings.fixed(spark))


def heading_documents(spark, d):
    """Short first lines of documents are headings of their source; where they stand in all documents, those of smaller ids first."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    first = T.strip(F.substring_index("text", "\n", 1))
    names = docs.select(first.alias("name"), F.col("source").alias("section"), F.col("doc_id").alias("rank")).filter(F.length("name") <= 60)
    return headings.find(spread(docs.select("doc_id", "text")), "doc_id", F.col("text"), spread(names))


def contact_query(*fields: str):
    def run(spark, d):
        text = resumes(spark, d).select("doc_id", T.clean(F.col("raw_text")).alias("t"))
        return text.select("doc_id", extract.contact(F.col("t")).alias("c")).select("doc_id", *[f"c.{f}" for f in fields])

    return run


def email_documents(spark, d):
    from ..functions.lexicon import EMAIL

    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.found(F.col("text"), EMAIL).alias("email"))


def _skills(spark, d):
    return resumes(spark, d).select("doc_id", extract.categorised(T.clean(F.col("raw_text"))).alias("by"))


def skills_flat(spark, d):
    return _skills(spark, d).select("doc_id", bars(extract.all_skills(F.col("by"))).alias("skills"))


def skills_by_category(spark, d):
    rows = _skills(spark, d).select("doc_id", F.explode_outer("by").alias("category", "s")).filter("category is not null")
    return rows.select("doc_id", "category", bars(F.col("s")).alias("skills"))


def skill_frequency(spark, d):
    return _skills(spark, d).select(F.explode_outer(extract.all_skills(F.col("by"))).alias("skill")).filter("skill is not null").groupBy("skill").agg(F.count("*").alias("n_docs"))


def domain(spark, d):
    return _skills(spark, d).select("doc_id", extract.domain(extract.all_skills(F.col("by"))).alias("primary_domain"))


def exp_rows(spark, d):
    return numbered(profiles(spark, d), "profile.experience", "role", "company", "start_date", "end_date", "duration")


def exp_highlights(spark, d):
    rows = numbered(profiles(spark, d), "profile.experience", "highlights")
    return rows.filter(F.size("highlights") > 0).withColumn("highlights", bars(F.col("highlights")))


def exp_total(spark, d):
    return profiles(spark, d).select("doc_id", "profile.total_experience_years")


def edu_rows(spark, d):
    return numbered(profiles(spark, d), "profile.education", "institution", "degree", "graduation_year")


def projects_top5(spark, d):
    return numbered(profiles(spark, d), "profile.projects", "name")


def certs_top6(spark, d):
    return numbered(profiles(spark, d), "profile.certifications", "name")


def summary(spark, d):
    return profiles(spark, d).select("doc_id", "profile.summary")


def jd_skills(spark, d):
    """What the job posts composed from the parts ask for."""
    posts = spread(composed(spark, d, synth.POSTS, "part"))
    asks = F.col("asks")
    return rubric.with_requirements(posts).select("job_id", bars(F.array_sort(asks["skills"])).alias("skills"), asks["years"].alias("required_years"), bars(asks["title"]).alias("title_words"), asks["phd"].alias("phd"), asks["master"].alias("master"))


def skills_table(spark, d):
    """skills_flat with the taxonomy as a table that is joined."""
    rows = [(s, lexicon.display(s)) for names in lexicon.SKILLS.values() for s in names]
    names = spark.createDataFrame(rows, "name string, shown string")
    texts = resumes(spark, d).select("doc_id", T.clean(F.col("raw_text")).alias("clean_text"))
    hits = dictionary.find(texts, "doc_id", F.col("clean_text"), names).groupBy("doc_id").agg(F.sort_array(F.collect_set("shown")).alias("s"))
    return texts.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce(bars(F.col("s")), F.lit("")).alias("skills"))


def dictionary_hits(spark, d):
    """Which of the benchmark's pairs of neighbouring words stand in each document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+ \p{L}+)"), F.lit(1))
    names = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(words).alias("name")).distinct()
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    return dictionary.find(docs, "doc_id", F.col("text"), names).groupBy("doc_id").agg(F.count("*").alias("n_names"), F.md5(F.array_join(F.sort_array(F.collect_list("name")), "|")).alias("names_md5"))


def provider_priority(spark, d):
    """Profiles with the replies of two of three providers, some of them malformed."""
    merged = reconcile.merge_providers(profiles(spark, d), composed(spark, d, synth.REPLIES, "customer"), synth.PROVIDERS)
    c = F.col("profile.contact")
    return merged.select("doc_id", c["name"].alias("name"), c["phone"].alias("phone"), c["location"].alias("location"), "profile.total_experience_years", bars(F.col("providers")).alias("providers"), "profile.extraction_mode")


def provider_errors(spark, d):
    """Replies that are no profiles."""
    return reconcile.parse_replies(composed(spark, d, synth.REPLIES, "customer")).filter("error is not null").groupBy("provider", "error").agg(F.count("*").alias("n_replies"), F.min("doc_id").alias("first_doc"))


def layer_metrics(spark, d):
    """Figures of the layers of one analysis, gathered while it is written."""
    metrics = pipeline.Metrics()
    found = pipeline.watched(resumes(spark, d), jobs(spark), metrics)
    found.select("doc_id", "job_id", F.col("report.overall_score").alias("overall_score")).write.parquet(shared_folder(spark, "analysis"))
    return metrics.report(spark).drop("seconds")


def _with_jobs(spark, d):
    """Reports on descriptions that are not blank, with whether they ask for skills."""
    asks = rubric.with_requirements(jobs(spark)).select("job_id", F.size("asks.skills").alias("n_asked"), F.col("asks.blank").alias("blank"))
    return reports(spark, d).join(F.broadcast(asks), "job_id").filter("not blank")  # one row for each job


def skill_match(spark, d):
    r = _with_jobs(spark, d).filter("n_asked > 0")
    return r.select("doc_id", "job_id", bars(F.col("report.matched_skills")).alias("matched"), bars(F.col("report.missing_skills")).alias("missing"))


def skill_missing(spark, d):
    return _with_jobs(spark, d).select("job_id", F.explode("report.missing_skills").alias("skill")).groupBy("job_id", "skill").agg(F.count("*").alias("n_docs"))


def category_score(category: str):
    return lambda spark, d: _with_jobs(spark, d).select("doc_id", "job_id", F.col(f"report.categories.{category}.score").alias("score"))


def report_field(field: str):
    return lambda spark, d: reports(spark, d).select("doc_id", "job_id", f"report.{field}")


def report_list(field: str):
    return lambda spark, d: _with_jobs(spark, d).select("doc_id", "job_id", bars(F.col(f"report.{field}")).alias(field))


def candidate_job_rank(spark, d):
    """The ten best candidates of each job (an extension of the one-to-one rubric)."""
    return ranking.best_candidates(profiles(spark, d), jobs(spark)).select("job_id", "doc_id", "overall_score", "rank")


def page_classify(spark, d):
    pages = packets(spark, d).select("doc_id", F.posexplode("pages").alias("i", "page"))
    return pages.select("doc_id", (F.col("i") + 1).cast("int").alias("page_no"), segment.page_category(F.col("page")).alias("category"))


def _split(spark, d):
    return pipeline.split(packets(spark, d))


def packet_merge(spark, d):
    return numbered(_split(spark, d), "segments", "category", "start_page", "end_page", "confidence").withColumnRenamed("seq", "seg_no")


def packet_primary(spark, d):
    return _split(spark, d).select("doc_id", "is_packet", "primary_category", F.md5("primary_text").alias("primary_md5"))


def segment_preview(spark, d):
    return pipeline.segment_rows(_split(spark, d)).select("doc_id", F.col("seg_no").cast("int").alias("seg_no"), "category", "preview")


def block_layout(spark, d):
    return layout.page_text(composed(spark, d, synth.BLOCKS, "lineitem", "orders"))


def scanned_flag(spark, d):
    return packets(spark, d, synth.SCANS).select("doc_id", segment.is_scanned(F.col("pages")).alias("is_scanned"))


def ext_gate(spark, d):
    return composed(spark, d, synth.FILES, "part").select("doc_id", "filename", reject_reason(F.col("filename"), F.col("size")).alias("reject_reason"))


def _external(spark, d):
    """The composed external profiles in the full shape of a profile."""
    flat = composed(spark, d, synth.EXTERNAL, "customer")
    text = F.lit(None).cast("string")
    none = lambda kind: F.array().cast(kind)
    contact = F.struct("name", "email", "phone", *[text.alias(f) for f in ("location", "linkedin", "github", "portfolio")])
    shape = shape_of(reconcile.PROFILE)
    profile = F.struct(
        contact.alias("contact"), text.alias("summary"), F.col("years").alias("total_experience_years"), text.alias("primary_domain"), F.split("skills", r"\|").alias("skills"),
        F.when(F.col("skills") != "", F.create_map(F.lit("Languages"), F.split("skills", r"\|"))).alias("categorized_skills"), *[none(shape[f].dataType).alias(f) for f in ("experience", "education", "projects", "certifications")], text.alias("raw_text_preview"), F.lit("llm").alias("extraction_mode"),
    )
    return flat.select("doc_id", profile.alias("profile"))


def _hybrid(spark, d):
    return reconcile.reconcile(profiles(spark, d), _external(spark, d))


def reconcile_scalar(spark, d):
    return _hybrid(spark, d).select("doc_id", "profile.contact.name", "profile.contact.email", "profile.contact.phone", "profile.total_experience_years", "profile.extraction_mode")


def reconcile_skills(spark, d):
    return _hybrid(spark, d).select("doc_id", bars(F.col("profile.skills")).alias("skills"))


def reconcile_categories(spark, d):
    rows = _hybrid(spark, d).select("doc_id", F.explode("profile.categorized_skills").alias("category", "s"))
    return rows.select("doc_id", "category", bars(F.col("s")).alias("skills"))


def prompt_budget(spark, d):
    """How much of each text an external model may read."""
    return reconcile.inference_input(normal(spark, d)).select("doc_id", F.length("prompt_text").alias("n_chars"))


def page_preview(spark, d):
    rows = packets(spark, d).select("doc_id", F.posexplode(segment.previews(F.col("pages"))).alias("i", "preview"))
    return rows.select("doc_id", (F.col("i") + 1).cast("int").alias("page_no"), "preview")


def score_band(spark, d):
    """Initials and band of the rounded score of each report, as a result page shows them."""
    score, name = F.col("report.overall_score"), F.coalesce(F.col("profile.contact.name"), F.lit("Candidate Profile"))
    whole = F.floor(score + 0.5)
    band = F.when(whole >= 75, "high").when(whole >= 50, "mid").otherwise("low")
    initials = F.substring(F.upper(F.array_join(F.transform(T.words(name), lambda w: F.substring(w, 1, 1)), "")), 1, 2)
    return reports(spark, d).select("doc_id", "job_id", initials.alias("initials"), band.alias("band"))


def widened(kind: StructType, key: str) -> Callable[[Column], Column]:
    """A struct with one field as a struct of that kind, whose other fields are null."""
    return lambda x: F.struct(*[(x[key] if n == key else F.lit(None).cast(kind[n].dataType)).alias(n) for n in kind.names])


def reconcile_lists(spark, d):
    """Lists of an external model stand in for those of the rules where they hold anything."""
    flat = composed(spark, d, synth.LISTS, "customer")
    shape = F.lit(None).cast(reconcile.PROFILE)
    one = lambda **fields: F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))
    job = one(role=F.col("role"))
    school = F.when(F.col("school") != "", one(institution=F.col("school")))
    lists = {"experience": ("role", job), "education": ("institution", school)}
    kind = shape_of(reconcile.PROFILE)
    filled = []
    for f in kind.names:
        if f not in lists:
            filled.append(shape.getField(f).alias(f))
            continue
        key, value = lists[f]
        inner = kind[f].dataType.elementType
        filled.append(F.transform(value, widened(inner, key)).alias(f))
    ext = flat.select("doc_id", F.struct(*filled).alias("profile"))
    p = F.col("profile")
    got = lambda f, key: F.array_join(F.transform(p[f], lambda x: x[key]), "|")
    return reconcile.reconcile(profiles(spark, d), ext).select("doc_id", got("experience", "role").alias("roles"), got("education", "institution").alias("schools"))


def packet_external(spark, d):
    """Segments and engine where an external model gave page ranges for some packets."""
    flat = composed(spark, d, synth.CUTS, "conversations")
    cut = lambda category, start, end: F.struct(F.lit(category).alias("category"), start.alias("start_page"), end.alias("end_page"), F.lit(None).cast("double").alias("confidence"), F.lit("t").alias("title"))
    one, two = cut("Resume", F.lit(1), F.col("first_end")), cut(None, F.col("first_end") + 1, F.lit(None).cast("int"))
    cuts = F.when(F.col("n_cuts") == 1, F.array(one)).when(F.col("n_cuts") == 2, F.array(one, two)).otherwise(F.slice(F.array(one), 1, 0))
    found = pipeline.split(packets(spark, d), flat.select("doc_id", cuts.alias("cuts")))
    rows = found.select("doc_id", "engine", "is_packet", F.posexplode("segments").alias("i", "s"))
    return rows.select("doc_id", "engine", "is_packet", (F.col("i") + 1).alias("seg_no"), "s.category", "s.start_page", "s.end_page", "s.confidence", F.md5("s.text").alias("text_md5"))


def pdf_text(spark, d):
    """Documents as PDF files, in one column or two, whose pages and fonts stand plainly or in object streams, read back."""
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).filter("text is not null")
    content = synth.pdf_file(F.col("text"), F.col("doc_id") % 2 + 1, F.col("doc_id") % 4 >= 2)
    back = read_bytes(docs.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"), content.alias("content")))
    shown = F.regexp_replace("raw_text", SHOWN, "")
    return back.select("doc_id", "page_count", F.length(shown).alias("n_shown"), F.md5(shown).alias("shown_md5"), "error")


SHOWN = r"[^\x21-\x7E\u00A1-\uFFFF]+"


def files_by_path(spark, d):
    """Documents written as files of several kinds, some of them broken, by the data source's writer; listed and read back by path."""
    path = shared_folder(spark, "files")
    documents.write(synth.document_files(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source"))), path)
    back = documents.read(spark, path)
    shown = F.regexp_replace("raw_text", SHOWN, "")
    return back.select(F.regexp_extract("filename", r"^(-?\d+)", 1).cast("long").alias("doc_id"), "file_type", "page_count", F.length(shown).alias("n_shown"), F.md5(shown).alias("shown_md5"), F.left("error", F.lit(3)).alias("error"))


def json_commits(spark, d):
    """Documents written as JSON by language; a second run replaces one language; read back through the last version."""
    path = shared_folder(spark, "commits")
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source"))
    commits.write(docs, path, "lang")
    commits.write(docs.filter("lang = 'en'").withColumns({"text": F.upper("source"), "source": F.lit(None).cast("string")}), path, "lang")
    back = commits.read(spark, path, "doc_id long, text string, source string, lang string")
    return back.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


def packet_rows(spark, d):
    """packet_external on pages as rows, whatever the number of pages of a packet."""
    pages = spread(composed(spark, d, synth.PAGES, "conversations"))
    flat = composed(spark, d, synth.CUTS, "conversations").filter("n_cuts > 0")
    one = F.struct(F.lit("Resume").alias("category"), F.lit(1).alias("start_page"), F.col("first_end").alias("end_page"))
    two = F.struct(F.lit(None).cast("string").alias("category"), (F.col("first_end") + 1).alias("start_page"), F.lit(None).cast("int").alias("end_page"))
    cuts = flat.select("doc_id", F.posexplode(F.slice(F.array(one, two), F.lit(1), F.col("n_cuts"))).alias("cut_no", "c")).select("doc_id", "cut_no", "c.*")
    found = paged.split(pages, cuts)
    texts = paged.texts(paged.segment_pages(pages, cuts)).withColumn("text_md5", F.md5("text"))
    out = found.join(texts.select("doc_id", "seg_no", "text_md5"), ["doc_id", "seg_no"], "left")
    return out.select("doc_id", "engine", "is_packet", "seg_no", "category", "start_page", "end_page", "confidence", F.coalesce("text_md5", F.md5(F.lit(""))).alias("text_md5"))


def text_decode(spark, d):
    """Bytes of text files, valid UTF-8 or not."""
    rows = composed(spark, d, synth.BYTES, "customer")
    data = F.when(F.col("doc_id") % 2 == 0, F.encode("name", "ISO-8859-1")).otherwise(F.encode("name", "UTF-8"))
    return rows.select("doc_id", decode_text(data).alias("text"))


def json_roundtrip(spark, d):
    """Profiles to JSON and back by their schema."""
    rows = profile_json(spark, d)
    back = profiles_from_json(rows.withColumnRenamed("profile", "json"), "json", reconcile.PROFILE)
    return back.select("doc_id", "profile.contact.name", "profile.contact.email", "profile.total_experience_years", bars(F.col("profile.skills")).alias("skills"), "error")


def profile_core(spark, d):
    """What an assembled profile holds, as one flat row."""
    p = F.col("profile")
    return profiles(spark, d).select(
        "doc_id", "profile.contact.name", "profile.contact.email", "profile.total_experience_years", "profile.primary_domain", bars(p["skills"]).alias("skills"),
        *[F.size(p[f]).alias(f"n_{f}") for f in ("experience", "education")], F.col("profile.raw_text_preview").alias("preview"), "profile.extraction_mode",
    )


def category_texts(spark, d):
    """Reasoning, matches and missing of each category of each report."""
    c = F.col("report.categories")
    return reports(spark, d).select(
        "doc_id", "job_id", *[c[k]["reasoning"].alias(f"{k}_text") for k in CATEGORIES],
        *[bars(c[k]["matches"]).alias(f"{k}_matches") for k in CATEGORIES], *[bars(c[k]["missing"]).alias(f"{k}_missing") for k in CATEGORIES],
    )


def profile_json(spark, d):
    """Whole profiles as JSON (no SQL equivalent: nested shape)."""
    return profiles(spark, d).select("doc_id", F.to_json("profile").alias("profile"))


def capabilities(spark, d):
    """What the engine can do, with how many of the given files of each format it takes."""
    files = composed(spark, d, synth.FILES, "part").select(suffix(F.col("filename")).alias("format"), reject_reason(F.col("filename"), F.col("size")).alias("reason"))
    counts = files.groupBy("format").agg(F.count("*").alias("n_files"), F.count_if(F.col("reason").isNull()).alias("n_taken"))
    able = pipeline.capabilities(spark).select("status", "mode", "formats", "reference_year", bars(F.col("layers")).alias("layers"))
    return counts.join(F.broadcast(able), how="cross").withColumn("supported", F.array_contains("formats", F.col("format"))).drop("formats")  # one row of abilities


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("report")
    out = reports(spark, sf_dir).select(
        "doc_id", "job_id", "title", r["overall_score"].alias("overall_score"), r["match_level"].alias("match_level"),
        *[r["categories"][c]["score"].alias(f"{c}_score") for c in CATEGORIES], r["recommendation"].alias("recommendation"),
    )
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        f.__name__: f
        for f in (
            norm_basic, norm_resumes, section_lines, section_assemble, heading_rows, section_table, heading_documents, email_documents, skills_flat, skills_by_category, skill_frequency, domain, exp_rows, exp_highlights,
            exp_total, edu_rows, projects_top5, certs_top6, summary, jd_skills, skill_match, skill_missing, candidate_job_rank, page_classify, packet_merge, packet_primary,
            segment_preview, block_layout, scanned_flag, ext_gate, reconcile_scalar, reconcile_skills, reconcile_categories, prompt_budget, page_preview, score_band, profile_json, capabilities,
            reconcile_lists, packet_external, pdf_text, files_by_path, json_commits, skills_table, dictionary_hits, packet_rows, provider_priority, provider_errors, layer_metrics, text_decode, json_roundtrip, profile_core, category_texts,
        )
    }
    found |= {f: contact_query(f) for f in ("name", "email", "phone", "location")} | {"links": contact_query("linkedin", "github")}
    found |= {"skill_score": category_score("technical_skills"), "exp_score": category_score("experience"), "edu_score": category_score("education"), "quality_score": category_score("quality")}
    found |= {"overall": report_field("overall_score"), "match_level": report_field("match_level"), "recommendation": report_field("recommendation")}
    found |= {"strengths": report_list("strengths"), "gaps": report_list("gaps"), "analyze": flagship}
    return found


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
