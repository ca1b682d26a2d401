"""The rubric: every profile against every job description.

What a job asks for is read once for each job, and what counts of a profile once for each profile; the
product with the jobs then only compares arrays and numbers. The product is the result asked for (a report for each candidate and job). The jobs
are broadcast if there are at most `BROADCAST_JOBS`, else Catalyst chooses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T
from .extract import shown, skill_hits, skill_places

BROADCAST_JOBS = 10_000
NEUTRAL = "No job description provided for comparison. Displaying candidate profile only."


def with_requirements(jobs: DataFrame, column: str = "jd_text") -> DataFrame:
    """jobs with `asks`: skills, years, title words and degree flags; blank descriptions have `asks.blank`."""
    jd, names = F.col("_jd"), [s for group in X.SKILLS.values() for s in group]
    low = F.lower(jd)
    asks = F.struct(
        (jd == "").alias("blank"), T.let(skill_places(low, ""), lambda places: F.array_distinct(skill_hits(places, names))).alias("skills"),
        F.coalesce(T.found(jd, X.REQUIRED_YEARS, 1).cast("double"), F.lit(3.0)).alias("years"),
        T.words(F.coalesce(T.strip(T.found(jd, X.TITLE, 1)), F.lit(""))).alias("title"),
        T.contains_any(low, ("ph.d", "doctorate")).alias("phd"), T.contains_any(low, ("master", "m.s.", "mba")).alias("master"),
    )
    return jobs.withColumn("_jd", T.strip(F.coalesce(F.col(column), F.lit("")))).withColumn("asks", asks).drop("_jd")


def _category(key: str, score: Column, reasoning: Column, matches: Column, missing: Column) -> dict[str, Column]:
    """The fields of a category, apart: those that nobody reads are then not computed."""
    return {
        "score": score.cast("double"), "weight": F.lit(X.WEIGHTS[key]), "reasoning": reasoning,
        "matches": F.coalesce(matches, F.array()).cast("array<string>"), "missing": F.coalesce(missing, F.array()).cast("array<string>"),
    }


def skills_score(n_matched: Column, n_asked: Column, n_own: Column) -> Column:
    raw = F.least(F.lit(100.0), n_matched / F.greatest(n_asked, F.lit(1)) * 100.0 + F.least(F.lit(10.0), n_own * 0.5))
    return F.when(n_asked == 0, F.when(n_own > 0, 75.0).otherwise(40.0)).otherwise(T.rounded(raw))


def experience_score(own: Column, need: Column) -> Column:
    ratio = own / F.when(need > 0, need)
    score = F.when(own >= need, 90.0 + F.least(F.lit(10.0), (own - need) * 2)).when(own > 0, ratio * 85.0).otherwise(50.0)
    return T.rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))


def degrees(p: Column) -> dict[str, Column]:
    """What a profile's education holds: phd, master, bachelor, and whether there is any."""
    return {k: _degrees(p)[k] for k in ("phd", "master", "bachelor", "some")}


def _degrees(p: Column) -> Column:
    held = F.lower(F.array_join(F.transform(p["education"], lambda e: F.concat_ws(" ", e["degree"], e["institution"])), " "))
    found = {"phd": ("ph.d", "doctorate"), "master": ("master", "m.s", "m.tech", "mba"), "bachelor": ("bachelor", "b.s", "b.tech", "b.e", "degree")}
    return T.let(held, lambda held: F.struct(*[T.contains_any(held, parts).alias(k) for k, parts in found.items()], (F.size(p["education"]) > 0).alias("some")))


def education_cases(asks: Column, held: Column | dict[str, Column]) -> list[tuple[Column, float, str]]:
    """Condition, score and reason, of which the first that holds counts."""
    phd, master, bachelor = held["phd"], held["master"], held["bachelor"]
    return [
        (asks["phd"] & phd, 100.0, "Candidate holds required doctoral degree."),
        (asks["phd"] & master, 75.0, "Candidate holds Master's degree (Ph.D. preferred)."),
        (asks["phd"], 60.0, "Candidate lacks required doctoral degree."),
        (asks["master"] & (phd | master), 100.0, "Candidate holds required advanced degree."),
        (asks["master"] & bachelor, 80.0, "Candidate holds Bachelor's degree (Master's preferred)."),
        (asks["master"], 65.0, "Advanced degree not explicitly stated."),
        (phd | master | bachelor, 95.0, "Candidate possesses relevant higher education credentials."),
        (held["some"], 85.0, "Candidate possesses educational background."),
        (F.lit(True), 70.0, "No formal degree detected in resume."),
    ]


def first_of(cases: list[tuple[Column, float, str]]) -> tuple[Column, Column]:
    score, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    for when, value, reason in reversed(cases):
        score, text = F.when(when, value).otherwise(score), F.when(when, reason).otherwise(text)
    return score, text


def quality_points(p: Column) -> list[tuple[Column, str]]:
    c = p["contact"]
    has = lambda *names: [T.blank_to_null(c[n]).isNotNull() for n in names]
    (email, phone), (github, linkedin) = has("email", "phone"), has("github", "linkedin")
    points = F.exists(p["experience"], lambda e: F.size(e["highlights"]) > 0)
    return [(email & phone, "Complete contact info"), (github | linkedin, "Professional profile links provided"), (points, "Structured accomplishment highlights present")]


def overall(blank: Column, scores: dict[str, Column]) -> Column:
    s, w = scores, X.WEIGHTS
    total = s["technical_skills"] * w["technical_skills"] + s["experience"] * w["experience"] + s["education"] * w["education"] + s["quality"] * w["quality"]
    return F.when(blank, 50.0).otherwise(T.rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))))


def skills_category(p: Column, asks: Column, matched: Column, missing: Column) -> dict[str, Column]:
    """matched, missing: display names, sorted."""
    n_jd, n_own = F.size(asks["skills"]), F.size(p["skills"])
    ratio = F.size(matched) / F.greatest(n_jd, F.lit(1))
    text = F.concat(
        F.lit("Candidate matches "), F.size(matched).cast("string"), F.lit(" of "), n_jd.cast("string"), F.lit(" required technical skills ("), T.fixed(ratio * 100, 0), F.lit("%).")
    )
    few = F.lit("Few specific technical keywords identified in job description.")
    return _category("technical_skills", skills_score(F.size(matched), n_jd, n_own), F.when(n_jd == 0, few).otherwise(text), matched, missing)


def experience_category(p: Column, asks: Column, roles: Column) -> dict[str, Column]:
    """roles: struct(role, low) of each job."""
    own, need = F.coalesce(p["total_experience_years"], F.lit(0.0)), asks["years"]
    ratio = own / F.when(need > 0, need)
    text = (
        F.when(own >= need, F.concat(F.lit("Candidate has "), T.fixed(own, 1), F.lit(" years of experience, exceeding the required "), T.fixed(need, 0), F.lit(" years.")))
        .when(own > 0, F.concat(F.lit("Candidate has "), T.fixed(own, 1), F.lit(" years vs. "), T.fixed(need, 0), F.lit(" required years ("), T.fixed(ratio * 100, 0), F.lit("% match).")))
        .otherwise("Experience duration could not be accurately calculated from resume dates.")
    )
    named = lambda rs: F.transform(rs, lambda r: r["role"])
    titled = F.filter(roles, lambda r: F.exists(asks["low_title"], lambda w: F.contains(r["low"], w)))
    short = F.when(own < need, F.array(F.concat(T.fixed(need - own, 1), F.lit(" more years required"))))
    return _category("experience", experience_score(own, need), text, F.when(F.size(asks["title"]) > 0, named(titled)).otherwise(named(F.slice(roles, 1, 2))), short)


def education_category(p: Column, asks: Column, held: Column) -> dict[str, Column]:
    score, text = first_of(education_cases(asks, held))
    listed = F.transform(p["education"], lambda e: F.concat(e["degree"], F.lit(" from "), e["institution"]))
    return _category("education", score, text, listed, F.when(score < 80, F.array(F.lit("Higher degree preferred"))))


def quality_category(reasons: Column) -> dict[str, Column]:
    text = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("Standard resume structure.")
    return _category("quality", F.least(F.lit(100.0), 70.0 + 10.0 * F.size(reasons)), text, reasons, F.array())


def level(overall: Column) -> Column:
    return F.when(overall >= 75.0, "Strong Match").when(overall >= 50.0, "Potential Match").otherwise("Weak Match")


def strengths(p: Column, edu_score: Column, matched: Column) -> Column:
    years = p["total_experience_years"]
    out = F.array_compact(
        F.array(
            F.when(F.size(matched) >= 3, F.concat(F.lit("Strong match on core tech stack: "), F.array_join(F.slice(matched, 1, 4), ", "), F.lit("."))),
            F.when(years >= 4.0, F.concat(F.lit("Solid career experience ("), T.fixed(years, 0), F.lit("+ years) in "), F.coalesce(T.blank_to_null(p["primary_domain"]), F.lit("engineering")), F.lit("."))),
            F.when((edu_score >= 90.0) & (F.size(p["education"]) > 0), F.concat(F.lit("Verified academic degree: "), F.get(p["education"], 0)["institution"], F.lit("."))),
        )
    )
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("Candidate demonstrates baseline professional competencies.")))


def gaps(p: Column, exp_score: Column, missing: Column) -> Column:
    c = p["contact"]
    none = T.blank_to_null(c["linkedin"]).isNull() & T.blank_to_null(c["github"]).isNull()
    out = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("Missing mentions of key technologies: "), F.array_join(F.slice(missing, 1, 4), ", "), F.lit("."))),
            F.when(exp_score < 70.0, "Years of experience may be below target requirements."),
            F.when(none, "No LinkedIn or GitHub profile links provided for verification."),
        )
    )
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("No critical qualification gaps identified.")))


def recommendation(p: Column, overall: Column, matched: Column, missing: Column) -> Column:
    who, pct = F.coalesce(T.blank_to_null(p["contact"]["name"]), F.lit("The candidate")), F.concat(F.lit("("), T.fixed(overall, 1), F.lit("%)"))
    lacks = F.when(F.size(missing) > 0, F.concat(F.lit(", though lacks explicit mention of "), F.array_join(F.slice(missing, 1, 2), ", "))).otherwise("")
    return (
        F.when(overall >= 75.0, F.concat(
            who, F.lit(" is a high-confidence match "), pct, F.lit(" for this role. Possesses strong alignment with core requirements ("),
            F.array_join(F.slice(matched, 1, 3), ", "), F.lit("). Recommended to advance immediately to technical interview.")))
        .when(overall >= 50.0, F.concat(
            who, F.lit(" is a potential candidate "), pct, lacks, F.lit(". Recommended for an initial recruiter screening call to clarify experience depth.")))
        .otherwise(F.concat(
            who, F.lit(" has significant skill or experience gaps for this specific position "), pct, F.lit(". Recommend reviewing alternative roles or junior positions.")))
    )


def score(profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    """profiles (with `profile`) times jobs (with jd_text): the columns of both and the struct `report`."""
    asked = with_requirements(jobs)
    few = jobs.limit(BROADCAST_JOBS + 1).count() <= BROADCAST_JOBS
    # the names asked for as the profiles spell them, and the words of the title, once for each job
    asked = asked.withColumn("asks", F.col("asks").withField("shown", shown(F.col("asks.skills"))).withField("low_title", F.transform("asks.title", F.lower)))
    p, asks = F.col("profile"), F.col("asks")
    own = profiles.withColumns({
        "_own": F.transform(p["skills"], F.lower), "_held": _degrees(p), "_roles": F.transform(p["experience"], lambda e: F.struct(e["role"].alias("role"), F.lower(e["role"]).alias("low"))),
        "_reasons": F.array_compact(F.array(*[F.when(holds, text) for holds, text in quality_points(p)])),
    })
    both = own.crossJoin(F.broadcast(asked) if few else asked)
    matched = F.filter(p["skills"], lambda s, i: F.array_contains(asks["skills"], F.get("_own", i)))
    lacking = F.filter(asks["shown"], lambda s, i: ~F.array_contains("_own", F.get(asks["skills"], i)))
    both = both.withColumns({
        "_matched": F.when(F.size(asks["skills"]) == 0, F.slice(p["skills"], 1, 5)).otherwise(F.array_sort(matched)), "_missing": F.array_sort(lacking),
    })
    m, x = F.col("_matched"), F.col("_missing")
    cats = {"technical_skills": skills_category(p, asks, m, x), "experience": experience_category(p, asks, F.col("_roles")), "education": education_category(p, asks, F.col("_held")), "quality": quality_category(F.col("_reasons"))}
    neutral = {k: _category(k, F.lit(50.0), F.lit("Job description not provided."), F.array(), F.array()) for k in cats}
    field = lambda k, f: F.when(asks["blank"], neutral[k][f]).otherwise(cats[k][f]).alias(f)
    # scores are columns of their own, so that who reads only totals leaves the texts out of the plan
    both = both.withColumns({f"_{k}": field(k, "score") for k in cats})
    s = {k: F.col(f"_{k}") for k in cats}
    categories = F.struct(*[F.struct(*[s[k].alias(f) if f == "score" else field(k, f) for f in cats[k]]).alias(k) for k in cats])
    both = both.withColumn("_total", overall(asks["blank"], s))
    t = F.col("_total")
    none = F.array().cast("array<string>")
    unless = lambda blank, value: F.when(asks["blank"], blank).otherwise(value)
    report = F.struct(
        t.alias("overall_score"), unless(F.lit("Neutral"), level(t)).alias("match_level"), unless(F.lit(NEUTRAL), recommendation(p, t, m, x)).alias("recommendation"),
        categories.alias("categories"), unless(F.array(F.lit("Candidate profile successfully extracted.")), strengths(p, s["education"], m)).alias("strengths"),
        unless(F.array(F.lit("Target job requirements not supplied.")), gaps(p, s["experience"], x)).alias("gaps"),
        unless(none, m).alias("matched_skills"), unless(none, x).alias("missing_skills"),
    )
    return both.withColumn("report", report).drop("asks", "_own", "_held", "_roles", "_reasons", "_matched", "_missing", "_total", *[f"_{k}" for k in cats])
