"""Rules that read a profile from clean text and its sections: contact, skills, career, education."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T

_DATES = r"(?i)(?=[adfjmnos][aceopu][bcglnprtvy]|q[1-4]|\d)" + X.DATES  # a month, a quarter, a day or a year
_SCHOOLS = rf"(?={T.ahead(X.SCHOOLS, 4, any_case=False)}){T.trie(X.SCHOOLS, any_case=False)}"
EXPERIENCE = "array<struct<company:string,role:string,location:string,duration:string,start_date:string,end_date:string,highlights:array<string>,technologies:array<string>>>"


def name(ls: Column) -> Column:
    """The first plausible name among the first ten lines."""
    # an honorific has its dot within five characters
    bare = lambda l: F.when(F.contains(F.substring(l, 1, 5), F.lit(".")), T.strip(F.regexp_replace(l, T.rx(X.HONORIFIC), ""))).otherwise(T.strip(l))

    def plausible(r: Column) -> Column:
        low, b = r["low"], r["bare"]
        listed = low.isin(*X.NOT_NAMES) | T.starts_with_any(low, ("curriculum vitae", "page "))
        small = lambda n: (n == 1) & (b == F.lower(b)) & (b != F.upper(b))
        sized = T.let(F.size(T.words(b)), lambda n: n.between(1, 4) & ~small(n))
        return T.matches(b, X.NAME) & ~T.contains_any(low, X.CONTACT_MARKS) & ~listed & sized

    rows = F.transform(F.slice(ls, 1, 10), lambda l: F.struct(F.lower(l).alias("low"), bare(l).alias("bare")))
    return F.get(F.filter(rows, plausible), 0)["bare"]


def phone(t: Column) -> Column:
    enough = lambda broad: F.length(F.regexp_replace(broad, T.rx(r"\D"), "")) >= 8
    broad = T.let(T.found(t, r"(?=[+(\d])" + X.PHONE), lambda b: F.when(enough(b), T.strip(b)))
    labelled = T.found(t, "(?i)(?=[cmptw])" + X.PHONE_LABELLED, 1)
    return T.let(labelled, lambda found: F.when(found.isNotNull(), T.strip(found)).otherwise(broad))


def location(t: Column, ls: Column) -> Column:
    cities = F.filter(F.slice(ls, 1, 8), lambda l: F.contains(l, F.lit(",")) & T.matches(l, X.CITY) & ~T.contains_any(F.lower(l), X.NO_CITY))
    labelled = T.found(t, "(?i)(?=[acl])" + X.LOCATION_LABELLED, 1)
    return T.let(labelled, lambda found: F.when(found.isNotNull(), T.strip(found)).otherwise(T.strip(T.found(F.get(cities, 0), X.CITY, 1))))


def contact(t: Column, tidy: bool = False) -> Column:
    return T.let(T.lines(t, tidy), lambda ls: _contact(t, ls))


def _contact(t: Column, ls: Column) -> Column:
    linked = F.contains(F.lower(t), F.lit(".com/"))
    return F.struct(
        name(ls).alias("name"), F.when(F.contains(t, F.lit("@")), T.found(t, X.EMAIL)).alias("email"), phone(t).alias("phone"), location(t, ls).alias("location"),
        F.when(linked, T.found(t, "(?i)(?=[hwl])" + X.LINKEDIN)).alias("linkedin"), F.when(linked, T.found(t, "(?i)(?=[hwg])" + X.GITHUB)).alias("github"), F.lit(None).cast("string").alias("portfolio"),
    )


def skill_places(low: Column, before: str) -> Column:
    """The skills that stand as whole tokens in lower-case text, by one pass over it."""
    names = [s for group in X.SKILLS.values() for s in group]
    short = [re.escape(s) + ("(?![a-z0-9])" if s.isalpha() else "") for s in names if len(s) < 3]
    begun = "|".join([T.ahead([s for s in names if len(s) > 2], 3, any_case=False), *short])
    # the longest name at each place; those that it begins with and a token's end are there too
    # what stands before a name is compared with ASCII letters first, as most places lie within words
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(T.rx(rf"(?<![a-z0-9])(?={begun})(?<![\w#+{before}])(?=({T.trie(names, any_case=False)})(?![\w#+]))")), F.lit(1)))
    within = sorted({(a, b) for a in names for b in names if re.match(re.escape(b) + r"[^\w#+]", a)})
    return T.let(found, lambda found: F.concat(found, F.array_compact(F.array(*[F.when(F.array_contains(found, F.lit(a)), F.lit(b)) for a, b in within]))))


def skill_hits(places: Column, names) -> Column:
    """Which of the names are among those found, in their order."""
    return F.array_intersect(F.lit(list(names)), places)


def shown(skills: Column, names=None) -> Column:
    """skills (of the names, if they are given) as they are spelled."""
    names = [s for group in X.SKILLS.values() for s in group] if names is None else names
    table = F.create_map(*[F.lit(v) for s in names for v in (s, X.display(s))])
    return F.transform(skills, lambda s: F.try_element_at(table, s))


def categorised(t: Column) -> Column:
    """map of category to its skills found, sorted; categories without any are left out."""
    values = lambda places: F.array(*[shown(skill_hits(places, sorted(names, key=X.display)), names) for names in X.SKILLS.values()])
    table = F.map_from_arrays(F.array(*[F.lit(c) for c in X.SKILLS]), T.let(skill_places(F.lower(t), "."), values))
    return F.map_filter(table, lambda _, v: F.size(v) > 0)


def all_skills(by_category: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.map_values(by_category))))


def domain(skills: Column) -> Column:
    low = F.transform(skills, F.lower)
    out = F.lit(X.OTHER_DOMAIN)
    for label, names in reversed(X.DOMAINS):
        out = F.when(F.arrays_overlap(low, F.array(*[F.lit(n) for n in names])), label).otherwise(out)
    return out


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ |\-–—,\t]+|[ |\-–—,\t]+$", "")


def _years(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(T.rx(X.YEAR)), F.lit(1)), lambda y: y.cast("int"))


def _job(line: Column, reference_year: int) -> Column:
    """Fields of a job from a line with dates."""
    at = F.struct(T.found(line, _DATES).alias("dates"), F.regexp_instr(line, F.lit(T.rx(_DATES))).alias("at"))

    def parts(m: Column) -> Column:
        before = _trimmed(F.substring(line, F.lit(1), m["at"] - 1))
        after = _trimmed(F.substring(line, m["at"] + F.length(m["dates"]), F.length(line)))
        head = F.coalesce(T.blank_to_null(before), after)
        return F.struct(m["dates"].alias("dates"), head.alias("head"), _years(m["dates"]).alias("years"))

    return T.let(T.let(at, parts), lambda p: _job_fields(p["dates"], p["head"], p["years"], reference_year))


def _job_fields(dates: Column, head: Column, years: Column, reference_year: int) -> Column:
    piped = F.filter(F.transform(F.split(head, r"\|"), T.strip), lambda p: p != "")
    pair = lambda sep: F.transform(F.split(head, sep), T.strip)
    role = (
        F.when(F.contains(head, F.lit("|")), F.get(piped, 0)).when(F.contains(head, F.lit(" at ")), pair(" at ")[0])
        .when(F.contains(head, F.lit(" - ")), pair(" - ")[0]).when(head != "", head)
    )
    company = (
        F.when(F.contains(head, F.lit("|")), F.get(piped, 1)).when(F.contains(head, F.lit(" at ")), F.get(pair(" at "), 1))
        .when(F.contains(head, F.lit(" - ")), F.get(pair(" - "), 1))
    )
    end = F.coalesce(F.get(years, 1), F.lit(reference_year))
    return F.struct(
        F.coalesce(role, F.lit("Professional Role")).alias("role"), F.coalesce(company, F.lit("Company")).alias("company"),
        years[0].alias("start"), end.alias("end"), T.contains_any(F.lower(dates), X.OPEN_ENDED).alias("open"),
    )


def jobs(target: Column, reference_year: int = X.REFERENCE_YEAR, tidy: bool = False) -> Column:
    """Jobs in the text: each line with a year range begins one, bullet lines after it are its highlights."""
    bullet = lambda l: T.starts_with_any(l, ("-", "*", "•", "–"))

    def points(own: Column) -> Column:
        return F.filter(F.transform(F.filter(own, bullet), lambda l: F.regexp_replace(l, r"^[-*•– \t]+", "")), lambda p: p != "")

    def cut(lines: Column, at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(lines))
        return F.transform(at, lambda i, k: F.struct(F.get(lines, i).alias("line"), points(F.slice(lines, i + 2, end(k) - i - 1)).alias("highlights")))

    def dated(lines: Column) -> Column:
        return T.let(F.filter(F.transform(lines, lambda l, i: F.when((F.contains(l, F.lit("19")) | F.contains(l, F.lit("20"))) & T.matches(l, _DATES), i)), lambda i: i.isNotNull()), lambda at: cut(lines, at))

    folded = T.let(T.lines(target, tidy), dated)
    return F.transform(folded, lambda f: F.struct(_job(f["line"], reference_year).alias("job"), f["highlights"].alias("highlights")))


def experience(found: Column) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x["job"]["company"].alias("company"), x["job"]["role"].alias("role"), F.lit(None).cast("string").alias("location"),
            F.concat(F.greatest(F.lit(1), x["job"]["end"] - x["job"]["start"]).cast("string"), F.lit(" years")).alias("duration"),
            x["job"]["start"].cast("string").alias("start_date"), F.when(x["job"]["open"], "Present").otherwise(x["job"]["end"].cast("string")).alias("end_date"),
            x["highlights"].alias("highlights"), F.array().cast("array<string>").alias("technologies"),
        ),
    )


def total_years(found: Column) -> Column:
    years = F.flatten(F.transform(found, lambda x: F.array(x["job"]["start"], x["job"]["end"])))
    return F.when(F.size(found) > 0, F.greatest(F.lit(1), F.array_max(years) - F.array_min(years)).cast("double"))


def education(target: Column, tidy: bool = False) -> Column:
    degrees = r"(?i)(?<![a-z0-9])(?=[abdlmp])\b(?:" + "|".join(X.DEGREES) + ")"  # no degree begins with another letter
    school = lambda l: T.matches(F.lower(l), _SCHOOLS)
    degree_of = lambda l: F.when(T.matches(l, degrees), F.coalesce(*[T.found(l, "(?i)" + p) for p in X.DEGREES]))

    parts = lambda l, sep: F.filter(F.transform(F.split(l, sep), T.strip), lambda p: p != "").alias("p")

    def build(l: Column) -> Column:
        return T.let(F.struct(parts(l, r"\|").alias("piped"), parts(l, " - ").alias("dashed")), lambda s: fields(l, s["piped"], s["dashed"]))

    def fields(l: Column, piped: Column, dashed: Column) -> Column:
        bar = F.contains(l, F.lit("|"))
        two_p, two_d = bar & (F.size(piped) >= 2), ~bar & F.contains(l, F.lit(" - ")) & (F.size(dashed) >= 2)
        swap = school(F.get(piped, 1)) & ~school(F.get(piped, 0))
        place = F.when(two_p, F.when(swap, F.get(piped, 1)).otherwise(F.get(piped, 0))).when(two_d, F.get(dashed, 0)).otherwise(l)
        part = F.when(two_p, F.when(swap, F.get(piped, 0)).otherwise(F.get(piped, 1))).when(two_d, F.get(dashed, 1))
        return F.struct(
            place.alias("institution"), F.coalesce(T.title(degree_of(l)), part, F.lit(X.NO_DEGREE)).alias("degree"), F.lit(None).cast("string").alias("field_of_study"),
            T.found(l, X.YEAR, 1).alias("graduation_year"), F.lit(None).cast("string").alias("grade"),
        )

    return F.transform(F.filter(T.lines(target, tidy), lambda l: school(l) | T.matches(l, degrees)), build)


def projects(section: Column, tidy: bool = False) -> Column:
    good = F.filter(T.lines(section, tidy), lambda l: (F.length(l) > 5) & ~T.starts_with_any(l, ("-", "*", "•")))
    empty = lambda kind: F.array().cast(kind)
    return F.transform(
        F.slice(good, 1, 5),
        lambda l: F.struct(F.substring(l, 1, 50).alias("name"), l.alias("description"), F.lit(None).cast("string").alias("url"), empty("array<string>").alias("technologies")),
    )


def certifications(section: Column, tidy: bool = False) -> Column:
    bare = F.transform(T.lines(section, tidy), lambda l: F.regexp_replace(l, r"^[-*• \t]+", ""))
    good = F.filter(bare, lambda l: F.length(l).between(4, 80))
    none = F.lit(None).cast("string")
    return F.transform(F.slice(good, 1, 6), lambda l: F.struct(l.alias("name"), none.alias("issuer"), none.alias("year")))


def summary_line(t: Column, tidy: bool = False) -> Column:
    # fifteen words hold 29 characters
    fit = F.filter(F.slice(T.lines(t, tidy), 2, 5), lambda l: (F.length(l) >= 29) & (F.size(T.words(l)) >= 15) & ~T.starts_with_any(l, ("-", "*", "•")))
    return F.get(fit, 0)


def preview(t: Column, n: int = 300) -> Column:
    return F.concat(F.substring(t, 1, n), F.when(F.length(t) > n, "...").otherwise(""))


def with_profile(docs: DataFrame, reference_year: int = X.REFERENCE_YEAR) -> DataFrame:
    """docs (clean_text, sections) with the struct column `profile`; an empty text gives an empty profile.

    Skills and jobs are found once, in columns of their own, and read by several fields.
    """
    t = F.col("clean_text")
    section = lambda s: F.coalesce(F.try_element_at("sections", F.lit(s)), F.lit(""))
    or_text = lambda s: F.when(section(s) != "", section(s)).otherwise(t)
    full = t != ""
    step = docs.withColumns({"_categories": categorised(t), "_jobs": jobs(or_text("experience"), reference_year, tidy=True)})
    step = step.withColumn("_skills", all_skills(F.col("_categories")))
    profile = F.struct(
        contact(t, tidy=True).alias("contact"), F.when(full, F.coalesce(T.blank_to_null(section("summary")), summary_line(t, tidy=True))).alias("summary"),
        total_years(F.col("_jobs")).alias("total_experience_years"), F.when(full, domain(F.col("_skills"))).alias("primary_domain"),
        F.col("_skills").alias("skills"), F.col("_categories").alias("categorized_skills"), experience(F.col("_jobs")).alias("experience"),
        education(or_text("education"), tidy=True).alias("education"), projects(section("projects"), tidy=True).alias("projects"), certifications(section("certifications"), tidy=True).alias("certifications"),
        F.when(full, preview(t)).alias("raw_text_preview"), F.lit("heuristic").alias("extraction_mode"),
    )
    return step.withColumn("profile", profile).drop("_categories", "_jobs", "_skills")
