"""Profiles read by rules, joined with profiles from an external model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The shape of a profile, as external models give it.
PROFILE = (
    "struct<contact:struct<name:string,email:string,phone:string,location:string,linkedin:string,github:string,portfolio:string>,summary:string,"
    "total_experience_years:double,primary_domain:string,skills:array<string>,categorized_skills:map<string,array<string>>,"
    "experience:array<struct<company:string,role:string,location:string,duration:string,start_date:string,end_date:string,highlights:array<string>,technologies:array<string>>>,"
    "education:array<struct<institution:string,degree:string,field_of_study:string,graduation_year:string,grade:string>>,"
    "projects:array<struct<name:string,description:string,url:string,technologies:array<string>>>,certifications:array<struct<name:string,issuer:string,year:string>>,"
    "raw_text_preview:string,extraction_mode:string>"
)
PLACEHOLDERS = ("full name", "candidate", "name")
BUDGET = 14_000


def _first(a: Column, b: Column) -> Column:
    return F.coalesce(T.blank_to_null(a), b)


def union_skills(ext: Column, own: Column) -> Column:
    """Both lists, the first spelling of each wins whatever its case, sorted."""
    both = F.filter(F.concat(F.coalesce(ext, F.array().cast("array<string>")), F.coalesce(own, F.array().cast("array<string>"))), lambda s: T.strip(s) != "")
    low = F.transform(both, F.lower)
    firsts = F.filter(F.transform(both, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda r: F.array_position(low, F.lower(r["s"])) == r["i"] + 1)
    return F.array_sort(F.transform(firsts, lambda r: T.strip(r["s"])))


def merge_categories(ext: Column, own: Column) -> Column:
    """ext with own's categories; in shared ones own's skills that differ in more than case are appended."""
    none = F.create_map().cast("map<string,array<string>>")

    def both(_: Column, a: Column, b: Column) -> Column:
        known = F.transform(a, F.lower)
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, F.filter(b, lambda s: ~F.array_contains(known, F.lower(s)))))

    return F.map_zip_with(F.coalesce(ext, none), F.coalesce(own, none), both)


def reconciled(own: Column, ext: Column, text: Column) -> Column:
    """The struct of a hybrid profile: an external e-mail must stand in the text, placeholders are no names."""
    c, e = own["contact"], ext["contact"]
    grounded = F.contains(F.lower(text), F.lower(e["email"])) & (e["email"] != "")
    named = (e["name"] != "") & ~F.lower(e["name"]).isin(*PLACEHOLDERS)
    contact = F.struct(
        F.when(named, e["name"]).otherwise(c["name"]).alias("name"), F.when(grounded, e["email"]).otherwise(c["email"]).alias("email"),
        *[_first(e[f], c[f]).alias(f) for f in ("phone", "location", "linkedin", "github", "portfolio")],
    )
    listed = lambda f: F.when(F.size(ext[f]) > 0, ext[f]).otherwise(own[f]).alias(f)
    return F.struct(
        contact.alias("contact"), _first(ext["summary"], own["summary"]).alias("summary"),
        F.when(ext["total_experience_years"] > 0, ext["total_experience_years"]).otherwise(own["total_experience_years"]).alias("total_experience_years"),
        _first(ext["primary_domain"], own["primary_domain"]).alias("primary_domain"), union_skills(ext["skills"], own["skills"]).alias("skills"),
        merge_categories(ext["categorized_skills"], own["categorized_skills"]).alias("categorized_skills"),
        listed("experience"), listed("education"), listed("projects"), listed("certifications"),
        own["raw_text_preview"].alias("raw_text_preview"), F.lit("hybrid").alias("extraction_mode"),
    )


def reconcile(profiles: DataFrame, external: DataFrame) -> DataFrame:
    """profiles (doc_id, clean_text, profile) with the external profile (doc_id, profile) of each merged in, if it has one."""
    ext = external.select("doc_id", F.col("profile").alias("_ext"))
    both = profiles.join(ext, "doc_id", "left")
    merged = F.when(F.col("_ext").isNotNull(), reconciled(F.col("profile"), F.col("_ext"), F.col("clean_text"))).otherwise(F.col("profile"))
    return both.withColumn("profile", merged).drop("_ext")


def inference_input(docs: DataFrame) -> DataFrame:
    """doc_id and the start of its text that an external model may read."""
    return docs.select("doc_id", F.substring("clean_text", 1, BUDGET).alias("prompt_text"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies (doc_id, provider, reply) with `profile`, and `error` where the reply is no profile: not JSON, or without any known field."""
    parsed = replies.withColumn("profile", F.from_json("reply", PROFILE))
    # JSON that isn't a profile parses to a struct of nulls
    empty = F.col("profile").isNull() | (F.to_json("profile") == "{}")
    return parsed.withColumns({"error": F.when(empty, "422 not a profile"), "profile": F.when(~empty, F.col("profile"))})


def merge_providers(profiles: DataFrame, replies: DataFrame, order: list[str]) -> DataFrame:
    """profiles with the replies of several providers merged in, field by field: the first provider in `order` that has a value wins.

    One aggregation brings the replies of a document together, one for each provider (of several the one that sorts first as
    JSON), and a fold merges them from the last provider to the first. Providers not in `order` and malformed
    replies take no part; `providers` lists those that did, in order.
    """
    rank = F.array_position(F.lit(order), F.col("provider"))
    good = parse_replies(replies).filter("error is null").withColumn("rank", rank).filter("rank > 0")
    one = good.groupBy("doc_id", "rank").agg(F.min_by("profile", "reply").alias("profile"))
    own = one.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.to_json("profile").alias("json"))), asc=False).alias("_replies"))  # as many as providers
    both = profiles.join(own, "doc_id", "left")
    found = F.transform(F.coalesce("_replies", F.array().cast("array<struct<rank:bigint,json:string>>")), lambda r: F.from_json(r["json"], PROFILE))
    merged = F.aggregate(found, F.col("profile").cast(PROFILE), lambda p, e: reconciled(p, e, F.col("clean_text")).cast(PROFILE))
    used = F.transform(F.reverse("_replies"), lambda r: F.lit(order)[(r["rank"] - 1).cast("int")])
    return both.withColumns({"profile": merged, "providers": F.coalesce(used, F.array().cast("array<string>"))}).drop("_replies")
