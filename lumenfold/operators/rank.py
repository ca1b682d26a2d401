"""The best candidates of each job, with the scores of the rubric but without scoring every pair.

A total depends on a candidate only through a few numbers (years, degrees, quality, number of skills: its class) and
the number of skills that match the job. Three things follow. Candidates of one class and one set of skills have equal
totals for every job, so of each such signature the k smallest ids are enough. Matches are counted by an
inverted index (skill -> signatures), which only touches pairs that share a skill. And as a match never lowers a
total, pairs without one are scored by class: the k smallest ids of a class hold all that can be among the best.

So totals are computed for classes and numbers of matches, never for pairs. Counts of candidates for each of these give the
total that the k-th best of a job reaches, and only pairs that reach it are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import shared_folder
from . import score as rubric

CLASS = ("years", "phd", "master", "bachelor", "some", "quality", "n_own")


def signatures(profiles: DataFrame, k: int) -> DataFrame:
    """sig, class and its fields, skills and the k smallest ids of each group of candidates that score alike."""
    p = F.col("profile")
    points = sum((T.let(F.coalesce(holds, F.lit(False)), lambda h: h.cast("int")) for holds, _ in rubric.quality_points(p)), F.lit(0))
    fields = {"years": F.coalesce(p["total_experience_years"], F.lit(0.0)), **{n: F.coalesce(v, F.lit(False)) for n, v in rubric.degrees(p).items()}, "quality": F.least(F.lit(100.0), 70.0 + 10.0 * points), "n_own": F.size(p["skills"])}
    rows = profiles.select("doc_id", *[v.alias(n) for n, v in fields.items()], F.transform(p["skills"], F.lower).alias("skills"))
    keyed = rows.withColumns({"class": F.xxhash64(*CLASS), "sig": F.xxhash64(*CLASS, "skills")})
    least = W.partitionBy("sig").orderBy(F.asc_nulls_last("doc_id"))
    few = keyed.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k)
    return few.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("class", *CLASS, "skills")], F.collect_list("doc_id").alias("ids"))  # k ids


def _total(asks: Column, n_matched: Column) -> Column:
    c = {n: F.col(n) for n in CLASS}
    return rubric.overall(asks["blank"], {
        "technical_skills": rubric.skills_score(n_matched, F.size(asks["skills"]), c["n_own"]), "experience": rubric.experience_score(c["years"], asks["years"]),
        "education": rubric.first_of(rubric.education_cases(asks, c))[0], "quality": c["quality"],
    })


def _best(rows: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("job_id").orderBy(F.desc("overall_score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def candidates(sigs: DataFrame, jobs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of jobs (with `asks`): the k best rows (job_id, doc_id, overall_score) by class alone, and the pairs (job_id, sig, overall_score) that may belong to the best."""
    # classes are combinations of few values; of each the k smallest ids
    ids = W.partitionBy("class").orderBy(F.asc_nulls_last("id"))
    members = sigs.select("class", *CLASS, F.explode("ids").alias("id")).withColumn("n", F.row_number().over(ids)).filter(F.col("n") <= k)
    classes = members.groupBy("class").agg(*[F.first(c).alias(c) for c in CLASS], F.collect_list("id").alias("ids"))
    both = classes.join(F.broadcast(jobs.select("job_id", "asks")), how="cross")  # classes times jobs, not candidates times jobs
    base = both.select("job_id", "class", *CLASS, "ids", "asks", _total(F.col("asks"), F.lit(0)).alias("overall_score"))
    by_class = _best(base.select("job_id", F.explode("ids").alias("doc_id"), "overall_score"), k)
    totals = base.select("job_id", "class", *CLASS, "asks", F.explode(F.sequence(F.lit(1), F.greatest(F.size("asks.skills"), F.lit(1)))).alias("n_matched"))
    totals = totals.select("job_id", "class", "n_matched", _total(F.col("asks"), F.col("n_matched")).alias("overall_score"))
    asked = jobs.select("job_id", F.explode("asks.skills").alias("skill"))
    owned = sigs.select("sig", "class", F.size("ids").alias("n_ids"), F.explode("skills").alias("skill"))
    shared = owned.join(F.broadcast(asked), "skill").groupBy("job_id", "sig", "class", "n_ids").agg(F.count("*").cast("int").alias("n_matched"))
    # how many candidates have each total at least: a table of classes and matches, from which the k-th best follows
    counts = shared.groupBy("job_id", "class", "n_matched").agg(F.sum("n_ids").alias("n")).join(totals, ["job_id", "class", "n_matched"])
    falling = W.partitionBy("job_id").orderBy(F.desc("overall_score"))
    reached = counts.withColumn("upto", F.sum("n").over(falling)).groupBy("job_id").agg(F.max(F.when(F.col("upto") >= k, F.col("overall_score"))).alias("by_pairs"))
    bound = by_class.groupBy("job_id").agg(F.when(F.count("*") >= k, F.min("overall_score")).alias("by_class")).join(reached, "job_id", "full")
    bound = bound.select("job_id", F.coalesce(F.greatest("by_pairs", "by_class"), F.lit(0.0)).alias("bound"))
    good = totals.join(F.broadcast(bound), "job_id").filter(F.col("overall_score") >= F.col("bound"))
    pairs = shared.join(good, ["job_id", "class", "n_matched"])
    return by_class.select("job_id", "doc_id", "overall_score"), pairs.select("job_id", "sig", "overall_score")


def best_candidates(profiles: DataFrame, jobs: DataFrame, k: int = 10) -> DataFrame:
    """job_id, doc_id, overall_score, rank: the k best of profiles (doc_id, profile) for each job (job_id, jd_text); ties to smaller ids."""
    asked = rubric.with_requirements(jobs)
    spark, path = profiles.sparkSession, shared_folder(profiles.sparkSession, "signatures")
    signatures(profiles, k).write.parquet(path)  # read several times: profiles are parsed once
    sigs = spark.read.parquet(path)
    by_class, pairs = candidates(sigs, asked, k)
    matched = pairs.join(sigs.select("sig", "ids"), "sig").select("job_id", F.explode("ids").alias("doc_id"), "overall_score")
    every = by_class.unionByName(matched).groupBy("job_id", "doc_id").agg(F.max("overall_score").alias("overall_score"))
    return _best(every, k)
