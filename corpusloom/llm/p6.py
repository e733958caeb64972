"""Queries of problem 6: generated, minified or vendored source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.sourcekind import kinds
from corpusloom.tables import table


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "stack_file", "file_id").select("file_id", F.col("max_stars_repo_name").alias("repo"), "content")
    return kinds(files, table(spark, d, "upstream_file").select("home_repo", "content"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).select("file_id").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Files per kind and repository, hand-written ones left out."""
    repos = table(spark, d, "stack_file").groupBy("file_id").agg(F.max(F.lower(F.trim("max_stars_repo_name"))).alias("repository"))
    return _kinds(spark, d).join(repos, "file_id", "left").groupBy("kind", "repository").agg(F.countDistinct("file_id").alias("n_files"))


QUERIES = {f.__name__: f for f in (p6_found, p6_report)}
ORACLES: dict[str, str] = {}
