"""Document lookup, corpus comparison and result rendering."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.identifiers import generation_identifier


def lookup_documents(asked: DataFrame, corpus: DataFrame, name: str = "identifier") -> DataFrame:
    """Documents by identifier, else by the generation side's normalised form of it.

    ``found_by`` is ``exact``, ``normalised`` or null.
    """
    keyed = corpus.select(F.col("normed_identifier").alias("k"), F.col("doc_id").alias("d"))
    one = asked.join(keyed.toDF("k1", "d1"), F.col(name) == F.col("k1"), "left")
    two = one.withColumn("_g", generation_identifier(name)).join(keyed.toDF("k2", "d2"), F.col("_g") == F.col("k2"), "left")
    how = F.when(F.col("d1").isNotNull(), "exact").when(F.col("d2").isNotNull(), "normalised")
    return two.select(*asked.columns, F.coalesce("d1", "d2").alias("doc_id"), how.alias("found_by"))


def changed_documents(a: DataFrame, b: DataFrame, key: str, body: str) -> DataFrame:
    """Keys of both corpora whose bodies differ."""
    return a.select(key, F.md5(body).alias("h1")).join(b.select(key, F.md5(body).alias("h2")), key).where("h1 <> h2").select(key)


def unified_diff(a: Column, b: Column) -> Column:
    @F.pandas_udf("string")
    def diff(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((p or "").split("\n"), (q or "").split("\n"), lineterm="")) for p, q in zip(x, y, strict=True)])

    return diff(a, b)


def estimate_tokens(docs: DataFrame, n: int, chars_per_token: float = 4.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token estimate from ``n`` documents in hash order: mean characters x documents / chars per token."""
    total = docs.agg(F.count("*").alias("n_docs"))
    sample = docs.select(F.length(text).alias("c"), F.md5(F.col(key).cast("string")).alias("h"), key).orderBy("h", key).limit(n).agg(F.avg("c").alias("mean_chars"))
    count = total.first()[0]
    return sample.select(F.lit(count).cast("bigint").alias("n_docs"), "mean_chars", F.round(F.col("mean_chars") * count / chars_per_token, 3).alias("estimated_tokens"))


def pack_connectivity(placements: DataFrame, edges: DataFrame) -> DataFrame:
    """Links between documents of one pack with both documents' positions."""
    inside = placements.select("pack_id", F.col("pos").alias("src_pos"), F.col("doc_id").alias("src"))
    there = placements.select("pack_id", F.col("pos").alias("dst_pos"), F.col("doc_id").alias("dst"))
    return inside.join(edges.select("src", "dst").distinct(), "src").join(there, ["pack_id", "dst"]).select("pack_id", "src", "dst", "src_pos", "dst_pos")


def timing_summary(timings: DataFrame) -> DataFrame:
    """Per phase: mean and deviation over all, and least, median and greatest rank mean."""
    ranks = timings.groupBy("phase", "rank").agg(F.avg("seconds").alias("m"))
    across = ranks.groupBy("phase").agg(F.min("m").alias("least_rank"), F.percentile("m", F.lit(0.5)).alias("median_rank"), F.max("m").alias("greatest_rank"))
    return timings.groupBy("phase").agg(F.avg("seconds").alias("mean_seconds"), F.stddev_samp("seconds").alias("std_seconds"), F.count("*").alias("n")).join(across, "phase")


def render_documents(docs: DataFrame) -> DataFrame:
    """Text rendering of result documents: a heading with source and depth, then the body."""
    mark = F.when(F.col("source") == "generated", "generated").otherwise("corpus")
    head = F.concat(F.repeat(F.lit("#"), F.col("depth") + 1), F.lit(" "), F.col("raw_identifier"), F.lit(" ["), mark, F.when(F.col("truncated"), F.lit(", truncated")).otherwise(F.lit("")), F.lit("]"))
    return docs.select("session", "ord", F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("rendered"))
