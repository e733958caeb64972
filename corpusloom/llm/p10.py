"""Queries of problem 10: long exact spans shared between records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.spans import shared_cover, shared_groups, text_classes
from corpusloom.session import materialize
from corpusloom.tables import table

SPAN = 400


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return text_classes(table(spark, d, "documents", "doc_id").where(F.length("text") >= SPAN).select("doc_id", "text"), "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    texts, members = _classes(spark, d)
    copies = members.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select(F.concat(F.lit("="), F.col("tid").cast("string")).alias("window"), "tid")
    groups = shared_groups(texts, SPAN).unionByName(copies).join(members.select("tid", "doc_id"), "tid")
    groups = materialize(groups.select("window", "doc_id").distinct(), "span-groups")
    other = groups.select("window", F.col("doc_id").alias("doc_id_b"))
    return groups.withColumnRenamed("doc_id", "doc_id_a").join(other, "window").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """Per document with shared text: its length and how many characters stand elsewhere."""
    texts, members = _classes(spark, d)
    copies = members.groupBy("tid").agg(F.count("*").alias("copies"))
    out = members.join(copies, "tid").join(shared_cover(texts, SPAN), "tid", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint")
    return out.select("doc_id", "n_chars", shared.alias("shared_chars")).where("shared_chars > 0")


QUERIES = {f.__name__: f for f in (p10_found, p10_report)}

_GRAMS = """with d as (select distinct doc_id, text from documents where length(text) >= 400),
 g as (select doc_id, i as pos, hash(substr(text, i, 400)) as h from (select doc_id, text, unnest(range(1, length(text) - 398)) as i from d)),
 r as (select h from g group by h having count(distinct doc_id) > 1), m as (select g.* from g join r using (h))
"""
ORACLES = {
    "p10_found": _GRAMS + "select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from m a join m b on a.h = b.h and a.doc_id < b.doc_id",
    "p10_report": _GRAMS + """, c as (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from (select distinct doc_id, pos from m))
 select c.doc_id, length(d.text) as n_chars, cast(sum(case when before is null then 400 else least(pos - before, 400) end) as bigint) as shared_chars
 from c join d using (doc_id) group by all""",
}
