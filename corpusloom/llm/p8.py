"""Queries of problem 8: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.leaks import find_leaks
from corpusloom.tables import table

RUN_WORDS = 12
PARAPHRASE_COSINE = 0.6


def _leaks(spark: SparkSession, d: str, paraphrase: float | None) -> DataFrame:
    return find_leaks(table(spark, d, "documents", "doc_id").select("doc_id", "text"), table(spark, d, "eval_item").select("item_id", "passage"), RUN_WORDS, paraphrase_cosine=paraphrase)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, None).where("kind = 'run'").select("doc_id", "item_id").distinct()


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item that leaked word for word: documents that hold a run of its passage."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: documents with a verbatim run and documents with a paraphrase only."""
    pairs = _leaks(spark, d, PARAPHRASE_COSINE).groupBy("item_id", "doc_id").agg(F.max(F.col("kind") == "run").alias("verbatim"))
    counts = pairs.groupBy("item_id").agg(F.sum(F.col("verbatim").cast("bigint")).alias("n_verbatim"), F.sum((~F.col("verbatim")).cast("bigint")).alias("n_paraphrase"))
    items = table(spark, d, "eval_item").select("item_id", "benchmark_name", "eval_split").distinct()
    return counts.join(items, "item_id")


QUERIES = {f.__name__: f for f in (p8_found, p8_leaked_items, p8_report)}
_RUNS = """with g as (select doc_id, w, unnest(range(1, len(w) - 10)) as i from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents)),
 p as (select item_id, w, unnest(range(1, len(w) - 10)) as i from (select item_id, regexp_extract_all(lower(passage), '[a-z0-9]+') as w from eval_item))
 select distinct doc_id, item_id from (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as s from g)
 join (select distinct item_id, array_to_string(w[i:i + 11], ' ') as s from p) using (s)"""
ORACLES = {"p8_found": _RUNS, "p8_leaked_items": f"select item_id, count(*) as n_documents from ({_RUNS}) group by 1"}
