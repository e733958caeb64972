"""Queries of problem 1: filling fixed-capacity containers with items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.packing import RETRIEVED, SEED, lexical_placements
from corpusloom.tables import table, trimmed, valid_lines


def _packs(spark: SparkSession, d: str) -> tuple[DataFrame, dict[int, int]]:
    budgets = {int(r["config_id"]): int(r["token_budget"]) for r in table(spark, d, "pack_config").where("config_id is not null and token_budget > 0").collect()}
    lines = valid_lines(table(spark, d, "tokenized_graph"), "node_id", "tok_len", "raw_identifier", "outgoing", "incoming")
    # a node's terms: the words of its name and the identifiers it is linked with
    words = F.split(F.lower(F.coalesce("raw_identifier", "normed_identifier")), r"[^\p{L}\p{N}]+")
    links = F.transform(F.concat(F.coalesce("outgoing", F.array().cast("array<string>")), F.coalesce("incoming", F.array().cast("array<string>"))), trimmed)
    terms = F.filter(F.concat(words, links, F.array("normed_identifier")), lambda x: x.isNotNull() & (x != ""))
    items = lines.select(F.col("node_id").alias("doc_id"), "tok_len", terms.alias("terms"), F.substring_index("normed_identifier", ":", 1).alias("place"))
    return lexical_placements(items, budgets), budgets


def p1_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packs(spark, d)[0].drop("how", "related")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per configuration: packs, nodes, cut nodes, share of the capacity filled, and of the
    nodes that joined a seed the shares that came by retrieval and that share a term with it."""
    packs, budgets = _packs(spark, d)
    capacity = F.element_at(F.create_map(*[F.lit(x) for c, b in sorted(budgets.items()) for x in (c, b)]), F.col("config_id"))
    joined = F.when(F.col("how") != SEED, 1)
    loads = packs.groupBy("config_id", "pack_id").agg(
        F.sum("effective_len").alias("load"), F.count("*").alias("n"), F.sum(F.col("truncated").cast("int")).alias("cut"), F.count(joined).alias("joined"),
        F.sum((F.col("how") == RETRIEVED).cast("int")).alias("retrieved"), F.sum(F.when(joined == 1, F.col("related").cast("int")).otherwise(0)).alias("related"),
    )
    return loads.groupBy("config_id").agg(
        F.count("*").alias("n_packs"), F.sum("n").alias("n_nodes"), F.sum("cut").alias("n_cut"), (F.sum("load") / (F.count("*") * F.first(capacity))).alias("filled"), F.max("load").alias("largest_load"),
        (F.sum("retrieved") / F.sum("joined")).alias("retrieved_share"), (F.sum("related") / F.sum("joined")).alias("related_share"),
    )


def p1_packed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Per configuration, what any right packing has in common: nodes, tokens, cut nodes, and
    the numbers of packs over the budget and of places that repeat."""
    packs, budgets = _packs(spark, d)
    capacity = F.element_at(F.create_map(*[F.lit(x) for c, b in sorted(budgets.items()) for x in (c, b)]), F.col("config_id"))
    loads = packs.groupBy("config_id", "pack_id").agg(
        F.sum("effective_len").alias("load"), F.count("*").alias("n"), F.countDistinct("pos").alias("places"), F.max("pos").alias("last"), F.sum(F.col("truncated").cast("bigint")).alias("cut"),
    )
    wrong = (F.col("load") > capacity) | (F.col("places") != F.col("n")) | (F.col("last") != F.col("n") - 1)
    return loads.groupBy("config_id").agg(F.sum("n").alias("n_nodes"), F.sum("load").alias("n_tokens"), F.sum("cut").alias("n_cut"), F.sum(wrong.cast("bigint")).alias("n_wrong_packs"))


QUERIES = {f.__name__: f for f in (p1_pack, p1_packed_nodes, p1_report)}
ORACLES: dict[str, str] = {
    "p1_packed_nodes": """with v as (select node_id, max(tok_len) as n from (select *, row_number() over (partition by trim(normed_identifier, ' ' || chr(9)) order by line_no desc) as rn
   from tokenized_graph where normed_identifier is not null) where rn = 1 and tok_len > 0 and node_id is not null group by 1)
 select config_id, count(*) as n_nodes, cast(sum(least(n, token_budget)) as bigint) as n_tokens, cast(sum(case when n > token_budget then 1 else 0 end) as bigint) as n_cut, 0 as n_wrong_packs from v, pack_config group by 1""",
}
