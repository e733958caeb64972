"""Queries of problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.mixing import mix
from corpusloom.llm.tokens import with_token_counts
from corpusloom.session import materialize
from corpusloom.tables import cleaned_split, table


def _mixed(spark: SparkSession, d: str, total_factor: float | None = None) -> tuple[DataFrame, DataFrame]:
    # a source is cleaned as a split is: trimmed, lower case, "-" read as "_"
    docs = table(spark, d, "documents", "doc_id").select("doc_id", cleaned_split("source").alias("source"), F.lower(F.trim("lang")).alias("lang"), "text").where("source is not null and text <> ''")
    targets = table(spark, d, "mix_target").select(cleaned_split("source").alias("source"), "target_share", "max_repeat")
    counted = with_token_counts(docs).select("doc_id", "source", "lang", "n_tokens")
    counted = materialize(counted, "token-counts")
    total = None if total_factor is None else total_factor * (counted.agg(F.sum("n_tokens")).first()[0] or 0)
    return mix(counted, targets, total)


def _shares(chosen: DataFrame, budget: DataFrame) -> DataFrame:
    got = chosen.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"), F.max("epoch").alias("most_uses"))
    total = chosen.agg(F.sum("n_tokens")).first()[0] or 1
    out = budget.join(got, "source", "left").na.fill(0, ["tokens", "n_rows", "most_uses"])
    asked = F.col("target_share") * F.lit(total)
    return out.withColumn("actual_share", F.col("tokens") / F.lit(total)).withColumn("shortage_tokens", F.greatest(asked - F.col("tokens"), F.lit(0.0)).cast("bigint")).withColumn(
        "unused_tokens", F.greatest(F.col("available_tokens") * F.greatest("max_repeat", F.lit(0)) - F.col("tokens"), F.lit(0))
    )


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Chosen documents at the largest total that keeps to all target shares."""
    return _mixed(spark, d)[0]


def p9_mixed_rows(spark: SparkSession, d: str) -> DataFrame:
    """What any right mix has in common, per usable source: no use beyond the cap, no use of a
    document twice in an epoch, and a share within one point of the target."""
    chosen, budget = _mixed(spark, d)
    chosen = materialize(chosen, "mixed")
    uses = chosen.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.countDistinct("epoch").alias("epochs"), F.sum("n_tokens").alias("tokens"))
    per = uses.groupBy("source").agg(F.max("uses").alias("most"), F.sum((F.col("uses") != F.col("epochs")).cast("bigint")).alias("n_doubled"), F.sum("tokens").alias("tokens"))
    usable = budget.where("available_tokens > 0 and max_repeat > 0")
    total, shares = chosen.agg(F.sum("n_tokens")).first()[0] or 1, usable.agg(F.sum("target_share")).first()[0] or 1.0
    near = F.abs(F.coalesce("tokens", F.lit(0)) / F.lit(total) - F.col("target_share") / F.lit(shares)) < 0.01
    return usable.join(per, "source", "left").select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeat")).alias("within_cap"), F.coalesce("n_doubled", F.lit(0)).alias("n_doubled"), near.alias("share_met"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _shares(*_mixed(spark, d))


def p9_report_all_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Shares and shortages if as many tokens as the corpus has are asked for: small sources run
    short and their rest goes to siblings, then to other domains."""
    return _shares(*_mixed(spark, d, 1.0))


QUERIES = {f.__name__: f for f in (p9_mix, p9_mixed_rows, p9_report, p9_report_all_tokens)}

_CLEAN = "nullif(replace(lower(trim(source, ' ' || chr(9))), '-', '_'), '')"
ORACLES = {
    "p9_mixed_rows": f"""select distinct t.source, true as within_cap, 0 as n_doubled, true as share_met from (select {_CLEAN} as source, max(max_repeat) as r from mix_target group by 1) t
 join (select {_CLEAN} as source from documents where text <> '' and doc_id is not null) d using (source) where t.r > 0""",
}
