"""Queries of problem 7: same or near-same records across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.crosssplit import cross_pairs, fingerprints
from corpusloom.session import materialize
from corpusloom.tables import cleaned_split, table, trimmed, valid_lines

THRESHOLD = 0.7


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    split = cleaned_split("split")
    nodes = valid_lines(table(spark, d, "tokenized_graph"), "node_id", "split").select(F.col("normed_identifier").alias("key"), "node_id", split.alias("split"))
    nodes = nodes.where(F.col("split").isin("train", "val_community", "val_random"))
    files = table(spark, d, "stack_file", "file_id").select(trimmed("normed_identifier").alias("key"), F.col("content").alias("text")).where("key is not null")
    prints = fingerprints(files)
    side = F.when(F.col("split") == "train", "train").otherwise("eval")
    tagged = materialize(prints.join(nodes, "key").select("key", "node_id", "split", side.alias("side"), "set_id", "n_shingles", "code").dropDuplicates(["node_id", "set_id"]), "fp-nodes")
    return tagged.select("key", "node_id", "split", "side", "set_id"), cross_pairs(tagged, files, THRESHOLD)


def _node_pairs(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = _overlaps(spark, d)
    train = members.where("side = 'train'").select(F.col("set_id").alias("set_a"), F.col("node_id").alias("train_id"))
    held = members.where("side = 'eval'").select(F.col("set_id").alias("set_b"), F.col("node_id").alias("eval_id"), "split", "key")
    return pairs.join(train, "set_a").join(held, "set_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _node_pairs(spark, d)
    return pairs.select(F.least("train_id", "eval_id").alias("node_id_a"), F.greatest("train_id", "eval_id").alias("node_id_b")).distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and repository: nodes with a counterpart in train, and pairs."""
    pairs = _node_pairs(spark, d).select("train_id", "eval_id", "split", F.substring_index("key", ":", 1).alias("repository")).distinct()
    return pairs.groupBy("split", "repository").agg(F.countDistinct("eval_id").alias("n_nodes"), F.count("*").alias("n_pairs"))


QUERIES = {f.__name__: f for f in (p7_found, p7_report)}

_PAIRS = """with valid as (select * from (select node_id, trim(normed_identifier, ' ' || chr(9)) as ident,
    nullif(replace(lower(trim(split, ' ' || chr(9))), '-', '_'), '') as sp,
    row_number() over (partition by trim(normed_identifier, ' ' || chr(9)) order by line_no desc) as rn
    from tokenized_graph where normed_identifier is not null) where rn = 1 and sp in ('train', 'val_community', 'val_random')),
 body as (select distinct v.node_id, v.sp, v.ident, f.content from valid v join stack_file f on trim(f.normed_identifier, ' ' || chr(9)) = v.ident where f.content <> ''),
 tok as (select node_id, sp, ident, regexp_extract_all(lower(content), '[a-z0-9_]+') as w from body),
 sh as (select distinct node_id, sp, ident, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select node_id, sp, ident, w, unnest(range(1, len(w) - 1)) as i from tok)),
 n as (select node_id, count(*) as n from sh group by 1),
 common as (select a.node_id as train_id, b.node_id as eval_id, b.sp, b.ident, count(*) as c from sh a join sh b on a.s = b.s and a.sp = 'train' and b.sp <> 'train' group by all),
 pairs as (select train_id, eval_id, sp, ident from common join n x on x.node_id = train_id join n y on y.node_id = eval_id where c >= 0.7 * (x.n + y.n - c))
"""
ORACLES = {
    "p7_found": _PAIRS + "select distinct least(train_id, eval_id) as node_id_a, greatest(train_id, eval_id) as node_id_b from pairs",
    "p7_report": _PAIRS + "select sp as split, split_part(ident, ':', 1) as repository, count(distinct eval_id) as n_nodes, count(*) as n_pairs from pairs group by all",
}
