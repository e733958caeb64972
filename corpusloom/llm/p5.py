"""Queries of problem 5: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.splits import assign_splits, group_members, mixed_groups
from corpusloom.operators.references import explode_references
from corpusloom.session import materialize
from corpusloom.tables import cleaned_split, table, valid_lines

SHARES = {"train": 0.84, "val_community": 0.08, "val_random": 0.08}


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = materialize(valid_lines(table(spark, d, "tokenized_graph"), "node_id", "outgoing", "incoming", "split"), "valid-lines")
    refs = explode_references(lines, ("outgoing", "incoming")).select("node_id", "target")
    return lines, materialize(group_members(lines, refs), "members")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    lines, members = _members(spark, d)
    return mixed_groups(members, lines.select("node_id", cleaned_split("split").alias("split"))).select("group_id", "node_id")


def p5_assign(spark: SparkSession, d: str) -> DataFrame:
    _, members = _members(spark, d)
    return assign_splits(members, SHARES).select("node_id", "group_id", "split")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, groups and reached share per split."""
    _, members = _members(spark, d)
    done = assign_splits(members, SHARES)
    total = done.count()
    return done.groupBy("split").agg(F.count("*").alias("n_nodes"), F.countDistinct("group_id").alias("n_groups"), (F.count("*") / F.lit(max(total, 1))).alias("share"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every node with the smallest node_id of its group."""
    return _members(spark, d)[1].select("node_id", "group_id")


def p5_split_groups(spark: SparkSession, d: str) -> DataFrame:
    """What any right assignment has in common: all nodes, no group in two splits, and shares
    within half a point of the targets."""
    _, members = _members(spark, d)
    done = materialize(assign_splits(members, SHARES).select("node_id", "group_id", "split"), "assigned")
    torn = done.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
    n = done.count()
    near = [F.abs(F.sum((F.col("split") == s).cast("int")) / F.lit(max(n, 1)) - share) < 0.005 for s, share in SHARES.items()]
    return done.agg(F.count("*").alias("n_nodes"), F.countDistinct("group_id").alias("n_groups"), F.lit(torn).cast("bigint").alias("n_torn_groups"), (near[0] & near[1] & near[2]).alias("shares_met"))


QUERIES = {f.__name__: f for f in (p5_found, p5_assign, p5_groups, p5_report, p5_split_groups)}

# labels walk along the edges, smaller ones only, until nothing changes
_GROUPS = """with recursive valid as (select * from (select *, trim(normed_identifier, ' ' || chr(9)) as ident,
   row_number() over (partition by trim(normed_identifier, ' ' || chr(9)) order by line_no desc) as rn from tokenized_graph where normed_identifier is not null) where rn = 1),
 named as (select node_id as a, trim(unnest(list_concat(coalesce(outgoing, []), coalesce(incoming, []))), ' ' || chr(9)) as t from valid),
 edge as (select distinct n.a, v.node_id as b from named n join valid v on v.ident = n.t where n.a <> v.node_id), pair as (select a, b from edge union select b, a from edge),
 walk(node_id, label) as (select node_id, node_id from valid union select e.b, w.label from walk w join pair e on e.a = w.node_id where w.label < e.b),
 groups as (select node_id, min(label) as group_id from walk group by 1)
"""
ORACLES = {
    "p5_groups": _GROUPS + "select node_id, group_id from groups",
    "p5_found": _GROUPS + """, tagged as (select g.*, nullif(replace(lower(trim(v.split, ' ' || chr(9))), '-', '_'), '') as sp from groups g join valid v using (node_id))
 select group_id, node_id from tagged where group_id in (select group_id from tagged group by 1 having count(distinct sp) > 1)""",
    "p5_split_groups": _GROUPS + "select count(*) as n_nodes, count(distinct group_id) as n_groups, 0 as n_torn_groups, true as shares_met from groups",
}
