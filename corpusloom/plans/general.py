"""Queries on dangling references (p3) and heavy keys (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import heavykeys, references
from corpusloom.session import materialize
from corpusloom.tables import table, trimmed, valid_lines

FIELDS = ("outgoing", "incoming")
HEAVY_SHARE = 0.02


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    graph = table(spark, d, "tokenized_graph")
    lines = valid_lines(graph, "node_id", *FIELDS, "dump_date", "loaded_at").select(
        "node_id", "normed_identifier", *FIELDS, F.substring("dump_date", 1, 6).alias("ref_period"), F.col("loaded_at").alias("ref_loaded_at")
    )
    refs = references.explode_references(lines, FIELDS)
    status = references.target_status(graph, table(spark, d, "node_removal"))
    hubs = table(spark, d, "hub_node").select(F.col("normed_identifier").alias("target"))
    refs = materialize(references.without_exempt(refs, hubs), "references")
    return refs, references.orphan_references(refs, status)


def _orphaned(spark: SparkSession, d: str) -> DataFrame:
    return references.orphaned_references(*_references(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Round 0 of the cascade: references that are dead themselves."""
    return _orphaned(spark, d).where("round = 0").select("node_id", "field", "target", "ref_period", "reason").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per list field, month and reason (``inherited`` for the cascade's): dead references."""
    return _orphaned(spark, d).groupBy("field", "ref_period", "reason").agg(F.count("*").alias("n_references"), F.countDistinct("target").alias("n_targets"))


def p3_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Per list field and round: orphaned references; round 0 are the direct ones."""
    return _orphaned(spark, d).groupBy("field", "round").agg(F.count("*").alias("n_references"), F.countDistinct("normed_identifier").alias("n_records"))


def _clean_repo(col: str):
    name = F.lower(trimmed(col))
    return F.when(name != "", name)


def _import_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "import_record").select(_clean_repo("repo_name").alias("key_value"), "file_path", "char_count")
    return rows.where("key_value is not null").groupBy("key_value", "file_path").agg(F.count("*").alias("deliveries"), F.max("char_count").alias("chars"))


def _incoming_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = valid_lines(table(spark, d, "tokenized_graph"), "node_id", "incoming", "tok_len")
    refs = lines.select("node_id", "tok_len", F.explode(F.array_distinct(F.transform("incoming", trimmed))).alias("key_value"))
    return refs.where("key_value <> ''")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for field, pairs in (("repo_name", _import_pairs(spark, d).select("key_value")), ("incoming", _incoming_pairs(spark, d).select("key_value"))):
        totals = materialize(heavykeys.dense_totals(pairs, "key_value"), "key-totals")
        parts.append(heavykeys.heavy_keys(totals, "key_value", HEAVY_SHARE).select(F.lit(field).alias("field"), "key_value"))
    return parts[0].unionByName(parts[1])


def p4_repo_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = heavykeys.dense_totals(_import_pairs(spark, d), "key_value", ["deliveries", "chars"])
    return totals.select(F.col("key_value").alias("repo_name"), F.col("deliveries").alias("n_records"), F.col("n_records").alias("n_paths"), F.col("chars").alias("total_chars"))


def p4_stack_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stack_file").select(_clean_repo("max_stars_repo_name").alias("key_value"), F.col("max_stars_repo_path").alias("path"), F.length("content").cast("bigint").alias("n"))
    pairs = rows.where("key_value is not null").groupBy("key_value", "path").agg(F.count("*").alias("deliveries"), F.max("n").alias("chars"))
    totals = heavykeys.dense_totals(pairs, "key_value", ["deliveries", "chars"])
    return totals.select(F.col("key_value").alias("repo_name"), F.col("deliveries").alias("n_records"), F.col("n_records").alias("n_paths"), F.col("chars").alias("total_chars"))


def p4_incoming_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = heavykeys.dense_totals(_incoming_pairs(spark, d).select("key_value", F.greatest(F.coalesce("tok_len", F.lit(0)), F.lit(0)).alias("tokens")), "key_value", ["tokens"])
    return totals.select(F.col("key_value").alias("target"), F.col("n_records").alias("n_nodes"), F.col("tokens").alias("total_tokens"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_cascade, p4_found, p4_repo_totals, p4_stack_totals, p4_incoming_totals)}

_VALID = """valid as (select * exclude (rn) from (select *, trim(normed_identifier, ' ' || chr(9)) as ident,
  row_number() over (partition by trim(normed_identifier, ' ' || chr(9)) order by line_no desc) as rn
  from tokenized_graph where normed_identifier is not null) where rn = 1)"""

_ORPHANS = f"""with {_VALID},
refs as (
  select distinct node_id, ident, field, trim(item, ' ' || chr(9)) as target, substr(dump_date, 1, 6) as ref_period, loaded_at from (
    select node_id, ident, 'outgoing' as field, unnest(outgoing) as item, dump_date, loaded_at from valid
    union all select node_id, ident, 'incoming', unnest(incoming), dump_date, loaded_at from valid)
  where item is not null and trim(item, ' ' || chr(9)) <> ''),
ln as (select trim(normed_identifier, ' ' || chr(9)) as target, min(loaded_at) as lo, max(loaded_at) as hi from tokenized_graph
  where normed_identifier is not null group by 1),
gone as (select trim(normed_identifier, ' ' || chr(9)) as target, max(removed_at) as rm from node_removal where normed_identifier is not null group by 1),
orphans as (
  select r.node_id, r.ident, r.field, r.target, r.ref_period,
    case when g.target is not null and (l.target is null or g.rm > l.hi) then 'deleted'
         when l.target is null then 'missing'
         when l.lo > r.loaded_at then 'late' end as reason
  from refs r left join ln l on l.target = r.target left join gone g on g.target = r.target
  where r.target not in (select normed_identifier from hub_node where normed_identifier is not null))
"""

# rounds are walked one by one: only records that were new in the round before go on
_CASCADE = _ORPHANS.replace("with valid", "with recursive valid", 1) + """, seed as (select distinct field, ident from orphans where reason is not null),
walk(field, ident, round) using key (field, ident) as (select field, ident, 0 from seed
  union select r.field, r.ident, min(w.round) + 1 from orphans r join walk w on w.field = r.field and w.ident = r.target
  where r.ident <> r.target and not exists (select 1 from recurring.walk k where k.field = r.field and k.ident = r.ident) group by all),
orphaned as (select node_id, ident, field, target, ref_period, reason, 0 as round from orphans where reason is not null
  union all select o.node_id, o.ident, o.field, o.target, o.ref_period, 'inherited', w.round + 1 from orphans o join walk w on w.field = o.field and w.ident = o.target where o.reason is null)
"""

_PAIRS = """pairs as (select lower(trim(repo_name, ' ' || chr(9))) as key_value, file_path, count(*) as deliveries, max(char_count) as chars
  from import_record where trim(repo_name, ' ' || chr(9)) <> '' group by all)"""

_INCOMING = f"""{_VALID}, inc as (select distinct node_id, tok_len, trim(item, ' ' || chr(9)) as key_value from
  (select node_id, tok_len, unnest(incoming) as item from valid) where trim(item, ' ' || chr(9)) <> '')"""

ORACLES = {
    "p3_found": _ORPHANS + "select distinct node_id, field, target, ref_period, reason from orphans where reason is not null",
    "p3_report": _CASCADE + "select field, ref_period, reason, count(*) as n_references, count(distinct target) as n_targets from orphaned group by all",
    "p3_cascade": _CASCADE + "select field, round, count(*) as n_references, count(distinct ident) as n_records from orphaned group by all",
    "p4_found": f"with {_PAIRS}, {_INCOMING}" + """
      select 'repo_name' as field, key_value from pairs group by key_value having count(*) >= 0.02 * (select count(*) from pairs)
      union all select 'incoming', key_value from inc group by key_value having count(*) >= 0.02 * (select count(*) from inc)""",
    "p4_repo_totals": f"with {_PAIRS} select key_value as repo_name, cast(sum(deliveries) as bigint) as n_records, count(*) as n_paths, cast(coalesce(sum(chars), 0) as bigint) as total_chars from pairs group by 1",
    "p4_stack_totals": """select key_value as repo_name, cast(sum(deliveries) as bigint) as n_records, count(*) as n_paths, cast(coalesce(sum(chars), 0) as bigint) as total_chars from
      (select lower(trim(max_stars_repo_name, ' ' || chr(9))) as key_value, max_stars_repo_path, count(*) as deliveries, max(length(content)) as chars
       from stack_file where trim(max_stars_repo_name, ' ' || chr(9)) <> '' group by all) group by 1""",
    "p4_incoming_totals": f"with {_INCOMING} select key_value as target, count(*) as n_nodes, cast(sum(greatest(coalesce(tok_len, 0), 0)) as bigint) as total_tokens from inc group by 1",
}
