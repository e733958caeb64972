"""References to records that do not exist: direct orphans and their cascade.

``orphan_references`` finds, for every reference, whether its target is deleted,
missing or late.  ``orphan_cascade`` goes on from there to a fixpoint: a record
that refers to an orphaned record is indirectly orphaned.

Defined results for odd input: null and empty references are no references; a
record without key has no references; repeated rows count once; empty tables give
an empty result; a null period stays null; null load times compare as unknown and
never make a case; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.joins import bounded
from corpusloom.operators.onetask import in_one_task
from corpusloom.session import discard, materialize
from corpusloom.tables import trimmed

#: Up to so many references the cascade's rounds are walked in one task, beyond by joins.
TASK_EDGES = 2_000_000


def explode_references(lines: DataFrame, fields: Sequence[str], key: str = "normed_identifier") -> DataFrame:
    """One row per record, list field and distinct trimmed target."""
    per_field = [F.struct(F.lit(f).alias("field"), F.col(f).alias("items")) for f in fields]
    keep = [c for c in ("node_id", key, "ref_period", "ref_loaded_at") if c in lines.columns]
    rows = lines.select(*keep, F.explode(F.array(*per_field)).alias("_f"))
    cleaned = F.array_distinct(F.filter(F.transform("_f.items", trimmed), lambda x: x.isNotNull() & (x != "")))
    return rows.select(*keep, F.col("_f.field").alias("field"), F.explode(cleaned).alias("target"))


def target_status(all_lines: DataFrame, removals: DataFrame, key: str = "normed_identifier") -> DataFrame:
    """First and last load of every key that has a line, and its last removal if any."""
    ident = trimmed(key).alias("target")
    lines = (
        all_lines.where(F.col(key).isNotNull())
        .groupBy(ident)
        .agg(F.min("loaded_at").alias("first_loaded"), F.max("loaded_at").alias("last_loaded"))
        .withColumn("has_line", F.lit(True))
    )
    gone = removals.where(F.col(key).isNotNull()).groupBy(ident).agg(F.max("removed_at").alias("last_removed")).withColumn("has_removal", F.lit(True))
    return lines.join(gone, "target", "full")


def without_exempt(refs: DataFrame, exempt: DataFrame) -> DataFrame:
    """References but for those to keys of ``exempt`` (column ``target``), which are always valid."""
    return refs.join(bounded(exempt.select("target").where("target is not null").distinct()), "target", "left_anti")


def orphan_references(refs: DataFrame, status: DataFrame) -> DataFrame:
    """References without a live record behind them, with ``reason``.

    ``refs`` has field, target and ref_loaded_at; ``status`` is unique per target, so
    a hub that a third of all references name is split by AQE on the reference side.
    """
    refs = refs.select(*[c for c in ("node_id", "normed_identifier", "field", "target", "ref_period", "ref_loaded_at") if c in refs.columns])
    known = refs.join(status, "target", "left")
    has_line = F.coalesce("has_line", F.lit(False))
    deleted = F.col("has_removal") & (~has_line | (F.col("last_removed") > F.col("last_loaded")))
    reason = (
        F.when(F.coalesce(deleted, F.lit(False)), "deleted")
        .when(~has_line, "missing")
        .when(F.col("first_loaded") > F.col("ref_loaded_at"), "late")
    )
    return known.withColumn("reason", reason).where("reason is not null").drop("first_loaded", "last_loaded", "has_line", "last_removed", "has_removal")


def orphan_cascade(refs: DataFrame, direct: DataFrame, key: str = "normed_identifier", task_edges: int = TASK_EDGES) -> DataFrame:
    """(field, key, round) of records orphaned directly (round 0) or by reference to an orphan
    (round n), each list field being followed for itself.

    Each round semi-joins the references with the last round's orphans and takes off those
    already found; every round is a table in the shared folder.  The loop ends when a round
    adds nothing, however long the chains are.  Up to ``task_edges`` references the same rounds
    are walked in one task.
    """
    edges = materialize(refs.select("field", F.col(key).alias("child"), F.col("target").alias("parent")).where("child <> parent").distinct(), "orphan-edges")
    first = direct.select("field", F.col(key).alias("key")).distinct()
    if edges.count() <= task_edges:
        rows = edges.select("field", "child", "parent").unionByName(first.select("field", F.col("key").alias("child"), F.lit(None).cast("string").alias("parent")))
        return in_one_task(rows, _task_cascade, "field string, key string, round int")
    frontier = materialize(first.withColumn("round", F.lit(0)), "orphans")
    parts, number = [frontier], 0
    while True:
        number += 1
        hit = edges.join(frontier.select("field", F.col("key").alias("parent")), ["field", "parent"], "left_semi").select("field", F.col("child").alias("key")).distinct()
        for part in parts:
            hit = hit.join(part.select("field", "key"), ["field", "key"], "left_anti")
        frontier = materialize(hit.withColumn("round", F.lit(number)), "orphans")
        if frontier.isEmpty():
            discard(frontier)
            break
        parts.append(frontier)
        if len(parts) > 6:  # keep the plan short: one table instead of many
            merged = materialize(_union(parts[:-1]), "orphans")
            for part in parts[:-1]:
                discard(part)
            parts = [merged, frontier]
    discard(edges)
    return _union(parts)


def _task_cascade(rows: pd.DataFrame) -> pd.DataFrame:
    """The rounds in one task; rows without a parent are the direct orphans."""
    out = []
    for field, part in rows.groupby("field"):
        seed = part["parent"].isna().to_numpy()
        codes, ids = pd.factorize(np.concatenate([part["child"].to_numpy(object), part["parent"].to_numpy(object)[~seed]]))
        child, parent = codes[: len(part)][~seed], codes[len(part) :]
        found = np.full(len(ids), -1)
        fresh, number = np.unique(codes[: len(part)][seed]), 0
        while len(fresh):
            found[fresh] = number
            number += 1
            last = np.zeros(len(ids), dtype=bool)
            last[fresh] = True
            hit = np.unique(child[last[parent]])
            fresh = hit[found[hit] < 0]
        at = np.flatnonzero(found >= 0)
        out.append(pd.DataFrame({"field": field, "key": ids[at], "round": found[at]}))
    return pd.concat(out, ignore_index=True)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def orphaned_references(refs: DataFrame, direct: DataFrame, key: str = "normed_identifier") -> DataFrame:
    """References without a live record behind them, direct and inherited.

    round 0 are the direct ones with their reason; a reference of round n + 1 names a record
    that the cascade orphans in round n, and its reason is ``inherited``.
    """
    direct = materialize(direct, "direct")
    orphans = materialize(orphan_cascade(refs, direct, key), "orphans")
    names = ["node_id", key, "field", "target", "ref_period"]
    own = direct.select(*names, "reason", F.lit(0).alias("round"))
    rest = refs.select(*names).distinct().join(direct.select(key, "field", "target").distinct(), [key, "field", "target"], "left_anti")
    inherited = rest.join(orphans.select("field", F.col("key").alias("target"), (F.col("round") + 1).alias("round")), ["field", "target"]).select(*names, F.lit("inherited").alias("reason"), "round")
    return own.unionByName(inherited)
