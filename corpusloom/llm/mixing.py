"""Mixing sources to target weights under repetition caps.

Targets form a tree of domain, language and source.  A total is handed down the tree in
proportion to the weights; a source that can't fill its part even with every document
repeated ``max_repeat`` times leaves a shortage, which goes to its siblings first, then to
its language's siblings, then to the other domains.  Each source then takes a prefix of
its documents, counted in tokens, from seeded epochs: every epoch is a new permutation
that holds each document once.

Only the source table (a row per source, documented bound ``MAX_SOURCES``) reaches the
driver; documents are ranked with distributed running sums.

Defined results: documents whose source is null, blank or without target are not used; a
target source without documents gets nothing and its share is redistributed; null or
empty texts have no tokens and are not used; repeated rows of a document count once; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import running_totals
from corpusloom.operators.joins import bounded

MAX_SOURCES = 100_000


def source_path(source: str, language: str | None = None) -> tuple[str, str, str]:
    """(domain, language, source): the domain is the name's part before the first ``_``; the
    language is that of most of its tokens, or else the name's other part."""
    domain, _, rest = source.partition("_")
    return domain, language or rest or "any", source


@dataclass
class _Node:
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, "_Node"] = field(default_factory=dict)


def _pour(node: _Node, amount: float) -> None:
    """Hand ``amount`` (at most the node's capacity) to the children by weight; what full
    children can't take goes to their siblings by weight, again and again."""
    node.amount = amount  # type: ignore[attr-defined]
    if not node.children:
        return
    parts = dict.fromkeys(node.children, 0.0)
    open_ones = [k for k, c in node.children.items() if c.capacity > 0]
    left = amount
    while open_ones and left > 1e-6:
        weights = sum(node.children[k].weight for k in open_ones)
        share = {k: left * (node.children[k].weight / weights if weights > 0 else 1 / len(open_ones)) for k in open_ones}
        full = [k for k in open_ones if parts[k] + share[k] >= node.children[k].capacity - 1e-9]
        if not full:
            for k in open_ones:
                parts[k] += share[k]
            break
        for k in full:
            left -= node.children[k].capacity - parts[k]
            parts[k] = node.children[k].capacity
        open_ones = [k for k in open_ones if k not in full]
    for k, child in node.children.items():
        _pour(child, parts[k])


def plan_budgets(sources: list[tuple[str, float, int, int]], total: float | None = None, path: Callable[[str], tuple[str, ...]] = source_path) -> dict[str, float]:
    """Tokens per source.  ``sources``: (source, weight, max_repeat, available tokens).

    Without ``total``, the largest total is taken for which every source that has any
    tokens can fill its part, so that the reached shares are the targets.
    """
    caps = {s: float(available * max(repeat, 0)) for s, _, repeat, available in sources}
    weights = {s: max(w, 0.0) for s, w, _, _ in sources}
    root = _Node()
    for s in sorted(caps):
        node = root
        for part in path(s):
            node = node.children.setdefault(part, _Node())
        node.weight, node.capacity = weights[s], caps[s]

    def sum_up(node: _Node) -> None:
        for child in node.children.values():
            sum_up(child)
        if node.children:
            node.weight = sum(c.weight for c in node.children.values())
            node.capacity = sum(c.capacity for c in node.children.values())

    sum_up(root)

    def leaves(node: _Node, name: str = "") -> dict[str, float]:
        if not node.children:
            return {name: getattr(node, "amount", 0.0)}
        return {k: v for n, c in node.children.items() for k, v in leaves(c, n).items()}

    if total is None:
        # parts grow in proportion to the total until the first source is full
        _pour(root, 1e-3 * min([c for c in caps.values() if c > 0], default=0.0))
        scale = [caps[s] / part for s, part in leaves(root).items() if part > 0]
        total = min(scale) * getattr(root, "amount", 0.0) if scale else 0.0
    _pour(root, min(total, root.capacity))
    return leaves(root)


def mix(counted: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The chosen (doc_id, source, epoch, n_tokens) and the budget table.

    ``counted``: doc_id, source (cleaned), n_tokens and, if there, lang; ``targets``: source,
    target_share, max_repeat.
    """
    spark = counted.sparkSession
    used = counted.select("doc_id", "source", "n_tokens").where("doc_id is not null and source is not null and n_tokens > 0").dropDuplicates(["doc_id"])
    spoken: dict[str, str] = {}
    if "lang" in counted.columns:
        by = counted.where("source is not null and lang is not null and n_tokens > 0").groupBy("source", "lang").agg(F.sum("n_tokens").alias("n"))
        most = by.join(bounded(targets.select("source").distinct(), MAX_SOURCES), "source", "left_semi").groupBy("source").agg(F.max(F.struct("n", "lang")).alias("m"))
        spoken = {r["source"]: r["m"]["lang"] for r in most.limit(MAX_SOURCES).collect()}
    have = used.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_docs"))
    table = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeat").alias("repeat"))
    rows = table.join(have, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = plan_budgets([(r["source"], r["share"] or 0.0, r["repeat"] or 0, r["available"] or 0) for r in rows], total, lambda s: source_path(s, spoken.get(s)))
    budget = spark.createDataFrame(
        [(r["source"], float(r["share"] or 0), int(r["repeat"] or 0), int(r["available"] or 0), float(plan.get(r["source"], 0.0))) for r in rows],
        "source string, target_share double, max_repeat int, available_tokens bigint, budget_tokens double",
    )
    need = budget.where("available_tokens > 0 and budget_tokens > 0").select("source", F.col("available_tokens").alias("per_epoch"), "budget_tokens")
    epochs = F.sequence(F.lit(1), F.ceil(F.col("budget_tokens") / F.col("per_epoch")).cast("int"))
    wanted = need.withColumn("epoch", F.explode(epochs)).withColumn("rest", F.col("budget_tokens") - (F.col("epoch") - 1) * F.col("per_epoch"))
    offered = used.join(bounded(wanted, MAX_SOURCES), "source").withColumn("h", F.xxhash64("doc_id", "epoch", F.lit(seed)))
    whole = offered.where("rest >= per_epoch").select("doc_id", "source", "epoch", "n_tokens")
    last = running_totals(offered.where("rest < per_epoch"), ["source", "epoch"], "h", ["doc_id"], "n_tokens")
    # the document over which the budget ends is taken if at least half of it fits
    part = last.where(F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")).select("doc_id", "source", "epoch", "n_tokens")
    return whole.unionByName(part), budget
