"""Splits that keep related records together.

Components of the reference graph are weighed by their number of records and balanced
over many equal bins by largest differencing (k-way Karmarkar-Karp); whole bins are then
given to the splits.  The driver sees only the histogram of component sizes, which has at
most about sqrt(2 n) rows for n records, never the components.

Defined results: null and unknown references join nothing; a record without references is
a component of its own; repeated rows count once; an empty table gives empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import running_totals
from corpusloom.operators.components import connected_components
from corpusloom.operators.joins import bounded


def group_members(nodes: DataFrame, refs: DataFrame, key: str = "normed_identifier", id_col: str = "node_id") -> DataFrame:
    """(node_id, group_id) of every node; references are (node_id, target key)."""
    ids = nodes.select(F.col(key).alias("target"), F.col(id_col).alias("b"))
    edges = refs.select(F.col(id_col).alias("a"), "target").join(ids, "target").select("a", "b")
    labels = connected_components(edges)
    return (
        nodes.select(id_col)
        .join(labels, F.col(id_col) == F.col("id"), "left")
        .select(id_col, F.coalesce("label", id_col).alias("group_id"))
    )


def mixed_groups(members: DataFrame, splits: DataFrame) -> DataFrame:
    """Members of groups whose records carry two or more different splits."""
    members = members.select("group_id", "node_id")
    tagged = members.join(splits.select("node_id", "split"), "node_id", "left")
    mixed = tagged.groupBy("group_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("group_id")
    return members.join(mixed, "group_id", "left_semi")


def differencing(weights: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """Largest differencing over ``bins`` subsets.

    ``weights`` are (weight, item) pairs.  Each heap entry is a partial solution of
    ``bins`` subsets; the two with the largest spread are combined, largest subset of
    one with smallest of the other, until one solution remains.  An item that has not been
    combined yet is kept as its weight alone, so memory grows with the items, not with
    items times bins.
    """

    def subsets(entry: tuple) -> tuple[list[int], list]:
        if len(entry) == 4:
            return entry[2], entry[3]
        weight, item = -entry[0], entry[2]
        return [0] * (bins - 1) + [weight], [None] * (bins - 1) + [((weight, item), None, None)]

    heap: list[tuple] = [(-weight, tick, item) for tick, (weight, item) in enumerate(weights)]
    heapq.heapify(heap)
    tick = len(weights)
    while len(heap) > 1:
        sums_a, sets_a = subsets(heapq.heappop(heap))
        sums_b, sets_b = subsets(heapq.heappop(heap))
        merged = []
        for k in range(bins):
            a, b = sets_a[k], sets_b[bins - 1 - k]
            node = a if b is None else b if a is None else (None, a, b)
            merged.append((sums_a[k] + sums_b[bins - 1 - k], k, node))
        merged.sort(key=lambda m: m[:2])
        low = merged[0][0]
        tick += 1
        heapq.heappush(heap, (-(merged[-1][0] - low), tick, [m[0] for m in merged], [m[2] for m in merged]))
    out: list[list[tuple[int, int]]] = []
    for tree in subsets(heap[0])[1] if heap else [None] * bins:
        items, stack = [], [tree] if tree else []
        while stack:
            leaf, a, b = stack.pop()
            if leaf is not None:
                items.append(leaf)
            else:
                stack += [a, b]
        out.append(items)
    return out


def plan_bins(histogram: Mapping[int, int], shares: Mapping[str, float], bins: int = 50) -> tuple[dict[tuple[int, int], str], dict[int, int], list[str]]:
    """Give every component a bin and every bin a split.

    Of each weight's components, equal numbers go to every bin; the rest (fewer than
    ``bins`` per weight) are balanced by differencing.  Returns the split of each rest
    item (weight, number), the number dealt evenly per weight and bin, and the bins' splits.
    """
    even = {w: n // bins for w, n in histogram.items()}
    rest = [(w, j) for w, n in histogram.items() for j in range(n % bins)]
    subsets = differencing(rest, bins)
    base = sum(w * n for w, n in even.items())
    loads = [base + sum(w for w, _ in s) for s in subsets]
    total = sum(loads)
    need = {s: share * total for s, share in shares.items()}
    owner = [""] * bins
    for k in sorted(range(bins), key=lambda k: -loads[k]):
        best = max(need, key=lambda s: (need[s] / (shares[s] or 1e-9) if loads[k] > 0 else need[s], s) if need[s] >= loads[k] else (need[s] - 1e18, s))
        owner[k] = best
        need[best] -= loads[k]
    _exchange(owner, loads, {s: share * total for s, share in shares.items()})
    item_split = {item: owner[k] for k, s in enumerate(subsets) for item in s}
    return item_split, even, owner


def _exchange(owner: list[str], loads: list[int], target: Mapping[str, float]) -> None:
    """Move or swap whole bins between splits while that brings the totals nearer."""
    held = {s: float(sum(w for w, o in zip(loads, owner, strict=True) if o == s)) for s in target}

    def off(a: str, b: str, shift: float) -> float:
        return abs(held[a] - shift - target[a]) + abs(held[b] + shift - target[b]) - abs(held[a] - target[a]) - abs(held[b] - target[b])

    while True:
        moves = [(off(owner[i], s, loads[i]), i, -1, s) for i in range(len(owner)) for s in target if s != owner[i]]
        swaps = [(off(owner[i], owner[j], loads[i] - loads[j]), i, j, owner[j]) for i in range(len(owner)) for j in range(len(owner)) if owner[i] != owner[j]]
        best = min(moves + swaps, default=(0.0, 0, 0, ""))
        if best[0] >= -1e-9:
            return
        _, i, j, to = best
        held[owner[i]] -= loads[i] - (loads[j] if j >= 0 else 0)
        held[to] += loads[i] - (loads[j] if j >= 0 else 0)
        if j >= 0:
            owner[j] = owner[i]
        owner[i] = to


def assign_splits(members: DataFrame, shares: Mapping[str, float], seed: int = 13, bins: int = 50) -> DataFrame:
    """(node_id, group_id, split) with whole groups per split, near the target shares."""
    spark = members.sparkSession
    members = members.select("node_id", "group_id")
    groups = members.groupBy("group_id").agg(F.count("*").alias("weight")).withColumn("h", F.xxhash64("group_id", F.lit(seed)))
    histogram = {int(r["weight"]): int(r["n"]) for r in groups.groupBy("weight").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return members.withColumn("split", F.lit(None).cast("string"))
    item_split, even, owner = plan_bins(histogram, shares, bins)
    rest = spark.createDataFrame([(w, even[w] * bins + j, s) for (w, j), s in item_split.items()] or [(-1, -1, "")], "weight bigint, rank bigint, rest_split string")
    ranked = running_totals(groups, ["weight"], "h", ["group_id"])
    dealt = F.element_at(F.array(*[F.lit(s) for s in owner]), (F.pmod("rank", F.lit(bins)) + 1).cast("int"))
    placed = ranked.join(bounded(rest, 200_000), ["weight", "rank"], "left").select("group_id", F.coalesce("rest_split", dealt).alias("split"))
    return members.join(placed, "group_id")
