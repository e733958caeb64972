"""Train and validation splits of graph nodes with communities and core pruning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.contentstats import edge_bucket
from corpusloom.operators.graph import internal_edges, k_core, undirected_degrees, undirected_edges
from corpusloom.operators.joins import bounded
from corpusloom.operators.onetask import in_one_task
from corpusloom.operators.ranking import running_totals
from corpusloom.session import discard, materialize

# Bucket edges of degrees and of characters.
DEGREE_EDGES = [2, 4, 8, 16]
CHAR_EDGES = [1000, 5000, 20000]
# States of a node in label propagation.
MOVED, PUT_OFF = 1, 2
#: How far, as a share of the eligible nodes, val_community may be from its fraction.
TOLERANCE = 0.01
#: Graphs of at most so many (src, dst) rows are worked through in one task; larger ones take
#: joins in rounds, with the same result.
TASK_EDGES = 2_000_000


def eligible(nodes: DataFrame, edges: DataFrame, least: int, key: str = "id") -> DataFrame:
    """Nodes with at least ``least`` distinct neighbours; raises where there is none."""
    out = undirected_degrees(nodes, edges, key).where(F.col("degree") >= least)
    if out.isEmpty():
        raise ValueError(f"no node has {least} neighbours or more")
    return out


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def random_split(nodes: DataFrame, fraction: float, seed: int, key: str = "id") -> DataFrame:
    """The first round(fraction * n) nodes (halves to even) in seeded hash order.

    The cut is found without ranking all nodes in one task: hash prefixes are counted, the
    prefix that holds the cut is found, and only its nodes are ranked.
    """
    hashed = nodes.select(key, hash_order(F.col(key), seed).alias("_h")).withColumn("_p", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_p").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    want = round(fraction * total)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", before.alias("_before"))  # at most 4,096 rows
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) + F.col("_before")
    return hashed.join(F.broadcast(starts), "_p").withColumn("_r", rank).where(F.col("_r") <= want).select(key)


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10, key: str = "id") -> DataFrame:
    """(id, community) by label propagation to its fixpoint: each node has its neighbours' most
    frequent label, the smallest among equals.  Nodes without neighbours are communities of
    their own.

    In the first ``rounds`` rounds all nodes move at once, every second round only to smaller
    labels, so that labels don't swing.  Labels could still go round in circles that way, so
    later rounds move only nodes that come first, by a hash, among their neighbours that want
    to move.  No two neighbours then move together, and each move makes more edges join equal
    labels or, at the same number, a label smaller: the loop ends on any graph.  A node is asked
    again only when a neighbour has moved or its own move was put off.
    """
    both = materialize(undirected_edges(internal_edges(nodes, edges, key)), "lpa-edges")
    if both.count() <= TASK_EDGES:
        kind = both.schema["src"].dataType.simpleString()
        found = in_one_task(both.withColumn("hash", F.xxhash64("src")), lambda rows: _task_labels(rows, rounds), f"id {kind}, community {kind}")
        return materialize(nodes.select(F.col(key).alias("id")).join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community")), "lpa")
    return _label_rounds(nodes, both, rounds, key)


def _label_rounds(nodes: DataFrame, both: DataFrame, rounds: int, key: str) -> DataFrame:
    labels = materialize(nodes.select(F.col(key).alias("id"), F.col(key).alias("community"), F.lit(MOVED).alias("state")), "lpa")
    number = 0
    while True:
        moved = labels.where(F.col("state") == MOVED).select(F.col("id").alias("dst"))
        asked = both.join(moved, "dst", "left_semi").select("src").unionByName(labels.where(F.col("state") == PUT_OFF).select(F.col("id").alias("src"))).distinct()
        votes = both.join(asked, "src", "left_semi").join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b")).select(F.col("src").alias("id"), F.col("b.community").alias("best"))
        wish = materialize(best.join(labels.select("id", "community"), "id").where("best <> community"), "lpa-wish")
        if wish.isEmpty():
            break
        if number < rounds:
            moves = wish.select("id", "best", (F.lit(number % 2 == 0) | (F.col("best") < F.col("community"))).alias("goes"))
        else:
            turn = number % 63 + 1
            rank = F.struct(F.shiftleft(F.xxhash64("id"), turn).bitwiseOR(F.shiftrightunsigned(F.xxhash64("id"), 64 - turn)), "id")
            rivals = both.join(wish.select(F.col("id").alias("src"), rank.alias("a")), "src").join(wish.select(F.col("id").alias("dst"), rank.alias("b")), "dst")
            moves = wish.select("id", "best").join(rivals.where("b > a").select(F.col("src").alias("id"), F.lit(False).alias("goes")).distinct(), "id", "left").na.fill(True, ["goes"])
        state = F.when(F.col("goes"), MOVED).when(~F.col("goes"), PUT_OFF).otherwise(0)
        fresh = materialize(labels.join(moves, "id", "left").select("id", F.when(F.col("goes"), F.col("best")).otherwise(F.col("community")).alias("community"), state.alias("state")), "lpa")
        discard(labels)
        discard(wish)
        labels = fresh
        number += 1
    discard(both)
    return labels.select("id", "community")


def _csr(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, starts of their rows, neighbours' numbers and the rows in that order."""
    ids = np.array(sorted(rows["src"].unique()), dtype=object)
    place = pd.Series(np.arange(len(ids)), index=ids)
    src, dst = place.loc[rows["src"]].to_numpy(np.int64), place.loc[rows["dst"]].to_numpy(np.int64)
    order = np.argsort(src, kind="stable")
    return ids, np.searchsorted(src[order], np.arange(len(ids) + 1)), dst[order], order


def _around(start: np.ndarray, dst: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The asked nodes and their neighbours, pair by pair."""
    sizes = start[asked + 1] - start[asked]
    at = np.repeat(start[asked] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return np.repeat(asked, sizes), dst[at]


def _task_labels(rows: pd.DataFrame, rounds: int) -> pd.DataFrame:
    """The rounds of ``_label_rounds`` in one task."""
    ids, start, dst, order = _csr(rows)
    n = len(ids)
    hashes = rows["hash"].to_numpy(np.int64)[order][start[:-1]].view(np.uint64)
    labels = asked = np.arange(n)
    number = 0
    while True:
        node, near = _around(start, dst, asked)
        pair, votes = np.unique(node * n + labels[near], return_counts=True)
        node, label = pair // n, pair % n
        best = np.lexsort((label, -votes, node))
        node, label = node[best], label[best]
        wants = np.r_[True, node[1:] != node[:-1]][: len(node)] & (label != labels[node])
        # only a node's first row, its best label, counts
        node, label = node[wants], label[wants]
        if not len(node):
            return pd.DataFrame({"id": ids, "community": ids[labels]})
        if number < rounds:
            goes = (label < labels[node]) | (number % 2 == 0)
        else:
            turn = np.uint64(number % 63 + 1)
            rank = ((hashes << turn) | (hashes >> (np.uint64(64) - turn))).view(np.int64)
            wish = np.zeros(n, dtype=bool)
            wish[node] = True
            a, b = _around(start, dst, node)
            lost = wish[b] & ((rank[b] > rank[a]) | ((rank[b] == rank[a]) & (b > a)))
            goes = ~np.isin(node, a[lost])
        labels = labels.copy()
        labels[node[goes]] = label[goes]
        asked = np.union1d(_around(start, dst, node[goes])[1], node[~goes])
        number += 1


def bucket_profiles(nodes: DataFrame, group: str, degree: str = "degree", chars: str = "char_count") -> DataFrame:
    """Per group the numbers of nodes per degree and per character bucket."""
    d, c = edge_bucket(F.col(degree), DEGREE_EDGES), edge_bucket(F.col(chars), CHAR_EDGES)
    sums = [F.sum((d == k).cast("bigint")).alias(f"degree_{k}") for k in range(5)] + [F.sum((c == k).cast("bigint")).alias(f"chars_{k}") for k in range(4)]
    return nodes.groupBy(group).agg(F.count("*").alias("n_nodes"), *sums)


def profile_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """L1 distance of two count vectors, each scaled to sum 1."""
    total = lambda v: sum(v[1:], v[0])
    part = lambda v: [F.when(total(v) > 0, x / total(v)).otherwise(0.0) for x in v]
    gaps = [F.abs(x - y) for x, y in zip(part(a), part(b), strict=True)]
    return sum(gaps[1:], gaps[0])


def choose_profiles(kinds: np.ndarray, sizes: np.ndarray, free: np.ndarray, held: np.ndarray, total: int, everyone: int, whole: np.ndarray, fraction: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """How many communities to take of each kind, that is of each profile.

    Greedy from ``held``, the profile of the ``total`` nodes there are: the community that
    brings the joint profile nearest to the whole's is taken next, until ``fraction`` of
    ``everyone`` is reached.  One that would pass it by more than the tolerance is passed over
    once the total is within the tolerance below it.
    """
    goal, taken, open_ = whole / whole.sum(), np.zeros(len(kinds), dtype=np.int64), free > 0
    target, nearly = round(fraction * everyone), round((fraction - tolerance) * everyone)
    while total < target and open_.any():
        at = np.flatnonzero(open_)
        trial = held + kinds[at]
        best = at[np.argmin(np.abs(trial / trial.sum(axis=1, keepdims=True) - goal).sum(axis=1))]
        if (total + sizes[best]) / everyone > fraction + tolerance and total >= nearly:
            open_[best] = False  # nor will another of its kind fit, as the total only grows
            continue
        taken[best] += 1
        total += int(sizes[best])
        held = held + kinds[best]
        open_[best] = taken[best] < free[best]
    return taken


@dataclass(frozen=True)
class _Refill:
    """What the choice of communities needs, but for the nodes: communities by profile, and the
    aim."""

    kinds: np.ndarray
    sizes: np.ndarray
    free: np.ndarray
    whole: np.ndarray
    everyone: int
    fraction: float

    def next(self, done: np.ndarray, held: np.ndarray, total: int) -> np.ndarray | None:
        """Communities to take next per kind; none when the aim is reached or nothing is left."""
        if total >= (self.fraction - TOLERANCE) * self.everyone and done.any():
            return None
        taken = choose_profiles(self.kinds, self.sizes, self.free - done, held, total, self.everyone, self.whole, self.fraction)
        return taken if taken.any() else None


def _task_refill(rows: pd.DataFrame, plan: _Refill, least: int, key: str) -> pd.DataFrame:
    """Select, prune and refill in one task; rows are nodes (kind, rank, buckets) and pool edges
    (dst is not null)."""
    is_edge = rows["dst"].notna().to_numpy()
    nodes, pairs = rows[~is_edge], rows[is_edge]
    ids = pd.Index(nodes["src"])
    a, b = ids.get_indexer(pairs["src"]), ids.get_indexer(pairs["dst"])
    inside = (a >= 0) & (b >= 0) & (a != b)
    both = np.unique(np.concatenate([a[inside] * len(ids) + b[inside], b[inside] * len(ids) + a[inside]]))
    a, b = both // max(len(ids), 1), both % max(len(ids), 1)
    kind, rank, degree, chars = (nodes[c].to_numpy(np.int64) for c in ("kind", "rank", "degree", "chars"))
    alive, done = np.zeros(len(ids), dtype=bool), np.zeros(len(plan.kinds), dtype=np.int64)
    held, total = np.zeros(9, dtype=np.int64), 0
    while (taken := plan.next(done, held, total)) is not None:
        alive |= (rank > done[kind]) & (rank <= done[kind] + taken[kind])
        while (drop := alive & (np.bincount(a[alive[a] & alive[b]], minlength=len(ids)) < least)).any():
            alive &= ~drop
        held = np.concatenate([np.bincount(degree[alive], minlength=5), np.bincount(chars[alive], minlength=4)])
        total, done = int(alive.sum()), done + taken
    return pd.DataFrame({key: ids.to_numpy(object)[alive]})


def split_nodes(nodes: DataFrame, edges: DataFrame, least: int, random_fraction: float, community_fraction: float, seed: int = 0, key: str = "id") -> DataFrame:
    """(id, split): val_random by hash, val_community by whole communities whose induced
    subgraph is pruned to its ``least``-core, train for the rest of the eligible nodes.

    Communities are selected, pruned and refilled until val_community is within the tolerance
    of its fraction or no community is left.  Only distinct profiles and the numbers of
    communities that have them reach the driver; all communities compete.
    """
    ok = materialize(eligible(nodes, edges, least, key).join(nodes.select(key, "char_count"), key), "eligible")
    n = ok.count()
    rand = materialize(random_split(ok, random_fraction, seed, key), "val-random")
    left = materialize(ok.join(rand, key, "left_anti"), "left")
    pool = materialize(internal_edges(left, edges, key), "pool-edges")
    labels = label_communities(left, pool, key=key).withColumnRenamed("id", key)
    profiles = bucket_profiles(left.join(labels, key), "community")
    names = [c for c in profiles.columns if c.startswith(("degree_", "chars_"))]
    profiles = materialize(profiles.na.fill(0, names), "profiles")
    rows = profiles.groupBy("n_nodes", *names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    kinds = np.array([[r[c] for c in names] for r in rows], dtype=np.int64).reshape(-1, len(names))
    sizes, free = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("n_nodes", "n"))
    numbered = ok.sparkSession.createDataFrame([(k, *map(int, kind)) for k, kind in enumerate(kinds)], ", ".join(f"{c} bigint" for c in ["kind", *names]))
    hashed = profiles.join(bounded(numbered, 1_000_000), names).select("community", "kind", F.xxhash64("community", F.lit(seed)).alias("h"))
    ranked = running_totals(hashed, ["kind"], "h", ["community"]).select("community", "kind", (F.col("rank") + 1).alias("rank"))
    buckets = [edge_bucket(F.col("degree"), DEGREE_EDGES).cast("bigint").alias("degree"), edge_bucket(F.col("char_count"), CHAR_EDGES).cast("bigint").alias("chars")]
    members = materialize(left.join(labels, key).join(ranked, "community").select(key, "kind", "rank", *buckets), "members")

    def profile(part: DataFrame) -> tuple[int, np.ndarray]:
        row = bucket_profiles(part.withColumn("g", F.lit(1)), "g").first()
        return (row["n_nodes"], np.array([row[c] or 0 for c in names])) if row else (0, np.zeros(len(names), dtype=np.int64))

    plan = _Refill(kinds, sizes, free, profile(ok)[1], n, community_fraction)
    if 2 * pool.count() <= TASK_EDGES:
        both = members.select(F.col(key).alias("src"), F.lit(None).cast(pool.schema["dst"].dataType).alias("dst"), "kind", "rank", "degree", "chars")
        both = both.unionByName(pool.select("src", "dst"), allowMissingColumns=True)
        core = in_one_task(both, lambda rows: _task_refill(rows, plan, least, key), f"{key} {pool.schema['src'].dataType.simpleString()}")
    else:
        core, done, held, total = members.limit(0).select(key), np.zeros(len(kinds), dtype=np.int64), np.zeros(len(names), dtype=np.int64), 0
        while (taken := plan.next(done, held, total)) is not None:
            wanted = [(int(k), int(done[k]), int(done[k] + taken[k])) for k in np.flatnonzero(taken)]
            chosen = ok.sparkSession.createDataFrame(wanted, "kind bigint, _low bigint, _high bigint")
            fresh = members.join(bounded(chosen, 1_000_000), "kind").where("rank > _low and rank <= _high").select(key)
            core = materialize(k_core(core.unionByName(fresh), pool, least, key), "val-community")
            total, held = profile(left.join(core, key))
            done = done + taken
    tagged = ok.select(key).join(rand.withColumn("_r", F.lit(True)), key, "left").join(core.withColumn("_c", F.lit(True)), key, "left")
    return tagged.select(key, F.when(F.col("_r"), "val_random").when(F.col("_c"), "val_community").otherwise("train").alias("split"))


def split_stats(assigned: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Per split: nodes, internal edges, edges to train, mean and least induced degree (distinct
    neighbours within the split, oneself left out)."""
    side = lambda a, b: assigned.select(F.col(key).alias(a), F.col("split").alias(b))
    pairs = edges.select("src", "dst").distinct().join(side("src", "s"), "src").join(side("dst", "t"), "dst")
    inside = pairs.where("s = t").groupBy(F.col("s").alias("split")).agg(F.count("*").alias("internal_edges"))
    cross = pairs.where("s <> t and (s = 'train' or t = 'train')").select(F.when(F.col("s") == "train", F.col("t")).otherwise(F.col("s")).alias("split")).groupBy("split").agg(F.count("*").alias("edges_to_train"))
    degree = undirected_edges(pairs.where("s = t")).groupBy(F.col("src").alias(key)).agg(F.count("*").alias("_d"))
    nodes = assigned.select(key, "split").join(degree, key, "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
    sizes = nodes.groupBy("split").agg(F.count("*").alias("n_nodes"), F.avg("_d").alias("mean_induced_degree"), F.min("_d").alias("least_induced_degree"))
    return sizes.join(inside, "split", "left").join(cross, "split", "left").na.fill(0, ["internal_edges", "edges_to_train"])


def node_list_hash(ids: DataFrame, key: str = "id") -> DataFrame:
    """First 16 digits of the SHA-256 of the sorted, comma-joined ids of each split.

    The definition asks for one string of all ids of a split.
    """
    return ids.groupBy("split").agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(key)), ","), 256), 1, 16).alias("node_list_hash"))
