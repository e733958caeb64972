"""Document graphs: nodes with adjacency lists, edges, degrees, reachability."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.onetask import in_one_task, strong_labels
from corpusloom.session import discard, materialize

#: Strong components of so few edges are found in one task; larger graphs take rounds of joins.
TASK_EDGES = 1_000_000


def last_lines(rows: DataFrame, key: str, line: str) -> DataFrame:
    """One row per key, the one of the highest line: later lines replace earlier ones."""
    w = Window.partitionBy(key).orderBy(F.col(line).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def adjacency(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Nodes with sorted distinct ``outgoing`` and ``incoming``.

    Targets without a node stay in ``outgoing``; ``incoming`` lists only what is reversed
    onto existing nodes; nodes without edges stay.
    """
    ids = nodes.select(key)
    pairs = edges.select("src", "dst").distinct().join(ids.select(F.col(key).alias("src")), "src")
    out = pairs.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("outgoing"))
    back = pairs.join(ids.select(F.col(key).alias("dst")), "dst", "left_semi").groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("incoming"))
    none = F.array().cast("array<string>")
    return (
        nodes.join(out.withColumnRenamed("src", key), key, "left").join(back.withColumnRenamed("dst", key), key, "left")
        .withColumn("outgoing", F.coalesce(F.col("outgoing").cast("array<string>"), none)).withColumn("incoming", F.coalesce(F.col("incoming").cast("array<string>"), none))
    )


def neighbours(nodes: DataFrame, field: str, key: str = "id") -> DataFrame:
    """(key, pos, neighbour): listed neighbours that are nodes, in list order, repeats kept."""
    listed = nodes.select(key, F.posexplode(field).alias("pos", "neighbour"))
    return listed.join(nodes.select(F.col(key).alias("neighbour")), "neighbour", "left_semi").select(key, "pos", "neighbour")


def internal_edges(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    ids = nodes.select(key)
    return edges.select("src", "dst").distinct().join(ids.select(F.col(key).alias("src")), "src", "left_semi").join(ids.select(F.col(key).alias("dst")), "dst", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Out- and in-degree of every node over internal edges."""
    inner = internal_edges(nodes, edges, key)
    out = inner.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("out_degree"))
    back = inner.groupBy(F.col("dst").alias(key)).agg(F.count("*").alias("in_degree"))
    return nodes.select(key).join(out, key, "left").join(back, key, "left").na.fill(0, ["out_degree", "in_degree"])


def undirected_edges(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def undirected_degrees(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Distinct neighbours among the nodes, in either direction, oneself left out."""
    inner = undirected_edges(internal_edges(nodes, edges, key))
    return nodes.select(key).join(inner.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("degree")), key, "left").na.fill(0, ["degree"])


def k_core(nodes: DataFrame, edges: DataFrame, least: int, key: str = "id", rounds: int | None = None) -> DataFrame:
    """Nodes left when all of induced degree under ``least`` are removed again and again.

    Only edges travel through the loop; each round is a table in the shared folder.
    ``rounds`` bounds the loop where a fixed number of rounds is wanted.
    """
    alive = materialize(undirected_edges(internal_edges(nodes, edges, key)), "core-edges")
    n, done = alive.count(), 0
    while rounds is None or done < rounds:
        keep = alive.groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") >= least).select("src")
        fresh = materialize(alive.join(keep, "src", "left_semi").join(keep.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"), "core-edges")
        done += 1
        m = fresh.count()
        discard(alive)
        alive = fresh
        if m == n:
            break
        n = m
    if rounds is None:
        return alive.select(F.col("src").alias(key)).distinct()
    return alive.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("degree"))


def bfs_levels(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, level): least number of steps from any seed; frontier joins without revisits.

    Each level is a table of its own; the levels before are only read to leave out what they
    hold, and merged now and then to keep plans short.
    """
    steps = materialize(edges.select("src", "dst").distinct(), "bfs-edges")
    frontier = materialize(seeds.select("id").distinct().withColumn("level", F.lit(0)), "bfs")
    parts, level = [frontier], 0
    while depth is None or level < depth:
        level += 1
        fresh = steps.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        for part in parts:
            fresh = fresh.join(part.select("id"), "id", "left_anti")
        frontier = materialize(fresh.withColumn("level", F.lit(level)), "bfs")
        if frontier.isEmpty():
            discard(frontier)
            break
        parts.append(frontier)
        if len(parts) > 6:
            merged = materialize(reduce(DataFrame.unionByName, parts[:-1]), "bfs")
            for part in parts[:-1]:
                discard(part)
            parts = [merged, frontier]
    discard(steps)
    return reduce(DataFrame.unionByName, parts)


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, label) of strongly connected components.

    Graphs of more than ``task_edges`` edges are taken apart by forward colouring: every node
    takes the colour that comes first, in a hash order salted by the round, among those that
    reach it; from the nodes coloured by themselves those of their colour that reach back form
    a component, which is removed.  The salt keeps chains of components from giving up only one
    in each round.  Rounds go on until no edge is left or one task can finish the rest.  Nodes
    without both kinds of edges are components of their own.  The label is the largest id.
    """
    pairs = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    work = materialize(pairs.where("src <> dst"), "scc-edges")
    kind = work.schema["src"].dataType.simpleString()
    parts: list[DataFrame] = []
    number = 0

    def replace(fresh: DataFrame, old: DataFrame) -> DataFrame:
        discard(old)
        return fresh

    while (n := work.count()) > task_edges:
        number += 1
        while True:  # nodes on a cycle have edges in and out
            kept = work.join(work.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(work.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            work, before, n = replace(materialize(kept, "scc-edges"), work), n, 0
            n = work.count()
            if n > 0.9 * before:
                break
        if n <= task_edges:
            continue
        ids = work.select(F.col("src").alias("id")).unionByName(work.select(F.col("dst").alias("id"))).distinct()
        colour = materialize(ids.select("id", F.struct(F.xxhash64("id", F.lit(number)).alias("h"), "id").alias("c"), F.lit(True).alias("fresh")), "scc-colour")
        while True:
            pushed = work.join(colour.where("fresh").select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("m"))
            better = F.coalesce(F.col("m") > F.col("c"), F.lit(False))
            fresh = colour.join(pushed, "id", "left").select("id", F.when(better, F.col("m")).otherwise(F.col("c")).alias("c"), better.alias("fresh"))
            colour = replace(materialize(fresh, "scc-colour"), colour)
            if colour.where("fresh").isEmpty():
                break
        colours = colour.select("id", F.col("c.id").alias("c"))
        reached = materialize(colours.where("id = c").withColumn("step", F.lit(0)), "scc-reach")
        step = 0
        while True:
            back = work.join(reached.where(F.col("step") == step).select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c")
            fresh = back.join(colours, ["id", "c"], "left_semi").distinct().join(reached, ["id", "c"], "left_anti").select("id", "c", F.lit(step + 1).alias("step"))
            fresh = materialize(fresh, "scc-new")
            if fresh.isEmpty():
                discard(fresh)
                break
            both = materialize(reached.unionByName(fresh), "scc-reach")
            discard(fresh)
            reached, step = replace(both, reached), step + 1
        parts.append(reached.select("id", F.col("c").alias("root")))
        gone = reached.select("id")
        work = replace(materialize(work.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc-edges"), work)
        discard(colour)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        codes, ids = pd.factorize(np.concatenate([rows["src"].to_numpy(), rows["dst"].to_numpy()]))
        return pd.DataFrame({"id": ids, "root": ids[strong_labels(codes[: len(rows)], codes[len(rows) :], len(ids))]})

    parts.append(in_one_task(work, finish, f"id {kind}, root {kind}"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = materialize(found, "scc-found")
    every = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    largest = found.groupBy("root").agg(F.max("id").alias("label"))
    return every.join(found.join(largest, "root"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
