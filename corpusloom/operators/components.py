"""Connected components of a graph by randomised contraction.

In every round each node takes that one of itself and its neighbours which comes first in
a salted hash order; edges move to the nodes taken, loops and repeats go.  A constant share
of the edges is expected to vanish in a round, so all rounds together cost a few times the
first.  What is left below ``TASK_EDGES`` is finished in one task.  The rounds' tables are
then put one after the other to give each node its component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.onetask import in_one_task, undirected_labels
from corpusloom.session import discard, materialize

#: Contracted graphs of at most so many edges are finished in one task; results are the same.
TASK_EDGES = 500_000


def connected_components(edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """(id, label) for every id that occurs in ``edges`` (a, b); label is the smallest id.

    Null ends and self loops are ignored, repeated edges count once, an empty edge
    table gives an empty result.
    """
    limit = TASK_EDGES if task_edges is None else task_edges
    kept = edges.where("a is not null and b is not null and a <> b")
    work = materialize(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    kind = work.schema["a"].dataType.simpleString()
    steps: list[DataFrame] = []
    n = work.count()
    while n > limit:
        salt = F.lit(len(steps))
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b", salt)).alias("b"))
        first = F.when(F.xxhash64("b", salt) < F.xxhash64("a", salt), F.col("b")).otherwise(F.col("a"))
        step = materialize(near.select(F.col("a").alias("id"), first.alias("taken")), "cc-step")
        steps.append(step)
        moved = work.join(step.select(F.col("id").alias("a"), F.col("taken").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("taken").alias("y")), "b")
        moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        fresh = materialize(moved, "cc-edges")
        discard(work)
        work, n = fresh, fresh.count()

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        codes, ids = pd.factorize(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]))
        half = len(rows)
        return pd.DataFrame({"id": ids, "taken": ids[undirected_labels(codes[:half], codes[half:], len(ids))]})

    labels = in_one_task(work, finish, f"id {kind}, taken {kind}") if n else work.select(F.col("a").alias("id"), F.col("b").alias("taken"))
    for step in reversed(steps):
        labels = step.join(labels.select(F.col("id").alias("taken"), F.col("taken").alias("last")), "taken", "left").select("id", F.coalesce("last", "taken").alias("taken"))
    labels = materialize(labels, "cc-labels")
    least = labels.groupBy("taken").agg(F.min("id").alias("label"))
    return labels.join(least, "taken").select("id", "label")
