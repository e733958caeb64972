"""Ranks and running sums within groups of any size.

A plain window over one hot group sorts that group in a single task.  Here a group is
first cut into ``buckets`` ranges of an order hash; the ranges' totals are prefix-summed
on a small table and only the rows within a range are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, groups: Sequence[str], order_hash: str, ties: Sequence[str], size: str | None = None, buckets: int = 512) -> DataFrame:
    """Adds ``rank`` (from 0) and, with ``size``, ``before``: the sum of ``size`` over earlier rows.

    Rows are ordered by the bigint ``order_hash`` and then ``ties``.  Nulls in ``size``
    count as 0.  An empty table stays empty.
    """
    value = F.coalesce(F.col(size), F.lit(0)).cast("bigint") if size else F.lit(0).cast("bigint")
    # bigint range cut into equal pieces by its high bits, in order
    shift = 64 - (buckets.bit_length() - 1)
    cut = df.withColumn("_bucket", F.shiftright(F.col(order_hash), shift)).withColumn("_size", value)
    totals = cut.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    ahead = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rank0"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before0"))
    inner = Window.partitionBy(*groups, "_bucket").orderBy(order_hash, *ties)
    sums = inner.rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_r", F.row_number().over(inner) - 1).withColumn("_b", F.coalesce(F.sum("_size").over(sums), F.lit(0)))
    on = [placed[c].eqNullSafe(starts[c]) for c in (*groups, "_bucket")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    out = placed.join(starts, condition)
    columns = [placed[c] for c in df.columns]
    columns.append((placed["_r"] + starts["_rank0"]).alias("rank"))
    if size:
        columns.append((placed["_b"] + starts["_before0"]).alias("before"))
    return out.select(*columns)
