"""Access to the project's input tables and their common cleanings."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.files import open_system

#: Blanks and tabs, the characters that "trimmed" removes in this project's data.
TRIM_CHARS = " \t"


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """A table; with ``spread_by`` for work that is heavy per row (see ``spread``)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if spread_by is None else spread(rows, spread_by)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a file table dealt out over the cores, if the scan can't occupy them.

    A row group is read by one task.  Where a table has fewer row groups than there are cores,
    most cores would idle through work that is heavy per row, and moving the (few) rows is
    cheap against it; a table with more row groups is left alone, so large texts aren't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = rows.inputFiles()
    if len(files) >= cores:
        return rows
    try:
        groups = sum(_row_groups(f) for f in files)
    except Exception:  # noqa: BLE001 - a file system that only the JVM reads
        return rows
    return rows if groups >= cores else rows.repartition(cores, key)


def _row_groups(file: str) -> int:
    system, path = open_system(unquote(file))
    with system.open_input_file(path) as found:
        return pq.ParquetFile(found).num_row_groups


def trimmed(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(col, F.lit(TRIM_CHARS))


def cleaned_split(col: Column | str) -> Column:
    """Trimmed, lower case, ``-`` read as ``_``; empty becomes null."""
    text = F.regexp_replace(F.lower(trimmed(col)), "-", "_")
    return F.when(text != "", text)


def valid_lines(graph: DataFrame, *columns: str) -> DataFrame:
    """The valid line of each node: the highest ``line_no`` per trimmed identifier.

    Lines with a null identifier stand for no node and are left out.  Ties on
    ``line_no`` (repeated rows) give one of the equal lines.  ``max_by`` over a
    struct keeps the aggregation map-side combinable, so that an identifier with
    very many lines doesn't pile up in one task.
    """
    ident = trimmed("normed_identifier")
    wanted = [c for c in columns if c not in ("normed_identifier", "line_no")]
    body = F.struct("line_no", *wanted)
    out = (
        graph.where(F.col("normed_identifier").isNotNull())
        .groupBy(ident.alias("normed_identifier"))
        .agg(F.max_by(body, F.struct("line_no", F.xxhash64(*[c for c in wanted if c]) if wanted else F.lit(0))).alias("b"))
    )
    return out.select("normed_identifier", "b.*")


def latest_files(files: DataFrame, **columns: Column) -> DataFrame:
    """One row per ``file_id`` with the given columns of the delivery loaded last.

    The columns are computed in the scan, before rows meet: ask for what is derived from a
    text (statistics, imports, a signature), not for the text, and no text is shuffled.
    """
    rank = F.coalesce(F.col("loaded_at"), F.lit("1970-01-01").cast("timestamp")).alias("_rank")
    narrow = files.where(F.col("file_id").isNotNull()).select("file_id", rank, F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_b"))
    return narrow.groupBy("file_id").agg(F.max_by("_b", "_rank").alias("_b")).select("file_id", "_b.*")
