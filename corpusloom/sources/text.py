"""Readers of article dumps, code rows, Markdown folders and graph files."""

from __future__ import annotations

import bz2
import gzip
import re
import shutil
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions.identifiers import normalize_repository
from corpusloom.operators.graph import last_lines

#: Characters a downloaded sample keeps of a file, and what marks a cut.
SAMPLE_CHARS = 50_000
CUT_MARK = "...[truncated]"


def read_articles(spark: SparkSession, path: str | Sequence[str], limit: int | None = None) -> DataFrame:
    """Articles of the main namespace with a source text; rows that don't parse are left out.

    Folders are searched for ``*.json.gz`` at any depth.  ``limit`` is the number of articles
    taken from each of the paths.
    """
    if limit is not None and not isinstance(path, str):
        parts = [read_articles(spark, one, limit) for one in path]
        return reduce(DataFrame.unionByName, parts)
    rows = spark.read.schema(schemas.ARTICLE).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(path)
    kept = rows.where("namespace = 0 and source_text is not null").withColumn("page_id", F.coalesce("page_id", F.lit(0)))
    return kept.limit(limit) if limit is not None else kept


def first_article(articles: DataFrame, title: str | None = None) -> DataFrame:
    found = articles.where("title is not null and source_text is not null")
    return (found.where(F.col("title") == title) if title is not None else found).limit(1)


def read_stack_rows(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(schemas.STACK_ROW).option("mode", "DROPMALFORMED").json(path)


def stack_documents(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(normed_identifier, content) of rows with repository, path and content; with ``ids``
    only those listed.  Repeated rows stay."""
    kept = rows.where("max_stars_repo_name <> '' and max_stars_repo_path <> '' and content <> ''")
    docs = kept.select(F.concat(normalize_repository("max_stars_repo_name"), F.lit(":"), F.col("max_stars_repo_path")).alias("normed_identifier"), "content")
    return docs.join(ids.select("normed_identifier"), "normed_identifier", "left_semi") if ids is not None else docs


def truncated_sample(rows: DataFrame, limit: int | None = None, chars: int = SAMPLE_CHARS, content: str = "content") -> DataFrame:
    """Rows with contents cut to ``chars`` characters and a mark where one was cut."""
    cut = F.when(F.length(content) > chars, F.concat(F.substring(F.col(content), 1, chars), F.lit(CUT_MARK))).otherwise(F.col(content))
    out = rows.withColumn(content, cut)
    return out.limit(limit) if limit is not None else out


def split_markdown(value: Column) -> tuple[Column, Column]:
    """Body and raw identifier of a Markdown file, whose last line is the identifier."""
    return F.regexp_replace(value, r"(?s)\n?[^\n]*\z", ""), F.regexp_extract(value, r"([^\n]*)\z", 1)


def read_markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """(normed_identifier, raw_identifier, content) of all ``*.md`` files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    body, raw = split_markdown(F.col("value"))
    return files.select(F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]*)\.md$", 1)).alias("normed_identifier"), raw.alias("raw_identifier"), body.alias("content"))


def read_graph(spark: SparkSession, path: str, schema: str = schemas.TOKENIZED_NODE) -> DataFrame:
    """Nodes of a graph file, one per identifier: the last line wins.

    Line order within a file is that of the reading; a file is split at line ends, so the
    order key is the monotonically increasing id of the scan.
    """
    rows = spark.read.schema(schema).json(path).withColumn("_line", F.monotonically_increasing_id())
    return last_lines(rows, "normed_identifier", "_line").drop("_line")


def checked_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose token columns are all there; the first node that lacks one raises by name."""
    out = nodes
    for column in ("tok_shard_idx", "tok_offset_bytes", "tok_len"):
        message = F.concat(F.lit("node "), F.coalesce("normed_identifier", F.lit("?")), F.lit(f" has no integer {column}"))
        out = out.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(message).cast("bigint")).otherwise(F.col(column)))
    return out


def split_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(normed_identifier, split) of a splits document."""
    doc = spark.read.schema(schemas.SPLITS).option("multiLine", "true").json(path)
    return doc.select(F.explode("splits").alias("split", "s")).select(F.explode("s.ids").alias("normed_identifier"), "split")


def latest_dump(listing: Column) -> Column:
    """Latest ``YYYYMMDD`` among the links of a directory listing."""
    names = F.transform(F.regexp_extract_all(listing, F.lit('href="([^"]*)"'), 1), lambda x: F.btrim(x, F.lit("/")))
    return F.array_max(F.filter(names, lambda x: F.regexp_like(x, F.lit(r"^\d{8}$"))))


def dump_parts(listing: Column, pattern: str = r"\.json\.(?:gz|bz2)$") -> Column:
    """Names of dump parts in a directory listing, sorted."""
    return F.sort_array(F.filter(F.regexp_extract_all(listing, F.lit('href="([^"]*)"'), 1), lambda x: F.regexp_like(x, F.lit(pattern))))


def recompress(sources: Sequence[str], target: str) -> None:
    """Join bz2 or gzip parts of a dump into one gzip file, streaming."""
    with gzip.open(target, "wb") as out:
        for source in sources:
            with (bz2.open if re.search(r"\.bz2$", source) else gzip.open)(source, "rb") as part:
                shutil.copyfileobj(part, out)
