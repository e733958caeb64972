"""Writers of articles, graphs, statistics and splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.files import open_system, write_file, write_json


def write_markdown_files(docs: DataFrame, folder: str) -> int:
    """``<LETTER>/<normed_identifier>.md`` with the body and the raw identifier as last line.

    For tools that want files; the table form is ``write_articles``.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for frame in frames:
            for name, raw, body in zip(frame["normed_identifier"], frame["raw_identifier"], frame["body"], strict=True):
                first = name[:1].upper() if name[:1].isalnum() else "_"
                write_file(folder, f"{first}/{name}.md", f"{body}\n{raw}".encode())
                n += 1
        yield pd.DataFrame({"n": [n]})

    system, base = open_system(folder)
    system.create_dir(base, recursive=True)
    rows = docs.select("normed_identifier", "raw_identifier", "body").mapInPandas(write, "n bigint")
    return int(rows.agg(F.sum("n")).first()[0] or 0)


def first_letter(identifier: str = "normed_identifier") -> Column:
    letter = F.upper(F.substring(F.col(identifier), 1, 1))
    return F.when(F.regexp_like(letter, F.lit("[A-Z0-9]")), letter).otherwise("_")


def write_articles(docs: DataFrame, path: str) -> None:
    docs.withColumn("letter", first_letter()).write.mode("overwrite").partitionBy("letter").parquet(path)


def write_graph(nodes: DataFrame, path: str, key: str = "normed_identifier") -> None:
    """Sorted JSON lines; a range shuffle keeps the parts in order."""
    nodes.orderBy(key).select(F.to_json(F.struct(*sorted(nodes.columns))).alias("value")).write.mode("overwrite").text(path)


def splits_document(assigned: DataFrame, path: str, parameters: dict, key: str = "id") -> None:
    """The splits document: parameters and, per split, count, fraction and ids."""
    total = assigned.count()
    rows = assigned.groupBy("split").agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("ids"))
    doc = {"parameters": parameters, "splits": {r["split"]: {"count": len(r["ids"]), "fraction": round(len(r["ids"]) / max(total, 1), 6), "ids": r["ids"]} for r in rows.toLocalIterator()}}
    folder, _, name = path.rpartition("/")
    write_json(folder or ".", name, doc)


def degree_histogram(degrees: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n): equal-width histogram of a degree column."""
    top = degrees.agg(F.max(column)).first()[0] or 0
    width = max(top, 1) / bins
    at = F.least(F.floor(F.col(column) / width), F.lit(bins - 1))
    return degrees.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn("low", F.col("bin") * width).withColumn("high", (F.col("bin") + 1) * width)
