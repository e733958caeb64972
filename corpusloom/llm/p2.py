"""Queries of problem 2: credentials embedded in source code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.credentials import MASK, credential_spans, find_spans, redact, trained_field
from corpusloom.llm.crf import ChainField
from corpusloom.session import materialize
from corpusloom.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return credential_spans(table(spark, d, "stack_file", "file_id")).where("begins").select("file_id", "line_no").distinct()


def p2_redact(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the table with its credential values masked and their number added.

    Rows stay what they are, repeated deliveries included, so no content is shuffled.
    """
    model = trained_field()
    shared = spark.sparkContext.broadcast((model.weights, model.moves))

    @F.pandas_udf("struct<content: string, n_spans: int>")
    def masked(texts: pd.Series) -> pd.DataFrame:
        field, cache = ChainField(*shared.value), {}
        rows = []
        for text in texts:
            spans = find_spans(text, field, cache) if text else []
            rows.append((redact(text, [(s, e) for _, s, e, _ in spans]) if spans else text, len(spans)))
        return pd.DataFrame(rows, columns=["content", "n_spans"])

    files = table(spark, d, "stack_file", "file_id")
    return files.withColumn("_m", masked("content")).withColumn("content", F.col("_m.content")).withColumn("n_spans", F.col("_m.n_spans")).drop("_m")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of file (extension): files with credentials and their lines."""
    files = table(spark, d, "stack_file").select("file_id", F.lower(F.regexp_extract("max_stars_repo_path", r"\.([^./]+)$", 1)).alias("extension")).groupBy("file_id").agg(F.max("extension").alias("extension"))
    return p2_found(spark, d).join(files, "file_id", "left").groupBy("extension").agg(F.countDistinct("file_id").alias("n_files"), F.count("*").alias("n_lines"))


def p2_redacted_rows(spark: SparkSession, d: str) -> DataFrame:
    """What any right redaction has in common: all rows, rows without a credential unchanged,
    changed ones with as many lines and quotes as before, and none left in what comes out."""
    marks = (F.length("content") - F.length(F.translate("content", "\n\r\"'", ""))).alias("marks")
    whole = F.xxhash64("content").alias("h")
    keys = [F.coalesce("file_id", F.lit(-1)).alias("file_id"), F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp")).alias("loaded_at")]
    raw = table(spark, d, "stack_file").select(*keys, marks, whole).distinct()
    # only what is compared is kept: texts of changed rows, numbers of the others
    kept = F.when(F.col("n_spans") > 0, F.col("content")).alias("content")
    done = materialize(p2_redact(spark, d).select(*keys, "n_spans", marks, whole, kept), "redacted")
    # a key block is still seen by its marker; between the markers nothing but masks may be left
    spans = credential_spans(done.where("n_spans > 0")).join(done.select("file_id", "content").distinct(), "file_id")
    text = F.expr("substring(content, start + 1, end - start)")
    left = spans.where(F.regexp_like(F.regexp_replace(F.replace(text, F.lit(MASK), F.lit("")), r"\\[nrt]", ""), F.lit("[A-Za-z0-9]"))).select("file_id").distinct()
    same = done.where("n_spans = 0").join(raw, ["file_id", "loaded_at", "h"], "left_semi").count()
    torn = done.where("n_spans > 0").join(raw, ["file_id", "loaded_at", "marks"], "left_anti").count()
    again = done.where("n_spans > 0").join(left, "file_id", "left_semi").count()
    return done.agg(F.count("*").alias("n_rows"), (F.sum((F.col("n_spans") == 0).cast("bigint")) - F.lit(same)).alias("n_changed_without_need")).select(
        "n_rows", "n_changed_without_need", F.lit(torn).cast("bigint").alias("n_torn"), F.lit(again).cast("bigint").alias("n_still_found")
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_redact, p2_redacted_rows, p2_report)}
ORACLES: dict[str, str] = {
    "p2_redacted_rows": "select count(*) as n_rows, 0 as n_changed_without_need, 0 as n_torn, 0 as n_still_found from stack_file",
}
