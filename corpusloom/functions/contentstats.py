"""Content statistics as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1))


def _without_last_end(text: Column) -> Column:
    """The text with line feeds as its only line ends and no final one."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", "")


def line_lengths(text: Column) -> Column:
    """Lengths of the lines; a final line end opens no line, an empty text has none."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(_without_last_end(text), "\n"), F.length))


def longest_line(text: Column) -> Column:
    return F.coalesce(F.array_max(line_lengths(text)), F.lit(0))


def line_summary(text: Column) -> Column:
    """(n, total, longest) of the lines: their number, all their characters, the longest."""
    bare = _without_last_end(text)
    ends = F.length(bare) - F.length(F.replace(bare, F.lit("\n"), F.lit("")))
    n = F.when(text == "", 0).otherwise(ends + 1).cast("bigint")
    return F.struct(n.alias("n"), (F.length(bare) - ends).cast("bigint").alias("total"), longest_line(text).cast("bigint").alias("longest"))


def non_alnum_ratio(text: Column) -> Column:
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(1 - kept / F.length(text))


def content_signature(text: Column) -> Column:
    """Signature of the first 4,096 characters, white space squeezed after the cut; empty for
    an empty text (md5 in place of a 64-bit BLAKE2 digest, which Spark lacks; equal texts agree
    under either)."""
    prefix = F.substring(text, 1, 4096)
    return F.when(text == "", "").otherwise(F.md5(F.trim(F.regexp_replace(prefix, r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "))))


def pow2_low(n: Column) -> Column:
    """Lower bound of the power-of-two bucket of a count: 0, 1, 2, 4, ..."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.pow(F.lit(2), F.length(F.bin(n)) - 1)).cast("bigint")


def pow2_label(n: Column) -> Column:
    low = pow2_low(n)
    return F.when(low == 0, F.lit("0")).otherwise(F.concat(low.cast("string"), F.lit("-"), (low * 2 - 1).cast("string")))


def edge_bucket(value: Column, edges: list[int]) -> Column:
    """Index of the first edge above the value, or the number of edges."""
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(value < edges[k], k).otherwise(out)
    return out


def histogram_quantiles(histogram: DataFrame, quantiles: Sequence[float], low: str = "low", n: str = "n") -> DataFrame:
    """(q, low): the first bucket at which the running share reaches each quantile.

    The histogram has one row per bucket, so the running sum is over a small table.
    """
    running = histogram.select(F.col(low).alias("low"), F.sum(n).over(Window.orderBy(low)).alias("_cum"), F.sum(n).over(Window.partitionBy()).alias("_total"))
    asked = F.explode(F.array(*[F.lit(q).cast("double") for q in quantiles])).alias("q")
    return running.select("low", "_cum", "_total", asked).where(F.col("_cum") >= F.col("_total") * F.col("q")).groupBy("q").agg(F.min("low").alias("low"))
