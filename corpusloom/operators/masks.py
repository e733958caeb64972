"""Attention masks as predicates and link grants as intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doc_causal(q: Column, kv: Column, q_doc: Column, kv_doc: Column) -> Column:
    return (q >= kv) & (q_doc == kv_doc)


def causal(q: Column, kv: Column, q_doc: Column, kv_doc: Column) -> Column:
    return q >= kv


def full(q: Column, kv: Column, q_doc: Column, kv_doc: Column) -> Column:
    return F.lit(True)


def doc_bidirectional(q: Column, kv: Column, q_doc: Column, kv_doc: Column) -> Column:
    return q_doc == kv_doc


MASKS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {f.__name__: f for f in (doc_causal, causal, full, doc_bidirectional)}


def mask(name: str) -> Callable[[Column, Column, Column, Column], Column]:
    if name not in MASKS:
        raise ValueError(f"unknown mask {name!r}; known: {', '.join(sorted(MASKS))}")
    return MASKS[name]


def allowed_pairs(spans: DataFrame, length: Column) -> DataFrame:
    """Allowed (query, key) pairs per pack and mask in closed form, without positions.

    ``spans``: pack_id, span_start, span_end; ``length``: tokens per pack.  Positions outside
    all spans count as one document.
    """
    n = F.col("span_end") - F.col("span_start")
    per = spans.groupBy("pack_id").agg(F.max(length).alias("t"), F.sum(n * (n + 1) / 2).alias("tri"), F.sum(n * n).alias("sq"), F.sum(n).alias("covered"))
    gap = F.col("t") - F.col("covered")
    return per.select(
        "pack_id", F.col("t").alias("length"), (F.col("tri") + gap * (gap + 1) / 2).cast("bigint").alias("doc_causal"), (F.col("t") * (F.col("t") + 1) / 2).cast("bigint").alias("causal"),
        (F.col("t") * F.col("t")).cast("bigint").alias("full_pairs"), (F.col("sq") + gap * gap).cast("bigint").alias("doc_bidirectional"),
    )


def match_links(links: DataFrame, spans: DataFrame) -> DataFrame:
    """Links whose target is a document of the same pack that starts before the link's end.

    Of several spans with one key the last wins.
    """
    w = Window.partitionBy("pack_id", "key").orderBy(F.col("span_start").desc())
    index = spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("pack_id", F.col("key").alias("target"), F.col("doc_id").alias("target_id"), F.col("span_start").alias("target_start"), F.col("span_end").alias("target_end"))
    return links.join(index, ["pack_id", "target"]).where(F.col("target_start") < F.col("link_end"))


def grants(matched: DataFrame, spans: DataFrame, length: Column) -> DataFrame:
    """Rectangles of granted attention: queries from the link's end to the end of the linking
    document, keys of the target, cut to the sequence; empty rectangles are left out.

    ``grant_idx`` numbers a pack's grants by link position.
    """
    own = spans.select("pack_id", F.col("doc_id").alias("source_id"), F.col("span_start").alias("s0"), F.col("span_end").alias("s1"))
    rows = matched.join(own, "pack_id").where((F.col("s0") < F.col("link_end")) & (F.col("link_end") <= F.col("s1")))
    cut = rows.select(
        "pack_id", "link_end", "source_id", "target_id", F.col("link_end").alias("q_start"), F.least("s1", length).alias("q_end"), F.col("target_start").alias("kv_start"), F.least("target_end", length).alias("kv_end")
    ).where("q_start < q_end and kv_start < kv_end")
    w = Window.partitionBy("pack_id").orderBy("link_end", "target_id", "source_id")
    return cut.withColumn("grant_idx", F.row_number().over(w) - 1)


def linked_pairs(spans: DataFrame, granted: DataFrame, length: Column) -> DataFrame:
    """Allowed pairs per pack under the linked mask (causal, and same document or granted), in
    closed form; ``granted`` are the rectangles of ``grants``.

    Spans don't overlap, so rectangles of different documents are apart, and those of the same
    two documents lie within that of the first link.  A grant within a document adds nothing.
    """
    apart = granted.where("source_id <> target_id").groupBy("pack_id", "source_id", "target_id", "q_end", "kv_start", "kv_end").agg(F.min("q_start").alias("q_start"))
    area = apart.groupBy("pack_id").agg(F.sum((F.col("q_end") - F.col("q_start")) * (F.col("kv_end") - F.col("kv_start"))).cast("bigint").alias("granted"))
    own = allowed_pairs(spans, length).join(area, "pack_id", "left").withColumn("granted", F.coalesce("granted", F.lit(0).cast("bigint")))
    allowed = F.col("doc_causal") + F.col("granted")
    return own.select("pack_id", "length", "doc_causal", "granted", allowed.alias("allowed"), (allowed / F.col("causal")).alias("share_of_causal"))


def may_see(asked: DataFrame, spans: DataFrame, granted: DataFrame) -> DataFrame:
    """(pack_id, q, k, allowed): whether position q may see position k of its pack: k is not
    after q, and stands in q's document or is granted to q.

    Positions outside all spans count as one document.
    """
    pairs = asked.select("pack_id", "q", "k").distinct()

    def located(rows: DataFrame, position: str, name: str) -> DataFrame:
        at = spans.select(F.col("pack_id").alias("_p"), "span_start", "span_end", F.col("doc_id").alias(name))
        inside = (F.col("pack_id") == F.col("_p")) & (F.col("span_start") <= F.col(position)) & (F.col(position) < F.col("span_end"))
        return rows.join(at, inside, "left").drop("_p", "span_start", "span_end")

    placed = located(located(pairs, "q", "_q_doc"), "k", "_k_doc")
    rectangles = granted.select(F.col("pack_id").alias("_p"), "q_start", "q_end", "kv_start", "kv_end")
    covers = (F.col("pack_id") == F.col("_p")) & F.col("q").between(F.col("q_start"), F.col("q_end") - 1) & F.col("k").between(F.col("kv_start"), F.col("kv_end") - 1)
    hits = pairs.join(rectangles, covers, "left_semi").withColumn("_granted", F.lit(True))
    same = F.col("_q_doc").eqNullSafe(F.col("_k_doc"))
    return placed.join(hits, ["pack_id", "q", "k"], "left").select("pack_id", "q", "k", ((F.col("q") >= F.col("k")) & (same | F.coalesce("_granted", F.lit(False)))).alias("allowed"))


def visible_ranges(spans: DataFrame, granted: DataFrame) -> DataFrame:
    """(pack_id, q, k_start, k_end): the rows of the dense mask as half-open ranges of keys, one
    for the query's own document and one for each other document granted to it.

    This has a row per token and granted document: take the packs that are to be looked at.
    """
    own = spans.select("pack_id", F.explode(F.sequence("span_start", F.col("span_end") - 1)).alias("q"), F.col("span_start").alias("k_start")).withColumn("k_end", F.col("q") + 1)
    apart = granted.where("source_id <> target_id").groupBy("pack_id", "source_id", "target_id", "q_end", "kv_start", "kv_end").agg(F.min("q_start").alias("q_start"))
    more = apart.select("pack_id", F.explode(F.sequence("q_start", F.col("q_end") - 1)).alias("q"), F.col("kv_start").alias("k_start"), F.col("kv_end").alias("k_end"))
    return own.unionByName(more)


def grant_bitmasks(granted: DataFrame, cap: int = 256) -> DataFrame:
    """Per pack, side, position and chunk of 64 grants: the bits of the grants that hold there."""
    used = granted.where(F.col("grant_idx") < cap)
    sides = used.select(
        "pack_id", "grant_idx", F.explode(F.array(F.struct(F.lit("q").alias("side"), F.col("q_start").alias("a"), F.col("q_end").alias("b")), F.struct(F.lit("kv").alias("side"), F.col("kv_start").alias("a"), F.col("kv_end").alias("b")))).alias("r")
    )
    at = sides.select("pack_id", "r.side", F.floor(F.col("grant_idx") / 64).cast("int").alias("chunk"), (F.col("grant_idx") % 64).cast("int").alias("bit"), F.explode(F.sequence("r.a", F.col("r.b") - 1)).alias("position"))
    return at.groupBy("pack_id", "side", "position", "chunk").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def grants_at_step(step: Column, start: int, stop: int, warmup: int) -> Column:
    """Number of grants during warm-up, on a rising half cosine."""
    part = F.least(step / F.lit(warmup), F.lit(1.0))
    return F.bround(F.lit(start) + (stop - start) * (1 - F.cos(F.pi() * part)) / 2).cast("int")
