"""Token-budgeted packs: lengths, filling, ordering, truncation, layout and collation."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackSettings:
    """Checked settings of a pack sampler."""

    token_budget: int
    doc_budget: int | None = None
    overflow_policy: str = "truncate"
    order_mode: str = "as_traversed"
    pack_trim_side: str = "head"
    doc_trim_side: str = "tail"
    seed: int = 0
    max_rejections: int = 1000

    def __post_init__(self) -> None:
        checks = [
            (self.token_budget <= 0, "token_budget must be positive"), (self.doc_budget is not None and self.doc_budget <= 0, "doc_budget must be positive"),
            (self.overflow_policy not in ("truncate", "skip"), "overflow_policy must be 'truncate' or 'skip'"), (self.order_mode not in ("as_traversed", "prefer_targets_first"), "unknown order_mode"),
            (self.pack_trim_side not in ("head", "tail"), "pack_trim_side must be 'head' or 'tail'"), (self.doc_trim_side not in ("head", "tail"), "doc_trim_side must be 'head' or 'tail'"),
            (self.max_rejections <= 0, "max_rejections must be positive"),
        ]
        for wrong, message in checks:
            if wrong:
                raise ValueError(message)


def budgeted_length(length: Column, budget: int | None, policy: str = "truncate") -> Column:
    """Length within a document budget; null where the document is left out."""
    out = F.when(length <= 0, F.lit(None))
    if budget is None:
        return out.otherwise(length)
    out = out.when(length <= budget, length)
    return out.when(F.lit(policy == "truncate"), F.lit(budget))


def fill_packs(docs: DataFrame, groups: Sequence[str], order: Sequence[str], length: str, budget: int) -> DataFrame:
    """Documents taken in order until the pack has reached its budget (it may overshoot)."""
    before = F.coalesce(F.sum(length).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.withColumn("tokens_before", before).where(F.col("tokens_before") < budget)


def truncate_packs(placements: DataFrame, budget: int, side: str = "tail", pack: str = "pack_id", pos: str = "pos", body: str = "body_len", extra: str | None = None) -> DataFrame:
    """Trim document bodies from one end of the pack until it fits; emptied documents go.

    Closed form of the sequential trimming: a body loses what of the overshoot the bodies
    trimmed before it did not cover.
    """
    whole = F.col(body) + (F.col(extra) if extra else F.lit(0))
    over = F.greatest(F.sum(whole).over(Window.partitionBy(pack)) - budget, F.lit(0))
    order = F.col(pos).desc() if side == "tail" else F.col(pos).asc()
    trimmed_before = F.coalesce(F.sum(body).over(Window.partitionBy(pack).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.least(F.col(body), F.greatest(over - trimmed_before, F.lit(0)))
    return placements.withColumn("kept_len", F.col(body) - cut).withColumn("was_cut", cut > 0).where("kept_len > 0")


def targets_first(ids: Sequence[int], edges: Iterable[tuple[int, int]]) -> list[int]:
    """Topological order with link targets before the linking documents.

    Of the documents that wait for nothing the one placed first goes next, also if it was
    unlocked late; documents on cycles, linking themselves or behind such ones keep their
    order at the end.
    """
    at = {d: k for k, d in enumerate(ids)}
    waits = [0] * len(ids)
    unlocks: list[list[int]] = [[] for _ in ids]
    for source, target in {(at[s], at[t]) for s, t in edges if s in at and t in at}:
        waits[source] += 1
        unlocks[target].append(source)
    ready = [k for k, n in enumerate(waits) if n == 0]  # ascending, so a heap already
    order: list[int] = []
    while ready:
        first = heapq.heappop(ready)
        order.append(first)
        for source in unlocks[first]:
            waits[source] -= 1
            if waits[source] == 0:
                heapq.heappush(ready, source)
    placed = set(order)
    return [ids[k] for k in order] + [d for k, d in enumerate(ids) if k not in placed]


def order_packs(placements: DataFrame, edges: DataFrame) -> DataFrame:
    """(pack_id, doc_id, pos, new_pos) with targets first; a pack has a bounded number of
    documents, so each is ordered in one call."""
    inside = placements.select("pack_id", F.col("doc_id").alias("src")).join(edges, "src")
    inside = inside.join(placements.select("pack_id", F.col("doc_id").alias("dst")), ["pack_id", "dst"], "left_semi")
    lists = inside.groupBy("pack_id").agg(F.collect_set(F.struct("src", "dst")).alias("links"))
    docs = placements.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("docs"))

    @F.pandas_udf("array<bigint>")
    def ordered(docs: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for d, e in zip(docs, links, strict=True):
            out.append(targets_first([x["doc_id"] for x in d], [(x["src"], x["dst"]) for x in (e if e is not None else [])]))
        return pd.Series(out)

    plan = docs.join(lists, "pack_id", "left").select("pack_id", F.posexplode(ordered("docs", "links")).alias("new_pos", "doc_id"))
    return placements.select("pack_id", "doc_id", "pos").join(plan, ["pack_id", "doc_id"])


@dataclass(frozen=True)
class Layout:
    """Tokens put around a body; ``title`` columns of encoded identifiers are optional."""

    bos: int | None = None
    eos: int | None = None
    with_title: bool = False
    names: tuple[str, ...] = field(default=())

    def prefix(self, title: Column | None = None) -> Column:
        parts = [F.array(F.lit(self.bos))] if self.bos is not None else []
        if self.with_title and title is not None:
            parts.append(title)
        return F.concat(*parts) if parts else F.array().cast("array<int>")

    def suffix(self) -> Column:
        return F.array(F.lit(self.eos)) if self.eos is not None else F.array().cast("array<int>")


# Fixed value: the end-of-text token id that serves as begin and end by default.
END_OF_TEXT = 50256


def make_layout(name: str, bos: int = END_OF_TEXT, eos: int = END_OF_TEXT) -> Layout:
    """A layout by name: none, bos_eos, identifier_prefix, identifier_prefix_bos_eos."""
    known = {
        "none": Layout(), "bos_eos": Layout(bos, eos), "identifier_prefix": Layout(with_title=True), "identifier_prefix_bos_eos": Layout(bos, eos, True),
    }
    if name not in known:
        raise ValueError(f"unknown layout {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


def title_text(raw: Column) -> Column:
    """Text of the title line that opens a document."""
    return F.concat(F.lit("# "), F.coalesce(raw, F.lit("")), F.lit("\n\n"))


def char_codes(text: Column) -> Column:
    """Code points as tokens: the character tokenizer."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def slice_body(tokens: Column, keep: Column, side: Column | str = "tail") -> Column:
    """First ``keep`` tokens if the tail is trimmed, last ones if the head is."""
    n = F.least(F.greatest(keep, F.lit(0)), F.size(tokens))
    side = F.lit(side) if isinstance(side, str) else side
    return F.when(side == "head", F.slice(tokens, F.size(tokens) - n + 1, n)).otherwise(F.slice(tokens, F.lit(1), n))


def spans(placements: DataFrame, length: str = "length", pack: str = "pack_id", pos: str = "pos") -> DataFrame:
    """Half-open token spans of the documents of each pack; documents without tokens are left out."""
    placed = placements.where(F.col(length) > 0)
    end = F.sum(length).over(Window.partitionBy(pack).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("span_end", end).withColumn("span_start", F.col("span_end") - F.col(length))


def collate(placed: DataFrame, tokens: str = "tokens", pack: str = "pack_id", pos: str = "pos") -> DataFrame:
    """One token sequence per pack, in the order of its documents."""
    lists = placed.groupBy(pack).agg(F.array_sort(F.collect_list(F.struct(pos, tokens))).alias("_l"))
    return lists.select(pack, F.flatten(F.transform("_l", lambda x: x[tokens])).alias("tokens"))


def first_packs(packs: DataFrame, n: int, order: Sequence[str] = ("pack", "seed")) -> DataFrame:
    """All rows of the first ``n`` packs; the same ones whenever the data is read again."""
    chosen = packs.select(*order).distinct().orderBy(*order).limit(n)
    return packs.join(F.broadcast(chosen), list(order), "left_semi")


def packed_sequences(placements: DataFrame, bodies: DataFrame, layout: Layout, trim_side: str = "tail") -> DataFrame:
    """(seed, pack, tokens, spans): the packs' token sequences with titles, bodies and marks, and
    where each document lies; ``bodies`` has node, tokens, raw_identifier, outgoing.

    Documents without tokens are left out.
    """
    title = char_codes(title_text(F.col("raw_identifier"))) if layout.with_title else None
    rows = placements.join(bodies.where(F.size("tokens") > 0), "node")
    whole = F.concat(layout.prefix(title), slice_body(F.col("tokens"), F.col("length").cast("int"), trim_side), layout.suffix())
    sized = rows.select("seed", "pack", "pos", "node", "raw_identifier", "outgoing", "cut", whole.alias("piece")).withColumn("n", F.size("piece"))
    end = F.sum("n").over(Window.partitionBy("seed", "pack").orderBy("pos"))
    parts = sized.withColumn("span_end", end).withColumn("span_start", F.col("span_end") - F.col("n"))
    fields = F.struct("pos", "piece", F.struct("node", "raw_identifier", "span_start", "span_end", "cut", "outgoing").alias("span"))
    lists = parts.groupBy("seed", "pack").agg(F.array_sort(F.collect_list(fields)).alias("_l"))
    return lists.select("seed", "pack", F.flatten(F.transform("_l", lambda x: x["piece"])).alias("tokens"), F.transform("_l", lambda x: x["span"]).alias("spans"))


def assign_shards(sizes: DataFrame, capacity: int, header: int = 1024, writers: int = 1) -> DataFrame:
    """(key, writer, shard, offset): documents in key order fill shards; a new shard starts
    where the next document would pass the capacity, an oversized one still gets a shard.

    A running sum with resets is sequential, so the keys are dealt to ``writers`` that fill
    shards of their own side by side; one writer gives the single sequence of shards.  Only
    (key, bytes) is walked, never tokens.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        shard, offset, shards, offsets = -1, 0, [], []
        for n in frame["n_bytes"]:
            if shard < 0 or offset + n > capacity:
                shard, offset = shard + 1, header
            shards.append(shard)
            offsets.append(offset)
            offset += n
        return pd.DataFrame({"key": frame["key"], "writer": frame["writer"], "shard": shards, "offset": offsets, "n_bytes": frame["n_bytes"]})

    dealt = sizes.select("key", "n_bytes", F.pmod(F.xxhash64("key"), F.lit(writers)).cast("int").alias("writer"))
    return dealt.groupBy("writer").applyInPandas(walk, "key string, writer int, shard int, offset bigint, n_bytes bigint")
