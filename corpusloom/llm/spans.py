"""Long exact spans shared between records, by repeated-phrase automata.

1. Every text yields content-chosen passages of ``gram`` characters such that two texts
   with a common span of ``span`` characters hold one of its passages in common.
2. Passages that occur in two or more different texts are confirmed as recurring.
3. Recurring passages are compiled into sharded Aho-Corasick automata and all texts that
   hold any of them are streamed through the shards that hold their passages.
4. Every occurrence is keyed by the texts' longer surroundings; around keys that two or more
   texts hold, all windows of ``span`` characters are hashed, and those in two or more texts
   are what is shared.

Equal texts form one class, of which one text is searched.  Every number of occurrences
is handled: a shard's stretches are salted by their size, and results are memberships of
windows, from which pairs are made only where pairs are asked for.

Defined results: null and short texts (under ``span`` characters) share nothing; repeated
rows of one document count once; characters are code points and nothing is normalised;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import textkernels as tk
from corpusloom.operators.joins import bounded
from corpusloom.session import discard, materialize

GRAM = 100
STEP = 50
#: Passages in one automaton: about 2 M trie nodes at 100 characters.
SHARD_PASSAGES = 20_000
#: Characters of text that one call of an automaton streams.
CALL_CHARS = 8_000_000


def text_key(text: Column | str, salt: int = 17) -> Column:
    """64-bit class key of a text."""
    return F.xxhash64(F.lit(salt), text, F.length(text))


def text_classes(docs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(tid, text) of all rows, and the table of (tid, n_chars and the wanted columns).

    Texts of one class are equal: the 128-bit digests of every class are compared, and where two
    differ under one key all keys are made anew with another salt.
    """
    salt = 17
    while True:
        keyed = docs.withColumn("tid", text_key("text", salt))
        members = materialize(keyed.select("tid", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), *columns).distinct(), "text-members")
        if members.groupBy("tid").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").isEmpty():
            return keyed.select("tid", "text"), members.drop("digest")
        discard(members)
        salt += 1


def _anchors(docs: DataFrame, gram: int, span: int) -> DataFrame:
    """(h, tid, pos) for each chosen passage."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hs, tids, poss = [], [], []
            for tid, text in zip(frame["tid"].to_numpy(), frame["text"], strict=True):
                pos, h = tk.minimizers(text, gram, span)
                hs.append(h.view(np.int64))
                poss.append(pos.astype(np.int32))
                tids.append(np.full(len(pos), tid, dtype=np.int64))
            if hs:
                yield pd.DataFrame({"h": np.concatenate(hs), "tid": np.concatenate(tids), "pos": np.concatenate(poss)})

    return docs.select("tid", "text").mapInPandas(run, "h bigint, tid bigint, pos int")


def _keyed_windows(docs: DataFrame, span: int, gram: int, step: int) -> tuple[DataFrame, DataFrame]:
    """(key, tid, pos) of windows of ``span - step`` characters around recurring passages that
    stand in two or more texts, and the (tid, text) of texts with recurring passages."""
    anchors = _anchors(docs, gram, span)
    recurring = anchors.groupBy("h").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.min(F.struct("tid", "pos")).alias("first")).where("lo <> hi")
    recurring = materialize(recurring.select("h", F.col("first.tid").alias("tid"), F.col("first.pos").alias("pos")), "recurring")
    shards = max(1, -(-recurring.count() // SHARD_PASSAGES))
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")
    # where the recurring passages stand; the anchors are read again rather than kept
    places = materialize(_anchors(docs, gram, span).join(bounded(recurring.select("h"), 2_000_000), "h", "left_semi").distinct().withColumn("shard", shard), "places")
    holders = places.select("tid").distinct()
    texts = docs.join(bounded(holders, 1_000_000), "tid", "left_semi").dropDuplicates(["tid"])
    texts = materialize(texts.select("tid", "text"), "span-texts")
    passages = recurring.join(texts, "tid").select("h", F.expr(f"substring(text, pos + 1, {gram})").alias("passage")).withColumn("shard", shard)
    passages = materialize(passages, "passages")
    # stretches around the places of one shard, joined where they touch
    reach = span
    w = Window.partitionBy("tid", "shard").orderBy("pos")
    fresh = F.when(F.col("pos") - reach > F.lag(F.col("pos")).over(w) + reach, 1).otherwise(0)
    runs = places.select("tid", "shard", "pos").distinct().withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    cuts = runs.groupBy("tid", "shard", "run").agg(F.greatest(F.min("pos") - reach, F.lit(0)).alias("lo"), (F.max("pos") + gram + reach).alias("hi"))
    stretches = cuts.join(texts, "tid").select("shard", "tid", "lo", F.expr("substring(text, lo + 1, hi - lo)").alias("stretch"))
    sizes = cuts.groupBy("shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("chars")).select("shard", F.greatest(F.ceil(F.col("chars") / CALL_CHARS), F.lit(1)).cast("int").alias("salts"))
    salted = stretches.join(bounded(sizes, 100_000), "shard").withColumn("salt", F.pmod(F.xxhash64("tid", "lo"), "salts").cast("int")).drop("salts")
    copies = passages.join(bounded(sizes, 100_000), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    long = span - step

    def locate(passage: pd.DataFrame, stretch: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(passage) and len(stretch):
            machine = ahocorasick.Automaton()
            for text in passage["passage"]:
                machine.add_word(text, len(text))
            machine.make_automaton()
            for tid, lo, text in zip(stretch["tid"], stretch["lo"], stretch["stretch"], strict=True):
                ends = np.fromiter((end for end, _ in machine.iter(text)), dtype=np.int64)
                if not len(ends):
                    continue
                sums = tk.prefix_sums(tk.code_points(text))
                # the keys: windows of span - step characters that hold the passage, on a grid from it
                starts = np.unique((ends[:, None] - (gram - 1)) - np.arange(0, long - gram + 1, step)[None, :])
                starts = starts[(starts >= 0) & (starts + long <= len(text))]
                keys = tk.span_hashes(sums, starts, starts + long).view(np.int64)
                found.extend(zip(keys.tolist(), [tid] * len(keys), (starts + lo).tolist(), strict=True))
        return pd.DataFrame(found, columns=["key", "tid", "pos"])

    grouped = copies.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt"))
    keyed = materialize(grouped.applyInPandas(locate, "key bigint, tid bigint, pos int").distinct(), "span-keys")
    several = keyed.groupBy("key").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo <> hi").select("key")
    return keyed.join(several, "key", "left_semi"), texts


def shared_windows(docs: DataFrame, span: int = 400, gram: int = GRAM, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(h, tid, pos) of windows of exactly ``span`` characters that stand in two or more texts,
    and the (tid, text) of texts with recurring passages; ``docs`` has tid and text.

    Every span of that length which two texts share is among them: it holds a recurring passage
    and with it a shared key, and all windows of the span's length around a key are looked at.
    """
    keyed, texts = _keyed_windows(docs, span, gram, step)
    w = Window.partitionBy("tid").orderBy("pos")
    fresh = F.when(F.col("pos") - F.lag("pos").over(w) <= step, 0).otherwise(1)
    runs = keyed.select("tid", "pos").distinct().withColumn("run", F.sum(fresh).over(w)).groupBy("tid", "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    lists = runs.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tid, found, text in zip(frame["tid"], frame["runs"], frame["text"], strict=True):
                sums = tk.prefix_sums(tk.code_points(text))
                starts = np.unique(np.concatenate([np.arange(max(r["lo"] - step, 0), min(r["hi"], len(text) - span) + 1) for r in found]))
                if len(starts):
                    yield pd.DataFrame({"h": tk.span_hashes(sums, starts, starts + span).view(np.int64), "tid": tid, "pos": starts.astype(np.int32)})

    hashed = materialize(lists.join(texts, "tid").select("tid", "runs", "text").mapInPandas(windows, "h bigint, tid bigint, pos int"), "span-windows")
    shared = hashed.groupBy("h").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo <> hi").select("h")
    return hashed.join(shared, "h", "left_semi"), texts


def shared_cover(docs: DataFrame, span: int = 400, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """(tid, covered): how many characters of a text lie in spans that stand in another text.

    No pair of texts is made, so that a span may stand in any number of them.
    """
    starts = shared_windows(docs, span, gram, step)[0].select("tid", "pos").distinct()
    gap = F.coalesce(F.col("pos") - F.lag("pos").over(Window.partitionBy("tid").orderBy("pos")), F.lit(span))
    return starts.withColumn("gap", gap).groupBy("tid").agg(F.sum(F.least("gap", F.lit(span))).alias("covered"))


def shared_groups(docs: DataFrame, span: int = 400, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """(window, tid): membership of texts in groups that share a span; two texts share one
    exactly if they are together in a group.

    A span in m texts gives m rows here.  Of all windows that stand in the same texts one is
    kept, and its characters are compared: ``window`` is their digest.
    """
    found, texts = shared_windows(docs, span, gram, step)
    holders = materialize(found.groupBy("h", "tid").agg(F.min("pos").alias("pos")), "span-holders")
    sets = holders.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64("tid", F.lit(1))).alias("y"))
    kept = sets.groupBy("n", "x", "y").agg(F.min("h").alias("h")).select("h")
    rows = holders.join(kept, "h").join(texts, "tid")
    return rows.select(F.md5(F.expr(f"substring(text, pos + 1, {span})")).alias("window"), "tid").distinct()
