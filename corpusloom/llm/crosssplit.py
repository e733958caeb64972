"""Same or near-same records across splits, by bit fingerprints.

Every text gets a fingerprint of 128 lanes of 8 bits whose lanes agree with the
probability of the texts' shingle similarity.  The code is cut into 32 segments of
four lanes; records of different splits that agree in a whole segment are
candidates, a Hamming radius over the lanes sorts out chance hits, and the surviving
pairs are verified on the exact shingle sets.

At similarity 0.7 a pair misses all 32 segments with probability
(1 - 0.7**4)**32 < 2e-4, at 0.8 with less than 1e-7.

Equal shingle sets form one class; only class representatives are compared and
classes are expanded at the end.

Defined results: null or empty texts and those with fewer than three words have no
shingles and pair with nothing; repeated rows count once; empty tables give no rows;
a record without split takes no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkernels as tk
from corpusloom.operators.joins import bounded
from corpusloom.session import materialize

LANES = 128
SHINGLE = 3
#: Lanes that must agree; a pair at similarity s agrees in about s * 128 of them, with a
#: standard deviation of at most 5.7, so 26 lanes below is more than four deviations.
SLACK_LANES = 26


def _set_id(items: np.ndarray) -> str:
    return hashlib.blake2b(items.tobytes(), digest_size=12).hexdigest()


def fingerprints(texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, set_id, n_shingles, code) per row with at least one shingle; no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tk.BitFingerprint(LANES)
        for frame in frames:
            rows = []
            for k, t in zip(frame["key"], frame["text"], strict=True):
                items = tk.shingle_set(t, SHINGLE)
                if len(items):
                    rows.append((k, _set_id(items), len(items), coder.code(items).tobytes()))
            yield pd.DataFrame(rows, columns=["key", "set_id", "n_shingles", "code"])

    source = texts.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return source.mapInPandas(run, "key string, set_id string, n_shingles int, code binary")


def _segments(classes: DataFrame) -> DataFrame:
    @F.pandas_udf("array<bigint>")
    def cut(codes: pd.Series) -> pd.Series:
        # number of the segment in the upper bits, so that one join column is enough
        place = np.arange(LANES // 4, dtype=np.int64) << 32
        return pd.Series([place | tk.BitFingerprint.segments(np.frombuffer(c, dtype=np.uint8)) for c in codes])

    return classes.select("cid", "n_shingles", F.explode(cut("code")).alias("segment"))


def cross_pairs(tagged: DataFrame, texts: DataFrame, threshold: float, key: str = "key", text: str = "text") -> DataFrame:
    """Verified class pairs between the sides of ``tagged``.

    ``tagged`` has key, side ('train' or 'eval'), set_id, n_shingles, code.  The result
    has set_a (a class with a train member), set_b (one with an eval member) and the
    exact similarity; a class with both appears with itself at similarity 1.
    """
    classes = materialize(
        tagged.groupBy("set_id").agg(
            F.first("code").alias("code"), F.first("n_shingles").alias("n_shingles"), F.min("key").alias("rep"),
            F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "eval").alias("in_eval"),
        ).withColumn("cid", F.xxhash64("set_id")),
        "fp-classes",
    )
    left = _segments(classes.where("in_train"))
    right = _segments(classes.where("in_eval")).select(F.col("cid").alias("cid_b"), F.col("n_shingles").alias("n_b"), "segment")
    # sets whose sizes differ by more than the threshold can't reach it
    fits = (F.col("n_b") >= F.lit(threshold) * F.col("n_shingles")) & (F.col("n_shingles") >= F.lit(threshold) * F.col("n_b"))
    hits = left.join(right, "segment").where(fits & (F.col("cid") != F.col("cid_b"))).select("cid", "cid_b").distinct()

    @F.pandas_udf("int")
    def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) for x, y in zip(a, b, strict=True)], dtype="int32")

    side_a = classes.select("cid", F.col("code").alias("code_a"), F.col("rep").alias("rep_a"), F.col("set_id").alias("set_a"))
    side_b = classes.select(F.col("cid").alias("cid_b"), F.col("code").alias("code_b"), F.col("rep").alias("rep_b"), F.col("set_id").alias("set_b"))
    near = hits.join(side_a, "cid").join(side_b, "cid_b").where(agreeing("code_a", "code_b") >= int(threshold * LANES) - SLACK_LANES)
    near = materialize(near.select("set_a", "rep_a", "set_b", "rep_b"), "fp-near")

    def contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 256):  # small frames bound the memory of the sets
                part = frame.iloc[lo : lo + 256]
                sets = [tk.shingle_set(x, SHINGLE) for x in part["_text"]]
                yield pd.DataFrame({"rep": part["rep"], "set_id": [_set_id(x) for x in sets], "items": [x.view(np.int64) for x in sets]})

    wanted = near.select(F.explode(F.array(F.struct(F.col("rep_a").alias("rep"), F.col("set_a").alias("set_id")), F.struct(F.col("rep_b").alias("rep"), F.col("set_b").alias("set_id")))).alias("w")).select("w.*").distinct()
    source = texts.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("rep"), F.col(text).alias("_text"))
    picked = source.join(bounded(wanted.select("rep").distinct(), 300_000), "rep", "left_semi")
    sets = picked.select("rep", "_text").mapInPandas(contents, "rep string, set_id string, items array<bigint>").join(wanted, ["rep", "set_id"], "left_semi").dropDuplicates(["set_id"]).select("set_id", "items")
    sets = materialize(sets, "fp-sets")

    common = F.size(F.array_intersect("items_a", "items_b"))
    similarity = common / (F.size("items_a") + F.size("items_b") - common)
    scored = (
        near.join(sets.select(F.col("set_id").alias("set_a"), F.col("items").alias("items_a")), "set_a")
        .join(sets.select(F.col("set_id").alias("set_b"), F.col("items").alias("items_b")), "set_b")
        .select("set_a", "set_b", similarity.alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    same = classes.where("in_train and in_eval").select(F.col("set_id").alias("set_a"), F.col("set_id").alias("set_b"), F.lit(1.0).alias("similarity"))
    return materialize(scored.unionByName(same), "fp-pairs")
