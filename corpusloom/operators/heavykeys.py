"""Per-key results when a few keys hold most records.

``dense_totals`` works on equal input splits, whatever their keys: every split
dictionary-encodes its own keys and sums its values with ``numpy.bincount``.  The sums
are packed into array blocks by a hash of the key, and the blocks of ``FAN_IN`` splits at
a time are added at the places of their common dictionary until one block of each number
is left.  No task ever holds the rows of one key; what is shuffled is one row per split
and block.

Defined results: rows with a null key or an empty one after cleaning are left to the
caller's filter (a null key here is dropped); null values count as 0; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Keys per dense block; one block's arrays are a few hundred kB.
BLOCK_KEYS = 16_384
#: Lanes (scan splits of the partial sums) whose blocks are added in one group.
FAN_IN = 32


def split_partials(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Per input split and key: record count and sums, by bincount over local codes."""
    names = ["n_records", *values]
    schema = f"{key} string, " + ", ".join(f"{n} bigint" for n in names)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes_of: dict[str, int] = {}
        totals = np.zeros((len(names), 1024), dtype=np.int64)

        def flush() -> pd.DataFrame:
            keys = list(codes_of)
            out = pd.DataFrame({key: keys} | {n: totals[i, : len(keys)] for i, n in enumerate(names)})
            codes_of.clear()
            totals[:] = 0
            return out

        for frame in frames:
            local, uniques = pd.factorize(frame[key])
            place = np.array([codes_of.setdefault(u, len(codes_of)) for u in uniques], dtype=np.int64)
            if len(codes_of) > totals.shape[1]:
                grown = np.zeros((len(names), 2 * len(codes_of)), dtype=np.int64)
                grown[:, : totals.shape[1]] = totals
                totals = grown
            ok = local >= 0
            local = local[ok]
            for i, name in enumerate(names):
                if i == 0:
                    part = np.bincount(local, minlength=len(uniques))
                else:  # integer scatter-reduce: bincount's weights would go through floats
                    part = np.zeros(len(uniques), dtype=np.int64)
                    np.add.at(part, local, frame[name].fillna(0).to_numpy(np.int64)[ok])
                if len(place):
                    totals[i, place] += part
            if len(codes_of) > 500_000:  # a split's own memory bound; partial rows simply add up later
                yield flush()
        if codes_of:
            yield flush()

    return df.select(F.col(key).cast("string").alias(key), *values).where(F.col(key).isNotNull()).mapInPandas(encode, schema)


def _scatter(keys: np.ndarray, sums: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys and, at their places, dense arrays into which the sums are added."""
    place, uniques = pd.factorize(keys)
    out = []
    for values in sums:
        total = np.zeros(len(uniques), dtype=np.int64)
        np.add.at(total, place, values.astype(np.int64))
        out.append(total)
    return uniques, out


def _add_blocks(frame: pd.DataFrame, names: Sequence[str]) -> pd.DataFrame:
    """The sum of the array blocks of one group."""
    keys, sums = _scatter(np.concatenate(list(frame["_key"])), [np.concatenate(list(frame[n])) for n in names])
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "lane": [frame["lane"].iloc[0]], "_key": [keys]} | {n: [t] for n, t in zip(names, sums, strict=True)})


def dense_totals(df: DataFrame, key: str, values: Sequence[str] = ()) -> DataFrame:
    """Record count ``n_records`` and the sum of each of ``values`` per key."""
    # names of our own inside, so that no input name can clash
    inner = [f"_v{i}" for i in range(len(values))]
    renamed = df.select(F.col(key).cast("string").alias("_key"), *[F.col(v).alias(n) for v, n in zip(values, inner, strict=True)])
    partials = materialize(split_partials(renamed, "_key", inner), "key-partials")
    names = ["n_records", *inner]
    blocks = max(1, -(-2 * int(partials.select(F.approx_count_distinct("_key")).first()[0]) // BLOCK_KEYS))
    schema = "block int, lane int, _key array<string>, " + ", ".join(f"{n} array<bigint>" for n in names)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values("block", kind="stable")
            block, lane, keys = (frame[c].to_numpy() for c in ("block", "lane", "_key"))
            values = [frame[n].to_numpy() for n in names]
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            rows = []
            for lo, hi in zip(starts, [*starts[1:], len(block)], strict=True):
                own, sums = _scatter(keys[lo:hi], [v[lo:hi] for v in values])
                rows.append((block[lo], lane[lo], own, *sums))
            yield pd.DataFrame(rows, columns=["block", "lane", "_key", *names])

    # lanes are scan splits of the partial sums
    lanes = max(1, len(partials.inputFiles()))
    lane = F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("lane")
    coded = partials.select(F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int").alias("block"), lane, "_key", *names)
    arrays = coded.mapInPandas(pack, schema)
    # a group never holds more than FAN_IN lanes' blocks: lanes are merged level by level
    while True:
        arrays = arrays.withColumn("lane", F.floor(F.col("lane") / FAN_IN).cast("int")).groupBy("block", "lane").applyInPandas(lambda f: _add_blocks(f, names), schema)
        lanes = -(-lanes // FAN_IN)
        if lanes <= 1:
            break
    out = arrays.select(F.explode(F.arrays_zip("_key", *names)).alias("z"))
    return out.select(F.col("z._key").alias(key), "z.n_records", *[F.col(f"z.{n}").alias(v) for v, n in zip(values, inner, strict=True)])


def heavy_keys(totals: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all records; nothing of an empty table."""
    everything = totals.agg(F.sum("n_records")).first()[0] or 0
    return totals.where(F.col("n_records") >= F.lit(share * everything)).select(key, "n_records")
