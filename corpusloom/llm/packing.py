"""Filling fixed-capacity containers by lexical retrieval.

Items are sharded so that lexical neighbours meet, every shard holds a BM25 inverted index
over its items' terms, and packs are grown from seeds: the longest unused item retrieves
its unused neighbours, and all of them are walked by falling score.  A neighbour goes in
where it fits and the room then left can be filled to the last token by one or two unused
items; these close the window in the end.  Packs that stay too empty are taken apart
together with others that hold short items; what loose ones are left then are packed again
in a second round over fewer shards, again by place.

Only items longer than the capacity are cut, to the capacity.  Shards have about
``SHARD_ITEMS`` items whatever the sizes of the groups: a large group is cut into
several shards by a hash, small ones share shards.

Defined results: items whose length is null or not positive are not packed; null or empty
term lists make an item without neighbours, placed by length alone; repeated rows of an
item count once; ties are broken by item id; an empty table gives no packs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.joins import bounded
from corpusloom.session import materialize

SHARD_ITEMS = 4096
#: Packs filled less than this go into the second round.
DENSE = 0.985
#: Packs taken apart with each loose one to pack their items anew.
DONORS = 4
K1, B = 1.2, 0.75
#: How an item came into its pack.
SEED, RETRIEVED, CLOSING = 0, 1, 2


class Bm25Index:
    """Inverted index of one shard, as arrays: postings by term and terms by item."""

    def __init__(self, terms: Sequence[Sequence[int]]) -> None:
        n = len(terms)
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        words = np.concatenate([np.asarray(t, dtype=np.int64) for t in terms]) if sizes.sum() else np.zeros(0, dtype=np.int64)
        codes = np.unique(words, return_inverse=True)[1]
        cells, tf = np.unique(codes * n + np.repeat(np.arange(n), sizes), return_counts=True)
        term, item = cells // max(n, 1), cells % max(n, 1)
        holders = np.bincount(term)
        shared = holders[term] > 1
        term, item, tf = term[shared], item[shared], tf[shared]
        idf = np.log(1 + (n - holders + 0.5) / (holders + 0.5))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / max(sizes.mean() if n else 0.0, 1e-9)))
        self.item, self.n = item, n
        self.start = np.searchsorted(term, np.arange(len(holders) + 1)).tolist()
        order = np.argsort(item, kind="stable")
        self.terms, self.first = term[order].tolist(), np.searchsorted(item[order], np.arange(n + 1)).tolist()

    def scores(self, seed: int) -> np.ndarray | None:
        """Score of every item of the shard against the seed; none where it shares no term."""
        spans = [slice(self.start[t], self.start[t + 1]) for t in self.terms[self.first[seed] : self.first[seed + 1]]]
        if not spans:
            return None
        return np.bincount(np.concatenate([self.item[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), minlength=self.n)


class Lengths:
    """Unused items by length; the lengths there are form the bits of one number, which makes
    looking for one or two lengths of a sum a few operations on words."""

    def __init__(self, lengths: Mapping[int, int], capacity: int) -> None:
        self.capacity, self.lengths = capacity, lengths
        self.items: dict[int, dict[int, None]] = {}
        for k, n in lengths.items():
            self.items.setdefault(n, {})[k] = None
        self.bits = self.back = 0
        for n in self.items:
            self.bits |= 1 << n
            self.back |= 1 << (capacity - n)

    def remove(self, item: int) -> None:
        n = self.lengths[item]
        held = self.items[n]
        del held[item]
        if not held:
            del self.items[n]
            self.bits ^= 1 << n
            self.back ^= 1 << (self.capacity - n)

    def best(self, room: int) -> int:
        """The largest length up to ``room``, 0 if there is none."""
        return max((self.bits & ((2 << room) - 1)).bit_length() - 1, 0)

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths whose sum is ``total``, the longest there is first."""
        hits = self.bits & (self.back >> (self.capacity - total))
        while hits:
            one = hits.bit_length() - 1
            if 2 * one != total or len(self.items[one]) > 1:
                return one, total - one
            hits ^= 1 << one
        return None

    def closes(self, room: int) -> bool:
        """Whether one or two items fill ``room`` to the last token, or it is so wide that more
        will have to go in anyway."""
        return room == 0 or room > 2 * (self.bits.bit_length() - 1) or bool(self.bits >> room & 1) or self.pair(room) is not None

    def closing(self, room: int) -> tuple[int, ...]:
        """One or two lengths that come nearest to ``room``; the largest where it is wide."""
        one = self.best(room)
        if one == 0 or one == room or room >= 2 * one + 2:
            return (one,) if one else ()
        if len(self.items) <= 64:
            return self._nearest(room, one)
        least = (self.bits & -self.bits).bit_length() - 1
        for total in range(min(room, 2 * one), max(one, 2 * least - 1), -1):
            if two := self.pair(total):
                return two
        return (one,)

    def _nearest(self, room: int, one: int) -> tuple[int, ...]:
        there = sorted(n for n in self.items if n <= room)
        top: tuple[int, ...] = (one,)
        low, high = 0, len(there) - 1
        while low <= high:
            a, b = there[low], there[high]
            if a + b > room or low == high and len(self.items[a]) < 2:
                high -= 1
                continue
            if a + b > sum(top):
                top = (b, a)
            low += 1
        return top

    def any_of(self, length: int) -> int:
        return next(iter(self.items[length]))


Pack = list[tuple[int, int, bool]]


def _grow(items: np.ndarray, lengths: np.ndarray, index: Bm25Index, capacity: int, retrieve: bool) -> list[Pack]:
    """Packs of ``items``, grown from the longest unused one; without retrieval by length alone."""
    sizes = lengths.tolist()
    unused = np.zeros(len(sizes), dtype=bool)
    unused[items] = True
    free = Lengths({k: sizes[k] for k in items.tolist()}, capacity)
    packs: list[Pack] = []
    for seed in items[np.argsort(-lengths[items], kind="stable")].tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        free.remove(seed)
        pack, room = [(seed, SEED, True)], capacity - sizes[seed]
        scores = index.scores(seed) if free.best(room) else None
        if scores is not None and retrieve:
            near = np.flatnonzero((scores > 0) & unused & (lengths <= room))
            for item in near[np.argsort(-scores[near], kind="stable")].tolist():
                n = sizes[item]
                if n <= room and free.closes(room - n):
                    unused[item] = False
                    free.remove(item)
                    pack.append((item, RETRIEVED, True))
                    room -= n
                    if room == 0:
                        break
        while room and (found := free.closing(room)):
            for n in found:
                item = free.any_of(n)
                unused[item] = False
                free.remove(item)
                pack.append((item, CLOSING, scores is not None and bool(scores[item] > 0)))
                room -= n
        packs.append(pack)
    return packs


def fill(lengths: np.ndarray, index: Bm25Index, capacity: int) -> list[Pack]:
    """Packs as lists of (position, how, shares a term with the seed); positions are in the
    order of ids, ``lengths`` already cut to the capacity.

    Retrieval spends short items early, so that some long ones find none in the end.  Loose
    packs are therefore taken apart again, with ``DONORS`` times as many packs of many items,
    and these items packed by length alone, as long as that saves packs.
    """
    packs = _grow(np.arange(len(lengths)), lengths, index, capacity, True)
    while True:
        loads = np.array([sum(int(lengths[i]) for i, _, _ in p) for p in packs])
        loose = np.flatnonzero(loads < DENSE * capacity)
        if len(loose) < 2:
            return packs
        order = np.lexsort((np.arange(len(packs)), -np.array([len(p) for p in packs])))
        donors = [k for k in order.tolist() if loads[k] >= DENSE * capacity and len(packs[k]) > 1][: DONORS * len(loose)]
        apart = set(donors) | set(loose.tolist())
        items = np.array(sorted(i for k in apart for i, _, _ in packs[k]), dtype=np.int64)
        again = _grow(items, lengths, index, capacity, False)
        if len(again) >= len(apart):
            return packs
        packs = [p for k, p in enumerate(packs) if k not in apart] + again


def _round(rows: DataFrame, number: int, budgets: Mapping[int, int]) -> DataFrame:
    """Pack every shard of ``rows`` by itself, for every configuration its items are wanted in."""
    columns = "config_id int, pack_id bigint, pos int, doc_id bigint, effective_len int, truncated boolean, how int, related boolean, filled double"
    wanted = sorted(budgets.items())

    def pack_shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable", ignore_index=True)
        whole, every = frame["tok_len"].to_numpy(np.int64), frame["doc_id"].to_numpy(np.int64)
        terms = [t if t is not None else () for t in frame["terms"]]
        index, out = None, []
        for config, capacity in wanted:
            own = np.array([config in c for c in frame["configs"]]) if number > 1 else np.ones(len(frame), dtype=bool)
            if not own.any():
                continue
            if number > 1 or index is None:
                index = Bm25Index([t for t, o in zip(terms, own, strict=True) if o])
            ids, tok_len = every[own], whole[own]
            lengths = np.minimum(tok_len, capacity)
            packs = fill(lengths, index, capacity)
            sizes = [len(p) for p in packs]
            at = np.array([i for p in packs for i, _, _ in p], dtype=np.int64)
            loads = np.array([lengths[[i for i, _, _ in p]].sum() / capacity for p in packs])
            # a node is the seed of one pack of a configuration
            names = ids[[p[0][0] for p in packs]] * len(wanted) + [c for c, _ in wanted].index(config)
            out.append(pd.DataFrame({
                "config_id": np.full(len(at), config, dtype=np.int32), "pack_id": np.repeat(names, sizes),
                "pos": np.concatenate([np.arange(s) for s in sizes]).astype(np.int32), "doc_id": ids[at], "effective_len": lengths[at].astype(np.int32),
                "truncated": tok_len[at] > capacity, "how": np.array([h for p in packs for _, h, _ in p], dtype=np.int32), "related": [r for p in packs for _, _, r in p], "filled": np.repeat(loads, sizes),
            }))
        return pd.concat(out, ignore_index=True)

    return rows.select("shard", "doc_id", "tok_len", "terms", "configs").groupBy("shard").applyInPandas(pack_shard, columns)


def _sharded(items: DataFrame) -> DataFrame:
    """Items with a shard: places larger than a shard are cut by a hash, small ones share."""
    sizes = items.groupBy("place").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > SHARD_ITEMS).select("place", F.ceil(F.col("n") / SHARD_ITEMS).cast("int").alias("pieces"))
    few = sizes.where(F.col("n") <= SHARD_ITEMS).agg(F.sum("n")).first()[0] or 0
    small = max(1, -(-int(few) // SHARD_ITEMS))
    split = F.concat_ws("/", F.lit("g"), F.md5("place"), F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("string"))
    shared = F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("place"), F.lit(small)).cast("string"))
    return items.join(bounded(large), "place", "left").withColumn("shard", F.when(F.col("pieces").isNotNull(), split).otherwise(shared))


def lexical_placements(items: DataFrame, budgets: Mapping[int, int]) -> DataFrame:
    """Placements with how each item came into its pack (0 seed, 1 retrieved, 2 closing the
    window) and whether it shares a term with the pack's seed.

    ``items``: doc_id, tok_len, terms (array of strings), place (a string whose equal values
    are lexically close, such as the repository); ``budgets``: capacity per config_id.
    """
    hashed = F.transform(F.filter("terms", lambda t: t.isNotNull()), lambda t: F.xxhash64(t)).alias("terms")
    wanted = items.select("doc_id", F.col("tok_len").cast("bigint").alias("tok_len"), hashed, F.coalesce("place", F.lit("")).alias("place"))
    clean = materialize(wanted.where("doc_id is not null and tok_len > 0").dropDuplicates(["doc_id"]), "pack-items")
    every = F.array(*[F.lit(c).cast("int") for c in sorted(budgets)])
    first = materialize(_round(_sharded(clean.withColumn("configs", every)), 1, budgets), "packs-1")
    loose = first.where(F.col("filled") < DENSE).groupBy("doc_id").agg(F.collect_set("config_id").alias("configs"))
    second = materialize(clean.join(loose, "doc_id"), "pack-loose")
    again = _round(_sharded(second), 2, budgets)
    return first.where(F.col("filled") >= DENSE).unionByName(again).drop("filled")


def lexical_packs(items: DataFrame, budgets: Mapping[int, int]) -> DataFrame:
    """(config_id, pack_id, pos, doc_id, effective_len, truncated)."""
    return lexical_placements(items, budgets).drop("how", "related")
