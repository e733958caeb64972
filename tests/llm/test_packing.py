import random

import numpy as np

from corpusloom.llm import packing

SCHEMA = "doc_id bigint, tok_len int, terms array<string>, place string, shard string, capacity int"


def test_packs_are_full_whole_and_reproducible(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, -1, 0, 30, 90, 200, 5000, rng.randrange(1, 600)]), rng.choice([None, [], ["a", None, "b"], [f"t{rng.randrange(30)}"] * 3]), rng.choice([None, "r1", "r2"]), "x", 1) for k in range(800)]
    rows += rows[:50] + [(None, 5, ["a"], "r1", "x", 1)]
    items = spark.createDataFrame(rows, SCHEMA)
    out = packing.lexical_packs(items, {1: 512, 2: 4096}).toPandas()
    length = {k: n for k, n, *_ in rows if k is not None and n is not None and n > 0}
    for config, capacity in ((1, 512), (2, 4096)):
        part = out[out.config_id == config]
        assert sorted(part.doc_id) == sorted(length)
        assert all(e == min(length[d], capacity) and t == (length[d] > capacity) for d, e, t in zip(part.doc_id, part.effective_len, part.truncated))
        loads = part.groupby("pack_id").effective_len.sum()
        assert loads.max() <= capacity and loads.sum() / (len(loads) * capacity) > 0.97
        assert all(sorted(p) == list(range(len(p))) for _, p in part.groupby("pack_id").pos)


def test_bm25_prefers_shared_rare_terms():
    index = packing.Bm25Index([[1, 7], [1], [1, 7, 7], [4], []])
    scores = index.scores(0)
    assert scores[2] > scores[1] > 0 and scores[3] == scores[4] == 0
    assert index.scores(3) is None and index.scores(4) is None


def test_lengths_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        free = packing.Lengths(dict(enumerate(lengths)), 64)
        for gone in rng.sample(range(len(lengths)), rng.randrange(len(lengths))):
            free.remove(gone)
            lengths[gone] = None
        left = [n for n in lengths if n]
        sums = set(left) | {a + b for i, a in enumerate(left) for b in left[:i]}
        for room in range(1, 65):
            best = max((s for s in sums if s <= room), default=0)
            longest = max((n for n in left if n <= room), default=0)
            wide = room > 2 * max(left)  # more than two items have to go in
            assert sum(free.closing(room)) == (longest if room >= 2 * longest + 2 else best)
            assert free.closes(room) == (room in sums or wide)


def test_neighbours_fill_the_window():
    # the seed's three neighbours fill it; the item of the same length without its terms stays out
    lengths = np.array([50, 20, 20, 10, 20])
    packs = packing.fill(lengths, packing.Bm25Index([[1, 2], [1, 2], [1], [2], [9]]), 100)
    assert sorted(i for i, _, _ in packs[0]) == [0, 1, 2, 3] and {h for _, h, _ in packs[0][1:3]} == {packing.RETRIEVED}


def test_empty(spark):
    assert packing.lexical_packs(spark.createDataFrame([], SCHEMA), {1: 64}).count() == 0


def test_shards_split_large_places(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    items = spark.createDataFrame([(k, 10, [f"w{k % 5}"], "one") for k in range(300)], "doc_id bigint, tok_len int, terms array<string>, place string")
    out = packing.lexical_packs(items, {7: 100}).toPandas()
    assert len(out) == 300 and out.groupby("pack_id").effective_len.sum().eq(100).all()
