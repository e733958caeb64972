import random
from collections import Counter

from corpusloom.operators import heavykeys as hk


def test_totals_match_a_plain_count_under_skew(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(500)}", rng.choice([None, 1, 5, 10**12]), rng.randrange(9)) for _ in range(5000)] + [(None, 3, 1), ("", 2, 1)]
    df = spark.createDataFrame(rows, "block string, place bigint, n_records int")
    count, total = Counter(), Counter()
    for k, v, _ in rows:
        if k is not None:
            count[k] += 1
            total[k] += v or 0
    got = {r.block: (r.n_records, r.place) for r in hk.dense_totals(df.repartition(7), "block", ["place"]).collect()}
    assert got == {k: (count[k], total[k]) for k in count}


def test_blocks_are_reduced_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(hk, "FAN_IN", 2)
    monkeypatch.setattr(hk, "BLOCK_KEYS", 8)
    df = spark.createDataFrame([(f"k{n % 40}", n) for n in range(900)], "k string, v bigint").repartition(9)
    got = {r.k: (r.n_records, r.v) for r in hk.dense_totals(df, "k", ["v"]).collect()}
    assert got == {f"k{j}": (len(range(j, 900, 40)), sum(range(j, 900, 40))) for j in range(40)}


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 98 + [("b",)] * 2, "k string")
    assert {r.k for r in hk.heavy_keys(hk.dense_totals(df, "k"), "k", 0.02).collect()} == {"a", "b"}
    assert {r.k for r in hk.heavy_keys(hk.dense_totals(df, "k"), "k", 0.021).collect()} == {"a"}
    assert hk.heavy_keys(hk.dense_totals(df.limit(0), "k"), "k", 0.02).count() == 0
