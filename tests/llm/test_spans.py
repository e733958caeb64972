import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import spans
from corpusloom.llm import textkernels as tk


def brute(texts, span):
    grams = {k: {t[i : i + span] for i in range(len(t) - span + 1)} for k, t in texts.items()}
    return {(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b] and grams[a] & grams[b]}


def pairs(groups):
    by = {}
    for r in groups.collect():
        by.setdefault(r.window, set()).add(r.tid)
    return {(a, b) for g in by.values() for a in g for b in g if a < b}


def test_a_hot_span_gives_memberships_only(spark):
    rng = random.Random(8)
    licence = "".join(rng.choice("abcdefghij") for _ in range(700))
    docs = spark.createDataFrame([(k, "".join(rng.choice("klmnop") for _ in range(50)) + licence) for k in range(400)], "tid bigint, text string")
    assert spans.shared_groups(docs).count() < 6 * 400 and spans.shared_cover(docs).where("covered >= 700").count() == 400


@pytest.mark.parametrize(("span", "gram", "step"), [(400, 100, 50), (60, 20, 10)])
def test_groups_and_cover_equal_brute_force(spark, span, gram, step):
    rng = random.Random(span)
    letters = "abcdefgh ☃\n🎈"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [text(rng.randrange(span - 5, 3 * span)) for _ in range(6)]
    texts = {}
    for k in range(60):
        parts = [text(rng.randrange(0, 2 * span))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(pool)
            cut = rng.choice([len(p), span, span - 1, span + 1])
            s = rng.randrange(max(1, len(p) - cut + 1))
            parts += [p[s : s + cut], text(rng.randrange(0, span))]
        body = "".join(parts)
        if len(body) >= span:
            texts[k] = body
    texts[100], texts[101] = "ab" * span, "x" + "ab" * span + "y"
    texts[102] = "a" * (2 * span)
    texts[103] = "a" * (2 * span) + "b"
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] * 2, "tid bigint, text string, h int")
    assert pairs(spans.shared_groups(docs, span, gram, step)) == brute(texts, span)
    got = {r.tid: r.covered for r in spans.shared_cover(docs, span, gram, step).collect()}
    grams = {k: [t[i : i + span] for i in range(len(t) - span + 1)] for k, t in texts.items()}
    holders = {}
    for k, g in grams.items():
        for x in set(g):
            holders.setdefault(x, set()).add(k)
    cover = {k: len({j for i, x in enumerate(g) if len(holders[x]) > 1 for j in range(i, i + span)}) for k, g in grams.items()}
    assert got == {k: n for k, n in cover.items() if n}


def test_small_shards_and_calls_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefghij") for _ in range(900))
    docs = spark.createDataFrame([(k, "".join(rng.choice("klmnop") for _ in range(300)) + shared[: 400 + 9 * k]) for k in range(20)], "tid bigint, text string")
    want = pairs(spans.shared_groups(docs))
    monkeypatch.setattr(spans, "SHARD_PASSAGES", 2)
    monkeypatch.setattr(spans, "CALL_CHARS", 1500)
    assert len(want) == 190 and pairs(spans.shared_groups(docs)) == want


def test_equal_keys_of_different_texts_are_made_anew(spark, monkeypatch):
    real = spans.text_key
    monkeypatch.setattr(spans, "text_key", lambda text, salt=17: F.length(text).cast("bigint") if salt == 17 else real(text, salt))
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "abc")], "doc_id bigint, text string")
    texts, members = spans.text_classes(docs, "doc_id")
    assert members.select("tid").distinct().count() == 3 == texts.select("tid").distinct().count() and members.count() == 4


def test_empty(spark):
    assert spans.shared_cover(spark.createDataFrame([], "tid bigint, text string")).count() == 0
    assert spans.shared_groups(spark.createDataFrame([], "tid bigint, text string")).count() == 0


def test_sliding_minimum():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 333).astype(np.uint64)
    for w in (1, 2, 7, 300, 333):
        assert tk.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(len(v) - w + 1)]
