import pytest

from corpusloom.llm import mixing
from corpusloom.llm.tokens import DEFAULT_VOCABULARY, encoder, with_token_counts


def test_shortage_goes_to_siblings_before_other_domains():
    sources = [("wiki_en", 0.4, 1, 1000), ("wiki_de", 0.2, 1, 50), ("code_py", 0.4, 1, 1000)]
    plan = mixing.plan_budgets(sources, 1000)
    assert plan == pytest.approx({"wiki_en": 550, "wiki_de": 50, "code_py": 400})
    plan = mixing.plan_budgets([("wiki_en", 0.4, 1, 300), ("wiki_de", 0.2, 1, 50), ("code_py", 0.4, 1, 1000)], 1000)
    assert plan == pytest.approx({"wiki_en": 300, "wiki_de": 50, "code_py": 650})


def test_default_total_keeps_the_shares():
    plan = mixing.plan_budgets([("a_x", 0.5, 1, 1000), ("a_y", 0.3, 2, 60), ("b", 0.2, 1, 900), ("c", 0.0, 1, 10)])
    assert plan == pytest.approx({"a_x": 200, "a_y": 120, "b": 80, "c": 0})
    assert mixing.plan_budgets([]) == {} or sum(mixing.plan_budgets([]).values()) == 0


def test_mix_repeats_within_caps(spark):
    rows = [(k, "big", 10) for k in range(1000)] + [(2000 + k, "small", 10) for k in range(10)] + [(5000, None, 10), (5001, "other", 10), (5002, "big", 0), (5003, "big", None)] + [(0, "big", 10)]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id bigint, source string, n_tokens bigint, rank string")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("absent", 0.5, 2), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
    chosen, budget = mixing.mix(docs, targets)
    out = chosen.toPandas()
    uses = out.groupby("doc_id").size()
    assert uses[uses.index >= 2000].eq(3).all() and uses[uses.index < 2000].eq(1).all() and not out.duplicated(["doc_id", "epoch"]).any()
    share = out.groupby("source").n_tokens.sum() / out.n_tokens.sum()
    assert share["small"] == pytest.approx(0.2, abs=0.01)
    again = mixing.mix(docs.repartition(3), targets)[0].toPandas()
    assert set(zip(out.doc_id, out.epoch)) == set(zip(again.doc_id, again.epoch))
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0 and mixing.mix(docs, targets.limit(0))[0].count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "Hello world, hello!"), (2, ""), (3, None), (4, "naïve ☃ " * 5000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in with_token_counts(docs).collect()}
    coder = encoder(DEFAULT_VOCABULARY)
    assert got == {1: len(coder.encode_ordinary("Hello world, hello!")), 2: 0, 3: 0, 4: len(coder.encode_ordinary("naïve ☃ " * 5000))}
