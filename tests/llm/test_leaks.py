import random

import numpy as np

from corpusloom.llm import leaks


def test_runs_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"v{k}x" for k in range(400)] + ["the", "of", "and"] * 30
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, words(rng.randrange(5, 45))) for k in range(80)]
    docs = []
    for k in range(300):
        body = words(rng.randrange(0, 300))
        if rng.random() < 0.5:
            passage = rng.choice(items)[1]
            n = rng.choice([8, 11, 12, 13, 20, 45])
            at, s = rng.randrange(len(body) + 1), rng.randrange(max(1, len(passage) - n + 1))
            body[at:at] = passage[s : s + n]
        docs.append((k, rng.choice([" ", ", ", "-"]).join(body)))
    docs += [(9001, None), (9002, ""), docs[0], (9003, " ".join(items[0][1]).upper() * 3)]
    rows = [(k, " ".join(w), "q") for k, w in items] + [(700, None, "q"), (701, "", "q"), (702, " ".join(items[3][1]), "q"), (3, " ".join(items[3][1]), "q")]
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(rows, "item_id bigint, passage string, kind string"))
    got = {(r.doc_id, r.item_id) for r in found.where("kind = 'run'").collect()}

    def runs(text):
        w = leaks.words_of(text or "")
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    grams = {k: runs(t) for k, t, _ in rows}
    want = {(d, k) for d, t in docs for k, g in grams.items() if g and g & runs(t)}
    assert len(want) > 40 and len(got & want) / len(want) >= 0.99 and got <= want


def test_longest_runs():
    windows = np.array([[1, 2, 3, 4, 5, 6], [9, 3, 4, 5, 9, 1], [7, 7, 7, 7, 7, 7]])
    assert leaks.longest_runs(windows, np.array([2, 3, 4, 5, 1])).tolist() == [4, 3, 0]


def test_recall_of_projections_and_several_blocks(spark, monkeypatch):
    # more passages than the space has directions, in several blocks
    monkeypatch.setattr(leaks, "MAX_RANK", 96)
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 150)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(900)]
    items = [(k, [rng.choice(vocabulary) for _ in range(40)]) for k in range(300)]
    docs = []
    for k in range(240):
        passage = rng.choice(items)[1]
        s = rng.randrange(25)
        docs.append((k, " ".join([rng.choice(vocabulary) for _ in range(30)] + passage[s : s + 14] + ["other"] * 9)))
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, passage string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    grams = {}
    for k, w in items:
        for i in range(len(w) - 11):
            grams.setdefault(tuple(w[i : i + 12]), set()).add(k)
    want = {(d, k) for d, t in docs for i in range(len(t.split()) - 11) for k in grams.get(tuple(t.split()[i : i + 12]), ())}
    assert got <= want and len(got) >= 0.9 * len(want) > 200


def test_lcs_and_paraphrase(spark):
    assert leaks.lcs_length(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 1])) == 2
    passage = "amber bridge crosses delta every february giving homeward islanders joyful karma lately making numerous old people quite relaxed"
    changed = passage.replace("every", "each").replace("lately", "now").replace("giving", "bringing")
    docs = spark.createDataFrame([(1, "intro words here " + changed + " and more text"), (2, "nothing alike at all in this one text about other matters"), (3, "every lately giving")], "doc_id bigint, text string")
    out = leaks.find_leaks(docs, spark.createDataFrame([(5, passage)], "item_id bigint, passage string"), paraphrase_cosine=0.5)
    assert {(r.doc_id, r.item_id, r.kind) for r in out.collect()} == {(1, 5, "paraphrase")}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id bigint, passage string")
    assert leaks.find_leaks(docs, items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0
