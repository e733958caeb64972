import random
import re

from corpusloom.llm import crosssplit as cs


def shingles(text):
    w = re.findall("[a-z0-9_]+", text.lower())
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, key = {}, 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        for edits in (0, 0, 1, 3, 8, 14):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[f"k{key}"] = " ".join(copy) if edits != 1 else "\t".join(copy).upper()
            key += 1
    texts |= {"e1": "", "e2": "one two", "e3": None, "e4": "one two"}
    side = {k: rng.choice(["train", "eval"]) for k in texts}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] * 2, "key string, text string, set_id int")
    tags = spark.createDataFrame([(k, s) for k, s in side.items()], "key string, side string")
    tagged = cs.fingerprints(df).join(tags, "key")
    pairs = cs.cross_pairs(tagged, df, 0.7)
    train, held = tagged.where("side = 'train'").select("key", "set_id").toDF("a", "set_a").distinct(), tagged.where("side = 'eval'").select("key", "set_id").toDF("b", "set_b").distinct()
    got = {(r.a, r.b) for r in pairs.join(train, "set_a").join(held, "set_b").collect()}
    sets = {k: shingles(t) for k, t in texts.items() if t}
    want = {(a, b) for a in sets for b in sets if side[a] == "train" and side[b] == "eval" and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert len(want) > 50 and got == want


def test_recall_just_above_the_threshold(spark):
    """Pairs of a similarity between 0.70 and 0.74 are found by segments and radius."""
    rng = random.Random(21)
    texts, want = [], set()
    while len(want) < 400:
        base = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(60, 160))]
        other = list(base)
        for at in rng.sample(range(len(base)), max(1, round(len(base) * 0.057))):
            other[at] = f"v{rng.randrange(50_000)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if 0.70 <= len(a & b) / len(a | b) < 0.74:
            k = len(want)
            texts += [(f"t{k}", " ".join(base), "train"), (f"e{k}", " ".join(other), "eval")]
            want.add((f"t{k}", f"e{k}"))
    df = spark.createDataFrame(texts, "key string, text string, side string")
    tagged = cs.fingerprints(df).join(df.select("key", "side"), "key")
    names = {r.set_id: r.key for r in tagged.select("set_id", "key").collect()}
    got = {(names[r.set_a], names[r.set_b]) for r in cs.cross_pairs(tagged, df, 0.7).collect()}
    assert len(got & want) >= 0.995 * len(want)


def test_empty(spark):
    none = spark.createDataFrame([], "key string, text string")
    tagged = cs.fingerprints(none).join(spark.createDataFrame([], "key string, side string"), "key")
    assert cs.cross_pairs(tagged, none, 0.7).count() == 0
