import random

import numpy as np
import pytest

from corpusloom.llm import grammar, sourcekind

RNG = random.Random(6)


def word():
    return "".join(RNG.choice("bdgklmnprst") + RNG.choice("aeiou") for _ in range(3))


def code(n=30):
    forms = ["def {0}({1}, {2}=None):\n    return {1} + {3}\n", "{0} = [{1} for {1} in {2} if {3}]\n", "for {0} in {1}:\n    {2}.append({0} * 3)\n", "class {0}:\n    {1} = '{2}'\n", "if {0} is None or {1} > 4:\n    raise ValueError('{2} {3}')\n", "while {0} < len({1}):\n    {0} += {2}.{3}()\n", "with open({0}) as {1}:\n    {2} = {1}.read()\n"]
    return "".join(RNG.choice(forms).format(*[word() for _ in range(4)]) for _ in range(n))


UPSTREAM = code(60)
MIN = "".join(f'for(var {a}=0;{a}<{k};{a}++){b}.push({c});{c}.{word()}=function(){{return"{word()}"}};' for k, (a, b, c) in enumerate([("a", "b", "c"), ("d", "e", "f"), ("g", "h", "i")] * 12))
CASES = [
    (code(), "r/x", None), ("", "r/x", None), (None, "r/x", None), ("  \n", "r/x", None),
    ("# Code generated by foogen. DO NOT EDIT.\n" + code(), "r/x", "generated"), (code() + "\n\n# @generated by foogen 1.2\n", "r/x", "generated"),
    ('HEADER = """# Code generated by foogen. DO NOT EDIT.\n# @generated by x\n"""\n' + code(), "r/x", None),
    ("".join(f"_F{k:04d} = ({k * 7}, {k * 11}, 0x{k * 991:04x}, '{word()}')\n" for k in range(50)), "r/x", "generated"),
    (MIN, "r/x", "minified"), ("X = [\n" + ",\n".join(", ".join(str(RNG.randrange(-30000, 30000)) for _ in range(12)) for _ in range(30)) + "]\n", "r/x", "data"),
    ("blob = (b'" + "'\n    b'".join("".join(f"\\x{RNG.randrange(256):02x}" for _ in range(16)) for _ in range(20)) + "')\n", "r/x", "data"),
    (UPSTREAM, " Other/Repo", "vendored"), ("# copied\n" + UPSTREAM.replace("None", "0")[: len(UPSTREAM) * 3 // 4], "other/repo", "vendored"), (UPSTREAM, "HOME/pkg ", None), (UPSTREAM, None, "vendored"),
    (code() + "T = [1, 2, 3, 4, 5, 6]\n", "r/x", None), ("".join(f"{word().upper()}={RNG.choice(['true', word(), '/var/' + word(), '42'])}\n" for _ in range(20)), "r/x", None),
]


def test_kinds(spark):
    rows = [(k, repo, text, "z") for k, (text, repo, _) in enumerate(CASES)]
    files = spark.createDataFrame(rows + rows[:12], "file_id bigint, repo string, content string, home string")
    known = spark.createDataFrame([("Home/pkg", UPSTREAM), ("Home/pkg", UPSTREAM), ("x/y", None)], "home_repo string, content string")
    got = {r.file_id: r.kind for r in sourcekind.kinds(files, known).collect()}
    assert got == {k: kind for k, (_, _, kind) in enumerate(CASES) if kind}
    assert sourcekind.kinds(files.limit(0), known.limit(0)).count() == 0


def _tokens(texts):
    data, offsets = grammar.batch_bytes(texts)
    return grammar.tokenize(data, offsets)


def test_grammar_of_repetition_is_small_and_covers():
    t = _tokens(["a b c " * 200, " ".join(f"w{k}" for k in range(600)), "", "p q x p q y p q z"])
    left, rules, alone = grammar.infer(t.exact, t.owner, 4)
    assert left[0] + 2 * rules[0] < 60 and not alone[t.owner == 0].any()
    assert left[1] == 600 and rules[1] == 0 and alone[t.owner == 1].all() and left[2] == 0
    assert (left[3], rules[3], alone[t.owner == 3].sum()) == (6, 1, 3)


def test_frequent_pairs_are_replaced_first():
    # "b c" is more frequent than "a b" and takes the b they share
    t = _tokens(["a b c 1 a b c 2 b c 3"])
    left, rules, alone = grammar.infer(t.exact, t.owner, 1)
    assert rules[0] == 2 and left[0] == 6


def test_deep_repetition_is_shortened_to_the_end():
    t = _tokens(["k l " * (1 << 16)])
    left, rules, _ = grammar.infer(t.exact, t.owner, 1)
    assert left[0] + 2 * rules[0] < 80


@pytest.mark.parametrize("seed", range(5))
def test_rules_of_a_common_passage(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    common = words(200)
    t = _tokens([words(50) + " " + common + " " + words(70), common + " " + words(9)])
    tables = [np.random.default_rng(seed).integers(0, 6, grammar.PAIR_BUCKETS).astype(np.uint8) for _ in range(3)]
    rule, owner, width = grammar.passages(t.exact, t.owner, tables)
    shared = np.intersect1d(rule[owner == 0], rule[owner == 1])
    assert width[(owner == 0) & np.isin(rule, shared)].sum() > 120


def test_small_copies_count_only_as_a_whole(spark):
    text = "x = alpha(beta)\ny = gamma\n"
    files = spark.createDataFrame([(1, "o/p", text), (2, "o/p", text.replace("gamma", "delta")), (3, "h/h", text), (4, "o/p", "x = 1")], "file_id bigint, repo string, content string")
    known = spark.createDataFrame([("h/h", text)], "home_repo string, content string")
    assert {r.file_id for r in sourcekind.kinds(files, known).collect()} == {1}
