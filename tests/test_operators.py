import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import codegraph, graph, logits, masks, nodesplits, packs, traversal
from corpusloom.operators.components import connected_components
from corpusloom.sources import shards, sinks
from corpusloom.sources import text as src
from corpusloom.streaming import context as ctx


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5), (None, 3)]
    parent = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.label for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    rounds = connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"), task_edges=3)
    assert {r.id: r.label for r in rounds.collect()} == got
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)], "src bigint, dst bigint")
    got = {}
    for r in graph.strong_components(e).collect():
        got.setdefault(r.label, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4, 5], [6], [7]]
    rounds = graph.strong_components(e, task_edges=0)
    assert {(r.id, r.label) for r in rounds.collect()} == {(x, k) for k, m in got.items() for x in m}


def test_strong_components_of_a_long_chain(spark):
    # 150 cycles of two whose ids fall along the chain
    e = [(2 * k, 2 * k + 1) for k in range(150)] + [(2 * k + 1, 2 * k) for k in range(150)] + [(2 * k, 2 * k - 1) for k in range(1, 150)]
    got = {r.id: r.label for r in graph.strong_components(spark.createDataFrame(e, "src bigint, dst bigint")).collect()}
    assert got == {x: x | 1 for x in range(300)}
    few = [p for p in e if max(p) < 12]
    got = {r.id: r.label for r in graph.strong_components(spark.createDataFrame(few, "src bigint, dst bigint"), task_edges=0).collect()}
    assert got == {x: x | 1 for x in range(12)}


def test_adjacency_keeps_dangling_targets_and_isolated_nodes(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("a", "zz"), ("a", "a"), ("a", "b"), ("zz", "a")], "src string, dst string")
    got = {r.id: (r.outgoing, r.incoming) for r in graph.adjacency(n, e).collect()}
    assert got == {"a": (["a", "b", "zz"], ["a"]), "b": ([], ["a"]), "c": ([], [])}


def test_k_core_and_bfs(spark):
    clique = [(a, b) for a in "abcd" for b in "abcd" if a < b]
    n = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    e = spark.createDataFrame([*clique, ("d", "e"), ("e", "f"), ("f", "g")], "src string, dst string")
    assert {r.id for r in graph.k_core(n, e, 3).collect()} == set("abcd")
    levels = graph.bfs_levels(e, spark.createDataFrame([("d",)], "id string"))
    assert {r.id: r.level for r in levels.collect()} == {"d": 0, "e": 1, "f": 2, "g": 3}


def test_import_resolution(spark):
    files = spark.createDataFrame([("r", p, k) for k, p in enumerate(["pkg/a.py", "pkg/b.py", "pkg/__init__.py", "pkg/sub/c.py", "main.py"])], "repo string, path string, ord bigint")
    asked = spark.createDataFrame([("r", "main.py", "pkg.a"), ("r", "main.py", "pkg"), ("r", "pkg/a.py", ".b"), ("r", "pkg/sub/c.py", "..b"), ("r", "main.py", "pkg.a.x"), ("r", "main.py", "nope")], "repo string, path string, import string")
    got = {(r.path, r["import"]): r.target for r in codegraph.resolve_imports(files, asked, codegraph.module_table(files)).collect()}
    assert got == {("main.py", "pkg.a"): "pkg/a.py", ("main.py", "pkg"): "pkg/__init__.py", ("pkg/a.py", ".b"): "pkg/b.py", ("pkg/sub/c.py", "..b"): "pkg/b.py", ("main.py", "pkg.a.x"): "pkg/__init__.py"}


def test_truncation_closed_form_equals_the_sequential_one(spark):
    rng = random.Random(5)
    rows = [(p, k, rng.randrange(1, 30)) for p in range(12) for k in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "pack_id bigint, pos int, body_len bigint")
    for side in ("head", "tail"):
        got = {(r.pack_id, r.pos): r.kept_len for r in packs.truncate_packs(df, 50, side).collect()}
        want = {}
        for p in range(12):
            for k, n, _ in traversal.trim_pack([(k, n, False) for q, k, n in rows if q == p], 50, side):
                want[(p, k)] = n
        assert got == want
    assert traversal.trim_pack([(0, 5, False), (1, 5, False), (2, 5, False)], 11, "head") == [(0, 1, True), (1, 5, False), (2, 5, False)]


def test_ordering_and_layout(spark):
    assert packs.targets_first([0, 1, 2], [(0, 1), (1, 2)]) == [2, 1, 0]
    assert packs.targets_first([0, 1, 2], [(0, 0), (1, 0), (2, 5)]) == [2, 0, 1]
    # an unlocked document goes before later ones that waited for nothing
    assert packs.targets_first([0, 1, 2, 3], [(0, 1)]) == [1, 0, 2, 3]
    with pytest.raises(ValueError):
        packs.make_layout("nope")
    with pytest.raises(ValueError):
        packs.PackSettings(0)
    row = spark.createDataFrame([("Python",), (None,)], "r string").select(packs.char_codes(packs.title_text(F.col("r"))).alias("t")).collect()
    assert row[0].t == [ord(c) for c in "# Python\n\n"] and row[1].t == [ord(c) for c in "# \n\n"]


def test_strategies_on_chains():
    chain = traversal.Csr.build(4, np.array([0, 1, 2]), np.array([1, 2, 3]))
    for deep in (False, True):
        s = traversal.Search(chain, random.Random(0), depth_first=deep)
        s.reset(0)
        assert [s.step() for _ in range(4)] == [0, 1, 2, 3]
    w = traversal.RandomWalk(chain, random.Random(0), mode="out")
    w.reset(0)
    assert [w.step(), w.step(), w.step()] == [1, 2, 3]

    class Fixed(traversal.RandomPick):
        def __init__(self, v):
            self.v = v

        def step(self):
            return self.v

    c = traversal.Composite([Fixed(0), Fixed(1)], random.Random(0))
    assert [c.step() for _ in range(4)] == [0, 1, 0, 1]
    c = traversal.Composite([Fixed(0), Fixed(1)], random.Random(0), "per_step_random", [0, 10])
    assert {c.step() for _ in range(20)} == {1}


def test_sampled_packs_keep_their_budget(spark):
    n = spark.createDataFrame([(k, 40 + k % 7) for k in range(60)], "node bigint, length bigint")
    e = spark.createDataFrame([(k, (k * 7 + 1) % 60) for k in range(60)], "src bigint, dst bigint")
    out = traversal.sampled_packs(n, e, [1, 2], 3, "bfs", packs.PackSettings(300, 45)).toPandas()
    assert (out.groupby(["seed", "pack"]).length.sum() == 300).all() and not out.duplicated(["seed", "pack", "node"]).any()


def test_grants_equal_the_dense_definition(spark):
    rng = random.Random(8)
    spans, links = [], []
    for p in range(6):
        at = 0
        for doc in range(rng.randrange(2, 8)):
            n = rng.randrange(2, 20)
            spans.append((p, doc, f"d{doc}", at, at + n))
            at += n
        for _ in range(10):
            links.append((p, rng.randrange(1, at + 1), f"d{rng.randrange(8)}"))
    s = spark.createDataFrame(spans, "pack_id bigint, doc_id bigint, key string, span_start bigint, span_end bigint")
    l = spark.createDataFrame(links, "pack_id bigint, link_end bigint, target string").distinct()  # noqa: E741
    granted = masks.grants(masks.match_links(l, s), s, F.lit(10**6))
    bits = masks.grant_bitmasks(granted).collect()
    q = {(r.pack_id, r.position, r.chunk): r.bits for r in bits if r.side == "q"}
    kv = {(r.pack_id, r.position, r.chunk): r.bits for r in bits if r.side == "kv"}
    dense = set()
    for p, end, target in set(links):
        source = next(x for x in spans if x[0] == p and x[3] < end <= x[4])
        found = [x for x in spans if x[0] == p and x[2] == target and x[3] < end]
        dense |= {(p, i, j) for t in found for i in range(end, source[4]) for j in range(t[3], t[4])}
    masked = {(p, i, j) for (p, i, c), b in q.items() for (p2, j, c2), b2 in kv.items() if p == p2 and c == c2 and b & b2}
    assert masked == dense
    with pytest.raises(ValueError):
        masks.mask("nope")


def test_top_p_keeps_two(spark):
    rows = spark.createDataFrame([(1, 0, 10.0), (1, 1, 0.0), (1, 2, -1.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)], "row_id bigint, token_id int, logit double")
    got = {(r.row_id, r.token_id) for r in logits.top_p(rows, 0.5).collect()}
    assert got == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert {r.token_id for r in logits.greedy(rows).where("row_id = 2").collect()} == {0}


def test_split_nodes(spark):
    cliques = [(f"{c}{i}", f"{c}{j}") for c, n in (("a", 20), ("b", 12), ("c", 10)) for i in range(n) for j in range(i)]
    ids = sorted({x for p in cliques for x in p})
    n = spark.createDataFrame([(x, 500 + 100 * k) for k, x in enumerate([*ids, "lonely"])], "id string, char_count bigint")
    e = spark.createDataFrame(cliques, "src string, dst string")
    out = {r.id: r.split for r in nodesplits.split_nodes(n, e, 3, 0.1, 0.3, seed=1).collect()}
    assert set(out) == set(ids) and {"train", "val_random", "val_community"} == set(out.values())
    held = {x for x, s in out.items() if s == "val_community"}
    assert all(sum(x in p and set(p) <= held for p in cliques) >= 3 for x in held)
    with pytest.raises(ValueError):
        nodesplits.eligible(n, e.limit(0), 1)


def test_val_community_is_refilled_after_pruning(spark, monkeypatch):
    # triangles, and many more rings with tails that lose nodes when pruned
    pairs = [(f"{a}{k:03}", f"{b}{k:03}") for k in range(60) for a, b in ("ab", "bc", "ca")]
    pairs += [(f"p{k:03}", f"p{k + 1:03}") for k in range(300)]
    ids = sorted({x for p in pairs for x in p})
    n, e = spark.createDataFrame([(x, 500) for x in ids], "id string, char_count bigint"), spark.createDataFrame(pairs, "src string, dst string")
    out = {r.id: r.split for r in nodesplits.split_nodes(n, e, 2, 0.05, 0.1, seed=7).collect()}
    held = {x for x, s in out.items() if s == "val_community"}
    assert 0.09 <= len(held) / len(out) <= 0.115
    # chains lose nodes when pruned; rounds of joins choose the same nodes as one task
    few = e.where("src < 'a020' or src < 'b020' and src >= 'b' or src < 'c020' and src >= 'c' or src between 'p000' and 'p040'")
    one = {tuple(r) for r in nodesplits.split_nodes(n, few, 2, 0.05, 0.2, seed=7).collect()}
    monkeypatch.setattr(nodesplits, "TASK_EDGES", 0)
    assert {tuple(r) for r in nodesplits.split_nodes(n, few, 2, 0.05, 0.2, seed=7).collect()} == one
    assert all(sum(x in p and set(p) <= held for p in pairs) >= 2 for x in held)


def test_every_community_competes():
    kinds = np.array([[2, 0], [1, 1], [0, 2]])
    taken = nodesplits.choose_profiles(kinds, np.array([2, 2, 2]), np.array([30_000, 30_000, 30_000]), np.zeros(2), 0, 180_000, np.array([3, 1]), 0.5)
    assert taken.sum() * 2 == 90_000 and abs((taken @ kinds)[0] / 90_000 - 0.75) < 0.001
    # far from the target an overshooting community is taken, near it passed over
    assert nodesplits.choose_profiles(np.array([[9]]), np.array([9]), np.array([1]), np.zeros(1), 0, 100, np.array([1]), 0.05).tolist() == [1]
    assert nodesplits.choose_profiles(np.array([[9]]), np.array([9]), np.array([1]), np.array([4]), 4, 100, np.array([1]), 0.05).tolist() == [0]


def test_label_communities_reach_the_fixpoint(spark, monkeypatch):
    rng = random.Random(11)
    pairs = [(f"c{k:03}", f"c{k + 1:03}") for k in range(60)] + [(f"r{rng.randrange(150):03}", f"r{rng.randrange(150):03}") for _ in range(190)]
    ids = sorted({x for p in pairs for x in p} | {"lonely"})
    n, e = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string")
    near = {x: {b for p in pairs for a, b in (p, p[::-1]) if a == x and b != x} for x in ids}
    got = {r.id: r.community for r in nodesplits.label_communities(n, e).collect()}
    assert set(got) == set(ids) and got["lonely"] == "lonely"
    for x in ids:
        votes = [got[y] for y in near[x]]
        assert not votes or got[x] == min(votes, key=lambda c: (-votes.count(c), c))
    few = e.where("src in ('c000', 'c001', 'c002', 'c003', 'c004', 'r001', 'r002', 'r003')")
    task = {tuple(r) for r in nodesplits.label_communities(n, few, rounds=1).collect()}
    monkeypatch.setattr(nodesplits, "TASK_EDGES", 0)
    assert {tuple(r) for r in nodesplits.label_communities(n, few, rounds=1).collect()} == task


def test_shards_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a", [0, 1, 2, 3, 4]), ("b", [10, 11, 12]), ("c", list(range(20, 26))), ("d", None)], "normed_identifier string, tokens array<int>")
    places = shards.write_shards(docs, str(tmp_path), "uint16", "chars", capacity=1024 + 18)
    rows = {r.normed_identifier: r for r in places.collect()}
    assert [(rows[k].tok_shard_idx, rows[k].tok_offset_bytes, rows[k].tok_len) for k in "abc"] == [(0, 1024, 5), (0, 1034, 3), (1, 1024, 6)]
    back = {r.normed_identifier: r.tokens for r in shards.read_tokens(spark, str(tmp_path), places).collect()}
    assert back == {"a": [0, 1, 2, 3, 4], "b": [10, 11, 12], "c": list(range(20, 26))}
    broken = places.withColumn("tok_len", F.lit(99).cast("bigint"))
    assert all(r.tokens is None for r in shards.read_tokens(spark, str(tmp_path), broken).collect())
    with pytest.raises(ValueError):
        shards.read_header(b"\0" * 1024)


def test_readers(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.json").write_text('{"namespace":0,"title":"T","source_text":"s","page_id":1}\n{"namespace":1,"title":"U","source_text":"s"}\nnot json\n{"namespace":0,"title":"V"}\n')
    assert [r.title for r in src.read_articles(spark, str(tmp_path / "w")).collect()] == ["T"]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "y.json").write_text("\n".join(json.dumps({"namespace": 0, "title": f"Y{k}", "source_text": "s"}) for k in range(3)))
    assert src.read_articles(spark, [str(tmp_path / "w"), str(tmp_path / "v")], 2).count() == 3
    docs = spark.createDataFrame([("doc_a", "Doc A", "first\nbody"), ("1x", "1x", "")], "normed_identifier string, raw_identifier string, body string")
    assert sinks.write_markdown_files(docs, str(tmp_path / "md")) == 2
    got = {r.normed_identifier: (r.raw_identifier, r.content) for r in src.read_markdown_folder(spark, str(tmp_path / "md")).collect()}
    assert got == {"doc_a": ("Doc A", "first\nbody"), "1x": ("1x", "")}
    rows = spark.createDataFrame([("a/b", "x.py", "c"), ("a/b", "x.py", "c"), ("", "y", "c"), ("a/b", None, "c"), ("a/b", "z", "")], "max_stars_repo_name string, max_stars_repo_path string, content string")
    assert src.stack_documents(rows).count() == 2
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps({"normed_identifier": k, "tok_len": n, "tok_shard_idx": 0, "tok_offset_bytes": o}) for k, n, o in [("a", 1, 5), ("b", 2, 6), ("a", 3, None)]))
    g = src.read_graph(spark, str(tmp_path / "g.jsonl"))
    assert {r.normed_identifier: r.tok_len for r in g.collect()} == {"a": 3, "b": 2}
    with pytest.raises(Exception, match="node a has no integer tok_offset_bytes"):
        src.checked_nodes(g).collect()
    (tmp_path / "s.json").write_text(json.dumps({"splits": {"train": {"count": 1, "fraction": 1.0, "ids": ["a"]}}}))
    assert [tuple(r) for r in src.split_lookup(spark, str(tmp_path / "s.json")).collect()] == [("a", "train")]
    page = spark.createDataFrame([('<a href="20250101/">x</a><a href="20250301/">y</a><a href="latest/">z</a>',)], "h string")
    assert page.select(src.latest_dump(F.col("h"))).first()[0] == "20250301"


def test_context_rules():
    s = ctx.ContextSettings(max_context=20, max_aux_docs=2, max_link_depth=0, max_doc_tokens=6)
    c = ctx.Context(s)
    c.add_root("r", 5)
    docs = {"a": (4, ["b"], None), "b": (4, ["d"], None), "d": (4, [], None), "e": (9, [], None)}
    for target in ("a", "a", "", None, "zz"):
        c.follow(target, "r", 0, docs.get)
    assert [d.identifier for d in c.docs] == ["a", "r"] and c.aux() == 1
    c.follow("b", "r", 0, docs.get)
    c.follow("e", "r", 0, docs.get)
    assert [d.identifier for d in c.docs] == ["b", "e", "r"] and [d.identifier for d in c.evicted] == ["a"]
    again = ctx.Context.load(s, c.dump())
    assert again.spans() == c.spans() == [("b", 0, 4), ("e", 4, 13), ("r", 13, 18)]
    assert [d.identifier for d in c.all_documents()] == ["r", "b", "e", "a"]
    with pytest.raises(ValueError):
        c.add_root("q", 1)
    for bad in ({"max_new_tokens": 0}, {"top_k": 0}, {"top_p": 1.5}, {"temperature": -1}):
        with pytest.raises(ValueError):
            ctx.GenerationSettings(**bad)
