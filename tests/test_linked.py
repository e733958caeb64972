import hashlib
import os
import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import imports as imp
from corpusloom.operators import detectors as det
from corpusloom.operators import joins, logits, masks, packs, traversal
from corpusloom.plans import linked
from corpusloom.sources import shards, vocabularies
from corpusloom.streaming import context as ctx

OPEN, MIDDLE, CLOSE = 1, 2, 3
PIECES = {OPEN: b"[", MIDDLE: b"](", CLOSE: b")", 4: b"Pier", 5: b" \xc3", 6: b"\xa9", 7: b"x) y", 8: b"  "}


def decode(tokens):
    return b"".join(PIECES[int(t)] for t in tokens).decode("utf-8", "replace")


def test_markdown_links_in_tokens():
    find = lambda tokens, **k: det.markdown_links(tokens, decode, (MIDDLE,), (OPEN,), **k)
    assert find([OPEN, 4, MIDDLE, 4, 5, 6, CLOSE, 4]) == [(7, "Pier é")]  # one letter in two tokens
    assert find([OPEN, 4, MIDDLE, 4, 7, 4]) == [(5, "Pierx")]  # the parenthesis within a token
    assert find([4, MIDDLE, 4, CLOSE]) == [] and find([OPEN, MIDDLE, 8, CLOSE]) == [] and find([OPEN, MIDDLE, 4]) == []
    assert find([OPEN] + [4] * 100 + [MIDDLE, 4, CLOSE]) == [] and len(find([OPEN] + [4] * 99 + [MIDDLE, 4, CLOSE])) == 1
    assert find([OPEN, MIDDLE] + [4] * 50 + [CLOSE]) == [] and len(find([OPEN, MIDDLE] + [4] * 49 + [CLOSE])) == 1
    assert find([]) == [] and find([MIDDLE]) == []


def test_imports_in_tokens():
    code = "import dock.crane as c, tug\nfrom port.pier import (\n    gate,  # the north one\n    lock\n)\nfrom . import x\nfrom .y import z\n"
    found = list(imp.statements(code))
    assert [(m, n) for m, n, _, _ in found] == [("dock.crane", ""), ("tug", ""), ("port.pier", "gate"), ("port.pier", "lock")]
    assert found[0][2:] == (0, 27) and code[found[2][2] : found[2][3]].endswith(")")
    links = det.char_import_links(det.char_tokens(code))
    assert (27, "tug.py") in links and (found[2][3], "port/pier/gate/__init__.py") in links and (found[2][3], "port/pier.py") in links
    assert det.token_at(np.array([0, 3, 5]), 4) == 2 and det.token_at(np.array([0, 3, 5]), 99) == 2 and det.token_at(np.array([0]), 1) == 0


def test_detected_links_of_null_and_empty_sequences(spark):
    rows = [(1, det.char_tokens("see [a](b c) and [d](e)")), (2, []), (3, None)]
    out = det.detected_links(spark.createDataFrame(rows, "pack_id bigint, tokens array<int>"), det.char_markdown_links)
    assert {tuple(r) for r in out.collect()} == {(1, 11, "b c"), (1, 21, "e")}


def test_char_positions_are_clamped(spark):
    tokens = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (2, 0, 1)], "d int, k int, n int")
    asked = spark.createDataFrame([(1, 3), (1, 4), (1, 99), (2, 0), (3, 1)], "d int, char int")
    got = {(r.d, r.char): r.token for r in det.positions_of_chars(tokens, asked, "d", "k", "n").collect()}
    assert got == {(1, 3): 0, (1, 4): 1, (1, 99): 1, (2, 0): 0}


@pytest.mark.parametrize("seed", range(3))
def test_linked_mask_by_brute_force(spark, seed):
    rng = random.Random(seed)
    spans, links = [], []
    for p in range(4):
        at = 0
        for doc in range(rng.randrange(1, 6)):
            n = rng.randrange(1, 9)
            spans.append((p, doc, f"d{doc}", at, at + n))
            at += n
        links += [(p, rng.randrange(1, at + 1), f"d{rng.randrange(6)}") for _ in range(6)]
    s = spark.createDataFrame(spans, "pack_id bigint, doc_id bigint, key string, span_start bigint, span_end bigint")
    granted = masks.grants(masks.match_links(spark.createDataFrame(list(set(links)), "pack_id bigint, link_end bigint, target string"), s), s, F.lit(10**6))
    total = {p: max(e for q, _, _, _, e in spans if q == p) for p in range(4)}
    asked = spark.createDataFrame([(p, q, k) for p in range(4) for q in range(total[p] + 1) for k in range(total[p] + 1)], "pack_id bigint, q bigint, k bigint")
    got = {(r.pack_id, r.q, r.k) for r in masks.may_see(asked, s, granted).where("allowed").collect()}

    def doc(p, x):
        return next((d for q, d, _, a, b in spans if q == p and a <= x < b), None)

    want = set()
    for p, q, k in ((p, q, k) for p in range(4) for q in range(total[p] + 1) for k in range(q + 1)):
        linked = False
        for p2, end, target in links:
            source = next((x for x in spans if x[0] == p and x[3] < end <= x[4]), None)
            to = next((x for x in spans if x[0] == p and x[2] == target and x[3] < end), None)
            linked |= p2 == p and source is not None and to is not None and end <= q < source[4] and to[3] <= k < to[4]
        if doc(p, q) == doc(p, k) or linked:
            want.add((p, q, k))
    assert got == want
    dense = {(r.pack_id, r.q, k) for r in masks.visible_ranges(s, granted).collect() for k in range(r.k_start, r.k_end)}
    assert dense == {x for x in want if x[1] < total[x[0]] and x[2] < total[x[0]]}
    lengths = spark.createDataFrame(list(total.items()), "pack_id bigint, t bigint")
    pairs = {r.pack_id: r.allowed for r in masks.linked_pairs(s.join(lengths, "pack_id"), granted, F.col("t")).collect()}
    assert pairs == {p: sum(x[0] == p and x[1] < total[p] and x[2] < total[p] for x in want) for p in range(4)}


def test_layout_tokens_count_towards_the_budget():
    n = 30
    src = np.arange(n - 1)
    graph = traversal.Csr.build(n, src, src + 1, np.full(n, 10), np.full(n, 5))
    settings = packs.PackSettings(100, pack_trim_side="tail")
    for pack in traversal.sample_packs(graph, 3, 5, "bfs", settings):
        assert sum(length + 5 for _, length, _ in pack) == 100 and len(pack) == 7
    assert traversal.trim_pack([(0, 10, False), (1, 10, False)], 25, "tail", [5, 5]) == [(0, 10, False), (1, 5, True)]
    many = traversal.endless_packs(graph, 1, "random", settings)
    assert len([next(many) for _ in range(40)]) == 40


def test_packed_sequences_and_their_spans(spark):
    placements = spark.createDataFrame([(1, 0, 0, 7, 3, True), (1, 0, 1, 8, 2, False), (1, 0, 2, 9, 4, False), (2, 0, 0, 8, 1, True)], "seed bigint, pack int, pos int, node bigint, length bigint, cut boolean")
    bodies = spark.createDataFrame([(7, [65, 66, 67, 68], "P", ["q"]), (8, [70, 71], "Q", None), (9, [], "R", [])], "node bigint, tokens array<int>, raw_identifier string, outgoing array<string>")
    out = {r.seed: r for r in packs.packed_sequences(placements, bodies, packs.make_layout("identifier_prefix_bos_eos", 1, 2)).collect()}
    title = lambda t: [ord(c) for c in f"# {t}\n\n"]
    assert out[1].tokens == [1, *title("P"), 65, 66, 67, 2, 1, *title("Q"), 70, 71, 2]
    assert [(s.node, s.span_start, s.span_end, s.outgoing) for s in out[1].spans] == [(7, 0, 10, ["q"]), (8, 10, 19, None)]
    assert {(r.seed, r.pack) for r in packs.first_packs(placements, 1).collect()} == {(1, 0)}


def test_draw_falls_back_on_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0, -inf), (1, 1, -inf), (2, 0, nan), (2, 1, 3.0), (2, 2, 9.0), (3, 0, 1.0), (3, 1, -inf), (4, 5, inf), (4, 6, 0.0)]
    u = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.99), (4, 0.9)], "row_id bigint, u double")
    got = {r.row_id: r.token_id for r in logits.draw(spark.createDataFrame(rows, "row_id bigint, token_id int, logit double"), u).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 6}


def test_pretokenized_graph_reads_back(spark, tmp_path):
    docs = spark.createDataFrame([("a", "pier"), ("b", ""), ("c", "quay é"), ("x", "no node"), ("a", "pier")], "normed_identifier string, content string")
    graph = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "normed_identifier string, char_count int")
    splits = spark.createDataFrame([("a", "train")], "normed_identifier string, split string")
    for folder in (str(tmp_path / "p"), f"file://{tmp_path}/q"):
        out = shards.pretokenize(docs, graph, lambda: lambda t: [ord(c) for c in t], folder, "code points", 256, splits)
        got = {r.normed_identifier: ("".join(map(chr, r.tokens)), r.split) for r in shards.read_tokens(spark, folder, out).collect()}
        assert got == {"a": ("pier", "train"), "c": ("quay é", None)}


def test_token_round_trip_keeps_a_part_of_its_shards_at_a_time(spark, tmp_path, monkeypatch):
    rows = [(f"org/r{k % 7}", f"f{k}.py", "x = 'naïve 🜁'\n" * (k % 9 + 1)) for k in range(200)]
    rows += [rows[3], ("org/r1", "two.py", "a"), ("org/r1", "two.py", "b"), ("org/r1", "none.py", "")]
    spark.createDataFrame(rows, "max_stars_repo_name string, max_stars_repo_path string, content string").write.parquet(str(tmp_path / "stack_file.parquet"))
    wanted = {(len(c), hashlib.md5(c.encode()).hexdigest(), True) for _, _, c in rows[:200]}
    whole = sum(len(c) * 4 for _, _, c in rows[:200])
    monkeypatch.setattr(shards, "PART_BYTES", whole // 8, raising=False)
    seen, info = [], shards.read_json

    def sized(folder, name):  # is called when the shards are written and about to be read
        files = [f for f in pathlib.Path(session.shared_dir(spark).removeprefix("file:"), "corpusloom").rglob("shard_*.bin")]
        seen.append(sum(f.stat().st_size for f in files) - before)
        return info(folder, name)

    before = sum(f.stat().st_size for f in pathlib.Path(session.shared_dir(spark).removeprefix("file:"), "corpusloom").rglob("shard_*.bin"))
    monkeypatch.setattr(shards, "read_json", sized)
    got = linked.token_round_trip(spark, str(tmp_path)).collect()
    assert len(got) == 200 and {tuple(r)[1:] for r in got} == wanted
    assert len(seen) >= 8 and max(seen) < whole / 3 and sum(seen) > whole
    folders = pathlib.Path(session.shared_dir(spark).removeprefix("file:"), "corpusloom")
    assert sum(f.stat().st_size for f in folders.rglob("shard_*.bin")) == before


def test_batches_of_encoded_and_read_documents_keep_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BATCH_TOKENS", 5)  # the workers of this session see the module's own
    kind = pa.list_(pa.int32())
    assert [a.to_pylist() for a in shards._batches(iter([[1, 2], None, np.array([3, 4, 5]), [], [6], None]), kind)] == [[[1, 2], None, [3, 4, 5]], [[], [6], None]]
    assert not list(shards._batches(iter([]), kind)) and [a.to_pylist() for a in shards._batches(iter([None]), kind)] == [[None]]
    docs = spark.createDataFrame([("a", "pier"), ("b", None), ("c", "é🜁")], "normed_identifier string, content string").coalesce(1)
    places = shards.write_shards(shards.encode_documents(docs, lambda: lambda t: np.array([ord(c) for c in t], dtype="<i4")), str(tmp_path), "uint32", "code points")
    more = places.unionByName(spark.createDataFrame([("x", 0, 1024, 999), ("y", None, None, None)], "normed_identifier string, tok_shard_idx bigint, tok_offset_bytes bigint, tok_len bigint"))
    texts = shards.read_texts(spark, str(tmp_path), more, lambda: lambda t: "".join(map(chr, t)))
    assert {r.normed_identifier: r.text for r in texts.collect()} == {"a": "pier", "c": "é🜁", "x": None, "y": None}


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabulary files")
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_vocabulary_files(spark, name):
    text = "North pier, 12 quays; naïve <|endoftext|>"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, content string")
    got = {r.k: r.tokens for r in shards.encode_documents(docs, vocabularies.load(f"/opt/tokenizers/{name}")).collect()}
    vocabulary = vocabularies.open_vocabulary(f"/opt/tokenizers/{name}")
    assert vocabulary.decode(got[1]) == text and got[2] is None and got[3] == [] and max(got[1]) < vocabulary.size
    with pytest.raises(ValueError):
        vocabularies.open_vocabulary("x.txt")


def test_broadcast_side_is_checked_in_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    df = spark.createDataFrame([(k, "x" * 1000, [1]) for k in range(20)], "k int, t string, a array<int>")
    assert hinted(joins.bounded(df, 20)) and not hinted(joins.bounded(df, 19)) and not hinted(joins.bounded(df, 20, 1000)) and hinted(joins.bounded(df.limit(0)))


def test_intermediate_tables_are_deleted(spark):
    with session.scratch():
        kept = session.materialize(spark.range(3))
        path = kept._loom_path
        assert kept.count() == 3 and any(p == path for _, p in session._TABLES)
    assert not any(p == path for _, p in session._TABLES)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path).count()


def test_a_cluster_without_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = Conf  # noqa: N815

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())


def corpus(docs):
    return lambda t: (docs[t][0], docs[t][1], None) if t in docs else None


def test_contexts_follow_links_to_their_depth():
    docs = {"a": (4, ["b"]), "b": (4, ["c"]), "c": (4, ["d"]), "d": (4, [])}
    for depth, want in ((0, ["a", "r"]), (1, ["b", "a", "r"]), (2, ["c", "b", "a", "r"])):
        c = ctx.Context(ctx.ContextSettings(max_link_depth=depth))
        c.add_root("r", 5)
        c.follow("a", "r", 0, corpus(docs))
        assert [d.identifier for d in c.docs] == want
    assert [d.depth for d in c.docs] == [3, 2, 1, 0]


def test_eviction_policies_and_written_documents():
    docs = {"a": (6, []), "b": (6, []), "e": (30, [])}
    for policy, want in (("drop_oldest", ["b", "r"]), ("stop_new", ["a", "r"])):
        c = ctx.Context(ctx.ContextSettings(max_context=15, eviction_policy=policy))
        c.add_root("r", 5)
        for t in ("a", "b"):
            c.follow(t, "r", 0, corpus(docs))
        assert [d.identifier for d in c.docs] == want
    c = ctx.Context(ctx.ContextSettings(max_context=15, restore_evicted=True))
    c.add_root("r", 5)
    for t in ("a", "b", "a"):
        c.follow(t, "r", 0, corpus(docs))
    assert [d.identifier for d in c.docs] == ["a", "r"] and [d.identifier for d in c.evicted] == ["b"]
    # a document that is to be written needs room for its limit, and only below the depth
    for room, depth, want in ((10, 0, ["g", "r"]), (9, 0, ["r"]), (10, 2, ["r"])):
        c = ctx.Context(ctx.ContextSettings(max_context=5 + room, max_doc_tokens=10, allow_generation=True))
        c.add_root("r", 5)
        c.follow("g", "r", depth, corpus({}))
        assert [d.identifier for d in c.docs] == want
    with pytest.raises(ValueError):
        ctx.ContextSettings(eviction_policy="largest")


def test_documents_written_token_by_token():
    texts = {"r": "x [k](a) and [k](g) [k](a) end", "g": "made [k](b)!"}
    docs = {"a": (4, []), "b": (3, [])}
    settings = ctx.GenerationSettings(max_new_tokens=100, max_tokens_per_document=100)
    c = ctx.Context(ctx.ContextSettings(allow_generation=True, max_doc_tokens=20))
    root = c.add_root("r", 0, [])
    c.write(root, lambda e: det.char_tokens(texts[e.identifier]), settings, det.char_markdown_links, corpus(docs), lambda t: t == ord(")"))
    assert [(d.identifier, d.depth, d.done) for d in c.docs] == [("a", 1, True), ("b", 2, True), ("g", 1, True), ("r", 0, True)]
    assert det.char_text(root.tokens) == texts["r"] and c.sequence() == c.docs[2].tokens + root.tokens
    for limits, length, cut in (({"max_new_tokens": 5, "max_tokens_per_document": 9}, 5, False), ({"max_new_tokens": 9, "max_tokens_per_document": 5}, 5, True), ({"end_token": ord("x")}, 1, False)):
        c = ctx.Context(ctx.ContextSettings())
        root = c.add_root("r", 0, [])
        c.write(root, lambda e: det.char_tokens(texts["r"]), ctx.GenerationSettings(**limits), det.char_markdown_links, corpus({}))
        assert (root.length, root.truncated, root.done) == (length, cut, True)


def test_batch_contexts_read_closures(spark):
    rows = [("a", 4, ["b", None, ""]), ("b", 4, ["c", "a"]), ("c", 4, ["zz"]), ("d", 4, None)]
    documents = spark.createDataFrame(rows, "target string, length bigint, links array<string>")
    known = {r.target: set(r.known.targets) for r in ctx.closures(documents, 1).collect()}
    assert known == {"a": {"a", "b"}, "b": {"b", "c", "a"}, "c": {"c"}, "d": {"d"}}
    sessions = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "nope", 5), (1, 3, None, 5), (2, 1, "d", 5)], "session bigint, ord int, target string, root_length int")
    out = ctx.assemble_contexts(sessions, documents, ctx.ContextSettings(max_link_depth=1)).where("active").collect()
    assert {(r.session, r.identifier, r.depth) for r in out} == {(1, "session 1", 0), (1, "a", 1), (1, "b", 2), (2, "session 2", 0), (2, "d", 1)}
