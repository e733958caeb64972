from datetime import datetime

from corpusloom.operators import references as ref

T = [datetime(2025, 1, d) for d in range(1, 10)]
LINES = "node_id bigint, normed_identifier string, outgoing array<string>, incoming array<string>, ref_period string, ref_loaded_at timestamp, has_line string"


def _setup(spark):
    lines = spark.createDataFrame([
        (1, "a", ["b", " gone ", None, "", "b", "hub"], None, "202501", T[1], "x"), (2, "b", ["late", "removed"], ["a"], None, T[2], "x"), (3, "late", None, [], "202502", T[5], "x"), (4, "c", ["a"], None, "202502", None, None),
    ], LINES)
    every = spark.createDataFrame([("a", T[1]), ("b", T[2]), (" late", T[5]), ("c", None), ("removed", T[3]), (None, T[1])], "normed_identifier string, loaded_at timestamp")
    gone = spark.createDataFrame([("removed", T[6]), ("removed", T[6]), ("b", T[0]), (None, T[0])], "normed_identifier string, removed_at timestamp")
    return lines, every, gone


def test_direct_orphans(spark):
    lines, every, gone = _setup(spark)
    refs = ref.explode_references(lines, ("outgoing", "incoming"))
    refs = ref.without_exempt(refs, spark.createDataFrame([("hub",), (None,)], "target string"))
    out = ref.orphan_references(refs, ref.target_status(every, gone))
    assert {(r.node_id, r.field, r.target, r.ref_period, r.reason) for r in out.collect()} == {
        (1, "outgoing", "gone", "202501", "missing"), (1, "outgoing", "b", "202501", "late"), (2, "outgoing", "late", None, "late"), (2, "outgoing", "removed", None, "deleted"),
    }


def test_cascade_reaches_the_fixpoint(spark):
    pairs = [("a", "x"), ("b", "a"), ("c", "b"), ("d", "c"), ("d", "d"), ("e", "f"), ("f", "e"), ("b", "a")]
    refs = spark.createDataFrame([("o", *p) for p in pairs] + [("i", "z", "a")], "field string, normed_identifier string, target string")
    direct = spark.createDataFrame([("o", "a"), ("o", "a")], "field string, normed_identifier string")
    got = {(r.field, r.key): r["round"] for r in ref.orphan_cascade(refs, direct).collect()}
    assert {(r.field, r.key): r["round"] for r in ref.orphan_cascade(refs, direct, task_edges=0).collect()} == got
    assert got == {("o", "a"): 0, ("o", "b"): 1, ("o", "c"): 2, ("o", "d"): 3}


def test_long_chains_are_followed_to_their_end(spark):
    pairs = [(k, "incoming", f"n{k}", f"n{k + 1}", None) for k in range(12)]
    refs = spark.createDataFrame(pairs, "node_id bigint, field string, normed_identifier string, target string, ref_period string")
    direct = refs.where("node_id = 11").selectExpr("*", "'missing' as reason")
    got = {(r.node_id, r.reason, r["round"]) for r in ref.orphaned_references(refs, direct).collect()}
    assert got == {(k, "missing" if k == 11 else "inherited", 11 - k) for k in range(12)}


def test_empty_tables(spark):
    lines, every, gone = _setup(spark)
    refs = ref.explode_references(lines.limit(0), ("outgoing",))
    out = ref.orphan_references(refs, ref.target_status(every.limit(0), gone.limit(0)))
    assert out.count() == 0
    assert ref.orphan_cascade(refs, out).count() == 0
    assert ref.orphaned_references(refs, out).count() == 0
