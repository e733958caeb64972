import random
from collections import Counter, defaultdict

from corpusloom.llm import splits
from corpusloom.operators.ranking import running_totals


def test_groups_against_union_find_and_shares(spark):
    rng = random.Random(4)
    n = 600
    refs = [(a, f"n{rng.randrange(n)}") for a in range(n) for _ in range(rng.choice([0, 0, 0, 1]))] + [(3, "nowhere"), (3, None), (5, "n5")] * 2 + [(k, f"n{k + 1}") for k in range(100, 160)]
    nodes = spark.createDataFrame([(k, f"n{k}", "x") for k in range(n)], "node_id bigint, normed_identifier string, split string")
    members = splits.group_members(nodes, spark.createDataFrame(refs, "node_id bigint, target string"))
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, t in refs:
        if t and t[1:].isdigit():
            x, y = find(a), find(int(t[1:]))
            parent[max(x, y)] = min(x, y)
    got = {r.node_id: r.group_id for r in members.collect()}
    assert got == {k: find(k) for k in range(n)}
    tags = [(k, rng.choice(["train", "train", "val", None])) for k in range(n)]
    mixed = {(r.group_id, r.node_id) for r in splits.mixed_groups(members, spark.createDataFrame(tags, "node_id bigint, split string")).collect()}
    by = defaultdict(set)
    for k, s in tags:
        if s:
            by[find(k)].add(s)
    assert mixed == {(find(k), k) for k in range(n) if len(by[find(k)]) > 1}
    shares = {"train": 0.84, "a": 0.08, "b": 0.08}
    done = splits.assign_splits(members, shares).toPandas()
    assert len(done) == n and done.groupby("group_id").split.nunique().max() == 1
    parts = done.split.value_counts(normalize=True)
    assert all(abs(parts[s] - share) < 0.02 for s, share in shares.items())


def test_differencing_balances():
    bins = splits.differencing([(w, k) for k, w in enumerate([8, 7, 6, 5, 4])], 2)
    loads = sorted(sum(w for w, _ in b) for b in bins)
    assert sum(loads) == 30 and loads[1] - loads[0] <= 2
    assert splits.differencing([], 3) == [[], [], []]


def test_one_giant_group_stays_whole():
    items, even, owner = splits.plan_bins({700: 1, 1: 300}, {"train": 0.84, "val": 0.16})
    total = Counter()
    for (w, _), s in items.items():
        total[s] += w
    for w, k in even.items():
        for s in owner:
            total[s] += w * k
    assert sum(total.values()) == 1000 and abs(total["val"] - 160) <= 6


def test_empty(spark):
    nodes = spark.createDataFrame([], "node_id bigint, normed_identifier string")
    members = splits.group_members(nodes, spark.createDataFrame([], "node_id bigint, target string"))
    assert members.count() == 0 and splits.assign_splits(members, {"train": 1.0}).count() == 0


def test_running_totals_equal_a_plain_pass(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "cold", None]), k, rng.randrange(-(2**63), 2**63), rng.choice([None, 1, 5])) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, id bigint, h bigint, n int")
    got = {r.id: (r.rank, r.before) for r in running_totals(df, ["g"], "h", ["id"], "n", buckets=8).collect()}
    want, seen = {}, defaultdict(lambda: [0, 0])
    for g, k, h, n in sorted(rows, key=lambda r: (r[2], r[1])):
        want[k] = tuple(seen[g])
        seen[g][0] += 1
        seen[g][1] += n or 0
    assert got == want
