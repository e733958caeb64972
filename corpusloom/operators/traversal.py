"""Traversal strategies and the graph-growing pack sampler.

Random strategies walk a graph held as compressed sparse rows; a task owns one seed and
makes its packs independently, so packs are spread over the cluster by seeds.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.packs import PackSettings, targets_first


@dataclass
class Csr:
    """Adjacency in both directions over dense ids, document lengths and layout tokens."""

    out_at: np.ndarray
    out_to: np.ndarray
    in_at: np.ndarray
    in_to: np.ndarray
    lengths: np.ndarray
    #: Tokens that the layout puts around each document.
    extra: np.ndarray

    @staticmethod
    def build(n: int, src: np.ndarray, dst: np.ndarray, lengths: np.ndarray | None = None, extra: np.ndarray | None = None) -> "Csr":
        def side(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((b, a))
            return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[order]

        return Csr(*side(src, dst), *side(dst, src), np.ones(n, dtype=np.int64) if lengths is None else lengths, np.zeros(n, dtype=np.int64) if extra is None else extra)

    def __len__(self) -> int:
        return len(self.lengths)

    def near(self, v: int, mode: str) -> list[int]:
        """Neighbours by mode: out, in, or both with incoming ones first."""
        back = self.in_to[self.in_at[v] : self.in_at[v + 1]].tolist()
        ahead = self.out_to[self.out_at[v] : self.out_at[v + 1]].tolist()
        return {"out": ahead, "in": back, "both": back + ahead}[mode]


def _check_mode(mode: str) -> None:
    if mode not in ("out", "in", "both"):
        raise ValueError(f"edge mode must be out, in or both, not {mode!r}")


class RandomPick:
    """Any node, each time anew."""

    def __init__(self, graph: Csr, rng: random.Random) -> None:
        self.graph, self.rng = graph, rng

    def reset(self, start: int) -> None:
        pass

    def step(self) -> int:
        return self.rng.randrange(len(self.graph))


class RandomWalk(RandomPick):
    """A walk along in- or out-edges by weights; a dead end or a restart jumps anywhere."""

    def __init__(self, graph: Csr, rng: random.Random, mode: str = "both", w_in: float = 1.0, w_out: float = 1.0, restart: float = 0.0) -> None:
        super().__init__(graph, rng)
        _check_mode(mode)
        self.w_in, self.w_out, self.restart = (0.0 if mode == "out" else w_in), (0.0 if mode == "in" else w_out), restart
        self.at: int | None = None

    def reset(self, start: int) -> None:
        self.at = start

    def step(self) -> int:
        jump = self.rng.random() < self.restart
        back = self.graph.near(self.at, "in") if self.at is not None and self.w_in > 0 else []
        ahead = self.graph.near(self.at, "out") if self.at is not None and self.w_out > 0 else []
        if self.at is None or jump or not (back or ahead):
            self.at = self.rng.randrange(len(self.graph))
        else:
            side = ahead if not back else back if not ahead else (back if self.rng.random() * (self.w_in + self.w_out) < self.w_in else ahead)
            self.at = self.rng.choice(side)
        return self.at


class Search(RandomPick):
    """Breadth-first (queue) or depth-first (stack, neighbours shuffled) search; nodes are
    marked when they are put in; when all are seen out the search starts at an unseen node."""

    def __init__(self, graph: Csr, rng: random.Random, mode: str = "both", depth_first: bool = False) -> None:
        super().__init__(graph, rng)
        _check_mode(mode)
        self.mode, self.depth_first = mode, depth_first
        self.line: deque[int] = deque()
        self.seen: set[int] = set()

    def reset(self, start: int) -> None:
        self.line, self.seen = deque([start]), {start}

    def step(self) -> int:
        if not self.line:
            start = self.rng.randrange(len(self.graph))
            for _ in range(min(2 * len(self.graph), 1000)):
                if start not in self.seen:
                    break
                start = self.rng.randrange(len(self.graph))
            self.line.append(start)
            self.seen.add(start)
        v = self.line.pop() if self.depth_first else self.line.popleft()
        near = self.graph.near(v, self.mode)
        if self.depth_first:
            self.rng.shuffle(near)
        for u in near:
            if u not in self.seen:
                self.seen.add(u)
                self.line.append(u)
        return v


class Composite(RandomPick):
    """Several strategies by turns, or one at random per step by weights (negative ones count
    as 0; without a positive one all are alike)."""

    def __init__(self, children: Sequence[RandomPick], rng: random.Random, mode: str = "alternate", weights: Sequence[float] | None = None) -> None:
        if not children:
            raise ValueError("a composite needs children")
        if mode not in ("alternate", "per_step_random"):
            raise ValueError(f"unknown composite mode {mode!r}")
        self.children, self.rng, self.mode, self.turn = list(children), rng, mode, 0
        weights = [max(w, 0.0) for w in (weights or [1.0] * len(children))]
        self.weights = weights if sum(weights) > 0 else [1.0] * len(children)

    def reset(self, start: int) -> None:
        for child in self.children:
            child.reset(start)

    def step(self) -> int:
        if self.mode == "alternate":
            child = self.children[self.turn % len(self.children)]
            self.turn += 1
        else:
            child = self.rng.choices(self.children, self.weights)[0]
        return child.step()


STRATEGIES: dict[str, Callable[[Csr, random.Random], RandomPick]] = {
    "random": RandomPick,
    "random_walk": RandomWalk,
    "bfs": Search,
    "dfs": lambda g, r: Search(g, r, depth_first=True),
    "bfs_then_random": lambda g, r: Composite([Search(g, r), RandomPick(g, r)], r),
}


def grow_pack(graph: Csr, rng: random.Random, strategy: RandomPick, settings: PackSettings) -> list[tuple[int, int, bool]]:
    """(node, length, cut) of one pack: seeds grow by the strategy until the budget is
    reached; too many rejections in a row start a new component; no node twice."""
    pack: dict[int, tuple[int, bool]] = {}
    total = 0
    budget = settings.doc_budget

    def accept(v: int) -> bool:
        nonlocal total
        n = int(graph.lengths[v])
        if v in pack or n <= 0 or budget is not None and n > budget and settings.overflow_policy == "skip":
            return False
        cut = budget is not None and n > budget
        pack[v] = (budget if cut else n, bool(cut))
        total += pack[v][0] + int(graph.extra[v])
        return True

    for _ in range(settings.max_rejections):  # new components
        if total >= settings.token_budget or len(pack) == len(graph):
            break
        tries = next((v for v in (rng.randrange(len(graph)) for _ in range(settings.max_rejections)) if v not in pack), None)
        if tries is None:
            break
        accept(tries)
        strategy.reset(tries)
        rejected = 0
        while total < settings.token_budget and rejected < settings.max_rejections:
            rejected = 0 if accept(strategy.step()) else rejected + 1
    return [(v, n, cut) for v, (n, cut) in pack.items()]


def trim_pack(pack: list[tuple[int, int, bool]], budget: int, side: str, extra: Sequence[int] | None = None) -> list[tuple[int, int, bool]]:
    """Sequential form of the pack truncation: trim bodies from one end until the pack fits
    together with the layout tokens of its documents."""
    over = sum(n + (0 if extra is None else int(extra[v])) for v, n, _ in pack) - budget
    out = []
    for v, n, cut in pack if side == "head" else reversed(pack):
        taken = min(max(over, 0), n)
        over -= taken
        if n > taken:
            out.append((v, n - taken, cut or taken > 0))
    return out if side == "head" else out[::-1]


def endless_packs(graph: Csr, seed: int, strategy: str, settings: PackSettings) -> Iterator[list[tuple[int, int, bool]]]:
    """The packs of one seed, ordered and trimmed as the settings say, without an end while the
    graph gives any; take as many as wanted with ``itertools.islice``."""
    rng = random.Random(seed)
    walker = STRATEGIES[strategy](graph, rng)
    while True:
        pack = grow_pack(graph, rng, walker, settings)
        if settings.order_mode == "prefer_targets_first":
            inside = [v for v, _, _ in pack]
            edges = [(v, int(u)) for v in inside for u in graph.near(v, "out")]
            by = {p[0]: p for p in pack}
            pack = [by[v] for v in targets_first(inside, edges)]
        pack = trim_pack(pack, settings.token_budget, settings.pack_trim_side, graph.extra)
        if not pack:
            return
        yield pack


def sample_packs(graph: Csr, seed: int, count: int, strategy: str, settings: PackSettings) -> Iterator[list[tuple[int, int, bool]]]:
    """The first ``count`` packs of one seed."""
    return islice(endless_packs(graph, seed, strategy, settings), count)


def sampled_packs(nodes: DataFrame, edges: DataFrame, seeds: Sequence[int], packs_per_seed: int, strategy: str, settings: PackSettings, max_nodes: int = 20_000_000) -> DataFrame:
    """(seed, pack, pos, node, length, cut) of seeded packs; one task per seed.

    ``nodes``: distinct ids with lengths and, if documents have a layout, the tokens it adds
    (``extra``), which count towards the budget; ``edges``: src, dst, of which those with unknown ends
    are left out.  Every task needs random access to the whole graph, which is broadcast as
    compressed rows (16 bytes an edge and 24 a node); more than ``max_nodes`` nodes are refused.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
    n = nodes.count()
    if n > max_nodes:
        raise ValueError(f"the graph has {n} nodes; a broadcast graph may have {max_nodes}")
    extra = F.coalesce("extra", F.lit(0)) if "extra" in nodes.columns else F.lit(0)
    ids = nodes.select("node", "length", extra.cast("bigint").alias("extra")).toPandas().sort_values("node", kind="stable")
    names = ids["node"].to_numpy(np.int64)
    pairs = edges.select("src", "dst").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").toPandas()
    src, dst = (np.searchsorted(names, pairs[c].to_numpy(np.int64)) for c in ("src", "dst"))
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast((names, Csr.build(n, src, dst, ids["length"].fillna(0).to_numpy(np.int64), ids["extra"].to_numpy(np.int64))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for seed in frame["seed"]:
                for k, pack in enumerate(sample_packs(shared.value[1], int(seed), packs_per_seed, strategy, settings)):
                    rows += [(int(seed), k, pos, int(shared.value[0][v]), length, cut) for pos, (v, length, cut) in enumerate(pack)]
            yield pd.DataFrame(rows, columns=["seed", "pack", "pos", "node", "length", "cut"])

    start = spark.createDataFrame([(int(s),) for s in seeds], "seed bigint").repartition(max(1, len(seeds)), "seed")
    return start.mapInPandas(run, "seed bigint, pack int, pos int, node bigint, length bigint, cut boolean")


def strategy_trace(edges: DataFrame, n: int, strategy: str, starts: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """(start, step, node): the first steps of a strategy from each start, for inspection."""
    pairs = edges.select("src", "dst").toPandas()
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(Csr.build(n, pairs["src"].to_numpy(np.int64), pairs["dst"].to_numpy(np.int64)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for start in frame["start"]:
                walker = STRATEGIES[strategy](shared.value, random.Random(seed * 1_000_003 + int(start)))
                walker.reset(int(start))
                rows += [(int(start), k, walker.step()) for k in range(steps)]
            yield pd.DataFrame(rows, columns=["start", "step", "node"])

    return starts.select(F.col("start").cast("bigint")).mapInPandas(run, "start bigint, step int, node bigint")
