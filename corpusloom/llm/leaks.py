"""Evaluation passages inside training text, by latent semantic retrieval.

The passages' TF-IDF matrix (document frequencies over the whole corpus) is a table; its
randomised SVD is computed over that table.  Texts are read in overlapping word windows,
every window is projected into the latent space, and the passages whose cosine with it
reaches ``min_cosine`` are its candidates; nothing else is looked at.  Candidates are then
checked on the words themselves: for a run of ``run`` successive words, and for paraphrases
by longest common subsequence and by the passage's answer words.

Windows have ``2 * run`` words and advance by ``run``, so each run of that many words lies
within one.  A window can hold such a run only if ``run`` successive words belong to the
passages' vocabulary; others are passed over, which loses nothing.  With paraphrases asked
for, windows with ``run`` such words in any places are searched.

The corpus is read once for the document frequencies and once for each ``BLOCK_ITEMS``
passages.  Up to ``MAX_RANK`` passages the space has full rank and cosines are exact; with
more they are projections, whose error falls with the root of the rank (about 0.05 here).

Defined results: null or empty texts and passages match nothing, as do passages with
fewer than ``run`` words; repeated rows give one result; equal passages under several ids
are all reported; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkernels as tk
from corpusloom.session import materialize

#: Passages of one pass over the corpus: the model that tasks are sent stays under 100 MB.
BLOCK_ITEMS = 8192
MAX_RANK = 384
#: Cosine from which a passage is a window's candidate.
MIN_COSINE = 0.25
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return text.lower().encode("ascii", "replace").translate(_TABLE).split()


def passage_words(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w.decode() for w in words_of(t)])

    return split(text)


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many texts each word of the vocabulary occurs, over all texts, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, size = shared.value.get, len(shared.value)
        counts, n = np.zeros(size + 1, dtype=np.int64), 0
        for frame in frames:
            for text in frame["text"]:
                seen = {get(w, size) for w in set(words_of(text))}
                counts[list(seen)] += 1
                n += 1
        counts[size] = n
        places = np.flatnonzero(counts)
        yield pd.DataFrame({"term": places, "n": counts[places]})

    summed = docs.select("text").mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    out[summed["term"].to_numpy()] = summed["n"].to_numpy()
    return out[:-1], int(out[-1])


def _summed(df: DataFrame, part, side: int) -> np.ndarray:
    """Sum over the tasks of their ``side`` x ``side`` matrices."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((side, side))
        for frame in frames:
            if len(frame):
                total += part(frame)
        yield pd.DataFrame({"row": np.arange(side), "v": list(total)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": frame["row"].iloc[:1], "v": [np.stack(list(frame["v"])).sum(axis=0)]})

    rows = df.mapInPandas(run, "row int, v array<double>").groupBy("row").applyInPandas(add, "row int, v array<double>").toPandas()
    out = np.zeros((side, side))
    out[rows["row"].to_numpy(np.int64)] = np.stack(list(rows["v"])) if len(rows) else 0
    return out


def randomised_svd(matrix: DataFrame, n_terms: int, rank: int, seed: int = 5) -> DataFrame:
    """(term, v): right singular vectors, by term, of a sparse matrix with rows (terms, weights).

    The range finder's random directions come from a seeded generator, so every task makes the
    same ones.  Only square matrices of the rank's size reach the driver; the projected matrix
    is a table by term.
    """

    def dense(frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(frame), n_terms))
        for i, (terms, weights) in enumerate(zip(frame["terms"], frame["weights"], strict=True)):
            out[i, np.asarray(terms, dtype=np.int64)] = np.asarray(weights)
        return out

    def sketch(frame: pd.DataFrame) -> np.ndarray:
        return dense(frame) @ np.random.default_rng(seed).standard_normal((n_terms, rank))

    def gram(frame: pd.DataFrame) -> np.ndarray:
        y = sketch(frame)
        return y.T @ y

    values, vectors = np.linalg.eigh(_summed(matrix, gram, rank))
    keep = values > values.max() * 1e-10
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    side = whiten.shape[1]

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                a = dense(frame)
                terms = np.flatnonzero(a.any(axis=0))
                yield pd.DataFrame({"term": terms, "v": list(a[:, terms].T @ (sketch(frame) @ whiten))})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        place, terms = pd.factorize(frame["term"])
        total = np.zeros((len(terms), side))
        np.add.at(total, place, np.stack(list(frame["v"])))
        return pd.DataFrame({"term": terms, "v": list(total)})

    parts = matrix.mapInPandas(project, "term bigint, v array<double>").withColumn("block", F.floor(F.col("term") / 4096))
    by_term = materialize(parts.groupBy("block").applyInPandas(lambda f: add(f[["term", "v"]]), "term bigint, v array<double>"), "svd")

    def outer(frame: pd.DataFrame) -> np.ndarray:
        b = np.stack(list(frame["v"]))
        return b.T @ b

    squares, turn = np.linalg.eigh(_summed(by_term, outer, side))
    good = squares > squares.max() * 1e-14
    turn = turn[:, good] / np.sqrt(squares[good])

    def rotate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"term": frame["term"], "v": list((np.stack(list(frame["v"])) @ turn).astype(np.float32))})

    return by_term.mapInPandas(rotate, "term bigint, v array<float>")


class _Model:
    """What a task needs for one block of passages."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray, directions: np.ndarray, items: list[tuple[int, np.ndarray]], run: int) -> None:
        self.vocabulary, self.run = vocabulary, run
        self.term = np.vstack([idf[:, None] * directions, np.zeros(directions.shape[1])]).astype(np.float32)
        latent = np.stack([self.term[ids].sum(axis=0) for _, ids in items])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32).T.copy()
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.words = [ids for _, ids in items]
        # answer words: the passage's rarest ones
        self.answers = [set(sorted(set(ids.tolist()), key=lambda t: (-idf[t], t))[:5]) for ids in self.words]


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one row at a time."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def longest_runs(windows: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Per window the longest run of successive words that stands in the passage as well."""
    runs = np.zeros((len(windows), len(passage) + 1), dtype=np.int16)
    best = np.zeros(len(windows), dtype=np.int16)
    for k in range(windows.shape[1]):
        runs[:, 1:] = (runs[:, :-1] + 1) * (windows[:, k, None] == passage)
        best = np.maximum(best, runs.max(axis=1))
    return best


def _windows(ids: np.ndarray, run: int, oov: int) -> np.ndarray:
    """Starts, on the grid of ``run``, of windows that can hold ``run`` known words in a row."""
    known = np.concatenate([[0], (ids != oov).astype(np.int8), [0]])
    turn = np.diff(known)
    begins, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = ends - begins >= run
    parts = [np.arange(b // run, (e - run) // run + 1) for b, e in zip(begins[long], ends[long], strict=True)]
    return np.unique(np.concatenate(parts)) * run if parts else np.zeros(0, dtype=np.int64)


def _loose_windows(ids: np.ndarray, run: int, oov: int) -> np.ndarray:
    """Starts, on the grid of ``run``, of windows with ``run`` known words in any places."""
    known = np.concatenate([[0], np.cumsum(ids != oov)])
    starts = np.arange(0, len(ids), run)
    return starts[known[np.minimum(starts + 2 * run, len(ids))] - known[starts] >= run]


def _blocks(docs: DataFrame, items: DataFrame, run: int) -> Iterator[_Model]:
    """Models of the passages, ``BLOCK_ITEMS`` at a time."""
    clean = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    worded = clean.select("item_id", passage_words(F.col("passage")).alias("words")).where(F.size("words") >= run)
    n = max(1, -(-worded.count() // BLOCK_ITEMS))
    worded = materialize(worded.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(n)).cast("int")), "passages")
    every = sorted(r["w"] for r in worded.select(F.explode("words").alias("w")).distinct().toLocalIterator())
    if not every:
        return
    df, n_docs = document_frequencies(docs, {w.encode(): k for k, w in enumerate(every)})
    weight = np.log((1 + n_docs) / (1 + df)) + 0.1
    place = {w: k for k, w in enumerate(every)}
    spark = docs.sparkSession
    for number in range(n):
        block = worded.where(F.col("block") == number)
        own = sorted(r["w"] for r in block.select(F.explode("words").alias("w")).distinct().toLocalIterator())
        if not own:
            continue
        idf = weight[[place[w] for w in own]]
        terms = spark.createDataFrame(pd.DataFrame({"w": own, "term": np.arange(len(own)), "idf": idf}))
        counts = block.withColumn("row", F.xxhash64("item_id", "words")).select("row", F.explode("words").alias("w")).groupBy("row", "w").agg(F.count("*").alias("n"))
        cells = counts.join(terms, "w").select("row", "term", (F.col("n") * F.col("idf")).alias("x"))
        rows = cells.groupBy("row").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sort_array(F.collect_list(F.struct("term", "x"))).alias("c"))
        matrix = materialize(rows.select(F.col("c.term").alias("terms"), F.transform("c.x", lambda x: x / F.col("norm")).alias("weights")), "tfidf")
        vectors = randomised_svd(matrix, len(own), min(MAX_RANK, matrix.count() + 8)).toPandas()
        directions = np.zeros((len(own), len(vectors["v"].iloc[0])), dtype=np.float32)
        directions[vectors["term"].to_numpy()] = np.stack(list(vectors["v"]))
        vocabulary = {w.encode(): k for k, w in enumerate(own)}
        coded = [(int(r["item_id"]), np.array([vocabulary[w.encode()] for w in r["words"]], dtype=np.int64)) for r in block.select("item_id", "words").collect()]
        yield _Model(vocabulary, idf, directions, sorted(coded, key=lambda c: (c[0], c[1].tolist())), run)


def find_leaks(docs: DataFrame, items: DataFrame, run: int = 12, min_cosine: float = MIN_COSINE, paraphrase_cosine: float | None = None) -> DataFrame:
    """(doc_id, item_id, kind, cosine, lcs_share, answer_share).

    ``docs`` has doc_id and text, ``items`` item_id and passage.  kind is ``run`` for a
    verbatim run of words; with ``paraphrase_cosine`` also ``paraphrase`` for candidates of
    that cosine of whose passage at least 60 % stand in order in the window's
    surroundings together with at least 60 % of its answer words.
    """
    spark = docs.sparkSession
    docs = docs.where("text is not null and text <> ''")
    schema = "doc_id bigint, item_id bigint, kind string, cosine double, lcs_share double, answer_share double"
    out = None
    for model in _blocks(docs, items, run):
        shared = spark.sparkContext.broadcast(model)

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = shared.value
            oov, get = len(m.vocabulary), m.vocabulary.get
            for frame in frames:
                rows: dict[tuple[int, int, str], tuple] = {}
                pending: list[tuple[int, np.ndarray, int]] = []
                for doc, text in zip(frame["doc_id"].to_numpy(), frame["text"], strict=True):
                    found = words_of(text)
                    if len(found) < run:
                        continue
                    ids = np.fromiter(map(get, found, repeat(oov)), dtype=np.int64, count=len(found))
                    at = _windows(ids, run, oov) if paraphrase_cosine is None else _loose_windows(ids, run, oov)
                    if len(at):
                        padded = np.concatenate([ids, np.full(2 * run, oov, dtype=np.int64)])
                        pending += [(int(doc), padded, int(s)) for s in at]
                    if len(pending) >= 1024:
                        _judge(m, pending, min_cosine, paraphrase_cosine, rows)
                        pending = []
                _judge(m, pending, min_cosine, paraphrase_cosine, rows)
                if rows:
                    yield pd.DataFrame([(*k, *v) for k, v in rows.items()], columns=["doc_id", "item_id", "kind", "cosine", "lcs_share", "answer_share"])

        part = docs.select("doc_id", "text").mapInPandas(scan, schema)
        part = part.groupBy("doc_id", "item_id", "kind").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"), F.max("answer_share").alias("answer_share"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def candidates(m: _Model, windows: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, cosine) of all pairs whose latent cosine reaches the threshold."""
    latent = m.term[windows].sum(axis=1)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    cosine = latent @ m.latent
    window, item = np.nonzero(cosine >= min_cosine)
    return window, item, cosine[window, item]


def _judge(m: _Model, pending: list, min_cosine: float, paraphrase_cosine: float | None, rows: dict) -> None:
    """Candidate search by cosine, then the checks on the words."""
    oov = len(m.vocabulary)
    for k in range(0, len(pending), 512):
        group = pending[k : k + 512]
        ids = np.stack([padded[s : s + 2 * m.run] for _, padded, s in group])
        window, item, cosine = candidates(m, ids, min_cosine)
        order = np.argsort(item, kind="stable")
        window, item, cosine = window[order], item[order], cosine[order]
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            if not len(part):
                continue
            one, passage = int(item[part[0]]), m.words[item[part[0]]]
            long = longest_runs(ids[window[part]], passage) >= m.run
            for at in part[long]:
                key = (group[window[at]][0], int(m.ids[one]), "run")
                rows[key] = (max(float(cosine[at]), rows.get(key, (-1.0,))[0]), 1.0, 1.0)
            if paraphrase_cosine is None:
                continue
            for at in part[cosine[part] >= paraphrase_cosine]:
                doc, padded, s = group[window[at]]
                near = padded[max(0, s - len(passage)) : s + 2 * m.run + len(passage)]
                share = lcs_length(passage, near[near != oov]) / len(passage)
                answers = len(m.answers[one] & set(near.tolist())) / len(m.answers[one])
                if share >= 0.6 and answers >= 0.6:
                    rows[(doc, int(m.ids[one]), "paraphrase")] = (float(cosine[at]), share, answers)
