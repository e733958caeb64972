"""Stateful multi-document context: insertion, eviction, recursive retrieval, writing.

The state machine (``Context``) is shared by the batch kernels (``assemble_contexts`` and
``written_contexts``, one session per call) and the streaming query (``context_stream``),
which keeps it between micro-batches with ``applyInPandasWithState``.

Depths are those of the document that holds a link: the root has 0.  A corpus document is
inserted whole or not at all; its own links are followed while its depth is at most
``max_link_depth``.  Where the corpus has no such document one may be written, if the
linking document's depth is below the limit and ``max_doc_tokens`` fit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: What the corpus knows of a document: its length, its links and, if wanted, its tokens.
Known = tuple[int, Sequence[str], Sequence[int] | None]
Find = Callable[[str], Known | None]


@dataclass
class ContextSettings:
    max_context: int = 2048
    max_aux_docs: int = 8
    max_link_depth: int = 2
    max_doc_tokens: int = 512
    allow_generation: bool = False
    eviction_policy: str = "drop_oldest"
    restore_evicted: bool = False

    def __post_init__(self) -> None:
        for name in ("max_context", "max_doc_tokens"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("max_aux_docs", "max_link_depth"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.eviction_policy not in ("drop_oldest", "stop_new"):
            raise ValueError("eviction_policy must be drop_oldest or stop_new")


@dataclass
class Entry:
    identifier: str
    length: int
    is_root: bool = False
    depth: int = 0
    source: str = "corpus"
    done: bool = True
    truncated: bool = False
    parent: str | None = None
    tokens: list[int] | None = None


@dataclass
class Context:
    """Documents in sequence order; the root is never evicted, nor is a document that is
    being written."""

    settings: ContextSettings
    docs: list[Entry] = field(default_factory=list)
    evicted: list[Entry] = field(default_factory=list)

    def add_root(self, identifier: str, length: int, tokens: Sequence[int] | None = None) -> Entry:
        if any(d.is_root for d in self.docs):
            raise ValueError("the context has a root already")
        self.docs.append(Entry(identifier, length, is_root=True, source="prompt", done=False, tokens=None if tokens is None else list(tokens)))
        return self.docs[-1]

    def total(self) -> int:
        return sum(d.length for d in self.docs)

    def aux(self) -> int:
        return sum(not d.is_root for d in self.docs)

    def holds(self, identifier: str) -> bool:
        return any(d.identifier == identifier for d in self.docs)

    def fits(self, length: int) -> bool:
        return self.total() + length <= self.settings.max_context and self.aux() < self.settings.max_aux_docs

    def make_room(self, length: int) -> bool:
        """Whether ``length`` fits; by the policy ``drop_oldest`` the leftmost finished documents
        but for the root are evicted until it does, by ``stop_new`` nothing is."""
        while not self.fits(length):
            k = next((i for i, d in enumerate(self.docs) if not d.is_root and d.done), None)
            if k is None or self.settings.eviction_policy == "stop_new":
                return False
            self.evicted.append(self.docs.pop(k))
        return True

    def insert(self, entry: Entry, before: str) -> None:
        at = next((i for i, d in enumerate(self.docs) if d.identifier == before), len(self.docs))
        self.docs.insert(at, entry)

    def append_tokens(self, identifier: str, n: int = 1) -> None:
        for d in self.docs:
            if d.identifier == identifier:
                d.length += n

    def mark_done(self, identifier: str, truncated: bool = False) -> None:
        for d in self.docs:
            if d.identifier == identifier:
                d.done, d.truncated = True, truncated

    def follow(self, target: str | None, writer: str, depth: int, find: Find, write: Callable[[Entry], None] | None = None) -> None:
        """A link to ``target`` in the document ``writer`` of the given depth.

        Nothing happens if the target is empty or in the context.  With ``restore_evicted`` an
        evicted document comes back as it was; else one of the corpus is inserted before the
        writer if room can be made; else one may be written, by ``write`` where it is given.
        """
        if not target or self.holds(target):
            return
        known = find(target)
        again = next((d for d in self.evicted if d.identifier == target), None) if self.settings.restore_evicted else None
        if again is not None or known is not None:
            entry = again or Entry(target, int(known[0]), depth=depth + 1, parent=writer, tokens=None if known[2] is None else list(known[2]))
            if not self.make_room(entry.length):
                return
            if again is not None:
                self.evicted.remove(again)
            self.insert(entry, writer)
            if depth + 1 <= self.settings.max_link_depth and known is not None:
                for link in known[1]:
                    self.follow(link, target, depth + 1, find, write)
        elif self.settings.allow_generation and depth < self.settings.max_link_depth and self.make_room(self.settings.max_doc_tokens):
            entry = Entry(target, 0, depth=depth + 1, source="generated", done=False, parent=writer, tokens=[])
            self.insert(entry, writer)
            if write is not None:
                write(entry)

    def write(self, entry: Entry, replay: Callable[[Entry], Iterable[int]], settings: GenerationSettings, detect: Callable[[Sequence[int]], list[tuple[int, str]]], find: Find, closes: Callable[[int], bool] = lambda token: True) -> None:
        """Append the tokens that ``replay`` gives for a document until it ends.

        After each token, links are looked for among the last ``max_recent_link_tokens``; the
        first that ends at the new token is followed.  The document ends with the end token,
        after ``max_new_tokens`` tokens, or, cut, at ``max_tokens_per_document``.  ``closes``
        tells tokens that can't end a link, for which the search is spared.
        """
        entry.tokens = [] if entry.tokens is None else entry.tokens
        for made, token in enumerate(replay(entry), 1):
            entry.tokens.append(int(token))
            entry.length += 1
            if closes(token):
                recent = entry.tokens[-settings.max_recent_link_tokens :]
                target = next((t for end, t in detect(recent) if end == len(recent)), None)
                self.follow(target, entry.identifier, entry.depth, find, lambda e: self.write(e, replay, settings, detect, find, closes))
            if token == settings.end_token or made >= settings.max_new_tokens:
                break
            if len(entry.tokens) >= settings.max_tokens_per_document:
                entry.truncated = True
                break
        entry.done = True

    def spans(self) -> list[tuple[str, int, int]]:
        out, at = [], 0
        for d in self.docs:
            out.append((d.identifier, at, at + d.length))
            at += d.length
        return out

    def sequence(self) -> list[int]:
        """The tokens of the active documents, in order."""
        return [t for d in self.docs for t in (d.tokens or [])]

    def all_documents(self) -> list[Entry]:
        """Root, active documents in order, then evicted ones in the order of their eviction."""
        return [d for d in self.docs if d.is_root] + [d for d in self.docs if not d.is_root] + self.evicted

    def dump(self) -> str:
        return json.dumps({"docs": [asdict(d) for d in self.docs], "evicted": [asdict(d) for d in self.evicted]})

    @classmethod
    def load(cls, settings: ContextSettings, text: str) -> "Context":
        raw = json.loads(text)
        return cls(settings, [Entry(**d) for d in raw["docs"]], [Entry(**d) for d in raw["evicted"]])


def closures(corpus: DataFrame, depth: int, roots: DataFrame | None = None) -> DataFrame:
    """(target, known): what may be needed after a link to a document, for all documents or for
    the targets in ``roots``.

    ``corpus`` has target, length and links (array of strings), one row per document.  known
    holds the targets, lengths and links of the document and of all that are reached from it in
    at most ``depth`` further links, as parallel arrays (``sizes`` links of each, one after the
    other); those that are only reached by the last link have size -1, as nothing follows theirs.
    """
    links = corpus.select(F.col("target").alias("here"), F.explode("links").alias("next")).where("next <> ''").distinct()
    reached = corpus.select(F.col("target").alias("root"), "target", F.lit(0).alias("level"))
    if roots is not None:
        reached = reached.join(roots.select("target").distinct(), "target", "left_semi").select("root", "target", "level")
    frontier = reached
    for level in range(1, depth + 1):
        frontier = frontier.join(links, F.col("target") == F.col("here")).select("root", F.col("next").alias("target")).distinct().withColumn("level", F.lit(level))
        reached = reached.unionByName(frontier)
    first = reached.groupBy("root", "target").agg(F.min("level").alias("level"))
    rows = first.join(corpus.select("target", "length", "links"), "target").withColumn("links", F.when(F.col("level") < depth, F.col("links")))
    lists = rows.groupBy(F.col("root").alias("target")).agg(F.collect_list(F.struct("target", "length", "links")).alias("k"))
    none = F.array().cast("array<string>")
    # parallel arrays, which Python reads much faster than an array of structs
    known = F.struct(
        F.col("k.target").alias("targets"), F.col("k.length").cast("array<bigint>").alias("lengths"),
        F.transform("k.links", lambda x: F.coalesce(F.size(x), F.lit(-1))).alias("sizes"), F.flatten(F.transform("k.links", lambda x: F.coalesce(x, none))).alias("links"),
    )
    return lists.select("target", known.alias("known"))


def _finder(lists: Iterable) -> Find:
    known: dict[str, Known] = {}
    for docs in lists:
        if docs is None:
            continue
        at, links = 0, docs["links"]
        for target, length, size in zip(docs["targets"], docs["lengths"], docs["sizes"], strict=True):
            if target not in known or size > 0 and not len(known[target][1]):
                known[target] = (int(length), links[at : at + max(size, 0)], None)
            at += max(size, 0)
    return known.get


_RESULT = "session bigint, ord int, identifier string, length int, depth int, source string, truncated boolean, is_root boolean, active boolean"


def _result_rows(session: int, context: Context) -> list[tuple]:
    active = len(context.docs)
    return [(session, k, d.identifier, d.length, d.depth, d.source, d.truncated, d.is_root, k < active) for k, d in enumerate(context.all_documents())]


_NAMES = ["session", "ord", "identifier", "length", "depth", "source", "truncated", "is_root", "active"]


def assemble_contexts(sessions: DataFrame, corpus: DataFrame, settings: ContextSettings) -> DataFrame:
    """Documents of each session's context after its links.

    ``sessions``: session, ord, target, root_length; ``corpus``: target, length, links.
    """
    known = closures(corpus, settings.max_link_depth, sessions)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord", kind="stable")
        session = int(frame["session"].iloc[0])
        find = _finder(frame["known"])
        context = Context(settings)
        context.add_root(f"session {session}", int(frame["root_length"].iloc[0]))
        for target in frame["target"]:
            context.follow(target, f"session {session}", 0, find)
        return pd.DataFrame(_result_rows(session, context), columns=_NAMES)

    return sessions.select("session", "ord", "target", "root_length").join(known, "target", "left").groupBy("session").applyInPandas(run, _RESULT)


def written_contexts(sessions: DataFrame, corpus: DataFrame, context_settings: ContextSettings, settings: GenerationSettings, detect: Callable[[Sequence[int]], list[tuple[int, str]]], closes: Callable[[int], bool]) -> DataFrame:
    """Contexts of sessions whose root is written token by token.

    ``sessions``: session, identifier and tokens (array), which the root and every document
    that is written replay; ``corpus``: target, length, links.  The links that the tokens may
    hold are found first, so that each session gets the documents it can need.
    """
    @F.pandas_udf("array<string>")
    def linked(tokens: pd.Series) -> pd.Series:
        return pd.Series([sorted({t for _, t in detect(list(x))}) if x is not None else [] for x in tokens])

    rows = sessions.select("session", "identifier", "tokens")
    asked = materialize(rows.select("session", F.explode(linked("tokens")).alias("target")), "linked-targets")
    known = closures(corpus, context_settings.max_link_depth, asked)
    targets = asked.join(known, "target").groupBy("session").agg(F.collect_list("known").alias("known"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for session, identifier, tokens, docs in zip(frame["session"], frame["identifier"], frame["tokens"], frame["known"], strict=True):
                context = Context(context_settings)
                root = context.add_root(identifier, 0, [])
                body = [] if tokens is None else [int(t) for t in tokens]
                context.write(root, lambda entry, body=body: body, settings, detect, _finder(docs if docs is not None else []), closes)
                out += _result_rows(int(session), context)
            yield pd.DataFrame(out, columns=_NAMES)

    return rows.join(targets, "session", "left").mapInPandas(run, _RESULT)


def context_stream(events: DataFrame, corpus: DataFrame, settings: ContextSettings) -> DataFrame:
    """Streaming form: rows (session, ord, kind, target, length) of kind ``tokens`` add to
    the root, kind ``link`` name a document; ``corpus`` is a table of target, length, links.

    Links are joined with their closures, so that documents' own links are followed as in
    ``assemble_contexts``.  Emits one row per session and micro-batch with the state of its
    context.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        session = int(key[0])
        root = f"session {session}"
        context = Context.load(settings, state.get[0]) if state.exists else Context(settings)
        if not state.exists:
            context.add_root(root, 0)
        rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
        find = _finder(rows["known"])
        for kind, target, length in zip(rows["kind"], rows["target"], rows["length"], strict=True):
            if kind == "tokens":
                context.append_tokens(root, 0 if pd.isna(length) else int(length))
            else:
                context.follow(target, root, 0, find)
        state.update((context.dump(),))
        yield pd.DataFrame({"session": [session], "n_docs": [len(context.docs)], "n_evicted": [len(context.evicted)], "total_tokens": [context.total()]})

    joined = events.join(closures(corpus, settings.max_link_depth), "target", "left")
    return joined.groupBy("session").applyInPandasWithState(run, "session bigint, n_docs int, n_evicted int, total_tokens bigint", "dump string", "update", "NoTimeout")


def context_spans(docs: DataFrame) -> DataFrame:
    """Spans of the active documents in sequence order."""
    end = F.sum("length").over(Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return docs.where("active").withColumn("span_end", end).withColumn("span_start", F.col("span_end") - F.col("length"))


def result_filters(docs: DataFrame, source: str | None = None, identifier: str | None = None) -> DataFrame:
    """Result documents of one source and, or, one identifier."""
    out = docs.where(F.col("source") == source) if source else docs
    return out.where(F.col("identifier") == identifier) if identifier else out


@dataclass(frozen=True)
class GenerationSettings:
    """Checked settings of a generation run."""

    max_new_tokens: int = 512
    max_tokens_per_document: int = 512
    max_recent_link_tokens: int = 200
    end_token: int | None = None
    max_context_length: int = 2048
    max_auxiliary_documents: int = 8
    max_link_depth: int = 2
    temperature: float = 1.0
    top_k: int | None = None
    top_p: float | None = None
    repetition_penalty: float = 1.0

    def __post_init__(self) -> None:
        wrong = [
            ("max_new_tokens", self.max_new_tokens <= 0), ("max_tokens_per_document", self.max_tokens_per_document <= 0), ("max_recent_link_tokens", self.max_recent_link_tokens <= 0), ("max_context_length", self.max_context_length <= 0),
            ("max_auxiliary_documents", self.max_auxiliary_documents < 0), ("max_link_depth", self.max_link_depth < 0), ("temperature", self.temperature < 0),
            ("top_k", self.top_k is not None and self.top_k <= 0), ("top_p", self.top_p is not None and not 0 < self.top_p <= 1), ("repetition_penalty", self.repetition_penalty <= 0),
        ]
        for name, bad in wrong:
            if bad:
                raise ValueError(f"{name} is out of range")

    def to_dict(self) -> dict:
        return asdict(self)
