"""Links in token sequences: Markdown links and Python imports, with token positions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.imports import module_paths, statements

Decode = Callable[[Sequence[int]], str]
Detect = Callable[[Sequence[int]], list[tuple[int, str]]]

#: Token of the character tokenizer below that stands for ``](``; all others are code points.
BRACKETS = 0x110000


def char_tokens(text: str) -> list[int]:
    """Code points as tokens, ``](`` being one token."""
    return [BRACKETS if c == "\x00" else ord(c) for c in text.replace("\x00", " ").replace("](", "\x00")]


def char_text(tokens: Sequence[int]) -> str:
    return "".join("](" if t == BRACKETS else chr(t) for t in tokens)


def markdown_links(tokens: Sequence[int], decode: Decode, middles: Iterable[int], openers: Iterable[int], back: int = 100, window: int = 50) -> list[tuple[int, str]]:
    """(end position, target) of the Markdown links of a sequence.

    ``middles`` are the tokens of ``](``; one of ``openers`` (tokens of ``[``) has to stand among
    the ``back`` tokens before it.  The target is decoded over at most ``window`` tokens as a
    whole, as single tokens need not be valid text, up to the first closing parenthesis.
    """
    ids = np.asarray(tokens, dtype=np.int64)
    places = np.arange(len(ids))
    opened = np.maximum.accumulate(np.where(np.isin(ids, list(openers)), places, -back - 1)) if len(ids) else ids
    out = []
    for middle in np.flatnonzero(np.isin(ids, list(middles))).tolist():
        if middle == 0 or middle - opened[middle - 1] > back:
            continue
        ahead = ids[middle + 1 : middle + 1 + window].tolist()
        if ")" not in decode(ahead):
            continue
        low, high = 1, len(ahead)  # the least number of tokens whose text holds the parenthesis
        while low < high:
            half = (low + high) // 2
            low, high = (low, half) if ")" in decode(ahead[:half]) else (half + 1, high)
        target = decode(ahead[:low]).split(")", 1)[0].strip()
        if target:
            out.append((middle + 1 + low, target))
    return out


def token_ends(tokens: Sequence[int], decode: Decode) -> np.ndarray:
    """Characters up to the end of each token, each decoded by itself; a token that can't be
    counts as one character."""

    def size(token: int) -> int:
        try:
            return len(decode([token]))
        except Exception:  # noqa: BLE001 - an undecodable token
            return 1

    return np.cumsum([0, *map(size, tokens)])


def token_at(ends: np.ndarray, char: int) -> int:
    """The least number of tokens that reach a character position, at most all."""
    return int(min(np.searchsorted(ends, char), len(ends) - 1))


def import_links(tokens: Sequence[int], decode: Decode) -> list[tuple[int, str]]:
    """(end position, path) of all files that the imports of a sequence may stand for."""
    ends = token_ends(tokens, decode)
    return [(token_at(ends, end), path) for module, name, _, end in statements(decode(list(tokens))) for path in module_paths(module, name)]


def char_markdown_links(tokens: Sequence[int]) -> list[tuple[int, str]]:
    return markdown_links(tokens, char_text, (BRACKETS,), (ord("["),))


char_import_links: Detect = partial(import_links, decode=char_text)


def detected_links(sequences: DataFrame, detect: Detect, key: str = "pack_id", tokens: str = "tokens") -> DataFrame:
    """(key, link_end, target) of all token sequences, each link once.

    Null sequences have no links.  ``detect`` is sent to the tasks, so it has to be a function
    of a module or a ``partial`` of one.
    """
    kind = sequences.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, end, target) for k, ids in zip(frame["key"], frame["tokens"], strict=True) for end, target in dict.fromkeys(detect(ids.tolist()))]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "link_end", "target"])

    source = sequences.where(F.col(tokens).isNotNull()).select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    return source.mapInPandas(run, f"{key} {kind}, link_end bigint, target string")


def positions_of_chars(tokens: DataFrame, asked: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """(key, char, token): for asked character positions the first token whose running length
    reaches them, as an as-of join within each key; positions beyond the text get the last."""
    ends = tokens.select(key, F.col(order).alias("_k"), F.sum(length).over(Window.partitionBy(key).orderBy(order)).alias("_end"))
    last = ends.groupBy(key).agg(F.max("_k").alias("_last"))
    reach = F.min(F.when(F.col("_end") >= F.col("char"), F.col("_k")))
    return asked.select(key, "char").distinct().join(ends, key).groupBy(key, "char").agg(reach.alias("token")).join(last, key).select(key, "char", F.coalesce("token", "_last").alias("token"))
