"""Re-Pair grammars over token sequences, inferred for many texts at once.

Tokens are found on bytes without a loop over them.  ``infer`` makes a grammar for every
text of a batch by replacing repeated pairs, frequent ones first, until none is left.
``passages`` does the same with frequencies that all texts share, so that a passage gets
the same rules in whatever text it stands, which is what comparing texts needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from corpusloom.llm import textkernels as tk

U64 = np.uint64
_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD[_c] = True
_WORD[128:] = True
_SPACE = np.zeros(256, dtype=bool)
for _c in b" \t\r\n\f\v\x00":
    _SPACE[_c] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True

#: Words that keep their identity in the shape sequence.
KEYWORDS = "def class return if else elif for while in is not and or import from as with try except raise lambda yield assert pass function var let const new this typeof module exports true false null None True False self print len range"


def _key(word: str) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(tk.span_hashes(tk.prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0])


_KEYWORD_HASHES = np.array(sorted(_key(w) for w in KEYWORDS.split()), dtype=U64)


@dataclass
class Tokens:
    """Tokens of a batch: exact hash, shape code, owning text, start and length in bytes."""

    exact: np.ndarray
    shape: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    length: np.ndarray
    digit: np.ndarray
    word: np.ndarray


def batch_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes parted by zero bytes, and the offset of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    return np.frombuffer(b"\x00".join(raw) + b"\x00", dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def tokenize(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    word = _WORD[data]
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    single = np.flatnonzero(~word & ~_SPACE[data])
    start = np.concatenate([ws, single])
    end = np.concatenate([we, single + 1])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    exact = np.empty(len(start), dtype=U64)
    # prefix sums per block of texts keep the tables of powers small
    block = 1 << 20
    for b in range(0, len(data), block):
        lo, hi = np.searchsorted(start, [b, b + block])
        if lo < hi:
            top = int(end[hi - 1])
            exact[lo:hi] = tk.span_hashes(tk.prefix_sums(data[b:top]), start[lo:hi] - b, end[lo:hi] - b)
    first = data[start] if len(start) else np.zeros(0, dtype=np.uint8)
    is_word = _WORD[first]
    digit = _DIGIT[first]
    lowers = np.concatenate([[0], np.cumsum(_LOWER[data])])
    has_lower = lowers[end] > lowers[start]
    shape = np.where(is_word, np.where(digit, U64(1), np.where(has_lower, U64(2), U64(3))), exact)
    known = is_word & np.isin(exact, _KEYWORD_HASHES)
    shape = np.where(known, exact, shape)
    owner = np.searchsorted(offsets, start, side="right") - 1
    return Tokens(exact, shape, owner, start, end - start, digit, is_word)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tk.mix(a * U64(0x9E3779B97F4A7C15) + tk.mix(b))


def _local_best(rank: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Positions whose rank exceeds that of both neighbours (the left one wins ties)."""
    rank = np.where(ok, rank, U64(0))
    left = np.concatenate([[U64(0)], rank[:-1]])
    right = np.concatenate([rank[1:], [U64(0)]])
    return ok & (rank > left) & (rank >= right)


def _pair_counts(key: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse]


def infer(symbols: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair grammars of many texts at once: per text the symbols left and the rules made,
    and per input symbol whether no rule took it in.

    In a round the pairs of each text are taken by falling frequency: a pair is replaced
    where it is more frequent than the pairs it overlaps, and only if that happens twice or
    more.  A text is done when no pair is left; rounds go on until all texts are done.
    """
    left, rules = np.zeros(texts, dtype=np.int64), np.zeros(texts, dtype=np.int64)
    alone = np.zeros(len(symbols), dtype=bool)
    sym, own, at_first = symbols.copy(), owner, np.arange(len(symbols))
    single = np.ones(len(symbols), dtype=bool)
    while len(sym):
        key = tk.mix(_pair_hash(sym[:-1], sym[1:]) + own[:-1].astype(U64) * U64(0xD6E8FEB86659FD93))
        n = _pair_counts(key)
        ok = (own[1:] == own[:-1]) & (n >= 2)
        # in a run of one pair every other position is taken
        places = np.arange(len(key))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        ok &= (places - np.maximum.accumulate(np.where(fresh, places, 0))) % 2 == 0
        at = np.flatnonzero(_local_best((np.minimum(n, 0xFFFFFF).astype(U64) << U64(40)) | (key >> U64(24)), ok))
        # a pair that this selection would use once only is no rule
        at = at[_pair_counts(key[at]) >= 2]
        active = np.zeros(texts, dtype=bool)
        active[own[at]] = True
        done = ~active[own]
        left += np.bincount(own[done], minlength=texts)
        alone[at_first[done & single]] = True
        rules += np.bincount(own[at[np.unique(key[at], return_index=True)[1]]], minlength=texts)
        sym[at] = key[at]
        single[at] = False
        keep = ~done
        keep[at + 1] = False
        sym, own, at_first, single = sym[keep], own[keep], at_first[keep], single[keep]
    return left, rules, alone


#: Buckets of a table of pair frequencies, and rounds that have a table of their own.
PAIR_BUCKETS = 1 << 16
PAIR_TABLES = 4


def passages(symbols: np.ndarray, owner: np.ndarray, tables: Sequence[np.ndarray], least: int = 8, count_round: int | None = None) -> tuple[np.ndarray, ...]:
    """(rule, owner, width) of the occurrences that first span ``least`` tokens.

    Re-Pair with frequencies that all texts share: ``tables[r]`` says how frequent the pairs of
    round r are among the known packages, frequent pairs are replaced before rare ones, equally
    frequent ones in hash order.  As the order does not depend on the text, equal passages get
    equal rules wherever they stand.  With ``count_round`` the pair buckets of that round are
    returned instead.
    """
    sym, own, width = symbols.copy(), owner, np.ones(len(symbols), dtype=np.int64)
    out_r, out_o, out_w = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    number = 0
    while len(sym) > 1:
        key = _pair_hash(sym[:-1], sym[1:])
        ok = (own[1:] == own[:-1]) & (width[:-1] < least) & (width[1:] < least)
        if count_round == number:
            return ((key[ok] % U64(PAIR_BUCKETS)).astype(np.int64),)
        often = tables[number][key % U64(PAIR_BUCKETS)].astype(U64) if number < len(tables) else U64(0)
        at = np.flatnonzero(_local_best((often << U64(56)) | (key >> U64(8)) | U64(1), ok))
        if not len(at):
            break
        sym[at] = key[at]
        width[at] += width[at + 1]
        done = at[width[at] >= least]
        out_r.append(sym[done])
        out_o.append(own[done])
        out_w.append(width[done])
        gone = np.ones(len(sym), dtype=bool)
        gone[at + 1] = False
        sym, own, width = sym[gone], own[gone], width[gone]
        number += 1
    if count_round is not None:
        return (np.zeros(0, dtype=np.int64),)
    return np.concatenate(out_r), np.concatenate(out_o), np.concatenate(out_w)
