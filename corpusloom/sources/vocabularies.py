"""Tokenizers from public vocabulary files, for ``encode_documents``.

``load`` returns a factory that workers call once; the file is read where it is used, so it
has to be at the same path on all machines.  The libraries are optional.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

#: Fixed value: the pre-tokenisation pattern of byte-level vocabularies of 50,000 merges.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Vocabulary:
    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]
    size: int


@lru_cache(maxsize=4)
def open_vocabulary(path: str, pattern: str = BYTE_PATTERN) -> Vocabulary:
    """By the file's ending: ``.json`` (tokenizers), ``.tiktoken`` (ranks) or ``.model``
    (sentencepiece).  Strings of special tokens are ordinary text."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return Vocabulary(lambda text: own.encode(text, add_special_tokens=False).ids, lambda ids: own.decode(ids, skip_special_tokens=False), own.get_vocab_size())
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        coder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Vocabulary(coder.encode_ordinary, coder.decode, coder.n_vocab)
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return Vocabulary(lambda text: pieces.encode(text, num_threads=1), pieces.decode, pieces.get_piece_size())
    raise ValueError(f"unknown kind of vocabulary file: {path}")


def load(path: str, pattern: str = BYTE_PATTERN) -> Callable[[], Callable[[str], list[int]]]:
    """A factory of encoders for ``encode_documents`` and ``pretokenize``."""
    return lambda: open_vocabulary(path, pattern).encode
