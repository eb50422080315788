"""Tokenising with a given public vocabulary, fast where words repeat.

The split pattern of byte-level BPE never lets a token reach over a single space between two other characters (a space can
only begin a token or belong to a longer run of white space). A text is therefore cut in front of those spaces into
*chunks*, which are encoded apart and remembered; the ids are those of encoding the text at once.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

from .common import CACHE_ENTRIES

#: The default vocabulary; every operator takes another path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"(?<=\S)(?= \S)").split


class _Entries(dict):
    """From a key to the number of its chunk; ``bad``: the simple split doesn't hold around this piece."""

    def __init__(self, chunks: Chunks, prefix: str):
        super().__init__()
        self.chunks, self.prefix = chunks, prefix

    def __missing__(self, piece: str) -> int:
        bad = not piece or piece[0].isspace() or piece[-1].isspace()
        value = self[piece] = -1 if bad and self.prefix else self.chunks.add(self.prefix + piece)
        return value


class Chunks:
    """Chunk numbers of texts, with each chunk's length in characters and ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encode_text = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._clear()

    def _clear(self) -> None:
        self.later, self.whole = _Entries(self, " "), _Entries(self, "")
        self.n = self.used = 0
        self.count = np.zeros(1 << 12, np.int64)
        self.begin = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)

    def add(self, chunk: str) -> int:
        ids = self.encode_text(chunk)
        if self.n == len(self.count):
            self.count, self.begin = np.resize(self.count, 2 * self.n), np.resize(self.begin, 2 * self.n)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.count[self.n], self.begin[self.n] = len(ids), self.used
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += 1
        return self.n - 1

    def numbers(self, text: str) -> tuple[np.ndarray, list[str] | None]:
        """The chunk numbers of a text, valid until the next call, and the chunks where they aren't simply split at single spaces."""
        if self.n > CACHE_ENTRIES:
            self._clear()
        pieces = text.split(" ")
        first = pieces[0]
        if not (first and first[-1].isspace()):
            a = np.fromiter(map(self.later.__getitem__, pieces), np.int64, len(pieces))
            a[0] = self.whole[first]
            if len(pieces) == 1 or a[1:].min() >= 0:
                return a, None
        chunks = _SAFE(text)
        return np.fromiter((self.whole[c] for c in chunks), np.int64, len(chunks)), chunks

    def encode(self, text: str) -> np.ndarray:
        """The token ids of a text."""
        if not text:
            return np.empty(0, np.uint32)
        a, _ = self.numbers(text)
        counts = self.count[a]
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.begin[a] - ends + counts, counts) + np.arange(ends[-1])]

    def length(self, text: str) -> int:
        """The number of tokens of a text."""
        if not text:
            return 0
        a, _ = self.numbers(text)
        return int(self.count[a].sum())


@cache
def chunks(path: str = TOKENIZER) -> Chunks:
    """The vocabulary at ``path`` (a rank file), loaded once in a process."""
    return Chunks(path)
