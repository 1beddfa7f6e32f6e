"""Byte-pair encoding with the rank file of a public tokenizer.

A text is split by the tokenizer's pattern; each part is merged by a priority
queue of merge ranks over a doubly linked list of symbols.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

#: Folder of the public tokenizers' files; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the tokenizer's pattern, with white space as in the Unicode standard.
# The parts starting with a letter come first as they are the most frequent; no text
# can match both them and a contraction.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(
    rf" ?\p{{L}}+|'(?:s|t|re|ve|m|ll|d)| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: The same for texts of ASCII characters only, where the plain module is faster.
ASCII_PATTERN = re.compile(r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Parts kept with their ids; when full, the memory is emptied (it only saves time).
REMEMBERED = 200_000
#: Longer parts (in characters) are not kept.
LONG = 24
#: Longer parts (in bytes; eight times as many if ASCII) are cut where no merge can join them.
SHORT = 9


def merge(symbols: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one part: apply the merge of the lowest rank, leftmost first, while there is one."""
    n = len(symbols)
    end = list(range(1, n + 1))  # end of the symbol that starts here; 0 once it is merged into its left neighbour
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(symbols[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, to = heapq.heappop(queue)
        j = end[i]
        if not j or j >= n or end[j] != to:
            continue  # stale: one of the two symbols has changed since
        end[i], end[j] = to, 0
        if to < n:
            before[to] = i
            if (r := ranks.get(symbols[i : end[to]])) is not None:
                heapq.heappush(queue, (r, i, end[to]))
        if (h := before[i]) >= 0 and (r := ranks.get(symbols[h:to])) is not None:
            heapq.heappush(queue, (r, h, to))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[symbols[i : end[i]]])
        i = end[i]
    return ids


class Encoder(dict):
    """Maps a part of a text to its ids as the bytes of 32-bit integers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.symbols = {i: b for b, i in self.ranks.items()}
        self.pieces: dict[bytes, bytes] = {}
        #: Pairs of bytes between which some merge joins two symbols; elsewhere a part can be cut without changing its ids.
        self.joined = np.zeros((256, 256), bool)
        for t in self.ranks:
            for k in range(1, len(t)):
                if t[:k] in self.ranks and t[k:] in self.ranks:
                    self.joined[t[k - 1], t[k]] = True

    def __missing__(self, part: str) -> bytes:
        raw = part.encode("utf-8", "surrogatepass")
        if len(raw) > (SHORT if len(raw) != len(part) else 8 * SHORT):
            b = np.frombuffer(raw, np.uint8)
            cuts = [0, *(np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
            ids = b"".join([self.merged(raw[i:j]) for i, j in zip(cuts, cuts[1:])])
        else:
            ids = array("i", merge(raw, self.ranks)).tobytes()
        if len(part) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def merged(self, raw: bytes) -> bytes:
        """Ids of some bytes; most are remembered, as runs without spaces repeat them."""
        ids = self.pieces.get(raw)
        if ids is None:
            ids = array("i", merge(raw, self.ranks)).tobytes()
            if len(raw) <= SHORT:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[raw] = ids
        return ids

    @staticmethod
    def parts(text: str) -> list[str]:
        """The parts that the tokenizer's pattern splits a text into; together they are the text."""
        return (ASCII_PATTERN if text.isascii() else PATTERN).findall(text)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.parts(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.encode(text), np.int32).tolist()

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4

    def decode(self, ids: list[int]) -> str:
        """The text: the ids' symbols one after another; bytes that are no text become U+FFFD."""
        return b"".join(map(self.symbols.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker."""
    return Encoder(path)
