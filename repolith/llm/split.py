"""Splitting of oversized texts at natural boundaries.

A recursive hierarchy of separators: sections, paragraphs, list items, lines,
sentences, words, and characters only inside a word that is too long itself.
The units are packed greedily up to the limit, ending at the strongest separator
in the second half of what fits; each piece starts with the end of the piece
before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.llm.bpe import Encoder, encoder
from repolith.llm.encode import chunks, text_of, vocabulary
from repolith.storage import spread

#: Names of the separators, strongest first.
LEVELS = ("section", "paragraph", "item", "line", "sentence", "word", "character")
WORD = LEVELS.index("word")

FENCE = regex.compile(r"(?m)^[ \t]*(```|~~~)")
LINE = regex.compile(r"(?<=\n)(?=[^\n])")
HEADING = regex.compile(r"#{1,6}[ \t]|={2,}[^=\n]+={2,}[ \t]*\r?(?:\n|$)|<h[1-6]|\\(?:sub)*section|[^\n]+\n(?:={3,}|-{3,})[ \t]*\r?(?:\n|$)")
ITEM = regex.compile(r"[ \t]*(?:[-*+][ \t]|[0-9]{1,9}[.)][ \t]|<li|\\item)")
SENTENCE = regex.compile(r"[.!?][\"')\]]*(?=\s)|[。！？；][”’」』）]*")


def boundaries(text: str) -> dict[int, int]:
    """Offsets at which the text may be cut, and the strongest separator there.

    Blank lines and headings inside a fenced code block don't separate more than
    lines do.
    """
    fences = [m.start() for m in FENCE.finditer(text)]
    found: dict[int, int] = {}
    for m in SENTENCE.finditer(text):
        found[m.end()] = 4
    for m in LINE.finditer(text):
        at = m.start()
        inside = bisect_left(fences, at) % 2 == 1
        if inside:
            level = 3
        elif HEADING.match(text, at):
            level = 0
        elif not text[text.rfind("\n", 0, at - 1) + 1 : at].strip():
            level = 1
        elif ITEM.match(text, at):
            level = 2
        else:
            level = 3
        found[at] = level
    return found


def split(text: str, limit: int, overlap: int, code: Encoder) -> list[tuple[int, int, int, str | None]]:
    """Pieces of a text as (start, end, tokens, separator before it).

    Every piece has at most ``limit`` tokens when encoded by itself.  The pieces
    cover the text; a piece starts with the last words of the one before, as
    many as ``overlap`` tokens hold.  A text within the limit is one piece, an
    empty one none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    whole = code.count(text)
    if whole <= limit:
        return [(0, len(text), whole, None)] if text else []
    words = code.parts(text)
    tokens = [n // 4 for n in map(len, map(code.__getitem__, words))]
    most = limit - overlap
    starts = [0, *accumulate(map(len, words))]
    level = [WORD] * len(starts)
    for at, kind in boundaries(text).items():
        i = bisect_left(starts, at)  # a separator's blanks may belong to the word before the cut
        level[i] = min(level[i], kind)
    cut_words = max(tokens) > most
    if cut_words:
        starts, tokens, level = _with_cut_words(words, tokens, level, most, code)
    total = [0, *accumulate(tokens)]
    kinds = np.array(level, np.int8)
    by_level = [np.flatnonzero(kinds <= k).tolist() for k in range(WORD + 1)]

    def units(i: int, j: int, k: int) -> Iterator[int]:
        """Ends of the units of [i, j): cut by separator k, what is still too long by weaker ones."""
        cuts = by_level[k][bisect_right(by_level[k], i) : bisect_left(by_level[k], j)]
        for a, b in zip([i, *cuts], [*cuts, j]):
            if total[b] - total[a] <= most:
                yield b
            elif k < WORD:
                yield from units(a, b, k + 1)
            else:
                yield from range(a + 1, b + 1)

    def size(i: int, j: int) -> int:
        """Tokens of [i, j) encoded by itself: as within the text but for white space at its end, and for cut words."""
        if cut_words:
            return code.count(text[starts[i] : starts[j]])
        e = j
        while e > i and words[e - 1].isspace():
            e -= 1
        return total[e] - total[i] + (code.count("".join(words[e:j])) if e < j else 0)

    made, start, at = [], 0, 0
    ends = list(units(0, len(tokens), 0))
    k = 0
    while k < len(ends):
        last = max(k, bisect_right(ends, bisect_right(total, total[start] + limit) - 1, k) - 1)
        if last + 1 < len(ends):  # the strongest separator in the second half, and the last of equal ones
            half = bisect_left(ends, bisect_left(total, total[start] + limit // 2), k)
            last = min(range(min(half, last), last + 1), key=lambda e: (level[ends[e]], -e))
        while (n := size(start, ends[last])) > limit:
            if last > k:
                last -= 1
            elif start < at:
                start += 1  # less overlap
            elif ends[k] - at > 1:
                whole_unit = ends[k]
                ends[k : k + 1] = range(at + 1, whole_unit + 1)  # the unit is longer by itself than within the text
                last = bisect_left(ends, whole_unit, k)
            else:
                break  # one character of more tokens than the limit
        made.append((starts[start], starts[ends[last]], n, LEVELS[level[at]] if at else None))
        at, k = ends[last], last + 1
        start = min(at, max(bisect_left(total, total[at] - overlap), start + 1))
    return made


def _with_cut_words(words: list[str], tokens: list[int], level: list[int], most: int, code: Encoder) -> tuple[list[int], list[int], list[int]]:
    """Starts, tokens and separators where words of more than ``most`` tokens are several units."""
    starts, counts, kinds, at = [], [], [], 0
    for i, w in enumerate(words):
        parts = _cut_word(w, most, code) if tokens[i] > most else [w]
        for k, p in enumerate(parts):
            starts.append(at)
            counts.append(code.count(p) if len(parts) > 1 else tokens[i])
            kinds.append(level[i] if k == 0 else WORD + 1)
            at += len(p)
    return [*starts, at], counts, [*kinds, level[-1]]


def _cut_word(word: str, most: int, code: Encoder) -> list[str]:
    """Pieces of one word within ``most`` tokens, between grapheme clusters where possible."""
    units = regex.findall(r"\X", word)
    made: list[str] = []

    def halve(parts: list[str]) -> None:
        whole = "".join(parts)
        if code.count(whole) <= most:
            made.append(whole)
        elif len(parts) > 1:
            halve(parts[: len(parts) // 2])
            halve(parts[len(parts) // 2 :])
        elif len(whole) > 1:  # a cluster of very many marks
            halve(list(whole))
        else:
            made.append(whole)

    halve(units)
    return made


def pieces(df: DataFrame, key: str, text: str, limit: int, overlap: int, path: str | None = None) -> DataFrame:
    """(key, piece, start, end, n_tokens, separator, text) of every text.

    ``piece`` counts from 0; ``start`` and ``end`` are offsets in characters;
    ``separator`` is what the cut before the piece follows (null for the first).
    Null and empty texts have no pieces.  Repeated rows give repeated pieces.
    Other columns are not read.  Whole texts are processed; no shuffle.
    """
    path = path or vocabulary()
    read = spread(df.select(F.col(key).alias("k"), text_of(F.col(text)).alias("t")))
    kind = T.StructType(
        [T.StructField("k", read.schema["k"].dataType)]
        + [T.StructField(n, T.IntegerType()) for n in ("piece", "start", "end", "n_tokens")]
        + [T.StructField("separator", T.StringType()), T.StructField("text", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for whole in batches:
            for b in chunks(whole, 1):
                rows, owner = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for p, (start, end, n, sep) in enumerate(split(t, limit, overlap, code) if t else ()):
                        owner.append(i)
                        rows.append((p, start, end, n, sep, t[start:end]))
                cols = list(zip(*rows)) or [()] * 6
                arrays = [b.column(0).take(pa.array(owner, pa.int32()))]
                arrays += [pa.array(c, pa.int32()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]]
                yield pa.RecordBatch.from_arrays(arrays, names=kind.names)

    return read.mapInArrow(run, kind).withColumnRenamed("k", key) if key != "k" else read.mapInArrow(run, kind)
