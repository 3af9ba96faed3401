"""Cutting oversized texts at natural boundaries near content-defined landmarks.

A rolling hash over the last tokens marks landmarks; a cut goes to the natural boundary (section, then
paragraph, then sentence) nearest to the first landmark past the minimum. Whether a place is a landmark
or a boundary depends only on the text around it, so an edit moves the cuts next to it and the later
ones fall back into place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import WORD_OR_MARK

LIMIT, OVERLAP, LEAST = 350, 60, 100
#: Tokens the rolling hash covers; about one place in 2**MASK_BITS is a landmark.
WINDOW, MASK_BITS = 12, 5
#: Beginning of a section: a numbered line, a named heading with a number or letter, a mark of a table or section, a line in capitals.
_SECTION = re.compile(r"\d{1,2}(?:(?:\.\d{1,2}){1,3}[.)]?|[.)])\s+\S|(?i:annex(?:ure)?|appendix|schedule|chapter|part|section)\s+(?:\d{1,3}|[IVXLC]{1,6}|[A-Z])\b|\[/?TABLE\]|\[Section:|[A-Z][A-Z0-9 ,&()\-/'.]{6,90}(?:\n|$)")
_STOP = frozenset(".!?;:。！？…")


def landmarks(tokens: list[str]) -> np.ndarray:
    """Whether the window that ends just before each token hashes to a landmark."""
    n = len(tokens)
    h = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, n)
    roll = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for back in range(1, WINDOW + 1):
            roll[back:] += h[: n - back] * np.uint64(pow(0x9E3779B97F4A7C15, back, 1 << 64) | 1)
    mixed = roll ^ (roll >> np.uint64(29))
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - MASK_BITS) == 0


def boundaries(text: str, starts: list[int], ends: list[int], tokens: list[str]) -> np.ndarray:
    """3: a section begins at the token, 2: a paragraph, 1: a sentence or line, 0: neither."""
    level = np.zeros(len(starts), np.int8)
    for i in range(1, len(starts)):
        gap = text[ends[i - 1] : starts[i]]
        if not gap:
            continue
        if "\n" in gap:
            if _SECTION.match(text, starts[i]):
                level[i] = 3
            else:
                level[i] = 2 if gap.count("\n") > 1 else 1
        elif tokens[i - 1] in _STOP or tokens[i - 1] in "\"')]”’" and i > 1 and tokens[i - 2] in _STOP:
            level[i] = 1
    return level


def cuts(level: np.ndarray, marks: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[int]:
    """Token positions where pieces end, the last one the number of tokens.

    A piece has least..limit - overlap new tokens (the first one up to limit), the last one may have fewer.
    """
    n, at, out = len(level), 0, []
    while n - at > (limit if at == 0 else limit - overlap):
        lo, hi = at + least, at + limit - overlap
        span = np.arange(lo, hi + 1)
        hits = span[marks[lo : hi + 1]]
        mark = int(hits[0]) if len(hits) else hi
        for want in (3, 2, 1):
            places = span[level[lo : hi + 1] >= want]
            if len(places):
                mark = int(places[np.abs(places - mark).argmin()])
                break
        out.append(mark)
        at = mark
    return [*out, n]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str, int, int, int, int, int]]:
    """(piece, tokens, begin, fresh, end, boundary) of a text above the limit, else one piece; no token gives no piece.

    boundary is the level of the place the piece begins at (of boundaries(); 3 for the first). begin and end are places in the text, fresh the place where the text that the piece before doesn't hold
    begins: the parts from fresh to end put together give the text again.
    """
    if len(text) <= limit:
        n = len(WORD_OR_MARK.findall(text))
        return [(text, n, 0, 0, len(text), 3)] if n else []
    spans = [m.span() for m in WORD_OR_MARK.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(text, n, 0, 0, len(text), 3)] if n else []
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    tokens = [text[a:b] for a, b in spans]
    out, before, level = [], 0, boundaries(text, starts, ends, tokens)
    for cut in cuts(level, landmarks(tokens), limit, overlap, least):
        first = max(0, before - overlap)
        begin, fresh = (0, 0) if before == 0 else (starts[first], starts[before])
        end = starts[cut] if cut < n else len(text)
        out.append((text[begin:end], cut - first, begin, fresh, end, int(level[before]) if before else 3))
        before = cut
    return out


PIECE = "piece int, pieces int, piece_text string, token_count int, begin int, fresh int, end int, boundary int"


def split_rows(rows: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST, whole: bool = True) -> DataFrame:
    """(keys, piece, pieces, piece_text, token_count, begin, fresh, end): the pieces of each row's text.

    A text within the limit is one piece, left out if whole is false; a null text or one without a token
    gives no row. Keys are copied to every piece (a section reference, an id), other columns are dropped.
    Each text is cut by itself: no shuffle, and a repeated row gives repeated pieces.
    """
    if not 0 <= overlap < limit or not 0 < least <= limit - overlap:
        raise ValueError("overlap must be below limit, and least within what is left")
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at, out = [], []
            for i, t in enumerate(part[text]):
                if t is None or not whole and len(t) <= limit:
                    continue
                made = split_text(t, limit, overlap, least)
                if whole or len(made) > 1:
                    at += [i] * len(made)
                    out += [(k, len(made), *p) for k, p in enumerate(made)]
            left = part[keys].iloc[at].reset_index(drop=True)
            yield pd.concat([left, pd.DataFrame(out, columns=[f.split()[0] for f in PIECE.split(", ")])], axis=1)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + PIECE
    return rows.select(*[F.col(k) for k in keys], F.col(text)).mapInPandas(run, schema)
