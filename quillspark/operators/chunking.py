"""Chunkers: one text to ordered chunks. The fixed one is an expression, the greedy ones run in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X

CHUNK_TOKENS, OVERLAP, MIN_TOKENS, LEAST_TAIL = 350, 60, 40, 15
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.;:?!])\s+(?=[A-Z0-9(])")
_PARAGRAPH = re.compile(r"\n\s*\n")
_NUMBERED, _NAMED, _CAPS = re.compile(X.NUMBERED_HEADING), re.compile(X.NAMED_HEADING), re.compile(X.CAPS_HEADING)

#: (text, type, section_ref)
Chunk = tuple[str, str, str | None]


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def fixed_chunks(docs: DataFrame, key: str, text: str, size: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, chunk_text, token_count): windows of size words that share overlap words.

    A window after the first with fewer than LEAST_TAIL tokens is dropped; null and blank texts give none.
    """
    step = size - min(overlap, size - 1)
    words = docs.select(key, X.space_words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("ws") - 1, F.lit(step)), lambda i: (i == 0) | (i - step + size < F.size("ws")))
    cut = words.select(key, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("ws", i + 1, size), " "))).alias("ordinal", "chunk_text"))
    counted = cut.withColumn("token_count", X.budget_tokens(F.col("chunk_text")))
    return counted.filter((F.col("ordinal") == 0) | (F.col("token_count") >= LEAST_TAIL))


def _windows(words: list[str], size: int, step: int) -> Iterator[str]:
    for i in range(0, len(words), step):
        yield " ".join(words[i : i + size])


def _filled(sizes: list[int], room: int, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items, each as long as its sizes fit in room, with one new item at least.

    A range begins with the last items of the one before it, as many as fit in overlap.
    """
    ends, lead, at = list(accumulate(sizes, initial=0)), 0, 0
    while at < len(sizes):
        at = max(at + 1, bisect_right(ends, ends[lead] + room) - 1)
        yield lead, at
        lead = max(lead, bisect_left(ends, ends[at] - overlap))


def recursive(text: str, size: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> list[Chunk]:
    """Paragraphs, else sentences, else windows of words, packed up to size tokens; the last units within overlap tokens start the next chunk."""
    units: list[str] = []
    for paragraph in filter(None, map(str.strip, _PARAGRAPH.split(text))):
        for unit in [paragraph] if count_tokens(paragraph) <= size else _SENTENCE.split(paragraph):
            units += [unit] if count_tokens(unit) <= size else _windows(unit.split(), size, size)
    units = [u for u in units if u]
    return [("\n\n".join(units[i:j]), "prose", None) for i, j in _filled(list(map(count_tokens, units)), size, overlap)]


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of a heading line."""
    s = line.strip()
    if not s or len(s) > 200:
        return None
    if m := _NUMBERED.match(s):
        return m[1].count(".") + 1, s
    return (1, s) if _NAMED.match(s) or _CAPS.match(s) and s[-1] not in ".," else None


def _pieces(text: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """(kind, section path, body) in order; kind is prose or table.

    A heading, either table mark, and a change between lines with bars and others each begin a new piece;
    blank lines belong to the piece they follow.
    """
    path: tuple[str, ...] = ()
    kind, marked, held = "prose", False, []
    for line in map(str.rstrip, [*text.split("\n"), "[/TABLE]"]):  # a last mark ends the last piece
        opens, closes = "[TABLE]" in line, "[/TABLE]" in line
        bars = not marked and line.count("|") >= 2
        title = None if marked or bars else heading(line)
        turn = bars != (kind == "table") and not marked and bool(line)
        if opens or closes or title or turn:
            if body := "\n".join(held).strip():
                yield kind, path, body
            held = []
        if opens or closes:
            kind, marked = ("table", True) if opens else ("prose", False)
            continue
        if title:
            path = (*path[: title[0] - 1], title[1])
        if turn or title:
            kind = "table" if bars else "prose"
        held.append(line)


def structure_aware(text: str, size: int = CHUNK_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS) -> list[Chunk]:
    """Chunks along headings with their section path; a table is a chunk of its own; small prose joins the prose before it.

    Pieces of prose share a chunk while they fit, under the path of the first; a larger one is filled up by its
    paragraphs, and a paragraph beyond the size falls into windows of words.
    """
    step = size - min(overlap, size - 1)

    def divided(body: str) -> Iterator[str]:
        paragraphs = [p for p in map(str.strip, _PARAGRAPH.split(body)) if p]
        counts = list(map(count_tokens, paragraphs))
        for i, j in _filled(counts, size):
            if counts[i] > size:
                yield from _windows(paragraphs[i].split(), size, step)
            else:
                yield "\n\n".join(paragraphs[i:j])

    made: list[Chunk] = []
    for kind, run in groupby(_pieces(text), key=lambda p: p[0]):
        paths, bodies = zip(*((path, body) for _, path, body in run), strict=True)
        counts = list(map(count_tokens, bodies))
        ranges = _filled(counts, size) if kind == "prose" else ((i, i + 1) for i in range(len(bodies)))
        for i, j in ranges:
            ref = " > ".join(paths[i]) or None
            prefix = f"[Section: {ref}]\n" if ref else ""
            whole = divided(bodies[i]) if kind == "prose" and counts[i] > size else ["\n\n".join(bodies[i:j])]
            made += [(prefix + body, kind, ref) for body in whole]
    # a chunk begins anew unless it is small prose that follows prose
    begins = [i for i, (body, kind, _) in enumerate(made) if not (i and kind == made[i - 1][1] == "prose" and count_tokens(body) < least)]
    return [("\n\n".join(c[0] for c in made[i:j]), *made[i][1:]) for i, j in pairwise([*begins, len(made)])]


CHUNKERS: dict[str, Callable[[str, int, int], list[Chunk]]] = {"recursive": recursive, "structure_aware": structure_aware}
_OUT = "ordinal int, chunk_text string, chunk_type string, section_ref string, token_count int"


def chunk(docs: DataFrame, key: str, text: str, name: str = "structure_aware", size: int = CHUNK_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, chunk_text, chunk_type, section_ref, token_count) by the chunker called name; null texts give none."""
    if name == "fixed":
        return fixed_chunks(docs, key, text, size, overlap).select(key, "ordinal", "chunk_text", F.lit("prose").alias("chunk_type"), F.lit(None).cast("string").alias("section_ref"), "token_count")
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; one of fixed, {', '.join(CHUNKERS)}")
    split, kind = CHUNKERS[name], dict(docs.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, i, body, what, ref, count_tokens(body)) for k, t in zip(part[key], part[text], strict=True) if t for i, (body, what, ref) in enumerate(split(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, *[f.split()[0] for f in _OUT.split(", ")]])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, {_OUT}")
