"""Per-document text quality: basic counts, and the nearest structural profile by Jensen-Shannon divergence.

A text is cut into blocks of lines of one shape (marked entries, delimited rows, plain lines). Of each
block three distributions are taken: function words among words and numbers, classes of characters,
and shapes of lines. Their Jensen-Shannon divergences from the profiles of prose in several
languages, of lists, tables and junk are added up; the block belongs to the nearest profile. A text
is natural prose if its prose blocks hold more of its words than the other blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares expected in each kind of block. words: function, other, number, odd token. chars: lower,
#: upper, digit, blank, sentence mark, delimiter, other symbol, letter beyond ASCII. lines: ends as a
#: sentence, marked entry without such end, delimited row, bare.
PROFILES: dict[str, tuple[list[float], list[float], list[float]]] = {
    "prose_en": ([0.27, 0.69, 0.04, 0.0], [0.81, 0.015, 0.01, 0.14, 0.015, 0.004, 0.004, 0.002], [0.9, 0.02, 0.0, 0.08]),
    "prose_fr": ([0.45, 0.52, 0.03, 0.0], [0.77, 0.015, 0.01, 0.155, 0.012, 0.002, 0.002, 0.034], [0.9, 0.02, 0.0, 0.08]),
    "prose_de": ([0.45, 0.52, 0.03, 0.0], [0.80, 0.015, 0.01, 0.15, 0.012, 0.002, 0.002, 0.009], [0.9, 0.02, 0.0, 0.08]),
    "prose_es": ([0.45, 0.52, 0.03, 0.0], [0.79, 0.015, 0.01, 0.15, 0.012, 0.002, 0.002, 0.019], [0.9, 0.02, 0.0, 0.08]),
    "prose_wrapped": ([0.25, 0.71, 0.04, 0.0], [0.81, 0.015, 0.01, 0.14, 0.012, 0.004, 0.007, 0.002], [0.2, 0.02, 0.0, 0.78]),
    "list_marked": ([0.05, 0.85, 0.05, 0.05], [0.82, 0.015, 0.01, 0.11, 0.0, 0.03, 0.015, 0.0], [0.02, 0.96, 0.0, 0.02]),
    "list_bare": ([0.04, 0.95, 0.01, 0.0], [0.80, 0.06, 0.005, 0.11, 0.0, 0.02, 0.005, 0.0], [0.02, 0.05, 0.03, 0.9]),
    "table": ([0.03, 0.67, 0.25, 0.05], [0.66, 0.03, 0.12, 0.11, 0.0, 0.05, 0.03, 0.0], [0.0, 0.02, 0.96, 0.02]),
    "figures": ([0.0, 0.15, 0.8, 0.05], [0.1, 0.03, 0.6, 0.2, 0.0, 0.04, 0.03, 0.0], [0.02, 0.05, 0.43, 0.5]),
    "junk_symbols": ([0.0, 0.35, 0.25, 0.4], [0.38, 0.1, 0.15, 0.1, 0.02, 0.1, 0.15, 0.0], [0.02, 0.03, 0.15, 0.8]),
    "junk_code": ([0.0, 0.5, 0.1, 0.4], [0.4, 0.35, 0.15, 0.0, 0.0, 0.03, 0.07, 0.0], [0.02, 0.03, 0.05, 0.9]),
    "junk_coding": ([0.02, 0.9, 0.05, 0.03], [0.1, 0.06, 0.01, 0.14, 0.01, 0.005, 0.025, 0.65], [0.6, 0.02, 0.0, 0.38]),
}
#: Weights of the three divergences.
WEIGHTS = (1.5, 0.7, 0.8)
NAMES = list(PROFILES)
#: A block whose most frequent word has at least this share of its words (of 12 at least) says nothing.
REPEATED_SHARE = 0.34
LANG_ORDER = ("en", "fr", "de", "es")

_MARK = re.compile(r"\s*(?:[-*+•·‣◦▪■□●○–—»>]|o(?= )|\[[ xX]?\]|☐|☑|\(?(?:\d{1,3}(?:\.\d{1,3})*|[a-zA-Z]|[ivxIVX]{1,5})[.)])(?=\s|$)\s*|\s*\d{1,3}(?:\.\d{1,3})+\s+|Q\d+[.:)]\s+|A\d*[.:)]\s+")
_END = re.compile(r"[.!?…。！？][\"'”’)\]»]*\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-‐‑][^\W\d_]+)*")
_NUMBER = re.compile(r"\d[\d.,:/%]*")
_GAP = re.compile(r"\S {2,}(?=\S)")
_TIGHT = re.compile(r"[,;](?=[^\s\d])|[,;](?=\d+(?:[,;%.]|$))")
_LEADER = re.compile(r"\.{4,}|(?:\. ){3,}|_{4,}")
_PAIR = re.compile(r"^\s*[\w][\w /-]{0,40}:\s+\S")
_TAG = re.compile(r"</?[a-zA-Z][^>]{0,200}>|&[a-z]{2,6};|\{\{|\}\}")


def _char_table() -> bytes:
    table = bytearray(b"G" * 256)
    for i in range(256):
        ch = chr(i)
        if i < 128 and ch.islower():
            table[i] = ord("a")
        elif i < 128 and ch.isupper():
            table[i] = ord("b")
        elif ch.isdigit() and i < 128:
            table[i] = ord("c")
        elif ch in " \r\n" or i == 0xA0:
            table[i] = ord("d")
        elif ch in ".!?,":
            table[i] = ord("e")
        elif ch in "|\t;:=":
            table[i] = ord("f")
        elif i >= 0xC0 and i not in (0xD7, 0xF7):
            table[i] = ord("h")
        else:
            table[i] = ord("g")
    return bytes(table)


_CHARS = _char_table()
_WIDE = re.compile(r"[^\x00-\xff]")


def _wide(m: re.Match[str]) -> str:
    return "é" if m[0].isalpha() else "#"


def _shape(line: str) -> str:
    """m: marked entry, t: delimited row, p: plain line."""
    s = line.strip()
    if s in ("[TABLE]", "[/TABLE]") or s.count("|") >= 1 and (s[0] == "|" or " | " in s or s.count("|") >= 2) or "\t" in s:
        return "t"
    if ("..." in s or "___" in s or ". ." in s) and _LEADER.search(s):
        return "t"
    m = _MARK.match(line)
    if m and m.end():
        return "m"
    if "  " in s and len(_GAP.findall(s)) >= 2 or ("," in s or ";" in s) and len(_TIGHT.findall(s)) >= 2:
        return "t"
    if len(s) < 90 and ":" in s and _PAIR.match(s) and not _END.search(s[-8:]):
        return "t"
    return "p"


def language_profiles(docs: DataFrame, common: dict[str, list[str]], text: str, lang: str) -> dict[str, dict[str, float]]:
    """The share of each function word of a language among all of them, over all documents labelled with the language.

    Labels compare without case and outer blanks, words are those that texts are measured by; each task sends one number a
    function word.
    """
    sets = {k: frozenset(v) for k, v in common.items()}

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, str]] = Counter()
        for part in parts:
            for label, body in zip(part["lang"], part["text"], strict=True):
                if known := sets.get(label):
                    words = Counter(_WORD.findall(body.lower()))
                    for w in known & words.keys():
                        seen[label, w] += words[w]
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["lang", "word", "n"])

    labelled = docs.select(F.lower(F.trim(lang)).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    counts = labelled.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, float]] = {}
    for r in counts.orderBy("lang", "word").collect():  # MAX_WORDS rows at most
        out.setdefault(r["lang"], {})[r["word"]] = float(r["n"])
    return {k: {w: c / sum(v.values()) for w, c in v.items()} for k, v in out.items()}


def nearest_language(counts: dict[str, int], profiles: dict[str, dict[str, float]]) -> tuple[str | None, float]:
    """(language, divergence in bits) of the profile nearest to the distribution of a text's function words; (None, 1) without any."""
    best: tuple[str | None, float] = (None, 1.0)
    for lang in sorted(profiles):
        q = profiles[lang]
        seen = {w: c for w, c in counts.items() if c}
        total = sum(seen.values())
        if not total:
            continue
        # words that only one side has add half of their share each
        d = sum(p / 2 for w, p in q.items() if w not in seen)
        for w, c in seen.items():
            p, r = c / total, q.get(w, 0.0)
            m = (p + r) / 2
            d += (p * math.log2(p / m) + (r * math.log2(r / m) if r else 0.0)) / 2
        if d < best[1]:
            best = lang, d
    return best


class Measure:
    """Counts of texts, given the function words of each language and, if fitted, how they are distributed in its prose."""

    def __init__(self, common: dict[str, list[str]], profiles: dict[str, dict[str, float]] | None = None):
        self.profiles = profiles or {}
        self.langs = [x for x in (*LANG_ORDER, *sorted(set(common) - set(LANG_ORDER))) if x in common]
        self.sets = [frozenset(common[x]) for x in self.langs]
        self.any = frozenset().union(*self.sets)

    def blocks(self, text: str) -> list[tuple[str, list[str]]]:
        out: list[tuple[str, list[str]]] = []
        for line in text.splitlines():
            if not line.strip():
                if out and out[-1][1]:
                    out.append(("", []))
                continue
            shape = _shape(line)
            if out and out[-1][0] == shape:
                out[-1][1].append(line)
            else:
                out.append((shape, [line]))
        return [b for b in out if b[1]]

    def block(self, shape: str, lines: list[str]) -> tuple[list[float], float, bool, int, dict[str, int]]:
        """The three count vectors of a block in one list, its weight in words, whether it merely repeats itself, its words without markup, its function words."""
        body = " ".join(lines)
        counts = Counter(_WORD.findall(body.lower()))
        words = counts.total()
        numbers = len(_NUMBER.findall(body))
        if shape == "t":
            func = sum(counts[w] for w in self.any & counts.keys() if w not in ("no", "a"))
        else:
            func = max((sum(counts[w] for w in s & counts.keys()) for s in self.sets), default=0)
        odd = sum(n for w, n in counts.items() if len(w) > 28)
        tags = len(_TAG.findall(body)) if "<" in body or "&" in body or "{{" in body else 0
        odd += tags
        plain = body if body.isascii() else _WIDE.sub(_wide, body)
        marks = plain.encode("latin-1", "replace").translate(_CHARS)
        n = [marks.count(k) for k in b"abcdefgh"]
        n[6] += marks.count(b"G")
        ended = sum(1 for x in lines if _END.search(x[-12:]))
        row = len(lines) if shape == "t" else 0
        marked = len(lines) - ended if shape == "m" else 0
        bare = len(lines) - row - marked - (ended if shape != "t" else 0)
        longest = max(counts.values(), default=0)
        repeats = (
            words >= 12 and longest >= REPEATED_SHARE * words
            or words >= 30 and len(counts) <= 10
            or len(lines) >= 5 and len(set(lines)) <= 0.2 * len(lines)
        )
        vec = [func, max(0, words - func - odd), numbers, odd, *n, 0 if shape == "t" else ended, marked, row, max(0, bare)]
        weight = words + numbers + 0.2 * n[6] + 0.3 * odd
        plain_words = len(_WORD.findall(_TAG.sub(" ", body))) if tags else words
        return vec, max(1.0, weight), repeats, plain_words, {w: counts[w] for w in self.any & counts.keys()}


def _jsd(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from each row of q."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return (left + right) / 2


_CUTS = ((0, 4), (4, 12), (12, 16))
_TARGETS = [np.array([PROFILES[n][k] for n in NAMES]) / np.array([PROFILES[n][k] for n in NAMES]).sum(1, keepdims=True) for k in range(3)]


def distances(vectors: np.ndarray) -> np.ndarray:
    """Summed weighted divergence of each block from each profile; an empty distribution counts as 1 bit."""
    total = np.zeros((len(vectors), len(NAMES)))
    for (a, b), target, weight in zip(_CUTS, _TARGETS, WEIGHTS, strict=True):
        part = vectors[:, a:b].astype(float)
        sums = part.sum(1, keepdims=True)
        d = _jsd(part / np.maximum(sums, 1e-9), target)
        total += weight * np.where(sums > 0, d, 1.0)
    return total


FIELDS = "n_words long, mean_word_length double, symbol_ratio double, end_punct_share double, common_word_share double, prose_share double, profile string, divergence double, language string, language_divergence double, is_prose boolean"


def measure_batch(texts: list[str | None], measure: Measure) -> pd.DataFrame:
    vectors, owner, weights, repeats, basic, spoken = [], [], [], [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        n_words = letters = common = ended = lines = 0
        heard: dict[str, int] = {}
        for shape, block in measure.blocks(text):
            vec, weight, repeated, plain_words, functions = measure.block(shape, block)
            for w, c in functions.items():
                heard[w] = heard.get(w, 0) + c
            vectors.append(vec)
            owner.append(i)
            weights.append(weight)
            repeats.append(repeated)
            n_words += plain_words
            common += vec[0]
            letters += vec[4] + vec[5] + vec[11]
            ended += vec[12]
            lines += len(block)
        spoken.append(nearest_language(heard, measure.profiles))
        basic.append((n_words, letters / n_words if n_words else 0.0, ended / lines if lines else 0.0, common / n_words if n_words else 0.0))
    out = pd.DataFrame(basic, columns=["n_words", "mean_word_length", "end_punct_share", "common_word_share"])
    n = len(texts)
    prose, total, symbols, chars = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    mass = np.zeros((n, len(NAMES)))
    spread = np.zeros(n)
    if vectors:
        v, o, w = np.array(vectors, float), np.array(owner), np.array(weights)
        d = distances(v)
        nearest = d.argmin(1)
        nearest = np.where(np.array(repeats), NAMES.index("junk_symbols"), nearest)
        np.add.at(mass, (o, nearest), w)
        np.add.at(total, o, w)
        np.add.at(symbols, o, v[:, 9] + v[:, 10])
        np.add.at(chars, o, v[:, 4:12].sum(1) - v[:, 7])
        np.add.at(spread, o, w * d.min(1))
        prose = mass[:, [k for k, x in enumerate(NAMES) if x.startswith("prose")]].sum(1)
    safe = np.maximum(total, 1e-9)
    out["symbol_ratio"] = symbols / np.maximum(chars, 1)
    out["prose_share"] = prose / safe
    kinds = [x.split("_")[0] for x in NAMES]
    by_kind = {k: mass[:, [i for i, x in enumerate(kinds) if x == k]].sum(1) for k in dict.fromkeys(kinds)}
    best = np.array(list(by_kind))[np.array(list(by_kind.values())).argmax(0)] if n else np.array([], dtype=object)
    out["profile"] = np.where(total > 0, best, "empty")
    out["divergence"] = spread / safe
    out["language"] = [lang for lang, _ in spoken]
    out["language_divergence"] = [d for _, d in spoken]
    out["is_prose"] = (out["prose_share"] > 0.5) & (out["n_words"] > 2)
    return out


def text_quality(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """(key, counts and shares, profile, divergence, language, its divergence, is_prose) of every row of docs.

    language is that of the nearest distribution of function words, of those fitted on all documents by
    their label in the column lang; null without such a column or without a function word.

    common_words(lang, word) is a fixed table of function words (at most MAX_WORDS rows are held by each
    task). A null or empty text has no words, profile 'empty' and isn't prose. Rows are measured one by
    one in Arrow batches without a shuffle; long texts count as a whole; extra columns are dropped.
    """
    common: dict[str, list[str]] = {}
    for row in common_words.select("lang", "word").distinct().limit(MAX_WORDS + 1).collect():
        common.setdefault(row.lang, []).append(row.word)
    if sum(map(len, common.values())) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} common words")
    measure = Measure(common or {"en": []}, language_profiles(docs, common, text, lang) if lang else None)
    kind = dict(docs.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = measure_batch(part[text].tolist(), measure)
            out.insert(0, key, part[key].to_numpy())
            yield out[[key, *[f.split()[0] for f in FIELDS.split(", ")]]]

    return docs.select(F.col(key), F.col(text)).mapInPandas(run, f"`{key}` {kind}, {FIELDS}")


#: Rows of the function-word table at most.
MAX_WORDS = 20000
