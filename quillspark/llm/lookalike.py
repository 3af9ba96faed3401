"""One consistent form for text that looks the same but is stored with other characters.

Stretches with characters beyond ASCII are exploded to positioned code points, joined with a
broadcast mapping (compatibility decomposition, look-alikes, characters without width), put into
canonical order by combining class, recomposed and written back into their texts. Pure ASCII text
already is in the consistent form and isn't exploded.
"""

from __future__ import annotations

import logging
import sys
import unicodedata
from functools import cache

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import staged

#: Letters and marks whose usual glyph is that of another character, by the glyph shown.
LOOK_ALIKES = {
    # Greek capitals and small letters
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ϲ": "c", "ϳ": "j", "Ϳ": "J", "Ϲ": "C",
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "Ӏ": "I",
    # Armenian, Cherokee and other scripts
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l",
    # marks
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "⁃": "-", "˗": "-", "∶": ":", "꞉": ":", "։": ":", "׃": ":", "ː": ":", "ʼ": "’", "ʹ": "'", "′": "'",
    "∕": "/", "⁄": "/", "⧸": "/", "∣": "|", "ǀ": "|", "․": ".", "‚": ",", "∗": "*", "٭": "*", ";": ";", "‹": "<", "›": ">",
}
#: Blocks of code points without width that are no format characters.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Strings of one form that one task pairs with the rest at most.
PAIR_BLOCK = 1000
#: A stretch: characters beyond ASCII, with the character before them, which may carry their marks.
STRETCH = r"[\x00-\x7f]?[^\x00-\x7f]+"


@cache
def confusables(jvm: object) -> dict[str, str]:
    """Letters and digits beyond ASCII by the glyph shown, from the public confusables data of Unicode in Spark's own ICU library.

    The data merge 1, I, l and | too: a capital shown as their stroke becomes I, a digit 1, another letter l. Han and
    Hangul are left alone, and so are marks: LOOK_ALIKES has those that don't differ to the eye. A Spark without that
    library has LOOK_ALIKES only, and says so.
    """
    skip = (range(0x3400, 0xA000), range(0xAC00, 0xD7A4), range(0xE000, 0xF900), range(0x20000, 0x33480))
    chars = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LN" and not any(ord(c) in r for r in skip)]
    try:
        skeletons = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(0, "\n".join(chars)).split("\n")
    except (TypeError, Py4JError) as e:
        logging.getLogger(__name__).warning("no confusables data (%s): look-alikes are those of the short list", e)
        return {}
    stroke = {"Lu": "I", "Nd": "1"}
    return {c: stroke.get(unicodedata.category(c), s) if s == "l" else s for c, s in zip(chars, skeletons, strict=True) if s != unicodedata.normalize("NFD", c)}


def glyphs(spark: SparkSession) -> dict[str, str]:
    """What shows as what: the confusables, and LOOK_ALIKES before them."""
    return confusables(spark.sparkContext._jvm) | LOOK_ALIKES


def _code_point(cp: int, shown: dict[str, str]) -> str | None:
    """What one code point becomes before ordering; None if it stays itself."""
    ch = chr(cp)
    if cp < 128 or 0xD800 <= cp < 0xE000:
        return None
    kind = unicodedata.category(ch)
    if kind == "Cf" or cp in INVISIBLE:
        return ""
    if kind == "Zs":
        return " "
    parts = unicodedata.normalize("NFKD", ch)
    if len(parts) > 1 and unicodedata.category(ch) == "Sk":
        parts = ch  # spacing accents stay visible characters of their own
    new = parts
    for _ in range(3):  # what is shown may itself show as something else
        new = "".join("" if unicodedata.category(c) == "Cf" or ord(c) in INVISIBLE else shown.get(c, c) for c in (new if new == ch else unicodedata.normalize("NFKD", new)))
    return None if new == ch else new


def mapping_rows(shown: dict[str, str] = LOOK_ALIKES) -> list[tuple[int, list[int]]]:
    """(code point, what it becomes) for all code points that change; about 8 000 of at most 1 114 112.

    Hangul syllables decompose by arithmetic and recompose to themselves, so they are left alone.
    """
    cps = (c for c in range(128, sys.maxunicode + 1) if not 0xAC00 <= c < 0xD7A4 and not 0xE000 <= c < 0xF900)
    return [(c, [ord(x) for x in new]) for c in cps if (new := _code_point(c, shown)) is not None]


@cache
def class_rows() -> list[tuple[int, int]]:
    """(code point, combining class) of every mark with a class other than 0."""
    return [(c, k) for c in range(128, sys.maxunicode + 1) if (k := unicodedata.combining(chr(c)))]


_mappings: dict[str, list[tuple[int, list[int]]]] = {}


def mapping(spark: SparkSession) -> list[tuple[int, list[int]]]:
    """mapping_rows of all glyphs, made once a process."""
    if "all" not in _mappings:
        _mappings["all"] = mapping_rows(glyphs(spark))
    return _mappings["all"]


def translation(spark: SparkSession) -> dict[int, str]:
    """The mapping for str.translate, to be broadcast to Python stages: at most one entry a code point."""
    return {c: "".join(map(chr, new)) for c, new in mapping(spark)}


@cache
def _table() -> dict[int, str]:
    return {c: "".join(map(chr, new)) for c, new in mapping_rows()}


def consistent(text: str, table: dict[int, str] | None = None) -> str:
    """The consistent form of one string by a translation, for use inside other operators' Python stages; without one, by LOOK_ALIKES only."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_table() if table is None else table))


@F.pandas_udf(T.StringType())
def _recompose(stretches: pd.Series) -> pd.Series:
    return stretches.map(lambda s: unicodedata.normalize("NFC", s))


def _stretch_forms(stretches: DataFrame) -> DataFrame:
    """(stretch, form) of the distinct stretches(stretch)."""
    spark: SparkSession = stretches.sparkSession
    becomes = F.broadcast(spark.createDataFrame(mapping(spark), "cp int, becomes array<int>"))
    classes = F.broadcast(spark.createDataFrame(class_rows(), "mark int, class int"))
    points = stretches.select("stretch", F.posexplode(F.split("stretch", "")).alias("at", "char")).filter("char <> ''")
    # ascii() gives the code point of the first character
    points = points.withColumn("cp", F.ascii("char"))
    mapped = points.join(becomes, "cp", "left").select(
        "stretch", "at", F.posexplode(F.coalesce("becomes", F.array("cp"))).alias("sub", "new")
    )
    ranked = mapped.join(classes, F.col("new") == F.col("mark"), "left").select("stretch", "at", "sub", F.coalesce("class", F.lit(0)).alias("class"), "new")
    # the marks after a starter move among themselves only: number the starters, then sort by (starter, class, place)
    starters = F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).over(Window.partitionBy("stretch").orderBy("at", "sub"))
    numbered = ranked.withColumn("n", starters)
    ordered = F.array_sort(F.collect_list(F.struct("n", "class", "at", "sub", "new")))
    spelled = F.transform("xs", lambda x: F.decode(F.unhex(F.lpad(F.hex(x["new"]), 8, "0")), "UTF-32"))
    forms = numbered.groupBy("stretch").agg(ordered.alias("xs")).select("stretch", F.array_join(spelled, "").alias("spelled"))
    # a stretch of characters without width leaves no point behind only if it has no other character
    return stretches.join(forms, "stretch", "left").select("stretch", _recompose(F.coalesce("spelled", F.lit(""))).alias("form"))


def consistent_texts(texts: DataFrame) -> DataFrame:
    """texts(field, id, text) with form added: the consistent form of text (null for null).

    Repeated rows, and rows with the same id and other texts, each get their form. Texts in ASCII pass through.
    Distinct stretches are combined on the map side before they are exploded, so a stretch that
    stands in a third of all texts is handled once; a text's own stretches are gathered per text.
    """
    plain = texts.filter(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x00-\x7f]")).withColumn("form", F.col("text"))
    rich = texts.filter(F.col("text").rlike(r"[^\x00-\x7f]")).withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = F.regexp_extract_all("text", F.lit(f"({STRETCH})"), F.lit(1))
    row = ["field", "id", "hash"]
    uses = rich.select(*row, F.posexplode(found).alias("at", "stretch"))
    forms = _stretch_forms(uses.select("stretch").distinct())
    # one row per text and stretch, however often the text repeats it
    per_text = uses.groupBy(*row, "stretch").agg(F.collect_set("at").alias("ats"))
    placed = (
        per_text.join(forms, "stretch")
        .groupBy(*row)
        .agg(F.collect_list(F.struct("ats", "form")).alias("fs"))
        .select(
            *row,
            F.transform(
                F.array_sort(F.flatten(F.transform("fs", lambda f: F.transform(f["ats"], lambda a: F.struct(a.alias("at"), f["form"].alias("form")))))),
                lambda x: x["form"],
            ).alias("new"),
        )
    )
    between = F.split("text", STRETCH, -1)
    rebuilt = F.array_join(F.zip_with(between, "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = rich.join(placed, row).withColumn("form", rebuilt).drop("new", "hash")
    return plain.unionByName(done)


def same_looking_pairs(texts: DataFrame) -> DataFrame:
    """(field, id_a, id_b): pairs of rows of one field with the same form but another string.

    Rows with the same string are first collapsed to one representative; only representatives of one
    form are joined with each other, and only then their rows come back. Null texts pair with nothing.
    """
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    prints = staged(
        consistent_texts(texts.filter(F.col("text").isNotNull())).select(
            "field", "id", digest("form").alias("form"), F.length("form").alias("size"), digest("text").alias("raw")
        ),
        "forms",
    )
    same = ["field", "form", "size"]
    kinds = prints.select(*same, "raw").distinct()
    several = kinds.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int"))
    kinds = kinds.join(several.drop("n"), same)
    # many strings of one form meet block by block, so no task pairs more than PAIR_BLOCK of them with the rest
    left = kinds.select(*same, F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("raw"), F.col("blocks")).cast("int").alias("block"))
    right = kinds.select(*same, F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = left.join(right, [*same, "block"]).filter("raw_a <> raw_b").drop("block")
    rows = prints.select(*same, "raw", "id")
    pairs = pairs.join(rows.withColumnRenamed("raw", "raw_a").withColumnRenamed("id", "id_a"), [*same, "raw_a"])
    pairs = pairs.join(rows.withColumnRenamed("raw", "raw_b").withColumnRenamed("id", "id_b"), [*same, "raw_b"])
    return pairs.filter("id_a < id_b").select("field", "id_a", "id_b")


def version_and_chunk_texts(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(field, id, text) of document_versions.raw_text and chunks.chunk_text."""
    return versions.select(F.lit("raw_text").alias("field"), "id", F.col("raw_text").alias("text")).unionByName(
        chunks.select(F.lit("chunk_text").alias("field"), "id", F.col("chunk_text").alias("text"))
    )
