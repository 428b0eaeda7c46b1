"""One consistent form of visually identical texts: confusables skeletons.

A skeleton decomposes the text, drops what has no ink, replaces every character by the prototype of its
look-alike class and decomposes again. The look-alike table isn't written out here: it is read on the
driver from the Unicode security data in the ICU library that Spark ships, and completed by rules for
width forms and kinds of space.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.operators import skew
from segmill.session import checkpointed

#: Characters without ink: default ignorables (fixed values of the Unicode character database).
_NO_INK = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
#: Signs drawn alike that the Unicode data keeps apart (fixed values).
_SIGNS = {"⋯": "…", "～": "〜", "∼": "~", "∶": ":", "•": "·"}
_WIDTH = ("<wide>", "<narrow>")


def look_alikes(spark: SparkSession) -> dict[int, str]:
    """Code point -> prototype, for every assigned character that has another one.

    Bounded by the Unicode repertoire: some 6,000 entries, 100 KB.
    """
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    chars = [
        chr(c)
        for c in range(0x21, 0x30000)
        if not 0xAC00 <= c < 0xD7A4 and unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co", "Cc", "Zs", "Zl", "Zp")
    ]
    prototypes = checker.getSkeleton("\n".join(chars)).split("\n")
    proto = {c: p for c, p in zip(chars, prototypes, strict=True) if p != unicodedata.normalize("NFD", c)}
    return closed_table(proto)


def closed_table(proto: dict[str, str]) -> dict[int, str]:
    """``str.translate`` table that reaches the last prototype of every character in one step."""
    step = dict(proto)
    for c in range(0x80, sys.maxunicode + 1):
        char = chr(c)
        kind, _, rest = unicodedata.decomposition(char).partition(" ")
        if kind in _WIDTH:
            step[char] = "".join(chr(int(x, 16)) for x in rest.split())
        elif unicodedata.category(char) == "Zs":
            step[char] = " "
    step |= {"\t": " ", **_SIGNS}

    @functools.cache
    def last(char: str) -> str:
        seen, text = {char}, step.get(char, char)
        for _ in range(8):
            parts = [step.get(x, x) for x in unicodedata.normalize("NFD", text)]
            if "".join(parts) == text or any(x in seen for x in text):
                break
            seen.update(text)
            text = "".join(parts)
        return unicodedata.normalize("NFD", text)

    return {ord(c): last(c) for c in step if last(c) != c}


def skeleton(text: str, table: dict[int, str]) -> str:
    """The skeleton of one text; empty where nothing visible is left."""
    if text.isascii():
        folded = text.translate(table)
    else:
        folded = unicodedata.normalize("NFD", _NO_INK.sub("", unicodedata.normalize("NFD", text)).translate(table))
    return "" if folded.isspace() else folded


def skeleton_column(spark: SparkSession, col: Column) -> Column:
    """The skeleton as a column (Arrow batches); NULL stays NULL."""
    shared = spark.sparkContext.broadcast(look_alikes(spark))

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        table = shared.value
        return texts.map(lambda t: skeleton(t, table), na_action="ignore")

    return of(col)


def forms(df: DataFrame, id_col: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """``(field_name, id, value)`` of the named text columns, NULLs left out: ``fields`` holds (name, column)."""
    parts = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(c).alias("value")) for n, c in fields))
    return df.select(F.col(id_col).cast("long").alias("id"), F.explode(parts).alias("p")).select("p.field_name", "id", "p.value").where("value IS NOT NULL")


def classes(values: DataFrame) -> DataFrame:
    """``(field_name, value, skeleton, rows, first_id, canonical)`` of every distinct visible value.

    ``canonical`` is the one consistent form of the class: its most frequent value, of equally frequent
    ones the least. Values are counted before anything else moves, so a value held by a third of all
    rows is one row per task; the class statistics are aggregates, never lists. Blank values (white
    space and characters without ink only) are in no class. An empty table gives no row.
    """
    spark = values.sparkSession
    distinct = values.groupBy("field_name", "value").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"))
    named = distinct.withColumn("skeleton", skeleton_column(spark, F.col("value"))).where("skeleton <> ''")
    best = named.groupBy("field_name", "skeleton").agg(
        F.count("*").alias("variants"), F.min_by("value", F.struct(-F.col("rows"), F.col("value"))).alias("canonical")
    )
    return named.join(best, ["field_name", "skeleton"])


def variant_classes(values: DataFrame) -> DataFrame:
    """``(field_name, sk, h, value, n)``: the distinct values of the classes that hold more than one, and their rows.

    ``sk`` and ``h`` are 64-bit hashes of skeleton and value; only hashes and the values of real classes
    are moved. A class is found by the least and the greatest value hash, which differ only there.
    """
    spark = values.sparkSession
    distinct = values.groupBy("field_name", "value").agg(F.count("*").alias("n"))
    named = distinct.select("field_name", "value", "n", skeleton_column(spark, F.col("value")).alias("skeleton")).where("skeleton <> ''")
    keyed = named.select("field_name", F.xxhash64("skeleton").alias("sk"), F.xxhash64("value").alias("h"), "value", "n")
    several = keyed.groupBy("field_name", "sk").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("field_name", "sk")
    return keyed.join(several, ["field_name", "sk"])


def look_alike_pairs(values: DataFrame) -> DataFrame:
    """``(field_name, id_a, id_b)``, smaller id first: all pairs of rows that look alike but aren't the same string.

    Takes :func:`forms`. Pairs are formed of distinct values of one class and only then widened to rows:
    equal strings never meet. Values of many rows are split (:mod:`skew`), rows are pre-filtered to
    values of classes that have variants. Two hash collisions at once would be needed for a wrong pair.
    """
    variants = checkpointed(variant_classes(values).select("field_name", "sk", "h", "n"))  # values of classes with variants only
    heavy = skew.heavy_keys(variants, ["field_name", "h"])
    rows = values.select("field_name", F.xxhash64("value").alias("h"), "id")
    held = skew.split_join(rows, variants.select("field_name", "h"), ["field_name", "h"], heavy, "id", "left_semi")
    side = lambda c: variants.select("field_name", "sk", F.col("h").alias(f"h{c}"), F.struct("field_name", "h").alias(c))
    pairs = side("a").join(side("b"), ["field_name", "sk"]).where("ha < hb").select("a", "b")
    key = F.struct("field_name", "h").alias("key")
    met = skew.row_pairs(pairs, held.select(key, "id"), skew.heavy_keys(variants.select(key, "n"), ["key"]))
    return met.select("a.field_name", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def normalised(values: DataFrame) -> DataFrame:
    """``(field_name, id, value, canonical)``: every row with the consistent form of its text.

    A value in very many rows is split by the adaptive skew join.
    Blank values keep themselves.
    """
    best = classes(values).where("variants > 1 AND value <> canonical").select("field_name", "value", F.col("canonical").alias("other"))
    return values.join(best, ["field_name", "value"], "left").select("field_name", "id", "value", F.coalesce("other", "value").alias("canonical"))
