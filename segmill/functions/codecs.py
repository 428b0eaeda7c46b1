"""Legacy encodings: which characters survive them, and what bytes decode to. Python's tables, never the JVM's."""

from __future__ import annotations

import codecs
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNENCODABLE = "array<struct<char:string,codepoint:string,count:int>>"
PROBED = ("utf-8", "cp932", "gbk", "utf-16-le")
#: Byte order marks, longest test first where one begins another (fixed values).
MARKS = (("utf-8-sig", codecs.BOM_UTF8), ("utf-16-le", codecs.BOM_UTF16_LE), ("utf-16-be", codecs.BOM_UTF16_BE))


def unencodable(text: Column, encoding: str) -> Column:
    """Characters that ``encoding`` can't hold, most frequent first, then in order of occurrence.

    Batches go through Arrow; a text that encodes as a whole costs one call. NULL has none.
    """
    codecs.lookup(encoding)

    @F.pandas_udf(UNENCODABLE)
    def of(texts: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def holds(char: str) -> bool:
            if char not in known:
                try:
                    char.encode(encoding)
                    known[char] = True
                except UnicodeEncodeError:
                    known[char] = False
            return known[char]

        def one(value: str | None) -> list[dict]:
            if not value:
                return []
            try:
                value.encode(encoding)
                return []
            except UnicodeEncodeError:
                lost = Counter(c for c in value if not holds(c))
                return [{"char": c, "codepoint": f"U+{ord(c):04X}", "count": n} for c, n in lost.most_common()]

        return texts.map(one)

    return of(text)


def encodes(text: Column, encoding: str) -> Column:
    """Whether the whole text, tokens included, encodes strictly; NULL does."""
    codecs.lookup(encoding)

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> bool:
            try:
                (value or "").encode(encoding)
                return True
            except UnicodeEncodeError:
                return False

        return texts.map(one)

    return of(text)


def byte_order_mark(content: Column) -> Column:
    """Name of the byte order mark that the bytes begin with, ``none`` without one."""
    chosen = F.lit("none")
    for name, mark in reversed(MARKS):
        chosen = F.when(F.startswith(content, F.lit(bytearray(mark))), F.lit(name)).otherwise(chosen)
    return chosen


def decodable_as(content: Column, encodings: tuple[str, ...] = PROBED) -> Column:
    """The encodings, in the order given, under which the bytes decode strictly."""

    @F.pandas_udf("array<string>")
    def of(contents: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> list[str]:
            found = []
            for name in encodings:
                try:
                    bytes(raw or b"").decode(name)
                    found.append(name)
                except UnicodeError:
                    continue
            return found

        return contents.map(one)

    return of(content)


def decoded(content: Column, encoding: str | None = None) -> Column:
    """``struct<text, encoding, bom, error>`` of a file's bytes.

    Without a given encoding the byte order mark decides, else the first of UTF-8, CP932 and GBK that
    decodes strictly. A given encoding is taken as it is: a mark then stays in the text.
    """

    @F.pandas_udf("text string, encoding string, bom binary, error string")
    def of(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in contents:
            data = bytes(raw if raw is not None else b"")
            tries: list[tuple[str, bytes]]
            if encoding:
                tries = [(encoding, b"")]
            else:
                marked = next(((n.removesuffix("-sig"), m) for n, m in MARKS if data.startswith(m)), None)
                tries = [marked] if marked else [(n, b"") for n in ("utf-8", "cp932", "gbk")]
            for name, mark in tries:
                try:
                    rows.append((data[len(mark) :].decode(name), name, mark, None))
                    break
                except UnicodeError:
                    continue
            else:
                rows.append((None, None, None, "not decodable as " + ", ".join(n for n, _ in tries)))
        return pd.DataFrame(rows, columns=["text", "encoding", "bom", "error"])

    return of(content)
