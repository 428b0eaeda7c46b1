"""Script adapter: translatable lines out of script files, translations back in, all other bytes unchanged."""

from __future__ import annotations

import codecs as _codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions import codecs, paths
from segmill.functions import text as T

# Script suffixes of the engines, and the forms of a translatable line.
SUFFIXES = {"kirikiri": ".ks", "renpy": ".rpy", "nscripter": ".txt"}
ONLY_NAME = {"nscripter": "0.txt"}
QUOTED = r'^(\s*(?:(?:[A-Za-z_][\w.]*)\s+|old\s+|new\s+)?")((?:\\.|[^"\\])*)("\s*(?:#.*)?)$'
JAPANESE = "[\\u3040-\\u30ff\\u3400-\\u9fff]"
_SPACE = "[\\s\\x1c-\\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_TRIMMED = f"(?s)^({_SPACE}*)(.*?)({_SPACE}*)$"


def script_files(files: DataFrame, engine: str) -> DataFrame:
    """The files that an engine's adapter reads, by suffix and, for one engine, by name; links left out."""
    own = files.where(F.lower("path").endswith(SUFFIXES[engine]))
    if engine in ONLY_NAME:
        own = own.where(F.lower(paths.base_name(F.col("path"))) == ONLY_NAME[engine])
    return own.where(~F.col("is_link")) if "is_link" in files.columns else own


def decoded_files(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """``(path, text, encoding, bom, error)`` of ``(path, content)``."""
    return files.select("path", codecs.decoded(F.col("content"), encoding).alias("d")).select("path", "d.*")


def lines(texts: DataFrame) -> DataFrame:
    """``(path, line, body, newline, encoding, bom)``: lines from 1, with their terminators split off.

    Lines end at every Unicode line break; only CR, LF and CR LF are terminators, other breaks stay in the
    body. An empty text has no line.
    """
    inner = "[^\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\u0085\\u2028\\u2029]"
    whole = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{inner}*(?:{T.LINE_BREAK})|{inner}+$"), F.lit(0))
    each = texts.select("path", "encoding", "bom", F.posexplode(whole).alias("at", "whole"))
    end = F.regexp_extract("whole", "(\\r\\n|\\r|\\n)$", 1)
    return each.select("path", (F.col("at") + 1).alias("line"), F.expr("substring(whole, 1, length(whole) - length(regexp_extract(whole, '(\\\\r\\\\n|\\\\r|\\\\n)$', 1)))").alias("body"), end.alias("newline"), "encoding", "bom")


def parts(engine: str, body: Column) -> Column:
    """``struct<prefix, source, suffix>`` of a line, NULL where it holds nothing to translate."""
    inner = T.stripped(body)
    if engine == "renpy":
        part = lambda k: F.regexp_extract(body, QUOTED, k)
        shape = F.struct(part(1).alias("prefix"), part(2).alias("source"), part(3).alias("suffix"))
        return F.when((inner != "") & body.rlike(QUOTED), shape)
    if engine not in SUFFIXES:
        raise ValueError(f"unsupported engine: {engine}")
    skipped = inner.rlike(r"^[;*@]") | (inner == "")
    skipped |= inner.rlike(r"(?s)^\[.*\]$") if engine == "kirikiri" else ~inner.rlike(JAPANESE)
    part = lambda k: F.regexp_extract(body, _TRIMMED, k)
    return F.when(~skipped, F.struct(part(1).alias("prefix"), part(2).alias("source"), part(3).alias("suffix")))


def extract(files: DataFrame, engine: str, encoding: str | None = None) -> DataFrame:
    """Records of all translatable lines of ``(path, content)``, in a narrow plan without a shuffle.

    Columns: ``segment_id, engine, path, line, source, target, source_sha256, line_sha256, prefix, suffix,
    encoding, bom, newline``; hashes are of UTF-8 text. Files that decode under no encoding fail the query.
    """
    texts = decoded_files(script_files(files, engine), encoding)
    checked = texts.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(F.concat("path", F.lit(": "), "error"))))
    found = lines(checked).withColumn("p", parts(engine, F.col("body"))).where("p IS NOT NULL")
    return found.select(
        F.concat("path", F.lit(":"), "line").alias("segment_id"), F.lit(engine).alias("engine"), "path", "line", F.col("p.source").alias("source"), F.lit("").alias("target"),
        F.sha2(F.col("p.source"), 256).alias("source_sha256"), F.sha2("body", 256).alias("line_sha256"), F.col("p.prefix").alias("prefix"), F.col("p.suffix").alias("suffix"), "encoding",
        F.coalesce(F.hex("bom"), F.lit("")).alias("bom"), F.replace(F.replace("newline", F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")).alias("newline"),
    )


def problems(files: DataFrame, translations: DataFrame, allow_empty: bool = False) -> DataFrame:
    """``(path, line, segment_id, problem)`` of every translation that can't be put back safely.

    All are checked before anything is written: unsafe or unknown paths, mixed encodings, an encoding or
    byte order mark that isn't the recorded one (a file read by its UTF-16 mark can't be written back), lines that are
    gone or changed, repeated lines, empty or several-line targets, quotes that would end a quoted line.
    """
    texts = _reread(files, translations)
    own = translations.withColumn("target", F.col("target"))
    mixed = own.groupBy("path").agg((F.count_distinct("encoding") + F.max(F.col("encoding").isNull().cast("int"))).alias("encodings"))
    repeats = own.groupBy("path", "line").agg(F.count("*").alias("times"))
    here = lines(texts).select("path", "line", "body")
    joined = own.join(mixed, "path", "left").join(repeats, ["path", "line"], "left").join(texts.select("path", F.col("bom").alias("real_bom"), "error", F.lit(True).alias("there")), "path", "left").join(here, ["path", "line"], "left")
    piece = lambda c: F.coalesce(F.col(c), F.lit(""))
    problem = (
        F.when(~F.coalesce(paths.is_safe(F.col("path")), F.lit(False)), "unsafe path")
        .when(F.col("there").isNull(), "no such file")
        .when(F.col("encodings") != 1, "mixed or missing encodings")
        .when(F.col("error").isNotNull() | (F.coalesce(F.hex("real_bom"), F.lit("")) != piece("bom")), "encoding or byte order mark drift")
        .when(F.col("body").isNull(), "line no longer exists")
        .when(F.col("times") > 1, "two translations of one line")
        .when((F.sha2(piece("source"), 256) != piece("source_sha256")) | (F.sha2("body", 256) != piece("line_sha256")) | (F.concat(piece("prefix"), piece("source"), piece("suffix")) != F.col("body")), "source drift")
        .when(F.col("target").isNull() | ((F.col("target") == "") & F.lit(not allow_empty)), "translation is empty")
        .when(F.col("target").rlike("[\\r\\n]"), "target of several lines")
        .when((F.col("engine") == "renpy") & T.has_unescaped_quote(F.col("target")), "unescaped quote")
    )
    return joined.select("path", "line", "segment_id", problem.alias("problem")).where("problem IS NOT NULL")


def _reread(files: DataFrame, translations: DataFrame) -> DataFrame:
    """The translated files decoded with their recorded encodings (UTF-8 with its mark: recorded as such)."""
    recorded = translations.groupBy("path").agg(F.min("encoding").alias("recorded"), F.max("bom").alias("mark"))

    @F.pandas_udf("text string, bom binary, error string")
    def read(content: pd.Series, name: pd.Series, mark: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, codec, held in zip(content, name, mark, strict=True):
            data = bytes(raw)
            own = _codecs.BOM_UTF8 if codec == "utf-8" and held and data.startswith(_codecs.BOM_UTF8) else b""
            try:
                rows.append((data[len(own) :].decode(codec), own, None))
            except (UnicodeError, LookupError) as error:
                rows.append((None, None, type(error).__name__))
        return pd.DataFrame(rows, columns=["text", "bom", "error"])

    return files.join(recorded, "path").select("path", F.col("recorded").alias("encoding"), read("content", "recorded", "mark").alias("d")).select("path", "encoding", "d.*")


def rebuilt(files: DataFrame, translations: DataFrame, allow_empty: bool = False) -> DataFrame:
    """``(path, content)`` of every translated file with its targets in place; raises if any problem is open.

    Lines are put together again in order inside each file, untouched ones as they were, so an identity
    translation gives the same bytes.
    """
    first = problems(files, translations, allow_empty).orderBy("path", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].problem}: {first[0].segment_id}")
    texts = _reread(files, translations)
    marks = texts.select("path", "encoding", "bom")
    new = translations.select("path", "line", F.concat(F.coalesce("prefix", F.lit("")), "target", F.coalesce("suffix", F.lit(""))).alias("new"))
    all_lines = lines(texts).join(new, ["path", "line"], "left")
    merged = all_lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", F.concat(F.coalesce("new", "body"), "newline").alias("whole")))).alias("l"))

    @F.pandas_udf("binary")
    def encode(text: pd.Series, name: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([bytes(m or b"") + t.encode(n) for t, n, m in zip(text, name, mark, strict=True)])

    return merged.join(marks, "path").select("path", encode(F.array_join(F.col("l.whole"), ""), "encoding", "bom").alias("content"))
