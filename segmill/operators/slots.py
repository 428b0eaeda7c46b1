"""Fixed-width text slots in binary files: read them, check them, compare two builds."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control markers inside slot texts (fixed value).
MARKER = r"@[A-Za-z]\([^)]*\)|[①-⑳]"
_SLOT = "text string, used_bytes int, errors array<string>"


def layout_errors(content: Column, offset: int, slot_size: int, count: int) -> Column:
    """Why a layout can't be read from the bytes; empty where it can."""
    bad = offset < 0 or slot_size <= 0 or count <= 0
    return F.array_compact(F.array(F.lit("invalid-layout" if bad else None), F.when(F.lit(offset + slot_size * count) > F.length(content), "region-out-of-bounds")))


def _wide(encoding: str) -> bool:
    return encoding.lower().replace("_", "-").startswith("utf-16")


def _read(encoding: str):
    unit = 2 if _wide(encoding) else 1
    missing = "missing-aligned-utf16-nul" if unit == 2 else "missing-nul"

    @F.pandas_udf(_SLOT)
    def read(raws: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in raws:
            data, errors = bytes(raw), []
            # only whole units count, so a zero byte across two units ends nothing
            ends = (k for k in range(0, len(data) - unit + 1, unit) if not any(data[k : k + unit]))
            end = next(ends, None)
            if end is None:
                errors.append(missing)
                payload = data
            else:
                payload = data[:end]
                if any(data[end + unit :]):
                    errors.append("nonzero-padding")
            try:
                text = payload.decode(encoding)
            except (UnicodeDecodeError, LookupError) as error:
                text = ""
                errors.append(f"decode-error:{type(error).__name__}")
            rows.append((text, len(payload), errors))
        return pd.DataFrame(rows, columns=["text", "used_bytes", "errors"])

    return read


def scan(files: DataFrame, offset: int, slot_size: int, count: int, encoding: str) -> DataFrame:
    """One row per slot of every ``(path, content)`` whose layout holds.

    Columns: ``path, index, offset, slot_size, used_bytes, capacity, capacity_unit, text, control_markers,
    raw_sha256, valid, errors``. Capacity leaves room for the terminator, in code units for UTF-16.
    """
    good = files.where(F.size(layout_errors(F.col("content"), offset, slot_size, count)) == 0)
    if count <= 0 or slot_size <= 0:
        good, count = good.where("false"), 1
    # the slots are cut out before they become rows, so that no row carries the file
    cut = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring("content", i * slot_size + offset + 1, F.lit(slot_size)))
    each = good.select("path", F.posexplode(cut).alias("index", "raw"))
    raw = each.select("path", "index", (F.col("index") * slot_size + offset).cast("long").alias("offset"), "raw")
    read = raw.withColumn("s", _read(encoding)("raw"))
    wide = _wide(encoding)
    return read.select(
        "path", "index", "offset", F.lit(slot_size).alias("slot_size"), "s.used_bytes", F.lit(slot_size // 2 - 1 if wide else slot_size - 1).alias("capacity"), F.lit("utf16-code-units" if wide else "bytes").alias("capacity_unit"),
        "s.text", F.regexp_extract_all("s.text", F.lit(MARKER), F.lit(0)).alias("control_markers"), F.sha2("raw", 256).alias("raw_sha256"), (F.size("s.errors") == 0).alias("valid"), "s.errors",
    )


def scan_summary(files: DataFrame, slots: DataFrame, offset: int, slot_size: int, count: int) -> DataFrame:
    """``(path, status, file_sha256, file_size, invalid_slots, errors)`` of every file."""
    bad = slots.groupBy("path").agg(F.count_if(~F.col("valid")).alias("invalid_slots"))
    own = files.select("path", F.sha2("content", 256).alias("file_sha256"), F.length("content").alias("file_size"), layout_errors(F.col("content"), offset, slot_size, count).alias("errors"))
    out = own.join(bad, "path", "left").withColumn("invalid_slots", F.coalesce("invalid_slots", F.lit(0)))
    ok = (F.size("errors") == 0) & (F.col("invalid_slots") == 0)
    return out.select("path", F.when(ok, "PASS").otherwise("FAIL").alias("status"), "file_sha256", "file_size", "invalid_slots", "errors")


def compare(original: DataFrame, rebuilt: DataFrame, offset: int, slot_size: int, count: int, encoding: str) -> DataFrame:
    """``(path, id, slot)`` of every failure between two builds of the files, joined by path and slot.

    Bytes outside the region are compared as hashes of both ends; slots pair by index as far as both have them.
    """
    before, after = scan(original, offset, slot_size, count, encoding), scan(rebuilt, offset, slot_size, count, encoding)
    end = offset + slot_size * count

    @F.pandas_udf("string")
    def outside(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: hashlib.sha256(bytes(c)[:offset] + b"|" + bytes(c)[end:]).hexdigest())

    facts = lambda df, slots, n: scan_summary(df, slots, offset, slot_size, count).join(df.select("path", outside("content").alias("outside")), "path").select("path", F.struct("status", "file_size", "outside").alias(n))
    files = facts(original, before, "a").join(facts(rebuilt, after, "b"), "path")
    whole = (F.col("a.file_size") >= end) & (F.col("b.file_size") >= end)
    checks = F.array_compact(
        F.array(
            F.when(F.col("a.file_size") != F.col("b.file_size"), "file-size-changed"),
            F.when(F.col("a.status") != "PASS", "original-layout-invalid"),
            F.when(F.col("b.status") != "PASS", "rebuilt-layout-invalid"),
            F.when(whole & (F.col("a.outside") != F.col("b.outside")), "outside-slot-region-changed"),
        )
    )
    by_file = files.select("path", F.explode(checks).alias("id"), F.lit(None).cast("int").alias("slot"))
    pairs = before.alias("a").join(after.alias("b"), ["path", "index"])
    markers = pairs.where("a.control_markers <> b.control_markers").select("path", F.lit("control-marker-sequence-changed").alias("id"), F.col("index").alias("slot"))
    return by_file.unionByName(markers)


def changed(original: DataFrame, rebuilt: DataFrame, offset: int, slot_size: int, count: int, encoding: str) -> DataFrame:
    """``(path, index)`` of the slots whose bytes differ."""
    before, after = scan(original, offset, slot_size, count, encoding), scan(rebuilt, offset, slot_size, count, encoding)
    return before.alias("a").join(after.alias("b"), ["path", "index"]).where("a.raw_sha256 <> b.raw_sha256").select("path", "index")
