"""Delimited records that may not parse: assemble, parse strictly, keep the reason of each failure.

Three stages, each of which may end a record with a reason:

1. physical lines are assembled into records, quote-aware (:func:`assemble` inside a delivered record,
   :func:`assembled` over the lines of whole files);
2. each record goes through the strict ``csv`` reader, in ``mapInArrow``; its exception becomes the reason, before any
   typed constructor sees the fields (:func:`parse_record`);
3. the fields' own constructors run in order, and the first that refuses its value gives the reason.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_COLUMNS = (
    "current_sha256", "segment_id", "decision", "reason", "similarity", "previous_catalog",
    "previous_segment_id", "previous_source", "suggested_target", "placeholder_compatible",
    "reviewed_target", "reviewer_notes",
)

_SHA256 = re.compile(r"[0-9a-f]{64}\Z")
_SEGMENT = re.compile(r"v[0-9]{2}/sc[0-9]{4}:[1-9][0-9]*\Z")
_UNPRINTABLE = re.compile("[\x00-\x09\x0b-\x1f\x7f-\x9f�]")

class Sha256(str):
    """64 lower-case hexadecimal digits."""

    def __new__(cls, value: str):
        if not _SHA256.match(value):
            raise ValueError("not a sha256")
        return super().__new__(cls, value)


class SegmentId(str):
    """Volume, scene and a positive line number."""

    def __new__(cls, value: str):
        if not _SEGMENT.match(value):
            raise ValueError("not a segment id")
        return super().__new__(cls, value)


class PrintableText(str):
    """Any text, also the empty one, without control characters (but line feeds) and broken characters."""

    def __new__(cls, value: str):
        if _UNPRINTABLE.search(value):
            raise ValueError("not printable")
        return super().__new__(cls, value)


#: Reason, column, and the constructor that raises ``ValueError`` for a value it refuses.
Rule = tuple[str, int, Callable[[str], object]]

#: Constructors of the fields of review records in order of precedence.
REVIEW_RULES: tuple[Rule, ...] = (
    ("bad_current_sha256", REVIEW_COLUMNS.index("current_sha256"), Sha256),
    ("bad_segment_id", REVIEW_COLUMNS.index("segment_id"), SegmentId),
    ("bad_reviewed_target", REVIEW_COLUMNS.index("reviewed_target"), PrintableText),
)


def assemble(lines: Iterable[str]) -> Iterator[tuple[int, str]]:
    """Join physical lines into records: ``(number of the first line, record)``.

    A line that leaves a quote open goes on in the next one. An open quote at the end of the input yields
    the rest as one record, which then fails as ``quoting``.
    """
    held: list[str] = []
    first, quotes = 1, 0
    for number, line in enumerate(lines, 1):
        if not held:
            first = number
        held.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            yield first, "".join(held)
            held, quotes = [], 0
    if held:
        yield first, "".join(held)


def strict_fields(body: str) -> list[str]:
    """The fields of one record by the strict ``csv`` reader; raises ``csv.Error`` where it isn't well-formed.

    The reader refuses open quotes, text behind a closing quote and line breaks outside quotes. What it lets pass is a quote
    inside an unquoted field and line breaks at the end: a walk along the record by the fields it found tells them.
    """
    rows = list(csv.reader((body,), strict=True)) if body else []
    if len(rows) != 1:
        if body:
            raise csv.Error("not one record")
        return []
    at = 0
    for field in rows[0]:
        if body.startswith('"', at):
            at += len(field) + field.count('"') + 3
        else:
            if '"' in field:
                raise csv.Error("quote inside an unquoted field")
            at += len(field) + 1
    if at != len(body) + 1:
        raise csv.Error("line break outside quotes")
    return rows[0]


def parse_record(record: str | None, width: int, rules: Sequence[Rule]) -> tuple[str | None, list[str] | None]:
    """``(reason, fields)`` of one delivered record; exactly one of the two is None.

    None (nothing delivered) and an empty record have not the right number of columns. A record that
    assembles into several ones holds a line break outside quotes; the reader fails on it as ``quoting``. One record
    terminator at the end is not part of the record.
    """
    if record is None:
        return "column_count", None
    body = record[:-2] if record.endswith("\r\n") else record[:-1] if record.endswith(("\n", "\r")) else record
    try:
        fields = strict_fields(body)
    except csv.Error:
        return "quoting", None
    if len(fields) != width:
        return "column_count", None
    for reason, at, construct in rules:
        try:
            construct(fields[at])
        except ValueError:
            return reason, None
    return None, fields


#: Lines of one block of a file; blocks are numbered and their quotes counted, so that each knows whether it begins inside quotes.
BLOCK_LINES = 8192


def assembled(lines: DataFrame, file: str = "file_name", at: str = "line_no", text: str = "line", block: int = BLOCK_LINES) -> DataFrame:
    """``(file, first_line, last_line, record, closed)`` of the lines of files, quote-aware, in pieces.

    ``lines`` is ``(file, line number from 1, text without its break)``. Whether a line begins inside quotes is the parity of
    all quotes before it in its file: blocks of lines are counted first, and only the counts are summed up
    along a file, so a file with any part of all rows is many tasks. A line that begins outside quotes begins a
    record. A quote that stays open to the end of its file would take the rest of it into one record; such
    a rest is not gathered: each of its lines is a row of its own with ``closed`` false. NULL lines are empty.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    own = lines.select(F.col(file).alias("file_name"), F.col(at).cast("long").alias("line_no"), F.coalesce(F.col(text), F.lit("")).alias("line"))
    own = own.withColumns({"quotes": quotes.cast("long"), "block": F.floor((F.col("line_no") - 1) / block).cast("long")})
    earlier = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_name")
    blocks = own.groupBy("file_name", "block").agg(F.sum("quotes").alias("n"))  # one row per block
    blocks = blocks.select("file_name", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), (F.sum("n").over(whole) % 2 == 1).alias("odd"))
    inside = Window.partitionBy("file_name", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    begun = own.join(*_per_block(blocks)).select("file_name", "block", "line_no", "line", "odd", ((F.col("before") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))) % 2 == 0).alias("begins"))
    # the line that begins a line's record: the last one up to it in its block, else the last one of the blocks before
    last = begun.groupBy("file_name", "block").agg(F.max(F.when(F.col("begins"), F.col("line_no"))).alias("last"))
    open_since = last.select("file_name", "block", F.max("last").over(earlier).alias("carried"), F.max("last").over(whole).alias("final"))
    up_to = Window.partitionBy("file_name", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = begun.withColumn("mine", F.max(F.when(F.col("begins"), F.col("line_no"))).over(up_to)).join(*_per_block(open_since))
    first = F.coalesce("mine", "carried")
    rest = F.col("odd") & (first == F.col("final"))  # the quotes of the last record never close
    placed = placed.select("file_name", F.when(rest, F.col("line_no")).otherwise(first).alias("first_line"), "line_no", "line", (~rest).alias("closed"))
    joined = placed.groupBy("file_name", "first_line").agg(F.max("line_no").alias("last_line"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("parts"), F.bool_and("closed").alias("closed"))
    return joined.select("file_name", "first_line", "last_line", F.array_join("parts.line", "\n").alias("record"), "closed")


def _per_block(facts: DataFrame) -> tuple:
    """Facts of blocks and the condition that joins them to lines; NULL is a file name like others."""
    return facts.withColumnsRenamed({"file_name": "__f", "block": "__b"}), F.col("file_name").eqNullSafe(F.col("__f")) & (F.col("block") == F.col("__b"))


def load_records(
    df: DataFrame,
    record_col: str = "raw_record",
    columns: Sequence[str] = REVIEW_COLUMNS,
    rules: Sequence[Rule] = REVIEW_RULES,
    keep: Sequence[str] = ("raw_id",),
) -> DataFrame:
    """Parse ``record_col`` of every row: ``keep`` columns, ``reject_reason`` (NULL when loaded) and ``columns``.

    One narrow pass without a shuffle; the plan carries only ``keep`` and the record, so further columns
    of the input, whatever their names, take no part. Every input row gives exactly one output row:
    repeated rows stay repeated, an empty table gives an empty one, very long records are parsed whole.
    """
    clash = {*columns, "reject_reason"} & {*keep}
    if clash:
        raise ValueError(f"kept columns clash with parsed ones: {sorted(clash)}")
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField("reject_reason", T.StringType())] + [T.StructField(c, T.StringType()) for c in columns]
    )
    width, rules = len(columns), tuple(rules)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)  # the module's own limit would fail long texts
        for batch in batches:
            records = batch.column(batch.num_columns - 1).to_pylist()
            reasons: list[str | None] = []
            cells: list[list[str | None]] = [[] for _ in range(width)]
            for record in records:
                reason, fields = parse_record(record, width, rules)
                reasons.append(reason)
                for i in range(width):
                    cells[i].append(fields[i] if fields else None)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(reasons, pa.string()), *(pa.array(c, pa.string()) for c in cells)],
                names=[*keep, "reject_reason", *columns],
            )

    return df.select(*keep, F.col(record_col).alias("__record")).mapInArrow(parse, schema)


def rejected(df: DataFrame, **options) -> DataFrame:
    """The rows that can't be loaded with their first reason: ``keep`` columns and ``reason``."""
    keep = options.get("keep", ("raw_id",))
    return load_records(df, **options).where("reject_reason IS NOT NULL").select(*keep, F.col("reject_reason").alias("reason"))


def loaded(df: DataFrame, **options) -> DataFrame:
    """The loadable rows: ``keep`` columns and the parsed ones."""
    return load_records(df, **options).where("reject_reason IS NULL").drop("reject_reason")
