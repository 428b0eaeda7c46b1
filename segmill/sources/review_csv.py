"""Review tables in CSV: strict quoting, and the physical line on which every record begins."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from segmill.operators.delimited import assemble, assembled
from segmill.sources import lines

REQUIRED = ("current_sha256", "segment_id", "reviewed_target")


class ReviewCsv(DataSource):
    """``spark.read.format("review_csv").load(path)``: ``line_no`` and the columns of the header, as texts.

    UTF-8 with or without a byte order mark. The header must be unique and hold the required columns;
    blank physical lines between records are skipped; a record with other than the header's number of
    cells, or broken quoting, fails and names its line. One file is one task, which streams it; :func:`read`
    splits a file.
    """

    @classmethod
    def name(cls) -> str:
        return "review_csv"

    def schema(self) -> StructType:
        return StructType([StructField("line_no", IntegerType()), StructField("cells", ArrayType(StringType())), StructField("header", ArrayType(StringType()))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReviewCsvReader(self.options["path"])


class ReviewCsvReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8-sig", newline="") as file:
            yield from numbered(file)


def checked_header(cells: list[str]) -> list[str]:
    if len(set(cells)) < len(cells):
        raise ValueError("duplicate CSV column names")
    if not set(REQUIRED) <= set(cells):
        raise ValueError("missing required review CSV columns")
    return cells


def parsed(line: int, record: str, width: int) -> list[str]:
    """The cells of one record, none for a blank line; a malformed one fails by its line."""
    try:
        rows = list(csv.reader(io.StringIO(record, newline=""), strict=True))
    except csv.Error as error:
        raise ValueError(f"CSV row {line}: {error}") from error
    cells = next((r for r in rows if r), [])
    if cells and len(cells) != width:
        raise ValueError(f"CSV row {line}: malformed CSV row: missing or extra cells")
    return cells


def numbered(text: str | Iterable[str]) -> Iterator[tuple[int, list[str], list[str]]]:
    """``(line, cells, header)`` of all records of a CSV text or of its lines; raises on the first that is malformed."""
    header: list[str] | None = None
    for line, record in assemble(io.StringIO(text, newline="") if isinstance(text, str) else text):
        try:
            rows = list(csv.reader(io.StringIO(record, newline=""), strict=True))
        except csv.Error as error:
            raise ValueError(f"CSV row {line}: {error}") from error
        if header is None:
            header = checked_header(rows[0] if rows else [])
            continue
        for cells in rows:
            if not cells:
                continue
            if len(cells) != len(header):
                raise ValueError(f"CSV row {line}: malformed CSV row: missing or extra cells")
            yield line, cells, header
    if header is None:
        raise ValueError("missing required review CSV columns")


def head(path: str) -> tuple[list[str], int]:
    """``(header, number of its last line)``: only the first record of the file is read."""
    with open(path.removeprefix("file://"), encoding="utf-8-sig", newline="") as file:
        for _, record in assemble(file):
            rows = list(csv.reader(io.StringIO(record, newline=""), strict=True))
            return checked_header(rows[0] if rows else []), max(1, record.count("\n"))
    raise ValueError("missing required review CSV columns")


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The review rows of a file: ``line_no`` and the named columns, NULL where the header lacks one.

    The file is read in splits: numbered lines are assembled quote-aware (:func:`delimited.assembled`), and each
    record goes through the strict reader in ``mapInArrow``; a malformed one fails the query and names its line. Records end
    with LF or CRLF; line breaks inside quotes stay as they are.
    """
    header, last = head(path)
    width, at = len(header), [header.index(c) if c in header else None for c in columns]
    records = assembled(lines.numbered(spark, path, line_sep="\n"), "file").where(F.col("first_line") > last)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, parsed(n, r, width)) for n, r in zip(batch.column("first_line").to_pylist(), batch.column("record").to_pylist(), strict=True)]
            rows = [(n, cells) for n, cells in rows if cells]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in rows], pa.int32()), *(pa.array([None if k is None else cells[k] for _, cells in rows], pa.string()) for k in at)], names=["line_no", *columns]
            )

    return records.select("first_line", "record").mapInArrow(parse, StructType([StructField("line_no", IntegerType()), *(StructField(c, StringType()) for c in columns)]))
