"""Lines of text files with their numbers, read in splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, keep: Callable[[Column], Column] | None = None, line_sep: str | None = None) -> DataFrame:
    """``(file, line_no, line)`` of UTF-8 files, ``line_no`` from 1 in every file; with ``keep`` also ``kept_idx``.

    Files are read by the splittable text reader: a line's number is its place in its split, behind the lines of
    the splits before, which are counted first (one row per split). ``keep`` makes a condition of a line; lines
    that fail it are counted but left out, and ``kept_idx`` numbers the others from 0 over all files in the order of
    their names. Lines end with LF, CRLF or CR, or with ``line_sep`` alone. A byte order mark isn't part of the first line.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    scan = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"))
    per, bare = ["file", "split"], F.regexp_replace("value", "^\\ufeff", "")
    held = F.lit(False) if keep is None else keep(bare)
    counts = scan.groupBy(*per).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.count_if(held).alias("kept"))
    in_file, in_all = (w.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for w, o in ((Window.partitionBy("file"), ["split"]), (Window, per)))
    begins = counts.select(*per, "first", F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("lines"), *([] if keep is None else [F.coalesce(F.sum("kept").over(in_all), F.lit(0)).alias("before")]))
    number = F.col("lines") + F.col("seq") - F.col("first") + 1
    line = F.when((F.col("split") == 0) & (F.col("seq") == F.col("first")), bare).otherwise(F.col("value"))
    if keep is None:
        return scan.join(begins, per).select("file", number.alias("line_no"), line.alias("line"))
    # a second number above the filter counts what is kept; neither filter nor join passes below a number
    kept = scan.where(held).withColumn("kept_seq", F.monotonically_increasing_id())
    begins = begins.join(kept.groupBy(*per).agg(F.min("kept_seq").alias("kept_first")), per)
    return kept.join(begins, per).select("file", number.alias("line_no"), line.alias("line"), (F.col("before") + F.col("kept_seq") - F.col("kept_first")).alias("kept_idx"))
