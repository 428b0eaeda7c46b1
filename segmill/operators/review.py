"""Import of human decisions: validate every review row, then put the reviewed targets into the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.functions import codecs
from segmill.functions import text as T
from segmill.operators.memory import with_ids


def judged(catalog: DataFrame, rows: DataFrame, expected_sha256: str, encoding: str | None = None) -> DataFrame:
    """``(line_no, segment_id, reviewed_target, error)`` of every review row, ``error`` NULL where it holds.

    ``catalog`` is ``(row_idx, segment_id, source, target)``, ``rows`` is ``(line_no, current_sha256,
    segment_id, reviewed_target)``. The first failing test counts: catalog hash; id unknown or seen in an
    earlier row (blank rows count as seen; of a catalog id that is repeated the first record counts); then, unless the target is blank, control tokens, a different
    existing target, the encoding of the whole target. Messages hold no translated text.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    first = with_ids(catalog).groupBy("segment_id").agg(F.min_by(F.struct(text("source"), text("target")), "row_idx").alias("c"))
    own = first.select("segment_id", "c.source", "c.target", F.lit(True).alias("known"))
    earliest = rows.groupBy("segment_id").agg(F.min("line_no").alias("first_line"))
    joined = rows.join(earliest, "segment_id", "left").join(own, "segment_id", "left")
    target = F.coalesce(F.col("reviewed_target"), F.lit(""))
    prefix = F.concat(F.lit("CSV row "), F.col("line_no"), F.lit(": "))
    blank = T.is_blank(target)
    if encoding:
        joined = joined.withColumn("fits", codecs.encodes(target, encoding))
    error = (
        F.when(~F.col("current_sha256").eqNullSafe(F.lit(expected_sha256)), "review CSV belongs to a different current catalog")
        .when(F.col("known").isNull() | (F.col("line_no") > F.col("first_line")), "unknown or duplicate review segment ID")
        .when(blank, None)
        .when(~T.tokens_agree(F.col("source"), target), F.concat(F.lit("placeholder mismatch: "), "segment_id"))
        .when((F.col("target") != "") & (F.col("target") != target), F.concat(F.lit("existing translation differs: "), "segment_id"))
    )
    if encoding:
        error = error.when(~F.col("fits"), F.lit(f"target cannot be encoded as {encoding}"))
    return joined.select("line_no", "segment_id", "reviewed_target", F.concat(prefix, error).alias("error"))


def apply(catalog: DataFrame, rows: DataFrame, expected_sha256: str, encoding: str | None = None) -> DataFrame:
    """The catalog with the reviewed targets; raises the error of the first failing row, if any fails.

    Blank targets stay pending. Every column of the catalog is kept. Repeated catalog ids are an error.
    """
    if with_ids(catalog).groupBy("segment_id").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate segment ID in catalog")
    checked = judged(catalog, rows, expected_sha256, encoding)
    first = checked.agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("e")).first().e
    if first:
        raise ValueError(first)
    ready = checked.where(~T.is_blank(F.col("reviewed_target"))).select(F.col("segment_id").alias("__id"), F.col("reviewed_target").alias("__new"))
    named = with_ids(catalog).select("row_idx", F.col("segment_id").alias("__id")).join(ready, "__id").select("row_idx", "__new")
    return catalog.join(named, "row_idx", "left").withColumn("target", F.coalesce("__new", "target")).select(*catalog.columns)


def summary(checked: DataFrame, catalog_records: int, current_sha256: str, review_sha256: str, dry_run: bool) -> DataFrame:
    """One row: ``dry_run, applied, ready, pending, failed, review_rows, catalog_records`` and both hashes."""
    blank = T.is_blank(F.col("reviewed_target"))
    own = checked.agg(F.count_if(F.col("error").isNull() & ~blank).alias("ready"), F.count_if(F.col("error").isNull() & blank).alias("pending"), F.count("error").alias("failed"), F.count("*").alias("review_rows"))
    return own.select(
        F.lit(dry_run).alias("dry_run"), F.when(F.lit(dry_run) | (F.col("failed") > 0), F.lit(0).cast("long")).otherwise(F.col("ready")).alias("applied"), "ready", "pending", "failed", "review_rows",
        F.lit(catalog_records).cast("long").alias("catalog_records"), F.lit(current_sha256).alias("current_sha256"), F.lit(review_sha256).alias("review_sha256"),
    )
