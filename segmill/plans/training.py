"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.operators import delimited, reconcile
from segmill.session import BLANK, table
from segmill.sources import catalog


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.rejected(table(spark, sf_dir, "review_raw"))


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.loaded(table(spark, sf_dir, "review_raw"))


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = delimited.load_records(table(spark, sf_dir, "review_raw"), keep=("raw_id", "file_name"))
    return records.groupBy("file_name").agg(
        F.count("*").alias("records"), F.count("reject_reason").alias("rejected"), F.count_if(F.col("reject_reason") == "quoting").alias("quoting")
    )


def p1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's records as physical lines, in order of delivery, assembled again: where each begins, and why it fails."""
    raw = table(spark, sf_dir, "review_raw").select("file_name", "record_no", "raw_id", F.posexplode(F.split("raw_record", "\n")).alias("at", "line"))
    numbered = catalog.dense(raw, ["file_name", "record_no", "raw_id", "at"], "line_no")
    records = delimited.assembled(numbered)
    judged = delimited.load_records(records, "record", keep=("file_name", "first_line", "last_line", "closed"))
    return judged.select("file_name", "first_line", "last_line", F.when(~F.col("closed"), "quoting").otherwise(F.col("reject_reason")).alias("reason"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.differences(table(spark, sf_dir, "seg_current"), table(spark, sf_dir, "seg_previous"))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("diff").agg(F.count("*").alias("segments"))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_reasons": p1_reasons, "p1_lines": p1_lines, "p3_found": p3_found, "p3_totals": p3_totals}

_FIELD = r'("([^"]|"")*"|[^",\r\n]*)'
_SPLIT = f"""
WITH shaped AS (
  SELECT raw_id, file_name, raw_record, regexp_full_match(raw_record, '{_FIELD}(,{_FIELD})*') AS well
  FROM review_raw),
split AS (
  SELECT raw_id, file_name, well,
         CASE WHEN well THEN list_transform(regexp_extract_all(',' || raw_record, ',{_FIELD}', 1),
              lambda c: CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) END AS f
  FROM shaped),
judged AS (
  SELECT *, CASE
    WHEN well IS NULL THEN 'column_count'
    WHEN NOT well THEN 'quoting'
    WHEN len(f) <> 12 THEN 'column_count'
    WHEN NOT regexp_full_match(f[1], '[0-9a-f]{{64}}') THEN 'bad_current_sha256'
    WHEN NOT regexp_full_match(f[2], 'v[0-9]{{2}}/sc[0-9]{{4}}:[1-9][0-9]*') THEN 'bad_segment_id'
    WHEN regexp_matches(f[11], '[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x{{9f}}\\x{{fffd}}]') THEN 'bad_reviewed_target' END AS reason
  FROM split)
"""
_LINES = """
WITH l0 AS (SELECT file_name, record_no, raw_id, unnest(string_split(raw_record, chr(10))) AS line, generate_subscripts(string_split(raw_record, chr(10)), 1) AS place FROM review_raw),
l AS (SELECT file_name, row_number() OVER (ORDER BY file_name, record_no, raw_id, place) - 1 AS line_no, line, length(line) - length(replace(line, '"', '')) AS q FROM l0),
b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY file_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS begins, sum(q) OVER (PARTITION BY file_name) % 2 = 1 AS odd FROM l),
g AS (SELECT *, max(line_no) FILTER (WHERE begins) OVER (PARTITION BY file_name ORDER BY line_no) AS head, max(line_no) FILTER (WHERE begins) OVER (PARTITION BY file_name) AS final FROM b),
r AS (SELECT file_name, CASE WHEN odd AND head = final THEN line_no ELSE head END AS first_line, max(line_no) AS last_line, bool_and(NOT (odd AND head = final)) AS closed, string_agg(line, chr(10) ORDER BY line_no) AS raw_record FROM g GROUP BY 1, 2),
review_raw AS (SELECT * FROM r), """
_LOADED = ", ".join(f"f[{i}] AS {c}" for i, c in enumerate(delimited.REVIEW_COLUMNS, 1))

_STRIP = "".join(f"\\x{{{ord(c):x}}}" for c in BLANK)
_DIFF = f"""
WITH c0 AS (SELECT lower(regexp_replace(coalesce(segment_id, ''), '^[{_STRIP}]+|[{_STRIP}]+$', '', 'g')) AS k, * FROM seg_current),
     p0 AS (SELECT lower(regexp_replace(coalesce(segment_id, ''), '^[{_STRIP}]+|[{_STRIP}]+$', '', 'g')) AS k, * FROM seg_previous),
     c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, row_id DESC) = 1),
     p AS (SELECT * FROM p0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, row_id DESC) = 1),
     found AS (
  SELECT k AS segment_id, 'only_current' AS diff FROM c WHERE k NOT IN (SELECT k FROM p)
  UNION ALL SELECT k, 'only_previous' FROM p WHERE k NOT IN (SELECT k FROM c)
""" + "".join(
    f"  UNION ALL SELECT c.k, '{f}' FROM c JOIN p ON c.k = p.k WHERE coalesce(c.{f}, '') <> coalesce(p.{f}, '')\n"
    for f in ("source", "target", "speaker", "context", "source_path")
) + ")\n"

ORACLES = {
    "p1_found": _SPLIT + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_loaded": _SPLIT + f"SELECT raw_id, {_LOADED} FROM judged WHERE reason IS NULL",
    "p1_reasons": _SPLIT + "SELECT file_name, count(*) AS records, count(reason) AS rejected, count(*) FILTER (WHERE reason = 'quoting') AS quoting FROM judged GROUP BY file_name",
    "p1_lines": _LINES + _SPLIT.replace("WITH shaped", "shaped", 1).replace("raw_id, file_name,", "file_name, first_line, last_line, closed,") + "SELECT file_name, first_line, last_line, CASE WHEN NOT closed THEN 'quoting' ELSE reason END AS reason FROM judged",
    "p3_found": _DIFF + "SELECT segment_id, diff FROM found",
    "p3_totals": _DIFF + "SELECT diff, count(*) AS segments FROM found GROUP BY diff",
}
