"""Queries of the translation memory and the import of decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.operators import memory, review
from segmill.plans import sql
from segmill.session import table

_HASH = "c40ffd4b1da7805cbba7f81a2f97c3ef3aa9d1455588357845a94165683a9c23"


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All current records, each its own segment by its row; records of the second feed await translation."""
    rows = table(spark, sf_dir, "seg_current").where("source <> ''")
    return rows.select(F.col("row_id").alias("row_idx"), F.concat("segment_id", F.lit("#"), "row_id").alias("segment_id"), "source", F.when(F.col("feed") == "birch", "").otherwise(F.coalesce("target", F.lit(""))).alias("target"))


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogs of history: the other system's copy and the loaded reviews' suggestions."""
    a = table(spark, sf_dir, "seg_previous").select("row_id", F.concat(F.lower(F.trim("segment_id")), F.lit("#"), (F.col("row_id") - 2_000_000_000).cast("string")).alias("segment_id"), "source", "target", F.lit("previous").alias("origin"))
    b = table(spark, sf_dir, "review_rows").select("row_id", F.col("previous_segment_id").alias("segment_id"), F.col("previous_source").alias("source"), F.col("suggested_target").alias("target"), F.lit("reviews").alias("origin"))
    return a.unionByName(b).withColumnRenamed("row_id", "row_idx")


def memory_decisions(spark, sf_dir):
    """Decisions of the exact steps."""
    own = memory.decisions(current(spark, sf_dir), previous(spark, sf_dir), threshold=None)
    return own.select("row_idx", "decision", "reason", F.array_join("previous_catalogs", " | ").alias("catalogs"), "previous_rows", "new_target", F.col("warning").isNotNull().alias("warned"))


def memory_summary(spark, sf_dir):
    """Counters of the exact steps, as its SQL has them (no threshold, no suggestions); see :func:`memory_summary_similar`."""
    past = previous(spark, sf_dir)
    return memory.summary(memory.decisions(current(spark, sf_dir), past, threshold=None), past.count(), None)


def memory_similar(spark, sf_dir):
    """Decisions of all steps; the similarity has no SQL form (see the brute-force test)."""
    own = memory.decisions(current(spark, sf_dir), previous(spark, sf_dir))
    return own.select("row_idx", "segment_id", "decision", "similarity", "previous_segment_id", "previous_source", "suggested_target", "placeholder_compatible", "previous_catalog")


def memory_merged(spark, sf_dir):
    now = current(spark, sf_dir)
    return memory.merged(now, memory.decisions(now, previous(spark, sf_dir), threshold=None))


def memory_summary_similar(spark, sf_dir):
    """Counters of all steps; the similarity has no SQL form (see the brute-force test)."""
    past = previous(spark, sf_dir)
    return memory.summary(memory.decisions(current(spark, sf_dir), past), past.count())


def memory_review_queue(spark, sf_dir):
    """Queue of the exact steps, as its SQL has it (no suggestions); see :func:`memory_review_queue_similar`."""
    own = memory.decisions(current(spark, sf_dir), previous(spark, sf_dir), threshold=None)
    return memory.review_queue(own, _HASH).select("current_sha256", "segment_id", "decision", "reason", "previous_catalog", "reviewed_target")


def memory_review_queue_similar(spark, sf_dir):
    """Queue of all steps with all its columns; the similarity has no SQL form (see the brute-force test)."""
    return memory.review_queue(memory.decisions(current(spark, sf_dir), previous(spark, sf_dir)), _HASH)


def _catalog(spark, sf_dir):
    """The newest record of every segment."""
    rows = table(spark, sf_dir, "seg_current")
    best = rows.groupBy("segment_id").agg(F.max(F.struct("updated_at", "row_id", "source", "target")).alias("b"))
    return best.select(F.col("b.row_id").alias("row_idx"), "segment_id", F.col("b.source").alias("source"), F.col("b.target").alias("target"))


def _reviews(spark, sf_dir):
    return table(spark, sf_dir, "review_rows").select(F.col("row_id").alias("line_no"), "current_sha256", "segment_id", "reviewed_target")


def review_judged(spark, sf_dir):
    own = review.judged(_catalog(spark, sf_dir), _reviews(spark, sf_dir), _HASH)
    return own.select("line_no", "segment_id", "error")


def review_summary(spark, sf_dir):
    own = review.judged(_catalog(spark, sf_dir), _reviews(spark, sf_dir), _HASH)
    return review.summary(own, _catalog(spark, sf_dir).count(), _HASH, _HASH, True)


def review_judged_gbk(spark, sf_dir):
    """With the target encoding; its SQL has the codec's table as a character class."""
    return review.judged(_catalog(spark, sf_dir), _reviews(spark, sf_dir), _HASH, "gbk").select("line_no", "segment_id", "error")


QUERIES = {
    "memory_decisions": memory_decisions, "memory_summary": memory_summary, "memory_similar": memory_similar, "memory_merged": memory_merged, "memory_review_queue": memory_review_queue,
    "memory_summary_similar": memory_summary_similar, "memory_review_queue_similar": memory_review_queue_similar,
    "review_judged": review_judged, "review_summary": review_summary, "review_judged_gbk": review_judged_gbk,
}

_MEMORY = f"""
WITH cur AS (SELECT row_id AS row_idx, segment_id || '#' || row_id AS segment_id, source AS s, CASE WHEN feed = 'birch' THEN '' ELSE coalesce(target, '') END AS t FROM seg_current WHERE source <> ''),
prev AS (SELECT lower(trim(segment_id)) || '#' || (row_id - 2000000000) AS segment_id, row_id, source AS s, target AS t, 'previous' AS origin FROM seg_previous
  UNION ALL SELECT previous_segment_id, row_id, previous_source, suggested_target, 'reviews' FROM review_rows),
good AS (SELECT coalesce(nullif(segment_id, ''), '#index:' || (row_id + 1)) AS segment_id, s, t, origin FROM prev WHERE t <> '' AND s <> '' AND t <> s),
i AS (SELECT segment_id, s, min(t) AS lo, max(t) AS hi, count(*) AS n, array_to_string(list_sort(list(DISTINCT origin)), ' | ') AS o FROM good GROUP BY 1, 2),
e AS (SELECT s, min(t) AS lo, max(t) AS hi, count(*) AS n, array_to_string(list_sort(list(DISTINCT origin)), ' | ') AS o FROM good GROUP BY 1),
d AS (SELECT c.*, i.lo AS ilo, i.n AS i_n, i.o AS io, e.lo AS elo, e.n AS e_n, e.o AS eo,
  CASE WHEN i.lo IS NULL THEN NULL WHEN i.lo <> i.hi THEN 'c' WHEN NOT {sql.agree('c.s', 'i.lo')} THEN 'p' ELSE 'ok' END AS by_id,
  CASE WHEN e.lo IS NULL THEN NULL WHEN e.lo <> e.hi THEN 'c' WHEN NOT {sql.agree('c.s', 'e.lo')} THEN 'p' ELSE 'ok' END AS by_src
  FROM cur c LEFT JOIN i ON c.segment_id = i.segment_id AND c.s = i.s LEFT JOIN e ON c.s = e.s),
r AS (SELECT *, CASE WHEN t <> '' THEN 'kept-current' WHEN by_id = 'ok' THEN 'reused-exact-id' WHEN by_id IS NOT NULL THEN 'conflict' WHEN by_src = 'ok' THEN 'reused-exact-source'
  WHEN by_src IS NOT NULL THEN 'conflict' ELSE 'pending' END AS decision FROM d),
x AS (SELECT row_idx, segment_id, s AS source, decision, CASE WHEN decision = 'conflict' THEN CASE coalesce(by_id, by_src) WHEN 'c' THEN '{memory.NO_AGREEMENT}' ELSE '{memory.BROKEN_TOKENS}' END END AS reason,
  CASE decision WHEN 'reused-exact-id' THEN io WHEN 'reused-exact-source' THEN eo END AS catalogs, CASE decision WHEN 'reused-exact-id' THEN i_n WHEN 'reused-exact-source' THEN e_n END AS previous_rows,
  CASE decision WHEN 'kept-current' THEN t WHEN 'reused-exact-id' THEN ilo WHEN 'reused-exact-source' THEN elo ELSE '' END AS new_target,
  decision = 'kept-current' AND NOT {sql.agree('s', 't')} AS warned FROM r)
"""
_N = lambda d: f"count(*) FILTER (WHERE decision = '{d}')"
_JUDGED = lambda last="": f"""
WITH c AS (SELECT * FROM seg_current QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY updated_at DESC NULLS LAST, row_id DESC) = 1),
j AS (SELECT r.row_id AS line_no, r.segment_id, coalesce(r.reviewed_target, '') AS n, r.current_sha256 AS h, min(r.row_id) OVER (PARTITION BY r.segment_id) AS f, c.row_id AS known, coalesce(c.source, '') AS s, coalesce(c.target, '') AS t
  FROM review_rows r LEFT JOIN c ON r.segment_id = c.segment_id),
x AS (SELECT *, 'CSV row ' || line_no || ': ' || CASE WHEN h IS NULL OR h <> '{_HASH}' THEN 'review CSV belongs to a different current catalog'
  WHEN known IS NULL OR line_no > f THEN 'unknown or duplicate review segment ID' WHEN {sql.strip('n')} = '' THEN NULL
  WHEN NOT {sql.agree('s', 'n')} THEN 'placeholder mismatch: ' || segment_id WHEN t <> '' AND t <> n THEN 'existing translation differs: ' || segment_id {last} END AS error FROM j)
"""  # noqa: E731
_REVIEW = _JUDGED()
ORACLES = {
    "memory_decisions": _MEMORY + "SELECT row_idx, decision, reason, catalogs, previous_rows, new_target, warned FROM x",
    "memory_summary": _MEMORY
    + f"""SELECT CASE WHEN {_N('conflict')} = 0 THEN 'PASS' ELSE 'REVIEW' END AS status, count(*) AS current_records, (SELECT count(*) FROM prev) AS previous_records, {_N('kept-current')} AS kept_current,
 {_N('reused-exact-id')} AS reused_by_id, {_N('reused-exact-source')} AS reused_by_source, 0::BIGINT AS suggestions, {_N('conflict')} AS conflicts, count(*) FILTER (WHERE decision IN ('conflict', 'pending')) AS pending, NULL::DOUBLE AS fuzzy_threshold FROM x""",
    "memory_merged": _MEMORY + "SELECT row_idx, segment_id, source, new_target AS target FROM x",
    "memory_review_queue": _MEMORY + f"SELECT '{_HASH}' AS current_sha256, segment_id, decision, coalesce(reason, '') AS reason, '' AS previous_catalog, '' AS reviewed_target FROM x WHERE decision IN ('conflict', 'pending')",
    "review_judged": _REVIEW + "SELECT line_no, segment_id, error FROM x",
    "review_judged_gbk": _JUDGED(f"WHEN regexp_matches(n, '{sql.outside('gbk')}') THEN 'target cannot be encoded as gbk'") + "SELECT line_no, segment_id, error FROM x",
    "review_summary": _REVIEW
    + f"""SELECT true AS dry_run, 0::BIGINT AS applied, count(*) FILTER (WHERE error IS NULL AND {sql.strip('n')} <> '') AS ready, count(*) FILTER (WHERE error IS NULL AND {sql.strip('n')} = '') AS pending, count(error) AS failed, count(*) AS review_rows,
 (SELECT count(*) FROM c) AS catalog_records, '{_HASH}' AS current_sha256, '{_HASH}' AS review_sha256 FROM x""",
}
