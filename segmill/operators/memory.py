"""Translation memory: carry translations from earlier catalogs into the current one.

Current records are ``(row_idx, segment_id, source, target)``, history adds ``origin``. The first step that
hits decides: a target of its own; the same id and source; the same source; a similar source, for review
only. Each step works on what the ones before left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.functions import text as T
from segmill.operators import similarity
from segmill.session import checkpointed

THRESHOLD = 0.86
# Reasons that review tables carry.
NO_AGREEMENT, BROKEN_TOKENS = "conflicting targets for the same exact source", "placeholder mismatch in previous translation"
#: Decisions that a person must look at, and those shown in reports (fixed values).
REVIEWED, SHOWN = ("conflict", "review-suggestion", "pending"), ("conflict", "review-suggestion")


def with_ids(records: DataFrame) -> DataFrame:
    """Records with a text id: NULL and empty ids become ``#index:`` and the position, from 1."""
    own = F.nullif(F.col("segment_id").cast("string"), F.lit(""))
    return records.withColumn("segment_id", F.coalesce(own, F.concat(F.lit("#index:"), (F.col("row_idx") + 1).cast("string"))))


def history(catalogs: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Catalogs in order, as one: ``origin`` labels each, positions go on through all of them."""
    parts, offset = [], F.lit(0).cast("long")
    for origin, records in catalogs:
        parts.append(records.select((F.col("row_idx") + offset).alias("row_idx"), "segment_id", "source", "target", F.lit(origin).alias("origin")))
        offset = offset + F.lit(records.count())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_current(current: DataFrame) -> None:
    """Raise for the first record, by position, whose id occurred before or whose source is empty."""
    ids = current.groupBy("segment_id").agg(F.min("row_idx").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = current.join(ids, "segment_id").where("row_idx > first").select("row_idx", F.concat(F.lit("duplicate current segment id: "), "segment_id").alias("e"))
    empty = current.where("source IS NULL OR source = ''").select("row_idx", F.concat(F.lit("current record "), "segment_id", F.lit(" has no source text")).alias("e"))
    first = repeats.unionByName(empty).agg(F.min_by("e", "row_idx").alias("e")).first().e
    if first:
        raise ValueError(first)


def _reduced(translated: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the least and greatest target, the number of rows and their catalogs.

    Whether the targets agree shows in the two extremes, so nothing is listed but catalog labels.
    """
    return translated.groupBy(*keys).agg(
        F.min("target").alias("lo"), F.max("target").alias("hi"), F.sort_array(F.collect_set("origin")).alias("origins"), F.count("*").alias("rows"), F.min("segment_id").alias("first_id"), F.max("segment_id").alias("last_id")
    )


def decisions(current: DataFrame, previous: DataFrame, threshold: float | None = THRESHOLD, checked: bool = True) -> DataFrame:
    """One row per current record.

    Columns: ``row_idx, segment_id, decision, reason, warning, similarity, previous_segment_id,
    previous_source, suggested_target, placeholder_compatible, previous_catalog, previous_catalogs,
    previous_rows, new_target``. ``new_target`` is the record's target afterwards. ``decision`` is
    ``kept-current``, ``reused-exact-id``, ``reused-exact-source``, ``conflict``, ``review-suggestion`` or
    ``pending``. A key with any number of history rows is one aggregate; the ids behind a reused source
    come from :func:`reused_ids`. ``threshold`` None leaves out the similarity step.

    ``checked`` refuses repeated current ids and empty sources; without it such rows are decided as any
    other. NULL targets are empty; history rows that aren't translated (empty target, or target equal to
    the source) are invisible. Ties of the similarity go to the greatest (id, source, target, catalog).
    """
    if threshold is not None and not 0.0 <= threshold <= 1.0:
        raise ValueError("fuzzy threshold must be between 0 and 1")
    current = with_ids(current).withColumns({"source": F.coalesce("source", F.lit("")), "target": F.coalesce("target", F.lit(""))})
    if checked:
        check_current(current)
    translated = with_ids(previous).where("target <> '' AND source <> '' AND target <> source")
    by_id = _reduced(translated, ["segment_id", "source"]).select("segment_id", "source", F.struct("lo", "hi", "origins", "rows", "first_id").alias("by_id"))
    by_source = _reduced(translated, ["source"]).select("source", F.struct("lo", "hi", "origins", "rows", "first_id", "last_id").alias("by_source"))
    open_ = current.where("target = ''")
    found = open_.join(by_id, ["segment_id", "source"], "left").join(by_source, "source", "left")

    def reason(hit: str):
        return F.when(F.col(f"{hit}.lo") != F.col(f"{hit}.hi"), NO_AGREEMENT).when(~T.tokens_agree(F.col("source"), F.col(f"{hit}.lo")), BROKEN_TOKENS)

    found = found.withColumns({"r1": F.when(F.col("by_id").isNotNull(), reason("by_id")), "r2": F.when(F.col("by_source").isNotNull(), reason("by_source"))})
    step = (
        F.when(F.col("by_id").isNotNull(), F.when(F.col("r1").isNull(), "reused-exact-id").otherwise("conflict"))
        .when(F.col("by_source").isNotNull(), F.when(F.col("r2").isNull(), "reused-exact-source").otherwise("conflict"))
        .otherwise("pending")
    )
    found = found.withColumn("decision", step)
    reused_id, reused_source = F.col("decision") == "reused-exact-id", F.col("decision") == "reused-exact-source"
    exact = found.select(
        "row_idx", "segment_id", "source", "decision",
        F.when(F.col("decision") == "conflict", F.coalesce("r1", "r2")).alias("reason"),
        F.when(reused_id, F.col("segment_id")).when(reused_source & (F.col("by_source.first_id") == F.col("by_source.last_id")), F.col("by_source.first_id")).alias("previous_segment_id"),
        F.when(reused_id, F.col("by_id.origins")).when(reused_source, F.col("by_source.origins")).alias("previous_catalogs"),
        F.when(reused_id, F.col("by_id.rows")).when(reused_source, F.col("by_source.rows")).alias("previous_rows"),
        F.when(reused_id, F.col("by_id.lo")).when(reused_source, F.col("by_source.lo")).otherwise(F.lit("")).alias("new_target"),
    )
    kept = current.where("target <> ''").select(
        "row_idx", "segment_id", F.lit("kept-current").alias("decision"),
        F.when(~T.tokens_agree(F.col("source"), F.col("target")), F.lit("control tokens of the current target differ")).alias("warning"), F.col("target").alias("new_target"),
    )
    if threshold:
        exact = checkpointed(exact)
        left = exact.where("decision = 'pending'").select(F.col("source").alias("text"))
        pairs = similarity.similar_pairs(left, translated.select(F.col("source").alias("text")), threshold)
        best = pairs.join(translated, F.col("b") == F.col("source")).groupBy("a").agg(F.max(F.struct("ratio", "segment_id", F.col("source"), F.col("target"), "origin")).alias("best"))
        exact = exact.join(best.withColumnRenamed("a", "source"), "source", "left")
        hit = F.col("best").isNotNull() & (F.col("decision") == "pending")
        exact = exact.withColumns(
            {
                "decision": F.when(hit, "review-suggestion").otherwise(F.col("decision")),
                "similarity": F.when(hit, F.round("best.ratio", 6)),
                "previous_segment_id": F.when(hit, F.col("best.segment_id")).otherwise(F.col("previous_segment_id")),
                "previous_source": F.when(hit, F.col("best.source")),
                "suggested_target": F.when(hit, F.col("best.target")),
                "placeholder_compatible": F.when(hit, T.tokens_agree(F.col("source"), F.col("best.target"))),
                "previous_catalog": F.when(hit, F.col("best.origin")),
            }
        ).drop("best")
    out = exact.drop("source").unionByName(kept, allowMissingColumns=True)
    kinds = {"reason": "string", "warning": "string", "similarity": "double", "previous_segment_id": "string", "previous_source": "string", "suggested_target": "string", "placeholder_compatible": "boolean", "previous_catalog": "string", "previous_catalogs": "array<string>", "previous_rows": "long"}
    return out.select("row_idx", "segment_id", "decision", *((F.col(c) if c in out.columns else F.lit(None).cast(k).alias(c)) for c, k in kinds.items()), "new_target")


def reused_ids(current: DataFrame, previous: DataFrame, decided: DataFrame) -> DataFrame:
    """``(segment_id, previous_segment_id)`` of the history rows behind every reused source, one a row."""
    wanted = decided.where("decision = 'reused-exact-source'").select("segment_id").join(with_ids(current).select("segment_id", "source"), "segment_id")
    return wanted.join(with_ids(previous).where("target <> '' AND target <> source").select("source", F.col("segment_id").alias("previous_segment_id")), "source").select("segment_id", "previous_segment_id").distinct()


def merged(current: DataFrame, decided: DataFrame) -> DataFrame:
    """The current records with their targets afterwards; all other columns are kept."""
    return current.drop("target").join(decided.select("row_idx", F.col("new_target").alias("target")), "row_idx").select(*current.columns)


def summary(decided: DataFrame, previous_records: int, threshold: float | None = THRESHOLD) -> DataFrame:
    """One row of counters; ``kept_current + reused_by_id + reused_by_source + pending = current_records``."""
    n = lambda d: F.count_if(F.col("decision") == d)
    own = decided.agg(
        F.count("*").alias("current_records"), n("kept-current").alias("kept_current"), n("reused-exact-id").alias("reused_by_id"), n("reused-exact-source").alias("reused_by_source"),
        n("review-suggestion").alias("suggestions"), n("conflict").alias("conflicts"), F.count_if(F.col("decision").isin(*REVIEWED)).alias("pending"),
    )
    return own.select(F.when(F.col("conflicts") == 0, "PASS").otherwise("REVIEW").alias("status"), "current_records", F.lit(previous_records).cast("long").alias("previous_records"), *own.columns[1:], F.lit(threshold).cast("double").alias("fuzzy_threshold"))


def review_queue(decided: DataFrame, current_sha256: str) -> DataFrame:
    """The review table's twelve text columns of every decision a person must look at."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    catalog = F.coalesce(F.nullif(text("previous_catalog"), F.lit("")), F.array_join("previous_catalogs", " | "), F.lit(""))
    return decided.where(F.col("decision").isin(*REVIEWED)).select(
        F.lit(current_sha256).alias("current_sha256"), "segment_id", "decision", text("reason").alias("reason"), text("similarity").alias("similarity"), catalog.alias("previous_catalog"),
        text("previous_segment_id").alias("previous_segment_id"), text("previous_source").alias("previous_source"), text("suggested_target").alias("suggested_target"),
        F.initcap(text("placeholder_compatible")).alias("placeholder_compatible"), F.lit("").alias("reviewed_target"), F.lit("").alias("reviewer_notes"),
    )
