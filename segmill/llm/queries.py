"""Queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import mixing, mojibake, neardup, packing, pairs, sentences, skeleton, truncation
from segmill.session import table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "seg_current").select(F.col("row_id").alias("id"), "source", "target", "feed")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective(_pairs(spark, sf_dir)).select(F.col("id").alias("row_id"), "defect")


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("pairs"))


_CUT_KINDS = {"current.target": "answer", "galtransl_cache.post_jp": "derived"}


def _cut_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "seg_current").select(F.lit("current.target").alias("field_name"), "feed", F.col("row_id").alias("id"), F.col("target").alias("value"), F.col("source").alias("peer"))
    cache = table(spark, sf_dir, "galtransl_cache").select(F.lit("galtransl_cache.post_jp").alias("field_name"), "feed", F.col("row_id").alias("id"), F.col("post_jp").alias("value"), F.col("pre_jp").alias("peer"))
    return current.unionByName(cache)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(_cut_values(spark, sf_dir), _CUT_KINDS).select("field_name", F.col("id").alias("row_id"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(_cut_values(spark, sf_dir), _CUT_KINDS)


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = skeleton.forms(table(spark, sf_dir, "seg_current"), "row_id", [("current.source", "source"), ("current.target", "target")])
    values = current.unionByName(skeleton.forms(table(spark, sf_dir, "galtransl_cache"), "row_id", [("galtransl_cache.pre_jp", "pre_jp")]))
    return mojibake.repaired(values).withColumnRenamed("id", "row_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("field_name", "row_id")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("field_name", "row_id", "restored", "channel")


def _look_alike_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = skeleton.forms(table(spark, sf_dir, "seg_current"), "row_id", [("current.source", "source"), ("current.target", "target")])
    return current.unionByName(skeleton.forms(table(spark, sf_dir, "review_rows"), "row_id", [("review.reviewed_target", "reviewed_target")]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.look_alike_pairs(_look_alike_values(spark, sf_dir))


def p4_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.normalised(_look_alike_values(spark, sf_dir))


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "seg_current").select(F.col("row_id").alias("id"), F.col("source").alias("text"))
    return current.unionByName(table(spark, sf_dir, "review_rows").select(F.col("row_id").alias("id"), F.col("previous_source").alias("text")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_records(_edited(spark, sf_dir))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_edited(spark, sf_dir))


def p8_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.assign(table(spark, sf_dir, "documents"), packing.read_specs(table(spark, sf_dir, "pack_specs")))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every right assignment has, by specification: documents placed whole and once (but for cut ones), containers within capacity, hardly more than needed."""
    documents, specs = table(spark, sf_dir, "documents"), packing.read_specs(table(spark, sf_dir, "pack_specs"))
    out = packing.checkpointed(packing.assign(documents, specs))
    pieces = out.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.max("piece").alias("last"), F.sum("piece_tokens").alias("tokens"))
    capacity = F.element_at(F.create_map(*(F.lit(x) for s in specs for x in (s.spec_id, s.capacity))), F.col("spec_id"))
    placed = pieces.groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") != F.col("last") + 1) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)))).alias("wrongly_cut"))
    over = out.groupBy("spec_id", "container").agg(F.sum("piece_tokens").alias("used")).groupBy("spec_id").agg(F.count_if(F.col("used") > capacity).alias("overfull"))
    tight = packing.fills(out, specs).select("spec_id", (F.col("containers") <= F.col("least_containers") * 1.01 + 1).alias("tight"))
    return placed.join(over, "spec_id").join(tight, "spec_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fills(p8_assignment(spark, sf_dir), packing.read_specs(table(spark, sf_dir, "pack_specs")))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(mixing.token_table(table(spark, sf_dir, "documents")), mixing.read_targets(table(spark, sf_dir, "mix_targets")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_selection(spark, sf_dir), mixing.read_targets(table(spark, sf_dir, "mix_targets")))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every right selection has, by target: the share of the tokens drawn within a hundredth of all, caps kept, nothing drawn twice."""
    targets = mixing.read_targets(table(spark, sf_dir, "mix_targets"))
    chosen = mixing.checkpointed(p9_selection(spark, sf_dir))
    caps = spark.createDataFrame([(s, t.repeats) for s, t in targets.items()], "source string, cap long")
    kept = chosen.join(F.broadcast(caps), "source").groupBy("source").agg((F.count_if((F.col("copies") > F.col("cap")) | (F.col("copies") < 1)) == 0).alias("kept"), (F.count("*") == F.count_distinct("doc_id")).alias("once"))
    shares = mixing.shares(chosen, targets)
    live = shares.where("tokens > 0").agg(F.sum("target_share").alias("live")).first()[0] or 1.0
    wanted = F.when(F.col("tokens") > 0, F.col("target_share") / live).otherwise(0.0)
    met = F.abs(F.col("actual_share") - wanted) <= 0.01
    return shares.join(kept, "source", "left").select("source", F.round(wanted, 9).alias("wanted"), met.alias("met"), F.coalesce("kept", F.lit(True)).alias("kept"), F.coalesce("once", F.lit(True)).alias("once"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = table(spark, sf_dir, "documents").where("file_class = 'prose'")
    return sentences.split_documents(prose).select("doc_id", "sent_end")


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files; headings, list items and fences are those of prose."""
    return sentences.split_documents(table(spark, sf_dir, "documents"), class_col="file_class")


QUERIES = {
    "p2_found": p2_found, "p2_totals": p2_totals, "p5_found": p5_found, "p5_rates": p5_rates, "p7_found": p7_found, "p7_restored": p7_restored,
    "p4_found": p4_found, "p4_normalised": p4_normalised, "p6_found": p6_found, "p6_classes": p6_classes,
    "p8_invariants": p8_invariants, "p9_invariants": p9_invariants, "p8_assignment": p8_assignment, "p8_fill": p8_fill, "p9_selection": p9_selection, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_sentences": p10_sentences,
}
_EDITED = """
WITH r AS (SELECT row_id AS id, source AS t FROM seg_current WHERE length(source) >= 24
  UNION ALL SELECT row_id, previous_source FROM review_rows WHERE length(previous_source) >= 24),
d AS (SELECT t, min(id) AS k, length(t) - 1 AS n FROM r GROUP BY t),
g0 AS (SELECT k, n, i, substr(t, i, 2) AS b FROM (SELECT k, n, t, unnest(range(1, n + 1)) AS i FROM d)),
g AS (SELECT k, n, b, row_number() OVER (PARTITION BY k, b ORDER BY i) AS o FROM g0),
s AS (SELECT x.k AS a, y.k AS b FROM g x JOIN g y ON x.b = y.b AND x.o = y.o AND x.k < y.k GROUP BY x.k, y.k, x.n, y.n HAVING 2 * count(*) >= 0.8 * (x.n + y.n)),
m AS (SELECT d.k, r.id FROM d JOIN r ON d.t = r.t)
SELECT least(p.id, q.id) AS id_a, greatest(p.id, q.id) AS id_b FROM s JOIN m p ON s.a = p.k JOIN m q ON s.b = q.k
"""
_CLASSES = _EDITED.replace("WITH r AS", "WITH RECURSIVE r AS").replace("SELECT least(p.id", "@").split("@")[0].rstrip() + """,
e AS (SELECT a AS u, b AS v FROM s UNION ALL SELECT b, a FROM s),
reach AS (SELECT DISTINCT u, u AS v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
c AS (SELECT u, min(v) AS class_id FROM reach GROUP BY u), g1 AS (SELECT u, count(*) AS links FROM e GROUP BY u),
every AS (SELECT row_id AS id FROM seg_current UNION ALL SELECT row_id FROM review_rows)
SELECT every.id, coalesce(c.class_id, m.k, every.id) AS class_id, coalesce(g1.links, 0) AS links FROM every LEFT JOIN m ON m.id = every.id LEFT JOIN c ON c.u = m.k LEFT JOIN g1 ON g1.u = m.k
"""
#: The others have no SQL form: they are tested against brute force, exact round trips or held-out truth.
ORACLES: dict[str, str] = {
    "p6_found": _EDITED, "p6_classes": _CLASSES,
    "p8_invariants": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS wrongly_cut, 0::BIGINT AS overfull, true AS tight FROM pack_specs",
    "p9_invariants": """WITH d AS (SELECT DISTINCT source FROM documents WHERE length(text) > 0), t AS (SELECT source, target_share, source IN (SELECT source FROM d WHERE source IS NOT NULL) AND target_share > 0 AND max_repeats > 0 AS live FROM mix_targets)
SELECT source, CASE WHEN live THEN round(target_share / (SELECT sum(target_share) FROM t WHERE live), 9) ELSE 0 END::DOUBLE AS wanted, true AS met, true AS kept, true AS once FROM t""",
}
