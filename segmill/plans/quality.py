"""Queries of tokens, text measures, the quality gate and its parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions import codecs
from segmill.functions import text as T
from segmill.operators import qa
from segmill.plans import sql
from segmill.session import table
from segmill.sources import catalog

MAX_CHARS, MAX_LINES = 40, 1


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.adapted(table(spark, sf_dir, "seg_current"), row_idx="row_id")


def policy(spark: SparkSession, sf_dir: str, **options) -> qa.Policy:
    return qa.Policy(max_chars=MAX_CHARS, max_lines=MAX_LINES, check_punctuation=True, glossary=catalog.glossary_of(table(spark, sf_dir, "glossary")), **options)


def tokens_extracted(spark, sf_dir):
    t = T.tokens(F.col("source"))
    return table(spark, sf_dir, "seg_current").select("row_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def tokens_stripped(spark, sf_dir):
    return table(spark, sf_dir, "seg_current").select("row_id", T.without_tokens(F.col("source")).alias("bare_source"))


def tokens_compared(spark, sf_dir):
    own = table(spark, sf_dir, "seg_current").select("row_id", T.tokens(F.col("source")).alias("s"), T.tokens(F.col("target")).alias("t"))
    n = lambda c: F.size(c).cast("long")
    return own.select("row_id", n(T.multiset_minus(F.col("s"), F.col("t"))).alias("missing"), n(T.multiset_minus(F.col("t"), F.col("s"))).alias("added"), T.reordered(F.col("s"), F.col("t")).alias("reordered"))


def text_measures(spark, sf_dir):
    own = table(spark, sf_dir, "seg_current").select("row_id", F.coalesce("target", F.lit("")).alias("t"))
    t, b = F.col("t"), F.col("b")
    return own.withColumn("b", T.without_tokens(t)).select(
        "row_id", T.stripped(t).alias("stripped"), T.shown_length(b).cast("long").alias("shown"), T.line_count(t).cast("long").alias("lines"), F.array_join(T.kana_in(b), "").alias("kana"),
        F.size(T.zero_width_in(t)).cast("long").alias("hidden"), F.array_join(T.unbalanced_pairs(b), " ").alias("unbalanced"), T.has_unescaped_quote(t).alias("unescaped_quote"), F.sha2(t, 256).alias("sha256"),
    )


def unencodable_chars(spark, sf_dir):
    """Characters of all targets that GBK can't hold, with their numbers."""
    lost = table(spark, sf_dir, "seg_current").select(F.explode(codecs.unencodable(T.without_tokens(F.col("target")), "gbk")).alias("x"))
    return lost.groupBy("x.char", "x.codepoint").agg(F.sum("x.count").alias("n"))


def non_ascii_chars(spark, sf_dir):
    lost = table(spark, sf_dir, "seg_current").select(F.explode(codecs.unencodable(T.without_tokens(F.col("target")), "ascii")).alias("x"))
    return lost.groupBy("x.char").agg(F.sum("x.count").alias("n"))


def qa_records(spark, sf_dir):
    return qa.adapted(table(spark, sf_dir, "galtransl_cache"), "alternate", row_idx="row_id")


def qa_findings(spark, sf_dir):
    return qa.findings(records(spark, sf_dir), policy(spark, sf_dir)).select("row_idx", "code", "blocking")


def qa_inconsistent(spark, sf_dir):
    found = qa.inconsistent_groups(records(spark, sf_dir))
    return found.select(F.sha2("key", 256).alias("source_sha256"), "targets", F.array_join("targets_shown", " | ").alias("shown"))


def qa_counters(spark, sf_dir):
    return qa.counters(records(spark, sf_dir), policy(spark, sf_dir))


def qa_gate(spark, sf_dir):
    return qa.summary(records(spark, sf_dir), policy(spark, sf_dir))


def qa_gate_strict(spark, sf_dir):
    return qa.summary(records(spark, sf_dir), policy(spark, sf_dir, require_complete=True, reject_japanese=True, require_translated=True, require_consistent=True))


def qa_gate_gbk(spark, sf_dir):
    """Gate with the encoding rule; its SQL has the codec's table as a character class."""
    return qa.summary(records(spark, sf_dir), policy(spark, sf_dir, encoding="gbk"))


QUERIES = {
    "tokens_extracted": tokens_extracted, "tokens_stripped": tokens_stripped, "tokens_compared": tokens_compared, "text_measures": text_measures, "unencodable_chars": unencodable_chars,
    "non_ascii_chars": non_ascii_chars, "qa_records": qa_records, "qa_findings": qa_findings, "qa_inconsistent": qa_inconsistent, "qa_counters": qa_counters, "qa_gate": qa_gate,
    "qa_gate_strict": qa_gate_strict, "qa_gate_gbk": qa_gate_gbk,
}

_ZW = "[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]"
_KANA = "[\\x{3040}-\\x{30ff}]"
_S, _T = "coalesce(source, '')", "coalesce(target, '')"
_PAIRS = "list_filter([" + ", ".join(f"CASE WHEN {sql.count('b', a)} <> {sql.count('b', z)} THEN '{a}{z}' END" for a, z in T.PUNCTUATION) + "], lambda x: x IS NOT NULL)"


_NOT_GBK = sql.outside("gbk")


def _rules(complete: bool, kana: bool, translated: bool, consistent: bool, gbk: bool = False) -> str:
    """All findings of the gate as CTEs ending in ``f(row_idx, segment_id, code, blocking)``."""
    flag = lambda x: "true" if x else "false"
    done = f"FROM r WHERE {sql.strip('t')} <> ''"
    one = lambda code, block, cond: f"SELECT row_idx, segment_id, '{code}' AS code, {flag(block)} AS blocking {done} AND {cond}"
    parts = [
        f"SELECT row_idx, segment_id, 'empty-translation' AS code, {flag(complete)} AS blocking FROM r WHERE {sql.strip('t')} = ''",
        one("control-token-missing", True, f"{sql.surplus('st', 'tt')} > 0"),
        one("control-token-added", True, f"{sql.surplus('tt', 'st')} > 0"),
        one("control-token-reordered", True, sql.reordered("st", "tt")),
        one("unchanged-source", translated, f"{sql.strip('s')} <> '' AND {sql.strip('s')} = {sql.strip('t')}"),
        one("residual-japanese", kana, f"regexp_matches(b, '{_KANA}')"),
        one("zero-width-character", True, f"regexp_matches(t, '{_ZW}')"),
        one("character-budget", True, f"length(replace(replace(b, chr(13), ''), chr(10), '')) > {MAX_CHARS}"),
        one("line-budget", True, f"{sql.lines('t')} > {MAX_LINES}"),
        f"SELECT row_idx, segment_id, 'punctuation-unbalanced', false FROM (SELECT row_idx, segment_id, unnest({_PAIRS}) {done})",
        "SELECT row_idx, segment_id, 'terminology-mismatch', true FROM r JOIN terms g ON contains(s, g.src) AND len(list_filter(g.tgts, lambda x: contains(t, x))) = 0 WHERE " + f"{sql.strip('t')} <> ''",
        "SELECT row_idx, segment_id, 'forbidden-term', true FROM r JOIN forbidden g ON contains(t, g.word) WHERE " + f"{sql.strip('t')} <> ''",
        f"SELECT row_idx, segment_id, 'inconsistent-translation', {flag(consistent)} FROM r JOIN groups g ON g.k = {sql.strip('s')} WHERE {sql.strip('t')} <> ''",
    ]
    if gbk:
        parts.append(one("encoding", True, f"regexp_matches(b, '{_NOT_GBK}')"))
    return f"""
WITH r AS (SELECT row_id AS row_idx, segment_id, {_S} AS s, {_T} AS t, {sql.tokens('source')} AS st, {sql.tokens('target')} AS tt, {sql.bare(_T)} AS b FROM seg_current),
terms AS (SELECT DISTINCT x.source AS src, x.targets AS tgts FROM (SELECT unnest(terms) AS x FROM glossary)),
forbidden AS (SELECT DISTINCT unnest(forbidden) AS word FROM glossary),
groups AS (SELECT {sql.strip('s')} AS k, count(DISTINCT {sql.strip('t')}) AS n, list_sort(list(DISTINCT {sql.strip('t')})) AS all_targets FROM r
  WHERE {sql.strip('s')} <> '' AND {sql.strip('t')} <> '' GROUP BY 1 HAVING n > 1),
f AS ({' UNION ALL '.join(parts)})
"""


def _gate(complete=False, kana=False, translated=False, consistent=False, gbk=False) -> str:
    side = "blocking" if consistent else "NOT blocking"
    extra = f"(SELECT count(DISTINCT segment_id) FROM f WHERE code = 'inconsistent-translation' AND segment_id NOT IN (SELECT segment_id FROM f WHERE code <> 'inconsistent-translation' AND {side}))"
    rows = lambda cond: f"(SELECT count(DISTINCT row_idx) FROM f WHERE code <> 'inconsistent-translation' AND {cond})"
    failed, warned = rows("blocking") + (f" + {extra}" if consistent else ""), rows("NOT blocking") + ("" if consistent else f" + {extra}")
    return _rules(complete, kana, translated, consistent, gbk) + f"""
SELECT CASE WHEN {failed} > 0 THEN 'FAIL' ELSE 'PASS' END AS gate, count(*) AS total_records, count(*) FILTER (WHERE {sql.strip('t')} <> '') AS completed,
       count(*) FILTER (WHERE {sql.strip('t')} = '') AS pending, {failed} AS failed_records, {warned} AS warning_records FROM r"""


_FIRST = lambda *c: "coalesce(" + ", ".join(f"nullif({x}, '')" for x in c) + ", '')"
ORACLES = {
    "tokens_extracted": f"SELECT row_id, len({sql.tokens('source')}) AS n_tokens, array_to_string({sql.tokens('source')}, ' ') AS tokens FROM seg_current",
    "tokens_stripped": f"SELECT row_id, {sql.bare('source')} AS bare_source FROM seg_current",
    "tokens_compared": f"WITH x AS (SELECT row_id, {sql.tokens('source')} AS s, {sql.tokens('target')} AS t FROM seg_current) SELECT row_id, {sql.surplus('s', 't')} AS missing, {sql.surplus('t', 's')} AS added, {sql.reordered('s', 't')} AS reordered FROM x",
    "text_measures": f"""WITH x AS (SELECT row_id, {_T} AS t, {sql.bare(_T)} AS b FROM seg_current)
SELECT row_id, {sql.strip('t')} AS stripped, length(replace(replace(b, chr(13), ''), chr(10), '')) AS shown, {sql.lines('t')} AS lines,
       array_to_string(list_sort(list_distinct(regexp_extract_all(b, '{_KANA}', 0))), '') AS kana, len(list_distinct(regexp_extract_all(t, '{_ZW}', 0))) AS hidden,
       array_to_string({_PAIRS}, ' ') AS unbalanced, regexp_matches(t, '(^|[^\\\\])(\\\\\\\\)*"') AS unescaped_quote, sha256(t) AS sha256 FROM x""",
    "non_ascii_chars": f"SELECT c AS char, count(*) AS n FROM (SELECT unnest(regexp_extract_all({sql.bare('target')}, '[^\\x00-\\x7f]', 0)) AS c FROM seg_current WHERE target IS NOT NULL) GROUP BY c",
    "qa_records": f"SELECT row_id AS row_idx, index::VARCHAR AS segment_id, {_FIRST('pre_jp', 'post_jp')} AS source, {_FIRST('proofread_zh', 'pre_zh', 'post_zh')} AS target FROM galtransl_cache",
    "qa_findings": _rules(False, False, False, False) + "SELECT row_idx, code, blocking FROM f",
    "qa_inconsistent": _rules(False, False, False, False) + "SELECT sha256(k) AS source_sha256, n AS targets, array_to_string(list_slice(all_targets, 1, 10), ' | ') AS shown FROM groups",
    "qa_counters": _rules(False, False, False, False)
    + """, c AS (SELECT code, count(*) AS n FROM f WHERE code <> 'inconsistent-translation' GROUP BY code UNION ALL SELECT 'inconsistent-translation', count(*) FROM groups HAVING count(*) > 0
  UNION ALL SELECT 'punctuation-unbalanced', 0) SELECT code, sum(n)::BIGINT AS n FROM c GROUP BY code""",
    "qa_gate": _gate(),
    "qa_gate_strict": _gate(True, True, True, True),
    "qa_gate_gbk": _gate(gbk=True),
    "unencodable_chars": f"SELECT c AS char, printf('U+%04X', ord(c)) AS codepoint, count(*) AS n FROM (SELECT unnest(regexp_extract_all({sql.bare('target')}, '{_NOT_GBK}', 0)) AS c FROM seg_current WHERE target IS NOT NULL) GROUP BY c",
}
