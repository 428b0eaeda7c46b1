"""Queries of audits, script lines, slots, images, manifests and the documented checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions import paths
from segmill.operators import adapter, audit, documented, images, manifest, slots
from segmill.plans import sql
from segmill.session import table


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory table with dotted suffixes; the path stands in for the walk's position."""
    rows = table(spark, sf_dir, "script_files")
    return rows.select("path", "size", F.concat(F.lit("."), F.lower("extension")).alias("extension"), "is_link", F.col("path").alias("walk_idx"))


def path_facts(spark, sf_dir):
    p = F.col("path")
    own = table(spark, sf_dir, "script_files")
    return own.select("path", paths.normal_path(F.concat(F.lit("\\"), p, F.lit("/"))).alias("normal"), paths.extension(p).alias("suffix"), paths.category(paths.extension(p)).alias("category"), paths.is_safe(F.concat(p, F.lit("/.."))).alias("safe"))


def audit_signals(spark, sf_dir):
    return audit.evidence(audit.signals(inventory(spark, sf_dir))).select("engine", "signal_group", "path", F.col("rank").cast("long").alias("rank"))


def audit_engines(spark, sf_dir):
    found = audit.detect(inventory(spark, sf_dir))
    return found.select("engine", "classification", "confidence", F.array_join("signal_groups", " ").alias("signal_groups"))


def audit_totals(spark, sf_dir):
    return audit.totals(inventory(spark, sf_dir))


def audit_extensions(spark, sf_dir):
    return audit.top_extensions(inventory(spark, sf_dir))


def audit_categories(spark, sf_dir):
    return audit.categories(inventory(spark, sf_dir)).select("category", F.col("files").cast("long").alias("files"), F.array_join("examples", " ").alias("examples"))


def audit_probes(spark, sf_dir):
    """Byte probes of the first twenty scripts, each in UTF-8 of a record's source."""
    first = table(spark, sf_dir, "seg_current").groupBy(F.col("source_path").alias("path")).agg(F.min_by("source", "row_id").alias("s"))
    files = first.join(inventory(spark, sf_dir), "path").select("path", "extension", "is_link", F.encode("s", "UTF-8").alias("content"), "walk_idx").withColumn("length", F.length("content"))
    return audit.probes(files).select("path", "sampled_bytes", "bom", F.array_join("decodable_as", " ").alias("decodable_as"))


def script_lines(spark, sf_dir):
    """All lines of all documents."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", F.lit("utf-8").alias("encoding"), F.lit(None).cast("binary").alias("bom"))
    own = adapter.lines(texts)
    return own.groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.length("body")).alias("body_chars"), F.count_if(F.col("newline") == "").alias("open_lines"))


def script_parts(spark, sf_dir):
    """Source lines as script lines of all three engines."""
    body = F.concat(F.lit("　"), F.col("source"), F.lit(" "))
    own = table(spark, sf_dir, "seg_current").select("row_id", adapter.parts("kirikiri", body).alias("k"), adapter.parts("nscripter", body).alias("n"), adapter.parts("renpy", F.concat(F.lit('  eileen "'), F.col("source"), F.lit('"  # x'))).alias("r"))
    return own.select("row_id", F.col("k.source").alias("tag_line"), F.col("n.prefix").alias("text_prefix"), F.col("r.source").alias("quoted"), F.col("r.suffix").alias("quoted_suffix"))


def _scripts(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return texts.select(F.concat("doc_id", F.lit(".ks")).alias("path"), F.encode("text", "UTF-8").alias("content"))


def script_extract(spark, sf_dir):
    """Translatable lines of all documents, read as files of the tag engine."""
    return adapter.extract(_scripts(spark, sf_dir), "kirikiri").select("segment_id", "source", "source_sha256", "line_sha256", "prefix", "suffix", "newline")


def script_round_trip(spark, sf_dir):
    """Files rebuilt from an identity translation: equal bytes."""
    files = _scripts(spark, sf_dir)
    same = adapter.extract(files, "kirikiri").withColumn("target", F.col("source"))
    out = adapter.rebuilt(files, same, allow_empty=True)
    return out.join(files.select("path", F.col("content").alias("before")), "path").select("path", (F.col("content") == F.col("before")).alias("identical"))


_SLOT, _HEAD = 64, 4


def _slot_files(spark, sf_dir, tail: str = ""):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat("p_name", F.lit(tail)).alias("a"), F.col("p_type").alias("b"))
    slot = lambda c: F.rpad(F.encode(F.col(c), "UTF-8"), _SLOT, F.lit(bytearray(1)))
    return part.select("path", F.concat(F.lit(bytearray(_HEAD)), slot("a"), slot("b")).alias("content"))


def slots_scan(spark, sf_dir):
    own = slots.scan(_slot_files(spark, sf_dir), _HEAD, _SLOT, 2, "utf-8")
    return own.select("path", F.col("index").cast("long").alias("index"), "offset", F.col("used_bytes").cast("long").alias("used_bytes"), F.col("capacity").cast("long").alias("capacity"), "text", "valid")


def slots_changed(spark, sf_dir):
    return slots.changed(_slot_files(spark, sf_dir), _slot_files(spark, sf_dir, "!"), _HEAD, _SLOT, 2, "utf-8").select("path", F.col("index").cast("long").alias("index"))


def _bitmaps(spark, sf_dir, grown: int = 0):
    part = table(spark, sf_dir, "part")
    wide = F.lpad(F.hex(F.col("p_size") + F.when(F.col("p_partkey") % 5 == grown, 1).otherwise(0)), 2, "0")
    head = F.concat(F.lit("424D" + "00" * 12 + "28000000"), wide, F.lit("000000" + "0A000000" + "0100" + "2000" + "00" * 24))
    other = F.when(F.col("p_partkey") % 7 == grown, f"other{grown}/").otherwise("")  # names that the other build lacks
    return part.select(F.concat(other, "p_partkey", F.lit(".BMP")).alias("path"), F.unhex(head).alias("content"))


def images_inventory(spark, sf_dir):
    return images.inventory(_bitmaps(spark, sf_dir)).select("path", "format", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "alpha", "error")


def images_compared(spark, sf_dir):
    return images.compare(images.inventory(_bitmaps(spark, sf_dir)), images.inventory(_bitmaps(spark, sf_dir, 1))).select("severity", "id", "path")


def _payload(spark, sf_dir):
    return table(spark, sf_dir, "seg_current").where("source IS NOT NULL").groupBy(F.concat(F.replace("segment_id", F.lit(":"), F.lit("/")), F.lit(".txt")).alias("rel")).agg(F.max_by("source", "row_id").alias("t")).select("rel", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("size"))


def _tree(spark, sf_dir):
    return table(spark, sf_dir, "seg_previous").where("source IS NOT NULL").groupBy(F.concat(F.replace(F.trim(F.lower("segment_id")), F.lit(":"), F.lit("/")), F.lit(".txt")).alias("rel")).agg(F.max_by("source", "row_id").alias("t")).select("rel", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("size"))


def manifest_entries(spark, sf_dir):
    return manifest.build(_payload(spark, sf_dir), _tree(spark, sf_dir))


def _half_applied(spark, sf_dir):
    """All files of both trees: by their hashes new, as before, changed otherwise, or under another name."""
    both = _payload(spark, sf_dir).select("rel", F.col("sha256").alias("n")).join(_tree(spark, sf_dir).select("rel", F.col("sha256").alias("o")), "rel", "full_outer")
    by = F.substring(F.coalesce("n", "o"), 1, 1)
    other = F.concat(F.when(by >= "d", "other/").otherwise(""), "rel")
    return both.select(other.alias("rel"), F.when(by < "6", F.coalesce("n", "o")).when(by < "b", F.coalesce("o", F.reverse("n"))).otherwise(F.reverse(F.coalesce("n", "o"))).alias("sha256"))


def manifest_states(spark, sf_dir):
    entries = manifest.build(_payload(spark, sf_dir), _tree(spark, sf_dir))
    return manifest.states(entries, _half_applied(spark, sf_dir))


def manifest_overall(spark, sf_dir):
    return manifest.overall(manifest_states(spark, sf_dir))


def manifest_preflight(spark, sf_dir):
    entries = manifest.build(_payload(spark, sf_dir), _tree(spark, sf_dir))
    return manifest.preflight(entries, _payload(spark, sf_dir))


def tree_differences(spark, sf_dir):
    free = _payload(spark, sf_dir).where(F.col("rel").like("%/sc0000/%"))
    return documented.tree_diff(_tree(spark, sf_dir), _payload(spark, sf_dir), free)


def regenerated(spark, sf_dir):
    newest = lambda t, k: table(spark, sf_dir, t).groupBy(k.alias("segment_id")).agg(F.max(F.struct("updated_at", "row_id", "source", "target")).alias("b")).select("segment_id", "b.source", "b.target")
    return documented.regeneration_diff(newest("seg_previous", F.lower(F.trim("segment_id"))), newest("seg_current", F.col("segment_id")))


def slot_budgets(spark, sf_dir):
    rows = table(spark, sf_dir, "seg_current").select(F.col("row_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"), F.lit(64).alias("slot_size"))
    return documented.slot_budget(rows).select("id", F.col("used").cast("long").alias("used"), "fits", "same_lines")


def progress(spark, sf_dir):
    """Order lines as progress traces: quantities per order, in line order."""
    trace = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("step"), F.col("l_quantity").alias("percent"))
    return documented.progress_check(trace)


def collisions(spark, sf_dir):
    own = table(spark, sf_dir, "seg_previous").select(F.col("segment_id").alias("path")).distinct()
    return documented.path_hazards(own)


QUERIES = {
    f.__name__: f
    for f in (
        path_facts, audit_signals, audit_engines, audit_totals, audit_extensions, audit_categories, audit_probes, script_lines, script_parts, script_extract, script_round_trip, slots_scan, slots_changed,
        images_inventory, images_compared, manifest_entries, manifest_states, manifest_overall, manifest_preflight, tree_differences, regenerated, slot_budgets, progress, collisions,
    )
}

_CAT = "CASE " + " ".join(f"WHEN e IN ({', '.join(repr(x) for x in own)}) THEN '{name}'" for name, own in paths.CATEGORIES.items()) + " END"


def _signal_sql(engines: tuple = audit.ENGINES) -> str:
    parts = []
    for e in engines:
        name = e.name.replace("'", "''")
        for group, patterns in e.signals:
            tests = " OR ".join(f"p GLOB '{x.lower()}' OR b GLOB '{x.lower()}'" for x in patterns)
            parts.append(f"SELECT '{name}' AS engine, '{group}' AS signal_group, p AS path FROM x WHERE {tests}")
    return "WITH x AS (SELECT DISTINCT lower(path) AS p, regexp_extract(lower(path), '[^/]*$') AS b FROM script_files), m AS (" + " UNION ALL ".join(parts) + ")"


_BREAK = "\\r\\n|[\\x0a\\x0b\\x0c\\x0d\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
_SP = "[\\s\\x1c-\\x1f\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_LINES = f"""a AS (SELECT path, regexp_extract_all(text, '[^\\x0a\\x0b\\x0c\\x0d\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]*(?:{_BREAK})|[^\\x0a\\x0b\\x0c\\x0d\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]+$', 0) AS ws FROM d),
l AS (SELECT path, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM a),
b AS (SELECT path, n, regexp_replace(w, '(\\r\\n|\\r|\\n)$', '') AS body, regexp_extract(w, '(\\r\\n|\\r|\\n)$') AS nl FROM l)"""
_PAY = """c AS (SELECT replace(segment_id, ':', '/') || '.txt' AS rel, arg_max(source, row_id) AS t FROM seg_current WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT replace(trim(lower(segment_id)), ':', '/') || '.txt' AS rel, arg_max(source, row_id) AS t FROM seg_previous WHERE source IS NOT NULL GROUP BY 1),
pay AS (SELECT rel, sha256(t) AS sha256, length(t) AS size FROM c), tree AS (SELECT rel, sha256(t) AS sha256, length(t) AS size FROM p),
ent AS (SELECT a.rel, CASE WHEN o.rel IS NULL THEN 'add' ELSE 'replace' END AS action, o.sha256 AS original_sha256, o.size AS original_size, a.sha256 AS new_sha256, a.size AS new_size FROM pay a LEFT JOIN tree o ON a.rel = o.rel)"""
_STATES = f"""WITH {_PAY}, both_ AS (SELECT coalesce(p.rel, t.rel) AS rel, p.sha256 AS n, t.sha256 AS o, left(coalesce(p.sha256, t.sha256), 1) AS k FROM pay p FULL JOIN tree t ON p.rel = t.rel),
now AS (SELECT CASE WHEN k >= 'd' THEN 'other/' ELSE '' END || rel AS rel, CASE WHEN k < '6' THEN coalesce(n, o) WHEN k < 'b' THEN coalesce(o, reverse(n)) ELSE reverse(coalesce(n, o)) END AS h FROM both_),
st AS (SELECT e.rel, CASE WHEN h = new_sha256 THEN 'applied' WHEN action = 'replace' AND h = original_sha256 THEN 'clean' WHEN action = 'add' AND h IS NULL THEN 'clean' ELSE 'drift' END AS state FROM ent e LEFT JOIN now USING (rel))"""
_BMP = lambda g: f"(SELECT CASE WHEN p_partkey % 7 = {g} THEN 'other{g}/' ELSE '' END || p_partkey || '.BMP' AS path, p_size + CASE WHEN p_partkey % 5 = {g} THEN 1 ELSE 0 END AS width FROM part)"
_TWO = "(length(regexp_replace({0}, '[^\\x00-\\x7f]', '', 'g')) + 2 * (length({0}) - length(regexp_replace({0}, '[^\\x00-\\x7f]', '', 'g'))))"
ORACLES = {
    "path_facts": f"SELECT path, lower(path) AS normal, e AS suffix, {_CAT} AS category, false AS safe FROM (SELECT path, lower(regexp_extract(path, '[^./](\\.[^./]+)$', 1)) AS e FROM script_files)",
    "audit_signals": _signal_sql() + " SELECT * FROM (SELECT engine, signal_group, path, row_number() OVER (PARTITION BY engine, signal_group ORDER BY path) AS rank FROM (SELECT DISTINCT * FROM m)) WHERE rank <= 5",
    "audit_engines": _signal_sql()
    + """, g AS (SELECT engine, count(DISTINCT signal_group) AS n, array_to_string(list_sort(list(DISTINCT signal_group)), ' ') AS signal_groups FROM m GROUP BY 1)
SELECT engine, CASE WHEN n >= 2 THEN 'candidate' ELSE 'weak-candidate' END AS classification, round(least(0.95, 0.40 + 0.18 * n), 2)::DOUBLE AS confidence, signal_groups FROM g""",
    "audit_totals": "SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE is_link) AS links FROM script_files",
    "audit_extensions": "SELECT '.' || lower(extension) AS extension, count(*) AS files FROM script_files GROUP BY 1 ORDER BY files DESC, min(path) LIMIT 20",
    "audit_categories": f"""WITH x AS (SELECT path, '.' || lower(extension) AS e FROM script_files), k AS (SELECT path, {_CAT} AS category FROM x),
r AS (SELECT category, path, row_number() OVER (PARTITION BY category ORDER BY path) AS n FROM k WHERE category IS NOT NULL),
every AS (SELECT unnest([{', '.join(repr(c) for c in paths.CATEGORIES)}]) AS category)
SELECT e.category, count(r.path) AS files, coalesce(string_agg(r.path, ' ' ORDER BY r.n) FILTER (WHERE r.n <= 12), '') AS examples FROM every e LEFT JOIN r USING (category) GROUP BY 1""",
    "script_lines": f"WITH d AS (SELECT doc_id::VARCHAR AS path, text FROM documents), {_LINES} SELECT path, count(*) AS lines, sum(length(body))::BIGINT AS body_chars, count(*) FILTER (WHERE nl = '') AS open_lines FROM b GROUP BY path",
    "script_parts": f"""SELECT row_id, CASE WHEN s <> '' AND NOT regexp_matches(s, '^[;*@]') AND NOT (starts_with(s, '[') AND ends_with(s, ']')) THEN s END AS tag_line,
CASE WHEN s <> '' AND NOT regexp_matches(s, '^[;*@]') AND regexp_matches(s, '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]') THEN regexp_extract(chr(12288) || source, '^{_SP}*') END AS text_prefix,
CASE WHEN q THEN source END AS quoted, CASE WHEN q THEN '"  # x' END AS quoted_suffix FROM (SELECT row_id, source, {sql.strip("source")} AS s, regexp_full_match(source, '(\\\\.|[^"\\\\])*') AS q FROM seg_current)""",
    "script_extract": f"""WITH d AS (SELECT doc_id || '.ks' AS path, text FROM documents WHERE text IS NOT NULL), {_LINES},
x AS (SELECT *, {sql.strip("body")} AS s FROM b)
SELECT path || ':' || n AS segment_id, s AS source, sha256(s) AS source_sha256, sha256(body) AS line_sha256, regexp_extract(body, '^{_SP}*') AS prefix, substr(body, length(regexp_extract(body, '^{_SP}*')) + length(s) + 1) AS suffix,
replace(replace(nl, chr(13), '\\r'), chr(10), '\\n') AS newline FROM x WHERE s <> '' AND NOT regexp_matches(s, '^[;*@]') AND NOT (starts_with(s, '[') AND ends_with(s, ']'))""",
    "script_round_trip": f"""WITH d AS (SELECT doc_id || '.ks' AS path, text FROM documents WHERE text IS NOT NULL), {_LINES}, x AS (SELECT path, {sql.strip("body")} AS s FROM b)
SELECT DISTINCT path, true AS identical FROM x WHERE s <> '' AND NOT regexp_matches(s, '^[;*@]') AND NOT (starts_with(s, '[') AND ends_with(s, ']'))""",
    "slots_scan": f"""SELECT p_partkey::VARCHAR AS path, i AS index, ({_HEAD} + i * {_SLOT})::BIGINT AS offset, length(t)::BIGINT AS used_bytes, {_SLOT - 1}::BIGINT AS capacity, t AS text, true AS valid
FROM (SELECT p_partkey, 0::BIGINT AS i, p_name AS t FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part)""",
    "slots_changed": "SELECT p_partkey::VARCHAR AS path, 0::BIGINT AS index FROM part",
    "images_inventory": f"SELECT path, 'BMP' AS format, width::BIGINT AS width, 10::BIGINT AS height, true AS alpha, NULL::VARCHAR AS error FROM {_BMP(0)}",
    "images_compared": f"""SELECT CASE WHEN b.path IS NULL THEN 'FAIL' WHEN a.path IS NULL THEN 'WARN' WHEN a.width <> b.width THEN 'FAIL' ELSE 'WARN' END AS severity,
CASE WHEN b.path IS NULL THEN 'missing-localized-asset' WHEN a.path IS NULL THEN 'extra-localized-asset' WHEN a.width <> b.width THEN 'geometry-changed' ELSE 'unchanged-asset' END AS id,
coalesce(a.path, b.path) AS path FROM {_BMP(0)} a FULL JOIN {_BMP(1)} b ON a.path = b.path""",
    "manifest_entries": f"WITH {_PAY} SELECT * FROM ent",
    "manifest_states": _STATES + " SELECT rel, state FROM st",
    "manifest_overall": _STATES
    + """, n AS (SELECT count(*) FILTER (WHERE state = 'applied') AS applied, count(*) FILTER (WHERE state = 'clean') AS clean, count(*) FILTER (WHERE state = 'drift') AS drift FROM st)
SELECT CASE WHEN clean + drift = 0 THEN 'APPLIED' WHEN applied + drift = 0 THEN 'CLEAN' ELSE 'MIXED/DRIFT' END AS overall, applied, clean, drift FROM n""",
    "manifest_preflight": f"""WITH {_PAY} SELECT * FROM (SELECT e.rel, CASE WHEN action = 'replace' AND n.rel IS NULL THEN 'missing original' WHEN action = 'replace' AND n.sha256 <> original_sha256 THEN 'baseline mismatch'
WHEN action = 'add' AND n.rel IS NOT NULL THEN 'target of an addition exists' END AS problem FROM ent e LEFT JOIN pay n ON e.rel = n.rel) WHERE problem IS NOT NULL""",
    "tree_differences": f"""WITH {_PAY} SELECT * FROM (SELECT coalesce(t.rel, n.rel) AS rel, CASE WHEN t.rel IS NULL THEN 'added' WHEN n.rel IS NULL THEN 'removed' WHEN t.sha256 <> n.sha256 THEN
CASE WHEN n.rel LIKE '%/sc0000/%' THEN 'declared-mutable' ELSE 'immutable-changed' END END AS change FROM tree t FULL JOIN pay n ON t.rel = n.rel) WHERE change IS NOT NULL""",
    "regenerated": """WITH o AS (SELECT lower(trim(segment_id)) AS segment_id, source, target FROM seg_previous QUALIFY row_number() OVER (PARTITION BY lower(trim(segment_id)) ORDER BY updated_at DESC, row_id DESC) = 1),
n AS (SELECT segment_id, target FROM seg_current QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY updated_at DESC, row_id DESC) = 1)
SELECT coalesce(o.segment_id, n.segment_id) AS segment_id, CASE WHEN o.segment_id IS NULL THEN 'new' WHEN n.segment_id IS NULL THEN CASE WHEN o.target IS NOT DISTINCT FROM o.source THEN 'omitted-no-op' ELSE 'omitted' END
WHEN o.target IS NOT DISTINCT FROM n.target THEN 'kept' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.segment_id = n.segment_id""",
    "slot_budgets": "SELECT row_id AS id, " + _TWO.format("coalesce(target, '')") + " AS used, " + _TWO.format("coalesce(target, '')") + " <= 64 AS fits, " + sql.count("coalesce(source, '')", "\n") + " = " + sql.count("coalesce(target, '')", "\n") + " AS same_lines FROM seg_current",
    "progress": """WITH x AS (SELECT l_orderkey AS job, l_quantity AS q, row_number() OVER w AS k, lag(l_quantity) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
SELECT job, arg_min(q, k) = 1 AND arg_max(q, k) = 100 AND NOT bool_or(coalesce(q < p, false)) AS ok FROM x GROUP BY job""",
    "collisions": """WITH x AS (SELECT DISTINCT segment_id AS path FROM seg_previous), k AS (SELECT lower(path) AS k FROM x GROUP BY 1 HAVING count(*) > 1)
SELECT path, 'case-collision' AS hazard FROM x WHERE lower(path) IN (SELECT k FROM k) UNION ALL SELECT path, 'unsafe' FROM x WHERE contains(path, ':') OR starts_with(path, '/') OR path = '' OR regexp_matches(path, '(^|/)\\.\\.(/|$)')""",
}
