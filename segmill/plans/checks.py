"""Queries of the documented checks, image formats and slot comparisons, with their SQL.

Bytes are built from the tables by rules that the SQL states in its own terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.operators import adapter, audit, documented, images, slots
from segmill.plans import sql, trees
from segmill.session import table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type", "p_size")


def _bytes(*values: bytes):
    return F.array(*(F.lit(bytearray(v)) for v in values))


def _pick(values, k):
    return F.element_at(values, (k % F.size(values) + 1).cast("int"))


_HEADS = (*(m for m, _ in documented.MAGIC if m != b"DX"), b"DX\x03\x00", b"DX11", b"MZ\x90 LiveMaker", b"MZ\x90", b"text")


def magic_kinds(spark, sf_dir):
    """Every signature, an executable with and without its marker, a short signature before text, and plain text, in turn."""
    content = F.concat(_pick(_bytes(*_HEADS), F.col("k")), F.encode("p_name", "UTF-8"))
    return _part(spark, sf_dir).select("k", documented.magic_kind(content).alias("kind"))


def named_pairs(spark, sf_dir):
    """Folders by part type; some hold one of the two files, some both."""
    name = _pick(F.array(F.lit("Scene.pck"), F.lit("Gameexe.dat"), F.lit("other.dat")), F.col("k"))
    return documented.named_pairs(_part(spark, sf_dir).select(F.concat("p_type", F.lit("/"), "p_size", F.lit("/"), name).alias("path")))


_HEX = lambda c: F.hex(F.encode(c, "UTF-8"))


def _prefixed(text):
    size = F.lpad(F.hex(F.octet_length(F.encode(text, "UTF-8"))), 2, "0")
    return F.concat(size, F.lit("000000"), _HEX(text), F.lit("00"))


def prefixed_strings(spark, sf_dir):
    """A zero byte, the name, a string of one letter, a string with a control character, and the type, each with its length before it."""
    digits = F.concat(F.lit("00"), _prefixed(F.col("p_name")), _prefixed(F.lit("x")), F.lit("03000000" + "610162" + "00"), _prefixed(F.col("p_type")))
    files = _part(spark, sf_dir).select(F.col("k").cast("string").alias("path"), F.unhex(digits).alias("content"))
    return documented.prefixed_strings(files).select("path", F.col("offset").cast("long").alias("offset"), "text")


def _newest(spark, sf_dir, name, key):
    best = table(spark, sf_dir, name).groupBy(key.alias("segment_id")).agg(F.max(F.struct("updated_at", "row_id", "source", "target")).alias("b"))
    return best.select("segment_id", "b.source", "b.target")


def completeness(spark, sf_dir):
    return documented.completeness(_newest(spark, sf_dir, "seg_previous", F.lower(F.trim("segment_id"))), _newest(spark, sf_dir, "seg_current", F.col("segment_id")), ["segment_id"])


def mirrored_scripts(spark, sf_dir):
    scene = lambda df: df.select(F.substring_index("segment_id", ":", 1).alias("scene"), F.substring_index("segment_id", ":", -1).alias("line"), "source")
    return documented.sequences_equal(scene(_newest(spark, sf_dir, "seg_previous", F.lower(F.trim("segment_id")))), scene(_newest(spark, sf_dir, "seg_current", F.col("segment_id"))), "scene", "line", "source")


def duplicate_groups(spark, sf_dir):
    """Groups of the catalog but for those whose source a review names."""
    named = table(spark, sf_dir, "review_rows").select(F.col("previous_source").alias("source")).where("source IS NOT NULL").distinct()
    own = documented.inconsistent_duplicates(table(spark, sf_dir, "seg_current"), named)
    return own.select(F.sha2("source", 256).alias("source_sha256"), "variants")


def _profiles(spark, sf_dir):
    return _part(spark, sf_dir).select((F.col("k") % 5).alias("profile"), F.floor(F.col("k") / 5).cast("string").alias("rel"), F.sha2("p_name", 256).alias("sha256"))


def baseline(spark, sf_dir):
    """Five profiles over all parts; the tree is the fourth."""
    own = _profiles(spark, sf_dir)
    return documented.baseline_of(own, own.where("profile = 3").select("rel", "sha256"))


def baseline_mixed(spark, sf_dir):
    """A tree that has files of two profiles and is neither."""
    own = _profiles(spark, sf_dir)
    return documented.baseline_of(own, own.where("profile IN (1, 3)").groupBy("rel").agg(F.max("sha256").alias("sha256")))


def category_audit(spark, sf_dir):
    return documented.category_audit(table(spark, sf_dir, "seg_current").select(F.col("feed").alias("category"), F.coalesce("target", F.lit("")).alias("text")), "ascii")


def byte_identity(spark, sf_dir):
    return documented.byte_identical(trees._tree(spark, sf_dir), trees._payload(spark, sf_dir))


def _ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") * 7) % 400
    return rows.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


def range_overlaps(spark, sf_dir):
    return documented.overlapping_ranges(_ranges(spark, sf_dir))


def id_repeats(spark, sf_dir):
    return documented.repeated_ids(table(spark, sf_dir, "seg_current").select("segment_id"), "segment_id")


def _offsets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), ((F.col("l_suppkey") * 13) % 400).alias("at"))


def stray_differences(spark, sf_dir):
    return documented.differing_outside(_offsets(spark, sf_dir), _ranges(spark, sf_dir))


def occurrences(spark, sf_dir):
    """Old wording that must be gone and new wording that must be there once, in every document."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    expected = texts.select("path", F.lit("the ").alias("old"), F.lit("return").alias("new"), F.lit(1).cast("long").alias("times"))
    return documented.occurrence_check(texts, expected)


def progress_traces(spark, sf_dir):
    """Every order's lines as a trace: mostly 1 first and 100 last, quantities between them."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax").alias("step"))
    last = rows.groupBy("l_orderkey").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    first = F.when(F.col("step.l_tax") < 0.07, 1.0).otherwise(3.0)
    percent = F.when(F.col("step") == F.col("last"), F.when(F.col("step") == F.col("first"), first).otherwise(100.0)).when(F.col("step") == F.col("first"), first).otherwise(F.col("step.l_quantity"))
    return documented.progress_check(rows.join(last, "l_orderkey").select(F.col("l_orderkey").alias("job"), "step", percent.alias("percent")))


def stray_branches(spark, sf_dir):
    """Branches of every order to line numbers, of which the order has some."""
    rows = table(spark, sf_dir, "lineitem")
    path = F.col("l_orderkey").alias("path")
    return documented.stray_targets(rows.select(path, (F.col("l_quantity") % 9 + 1).cast("int").alias("target")), rows.select(path, F.col("l_linenumber").alias("start")))


def fingerprints(spark, sf_dir):
    """The digits of customers against those of the suppliers of their nation."""
    digits = lambda c: F.encode(F.substring_index(c, "#", -1), "UTF-8").alias("content")
    frames = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame"), F.col("c_nationkey").alias("place"), digits("c_name"))
    prints = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("print"), F.col("s_nationkey").alias("place"), digits("s_name"))
    return documented.fingerprint_matrix(frames, prints).select("frame", "print", "matches", F.col("first_mismatch").cast("long").alias("first_mismatch"))


_PAYLOADS = (b"\x81\x79\xb4\xd3\xcd\xb7\x81\x7a", b"\x81\x79\xff\x81\x7a", b"\x81\x79\x81\x7a", b"\x81\x79\xb4\xd3", b"\xb4\xd3\x81\x7a", b"\x81\x79")


def wrappers(spark, sf_dir):
    """Wrapped text, a wrapped byte that isn't text, an empty payload, halves of the wrapper."""
    return _part(spark, sf_dir).select("k", documented.wrapped(_pick(_bytes(*_PAYLOADS), F.col("k"))).alias("wrapped"))


def composed_choices(spark, sf_dir):
    rows = table(spark, sf_dir, "seg_current").select(F.col("row_id").alias("id"), F.lit("<").alias("open"), F.col("target").alias("translation"), F.lit(">").alias("close"))
    return documented.composed_check(rows, "ascii")


def pixel_deltas(spark, sf_dir):
    """Two pixels a part; one colour is brighter by the remainder of its number, and some lose their alpha."""
    two = lambda n: F.lpad(F.hex(n), 2, "0")
    before = F.concat(two(F.col("p_size")), F.lit("0A14FF" + "01020380"))
    after = F.concat(two(F.col("p_size") + F.col("k") % 7), F.lit("0A14FF" + "010203"), F.when(F.col("k") % 5 == 0, "7F").otherwise("80"))
    own = documented.pixel_delta(_part(spark, sf_dir).select(F.col("k").cast("string").alias("path"), F.unhex(before).alias("before"), F.unhex(after).alias("after")))
    return own.select("path", "same_alpha", F.col("max_delta").cast("long").alias("max_delta"), F.round("mean_delta", 9).alias("mean_delta"))


def archive_readback(spark, sf_dir):
    name = lambda df: df.select(F.col("rel").alias("member"), "sha256")
    return documented.readback(name(trees._payload(spark, sf_dir)), name(trees._tree(spark, sf_dir)))


def retention(spark, sf_dir):
    """Parts depend on the part of a third of their number; those of one size are released."""
    own = _part(spark, sf_dir)
    return documented.retained(own.select(F.col("k").alias("node"), F.floor(F.col("k") / 3).alias("input")), own.where("p_size = 50").select(F.col("k").alias("node")))


def path_collisions(spark, sf_dir):
    """Files of both systems' segments, whose ids differ in case now and then; those of one feed lead out of the tree."""
    path = F.concat(F.when(F.col("feed") == "heath", "../").otherwise(""), F.replace(F.trim("segment_id"), F.lit(":"), F.lit("/")), F.lit(".txt"))
    both = table(spark, sf_dir, "seg_previous").select(path.alias("path")).union(table(spark, sf_dir, "seg_current").select(path.alias("path")))
    return documented.path_hazards(both.distinct())


def audit_wider(spark, sf_dir):
    """Signals of the wider matrix, over the files of the inventory and names of the matrix' own kinds."""
    return audit.evidence(audit.signals(_wider_inventory(spark, sf_dir), audit.WIDER_ENGINES)).select("engine", "signal_group", "path", F.col("rank").cast("long").alias("rank"))


_WIDER_NAMES = ("root.pfs", "a.AST", "x.ypf", "pac/y.bin", "ysbin/s.ybn", "b.int", "c.cst", "list.bin", "d.cpz", "data/map.wolf", "GuruguruSMF4.dll", "rio.arc", "AdvHD.exe", "www/data/Map1.json", "package.json", "RGSS301.dll", "Game.rgss3a", "e.lsb", "malie.exe", "f.libp", "System/a.dat", "g.pac")


def _wider_inventory(spark, sf_dir):
    name = _pick(F.array(*map(F.lit, _WIDER_NAMES)), F.col("k"))
    made = _part(spark, sf_dir).select(F.concat("p_size", F.lit("/"), name).alias("path")).unionByName(_part(spark, sf_dir).select(name.alias("path")).distinct())
    return table(spark, sf_dir, "script_files").select("path").unionByName(made)


def audit_plan(spark, sf_dir):
    """The plan for the best candidate of the inventory."""
    plan = audit.plan(audit.detect(trees.inventory(spark, sf_dir)))
    return spark.createDataFrame([(plan["engine"], plan["evidence_status"], plan["adapter"])], "engine string, evidence_status string, adapter string")


_SLOT, _HEAD = 64, 4


def _slot_builds(spark, sf_dir, changed: bool):
    """Two slots a part. In the changed build, by turns: nothing, another marker, a byte behind the slots, one byte more, no terminator."""
    turn = F.col("k") % 5 if changed else F.lit(0)
    slot = lambda text: F.rpad(F.encode(text, "UTF-8"), _SLOT, F.lit(bytearray(1)))
    full = F.encode(F.rpad(F.lit(""), _SLOT, "y"), "UTF-8")
    first = F.when(turn == 4, full).otherwise(slot(F.concat("p_name", F.when(turn == 1, "@b(1)").otherwise("@a(1)"))))
    tail = F.when(turn == 2, F.lit(bytearray(b"\x01"))).when(turn == 3, F.lit(bytearray(2))).otherwise(F.lit(bytearray(1)))
    return _part(spark, sf_dir).select(F.col("k").cast("string").alias("path"), F.concat(F.lit(bytearray(_HEAD)), first, slot(F.col("p_type")), tail).alias("content"))


def slots_compared(spark, sf_dir):
    own = slots.compare(_slot_builds(spark, sf_dir, False), _slot_builds(spark, sf_dir, True), _HEAD, _SLOT, 2, "utf-8")
    return own.select("path", "id", F.col("slot").cast("long").alias("slot"))


def slots_summary(spark, sf_dir):
    files = _slot_builds(spark, sf_dir, True)
    own = slots.scan_summary(files, slots.scan(files, _HEAD, _SLOT, 2, "utf-8"), _HEAD, _SLOT, 2)
    return own.select("path", "status", F.col("file_size").cast("long").alias("file_size"), F.col("invalid_slots").cast("long").alias("invalid_slots"))


def _image_files(spark, sf_dir, changed: bool):
    """An image a part, by turns PNG (every fourth with frames), GIF of one to three frames, JPEG, BMP and one that isn't any.

    The changed build differs by turns in its size, alpha, frames or format, and has upper-case and other names.
    """
    k, turn = F.col("k"), (F.col("k") % 11 if changed else F.lit(0))
    byte = lambda n, width=2: F.lpad(F.hex(n), width, "0")
    wide = F.col("p_size") + F.when(turn == 1, 1).otherwise(0)
    frames = k % 3 + 1 + F.when(turn == 3, 1).otherwise(0)
    color = F.when(turn == 2, "02").otherwise("06")
    control = F.when(k % 4 == 0, F.concat(F.lit("00000008" + "6163544C"), byte(frames, 8), F.lit("00000000" + "00000000"))).otherwise("")
    png = F.concat(F.lit("89504E470D0A1A0A" + "0000000D" + "49484452"), byte(wide, 8), F.lit("0000000A" + "08"), color, F.lit("000000" + "00000000"), control, F.lit("00000000" + "49454E44" + "AE426082"))
    gif = F.concat(F.lit("474946383961"), byte(wide), F.lit("00" + "0A00" + "70" + "00" + "00"), F.repeat(F.lit("2C" + "00" * 8 + "00" + "02" + "01" + "44" + "00"), frames.cast("int")), F.lit("3B"))
    jpeg = F.concat(F.lit("FFD8" + "FFE0" + "0004" + "4A46" + "FFC0" + "0011" + "08" + "000A" + "00"), byte(wide), F.lit("03" + "01220002110103110100" + "FFD9"))
    bmp = F.concat(F.lit("424D" + "00" * 12 + "28000000"), byte(wide), F.lit("000000" + "0A000000" + "0100" + "2000" + "00" * 24))
    kinds = F.array(png, gif, jpeg, bmp, F.lit("00FF"))
    suffix = _pick(F.array(*map(F.lit, (".png", ".gif", ".jpg", ".bmp", ".jpeg"))), k)
    name = F.concat(F.when(turn == 6, "other").otherwise(""), F.col("k"), F.when(turn == 4, F.upper(suffix)).otherwise(suffix))
    return _part(spark, sf_dir).select(name.alias("path"), F.unhex(_pick(kinds, F.when(turn == 5, k + 1).otherwise(k))).alias("content"))


def images_formats(spark, sf_dir):
    own = images.inventory(_image_files(spark, sf_dir, False))
    return own.select("path", "format", *(F.col(c).cast("long").alias(c) for c in ("width", "height", "frames")), "alpha", "animated", F.col("error").isNotNull().alias("failed"))


def images_differences(spark, sf_dir):
    return images.compare(images.inventory(_image_files(spark, sf_dir, False)), images.inventory(_image_files(spark, sf_dir, True))).select("severity", "id", "path")


def script_problems(spark, sf_dir):
    """Translations of all documents' lines of which, by turns of their place, one breaks a rule."""
    files = trees._scripts(spark, sf_dir)
    own = adapter.extract(files, "kirikiri")
    turn = F.col("line") % 9
    broken = own.select(
        F.when(turn == 1, F.concat(F.lit("../"), "path")).when(turn == 2, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path"), "segment_id", "engine",
        F.when(turn == 3, F.col("line") + 1_000_000).otherwise(F.col("line")).alias("line"), F.when(turn == 4, F.concat("source", F.lit("!"))).otherwise(F.col("source")).alias("source"), "source_sha256", "line_sha256", "prefix", "suffix", "encoding", "bom", "newline",
        F.when(turn == 5, F.lit("")).when(turn == 6, F.lit("a\nb")).otherwise(F.lit("ok")).alias("target"),
    )
    return adapter.problems(files, broken).select("segment_id", "problem")


QUERIES = {
    f.__name__: f
    for f in (
        magic_kinds, named_pairs, prefixed_strings, completeness, mirrored_scripts, duplicate_groups, baseline, baseline_mixed, category_audit, byte_identity, range_overlaps, id_repeats, stray_differences,
        occurrences, progress_traces, stray_branches, fingerprints, wrappers, composed_choices, pixel_deltas, archive_readback, retention, path_collisions, audit_wider, audit_plan, slots_compared, slots_summary,
        images_formats, images_differences, script_problems,
    )
}

_KINDS = (*(kind for m, kind in documented.MAGIC if m != b"DX"), "Wolf RPG Editor", None, "LiveMaker", "exe", None)
_LIST = lambda values: "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"
_PICK = lambda values, k="p_partkey": f"{_LIST(values)}[{k} % {len(values)} + 1]"
_NEW = """o AS (SELECT lower(trim(segment_id)) AS segment_id, source, target FROM seg_previous QUALIFY row_number() OVER (PARTITION BY lower(trim(segment_id)) ORDER BY updated_at DESC, row_id DESC) = 1),
n AS (SELECT segment_id, source, target FROM seg_current QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY updated_at DESC, row_id DESC) = 1)"""
_RANGES = "rg AS (SELECT l_orderkey::VARCHAR AS path, l_linenumber::BIGINT AS id, (l_partkey * 7) % 400 AS s, (l_partkey * 7) % 400 + l_quantity::BIGINT AS e FROM lineitem)"
_BASE = "pr AS (SELECT p_partkey % 5 AS profile, (p_partkey // 5)::VARCHAR AS rel, sha256(p_name) AS h FROM part)"
_FIT = "hit AS (SELECT profile, bool_and(coalesce(pr.h = t.h, false)) AS ok FROM pr LEFT JOIN t USING (rel) GROUP BY profile) SELECT CASE WHEN count(*) FILTER (WHERE ok) = 1 THEN 'supported' ELSE 'unsupported' END AS status, CASE WHEN count(*) FILTER (WHERE ok) = 1 THEN min(profile) FILTER (WHERE ok) END AS profile FROM hit"
_EXT = "['.png', '.gif', '.jpg', '.bmp', '.jpeg'][k % 5 + 1]"


def _image_sql(name: str, changed: bool) -> str:
    t = "p_partkey % 11" if changed else "0"
    return f"""{name} AS (SELECT CASE WHEN t = 6 THEN 'other' ELSE '' END || k || CASE WHEN t = 4 THEN upper({_EXT}) ELSE {_EXT} END AS path, k, t, (k + CASE WHEN t = 5 THEN 1 ELSE 0 END) % 5 AS kind, k % 5 AS named, p_size + CASE WHEN t = 1 THEN 1 ELSE 0 END AS width,
 k % 3 + 1 + CASE WHEN t = 3 THEN 1 ELSE 0 END AS n FROM (SELECT p_partkey AS k, {t} AS t, p_size FROM part)),
{name}f AS (SELECT path, k, width, 10 AS height, kind, kind <> (CASE WHEN named = 4 THEN 2 ELSE named END) OR kind = 4 AS failed, ['PNG', 'GIF', 'JPEG', 'BMP'][kind + 1] AS format,
 CASE kind WHEN 0 THEN t <> 2 WHEN 3 THEN true ELSE false END AS alpha, CASE kind WHEN 0 THEN CASE WHEN k % 4 = 0 THEN n ELSE 1 END WHEN 1 THEN n ELSE 1 END AS frames,
 CASE kind WHEN 0 THEN k % 4 = 0 WHEN 1 THEN n > 1 ELSE false END AS animated, t FROM {name})"""


_WIDE = trees._signal_sql(audit.WIDER_ENGINES).replace(
    "FROM script_files)",
    f"FROM (SELECT path FROM script_files UNION ALL SELECT p_size || '/' || {_PICK(_WIDER_NAMES)} FROM part UNION ALL SELECT DISTINCT {_PICK(_WIDER_NAMES)} FROM part))",
    1,
)
ORACLES = {
    "magic_kinds": f"SELECT p_partkey AS k, {_PICK(_KINDS)} AS kind FROM part",
    "named_pairs": f"SELECT folder, 'SiglusEngine' AS kind FROM (SELECT lower(p_type || '/' || p_size || '/') AS folder, {_PICK(('Scene.pck', 'Gameexe.dat', 'other.dat'))} AS f FROM part) WHERE f <> 'other.dat' GROUP BY folder HAVING count(DISTINCT f) = 2",
    "prefixed_strings": """SELECT p_partkey::VARCHAR AS path, o::BIGINT AS offset, t AS text FROM (
SELECT p_partkey, 1 AS o, p_name AS t FROM part UNION ALL SELECT p_partkey, 6 + length(p_name), 'x' FROM part UNION ALL SELECT p_partkey, 20 + length(p_name), p_type FROM part)""",
    "completeness": f"""WITH {_NEW} SELECT coalesce(o.segment_id, n.segment_id) AS segment_id, CASE WHEN o.segment_id IS NULL THEN 'new-candidate' WHEN n.segment_id IS NULL THEN 'not-found' WHEN o.source IS NOT DISTINCT FROM n.source THEN 'known-match' ELSE 'source-mismatch' END AS status
FROM o FULL JOIN n ON o.segment_id = n.segment_id""",
    "mirrored_scripts": f"""WITH {_NEW} SELECT split_part(coalesce(o.segment_id, n.segment_id), ':', 1) AS scene, bool_and(o.segment_id IS NOT NULL AND n.segment_id IS NOT NULL AND o.source IS NOT DISTINCT FROM n.source) AS equal FROM o FULL JOIN n ON o.segment_id = n.segment_id GROUP BY 1""",
    "duplicate_groups": "SELECT sha256(source) AS source_sha256, count(DISTINCT target) AS variants FROM seg_current WHERE source IS NOT NULL AND source NOT IN (SELECT previous_source FROM review_rows WHERE previous_source IS NOT NULL) GROUP BY source HAVING count(DISTINCT target) > 1",
    "baseline": f"WITH {_BASE}, t AS (SELECT rel, h FROM pr WHERE profile = 3), {_FIT}",
    "baseline_mixed": f"WITH {_BASE}, t AS (SELECT rel, max(h) AS h FROM pr WHERE profile IN (1, 3) GROUP BY rel), {_FIT}",
    "category_audit": f"""SELECT feed AS category, count(*) AS rows, count(*) FILTER (WHERE regexp_matches(coalesce(target, ''), '[^\\x00-\\x7f]')) AS unencodable, count(*) FILTER (WHERE regexp_matches({sql.bare("coalesce(target, '')")}, '[\\x{{3040}}-\\x{{30ff}}]')) AS kana FROM seg_current GROUP BY 1""",
    "byte_identity": f"WITH {trees._PAY} SELECT t.rel, t.sha256 = p.sha256 AS identical FROM tree t JOIN pay p ON t.rel = p.rel",
    "range_overlaps": f"WITH {_RANGES}, x AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg) SELECT path, id, s AS start FROM x WHERE reach > s",
    "id_repeats": "SELECT segment_id, count(*) AS times FROM seg_current GROUP BY 1 HAVING count(*) > 1",
    "stray_differences": f"WITH {_RANGES}, d AS (SELECT l_orderkey::VARCHAR AS path, (l_suppkey * 13) % 400 AS at_byte FROM lineitem) SELECT d.path, d.at_byte AS at FROM d WHERE NOT EXISTS (SELECT 1 FROM rg WHERE rg.path = d.path AND rg.s <= d.at_byte AND rg.e > d.at_byte)",
    "occurrences": f"WITH x AS (SELECT doc_id::VARCHAR AS path, {sql.count('coalesce(text, chr(32))', 'the ')} // 4 AS o, {sql.count('coalesce(text, chr(32))', 'return')} // 6 AS n FROM documents) SELECT path, o::BIGINT AS old_count, n::BIGINT AS new_count, o = 0 AND n = 1 AS ok FROM x",
    "progress_traces": """WITH x AS (SELECT l_orderkey AS job, l_quantity AS q, l_tax, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax)),
y AS (SELECT job, k, CASE WHEN k = 1 THEN CASE WHEN l_tax < 0.07 THEN 1 ELSE 3 END WHEN k = n THEN 100 ELSE q END AS p FROM x), z AS (SELECT *, lag(p) OVER (PARTITION BY job ORDER BY k) AS before FROM y)
SELECT job, arg_min(p, k) = 1 AND arg_max(p, k) = 100 AND NOT bool_or(coalesce(p < before, false)) AS ok FROM z GROUP BY job""",
    "stray_branches": "SELECT l_orderkey AS path, (l_quantity % 9 + 1)::INT AS target FROM lineitem b WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_orderkey = b.l_orderkey AND e.l_linenumber = (b.l_quantity % 9 + 1)::INT)",
    "fingerprints": """WITH p AS (SELECT c_custkey AS frame, s_suppkey AS print, regexp_extract(c_name, '[^#]*$') AS a, regexp_extract(s_name, '[^#]*$') AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT frame, print, a = b AS matches, list_min(list_filter(range(greatest(length(a), length(b))::BIGINT), lambda i: a[i + 1] <> b[i + 1])) AS first_mismatch FROM p""",
    "wrappers": "SELECT p_partkey AS k, [true, false, true, false, false, false][p_partkey % 6 + 1] AS wrapped FROM part",
    "composed_choices": "SELECT row_id AS id, '<' || coalesce(target, '') || '>' AS composed, NOT regexp_matches(coalesce(target, ''), '[^\\x00-\\x7f]') AS encodable, regexp_matches(coalesce(target, ''), '[\\x{3040}-\\x{30ff}]') AS kana FROM seg_current",
    "pixel_deltas": "SELECT p_partkey::VARCHAR AS path, p_partkey % 5 <> 0 AS same_alpha, p_partkey % 7 AS max_delta, round((p_partkey % 7) / 6.0, 9)::DOUBLE AS mean_delta FROM part",
    "archive_readback": f"WITH {trees._PAY} SELECT p.rel AS member, CASE WHEN t.rel IS NULL THEN 'missing' ELSE 'hash differs' END AS problem FROM pay p LEFT JOIN tree t ON p.rel = t.rel WHERE t.rel IS NULL OR t.sha256 <> p.sha256",
    "retention": "WITH RECURSIVE r AS (SELECT p_partkey AS node FROM part WHERE p_size = 50 UNION SELECT p_partkey // 3 FROM part JOIN r ON p_partkey = node) SELECT node FROM r",
    "path_collisions": """WITH x AS (SELECT DISTINCT CASE WHEN feed = 'heath' THEN '../' ELSE '' END || replace(trim(segment_id), ':', '/') || '.txt' AS path FROM (SELECT feed, segment_id FROM seg_previous UNION ALL SELECT feed, segment_id FROM seg_current)), k AS (SELECT lower(path) AS k FROM x GROUP BY 1 HAVING count(*) > 1)
SELECT path, 'case-collision' AS hazard FROM x WHERE lower(path) IN (SELECT k FROM k) UNION ALL SELECT path, 'unsafe' FROM x WHERE starts_with(path, '../')""",
    "audit_wider": _WIDE + " SELECT * FROM (SELECT engine, signal_group, path, row_number() OVER (PARTITION BY engine, signal_group ORDER BY path) AS rank FROM (SELECT DISTINCT * FROM m)) WHERE rank <= 5",
    "audit_plan": trees._signal_sql()
    + """, g AS (SELECT engine, count(DISTINCT signal_group) AS n FROM m GROUP BY 1)
SELECT engine, CASE WHEN n >= 2 THEN 'candidate-with-two-signal-groups' ELSE 'insufficient-static-evidence' END AS evidence_status, CASE engine WHEN 'KiriKiri' THEN 'kirikiri' WHEN 'Ren''Py' THEN 'renpy' WHEN 'NScripter/ONScripter' THEN 'nscripter' END AS adapter FROM g ORDER BY least(0.95, 0.40 + 0.18 * n) DESC, engine LIMIT 1""",
    "slots_compared": """WITH x AS (SELECT p_partkey::VARCHAR AS path, p_partkey % 5 AS t FROM part)
SELECT path, 'control-marker-sequence-changed' AS id, 0::BIGINT AS slot FROM x WHERE t IN (1, 4) UNION ALL SELECT path, 'outside-slot-region-changed', NULL FROM x WHERE t IN (2, 3)
UNION ALL SELECT path, 'file-size-changed', NULL FROM x WHERE t = 3 UNION ALL SELECT path, 'rebuilt-layout-invalid', NULL FROM x WHERE t = 4""",
    "slots_summary": "SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 5 = 4 THEN 'FAIL' ELSE 'PASS' END AS status, (133 + CASE WHEN p_partkey % 5 = 3 THEN 1 ELSE 0 END)::BIGINT AS file_size, CASE WHEN p_partkey % 5 = 4 THEN 1 ELSE 0 END::BIGINT AS invalid_slots FROM part",
    "images_formats": f"WITH {_image_sql('a', False)} SELECT path, CASE WHEN NOT failed THEN format END AS format, CASE WHEN NOT failed THEN width END::BIGINT AS width, CASE WHEN NOT failed THEN height END::BIGINT AS height, CASE WHEN NOT failed THEN frames END::BIGINT AS frames, CASE WHEN NOT failed THEN alpha END AS alpha, CASE WHEN NOT failed THEN animated END AS animated, failed FROM af",
    "images_differences": f"""WITH {_image_sql('a', False)}, {_image_sql('b', True)}, j AS (SELECT coalesce(x.path, y.path) AS path, x.path IS NULL AS extra, y.path IS NULL AS gone, x.failed OR y.failed AS bad, x.width <> y.width AS geometry, x.alpha AND NOT y.alpha AS alpha, x.frames <> y.frames AS frames,
 y.kind = x.kind AND x.width = y.width AND NOT (y.kind = 0 AND y.t = 2) AND (x.frames = y.frames) AS same FROM af x FULL JOIN bf y ON lower(x.path) = lower(y.path))
SELECT 'FAIL' AS severity, 'missing-localized-asset' AS id, path FROM j WHERE gone UNION ALL SELECT 'WARN', 'extra-localized-asset', path FROM j WHERE extra UNION ALL SELECT 'FAIL', 'unreadable-image', path FROM j WHERE NOT gone AND NOT extra AND bad UNION ALL SELECT 'FAIL', 'geometry-changed', path FROM j WHERE NOT gone AND NOT extra AND NOT bad AND geometry
UNION ALL SELECT 'FAIL', 'alpha-lost', path FROM j WHERE NOT gone AND NOT extra AND NOT bad AND alpha UNION ALL SELECT 'FAIL', 'frame-count-changed', path FROM j WHERE NOT gone AND NOT extra AND NOT bad AND frames UNION ALL SELECT 'WARN', 'unchanged-asset', path FROM j WHERE NOT gone AND NOT extra AND NOT bad AND same""",
    "script_problems": f"""WITH d AS (SELECT doc_id || '.ks' AS path, text FROM documents WHERE text IS NOT NULL), {trees._LINES},
x AS (SELECT *, {sql.strip("body")} AS s FROM b), e AS (SELECT path || ':' || n AS segment_id, n % 9 AS t FROM x WHERE s <> '' AND NOT regexp_matches(s, '^[;*@]') AND NOT (starts_with(s, '[') AND ends_with(s, ']')))
SELECT segment_id, ['unsafe path', 'no such file', 'line no longer exists', 'source drift', 'translation is empty', 'target of several lines'][t] AS problem FROM e WHERE t BETWEEN 1 AND 6""",
}
