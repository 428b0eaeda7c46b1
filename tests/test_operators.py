import hashlib
import json
import os
import random
import struct
import zlib
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from segmill.operators import adapter, audit, documented, images, manifest, memory, qa, review, similarity, skew, slots
from segmill.plans import migration
from segmill.sources import catalog, review_csv, sinks, tree

REC = "row_idx long, segment_id string, source string, target string"


def recs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REC)


def test_gate_golden(spark):
    rows = recs(spark, [("1", "こ{name}", "ni{name}"), ("2", "x", "x {extra}"), ("3", "y", " ")])
    policy = qa.Policy(require_complete=True, encoding="gbk")
    codes = sorted(r.code for r in qa.record_findings(rows, policy).collect())
    assert codes == ["control-token-added", "empty-translation"]
    s = qa.summary(rows, policy).first()
    assert (s.gate, s.total_records, s.completed, s.failed_records) == ("FAIL", 3, 2, 2)


def test_gate_details(spark):
    glossary = qa.Glossary((("犬", ("狗",)), ("猫", ())), ("禁",))
    rows = recs(spark, [("a", "犬猫", "禁か\u200b（"), ("a", "s", "x\ny"), ("b", " s\u3000", "z"), (None, None, None)])
    found = {(r.row_idx, r.code) for r in qa.findings(rows, qa.Policy(max_chars=3, max_lines=1, check_punctuation=True, glossary=glossary)).collect()}
    assert found == {
        (0, "terminology-mismatch"), (0, "forbidden-term"), (0, "residual-japanese"), (0, "zero-width-character"), (0, "character-budget"), (0, "punctuation-unbalanced"),
        (1, "line-budget"), (1, "inconsistent-translation"), (2, "inconsistent-translation"), (3, "empty-translation"),
    }
    counts = {r.code: r.n for r in qa.counters(rows, qa.Policy(glossary=glossary)).collect()}
    assert counts["terminology-mismatch"] == 2 and counts["inconsistent-translation"] == 1
    big = qa.Glossary(glossary.terms + tuple((f"t{i}", ("u",)) for i in range(99)), glossary.forbidden)
    pick = lambda g: sorted((r.row_idx, r.code, r.detail) for r in qa.record_findings(rows, qa.Policy(glossary=g)).collect())
    assert pick(glossary) == pick(big)
    with pytest.raises(ValueError):
        qa.Policy(max_chars=0)
    empty = spark.createDataFrame([], REC)
    assert qa.summary(empty).first().gate == "PASS" and qa.findings(empty).count() == 0


def test_gate_summary_counts_ids_once(spark):
    rows = recs(spark, [("a", "s", "1"), ("a", "s", "2"), ("b", "s", "s")])
    s = qa.summary(rows).first()  # b warns for itself; a gets one further row
    assert (s.gate, s.failed_records, s.warning_records) == ("PASS", 0, 2)
    assert qa.summary(rows, qa.Policy(require_consistent=True)).first().failed_records == 2


def test_gate_on_a_stream(spark, tmp_path):
    from segmill.streaming import gate

    recs(spark, [("1", "x{a}", "y"), ("2", "k", "v")]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(REC).parquet(f"{tmp_path}/in")
    gate.watch(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert [r.code for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["control-token-missing"]


def test_memory_golden(spark):
    now = recs(spark, [("1", "same{a}", ""), ("2", "moved", ""), ("3", "0123456789", ""), ("4", "kept", "k"), ("5", "clash", ""), ("6", "tok{x}", ""), (None, "nothing like it", "")])
    past = memory.history([("one", recs(spark, [("1", "same{a}", "S{a}"), ("9", "moved", "M"), ("8", "012345678X", "T"), ("5", "clash", "A")])), ("two", recs(spark, [("5", "clash", "B"), ("7", "tok{x}", "t"), ("0", "untranslated", "untranslated")]))])
    out = {r.row_idx: r for r in memory.decisions(now, past).collect()}
    assert [out[i].decision for i in range(7)] == ["reused-exact-id", "reused-exact-source", "review-suggestion", "kept-current", "conflict", "conflict", "pending"]
    assert out[2].similarity == 0.9 and out[2].suggested_target == "T" and out[2].new_target == "" and out[1].previous_segment_id == "9"
    assert out[4].reason == memory.NO_AGREEMENT and out[5].reason == memory.BROKEN_TOKENS and out[6].segment_id == "#index:7"
    s = memory.summary(memory.decisions(now, past), past.count()).first()
    assert s.kept_current + s.reused_by_id + s.reused_by_source + s.pending == s.current_records == 7 and s.status == "REVIEW"
    assert memory.review_queue(memory.decisions(now, past), "h").count() == 4
    with pytest.raises(ValueError, match="duplicate current segment id: 1"):
        memory.decisions(recs(spark, [("1", "a", ""), ("1", "b", "")]), past)
    with pytest.raises(ValueError, match="no source"):
        memory.decisions(recs(spark, [("1", "", "")]), past)


def test_memory_queries_run_all_steps(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    exact = memory.decisions(migration.current(spark, sf), migration.previous(spark, sf), threshold=None).join(migration.current(spark, sf).select("row_idx", "source"), "row_idx").collect()
    past = {(r.segment_id, r.source, r.target, r.origin) for r in memory.with_ids(migration.previous(spark, sf)).where("target <> '' AND source <> '' AND target <> source").collect()}
    want = {}
    for r in exact:
        if r.decision in memory.REVIEWED:
            want[r.segment_id] = (r.decision, "", "", "")
        if r.decision == "pending":
            hits = []
            for h in past:
                m = SequenceMatcher(None, r.source, h[1], autojunk=False)
                if m.real_quick_ratio() >= 0.86 and m.quick_ratio() >= 0.86 and m.ratio() >= 0.86:
                    hits.append((m.ratio(), *h))
            if hits:
                ratio, _, source, target, _ = max(hits)
                want[r.segment_id] = ("review-suggestion", str(round(ratio, 6)), source, target)
    queue = migration.memory_review_queue_similar(spark, sf).collect()
    assert {r.segment_id: (r.decision, r.similarity, r.previous_source, r.suggested_target) for r in queue} == want and len(queue) == len(want)
    n = lambda d: sum(v[0] == d for v in want.values())
    s = migration.memory_summary_similar(spark, sf).first()
    assert s.suggestions == n("review-suggestion") > 0 and s.conflicts == n("conflict") and s.pending == len(want) and s.fuzzy_threshold == 0.86
    assert s.kept_current + s.reused_by_id + s.reused_by_source + s.pending == s.current_records == len(exact)


@pytest.mark.parametrize("threshold", [0.55, 0.7, 0.86])
def test_similarity_join_is_exact(spark, threshold):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd文") for _ in range(rng.randint(1, 24))) for _ in range(60)]

    def edit(t):
        t = list(t)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "文a"])
        return "".join(t)

    left, right = [*base, None, ""], [edit(t) for t in base for _ in range(2)] + [None, ""]
    one = lambda v: spark.createDataFrame([(x,) for x in v], "text string")
    got = {(r.a, r.b): r.ratio for r in similarity.similar_pairs(one(left), one(right), threshold).collect()}
    want = {}
    for a in set(filter(None, left)):
        for b in set(filter(None, right)):
            ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
            if ratio >= threshold:
                want[a, b] = ratio
    assert got == want


def test_review(spark, tmp_path):
    cat = recs(spark, [("a", "s{x}", ""), ("b", "t", "old"), ("c", "u", "")])
    row = "line_no int, current_sha256 string, segment_id string, reviewed_target string"
    rows = spark.createDataFrame([(2, "h", "a", "n{x}"), (3, "h", "c", " ")], row)
    done = {r.segment_id: r.target for r in review.apply(cat, rows, "h").collect()}
    assert done == {"a": "n{x}", "b": "old", "c": ""}
    bad = spark.createDataFrame([(2, "x", "a", ""), (3, "h", "zz", ""), (4, "h", "a", "n"), (5, "h", "b", "new"), (6, "h", "c", ""), (9, "h", "c", "€")], row)
    errors = {r.line_no: r.error for r in review.judged(cat, bad, "h").collect()}
    assert errors[2].endswith("different current catalog") and errors[3].endswith("unknown or duplicate review segment ID") and errors[4].endswith("unknown or duplicate review segment ID")
    assert errors[5].endswith("existing translation differs: b") and errors[6] is None and errors[9].startswith("CSV row 9: unknown or duplicate")
    with pytest.raises(ValueError, match="CSV row 2"):
        review.apply(cat, bad, "h")
    path = tmp_path / "r.csv"
    path.write_text('\ufeffcurrent_sha256,segment_id,reviewed_target\n\nh,a,"x\ny"\nh,b,z\n', "utf-8")
    got = [tuple(r) for r in review_csv.read(spark, str(path)).orderBy("line_no").collect()]
    assert got == [(3, "h", "a", "x\ny"), (5, "h", "b", "z")]
    for text, message in (("a,a\n", "duplicate"), ("a,b\n", "missing"), ("current_sha256,segment_id,reviewed_target\nh,a\n", "row 2"), ('current_sha256,segment_id,reviewed_target\nh,a,"x"y\n', "row 2")):
        with pytest.raises(ValueError, match=message):
            list(review_csv.numbered(text))


def test_audit(spark, tmp_path):
    rows = [(i, p, 1, "." + p.rsplit(".")[-1], False) for i, p in enumerate(["Startup.tjs", "scenario/scene01.ks", "data.xp3", "x.ttf", "y.ttf"])]
    inv = spark.createDataFrame(rows, tree.INVENTORY)
    best = audit.detect(inv).first()
    assert (best.engine, best.classification, best.confidence) == ("KiriKiri", "candidate", 0.94)
    assert [r.signal_group for r in best.evidence] == ["startup", "scenario", "archive"]
    weak = audit.detect(inv.where("path like '%.xp3'"))
    assert weak.first().confidence == 0.58 and audit.plan(weak)["evidence_status"].startswith("insufficient")
    assert audit.plan(audit.detect(inv.where("false")))["engine"] == "Unknown"
    assert audit.top_extensions(inv).first().extension == ".ttf"
    assert {r.category: r["files"] for r in audit.categories(inv).collect()} == {"scripts": 2, "archives": 1, "images": 0, "fonts": 2, "executables": 0}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.KS").write_bytes("文".encode("cp932"))
    (tmp_path / "z.ks").write_bytes(b"\xef\xbb\xbfx")
    (tmp_path / "b" / "l").symlink_to(tmp_path / "b")
    listed, warnings = tree.walk(tmp_path)
    assert [r[1] for r in listed] == ["z.ks", "b/a.KS"] and len(warnings) == 1 and tree.walk(tmp_path, 1)[1][-1].startswith("stopped")
    probes = audit.probes(tree.files_with_inventory(spark, tmp_path)).collect()
    assert {r.path: r.bom for r in probes} == {"z.ks": "utf-8-sig", "b/a.KS": "none"}


def test_adapter_round_trip(spark, tmp_path):
    body = "; c\r\n*label\r\n　こんにちは \r\n[tag]\r\n\r\nline\u2028same\nlast"
    (tmp_path / "a.ks").write_bytes(b"\xef\xbb\xbf" + body.encode())
    (tmp_path / "s.rpy").write_text('  e "hi \\"x\\"" # c\n$ code\n  old "t"\n', "utf-8")
    files = tree.contents(spark, tmp_path)
    got = adapter.extract(files, "kirikiri").orderBy("line").collect()
    assert [(r.line, r.source, r.newline) for r in got] == [(3, "こんにちは", "\\r\\n"), (6, "line", ""), (7, "same", "\\n"), (8, "last", "")]
    assert got[0].prefix == "　" and got[0].suffix == " " and got[0].bom == "EFBBBF" and got[0].source_sha256 == hashlib.sha256("こんにちは".encode()).hexdigest()
    assert [r.source for r in adapter.extract(files, "renpy").collect()] == ['hi \\"x\\"', "t"]
    same = adapter.extract(files, "kirikiri").withColumn("target", F.col("source"))
    out = adapter.rebuilt(files.where("path = 'a.ks'"), same).first()
    assert bytes(out.content) == (tmp_path / "a.ks").read_bytes()
    new = same.withColumn("target", F.when(F.col("line") == 8, "fin").otherwise(F.col("source")))
    assert bytes(adapter.rebuilt(files, new).first().content).endswith(b"\nfin")
    wrong = same.withColumn("target", F.when(F.col("line") == 3, "").when(F.col("line") == 6, "a\nb").otherwise("x")).withColumn("suffix", F.when(F.col("line") == 8, "!").otherwise(F.col("suffix")))
    assert {r.line: r.problem for r in adapter.problems(files, wrong).collect()} == {3: "translation is empty", 6: "target of several lines", 8: "source drift"}
    assert {r.problem for r in adapter.problems(files, same.withColumn("path", F.lit("../a.ks"))).collect()} == {"unsafe path"}
    quoted = adapter.extract(files, "renpy").withColumn("target", F.lit('a"b'))
    assert {r.problem for r in adapter.problems(files, quoted).collect()} == {"unescaped quote"}
    with pytest.raises(ValueError):
        adapter.rebuilt(files, wrong)
    sinks.write_files(adapter.rebuilt(files, same), tmp_path.parent / "out_of_it", tmp_path)
    with pytest.raises(ValueError):
        sinks.write_files(adapter.rebuilt(files, same), tmp_path / "in", tmp_path)


def test_slots(spark):
    good = b"HEAD" + "文①".encode("utf-16-le").ljust(16, b"\0") + "b".encode("utf-16-le").ljust(16, b"\0") + b"TAIL"
    other = good.replace("①".encode("utf-16-le"), "②".encode("utf-16-le")).replace(b"TAIL", b"tail")
    files = lambda c: spark.createDataFrame([("f", bytearray(c))], "path string, content binary")
    rows = slots.scan(files(good), 4, 16, 2, "utf-16-le").orderBy("index").collect()
    assert [(r.text, r.used_bytes, r.capacity, r.valid) for r in rows] == [("文①", 4, 7, True), ("b", 2, 7, True)] and rows[0].control_markers == ["①"]
    assert slots.compare(files(good), files(good), 4, 16, 2, "utf-16-le").count() == 0
    assert {r.id for r in slots.compare(files(good), files(other), 4, 16, 2, "utf-16-le").collect()} == {"outside-slot-region-changed", "control-marker-sequence-changed"}
    assert slots.changed(files(good), files(other), 4, 16, 2, "utf-16-le").count() == 1
    padded = slots.scan(files(b"a\0x\0" + b"abcd"), 0, 4, 2, "ascii").orderBy("index").collect()
    assert [r.errors for r in padded] == [["nonzero-padding"], ["missing-nul"]]
    assert slots.scan_summary(files(b"x"), slots.scan(files(b"x"), 0, 4, 2, "ascii"), 0, 4, 2).first().errors == ["region-out-of-bounds"]


def _png(width, color=6, extra=b""):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 2, 8, color, 0, 0, 0)) + extra + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


def test_images(spark):
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 4, 0x80, 0, 0) + b"\0" * 6 + b"!\xf9\x04\x01\0\0\0\0" + b"," + b"\0" * 9 + b"\x02\x01x\0" + b";"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x05\0\x06\x01\x11\0\xff"
    bmp = b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 7, -8, 1, 32) + b"\0" * 24
    shape = "path string, content binary"
    make = lambda d: images.inventory(spark.createDataFrame([(k, bytearray(v)) for k, v in d.items()], shape))
    a = make({"a.png": _png(1), "b.gif": gif, "c.jpg": jpeg, "d.BMP": bmp, "e.png": b"bad", "f.txt": b"", "g.png": _png(5), "h.png": _png(6)})
    facts = {r.path: r for r in a.collect()}
    assert (facts["a.png"].width, facts["a.png"].alpha) == (1, True) and (facts["b.gif"].width, facts["b.gif"].alpha, facts["b.gif"].frames) == (3, True, 1)
    assert (facts["c.jpg"].width, facts["c.jpg"].height) == (6, 5) and (facts["d.BMP"].width, facts["d.BMP"].height) == (7, 8) and facts["e.png"].error and "f.txt" not in facts
    b = make({"A.PNG": _png(2, 2), "b.gif": gif, "c.jpg": jpeg, "d.BMP": bmp, "e.png": b"bad", "x.png": _png(1), "h.png": _png(6)})
    found = [(r.severity, r.id, r.path) for r in images.compare(a, b).collect()]
    assert found == [
        ("FAIL", "geometry-changed", "a.png"), ("FAIL", "alpha-lost", "a.png"), ("WARN", "unchanged-asset", "b.gif"), ("WARN", "unchanged-asset", "c.jpg"), ("WARN", "unchanged-asset", "d.BMP"),
        ("FAIL", "unreadable-image", "e.png"), ("FAIL", "missing-localized-asset", "g.png"), ("WARN", "unchanged-asset", "h.png"), ("WARN", "extra-localized-asset", "x.png"),
    ]


def test_manifest_transaction(spark, tmp_path):
    game, pay, pkg = tmp_path / "game", tmp_path / "pay", tmp_path / "pkg"
    for d in (game, pay / "n", pkg / "files" / "n"):
        d.mkdir(parents=True)
    (game / "a").write_text("old")
    for base in (pay, pkg / "files"):
        (base / "a").write_text("new")
        (base / "n" / "b").write_text("add")
    hashed = lambda p: manifest.hashed(tree.contents(spark, p))
    built = manifest.build(hashed(pay), hashed(game))
    entries = spark.createDataFrame(built.collect(), built.schema)  # as it was when built
    assert {r.rel: r.action for r in entries.collect()} == {"a": "replace", "n/b": "add"}
    assert manifest.overall(manifest.states(entries, hashed(game))).first().overall == "CLEAN"
    (pkg / "manifest.json").write_text(json.dumps({"entries": [r.asDict() for r in entries.collect()]}))
    assert manifest.apply_package(pkg, game)["status"] == "APPLIED"
    assert manifest.overall(manifest.states(entries, hashed(game))).first().overall == "APPLIED"
    assert {r.problem for r in manifest.preflight(entries, hashed(game)).collect()} == {"baseline mismatch", "target of an addition exists"}
    assert manifest.apply_package(pkg, game)["status"] == "ABORTED"
    assert manifest.roll_back(pkg, game)["status"] == "ROLLED_BACK" and (game / "a").read_text() == "old" and not (game / "n" / "b").exists()
    assert manifest.overall(manifest.states(entries.where("false"), hashed(game))).first().overall == "APPLIED"
    assert catalog.read_manifest(spark, str(pkg / "manifest.json")).count() == 2


def test_catalog_readers(spark, tmp_path):
    jsonl = tmp_path / "c.jsonl"
    jsonl.write_text('\ufeff{"segment_id": 7, "source": "a", "target": 5, "x": [1]}\n\n{"pre_jp": null, "post_jp": "p", "proofread_zh": "", "pre_zh": "z", "index": 3}\n{"source": "q"}\n', "utf-8")
    rows = [tuple(r)[:4] for r in catalog.read_records(spark, str(jsonl)).orderBy("row_idx").collect()]
    assert rows == [(0, "7", "a", ""), (1, "3", "p", "z"), (2, "3", "q", "")]
    doc = tmp_path / "c.json"
    doc.write_text('{"data": [{"source": "a"}, 5, {"source": "b"}]}', "utf-8")
    assert [r.source for r in catalog.read_records(spark, str(doc)).orderBy("row_idx").collect()] == ["a", "b"]
    doc.write_text('{"k1": {"source": "a"}, "k2": {"source": "b"}}', "utf-8")
    assert {r.segment_id for r in catalog.read_records(spark, str(doc)).collect()} == {"k1", "k2"}
    out = tmp_path / "o.jsonl"
    assert sinks.write_jsonl_file(catalog.read_records(spark, str(jsonl)), out, raw="raw") == 3
    assert json.loads(out.read_text("utf-8").splitlines()[0]) == {"segment_id": 7, "source": "a", "target": "", "x": [1]}
    with pytest.raises(FileExistsError):
        sinks.write_jsonl_file(catalog.read_records(spark, str(jsonl)), out)
    bad = tmp_path / "b.jsonl"
    bad.write_text("[1]\n", "utf-8")
    with pytest.raises(Exception, match="not a JSON object in line 1"):
        catalog.read_jsonl(spark, str(bad)).collect()
    assert catalog.parse_glossary({"terms": [{"source": "s", "target": "t"}, {"source": "u", "targets": []}]}).terms == (("s", ("t",)), ("u", ()))
    with pytest.raises(ValueError, match="term 1"):
        catalog.parse_glossary({"terms": [{"source": ""}]})
    df = spark.createDataFrame([("\ufeff---\na: 1\n---\n\n# T\n",)], "t string")
    assert df.select(catalog.document_body(F.col("t"))).first()[0] == "# T\n"


def test_documented_checks(spark):
    df = lambda rows, shape: spark.createDataFrame(rows, shape)
    got = lambda d: sorted(tuple(r) for r in d.collect())
    assert df([(bytearray(b"PK\x03\x04..."),), (bytearray(b"MZ"),), (bytearray(b"?"),)], "c binary").select(documented.magic_kind(F.col("c"))).collect() == [("zip",), ("exe",), (None,)]
    packed = b"xx" + struct.pack("<I", 4) + "文字".encode("cp932") + b"\0" + b"zz"
    assert got(documented.prefixed_strings(df([("f", bytearray(packed))], "path string, content binary"))) == [("f", 2, "文字")]
    k = "path string, at int, source string"
    assert got(documented.completeness(df([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z")], k), df([("a", 1, "x"), ("a", 2, "q"), ("a", 4, "w")], k), ["path", "at"])) == [("a", 1, "known-match"), ("a", 2, "source-mismatch"), ("a", 3, "not-found"), ("a", 4, "new-candidate")]
    assert got(documented.slot_budget(df([(1, "a\n", "文a\n", 4)], "id int, source string, target string, slot_size int"))) == [(1, 4, 4, True, True)]
    s = "g string, p int, v string"
    assert got(documented.sequences_equal(df([("a", 1, "x"), ("b", 1, "x")], s), df([("a", 1, "x"), ("b", 1, "y")], s), "g", "p", "v")) == [("a", True), ("b", False)]
    h = "rel string, sha256 string"
    assert documented.baseline_of(df([("p1", "a", "1"), ("p2", "a", "2")], "profile string, rel string, sha256 string"), df([("a", "2")], h)).first() == ("supported", "p2")
    assert got(documented.tree_diff(df([("a", "1"), ("b", "1"), ("c", "1")], h), df([("b", "2"), ("c", "2"), ("d", "1")], h), df([("c",)], "rel string"))) == [("a", "removed"), ("b", "immutable-changed"), ("c", "declared-mutable"), ("d", "added")]
    assert got(documented.overlapping_ranges(df([("f", 1, 0, 10), ("f", 2, 5, 6), ("f", 3, 7, 8), ("f", 4, 10, 12)], "path string, id int, start int, end int"))) == [("f", 2, 5), ("f", 3, 7)]
    assert got(documented.differing_outside(df([("f", 1), ("f", 4), ("g", 0)], "path string, at long"), df([("f", 0, 3)], "path string, start long, end long"))) == [("f", 4), ("g", 0)]
    assert got(documented.occurrence_check(df([("f", "new new")], "path string, text string"), df([("f", "old", "new", 2)], "path string, old string, new string, times int"))) == [("f", 0, 2, True)]
    assert got(documented.progress_check(df([("a", 1, 1), ("a", 2, 100), ("b", 1, 1), ("b", 2, 0), ("b", 3, 100)], "job string, step int, percent int"))) == [("a", True), ("b", False)]
    assert got(documented.stray_targets(df([("f", 3), ("f", 4)], "path string, target int"), df([("f", 4)], "path string, start int"))) == [("f", 3)]
    c = "{} string, place int, content binary"
    assert got(documented.fingerprint_matrix(df([("x", 0, bytearray(b"ab"))], c.format("frame")), df([("p", 0, bytearray(b"ab")), ("q", 0, bytearray(b"ac"))], c.format("print")))) == [("x", "p", True, None), ("x", "q", False, 1)]
    assert got(documented.composed_check(df([(1, "「", "か", None)], "id int, open string, translation string, close string"), "gbk")) == [(1, "「か", True, True)]
    assert got(documented.pixel_delta(df([("f", bytearray([1, 2, 3, 9]), bytearray([2, 2, 3, 9]))], "path string, before binary, after binary")))[0][:3] == ("f", True, 1)
    assert got(documented.readback(df([("a", "1"), ("b", "1")], "member string, sha256 string"), df([("b", "2")], "member string, sha256 string"))) == [("a", "missing"), ("b", "hash differs")]
    assert got(documented.retained(df([("r", "x"), ("x", "y"), ("z", "q")], "node string, input string"), df([("r",)], "node string"))) == [("r",), ("x",), ("y",)]
    assert got(documented.path_hazards(df([("a",), ("A",), ("../b",)], "path string"))) == [("../b", "unsafe"), ("A", "case-collision"), ("a", "case-collision")]
    assert got(documented.inconsistent_duplicates(df([("s", "1"), ("s", "2"), ("t", "1"), ("t", "2")], "source string, target string"), df([("t",)], "source string"))) == [("s", 2)]
    assert got(documented.category_audit(df([("c", "か"), ("c", "€")], "category string, text string"), "gbk")) == [("c", 2, 1, 1)]
    assert got(documented.byte_identical(df([("a", "1")], h), df([("a", "2")], h))) == [("a", False)]
    assert got(documented.repeated_ids(df([(1,), (1,), (2,)], "k int"), "k")) == [(1, 2)]
    r = "segment_id string, source string, target string"
    assert got(documented.regeneration_diff(df([("a", "s", "s"), ("b", "s", "t"), ("c", "s", "t")], r), df([("c", "s", "u"), ("d", "s", "t")], r))) == [("a", "omitted-no-op"), ("b", "omitted"), ("c", "changed"), ("d", "new")]


def _fingerprints_by_hand(frames, prints):
    found = {}
    for f, x, a in frames:
        for p, y, b in prints:
            if x is not None and x == y:
                known = a is not None and b is not None
                byte = next((i for i in range(max(len(a), len(b))) if a[i : i + 1] != b[i : i + 1]), None) if known else None
                found.setdefault((f, p), []).append((x, byte, known))
    wrong = {k: min((x, byte) for x, byte, _ in v if byte is not None)[1] for k, v in found.items() if any(byte is not None for _, byte, _ in v)}
    return sorted(((*k, False if k in wrong else True if all(known for *_, known in v) else None, wrong.get(k)) for k, v in found.items()), key=repr)


def _fingerprints(spark, frames, prints):
    return documented.fingerprint_matrix(*(spark.createDataFrame(rows, f"{key} long, place int, content binary") for rows, key in ((frames, "frame"), (prints, "print"))))


@pytest.mark.parametrize(("kind", "longest", "cell"), [("lone", 9, 2000), ("lone", 70, 3), ("places", 15, 3), ("repeats", 60, 4)])
def test_fingerprints_against_brute_force(spark, monkeypatch, kind, longest, cell):
    """Lacking and zero bytes, bytes beyond all numbers, NULL, one row a frame or several, places that repeat."""
    monkeypatch.setattr(skew, "CELL", cell)
    rng = random.Random(longest)
    base = bytes(rng.randrange(256) for _ in range(longest))

    def content():
        own = bytearray(base)
        for _ in range(rng.choice((0, 0, 1, 2))):
            own[rng.randrange(longest)] = rng.choice((0, 127, 128, 255))
        return None if rng.random() < 0.1 else bytes(own[: rng.choice((longest, longest, rng.randrange(longest)))]) + bytes(rng.choice((0, 0, 1)))

    def side(n):
        places = {"lone": lambda: [rng.choice((None, 1, 2))], "places": lambda: rng.sample((1, 2, 3), rng.randint(1, 3)), "repeats": lambda: rng.choices((1, 2), k=rng.randint(1, 3))}[kind]
        return [(i, x, content()) for i in range(n) for x in places()]

    frames, prints = side(30), side(20)
    got = sorted((tuple(r) for r in _fingerprints(spark, frames, prints).collect()), key=repr)
    assert got == _fingerprints_by_hand(frames, prints) and {r[2] for r in got} == {True, False, None}
    assert _fingerprints(spark, frames, []).count() == 0


def test_fingerprints_of_one_row_are_not_gathered(spark, monkeypatch):
    """The pairs are the job: none of them is moved again, and those of one place are made in several tasks."""
    monkeypatch.setattr(skew, "CELL", 50)
    frames, prints = ([(i, 1, f"{i * k:09d}".encode()) for i in range(n)] for n, k in ((400, 3), (200, 5)))
    df = _fingerprints(spark, frames, prints)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan.split("Join")[0]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == _fingerprints_by_hand(frames, prints)
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 80_000 and len(tasks) > 1 and max(tasks) < 60_000
