"""Documented checks and configuration limits beyond what the queries cover."""

import pytest
from pyspark.sql import functions as F

from segmill.operators import audit, documented, qa, review, slots

REC = "row_idx long, segment_id string, source string, target string"


@pytest.mark.parametrize("n", [39, 40, 41, 120])
def test_glossaries_of_any_size_find_the_same(spark, n):
    """Literals and automaton agree, whatever the number of terms."""
    base = (("犬", ("狗",)), ("猫", ()), ("鳥", ("鸟", "禽")))
    rows = spark.createDataFrame([(1, "a", "犬と猫", "狗"), (2, "b", "鳥", "禽"), (3, "c", "鳥", "x禁"), (4, "d", "", "犬"), (5, "e", None, "禁"), (6, "f", "犬", None)], REC)
    pick = lambda g: sorted((r.row_idx, r.code, r.detail) for r in qa.record_findings(rows, qa.Policy(glossary=g)).collect())
    small = pick(qa.Glossary(base, ("禁",)))
    assert small == pick(qa.Glossary(base + tuple((f"無{k}", ("u",)) for k in range(n - 4)), ("禁",))) and (1, "terminology-mismatch", "") in small


@pytest.mark.parametrize("terms, forbidden", [([("", ("x",))], ()), ([(None, ("x",))], ()), ([("s", ("",))], ()), ([("s", (None,))], ()), ([], ("",)), ([], (None,))])
def test_empty_terms_are_refused(terms, forbidden):
    with pytest.raises(ValueError):
        qa.Glossary(tuple(terms), tuple(forbidden))


def test_pending_records_have_keys_of_their_own(spark):
    rows = spark.createDataFrame([(k, f"s{k % 40}", "源", None if k % 3 else "t") for k in range(120)] + [(200, "x", "源", "u")], REC)
    s = qa.summary(rows).first()
    assert (s.total_records, s.completed, s.pending) == (121, 41, 80)


def test_first_of_repeated_catalog_ids(spark):
    cat = spark.createDataFrame([(5, "a", "later", "x"), (1, "a", "first", ""), (2, "b", None, None)], REC)
    rows = spark.createDataFrame([(2, "h", "a", "n"), (3, "h", "b", "m")], "line_no int, current_sha256 string, segment_id string, reviewed_target string")
    assert [r.error for r in review.judged(cat, rows, "h").orderBy("line_no").collect()] == [None, None]


def test_length_prefixed_strings(spark):
    def packed(text, codec="cp932"):
        raw = text.encode(codec) if isinstance(text, str) else text
        return len(raw).to_bytes(4, "little") + raw + b"\0"

    long = "長" * 700 + "い文章" * 500
    content = b"\0\0\0" + packed("文字") + packed("あ") + packed(b"a\x01b") + packed("亜亜亜亜亜亜") + packed("ｱｲｳｴｵ") + packed(long) + packed(b"\xf0\x40") + packed("名前\n次")
    df = spark.createDataFrame([("f", bytearray(content)), ("e", bytearray()), ("n", None)], "path string, content binary")
    found = [(r.offset, r.text) for r in documented.prefixed_strings(df).orderBy("offset").collect()]
    assert [t for _, t in found] == ["文字", "あ", long, "名前\n次"] and found[0][0] == 3
    assert [r.text for r in documented.prefixed_strings(df, most=6).orderBy("offset").collect()] == ["文字", "あ"]


def test_magic(spark):
    heads = [b"XP3\r\n \n\x1a..", b"YPF\0", b"PackFile", b"ESC-ARC2", b"MajiroArcV3.000", b"DX\x04", b"DXY", b"MZ..LIVEMAKER", b"MZ", None, b""]
    df = spark.createDataFrame([(k, None if h is None else bytearray(h)) for k, h in enumerate(heads)], "k int, c binary")
    got = [r.m for r in df.select("k", documented.magic_kind(F.col("c")).alias("m")).orderBy("k").collect()]
    assert got == ["KiriKiri", "Yu-Ris", "QLIE", "Escude", "Majiro", "Wolf RPG Editor", None, "LiveMaker", "exe", None, None]
    files = spark.createDataFrame([("A/Scene.pck",), ("a/gameexe.DAT",), ("b/scene.pck",)], "path string")
    assert [tuple(r) for r in documented.named_pairs(files).collect()] == [("a/", "SiglusEngine")]


def test_wider_engines(spark):
    files = spark.createDataFrame([("root.pfs",), ("scenario/a.ast",), ("x.ypf",)], "path string")
    got = {r.engine: r.classification for r in audit.detect(files, audit.ENGINES + audit.WIDER_ENGINES).collect()}
    assert got == {"Artemis": "candidate", "Yu-Ris": "weak-candidate"}
    assert len({e.name for e in audit.ENGINES + audit.WIDER_ENGINES}) == len(audit.ENGINES) + len(audit.WIDER_ENGINES)


def test_long_dependency_chains_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(12, 0), (3, None)], "node int, input int")
    assert sorted(r.node for r in documented.retained(edges, spark.createDataFrame([(5,)], "node int")).collect()) == list(range(13))


def test_slots_are_cut_before_they_are_rows(spark):
    df = spark.createDataFrame([("f", bytearray(b"HEADab\0\0cd\0\0"))], "path string, content binary")
    out = slots.scan(df, 4, 4, 2, "ascii")
    assert [(r["index"], r.offset, r.text) for r in out.orderBy("index").collect()] == [(0, 4, "ab"), (1, 8, "cd")]
    assert slots.scan(df, 4, 4, 9, "ascii").count() == 0 and slots.scan(df, 4, 0, 0, "ascii").count() == 0
