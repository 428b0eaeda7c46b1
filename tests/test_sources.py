"""Readers over splits: numbers, records across lines, review tables."""

import csv
import io
import random

import pytest

from segmill.operators import delimited as D
from segmill.sources import catalog, lines, review_csv


def test_dense_numbers(spark):
    """Numbers have no gap though range bounds are sampled, with many tasks and ties in the order."""
    n = 200_000
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(n).selectExpr("id", "hash(id) % 50000 AS k", "id % 3 AS k2").repartition(16)
        got = catalog.dense(rows, ["k", "id"]).toPandas().sort_values("row_idx")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.row_idx.tolist() == list(range(n)) and got.id.is_unique
    assert got[["k", "id"]].apply(tuple, axis=1).is_monotonic_increasing
    assert catalog.dense(rows.where("false"), ["k"]).count() == 0


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbered_lines(spark, tmp_path, small_splits):
    rng = random.Random(5)
    want, kept = {}, []
    for name in ("a.txt", "b.txt"):
        own = ["" if rng.random() < 0.2 else "文" * rng.randint(0, 30) + str(k) for k in range(400)]
        (tmp_path / name).write_bytes(("﻿" + "".join(t + rng.choice(["\n", "\r\n"]) for t in own)).encode())
        want |= {(name, k): t for k, t in enumerate(own, 1)}
        kept += [(name, k, t) for k, t in enumerate(own, 1) if t]
    df = lines.numbered(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 1
    assert {(r.file.split("/")[-1], r.line_no): r.line for r in df.collect()} == want
    some = lines.numbered(spark, str(tmp_path), keep=lambda line: line != "").orderBy("kept_idx").collect()
    assert [(r.file.split("/")[-1], r.line_no, r.line) for r in some] == kept and [r.kept_idx for r in some] == list(range(len(kept)))


def test_jsonl_in_splits(spark, tmp_path, small_splits):
    path = tmp_path / "c.jsonl"
    path.write_text("﻿\n" + "\n\n".join(f'{{"segment_id": "s{k}", "source": "{"あ" * (k % 40)}"}}' for k in range(300)) + "\n", "utf-8")
    rows = catalog.read_jsonl(spark, str(path)).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(300)) and [r.line_no for r in rows] == [2 + 2 * k for k in range(300)]
    assert [r.segment_id for r in catalog.read_records(spark, str(path)).orderBy("row_idx").collect()] == [f"s{k}" for k in range(300)]


def review_text(rng, n=300):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(["current_sha256", "segment_id", "reviewed_target", "extra"])
    rows = []
    for k in range(n):
        row = ["h", f"s{k}", "".join(rng.choice(['a"', ",", "\n", "\r\n", "文", '""']) for _ in range(rng.randint(0, 9))), "x"]
        rows.append((out.getvalue().count("\n") + 1, *row[:3]))
        writer.writerow(row)
    return out.getvalue(), rows


def test_review_tables_in_splits(spark, tmp_path, small_splits):
    text, want = review_text(random.Random(7))
    path = tmp_path / "r.csv"
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    got = review_csv.read(spark, str(path))
    assert [tuple(r) for r in got.orderBy("line_no").collect()] == want
    path.write_bytes(text.encode() + b'h,s,"open\n')
    with pytest.raises(Exception, match="CSV row"):
        review_csv.read(spark, str(path)).collect()


def brute_records(own):
    """Records of ``(line number, text)`` by one pass; the lines of an open rest stay single."""
    out, held, quotes = [], [], 0
    for n, t in own:
        held.append((n, t))
        quotes += t.count('"')
        if quotes % 2 == 0:
            out.append((held[0][0], held[-1][0], "\n".join(x for _, x in held), True))
            held, quotes = [], 0
    return out + [(n, n, t, False) for n, t in held]


@pytest.mark.parametrize("block", [1, 3, 50, 8192])
def test_assembled_records(spark, block):
    rng = random.Random(block)
    rows = []
    for name in ("a", "b", None):
        rows += [(name, k, None if rng.random() < 0.05 else "".join(rng.choice(["x", '"', '""', ","]) for _ in range(rng.randint(0, 3)))) for k in range(1, 121)]
    rows += [("even", 1, '"a'), ("even", 2, 'b"'), ("even", 3, "c")]
    df = spark.createDataFrame(rows, "file_name string, line_no long, line string")
    got = {}
    for r in D.assembled(df, block=block).collect():
        got.setdefault(r.file_name, []).append((r.first_line, r.last_line, r.record, r.closed))
    want = {name: brute_records([(n, t or "") for f, n, t in rows if f == name]) for name in {r[0] for r in rows}}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert D.assembled(df.where("false")).count() == 0


def test_strict_reader_decides(monkeypatch):
    """Without the strict reader malformed records pass."""
    good = ",".join(["a" * 64, "v01/sc0001:5", *[""] * 8, "文", ""])
    bad = [good.replace("文", '"x"y'), good.replace("文", '"x" '), good.replace("文", "x\ny"), '"' + good]
    assert all(D.parse_record(r, 12, D.REVIEW_RULES)[0] == "quoting" for r in bad)
    reader = csv.reader
    seen = []

    def lenient(rows, strict):
        seen.append(1)
        return reader([r.replace("\n", " ") for r in rows], strict=False)

    monkeypatch.setattr(D.csv, "reader", lenient)
    assert seen == [] and sum(D.parse_record(r, 12, D.REVIEW_RULES)[0] == "quoting" for r in bad) < len(bad) and seen
