import csv
import io
import random

import pytest

from segmill.operators import delimited as D

SHA, SEG = "a" * 64, "v01/sc0001:5"
GOOD = ",".join([SHA, SEG, *[""] * 8, "文", ""])
SHAPE = "raw_id long, raw_record string"


def reason(record):
    return D.parse_record(record, 12, D.REVIEW_RULES)[0]


@pytest.mark.parametrize(
    "record, expected",
    [
        (GOOD, None),
        (GOOD + "\r\n", None),
        (GOOD.replace("文", '"a\nb ""q"" c, d"'), None),
        (GOOD.replace("文", 'x"y'), "quoting"),
        (GOOD.replace("文", '"x'), "quoting"),
        (GOOD.replace("文", '"x"y'), "quoting"),
        (GOOD.replace("文", "x\ny"), "quoting"),
        (GOOD + ",", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        ("a,b", "column_count"),
        (GOOD.replace(SHA, "A" * 64), "bad_current_sha256"),
        (GOOD.replace(SHA, "a" * 63), "bad_current_sha256"),
        (GOOD.replace(SEG, "v1/sc0001:5"), "bad_segment_id"),
        (GOOD.replace(SEG, "v01/sc0001:05"), "bad_segment_id"),
        (GOOD.replace(SEG, "v01/sc0001:５"), "bad_segment_id"),
        (GOOD.replace("文", "\ufffd"), "bad_reviewed_target"),
        (GOOD.replace("文", "\t"), "bad_reviewed_target"),
        (GOOD.replace("文", '"a\nb"'), None),
        (GOOD.replace("文", ""), None),
        (GOOD.replace(SHA, "x").replace(SEG, "y"), "bad_current_sha256"),
    ],
)
def test_first_reason(record, expected):
    assert reason(record) == expected


def test_round_trip_of_written_records():
    rng = random.Random(3)
    for _ in range(500):
        row = [SHA, SEG, *["".join(rng.choice('a,"\n 文') for _ in range(rng.randint(0, 6))) for _ in range(8)], "", ""]
        out = io.StringIO()
        csv.writer(out, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator="\r\n").writerow(row)
        assert D.parse_record(out.getvalue(), 12, D.REVIEW_RULES) == (None, row)


def test_assembles_quoted_line_breaks():
    assert list(D.assemble(['a,"b\n', 'c"\n', "d\n"])) == [(1, 'a,"b\nc"\n'), (3, "d\n")]


def test_loading(spark):
    long = GOOD.replace("文", "文" * 300_000)
    rows = [(1, GOOD), (1, GOOD), (2, None), (3, long), (4, '"')]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "'x' AS reason", "'y' AS segment_id")
    bad = sorted(map(tuple, D.rejected(df).collect()))
    assert bad == [(2, "column_count"), (4, "quoting")]
    good = D.loaded(df).collect()
    assert sorted(r.raw_id for r in good) == [1, 1, 3] and {len(r.reviewed_target) for r in good} == {1, 300_000}
    assert D.rejected(spark.createDataFrame([], SHAPE)).count() == 0
    with pytest.raises(ValueError):
        D.load_records(df, keep=("segment_id",))
