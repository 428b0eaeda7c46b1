import random

from segmill.operators.reconcile import differences

SHAPE = "segment_id string, source string, target string, speaker string, context string, source_path string, updated_at int, row_id long, diff string"


def brute(current, previous):
    def latest(rows):
        out = {}
        for r in rows:
            k = (r[0] or "").strip().lower()
            o = (r[6] if r[6] is not None else -1, r[7])
            if k not in out or o > out[k][0]:
                out[k] = (o, [v or "" for v in r[1:6]])
        return {k: v for k, (_, v) in out.items()}

    a, b = latest(current), latest(previous)
    out = {(k, "only_current") for k in a.keys() - b.keys()} | {(k, "only_previous") for k in b.keys() - a.keys()}
    names = ("source", "target", "speaker", "context", "source_path")
    return out | {(k, n) for k in a.keys() & b.keys() for n, x, y in zip(names, a[k], b[k]) if x != y}


def test_against_brute_force(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, "", " ", "a", "A", "文"])
    side = lambda base: [(rng.choice(["s1", " S1", "s2\u3000", "s3", None, "", "hot", "hot", "hot"]), *[value() for _ in range(5)], rng.choice([None, 1, 2]), base + i, "x") for i in range(60)]
    for _ in range(3):
        a, b = side(0), side(1000)
        got = differences(spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE)).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(a, b)


def test_empty_sides(spark):
    empty, one = spark.createDataFrame([], SHAPE), spark.createDataFrame([("K ", "a", None, None, None, None, 1, 1, None)] * 2, SHAPE)
    assert [tuple(r) for r in differences(one, empty).collect()] == [("k", "only_current")]
    assert [tuple(r) for r in differences(empty, one).collect()] == [("k", "only_previous")]
    assert differences(empty, empty).count() == 0 and differences(one, one).count() == 0
