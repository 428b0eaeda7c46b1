import random
import re
from collections import Counter

from pyspark.sql import functions as F

from segmill.functions import codecs, paths
from segmill.functions import text as T

POOL = ["{a}", "{0}", "[p]", "%s", "%1$d", "% c", "{{A3}}", "\\n", "x", "文", "\u3000", "\r\n", "\u2028", "\U0001f600", '"', "\\", "「", "」", "(", "ー", "\u200b"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_tokens_against_python(spark):
    a, b = texts(800), texts(800, 2)
    df = spark.createDataFrame(list(zip(range(800), a, b)), "i int, s string, t string")
    s, t = T.tokens(F.col("s")), T.tokens(F.col("t"))
    rows = df.select("i", s.alias("own"), T.multiset_minus(s, t).alias("m"), T.reordered(s, t).alias("r"), T.without_tokens(F.col("s")).alias("w"), T.tokens_agree(F.col("s"), F.col("t")).alias("ok")).collect()
    pattern = re.compile(T.TOKEN)
    for r in rows:
        x, y = pattern.findall(a[r.i]), pattern.findall(b[r.i])
        left = list((Counter(x) - Counter(y)).elements())
        assert r.own == x and r.m == left and r.w == pattern.sub("", a[r.i])
        assert r.r == (Counter(x) == Counter(y) and x != y) and r.ok == (x == y)


def test_measures_against_python(spark):
    a = texts(800, 3)
    df = spark.createDataFrame(list(enumerate(a)), "i int, t string")
    c = F.col("t")
    for r in df.select("i", T.stripped(c).alias("s"), T.line_count(c).alias("l"), T.has_unescaped_quote(c).alias("q"), T.shown_length(T.without_tokens(c)).alias("n")).collect():
        t = a[r.i]
        assert r.s == t.strip() and r.l == len(t.splitlines() or [t])
        assert r.q == bool(re.search(r'(?<!\\)(?:\\\\)*"', t)) and r.n == len(re.sub(T.TOKEN, "", t).replace("\r", "").replace("\n", ""))


def test_unencodable(spark):
    df = spark.createDataFrame([("a€€文\U0001f600",), ("ok",), (None,)], "t string")
    rows = df.select(codecs.unencodable(F.col("t"), "gbk").alias("u"), codecs.encodes(F.col("t"), "gbk").alias("e")).collect()
    assert [(x["char"], x["codepoint"], x["count"]) for x in rows[0].u] == [("€", "U+20AC", 2), ("\U0001f600", "U+1F600", 1)]
    assert [r.e for r in rows] == [False, True, True] and rows[1].u == rows[2].u == []


def test_bytes(spark):
    raw = [(b"\xef\xbb\xbfa",), (b"\xff\xfea\0",), ("文".encode("cp932"),), (b"\x81",), (b"",)]
    df = spark.createDataFrame(raw, "b binary")
    rows = df.select(codecs.byte_order_mark(F.col("b")).alias("m"), codecs.decodable_as(F.col("b")).alias("d"), codecs.decoded(F.col("b")).alias("x")).collect()
    assert [r.m for r in rows] == ["utf-8-sig", "utf-16-le", "none", "none", "none"]
    assert [r.x.text for r in rows] == ["a", "a", "文", None, ""] and rows[2].x.encoding == "cp932" and "gbk" in rows[2].d


def test_paths(spark):
    from fnmatch import fnmatchcase

    pats = ["*.ks", "a?c/*", "[ab]*", "*_data/x", "lib/*/p*", "[!a]x"]
    names = ["a.ks", "x/y.ks", "abc/d", "b", "my_data/x", "lib/q/r/p1", "bx", "ax", "a.ks.txt"]
    for p in pats:
        rx = re.compile(paths.glob_regex(p))
        for n in names:
            assert bool(rx.search(n)) == fnmatchcase(n, p), (p, n)
    df = spark.createDataFrame([("\\A\\B.TXT/",), (".hid",), ("x.tar.GZ",), ("../a",), ("c:/x",), ("/abs",), ("a/..b",)], "p string")
    rows = df.select(paths.normal_path(F.col("p")).alias("n"), paths.extension(F.col("p")).alias("e"), paths.is_safe(F.col("p")).alias("s")).collect()
    assert rows[0].n == "a/b.txt" and [r.e for r in rows[1:3]] == ["", ".gz"] and [r.s for r in rows[3:]] == [False, False, False, True]
