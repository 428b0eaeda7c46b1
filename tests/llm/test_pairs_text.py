"""Answers, truncation, look-alikes and wrong encodings."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from segmill.llm import answers, charstats, mojibake, pairs, skeleton, truncation

COMMON = charstats.Commonness(dict.fromkeys("我的不了在是他们说话早上好明天见日本語中国文能翻译这段内容抱歉无法一二三四五。，", 1000), 1000)


@pytest.mark.parametrize(
    "source, target, expected",
    [
        ("はい。", None, "empty"),
        ("はい。", " ​[wait]\n", "empty"),
        ("はい。", "{{A3}}\\n", "empty"),
        ("明日また会おう。", "抱歉，我无法翻译这段内容。", "refusal"),
        ("明日また会おう。", "I'm sorry, but I can't translate this text.", "refusal"),
        ("明日また会おう。", "申し訳ありませんが、この文章は翻訳できません。", "refusal"),
        ("申し訳ない、断る。", "抱歉，我不能。", None),
        ("明日また会おう。", "> 明日 また会おう", "copied"),
        ("明日また会おう。", "译文：明日また会おう。", "copied"),
        ("明日また会おう。", "昨日は雨が降っていたので出かけなかった。", "other_language"),
        ("明日また会おう。", "See you again tomorrow.（早上）", "other_language"),
        ("明日また会おう。", "Мы ждали у старой двери.", "other_language"),
        ("明日また会おう。", "明天再见。", None),
        ("OK", "OK", None),
        ("(´・ω・｀)", "(´・ω・｀)", None),
        ("Привет!", "Привет!", None),
        (None, "明天见。", None),
        ("「Café」で会おう。", "在Café见。", None),
        ("明日また会おう。", "ÈË¹¤ÖÇÄÜ´óÕæÔÚÊýÀ´ºÅÈË", "garbled"),
        ("明日", "明天" * 200_000, None),
    ],
)
def test_defect(source, target, expected):
    assert answers.defect(source, target, COMMON) == expected


def test_copy_ratio_tells_copies_from_others():
    a, b = "扉の奥に北の国があり、そこで雨を待っている。", "昨日は雨が降っていたので出かけなかったのだ。"
    assert answers.copy_ratio(a, a) < 0.35 < answers.copy_ratio(a, b)


@pytest.mark.parametrize("text, expected", [("好。", True), ("好……", True), ("好——", True), ("“好。”", True), ("好。（错误 4）", True), ("去了，", False), ("去", False), ("「だめ」", True), ("在“早”", False)])
def test_ended(text, expected):
    assert truncation.ended(text) is expected


def test_core_drops_tokens_and_blanks():
    assert truncation.core(" 好。{name}\\n ​") == "好。" and truncation.core("[wait]") == ""


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(3.2, 0.4, 40_000)).round()
    seen = x[x < 30]
    lengths, counts = np.unique(seen, return_counts=True)
    mu, sd = truncation.fit_censored(lengths, counts, 30.0, float((x >= 30).sum()))
    assert abs(mu - 3.2) < 0.02 and abs(sd - 0.4) < 0.02


VALUES = "field_name string, feed string, id long, value string, peer string"


def cut_rows():
    rng = random.Random(4)
    words = [a + b for a in "春夏秋冬山川" for b in "花鳥風月雨雪"]
    rows, cut = [], set()
    for i in range(600):
        full = "，".join("去" + rng.choice(words) + "见" + rng.choice(words) for _ in range(rng.randint(2, 6))) + "。"
        feed = rng.choice(["limited", "whole", None])
        value = full
        if feed == "limited" and len(full) > 20 and rng.random() < 0.5:
            value = full[:20]
            cut.add(i)
        rows.append(("current.target", feed, i, value, "…のだ。"))
    rows += [("current.target", "whole", 1000 + k, "保存", "セーブ") for k in range(5)]
    rows += [("current.target", "whole", 2000, None, None), ("current.target", "whole", 2001, "", ""), ("current.target", "limited", 2002, "去春花见夏鳥，去秋�", "。")]
    return rows, cut | {2002}


def test_truncation(spark):
    rows, cut = cut_rows()
    df = spark.createDataFrame(rows, VALUES)
    kinds = {"current.target": "answer"}
    assert {r.id for r in truncation.judged(df, kinds).collect()} == cut
    rates = {r.feed: (r.cut, r.unit, r.limit_at) for r in truncation.rates(df, kinds).collect()}
    assert rates["limited"] in ((len(cut), "chars", 20), (len(cut), "bytes", 60)) and rates["whole"][0] == 0
    assert truncation.judged(df.where("false"), kinds).count() == 0
    doubled = truncation.judged(df.union(df), kinds).collect()
    assert sorted(r.id for r in doubled) == sorted([*cut, *cut])


def test_pairs(spark):
    shape = "id long, source string, target string, feed string, defect string"
    base = [("早上好。", "早。"), ("设定", "设置"), ("设定", "设置"), ("设定", "设定"), ("音量", "音量"), ("はい。", ""), ("はい。", ""), (None, None), ("明日また会おうと言った。", "他们说明天再见，在早"), ("明日また会おう。", "明日また会おう。")]
    df = spark.createDataFrame([(i, s, t, "f", "x") for i, (s, t) in enumerate(base)], shape)
    assert sorted(tuple(r) for r in pairs.defective(df).collect()) == [(3, "copied"), (5, "empty"), (6, "empty"), (7, "empty"), (8, "truncated"), (9, "copied")]
    assert pairs.defective(df.where("false")).count() == 0


FORMS = [
    ("ｶﾞﾗｽ", "ガラス"), ("ＡＩ８", "AI8"), ("Café", "Café"), ("a​b", "ab"), ("x y", "x y"), ("Р-1", "P-1"), ("口を", "ロを"), ("⽉", "月"), ("――", "—―"), ("⋯", "…"), ("　x", " x"),
]


def test_skeletons(spark):
    table = skeleton.look_alikes(spark)
    for a, b in FORMS:
        assert skeleton.skeleton(a, table) == skeleton.skeleton(b, table), (a, b)
    for a, b in [("はい", "はお"), ("つ", "っ"), ("ab", "a b"), ("か", "が"), ("は", "ぱ"), ("Abc", "abc"), ("2", "3"), ("10", "11")]:
        assert skeleton.skeleton(a, table) != skeleton.skeleton(b, table), (a, b)
    assert skeleton.skeleton("​ ﻿", table) == ""
    once = skeleton.skeleton("Ｃａｆé Éｔｏｉｌｅで、ﾃﾞｰﾀ", table)
    assert skeleton.skeleton(once, table) == once and unicodedata.is_normalized("NFD", once)


def test_look_alike_pairs_against_brute_force(spark):
    rng = random.Random(2)
    pool = [x for p in FORMS for x in p] + ["はい。", "はい｡", "", " ", "​", None]
    rows = [(f, i, rng.choice(pool)) for i, f in enumerate(rng.choices(["f", "g"], k=120))] + [("f", 500 + i, "はい。") for i in range(60)]
    rows.append(("f", 900, "x" * 100_000))
    values = spark.createDataFrame(rows, "field_name string, id long, value string").where("value IS NOT NULL")
    table = skeleton.look_alikes(spark)
    by = defaultdict(list)
    for f, i, v in rows:
        if v is not None and (k := skeleton.skeleton(v, table)):
            by[f, k].append((i, v))
    want = {(f, min(i, j), max(i, j)) for (f, _), m in by.items() for i, v in m for j, w in m if v != w}
    got = [tuple(r) for r in skeleton.look_alike_pairs(values).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    forms = {r.id: r.canonical for r in skeleton.normalised(values).collect()}
    assert len(forms) == values.count() and forms[500] == "はい。" and all(forms[i] == "はい。" for f, i, v in rows if f == "f" and v == "はい｡")
    assert skeleton.look_alike_pairs(values.where("false")).count() == 0


def corpus():
    rng = random.Random(9)
    words = ["北の国", "雨を待つ", "扉の奥", "春の花", "ガラスの海", "声が響いた", "本を読む", "町へ行く", "見つからない", "調べてから", "夜明け前に", "思い出した"]
    return ["、".join(rng.sample(words, rng.randint(2, 5))) + "。" for _ in range(800)]


@pytest.mark.parametrize("read_as, really", [("latin-1", "utf-8"), ("cp1252", "cp932"), ("cp932", "utf-8"), ("gb18030", "utf-8"), ("gb18030", "cp932"), ("koi8-r", "utf-8"), ("mac-roman", "utf-8"), ("latin-1", "euc-jp")])
def test_encodings_are_restored(spark, read_as, really):
    texts = corpus()
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "field_name string, id long, value string")
    model = _model(spark, df)
    garbled = 0
    for t in texts[:40]:
        bad = "".join(bytes([b]).decode(read_as) if _single(read_as) and _reads(b, read_as) else chr(b) if _single(read_as) else "" for b in t.encode(really)) if _single(read_as) else t.encode(really).decode(read_as, "replace")
        found, fixed, how = mojibake.restore(bad, *model)
        assert found, bad
        garbled += fixed == t
    assert garbled >= (40 if _single(read_as) else 20)
    for t in texts[:40] + ["Привет, мир!", "ﾊｧﾊｧ", "Không ai biết chìa khóa", "扉の奥に�", "はい"]:
        assert not mojibake.restore(t, *model)[0], t


_models = {}


def _model(spark, df):
    if not _models:
        common = charstats.commonness(df)
        _models["m"] = (common, mojibake.word_counts(df, common))
    return _models["m"]


def _single(codec):
    return codec in ("latin-1", "cp1252", "koi8-r", "mac-roman")


def _reads(b, codec):
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


def test_repaired_rows(spark):
    texts = corpus()
    half = texts[0][:6] + texts[0][6:].encode().decode("latin-1")
    twice = texts[1].encode().decode("cp1252", "ignore").encode().decode("cp1252", "ignore")
    rows = [("f", i, t) for i, t in enumerate(texts)] + [("f", 9000, half), ("f", 9000, half), ("f", 9001, None), ("f", 9002, ""), ("f", 9003, twice)]
    df = spark.createDataFrame(rows, "field_name string, id long, value string")
    got = [(r.id, r.restored) for r in mojibake.repaired(df).orderBy("id").collect()]
    assert got[:2] == [(9000, texts[0])] * 2 and got[2][0] == 9003 and len(got) == 3
    assert mojibake.repaired(df.where("false")).count() == 0


def test_all_pairs_are_counted(spark):
    rng = random.Random(3)
    texts = ["".join(chr(0x4E00 + rng.randrange(600)) for _ in range(2000)) for _ in range(500)]
    want = Counter(p for t in texts for p in map(str.__add__, t, t[1:]))
    want = {p: n for p, n in want.items() if n > 1}
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    words, single = mojibake.word_counts(df, charstats.commonness(df)), Counter("".join(texts))
    assert len(want) > 220_000 and sum(len(seconds) for seconds, _ in words.following.values()) == len(want) + sum(n > 1 for n in Counter(t[-1] for t in texts).values())
    assert all(abs(words.step(p[0], p[1]) - math.log(n / single[p[0]])) < 1e-5 for p, n in want.items())


def test_search_leaves_nothing_out():
    block = [chr(c) for c in range(0x5300, 0x5340)]  # all share two UTF-8 bytes
    single = {c: 1000 - i for i, c in enumerate(block)} | {"甲": 500, "乙": 500, "\n": 5000}
    last = block[-1]  # the least frequent of 64, told by its neighbours
    words = mojibake.Words(single, [("甲", last, [400]), (last, "乙", [400]), ("\n", "甲", [400]), ("乙", "\n", [400])])
    assert len(words.fitting("utf-8", (*last.encode()[:2], mojibake.LOST))) == 64
    bad = "甲".encode().decode("latin-1") + last.encode()[:2].decode("latin-1") + "�" + "乙".encode().decode("latin-1")
    assert mojibake.decode(bad, "latin-1", "utf-8", words)[0] == f"甲{last}乙"
    common = charstats.Commonness(dict.fromkeys(single, 1000), 1000)
    assert mojibake.restore("甲".encode().decode("latin-1"), common, words)[:2] == (True, "甲")  # one character is enough


@pytest.mark.parametrize("read_as", ["latin-1", "gb18030"])
def test_common_garbled_texts_are_searched(spark, read_as):
    texts = sorted(set(corpus()))
    bad = {t[:k].encode().decode(read_as, "replace") for t in texts for k in (6, 8, 10, 12)}
    bad = [b for b in sorted(bad) if "�" not in b][:120]  # no broken characters where two bytes are read as one
    copied = texts[0].encode().decode("koi8-r")  # one line, copied into many rows
    rows = [*enumerate(texts), *((10_000 + i, b) for i, b in enumerate(bad)), *((20_000 + i, copied) for i in range(200))]
    df = spark.createDataFrame([("f", i, t) for i, t in rows], "field_name string, id long, value string")
    got = {r.id for r in mojibake.repaired(df).collect()}
    assert got == {i for i, _ in rows if i >= 10_000} and len(bad) >= 10
