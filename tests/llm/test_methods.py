"""The named method of each operator decides its result: switched off, the result changes."""

import random

import numpy as np
import pytest

from segmill.llm import answers, pairs, truncation

VALUES = "field_name string, feed string, id long, value string, peer string"
WORDS = [a + b for a in "春夏秋冬山川" for b in "花鳥風月雨雪"]


def sentence(rng, least=2, most=6):
    return "、".join("去" + rng.choice(WORDS) + "を見て" + rng.choice(WORDS) for _ in range(rng.randint(least, most)))


def limited_rows(limit=30, size=None):
    """Texts without peers; one of two sources cuts a tenth of its texts at a limit, the other one of a hundred anywhere."""
    rng = random.Random(11)
    rows, cut = [], set()
    for i in range(1200):
        full = ("" if size is None else "K" * rng.randint(0, 5)) + sentence(rng) + "。"  # bytes aren't characters
        feed, value = ("limited", "whole")[i % 2], full
        if feed == "limited" and len(full) > limit and rng.random() < 0.1:
            value = full[:limit] if size is None else full.encode()[:size].decode("utf-8", "ignore")
            if value != full:
                cut.add(i)
        elif feed == "whole" and rng.random() < 0.01:
            value = full[: rng.randint(8, len(full) - 2)]
            cut.add(i)
        rows.append(("f", feed, i, value, None))
    short = ["保存", "設定", "終了する", "つづきから", "はじめる", "もどる"]
    return rows + [("f", rng.choice(["limited", "whole"]), 5000 + k, rng.choice(short), None) for k in range(120)], cut


@pytest.mark.parametrize("size", [None, 91])
def test_censored_fit_decides(spark, monkeypatch, size):
    rows, cut = limited_rows(size=size)
    df, kinds = spark.createDataFrame(rows, VALUES), {"f": "derived"}
    got = {r.id for r in truncation.judged(df, kinds).collect()}
    at_limit = {i for i in cut if rows[i][1] == "limited"}
    assert got <= cut and len(got & at_limit) >= 0.9 * len(at_limit) and len(got) >= 0.9 * len(cut)
    rates = {r.feed: (r.unit, r.limit_at) for r in truncation.rates(df, kinds).collect()}
    unit, at = rates["limited"]
    assert (unit, at) == ("chars", 30) if size is None else unit == "bytes" and size - 2 <= at <= size
    assert rates["whole"] == (None, None)
    own = truncation.cut_limits
    monkeypatch.setattr(truncation, "cut_limits", lambda *a: own(*a).where("false"))
    assert len({r.id for r in truncation.judged(df, kinds).collect()} & at_limit) < 0.5 * len(at_limit)


def test_spike_beyond_the_tail_is_no_limit():
    """Equal lengths where the fitted texts end don't count as cut beyond what the tail holds."""
    lengths, counts = np.arange(10, 31), np.full(21, 100)
    few = truncation.Fit(lengths, counts, [28] * 40, [84] * 40, [28] * 40, [1] * 40, (3.0, 1.0))
    far = truncation.Fit(lengths, counts, [90] * 40, [270] * 40, [90] * 40, [1] * 40, (3.0, 1.0))
    assert few.limits == [("chars", 28)] and few.posterior(0) > 0.9 and all(far.posterior(k) < 0.1 for k in range(len(far.limits)))


def edited_copies():
    rng = random.Random(12)
    out = []
    for i in range(60):
        source = sentence(rng, 2, 3) + "と言った。"
        k = rng.randrange(4, len(source) - 6)
        given = [source[:k] + "とても" + source[k:], source[:k] + source[k + 3 :], "原文：" + source[:k] + "きっと" + source[k:]][i % 3]
        out.append((i, source, given, "f"))
    others = [(100 + i, sentence(rng, 2, 3) + "と言った。", sentence(rng, 2, 3) + "と聞いた。", "f") for i in range(60)]
    return out, others + [(200 + i, "明日また会おうと言った。", "他们说明天再见。", "f") for i in range(30)]


def test_dictionary_compression_decides(spark, monkeypatch):
    copies, others = edited_copies()
    df = spark.createDataFrame(copies + others, "id long, source string, target string, feed string")
    copied = lambda: {r.id for r in pairs.defective(df).collect() if r.defect == "copied"}
    got = copied()
    assert len(got & {r[0] for r in copies}) >= 57 and not any(i >= 200 for i in got)
    assert not any(answers.letters_only(s) == answers.letters_only(t) for _, s, t, _ in copies)  # equality finds none of them
    ratio = answers.copy_ratio
    assert all(ratio(s, s) == 0 for s in ("はい", "だ", "明日また会おう")) and ratio("はい", "好的") > 0.9 and ratio("静かに", "安静") > 0.6


def test_language_dictionaries():
    assert [answers.language_of(t)[0] for t in ("Nobody told him.", "La porte est fermée.", "Где же он был?", "Không ai biết.", "明天见")] == ["en", "fr", "ru", "vi", None]
