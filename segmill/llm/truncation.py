"""Text cut off by field limits: censored length distributions per source, combined with ending evidence."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import answers, charstats
from segmill.session import checkpointed

#: End marks and closers of complete or trailing-off wording (fixed values).
_ENDS = set("。．.｡！!？?…‥⋯♪♫♡☆★—―─～〜~‼⁇⁈⁉ー・")
_CLOSERS = "”’」』）)】〉》］]\"'»｣"
_OPENERS = {"“": "”", "「": "」", "『": "』", "（": "）", "《": "》"}
_OPEN_TOKEN = re.compile(r"(?:\{\{?[A-Za-z0-9_:]*|\[[A-Za-z]*|%(?:\d+\$?)?|\\)\Z")
_GROUP = re.compile(r"[（(][^（()）]{0,40}[)）]\Z")
_DANGLING = set("，、,；;：:“「『（《·")

#: Weights of evidence, in nats, beside the fitted lengths: what a mark at the end, the peer and repetition say.
W = {"prior": -4.0, "lost": 6.0, "dangling": 4.0, "open_token": 3.0, "peer_ended": 4.0, "peer_open": -6.0, "peer_longer": 8.0, "repeated": -5.0, "single": 1.5, "context": 0.4}
#: Times that a text without end mark occurs from which it is a complete line that recurs.
REPEATED = 3
#: Least number of open endings at a candidate limit, and how many standard deviations more than the fit expects there.
LEAST, DEVIATIONS = 5, 4.0
#: Observations that a fit begins with, as if seen: complete texts (log of length) and complete lines without mark (length).
TEXTS, LINES = (3.0, 0.8, 5.0), (4.0, 2.0, 5.0)
#: Bounds of the evidence of the lengths and of the last character, in nats.
MOST, MOST_CONTEXT = 8.0, 2.0


def core(text: str) -> str:
    """The text without control tokens at its end, outer white space and characters without ink."""
    held = answers.EMPTY.sub(lambda m: " " if any(map(str.isspace, m.group())) else "", text).strip()
    while True:
        m = None
        for m in answers.CONTROL.finditer(held):
            pass
        if m is None or m.end() != len(held):
            return held
        held = held[: m.start()].rstrip()


def ended(text: str) -> bool:
    """Whether the wording (without tokens) ends with an end mark, perhaps before closers or a bracketed note."""
    held = text
    while (m := _GROUP.search(held)) and m.start() > 0:
        held = held[: m.start()].rstrip()
    bare = held.rstrip(_CLOSERS)
    if not bare:
        return True
    if bare[-1] in _ENDS:
        return True
    # a line wholly inside one pair of brackets is complete without a mark
    return held != bare and _OPENERS.get(held[0]) == held[-1] and held.count(held[0]) == held.count(held[-1])


def evidence(text: str, peer: str | None, kind: str, common: charstats.Commonness | None = None) -> float:
    """Log odds from the ending alone; ``kind`` says how the peer relates: ``answer`` to it, or ``derived`` from it.

    The terminal context: a last character that stands inside most texts that hold it speaks for a cut, one
    that ends them against it (counted over all distinct texts).
    """
    held = core(text)
    total = W["prior"]
    if held.endswith("\ufffd"):
        total += W["lost"]
        held = held.rstrip("\ufffd")
    if held and held[-1] in _DANGLING:
        total += W["dangling"]
    if _OPEN_TOKEN.search(held):
        total += W["open_token"]
    if held and common is not None:
        total += max(-MOST_CONTEXT, min(MOST_CONTEXT, W["context"] * common.goes_on(held[-1])))
    if peer:
        other = core(peer)
        if kind == "answer":
            if other and not other.endswith("\ufffd"):
                total += W["peer_ended"] if ended(other) else W["peer_open"]
        elif len(held) >= 4 and len(other) > len(held) + 1 and other.lstrip("「『（").startswith(held.lstrip("「『（")):
            total += W["peer_longer"]
    return total


def beyond(length, mu: float, sd: float):
    """Share of the fitted texts that are longer."""
    z = (np.log(np.maximum(length, 1)) - mu) / (sd * math.sqrt(2))
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(z)


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limit, censored, start: tuple[float, float, float] | None = None) -> tuple[float, float]:
    """Maximum likelihood of a log-normal length distribution, ``censored`` values known to exceed ``limit``.

    Expectation-maximisation: the censored values take their conditional moments. ``limit`` and ``censored``
    may be several; ``start`` is a mean, a deviation and a number of values (of the log) as if seen before.
    """
    x, at, cut = np.log(np.maximum(lengths, 1)), np.log(np.atleast_1d(np.asarray(limit, float))), np.atleast_1d(np.asarray(censored, float))
    m0, s0, n0 = start or (0.0, 0.0, 0.0)
    n = counts.sum() + n0
    sum1, sum2 = (x * counts).sum() + n0 * m0, (x * x * counts).sum() + n0 * (m0 * m0 + s0 * s0)
    mu = float(sum1 / n)
    sd = math.sqrt(max(0.0025, float(sum2 / n) - mu * mu))
    while True:
        tail = np.maximum(beyond(np.exp(at), mu, sd), 1e-12)
        hazard = np.exp(-(((at - mu) / sd) ** 2) / 2) / math.sqrt(2 * math.pi) / tail
        first, second = mu + sd * hazard, mu * mu + sd * sd + sd * (at + mu) * hazard
        new = float((sum1 + (cut * first).sum()) / (n + cut.sum()))
        new_sd = math.sqrt(max(0.0025, float((sum2 + (cut * second).sum()) / (n + cut.sum())) - new * new))
        done = abs(new - mu) + abs(new_sd - sd) < 1e-5
        mu, sd = new, new_sd
        if done:  # the likelihood grows with every step, and is bounded
            return mu, sd


class Fit:
    """Lengths of one source: complete texts (log-normal, censored at its limits) and what open endings are made of.

    An open ending is a complete line without a mark (normal length of the lines that recur), a text cut at
    any place (every length below the text's own, so the fitted survival function over its mean), or one cut at a limit. The
    shares of the three are fitted by expectation-maximisation. Limits are the lengths with significantly
    more open endings than the fit explains, taken one by one, the most significant first; a limit can't
    have cut more texts than the fitted distribution holds beyond it.
    """

    def __init__(self, lengths, counts, chars, sizes, cores, n, lines: tuple[float, float]):
        self.lengths, self.counts = np.asarray(lengths, float), np.asarray(counts, float)
        self.chars, self.sizes, self.cores, self.n = (np.asarray(v, float) for v in (chars, sizes, cores, n))
        self.lines = lines
        self.limits: list[tuple[str, int]] = []
        self._refit()
        while len(self.n) and (best := self._candidate()) is not None:
            self.limits.append(best)
            self._refit()

    @staticmethod
    def hits(unit: str, at, chars, sizes):
        """Whether a text of so many characters and bytes may have been cut at a limit; for bytes the last character may not have fitted."""
        return (chars == at) if unit == "chars" else (sizes <= at) & (sizes > at - 3)

    def _refit(self):
        total, open_ = self.counts.sum(), max(1.0, self.n.sum())
        masks = [self.hits(u, at, self.chars, self.sizes) for u, at in self.limits]
        held = [float((self.n * m).sum()) for m in masks]
        at = [max(1.0, float((self.chars * self.n * m).sum()) / h) if h else 1.0 for m, h in zip(masks, held, strict=True)]
        self.mu, self.sd = fit_censored(self.lengths, self.counts, at or [1.0], held or [0.0], TEXTS)
        mean = math.exp(self.mu + self.sd * self.sd / 2)
        # most that each limit can have cut, as a share of the open endings
        most = [float(beyond(a, self.mu, self.sd)) * (total + open_) / open_ for a in at]
        density = np.array([self._line(self.cores), beyond(self.chars, self.mu, self.sd) / mean, *(m.astype(float) for m in masks)])
        share = np.full(len(density), 1.0 / len(density))
        while len(self.n):
            part = share[:, None] * density + 1e-300
            new = ((part / part.sum(0)) * self.n).sum(1) + 0.5  # half an ending of each kind as if seen
            new /= new.sum()
            if np.abs(new - share).max() < 1e-4:
                break
            share = new
        self.line_share, self.any_share = float(share[0]), float(share[1])
        self.limit_shares = [min(float(s), m) for s, m in zip(share[2:], most, strict=True)]
        self.mean = mean
        return self

    def _line(self, cores):
        mean, sd = self.lines
        return np.exp(-(((cores - mean) / sd) ** 2) / 2) / (sd * math.sqrt(2 * math.pi))

    def _expected(self, chars, sizes, cores):
        """Share of open endings of this shape that aren't explained by a further limit."""
        out = self.line_share * self._line(cores) + self.any_share * beyond(chars, self.mu, self.sd) / self.mean
        for (unit, at), share in zip(self.limits, self.limit_shares, strict=True):
            out = out + share * self.hits(unit, at, chars, sizes)
        return out

    def _candidate(self) -> tuple[str, int] | None:
        explained = np.zeros(len(self.n), bool)
        for unit, at in self.limits:
            explained |= self.hits(unit, at, self.chars, self.sizes)
        left, best = ~explained, None
        total = self.n.sum()
        for unit, own in (("chars", self.chars), ("bytes", self.sizes)):
            for at in np.unique(own[left]):
                if (unit, int(at)) in self.limits:
                    continue
                here = self.hits(unit, at, self.chars, self.sizes) & left
                seen = float(self.n[here].sum())
                if seen < LEAST:
                    continue
                mean = [float((v[here] * self.n[here]).sum()) / seen for v in (self.chars, self.sizes, self.cores)]
                wide = 1.0 if unit == "chars" else max(1.0, 3 * mean[0] / max(1.0, mean[1]))  # three bytes in characters
                expected = total * wide * float(self.line_share * self._line(mean[2]) + self.any_share * beyond(mean[0], self.mu, self.sd) / self.mean)
                sure = (seen - expected) / math.sqrt(expected + 1)
                if sure > DEVIATIONS and (best is None or (sure, unit == "chars") > best[0]):
                    best = ((sure, unit == "chars"), (unit, int(at)))
        return best and best[1]

    def posterior(self, k: int) -> float:
        """Share of the open endings at a limit that it has cut."""
        unit, at = self.limits[k]
        here = self.hits(unit, at, self.chars, self.sizes)
        rest = float((self.n * here).sum()) / max(1.0, self.n.sum())
        return self.limit_shares[k] / max(self.limit_shares[k], rest, 1e-9)


def censoring(fit: dict, chars: int, size: int, core_length: int) -> float:
    """Log odds that an open ending of this length is a cut one under its source's fit, against a complete line.

    Censored mass at the length (of the limits it stands at, and of cuts at any place) against the density
    of true ends there.
    """
    cut = fit["any_share"] * float(beyond(chars, fit["mu"], fit["sd"])) / fit["mean"]
    for x in fit["limits"] or ():
        if Fit.hits(x["unit"], x["limit_at"], chars, size):
            cut += x["share"]
    z = (core_length - fit["line_mean"]) / fit["line_sd"]
    line = fit["line_share"] * math.exp(-min(z * z, 1400.0) / 2) / (fit["line_sd"] * math.sqrt(2 * math.pi))
    return max(-MOST, min(MOST, math.log(cut + 1e-12) - math.log(line + 1e-12)))


def _observe(common, judge: Callable):
    """Per batch: the histogram of lengths, and the values with open endings one by one."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        hist: Counter[tuple] = Counter()
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("field_name", "feed", "id", "value", "peer")}
            keep: list[int] = []
            chars, sizes, cores = [], [], []
            for k, (field, feed, text) in enumerate(zip(cols["field_name"], cols["feed"], cols["value"], strict=True)):
                if not text:
                    continue
                held = core(text)
                if not held:
                    continue
                n, size = len(text), len(text.rstrip("\ufffd").encode("utf-8", "surrogatepass"))
                complete = not held.endswith("\ufffd") and ended(held)
                if not complete:
                    if judge(field, cols["peer"][k], text, known):
                        continue
                    keep.append(k)
                    chars.append(n)
                    sizes.append(size)
                    cores.append(len(held))
                hist[field, feed, n, complete] += 1
            if keep:
                at = pa.array(keep, pa.int64())
                m = len(keep)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in ("field_name", "feed", "id", "value", "peer")), pa.array(chars, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cores, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64())],
                    names=_NAMES,
                )
        if hist:
            m = len(hist)
            f, s, n, done = zip(*hist, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(f, pa.string()), pa.array(s, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(n, pa.int64()), pa.array(done, pa.bool_()), pa.array(hist.values(), pa.int64())],
                names=_NAMES,
            )

    return observe


_NAMES = ["field_name", "feed", "id", "value", "peer", "chars", "size", "core", "length", "complete", "n"]
_SHAPE = "field_name string, feed string, id long, value string, peer string, chars long, size long, core long, length long, complete boolean, n long"


def _excused(field: str, peer: str | None, text: str, common: charstats.Commonness) -> bool:
    """Values whose open ending says nothing: garbled ones, refusals, copies and other languages."""
    if field.endswith("target"):
        return answers.defect(peer, text, common) is not None
    return answers.looks_garbled(text, common)


def observed(values: DataFrame, common: charstats.Commonness) -> DataFrame:
    """One pass over ``(field_name, feed, id, value, peer)``: histograms and open endings, checkpointed (small)."""
    shared = values.sparkSession.sparkContext.broadcast(common)
    return checkpointed(values.select("field_name", "feed", "id", "value", "peer").mapInArrow(_observe(shared, _excused), _SHAPE))


def recurrence(seen: DataFrame) -> DataFrame:
    """``(field_name, feed, value, chars, size, core, times)`` of the different open endings; ``times`` over all sources.

    Copies are counted map-side, so a value in any part of the rows is one row per task.
    """
    own = seen.where("n IS NULL").groupBy("field_name", "feed", "value", "chars", "size", "core").agg(F.count("*").alias("rows"))
    times = own.groupBy("field_name", "value").agg(F.sum("rows").alias("times"))
    return own.join(times, ["field_name", "value"]).drop("rows")


_FIT = "field_name string, feed string, mu double, sd double, mean double, line_mean double, line_sd double, line_share double, any_share double, limits array<struct<unit:string,limit_at:long,share:double,posterior:double>>"


def cut_limits(seen: DataFrame, repeats: DataFrame) -> DataFrame:
    """One row per source: the parameters of its :class:`Fit`. A group holds histograms only, whatever the source's size.

    Open endings count once a different text. Complete lines without mark are those that recur, over all
    sources of a field.
    """
    complete = seen.where("n IS NOT NULL AND complete").groupBy("field_name", "feed", "length").agg(F.sum("n").alias("n"))
    lines = repeats.where(F.col("times") >= REPEATED).groupBy("field_name").agg(F.count("*").alias("k"), F.sum("core").alias("s1"), F.sum(F.col("core") * F.col("core")).alias("s2"))
    shapes = repeats.groupBy("field_name", "feed", "chars", "size", "core").agg(F.count("*").alias("n")).join(lines, "field_name", "left")
    both = complete.unionByName(shapes, allowMissingColumns=True)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        done, open_ = pdf[pdf["length"].notna()], pdf[pdf["length"].isna()]
        m0, s0, n0 = LINES
        k, s1, s2 = (float(open_[c].fillna(0).max()) if len(open_) else 0.0 for c in ("k", "s1", "s2"))
        mean = (s1 + n0 * m0) / (k + n0)
        sd = math.sqrt(max(0.25, (s2 + n0 * (m0 * m0 + s0 * s0)) / (k + n0) - mean * mean))
        own = Fit(done["length"], done["n"], open_["chars"], open_["size"], open_["core"], open_["n"], (mean, sd))
        limits = [{"unit": u, "limit_at": at, "share": own.limit_shares[i], "posterior": own.posterior(i)} for i, (u, at) in enumerate(own.limits)]
        return pd.DataFrame([[key[0], key[1], own.mu, own.sd, own.mean, mean, sd, own.line_share, own.any_share, limits]], columns=_FIT_NAMES)

    return both.groupBy("field_name", "feed").applyInPandas(fit, _FIT)


_FIT_NAMES = [c.split(" ")[0] for c in _FIT.split(", ")]


def judged(values: DataFrame, kinds: dict[str, str], seen: DataFrame | None = None, common: charstats.Commonness | None = None) -> DataFrame:
    """``(field_name, feed, id, log_odds)`` of every value with an open ending that is more likely cut than not.

    ``values`` is ``(field_name, feed, id, value, peer)``; ``kinds`` says of each field whether it is an
    ``answer`` to its peer or ``derived`` from it. The log odds add the censoring posterior of the value's
    length under its source's fit (:func:`censoring`) and the evidence of the ending, of its peer and of
    repetition (complete short lines recur).

    NULL, empty and blank values are never cut; a NULL source of the text is a source like the others;
    repeated rows are judged alike; whole texts count, however long. Empty tables give no rows.
    """
    common = charstats.commonness(values) if common is None else common
    seen = observed(values, common) if seen is None else seen
    shared = values.sparkSession.sparkContext.broadcast(common)
    open_ = seen.where("n IS NULL").drop("length", "complete", "n")
    repeats = checkpointed(recurrence(seen))  # different open endings only
    found = cut_limits(seen, repeats).select(F.col("field_name").alias("g"), F.col("feed").alias("f"), F.struct(*_FIT_NAMES[2:]).alias("fit"))
    # rows of a value or source with a third of all rows are split by AQE; the other sides have one row per value and source
    times = repeats.select("field_name", "value", "times").distinct()
    joined = open_.join(times, ["field_name", "value"]).join(found, (F.col("g") == F.col("field_name")) & F.col("f").eqNullSafe(F.col("feed")), "left")
    here = joined.select("field_name", "feed", "id", "value", "peer", "chars", "size", "core", "times", "fit")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            odds = []
            for r in batch.to_pylist():
                total, fit = evidence(r["value"], r["peer"], kinds[r["field_name"]], known), r["fit"]
                if fit is not None:
                    total += censoring(fit, r["chars"], r["size"], r["core"])
                    if r["times"] >= REPEATED and r["core"] <= fit["line_mean"] + 4 * fit["line_sd"]:
                        total += W["repeated"]
                if r["times"] == 1:
                    total += W["single"]
                odds.append(total)
            keep = pa.array([k for k, x in enumerate(odds) if x > 0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("field_name").take(keep), batch.column("feed").take(keep), batch.column("id").take(keep), pa.array(odds, pa.float64()).take(keep)], names=["field_name", "feed", "id", "log_odds"]
            )

    return here.mapInArrow(weigh, "field_name string, feed string, id long, log_odds double")


def rates(values: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``(field_name, feed, texts, cut, rate, unit, limit_at)``: how often each source cuts, and where.

    ``unit`` and ``limit_at`` are those of the limit with most cuts, NULL where a source cuts anywhere.
    """
    common = charstats.commonness(values)
    seen = observed(values, common)
    cut = judged(values, kinds, seen, common).groupBy("field_name", "feed").agg(F.count("*").alias("cut"))
    texts = seen.where("n IS NOT NULL").groupBy("field_name", "feed").agg(F.sum("n").alias("texts"))
    most = F.array_max(F.transform("limits", lambda x: F.struct(x["share"].alias("share"), x["unit"].alias("unit"), x["limit_at"].alias("limit_at"))))
    sure = cut_limits(seen, recurrence(seen)).select("field_name", "feed", most.alias("best"))
    on = lambda other: [F.col("t.field_name") == F.col(f"{other}.field_name"), F.col("t.feed").eqNullSafe(F.col(f"{other}.feed"))]
    out = texts.alias("t").join(cut.alias("c"), on("c"), "left").join(sure.alias("s"), on("s"), "left")
    n = F.coalesce("c.cut", F.lit(0))
    return out.select("t.field_name", "t.feed", "t.texts", n.alias("cut"), (n / F.col("t.texts")).alias("rate"), "s.best.unit", "s.best.limit_at")
