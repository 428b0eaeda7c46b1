"""Mixing sources to target shares of tokens: entropy balancing, then copies by systematic rounding."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmill.llm import tokens
from segmill.session import checkpointed, small_table

#: Documents of one source and length above which they are rounded in several pieces, and greatest number of such
#: pairs of a source and a length (a larger table raises the first).
PIECE, MOST_HOT = 50_000, 100_000
#: Starting points of the rounding that are compared.
STARTS = 256
#: Newton steps (or bisections) after which a problem that isn't solved is an error.
STEPS = 200


class Target(NamedTuple):
    share: float
    repeats: int


def tilted(lengths: np.ndarray, cap: float, base: float, tilt: float, scale: float) -> np.ndarray:
    """Expected copies by length: the odds ``rate / (cap - rate)`` are those of the base rate, tilted exponentially, so that the cap holds."""
    z = math.log(base / (1 - base)) + tilt * lengths / scale
    return cap / (1 + np.exp(-np.clip(z, -500.0, 500.0)))


def solve(lengths: np.ndarray, docs: np.ndarray, budget: float, cap: float, base: float, scale: float, tolerance: float = 1e-6, steps: int = STEPS) -> float:
    """The tilt at which the expected tokens of a source are its budget: Newton steps on its convex dual.

    Brackets keep the steps safe. A source that must give all it may has an infinite tilt, the cap as its rate;
    a problem that isn't solved in ``steps`` raises.
    """
    weight = (lengths * docs).astype(float)
    if budget >= cap * weight.sum() * (1 - tolerance):
        return math.inf
    tilt, low, high = 0.0, -math.inf, math.inf
    for _ in range(steps):
        rate = tilted(lengths, cap, base, tilt, scale)
        gap = float((weight * rate).sum()) - budget
        if abs(gap) <= tolerance * budget:
            return tilt
        slope = float((weight * lengths / scale * rate * (1 - rate / cap)).sum())
        low, high = (low, tilt) if gap > 0 else (tilt, high)
        step = tilt - gap / slope if slope > 0 else math.nan
        if not low < step < high:
            lo = low if low > -math.inf else min(tilt, high) * 2 - 1
            hi = high if high < math.inf else max(tilt, low) * 2 + 1
            step = (lo + hi) / 2
        tilt = step
    raise RuntimeError("entropy balancing isn't solved")


def whole(place: np.ndarray, start) -> np.ndarray:
    """Whole numbers up to a place of the running sum; places agree to a billionth, so that sums that are whole but for rounding errors count once."""
    return np.floor(np.round(place + start, 9))


class Budgets(NamedTuple):
    """Token budgets of the targets that have documents, and the common base rate and length."""

    base: float
    scale: float
    budget: dict[str, float]
    live: dict[str, Target]


def budgets(histogram: DataFrame, targets: Mapping[str, Target], total: float | None = None) -> Budgets | None:
    """The budgets of a total, at most (and by default) what the caps allow; None where no target has documents. Sums of targets alone reach the driver."""
    names = histogram.sparkSession.createDataFrame([(s,) for s in targets], "source string")
    own = histogram.join(F.broadcast(names), "source")  # as few rows as targets
    sums = {r.source: (r.t, r.n) for r in own.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("t"), F.sum("docs").alias("n")).collect()}
    live = {s: t for s, t in targets.items() if sums.get(s, (0, 0))[0] and t.share > 0 and t.repeats > 0}
    if not live:
        return None
    norm = sum(t.share for t in live.values())
    attainable = min(t.repeats * sums[s][0] / (t.share / norm) for s, t in live.items())
    total = min(total, attainable) if total else attainable
    base = min(0.95, max(0.02, total / sum(t.repeats * sums[s][0] for s, t in live.items())))
    scale = max(1.0, sum(sums[s][0] for s in live) / sum(sums[s][1] for s in live))
    return Budgets(base, scale, {s: total * t.share / norm for s, t in live.items()}, live)


def balance(histogram: DataFrame, given: Budgets) -> DataFrame:
    """``(source, tokens, docs, rate, cap, offset, start)`` of every length of every live source.

    The rates maximise the entropy relative to one base rate under one token constraint per source and the
    cap on repeats. The dual is convex and separable by source, so each source's Newton iterations run in a task of their own
    over its histogram: one row per different length, at most the root of twice its tokens, however many documents it has. ``offset`` is the running sum of the rates
    before the length, ``start`` the starting point of the rounding whose tokens come nearest to the budget, of :data:`STARTS`.
    """

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tokens")
        lengths, docs = pdf["tokens"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64)
        cap, budget = float(given.live[key[0]].repeats), given.budget[key[0]]
        tilt = solve(lengths, docs, budget, cap, given.base, given.scale)
        rate = np.full(len(pdf), cap) if tilt == math.inf else tilted(lengths, cap, given.base, tilt, given.scale)
        end = np.cumsum(docs * rate)
        offset = np.concatenate(([0.0], end[:-1]))
        starts = (np.arange(STARTS) + 0.5) / STARTS
        got = [float((lengths * (whole(offset + docs * rate, s) - whole(offset, s))).sum()) for s in starts]
        best = starts[int(np.abs(np.array(got) - budget).argmin())]
        return pd.DataFrame({"source": key[0], "tokens": lengths, "docs": docs, "rate": rate, "cap": cap, "offset": offset, "start": best})

    live = histogram.sparkSession.createDataFrame([(s,) for s in given.live], "source string")
    own = histogram.join(F.broadcast(live), "source")
    return own.groupBy("source").applyInPandas(fit, "source string, tokens long, docs long, rate double, cap double, offset double, start double")


def token_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = "gpt2", directory: str | None = None) -> DataFrame:
    """``(doc_id, source, tokens)`` of every document, written once (it is read by every step)."""
    named = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return checkpointed(tokens.counted(named, ["doc_id", "source"], "text", {"tokens": tokens.FILES.get(tokenizer, tokenizer)}, directory))


def select(counts: DataFrame, targets: Mapping[str, Target], total: float | None = None) -> DataFrame:
    """``(doc_id, source, tokens, copies)`` of the drawn documents.

    Takes :func:`token_table`. ``total`` is the wanted number of tokens, at most (and by default) what the
    caps allow. Rates become copies by systematic rounding: inside a source documents are ordered by
    length, piece and id, and a document gets as many copies as whole numbers its stretch of the running
    sum passes, so no document gets more than its source's cap. As the rate depends on source and length
    alone, the running sums are those of the histogram; documents are only numbered inside a piece, a
    source and a length, or a hash part of it where there are more than :data:`PIECE`. The rounding may start anywhere:
    of :data:`STARTS` starting points each source takes the one whose tokens come nearest to its budget.

    Sources without a target, documents without tokens (NULL, empty) and without source are never drawn;
    targets without documents can't be met, and the shares of the others are raised in proportion. Every
    repeated row counts as a document. Empty tables give no rows.
    """
    usable = counts.where("tokens > 0 AND source IS NOT NULL")
    histogram = checkpointed(usable.groupBy("source", "tokens").agg(F.count("*").alias("docs")))
    given = budgets(histogram, targets, total)
    if given is None:
        return counts.select("doc_id", "source", "tokens", F.lit(0).cast("long").alias("copies")).where("false")
    # lengths of more than PIECE documents are at most MOST_HOT, so the table of them has a bound
    piece = max(PIECE, -(-histogram.agg(F.sum("docs")).first()[0] // MOST_HOT))
    placed = checkpointed(balance(histogram, given).withColumn("parts", F.ceil(F.col("docs") / piece)))
    hot = placed.where("parts > 1").select("source", "tokens", "parts")
    split = usable.join(F.broadcast(hot), ["source", "tokens"], "left").select("doc_id", "source", "tokens", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).alias("part"))
    # places before each part: the parts of the hot lengths alone have any
    counted = split.join(F.broadcast(hot), ["source", "tokens"], "left_semi").groupBy("source", "tokens", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.select("source", "tokens", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    cells = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(ahead, ["source", "tokens", "part"], "left")
    number = F.row_number().over(Window.partitionBy("source", "tokens", "part").orderBy("doc_id")) + F.coalesce("ahead", F.lit(0))
    run = split.join(cells.select("source", "tokens", "part", "ahead", "rate", "cap", "offset", "start"), ["source", "tokens", "part"]).withColumn("number", number)
    at = lambda place: F.floor(F.round(F.col("offset") + F.col("rate") * place + F.col("start"), 9))  # noqa: E731  as in whole()
    copies = F.least(at(F.col("number")) - at(F.col("number") - 1), F.col("cap").cast("long"))
    return run.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def shares(selection: DataFrame, targets: Mapping[str, Target]) -> DataFrame:
    """``(source, target_share, actual_share, tokens, documents, most_copies)`` of every target, met or not."""
    spark = selection.sparkSession
    wanted = spark.createDataFrame([(s, t.share) for s, t in targets.items()], "source string, target_share double")
    drawn = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    out = wanted.join(drawn, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    whole = Window.partitionBy()  # one row per target
    return out.select("source", "target_share", (F.col("tokens") / F.greatest(F.sum("tokens").over(whole), F.lit(1))).alias("actual_share"), "tokens", "documents", "most_copies")


def read_targets(rows: DataFrame) -> dict[str, Target]:
    """The targets, a fixed small table; of a source named twice the larger share holds."""
    out: dict[str, Target] = {}
    for r in small_table(rows.where("source IS NOT NULL").orderBy("source", "target_share"), 10_000):
        out[r.source] = Target(r.target_share or 0.0, r.max_repeats or 0)
    return out
