"""Best similar text: an exact similarity join by Ratcliff/Obershelp ratio, without comparing all pairs.

A ratio of t or more leaves few unmatched characters, hence few matching blocks, hence a least number of
shared bigrams (or, for very short texts, characters). Two sets that share R elements share one among
their first |set| - R + 1 elements in any common order, so joining on those finds every pair; the order
used is rarest first.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.functions import grams
from segmill.session import checkpointed

_EPS = 1e-9


def partner_lengths(n: int, threshold: float) -> range:
    """Lengths that a text of ``n`` characters can reach the threshold with."""
    return range(math.ceil(n * threshold / (2 - threshold) - _EPS), math.floor(n * (2 - threshold) / threshold + _EPS) + 1)


@functools.cache
def least_shared(n: int, threshold: float) -> tuple[int, int]:
    """Least numbers of shared ``(bigrams, characters)`` over all partners of a text of ``n`` characters."""
    bigrams = chars = n
    for m in partner_lengths(n, threshold):
        matched = math.ceil(threshold * (n + m) / 2 - _EPS)
        unmatched = n + m - 2 * matched
        bigrams = min(bigrams, matched - (unmatched + 1))
        chars = min(chars, matched)
    return bigrams, chars


def weak_length(threshold: float) -> float:
    """Greatest length at which no shared bigram is certain; infinite for thresholds of two thirds or less.

    Of s characters in two texts at least ts/2 are matched on each side and at most (1 - t)s are not, so the shared
    bigrams are at least (3t/2 - 1)s - 1; and s is at least 2n / (2 - t). From there on one is certain, below it
    every length is tried.
    """
    slope = 1.5 * threshold - 1
    if slope <= 1e-6:
        return math.inf
    certain = math.ceil((2 - threshold) / slope) + 1
    return max((n for n in range(1, certain + 1) if least_shared(n, threshold)[0] < 1), default=0)


#: Longs of a text's bit sketch: a bit for every bigram it holds, by hash.
SKETCH = 4
_KEY = "id long, kind int, key long, weak boolean, n int, " + ", ".join(f"s{k} long" for k in range(SKETCH))


def _keys(threshold: float, longest: float, frequencies):
    """The elements by which a text can be met, rarest first, with its length and bit sketch; whole batches at once."""
    reach = max(partner_lengths(int(longest), threshold), default=0) if longest < math.inf else longest

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, one = frequencies.value
        for batch in batches:
            own = batch.column("text").to_pylist()
            if not own:
                continue
            ids, n = np.asarray(batch.column("id"), np.int64), np.fromiter(map(len, own), np.int64, len(own))
            least = {int(k): least_shared(int(k), threshold) for k in np.unique(n)}
            needed, chars = (np.array([least[k][i] for k in n.tolist()]) for i in (0, 1))
            sketch, parts = np.zeros((len(own), SKETCH), np.uint64), []
            for width, table in ((2, two), (1, one)):
                hashes, offsets = grams.elements(own, width)
                owner = np.repeat(np.arange(len(own)), np.diff(offsets))
                if width == 2:
                    bit = (hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64)
                    np.bitwise_or.at(sketch, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
                    size = np.where(needed >= 1, np.diff(offsets) - needed + 1, 0)
                else:
                    size = np.where((needed < 1) | (n <= reach), n - chars + 1, 0)
                order = np.lexsort((hashes, table[grams.slots(hashes)], owner))
                kept = order[np.arange(len(order)) - offsets[owner] < size[owner]]  # sorted by owner, so places are offsets
                parts.append((owner[kept], np.full(len(kept), width), hashes[kept].view(np.int64)))
            at, kind, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(kind, pa.int32()), pa.array(key), pa.array(needed[at] < 1), pa.array(n[at], pa.int32()), *(pa.array(sketch[at, k].view(np.int64)) for k in range(SKETCH))],
                names=["id", "kind", "key", "weak", "n", *(f"s{k}" for k in range(SKETCH))],
            )

    return emit


def shared(left: list[str], right: list[str], width: int) -> np.ndarray:
    """Number of shared pieces, with multiplicity, of every pair of texts."""
    n = len(left)
    (ha, oa), (hb, ob) = grams.elements(left, width), grams.elements(right, width)
    owner = np.concatenate((np.repeat(np.arange(n), np.diff(oa)), np.repeat(np.arange(n), np.diff(ob))))
    both = np.concatenate((ha, hb))
    order = np.lexsort((both, owner))
    both, owner = both[order], owner[order]
    same = (both[1:] == both[:-1]) & (owner[1:] == owner[:-1])  # an element is at most once on each side
    return np.bincount(owner[1:][same], minlength=n)


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, ratio)`` of all pairs of different texts, ``a`` from ``left.text``, ``b`` from ``right.text``.

    The ratio is 2M / (|a| + |b|) in this order of arguments (it isn't symmetric), compared inclusively.
    Texts are numbered once; what meets are numbers, keys and bit sketches. A pair goes on only if its
    sketches allow the shared bigrams that the ratio needs, and is compared character by character only
    if its numbers of shared characters and bigrams do. Keys that many texts hold are split by AQE's skew join.
    At a threshold of 0 everything matches; such a join is refused. NULL and empty texts match nothing.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = left.sparkSession
    clean = lambda df: checkpointed(df.select("text").where("text IS NOT NULL AND text <> ''").distinct().select(F.monotonically_increasing_id().alias("id"), "text"))
    a, b = clean(left), clean(right)
    longest = weak_length(threshold)
    # any common order will do; that of single characters matters where they are met by all texts, not only by the shortest
    widths = (2, 1) if longest == math.inf else (2,)
    tables = [np.minimum(grams.slot_frequencies(b, width)[0], 2**31 - 1).astype(np.int32) for width in widths]
    known = spark.sparkContext.broadcast((tables + [np.zeros(1 << grams.SLOT_BITS, np.int32)])[:2])  # 8 MB, whatever the input
    ka, kb = (x.mapInArrow(_keys(threshold, longest, known), _KEY).alias(c) for x, c in ((a, "a"), (b, "b")))
    n, m = F.col("a.n"), F.col("b.n")
    near = F.least(n, m) * 2 + _EPS >= threshold * (n + m)
    # bigrams whose bit the other text lacks can't be shared
    apart = lambda x, y: sum((F.bit_count(F.col(f"{x}.s{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}.s{k}")))) for k in range(SKETCH)), F.lit(0))
    matched = F.ceil(threshold * (n + m) / 2 - _EPS)
    bigrams = 3 * matched - (n + m) - 1
    allowed = (n - 1 - apart("a", "b") >= bigrams) & (m - 1 - apart("b", "a") >= bigrams)
    met = ka.join(kb, [F.col("a.kind") == F.col("b.kind"), F.col("a.key") == F.col("b.key"), near, (F.col("a.kind") == 2) | F.col("a.weak") | F.col("b.weak"), allowed])
    candidates = met.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    named = candidates.join(a.select(F.col("id").alias("x"), F.col("text").alias("a")), "x").join(b.select(F.col("id").alias("y"), F.col("text").alias("b")), "y").select("a", "b")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = SequenceMatcher(None, autojunk=False)
        for batch in batches:
            left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            if not left:
                continue
            size = np.fromiter((len(x) + len(y) for x, y in zip(left, right, strict=True)), np.int64, len(left))
            least = np.ceil(threshold * size / 2 - _EPS).astype(np.int64)
            open_ = np.flatnonzero((shared(left, right, 1) >= least) & (shared(left, right, 2) >= 3 * least - size - 1))
            keep, ratios = [], []
            for i in open_.tolist():
                matcher.set_seqs(left[i], right[i])
                if (r := matcher.ratio()) >= threshold:
                    keep.append(i)
                    ratios.append(r)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(ratios, pa.float64())], names=["a", "b", "ratio"])

    return named.mapInArrow(score, "a string, b string, ratio double")
