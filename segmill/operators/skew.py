"""Joins and row pairs that split keys held by very many rows, whatever the adaptive planner makes of them.

A key is heavy where more than :data:`PIECE` rows hold it. Heavy keys are found from counts; their
rows are dealt to parts by a hash of an id, and what they meet is repeated once a part. The table of heavy keys
has at most :data:`MOST_HEAVY` rows, two numbers each; keys beyond them, which then hold less than a hundred-thousandth of all rows
each, stay in one part. Where no key is heavy the joins are plain ones. Results don't depend on any of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE, MOST_HEAVY = 20_000, 100_000
#: Rows of either side in a cell of :func:`cell_join`, and pairs of rows that one of its tasks makes.
CELL, TASK_PAIRS = 2_000, 5_000_000


def heavy_keys(counts: DataFrame, keys: Sequence[str], piece: int | None = None) -> DataFrame | None:
    """``(__h, __parts)`` of the heavy keys of ``(keys, n)``: a hash of the key and the number of its parts; None where there are none.

    ``counts`` should be something already written, as it is read here.
    """
    size = piece or PIECE
    top = counts.where(F.col("n") > size).orderBy(F.desc("n")).limit(MOST_HEAVY)
    found = top.groupBy(F.xxhash64(*keys).alias("__h")).agg(F.max(F.ceil(F.col("n") / size)).alias("__parts")).collect()
    return counts.sparkSession.createDataFrame(found, "__h long, __parts long") if found else None


def _dealt(df: DataFrame, keys: Sequence[str], heavy: DataFrame, by: Column | None) -> DataFrame:
    """With ``__h`` and ``__part``: one part by the hash of ``by``, or all parts of the key."""
    held = df.withColumn("__h", F.xxhash64(*keys)).join(F.broadcast(heavy), "__h", "left")  # at most MOST_HEAVY rows
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)) if by is None else F.pmod(F.xxhash64(by), parts)
    return held.withColumn("__part", part).drop("__parts")


def split_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], heavy: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, one row of which there is per key; ``how`` is ``inner``, ``left`` or ``left_semi``.

    Rows of heavy keys are dealt to parts by ``by``. NULL keys match nothing; leave them out before an outer join.
    """
    if heavy is None:
        return rows.join(facts, [*keys], how)
    a, b = _dealt(rows, keys, heavy, F.col(by)), _dealt(facts, keys, heavy, None)
    return a.join(b, ["__h", "__part", *keys], how).drop("__h", "__part")


def row_pairs(pairs: DataFrame, members: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """``(a, b, id_a, id_b)``: every pair of keys ``(a, b)`` widened to the rows ``(key, id)`` of both.

    A pair of heavy keys is a grid of cells, part by part; a cell is what one task joins. ``heavy`` are the heavy ones of ``key``.
    """
    if heavy is None:
        side = lambda c: members.select(F.col("key").alias(c), F.col("id").alias(f"id_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "id_a", "id_b")
    own = _dealt(members, ["key"], heavy, F.col("id")).select("key", "__part", "id")
    first = _dealt(pairs.withColumn("key", F.col("a")), ["key"], heavy, None).select("a", "b", F.col("__part").alias("i"))
    cells = _dealt(first.withColumn("key", F.col("b")), ["key"], heavy, None).select("a", "i", "b", F.col("__part").alias("j"))
    left = cells.join(own.select(F.col("key").alias("a"), F.col("__part").alias("i"), F.col("id").alias("id_a")), ["a", "i"])
    right = cells.join(own.select(F.col("key").alias("b"), F.col("__part").alias("j"), F.col("id").alias("id_b")), ["b", "j"])
    return left.join(right, ["a", "i", "b", "j"]).select("a", "b", "id_a", "id_b")


def cell_join(a: DataFrame, b: DataFrame, keys: Sequence[str], by_a: str, by_b: str, cell: int | None = None) -> DataFrame:
    """``a`` joined with ``b`` on ``keys`` where either side may hold very many rows of a key, and the pairs are the work.

    Rows of a heavy key are dealt to parts by ``by_a`` and ``by_b``; a pair of parts is a cell. Tasks are as many as
    the pairs need, as neither rows nor bytes of the inputs, which are all that the adaptive planner sees, tell them.
    """
    size = cell or CELL
    n = [df.dropna(subset=[*keys]).groupBy(*keys).agg(F.count("*").alias("n")) for df in (a, b)]
    of_a, of_b = (heavy_keys(x, keys, size) for x in n)
    pairs = n[0].join(n[1].withColumnRenamed("n", "m"), [*keys]).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    on = [*keys]
    for heavy, by, part in ((of_a, (by_a, None), "__i"), (of_b, (None, by_b), "__j")):
        if heavy is not None:
            a, b = (_dealt(df, keys, heavy, None if c is None else F.col(c)).withColumnRenamed("__part", part).drop("__h") for df, c in zip((a, b), by, strict=True))
            on.append(part)
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))
    return a.repartition(tasks, *on).join(b.repartition(tasks, *on), on).drop("__i", "__j")
