"""Broken prompt and response pairs: every defective answer with its kind of defect."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import answers, charstats, truncation

_KANA = "[\\u3041-\\u3096\\u30a1-\\u30fa\\u30fc]"
_IDEOGRAPH = "[\\u3400-\\u9fff]"


def kana_less_copies(pairs: DataFrame) -> DataFrame:
    """``(id)`` of answers equal to a prompt of ideographs alone, where that isn't its usual translation.

    What is usual is counted over all answers to the prompt: an equal answer is sound where at least half
    of them are equal (words that both languages write alike).
    """
    same = F.btrim(F.col("source")) == F.btrim(F.col("target"))
    wordy = pairs.where(F.col("source").rlike(_IDEOGRAPH) & ~F.col("source").rlike(_KANA))
    usual = wordy.where("target IS NOT NULL").groupBy("source").agg(F.avg(same.cast("double")).alias("share"))
    return wordy.where(same).join(usual.where("share < 0.5"), "source").select("id")


def defective(pairs: DataFrame) -> DataFrame:
    """``(id, defect)`` of every pair with an unusable answer, one defect each.

    ``pairs`` is ``(id, source, target, feed)``. In order of precedence: ``empty``, ``refusal``,
    ``copied``, ``other_language``, ``truncated`` (see :mod:`truncation`). Garbled answers are not judged.
    One pass labels the pairs alone; a second one, over all answers, finds the truncated ones. A NULL
    answer is empty, a NULL prompt never copied; repeated rows are judged alike; whole texts are read.
    """
    spark = pairs.sparkSession
    values = pairs.select(F.lit("current.target").alias("field_name"), "feed", "id", F.col("target").alias("value"), F.col("source").alias("peer"))
    common = charstats.commonness(values)
    shared = spark.sparkContext.broadcast(common)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [answers.defect(s, t, shared.value) for s, t in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist(), strict=True)]
            keep = pa.array([k for k, d in enumerate(found) if d and d != "garbled"], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(keep), pa.array(found, pa.string()).take(keep)], names=["id", "defect"])

    alone = pairs.select("id", "source", "target").mapInArrow(label, "id long, defect string")
    cut = truncation.judged(values, {"current.target": "answer"}, common=common).select("id", F.lit("truncated").alias("defect"))
    copies = kana_less_copies(pairs).select("id", F.lit("copied").alias("defect"))
    # the parts are disjoint but for copies, which may also lack an end mark
    return alone.unionByName(copies).unionByName(cut.join(copies.select("id"), "id", "left_anti"))
