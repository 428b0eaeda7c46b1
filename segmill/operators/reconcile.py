"""Differences between two copies of a dataset, field by field, by cells that don't cancel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.session import BLANK


def outer_blank_free(col: Column) -> Column:
    """The text without outer Unicode white space, in lower case; NULL as the empty text."""
    return F.lower(F.btrim(F.coalesce(col, F.lit("")), F.lit(BLANK)))


def differences(
    current: DataFrame,
    previous: DataFrame,
    key: str = "segment_id",
    fields: Sequence[str] = ("source", "target", "speaker", "context", "source_path"),
    order_by: Sequence[str] = ("updated_at", "row_id"),
    names: tuple[str, str] = ("current", "previous"),
) -> DataFrame:
    """``(key, diff)``: keys that one side lacks, and fields whose values differ on shared keys.

    Each side is reduced to the row of a key with the greatest ``order_by`` tuple (NULL counts as least);
    the reduction aggregates before its shuffle, so a key with a third of all rows sends one row per
    task. Both sides are then unpivoted to signed (key, field, value) cells, and cells that don't cancel
    are the differences. The one shuffle is by the key; the grouping of the cells reuses it.

    Keys are compared without outer blanks and in lower case, NULL and blank keys as the empty key; NULL
    values equal the empty text. An empty side makes every key of the other one missing there. Repeated
    rows count once; columns beyond the named ones take no part.
    """
    fields = [*fields]
    value = F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)))
    order = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order_by)))

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(outer_blank_free(F.col(key)).alias("__key"), F.lit(sign).alias("__sign"), order.alias("__order"), value.alias("__value"))

    rows = side(current, 1).unionByName(side(previous, -1))
    latest = rows.groupBy("__key").agg(
        F.max_by("__value", F.when(F.col("__sign") == 1, F.col("__order"))).alias("__cur"),
        F.max_by("__value", F.when(F.col("__sign") == -1, F.col("__order"))).alias("__prev"),
    )

    def cells(struct: str, sign: int) -> Column:
        own = [F.struct(F.lit(i).alias("field"), F.col(f"{struct}.f{i}").alias("value"), F.lit(sign).alias("sign")) for i in range(len(fields))]
        own.append(F.struct(F.lit(-1).alias("field"), F.lit("").alias("value"), F.lit(sign).alias("sign")))
        return F.when(F.col(struct).isNotNull(), F.array(*own)).otherwise(F.array().cast("array<struct<field:int,value:string,sign:int>>"))

    unpivoted = latest.select("__key", F.explode(F.concat(cells("__cur", 1), cells("__prev", -1))).alias("c")).select("__key", "c.field", "c.value", "c.sign")
    left = unpivoted.groupBy("__key", "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    # at most two cells a field and key are left
    found = left.groupBy("__key").agg(F.collect_set("field").alias("open"), F.max(F.when(F.col("field") == -1, F.col("n"))).alias("lone"))
    label = F.array(*(F.lit(f) for f in fields))
    diff = (
        F.when(F.col("lone") > 0, F.array(F.lit(f"only_{names[0]}")))
        .when(F.col("lone") < 0, F.array(F.lit(f"only_{names[1]}")))
        .otherwise(F.transform(F.col("open"), lambda i: F.element_at(label, i + 1)))
    )
    return found.select(F.col("__key").alias(key), F.explode(diff).alias("diff"))
