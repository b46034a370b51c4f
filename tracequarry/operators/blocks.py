"""Neighbour lookups in very long ordered groups.

A window over ``partitionBy(key)`` puts a whole group into one task; with one key
holding a third of all rows that task never ends. Here the integer position is cut
into blocks of ``BLOCK`` positions, the window runs per (key, block), and only one
summary row per block travels to the window over blocks. Every task then sees at
most ``BLOCK`` positions, or ``1 / BLOCK`` of a group's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def with_block(df: DataFrame, position: str, block: int = BLOCK, name: str = "_block") -> DataFrame:
    """Adds the block number of an integer position (floor division)."""
    return df.withColumn(name, F.floor(F.col(position) / F.lit(block)).cast("long"))


def blocked_lag(df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``lag(value) over (partition by keys order by position)`` without a task per key.

    ``value`` must be non-null (wrap it in a struct); positions are unique within the
    keys. Rows with a null key or position get a null predecessor only among
    themselves; callers drop them first.
    """
    blocked = with_block(df, position, block).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    blocked = blocked.withColumn("_lag", F.lag("_value").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    last = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max(F.struct(F.col(position).alias("p"), F.col("_value").alias("v"))).alias("_last"))
        .withColumn("_before", F.lag("_last").over(over_blocks)["v"])
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb"), "_before")
        .where("_before is not null")
    )
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_block") == F.col("_kb"), F.col("_first")]
    joined = blocked.join(last, on, "left")
    drop = [f"_k{i}" for i in range(len(keys))] + ["_kb", "_before", "_lag", "_first", "_value", "_block"]
    return joined.withColumn(name, F.coalesce("_lag", "_before")).drop(*drop)


def blocked_lead(df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``lead(value)``: the mirror image of :func:`blocked_lag`."""
    flipped = df.withColumn("_neg", -F.col(position).cast("long"))
    return blocked_lag(flipped, keys, "_neg", value, name, block).drop("_neg")
