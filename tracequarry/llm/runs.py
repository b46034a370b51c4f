"""Problem 3: runs of consecutive calls with the same command.

Boundary-only rows: a row that differs from its predecessor starts a run; ``lead``
over the starts gives each run its end. Position differences give the count, the
timestamp of the row before the next start gives the duration.

A trajectory may hold a third of all calls, so this is done in blocks of positions: calls
are shuffled once to their block, and lag and lead stay within it. Only runs that touch
the edge of a block (two a block) are then chained across blocks.

Defined results
* rows of one (trajectory_id, call_index) count once; among differing copies the one
  with the least (ingested_at, values) stays;
* rows with a null trajectory_id or call_index have no place in any order and are left out;
* a null command is a boundary and belongs to no run; an empty or blank command is a
  command like any other (all blank ones match);
* a missing call_index ends a run: calls are adjacent when their indexes differ by one;
* monitoring_action null matches only null; numbers are masked only where it is true;
* a missing start or end time gives a null duration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators.blocks import BLOCK, with_block
from tracequarry.operators.ordered import islands

KEY = ["trajectory_id", "call_index"]


def unique_calls(calls: DataFrame, texts: bool, times: bool = True) -> DataFrame:
    """One row per (trajectory_id, call_index) with its key, a hash that stands for the command.

    Commands and times travel only where they are asked for.
    """
    kept = calls.where("trajectory_id is not null and call_index is not null")
    key = F.unhex(F.md5(match_key(F.col("command"), F.col("monitoring_action"))))
    used = [*(["command"] if texts else []), *(["monitoring_action", "started_at", "ended_at"] if times else []), "key"]
    kept = kept.select(*KEY, "ingested_at", "command", "monitoring_action", "started_at", "ended_at", key.alias("key"))
    return kept.groupBy(*KEY).agg(F.min(F.struct("ingested_at", *used)).alias("r")).select(*KEY, *[F.col(f"r.{c}") for c in used])


def match_key(command: Column, monitoring: Column) -> Column:
    """Equal keys mean matching commands; null for a null command."""
    spaced = F.trim(F.regexp_replace(command, r"(?U)[\s\x{FEFF}\x{200B}]+", " "))
    masked = F.regexp_replace(spaced, r"[0-9]+(?:\.[0-9]+)?", "0")
    flag = F.when(monitoring, "m").when(~monitoring, "c").otherwise("?")
    return F.concat(flag, F.when(monitoring, masked).otherwise(spaced))


def _stretches(rows: DataFrame, kept: list[str], ended: Column, block: int) -> DataFrame:
    """(trajectory_id, first, last, ended, *kept): runs of matching adjacent calls, also of one call; kept are values of a run's first call."""
    inside = Window.partitionBy("trajectory_id", "_block").orderBy("call_index")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(F.col("call_index").alias("i"), "key", ended.alias("t"))
    cut = with_block(rows, "call_index", block).withColumn("own", own).withColumn("prev", F.lag("own").over(inside)).withColumn("end", F.last("own").over(whole))
    same = F.coalesce((F.col("prev.i") == F.col("call_index") - 1) & (F.col("prev.key") == F.col("key")), F.lit(False))
    starts = cut.where(~same).withColumn("stop", F.coalesce(F.lead("prev").over(inside), F.col("end"))).where("key is not null")
    names = ["trajectory_id", "first", "last", "ended", "key", *kept]
    runs = starts.select("trajectory_id", F.col("call_index").alias("first"), F.col("stop.i").alias("last"), F.col("stop.t").alias("ended"), "key", *kept, F.col("prev").isNull().alias("opens"), (F.col("stop.i") == F.col("end.i")).alias("closes"))
    inner = runs.where("not opens and not closes").select(*names)
    # of a block at most its first and last run may go on in its neighbours: as few rows as there are blocks
    edges = runs.where("opens or closes").select(*names)
    before = F.struct("last", "key")
    edges = islands(edges.withColumn("own", before), ["trajectory_id"], "first", F.lit(False), "chain", block * block, joins=lambda b: (b["last"] == F.col("first") - 1) & (b["key"] == F.col("key")), carry=F.col("own"))
    chained = edges.groupBy("trajectory_id", "chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("ended", "first").alias("ended"), F.first("key").alias("key"), *[F.min_by(c, "first").alias(c) for c in kept])
    return inner.unionByName(chained.select(*names)).drop("key")


def command_runs(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per run (also runs of one call): first and last index, count, times, and the first command."""
    runs = _stretches(unique_calls(calls, texts=True), ["command", "monitoring_action", "started_at"], F.col("ended_at"), block)
    return runs.select(
        "trajectory_id",
        F.col("first").alias("first_call_index"),
        F.col("last").alias("last_call_index"),
        (F.col("last") - F.col("first") + 1).alias("n_calls"),
        "command",
        F.coalesce("monitoring_action", F.lit(False)).alias("is_polling"),
        F.col("started_at").alias("first_start"),
        F.col("ended").alias("last_end"),
        (F.unix_micros("ended") - F.unix_micros("started_at")).alias("duration_us"),
    )


def repeated_runs(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """p3_found: the runs of two or more calls."""
    runs = _stretches(unique_calls(calls, texts=False, times=False), [], F.lit(True), block)
    return runs.where("last > first").select("trajectory_id", F.col("first").alias("first_call_index"), F.col("last").alias("last_call_index"))
