"""Streams: the evaluation queue, the journal, and windows over event time.

A queue of requests is polled, each key is taken once, failures are retried a bounded
number of times. State that would grow for ever is bounded by a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "timestamp string, checkpoint string"
JOURNAL = "line_no bigint, type string, checkpoint string, payload string"
RETRIES = 2


def request_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Appended JSON request files; taken at most max_files a trigger."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", max_files).json(folder)


def once_by_key(requests: DataFrame, key: str = "checkpoint", time: str | None = None, within: str = "7 days") -> DataFrame:
    """The first request of each key. With a time column keys are forgotten after `within`; else state grows with keys."""
    if time is None:
        return requests.dropDuplicates([key])
    return requests.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def with_retries(results: DataFrame, most: int = RETRIES, ttl: str | None = "7 days") -> DataFrame:
    """From results (key string, ok boolean): (key, tries, verdict), one row a try: done, retry, or given_up after `most` retries.

    A key's count of failures is dropped when it succeeds, and `ttl` after its last try.
    Without a ttl state is kept until success; a stream that is to end by itself needs
    that, as pending timeouts keep a stream running.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failed = state.get[0] if state.exists else 0
        out = []
        for batch in batches:
            for ok in batch["ok"]:
                if ok:
                    out.append((key[0], failed + 1, "done"))
                    failed = 0
                else:
                    failed += 1
                    out.append((key[0], failed, "given_up" if failed > most else "retry"))
        if failed:
            state.update((failed,))
            if ttl:
                state.setTimeoutDuration(_milliseconds(ttl))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "tries", "verdict"])

    return results.groupBy("key").applyInPandasWithState(step, "key string, tries int, verdict string", "failed int", "append", "ProcessingTimeTimeout" if ttl else "NoTimeout")


def _milliseconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def matched_journal(journal: DataFrame) -> DataFrame:
    """Batch: predictions with the result and analysis of the same checkpoint and occurrence, in line order.

    The clock is not used: journals are written by hand, in several zones.
    """
    from tracequarry.operators.ordered import running_sum

    kinds = ["prediction", "eval_result", "analysis"]
    keyed = journal.where(F.col("type").isin(kinds)).withColumn("_k", F.concat_ws("|", "checkpoint", "type"))
    counted = running_sum(keyed, ["_k"], "line_no", {"occurrence": F.lit(1)})
    of = lambda k: F.max(F.when(F.col("type") == k, F.struct("line_no", "payload")))
    wide = counted.groupBy("checkpoint", "occurrence").agg(*[of(k).alias(k) for k in kinds])
    number = lambda c: F.regexp_extract(F.col(f"{c}.payload"), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return wide.where("prediction is not null").select("checkpoint", "occurrence", *[F.col(f"{k}.payload").alias(k) for k in kinds], (number("eval_result") - number("prediction")).alias("gap"))


def journal_results(requests: DataFrame, journal: DataFrame, within: str = "3 hours") -> DataFrame:
    """Stream-stream join of requests (checkpoint, requested_at) and results (checkpoint, finished_at), results at most `within` later."""
    r = requests.withWatermark("requested_at", within).alias("r")
    j = journal.withWatermark("finished_at", within).alias("j")
    on = F.expr(f"r.checkpoint = j.checkpoint AND j.finished_at >= r.requested_at AND j.finished_at <= r.requested_at + INTERVAL {within}")
    return r.join(j, on, "inner").select("r.checkpoint", "r.requested_at", "j.finished_at")


def cycle_states(requests: DataFrame, results: DataFrame, seconds: int) -> DataFrame:
    """(key, line_no, state) of requests (key, line_no, at): done, timed_out or open, by the next result of the key in line order."""
    from tracequarry.operators.ordered import asof_backward

    back = lambda df: df.withColumn("_back", -F.col("line_no").cast("long"))
    marks = back(results).select("key", "_back", F.col("at").alias("finished"))
    met = asof_backward(back(requests), marks, ["key"], "_back", ["finished"])
    took = F.unix_micros("finished") - F.unix_micros("at")
    return met.select("key", "line_no", F.when(F.col("finished").isNull(), "open").when(took <= seconds * 1_000_000, "done").otherwise("timed_out").alias("state"))


def last_lines(journal: DataFrame, n: int = 50) -> DataFrame:
    """The last n lines, in order."""
    return journal.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def budget(spent_seconds: float, hours: float) -> dict[str, float]:
    """Elapsed and remaining seconds of a budget."""
    return {"elapsed": spent_seconds, "remaining": max(0.0, hours * 3600 - spent_seconds)}


def session_counts(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by gaps in event time: (user_id, started, ended, n_events)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n_events")


def window_counts(events: DataFrame, length: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sliding counts by event type: (event_type, started, n_events, total)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n_events"))
    return out.select("event_type", F.col("window.start").alias("started"), "n_events")


def drained(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet files and gives them as a table.

    checkpoint and out are the stream's own folders: a restart goes on where it stopped.
    """
    running = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
