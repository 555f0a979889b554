"""Job queue and limiters: the state machine as column rules, replays of limiters, and a streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NEW, PROCESSING, COMPLETED, ABORTING, FAILED = "NEW", "PROCESSING", "COMPLETED", "ABORTING", "FAILED"


def completed_status(error: Column, retryable: Column, retries: Column, max_retries: Column) -> Column:
    """Status after an attempt: no error COMPLETED; retryable with attempts left NEW; else FAILED."""
    return F.when(error.isNull(), COMPLETED).when(retryable & (retries + 1 < max_retries), NEW).otherwise(FAILED)


def runnable(status: Column, run_after: Column, now: Column) -> Column:
    return (status == NEW) & (run_after <= now)


def next_job(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter(runnable(F.col("status"), F.col("run_after"), now)).orderBy("created_at", "id").limit(1)


def peek(jobs: DataFrame, now: Column, n: int = 100) -> DataFrame:
    return jobs.filter((F.col("status") == NEW) & (F.col("run_after") > now)).orderBy("run_after", "id").limit(n)


def clamp_progress(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), p))


def changes(progress: DataFrame, job: str, order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from the job's row before."""
    w = W.partitionBy(job).orderBy(*order)
    now, before = F.struct(*values), F.lag(F.struct(*values)).over(w)
    return progress.withColumn("_same", F.coalesce(before.eqNullSafe(now), F.lit(False))).filter(~F.col("_same")).drop("_same")


def window_counts(requests: DataFrame, queue: str, ts: str, seconds: int) -> DataFrame:
    """Requests of the queue in the last seconds, this one included; one exactly so many seconds old no longer counts."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(queue).orderBy("_at").rangeBetween(1 - seconds * 1_000_000, 0)
    return requests.withColumn("_at", at).withColumn("in_window", F.count("*").over(w)).drop("_at")


def running_counts(runs: DataFrame, queue: str, start: str, end: str) -> DataFrame:
    """(queue, moment, running) after each start or end."""
    events = runs.select(queue, F.col(start).alias("moment"), F.lit(1).alias("d")).unionByName(runs.select(queue, F.col(end).alias("moment"), F.lit(-1).alias("d")))
    steps = events.groupBy(queue, "moment").agg(F.sum("d").alias("d"))
    return steps.select(queue, "moment", F.sum("d").over(W.partitionBy(queue).orderBy("moment")).alias("running"))


def admit(times: list[int], limit: int, window: int, gap: int = 0) -> list[bool]:
    """Which of the requests, in time order, a limit of `limit` in `window` and a least `gap` lets start."""
    out, log = [], []
    first = 0
    for t in times:
        while first < len(log) and log[first] <= t - window:
            first += 1
        ok = len(log) - first < limit and (not log or t - log[-1] >= gap)
        if ok:
            log.append(t)
        out.append(ok)
    return out


def replay_limiter(requests: DataFrame, queue: str, ts: str, order: str, limit: int, seconds: int, gap_ms: int = 0) -> DataFrame:
    """(queue, order, admitted). Admission depends on all earlier ones of the queue, so a queue is folded in one task, streamed in time order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue_now, log, first = None, [], 0
        for pdf in frames:
            ok = []
            for q, t in zip(pdf[queue], pdf["_at"]):
                if q != queue_now:
                    queue_now, log, first = q, [], 0
                while first < len(log) and log[first] <= t - seconds * 1_000_000:
                    first += 1
                if first > 4096:
                    log, first = log[first:], 0
                good = len(log) - first < limit and (not log or t - log[-1] >= gap_ms * 1000)
                if good:
                    log.append(t)
                ok.append(good)
            yield pdf[[queue, order]].assign(admitted=ok)

    src = requests.select(queue, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")).repartition(queue).sortWithinPartitions(queue, "_at", order)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    return src.mapInPandas(run, f"{queue} {kinds[queue]}, {order} {kinds[order]}, admitted boolean")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str | None = None) -> DataFrame:
    """Event-time tumbling counts; with late, a watermark for use on a stream. An extension."""
    src = events.withWatermark(ts, late) if late else events
    return src.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
