"""Job queues as tables: submit, claim, run, retry, abort, progress; limiters; and the same rules for streams.

A queue's state is one row a job. All rules are column expressions over whole tables, so one change
handles any number of jobs; a change writes the new state to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.sources.kv import KVTable
from weftline.sources.shared import written
from weftline.streaming import jobs as rules

SCHEMA = """id string, fingerprint string, queue string, jobRunId string, status string, input string, output string, retries int,
maxRetries int, runAfter timestamp, lastRanAt timestamp, completedAt timestamp, createdAt timestamp, deadlineAt timestamp, error string, errorCode string,
progress double, progressMessage string, progressDetails string"""
#: The classes of errors by which callers tell what became of a job, and the default number of tries.
RETRYABLE, PERMANENT, ABORT = "RetryableJobError", "PermanentJobError", "AbortSignalJobError"
MAX_RETRIES = 10
TERMINAL = ("COMPLETED", "FAILED")


class JobError(Exception):
    """Raised by a job's function; by default it is permanent."""

    code, retry_after = PERMANENT, None


class RetryableJobError(JobError):
    code = RETRYABLE

    def __init__(self, message: str, retry_after: float = 0.0):
        super().__init__(message)
        self.retry_after = retry_after


class PermanentJobError(JobError):
    pass


class AbortSignalJobError(PermanentJobError):
    code = ABORT


def new_jobs(rows: DataFrame, queue: str, now: Column) -> DataFrame:
    """Rows (id, input, ...) as NEW jobs; other columns of the schema may be given."""
    given = {c: F.col(c) for c in rows.columns}
    # fmt: off
    defaults = {"fingerprint": F.sha2(F.col("input"), 256), "queue": F.lit(queue), "jobRunId": F.col("id"), "status": F.lit("NEW"), "retries": F.lit(0),
                "maxRetries": F.lit(MAX_RETRIES), "runAfter": now, "createdAt": now, "progress": F.lit(0.0), "progressMessage": F.lit("")}
    # fmt: on
    fields = [x.strip().rsplit(" ", 1) for x in SCHEMA.replace("\n", " ").split(",")]
    return rows.select(*[given.get(c, defaults.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in fields])


def refusal(status: Column, deadline: Column, now: Column) -> Column:
    """Why a claimed job must not run, or null."""
    return F.when(status.isin(*TERMINAL), F.concat(F.lit("the job is "), status)).when(status == "ABORTING", F.lit("the job is being aborted")).when(deadline < now, F.lit("the job is past its deadline"))


def completed(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """jobs after the attempts in results (id, output, error, errorCode, retryAt).

    No error: COMPLETED. A retryable error with tries left: NEW at retryAt, one retry more. Else FAILED. Jobs that are
    terminal already stay as they are; what was ABORTING fails as aborted, whatever came out.
    """
    r = results.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("output", "error", "errorCode", "retryAt")])
    out = jobs.join(r, F.col("id") == F.col("_id"), "left")
    mine = F.col("_id").isNotNull() & ~F.col("status").isin(*TERMINAL)
    aborted = F.col("status") == "ABORTING"
    error = F.when(aborted, F.coalesce("_error", F.lit("aborted"))).otherwise(F.col("_error"))
    code = F.when(aborted, ABORT).when(F.col("_error").isNotNull(), F.coalesce("_errorCode", F.lit(PERMANENT)))
    again = ~aborted & (F.col("_errorCode") == RETRYABLE)
    status = rules.completed_status(error, F.coalesce(again, F.lit(False)), F.col("retries"), F.col("maxRetries"))
    # fmt: off
    change = {"status": status, "output": F.when(error.isNull(), F.col("_output")), "error": error, "errorCode": code, "lastRanAt": now,
              "retries": F.col("retries") + F.when(error.isNotNull(), 1).otherwise(0), "runAfter": F.when(status == "NEW", F.coalesce("_retryAt", now)).otherwise(F.col("runAfter")),
              "completedAt": F.when(status != "NEW", now), "progress": F.when(status == "COMPLETED", 100.0).when(status == "NEW", 0.0).otherwise(F.col("progress"))}
    # fmt: on
    return out.select(*[F.when(mine, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in jobs.columns])


def aborted(jobs: DataFrame, which: Column, now: Column) -> DataFrame:
    """Running jobs that are chosen become ABORTING; those that have not begun fail at once, so nobody waits for them."""
    waiting, running = which & (F.col("status") == "NEW"), which & (F.col("status") == "PROCESSING")
    change = {"status": F.when(waiting, "FAILED").when(running, "ABORTING"), "error": F.when(waiting, "aborted before it began"), "errorCode": F.when(waiting, ABORT), "completedAt": F.when(waiting, now)}
    return jobs.select(*[F.coalesce(change[c], F.col(c)).alias(c) if c in change else F.col(c) for c in jobs.columns])


def outputs_for(jobs: DataFrame, inputs: DataFrame) -> DataFrame:
    """inputs (input, ...) with the output of the latest COMPLETED job of an equal input, or null."""
    done = jobs.filter(F.col("status") == "COMPLETED").groupBy("fingerprint").agg(F.max_by("output", F.struct("completedAt", "id")).alias("output"))
    return inputs.withColumn("fingerprint", F.sha2("input", 256)).join(done, "fingerprint", "left").drop("fingerprint")


def stats(jobs: DataFrame) -> DataFrame:
    """One row a queue: jobs by what became of them, retries, and the average seconds of completed ones."""
    count = lambda c: F.count_if(c)
    seconds = (F.unix_micros("completedAt") - F.unix_micros("createdAt")) / 1e6
    return jobs.groupBy("queue").agg(
        F.count("*").alias("total"), count(F.col("status") == "NEW").alias("waiting"), count(F.col("status") == "COMPLETED").alias("completed"), count((F.col("status") == "FAILED") & (F.coalesce("errorCode", F.lit("")) != ABORT)).alias("failed"),
        count((F.col("status") == "FAILED") & (F.col("errorCode") == ABORT)).alias("aborted"), F.sum(F.when(F.col("status") != "FAILED", F.col("retries")).otherwise(F.greatest(F.lit(0), F.col("retries") - 1))).cast("long").alias("retried"),
        F.avg(F.when(F.col("status") == "COMPLETED", seconds)).alias("average_seconds"))


def progressed(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """jobs after progress updates (id, progress, message, details); an update of a terminal job raises."""
    u = updates.select(F.col("id").alias("_id"), F.col("progress").alias("_p"), F.col("message").alias("_m"), F.col("details").alias("_d"))
    out = jobs.join(u, F.col("id") == F.col("_id"), "left")
    mine = F.col("_id").isNotNull()
    late = mine & F.col("status").isin(*TERMINAL)
    value = F.when(late, F.raise_error(F.concat(F.lit("progress of a job that is "), F.col("status"))).cast("double")).when(mine, rules.clamp_progress(F.col("_p"))).otherwise(F.col("progress"))
    change = {"progress": value, "progressMessage": F.when(mine, F.coalesce("_m", F.lit(""))).otherwise(F.col("progressMessage")), "progressDetails": F.when(mine, F.col("_d")).otherwise(F.col("progressDetails"))}
    return out.select(*[change.get(c, F.col(c)).alias(c) for c in jobs.columns])


def job_states(events: DataFrame, job: str, order: list[str], values: list[str]) -> DataFrame:
    """The last values of each job and its number of events; for tables, and for streams in complete or update mode."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return events.groupBy(job).agg(last, F.count("*").alias("n_events")).select(job, *[F.col(f"last.{v}").alias(v) for v in values], "n_events")


class Limiter:
    """Whether a job may start now, when the next one may, and what has happened."""

    def __init__(self) -> None:
        self.next = datetime.min

    def can_proceed(self, now: datetime) -> bool:
        return now >= self.next

    def record_start(self, now: datetime) -> None:
        pass

    def record_completion(self, now: datetime) -> None:
        pass

    def next_time(self, now: datetime) -> datetime:
        return max(now, self.next)

    def set_next(self, at: datetime) -> None:
        self.next = max(self.next, at)

    def clear(self) -> None:
        self.__init__()


class ConcurrencyLimiter(Limiter):
    """At most n at once, and a slice of time between starts."""

    def __init__(self, n: int, slice_ms: int = 1000):
        super().__init__()
        self.n, self.slice_ms, self.running = n, slice_ms, 0

    def can_proceed(self, now: datetime) -> bool:
        return self.running < self.n and super().can_proceed(now)

    def record_start(self, now: datetime) -> None:
        self.running += 1
        self.set_next(now + timedelta(milliseconds=self.slice_ms))

    def record_completion(self, now: datetime) -> None:
        self.running = max(0, self.running - 1)

    def clear(self) -> None:
        self.__init__(self.n, self.slice_ms)


class DelayLimiter(Limiter):
    """A least time between starts."""

    def __init__(self, delay_ms: int = 50):
        super().__init__()
        self.delay_ms = delay_ms

    def record_start(self, now: datetime) -> None:
        self.set_next(now + timedelta(milliseconds=self.delay_ms))

    def clear(self) -> None:
        self.__init__(self.delay_ms)


class RateLimiter(Limiter):
    """At most so many starts in any window of so many minutes; a start exactly one window old no longer counts."""

    def __init__(self, most: int, minutes: float):
        super().__init__()
        self.most, self.minutes, self.starts = most, minutes, []

    def _recent(self, now: datetime) -> list[datetime]:
        self.starts = [s for s in self.starts if s > now - timedelta(minutes=self.minutes)]
        return self.starts

    def can_proceed(self, now: datetime) -> bool:
        return len(self._recent(now)) < self.most and super().can_proceed(now)

    def record_start(self, now: datetime) -> None:
        self.starts.append(now)

    def next_time(self, now: datetime) -> datetime:
        """When the oldest start that is too many leaves the window."""
        recent = self._recent(now)
        free = recent[len(recent) - self.most] + timedelta(minutes=self.minutes) if len(recent) >= self.most else now
        return max(free, super().next_time(now))

    def clear(self) -> None:
        self.__init__(self.most, self.minutes)


class CompositeLimiter(Limiter):
    """All of several limiters at once."""

    def __init__(self, limiters: list[Limiter]):
        super().__init__()
        self.limiters = limiters

    def can_proceed(self, now: datetime) -> bool:
        return all(x.can_proceed(now) for x in self.limiters)

    def record_start(self, now: datetime) -> None:
        for x in self.limiters:
            x.record_start(now)

    def record_completion(self, now: datetime) -> None:
        for x in self.limiters:
            x.record_completion(now)

    def next_time(self, now: datetime) -> datetime:
        return max([now, *(x.next_time(now) for x in self.limiters)])

    def set_next(self, at: datetime) -> None:
        for x in self.limiters:
            x.set_next(at)

    def clear(self) -> None:
        for x in self.limiters:
            x.clear()


def delay_violations(starts: DataFrame, queue: str, ts: str, delay_ms: int) -> DataFrame:
    """Starts that come sooner than the delay after the start before, with the gap in milliseconds."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (at - F.lag(at).over(W.partitionBy(queue).orderBy(at))) / 1000
    return starts.withColumn("gap_ms", gap).filter(F.col("gap_ms") < delay_ms)


def nth_oldest(starts: DataFrame, queue: str, ts: str, n: int) -> DataFrame:
    """(queue, at): the n-th oldest start of each queue, of those that have n.

    Only the n oldest of a queue in each task travel: a bounded heap would do the same, array_sort of slices combines on the map side.
    """
    rank = F.row_number().over(W.partitionBy(queue).orderBy(ts))
    return starts.select(queue, ts, rank.alias("_r")).filter(F.col("_r") == n).select(queue, F.col(ts).alias("at"))


def composite_next(now: Column, times: list[Column]) -> Column:
    """When all limiters let the next job start: the latest of their times, now at the earliest."""
    return F.greatest(now, *[F.coalesce(x, now) for x in times])


def usage(starts: DataFrame, queue: str, ts: str, since: Column) -> DataFrame:
    """(queue, attempts, latest) of the starts after a moment, in one pass."""
    return starts.filter(F.col(ts) > since).groupBy(queue).agg(F.count("*").alias("attempts"), F.max(ts).alias("latest"))


class JobQueue:
    """A queue with its state in the shared folder. now may be given everywhere, for replays and tests."""

    def __init__(self, spark: SparkSession, name: str, run: Callable[[str], str] | None = None, limiter: Limiter | None = None):
        self.spark, self.name, self.run, self.limiter, self.mode = spark, name, run, limiter or Limiter(), None
        self.jobs = spark.createDataFrame([], SCHEMA)

    def _now(self, now: datetime | None) -> datetime:
        return now or datetime.now()

    def _set(self, jobs: DataFrame) -> None:
        self.jobs = written(jobs)

    def add(self, rows: DataFrame, now: datetime | None = None) -> None:
        self._set(KVTable(self.jobs, ["id"]).put(new_jobs(rows, self.name, F.lit(self._now(now)))).get_all())

    def get(self, job_id: str) -> DataFrame:
        return self.jobs.filter(F.col("id") == job_id)

    def by_run(self, run_id: str) -> DataFrame:
        return self.jobs.filter(F.col("jobRunId") == run_id)

    def with_status(self, status: str) -> DataFrame:
        return self.jobs.filter(F.col("status") == status)

    def size(self, status: str = "NEW") -> int:
        return self.with_status(status).count()

    def peek(self, n: int = 100, now: datetime | None = None) -> DataFrame:
        return self.jobs.filter((F.col("status") == "NEW") & (F.col("runAfter") > F.lit(self._now(now)))).orderBy("runAfter", "id").limit(n)

    def claim(self, n: int = 1, now: datetime | None = None) -> DataFrame:
        """Up to n runnable jobs, first come first served; they become PROCESSING."""
        at = F.lit(self._now(now))
        chosen = written(self.jobs.filter(rules.runnable(F.col("status"), F.col("runAfter"), at)).orderBy("createdAt", "id").limit(n).select("id"))
        took = self.jobs.join(F.broadcast(chosen.withColumn("_took", F.lit(True))), "id", "left")  # n rows
        change = {"status": F.when(F.col("_took"), "PROCESSING").otherwise(F.col("status")), "lastRanAt": F.when(F.col("_took"), at).otherwise(F.col("lastRanAt"))}
        self._set(took.select(*[change.get(c, F.col(c)).alias(c) for c in self.jobs.columns]))
        return self.jobs.join(F.broadcast(chosen), "id", "left_semi")

    def process(self, now: datetime | None = None, most: int = 1000) -> int:
        """One turn of the loop: start what the limiter admits, run it on the executors, record what came of it. The number of jobs run."""
        if self.mode == "CLIENT":
            return 0
        at, admitted = self._now(now), 0
        while admitted < most and self.limiter.can_proceed(at):
            self.limiter.record_start(at)
            admitted += 1
        claimed = self.claim(admitted, at) if admitted else None
        got = claimed.count() if claimed is not None else 0
        for _ in range(admitted):
            self.limiter.record_completion(at)
        if got:
            self._set(completed(self.jobs, written(attempts(claimed, self.run, at)), F.lit(at)))
        return got

    def complete(self, results: DataFrame, now: datetime | None = None) -> None:
        self._set(completed(self.jobs, results, F.lit(self._now(now))))

    def abort(self, job_id: str, now: datetime | None = None) -> None:
        self._set(aborted(self.jobs, F.col("id") == job_id, F.lit(self._now(now))))

    def abort_run(self, run_id: str, now: datetime | None = None) -> None:
        self._set(aborted(self.jobs, F.col("jobRunId") == run_id, F.lit(self._now(now))))

    def output_for_input(self, value: str) -> str | None:
        return outputs_for(self.jobs, self.spark.createDataFrame([(value,)], "input string")).first().output

    def update_progress(self, updates: DataFrame) -> None:
        self._set(progressed(self.jobs, updates))

    def wait_for(self, job_id: str) -> str | None:
        """Process until the job is terminal; its output, or its error raised."""
        while True:
            row = self.get(job_id).first()
            if row is None:
                raise JobError(f"there is no job {job_id}")
            if row.status == "COMPLETED":
                return row.output
            if row.status == "FAILED":
                raise {RETRYABLE: RetryableJobError, ABORT: AbortSignalJobError}.get(row.errorCode, PermanentJobError)(row.error)
            if not self.process():
                raise JobError(f"job {job_id} is not runnable now")

    def stats(self) -> DataFrame:
        return stats(self.jobs)

    def start(self, mode: str = "BOTH") -> JobQueue:
        """CLIENT submits only, SERVER and BOTH also process."""
        if mode not in ("CLIENT", "SERVER", "BOTH"):
            raise ValueError(f"unknown mode {mode}")
        self.mode = mode
        return self

    def stop(self) -> JobQueue:
        """What runs is aborted; nothing is started until start()."""
        self._set(aborted(self.jobs, F.col("status") == "PROCESSING", F.lit(self._now(None))))
        self.mode = "CLIENT"
        return self

    def clear(self) -> JobQueue:
        self.jobs = self.spark.createDataFrame([], SCHEMA)
        self.limiter.clear()
        return self

    def restart(self) -> JobQueue:
        return self.stop().clear().start()


RESULTS = "id string, output string, error string, errorCode string, retryAt timestamp"


def attempts(claimed: DataFrame, run: Callable[[str], str], now: datetime) -> DataFrame:
    """(id, output, error, errorCode, retryAt) of each claimed job: run(input) on the executors; errors are results, never failures of the stage."""
    refused = refusal(F.when(F.col("status") == "PROCESSING", F.lit("NEW")).otherwise(F.col("status")), F.col("deadlineAt"), F.lit(now))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for job, value, no in zip(pdf["id"], pdf["input"], pdf["refused"]):
                try:
                    if no is not None:
                        raise PermanentJobError(no)
                    rows.append((job, run(value), None, None, None))
                except JobError as e:
                    again = now + timedelta(seconds=e.retry_after) if e.retry_after is not None else None
                    rows.append((job, None, str(e), e.code, again))
                except Exception as e:  # noqa: BLE001
                    rows.append((job, None, str(e), PERMANENT, None))
            yield pd.DataFrame(rows, columns=["id", "output", "error", "errorCode", "retryAt"]).astype({"retryAt": "datetime64[us]"})

    return claimed.select("id", "input", refused.alias("refused")).mapInPandas(work, RESULTS)
