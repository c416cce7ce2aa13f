"""Structured Streaming operators; each runs to the end of what is there and returns its table."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.session import shared_folder

#: Seconds a job's results may take, and days a request's identity is remembered.
DEADLINE_SECONDS, REMEMBER = 300, "30 days"
#: How late rows may be, and milliseconds that the mark of a finished job is kept.
LATE, KEPT_MS = "1 day", 7 * 86_400_000


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # a file source watches folders; the one file is picked from its folder
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append", root: str | None = None) -> DataFrame:
    """Run ``stream`` over all that is available and read what it wrote.

    A batch writes its own folder and replaces it when it runs again, so a
    restart from the checkpoint repeats nothing. In complete mode the last
    batch is the result. ``root`` names the folder of an earlier run to go on with.
    """
    spark = stream.sparkSession
    root = root or f"{shared_folder(spark)}/siltstone/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{root}/out" if mode == "complete" else f"{root}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out").select(*schema.names)


def fan_out(stream: Callable[[], DataFrame], roles: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Every role sees every message: one query with its own checkpoint per role."""
    return {role: run_to_table(handle(stream())) for role, handle in roles.items()}


def dedupe_requests(jobs: DataFrame, event_time: str = "received_at", remember: str = REMEMBER) -> DataFrame:
    """First delivery of each (repo, pr_number, head_sha) within the watermark; without a commit all pass."""
    keyed = F.when(F.length("head_sha") > 0, F.col("head_sha")).otherwise(F.concat(F.lit("delivery:"), F.col("delivery_id").cast("string")))
    return jobs.withColumn("__commit", keyed).withWatermark(event_time, remember).dropDuplicatesWithinWatermark(["repo", "pr_number", "__commit"]).drop("__commit")


def windowed_counts(events: DataFrame, ts: str, by: str, length: str, slide: str | None = None) -> DataFrame:
    """``by, start, n``: counts per tumbling or sliding window."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, "1 hour")
    at = F.window(ts, length, slide) if slide else F.window(ts, length)
    return timed.groupBy(by, at.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, ts: str, by: str, gap: str) -> DataFrame:
    """``by, start, n`` per session; an addition of the host engine."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, "1 hour")
    return timed.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


_OUT = "job_id string, agents string, complete boolean"
_STATE = "agents array<string>, ats array<long>, ids array<long>, statuses array<string>, expected array<string>, created long, done boolean"


def _gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Results of one job until all expected agents have one in time or the deadline passes; once only."""
    agents, ats, ids, statuses, want, created, done = state.get if state.exists else ([], [], [], [], [], -1, False)
    if state.hasTimedOut and (done or created < 0):  # the mark, or results of a job that never came, have been kept long enough
        state.remove()
        return
    have = {a: x for a, *x in zip(agents, ats, ids, statuses)}
    want = list(want)
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            at = row.at.value // 1000
            if row.kind == "job":
                if created < 0 or at < created:  # what the first request expects counts
                    created, want = at, list(row.expected)
            elif row.kind == "result" and not done:
                # the earliest counts, then the smallest result
                mine = [at, row.result_id, row.status]
                have[row.agent] = min(have.get(row.agent, mine), mine)
    deadline = created + DEADLINE_SECONDS * 1_000_000
    now = state.getCurrentWatermarkMs()
    in_time = {a: x[2] for a, x in have.items() if created >= 0 and x[0] <= deadline}
    complete = bool(want) and set(want) <= set(in_time)
    emit = created >= 0 and not done and (complete or deadline // 1000 < now)
    done = done or emit
    state.update((list(have), *([x[i] for x in have.values()] for i in range(3)), want, created, done))
    keep = KEPT_MS if done or created < 0 else 0
    state.setTimeoutTimestamp(max(deadline // 1000 if created >= 0 else 0, now) + 1 + keep)
    if emit:
        said = {a: in_time.get(a, "timeout") for a in want}
        yield pd.DataFrame({"job_id": [key[0]], "agents": [json.dumps(said, sort_keys=True)], "complete": [complete]})


def fan_in_stream(jobs: DataFrame, results: DataFrame, agents: list[str], ticks: DataFrame | None = None) -> DataFrame:
    """``job_id, agents, complete``: one row per job when its results are in, or its time is up.

    Both streams share one state per job. The deadline counts from the job's
    first creation in event time; a result after it is none. Of an agent's
    results the earliest counts, and any after the row went out change nothing.
    The done mark and the row leave in one step; the mark, like results whose
    job is unknown, goes ``KEPT_MS`` after the deadline has passed. ``ticks``
    (at) only move the time on, as a heartbeat does when nothing else arrives.
    """
    expected = F.array_distinct(F.when(F.size("expected_agents") > 0, F.col("expected_agents")).otherwise(F.array(*map(F.lit, agents))))
    none, nobody = F.lit(None).cast("string"), F.array().cast("array<string>")
    a = jobs.where("job_id is not null and created_at is not null").select("job_id", F.lit("job").alias("kind"), none.alias("agent"), none.alias("status"), F.lit(0).cast("long").alias("result_id"), F.col("created_at").alias("at"), expected.alias("expected"))
    status = F.when(F.col("error").isNull(), "ok").otherwise(F.concat(F.lit("error: "), F.substring("error", 1, 120)))
    b = results.where("job_id is not null and agent is not null and arrived_at is not null").select("job_id", F.lit("result").alias("kind"), "agent", status.alias("status"), F.col("result_id").cast("long").alias("result_id"), F.col("arrived_at").alias("at"), nobody.alias("expected"))
    both = a.unionByName(b)
    if ticks is not None:
        both = both.unionByName(ticks.select(F.lit("").alias("job_id"), F.lit("tick").alias("kind"), none.alias("agent"), none.alias("status"), F.lit(0).cast("long").alias("result_id"), "at", nobody.alias("expected")))
    timed = both.withWatermark("at", LATE)
    return timed.groupBy("job_id").applyInPandasWithState(_gather, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def fan_in_table(spark: SparkSession, sf_dir: str, jobs: str, results: str, agents: list[str]) -> DataFrame:
    """:func:`fan_in_stream` over all files of two tables, to its end.

    When all is read, a heartbeat past the last deadline follows through the
    same checkpoint, so that what still waits goes out.
    """
    root = f"{shared_folder(spark)}/siltstone/stream-{uuid.uuid4().hex}"
    beat = lambda at: spark.sql(f"SELECT timestamp_micros({at}) AS at").write.mode("append").parquet(f"{root}/ticks")
    beat(0)
    last = max(spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.max(F.unix_micros(F.col(c).cast("timestamp")))).first()[0] or 0 for t, c in ((jobs, "created_at"), (results, "arrived_at")))
    for at in (None, last + 1_000_000 * (DEADLINE_SECONDS + 1) + 2 * 86_400_000_000):
        if at is not None:
            beat(at)
        ticks = spark.readStream.schema("at timestamp").parquet(f"{root}/ticks")
        out = run_to_table(fan_in_stream(stream_table(spark, sf_dir, jobs), stream_table(spark, sf_dir, results), agents, ticks), root=root)
    return out


def with_dead_letters(messages: DataFrame, check: Column | None = None, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(handled, dead)`` of messages (topic, key, value): JSON objects pass, others go to the dead letters after ``attempts``."""
    good = F.get_json_object("value", "$").startswith("{") if check is None else check
    marked = messages.withColumn("ok", F.coalesce(good, F.lit(False)))
    dead = marked.where(~F.col("ok")).select(F.lit("dlq").alias("topic"), "key", "value", F.create_map(F.lit("origin"), "topic", F.lit("attempts"), F.lit(str(attempts)), F.lit("error"), F.lit("not a JSON object")).alias("headers"))
    return marked.where("ok").drop("ok"), dead


def backoff(attempt: int, most: float = 30.0) -> float:
    """Seconds to wait after a failed attempt, from 1: 2, 4, 8 and so on up to ``most``."""
    return min(2.0**attempt, most)


def handle_rows(messages: DataFrame, handle: Callable[[str | None], str | None], attempts: int = 3, wait: Callable[[int], float] | None = backoff) -> DataFrame:
    """``messages`` (topic, key, value) with ``result, outcome, error, attempts``; for batches and for ``foreachBatch``.

    A row that fails is tried again, ``attempts`` times in all. ``outcome`` is
    ok, retry for a success after a failure, or dlq; then ``error`` holds at
    most 500 characters of the last failure. The job itself never fails for a
    row, so its offset is committed either way.
    """
    names = messages.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value in pdf["value"]:
                result, error, n = None, None, 0
                while n < attempts:
                    n += 1
                    try:
                        result, error = handle(value), None
                        break
                    except Exception as e:
                        error = (str(e) or type(e).__name__)[:500]
                        if wait and n < attempts:
                            time.sleep(wait(n))
                out.append((result, "dlq" if error is not None else "ok" if n == 1 else "retry", error, n))
            extra = pd.DataFrame(out, columns=["result", "outcome", "error", "attempts"], index=pdf.index)
            yield pd.concat([pdf, extra], axis=1)

    schema = ", ".join(f"`{c}` {t}" for c, t in messages.dtypes)
    return messages.select(*names).mapInPandas(work, f"{schema}, result string, outcome string, error string, attempts int")


def latest_status(log: DataFrame) -> DataFrame:
    """``job_id, status``: the furthest status of each job; a late earlier one changes nothing."""
    order = F.array_position(F.array(*[F.lit(s) for s in ("queued", "agents", "judging", "completed")]), F.col("status"))
    return log.groupBy("job_id").agg(F.max_by("status", order).alias("status"))
