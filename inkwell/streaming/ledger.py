"""The token ledger and the job queue as streams."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.streaming.leases import Leases


def per_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ("event_type",), time: str = "ts", value: str = "value") -> DataFrame:
    """Calls and sums of each tumbling window; events later than `late` are dropped with the state of their window."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *by, "calls", "total")


def once(events: DataFrame, key: str = "request_id", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each request once: repeated posts within the watermark are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def claimed(jobs: DataFrame, model: str | None = None, step: str | None = None) -> DataFrame:
    """The pending jobs, as running ones with the model and the step of the worker that takes them."""
    taken = {"status": F.lit("RUNNING"), "model_name": F.lit(model), "current_step": F.lit(step)}
    return jobs.filter("status = 'PENDING'").withColumns({c: x.cast("string") for c, x in taken.items()})


REPORT = "job_id string, status string, current_step string, error_message string, batch long, fence long"


def work(jobs: DataFrame, handle: Callable[..., DataFrame], results: str, reports: str, checkpoint: str, job: str = "job_id", model: str | None = None, step: str | None = None, interval: str = "5 seconds", leases: Leases | None = None, worker: str | None = None, parallel: int = 4):
    """Claims pending jobs and handles them as the rows come, up to `parallel` at a time; a job that fails is reported, and the loop goes on.

    handle(rows) or handle(rows, progress) gives the job's results; progress(step) reports a step and makes the lease longer. reports gets
    REPORT rows when a job is taken, for its steps, and when it is COMPLETED or FAILED with its error cut to 1,000 characters. A job is a
    unit of work that its handler distributes. Each job's results are a partition `part` of results.

    With leases a job is handled by one of several such loops, once: results and reports carry its lease's number as fence, those that
    count are committed()'s, and a job whose worker was lost is taken again, by the next batch of any loop, when its lease is over.
    """
    spark, schema, worker = jobs.sparkSession, jobs.schema, worker or uuid.uuid4().hex
    steps = len(inspect.signature(handle).parameters) > 1

    def put(rows: DataFrame, path: str) -> None:
        # a folder of its own, as writers of one folder get into each other's way
        rows.write.parquet(f"{path}/part=p-{uuid.uuid4().hex}")

    def report(name: str, status: str, number: int, fence: int | None, at: str | None, error: str | None = None) -> None:
        put(spark.createDataFrame([(name, status, at, error, number, fence)], REPORT).coalesce(1), reports)

    def one(name: str, own: DataFrame, number: int) -> None:
        fence = None
        if leases is not None:
            fence = leases.claim(name, worker, own.toJSON().collect())  # a job's few rows
            if fence is None:
                return
        own = claimed(own, model, step)
        report(name, "RUNNING", number, fence, step)

        def progress(at: str) -> None:
            if leases is not None and not leases.renew(name, fence):
                raise RuntimeError("the lease was taken over")
            report(name, "RUNNING", number, fence, at)

        try:
            done = handle(own, progress) if steps else handle(own)
            put(done.withColumns({"batch": F.lit(number).cast("long"), "fence": F.lit(fence).cast("long")}), results)
        except Exception as e:
            status, error = "FAILED", (str(e) or type(e).__name__)[:1000]
        else:
            status, error = "COMPLETED", None
        if leases is None or leases.finish(name, fence, status):
            report(name, status, number, fence, step, error)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.filter("status = 'PENDING'").persist()
        try:
            with ThreadPoolExecutor(parallel) as pool:
                names = [r[0] for r in rows.select(F.col(job).cast("string")).distinct().collect()]  # the jobs of a batch
                list(pool.map(lambda name: one(name, rows.filter(F.col(job).cast("string") == F.lit(name)), number), names))
                if leases is not None:
                    again = [(name, spark.createDataFrame([(x,) for x in lines], "x string").select(F.from_json("x", schema).alias("x")).select("x.*")) for name, lines in leases.expired()]
                    list(pool.map(lambda x: one(*x, number), again))
        finally:
            rows.unpersist()

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if interval == "once" else {"processingTime": interval})).start()


def committed(rows: DataFrame, leases: Leases, job: str = "job_id") -> DataFrame:
    """The results or reports that count: those with the fence that ended their job."""
    ended = rows.sparkSession.createDataFrame([x[:2] for x in leases.ended()], "_ink_job string, _ink_fence long")
    return rows.join(ended, (F.col(job).cast("string") == F.col("_ink_job")) & (F.col("fence") == F.col("_ink_fence")), "left_semi")
