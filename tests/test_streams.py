"""The ledger as state of a stream, jobs under leases, and calls that are made once."""

import json
import os
import random
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from inkwell.operators import metering
from inkwell.streaming import leases, ledger, reservations

EVENT = "request_id string, ordinal int, event string, time timestamp, purpose string, model string, reserved long, input long, cached long, output long"


def event(i, ordinal, kind, minute, reserved=None, used=None):
    return (i, ordinal, kind, f"2024-05-01 {minute // 60:02d}:{minute % 60:02d}:00", "p", "m", reserved, used, 0 if used is not None else None, 1 if used is not None else None)


class Stream:
    """Rows written file by file, and a query over them that can be stopped and started again."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def add(self, rows):
        names = [c.split()[0] for c in EVENT.split(", ")]
        self.n += 1
        os.makedirs(f"{self.folder}/in", exist_ok=True)
        with open(f"{self.folder}/in/.{self.n}", "w") as f:
            f.writelines(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows)
        os.rename(f"{self.folder}/in/.{self.n}", f"{self.folder}/in/{self.n:03d}.json")

    def run(self, **options):
        events = self.spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(f"{self.folder}/in")
        changes = reservations.requests(events, **options)
        changes.writeStream.foreachBatch(lambda d, n: d.write.mode("append").json(f"{self.folder}/out")).outputMode("update").option("checkpointLocation", f"{self.folder}/cp").trigger(availableNow=True).start().awaitTermination(180)
        return {r["request_id"]: r for r in reservations.latest(self.spark.read.schema(reservations.OUT).json(f"{self.folder}/out")).collect()}


def test_stream_state_is_the_settled_ledger(spark, tmp_path):
    """Repeated, out of order and over two runs with a restart in between: the final state is metering.settle()."""
    rng, rows = random.Random(3), []
    for i in range(40):
        own = [event(f"r{i}", k, "reserve", i + k, 100 + k) for k in range(rng.randrange(1, 3))]
        own += [event(f"r{i}", 5, "settle", i + 6, None, rng.choice((None, 7, 30)))] * rng.randrange(3) + [event(f"r{i}", 6, "release", i + 7)] * rng.randrange(2)
        rows += own + own[: rng.randrange(2)]
    rng.shuffle(rows)
    s = Stream(spark, str(tmp_path))
    for part in (rows[:60], rows[60:]):
        s.add(part[::2])
        s.add(part[1::2])
        got = s.run(hold=10**9, late="1 day")
    frame = spark.createDataFrame(rows, EVENT.replace("timestamp", "string"))
    wanted = {r["request_id"]: tuple(r) for r in metering.settle(frame).collect()}
    shown = ("request_id", "purpose", "model", "reserved", "attempts", "state", "input", "cached", "output")
    assert {i: tuple(r[c] for c in shown) for i, r in got.items()} == wanted and {r["state"] for r in got.values()} == {"SETTLED", "RELEASED", "RESERVED"}
    assert not any(r["expired"] for r in got.values())


def test_reservations_that_never_settle_are_released(spark, tmp_path):
    s, minute = Stream(spark, str(tmp_path)), 60 * reservations.SECOND
    options = {"hold": 30 * minute, "keep": 60 * minute, "late": "1 minute"}
    s.add([event("a", 0, "reserve", 0, 10), event("b", 0, "reserve", 0, 20), event("c", 0, "reserve", 0, 30)])
    s.add([event("b", 1, "settle", 20, None, 5), event("d", 0, "reserve", 29, 1)])
    got = s.run(**options)
    assert {i: r["state"] for i, r in got.items()} == {"a": "RESERVED", "b": "SETTLED", "c": "RESERVED", "d": "RESERVED"}
    s.add([event("e", 0, "reserve", 40, 1)])  # the watermark passes the hold of a and c
    s.add([event("f", 0, "release", 41)])  # a batch later their timers have fired
    s.add([event("c", 1, "settle", 42, None, 9), event("a", 1, "reserve", 1, 10)])  # usage after the release counts; an event behind the watermark is dropped
    got = s.run(**options)
    assert got["a"]["attempts"] == 1 and got.pop("f")["state"] == "RELEASED"
    assert {i: (r["state"], r["expired"]) for i, r in got.items()} == {"a": ("RELEASED", True), "b": ("SETTLED", False), "c": ("SETTLED", True), "d": ("RESERVED", False), "e": ("RESERVED", False)}


JOB = "job_id string, status string, payload string"


def queue(spark, folder, rows):
    spark.createDataFrame(rows, JOB).coalesce(1).write.mode("append").parquet(folder)


def test_lease_is_had_by_one_and_fenced(spark, tmp_path):
    now = [0.0]
    held = leases.Leases(spark, str(tmp_path), 10, lambda: now[0])
    assert held.claim("a/b ü", "w1", ["x"]) == 1 and held.claim("a/b ü", "w2") is None
    now[0] = 8
    assert held.renew("a/b ü", 1)
    now[0] = 15
    assert held.claim("a/b ü", "w2") is None and list(held.expired()) == []
    now[0] = 19
    assert list(held.expired()) == [("a/b ü", ["x"])] and held.claim("a/b ü", "w2", ["x"]) == 2
    assert not held.renew("a/b ü", 1) and not held.finish("a/b ü", 1, "COMPLETED")
    assert held.finish("a/b ü", 2, "COMPLETED") and not held.finish("a/b ü", 2, "FAILED")
    now[0] = 99
    assert held.claim("a/b ü", "w3") is None and list(held.ended()) == [("a/b ü", 2, "COMPLETED")] and list(held.expired()) == []


def test_two_loops_handle_each_job_once(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    queue(spark, at("in"), [(f"j{i}", "PENDING", "bad" if i == 3 else "x") for i in range(8)])
    held = leases.Leases(spark, at("leases"), 600)

    def handle(rows, progress):
        progress("EXTRACT")
        if rows.first()["payload"] == "bad":
            raise ValueError("no")
        return rows.select("job_id", "payload")

    loops = [ledger.work(spark.readStream.schema(JOB).parquet(at("in")), handle, at("out"), at("reports"), at(f"cp{w}"), interval="once", leases=held, worker=f"w{w}") for w in range(2)]
    for q in loops:
        q.awaitTermination(240)
        assert q.exception() is None
    out = ledger.committed(spark.read.parquet(at("out")), held)
    assert sorted(r["job_id"] for r in out.collect()) == [f"j{i}" for i in range(8) if i != 3] and spark.read.parquet(at("out")).count() == 7
    reports = [(r["job_id"], r["status"], r["current_step"]) for r in spark.read.parquet(at("reports")).collect()]
    assert sorted(reports.count((f"j{i}", "COMPLETED", None)) for i in range(8)) == [0] + [1] * 7 and reports.count(("j3", "FAILED", None)) == 1 and reports.count(("j5", "RUNNING", "EXTRACT")) == 1


def test_job_of_a_killed_worker_is_taken_again(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    now = [100.0]
    held = leases.Leases(spark, at("leases"), 10, lambda: now[0])
    lost = held.claim("old", "killed", ['{"job_id":"old","status":"PENDING","payload":"p"}'])  # and then nothing more is heard of it
    queue(spark, at("in"), [("new", "PENDING", "q"), ("old", "PENDING", "p")])
    run = lambda: ledger.work(spark.readStream.schema(JOB).parquet(at("in")), lambda rows: rows.select("job_id", "payload"), at("out"), at("reports"), at("cp"), interval="once", leases=held).awaitTermination(120)
    run()
    assert [r["job_id"] for r in spark.read.parquet(at("out")).collect()] == ["new"]
    now[0] = 111
    queue(spark, at("in"), [("later", "PENDING", "r")])
    run()
    got = {r["job_id"]: (r["payload"], r["fence"]) for r in ledger.committed(spark.read.parquet(at("out")), held).collect()}
    assert got == {"new": ("q", 1), "later": ("r", 1), "old": ("p", 2)} and not held.finish("old", lost, "COMPLETED")


CALLER = """
import os, sys
from inkwell.operators import answers, extraction
from pyspark.sql import SparkSession
folder, killed = sys.argv[1], sys.argv[2] == "kill"
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "1").getOrCreate()
def provider(prompt):
    with open(folder + "/calls", "a") as f:
        f.write(prompt.split()[-1] + "\\n")
    if killed and len(open(folder + "/calls").readlines()) > 4:
        os._exit(1)
    return '{"candidates": []}' if "t2" not in prompt or len([x for x in open(folder + "/calls") if x == "t2\\n"]) > 1 else "broken"
chunks = spark.createDataFrame([(str(i), f"t{i}") for i in range(8)], "chunk_id string, chunk_text string").coalesce(1)
extraction.extract(chunks, answers.Once(provider, folder + "/answers", "m", "EXTRACT", patience=1), "static", [{"schemaKey": "k"}]).count()
"""


def test_a_killed_task_makes_no_second_call(tmp_path):
    """A process dies in the middle of its calls; started again it only makes those that have no answer. A broken answer's next attempt is another call."""
    (tmp_path / "caller.py").write_text(textwrap.dedent(CALLER))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for how in ("kill", "go", "go"):
        done = subprocess.run([sys.executable, str(tmp_path / "caller.py"), str(tmp_path), how], env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=90)
        assert (done.returncode == 0) == (how == "go"), done.stderr[-2000:]
    calls = (tmp_path / "calls").read_text().split()
    assert sorted(calls) == sorted(["t0", "t1", "t2", "t2", "t3", "t3", "t4", "t5", "t6", "t7"])  # the process died in t3's call, before its answer


def test_tokens_are_booked_once(spark, tmp_path):
    from inkwell.operators import answers

    asked = []
    once = answers.Once(lambda p: asked.append(p) or (p.upper(), 5, 2, 1), str(tmp_path / "a"), "m", "JUDGE")
    assert [once(p) for p in ("x", "y", "x")] == [("X", 5, 2, 1), ("Y", 5, 2, 1), ("X", 5, 2, 1)] and asked == ["x", "y"] and once.ask("x", 1) == ("X", 5, 2, 1)
    assert [tuple(r) for r in answers.tokens(spark, str(tmp_path / "a")).collect()] == [("m", "JUDGE", 3, 15, 6, 3)]
    many = answers.Once(lambda texts: [[1.0, float(len(t))] for t in texts], str(tmp_path / "b"))
    assert many(["a", "bc"]) == many(["a", "bc"]) == [[1.0, 1.0], [1.0, 2.0]]
    slow = answers.Once(lambda p: asked.append(p) or time.sleep(0.5) or p, str(tmp_path / "c"))
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(slow, ["same"] * 4)) == ["same"] * 4 and asked.count("same") == 1
    stale = answers.Once(lambda p: p, str(tmp_path / "c"), patience=-1)
    key = next((tmp_path / "c").rglob("*.json"))
    key.rename(key.parent / f".{key.stem}.lock")
    assert stale("same") == "same"
    with pytest.raises(ZeroDivisionError):
        answers.Once(lambda p: 1 / 0, str(tmp_path / "d"))("p")
    assert not list((tmp_path / "d").rglob("*.lock"))
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_a_new_request_costs_three_calls_to_the_state():
    """Each call is a way to the JVM and back; that is what a stream of many requests takes its time for."""
    calls = []

    class State:
        def get(self):
            calls.append("get")

        def exists(self):
            calls.append("exists")
            return False

        def update(self, value):
            calls.append("update")

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def listTimers(self):
            calls.append("listTimers")
            return []

        def registerTimer(self, at):
            calls.append("registerTimer")

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    own = reservations.Requests(1000, 2000)
    own.init(Handle())
    rows = [{"e": json.dumps({"ordinal": 0, "event": "reserve", "reserved": 7, "at": 5})}, {"e": json.dumps({"ordinal": 1, "event": "settle", "input": 3, "at": 6})}]
    change = [json.loads(r["change"]) for r in own.handleInputRows(("a",), iter(rows), Timers())]
    assert [(c["request_id"], c["state"], c["reserved"], c["input"], c["version"]) for c in change] == [("a", "SETTLED", 7, 3, 1)]
    assert calls == ["get", "update", "registerTimer"]
