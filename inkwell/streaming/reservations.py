"""The token ledger as state of a stream: reserve, settle and release of each request, with a timer for those that never settle.

Events are (request_id, ordinal, event, time, purpose, model, reserved, input, cached, output). A request's state is that of
metering.settle(): repeated events count once, a settle event with known usage settles it, whatever was before, a release or a settle
event without usage releases it. In addition a request that is still reserved when the watermark has passed `hold` after its last
reservation is released by a timer (expired); usage that still comes in time settles it after all. Events behind the watermark are dropped by
Spark. A request's state is forgotten `keep` after its last event, when the watermark lets no event of that time in any more.

The stream has a row for each change of a request, with a version; latest() takes the last of each.

What a request costs is mostly the way between Spark and Python. So the state is asked as seldom as possible, and an event and a change
are one column of JSON each, which Spark writes and reads.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECOND = 1000
STATE = "purpose string, model string, reserved long, attempts long, at_ordinal int, input long, cached long, output long, over boolean, expired boolean, seen array<string>, reserved_at long, last_at long, version long"
OUT = "request_id string, purpose string, model string, reserved long, attempts long, state string, input long, cached long, output long, expired boolean, version long"
EMPTY = {"purpose": None, "model": None, "reserved": None, "attempts": 0, "at_ordinal": None, "input": None, "cached": None, "output": None, "over": False, "expired": False, "seen": [], "reserved_at": None, "last_at": 0, "version": 0}
EVENT = ("ordinal", "event", "purpose", "model", "reserved", "input", "cached", "output", "at")
SHOWN = ("purpose", "model", "reserved", "attempts", "input", "cached", "output", "expired", "version")
RESERVED, SETTLED, RELEASED = "RESERVED", "SETTLED", "RELEASED"


def state_of(s: dict) -> str:
    return SETTLED if s["at_ordinal"] is not None else RELEASED if s["over"] or s["expired"] else RESERVED


def taken(s: dict, e: dict) -> bool:
    """Put an event into the state of its request; whether it was new."""
    e = dict.fromkeys(EVENT) | e
    name = f"{e['ordinal']}:{e['event']}"
    s["last_at"] = max(s["last_at"], e["at"])
    if name in s["seen"]:
        return False
    s["seen"] = [*s["seen"], name]
    for c in ("purpose", "model"):
        s[c] = s[c] if s[c] is not None else e[c]
    if e["reserved"] is not None:
        s["reserved"] = max(s["reserved"] or 0, e["reserved"])
    if e["event"] == "reserve":
        s["attempts"] += 1
        s["reserved_at"] = max(s["reserved_at"] or 0, e["at"])
    if e["event"] in ("settle", "release"):
        s["over"] = True
    if e["event"] == "settle" and e["input"] is not None and (s["at_ordinal"] is None or e["ordinal"] > s["at_ordinal"]):
        s |= {"at_ordinal": e["ordinal"], "input": e["input"], "cached": e["cached"], "output": e["output"]}
    return True


class Requests(StatefulProcessor):
    """One request's state; hold and keep in milliseconds of event time."""

    def __init__(self, hold: int, keep: int):
        self.hold, self.keep = hold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", STATE)

    def _read(self) -> dict | None:
        held = self.state.get()
        return None if held is None else dict(zip(EMPTY, held, strict=True))

    def _shown(self, key, s: dict) -> Row:
        s["version"] += 1
        return Row(change=json.dumps({"request_id": key[0], "state": state_of(s)} | {c: s[c] for c in SHOWN}))

    def _due(self, s: dict) -> int:
        """When the request is looked at next."""
        return s["reserved_at"] + self.hold if state_of(s) == RESERVED and s["reserved_at"] is not None else s["last_at"] + self.keep

    def _kept(self, s: dict, watermark: int, new: bool = False) -> None:
        for t in () if new else list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update(tuple(list(s[c]) if c == "seen" else s[c] for c in EMPTY))
        self.handle.registerTimer(max(self._due(s), watermark + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, changed = self._read(), False
        s = dict(EMPTY) if held is None else held
        for e in rows:
            changed = taken(s, json.loads(e["e"])) or changed
        if changed:
            yield self._shown(key, s)
        self._kept(s, timerValues.getCurrentWatermarkInMs(), held is None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, now = self._read(), timerValues.getCurrentWatermarkInMs()
        if state_of(s) == RESERVED:
            s["expired"] = True
            yield self._shown(key, s)
            self._kept(s, now)
        elif s["last_at"] + self.keep <= now:
            self.state.clear()
        else:
            self._kept(s, now)

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """The state store that such streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def requests(events: DataFrame, hold: int = 3600 * SECOND, keep: int = 24 * 3600 * SECOND, late: str = "10 minutes", time: str = "time") -> DataFrame:
    """The changes of each request (OUT) of a stream of events. keep is at least hold."""
    prepare(events.sparkSession)
    at = F.col(time).cast("timestamp")
    columns = {"ordinal": "int", "event": "string", "purpose": "string", "model": "string", "reserved": "long", "input": "long", "cached": "long", "output": "long"}
    event = F.to_json(F.struct(*(F.col(c).cast(t).alias(c) for c, t in columns.items()), F.unix_millis(at).alias("at")))
    whole = events.select(F.col("request_id").cast("string").alias("request_id"), at.alias("time"), event.alias("e"))
    changes = whole.withWatermark("time", late).groupBy("request_id").transformWithState(Requests(hold, max(hold, keep)), "change string", "Update", "EventTime")
    return changes.select(F.from_json("change", OUT).alias("c")).select("c.*")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each request."""
    names = [c for c in changes.columns if c != "request_id"]
    return changes.groupBy("request_id").agg(F.max_by(F.struct(*names), "version").alias("r")).select("request_id", "r.*")
