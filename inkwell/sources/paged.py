"""A paged API as a data source: batches and streams of annotation pages, read by cursor.

    paged.register(spark)
    spark.read.format("paged").option("path", folder).load().filter("episode_no IN (1, 2)")

A request is {"page_size", "sorts", "filter", "start_cursor"}; an answer is (status, headers, {"results", "has_more", "next_cursor"}). The
transport `path` answers requests from a folder offline: its *.json files hold lists of pages. A subclass of Paged with another ask()
reads another API. Statuses of 429 and of 500 and more are asked again, up to ATTEMPTS times in all, after as many seconds as Retry-After
says (1 where it says nothing that is a number); any other error, an answer without results, and has_more without a cursor end the job.

Rows are (id, episode_no, sort_order, body), where body is the page's JSON. Filters of episode_no by = and IN go into the request, and
each number asked for is a partition with a cursor chain of its own; without such a filter there is one chain, as only its own answers say
where a chain goes on. The order of a chain is that of the request. The offset of a stream is a cursor and the results used behind it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

from inkwell.sources import tables

ATTEMPTS, PAGE = 4, 100
SCHEMA = "id string, episode_no double, sort_order double, body string"
#: The properties that pages are sorted and filtered by.
EPISODE, ORDER = tables.PROPERTIES["episode_no"], tables.PROPERTIES["sort_order"]


def number(page: dict, name: str) -> float | None:
    return ((page.get("properties") or {}).get(name) or {}).get("number")


class Api:
    """Requests and retries of one source."""

    def __init__(self, options: dict, sleep=time.sleep):
        self.options, self.sleep = {k.lower(): v for k, v in options.items()}, sleep

    def ask(self, body: dict) -> tuple[int, dict, dict]:
        """Answer a request from the folder `path`; the cursor is the number of results before the page."""
        pages = [p for f in sorted(Path(self.options["path"]).glob("*.json")) for p in json.loads(f.read_text(encoding="utf-8"))]
        if "filter" in body:
            wanted = {x["number"]["equals"] for x in body["filter"]["or"]}
            pages = [p for p in pages if number(p, EPISODE) in wanted]
        if body["sorts"]:
            pages.sort(key=lambda p: [(number(p, s["property"]) is None, number(p, s["property"]) or 0) for s in body["sorts"]])
        at = int(body.get("start_cursor") or 0)
        end = at + body["page_size"]
        more = end < len(pages)
        return 200, {}, {"results": pages[at:end], "has_more": more, "next_cursor": str(end) if more else None}

    def answer(self, episode: float | None, cursor: str | None, ordered: bool = True) -> dict:
        body = {"page_size": int(self.options.get("pagesize", PAGE)), "sorts": [{"property": p, "direction": "ascending"} for p in (EPISODE, ORDER)] if ordered else []}
        if episode is not None:
            body["filter"] = {"or": [{"property": EPISODE, "number": {"equals": episode}}]}
        if cursor:
            body["start_cursor"] = cursor
        for left in reversed(range(ATTEMPTS)):
            status, headers, payload = self.ask(body)
            if status < 400:
                if not isinstance(payload, dict) or not isinstance(payload.get("results"), list):
                    raise ValueError("the answer has no results")
                if payload.get("has_more") and not (isinstance(payload.get("next_cursor"), str) and payload["next_cursor"]):
                    raise ValueError("has_more without a cursor")
                return payload
            if not left or status != 429 and status < 500:
                raise RuntimeError(f"the source answered {status}")
            try:
                seconds = max(float(headers.get("Retry-After", "1")), 0.0)
            except ValueError:
                seconds = 1.0
            self.sleep(seconds)

    def chain(self, episode: float | None) -> Iterator[dict]:
        cursor = None
        while True:
            payload = self.answer(episode, cursor)
            yield from (p for p in payload["results"] if isinstance(p, dict))
            if not payload.get("has_more"):
                return
            cursor = payload["next_cursor"]


def shown(page: dict) -> tuple:
    return page.get("id"), number(page, EPISODE), number(page, ORDER), json.dumps(page, ensure_ascii=False)


class Chain(InputPartition):
    def __init__(self, episode: float | None):
        self.episode = episode


class Reader(DataSourceReader):
    def __init__(self, api: Api):
        self.api, self.episodes = api, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("episode_no",):
                yield f
            else:
                self.episodes = values if self.episodes is None else self.episodes & values

    def partitions(self) -> list[InputPartition]:
        return [Chain(None)] if self.episodes is None else [Chain(e) for e in sorted(x for x in self.episodes if x is not None)]

    def read(self, partition: Chain) -> Iterator[tuple]:
        yield from map(shown, self.api.chain(partition.episode)) if partition is not None else ()


class StreamReader(SimpleDataSourceStreamReader):
    """Pages in the order in which the source has them, as new ones come behind."""

    def __init__(self, api: Api):
        self.api = api

    def initialOffset(self) -> dict:
        return {"cursor": "", "used": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        payload = self.api.answer(None, start["cursor"], ordered=False)
        rows = payload["results"][start["used"] :]
        end = {"cursor": payload["next_cursor"], "used": 0} if payload.get("has_more") else {"cursor": start["cursor"], "used": len(payload["results"])}
        return iter([shown(p) for p in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        payload = self.api.answer(None, start["cursor"], ordered=False)
        last = end["used"] if end["cursor"] == start["cursor"] else None
        return iter([shown(p) for p in payload["results"][start["used"] : last]])

    def commit(self, end: dict) -> None:
        pass


class Paged(DataSource):
    """The data source `paged`; a subclass may have another api()."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def api(self) -> Api:
        return Api(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.api())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return StreamReader(self.api())


def register(spark: SparkSession, source: type[Paged] = Paged) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def annotations(pages: DataFrame) -> DataFrame:
    """The pages with the schema that tables.parse_annotations() reads."""
    return pages.select(F.from_json("body", tables.PAGES).alias("p")).select("p.*")
