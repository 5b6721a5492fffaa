"""The paged source: order, pushed filters, retries, streams, and the way to gold."""

import json

import pytest

from inkwell.sources import paged, tables


def page(i, episode, order):
    text = {"entityName": "Mira", "factKey": "level", "attributeValue": "3", "valueJson": '{"value": 3}', "evidenceQuotes": "q"}
    p = {tables.PROPERTIES[k]: {"type": "rich_text", "rich_text": [{"plain_text": v}]} for k, v in text.items()}
    p |= {tables.PROPERTIES[k]: {"type": "select", "select": {"name": v}} for k, v in (("decision", "EXTRACT"), ("importance", "MUST"), ("valueType", "NUMBER"))}
    return {"id": i, "properties": p | {paged.EPISODE: {"type": "number", "number": episode}, paged.ORDER: {"type": "number", "number": order}}}


def put(folder, name, pages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(pages, ensure_ascii=False), encoding="utf-8")


def test_batches_push_filters_and_keep_order(spark, tmp_path):
    folder = tmp_path / "api"
    put(folder, "a.json", [page(f"p{i}", i % 3 + 1, 50 - i) for i in range(25)])
    put(folder, "b.json", [page("x", None, 1)])

    class Counted(paged.Paged):
        @classmethod
        def name(cls):
            return "counted"

        def api(self):
            log = str(tmp_path / "log")

            class Logged(paged.Api):
                def ask(self, body):
                    with open(log, "a") as f:
                        f.write(json.dumps(body) + "\n")
                    return super().ask(body)

            return Logged(dict(self.options))

    paged.register(spark, Counted)
    rows = spark.read.format("counted").option("path", str(folder)).option("pageSize", "4").load()
    got = rows.collect()
    keys = [(r["episode_no"] is None, r["episode_no"] or 0, r["sort_order"]) for r in got]
    assert len(got) == 26 and keys == sorted(keys)
    (tmp_path / "log").unlink()
    some = rows.filter("episode_no IN (1.0, 3.0) AND sort_order > 30")
    assert some.rdd.getNumPartitions() == 2
    assert {(r["id"], r["episode_no"]) for r in some.collect()} == {(f"p{i}", i % 3 + 1) for i in range(25) if i % 3 != 1 and 50 - i > 30}
    asked = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert asked and all(len(b["filter"]["or"]) == 1 and b["filter"]["or"][0]["number"]["equals"] in (1, 3) for b in asked) and {b.get("start_cursor") for b in asked} == {None, "4", "8"}
    assert rows.filter("episode_no = 2 AND episode_no IN (1, 3)").count() == 0
    gold = tables.gold_from_annotations(tables.parse_annotations(paged.annotations(rows.filter("episode_no = 2")))).first()
    assert gold["episodeNo"] == 2 and len(gold["candidates"]) == 8


@pytest.mark.parametrize(("answers", "wanted", "slept"), [
    ([(429, {"Retry-After": "7"}, {}), (503, {}, {}), (500, {"Retry-After": "soon"}, {}), (200, {}, {"results": [page("a", 1, 1)]})], ["a"], [7.0, 1.0, 1.0]),
    ([(429, {"Retry-After": "-3"}, {}), (200, {}, {"results": [page("a", 1, 1), "no page"], "has_more": True, "next_cursor": "c"}), (200, {}, {"results": [page("b", 1, 2)], "has_more": False})], ["a", "b"], [0.0]),
    ([(503, {}, {})] * 4, RuntimeError, [1.0] * 3), ([(404, {}, {})], RuntimeError, []), ([(200, {}, {"results": 3})], ValueError, []), ([(200, {}, {"results": [], "has_more": True})], ValueError, []),
])
def test_retries(answers, wanted, slept):
    seen = []

    class Scripted(paged.Api):
        def ask(self, body):
            return left.pop(0)

    left = list(answers)
    api = Scripted({}, seen.append)
    if isinstance(wanted, list):
        assert [p["id"] for p in api.chain(None)] == wanted
    else:
        with pytest.raises(wanted):
            list(api.chain(None))
    assert seen == slept and not left


def test_stream_goes_on_from_its_cursor(spark, tmp_path):
    paged.register(spark)
    folder = tmp_path / "api"

    def run():
        rows = spark.readStream.format("paged").option("path", str(folder)).option("pageSize", "4").load()
        q = rows.writeStream.foreachBatch(lambda d, n: d.write.mode("append").json(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r["id"] for r in spark.read.schema(paged.SCHEMA).json(str(tmp_path / "out")).collect())

    put(folder, "a.json", [page(f"p{i}", 1, i) for i in range(6)])
    assert run() == [f"p{i}" for i in range(6)]
    put(folder, "b.json", [page(f"q{i}", 1, i) for i in range(5)])
    assert run() == [f"p{i}" for i in range(6)] + [f"q{i}" for i in range(5)]
