"""Registered queries against their SQL on the smallest tables, sources, and streams."""

import glob
import importlib.util
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkwell.plans import queries as plans
from inkwell.sources import tables
from inkwell.streaming import ledger


def shown(x):
    if x is None or str(x) in ("<NA>", "NaT", "nan"):
        return "NULL"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, str):
        return x
    try:
        return repr(round(float(x), 9))
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rows = lambda d: sorted(tuple(shown(x) for x in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    got, wanted = plans.QUERIES[name](spark, sf).toPandas(), con.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns) and rows(got) == rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_imports_nothing_of_llm():
    root = os.path.dirname(importlib.util.find_spec("inkwell").origin)
    for f in glob.glob(f"{root}/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "inkwell.llm" not in open(f).read(), f


def test_sources(spark, tmp_path):
    gold = {"datasetVersion": "1", "name": "n", "episodes": [{"episodeNo": 2, "sourceFile": "a/e2.txt", "candidates": [{"decision": "EXTRACT", "entityName": "A", "factKey": "k", "evidenceQuotes": ["q"], "valueJson": {"x": 1}}]}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    for folder, text in (("a", "본문\n둘"), ("b", "another text"), ("c d+%20", "third")):
        (tmp_path / "texts" / folder).mkdir(parents=True)
        (tmp_path / "texts" / folder / "e2.txt").write_text(text, encoding="utf-8")
    texts = tables.read_texts(spark, str(tmp_path / "texts"))
    assert {r["file"]: r["text"] for r in texts.collect()} == {"a/e2.txt": "본문\n둘", "b/e2.txt": "another text", "c d+%20/e2.txt": "third"}
    [row] = tables.read_gold(spark, str(tmp_path / "gold.json"), texts).collect()
    assert (row["episode_no"], row["source_text"], row["aliases"], json.loads(row["value_json"])) == (2, "본문\n둘", [], {"x": 1})
    with pytest.raises(Exception, match="missing source file"):
        tables.read_gold(spark, str(tmp_path / "gold.json")).collect()
    (tmp_path / "p.json").write_text(json.dumps({"episodes": [{"episodeNo": 1, "candidates": [{"entity_name": "A"}]}, {"episodeNo": 1, "candidates": []}]}))
    with pytest.raises(ValueError):
        tables.read_predictions(spark, str(tmp_path / "p.json"))
    debug = {"summary": {"episodeNo": 3}, "knownCharacters": [{"characterId": "c1", "name": "Odile Marsh"}], "settingCandidates": [{"candidateKind": "SETTING", "entity_name": "Odile", "matchStatus": "MATCHED", "matched_character_id": "c1", "attributeName": "a", "value_json": {"v": 1}, "evidenceSpans": [{"quote": "q", "startOffset": 1}]}]}
    for name, rows in (("d.json", debug), ("e.json", {"episodeNo": 4, "candidates": [{"entityName": "B", "matched_character_name": "C"}]}), ("f.json", debug | {"knownCharacters": []})):
        (tmp_path / name).write_text(json.dumps(rows, ensure_ascii=False))
    got = {r["episode_no"]: (r["entity_name"], r["match_status"], r["matched_name"], r["attribute_name"], r["value_json"], r["quotes"]) for r in tables.read_predictions(spark, [str(tmp_path / "d.json"), str(tmp_path / "e.json")]).collect()}
    assert got == {3: ("Odile", "MATCHED", "Odile Marsh", "a", '{"v": 1}', ["q"]), 4: ("B", None, "C", None, None, None)}
    with pytest.raises(Exception, match="unknown character ID"):
        tables.read_predictions(spark, str(tmp_path / "f.json")).collect()
    (tmp_path / "s.json").write_text(json.dumps([{"schemaKey": "a.b", "aliases": ["x"], "valueType": "STRING"}]))
    assert tables.read_schemas(spark, str(tmp_path / "s.json")).first()["schema_key"] == "a.b"
    with pytest.raises(ValueError):
        tables.inside("/root", "../x")


def test_keyed_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    tables.replace_by_key(rows, path, "k")
    tables.replace_by_key(spark.createDataFrame([(1, "z")], "k int, v string"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]
    tables.replace_by_key(spark.createDataFrame([(2, "y")], "k int, v string"), path, "k", keys=[1, 2, 9])
    assert [(r["k"], r["v"]) for r in spark.read.parquet(path).collect()] == [(2, "y")]
    tables.replace_by_key(rows.limit(0), path, "k", keys=[5])
    tables.delete_by_key(spark, path, "k", [7])
    assert spark.read.parquet(path).count() == 1
    table = spark.createDataFrame([(1, None), (2, "x")], "id int, e string")
    changes = spark.createDataFrame([(1, "y")], "id int, e string")
    assert sorted((r["id"], r["e"]) for r in tables.updated(table, changes, "id").collect()) == [(1, "y"), (2, "x")]
    for bad in ([(1, "y"), (1, "z")], [(9, "y")]):
        with pytest.raises(ValueError):
            tables.updated(table, spark.createDataFrame(bad, "id int, e string"), "id")
    with pytest.raises(LookupError):
        tables.get_or_raise(table, "id", 7)
    tables.append(table, str(tmp_path / "a"))
    tables.append(spark.createDataFrame([(0, "q"), (2, "a")], "id int, e string"), str(tmp_path / "a"))
    assert [r["e"] for r in tables.ordered_scan(spark.read.parquet(str(tmp_path / "a")), "id", 2, "e").collect()] == ["a", "x"]


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = ledger.per_window(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["window_start"], r["event_type"]): r["calls"] for r in spark.table("w").collect()}
    assert got == {(r["w"]["start"], r["event_type"]): r["count"] for r in events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().collect()}


def test_jobs_are_claimed_and_reported(spark, tmp_path):
    schema = "job_id string, status string, payload string"
    spark.createDataFrame([("a", "PENDING", "x"), ("b", "PENDING", "bad"), ("c", "DONE", "y")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def handle(rows):
        if rows.first()["payload"] == "bad":
            raise ValueError("e" * 2000)
        return rows.select("job_id", "payload", "model_name")

    q = ledger.work(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), handle, str(tmp_path / "out"), str(tmp_path / "reports"), str(tmp_path / "cp"), model="m", step="EXTRACT", interval="once")
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("job_id", "payload", "model_name").collect()] == [("a", "x", "m")]
    reports = {(r["job_id"], r["status"]): r for r in spark.read.parquet(str(tmp_path / "reports")).collect()}
    assert set(reports) == {("a", "RUNNING"), ("b", "RUNNING"), ("a", "COMPLETED"), ("b", "FAILED")} and reports["b", "FAILED"]["error_message"] == "e" * 1000 and reports["a", "RUNNING"]["current_step"] == "EXTRACT"


def annotation(i, episode=1, order=1.0, **fields):
    text = {"entityName": "Mira", "factKey": "rank", "attributeValue": "12", "valueJson": '{"value": 12}', "evidenceQuotes": " a \n\n b", "factKeyAliases": '[" lv "]'} | fields
    p = {tables.PROPERTIES[k]: {"type": "rich_text", "rich_text": [{"plain_text": v[:1]}, {"plain_text": v[1:]}]} for k, v in text.items() if v and k not in ("decision", "importance", "valueType")}
    p |= {tables.PROPERTIES[k]: {"type": "select", "select": {"name": text.get(k, d)}} for k, d in (("decision", "EXTRACT"), ("importance", "MUST"), ("valueType", "NUMBER"))}
    return json.dumps({"id": i, "properties": p | {tables.PROPERTIES["episode_no"]: {"type": "number", "number": episode}, tables.PROPERTIES["sort_order"]: {"type": "number", "number": order}}}, ensure_ascii=False)


def test_annotations_become_gold(spark, tmp_path):
    def parsed(*rows):
        path = tmp_path / f"p{len(list(tmp_path.iterdir()))}"
        path.write_text("\n".join(rows), encoding="utf-8")
        return tables.parse_annotations(spark.read.schema(tables.PAGES).json(str(path)))

    rows = parsed(annotation("p2", 2, 5), annotation("p1", 1, 2), annotation("p0", 1, 2, factKey="age", decision="DO_NOT_EXTRACT", valueJson=""), annotation("p3", 1, 1, note="n"))
    gold = {r["episodeNo"]: r for r in tables.gold_from_annotations(rows).collect()}
    assert [c["factKey"] for c in gold[1]["candidates"]] == ["rank", "age", "rank"] and gold[1]["sourceFile"] == "01화.txt" and gold[1]["candidates"][0]["note"] == "n"
    first = gold[2]["candidates"][0]
    assert (first["decision"], first["factKeyAliases"], first["evidenceQuotes"], json.loads(first["valueJson"])) == ("EXTRACT", ["lv"], ["a", "b"], {"value": 12})
    version = tables.snapshot_version(tables.gold_from_annotations(rows), "n")
    assert version.startswith("notion-") and len(version) == 19 and version == tables.snapshot_version(tables.gold_from_annotations(rows.repartition(3)), "n") != tables.snapshot_version(tables.gold_from_annotations(rows), "m")
    for bad, what in ((annotation("p", 1.5), "integral"), (annotation("p", factKeyAliases="{}"), "aliases"), (annotation("p", valueJson="[1]"), "valueJson"), (annotation("p", attributeValue="", valueJson=""), "lacks 정답 attributeValue, 정답 valueJson"), (annotation("p", entityName=""), "소속 캐릭터")):
        with pytest.raises(Exception, match=what):
            parsed(bad).collect()


def test_command_line_scores_files(spark, tmp_path):
    from inkwell import cli

    gold = {"datasetVersion": "v", "name": "n", "episodes": [{"episodeNo": 1, "sourceFile": "t/e.txt", "candidates": [{"decision": "EXTRACT", "importance": "MUST", "entityName": "A", "factKey": "k", "valueType": "NUMBER", "attributeValue": "1", "valueJson": {"v": 1}, "evidenceQuotes": ["A is one"]}]}]}
    given = {"episodes": [{"episodeNo": 1, "candidates": [{"entity_name": "a", "attribute_name": "K", "attribute_value": "1", "value_type": "NUMBER", "value_json": {"v": 1}, "evidence_spans": [{"quote": "A is one"}]}]}]}
    (tmp_path / "src" / "t").mkdir(parents=True)
    (tmp_path / "src" / "t" / "e.txt").write_text("Here A is one.")
    for name, x in (("gold.json", gold), ("p.json", given)):
        (tmp_path / name).write_text(json.dumps(x))
    at = lambda x: str(tmp_path / x)
    summary = cli.main(["evaluate", "--gold", at("gold.json"), "--predictions", at("p.json"), "--source-root", at("src"), "--output", at("o.json"), "--markdown", at("o.md")], spark)
    assert summary == json.loads((tmp_path / "o.json").read_text()) and summary["metrics"]["factF1"] == 1.0 and summary["metrics"]["evidenceLocatableRate"] == 1.0 and len(summary["counts"]) == 34 and len(summary["metrics"]) == 22
    assert "| Fact F1 | 100.00% |" in (tmp_path / "o.md").read_text() and "| EXTRACT 정답 | 1 |" in (tmp_path / "o.md").read_text()
