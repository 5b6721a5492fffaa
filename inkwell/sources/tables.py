"""Sources and sinks: texts, JSON datasets, keyed tables that are replaced or updated by key, and reports."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from hashlib import sha256
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import json_values as J
from inkwell.functions import text as T

GOLD = (
    "datasetVersion string, name string, episodes array<struct<episodeNo:int,sourceText:string,sourceFile:string,candidates:array<struct<decision:string,importance:string,"
    "entityName:string,factKey:string,acceptedFactKeyAliases:array<string>,factKeyAliases:array<string>,valueType:string,attributeValue:string,valueJson:string,evidenceQuotes:array<string>,note:string>>>>"
)
#: The fields of a prediction, each also in camel case.
PREDICTION = {
    "entity_name": "string", "attribute_name": "string", "attribute_value": "string", "value_type": "string", "value_json": "string", "evidence_spans": "array<struct<quote:string,start_offset:int,end_offset:int,startOffset:int,endOffset:int>>",
    "match_status": "string", "matched_character_id": "string", "matched_character_name": "string", "candidate_kind": "string",
}


def camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m[1].upper(), name)


_PREDICTION = ",".join(f"{x}:{t}" for c, t in PREDICTION.items() for x in dict.fromkeys((c, camel(c))))
PREDICTIONS = (
    f"episodes array<struct<episodeNo:int,candidates:array<struct<{_PREDICTION}>>>>, episodeNo int, candidates array<struct<{_PREDICTION}>>, summary struct<episodeNo:int>, "
    f"settingCandidates array<struct<{_PREDICTION}>>, knownCharacters array<struct<characterId:string,character_id:string,id:string,name:string>>"
)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local session may leave that unset."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="inkwell-"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a Hadoop path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which release() deletes."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def release() -> None:
    """Delete all scratch paths, as the end of the driver does; frames that still read them can't be used afterwards."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            store, at = _hadoop(spark, path)
            store.delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(release)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept as a table in the shared folder: a lost executor loses nothing, and Spark knows its size."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(file, text): the whole UTF-8 files under root, with their paths below it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(plain(F.input_file_name()), "^file:/+", "file:/")
    top = F.regexp_replace(plain(F.lit(whole)), "^file:/+", "file:/")
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.substring(name, F.length(top) + 2, F.lit(1 << 30)).alias("file"), F.col("value").alias("text"))


def get_or_raise(table: DataFrame, key: str, value) -> Row:
    row = table.filter(F.col(key) == F.lit(value)).limit(1).collect()
    if not row:
        raise LookupError(f"no row with {key} = {value!r}")
    return row[0]


def ordered_scan(table: DataFrame, key: str, value, order: str) -> DataFrame:
    return table.filter(F.col(key) == F.lit(value)).orderBy(order)


def delete_by_key(spark: SparkSession, path: str, key: str, values) -> None:
    """Delete all rows of the keys in values (those of a batch of jobs), which are partitions; other keys stay."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for value in values:
        store.delete(jvm.org.apache.hadoop.fs.Path(top, f"{key}={escaped(str(value))}"), True)


def replace_by_key(rows: DataFrame, path: str, key: str, keys=None) -> None:
    """Replace all rows of the keys that occur in rows, as partitions; other keys stay. Of `keys`, those of a batch of jobs, the ones
    without rows lose what they had. Each key's files change place together at commit; there is no transaction over several keys."""
    rows = settled(rows)  # they are looked at twice, and may read the table that they replace
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    if keys is not None:
        have = {str(r[0]) for r in rows.select(key).filter(F.col(key).isin(list(keys))).distinct().toLocalIterator()}
        delete_by_key(rows.sparkSession, path, key, [k for k in keys if str(k) not in have])


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the columns of changes for the keys that these name. A repeated or missing key is an error, and then nothing is changed."""
    repeated = changes.groupBy(key).count().filter("count > 1").select(key)
    missing = changes.join(table.select(key), key, "left_anti").select(key)
    wrong = [r[0] for r in repeated.unionByName(missing).limit(10).collect()]
    if wrong:
        raise ValueError(f"repeated or missing keys, among them {wrong}")
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*names).alias("new"))
    pick = {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c) if c in table.columns else F.lit(None)) for c in names}
    return table.join(new, key, "left").withColumns(pick).drop("new").select(*table.columns, *(c for c in names if c not in table.columns))


def stream_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of a single file."""
    store, at = _hadoop(spark, path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if store.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(path.rstrip("/").rpartition("/")[0])


def update_files(spark: SparkSession, path: str, changes: DataFrame, key: str) -> int:
    """updated() of the Parquet files under path, of which only those that hold a changed key are rewritten; how many these are.

    A repeated or missing key is an error before anything is written. The new files are written aside, with a journal that names them and
    the files that they replace; the journal's last name is the commit. Then they are moved in and the old files deleted, which
    finish_updates() does for a commit that was interrupted. Readers that list the files in between may see rows of both.
    """
    store, _ = _hadoop(spark, path)
    finish_updates(spark, path)
    changes = settled(changes)
    table = spark.read.parquet(path)
    if set(changes.columns) - set(table.columns):
        raise ValueError(f"columns that the table lacks: {sorted(set(changes.columns) - set(table.columns))}")
    located = table.select(F.col(key).alias("_k"), F.col("_metadata.file_path").alias("_file"))
    held = settled(changes.select(F.col(key).alias("_k")).join(located, "_k", "left"))
    wrong = [r[0] for r in held.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.count("_file").alias("m")).filter("n > 1 or m = 0").limit(10).collect()]
    if wrong:
        raise ValueError(f"repeated or missing keys, among them {wrong}")
    old = [r[0] for r in held.select("_file").distinct().collect()]
    if not old:
        return 0
    name = uuid.uuid4().hex
    aside = f"{path.rstrip('/')}/_update-{name}"
    own = spark.read.schema(table.schema).parquet(*old)
    updated(own, changes, key).select(*table.columns).coalesce(max(1, min(len(old), own.rdd.getNumPartitions()))).write.parquet(f"{aside}/rows")
    written = [s.getPath().toString() for s in store.listStatus(_hadoop(spark, f"{aside}/rows")[1]) if s.getPath().getName().startswith("part-")]
    out = store.create(_hadoop(spark, f"{aside}/journal.new")[1], True)
    out.write(bytearray(json.dumps({"new": written, "old": old}).encode()))
    out.close()
    store.rename(_hadoop(spark, f"{aside}/journal.new")[1], _hadoop(spark, f"{aside}/journal")[1])
    finish_updates(spark, path)
    return len(old)


def finish_updates(spark: SparkSession, path: str) -> None:
    """Carry out the committed updates of a folder, and drop what was never committed."""
    store, top = _hadoop(spark, path)
    for status in store.listStatus(top) if store.exists(top) else ():
        aside = status.getPath()
        if not aside.getName().startswith("_update-"):
            continue
        journal = _hadoop(spark, f"{aside.toString()}/journal")[1]
        if store.exists(journal):
            stream = store.open(journal)
            done = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            for new in done["new"]:
                at = _hadoop(spark, new)[1]
                if store.exists(at) and not store.rename(at, _hadoop(spark, f"{path.rstrip('/')}/{aside.getName()[1:]}-{at.getName()}")[1]):
                    raise OSError(f"{new} can't be moved in")
            for old in done["old"]:
                store.delete(_hadoop(spark, old)[1], False)
        store.delete(aside, True)


def inside(root: str, name: str) -> str:
    """The path of name under root; a name that leads out of it is an error."""
    path = PurePosixPath(name)
    if path.is_absolute() or ".." in path.parts:
        raise ValueError(f"{name!r} leads out of the source folder")
    return str(PurePosixPath(root) / path)


def read_gold(spark: SparkSession, path: str, texts: DataFrame | None = None) -> DataFrame:
    """(episode_no, source_text, ordinal, gold fields). A sourceFile is looked up in texts (file, text) by its whole path; a missing one is an error."""
    episodes = spark.read.schema(GOLD).json(path, multiLine=True).select(F.explode("episodes").alias("e")).select("e.*")
    if texts is not None:
        episodes = episodes.withColumn("file", F.regexp_replace("sourceFile", r"^(?:\./)+", "")).join(texts.select("file", F.col("text").alias("file_text")), "file", "left")
    else:
        episodes = episodes.withColumn("file_text", F.lit(None).cast("string"))
    text = F.coalesce("sourceText", "file_text")
    text = F.when(F.col("sourceFile").isNotNull() & text.isNull(), F.raise_error(F.concat(F.lit("missing source file "), F.col("sourceFile")))).otherwise(text)
    rows = episodes.select(F.col("episodeNo").cast("long").alias("episode_no"), text.alias("source_text"), F.posexplode("candidates").alias("ordinal", "c"))
    return rows.select(
        "episode_no", "source_text", F.col("ordinal").cast("long").alias("ordinal"), "c.decision", "c.importance", F.col("c.entityName").alias("entity_name"), F.col("c.factKey").alias("fact_key"),
        F.coalesce("c.acceptedFactKeyAliases", "c.factKeyAliases", F.array().cast("array<string>")).alias("aliases"), F.col("c.valueType").alias("value_type"), F.col("c.attributeValue").alias("attribute_value"),
        F.col("c.valueJson").alias("value_json"), F.coalesce("c.evidenceQuotes", F.array().cast("array<string>")).alias("quotes"),
    )


def read_predictions(spark: SparkSession, path) -> DataFrame:
    """(episode_no, ordinal, candidate fields, quotes, matched_name) from files that hold a bundle of episodes, a single episode, or the
    result of a debug run; an episode that comes twice is an error, and so is a MATCHED id that a debug run's characters lack."""
    raw = spark.read.schema(PREDICTIONS).json(path, multiLine=True)
    none = F.lit(None).cast("map<string,string>")
    names = F.map_from_entries(F.transform("knownCharacters", lambda c: F.struct(F.coalesce(c["characterId"], c["character_id"], c["id"]), c["name"])))
    debug = raw.filter("settingCandidates is not null").select(F.col("summary.episodeNo").alias("episodeNo"), F.col("settingCandidates").alias("candidates"), F.coalesce(names, F.create_map().cast("map<string,string>")).alias("names"))
    bundle = raw.select(F.explode("episodes").alias("e")).select("e.episodeNo", "e.candidates", none.alias("names"))
    single = raw.filter("episodes is null and settingCandidates is null and episodeNo is not null").select("episodeNo", "candidates", none.alias("names"))
    episodes = bundle.unionByName(single).unionByName(debug)
    twice = [r[0] for r in episodes.groupBy("episodeNo").count().filter("count > 1").limit(10).collect()]
    if twice:
        raise ValueError(f"episodes that come twice: {twice}")
    rows = episodes.select(F.col("episodeNo").cast("long").alias("episode_no"), F.posexplode("candidates").alias("ordinal", "c"), "names").select("episode_no", F.col("ordinal").cast("long").alias("ordinal"), "c.*", "names")
    rows = rows.withColumns({c: F.coalesce(c, camel(c)) if camel(c) != c else F.col(c) for c in PREDICTION})
    named = F.when(F.col("names").isNull(), F.col("matched_character_name")).when(F.col("match_status") == "MATCHED", F.coalesce(F.col("names")[F.col("matched_character_id")], F.raise_error(F.concat(F.lit("unknown character ID "), F.coalesce("matched_character_id", F.lit("(none)"))))))
    return rows.select("episode_no", "ordinal", *(c for c in PREDICTION if c != "matched_character_name"), F.transform("evidence_spans", lambda s: s["quote"]).alias("quotes"), named.alias("matched_name"))


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(schema_key, aliases, value_type) from a list, or from an object that holds the list under schemas; an empty one is an error."""
    fields = "schemaKey:string,displayName:string,attributePattern:string,aliases:array<string>,valueType:string"
    raw = spark.read.schema(f"schemas array<struct<{fields}>>, {fields.replace(':string', ' string').replace(':array', ' array')}").json(path, multiLine=True)
    rows = raw.select(F.explode(F.coalesce("schemas", F.array(F.struct("schemaKey", "displayName", "attributePattern", "aliases", "valueType")))).alias("s")).select("s.*").filter("schemaKey is not null")
    if rows.isEmpty():
        raise ValueError("there are no schemas")
    return rows.select(F.col("schemaKey").alias("schema_key"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.col("valueType").alias("value_type"))


def attach_names(rows: DataFrame, known: DataFrame) -> DataFrame:
    """matched_name of rows by matched_character_id; an id that known (id, name) lacks is an error."""
    named = known.select(F.col("id").alias("matched_character_id"), F.col("name").alias("matched_name"))
    missing = rows.filter("matched_character_id is not null").join(named, "matched_character_id", "left_anti").select("matched_character_id").limit(10).collect()
    if missing:
        raise ValueError(f"unknown characters: {[r[0] for r in missing]}")
    return rows.join(named, "matched_character_id", "left")


#: The annotation's property of each gold field.
PROPERTIES = {
    "row_id": "정답 ID", "episode_no": "회차", "sort_order": "정렬 순서", "decision": "판정", "importance": "중요도", "entityName": "소속 캐릭터", "factKey": "canonical factKey", "factKeyAliases": "추가 허용 factKey 별칭",
    "valueType": "valueType", "attributeValue": "정답 attributeValue", "valueJson": "정답 valueJson", "evidenceQuotes": "원문 근거", "note": "비고(판정 사유·검수 메모)",
}
PAGES = "id string, properties map<string,struct<type:string,title:array<struct<plain_text:string>>,rich_text:array<struct<plain_text:string>>,select:struct<name:string>,number:double>>"
#: Fields that an EXTRACT row needs.
REQUIRED = ("importance", "factKey", "valueType", "attributeValue", "valueJson", "evidenceQuotes")


def parse_annotations(pages: DataFrame) -> DataFrame:
    """(page_id, episode_no, sort_order, decision, importance, entityName, ...) of annotation pages read with the schema PAGES.

    Texts are joined and stripped, aliases are a JSON list of texts, valueJson is a JSON object, each line of the evidence that
    isn't blank is a quote. A row that breaks these rules, or an EXTRACT row that lacks a field, is an error that names its fields only.
    """
    at = lambda f: F.col("properties")[F.lit(PROPERTIES[f])]

    def text(f: str) -> Column:
        parts = F.when(at(f)["type"] == "title", at(f)["title"]).when(at(f)["type"] == "rich_text", at(f)["rich_text"])
        return F.nullif(T.strip(F.coalesce(F.array_join(F.transform(parts, lambda x: F.coalesce(x["plain_text"], F.lit(""))), ""), F.lit(""))), F.lit(""))

    wrong = lambda what: F.raise_error(F.concat(F.lit(f"annotation: {what}in row "), F.col("row_id")))
    integral = lambda f: F.when(at(f)["number"] == F.floor(at(f)["number"]), at(f)["number"].cast("long")).otherwise(wrong(f"{PROPERTIES[f]} must be an integral number ").cast("long"))
    select = lambda f: F.nullif(T.strip(F.coalesce(at(f)["select"]["name"], F.lit(""))), F.lit(""))
    rows = pages.withColumn("row_id", F.coalesce(text("row_id"), "id", F.lit("unknown"))).select("properties", "row_id", F.col("id").alias("page_id"), *(text(f).alias(f"_{f}") for f in ("factKeyAliases", "valueJson", "evidenceQuotes", "entityName", "factKey", "attributeValue", "note")))
    aliases = F.from_json("_factKeyAliases", "array<string>", {"mode": "PERMISSIVE"})
    listed = F.col("_factKeyAliases").startswith("[") & aliases.isNotNull() & F.forall(aliases, lambda x: x.isNotNull() & x.rlike(T.SOLID))
    value = F.when(F.col("_valueJson").isNull() | (F.col("_valueJson").startswith("{") & F.try_parse_json("_valueJson").isNotNull()), F.col("_valueJson")).otherwise(wrong("valueJson must be a JSON object "))
    quotes = F.filter(F.transform(F.regexp_extract_all("_evidenceQuotes", F.lit(T.LINE), F.lit(0)), T.strip), lambda x: x != "")
    rows = rows.select(
        "page_id", "row_id", integral("episode_no").alias("episode_no"), integral("sort_order").alias("sort_order"), select("decision").alias("decision"), select("importance").alias("importance"),
        F.coalesce("_entityName", wrong(f"{PROPERTIES['entityName']} is needed ")).alias("entityName"), F.col("_factKey").alias("factKey"),
        F.when(F.col("_factKeyAliases").isNull(), F.array().cast("array<string>")).when(F.coalesce(listed, F.lit(False)), F.transform(aliases, T.strip)).otherwise(wrong("aliases must be a JSON list of texts ").cast("array<string>")).alias("factKeyAliases"),
        select("valueType").alias("valueType"), F.col("_attributeValue").alias("attributeValue"), value.alias("valueJson"), F.coalesce(quotes, F.array().cast("array<string>")).alias("evidenceQuotes"), F.col("_note").alias("note"),
    )
    lacks = F.concat(*(F.when((F.size(c) == 0) if c == "evidenceQuotes" else F.col(c).isNull(), F.lit(PROPERTIES[c] + ", ")).otherwise(F.lit("")) for c in REQUIRED))
    checked = F.when((F.col("decision") == "EXTRACT") & (lacks != ""), F.raise_error(F.concat(F.lit("annotation row "), F.col("row_id"), F.lit(" lacks "), lacks))).otherwise(F.col("decision"))
    return rows.withColumn("decision", checked).drop("row_id")


def gold_from_annotations(rows: DataFrame, source_pattern: str = "%02d화.txt") -> DataFrame:
    """(episodeNo, sourceFile, candidates): annotation rows grouped by episode, ordered by sort_order and page_id. An episode's rows are one annotator's work."""
    own = [c for c in rows.columns if c not in ("episode_no", "sort_order", "page_id")]
    item = F.struct(F.coalesce("sort_order", F.lit(2**31 - 1)).alias("sort_order"), F.col("page_id"), F.struct(*own).alias("row"))
    grouped = rows.groupBy(F.col("episode_no").alias("episodeNo")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["row"]).alias("candidates"))
    return grouped.select("episodeNo", F.format_string(source_pattern, "episodeNo").alias("sourceFile"), "candidates")


#: Fixed value: the name under which a version has a field that isn't its own in snake case.
VERSIONED = {"factKeyAliases": "accepted_fact_key_aliases"}


def snapshot_version(episodes: DataFrame, name: str) -> str:
    """Version of a dataset: the digest of its canonical JSON, keys sorted, without blanks, candidates in snake case and without nulls. The same rows give the same version, whatever their order.

    The episodes' JSON is made by the executors and streamed through one digest on the driver, in the order of episodeNo.
    """
    bare = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    fields = [f.name for f in episodes.schema["candidates"].dataType.elementType.fields]
    snake = lambda f: VERSIONED.get(f, re.sub("[A-Z]", lambda m: "_" + m[0].lower(), f))

    def one(c: Column) -> Column:
        # a text that is JSON itself goes in as it is
        pieces = [F.when(c[f].isNotNull(), F.concat(F.lit(json.dumps(snake(f)) + ":"), c[f] if f == "valueJson" else bare(c[f]))) for f in fields]
        return F.concat(F.lit("{"), F.array_join(F.array(*pieces), ","), F.lit("}"))

    text = F.concat(F.lit('{"candidates":['), F.array_join(F.transform("candidates", one), ","), F.lit('],"episodeNo":'), F.col("episodeNo").cast("string"), F.lit(',"sourceFile":'), bare(F.col("sourceFile")), F.lit(',"title":null}'))
    digest = sha256(b'{"episodes":[')
    for i, row in enumerate(episodes.select("episodeNo", J.canonical_json(text).alias("t")).orderBy("episodeNo").toLocalIterator()):
        digest.update((b"," if i else b"") + row["t"].encode())
    digest.update(b'],"name":' + json.dumps(name, ensure_ascii=False).encode() + b"}")
    return f"notion-{digest.hexdigest()[:12]}"


def write_report(counts: DataFrame, path: str) -> None:
    counts.coalesce(1).write.mode("overwrite").json(path)


def machine_summary(counts: Row, metrics: Row, run: dict, dataset: dict) -> dict:
    """Run, dataset, metrics and counts of a report, without anything that is derived from a source text."""
    return {"run": run, "dataset": dataset, "metrics": {k: v for k, v in metrics.asDict().items() if k != "episode_no"}, "counts": {k: v for k, v in counts.asDict().items() if k != "episode_no"}}


#: The metrics and counts of a Markdown report, with their labels.
SHOWN_METRICS = {
    "detectionPrecision": "Detection Precision", "detectionRecall": "Detection Recall", "detectionF1": "Detection F1", "factPrecision": "Fact Precision", "factRecall": "Fact Recall", "factF1": "Fact F1",
    "weightedDetectionRecall": "중요도 가중 Detection Recall", "weightedFactRecall": "중요도 가중 Fact Recall", "valueTypeAccuracy": "valueType Accuracy", "attributeValueAccuracy": "attributeValue Accuracy",
    "structuredValueAccuracy": "structuredValue Accuracy", "evidenceLocatableRate": "원문에서 찾을 수 있는 근거 비율", "goldEvidenceCoverageRate": "정답 근거 범위 포괄 비율", "hardNegativeViolationRate": "DO_NOT_EXTRACT 위반율",
    "duplicatePredictionRate": "중복 예측 비율", "unknownSubjectPredictionRate": "미상 주체 예측 비율", "subjectOnlyFailureRate": "주체 해소만 실패한 비율",
}
SHOWN_COUNTS = {
    "goldExtract": "EXTRACT 정답", "predictions": "채점 대상 예측", "detectionMatches": "Detection 매칭", "factCorrect": "Fact 정답", "semanticPending": "의미 판정 대기", "reviewExcludedPredictions": "REVIEW 제외 예측",
    "characterDiscoveryExcluded": "캐릭터 발견 후보 제외", "judgeInputTokens": "LLM Judge 입력 토큰", "judgeCachedInputTokens": "LLM Judge 캐시 입력 토큰", "judgeOutputTokens": "LLM Judge 출력 토큰",
}


def markdown(summary: dict) -> str:
    """A machine_summary() as a page: what was run on what, its metrics and its counts."""
    run, dataset, metrics, counts = (summary.get(k) or {} for k in ("run", "dataset", "metrics", "counts"))
    judge = run.get("semanticJudgeModel", "-") if run.get("semanticJudgeEnabled") else "사용 안 함"

    def shown(v) -> str:
        if isinstance(v, bool):
            return "완료" if v else "미완료"
        return "판정 대기/대상 없음" if v is None else f"{v:.2%}" if isinstance(v, (int, float)) else str(v)

    head = {"데이터셋": f"`{dataset.get('name', '-')}`", "스냅샷 버전": f"`{dataset.get('version', '-')}`", "평가 회차": f"`{dataset.get('episodeCount', 0)}`개", "분석 모델": f"`{run.get('analysisModel') or '-'}`", "의미 판정 모델": f"`{judge}`"}
    table = lambda title, names, rows: ["", f"## {title}", "", f"| {names} |", "| --- | ---: |", *(f"| {a} | {b} |" for a, b in rows)]
    lines = ["# 설정 추출 평가 결과", "", *(f"- {k}: {v}" for k, v in head.items())]
    lines += table("핵심 지표", "지표 | 결과", [(label, shown(metrics.get(m))) for m, label in SHOWN_METRICS.items()])
    lines += table("평가 개수", "구분 | 개수", [(label, counts.get(c, 0)) for c, label in SHOWN_COUNTS.items()])
    return "\n".join([*lines, ""])


def known_characters(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) where the id may be spelt in three ways."""
    raw = spark.read.schema("characterId string, character_id string, id string, name string").json(path, multiLine=True)
    return raw.select(F.coalesce("characterId", "character_id", "id").alias("id"), "name")
