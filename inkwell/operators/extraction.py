"""Extraction by an injected model: prompts, lenient parsing, retries, and filling in subjects."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators import names

CANDIDATE = (
    "array<struct<candidate_kind:string,entity_name:string,raw_entity_mention:string,attribute_name:string,attribute_value:string,value_type:string,value_json:string,"
    "confidence:double,quotes:array<string>>>"
)
FIELDS = ("candidate_kind", "entity_name", "raw_entity_mention", "attribute_name", "attribute_value", "value_type", "value_json", "confidence", "quotes")


def hints_text(hints: list[dict]) -> str:
    """Schema hints in canonical order, aliases sorted: equal hints give an equal text."""
    rows = [{**h, "aliases": sorted(h.get("aliases") or [])} for h in hints]
    rows.sort(key=lambda h: tuple(json.dumps(h.get(k), ensure_ascii=False) for k in ("schemaKey", "displayName", "attributePattern", "valueType", "aliases", "description")))
    return json.dumps(rows, ensure_ascii=False, indent=2)


def cache_key(static_prompt: str) -> str:
    return "setting-extraction:v3:" + hashlib.sha256(static_prompt.encode()).hexdigest()[:16]


def loads_object(answer: str) -> dict:
    """The JSON object in an answer; ValueError where there is none."""
    bare = answer.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    try:
        found = json.loads(bare)
    except ValueError:
        found = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
    if not isinstance(found, dict):
        raise ValueError("the answer is no JSON object")
    return found


def valid(c: dict) -> bool:
    """A name of 1 to 100 characters, a confidence of 0 to 1 or none, a quote; settings have attribute, type and JSON, discoveries none of the value fields."""
    name, confidence = (c.get("entity_name") or "").strip(), c.get("confidence")
    if not 1 <= len(name) <= 100 or len(c.get("raw_entity_mention") or "") > 100 or not c.get("quotes") or not all(c["quotes"]):
        return False
    if confidence is not None and not 0 <= confidence <= 1:
        return False
    values = [c.get(k) for k in ("attribute_name", "attribute_value", "value_type", "value_json")]
    return all(x is None for x in values) if c.get("candidate_kind") == "CHARACTER_DISCOVERY" else all(values[k] is not None for k in (0, 2, 3))


def names_text(known: list[str]) -> str:
    """Known names, each once and in order."""
    return json.dumps(sorted({n.strip() for n in known if n and n.strip()}), ensure_ascii=False)


def prompt(head: str, known: list[str], episode_no: int | None, episode_title: str | None, text: str) -> str:
    """What is the same for most chunks stands first, so that a provider can keep it: rules and schemas, known names, the episode, the text."""
    metadata = json.dumps({"episode_no": episode_no, "episode_title": episode_title}, ensure_ascii=False, sort_keys=True)
    return f"{head}\nknown_character_names:\n{names_text(known)}\n\nmetadata:\n{metadata}\n\nchunk_text:\n{text}"


def with_known_names(chunks: DataFrame, known: DataFrame, work: str = "work_id", name: str = "name") -> DataFrame:
    """chunks with known_names, the names of their work in known (work, name): the few characters of a work, an empty list without any."""
    own = known.groupBy(F.col(work).alias("_ink_work")).agg(F.sort_array(F.collect_set(name)).alias("known_names"))
    met = chunks.join(own, chunks[work].eqNullSafe(F.col("_ink_work")), "left").drop("_ink_work")
    return met.withColumn("known_names", F.coalesce("known_names", F.array().cast("array<string>")))


def extract(chunks: DataFrame, provider: Callable[[str], str], static_prompt: str, hints: list[dict], attempts: int = 3, id_col: str = "chunk_id", text_col: str = "chunk_text") -> DataFrame:
    """(source_chunk_id, ordinal, candidate fields): each chunk goes to the provider; answers that are no valid JSON are asked for again, provider errors end the job. The chunk id is always the row's own.

    Where chunks have them, known_names (an array, see with_known_names()), episode_no and episode_title are in the prompt.
    """
    if not hints:
        raise ValueError("hints are needed")
    head = static_prompt + "\n" + hints_text(hints) + "\n"

    def ask(asked: str) -> list[dict]:
        for left in reversed(range(attempts)):
            # a provider that keeps its answers is told which attempt it is
            answer = provider.ask(asked, attempts - 1 - left) if hasattr(provider, "ask") else provider(asked)
            try:
                found = loads_object(answer).get("candidates", [])
                if not all(isinstance(c, dict) and valid(c) for c in found):
                    raise ValueError("a candidate breaks its contract")
                return found
            except ValueError:
                if not left:
                    raise
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [[{k: (json.dumps(c.get(k), ensure_ascii=False) if k == "value_json" and c.get(k) is not None else c.get(k)) for k in FIELDS} for c in ask(prompt(head, list(k), None if pd.isna(n) else int(n), h, t))] for t, k, n, h in zip(frame["t"], frame["k"], frame["n"], frame["h"], strict=True)]
            yield pd.DataFrame({"i": frame["i"], "candidates": out})

    given = lambda c, kind: (F.col(c) if c in chunks.columns else F.lit(None)).cast(kind)
    source = chunks.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.coalesce(given("known_names", "array<string>"), F.array().cast("array<string>")).alias("k"), given("episode_no", "long").alias("n"), given("episode_title", "string").alias("h"))
    rows = source.mapInPandas(run, f"i string, candidates {CANDIDATE}")
    return rows.select(F.col("i").alias("source_chunk_id"), F.posexplode("candidates").alias("ordinal", "c")).select("source_chunk_id", "ordinal", "c.*").withColumn("entity_name", F.trim("entity_name"))


def needs_subject(kind: Column, entity_name: Column) -> Column:
    """Settings whose subject is no concrete name."""
    return (kind == "SETTING") & ~names.is_concrete(names.normalize(entity_name))


def fill_subjects(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Subjects from answers (source_chunk_id, ordinal, subject) for the rows that need one; an unusable answer gives the unknown name. The answers must cover exactly those rows."""
    keys = ["source_chunk_id", "ordinal"]
    wanted = candidates.filter(needs_subject(F.col("candidate_kind"), F.col("entity_name"))).select(*keys)
    wrong = wanted.join(answers, keys, "left_anti").select(*keys).unionByName(answers.join(wanted, keys, "left_anti").select(*keys)).unionByName(answers.groupBy(*keys).count().filter("count > 1").select(*keys))
    if not wrong.isEmpty():
        raise ValueError("the answers don't match the questions")
    usable = F.when(names.is_usable(names.normalize(F.col("subject"))), F.trim("subject")).otherwise(F.lit(names.UNKNOWN))
    met = candidates.join(answers.select(*keys, usable.alias("s")), keys, "left")
    return met.withColumn("entity_name", F.coalesce("s", "entity_name")).select(*candidates.columns)


def subject_counts(candidates: DataFrame, filled: DataFrame) -> DataFrame:
    """(calls, resolved, unresolved) of each chunk that needed subjects: one call a chunk; filled is fill_subjects() of candidates."""
    keys = ["source_chunk_id", "ordinal"]
    asked = candidates.filter(needs_subject(F.col("candidate_kind"), F.col("entity_name"))).select(*keys).join(filled.select(*keys, "entity_name"), keys)
    unknown = F.count(F.when(F.col("entity_name") == names.UNKNOWN, 1))
    return asked.groupBy("source_chunk_id").agg(F.lit(1).cast("long").alias("calls"), (F.count(F.lit(1)) - unknown).alias("resolved"), unknown.alias("unresolved"))


def ask_subjects(candidates: DataFrame, chunks: DataFrame, provider: Callable[[str], str], static_prompt: str, known: list[str] = ()) -> DataFrame:
    """(source_chunk_id, ordinal, subject): one call for each chunk with candidates that need a subject.

    chunks: chunk_id, chunk_text, previous_text, next_text. The static part of the prompt comes first. The answer names each
    asked candidate once, as {"resolutions": [{"candidateId": ..., "resolvedEntityName": ...}]}.
    """
    head = static_prompt + "\n" + json.dumps({"knownCharacters": sorted(known)}, ensure_ascii=False) + "\n"

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal", ignore_index=True)
        first = frame.iloc[0]
        question = {"previous": first["previous_text"], "current": first["chunk_text"], "next": first["next_text"], "candidates": [{"candidateId": f"candidate-{r['ordinal']}", "entityName": r["entity_name"], "rawEntityMention": r["raw_entity_mention"], "attributeName": r["attribute_name"], "attributeValue": r["attribute_value"]} for _, r in frame.iterrows()]}
        found = loads_object(provider(head + json.dumps(question, ensure_ascii=False)))["resolutions"]
        said = {x["candidateId"]: x.get("resolvedEntityName") for x in found}
        wanted = [f"candidate-{o}" for o in frame["ordinal"]]
        if len(said) != len(found) or sorted(said) != sorted(wanted):
            raise ValueError("the answers don't match the questions")
        return frame[["source_chunk_id", "ordinal"]].assign(subject=[said[c] for c in wanted])

    wanted = candidates.filter(needs_subject(F.col("candidate_kind"), F.col("entity_name")))
    asked = wanted.join(chunks.select(F.col("chunk_id").alias("source_chunk_id"), "chunk_text", "previous_text", "next_text"), "source_chunk_id")
    asked = asked.select("source_chunk_id", "ordinal", "entity_name", "raw_entity_mention", "attribute_name", "attribute_value", "chunk_text", "previous_text", "next_text")
    return asked.groupBy("source_chunk_id").applyInPandas(ask, "source_chunk_id string, ordinal int, subject string")


def job_summary(chunks: DataFrame, candidates: DataFrame, subjects: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, summary_json): the counters of each job. chunks: job, episode_id, embedding and embedding_status (null where it wasn't tried); candidates: the saved ones."""
    when = lambda c: F.count(F.when(c, 1))
    own = chunks.groupBy(job).agg(F.countDistinct("episode_id").alias("episodeCount"), F.count(F.lit(1)).alias("chunkCount"), when(F.col("embedding").isNotNull()).alias("embeddedChunkCount"), when(F.col("embedding").isNull() & F.col("embedding_status").isNotNull()).alias("embeddingFailedChunkCount"), when(F.col("embedding").isNull() & F.col("embedding_status").isNull()).alias("embeddingSkippedChunkCount"))
    saved = candidates.groupBy(job).agg(F.count(F.lit(1)).alias("candidateCount"))
    asked = subjects.groupBy(job).agg(*(F.sum(c).alias(f"subjectFallback{n}Count") for c, n in (("calls", "Call"), ("resolved", "Resolved"), ("unresolved", "Unresolved"))))
    met = own.join(saved, job, "left").join(asked, job, "left").na.fill(0)
    return met.select(job, F.to_json(F.struct(*(c for c in met.columns if c != job))).alias("summary_json"))
