"""Registered queries of the engine's own operators, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import json_values as J
from inkwell.functions import text as T
from inkwell.operators import ann, chunking, dedup, evaluation, evidence, metering, names, vector
from inkwell.sources import tables
from inkwell.streaming import reservations

#: Fixed query vector of 64 numbers.
Q = [((k * 37 % 64) - 32) / 32 for k in range(64)]
_Q = "[" + ", ".join(str(x) for x in Q) + "]::DOUBLE[]"


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark, sf):
    """embeddings with the columns that chunks have: work, episode, model and version follow from vec_id."""
    return _t(spark, sf, "embeddings").select("vec_id", F.col("label").alias("work_id"), (F.col("vec_id") % 50).alias("episode_no"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 11 == 0, "v0").otherwise("v1").alias("version"))


def vector_topk(spark, sf):
    out = vector.top_k(_t(spark, sf, "embeddings"), Q, 10)
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


def vector_topk_filtered(spark, sf):
    rows = _chunks(spark, sf)
    out = vector.top_k(rows, Q, 20, where=(F.col("work_id") < 6) & (F.col("version") == "v1"), episode_range=(5, 40), exclude=rows.filter("vec_id % 13 = 0"))
    return out.select("vec_id", "episode_no", F.round("similarity", 6).alias("similarity"))


def vector_index_search(spark, sf):
    """vector_topk_filtered by an index with all its cells probed, where it is exact."""
    path = tables.scratch(spark, "index")
    ann.build(_chunks(spark, sf), path)
    exclude = _chunks(spark, sf).filter("vec_id % 13 = 0")
    out = ann.search(spark, path, Q, 20, nprobe=ann.CELLS + 1, where=(F.col("work_id") < 6) & (F.col("version") == "v1"), episode_range=(5, 40), exclude=exclude)
    return out.select("vec_id", "episode_no", F.round("similarity", 6).alias("similarity"))


def paragraph_split(spark, sf):
    return chunking.split_paragraphs(_t(spark, sf, "documents").select("doc_id", "text"))


def long_paragraph_split(spark, sf):
    rows = chunking.split_long(chunking.split_paragraphs(_t(spark, sf, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "paragraph_index", "start_offset", "end_offset", "paragraph_text")


def chunk_pack(spark, sf):
    return chunking.chunks(_t(spark, sf, "documents").select("doc_id", "text")).drop("chunk_id")


def adjacent_context(spark, sf):
    return chunking.with_context(_t(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "previous_text", "text", "next_text")


def _third_lines(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "text", F.get(F.split("text", "\n"), 2).alias("quote"))


def _quotes(spark, sf):
    """Each document with its own third line as a quote, and with that of the next document, which is mostly not found."""
    own = _third_lines(spark, sf)
    other = own.select(F.col("doc_id").alias("of"), "quote").withColumn("doc_id", F.col("of") - 1)
    return own.withColumn("of", F.col("doc_id")).unionByName(own.drop("quote").join(other, "doc_id"))


def evidence_locate(spark, sf):
    at = evidence.locate(F.col("text"), F.col("quote"))
    return _quotes(spark, sf).select("doc_id", "of", at["start"].alias("start_offset"), at["end"].alias("end_offset"), evidence.verified(F.col("text"), F.col("quote"), at["start"], at["end"]).alias("verified"))


def evidence_locate_ws(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    quotes = _quotes(spark, sf).select("doc_id", "of", F.regexp_replace("quote", " ", "\n\t").alias("quote"))
    return evidence.locate_quotes(docs, quotes, "doc_id").select("doc_id", "of", F.col("at.start").alias("start_offset"), F.col("at.end").alias("end_offset"))


def source_excerpt(spark, sf):
    return _quotes(spark, sf).select("doc_id", "of", evidence.excerpt(F.col("text"), F.array("quote")).alias("excerpt"))


def name_exact(spark, sf):
    """Nation names in brackets, quotes and other case; every second one is looked for in the work of the next region."""
    nation = _t(spark, sf, "nation")
    known = names.known(nation, "n_nationkey", "n_name", "n_regionkey")
    shown = F.concat(F.lit(" 《'"), F.lower("n_name"), F.lit("'》\t"))
    rows = nation.select(F.col("n_nationkey").alias("row_id"), ((F.col("n_regionkey") + F.col("n_nationkey") % 2) % 5).cast("string").alias("work"), names.normalize(shown).alias("n"))
    return names._exact(rows, "n", known, "ids").select("row_id", F.explode("ids").alias("known_id"))


def _mentions(spark, sf):
    """Parts that mention a part name, its first word, a brand or nothing, against all distinct part names."""
    part = _t(spark, sf, "part")
    known = names.known(part.groupBy("p_name").agg(F.min("p_partkey").alias("id")), "id", "p_name")
    word = F.element_at(F.split("p_name", " "), 1)
    entity = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise(word)
    raw = F.when(F.col("p_size") % 4 == 0, F.col("p_type")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("the "), F.col("p_name"), F.lit(" itself"))).when(F.col("p_size") % 4 == 2, F.concat(F.col("p_brand"), F.lit(" of "), word))
    return part.select(F.col("p_partkey").alias("row_id"), entity.alias("entity_name"), raw.alias("raw_mention")), known


def name_containment(spark, sf):
    rows, known = _mentions(spark, sf)
    met = names.contained(rows.select("row_id", F.lit("").alias("work"), names.normalize(F.col("entity_name")).alias("n0")), "n0", known, "ids")
    return met.select("row_id", F.array_join("ids", ",").alias("ids"))


def name_resolution(spark, sf):
    rows, known = _mentions(spark, sf)
    return names.resolve(rows, known)


def schema_key_canonical(spark, sf):
    """Customers' keys by the regions as schemas: the key itself, an alias bare and behind the namespace, one letter that several regions share, and neither."""
    region, nation = _t(spark, sf, "region"), _t(spark, sf, "nation")
    schemas = region.select(F.concat(F.lit("place."), F.lower("r_name")).alias("schema_key"), F.array("r_name", F.substring("r_name", 1, 2), F.substring("r_name", 1, 1)).alias("aliases"))
    rows = _t(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    k, two = F.col("c_custkey") % 5, F.substring("r_name", 1, 2)
    shown = F.when(k == 0, F.concat(F.lit(" place."), F.lower("r_name"))).when(k == 1, F.col("r_name")).when(k == 2, F.concat(F.lit("place."), two)).when(k == 3, F.substring("r_name", 1, 1)).otherwise(F.col("n_name"))
    return names.canonical_keys(rows.select("c_custkey", shown.alias("attribute_name")), schemas).select("c_custkey", "canonical_key")


def _discoveries(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.lower(F.element_at(F.split("text", " "), 1)).alias("name"), F.when(F.col("turn") % 3 == 0, "MATCHED").otherwise("UNRESOLVED").alias("match_status"))


def discovery_dedup(spark, sf):
    return dedup.first_discoveries(_discoveries(spark, sf), ["conv_id"], "name")


def _settings(spark, sf):
    return _t(spark, sf, "events").select(F.col("event_id").alias("ordinal"), (F.col("user_id") % 10).alias("job"), F.when(F.col("event_id") % 17 != 0, F.concat_ws("|", "event_type", (F.col("user_id") % 50).cast("string"))).alias("key"), F.when(F.col("event_id") % 5 != 0, F.round("value", 1)).alias("confidence"))


def setting_dedup(spark, sf):
    return dedup.best_settings(_settings(spark, sf), ["job"], "key")


def duplicate_rows(spark, sf):
    return dedup.repeated(_settings(spark, sf), ["job"], "key")


def gold_ids(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), (F.col("doc_id") % 10).alias("episode_no"), "lang", "source")
    return dedup.occurrence_ids(rows, "episode_no", F.lower("lang"), F.col("source")).select("doc_id", "gold_id")


def _counts(spark, sf):
    """Labels as gold decisions against a rule; episodes are the sources."""
    d, l = _t(spark, sf, "documents").select("doc_id", "source", "n_chars"), _t(spark, sf, "labels")
    rows = d.join(l, "doc_id").withColumn("predicted", F.col("n_chars") > 400)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    good, w = F.col("quality") == 1, F.when(F.col("doc_id") % 3 == 0, 3).when(F.col("doc_id") % 3 == 1, 2).otherwise(1)
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    own = {"goldExtract": n(good), "predictions": n(F.col("predicted")), "predictionTotal": F.count(F.lit(1)), "detectionMatches": n(good & F.col("predicted")), "factCorrect": n(good & F.col("predicted") & (F.col("toxic") == 0)), "goldDoNotExtractScored": n(~good), "hardNegativeViolations": n(~good & F.col("predicted")), "weightedGold": total(good), "weightedDetectionMatches": total(good & F.col("predicted")), "weightedFactCorrect": total(good & F.col("predicted") & (F.col("toxic") == 0))}
    return rows.rollup("source").agg(*(e.cast("long").alias(c) for c, e in own.items())).withColumn("source", F.coalesce("source", F.lit("*")))


def eval_counts(spark, sf):
    return _counts(spark, sf)


def eval_metrics(spark, sf):
    out = evaluation.metrics(eval_counts(spark, sf))
    return out.select("source", "detectionPrecision", "detectionRecall", "detectionF1", "factPrecision", "factRecall", "factF1", "weightedDetectionRecall", "weightedFactRecall", "hardNegativeViolationRate")


def _pairs(spark, sf):
    """Gold and predicted rows of an episode that share a key."""
    p = _t(spark, sf, "part")
    gold = p.filter("p_partkey % 2 = 0").select((F.col("p_partkey") % 40).alias("episode_no"), F.col("p_partkey").alias("ordinal"), F.element_at(F.split("p_name", " "), 1).alias("name"), F.col("p_brand").alias("fact_key"), F.array(F.col("p_type")).alias("accepted_keys"))
    pred = p.filter("p_partkey % 2 = 1").select(((F.col("p_partkey") + 1) % 40).alias("episode_no"), F.col("p_partkey").alias("ordinal"), F.element_at(F.split("p_name", " "), 1).alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("key"))
    return gold, pred, evaluation.identity_pairs(gold, pred, dealt=8)


def identity_join(spark, sf):
    return _pairs(spark, sf)[2].drop("name")


def assignment(spark, sf):
    """The weight that each episode's best assignment has, which is the same whatever pairs of equal weight it takes."""
    gold, pred, _ = _pairs(spark, sf)
    gold = tables.settled(evaluation.with_kinds(gold, ("name", "fact_key", "accepted_keys")))
    pred = tables.settled(evaluation.with_kinds(pred, ("name", "key")))
    pairs = evaluation.identity_pairs(gold.filter("kind_place = 0"), pred.filter("kind_place = 0"))
    taken = evaluation.assign_kinds(gold, pred, pairs)
    return taken.groupBy("episode_no").agg(F.count(F.lit(1)).alias("pairs"), F.sum("weight").cast("long").alias("weight"))


def _gold(spark, sf):
    """Parts as gold rows and as predictions that differ from them in name, key, type, value or evidence; every part has a key of its own."""
    p = _t(spark, sf, "part").withColumns({"u": F.col("p_size"), "word": F.element_at(F.split("p_name", " "), 1), "id": F.col("p_partkey").cast("string")})
    u, number = F.col("u"), F.col("u") % 2 == 0
    value = lambda c: F.concat(F.lit('{"value": "'), c.cast("string"), F.lit('"}'))
    gold = p.select(
        (u % 10).cast("long").alias("episode_no"), F.col("p_partkey").alias("ordinal"), F.when(u % 5 == 0, "DO_NOT_EXTRACT").when(u % 5 == 1, "REVIEW_REQUIRED").otherwise("EXTRACT").alias("decision"),
        F.when(u % 3 == 0, "MUST").when(u % 3 == 1, "SHOULD").otherwise("NICE").alias("importance"), F.col("word").alias("entity_name"), F.concat(F.lit("Stat.K "), "id").alias("fact_key"), F.array(F.concat(F.lit("alt."), "id")).alias("aliases"),
        F.when(number, "NUMBER").otherwise("STRING").alias("value_type"), F.when(number, F.concat(F.lit("Lv."), u.cast("string"), F.lit(" (New +1)"))).otherwise(F.col("p_name")).alias("attribute_value"), value(u).alias("value_json"), F.array("p_name").alias("quotes"), F.concat("p_name", F.lit(" is here")).alias("source_text"),
    )
    shown = F.when(number, F.when(u % 7 == 0, u + 1).otherwise(u).cast("string")).when(u % 3 == 1, F.concat("p_name", F.lit(" x"))).otherwise(F.upper("p_name"))
    given = p.select(
        (u % 10).cast("long").alias("episode_no"), F.col("p_partkey").alias("ordinal"), F.when(u % 11 == 0, "미상").otherwise(F.concat(F.lit(" "), F.upper("word"))).alias("entity_name"), F.when(u % 13 == 0, "AMBIGUOUS").otherwise("UNRESOLVED").alias("match_status"),
        F.when(u % 4 == 0, F.concat(F.lit("ALT. "), "id")).otherwise(F.concat(F.lit("stat.k "), "id")).alias("attribute_name"), F.when(u % 17 == 0, "UNKNOWN").otherwise(F.when(number, "number").otherwise("STRING")).alias("value_type"),
        shown.alias("attribute_value"), F.when(u % 10 == 3, "{}").otherwise(value(u)).alias("value_json"), F.when(u % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.upper("p_name"))).alias("quotes"), "u",
    )
    again = given.filter("u >= 45").withColumn("ordinal", F.col("ordinal") + 10**9)
    return gold, given.unionByName(again).drop("u")


def evaluate(spark, sf):
    """All counts and metrics of gold against predictions, by episode and in all (-1)."""
    report = evaluation.evaluate(*_gold(spark, sf))
    rates = evaluation.metrics(report.counts).select("episode_no", "detectionPrecision", "weightedDetectionRecall", "valueTypeAccuracy", "hardNegativeViolationRate", "unknownSubjectRecoverableRate")
    both = report.counts.join(rates, report.counts["episode_no"].eqNullSafe(rates["episode_no"])).drop(rates["episode_no"])
    return both.withColumn("episode_no", F.coalesce("episode_no", F.lit(-1).cast("long")))


def _competing(spark, sf):
    """Parts as gold rows and as predictions of the same episode and name, with few brands and types as keys, so that many compete for one another."""
    p = _t(spark, sf, "part").withColumns({"word": F.element_at(F.split("p_name", " "), 1), "number": F.col("p_size") % 2 == 0})
    rest = F.col("p_size") % 3
    own = [F.when(F.col("number"), "NUMBER").otherwise("STRING").alias("value_type"), F.when(F.col("number"), (F.col("p_size") % 8).cast("string")).otherwise(F.concat(F.lit("value "), (F.col("p_size") % 5).cast("string"))).alias("attribute_value"), F.lit("{}").alias("value_json"), F.array(F.when(rest == 0, "alpha one").when(rest == 1, "beta two").otherwise("gamma three")).alias("quotes")]
    gold = p.filter("p_partkey % 2 = 0").select((F.col("p_partkey") % 40).cast("long").alias("episode_no"), F.col("p_partkey").cast("long").alias("ordinal"), F.lit("EXTRACT").alias("decision"), F.lit("MUST").alias("importance"), F.col("word").alias("entity_name"), F.substring("p_brand", 1, 7).alias("fact_key"), F.array(F.element_at(F.split("p_type", " "), 1)).alias("aliases"), *own, F.lit(None).cast("string").alias("source_text"))
    given = p.filter("p_partkey % 2 = 1").select(((F.col("p_partkey") + 1) % 40).cast("long").alias("episode_no"), F.col("p_partkey").cast("long").alias("ordinal"), F.col("word").alias("entity_name"), F.when(F.col("p_partkey") % 3 == 0, F.element_at(F.split("p_type", " "), 1)).otherwise(F.substring("p_brand", 1, 7)).alias("attribute_name"), *own)
    return gold, given


def evaluate_competing(spark, sf):
    """The greatest weight of each episode's matches, and what there was to match."""
    report = evaluation.evaluate(*_competing(spark, sf))
    weight = report.matches.groupBy(F.col("episode_no").alias("e")).agg(F.sum("weight").cast("long").alias("weight"))
    counts = report.counts.filter("episode_no is not null").select("episode_no", "goldExtract", "predictions")
    return counts.join(weight, F.col("episode_no") == F.col("e"), "left").select("episode_no", "goldExtract", "predictions", F.coalesce("weight", F.lit(0).cast("long")).alias("weight"))


def unmatched_gold(spark, sf):
    gold, pred, _ = _pairs(spark, sf)
    return gold.select("episode_no", "ordinal").join(evaluation.met_gold(gold, pred), ["episode_no", "ordinal"], "left_anti")


def review_exclusion(spark, sf):
    gold, pred, _ = _pairs(spark, sf)
    met = pred.withColumnRenamed("ordinal", "pred_ordinal").join(evaluation.identities(gold), ["episode_no", "name", "key"])
    return evaluation.without_review(pred.select("episode_no", F.col("ordinal").alias("pred_ordinal")), met.filter("weight = 1000"), met.filter("weight = 900"))[0]


def episode_alignment(spark, sf):
    gold, pred, _ = _pairs(spark, sf)
    brand = lambda rows, c: rows.select((F.length(c) % 7 * 10 + F.length("name")).alias("episode_no"))
    return evaluation.align(brand(gold, "fact_key"), brand(pred, "key"))


def token_bounds(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", metering.bound_from_bytes(F.col("text"), 4096).alias("byte_bound"), metering.bound_from_tokens(F.col("n_chars"), 4096).alias("token_bound"))


def embedding_bounds(spark, sf):
    return metering.embedding_bound(_t(spark, sf, "documents"), ["source"], "text")


def ledger_report(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_type").alias("purpose"), (F.col("user_id") % 3).alias("model"), (F.col("event_id") % 1000 + 100).alias("input"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 50).otherwise(0).alias("cached"), (F.col("event_id") % 2000 + 500).alias("reserved"))
    return metering.report(e, ["purpose", "model"])


def _requests(spark, sf, events):
    """Events as the ledger's: three of a row are a request, a purchase settles it (one in four without known usage), an error releases it."""
    kind = F.when(F.col("event_type") == "purchase", "settle").when(F.col("event_type") == "error", "release").otherwise("reserve")
    used = lambda x: F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 != 0), x)
    return events.select(F.concat(F.lit("r"), F.expr("event_id div 3").cast("string")).alias("request_id"), (F.col("event_id") % 3).cast("int").alias("ordinal"), kind.alias("event"), F.col("ts").cast("timestamp").alias("time"), F.lit("p").alias("purpose"), F.concat(F.lit("m"), (F.expr("event_id div 3") % 4).cast("string")).alias("model"), F.when(kind == "reserve", F.col("event_id") % 7 * 10 + 100).alias("reserved"), used(F.floor("value")).alias("input"), used(F.col("event_id") % 5).alias("cached"), used(F.col("event_id") % 9).alias("output"))


def ledger_settle(spark, sf):
    """The final state of each request, with every event posted twice."""
    events = _requests(spark, sf, _t(spark, sf, "events"))
    return metering.settle(events.unionByName(events))


def ledger_stream(spark, sf):
    """The same as state of a stream, all of whose requests are held longer than the events last."""
    out = tables.scratch(spark, "ledger")
    events = _requests(spark, sf, tables.stream_parquet(spark, f"{sf}/events.parquet"))
    changes = reservations.requests(events, hold=10**12, late="3650 days")
    changes.writeStream.foreachBatch(lambda rows, number: rows.write.mode("append").parquet(f"{out}/changes")).outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return reservations.latest(spark.read.schema(reservations.OUT).parquet(f"{out}/changes")).drop("expired", "version")


def number_parse(spark, sf):
    """The number in a brand, and a price written with commas behind a currency."""
    price = F.concat(F.lit("USD "), F.format_number(F.col("p_retailprice").cast("double"), 2), F.lit(" each"))
    return _t(spark, sf, "part").select("p_partkey", T.parse_decimal(F.col("p_brand")).cast("double").alias("brand"), T.parse_decimal(price).cast("double").alias("price"))


def boolean_parse(spark, sf):
    """Labels, and the flags of order lines, as they are written."""
    labels = _t(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(0).alias("line"), F.concat(F.lit(" "), F.col("toxic").cast("string")).alias("w"))
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("w"))
    return labels.unionByName(lines).select("id", "line", T.parse_boolean(F.col("w")).alias("flag"))


def content_hash(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.content_version(F.col("text"), "notion-").alias("version"))


def canonical_props(spark, sf):
    return _t(spark, sf, "events").select("event_id", J.canonical_json(F.col("props")).alias("props"))


def fact_keys(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.fact_key(F.concat_ws(".", "p_type", "p_name")).alias("key"))


_LINES = r"""
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL"""
_PARAGRAPHS = f"""
WITH l AS ({_LINES}),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS paragraph_index, line AS paragraph_text, s::INT AS start_offset, (s + length(line))::INT AS end_offset
      FROM o WHERE NOT regexp_matches(line, '^\\s*$'))""".replace("\\\\", "\\")
_CH = "(SELECT vec_id, label AS work_id, vec_id % 50 AS episode_no, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS embedding, CASE WHEN vec_id % 11 = 0 THEN 'v0' ELSE 'v1' END AS version FROM embeddings)"
_SET = "(SELECT event_id AS ordinal, user_id % 10 AS job, CASE WHEN event_id % 17 <> 0 THEN event_type || '|' || (user_id % 50) END AS key, CASE WHEN event_id % 5 <> 0 THEN round(value, 1) END AS confidence FROM events)"
_KNOWN = "(SELECT min(p_partkey) AS known_id, lower(p_name) AS known_name FROM part GROUP BY p_name)"
_MENTIONS = """(SELECT p_partkey AS row_id, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE split_part(p_name, ' ', 1) END AS entity_name,
  CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN 'the ' || p_name || ' itself' WHEN 2 THEN p_brand || ' of ' || split_part(p_name, ' ', 1) END AS raw_mention FROM part)"""
_QUOTES = """(SELECT doc_id, doc_id AS "of", text, string_split(text, chr(10))[3] AS quote FROM documents
  UNION ALL SELECT a.doc_id, b.doc_id, a.text, string_split(b.text, chr(10))[3] FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""
_FOUND = f"WITH h AS (SELECT *, CASE WHEN length(quote) > 0 AND strpos(text, quote) > 0 THEN strpos(text, quote) - 1 END AS s FROM {_QUOTES})"
_G = "(SELECT p_partkey % 40 AS episode_no, p_partkey AS ordinal, split_part(p_name, ' ', 1) AS name, p_brand AS fact_key, p_type AS alias FROM part WHERE p_partkey % 2 = 0)"
_P = "(SELECT (p_partkey + 1) % 40 AS episode_no, p_partkey AS ordinal, split_part(p_name, ' ', 1) AS name, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS key FROM part WHERE p_partkey % 2 = 1)"
_PAIRS = f"(SELECT g.episode_no, g.ordinal AS gold_ordinal, p.ordinal AS pred_ordinal, CASE WHEN p.key = g.fact_key THEN 1000 ELSE 900 END AS weight FROM {_G} g JOIN {_P} p ON g.episode_no = p.episode_no AND g.name = p.name AND p.key IN (g.fact_key, g.alias))"
_W = "CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END"
_COUNTS = f"""
SELECT coalesce(source, '*') AS source, count(*) FILTER (quality = 1) AS "goldExtract", count(*) FILTER (n_chars > 400) AS "predictions", count(*) AS "predictionTotal",
  count(*) FILTER (quality = 1 AND n_chars > 400) AS "detectionMatches", count(*) FILTER (quality = 1 AND n_chars > 400 AND toxic = 0) AS "factCorrect", count(*) FILTER (quality <> 1) AS "goldDoNotExtractScored",
  count(*) FILTER (quality <> 1 AND n_chars > 400) AS "hardNegativeViolations", coalesce(sum({_W}) FILTER (quality = 1), 0)::BIGINT AS "weightedGold",
  coalesce(sum({_W}) FILTER (quality = 1 AND n_chars > 400), 0)::BIGINT AS "weightedDetectionMatches", coalesce(sum({_W}) FILTER (quality = 1 AND n_chars > 400 AND toxic = 0), 0)::BIGINT AS "weightedFactCorrect"
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)"""


_EVALUATED = """
WITH g AS (SELECT p_size % 10 AS episode_no, p_size AS u, CASE p_size % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'R' ELSE 'E' END AS d, 3 - p_size % 3 AS w, p_size % 13 = 0 AS amb, p_size % 11 = 0 AS unk, CASE WHEN p_size >= 45 THEN 2 ELSE 1 END AS n,
    p_size % 17 <> 0 AS typed, CASE WHEN p_size % 17 = 0 THEN 'X' WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 7 = 0 THEN 'X' ELSE 'M' END WHEN p_size % 3 = 1 THEN 'S' ELSE 'M' END AS st, CASE WHEN p_size % 6 = 0 THEN 0 ELSE 1 END AS q FROM part),
b AS (SELECT *, NOT amb AND NOT unk AS named, d = 'E' AND NOT amb AND NOT unk AS m FROM g),
c AS (SELECT coalesce(episode_no, -1)::BIGINT AS episode_no,
  count(*) FILTER (d = 'E') AS "goldExtract", count(*) FILTER (d = 'N') AS "goldDoNotExtract", count(*) FILTER (d = 'N') AS "goldDoNotExtractScored", 0::BIGINT AS "goldDoNotExtractUnscored", count(*) FILTER (d = 'R') AS "goldReviewExcluded", 0::BIGINT AS "characterDiscoveryExcluded",
  sum(n)::BIGINT AS "predictionTotal", (sum(n) - coalesce(sum(n) FILTER (d = 'R' AND named), 0))::BIGINT AS "predictions", coalesce(sum(n) FILTER (d = 'R' AND named), 0)::BIGINT AS "reviewExcludedPredictions", count(*) FILTER (m) AS "detectionMatches",
  count(*) FILTER (m AND st = 'M') AS "factCorrect", count(*) FILTER (m AND st = 'S') AS "semanticPending", count(*) FILTER (m AND typed) AS "valueTypeCorrect", count(*) FILTER (m) AS "structuredValueEvaluated", count(*) FILTER (m AND u % 10 <> 3) AS "structuredValueCorrect",
  count(*) FILTER (m AND st = 'M') AS "attributeValueCorrect", count(*) FILTER (d = 'N' AND named) AS "hardNegativeViolations", count(*) FILTER (n = 2 AND NOT amb AND NOT (d = 'R' AND named)) AS "duplicates",
  coalesce(sum(w) FILTER (d = 'E'), 0)::BIGINT AS "weightedGold", coalesce(sum(w) FILTER (m), 0)::BIGINT AS "weightedDetectionMatches", coalesce(sum(w) FILTER (m AND st = 'M'), 0)::BIGINT AS "weightedFactCorrect",
  coalesce(sum(q) FILTER (m), 0)::BIGINT AS "evidenceQuotes", coalesce(sum(q) FILTER (m), 0)::BIGINT AS "locatableEvidenceQuotes", count(*) FILTER (m AND q > 0) AS "matchedWithPredictionEvidence", count(*) FILTER (m) AS "matchedWithGoldEvidence", count(*) FILTER (m AND q > 0) AS "matchedWithCoveredGoldEvidence",
  0::BIGINT AS "judgeInputTokens", 0::BIGINT AS "judgeCachedInputTokens", 0::BIGINT AS "judgeOutputTokens", coalesce(sum(n) FILTER (unk), 0)::BIGINT AS "unknownSubjectPredictions", count(*) FILTER (unk AND d = 'E' AND st = 'M' AND n = 1) AS "subjectOnlyFailures",
  2 * count(*) FILTER (unk AND d = 'E' AND st = 'M' AND n = 2) AS "ambiguousUnknownSubjectPredictions", coalesce(sum(n) FILTER (unk AND d = 'E' AND st = 'S'), 0)::BIGINT AS "pendingUnknownSubjectPredictions", coalesce(sum(n) FILTER (unk AND (d <> 'E' OR st = 'X')), 0)::BIGINT AS "unmatchedUnknownSubjectPredictions"
  FROM b GROUP BY ROLLUP (episode_no))
"""
_PACKED = """, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
r AS (SELECT DISTINCT doc_id, -1::BIGINT AS k, NULL::INT AS a, NULL::INT AS b, NULL::BIGINT AS i, []::STRUCT(s INT, e INT, f BIGINT, l BIGINT)[] AS made FROM n
  UNION ALL
  SELECT n.doc_id, n.paragraph_index,
    CASE WHEN end_offset - start_offset > 3000 THEN NULL WHEN end_offset - coalesce(a, start_offset) > 3000 THEN start_offset WHEN end_offset - coalesce(a, start_offset) >= 2500 THEN NULL ELSE coalesce(a, start_offset) END,
    CASE WHEN end_offset - start_offset > 3000 THEN NULL WHEN end_offset - coalesce(a, start_offset) > 3000 THEN end_offset WHEN end_offset - coalesce(a, start_offset) >= 2500 THEN NULL ELSE end_offset END,
    CASE WHEN end_offset - start_offset > 3000 THEN NULL WHEN end_offset - coalesce(a, start_offset) > 3000 THEN paragraph_index WHEN end_offset - coalesce(a, start_offset) >= 2500 THEN NULL ELSE coalesce(i, paragraph_index) END,
    CASE WHEN end_offset - start_offset > 3000 THEN list_concat(CASE WHEN a IS NULL THEN [] ELSE [{'s': a, 'e': b, 'f': i, 'l': paragraph_index - 1}] END, list_transform(range(0, end_offset - start_offset, 3000), lambda d: {'s': (start_offset + d)::INT, 'e': least(start_offset + d + 3000, end_offset)::INT, 'f': paragraph_index, 'l': paragraph_index}))
      WHEN end_offset - coalesce(a, start_offset) > 3000 THEN [{'s': a, 'e': b, 'f': i, 'l': paragraph_index - 1}]
      WHEN end_offset - coalesce(a, start_offset) >= 2500 THEN [{'s': coalesce(a, start_offset), 'e': end_offset, 'f': coalesce(i, paragraph_index), 'l': paragraph_index}] ELSE [] END
  FROM r JOIN n ON n.doc_id = r.doc_id AND n.paragraph_index = r.k + 1),
c AS (SELECT doc_id, unnest(made) AS c FROM r UNION ALL SELECT r.doc_id, {'s': a, 'e': b, 'f': i, 'l': k} FROM r JOIN (SELECT DISTINCT doc_id, n FROM n) USING (doc_id) WHERE k = n - 1 AND a IS NOT NULL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY c.s) - 1)::INT AS chunk_index, substring(text, c.s + 1, c.e - c.s) AS chunk_text, c.s AS start_offset, c.e AS end_offset, c.f::INT AS paragraph_start_index, c.l::INT AS paragraph_end_index FROM c JOIN documents USING (doc_id)"""


def _r(a, b):
    return f'round_even("{a}"::DOUBLE / nullif("{b}", 0), 6)'


def _f(p, r):
    return f"CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE round_even(2 * {p} * {r} / ({p} + {r}), 6) END"


QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_filtered, vector_index_search, paragraph_split, long_paragraph_split, chunk_pack, adjacent_context, evidence_locate, evidence_locate_ws, source_excerpt, name_exact, name_containment,
    name_resolution, schema_key_canonical, discovery_dedup, setting_dedup, duplicate_rows, gold_ids, evaluate, evaluate_competing, eval_counts, eval_metrics, identity_join, assignment, unmatched_gold, review_exclusion,
    episode_alignment, token_bounds, embedding_bounds, ledger_report, ledger_settle, ledger_stream, number_parse, boolean_parse, content_hash, canonical_props, fact_keys,
)}

ORACLES: dict[str, str] = {
    "vector_topk": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS similarity FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10",
    "vector_topk_filtered": f"SELECT vec_id, episode_no, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS similarity FROM {_CH} WHERE embedding IS NOT NULL AND work_id < 6 AND version = 'v1' AND episode_no BETWEEN 5 AND 40 AND vec_id % 13 <> 0 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), vec_id LIMIT 20",
    "paragraph_split": _PARAGRAPHS + "SELECT * FROM p",
    "long_paragraph_split": _PARAGRAPHS + "SELECT doc_id, paragraph_index, (start_offset + a)::INT AS start_offset, (start_offset + least(a + 3000, length(paragraph_text)))::INT AS end_offset, substring(paragraph_text, a + 1, 3000) AS paragraph_text FROM (SELECT *, unnest(generate_series(0, greatest(length(paragraph_text) - 1, 0), 3000))::INT AS a FROM p)",
    "adjacent_context": "SELECT conv_id, turn, lag(text) OVER w AS previous_text, text, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "evidence_locate": _FOUND + ' SELECT doc_id, "of", s::INT AS start_offset, (s + length(quote))::INT AS end_offset, s IS NOT NULL AS verified FROM h',
    "evidence_locate_ws": rf"""WITH h AS (SELECT *, regexp_extract(text, array_to_string(list_transform(string_split(quote, ' '), lambda x: regexp_escape(x)), '\s+')) AS hit FROM {_QUOTES})
      SELECT doc_id, "of", CASE WHEN length(quote) > 0 AND length(hit) > 0 THEN strpos(text, hit) - 1 END::INT AS start_offset, CASE WHEN length(quote) > 0 AND length(hit) > 0 THEN strpos(text, hit) - 1 + length(hit) END::INT AS end_offset FROM h""",
    "source_excerpt": _FOUND + ' SELECT doc_id, "of", CASE WHEN s IS NULL THEN substring(text, 1, 600) ELSE substring(text, greatest(s - 300, 0) + 1, least(s + length(quote) + 300, length(text)) - greatest(s - 300, 0)) END AS excerpt FROM h',
    "name_exact": "SELECT a.n_nationkey AS row_id, b.n_nationkey AS known_id FROM nation a JOIN nation b ON lower(a.n_name) = lower(b.n_name) AND (a.n_regionkey + a.n_nationkey % 2) % 5 = b.n_regionkey",
    "chunk_pack": _PARAGRAPHS.replace("WITH l", "WITH RECURSIVE l") + _PACKED,
    "name_resolution": f"""
WITH m AS (SELECT *, lower(entity_name) AS e, lower(coalesce(raw_mention, '')) AS r FROM {_MENTIONS}),
i AS (SELECT row_id, raw_mention, entity_name, e, r, (SELECT list_sort(list(DISTINCT known_id::VARCHAR)) FROM {_KNOWN} k WHERE known_name = e OR length(e) >= 2 AND length(known_name) >= 2 AND (contains(e, known_name) OR contains(known_name, e))) AS a,
  (SELECT list_sort(list(DISTINCT known_id::VARCHAR)) FROM {_KNOWN} k WHERE known_name = r OR length(r) >= 2 AND length(known_name) >= 2 AND (contains(r, known_name) OR contains(known_name, r))) AS b FROM m),
s AS (SELECT *, CASE WHEN coalesce(len(a), 0) = 0 AND contains(r, e) THEN 'UNRESOLVED' WHEN len(b) > 1 OR len(b) = 1 AND len(a) = 1 AND a[1] <> b[1] THEN 'AMBIGUOUS' WHEN len(b) = 1 THEN 'MATCHED' WHEN len(a) > 1 THEN 'AMBIGUOUS' WHEN len(a) = 1 THEN 'MATCHED' ELSE 'UNRESOLVED' END AS match_status FROM i)
SELECT row_id, entity_name, raw_mention, CASE WHEN match_status = 'MATCHED' THEN CASE WHEN len(b) = 1 THEN b[1] ELSE a[1] END END AS matched_id, match_status FROM s""",
    "canonical_props": "SELECT event_id, json(props)::VARCHAR AS props FROM events",
    "name_containment": f"SELECT row_id, string_agg(known_id::VARCHAR, ',' ORDER BY known_id) AS ids FROM (SELECT DISTINCT row_id, known_id FROM {_MENTIONS} JOIN {_KNOWN} ON contains(known_name, lower(entity_name)) OR contains(lower(entity_name), known_name)) GROUP BY row_id",
    "schema_key_canonical": """
WITH s AS (SELECT 'place.' || lower(r_name) AS schema_key, [r_name, substring(r_name, 1, 2), substring(r_name, 1, 1)] AS aliases FROM region),
r AS (SELECT c_custkey, trim(CASE c_custkey % 5 WHEN 0 THEN ' place.' || lower(r_name) WHEN 1 THEN r_name WHEN 2 THEN 'place.' || substring(r_name, 1, 2) WHEN 3 THEN substring(r_name, 1, 1) ELSE n_name END) AS k
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT c_custkey, count(*) AS n, min(schema_key) AS to_key FROM r JOIN s ON schema_key = k GROUP BY 1),
a AS (SELECT c_custkey, count(DISTINCT schema_key) AS n, min(schema_key) AS to_key FROM r JOIN (SELECT schema_key, unnest(aliases) AS alias FROM s) ON k = alias OR k = 'place.' || alias GROUP BY 1)
SELECT c_custkey, CASE WHEN x.n = 1 THEN x.to_key WHEN x.n > 1 THEN k WHEN a.n = 1 THEN a.to_key ELSE k END AS canonical_key FROM r LEFT JOIN x USING (c_custkey) LEFT JOIN a USING (c_custkey)""",
    "discovery_dedup": "SELECT conv_id, ordinal, name, match_status FROM (SELECT conv_id, turn AS ordinal, lower(split_part(text, ' ', 1)) AS name, 'UNRESOLVED' AS match_status, row_number() OVER (PARTITION BY conv_id, lower(split_part(text, ' ', 1)) ORDER BY turn) AS k FROM conversations WHERE turn % 3 <> 0) WHERE k = 1",
    "setting_dedup": f"SELECT ordinal, job, key, confidence, position FROM (SELECT *, row_number() OVER (PARTITION BY job, key ORDER BY coalesce(confidence, -1) DESC, ordinal) AS k, min(ordinal) OVER (PARTITION BY job, key) AS position FROM {_SET} WHERE key IS NOT NULL) WHERE k = 1 UNION ALL SELECT ordinal, job, key, confidence, ordinal FROM {_SET} WHERE key IS NULL",
    "duplicate_rows": f"SELECT ordinal, job, key, confidence FROM (SELECT *, row_number() OVER (PARTITION BY job, key ORDER BY ordinal) AS k FROM {_SET} WHERE key IS NOT NULL) WHERE k > 1",
    "gold_ids": "SELECT doc_id, 'episode-' || (doc_id % 10) || ':' || lower(lang) || ':' || source || ':' || row_number() OVER (PARTITION BY doc_id % 10, lower(lang), source ORDER BY doc_id) AS gold_id FROM documents",
    "evaluate": _EVALUATED + f'SELECT *, {_r("detectionMatches", "predictions")} AS "detectionPrecision", {_r("weightedDetectionMatches", "weightedGold")} AS "weightedDetectionRecall", {_r("valueTypeCorrect", "detectionMatches")} AS "valueTypeAccuracy", {_r("hardNegativeViolations", "goldDoNotExtractScored")} AS "hardNegativeViolationRate", {_r("subjectOnlyFailures", "unknownSubjectPredictions")} AS "unknownSubjectRecoverableRate" FROM c',
    "eval_counts": _COUNTS,
    "eval_metrics": f'WITH c AS ({_COUNTS}), m AS (SELECT source, {_r("detectionMatches", "predictions")} AS "detectionPrecision", {_r("detectionMatches", "goldExtract")} AS "detectionRecall", {_r("factCorrect", "predictions")} AS "factPrecision", {_r("factCorrect", "goldExtract")} AS "factRecall", {_r("weightedDetectionMatches", "weightedGold")} AS "weightedDetectionRecall", {_r("weightedFactCorrect", "weightedGold")} AS "weightedFactRecall", {_r("hardNegativeViolations", "goldDoNotExtractScored")} AS "hardNegativeViolationRate" FROM c) SELECT *, ' + _f('"detectionPrecision"', '"detectionRecall"') + ' AS "detectionF1", ' + _f('"factPrecision"', '"factRecall"') + ' AS "factF1" FROM m',
    "identity_join": f"SELECT * FROM {_PAIRS}",
    "unmatched_gold": f"SELECT episode_no, ordinal FROM {_G} g WHERE NOT EXISTS (SELECT 1 FROM {_PAIRS} p WHERE p.episode_no = g.episode_no AND p.gold_ordinal = g.ordinal)",
    "review_exclusion": f"SELECT episode_no, ordinal AS pred_ordinal FROM {_P} p WHERE NOT EXISTS (SELECT 1 FROM {_PAIRS} x WHERE x.pred_ordinal = p.ordinal AND weight = 1000) AND EXISTS (SELECT 1 FROM {_PAIRS} x WHERE x.pred_ordinal = p.ordinal AND weight = 900)",
    "episode_alignment": f"SELECT episode_no, coalesce(a, false) AS has_gold, coalesce(b, false) AS has_predictions FROM (SELECT DISTINCT length(fact_key) % 7 * 10 + length(name) AS episode_no, true AS a FROM {_G}) FULL JOIN (SELECT DISTINCT length(key) % 7 * 10 + length(name) AS episode_no, true AS b FROM {_P}) USING (episode_no)",
    "token_bounds": "SELECT doc_id, strlen(coalesce(text, '')) + 4096 + 512 AS byte_bound, ceil(n_chars::DOUBLE * 1.10::DOUBLE)::BIGINT + 256 + 4096 AS token_bound FROM documents",
    "embedding_bounds": "SELECT source, (coalesce(sum(strlen(text)), 0) + 256)::BIGINT AS reserved_tokens FROM documents GROUP BY 1",
    "ledger_report": "WITH e AS (SELECT event_type AS purpose, user_id % 3 AS model, event_id % 1000 + 100 AS input, CASE WHEN event_id % 4 = 0 THEN event_id % 50 ELSE 0 END AS cached, event_id % 2000 + 500 AS reserved FROM events) SELECT purpose, model, count(*) AS calls, count(*) FILTER (cached > 0) AS cache_hits, sum(input)::BIGINT AS input_tokens, sum(cached)::BIGINT AS cached_tokens, round(sum(cached)::DOUBLE / sum(input), 6) AS cached_share, round(avg(reserved), 6) AS mean_reserved, round(avg(reserved::DOUBLE / input), 6) AS mean_reserved_over_used FROM e GROUP BY 1, 2",
    "number_parse": "SELECT p_partkey, regexp_extract(p_brand, '[0-9]+')::DOUBLE AS brand, round(p_retailprice::DOUBLE, 2) AS price FROM part",
    "boolean_parse": "WITH w AS (SELECT doc_id AS id, 0 AS line, toxic::VARCHAR AS w FROM labels UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem) SELECT id, line, CASE WHEN lower(w) IN ('true', '1', 'yes', 'y', '예', '참') THEN true WHEN lower(w) IN ('false', '0', 'no', 'n', '아니오', '거짓') THEN false END AS flag FROM w",
    "content_hash": "SELECT doc_id, 'notion-' || substring(sha256(text), 1, 12) AS version FROM documents",
    "fact_keys": "SELECT p_partkey, array_to_string(list_transform(string_split(lower(trim(p_type || '.' || p_name)), '.'), lambda x: replace(trim(x), ' ', '_')), '.') AS key FROM part",
}


def _best(pairs: str) -> str:
    """SQL that tries every assignment of each group of pairs (episode_no, name, gold_ordinal, pred_ordinal, weight): b has a group's greatest weight."""
    return f"""
p AS ({pairs}),
n AS (SELECT *, dense_rank() OVER (PARTITION BY episode_no, name ORDER BY gold_ordinal) AS k FROM p),
o AS (SELECT episode_no, name, k, pred_ordinal, weight FROM n UNION ALL SELECT DISTINCT episode_no, name, k, NULL, 0 FROM n),
s AS (SELECT DISTINCT episode_no, name, 0::BIGINT AS k, []::BIGINT[] AS used, 0::BIGINT AS w FROM p
  UNION SELECT s.episode_no, s.name, s.k + 1, CASE WHEN o.pred_ordinal IS NULL THEN used ELSE list_sort(list_append(used, o.pred_ordinal::BIGINT)) END, w + o.weight
  FROM s JOIN o ON o.episode_no = s.episode_no AND o.name = s.name AND o.k = s.k + 1 WHERE o.pred_ordinal IS NULL OR NOT list_contains(used, o.pred_ordinal::BIGINT)),
m AS (SELECT episode_no, name, max(w) AS w FROM s GROUP BY ALL),
b AS (SELECT m.*, max(len(used)) AS pairs FROM m JOIN s ON s.episode_no = m.episode_no AND s.name = m.name AND s.w = m.w GROUP BY ALL)"""


ORACLES["assignment"] = f"WITH RECURSIVE {_best(f'SELECT x.*, g.name FROM {_PAIRS} x JOIN {_G} g ON g.ordinal = x.gold_ordinal')} SELECT episode_no, sum(pairs)::BIGINT AS pairs, sum(w)::BIGINT AS weight FROM b GROUP BY 1"
_C = """(SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS name, lower(substring(p_brand, 1, 7)) AS brand, lower(split_part(p_type, ' ', 1)) AS kind, CASE WHEN p_size % 2 = 0 THEN 'NUMBER' ELSE 'STRING' END AS t,
  CASE WHEN p_size % 2 = 0 THEN p_size % 8 ELSE p_size % 5 END AS v FROM part)"""
ORACLES["evaluate_competing"] = f"""WITH RECURSIVE x AS (SELECT g.p_partkey % 40 AS episode_no, g.name, g.p_partkey AS gold_ordinal, y.p_partkey AS pred_ordinal,
    CASE WHEN (CASE WHEN y.p_partkey % 3 = 0 THEN y.kind ELSE y.brand END) = g.brand THEN 1000 ELSE 900 END + CASE WHEN g.t <> y.t THEN 0 WHEN g.v = y.v THEN 120 WHEN g.t = 'STRING' THEN 70 ELSE 20 END + CASE WHEN g.p_size % 3 = y.p_size % 3 THEN 5 ELSE 0 END AS weight
  FROM {_C} g JOIN {_C} y ON g.p_partkey % 2 = 0 AND y.p_partkey % 2 = 1 AND g.p_partkey % 40 = (y.p_partkey + 1) % 40 AND g.name = y.name AND (CASE WHEN y.p_partkey % 3 = 0 THEN y.kind ELSE y.brand END) IN (g.brand, g.kind)),
{_best('SELECT * FROM x')}, e AS (SELECT p_partkey % 40 AS episode_no, 1 AS g, 0 AS p FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT (p_partkey + 1) % 40, 0, 1 FROM part WHERE p_partkey % 2 = 1)
SELECT episode_no::BIGINT AS episode_no, sum(g)::BIGINT AS "goldExtract", sum(p)::BIGINT AS predictions, coalesce(any_value(w), 0)::BIGINT AS weight FROM e LEFT JOIN (SELECT episode_no, sum(w) AS w FROM b GROUP BY 1) USING (episode_no) GROUP BY 1"""
ORACLES["ledger_settle"] = """WITH e AS (SELECT 'r' || (event_id // 3) AS request_id, event_id % 3 AS ordinal, event_type = 'purchase' AS settle, event_type = 'error' AS release, 'm' || (event_id // 3 % 4) AS model, event_id, CASE WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN floor(value)::BIGINT END AS input FROM events),
u AS (SELECT request_id, max(ordinal) FILTER (input IS NOT NULL) AS last FROM e GROUP BY 1)
SELECT request_id, 'p' AS purpose, any_value(model) AS model, max(event_id % 7 * 10 + 100) FILTER (NOT settle AND NOT release) AS reserved, count(*) FILTER (NOT settle AND NOT release) AS attempts,
  CASE WHEN any_value(last) IS NOT NULL THEN 'SETTLED' WHEN bool_or(settle OR release) THEN 'RELEASED' ELSE 'RESERVED' END AS state,
  max(input) FILTER (ordinal = last) AS input, max(event_id % 5) FILTER (ordinal = last) AS cached, max(event_id % 9) FILTER (ordinal = last) AS output FROM e JOIN u USING (request_id) GROUP BY request_id"""
ORACLES["ledger_stream"] = ORACLES["ledger_settle"]
ORACLES["vector_index_search"] = ORACLES["vector_topk_filtered"]
