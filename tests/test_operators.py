"""Cases of the chunking, evidence, name, deduplication, vector, metering and evaluation operators."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import json_values as J
from inkwell.functions import text as T
from inkwell.operators import chunking, dedup, evaluation, evidence, extraction, metering, names, vector


def plain_paragraphs(text):
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        body = line[:-2] if line.endswith("\r\n") else line[:-1] if line[-1:] in "\r\n" else line
        if body.strip():
            out.append((at, at + len(body)))
        at += len(line)
    return out


def plain_pack(text, target, most, least):
    out, a, b, i = [], None, None, None
    ps = plain_paragraphs(text)
    for k, (s, e) in enumerate(ps):
        if e - s > most:
            if a is not None:
                out.append((a, b))
            out += [(x, min(x + most, e)) for x in range(s, e, most)]
            a = None
        elif a is not None and e - a > most:
            out.append((a, b))
            a, b = s, e
        else:
            a = s if a is None else a
            b = e
            if b - a >= target and b - a >= least:
                out.append((a, b))
                a = None
    return out + ([(a, b)] if a is not None else [])


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["a" * 7, "b c", "가나다😀", " ", "", "x" * 40, " z", "　", "q" * 13]
    return ["".join(rng.choice(parts) + rng.choice(["\n", "\r\n", "\r", "\n\n", ""]) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_paragraphs_and_chunks_match_plain_python(spark):
    rows = list(enumerate(texts(300, 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in chunking.split_paragraphs(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start_offset"], r["end_offset"]))
        assert rows[r["doc_id"]][1][r["start_offset"] : r["end_offset"]] == r["paragraph_text"]
    packed = {}
    for r in chunking.chunks(df, target=25, most=30, least=10).orderBy("doc_id", "chunk_index").collect():
        packed.setdefault(r["doc_id"], []).append((r["start_offset"], r["end_offset"]))
        assert rows[r["doc_id"]][1][r["start_offset"] : r["end_offset"]] == r["chunk_text"]
    for i, t in rows:
        assert sorted(got.get(i, [])) == plain_paragraphs(t)
        assert packed.get(i, []) == plain_pack(t, 25, 30, 10)


def test_chunk_cases(spark):
    def sizes(text, **k):
        df = spark.createDataFrame([(0, text)], "doc_id long, text string")
        return [len(r["chunk_text"]) for r in chunking.chunks(df, **k).orderBy("chunk_index").collect()]

    assert sizes("x" * 12, target=5, most=5, least=1) == [5, 5, 2]
    assert len(sizes("\n\n".join(["y" * 480] * 13))) == 3
    assert sizes("a" * 600 + "\r\n" * 20 + "b" * 2900) == [600, 2900]
    assert sizes("") == []
    with pytest.raises(ValueError):
        chunking.pack(F.col("text"), 10, 5, 1)
    # rows that share an id don't mix, and running sums cross the blocks that they are made in
    df = spark.createDataFrame([(1, "aa\nbb"), (1, "cccc\ndd"), (2, "\n".join(f"{i:04d}" for i in range(400))), (3, None)], "doc_id long, text string")
    got = chunking.split_paragraphs(df).collect()
    assert sorted((r["paragraph_text"], r["start_offset"]) for r in got if r["doc_id"] == 1) == [("aa", 0), ("bb", 3), ("cccc", 0), ("dd", 5)]
    assert [(r["paragraph_index"], r["start_offset"], r["end_offset"]) for r in got if r["doc_id"] == 2] == [(i, 5 * i, 5 * i + 4) for i in range(400)]


def test_evidence(spark):
    rows = [("ab  cd\nef", "cd ef", 4, 9), ("a.b(c", "b(c", 2, 5), ("abc", "x", None, None), ("abc", "", None, None), ("x [1] y", "[1]\ty", 2, 7)]
    df = spark.createDataFrame([(t, q) for t, q, *_ in rows], "t string, q string")
    got = df.select("t", "q", evidence.locate_spaced(F.col("t"), F.col("q")).alias("at")).collect()
    assert [(r["at"] and r["at"]["start"], r["at"] and r["at"]["end"]) for r in got] == [(a, b) for *_, a, b in rows]
    e = spark.createDataFrame([(["Alpha beta"], ["alpha  BETA gamma"], "the alpha beta gamma")], "g array<string>, p array<string>, s string").select(evidence.evaluate("g", "p", "s").alias("e")).first()["e"]
    assert tuple(e) == (1, 1, 1, 1)
    got = spark.createDataFrame([("c1", "x ab", 10, [("ab", 99)])], "id string, t string, base int, spans array<struct<quote:string,start_offset:int>>")
    assert evidence.locate_all(got, "spans", "t", "base").first()["spans"][0][1:] == (12, 14)


def plain_mention(s):
    return s in names.MENTIONS or any(len(s) > len(p) and s.endswith(p) and plain_mention(s[: -len(p)]) for p in names.PARTICLES)


def test_mentions_match_recursion(spark):
    rng = random.Random(3)
    words = [rng.choice((*names.MENTIONS, "철수", "제은", "그로")) + "".join(rng.choice(names.PARTICLES) for _ in range(rng.randrange(3))) for _ in range(800)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", names.is_mention(F.col("w")).alias("m"), names.is_usable(F.col("w")).alias("u")).collect():
        assert r["m"] == plain_mention(r["w"])
        rejected = any(len(r["w"]) - len(p) > 1 and r["w"].endswith(p) and plain_mention(r["w"][: -len(p)]) for p in names.PARTICLES)
        assert r["u"] == (not plain_mention(r["w"]) or (r["w"] not in names.MENTIONS and not rejected))


def test_name_resolution(spark):
    """A keeper's log: two sisters who share a family name, a name that ends like a particle, and a cook."""
    known = spark.createDataFrame([("k1", "Odile Marsh"), ("k2", "Perrin Marsh"), ("k3", "Tomas Brandt"), ("k4", "도은")], "id string, name string")
    cases = [
        # the entity name decides
        ("Odile Marsh", None, "SETTING", "k1", "MATCHED"), ("[tomas  BRANDT]", "", "SETTING", "k3", "MATCHED"), ("Marsh", None, "SETTING", None, "AMBIGUOUS"), ("Lieve", None, "SETTING", None, "UNRESOLVED"), ("도은", "도은", "SETTING", "k4", "MATCHED"),
        # no concrete name
        ("unknown", "Odile Marsh", "SETTING", None, "AMBIGUOUS"), ("그녀", "Perrin Marsh", "SETTING", None, "AMBIGUOUS"), ("", "Brandt", "SETTING", None, "AMBIGUOUS"),
        # a pronoun as mention leaves it to the entity name
        ("Perrin Marsh", "그녀가", "SETTING", "k2", "MATCHED"), ("Lieve", "저는", "SETTING", None, "UNRESOLVED"),
        # a mention that names someone known
        ("Brandt", "Tomas Brandt the cook", "SETTING", "k3", "MATCHED"), ("Tomas Brandt", "Odile Marsh", "SETTING", None, "AMBIGUOUS"), ("Lieve", "old Brandt", "SETTING", None, "UNRESOLVED"), ("Tomas Brandt", "both Marsh and Odile Marsh", "SETTING", None, "AMBIGUOUS"),
        # a new person who is mentioned beside a known one
        ("Wim", "Wim, the nephew of Tomas Brandt", "SETTING", None, "UNRESOLVED"), ("Wim", "the nephew, Tomas Brandt", "SETTING", "k3", "MATCHED"), ("Wim", "the nephew, Tomas Brandt", "CHARACTER_DISCOVERY", None, "UNRESOLVED"),
    ]
    rows = spark.createDataFrame([(i, e, r, k) for i, (e, r, k, *_) in enumerate(cases)], "row_id long, entity_name string, raw_mention string, candidate_kind string")
    got = {r["row_id"]: (r["matched_id"], r["match_status"]) for r in names.resolve(rows, names.known(known, "id", "name")).collect()}
    assert got == {i: (m, s) for i, (*_, m, s) in enumerate(cases)}


def test_names_match_within_their_work(spark):
    """Containment in both directions, by work; case folding unfolds letters."""
    known = spark.createDataFrame([("1", "김철수", "a"), ("2", "철수", "b"), ("3", "Großmann", "a"), ("4", "철", "a")], "id string, name string, w string")
    rows = spark.createDataFrame([(0, "철수", "a"), (1, "김철수 검사", "a"), (2, "김철수", "b"), (3, "GROSSMANN", "a"), (4, "GROSSMANN", "b"), (5, "철", "a"), (6, "수김철", "a")], "row_id long, entity_name string, w string").withColumn("raw_mention", F.lit(None).cast("string"))
    got = {r["row_id"]: (r["matched_id"], r["match_status"]) for r in names.resolve(rows, names.known(known, "id", "name", "w"), work_col="w").collect()}
    assert got == {0: ("1", "MATCHED"), 1: ("1", "MATCHED"), 2: ("2", "MATCHED"), 3: ("3", "MATCHED"), 4: (None, "UNRESOLVED"), 5: ("4", "MATCHED"), 6: (None, "UNRESOLVED")}
    rng = random.Random(2)
    words = ["".join(rng.choice("ab가나") for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    rows = spark.createDataFrame([(i, w, "") for i, w in enumerate(words[:60])], "row_id long, n string, work string")
    known = spark.createDataFrame([(str(i), w, "") for i, w in enumerate(words[60:])], "known_id string, known_name string, work string")
    got = {r["row_id"]: r["ids"] for r in names.contained(rows, "n", known, "ids").collect()}
    wanted = {i: sorted(str(k) for k, x in enumerate(words[60:]) if len(x) > 1 and len(w) > 1 and (x in w or w in x)) for i, w in enumerate(words[:60])}
    assert got == {i: x for i, x in wanted.items() if x}


def test_scalars(spark):
    df = spark.createDataFrame([("Lv.３６ (New +1)", "ＹＥＳ", 0.12345, " Ａ b "), ("정신 -1,234.5", " 참", 1.0, "ß"), ("none", "maybe", None, None)], "n string, b string, c double, i string")
    got = df.select(T.parse_decimal(F.col("n")).cast("double"), T.parse_boolean(F.col("b")), T.confidence(F.col("c")).cast("string"), T.id_part("i")).collect()
    assert [tuple(r) for r in got] == [(36.0, True, "0.1235", "a_b"), (-1234.5, True, "1.0000", "ss"), (None, None, None, None)]
    letters = [c for c in map(chr, range(1, 0x3000)) if c.lower() != c.casefold() or c.upper() != c]
    folded = spark.createDataFrame([(c,) for c in letters], "c string").select("c", T.fold(F.col("c")).alias("f")).collect()
    # dotless i and capital sharp s fold further, and Cherokee folds to its capitals
    assert {r["c"] for r in folded if r["f"] != r["c"].casefold() and not "\u13a0" <= r["c"] <= "\u13fd"} <= {"ı", "ẞ"} and {"ß": "ss", "ς": "σ", "µ": "μ", "é": "é"}.items() <= {r["c"]: r["f"] for r in folded}.items()


def test_dedup(spark):
    rows = spark.createDataFrame([(0, "a", 0.5), (1, "a", 0.9), (2, "a", 0.9), (3, None, None), (4, "b", None), (5, None, 0.1)], "ordinal long, key string, confidence double").withColumn("job", F.lit(1))
    got = sorted((r["position"], r["ordinal"]) for r in dedup.best_settings(rows, ["job"], "key").collect())
    assert got == [(0, 1), (3, 3), (4, 4), (5, 5)]
    assert sorted(r["ordinal"] for r in dedup.repeated(rows, ["job"], "key").collect()) == [1, 2]


def test_vector_guards_and_order(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, None), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = vector.top_k(df, [1.0, 0.0], 3).collect()
    assert [r["vec_id"] for r in got] == [1, 4, 2] and abs(got[2]["similarity"] - 0.8) < 1e-12
    for bad in (dict(query=[], k=1), dict(query=[1.0], k=0), dict(query=[1.0], k=1, episode_range=(3, 2))):
        with pytest.raises(ValueError):
            vector.top_k(df, **bad)


def test_embedding_errors(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, chunk_text string")

    class Busy(Exception):
        status_code = 503

    def busy(texts):
        raise Busy

    assert [r["embedding"] for r in vector.embed(df, busy, 2, "m").collect()] == [None, None]
    assert sorted(r["embedding"][0] for r in vector.embed(df, lambda ts: [[float(len(t)), 0.0] for t in ts], 2, "m").collect()) == [1.0, 1.0]
    items = spark.createDataFrame([([(1, [2.0]), (0, [1.0])],)], "i array<struct<index:int,embedding:array<double>>>")
    assert items.select(vector.in_order(F.col("i"), 1).alias("v")).first()["v"] == [[1.0], [2.0]]


def test_assignment_is_best():
    assert evaluation.best_assignment([[9, 8], [8, 0]]) == [(0, 1), (1, 0)]
    rng = random.Random(5)
    for _ in range(300):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        w = [[rng.choice((0, 0, 900, 1000, 1025)) for _ in range(m)] for _ in range(n)]
        got = evaluation.best_assignment(w)
        size = max(n, m)
        best = max(sum(w[i][p[i]] for i in range(n) if p[i] < m) for p in itertools.permutations(range(size)))
        assert sum(w[i][j] for i, j in got) == best and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert all(w[i][j] > 0 for i, j in got)


def test_assignment_by_components(spark):
    rng = random.Random(6)
    edges = [(e, rng.randrange(12), rng.randrange(12), rng.choice((900, 1000, 1025, 1120))) for e in range(4) for _ in range(18)]
    taken = evaluation.assign(spark.createDataFrame([(*x, "kept") for x in edges], "episode_no long, gold_ordinal long, pred_ordinal long, weight long, more string")).collect()
    for e in range(4):
        w = [[max([x[3] for x in edges if x[:3] == (e, i, j)], default=0) for j in range(12)] for i in range(12)]
        own = [r for r in taken if r["episode_no"] == e]
        assert sum(r["weight"] for r in own) == sum(w[i][j] for i, j in evaluation.best_assignment(w)) and all(w[r["gold_ordinal"]][r["pred_ordinal"]] == r["weight"] and r["more"] == "kept" for r in own)
        assert len({r["gold_ordinal"] for r in own}) == len({r["pred_ordinal"] for r in own}) == len(own)


GOLD = "episode_no long, ordinal long, decision string, importance string, entity_name string, fact_key string, aliases array<string>, value_type string, attribute_value string, value_json string, quotes array<string>, source_text string"
GIVEN = "episode_no long, ordinal long, candidate_kind string, entity_name string, match_status string, matched_name string, attribute_name string, value_type string, attribute_value string, value_json string, quotes array<string>"


LOG = "The lamp was lit at dusk. Odile Marsh has kept the light for nine years, and she carries a brass key. Fog came in from the north."
NINE, KEY = "Odile Marsh has kept the light for nine years", "she carries a brass key"


def gold_row(name="Odile Marsh", key="duty.years", value="9", kind="NUMBER", json_='{"years": 9}', quotes=(NINE,), decision="EXTRACT", importance="SHOULD", aliases=(), text=LOG):
    return decision, importance if decision == "EXTRACT" else None, name, key, list(aliases), kind, value, json_, list(quotes), text


def given_row(name="Odile Marsh", key="duty.years", value="9", kind="NUMBER", json_='{"years": 9}', quotes=(NINE,), what="SETTING", status=None, matched=None):
    return what, name, status, matched, key, kind, value, json_, list(quotes)


def scenarios():
    """name -> (gold rows, predictions, wanted counts): a keeper's log, a case for each rule."""
    kept = gold_row(importance="NICE")
    key = gold_row(key="gear.key", value="a brass key", kind="STRING", json_='{"metal": "brass"}', quotes=(KEY,), aliases=("gear.brass_key",), importance="MUST")
    hidden = gold_row(key="family.secret", value="none", kind="STRING", json_="{}", quotes=(), decision="DO_NOT_EXTRACT")
    home = lambda name, **k: gold_row(name, "home.port", "Vlieland", "STRING", '{"port": "Vlieland"}', (), text=None, **k)
    port = lambda name, value="vlieland", **k: given_row(name, **({"key": "home.port", "kind": "string", "json_": "{}", "quotes": ()} | k), value=value)
    stranger = names.UNKNOWN
    return {
        # values
        "number in words around it": ([kept], [given_row(value="for 9 (nine) years")], {"detectionMatches": 1, "factCorrect": 1, "valueTypeCorrect": 1, "weightedGold": 1, "weightedFactCorrect": 1}),
        "another number": ([kept], [given_row(value="8")], {"detectionMatches": 1, "factCorrect": 0, "semanticPending": 0, "attributeValueCorrect": 0}),
        "another type": ([kept], [given_row(kind="STRING")], {"detectionMatches": 1, "valueTypeCorrect": 0, "factCorrect": 0}),
        "texts that differ wait for a judge": ([key], [given_row(key="gear.key", value="key made of brass", kind="STRING", json_='{"metal": "brass", "size": 2}', quotes=(KEY,))], {"detectionMatches": 1, "semanticPending": 1, "factCorrect": 0, "structuredValueEvaluated": 1, "structuredValueCorrect": 1, "weightedDetectionMatches": 3}),
        "shown value right, structure wrong": ([key], [given_row(key="gear.key", value="A  BRASS key", kind="STRING", json_='{"metal": "tin"}', quotes=(KEY,))], {"factCorrect": 1, "attributeValueCorrect": 1, "structuredValueEvaluated": 1, "structuredValueCorrect": 0}),
        "no structure asked for": ([gold_row(json_="{}")], [given_row(json_='{"years": 1}')], {"factCorrect": 1, "structuredValueEvaluated": 0}),
        # identity
        "alias as key": ([key], [given_row(key="Gear. Brass Key", value="a brass key", kind="STRING", quotes=(KEY,))], {"detectionMatches": 1, "factCorrect": 1}),
        "schema alias as key": ([home("Perrin Marsh")], [port("perrin marsh", key="home.harbour")], {"detectionMatches": 1, "factCorrect": 1}),
        "another key": ([kept], [given_row(key="duty.months")], {"detectionMatches": 0, "predictions": 1}),
        "known name stands for a short one": ([home("Perrin Marsh")], [port("Perrin", status="MATCHED", matched="Perrin Marsh")], {"detectionMatches": 1}),
        "ambiguous name matches nothing": ([home("Perrin Marsh")], [port("Perrin Marsh", status="AMBIGUOUS")], {"detectionMatches": 0, "predictions": 1, "unknownSubjectPredictions": 0}),
        # one to one
        "the better of two": ([kept], [given_row(value="8", json_='{"years": 9}'), given_row(json_='{"years": 8}')], {"detectionMatches": 1, "factCorrect": 1, "structuredValueCorrect": 0, "duplicates": 0}),
        "said twice": ([kept, key], [given_row(), given_row()], {"detectionMatches": 1, "predictions": 2, "duplicates": 1, "goldExtract": 2}),
        # what must not be found, and what isn't scored
        "hard negative": ([kept, hidden], [given_row(), given_row(key="family.secret", value="x", kind="STRING")], {"goldDoNotExtractScored": 1, "hardNegativeViolations": 1, "detectionMatches": 1}),
        "hard negative left alone": ([hidden], [given_row()], {"goldDoNotExtract": 1, "hardNegativeViolations": 0, "predictions": 1}),
        "negative without a key": ([gold_row(key=None, decision="DO_NOT_EXTRACT")], [], {"goldDoNotExtract": 1, "goldDoNotExtractScored": 0, "goldDoNotExtractUnscored": 1}),
        "under review": ([gold_row(key="mood.fear", decision="REVIEW_REQUIRED")], [given_row(key="mood.fear")], {"goldReviewExcluded": 1, "predictionTotal": 1, "predictions": 0, "reviewExcludedPredictions": 1}),
        "discovery isn't a setting": ([], [given_row(what="CHARACTER_DISCOVERY", key=None, value=None, kind=None, json_=None)], {"characterDiscoveryExcluded": 1, "predictionTotal": 0, "predictions": 0}),
        "nothing to find": ([], [given_row()], {"goldExtract": 0, "predictions": 1, "detectionMatches": 0}),
        # evidence
        "quote that isn't in the text": ([kept], [given_row(quotes=("The lamp burned blue all night",))], {"evidenceQuotes": 1, "locatableEvidenceQuotes": 0, "matchedWithPredictionEvidence": 1, "matchedWithGoldEvidence": 1, "matchedWithCoveredGoldEvidence": 0}),
        "longer quote covers": ([kept], [given_row(quotes=(f"{NINE}, and {KEY}", "lit at dusk"))], {"evidenceQuotes": 2, "locatableEvidenceQuotes": 2, "matchedWithCoveredGoldEvidence": 1}),
        # subjects that the text doesn't name
        "recoverable": ([home("Odile Marsh")], [port(stranger, status="AMBIGUOUS")], {"unknownSubjectPredictions": 1, "subjectOnlyFailures": 1, "detectionMatches": 0}),
        "could be either sister": ([home("Odile Marsh"), home("Perrin Marsh")], [port(stranger, status="AMBIGUOUS")], {"subjectOnlyFailures": 0, "ambiguousUnknownSubjectPredictions": 1}),
        "two for one": ([home("Odile Marsh")], [port(stranger), port(stranger)], {"unknownSubjectPredictions": 2, "ambiguousUnknownSubjectPredictions": 2}),
        "needs a judge": ([home("Odile Marsh")], [port(stranger, value="an island port")], {"pendingUnknownSubjectPredictions": 1, "subjectOnlyFailures": 0, "judgeInputTokens": 0}),
        "fits nothing": ([home("Odile Marsh")], [port(stranger, kind="NUMBER", value="2")], {"unmatchedUnknownSubjectPredictions": 1}),
        "known after all": ([home("Odile Marsh")], [port(stranger, status="MATCHED", matched="Odile Marsh")], {"detectionMatches": 1, "unknownSubjectPredictions": 0}),
    }


def framed(spark, cases):
    number = {name: i for i, name in enumerate(cases, 1)}
    gold = spark.createDataFrame([(number[e], i, *g) for e, (rows, _, _) in cases.items() for i, g in enumerate(rows)], GOLD)
    given = spark.createDataFrame([(number[e], i, *p) for e, (_, rows, _) in cases.items() for i, p in enumerate(rows)], GIVEN)
    return number, gold, given


def test_evaluation_end_to_end(spark):
    cases = scenarios()
    number, gold, given = framed(spark, cases)
    schemas = spark.createDataFrame([("home.port", ["harbour", "haven"])], "schema_key string, aliases array<string>")
    report = evaluation.evaluate(gold, given, schemas)
    counts = {r["episode_no"]: r.asDict() for r in report.counts.collect()}
    assert list(report.counts.columns) == ["episode_no", *evaluation.COUNTS] and len(evaluation.COUNTS) == 34
    for name, (*_, wanted) in cases.items():
        assert {k: counts[number[name]][k] for k in wanted} == wanted, name
    assert all(counts[None][k] == sum(c[k] for e, c in counts.items() if e is not None) for k in evaluation.COUNTS)
    m = {name: r for r in report.metrics().collect() for name in cases if r["episode_no"] == number[name]}
    assert len(m["alias as key"]) == 23 and [m["texts that differ wait for a judge"][k] for k in ("detectionPrecision", "detectionRecall", "factMetricsComplete", "factF1", "evidenceLocatableRate", "goldEvidenceCoverageRate")] == [1.0, 1.0, False, None, 1.0, 1.0]
    assert (m["said twice"]["detectionPrecision"], m["said twice"]["detectionRecall"], m["said twice"]["duplicatePredictionRate"]) == (0.5, 0.5, 0.5) and m["hard negative"]["hardNegativeViolationRate"] == 1.0 and m["quote that isn't in the text"]["evidenceLocatableRate"] == 0.0
    assert m["no structure asked for"]["structuredValueAccuracy"] is None and m["negative without a key"]["hardNegativeViolationRate"] is None and m["under review"]["detectionPrecision"] is None and m["recoverable"]["unknownSubjectRecoverableRate"] == 1.0
    matches = {(r["episode_no"], r["gold_id"].split(":", 1)[1]): r for r in report.matches.collect()}
    at = lambda name, gold_id: matches[number[name], gold_id]
    assert at("longer quote covers", "odile_marsh:duty.years:1")["evidence_matched"] and not at("quote that isn't in the text", "odile_marsh:duty.years:1")["evidence_matched"] and at("quote that isn't in the text", "odile_marsh:duty.years:1")["fact_correct"]
    assert at("schema alias as key", "perrin_marsh:home.port:1")["attribute_name"] == "home.harbour"
    assert [tuple(r) for r in report.review_excluded.collect()] == [(number["under review"], 0)] and (number["another key"], 0) in {tuple(r) for r in report.unmatched_predictions.collect()}
    assert (number["ambiguous name matches nothing"], f"episode-{number['ambiguous name matches nothing']}:perrin_marsh:home.port:1") in {tuple(r) for r in report.unmatched_gold.collect()}
    broken = gold.withColumn("importance", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="no importance"):
        evaluation.evaluate(broken, given).counts.collect()


def test_copies_are_compared_once(spark, monkeypatch):
    """300 equal gold rows against 200 equal predictions: one pair is compared, and 200 are matched one to one."""
    gold = spark.range(300).selectExpr("1L", "id", "'EXTRACT'", "'MUST'", "'Ada'", "'k.a'", "array('k.b')", "'NUMBER'", "'7'", "'{}'", "array('a quote')", "cast(null as string)").toDF(*(c.split()[0] for c in GOLD.split(", ")))
    given = spark.range(200).selectExpr("1L", "id + 5", "'SETTING'", "'ada'", "'UNRESOLVED'", "cast(null as string)", "'k.a'", "'number'", "'7'", "'{}'", "array('a quote')").toDF(*(c.split()[0] for c in GIVEN.split(", ")))
    sizes, own = [], evaluation.compared
    monkeypatch.setattr(evaluation, "compared", lambda pairs, *rest: sizes.append(pairs.count()) or own(pairs, *rest))
    report = evaluation.evaluate(gold, given)
    assert sizes[0] == 1
    assert report.matches.selectExpr("count(*)", "count(distinct gold_id)", "count(distinct pred_ordinal)", "sum(weight)").first() == (200, 200, 200, 200 * 1125)
    assert report.counts.filter("episode_no is null").select("detectionMatches", "factCorrect", "predictions", "goldExtract").first() == (200, 200, 200, 300)


def test_evaluation_sends_no_side_of_a_join_through_the_driver(spark, monkeypatch):
    """Joins of rows are sorted ones even where a few bytes hold all rows, as they do with millions of rows that are alike."""
    gold = spark.range(300).selectExpr("1L", "id", "'EXTRACT'", "'MUST'", "'Ada'", "'k.a'", "array('k.b')", "'NUMBER'", "'7'", "'{}'", "array('a quote')", "cast(null as string)").toDF(*(c.split()[0] for c in GOLD.split(", ")))
    given = spark.range(200).selectExpr("1L", "id + 5", "'SETTING'", "'ada'", "'UNRESOLVED'", "cast(null as string)", "'k.a'", "'number'", "'7'", "'{}'", "array('a quote')").toDF(*(c.split()[0] for c in GIVEN.split(", ")))
    frames, own = [], evaluation.tables.settled
    monkeypatch.setattr(evaluation.tables, "settled", lambda df: frames.append(df) or own(df))
    provider = lambda prompt: (json.dumps({"results": []}), 0, 0, 0)
    report = evaluation.evaluate(gold, given, provider=provider)
    frames += [report.counts, report.matches, report.unmatched_gold, report.unmatched_predictions, report.unknown_subjects]
    plans = "\n".join(df._jdf.queryExecution().executedPlan().toString() for df in frames)
    assert plans.count("SortMergeJoin") >= 10 and "Broadcast" not in plans
    assert report.counts.filter("episode_no is null").select("detectionMatches", "unmatchedUnknownSubjectPredictions").first() == (200, 0)


def test_identities_need_no_pairs(spark):
    """Equal rows give one identity, and a gold row is met once a key, however many predictions have it."""
    gold = spark.range(50).selectExpr("1L as episode_no", "id as ordinal", "'n' as name", "'k' as fact_key", "array('k', 'a') as accepted_keys")
    pred = spark.range(40).selectExpr("1L as episode_no", "id as ordinal", "'n' as name", "if(id < 30, 'a', 'x') as key")
    assert sorted((r["key"], r["weight"]) for r in evaluation.identities(gold).collect()) == [("a", 900), ("k", 1000)]
    assert evaluation.met_gold(gold, pred).count() == 50


def test_a_keys_pairs_are_spread(spark):
    """300 x 300 rows of one key are dealt to several tasks, with the same pairs."""
    gold = spark.createDataFrame([(1, i, "n", "k", ["a"]) for i in range(300)], "episode_no long, ordinal long, name string, fact_key string, accepted_keys array<string>")
    pred = spark.createDataFrame([(1, i, "n", "a") for i in range(300)], "episode_no long, ordinal long, name string, key string")
    got = evaluation.identity_pairs(gold, pred, dealt=8)
    assert got.select("gold_ordinal", "pred_ordinal").distinct().count() == got.count() == 90_000
    assert got.withColumn("task", F.spark_partition_id()).groupBy("task").count().count() > 4


def test_judge(spark):
    """A batch is one call; pending matches are decided; unknown subjects are never asked about; bad answers show no text."""
    number, gold, given = framed(spark, {e: x for e, x in scenarios().items() if e in ("texts that differ wait for a judge", "needs a judge")})
    asked_for, never = number["texts that differ wait for a judge"], number["needs a judge"]

    def provider(prompt):
        asked = json.loads(prompt)["cases"]
        assert all("brass key" in c["sourceExcerpt"] and c["predictionEvidence"] for c in asked)
        return json.dumps({"results": [{"caseId": c["caseId"], "core_meaning_covered": True, "supported_by_evidence": True, "contradiction": False, "unsupported_detail": False, "reason": "same"} for c in asked]}), 100, 50, 20

    report = evaluation.evaluate(gold, given, provider=provider)
    c = {r["episode_no"]: r for r in report.counts.collect()}
    assert [c[asked_for][k] for k in ("judgeInputTokens", "judgeCachedInputTokens", "judgeOutputTokens", "factCorrect", "semanticPending")] == [100, 50, 20, 1, 0] and c[never]["judgeInputTokens"] == 0
    m = {r["episode_no"]: r for r in report.metrics().collect()}[asked_for]
    assert (m["factPrecision"], m["factRecall"], m["factMetricsComplete"]) == (1.0, 1.0, True)
    rows = spark.createDataFrame([(1, i, "a", "k", "x", "y", ["q"], ["q"], "s") for i in range(10)], "episode_no long, ordinal long, entity_name string, fact_key string, gold_value string, value string, gold_quotes array<string>, quotes array<string>, excerpt string")
    said = lambda prompt: (json.dumps({"results": [{"caseId": x["caseId"], "core_meaning_covered": True, "supported_by_evidence": True, "contradiction": x["caseId"] == 1, "unsupported_detail": False, "reason": ""} for x in json.loads(prompt)["cases"]]}), 1, 0, 0)
    got = evaluation.judge(rows, said).orderBy("ordinal").collect()
    assert [r["matched"] for r in got] == [i not in (1, 9) for i in range(10)] and sum(r["input_tokens"] for r in got) == 2
    for answer in ("secret", '{"results": [{"caseId": 0, "reason": "secret"}]}'):
        with pytest.raises(ValueError, match="invalid") as e:
            evaluation.verdicts(answer, 1)
        assert "secret" not in str(e.value)
    with pytest.raises(ValueError, match="once"):
        evaluation.verdicts(said(json.dumps({"cases": [{"caseId": 0}, {"caseId": 0}]}))[0], 2)


def test_json_containment_cases():
    yes = [({"a": 1}, {"a": "1", "b": 2}), ({"a": [1, {"b": True}]}, {"a": ["1", {"b": "예", "c": 0}]}), ({"v": None}, {"v": None}), ({"n": 36}, {"n": "정신 36 (New +1)"}), ({"t": "Ａ  b"}, {"t": "a B"}), ({"x": False}, {"x": 0}), ({"t": "1"}, {"t": 1})]
    no = [({"a": 1}, {}), ({"a": [1]}, {"a": [1, 2]}), ({"a": {}}, {"a": []}), ({"v": None}, {"v": 0}), ({"n": 1}, {"n": True}), ({"x": True}, {"x": "maybe"}), ({"a": 1}, None)]
    assert all(J.contains(*x) for x in yes) and not any(J.contains(*x) for x in no)


def test_query_search_and_subjects(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vector.search(df, "q", lambda ts: [[0.0, 2.0]], 1, 2).collect()] == [2]
    calls = []
    for bad in (dict(text=" ", k=1), dict(text="q", k=0), dict(text="q", k=1, episode_range=(2, 1))):
        with pytest.raises(ValueError):
            vector.search(df, bad.pop("text"), lambda ts: calls.append(1), bad.pop("k"), 2, **bad)
    assert not calls
    fields = "source_chunk_id string, ordinal int, candidate_kind string, entity_name string, raw_entity_mention string, attribute_name string, attribute_value string"
    rows = spark.createDataFrame([("c1", 0, "SETTING", "그는", "그는", "a", "1"), ("c1", 1, "SETTING", "철수", "철수", "a", "1"), ("c1", 2, "SETTING", "미상", None, "a", "1"), ("c2", 0, "SETTING", "나", "나", "a", "1"), ("c3", 0, "CHARACTER_DISCOVERY", "그녀", None, None, None)], fields)
    chunks = spark.createDataFrame([("c1", "t1", None, "t2"), ("c2", "t2", "t1", None)], "chunk_id string, chunk_text string, previous_text string, next_text string")

    def provider(prompt):
        asked = json.loads(prompt.split("\n")[-1])
        assert prompt.startswith("static\n") and asked["current"] in ("t1", "t2")
        return "```json\n" + json.dumps({"resolutions": [{"candidateId": c["candidateId"], "resolvedEntityName": "영희" if c["candidateId"] == "candidate-0" and asked["current"] == "t1" else "그"} for c in asked["candidates"]]}) + "\n```"

    answers = extraction.ask_subjects(rows, chunks, provider, "static", ["영희"])
    filled = extraction.fill_subjects(rows, spark.createDataFrame(answers.collect(), answers.schema))
    assert {(r["source_chunk_id"], r["ordinal"]): r["entity_name"] for r in filled.collect()} == {("c1", 0): "영희", ("c1", 1): "철수", ("c1", 2): "미상", ("c2", 0): "미상", ("c3", 0): "그녀"}
    counts = extraction.subject_counts(rows, filled)
    assert sorted(tuple(r) for r in counts.collect()) == [("c1", 1, 1, 1), ("c2", 1, 0, 1)]
    with pytest.raises(Exception, match="don't match"):
        extraction.ask_subjects(rows, chunks, lambda p: '{"resolutions": []}', "static").collect()
    state = spark.createDataFrame([("j", "e", [1.0], "OK"), ("j", "e", None, "FAILED"), ("j", "e", None, None)], "job_id string, episode_id string, embedding array<double>, embedding_status string")
    summary = extraction.job_summary(state, spark.createDataFrame([("j",)] * 4, "job_id string"), counts.withColumn("job_id", F.lit("j"))).first()
    assert json.loads(summary["summary_json"]) == {"episodeCount": 1, "chunkCount": 3, "embeddedChunkCount": 1, "embeddingFailedChunkCount": 1, "embeddingSkippedChunkCount": 1, "candidateCount": 4, "subjectFallbackCallCount": 2, "subjectFallbackResolvedCount": 1, "subjectFallbackUnresolvedCount": 2}


def test_values_and_metrics(spark):
    rows = [("NUMBER", "36 (New +1)", None, "number", "36", None), ("BOOLEAN", "예", None, "BOOLEAN", "true", None), ("STRING", "a", None, "STRING", "b", None), ("NUMBER", "x", None, "NUMBER", "x", None), ("STRING", "Ａ", '{"k": 1}', "STRING", "a", '{"k": "1", "z": 2}'), (None, "a", "{}", "STRING", "a", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    got = [tuple(r["v"]) for r in df.select(evaluation.compare_values("a", "b", "c", "d", "e", "f").alias("v")).collect()]
    assert got == [("MATCH", True, None), ("MATCH", True, None), ("SEMANTIC_JUDGE_REQUIRED", True, None), ("MISMATCH", True, None), ("MATCH", True, True), ("MISMATCH", False, None)]
    m = evaluation.metrics(spark.createDataFrame([(2, 3, 2, 1, 1)], "detectionMatches long, predictions long, goldExtract long, factCorrect long, semanticPending long")).first()
    assert (m["detectionPrecision"], m["detectionRecall"], m["detectionF1"], m["factF1"], m["factMetricsComplete"]) == (0.666667, 1.0, 0.8, None, False)


def test_json_functions(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so: {"b": [1]} done',), ("none",)], "t string")
    assert [r[0] for r in df.select(J.lenient_object(F.col("t"))).collect()] == ['{"a": 1}', '{"b": [1]}', None]
    assert json.loads(spark.createDataFrame([("5",)], "t string").select(J.summary_object(F.col("t"))).first()[0]) == {"value": 5}
    assert spark.createDataFrame([('{"b":1.0,"a":1}',)], "t string").select(J.canonical_json("t")).first()[0] == '{"a":1,"b":1.0}'
    assert spark.createDataFrame([("Ａ  b. C d ",)], "t string").select(T.normalize_text("t"), T.fact_key("t")).first()[:] == ("a b. c d", "a__b.c_d")


def test_ledger(spark):
    rows = [("r1", 0, "reserve", 100, None), ("r1", 0, "reserve", 100, None), ("r1", 1, "settle", None, 40), ("r2", 0, "reserve", 50, None), ("r2", 1, "settle", None, None), ("r3", 0, "reserve", 10, None)]
    events = spark.createDataFrame([(i, o, e, "p", "m", r, u, 0, 1) for i, o, e, r, u in rows], "request_id string, ordinal int, event string, purpose string, model string, reserved long, input long, cached long, output long")
    assert {r["request_id"]: (r["state"], r["attempts"]) for r in metering.settle(events).collect()} == {"r1": ("SETTLED", 1), "r2": ("RELEASED", 1), "r3": ("RESERVED", 1)}


def test_extraction_retries_and_subjects(spark, tmp_path):
    good = json.dumps({"candidates": [{"candidate_kind": "SETTING", "entity_name": " 그는 ", "raw_entity_mention": "그는", "attribute_name": "age", "attribute_value": "3", "value_type": "NUMBER", "value_json": 3, "confidence": 0.5, "quotes": ["q"]}]})
    log = str(tmp_path / "calls")

    def provider(prompt):
        import os

        with open(log, "a") as f:
            f.write("x")
        return "broken" if os.path.getsize(log) == 1 else good

    df = spark.createDataFrame([("c1", "text")], "chunk_id string, chunk_text string")
    rows = extraction.extract(df, provider, "static", [{"schemaKey": "age", "aliases": ["b", "a"]}])
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert rows.first()["entity_name"] == "그는" and rows.first()["source_chunk_id"] == "c1"
    answers = spark.createDataFrame([("c1", 0, "철수")], "source_chunk_id string, ordinal int, subject string")
    assert extraction.fill_subjects(rows, answers).first()["entity_name"] == "철수"
    with pytest.raises(ValueError):
        extraction.fill_subjects(rows, answers.limit(0))
    with pytest.raises(ValueError):
        extraction.extract(df, provider, "static", [])
    hints = [{"schemaKey": "b", "aliases": ["y", "x"]}, {"schemaKey": "a", "aliases": []}]
    assert extraction.hints_text(hints) == extraction.hints_text(hints[::-1])
