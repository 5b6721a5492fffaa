"""Names by automata, quotes located together, bounded similarity, sparse assignment, components, the vector index, file updates and reports."""

import json
import os
import random
import re
from difflib import SequenceMatcher
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import ann, chunking, components, evaluation, evidence, extraction, names, vector
from inkwell.sources import tables

# -- names


def test_resolution_keeps_rows_and_columns(spark):
    """Repeated row_ids stay as many rows as they are, columns may have any names, and a null work is a work of its own."""
    known = spark.createDataFrame([("1", "Ann Rivers", "w"), ("2", "Bo Hill", None)], "id string, name string, w string")
    given = "row_id long, entity_name string, raw_mention string, e string, r string, work string, concrete string, w string, matched string, e_ids string"
    rows = spark.createDataFrame([(7, "Ann", "she", "keep", "r", "own", "c", "w", "m", "i"), (7, "Ann", "she", "keep", "r", "own", "c", "w", "m", "i"), (8, "Bo Hill", None, "keep", "r", None, "c", None, "m", "i"), (9, "Ann", None, "keep", "r", "own", "c", None, "m", "i")], given)
    got = names.resolve(rows, names.known(known, "id", "name", "w"), work_col="w").orderBy("row_id").collect()
    assert [(r["row_id"], r["matched_id"], r["match_status"]) for r in got] == [(7, "1", "MATCHED")] * 2 + [(8, "2", "MATCHED"), (9, None, "UNRESOLVED")]
    assert got[0].asDict() == {"row_id": 7, "entity_name": "Ann", "raw_mention": "she", "e": "keep", "r": "r", "work": "own", "concrete": "c", "w": "w", "matched": "m", "e_ids": "i", "matched_id": "1", "match_status": "MATCHED"}


def test_many_names_with_one_beginning(spark):
    """100,000 known names that share their first two characters; in one block, and in many."""
    known = spark.range(100_000).select(F.lit("").alias("work"), F.col("id").cast("string").alias("known_id"), F.concat(F.lit("ab"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("known_name"))
    asked = [f"see ab{i:06d} and ab{i + 1:06d}" for i in range(0, 3000, 2)] + [f"b{i:05d}" for i in range(300)]
    rows = spark.createDataFrame([("", n) for n in asked], "work string, n string")
    for block in (names.BLOCK, 7000):
        got = {r["n"]: sorted(r["ids"]) for r in names.contained_names(rows, known, block).collect()}
        for i in range(0, 3000, 2):
            assert got[f"see ab{i:06d} and ab{i + 1:06d}"] == sorted([str(i), str(i + 1)])
        assert all(got[f"b{i:05d}"] == sorted(str(i * 10 + d) for d in range(10)) for i in range(300))


def test_canonical_keys_keep_columns(spark):
    rows = spark.createDataFrame([("mass", "x", "y", "z")], "attribute_name string, k string, exact string, n_alias string")
    schemas = spark.createDataFrame([("item.weight", ["mass"])], "schema_key string, aliases array<string>")
    assert names.canonical_keys(rows, schemas).first().asDict() == {"attribute_name": "mass", "k": "x", "exact": "y", "n_alias": "z", "canonical_key": "item.weight"}


# -- quotes


def plain_located(source, quote):
    if not source or not quote:
        return None
    if quote in source:
        return source.index(quote), source.index(quote) + len(quote)
    if not re.search(r"\s", quote):
        return None
    m = re.search(r"\s+".join(re.escape(p) for p in re.split(r"\s+", quote)), source)
    return m and m.span()


def test_quotes_are_located_as_by_patterns(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(["a", "b", " ", "  ", "\n", "\t ", "　", "é", "😀", ".", "("]) for _ in range(n))
    for _ in range(1500):
        source = text(rng.randrange(40))
        at = rng.randrange(len(source) + 1)
        quotes = [text(rng.randrange(5)), source[at : at + 6], re.sub(r"\s+", lambda m: rng.choice([" ", "\n\n", "\t"]), source[at : at + 9]), None, "", *([text(3) for _ in range(12)] if rng.random() < 0.3 else [])]
        assert evidence.located(source, quotes) == [plain_located(source, q) for q in quotes], (source, quotes)
    docs = spark.createDataFrame([(1, "one  two\nthree " * 50 + "end"), (2, None)], "doc_id long, text string")
    asked = [(1, f"two three one{' ' * (i % 3)}\n two", i) for i in range(40)] + [(1, "end", 50), (1, "two three one", 51), (1, None, 52), (2, "x", 53), (3, "x", 54), (1, "end", 55)]
    got = {r["n"]: r["at"] and tuple(r["at"]) for r in evidence.locate_quotes(docs, spark.createDataFrame(asked, "doc_id long, quote string, n long"), "doc_id", most=3).collect()}
    source = docs.first()["text"]
    assert got == {n: plain_located(source if d == 1 else None, q) for d, q, n in asked}


def test_similarity_is_bounded_and_exact():
    """10^5 pairs: what the bounds leave out is never alike, and they leave out most."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    change = lambda t: "".join(c if rng.random() > 0.08 else rng.choice("abc") for c in t)
    left = [change(rng.choice(base)) for _ in range(317)]
    right = [change(rng.choice(base)) for _ in range(317)]
    wanted = np.array([[bool(a and b) and (a in b or b in a or SequenceMatcher(None, a, b).ratio() >= evidence.RATIO) for b in right] for a in left])
    assert np.array_equal(evidence.alike(left, right), wanted) and 0.001 < wanted.mean() < 0.2
    assert 1 - evidence.possible(left, right).mean() > 0.9  # the share of pairs whose ratio is never computed
    assert evidence.same_span("Ａ  long quote here", "a long quote herE!") and not evidence.same_span("", "a")


# -- chunks


def test_chunking_is_linear(spark):
    """Four times the lines take about four times as long; measured in one process, without Spark."""
    import time

    def took(n):
        text = "\n".join(f"line {i} of a long text" for i in range(n))
        began = time.perf_counter()
        assert sum(1 for _ in chunking._lines(text)) == n and sum(b - a for a, b, *_ in chunking.packed(chunking._lines(text), 2500, 3000, 1000)) > 0
        return time.perf_counter() - began

    took(16_000)
    assert min(took(64_000) for _ in range(3)) < 10 * min(took(16_000) for _ in range(3)) and took(16_000) < 1
    odd = spark.createDataFrame([(1, "a\x0bb\x85\r\nc \rd\x1c\n\n e")], "doc_id long, text string")
    got = [(r["paragraph_text"], r["start_offset"]) for r in chunking.split_paragraphs(odd).orderBy("paragraph_index").collect()]
    assert got == [("a\x0b", 0), ("b\x85", 2), ("c ", 6), ("d\x1c", 9), (" e", 13)]


def test_a_batch_of_texts_is_never_all_objects():
    """40 MB of texts in one batch: what is Python objects at once stays far below them."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["\n".join(f"line {i} of text {k}" for i in range(200)) for k in range(10_000)] + [None])
    kinds = {"start": pa.int32(), "end": pa.int32(), "body": pa.string()}
    tracemalloc.start()
    got = chunking._by_slices(texts, lambda t: list(chunking._lines(t)), kinds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 10_001 and got[9_999][199].as_py()["body"] == "line 199 of text 9999" and got[10_000].as_py() == []
    assert texts.nbytes > 40e6 and peak < 60e6, peak  # all lines as objects are some 300 MB


# -- assignment


def dense_best(w):
    """Greatest weight by successive rows over a whole matrix (Hungarian method), for comparison."""
    n = max(w.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : w.shape[0] + 1, 1 : w.shape[1] + 1] = -w
    u, v, p, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while p[j0]:
            used[j0] = True
            cur = cost[p[j0]] - u[p[j0]] - v
            better = ~used & (cur < least)
            better[0] = False
            least[better], way[better] = cur[better], j0
            rest = np.where(used, np.inf, least)
            rest[0] = np.inf
            j1 = int(rest.argmin())
            delta = rest[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return -sum(cost[p[j], j] for j in range(1, n + 1))


def test_sparse_assignment_equals_dense():
    rng = np.random.default_rng(2)
    for n, m, edges in ((40, 60, 150), (80, 50, 400), (120, 120, 3000), (1, 9, 5)):
        for choices in ((900, 1000, 1025, 1120), tuple(range(1, 500)), (5,)):
            g, p, w = rng.integers(0, n, edges), rng.integers(0, m, edges), rng.choice(choices, edges)
            k = evaluation.best_pairs(g, p, w)
            dense = np.zeros((n, m))
            np.maximum.at(dense, (g, p), w)
            assert w[k].sum() == dense_best(dense) and len(set(g[k])) == len(set(p[k])) == len(k)


def test_a_large_component_is_sparse(spark):
    """20,000 gold rows and as many predictions with 10^5 pairs, mostly one component, in one task; and cut into components by Spark."""
    import tracemalloc

    rng = np.random.default_rng(1)
    g, p, w = rng.integers(0, 20_000, 100_000), rng.integers(0, 20_000, 100_000), rng.integers(1, 2000, 100_000)
    tracemalloc.start()
    k = evaluation.best_pairs(g, p, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(k) > 18_000 and peak < 200e6  # a matrix of doubles would be 3,200 MB
    rows = [(1, i // 40 * 100 + i % 7, i // 40 * 100 + i % 5, 900 + i % 3, "kept") for i in range(2000)] + [(2, 1, 1, 5, "kept")]
    df = spark.createDataFrame(rows, "episode_no long, gold_ordinal long, pred_ordinal long, weight long, more string")
    whole, cut = (evaluation.assign(df, most=most).groupBy("episode_no", "more").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).orderBy("episode_no").collect() for most in (10**6, 100))
    assert whole == cut and whole[1]["w"] == 5


def test_flows_between_kinds_equal_single_rows():
    """The greatest weight, and of that the most pairs, as rows one by one have it; no row twice."""
    rng = np.random.default_rng(7)
    for t in range(400):
        n, m = rng.integers(1, 6, 2)
        cells = [(i, j) for i in range(n) for j in range(m) if rng.random() < 0.6] or [(0, 0)]
        g, p = (np.array(x) for x in zip(*cells, strict=True))
        w, n_gold, n_pred = rng.choice(((900, 1000), (0, 5), (9, 10))[t % 3], len(cells)), rng.integers(1, 6, n), rng.integers(1, 6, m)
        rows = [(k, i * 10 + a, j * 10 + b) for k, (i, j) in enumerate(cells) for a in range(n_gold[i]) for b in range(n_pred[j])]
        k, gold, pred = (np.array(x) for x in zip(*rows, strict=True))
        best = evaluation.best_pairs(gold, pred, w[k] * 1000 + (w[k] > 0))
        got = [(g[e] * 10 + a + d, p[e] * 10 + b + d, w[e]) for e, a, b, many in evaluation.best_flows(g, p, w, n_gold[g], n_pred[p]) for d in range(many)]
        assert sum(x[2] for x in got) == w[k][best].sum() and len({x[0] for x in got}) == len({x[1] for x in got}) == len(got) == len(best)
        assert {x[:2] for x in got} <= set(zip(gold.tolist(), pred.tolist(), strict=True))


def test_rows_that_are_alike_are_assigned_without_their_pairs(spark):
    """30,000 x 20,000 equal rows are 6 x 10^8 pairs; one kind of each side, and one more that competes, are two."""
    gold = spark.range(30_000).select(F.lit(1).cast("long").alias("episode_no"), F.col("id").alias("ordinal"), F.lit("n").alias("name"), F.lit("k").alias("fact_key"), F.array(F.lit("a")).alias("accepted_keys"))
    pred = spark.range(25_000).select(F.lit(1).cast("long").alias("episode_no"), (F.col("id") + 7).alias("ordinal"), F.lit("n").alias("name"), F.when(F.col("id") % 5 == 0, "a").otherwise("k").alias("key"))
    gold, pred = evaluation.with_kinds(gold, ("name", "fact_key", "accepted_keys")), evaluation.with_kinds(pred, ("name", "key"))
    pairs = evaluation.identity_pairs(gold.filter("kind_place = 0"), pred.filter("kind_place = 0"))
    assert pairs.count() == 2
    got = evaluation.assign_kinds(gold, pred, pairs).agg(F.count(F.lit(1)), F.sum("weight"), F.countDistinct("gold_ordinal"), F.countDistinct("pred_ordinal")).first()
    assert tuple(got) == (25_000, 20_000 * 1000 + 5_000 * 900, 25_000, 25_000)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)] + [(7000, 7000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


# -- vector index


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """The embeddings with what chunks have, and 3,000 vectors around 30 centres."""
    chunks = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "label", (F.col("vec_id") % 50).alias("episode_no"), "embedding")
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    near = [(i, 0, i % 50, [float(x) for x in centres[i % 30] + 0.4 * rng.normal(size=16)]) for i in range(3000)]
    folder = str(tmp_path_factory.mktemp("index"))
    out = {"given": chunks, "near": spark.createDataFrame(near, "vec_id long, label int, episode_no long, embedding array<float>")}
    for name, rows in out.items():
        ann.build(rows, f"{folder}/{name}")
    return folder, out


@pytest.mark.parametrize(("name", "nprobe"), [("given", None), ("near", 8)])
def test_index_recall(spark, index, name, nprobe):
    """Recall at 10 of at least 0.9 for wide and selective filters: near-random vectors at the default, clustered ones with 8 of 55 cells."""
    folder, tables_ = index
    rows = {r["vec_id"]: r["embedding"] for r in tables_[name].filter("vec_id % 400 = 0").collect()}
    for where in (None, F.col("episode_no") < 5):
        hits = total = 0
        for i, q in rows.items():
            q = [x + 0.05 * ((i * 31 + k) % 7 - 3) / 3 for k, x in enumerate(q)]
            wanted = {r["vec_id"] for r in vector.top_k(tables_[name], q, 10, where=where).collect()}
            hits += len(wanted & {r["vec_id"] for r in ann.search(spark, f"{folder}/{name}", q, 10, nprobe=nprobe, where=where).collect()})
            total += len(wanted)
        assert hits / total >= 0.9, (name, hits, total)


def test_index_is_exact_with_all_cells_and_refills(spark, index, tmp_path):
    folder, tables_ = index
    q = [((k * 37 % 64) - 32) / 32 for k in range(64)]
    key = lambda df: [(r["vec_id"], round(r["similarity"], 9)) for r in df.collect()]
    options = {"where": F.col("label") < 6, "episode_range": (5, 40), "exclude": tables_["given"].filter("vec_id % 13 = 0")}
    assert key(ann.search(spark, f"{folder}/given", q, 25, nprobe=10**6, **options)) == key(vector.top_k(tables_["given"], q, 25, **options))
    # one cell at first, and a filter that few rows pass: the search goes on until there are enough
    few = {"where": F.col("vec_id") % 40 == 3}
    assert key(ann.search(spark, f"{folder}/given", q, 40, nprobe=1, **few)) == key(vector.top_k(tables_["given"], q, 40, **few))
    assert ann.search(spark, f"{folder}/given", q, 5, where=F.lit(False)).count() == 0
    for bad in (dict(query=[], k=1), dict(query=q, k=0), dict(query=q, k=1, episode_range=(3, 2))):
        with pytest.raises(ValueError):
            ann.search(spark, f"{folder}/given", bad.pop("query"), bad.pop("k"), **bad)
    # copies, vectors without length, nulls, and a table of one row
    odd = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(60, [0.0, 0.0]), (61, None), (62, [0.0, -1.0]), (63, [1.0, 1e-4])], "vec_id long, embedding array<double>")
    ann.build(odd, str(tmp_path / "odd"))
    got = ann.search(spark, str(tmp_path / "odd"), [1.0, 0.0], 60, refill=1)
    assert key_null(got) == key_null(vector.top_k(odd, [1.0, 0.0], 60)) and key_null(ann.search(spark, str(tmp_path / "odd"), [1.0, 0.0], 3)) == [(0, 1.0), (1, 1.0), (2, 1.0)]
    with pytest.raises(ValueError, match="cell"):
        ann.build(odd.withColumn("cell", F.lit(1)), str(tmp_path / "x"))
    ann.build(odd.filter("vec_id = 61"), str(tmp_path / "none"))
    assert ann.search(spark, str(tmp_path / "none"), [1.0, 0.0], 3).count() == 0


def key_null(df):
    return [(r["vec_id"], r["similarity"] and round(r["similarity"], 9)) for r in df.collect()]


# -- tables


def test_only_touched_files_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 400, 1, 8).select("id", F.lit("old").alias("v"), F.lit(None).cast("string").alias("e")).write.parquet(path)
    files = lambda: {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.startswith(("part-", "update-"))}
    before = files()
    for bad in ([(1, "x"), (1, "y")], [(1, "x"), (9999, "y")]):
        with pytest.raises(ValueError, match="repeated or missing"):
            tables.update_files(spark, path, spark.createDataFrame(bad, "id long, e string"), "id")
    with pytest.raises(ValueError, match="lacks"):
        tables.update_files(spark, path, spark.createDataFrame([(1, 1)], "id long, z int"), "id")
    assert files() == before
    assert tables.update_files(spark, path, spark.createDataFrame([(3, "x"), (5, "y"), (399, "z")], "id long, e string"), "id") == 2
    after = files()
    assert len(set(before) - set(after)) == 2 and all(after[f] == t for f, t in before.items() if f in after)
    rows = {r["id"]: (r["v"], r["e"]) for r in spark.read.parquet(path).collect()}
    assert len(rows) == 400 == spark.read.parquet(path).count() and {i: x[1] for i, x in rows.items() if x[1]} == {3: "x", 5: "y", 399: "z"} and {x[0] for x in rows.values()} == {"old"}
    # an update that was interrupted after its commit is finished, one before it is dropped
    aside = tmp_path / "t" / "_update-abc"
    spark.createDataFrame([(7, "new", "w")], "id long, v string, e string").coalesce(1).write.parquet(str(aside / "rows"))
    [new] = [f for f in os.listdir(aside / "rows") if f.startswith("part-")]
    tables.finish_updates(spark, path)
    assert not aside.exists() and spark.read.parquet(path).count() == 400
    spark.createDataFrame([(777, "new", "w")], "id long, v string, e string").coalesce(1).write.parquet(str(aside / "rows"))
    [new] = [f for f in os.listdir(aside / "rows") if f.startswith("part-")]
    (aside / "journal").write_text(json.dumps({"new": [f"file:{aside}/rows/{new}"], "old": []}))
    tables.finish_updates(spark, path)
    assert spark.read.parquet(path).count() == 401 and not aside.exists()


def test_a_replacement_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_by_key(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    tables.replace_by_key(spark.read.parquet(path).select("k", F.concat("v", F.lit("+")).alias("v")), path, "k", keys=[1, 2])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a+"), (2, "b+")]
    # rows that come out differently each time: what was written isn't deleted again
    tables.replace_by_key(spark.range(40).select((F.col("id") % 2 + F.round(F.rand()) * 2).cast("int").alias("k"), F.lit("x").alias("v")), path, "k", keys=[0, 1, 2, 3])
    assert spark.read.parquet(path).filter("v = 'x'").count() == 40


def test_version_is_that_of_the_canonical_json(spark):
    fields = "struct<decision:string,importance:string,entityName:string,factKey:string,factKeyAliases:array<string>,valueType:string,attributeValue:string,valueJson:string,evidenceQuotes:array<string>,note:string>"
    rows = [(2, "b.txt", [("EXTRACT", "MUST", "Mira \"q\" é/", "level", ["lv"], "NUMBER", "3", '{"b": 1, "a": [1.0, null]}', ["one\n", "둘"], None)]), (1, "a.txt", [("DO_NOT_EXTRACT", None, "Mira", None, [], None, None, None, [], "n")])]
    plain = [
        {"episodeNo": 1, "title": None, "sourceFile": "a.txt", "candidates": [{"decision": "DO_NOT_EXTRACT", "entity_name": "Mira", "accepted_fact_key_aliases": [], "evidence_quotes": [], "note": "n"}]},
        {"episodeNo": 2, "title": None, "sourceFile": "b.txt", "candidates": [{"decision": "EXTRACT", "importance": "MUST", "entity_name": "Mira \"q\" é/", "fact_key": "level", "accepted_fact_key_aliases": ["lv"], "value_type": "NUMBER", "attribute_value": "3", "value_json": {"b": 1, "a": [1.0, None]}, "evidence_quotes": ["one\n", "둘"]}]},
    ]
    body = json.dumps({"name": "naïve", "episodes": plain}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    got = tables.snapshot_version(spark.createDataFrame(rows, f"episodeNo int, sourceFile string, candidates array<{fields}>"), "naïve")
    assert got == f"notion-{sha256(body.encode()).hexdigest()[:12]}"


def test_report_and_gold_commands(spark, tmp_path):
    from inkwell import cli
    from tests.test_paged import page, put

    report = {"run": {"analysisModel": "m1", "semanticJudgeEnabled": True, "semanticJudgeModel": "j1"}, "dataset": {"name": "d", "version": "v", "episodeCount": 3}, "metrics": {"factF1": 0.5, "factRecall": None}, "counts": {"goldExtract": 7}, "matches": ["secret text"]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    cli.main(["report", "--report", str(tmp_path / "r.json"), "--output", str(tmp_path / "o" / "r.md"), "--machine-output", str(tmp_path / "m.json")])
    shown = (tmp_path / "o" / "r.md").read_text()
    assert all(x in shown for x in ("`d`", "`v`", "`3`개", "`m1`", "`j1`", "| Fact F1 | 50.00% |", "| Fact Recall | 판정 대기/대상 없음 |", "| EXTRACT 정답 | 7 |", "| Fact 정답 | 0 |"))
    assert json.loads((tmp_path / "m.json").read_text()) == {k: report[k] for k in ("run", "dataset", "metrics", "counts")} and "secret" not in shown
    put(tmp_path / "api", "a.json", [page(f"p{i}", i % 3 + 1, i) for i in range(9)])
    cli.main(["gold", str(tmp_path / "api"), str(tmp_path / "gold.json"), "--paged", "--episode", "1", "--episode", "3", "--name", "n"], spark)
    gold = json.loads((tmp_path / "gold.json").read_text())
    assert [(e["episodeNo"], len(e["candidates"])) for e in gold["episodes"]] == [(1, 3), (3, 3)] and gold["datasetVersion"].startswith("notion-") and tables.read_gold(spark, str(tmp_path / "gold.json"), spark.createDataFrame([("01화.txt", "t"), ("03화.txt", "t")], "file string, text string")).count() == 6
    with pytest.raises(ValueError, match="no annotation"):
        cli.main(["gold", str(tmp_path / "api"), str(tmp_path / "none.json"), "--paged", "--episode", "9", "--name", "n"], spark)


# -- prompts and numbers


def test_prompt_has_names_and_episode(spark, tmp_path):
    log = str(tmp_path / "p")

    def provider(text):
        with open(log, "a") as f:
            f.write(json.dumps(text) + "\n")
        return '{"candidates": []}'

    chunks = spark.createDataFrame([("c1", "the text", "w1", 4, "Dusk"), ("c2", "other", None, None, None)], "chunk_id string, chunk_text string, work_id string, episode_no long, episode_title string")
    known = spark.createDataFrame([("w1", "Mira"), ("w1", " Aron "), ("w1", "Mira"), ("w2", "Zed"), (None, "Nil")], "work_id string, name string")
    extraction.extract(extraction.with_known_names(chunks, known), provider, "rules", [{"schemaKey": "k"}]).count()
    asked = {t.split("\n")[-1]: t for t in map(json.loads, open(log))}
    assert asked["the text"].startswith("rules\n[") and '["Aron", "Mira"]' in asked["the text"] and '{"episode_no": 4, "episode_title": "Dusk"}' in asked["the text"]
    assert '["Nil"]' in asked["other"] and '{"episode_no": null, "episode_title": null}' in asked["other"]
    head = os.path.commonprefix(list(asked.values()))
    assert "schemaKey" in head and "Mira" not in head


def test_numbers_beyond_the_bound_are_null(spark):
    df = spark.createDataFrame([("9" * 38,), ("9" * 28,), ("Lv.3 x",)], "n string")
    assert [r[0] is None for r in df.select(T.parse_decimal(F.col("n"))).collect()] == [True, False, False]
