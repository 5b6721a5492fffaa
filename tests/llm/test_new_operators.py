"""Prefix trie, mixing and manifest against plain Python, with every edge case."""

import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from inkwell.llm import manifest, mixing, trie

H = lambda s: sha256(s.encode()).hexdigest()
TURN = "conv_id long, turn long, role string, text string, digest string, path string, n long"


# -- prefix trie


def plain_rebuilt(rows):
    """conv_id -> rebuilt turns."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def plain_trie(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        ends[tuple(p)].append(c)
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], H(",".join(map(str, sorted(ends[p]))))))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def turns_of(paths):
    return [(c, i, role, text, "x", "y", 1) for c, p in paths.items() for i, (role, text) in enumerate(p)]


@pytest.mark.parametrize("limit", [1, 6, 40, trie.LIMIT])
def test_trie_equals_plain(spark, limit):
    """At limits that split nothing, some and all first turns; long shared beginnings, copies, prefixes of others."""
    rng = random.Random(limit)
    long = [("user", f"l{i}") for i in range(30)]
    paths = {c: [("user", rng.choice("ab"))] + [("bot", rng.choice("cdé")) for _ in range(rng.randrange(5))] for c in range(1, 90)}
    paths |= {c: long + [("user", rng.choice("xy"))] * rng.randrange(3) for c in range(100, 130)} | {c: long[:7] for c in (200, 201)} | {c: long[:12] + [("bot", "z")] for c in (300, 5)}
    df = spark.createDataFrame(turns_of(paths), TURN)
    nodes = trie.trie(trie.digested(df), limit)
    assert told(nodes) == plain_trie(paths)
    shown = trie.with_texts(nodes, df).filter("depth = 1").select("role", "text").collect()
    assert {(r["role"], r["text"]) for r in shown} == {tuple(p[0]) for p in paths.values()}


def test_trie_query_equals_plain(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, rng.choice((None, i)), rng.choice((None, "user", "bot")), rng.choice((None, "", "Hé", "a" * 70_000)), "x", "y", 1) for c in rng.sample(range(60), 40) for i in range(rng.randrange(1, 11))]
    rows += rows[:7] + [(None, 1, "user", "lost", "x", "y", 1)]
    spark.createDataFrame(rows, TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    assert told(trie.query(spark, str(tmp_path))) == plain_trie(plain_rebuilt(rows))


def test_trie_of_nothing_and_of_turnless(spark):
    assert trie.trie(trie.digested(spark.createDataFrame([], TURN))).count() == 0
    rows = spark.createDataFrame([(1, 0, None, None), (2, 0, None, None)], "conv_id long, i long, digest string, bytes long")
    assert told(trie.trie(rows)) == [(1, 0, None, 2, 0, 1, 0, H("1,2"))]


def test_trie_ends_over_many_chunks(spark):
    """Thousands of copies: their ids stand in many chunks of one stream."""
    n = 3 * trie.CHUNK + 5
    rows = spark.range(7, 7 + n).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("i"), F.lit("a" * 32).alias("digest"), F.lit(3).cast("long").alias("bytes"))
    got = {r["depth"]: r for r in trie.trie(rows).collect()}
    assert got[1]["ends_sha256"] == H(",".join(map(str, range(7, 7 + n)))) and got[1]["saved_tokens"] == 3 * (n - 1) and got[1]["n_convs"] == n


# -- mixing


def plain_targets(sizes, weights, limit):
    """Sources in order -> target, by sharing again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        share = {s: limit * sizes[s] if s in full else rest * w[s] / free for s in names}
        more = {s for s in names if s not in full and share[s] > limit * sizes[s]}
        if not more:
            return share
        full |= more


def mixed(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size long, shard long, block string"), **options).collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(0.8) * 5) % 4000)), rng.choice(["a", "b", "c", "d", None, "z"][: rng.choice((3, 6))]), 1, 2, "x") for i in range(400)]
    rows += [(1000 + i, "one two", "tiny", 1, 2, "x") for i in range(3)] + [(7, "again", "é", 1, 2, "x")] * 5 + [(None, None, "none", 1, 2, "x"), (None, "a\x0bb", None, 1, 2, "x")]
    got = mixed(spark, rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for i, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len((t or "").split())) for i, t, *_ in rows)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    wanted = plain_targets(sizes, (1, 2, 3), 3)
    for s in sizes:
        assert target[s] == pytest.approx(wanted[s])
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]), s
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows)))
    assert sorted(map(str, got)) != sorted(map(str, mixed(spark, rows, seed="other")))


def test_mix_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 300)
    rows = [(i, "w " * (i % 50), "hot" if i % 3 else "cold", 1, 2, "x") for i in range(900)]
    got = mixed(spark, rows)
    for s in ("hot", "cold"):
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.05)
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_mix_of_nothing(spark, none):
    assert mixing.mix(none).count() == 0
    assert [(r["taken"], r["target"]) for r in mixed(spark, [(1, None, None, 1, 2, "x"), (2, "", "a", 1, 2, "x")])] == [(0, 0.0)] * 2


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(4)
    rows, wanted = [], {}
    for group in range(30):
        weights = [rng.choice((0, 1, 5, 5, 17, 1000.5, 3e6)) for _ in range(rng.randrange(1, 12))]
        seats = rng.choice((0, 1, 3, 40, 1001))
        won = [0] * len(weights)
        for _ in range(seats if any(weights) else 0):
            best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        for i, w in enumerate(weights):
            rows.append((group, i, float(w), seats))
            wanted[group, i] = won[i]
    df = spark.createDataFrame(rows, "g int, i int, w double, m long")
    assert {(r["g"], r["i"]): r["q"] for r in mixing.apportion(df, "w", "m", ["g"], ["i"], "q").collect()} == wanted


# -- manifest


def plain_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) -> sorted results of the query."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: H("".join(map(field, (i, source, lang, n, text))))
    low = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = defaultdict(list)
    for r in rows:
        shown = low(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], shown, *r[2:]), r[0]))

    def climb(nodes):
        tree = [nodes]
        while len(tree[-1]) > 1:
            tree.append([H("".join(tree[-1][a : a + 8])) for a in range(0, len(tree[-1]), 8)])
        return tree

    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([r[2] for r in sorted(by[x], key=lambda r: r[:3])]) for x in langs}
    top, out = climb([trees[x][-1][0] for x in langs]), []
    for g, x in enumerate(langs):
        for at, (_, _, own, now, doc_id) in enumerate(sorted(by[x], key=lambda r: r[:3])):
            proof, folded = "", now
            for tree, i in ((trees[x], at), (top, g)):
                for level in tree[:-1]:
                    run = level[i // 8 * 8 : i // 8 * 8 + 8]
                    proof += "".join(run[: i % 8] + run[i % 8 + 1 :])
                    folded = H("".join([*run[: i % 8], folded, *run[i % 8 + 1 :]]))
                    i //= 8
            out.append((doc_id, own, trees[x][-1][0], top[-1][0], H(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, id string, grp string, at string, number string, block string"
PROVEN = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("n", [1, 7, 65, 700])
def test_manifest_equals_plain(spark, tmp_path, n):
    """One group of a block, groups of many blocks, groups of one row, nulls in every column, repeated rows and ids."""
    rng = random.Random(n)
    rows = [(rng.choice((i, i // 3)), rng.choice((f"Text {i}", "É ß B", "low")), rng.choice(("en", "en", "en", "de")), "s", i) for i in range(n)]
    rows += [(None, "A", "en", None, None), (None, None, None, None, None), (3, "", "fr", "x", 1), (3, "X" * 70_000, "fr", "x", 1)] + [(6, "Same", "en", "s", 4)] * 20
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], DOC)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in PROVEN) for r in manifest.query(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False} or n < 65
    # a proof is what a reader needs
    proven = manifest.manifest(df, proofs=True)
    assert proven.filter((manifest.fold(F.col("leaf"), F.col("proof")) == F.col("root")) & F.col("verified")).count() == len(rows)


def test_manifest_of_higher_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "TOP", 3)
    assert manifest.height(3 * 64) == 2 and manifest.height(3 * 64 + 1) == 3
    rows = [(i, f"Word{i}", "en", "s", 1) for i in range(600)]
    spark.createDataFrame([(*r, *"abcdef") for r in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in PROVEN) for r in manifest.query(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_manifest(rows)
    many = spark.createDataFrame([(i, "t", f"l{i}", "s", 1, *"abcdef") for i in range(5)], DOC)
    with pytest.raises(ValueError, match="5 values"):
        manifest.manifest(many)


def test_manifest_of_nothing(none):
    assert manifest.manifest(none).count() == 0
