"""Quality rules, language models, language identification, toxicity and token counts."""

import collections
import zlib

import numpy as np
import pytest

from inkwell.llm import common, langid, lm, quality, tokens, toxicity


def held(i, n, k):
    return zlib.crc32(str(i).encode() if i is not None else b"") % n == k


def plain_quality(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_equals_plain_python(docs, odd):
    for df in (docs, odd):
        texts = collections.defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r["doc_id"]].append(r["text"])
        rows = quality.judge(df).collect()
        assert len(rows) == sum(map(len, texts.values()))
        for r in rows:
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            assert got in [plain_quality(t) for t in texts[r["doc_id"]]]
            assert not (r["kept"] and r["base_failed"])


def test_quality_thresholds_follow_the_group(spark):
    """What is usual in one source is an outlier in another; a small group leans on its language; a constant metric doesn't judge."""
    rng = np.random.default_rng(3)

    def text(share, n=60):
        return " ".join(w.upper() if rng.random() < share else w for w in (f"word{rng.integers(10**6)}" for _ in range(n)))

    rows = [(i, text(0.05), "en", "quiet") for i in range(300)] + [(1000, text(0.95), "en", "quiet")] + [(2000 + i, text(0.9), "en", "loud") for i in range(300)]
    rows += [(5000, text(0.05), None, "tiny"), (5001, text(0.5), "en", "tiny")] + [(6000 + i, "plain " + " ".join(f"w{i}x{k}" for k in range(40)), "xx", "same") for i in range(60)] + [(7000, "Plain " + " ".join(f"v{k}" for k in range(40)), "xx", "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert not kept[1000] and kept[5000] and kept[5001] and kept[7000]
    assert sum(kept[i] for i in range(300)) >= 297 and sum(kept[2000 + i] for i in range(300)) >= 297
    fences = {(r["lang"], r["source"]): r["t_upper_pm"] for r in quality.thresholds(common.materialize(quality.metrics(df), "t")).collect()}
    assert len(fences) == 5 and fences["en", "quiet"] < 500 < fences["en", "loud"]
    rest = sorted(map(tuple, df.filter(df["doc_id"].isin([i for i, k in kept.items() if k])).collect()), key=str)
    assert sorted(map(tuple, quality.kept_rows(df).collect()), key=str) == rest


def test_quality_fences_equal_plain_python(docs):
    """The verdict of every document, from exact blended histograms in plain Python."""
    rows = [r.asDict() for r in quality.judge(docs).collect()]
    counts = collections.defaultdict(collections.Counter)
    coarse = lambda v: v >> max(v.bit_length() - quality.DIGITS, 0) << max(v.bit_length() - quality.DIGITS, 0)
    for r in rows:
        if not r["base_failed"]:
            for m in quality.FENCES:
                for key in ((m,), (m, r["lang"]), (m, r["lang"], r["source"])):
                    counts[key][coarse(r[m])] += 1

    def fence(m, lang, source):
        q, spread = quality.FENCES[m]
        share = lambda c, b: sum(n for x, n in c.items() if x <= b)
        at, p = {}, quality.PRIOR
        for b in sorted(counts[m,]):
            below = share(counts[m,], b) / sum(counts[m,].values())
            for key in ((m, lang), (m, lang, source)):
                below = (share(counts[key], b) + p * below) / (sum(counts[key].values()) + p)
            for name, level in (("mid", 0.5), ("top", q / 100)):
                if below >= level:
                    at.setdefault(name, b)
        return at["top"] + spread * (at["top"] - at["mid"]) if at["top"] > at["mid"] else None

    fences = {(m, *g): fence(m, *g) for g in {(r["lang"], r["source"]) for r in rows if not r["base_failed"]} for m in quality.FENCES}
    for r in rows:
        beyond = not r["base_failed"] and any((f := fences[m, r["lang"], r["source"]]) is not None and r[m] > f for m in quality.FENCES)
        assert r["kept"] == (not r["base_failed"] and not beyond)
    assert any(not r["kept"] and not r["base_failed"] for r in rows)


def test_quality_of_nothing(none):
    assert quality.judge(none).count() == 0


def test_lm_counts_and_normalisation(docs, odd):
    for df in (docs, odd):
        data = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in df.select("doc_id", "text").collect()]
        c = collections.Counter(w for i, t in data if not held(i, 10, 0) for w in t)
        n, v = sum(c.values()), len(c)
        wanted = sorted((str(i), len(t), sum(c[w] > 0 for w in t), round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in data)
        rows = lm.score(df).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == wanted
        assert all(r["train_tokens"] == n and r["held_out"] == held(r["doc_id"], 10, 0) and r["score"] <= 0 for r in rows)


def test_lm_probabilities_sum_to_one():
    """Over all classes, and over the classes of single words with all slots of the groups."""
    rng = np.random.default_rng(0)
    tree = lm.Tree(2, 6, 3, 2)
    counts, slots = np.array([5.0, 3, 9, 2, 1, 4]), rng.integers(0, 9, 12).astype(float)
    model = lm.Model(counts, tree, slots)
    packed = rng.integers(0, 216, 5000)
    own = np.where(packed % 6 > 2, (packed % 6 - 3) * 4 + rng.integers(0, 4, 5000), -1)
    model.train(iter([(packed, own)] * 3))
    tables = model.prepare()
    for w2 in range(6):
        for w1 in range(6):
            p = np.exp(lm.log_probability(tables, np.full(6, w2), np.full(6, w1), np.arange(6)))
            assert abs(p.sum() - 1) < 1e-4
            q = np.exp(lm.log_path(tables, tree, np.full(12, w2), np.full(12, w1), np.arange(12)))
            assert np.allclose(q.reshape(3, 4).sum(axis=1), 1, atol=1e-4)
    ids = np.arange(15)
    assert tree.class_of(ids).tolist() == [0, 1, 2, *[3] * 4, *[4] * 4, *[5] * 4] and tree.slot_of(ids[3:]).tolist() == list(range(12))
    assert [lm.branches(n) for n in (0, 400_000, 10**9)] == [2, 9, 60]


def test_lm_learns_context():
    """After class 2 always comes class 3, and in its group the slot that goes with the class before: the model must say so, unlike the shares."""
    seq = np.tile([2, 3, 4, 4], 5000)
    w2, w1, w = seq[:-2], seq[1:-1], seq[2:]
    counts = np.bincount(seq, minlength=5).astype(float)
    model = lm.Model(counts)
    model.train(iter([((w2 * 5 + w1) * 5 + w, None)] * 120))  # equal trigrams are folded, so a chunk is a few steps
    got = lm.log_probability(model.prepare(), w2, w1, w).mean()
    assert got > np.log(counts[w] / counts.sum()).mean() + 0.5
    tree = lm.Tree(3, 5, 1, 2)  # classes 1 to 3 are words, class 4 is a group of four slots
    slots = np.where(w == 4, np.where(w1 == 3, 1, 2), -1)
    model = lm.Model(counts, tree, np.bincount(slots[slots >= 0], minlength=4).astype(float))
    model.train(iter([((w2 * 5 + w1) * 5 + w, slots)] * 120))
    at = slots >= 0
    assert lm.log_path(model.prepare(), tree, w2[at], w1[at], slots[at]).mean() > np.log(0.5) + 0.2


def test_lm_score_equals_brute_force(spark, docs, odd):
    """Each text's score from softmaxes written out token by token."""
    for df in (docs.limit(60), odd):
        df = common.materialize(df.select("doc_id", "text"), "t")
        posted = common.materialize(lm.postings(df), "t")
        counted = lm.counts_of(posted)
        fit = lm.Fitted(df, counted, 20, 4)
        c = {r["token"]: r["c"] for r in counted.collect()}
        t, tree = fit.tables, fit.tree
        mass = collections.defaultdict(float)
        for token, n in c.items():
            if token != lm.END_TOKEN and token not in fit.by_hash:
                mass[token % tree.slots] += n + 0.1
        softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

        def plain(text):
            first = second = 0  # classes of the words before
            total = 0.0
            for word in [*(text or "").encode().lower().split(), None]:
                h = lm.END_TOKEN if word is None else common.hash64(word)
                state = t["h1"][first].astype(float) + t["h2"][second]
                own = 0 if word is None else fit.by_hash.get(h)
                slot = h % tree.slots
                k = own if own is not None else tree.heads + 1 + slot // tree.b**2
                total += np.log10(softmax(t["Q"] @ state + t["b"])[k])
                if own is None:
                    two = slot // tree.b
                    for start, place in ((slot // tree.b**2 * tree.b, two % tree.b), (tree.groups * tree.b + two * tree.b, slot % tree.b)):
                        family = slice(start, start + tree.b)
                        total += np.log10(softmax(t["W"][family] @ state + t["d"][family])[place])
                    total += np.log10((c.get(h, 0) + 0.1) / (mass[slot] + 0.1))
                first, second = k, first
            return total

        rows = lm.scored(df, posted, counted, fit).collect()
        wanted = sorted((str(r["doc_id"]), plain(r["text"])) for r in df.collect() if len(r["text"] or "") < 20_000)
        short = {i for i, _ in wanted}
        got = sorted((str(r["doc_id"]), r["score"]) for r in rows if str(r["doc_id"]) in short)
        assert len(rows) == df.count() and [i for i, _ in got] == [i for i, _ in wanted]
        assert np.allclose([x for _, x in got], [x for _, x in wanted], rtol=1e-4, atol=1e-3)


def test_lm_of_nothing(none):
    assert lm.score(none).count() == 0


def plain_parse(text, train, block=4096):
    """Phrases of the longest matches in each block; other characters than letters are all alike."""
    bare = lambda t: "".join(c if c.isalpha() else "." for c in t.lower())
    train, n = bare(train), 0
    for k in range(0, len(text), block):
        own, at = bare(text)[k : k + block], 0
        while at < len(own):
            size = 1
            while at + size < len(own) and own[at : at + size + 1] in train:
                size += 1
            n, at = n + 1, at + size
    return n


def test_cross_parsing_equals_brute_force():
    train = {"a": "the cat sat on the mat, and the dog", "b": "el gato come pan y la vaca come pan"}
    parser = langid.Parser(train)
    rng = np.random.default_rng(1)
    texts = ["the cat", "el gato", "xyzzy the q", "z", "the catz"] + ["".join(rng.choice(list("thecat sonmdgl,q"), 40)) for _ in range(50)] + ["".join(rng.choice(list("thecat sonmdgl,q"), n)) for n in (4095, 4096, 4097, 9000)]
    for t, row in zip(texts, parser.phrases(texts), strict=True):
        assert row.tolist() == [plain_parse(t, train[x]) for x in parser.languages]


def test_every_letter_of_every_script_counts():
    """Letters beyond the most frequent ones, and beyond U+FFFF, tell languages apart, in dense and in sparse tables."""
    rng = np.random.default_rng(5)
    scripts = {"en": range(97, 123), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "zh": range(0x4E00, 0x4E00 + 900), "ja": range(0x3041, 0x3097), "gothic": range(0x10330, 0x10341)}
    words = {x: ["".join(chr(c) for c in rng.choice(list(own), rng.integers(2, 6))) for _ in range(400)] for x, own in scripts.items()}
    say = lambda x, n: " ".join(rng.choice(words[x], n))
    train = {x: say(x, 1500 if x == "gothic" else 2000) for x in scripts}
    texts = [say(x, 10) + "x" for x in scripts for _ in range(5)] + ["\u05d0\u05d1", " a"]
    got = langid.Parser(train)
    assert np.array_equal(got.phrases(texts), langid.Parser(train, dense=0).phrases(texts))
    assert got.predict(texts[:-2])[0] == [x for x in scripts for _ in range(5)]
    for t, row in zip(texts, got.phrases(texts), strict=True):
        assert row.tolist() == [plain_parse(t, train[x]) for x in got.languages]


def test_training_takes_whole_documents():
    assert langid.chosen_rows([(1, 70), (2, 90), (3, 20)], 100) == [1, 3]
    assert langid.chosen_rows([(1, 70), (2, 29)], 100) == [1, 2] and langid.chosen_rows([(1, 70), (2, 30)], 100) == [1]
    assert langid.chosen_rows([(1, 101), (2, 100), (3, 1)], 100) == [2] and langid.chosen_rows([(1, 500), (2, 300)], 100) == [2] and langid.chosen_rows([], 100) == []


def test_languages_of_four_scripts(spark):
    """Han, Hangul, Cyrillic and Latin, with an id repeated over many rows, in one parser and in parsers of a few languages each."""
    rng = np.random.default_rng(6)
    scripts = {"zh": range(0x4E00, 0x4E00 + 800), "ko": range(0xAC00, 0xAC00 + 600), "ru": range(0x430, 0x450), "en": range(97, 123)}
    words = {x: ["".join(chr(c) for c in rng.choice(list(own), rng.integers(2, 5))) for _ in range(300)] for x, own in scripts.items()}
    rows = [(100 * k + i, " ".join(rng.choice(words[x], 40)), x) for k, x in enumerate(scripts) for i in range(60)]
    repeated = (next(i for i in range(900, 1000) if not held(i, 4, 2)), " ".join(rng.choice(words["en"], 30)), "en")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").union(spark.range(5000).selectExpr(f"{repeated[0]}L", f"'{repeated[1]}'", "'en'"))
    parsers = langid.train(df)
    assert len(parsers) == 1 and parsers[0].languages == sorted(scripts)
    got = langid.identify(df.filter("doc_id < 900"), parsers).collect()
    truth = {i: x for i, _, x in rows}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]) >= 0.95
    again = langid.identify(df.filter("doc_id < 900"), langid.train(df, group=1)).collect()
    shown = lambda rows: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in rows)
    assert shown(got) == shown(again)


def test_language_accuracy(docs, spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs, langid.train(docs)).filter("held_out").collect()
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(odd, none, docs):
    rows = langid.identify(odd, langid.train(docs)).collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], r["lang_pred"]) for r in rows}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (11, "und")} <= by
    assert langid.identify(none, langid.train(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}


def test_toxicity_learns(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(300)]
    rows, truth = [], []
    for i in range(600):
        own, bad = list(rng.choice(base, 30)), bool(i % 4 == 0)
        if bad:
            own[rng.integers(30)] = str(rng.choice(["nastily", "nasty", "nastier"]))
        rows.append((i, " ".join(own), "en"))
        truth.append((i, 1, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    unseen = [r for r in got if r["held_out"]]
    assert len(got) == 600 and all(r["held_out"] == held(r["doc_id"], 3, 1) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]][2] for r in unseen]) >= 0.97


def separable(n, seed=2):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        own, bad = list(rng.choice(base, 30)), bool(i % 4 == 0)
        if bad:
            own[rng.integers(30)] = str(rng.choice(["nastily", "nasty", "nastier"]))
        rows.append((i, " ".join(own), "en", int(bad)))
    return rows


def test_toxicity_sample_is_bounded(spark):
    """A text of 20 million characters is skipped, and an id of many rows counts once."""
    rows = separable(400)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    long, many = (next(i for i in range(start, start + 99) if not held(i, 3, 1)) for start in (1000, 2000))
    df = df.union(spark.range(1).selectExpr(f"{long}L", "repeat('lorem ipsum dolor ', 1200000)", "'en'")).union(spark.range(10_000).selectExpr(f"{many}L", "concat('w1 w2 w', id % 3)", "'en'"))
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(long, 1, 0), (many, 1, 0)], "doc_id long, quality int, toxic int")
    chosen, shares = toxicity.sample(df, labels, toxicity.PER_CLASS, toxicity.MAX_WORDS)
    ids = sorted(r["doc_id"] for r in chosen.select("doc_id").collect())
    assert ids == sorted([r[0] for r in rows if not held(r[0], 3, 1)] + [many]) and sum(shares.values()) == len(ids) + 1
    assert toxicity.sample(df, labels, 20, toxicity.MAX_WORDS)[0].count() == 40
    got = toxicity.score(df.filter("doc_id < 400"), toxicity.train(df, labels)).filter("held_out").collect()
    assert np.mean([r["predicted"] == rows[r["doc_id"]][3] for r in got]) >= 0.97


def test_toxicity_scores_equal_naive_convolution():
    rng = np.random.default_rng(4)
    model, vocabulary = toxicity.Model(), toxicity.Vocabulary()
    model.e = rng.normal(0, 1, model.e.shape).astype(np.float32)
    model.e[0] = 0
    model.out, model.bias, model.scale, model.shift = rng.normal(0, 1, len(model.out)).astype(np.float32), np.float32(0.2), 0.7, -0.1
    texts = ["", "one", "Two words", "a b c d e f g", "Straße, naïve! naïvely", " ".join(f"w{i}" for i in rng.integers(0, 50, 400))]
    docs = [vocabulary.of(t.encode()) for t in texts]
    got = model.score(docs, vocabulary.table)
    strip = toxicity._STRIP.decode()

    def embedding(word):
        w = word.strip(strip).lower()
        parts = [w, *(w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k)]
        return sum((model.e[1 + common.hash64(p.encode()) % (toxicity.BUCKETS - 1)] for p in parts if p), np.zeros(toxicity.DIM))

    for text, s in zip(texts, got, strict=True):
        words = [embedding(w) for w in text.lower().split()]
        padded = words + [np.zeros(toxicity.DIM)] * 3
        maxima = []
        for width, w, b in zip(toxicity.WIDTHS, model.w, model.b, strict=True):
            for f in range(toxicity.FILTERS):
                maxima.append(max([0.0] + [float(sum(padded[i + k] @ w[k * toxicity.DIM : (k + 1) * toxicity.DIM, f] for k in range(width)) + b[f]) for i in range(max(len(words), 1))]))
        z = model.scale * (np.dot(maxima, model.out) + model.bias) + model.shift
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-4


def test_toxicity_edges(odd, none, labels):
    for df, y in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        rows = toxicity.score(df, toxicity.train(df, y)).collect()
        assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_encoding_equals_the_tokenizers_library(docs):
    texts = [r["text"] for r in docs.limit(60).collect()] + ["", " ", "a  b\n\n", "ß É 😀 日本語 <|endoftext|> x", "\u00a0\u2003x", "1234 12,5", "don't I'll", "\x00\x01"]
    for t in texts:
        ids = tokens.encode(t)
        assert ids.tolist() == tokens._plain().encode(t, add_special_tokens=False).ids
        assert tokens.spans(ids)[1].tolist()[-1:] in ([len(t.encode())], [])


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_adds_up(docs, odd, rule):
    for df in (docs.limit(50), odd):
        rows = tokens.attribute(df, "doc_id", ["text", "lang"], lines=True, rule=rule).collect()
        got = collections.Counter()
        for r in rows:
            got[r["doc_id"]] += r["n_tokens"]
        wanted = collections.Counter()
        for r in df.select("doc_id", "text", "lang").collect():
            wanted[r["doc_id"]] += len(tokens.encode((r["text"] or "") + (r["lang"] or "")))
        assert +got == +wanted


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_equal_brute_force(spark, docs, rule):
    """Each section's tokens, byte by byte, with ids of the tokenizers library and token bytes of the rank file."""
    by_id = {i: b for b, i in tokens._ranks().items()} | {i: t.encode() for t, i in tokens.SPECIAL.items()}
    rows = [(r["doc_id"], r["text"], "x y\n") for r in docs.limit(25).collect()] + [(-1, "hello\nworld 日本\n語\n\n a\n", "ly 😀"), (-2, "\n", None), (-3, None, "only\nfield two"), (-4, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    for lines in (True, False):
        wanted = {}
        for i, a, b in rows:
            sections = []
            for name, part in (("a", a), ("b", b)):
                pieces = part.encode().split(b"\n") if part else []
                pieces = [p + b"\n" for p in pieces[:-1]] + ([pieces[-1]] if pieces and pieces[-1] else []) if lines else [part.encode()] if part else []
                at = 0
                for k, p in enumerate(pieces):
                    sections.append((name, k, at, at + len(p)))
                    at += len(p)
            owner = [k for k, (*_, x, y) in enumerate(sections) for _ in range(y - x)]
            counts, at = collections.Counter(), 0
            for token in tokens._plain().encode((a or "") + (b or ""), add_special_tokens=False).ids:
                own = owner[at : at + len(by_id[token])]
                counts[own[0] if rule == "start" else max(sorted(set(own)), key=own.count)] += 1
                at += len(by_id[token])
            wanted |= {(i, *s): counts[k] for k, s in enumerate(sections)}
        got = {(r["doc_id"], r["field"], r["section"], r["start"], r["end"]): r["n_tokens"] for r in tokens.attribute(df, "doc_id", ["a", "b"], lines=lines, rule=rule).collect()}
        assert got == wanted


def test_crossing_tokens_follow_the_rule():
    ids = tokens.encode("hello worldly")
    first, last = tokens.spans(ids)
    cut = int(first[1]) + 1  # one byte into the second token
    ends = np.array([cut, int(last[-1])])
    assert tokens.allocate(ids, ends, "start").tolist() == [2, len(ids) - 2]
    assert tokens.allocate(ids, ends, "majority").tolist() == [1, len(ids) - 1]
    with pytest.raises(ValueError):
        tokens.allocate(ids, ends, "none")


def test_words_are_the_contracts_words():
    import re

    text = "A\x1cb\u00a0C d\x0be\x0cf\rg\u2003h".encode()
    assert common.words(text) == re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
