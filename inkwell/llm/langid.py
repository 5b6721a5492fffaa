"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text accepts exactly the substrings of that text. A text is parsed from the
left into the longest phrases that the automaton accepts; the language that needs the fewest phrases wins. A phrase costs
about the logarithm of the training length, so phrases times that logarithm is a code length, and the score is the posterior
that these code lengths give to the winner.

The automata are tables (state x symbol -> next state and phrases ended), and numpy steps all texts of a batch at once. The
alphabet holds every letter of the training text, of any script; each language's table knows its own letters. It is dense up to
DENSE cells and a sorted list of transitions above. A letter that a language's text lacks is a phrase by itself there.
Every text is parsed whole, in blocks of `block` characters each of which begins with a new phrase: the same rule at every
length, and a very long text is many lanes rather than one long loop.

Training is bounded by documented parameters: at most `sample_docs` documents and `chars` characters of each language, chosen
by a hash of doc_id. Documents are taken whole, and one that doesn't fit into what is left is skipped; only where none of a
language's documents fits, the shortest one gives its first `chars` characters. Beyond 8 languages the characters of each are
fewer, 8 chars / languages but 2,000 at least. Languages beyond `group` go into further parsers, each of which looks at all
texts; so the tables of a task stay bounded and any number of languages is compared. Training rows have a non-null lang and text
and crc32(doc_id) mod 4 != 2; repeated rows count once, and rows without a doc_id aren't used.
lang, source and doc_id aren't inputs of a prediction.

Defined results. Null text or no letter: "und" with score 0. Ties: the language that comes first in the alphabet. No training
rows at all: everything is "und" with score 0. Repeated rows: each is predicted. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import common

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS, CHARS, GROUP, BLOCK, DENSE = 60, 30_000, 128, 4096, 1 << 22
UNKNOWN, BREAK = 0, 1
_LETTER = regex.compile(r"\p{L}")


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts the substrings of symbols (Blumer et al. 1985)."""
    go: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Table:
    """A language's automaton: value 4 * (next state * width) + phrases ended, by state * width + symbol."""

    def __init__(self, symbols: np.ndarray, known: int, dense: int) -> None:
        letters = np.unique(symbols[symbols > BREAK])
        self.local = np.full(known, UNKNOWN, np.min_scalar_type(len(letters) + 1))
        self.local[BREAK] = BREAK
        self.local[letters] = np.arange(2, len(letters) + 2)
        a = len(letters) + 2
        go = suffix_automaton(self.local[symbols])
        root = np.full(a, -1, np.int64)
        for c, t in go[0].items():
            root[c] = t
        # no transition: the phrase ends, and the next begins with this symbol; an unknown symbol is a phrase by itself
        self.restart = np.where(root >= 0, 4 * a * root + 1, 2)
        if len(go) * a <= dense:
            out = np.tile(self.restart, (len(go), 1))
            for s, row in enumerate(go):
                for c, t in row.items():
                    out[s, c] = 4 * a * t
            out[0] = np.where(root >= 0, 4 * a * root, 1)
            self.dense = out.astype(np.int32).ravel()
        else:
            self.dense = None
            moves = np.array(sorted((s * a + c, 4 * a * t) for s, row in enumerate(go) for c, t in row.items()), np.int64)
            self.keys, self.values = moves[:, 0].copy(), moves[:, 1].copy()

    def step(self, state: np.ndarray, symbol: np.ndarray, at: np.ndarray) -> None:
        """state becomes the value of (state, symbol); at is scratch."""
        np.add(state, symbol, out=at)
        if self.dense is not None:
            np.take(self.dense, at, out=state, mode="clip")
            return
        i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        state[:] = np.where(self.keys[i] == at, self.values[i], np.where(state == 0, 1, self.restart[symbol]))


class Parser:
    """Alphabet and tables of all languages."""

    def __init__(self, texts: dict[str, str], block: int = BLOCK, dense: int = DENSE) -> None:
        self.alphabet = {c: i + 2 for i, c in enumerate(sorted({c for t in texts.values() for c in t.lower() if c.isalpha()}))}
        self.block = block
        codes = np.full(0x110000, BREAK, np.min_scalar_type(len(self.alphabet) + 1))
        codes[[i for i in range(0x110000) if chr(i).isalpha()]] = UNKNOWN
        for c, i in self.alphabet.items():
            codes[ord(c)] = i
        self.codes = codes
        self.languages = sorted(texts)
        self.cost = np.array([np.log(len(texts[x]) + 2) for x in self.languages])
        self.tables = [Table(self.symbols_of(texts[x]), len(self.alphabet) + 2, dense) for x in self.languages]

    def symbols_of(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text by language."""
        coded = [self.symbols_of(t) for t in texts]
        owner = np.concatenate([np.full(-(-len(c) // self.block), i) for i, c in enumerate(coded)]).astype(np.int64) if coded else np.zeros(0, np.int64)
        blocks = [c[k : k + self.block] for c in coded for k in range(0, len(c), self.block)]
        sizes = np.array([len(b) for b in blocks], np.int64)
        order = np.argsort(-sizes, kind="stable")
        owner, sizes = owner[order], sizes[order]
        out = np.zeros((len(texts), len(self.languages)))
        if not len(blocks):
            return out
        grid = np.zeros((int(sizes[0]), len(blocks)), self.codes.dtype)
        for lane, k in enumerate(order):
            grid[: sizes[lane], lane] = blocks[k]
        active = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")  # lanes longer than t
        for j, table in enumerate(self.tables):
            local = table.local[grid]
            state, count = np.zeros(len(blocks), np.int64 if table.dense is None else np.int32), np.ones(len(blocks), np.int32)
            at, ended = np.empty_like(state), np.empty_like(state)
            for t, n in enumerate(active):
                s, w, e = state[:n], at[:n], ended[:n]
                table.step(s, local[t, :n], w)
                np.bitwise_and(s, 3, out=e)
                count[:n] += e
                np.right_shift(s, 2, out=s)
            # in state 0 the block ended with an unknown symbol, and no phrase is open
            out[:, j] = np.bincount(owner, weights=count - (state == 0), minlength=len(texts))
        return out

    def codes_of(self, texts: list[str | None]) -> tuple[list[int], np.ndarray]:
        """The texts that have a letter, and their code lengths by language."""
        spoken = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        return spoken, self.phrases([texts[i] for i in spoken]) * self.cost if spoken else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text, among this parser's languages."""
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        spoken, bits = self.codes_of(texts)
        for i, own in zip(spoken, bits, strict=True):
            b = int(own.argmin())
            lang[i], score[i] = self.languages[b], float(1 / np.exp(own[b] - own).sum())
        return lang, score


def chosen_rows(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Which of (place, characters), in order, are taken whole within `most` characters, line breaks between them included; the shortest alone where none fits."""
    out, left = [], most
    for k, n in sizes:
        if n <= left:
            out.append(k)
            left -= n + 1
    return out or [min(sizes, key=lambda x: (x[1], x[0]))[0]] if sizes else []


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, chars: int = CHARS, group: int = GROUP) -> list[Parser]:
    """Parsers from the labelled documents of the training folds, within the documented bounds, for `group` languages each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    fit = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & (common.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    once = fit.groupBy("lang", "doc_id", "t").agg(F.max(F.length("text")).alias("n"))
    # each task passes on at most sample_docs rows of a language
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "t")
    found: dict[str, list] = {}
    for r in once.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample_docs).collect():
        found.setdefault(r["lang"], []).append(r)
    most = max(2_000, min(chars, 8 * chars // max(len(found), 1)))
    chosen = []
    for own in found.values():
        by = {r["k"]: r for r in own}
        chosen += [by[k] for k in chosen_rows(sorted((r["k"], r["n"]) for r in own), most)]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(r["lang"], r["doc_id"], r["t"], r["k"]) for r in chosen], "lang string, doc_id long, t long, k int")
    texts: dict[str, dict[int, str]] = {}
    for r in rows.join(F.broadcast(ids), ["lang", "doc_id", "t"]).groupBy("lang", "k").agg(F.min(F.substring("text", 1, most)).alias("text")).collect():
        texts.setdefault(r["lang"], {})[r["k"]] = r["text"]
    joined = {lang: "\n".join(t for _, t in sorted(own.items())) for lang, own in sorted(texts.items())}
    names = list(joined)
    return [Parser({x: joined[x] for x in names[k : k + group]}) for k in range(0, len(names), group)]


def identify(docs: DataFrame, parsers: list[Parser]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    if not parsers:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    state = "lang_pred string, bits double, odds double"
    rows = rows.select("*", F.lit("und").alias("lang_pred"), F.lit(None).cast("double").alias("bits"), F.lit(0.0).alias("odds"))

    def step(parser: Parser):
        shared = docs.sparkSession.sparkContext.broadcast(parser)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                lang, bits, odds = (batch.column(c).to_pylist() for c in ("lang_pred", "bits", "odds"))
                spoken, codes = shared.value.codes_of(texts)
                for i, own in zip(spoken, codes, strict=True):
                    b = int(own.argmin())
                    total = float(np.exp(own[b] - own).sum())  # of all languages' odds, relative to the best of this parser
                    if bits[i] is None or own[b] < bits[i]:
                        lang[i], odds[i], bits[i] = shared.value.languages[b], total + (odds[i] * np.exp(own[b] - bits[i]) if bits[i] is not None else 0.0), float(own[b])
                    else:
                        odds[i] += total * np.exp(bits[i] - own[b])
                yield pa.record_batch([*batch.columns[:3], pa.array(lang, pa.string()), pa.array(bits, pa.float64()), pa.array(odds, pa.float64())], names=batch.schema.names)

        return common.tidied(run)

    for parser in parsers:
        rows = rows.mapInArrow(step(parser), f"doc_id long, held_out boolean, text string, {state}")
    return rows.select("doc_id", "held_out", "lang_pred", F.when(F.col("odds") > 0, 1 / F.col("odds")).otherwise(0.0).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
