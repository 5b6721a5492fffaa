"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Words are hashed into an embedding table; filters of several widths slide over the words, each filter keeps its maximum over
the document, and a logistic layer reads the maxima. Only the winning positions carry gradient, so training is sparse (Adagrad
on the touched rows). The scores are then calibrated on rows that the training didn't see, at their natural shares.

Bounds (documented parameters): the fit uses at most `per_class` labelled documents of each class, the smallest hashes of
doc_id first, one text of each doc_id, and at most `max_words` words altogether (a word as five characters). It takes whole
documents; one that doesn't fit into what is left of the words is skipped, and those after it are still taken. Spark brings this
bounded sample to one task, which fits the model; the driver sees the model only. Labels come from rows whose crc32(doc_id)
mod 3 isn't 1 only. labels, lang, source and doc_id aren't inputs of a score. Thresholds by language are chosen on
calibration rows and only used by rejected(); the score itself knows no language.

Defined results. Null or empty text: the score of a document without words (the calibrated bias), in 0 to 1. No labels: score 0
for all. Labels of both kinds for one doc_id: the larger one counts. Several texts of one labelled doc_id: the fit takes the one
of the smallest hash. Repeated rows: each is scored. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common

FOLDS, HELD_OUT, CUT = 3, 1, 0.7
PER_CLASS, MAX_WORDS = 3_000, 4_000_000
BUCKETS, DIM, WIDTHS, FILTERS, PREFIXES = 1 << 17, 12, (1, 2, 3), 8, (3, 4, 5, 6, 7)
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.1, 7
PAD = max(WIDTHS) - 1
_STRIP = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))


class Vocabulary(dict):
    """word -> row of `table`, whose columns are the hashed buckets of the word and of its prefixes; row 0 and bucket 0 pad.

    A word's embedding is the sum of these buckets, so inflected forms share what is learned about their stem, and the word's
    own bucket can still set it apart. Punctuation around a word doesn't count.
    """

    def __init__(self) -> None:
        super().__init__()
        self.rows = array("i", [0] * (1 + len(PREFIXES)))

    def __missing__(self, word: bytes) -> int:
        w = word.strip(_STRIP).decode("utf-8", "ignore").lower()
        parts = [w, *(f"{w[:k]}*" if len(w) > k else "" for k in PREFIXES)]
        self.rows.extend(1 + common.hash64(x.encode()) % (BUCKETS - 1) if x else 0 for x in parts)
        i = self[word] = len(self.rows) // len(parts) - 1
        return i

    @property
    def table(self) -> np.ndarray:
        return np.array(self.rows, np.int32).reshape(-1, 1 + len(PREFIXES))

    def of(self, text: bytes | None) -> np.ndarray:
        own = common.words(text)
        out = np.zeros(max(len(own), 1) + PAD, np.int32)  # a text without words is one padding word
        out[: len(own)] = np.fromiter(map(self.__getitem__, own), dtype=np.int32, count=len(own))
        return out

    def trim(self, most: int = 200_000) -> None:
        """Between batches only: arrays made before lose their meaning."""
        if len(self) > most:
            self.clear()
            del self.rows[1 + len(PREFIXES) :]


class Model:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.03, (BUCKETS, DIM)).astype(np.float32)
        self.e[0] = 0
        self.w = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.float32(0)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def pooled(self, docs: list[np.ndarray], embedded: np.ndarray, where: bool = False):
        """embedded: the embedding of each row of the vocabulary. Maxima of all filters (and their positions in the joined words). Windows that begin in the padding don't count, but the first of each document does."""
        joined = np.concatenate(docs + [np.zeros(PAD, np.int32)])
        sizes = np.array([len(d) for d in docs])
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        x = embedded[joined]
        n = len(joined) - PAD
        real = np.maximum(sizes - PAD, 1)
        off = np.ones(n, bool)
        off[np.arange(int(real.sum())) + np.repeat(first - np.concatenate(([0], np.cumsum(real)[:-1])), real)] = False
        maxima, places = [], []
        for width, w, b in zip(WIDTHS, self.w, self.b, strict=True):
            conv = x[:n] @ w[:DIM]
            for k in range(1, width):
                conv += x[k : k + n] @ w[k * DIM : (k + 1) * DIM]
            conv += b
            conv[off] = -1e9
            top = np.maximum.reduceat(conv, first, axis=0)
            maxima.append(np.maximum(top, 0))
            if where:
                places.append(np.stack([first[i] + conv[first[i] : first[i] + sizes[i]].argmax(axis=0) for i in range(len(docs))]))
        return (np.concatenate(maxima, axis=1), places, joined) if where else np.concatenate(maxima, axis=1)

    def embed(self, table: np.ndarray) -> np.ndarray:
        return sum(self.e[column] for column in table.T)

    def logits(self, docs: list[np.ndarray], table: np.ndarray, batch_words: int = 100_000) -> np.ndarray:
        out, own, n, embedded = [], [], 0, self.embed(table)
        for d in docs:
            own.append(d)
            n += len(d)
            if n > batch_words:
                out.append(self.pooled(own, embedded) @ self.out + self.bias)
                own, n = [], 0
        if own:
            out.append(self.pooled(own, embedded) @ self.out + self.bias)
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def score(self, docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(docs, table) + self.shift, -50, 50)))

    def fit(self, docs: list[np.ndarray], table: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        ge, gw, gb, go, gbias = np.full(BUCKETS, 1e-6, np.float32), [np.full_like(w, 1e-6) for w in self.w], [np.full_like(b, 1e-6) for b in self.b], np.full_like(self.out, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                batch = [docs[i] for i in own]
                used, flat = np.unique(np.concatenate(batch), return_inverse=True)
                local = np.split(flat.astype(np.int32), np.cumsum([len(x) for x in batch])[:-1])
                embedded = self.embed(table[used])
                m, places, joined = self.pooled(local, embedded, where=True)
                p = 1 / (1 + np.exp(-np.clip(m @ self.out + self.bias, -30, 30)))
                d = ((p - labels[own]) / len(own)).astype(np.float32)
                dm = d[:, None] * self.out[None, :] * (m > 0)
                grad = m.T @ d
                go += grad**2
                self.out -= RATE * grad / np.sqrt(go)
                gbias += float(d.sum()) ** 2
                self.bias -= np.float32(RATE * d.sum() / np.sqrt(gbias))
                rows, parts = [], []
                for j, width in enumerate(WIDTHS):
                    dz, at = dm[:, j * FILTERS : (j + 1) * FILTERS], places[j]
                    ids = joined[at[..., None] + np.arange(width)]
                    x = embedded[ids].reshape(*at.shape, width * DIM)
                    dw = np.einsum("bf,bfk->kf", dz, x)
                    parts.append((dz[..., None] * self.w[j].T[None]).reshape(-1, DIM))
                    rows.append(table[used][ids.reshape(-1)])
                    gw[j] += dw**2
                    self.w[j] -= RATE * dw / np.sqrt(gw[j])
                    db = dz.sum(axis=0)
                    gb[j] += db**2
                    self.b[j] -= RATE * db / np.sqrt(gb[j])
                rows, parts = np.concatenate(rows), np.concatenate(parts)
                touched, inverse = np.unique(rows.ravel(), return_inverse=True)
                de = np.zeros((len(touched), DIM), np.float32)
                np.add.at(de, inverse.ravel(), np.repeat(parts, rows.shape[1], axis=0))
                ge[touched] += (de**2).mean(axis=1)
                self.e[touched] -= RATE * de / np.sqrt(ge[touched])[:, None]
                self.e[0] = 0

    def calibrate(self, docs: list[np.ndarray], table: np.ndarray, labels: np.ndarray, weights: np.ndarray, langs: list[str | None]) -> None:
        """Logistic scale and shift at the natural shares of the classes, and for each language the threshold with the best weighted F1."""
        z = self.logits(docs, table)
        a, c = 1.0, 0.0
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            g = np.array([(weights * (p - labels) * z).sum() + 1e-2 * (a - 1), (weights * (p - labels)).sum() + 1e-2 * c])
            r = weights * p * (1 - p)
            h = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-2]])
            step = np.linalg.solve(h, g)
            a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -2, 2)
        self.scale, self.shift = max(float(a), 0.05), float(c)
        score = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50)))
        names = np.array([x or "" for x in langs])
        for lang in sorted(set(names)):
            own = names == lang
            self.thresholds[lang] = best_threshold(score[own], labels[own], weights[own]) if (labels[own] == 1).sum() >= 20 else CUT


def best_threshold(score: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    grid = np.arange(0.3, 0.96, 0.05)
    f = [2 * (weights * labels * (score >= t)).sum() / max((weights * labels).sum() + (weights * (score >= t)).sum(), 1e-9) for t in grid]
    good = np.flatnonzero(np.array(f) >= max(f) - 0.002)
    return float(round(grid[good[np.argmin(np.abs(grid[good] - CUT))]], 2))


def sample(docs: DataFrame, labels: DataFrame, per_class: int, max_words: int) -> tuple[DataFrame | None, dict[int, int]]:
    """(h, toxic, lang, text) of the bounded sample, None where there is none, and the number of labelled ids of each class."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (common.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = [(r["doc_id"], c) for c in sorted(shares) for r in own.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    frame = lambda rows, schema: F.broadcast(docs.sparkSession.createDataFrame(rows, schema))  # noqa: E731  2 * per_class short rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("t", F.xxhash64("text"))
    # one text of each id; every task passes on one row of an id
    sizes = texts.join(frame(ids, "doc_id long, toxic int"), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("t", (F.coalesce(F.length("text"), F.lit(0)) / 5).alias("words"))).alias("x"))
    kept, left = [], float(max_words)
    for r in sorted(sizes.select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic", "x.t", "x.words").collect(), key=lambda r: (r["h"], r["doc_id"])):
        if r["words"] <= left:
            kept.append((r["doc_id"], r["t"], r["h"], r["toxic"]))
            left -= r["words"]
    if not kept:
        return None, shares
    found = texts.join(frame(kept, "doc_id long, t long, h long, toxic int"), ["doc_id", "t"])
    return found.groupBy("doc_id", "h", "toxic").agg(F.min(F.struct("lang", "text")).alias("x")).select("h", "doc_id", "toxic", "x.lang", "x.text"), shares


def fitted(rows: list[tuple], shares: dict[int, int]) -> Model:
    """The model of the sample's rows (h, doc_id, toxic, lang, text in UTF-8): fit on 3/4 of them, calibrated on the rest."""
    model, vocabulary = Model(), Vocabulary()
    rows = sorted(rows, key=lambda r: r[:2])
    x, y, langs = [vocabulary.of(r[4]) for r in rows], np.array([r[2] for r in rows], np.float32), [r[3] for r in rows]
    held = np.arange(len(x)) % 4 == 3
    fit = np.flatnonzero(~held)
    table = vocabulary.table
    model.fit([x[i] for i in fit], table, y[fit])
    rest = np.flatnonzero(held) if held.any() else fit
    weights = np.array([shares[int(c)] / max((y[rest] == c).sum(), 1) for c in y[rest]])
    weights = weights / weights.sum() * len(rest)
    model.calibrate([x[i] for i in rest], table, y[rest], weights, [langs[i] for i in rest])
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_words: int = MAX_WORDS) -> Model:
    """Fit on 3/4 of the bounded sample, calibrate on the rest, in one task."""
    chosen, shares = sample(docs, labels, per_class, max_words)
    if chosen is None:
        model = Model()
        model.scale, model.shift = 0.0, -50.0
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "toxic", "lang")), common.utf8(batch, "text"), strict=True)]
        yield pa.record_batch([pa.array([pickle.dumps(fitted(rows, shares))], pa.binary())], names=["model"])

    return pickle.loads(bytes(chosen.repartition(1).mapInArrow(common.tidied(run), "model binary").first()[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text"), model).withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop("text")


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs, all columns, with the score of its text."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = Vocabulary(), shared.value
        for batch in batches:
            vocabulary.trim()
            docs = [vocabulary.of(t) for t in common.utf8(batch, "text")]
            s = model.score(docs, vocabulary.table)
            yield pa.record_batch([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(common.tidied(run), schema)


def rejected(model: Model, score, lang):
    """Whether the score reaches the threshold of the row's language (CUT for a language without one), as a column."""
    out = F.lit(CUT)
    for name, t in model.thresholds.items():
        out = F.when(F.coalesce(lang, F.lit("")) == name, F.lit(t)).otherwise(out)
    return score >= out


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read(spark, sf_dir, "labels")))
