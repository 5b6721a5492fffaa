"""Language-model scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Counts. One pass turns the documents into postings: for each chunk of words and each token, the occurrences in training
documents and the (row, frequency) pairs of all documents. Counts are sums over the postings, and each document's sum of
log counts comes from joining the postings back to the counts, so no vocabulary of unbounded size is ever broadcast. A token
has one posting a chunk, however frequent it is, so frequent words don't skew the join.

Model. A word is a path of classes. Its first class is one of CLASSES: the end of text, each of the most frequent training words by
itself, or one of GROUPS groups into which the hash deals all other words. A group has B subgroups and each of these B slots, so
there are GROUPS B^2 slots; B is the fourth root of the number of words that are dealt out, over 3, so the modelled vocabulary
grows with the square root of the corpus' (20,736 slots for 400,000 words, a million for a milliard) and the branches of a token
only with its fourth root. The context is the first classes of the two tokens before: h = R[w1] C1 + R[w2] C2, and P(w | h) is
the product of log-bilinear softmaxes, one at each level: of h Q[c] + b[c] over the classes, the subgroups and the slots. Within
its slot a word has its smoothed share, and all unknown words of a slot together that of one word without occurrences. So the
score is a probability over all texts, normalised exactly: the normalisers of the first level's classes^2 contexts come from
batched matrix products on the driver, whose size doesn't depend on the data, those of the lower levels from products of all
tokens of a group.

Training covers every training token. Each task runs NCE over its own documents from a common start (Adagrad; on the first level
noise from the shares of the classes, shared by a minibatch, equal trigrams of a chunk folded into a weight; on the lower levels
uniform noise, shared by the tokens of a group), and the parameters are averaged by tokens, in blocks. Tasks are at most
TRAIN_TASKS, so what they send doesn't grow beyond that. The scores depend a little on how the files are split into tasks, as
the averaged parameters do; the base scores and counts don't.

Tokens are 64-bit hashes of words; two of n distinct words share one with probability n^2 / 2^65. Rows are told apart by a
64-bit hash of doc_id and text.

Defined results. Null text: empty, so only the end token. No training rows: N = V = 0, uniform classes. Repeated rows: each is
scored alike. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common

FOLDS, HELD_OUT = 10, 0
CLASSES, GROUPS, DIM, NOISE, CHILD_NOISE, MINIBATCH, RATE, SEED = 768, 256, 16, 50, 8, 4096, 0.3, 3
TRAIN_TASKS = 4096
CHUNK_WORDS = 2_000_000
ALPHA = 0.1
END = 0
#: Holds a blank, so it is the hash of no word.
END_TOKEN = common.hash64(b" end")
PAIR = np.dtype([("row", "<i8"), ("tf", "<i4")])
SUM = np.dtype([("row", "<i8"), ("log_c", "<f8"), ("known", "<i8")])
BLOCKS = 64


def source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (common.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))


def chunks(batches: Iterator[pa.RecordBatch], of, train_only: bool = False) -> Iterator[tuple[list, list[int], list[bool], list[np.ndarray]]]:
    """doc ids, row keys, held-out flags and of(words), in chunks of about CHUNK_WORDS words."""
    out, n = ([], [], [], []), 0
    for batch in batches:
        for doc_id, text, held in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            doc_id, text, held = doc_id.as_py(), text.as_py(), held.as_py()
            if train_only and held:
                continue
            own = of(common.words(text))
            for to, x in zip(out, (doc_id, 0 if train_only else row_key(doc_id, text), held, own), strict=True):
                to.append(x)
            n += len(own) + 1
            if n >= CHUNK_WORDS:
                yield out
                out, n = ([], [], [], []), 0
    if out[0]:
        yield out


def row_key(doc_id: int | None, text: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(text, seed=xxhash.xxh3_64_intdigest(str(doc_id).encode()))
    return h - (1 << 64) if h >> 63 else h


def postings(docs: DataFrame) -> DataFrame:
    """(token, train, pairs): occurrences in training documents, and the packed (row, frequency) pairs of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = common.HashMemo()
        end = np.array([END_TOKEN], np.int64)
        for ids, keys, held, own in chunks(batches, memo.of):
            sizes = np.array([len(w) + 1 for w in own])
            h = np.concatenate([x for w in own for x in (w, end)])
            doc = np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            new_token = np.concatenate(([True], h[1:] != h[:-1]))
            pair = np.flatnonzero(new_token | np.concatenate(([True], doc[1:] != doc[:-1])))
            tf = np.diff(np.append(pair, len(h)))
            pairs = np.empty(len(pair), PAIR)
            pairs["row"] = np.array(keys, np.int64)[doc[pair]]
            pairs["tf"] = tf
            first = np.flatnonzero(new_token[pair])
            train = np.add.reduceat(tf * ~np.array(held, bool)[doc[pair]], first)
            offsets = (np.append(first, len(pair)) * PAIR.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])
            out = pa.record_batch([pa.array(h[pair[first]]), pa.array(train), packed], names=["token", "train", "pairs"])
            memo.trim()
            for k in range(0, out.num_rows, 100_000):
                yield out.slice(k, 100_000)

    return source(docs).mapInArrow(common.tidied(run), "token long, train long, pairs binary")


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    """One SUM record for each row."""
    x = np.concatenate(parts)
    keys, at = np.unique(x["row"], return_inverse=True)
    out = np.empty(len(keys), SUM)
    out["row"] = keys
    for k in ("log_c", "known"):
        out[k] = np.bincount(at, x[k], minlength=len(keys))
    return out


def sums(joined: DataFrame, buckets: int) -> DataFrame:
    """(row, rare_c, rare_known) for each row of the pairs of (pairs, c): the sums of tf * log10(c + ALPHA), and of tf where c > 0.

    Tasks hand on their partial sums packed by bucket of the row, so that a document isn't a record of its own in every task.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def flush() -> pa.RecordBatch:
            own = _fold(parts)
            bucket = (common.mix64(own["row"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own, bucket = own[order], bucket[order]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            return pa.record_batch([pa.array(bucket[first]), pa.array([x.tobytes() for x in np.split(own, first[1:])], pa.binary())], names=["bucket", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column(0)
            offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
            pairs = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(PAIR)
            c = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(offsets) // PAIR.itemsize)
            own = np.empty(len(pairs), SUM)
            own["row"], own["log_c"], own["known"] = pairs["row"], pairs["tf"] * np.log10(c + ALPHA), pairs["tf"] * (c > 0)
            parts.append(own)
            n += len(own)
            if n > 1_000_000:
                yield flush()
                parts, n = [], 0
        if parts:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for x in batch.column(1).to_pylist():
                parts.append(np.frombuffer(x, SUM))
                n += len(parts[-1])
                if n > 1_000_000:
                    parts = [_fold(parts)]
                    n = len(parts[0]) // 2  # a fold must at least halve what comes after it
        if parts:
            own = _fold(parts)
            yield pa.record_batch([pa.array(own["row"]), pa.array(own["log_c"]), pa.array(own["known"])], names=["row", "rare_c", "rare_known"])

    packed = joined.select("pairs", "c").mapInArrow(common.tidied(partial), "bucket long, sums binary")
    return packed.repartition(buckets // 4, "bucket").mapInArrow(common.tidied(total), "row long, rare_c double, rare_known long")


def branches(words: int) -> int:
    """B for so many words that are dealt out to slots."""
    return max(2, int(np.ceil(words**0.25 / 3)))


class Tree:
    """Ids of words: 0 ends a text, 1 to heads are words of their own class, then come the slots. Children of level 2 and 3 are numbered through."""

    def __init__(self, heads: int, classes: int, groups: int, b: int) -> None:
        self.heads, self.classes, self.groups, self.b = heads, classes, groups, b
        self.slots, self.children = groups * b * b, groups * b + groups * b * b

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids <= self.heads, ids, self.heads + 1 + (ids - self.heads - 1) // (self.b * self.b))

    def slot_of(self, ids: np.ndarray) -> np.ndarray:
        return ids - self.heads - 1

    def families(self, slots: np.ndarray) -> Iterator[tuple[slice, int, np.ndarray]]:
        """For sorted slots, the rows that share a parent, that parent's first child, and each row's place among its children, on both levels."""
        if not len(slots):
            return
        for level, width in ((0, self.b * self.b), (self.groups * self.b, self.b)):
            child = slots // (width // self.b)
            parent = slots // width
            starts = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            for x, y in zip(starts, [*starts[1:], len(slots)], strict=True):
                first = int(parent[x]) * self.b
                yield slice(x, y), level + first, child[x:y] - first


class Model:
    """Parameters of the log-bilinear model: `counts` by class and by slot give the start and the noise."""

    def __init__(self, counts: np.ndarray, tree: Tree | None = None, slot_counts: np.ndarray | None = None, dim: int = DIM, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        c = len(counts)
        self.q, self.tree = (counts + ALPHA) / (counts + ALPHA).sum(), tree
        self.parts = {
            "R": rng.normal(0, 0.1, (c, dim)).astype(np.float32), "C1": np.eye(dim, dtype=np.float32), "C2": 0.5 * np.eye(dim, dtype=np.float32),
            "Q": rng.normal(0, 0.1, (c, dim)).astype(np.float32), "b": np.log(self.q).astype(np.float32),
        }
        if tree:
            n = slot_counts.reshape(tree.groups, tree.b, tree.b) + 1.0
            share = np.concatenate(((n.sum(axis=2) / n.sum(axis=(1, 2))[:, None]).ravel(), (n / n.sum(axis=2)[..., None]).ravel()))
            self.parts |= {"W": rng.normal(0, 0.02, (tree.children, dim)).astype(np.float32), "d": np.log(share).astype(np.float32)}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts.values()])

    def unflat(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.parts.items():
            self.parts[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def train(self, chunks: Iterator[tuple[np.ndarray, np.ndarray]], noise: int = NOISE, rate: float = RATE, seed: int = SEED) -> int:
        """NCE over chunks (trigrams, slots): classes (w2, w1, w) packed as (w2 * C + w1) * C + w, and the slot of w or -1. Returns the tokens seen."""
        rng = np.random.default_rng(seed)
        past, tokens = {k: np.full_like(x, 1e-4) for k, x in self.parts.items()}, 0
        for packed, slots in chunks:
            tokens += len(packed)
            self._train_classes(packed, past, noise, rate, rng)
            if self.tree:
                dealt = np.flatnonzero(slots >= 0)
                size = 256 * (self.tree.groups + self.tree.groups * self.tree.b)
                rng.shuffle(dealt)
                for k in range(0, len(dealt), size):
                    self._train_children(packed[dealt[k : k + size]], slots[dealt[k : k + size]], past, rate, rng)
        return tokens

    def _train_classes(self, packed: np.ndarray, past: dict[str, np.ndarray], noise: int, rate: float, rng) -> None:
        c, p = len(self.q), self.parts
        log_kq = np.log(noise * self.q).astype(np.float32)
        cumulated = np.cumsum(self.q)

        def scatter(at: np.ndarray, g: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(at, g[:, j], minlength=c) for j in range(g.shape[1])], axis=1).astype(np.float32)

        distinct, times = np.unique(packed, return_counts=True)
        order = rng.permutation(len(distinct))
        for k in range(0, len(order), MINIBATCH):
            own = order[k : k + MINIBATCH]
            x, weight = distinct[own], times[own].astype(np.float32)
            weight /= weight.sum()
            w2, w1, w = x // (c * c), x // c % c, x % c
            r1, r2 = p["R"][w1], p["R"][w2]
            h = r1 @ p["C1"] + r2 @ p["C2"]
            z = np.minimum(np.searchsorted(cumulated, rng.random(noise)), c - 1)
            good = 1 / (1 + np.exp(-np.clip((h * p["Q"][w]).sum(axis=1) + p["b"][w] - log_kq[w], -30, 30)))
            bad = 1 / (1 + np.exp(-np.clip(h @ p["Q"][z].T + p["b"][z] - log_kq[z], -30, 30)))
            dg, db = ((good - 1) * weight).astype(np.float32), (bad * weight[:, None]).astype(np.float32)
            dh = dg[:, None] * p["Q"][w] + db @ p["Q"][z]
            grads = {"Q": scatter(w, dg[:, None] * h), "b": np.bincount(w, dg, minlength=c).astype(np.float32), "C1": r1.T @ dh, "C2": r2.T @ dh, "R": scatter(w1, dh @ p["C1"].T) + scatter(w2, dh @ p["C2"].T)}
            np.add.at(grads["Q"], z, db.T @ h)
            np.add.at(grads["b"], z, db.sum(axis=0))
            for name, g in grads.items():
                past[name] += g * g
                p[name] -= (rate if name not in ("C1", "C2") else rate / 5) * g / np.sqrt(past[name])

    def _train_children(self, packed: np.ndarray, slots: np.ndarray, past: dict[str, np.ndarray], rate: float, rng) -> None:
        c, p, b = len(self.q), self.parts, self.tree.b
        order = np.argsort(slots, kind="stable")
        packed, slots = packed[order], slots[order]
        h = p["R"][packed // c % c] @ p["C1"] + p["R"][packed // (c * c)] @ p["C2"]
        log_kq = np.float32(np.log(CHILD_NOISE / b))
        for rows, first, place in self.tree.families(slots):
            own, w, d = h[rows], p["W"][first : first + b], p["d"][first : first + b]
            z = rng.integers(0, b, CHILD_NOISE)
            err = 1 / (1 + np.exp(-np.clip(own @ w.T + d - log_kq, -30, 30)))  # of every child, true and noise ones are used
            g = err * np.bincount(z, minlength=b)
            at = np.arange(len(own))
            g[at, place] += err[at, place] - 1
            g = (g / len(own)).astype(np.float32)
            for name, x in (("W", g.T @ own), ("d", g.sum(axis=0))):
                past[name][first : first + b] += x * x
                p[name][first : first + b] -= rate / 10 * x / np.sqrt(past[name][first : first + b])

    def prepare(self) -> dict[str, np.ndarray]:
        """Tables for scoring: context halves, and the log normaliser of every context."""
        p = self.parts
        h1, h2 = p["R"] @ p["C1"], p["R"] @ p["C2"]
        base = h1 @ p["Q"].T + p["b"]  # what w1 adds, for every next class
        log_z = np.empty((len(h1), len(h1)), np.float32)
        for w2, extra in enumerate(h2 @ p["Q"].T):
            logits = base + extra
            top = logits.max(axis=1)
            log_z[w2] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
        return {"h1": h1, "h2": h2, "log_z": log_z} | {k: p[k] for k in ("Q", "b", "W", "d") if k in p}


def log_probability(tables: dict[str, np.ndarray], w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Natural log of P(class w | classes w2, w1)."""
    return ((tables["h1"][w1] + tables["h2"][w2]) * tables["Q"][w]).sum(axis=1) + tables["b"][w] - tables["log_z"][w2, w1]


def log_path(tables: dict[str, np.ndarray], tree: Tree, w2: np.ndarray, w1: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Natural log of P(slot | its group, classes w2, w1)."""
    order = np.argsort(slots, kind="stable")
    h, own = tables["h1"][w1[order]] + tables["h2"][w2[order]], slots[order]
    total = np.zeros(len(own))
    for rows, first, place in tree.families(own):
        logits = h[rows] @ tables["W"][first : first + tree.b].T + tables["d"][first : first + tree.b]
        top = logits.max(axis=1)
        total[rows] += logits[np.arange(len(place)), place] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))
    out = np.empty(len(own))
    out[order] = total
    return out


class Ids(dict):
    """word -> id in the tree."""

    def __init__(self, by_hash: dict[int, int], tree: Tree) -> None:
        super().__init__()
        self.by_hash, self.tree = by_hash, tree

    def __missing__(self, word: bytes) -> int:
        h = common.hash64(word)
        i = self[word] = self.by_hash.get(h) or self.tree.heads + 1 + h % self.tree.slots
        return i

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 400_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))

    @staticmethod
    def sequences(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The joined documents, each ended by END and begun by two END as context, and the documents' sizes without those."""
        sizes = np.array([len(w) + 1 for w in docs])
        begin, end = np.full(2, END, np.int32), np.full(1, END, np.int32)
        return np.concatenate([x for own in docs for x in (begin, own, end)]), sizes


def contexts(seq: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w2, w1, w) of every token of sequences()."""
    at = np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(1, len(sizes) + 1), sizes)
    return seq[at - 2], seq[at - 1], seq[at]


def train_model(docs: DataFrame, by_hash: dict[int, int], tree: Tree, counts: np.ndarray, slot_counts: np.ndarray) -> Model:
    """One pass over all training documents; see the module's docstring."""
    start = Model(counts, tree, slot_counts)
    shared = docs.sparkSession.sparkContext.broadcast((by_hash, tree, counts, slot_counts))
    size = len(start.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash, tree, counts, slot_counts = shared.value
        ids, model, c = Ids(by_hash, tree), Model(counts, tree, slot_counts), len(counts)

        def trigrams() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for *_, own in chunks(batches, ids.of, train_only=True):
                seq, sizes = ids.sequences(own)
                slots = np.maximum(contexts(tree.slot_of(seq), sizes)[2], -1)
                w2, w1, w = contexts(tree.class_of(seq).astype(np.int64), sizes)
                yield (w2 * c + w1) * c + w, slots

        tokens = model.train(trigrams())
        if tokens:
            parts = np.array_split(model.flat(), BLOCKS)
            yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([float(tokens)] * BLOCKS), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "tokens", "mean"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for block, tokens, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = total.setdefault(block, [0.0, 0.0])
                own[0] += tokens
                own[1] = own[1] + tokens * np.frombuffer(x, np.float32).astype(np.float64)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t for t, _ in total.values()]), pa.array([(x / t).astype(np.float32).tobytes() for t, x in total.values()], pa.binary())], names=["block", "tokens", "mean"])

    schema = "block int, tokens double, mean binary"
    rows = source(docs)
    if rows.rdd.getNumPartitions() > TRAIN_TASKS:
        rows = rows.coalesce(TRAIN_TASKS)
    rows = rows.mapInArrow(common.tidied(run), schema).repartition(16, "block").mapInArrow(common.tidied(add), schema).collect()  # BLOCKS rows
    shared.destroy()
    if rows:
        flat = np.concatenate([np.frombuffer(bytes(r["mean"]), np.float32) for r in sorted(rows, key=lambda r: r["block"])])
        assert len(flat) == size
        start.unflat(flat)
    return start


class Fitted:
    """What scoring needs: heads by hash with their counts, the tree, tables of the model, and log10 of what a slot is shared out over."""

    def __init__(self, docs: DataFrame, counted: DataFrame, classes: int = CLASSES, groups: int = GROUPS) -> None:
        """counted: (token, c) of the training documents, a table that has been written."""
        total = counted.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = int(total["n"] or 0), int(total["v"])
        top = counted.filter(F.col("token") != END_TOKEN).orderBy(F.desc("c"), "token").limit(classes - groups - 1).collect()
        ended = counted.filter(F.col("token") == END_TOKEN).first()
        self.has_end = bool(ended)
        self.by_hash = {r["token"]: i + 1 for i, r in enumerate(top)}
        self.listed = np.array([ended["c"] if ended else 0, *(r["c"] for r in top)], np.float64)
        self.tree = Tree(len(top), len(top) + 1 + groups, groups, branches(self.v - len(top) - self.has_end))
        rest = counted.join(self.heads(counted), "token", "left_anti")
        slots = rest.groupBy(F.pmod("token", F.lit(self.tree.slots)).alias("slot")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()  # one short row for each slot
        n, v = np.zeros(self.tree.slots), np.zeros(self.tree.slots)
        at = slots.column("slot").to_numpy()
        n[at], v[at] = slots.column("n").to_numpy(), slots.column("v").to_numpy()
        self.log_slot = np.log10(n + ALPHA * (v + 1))
        shares = np.concatenate((self.listed, n.reshape(groups, -1).sum(axis=1)))
        self.tables = train_model(docs, self.by_hash, self.tree, shares, n).prepare()

    def heads(self, like: DataFrame) -> DataFrame:
        """The tokens that have a class of their own."""
        return F.broadcast(like.sparkSession.createDataFrame([(t,) for t in [END_TOKEN, *self.by_hash]], "token long"))

    def log10(self, seq: np.ndarray, sizes: np.ndarray, batch: int = 500_000) -> np.ndarray:
        """log10 of P(class) and, for words that are dealt out, of P(slot | class) over what the slot is shared out over, for each token of sequences()."""
        c2, c1, c = contexts(self.tree.class_of(seq), sizes)
        ids = contexts(seq, sizes)[2]
        out = np.empty(len(ids))
        for k in range(0, len(ids), batch):
            part = slice(k, k + batch)
            own = log_probability(self.tables, c2[part], c1[part], c[part]).astype(np.float64)
            dealt = np.flatnonzero(ids[part] > self.tree.heads)
            slots = self.tree.slot_of(ids[part][dealt])
            own[dealt] += log_path(self.tables, self.tree, c2[part][dealt], c1[part][dealt], slots)
            own /= np.log(10)
            own[dealt] -= self.log_slot[slots]
            out[part] = own
        return out


def counts_of(posted: DataFrame) -> DataFrame:
    """(token, c): occurrences in training documents, written."""
    return common.materialize(posted.filter("train > 0").groupBy("token").agg(F.sum("train").alias("c")), "lm-counts")


def score(docs: DataFrame, classes: int = CLASSES, groups: int = GROUPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    posted = common.materialize(postings(docs), "lm-postings")
    counted = counts_of(posted)
    return scored(docs, posted, counted, Fitted(docs, counted, classes, groups))


def scored(docs: DataFrame, posted: DataFrame, counted: DataFrame, fitted: Fitted) -> DataFrame:
    # the tokens with a class of their own need no join
    rare = posted.join(fitted.heads(docs), "token", "left_anti").select("token", "pairs")
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = sums(rare.join(counted, "token", "left").withColumn("c", F.coalesce("c", F.lit(0))), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        heads, log_c = fitted.tree.heads, np.log10(fitted.listed + ALPHA)
        known = Ids(fitted.by_hash, fitted.tree)
        for ids, keys, held, own in chunks(batches, known.of):
            seq, sizes = known.sequences(own)
            w = contexts(seq, sizes)[2]
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            of = lambda x: np.add.reduceat(x, first)
            dealt = w > heads
            seen = sizes - of(dealt.astype(np.int64)) - (0 if fitted.has_end else 1)
            yield pa.record_batch([
                pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(held), pa.array(sizes), pa.array(seen),
                pa.array(of(np.where(dealt, 0.0, log_c[np.minimum(w, heads)]))), pa.array(of(fitted.log10(seq, sizes))),
            ], names=["row", "doc_id", "held_out", "n_tokens", "known", "log_c", "log_p"])

    rows = source(docs).mapInArrow(common.tidied(run), "row long, doc_id long, held_out boolean, n_tokens long, known long, log_c double, log_p double")
    absent = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rare = rare.select("row", absent("doc_id", "long"), absent("held_out", "boolean"), absent("n_tokens", "long"), absent("known", "long"), absent("log_c", "double"), absent("log_p", "double"), "rare_c", "rare_known")
    rows = rows.select("*", absent("rare_c", "double"), absent("rare_known", "long"))
    met = rows.union(rare).groupBy("row").agg(F.count("n_tokens").alias("copies"), *(F.max(c).alias(c) for c in rows.columns[1:]))
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))  # equal rows have one key
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("copies")
    base = float(np.log10(fitted.n + ALPHA * (fitted.v + 1)))
    return met.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.round(share("rare_known"))).cast("long").alias("n_known"), F.lit(fitted.n).cast("long").alias("train_tokens"),
        (F.col("log_c") + share("rare_c") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("log_p") + share("rare_c")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"))
