"""Benchmark decontamination with a distributed positional inverted index.

Index: the documents are dealt out in blocks as the scan brings them, and each block becomes one row of a table in the shared
folder: the sorted 64-bit hashes of its terms, and for each term the ascending positions at which it stands. Between two
documents one position stays free, so no match runs across them. The index holds all terms and is reread for any test set.

Query: the windows of the items are written as a table. Up to max_windows of them go to every task; more are dealt out in parts
of about max_windows, runs of an item's windows staying together, each of which is matched by a pass over the same index. A
part gives the hit intervals and items of each document that it hits; they are united by document before hit words are counted.
Corpus frequencies of the test terms come from one pass over the dictionaries of the index, so every window starts
from its rarest term: the positions of that term less its offset, intersected with the adjusted lists of the next rarest terms
until the list is empty or all terms are used.

Terms are compared by a 64-bit hash: a wrong match of a window needs as many simultaneous collisions as it has rare words.

Defined results. Null or empty text: no words, nothing hit. An item without words has no window; a shorter item is one window.
Repeated documents are judged each by itself; items with equal text all count. Null item_id: the item has no id to report and
is left out. Empty tables: no rows, or nothing hit. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common

WINDOW = 13
BLOCK_WORDS = 500_000
MAX_WINDOWS, RUN = 200_000, 1000

#: A-Z to a-z; ASCII that is no letter or digit to a blank; other bytes, all of characters beyond ASCII, stay.
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def build_index(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each block: its number, doc ids, row hashes and word counts of its documents; term hashes, list starts and positions."""
    names = ["ids", "hashes", "lengths", "terms", "starts", "positions"]

    def block(ids: list, keys: list, lengths: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array(lengths, np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        h = np.concatenate(hashes)
        at = np.arange(len(h)) + np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(h, kind="stable")
        h = h[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        assert not len(at) or at[-1] < 1 << 32, "block_words must stay below 2**32"
        assert len(first) == len(sizes)
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, h[starts], starts.astype(np.uint32), at[order].astype(np.uint32)))]
        return pa.record_batch(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = common.HashMemo()
        ids, keys, lengths, hashes, n = [], [], [], [], 0
        for batch in batches:
            for doc_id, text, key in zip(batch.column(0).to_pylist(), common.utf8(batch, "text"), batch.column(2).to_pylist(), strict=True):
                own = memo.of(terms(text))
                ids.append(doc_id)
                keys.append(key)
                lengths.append(len(own))
                hashes.append(own)
                n += len(own)
                memo.trim()
                if n >= block_words:
                    yield block(ids, keys, lengths, hashes)
                    ids, keys, lengths, hashes, n = [], [], [], [], 0
        if ids:
            yield block(ids, keys, lengths, hashes)

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), common.row_hash(docs["doc_id"], docs["text"]).alias("row_hash"))
    index = source.mapInArrow(common.tidied(run), "ids array<long>, hashes array<long>, lengths binary, terms binary, starts binary, positions binary")
    return index.withColumn("block", F.monotonically_increasing_id())


class Block:
    """Read side of an index row."""

    def __init__(self, ids, lengths, terms, starts, positions) -> None:
        self.ids = ids
        self.lengths, self.terms = np.frombuffer(lengths, np.int64), np.frombuffer(terms, np.int64)
        self.starts, self.positions = np.frombuffer(starts, np.uint32).astype(np.int64), np.frombuffer(positions, np.uint32)
        self.ends = np.append(self.starts[1:], len(self.positions))
        self.first = np.concatenate(([0], np.cumsum(self.lengths + 1)[:-1])) if len(self.lengths) else self.lengths

    def lists(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted term in the dictionary, -1 where the block lacks it."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def posting(self, k: int) -> np.ndarray:
        return self.positions[self.starts[k] : self.ends[k]].astype(np.int64)

    def phrase(self, lists: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Positions where the phrase begins: the lists of its terms, taken in the given order (rarest first), less their offsets."""
        at = self.posting(lists[order[0]]) - order[0]
        at = at[at >= 0]
        for k in order[1:]:
            if not len(at):
                break
            there = self.posting(lists[k])
            want = at + k
            i = np.minimum(np.searchsorted(there, want), len(there) - 1)
            at = at[there[i] == want]
        return at

    def near(self, lists: np.ndarray, slop: int) -> list[tuple[int, int]]:
        """Smallest spans (first, last position) within one document that hold every term, at most slop positions wide."""
        events = sorted((int(p), j) for j, k in enumerate(dict.fromkeys(lists.tolist())) for p in self.posting(k))
        need, have, count, left, out = len(set(lists.tolist())), {}, 0, 0, []
        for p, j in events:
            have[j] = have.get(j, 0) + 1
            count += have[j] == 1
            while count == need:
                start, i = events[left]
                if p - start + 1 <= slop and self.doc_of(start) == self.doc_of(p):
                    out.append((start, p))
                have[i] -= 1
                count -= have[i] == 0
                left += 1
        return out

    def doc_of(self, position):
        return np.searchsorted(self.first, position, side="right") - 1


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """(run, window, item): the windows of each item that has an id, as packed term hashes; run tells pieces of RUN windows of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = common.HashMemo()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), common.utf8(batch, "text"), strict=True):
                h = memo.of(terms(text))
                n = max(len(h) - size + 1, min(len(h), 1))
                for at in range(0, n, RUN):
                    own = [h[k : k + size].tobytes() for k in range(at, min(at + RUN, n))]
                    yield pa.record_batch([pa.array([at // RUN] * len(own), pa.int64()), pa.array(own, pa.binary()), pa.array([str(item)] * len(own))], names=["run", "window", "item"])
                memo.trim()

    items = benchmark.filter(benchmark["item_id"].isNotNull()).select(benchmark["item_id"].alias("item_id"), benchmark["text"].cast("string").alias("text"))
    return items.mapInArrow(common.tidied(run), "run long, window binary, item string")


def term_counts(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """How often each wanted term stands in the corpus, from the dictionaries of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms_, starts, n in zip(*(batch.column(c).to_pylist() for c in ("terms", "starts", "n")), strict=True):
                have, first = np.frombuffer(terms_, np.int64), np.frombuffer(starts, np.uint32).astype(np.int64)
                if len(have):
                    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                    total += np.where(have[at] == wanted, np.diff(np.append(first, n // 4))[at], 0)
        yield pa.record_batch([pa.array(wanted), pa.array(total)], names=["term", "n"])

    rows = index.select("terms", "starts", F.length("positions").cast("long").alias("n")).mapInArrow(common.tidied(run), "term long, n long")
    return {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row for each test term


def hits(index: DataFrame, windows: DataFrame, every: bool) -> tuple[DataFrame, Broadcast]:
    """(block, doc, doc_id, row_hash, n_words, spans, items) of the documents that windows (window, item) hit, or of every document.

    spans are the united word intervals that are hit, as packed pairs (begin, end). The windows go to every task.
    """
    owners: dict[bytes, set[str]] = {}
    for r in windows.toLocalIterator():
        owners.setdefault(bytes(r["window"]), set()).add(r["item"])
    found = [np.frombuffer(w, np.int64) for w in owners]
    wanted = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    counts = term_counts(index, wanted) if len(wanted) else {}
    rows = []
    for w in found:
        order = np.argsort([counts.get(int(t), 0) for t in w], kind="stable")
        rows.append((np.searchsorted(wanted, w), order, len(w)))
    shared = index.sparkSession.sparkContext.broadcast((wanted, rows, list(owners.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, rows, owners = shared.value
        width = max((n for _, _, n in rows), default=1)
        padded = np.full((len(rows), width), len(wanted))
        for i, (w, _, n) in enumerate(rows):
            padded[i, :n] = w
        for batch in batches:
            for block, keys, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "hashes", "ids", "lengths", "terms", "starts", "positions")), strict=True):
                b = Block(*row)
                lists = b.lists(wanted)
                present = np.append(lists >= 0, True)
                delta = np.zeros(int(b.first[-1] + b.lengths[-1]) + 2 if len(b.lengths) else 1, np.int64)
                items_of: dict[int, set[str]] = {}
                for i in np.flatnonzero(present[padded].all(axis=1)):
                    w, order, n = rows[i]
                    at = b.phrase(lists[w], order)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + n, -1)
                    for d in np.unique(b.doc_of(at)):
                        items_of.setdefault(int(d), set()).update(owners[i])
                # a document's words end before the free position, so each change from bare to hit and back lies within it
                change = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(delta) > 0).astype(np.int8))))).reshape(-1, 2)
                of = b.doc_of(change[:, 0])
                docs = range(len(b.ids)) if every else sorted(items_of)
                left, right = np.searchsorted(of, docs), np.searchsorted(of, docs, side="right")
                spans = [(change[x:y] - b.first[d]).tobytes() for d, x, y in zip(docs, left, right, strict=True)]
                yield pa.record_batch([
                    pa.array([block] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array([b.ids[d] for d in docs], pa.int64()), pa.array([keys[d] for d in docs], pa.int64()), pa.array([int(b.lengths[d]) for d in docs], pa.int64()),
                    pa.array(spans, pa.binary()), pa.array([sorted(items_of.get(d, ())) for d in docs], pa.list_(pa.string())),
                ], names=["block", "doc", "doc_id", "row_hash", "n_words", "spans", "items"])

    return index.mapInArrow(common.tidied(run), "block long, doc long, doc_id long, row_hash long, n_words long, spans binary, items array<string>"), shared


def match(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, row_hash, n_words, n_hit, n_items, items_sha256, contaminated, items) for every document of the index, a table that has been written."""
    windows = common.materialize(windows_of(benchmark, size), "decontam-windows")
    parts, found = max(-(-windows.count() // max_windows), 1), None
    for part in range(parts):
        own, shared = hits(index, windows.filter(F.pmod(F.xxhash64("item", "run"), F.lit(parts)) == part), part == 0)
        own = common.materialize(own, "decontam-hits")
        shared.destroy()
        found = own if found is None else found.union(own)
    if parts == 1:
        found = found.select("doc_id", "row_hash", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    else:
        same = (F.first(c).alias(c) for c in ("doc_id", "row_hash", "n_words"))
        found = found.groupBy("block", "doc").agg(*same, F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
        found = found.select("doc_id", "row_hash", "n_words", "spans", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, hit, listed = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int64), []
            for i, (spans, items) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                listed.append(sorted(set().union(*items)))
                x = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
                if len(x):
                    x = x[np.argsort(x[:, 0], kind="stable")]
                    end = np.maximum.accumulate(x[:, 1])
                    hit[i] = np.maximum(end - np.maximum(x[:, 0], np.append(0, end[:-1])), 0).sum()
            yield pa.record_batch([
                *batch.columns[:3], pa.array(hit), pa.array([len(x) for x in listed], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()), pa.array((hit > 0) & (20 * hit >= lengths)), pa.array(listed, pa.list_(pa.string())),
            ], names=["doc_id", "row_hash", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    return found.mapInArrow(common.tidied(run), "doc_id long, row_hash long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def proximity(index: DataFrame, phrase: str, slop: int) -> DataFrame:
    """(doc_id, start, end) of the smallest spans of a document, at most slop words wide, that hold all words of the phrase."""
    wanted = np.array([common.hash64(t) for t in terms(phrase.encode())], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "lengths", "terms", "starts", "positions")), strict=True):
                b = Block(*row)
                lists = b.lists(wanted)
                spans = b.near(lists, slop) if len(wanted) and (lists >= 0).all() else []
                docs = [int(b.doc_of(a)) for a, _ in spans]
                yield pa.record_batch([pa.array([b.ids[d] for d in docs], pa.int64()), pa.array([a - int(b.first[d]) for (a, _), d in zip(spans, docs, strict=True)], pa.int64()), pa.array([z - int(b.first[d]) for (_, z), d in zip(spans, docs, strict=True)], pa.int64())], names=["doc_id", "start", "end"])

    return index.mapInArrow(common.tidied(run), "doc_id long, start long, end long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    index = common.materialize(build_index(docs), "decontam-index")
    return match(index, benchmark, size)


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")).drop("row_hash", "items")


ORACLE = r"""
WITH f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT *, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM k)),
d AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM f, (SELECT DISTINCT k FROM k))),
h AS (SELECT doc_id, item_id, i, d.k FROM d JOIN v ON d.k = v.k AND d.g = v.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) AS contaminated
FROM f LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
