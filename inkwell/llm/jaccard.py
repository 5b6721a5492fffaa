"""N-gram Jaccard join: universe partition with the pigeonhole principle, exact.

Sets are the distinct word shingles of a text. If two sets are linked and the smaller one has l elements, they differ in at
most H(l) = l (100 - p) / p elements. For each band of sizes the universe of shingles is partitioned by hash into m0 + m1
segments, and the differences of a linked pair fall into few of them. An exact segment (m0) covers a difference of 0 and uses
up one unit of the budget; a one-deletion segment (m1, with a larger part of the universe) covers a difference of up to 1,
by indexing the segment and its one-deletion neighbourhood, and uses up two. With m0 + 2 m1 = H + 1 + slack, a set may leave
out segments that are too small to tell sets apart, up to `slack` units. Why no link is lost: take the set of the pair that
leaves out segments; what is left of its budget is above H, so some segment of it is covered, and the other set's part of it
is at most one smaller, so it is indexed too. If neither leaves out any, the same holds with the whole budget.

An exact segment all of whose shingles are common ones (of FREQUENT of the documents: license lines, passages) is left out too, as far as
the slack reaches: what is left out is told by the segment's content, which is the same in both sets where they agree, so the argument
holds, and a set that leaves out less than its partner has indexed all that its partner has. The table of common shingles is counted over
all documents, bounded, and only steers costs: any table gives the same links.

allocate() chooses m0, m1 and the smallest segment size by cost: index entries of a set, plus the wrong candidates that
its segments, of Poisson sizes, are expected to cause among all documents; so the segments grow with the corpus.

Groups of equal keys are sorted and streamed; in each, the first set is the hub and the pairs with it are verified first. Then the
groups get more hubs in rounds (64, 4096, ... of them) until all are used, so no link is missed; each pair is looked at once.
join() verifies every pair; components(), which returns no links, leaves out groups and pairs that the links found so far already
join, and after the first round no set of a group of over PART members meets all others: distant() finds such groups' pairs by an index of
how each set differs from what most sets of its group have. Every set has a bitmap with the parity of its elements' hashes: sets that differ in d elements have bitmaps that differ in
at most d bits, so the joins only let pass pairs whose bitmaps allow a link, and a group of near copies below the threshold isn't
expanded. Copies of a set are one node. Verification compares the whole sets, which are made again from the texts of the
candidates only.

Shingles, sets and keys are 64-bit hashes: two of n distinct sets share one with probability n^2 / 2^65.

Defined results. Null text or no words: empty set, n_shingles 0, a component by itself. Fewer words than a shingle: one shingle of
all of them. Repeated rows: each is returned. Null doc_id: never the smallest of a component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common, graph

SHINGLE, PERCENT = 5, 80
#: Cost model: the chance that a set has a given shingle of another one by accident, and the cost of a wrong candidate in index entries.
SHARED, WRONG = 0.001, 0.1
BITS, GROWTH = 512, 64
#: Members of a part of a group, when its hubs meet them.
PART = 256
#: How often a group is dealt anew by its differences, and of how many sets and elements, about, its centre is taken; they steer costs only.
DEPTH, SAMPLE, SAMPLED = 4, 512, 1 << 20
#: Common shingles: of this share of the documents, so many at most, counted in chunks of so many documents; slack for segments of them.
FREQUENT, COMMON, CHUNK, ROOM = 0.001, 1 << 18, 4000, 0.03
PAGE = 32768
BITMAP = [f"b{i}" for i in range(BITS // 64)]
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x1000003) for k in range(64)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a sequence of word hashes; of the whole sequence where it is shorter."""
    if not len(h):
        return np.zeros(0, np.uint64)
    w, width = h.astype(np.uint64), min(k, len(h))
    out = np.full(len(w) - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        out += w[j : j + len(out)] * _ODD[j % 64] if j < 64 else common.mix64(w[j : j + len(out)] + np.uint64(j))
    return np.unique(common.mix64(out))


def node_of(s: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def most_different(size: int, percent: int) -> int:
    return size * (100 - percent) // percent


@lru_cache(16)
def bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Smallest sizes of the bands, each about twice as wide as the sizes that can be linked."""
    out, ratio = [1], 1 + 2 * (100 - percent) / percent
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio) + 1))
    return np.array(out)


def _at_most(k: float, mean: float) -> float:
    """P(Poisson(mean) <= k)."""
    term, total = exp(-mean), 0.0
    for i in range(int(k) + 1):
        total += term
        term *= mean / (i + 1)
    return min(total, 1.0)


def _accidents(mean: float, least: int) -> float:
    """Chance that a segment of Poisson(mean) elements, more than least of them, stands in another set by accident, with nothing else in the segment there."""
    term, total = exp(-mean), 0.0
    for i in range(60):
        if i > least:
            total += term
        term *= mean * SHARED / (i + 1)
    return total * exp(-mean)


@lru_cache(4096)
def allocate(band: int, percent: int, documents: int) -> tuple[int, int, int, int, int] | None:
    """(m0, m1, weight of a one-deletion segment, smallest size, slack) of least cost; None where sets must be equal to be linked."""
    edges = bands(percent)
    low, high = int(edges[band]), int(edges[band + 1]) - 1
    need, best, cost = most_different(high, percent) + 1, None, float("inf")
    if need == 1:
        return None
    for least in range(-1, 6):
        for weight in (1, 2, 3):
            for share in (0, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75, 1):
                slack = 0
                while True:  # slack grows until it is enough or out of bounds
                    m1 = int(round(share * ceil((need + slack) / 2)))
                    m0 = max(need + slack - 2 * m1, 0)
                    k0 = low / (m0 + weight * m1)
                    p0, p1 = (_at_most(least, k0), _at_most(least + 1, weight * k0)) if least >= 0 else (0.0, 0.0)
                    wanted = ceil((m0 * (p0 + ROOM) if least >= 0 else 0) + 2 * m1 * p1 + 3 * sqrt(m0 * p0 * (1 - p0) + 4 * m1 * p1 * (1 - p1)))
                    if wanted <= slack or wanted > 4 * need:
                        break
                    slack = wanted
                if wanted > slack:
                    continue
                k1 = weight * k0
                wrong = m0 * _accidents(k0, least) + m1 * k1 * (1 + k1) * _accidents(k1, least)  # with one element less on either side
                now = m0 * (1 - p0) + m1 * (1 + k1) + documents * wrong * WRONG
                if now < cost:
                    best, cost = (m0, m1, weight, least, slack), now
    return best


def keys(s: np.ndarray, percent: int, documents: int, common_: np.ndarray | None = None) -> np.ndarray:
    """Index keys of a set in the bands of all smaller or equal sizes that can be linked with it. Even: a segment; odd: one with a deletion. common_: common shingles in order."""
    edges, out = bands(percent), []
    if common_ is None or not len(common_):
        often = np.zeros(len(s), bool)
    else:
        often = common_[np.minimum(np.searchsorted(common_, s), len(common_) - 1)] == s
    value = common.mix64(s + np.uint64(0x5851F42D4C957F2D))
    first = int(np.searchsorted(edges, -(-percent * len(s) // 100), side="right")) - 1
    for band in range(first, int(np.searchsorted(edges, len(s), side="right"))):
        plan = allocate(band, percent, documents)
        if plan is None:
            continue
        m0, m1, weight, least, slack = plan
        t = (s % np.uint64(m0 + weight * m1)).astype(np.int64)
        segment = np.where(t < m0, t, m0 + (t - m0) // weight)
        order = np.argsort(segment, kind="stable")
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[order], dtype=np.uint64)))
        size = np.bincount(segment, minlength=m0 + m1)
        ends = np.cumsum(size)
        sums = total[ends] - total[ends - size]
        exact = np.arange(m0 + m1) < m0
        units = int((size[:m0] <= least).sum()) + 2 * int((size[m0:] <= least + 1).sum())
        idle = exact & (size > least) & (size > 0) & (np.bincount(segment[often], minlength=m0 + m1) == size)
        skips = units <= slack
        if not skips or units + int(idle.sum()) > slack:
            idle[:] = False
        whole = np.flatnonzero((size > least) & ~idle) if skips else np.arange(m0 + m1)
        salt = common.mix64((np.uint64(band + 1) << np.uint64(40)) + np.arange(m0 + m1, dtype=np.uint64))
        out.append(common.mix64(sums[whole] ^ salt[whole]) & ~np.uint64(1))
        owner = segment[order]
        less = ~exact[owner] & (size[owner] > least + 1 if skips else True)
        out.append(common.mix64((sums[owner[less]] - value[order][less]) ^ salt[owner[less]]) | np.uint64(1))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    memo = common.HashMemo()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield part, [shingles(memo.of(common.words(t)), k) for t in common.utf8(part, "text")]
            memo.trim()


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of BITS places, as signed longs."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def possible(percent: int):
    """Condition on two rows (n, bits...) and (n_a, bits..._a): sizes and bitmaps allow a link."""
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_a"))) for b in BITMAP[1:]), F.bit_count(F.col(BITMAP[0]).bitwiseXOR(F.col(f"{BITMAP[0]}_a"))))
    sizes = 100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")
    return sizes & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("n_a")))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, row_hash, n_shingles, node, bitmap..., often): node is the hash of the set, null for the empty one.

    often, in the last row of each chunk of CHUNK documents: the shingles that several of its distinct sets have, and how many have each.
    """
    names = ["doc_id", "row_hash", "n_shingles", "node", *BITMAP, "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk, rows = None, {}, 0  # the last batch waits for its chunk's counts

        def counted(held: list) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([*chunk.values(), np.zeros(0, np.uint64)]), return_counts=True)
            packed = np.stack((found[n > 1].view(np.int64), n[n > 1]), 1).tobytes()
            return pa.record_batch([*held, pa.array([None] * (len(held[0]) - 1) + [packed], pa.binary())], names=names)

        for batch, sets in _sets(batches, k):
            if not len(sets):
                continue
            if held is not None:
                if rows >= CHUNK:
                    yield counted(held)
                    chunk, rows = {}, 0
                else:
                    yield pa.record_batch([*held, pa.nulls(len(held[0]), pa.binary())], names=names)
            nodes = [node_of(s) if len(s) else None for s in sets]
            held = [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), *(pa.array(x) for x in np.array([bitmap(s) for s in sets]).T.copy())]
            chunk |= zip(nodes, sets, strict=True)
            rows += len(sets)
        if held is not None:
            yield counted(held)

    return docs.select("doc_id", "text", common.row_hash(docs["doc_id"], docs["text"]).alias("row_hash")).mapInArrow(common.tidied(run), "doc_id long, row_hash long, n_shingles long, node long, " + ", ".join(f"{b} long" for b in BITMAP) + ", often binary")


def common_shingles(described: DataFrame, documents: int) -> np.ndarray:
    """The shingles of FREQUENT of all documents, by the counts of all chunks, COMMON at most, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                pairs = np.frombuffer(x, np.int64).reshape(-1, 2)
                for at in range(0, len(pairs), 50_000):
                    yield pa.record_batch([pa.array(pairs[at : at + 50_000, c]) for c in (0, 1)], names=["h", "n"])

    counts = described.filter("often is not null").select("often").mapInArrow(common.tidied(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = counts.filter(F.col("n") >= max(8, FREQUENT * documents)).orderBy(F.col("n").desc(), "h").limit(COMMON).select("h").toArrow()  # COMMON rows at most
    return np.sort(most.column("h").to_numpy().view(np.uint64)) if most.num_rows else np.zeros(0, np.uint64)


def entries(docs: DataFrame, k: int, percent: int, documents: int, common_: Broadcast | None = None) -> DataFrame:
    """(key, node) of every set; a task that meets a set again leaves the repeated entries out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, k):
            own, nodes = [], []
            for s in sets:
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    own.append(keys(s, percent, documents, common_.value if common_ else None))
                    nodes.append(node)
            if len(seen) > 500_000:
                seen.clear()
            if own:
                out = pa.record_batch([pa.array(np.concatenate(own)), pa.array(np.repeat(np.array(nodes, np.int64), [len(x) for x in own]))], names=["key", "node"])
                for at in range(0, out.num_rows, 50_000):
                    yield out.slice(at, 50_000)

    return docs.mapInArrow(common.tidied(run), "key long, node long")


def collisions(sorted_entries: DataFrame) -> DataFrame:
    """(key, node, rank, hub, fresh) for the sets that share a key with an earlier one; rank counts the sets that have the segment whole from 1, null for the others.

    Reads the entries of a partition in order, with a few numbers as state, so a group may be of any size. fresh: the task meets
    this node with this hub for the first time, as far as it remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_node = last_group = hub = None
        rank = 0  # whole segments of the group so far
        met: set[int] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.concatenate(([key[0] != last_key or node[0] != last_node], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            last_key, last_node = int(key[-1]), int(node[-1])
            key, node = key[fresh], node[fresh]
            if not len(key):
                continue
            group, whole = key >> 1, (key & 1) == 0
            begins = np.concatenate(([group[0] != last_group], group[1:] != group[:-1]))
            at = np.cumsum(begins) - 1  # -1: the group of the last batch goes on
            starts = np.flatnonzero(begins)
            has_hub = np.append(whole[starts], hub is not None)  # index -1 is the group that goes on
            hubs = np.append(node[starts], hub or 0)
            counted = np.cumsum(whole)
            before = np.append(counted[starts] - whole[starts], -rank)
            ranks = counted - before[at] - 1
            out = has_hub[at] & (node != hubs[at])
            if out.any():
                pair = (common.mix64(node[out]) ^ hubs[at][out].astype(np.uint64)).tolist()
                first = [x not in met and not met.add(x) for x in pair]
                if len(met) > 500_000:
                    met.clear()
                yield pa.record_batch([pa.array(group[out]), pa.array(node[out]), pa.array(ranks[out], mask=~whole[out]), pa.array(hubs[at][out]), pa.array(first, pa.bool_())], names=["key", "node", "rank", "hub", "fresh"])
            rank = int(counted[-1] - before[at[-1]])
            hub = int(hubs[at[-1]]) if has_hub[at[-1]] else None
            last_group = int(group[-1])

    return sorted_entries.mapInArrow(common.tidied(run), "key long, node long, rank long, hub long, fresh boolean")


def slots_for(candidates: int) -> int:
    """Slots of the bitmap of sets_of(): 64 for each candidate, within 2^20 to 2^32 (512 MB at most, from 67 million candidates on)."""
    return 1 << min(max(20, (64 * candidates).bit_length()), 32)


def sets_of(docs: DataFrame, candidates: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """(node, set) of the candidates, from the text of one document each, and of the few documents that share a slot with one.

    A bitmap of slots of doc_id and row_hash keeps other texts from being read into sets; its size follows the number of
    candidates, and a crowded bitmap would only let more texts pass. Each task gives a set once, as far as it remembers.
    """
    slots = slots_for(candidates.count())
    slot = F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(slots))
    rows = candidates.select(slot.alias("s")).groupBy(F.expr(f"s div {PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.col("s") % PAGE).alias("bits")).collect()  # at most slots / PAGE rows
    shared = docs.sparkSession.sparkContext.broadcast({r["page"]: bytes(r["bits"]) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(slots // 8, np.uint8)
        seen: set[int] = set()
        for page, x in shared.value.items():
            bits[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(x, np.uint8)

        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(0).to_numpy()
                yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

        for _, sets in _sets(wanted(), k):
            own = {node_of(s): s for s in sets if len(s)}
            own = {n: s for n, s in own.items() if n not in seen}
            seen.update(own)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.record_batch([pa.array(list(own), pa.int64()), pa.array([s.tobytes() for s in own.values()], pa.binary())], names=["node", "set"])

    rows = docs.withColumn("row_hash", common.row_hash(docs["doc_id"], docs["text"])).select(slot.alias("slot"), "text")
    return rows.mapInArrow(common.tidied(run), "node long, set binary"), shared


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.record_batch([c.filter(ok) for c in batch.columns[:2]], names=["a", "b"])

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    return full.select("a", "b", "x", "y").mapInArrow(common.tidied(run), "a long, b long")


def checked(docs: DataFrame, pairs: DataFrame, known: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b), written. Only the texts of sets that are in a pair are made into sets."""
    begun = common.written()
    pairs = common.materialize(pairs, "jaccard-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets, bits = sets_of(docs, common.materialize(known.select("node", "least.doc_id", "least.row_hash").join(nodes.hint("merge"), "node", "left_semi"), "jaccard-candidates"), k)
    sets = common.materialize(sets, "jaccard-texts")
    bits.destroy()
    links = common.materialize(verify(pairs, sets, percent), "jaccard-links")
    common.release(begun, keep=1)
    common.drop_shuffles(docs.sparkSession)
    return links


def with_known(rows: DataFrame, known: DataFrame, node: str, tag: str = "") -> DataFrame:
    """rows with size and bitmap of the column node. Both sides grow with the corpus: a merge join at every size."""
    return rows.join(known.select(F.col("node").alias(node), *(F.col(c).alias(f"{c}{tag}") for c in ("n", *BITMAP))).hint("merge"), node)


def parts_of(members: str):
    """Into how many parts a group of so many members is dealt."""
    return (1 + F.expr(f"{members} div {PART}")).cast("int")


def met(members: DataFrame, used: int, percent: int) -> DataFrame:
    """(a, b) of the hubs of a round, from rank `used` on, and the members of their groups that they may be linked with.

    members: key, node, rank, root, parts, n, bitmap. A group's members are dealt into its parts and each part meets all hubs of the round, so
    large groups make even tasks and Spark needn't split both sides of a skewed join, whose tasks are the product of the splits. The
    hubs that this repeats are fewer than the pairs by a factor of about PART.
    """
    hubs = members.filter(F.col("rank").between(used, GROWTH * used - 1)).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("root", "rank", "n", *BITMAP)))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts").withColumnRenamed("node", "b")
    # members with a smaller rank have been hubs themselves, or are in this round
    fresh = F.col("rank").isNull() | (F.col("rank") >= GROWTH * used) | F.col("rank").between(used, F.col("rank_a") - 1)
    return hubs.join(dealt.hint("merge"), (hubs["key"] == dealt["key"]) & (hubs["part"] == dealt["part"]) & (F.col("root") != F.col("root_a")) & fresh & possible(percent))


def centers(sampled: DataFrame) -> DataFrame:
    """(gid, k, often) of the sets (gid, set) that stand for a group: how many there are, and the elements that several have, with how many."""

    def run(table: pa.Table) -> pa.Table:
        found, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]), return_counts=True)
        packed = np.stack((found[n > 1].view(np.int64), n[n > 1]), 1).tobytes()
        return pa.table({"gid": table.column("gid").slice(0, 1), "k": pa.array([table.num_rows], pa.int64()), "often": pa.array([packed], pa.binary())})

    return sampled.groupBy("gid").applyInArrow(run, "gid long, k long, often binary")


def different(s: np.ndarray, k: int, often: bytes) -> np.ndarray:
    """The elements in which a set differs from its group's centre (what most of the k sets have), in an order that all sets of the group share: those in which few differ first."""
    table = np.frombuffer(often, np.int64).reshape(-1, 2)
    elements, n = table[:, 0].copy().view(np.uint64), table[:, 1]
    inside = 2 * n > k
    out = np.setxor1d(s, elements[inside], assume_unique=True)
    if len(elements):
        at = np.minimum(np.searchsorted(elements, out), len(elements) - 1)
        times = np.where(elements[at] == out, np.where(inside, k - n, n)[at], 0)
        out = out[np.lexsort((out, times))]
    return out


def reach(excess: int, least: int, d: int, n: int, percent: int) -> tuple[int, int]:
    """How many of the d first differences of a set of n elements are keys, for partners that are not near the centre and for those that are.

    excess of a set: (100 + p) d - (100 - p) n; least: the smallest of the group. Two sets are linked if (100 + p) |a ^ b| <= (100 - p) (n_a + n_b), and
    |a ^ b| = d_a + d_b - 2 (differences in common), so linked ones have at least (excess_a + excess_b) / 2 (100 + p) differences in common. Where
    excess_a + excess_b <= 0 they are linked for sure, and the set of least excess with either of them too: such sets are near.
    A partner that isn't near has an excess over -least. Nor can a set lack more of its differences in a partner than it may differ in.
    """
    twice, floor = 2 * (100 + percent), d - most_different(n, percent)
    far, near = (max(1, -(-x // twice), floor) for x in (excess - least + 1, excess + least))
    return max(0, d - far + 1), max(0, d - near + 1)


def differing(rows: DataFrame, percent: int) -> DataFrame:
    """(gid, node, root, n, bitmap..., excess, diff) of rows (gid, node, root, set, k, often); diff: the differences in order."""
    names = ["gid", "node", "root", "n", *BITMAP, "excess", "diff"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(3)]
            diff = [different(s, k.as_py() or 0, o.as_py() or b"") for s, k, o in zip(sets, batch.column(4), batch.column(5), strict=True)]
            excess = [(100 + percent) * len(d) - (100 - percent) * len(s) for s, d in zip(sets, diff, strict=True)]
            bits = np.array([bitmap(s) for s in sets], np.int64).reshape(-1, len(BITMAP)).T.copy()
            yield pa.record_batch([*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x) for x in bits), pa.array(excess, pa.int64()), pa.array([d.tobytes() for d in diff], pa.binary())], names=names)

    return rows.select("gid", "node", "root", "set", "k", "often").mapInArrow(common.tidied(run), "gid long, node long, root long, n long, " + ", ".join(f"{b} long" for b in BITMAP) + ", excess long, diff binary")


def postings(rows: DataFrame, percent: int) -> DataFrame:
    """(gid, e, node, root, n, bitmap..., near, short) of rows of differing() with the least excess of their group; short: a key for partners that aren't near, too."""
    kept = ["node", "root", "n", *BITMAP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                col = {c: part.column(c).to_pylist() for c in ("excess", "least", "n", "diff")}
                keys_, owner, short = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                near = np.array([e + x <= 0 for e, x in zip(col["excess"], col["least"], strict=True)], bool)
                for i, (excess, least, n, diff) in enumerate(zip(*col.values(), strict=True)):
                    own = np.frombuffer(diff, np.int64)
                    far, all_ = reach(excess, least, len(own), n, percent)
                    length = far if near[i] else all_
                    keys_.append(own[:length])
                    owner.append(np.full(length, i))
                    short.append(np.arange(length) < far)
                at_ = np.concatenate(owner)
                yield pa.record_batch([part.column("gid").take(pa.array(at_)), pa.array(np.concatenate(keys_)), *(part.column(c).take(pa.array(at_)) for c in kept), pa.array(near[at_]), pa.array(np.concatenate(short))], names=["gid", "e", *kept, "near", "short"])

    return rows.mapInArrow(common.tidied(run), "gid long, e long, node long, root long, n long, " + ", ".join(f"{b} long" for b in BITMAP) + ", near boolean, short boolean")


def distant(docs: DataFrame, members: DataFrame, known: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b), distinct, that hold a link of each component for the sets of large groups that have different roots.

    members: hub, node, root; those of one hub are a group. Each set is told by its differences from the group's centre. Sets near the centre are
    paired with the one of least excess; any other link joins sets that have differences in common, one of them among the first of both (reach()), so these
    are keys of smaller groups. Those of up to PART members are paired, larger ones are groups with a centre of their own; after DEPTH times what is left is paired.
    """
    begun = common.written()
    groups = common.materialize(members.select(F.col("hub").alias("gid"), "node", "root").distinct(), "jaccard-groups")
    wanted = known.select("node", "least.doc_id", "least.row_hash").join(groups.select("node").distinct().hint("merge"), "node", "left_semi")
    sets, bits = sets_of(docs, common.materialize(wanted, "jaccard-candidates"), k)
    # a text's copies are met by several tasks, and other texts may share a slot
    sets = common.materialize(sets.groupBy("node").agg(F.first("set").alias("set")), "jaccard-texts")
    bits.destroy()
    found = []
    for depth in range(DEPTH):
        sizes = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
        rows = common.materialize(groups.join(sizes.hint("merge"), "gid").join(sets.hint("merge"), "node"), "jaccard-grouped")
        share = F.greatest(F.lit(16), F.least(F.lit(SAMPLE), F.expr(f"{SAMPLED} div (1 + length(set) div 8)")))
        centre = common.materialize(centers(rows.filter(F.pmod(F.xxhash64("gid", "node"), F.col("m")) < share).select("gid", "set")), "jaccard-centres")
        rows = common.materialize(differing(rows.join(centre.hint("merge"), "gid", "left"), percent), "jaccard-differences")
        least = common.materialize(rows.groupBy("gid").agg(F.min(F.struct("excess", "node", "root")).alias("x")).select("gid", F.col("x.excess").alias("least"), F.col("x.node").alias("a"), F.col("x.root").alias("root_a")), "jaccard-least")
        rows = rows.join(least.hint("merge"), "gid")
        found.append(rows.filter((F.col("excess") + F.col("least") <= 0) & (F.col("root") != F.col("root_a"))).select("a", F.col("node").alias("b")))
        keyed = common.materialize(postings(rows.drop("a", "root_a"), percent), "jaccard-postings")
        counts = keyed.groupBy("gid", "e").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("gid", "e", "m")
        keyed = common.materialize(keyed.join(counts.hint("merge"), ["gid", "e"]), "jaccard-keyed")
        paired = keyed if depth == DEPTH - 1 else keyed.filter(F.col("m") <= PART)
        hubs = paired.filter("not near").select("gid", "e", F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("root", "short", "n", *BITMAP)))
        other = F.col("near") | (F.col("short") & F.col("short_a") & (F.col("a") < F.col("node")))
        met_ = hubs.join(paired.hint("merge"), ["gid", "e"]).filter((F.col("root") != F.col("root_a")) & other & possible(percent))
        found.append(met_.select("a", F.col("node").alias("b")))
        groups = common.materialize(keyed.filter(F.col("m") > PART).select(F.xxhash64("gid", "e").alias("gid"), "node", "root"), "jaccard-groups")
        if depth == DEPTH - 1 or groups.isEmpty():
            break
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.union(x)
    pairs = common.materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-distant")
    common.release(begun, keep=1)
    return pairs


def labelled(docs: DataFrame, k: int, percent: int, every: bool) -> DataFrame:
    """(doc_id, row_hash, n_shingles, component_id, first, n_links) of every row.

    first: the row is the one that stays of its component (the smallest doc_id, and of rows with that the smallest row_hash; null
    doc_ids last); rows with an empty set are components by themselves and all first. every: all candidate pairs are verified,
    and n_links counts the links of the document's set to other sets. Otherwise only the components are meant: pairs that the
    links found so far already join are left out, and n_links isn't counted.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = common.materialize(describe(docs, k), "jaccard-sets")
    begun, documents = common.written(), described.count()
    often = docs.sparkSession.sparkContext.broadcast(common_shingles(described, documents))
    described = described.drop("often")
    dealt = entries(docs, k, percent, documents, often).repartition(partitions, F.shiftright("key", 1)).sortWithinPartitions("key", "node")
    shared = common.materialize(collisions(dealt), "jaccard-collisions")
    common.drop_shuffles(docs.sparkSession)
    # one row of each set, and whether it is a candidate; copies are one row of each task before they meet
    least = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_hash")
    own = described.filter(F.col("node").isNotNull()).select("node", least.alias("least"), F.col("n_shingles").alias("n"), *BITMAP, F.lit(False).alias("met"))
    flags = shared.select("node").union(shared.filter("fresh").select("hub")).select("node", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns[1:-1]), F.lit(True).alias("met"))
    unique = own.union(flags).groupBy("node").agg(F.min("least").alias("least"), *(F.max(c).alias(c) for c in ("n", *BITMAP, "met")))
    unique = common.materialize(unique, "jaccard-unique")
    known = unique.filter("met").drop("met")
    first = shared.filter("fresh").select(F.col("hub").alias("a"), F.col("node").alias("b")).repartition("b").distinct()
    first = with_known(with_known(first, known, "b"), known, "a", "_a")
    links = checked(docs, first.filter(possible(percent)).select("a", "b"), known, k, percent)
    roots = None if every else common.materialize(graph.components(links), "jaccard-roots")
    most = shared.agg(F.max("rank")).first()[0] or 0
    used = 1
    while used <= most:
        if every:
            members = shared.select("key", "node", "rank", "hub", F.col("node").alias("root"))
        else:
            members = shared.select("key", "node", "rank", "hub").join(roots.hint("merge"), "node", "left").select("key", "node", "rank", "hub", F.coalesce("root", "node").alias("root"))
        # groups with members, beside the first hub, that aren't all joined, or distinct where every pair counts, and with further hubs
        open_keys = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("rank").alias("most"), F.count(F.lit(1)).alias("members")).filter(f"x <> y and most >= {used}").select("key", parts_of("members").alias("parts"))
        if used > GROWTH and not every:  # all pairs of large groups were settled in the round before
            open_keys = open_keys.filter("parts = 1")
        members = common.materialize(with_known(members.join(open_keys.hint("merge"), "key"), known, "node"), "jaccard-open")
        if members.isEmpty():
            break
        large, far = F.col("parts") > 1, None
        if used > 1 and not every:
            far = distant(docs, members.filter(large), known, k, percent) if used == GROWTH and not members.filter(large).isEmpty() else None
            members = members.filter(~large)
        more = met(members.drop("hub"), used, percent).select("a", "b")
        more = (more if far is None else more.union(far)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = checked(docs, more, known, k, percent)
        used *= GROWTH
        if not more.isEmpty():
            links = links.union(more)
            if not every and used <= most:
                roots = common.materialize(graph.components(links), "jaccard-roots")
            elif not every:
                roots = None
    if roots is None:
        links = common.materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-links")  # a pair may share keys of several rounds
        roots = common.materialize(graph.components(links), "jaccard-roots")
    named = common.materialize(unique.select("node", "least").join(roots.hint("merge"), "node", "left").select("node", "least", "root"), "jaccard-named")
    joined = common.materialize(named.filter("root is not null").groupBy("root").agg(F.min("least").alias("all")), "jaccard-components")
    labels = named.join(joined.hint("merge"), "root", "left").select("node", F.coalesce("all", "least").alias("all"), F.lit(0 if every else None).cast("long").alias("n_links"))
    if every:
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
        labels = labels.join(degree.hint("merge"), "node", "left").select("node", "all", F.coalesce("degree", "n_links").alias("n_links"))
    labels = common.materialize(labels, "jaccard-labels")
    common.release(begun, keep=1)
    rows = described.drop(*BITMAP).join(labels.hint("merge"), "node", "left")
    first = F.col("all").isNull() | (F.col("doc_id").eqNullSafe(F.col("all.doc_id")) & (F.col("row_hash") == F.col("all.row_hash")))
    component = F.when(F.col("all").isNull(), F.col("doc_id")).otherwise(F.col("all.doc_id"))
    return rows.select("doc_id", "row_hash", "n_shingles", component.alias("component_id"), first.alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: n_links counts all links of the document's set to other sets."""
    return labelled(docs, k, percent, True).drop("row_hash", "first")


def components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, without verifying the links that no component needs."""
    return labelled(docs, k, percent, False).drop("row_hash", "first", "n_links")


def keep(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row_hash, kept) of every row: one document of each component is kept; empty sets all are."""
    return labelled(docs, k, percent, False).select("doc_id", "row_hash", F.col("first").alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return components(common.read(spark, sf_dir, "documents"), 3, 90)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.r = l.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id) USING (doc_id)
"""
