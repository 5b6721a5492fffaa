"""Best-fit packing by bin completion with branch and bound, over the histogram of piece lengths.

Pieces of equal length can stand for each other, so the whole packing is decided on the counts of the at most `capacity`
lengths: that histogram is all that reaches the driver, whatever the number of documents. The incumbent is best fit: the largest
length left and its filling with the least waste among a few, used as many times at once as the counts allow. If it takes more
sequences than the lower bound, branch and bound looks for fewer, over the whole histogram: at each node it enumerates the
fillings of any number of pieces around the largest piece left, those with the least waste first, leaves out the dominated ones
(where a piece left out could replace one or several smaller ones of the filling), takes a filling as many times as the counts
allow and then less often, and prunes where the waste so far is more than a packing better than the incumbent may have. Fillings
at the same largest piece are taken in one order, so no set of sequences is met twice. A better packing becomes the incumbent.
The search is complete but for its bounds: it ends after `nodes` nodes, or STEPS steps of the enumeration for each of them, all
together, with the best packing found.

The plan is a list of intervals of ranks of each length. Pieces get their rank by a range partition on (length, doc_id,
piece), written as a table, plus the counts of its partitions; so no task ever holds all pieces of a common length.

Defined results. Null or empty text: the single end id. Repeated rows: each is packed. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common, tokens

CAPACITY = 2048
END = 0
NODES, STEPS = 20_000, 50

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def _complete(counts: np.ndarray, room: int) -> Counter:
    """The filling of room with the least waste among best fit and exact fillings of one or two pieces. counts isn't changed."""

    def greedy(room: int, used: Counter) -> Counter:
        used = used.copy()
        at = room
        while room > 0 and at > 0:
            at = min(at, room)
            below = np.flatnonzero(counts[1 : at + 1]) + 1
            if not len(below):
                break
            at = int(below[-1])
            n = min(room // at, int(counts[at]) - used[at])
            if n > 0:
                used[at] += n
                room -= n * at
            at -= 1
        return used

    best = greedy(room, Counter())
    if sum(k * v for k, v in best.items()) == room:
        return best
    here = np.flatnonzero(counts[: room + 1])
    for a in here[::-1]:  # the largest piece of an exact pair first
        b = room - int(a)
        if b > a:
            break
        if b == 0 or counts[b] > (b == a):
            return Counter([int(a)] if b == 0 else [int(a), b])
    for a in here[::-1][:64]:  # best fit after each of the next large pieces
        used = greedy(room - int(a), Counter())
        used[int(a)] += 1
        if all(counts[k] >= v for k, v in used.items()) and sum(k * v for k, v in used.items()) > sum(k * v for k, v in best.items()):
            best = used
            if sum(k * v for k, v in best.items()) == room:
                break
    return best


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of total length over capacity and the pieces that can't share with another of them (over half)."""
    lengths = np.arange(len(counts))
    best = max(-(-int((counts * lengths).sum()) // capacity), int(counts[capacity // 2 + 1 :].sum()))
    for k in range(1, capacity // 2 + 1, 16):  # pieces of over capacity - k admit none of at least k
        large, mid, fit = counts[capacity - k + 1 :].sum(), counts[capacity // 2 + 1 : capacity - k + 1], counts[k : capacity // 2 + 1]
        spare = int(mid.sum()) * capacity - int((mid * np.arange(capacity // 2 + 1, capacity - k + 1)).sum())
        rest = int((fit * np.arange(k, capacity // 2 + 1)).sum()) - spare
        best = max(best, int(large) + int(mid.sum()) + max(0, -(-rest // capacity)))
    return best


Filling = tuple[tuple[int, int], ...]


def exact(lengths: list[int], left: list[int], target: int, budget: list[int]) -> Iterator[Filling]:
    """The sets of pieces that fill target exactly, as (length, times), larger pieces first; lengths ascend and left has their counts. Ends early where budget, the steps left, is used up."""
    reach, dead = [], set()
    for n, k in zip(lengths, left, strict=True):
        reach.append((reach[-1] if reach else 0) + n * k)

    def go(i: int, rest: int) -> Iterator[Filling]:
        if not rest:
            yield ()
            return
        i = min(i, bisect_right(lengths, rest) - 1)
        if i < 0 or (i, rest) in dead:
            return
        found = False
        for j in range(i, -1, -1):
            if reach[j] < rest:
                break
            for times in range(min(left[j], rest // lengths[j]), 0, -1):
                budget[0] -= 1
                if budget[0] < 0:
                    return
                for others in go(j - 1, rest - times * lengths[j]):
                    found = True
                    yield ((lengths[j], times), *others)
        if not found:
            dead.add((i, rest))

    return go(len(lengths) - 1, target)


def dominated(filling: Filling, lengths: list[int], left: list[int], waste: int) -> bool:
    """Whether a piece that was left out could join the filling, or replace one smaller piece of it or several that together aren't larger."""
    used = dict(filling)
    out = sum(1 << n for n, k in zip(lengths, left, strict=True) if k > used.get(n, 0))
    one = several = 0  # sums of one piece and of more, as bits
    for n, times in filling:
        for _ in range(times):
            several |= (several << n) | (one << n)
            one |= 1 << n
    if out & several:
        return True
    sums, width = (one | several | 1), 0
    spread = 0  # sums plus 1 to waste
    while width < waste:
        more = min(max(width, 1), waste - width)
        spread |= (spread << more) if width else (sums << 1)
        width += more
    return bool(out & spread)


def search(counts: np.ndarray, capacity: int, best: int, bound: int, nodes: int = NODES) -> Plan | None:
    """A packing of fewer than best sequences, the best that the search finds, or None."""
    counts, found, budget = counts.copy(), None, [STEPS * nodes]
    total = int((counts * np.arange(len(counts))).sum())

    def choices(after: tuple | None, spare: int) -> Iterator[tuple[tuple, Filling]]:
        """(order, filling with the largest piece) at the present counts, in order, behind `after` where the largest piece is the same."""
        largest = int(np.flatnonzero(counts)[-1])
        own = counts[: capacity - largest + 1].copy()
        if largest < len(own):
            own[largest] -= 1
        lengths = (np.flatnonzero(own[1:]) + 1).tolist()
        left = own[lengths].tolist()
        for waste in range(min(spare, capacity - largest) + 1):
            for filling in exact(lengths, left, capacity - largest - waste, budget):
                order = (-largest, waste, tuple((-n, -k) for n, k in filling))
                if (after is None or after[0] != -largest or order > after) and not dominated(filling, lengths, left, waste):
                    same = filling and filling[0][0] == largest
                    yield order, ((largest, 1 + filling[0][1]), *filling[1:]) if same else ((largest, 1), *filling)

    def times_of(filling: Filling) -> int:
        return min(int(counts[n]) // k for n, k in filling)

    def take(filling: Filling, times: int) -> None:
        for n, k in filling:
            counts[n] -= k * times

    path: list[list] = []  # [choices, order, filling, times] of each level
    bins, waste = 0, 0
    spare = lambda: capacity * (best - 1) - total - waste
    level: list | None = [choices(None, spare()), None, None, 0]
    while level is not None and nodes > 0 and budget[0] > 0 and best > bound:
        if level[3] > 0:  # less often
            per = capacity - sum(n * k for n, k in level[2])
            take(level[2], -1)
            level[3], bins, waste = level[3] - 1, bins - 1, waste - per
        if level[3] == 0:
            step = next(level[0], None)
            if step is None:
                level = path.pop() if path else None
                continue
            level[1], level[2] = step
            level[3] = times_of(level[2])
            per = capacity - sum(n * k for n, k in level[2])
            take(level[2], level[3])
            bins, waste = bins + level[3], waste + per * level[3]
        nodes -= 1
        if spare() < 0:
            continue
        if not counts.any():
            best, found = bins, [(x[2], x[3]) for x in [*path, level]]
            continue
        path.append(level)
        level = [choices(level[1], spare()), None, None, 0]
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Patterns ((length, times), ...) with the number of sequences of each; they use every piece exactly once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    whole, bound, out, at = counts.copy(), lower_bound(counts, capacity), [], capacity
    while at > 0:
        if not counts[at]:
            at -= 1
            continue
        counts[at] -= 1
        used = _complete(counts, capacity - at)
        counts[at] += 1
        used[at] += 1
        times = min(int(counts[k]) // v for k, v in used.items())
        for k, v in used.items():
            counts[k] -= v * times
        out.append((tuple(sorted(used.items(), reverse=True)), times))
    if (n := sum(times for _, times in out)) > bound:
        out = search(whole, capacity, n, bound, nodes) or out
    return out


def intervals(packed: Plan) -> dict[str, np.ndarray]:
    """The plan by global position of the pieces in order of length: start position, length, first sequence, times in a sequence, offset."""
    uses: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, n in packed:
        offset = 0
        for length, times in pattern:
            uses.setdefault(length, []).append((sequence, times, offset, n * times))
            offset += length * times
        sequence += n
    rows, at = [], 0
    for length in sorted(uses):
        for first, times, offset, n in uses[length]:
            rows.append((at, length, first, times, offset))
            at += n
    return dict(zip(("start", "length", "sequence", "times", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and an end id, cut from the back so that only the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(tokens.encode(text), np.array([END], "<u4"))
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for to, x in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        to.append(x)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return source.mapInArrow(common.tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces() with sequence_id and offset."""
    spark = docs.sparkSession
    cut = common.materialize(pieces(docs, capacity), "pack-pieces")
    ranged = cut.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "length", "doc_id", "piece", "start", "ids_crc32").sortWithinPartitions("length", "doc_id", "piece")
    ranged = common.materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "pack-ranked")
    part, local = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each partition, and one for each of the at most `capacity` lengths
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = {r["length"]: r["n"] for r in ranged.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.zeros(max(sizes, default=0) + 2, np.int64)
    for p, n in sizes.items():
        before[p + 1] = n
    before = np.cumsum(before)
    table = spark.sparkContext.broadcast((before, intervals(plan(histogram, capacity, nodes))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, iv = table.value
        for batch in batches:
            at = before[batch.column("p").to_numpy()] + batch.column("local").to_numpy()
            k = np.searchsorted(iv["start"], at, side="right") - 1
            rank, times = at - iv["start"][k], iv["times"][k]
            sequence, offset = iv["sequence"][k] + rank // times, iv["offset"][k] + rank % times * iv["length"][k]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranged.select("doc_id", "piece", "start", "length", "ids_crc32", part.alias("p"), local.alias("local"))
    return rows.mapInArrow(common.tidied(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))
