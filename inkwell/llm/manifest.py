"""Merkle dataset manifest: the broadcast upper-tree variant.

A leaf is the hash of a row's fields. In each group the leaves lie in order, runs of ARITY of them become their hash, level by level,
until one node is left; the nodes of the groups, in the order of the groups, become the root in the same way.

Leaves are hashed by SQL functions, and only these 32 bytes, the row's id and its group are sorted and shuffled. A range partitioning in
order, with counts by partition, gives each row its place in its group. Blocks of ARITY^k neighbouring leaves are reduced by tasks of
their own, so a hot group is many tasks; k grows with the table, so that at most TOP blocks and one node a group remain. The driver
builds the tree over these and broadcasts it as one string a level (at most 20 MB for the blocks); a task reads its blocks' paths to the
root from it, makes the blocks' levels again, and with both the proof of each row and the root that the row's present content folds to.
Before the driver takes them, the groups are counted: more than TOP are an error, as their tree isn't small.

H is SHA-256 in lower-case hexadecimal digits; the inputs of an inner node are its nodes' digits.

Defined results. Null fields: `-`; so null text and empty text differ. Null group: the first one. Null ids: first in their group. Rows with
one id: by their leaves; equal rows: each has a place. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import common

ARITY, LEAST, TOP = 8, 2, 1 << 18
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
_RUN = HEX * ARITY


def leaf(fields: list[Column]) -> Column:
    """H of the fields: each its number of UTF-8 bytes, a colon and its text, or `-` where it is null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(part(c.cast("string")) for c in fields)), 256)


def fold(leaf_: Column, proof: Column) -> Column:
    """The root that a leaf and its proof, an array of (left, right), lead to: what a reader of the manifest checks a row with."""
    return F.aggregate(proof, leaf_, lambda at, p: F.sha2(F.concat(p["left"], at, p["right"]), 256))


def levels(nodes: bytes, rounds: int | None = None) -> list[bytes]:
    """The levels of a tree as strings of digits; all of them, or as many as there are rounds, even over a single node."""
    out = [nodes]
    while len(out) <= rounds if rounds is not None else len(out[-1]) > HEX:
        low = out[-1]
        out.append("".join([sha256(low[at : at + _RUN]).hexdigest() for at in range(0, len(low), _RUN)]).encode())
    return out


def siblings(level: bytes, at: int) -> tuple[bytes, bytes]:
    """The other nodes of a node's run, left and right of it."""
    run, own = at // ARITY * _RUN, at * HEX
    return level[run:own], level[own + HEX : run + _RUN]


def height(rows: int) -> int:
    """k: blocks have ARITY^k leaves."""
    k = LEAST
    while rows > TOP * ARITY**k:
        k += 1
    return k


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, int, pa.Table]]:
    """(group, block, size of the group, rows) of a partition that is sorted by these."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(1).to_numpy()
        group = batch.column(0).dictionary_encode()
        code = group.indices.fill_null(-1).to_numpy()
        starts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            now = (batch.column(0)[a].as_py(), int(block[a]), batch.column(2)[a].as_py())
            if held and now != key:
                yield *key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield *key, pa.Table.from_batches(held)


def _digits(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist()).hex().encode()


def reduced(dealt: DataFrame, k: int) -> DataFrame:
    """(grp, block, node): the node that each block comes to; a group of one block comes to its own root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, size, rows in _blocks(batches):
            node = levels(_digits(rows.column("leaf")), None if size <= ARITY**k else k)[-1]
            yield pa.record_batch([pa.array([group], pa.string()), pa.array([block], pa.int64()), pa.array([node.decode()])], names=["grp", "block", "node"])

    return dealt.select("grp", "block", "n", "leaf").mapInArrow(common.tidied(run), "grp string, block long, node string")


class Upper:
    """The tree above the blocks: a string of digits for each level of a group, and for each level above the groups."""

    def __init__(self, nodes: list[tuple[str | None, int, str]]):
        ordered: dict[str | None, list[str]] = {}
        for group, _, node in sorted(nodes, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1])):
            ordered.setdefault(group, []).append(node)
        self.groups = {g: levels("".join(n).encode()) for g, n in ordered.items()}
        self.place = {g: i for i, g in enumerate(self.groups)}
        self.top = levels(b"".join(x[-1] for x in self.groups.values())) if self.groups else [b""]

    def path(self, group: str | None, block: int) -> list[tuple[bytes, bytes]]:
        """What stands left and right of a block's nodes, level by level up to the root."""
        own, out = self.groups[group], []
        for tree, at in ((own, block), (self.top, self.place[group])):
            for level in tree[:-1]:
                out.append(siblings(level, at))
                at //= ARITY
        return out


def proven(dealt: DataFrame, k: int, upper: Broadcast, proofs: bool) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root[, proof]) of each row, block by block."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    pair = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, size, rows in _blocks(batches):
            tree = levels(_digits(rows.column("leaf")), None if size <= ARITY**k else k)
            above, leaves = upper.value.path(group, block), tree[0].decode()
            subroot, root = upper.value.groups[group][-1].decode(), upper.value.top[-1].decode()
            for first in range(0, rows.num_rows, 5000):
                part = rows.slice(first, 5000)
                digest, folded, paths = [], [], []
                for at, now in enumerate(part.column("now").to_pylist(), first):
                    path, i = [], at
                    for level in tree[:-1]:
                        path.append(siblings(level, i))
                        i //= ARITY
                    path += above
                    digest.append(sha256(b"".join([x for p in path for x in p])).hexdigest())
                    own = now.hex().encode()
                    for left, right in path:
                        own = sha256(left + own + right).hexdigest().encode()
                    folded.append(own.decode())
                    if proofs:
                        paths.append([{"left": a.decode(), "right": b.decode()} for a, b in path])
                n = part.num_rows
                shown = [leaves[i * HEX : (i + 1) * HEX] for i in range(first, first + n)]
                columns = [part.column("id").combine_chunks(), pa.array(shown), pa.array([subroot] * n), pa.array([root] * n), pa.array(digest), pa.array(folded)]
                yield pa.record_batch([*columns, *([pa.array(paths, pair)] if proofs else [])], names=[*names, *(["proof"] if proofs else [])])

    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", proof array<struct<left:string,right:string>>" if proofs else "")
    return dealt.select("grp", "block", "n", "id", "leaf", "now").mapInArrow(common.tidied(run), schema)


def manifest(docs: DataFrame, now: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", proofs: bool = False) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]) of every row.

    now: what some fields hold at present, as columns of docs; folded_root is what these come to with the proof, and verified whether that
    is the root. proofs: with the proof itself, for fold().
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    then, present = [docs[c] for c in fields], [(now or {}).get(c, docs[c]) for c in fields]
    own = docs.select(docs[order].cast("long").alias("id"), docs[group].cast("string").alias("grp"), F.unhex(leaf(then)).alias("leaf"), (F.unhex(leaf(present)) if now else F.lit(None).cast("binary")).alias("now"))
    leaves = common.materialize(own.withColumn("now", F.coalesce("now", "leaf")), "manifest-leaves")
    k = height(leaves.count())
    # equal rows have different numbers, so that any group of them can be split
    order_ = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("number")]
    ranged = leaves.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(partitions, *order_).sortWithinPartitions(*order_).drop("number")
    ranged = common.materialize(ranged.withColumn("number", F.monotonically_increasing_id()), "manifest-sorted").withColumn("part", F.shiftright("number", 33))
    counted = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("number").alias("first"))
    before = F.sum("rows").over(Window.partitionBy("grp").orderBy("part")) - F.col("rows")
    counted = counted.select(F.col("grp").alias("_grp"), F.col("part").alias("_part"), (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    counted = common.materialize(counted, "manifest-counts")
    groups = counted.select("_grp").distinct().count()
    if groups > TOP:
        raise ValueError(f"{group} has {groups} values; at most {TOP} groups fit the driver's tree")
    placed = ranged.join(counted, ranged["grp"].eqNullSafe(F.col("_grp")) & (ranged["part"] == F.col("_part"))).withColumn("at", F.col("number") + F.col("shift"))
    dealt = placed.select("grp", F.expr(f"at div {ARITY**k}").alias("block"), "at", "n", "id", "leaf", "now").repartition(partitions, "grp", "block").sortWithinPartitions("grp", "block", "at")
    nodes = reduced(dealt, k).toArrow()  # at most TOP blocks and a node a group
    upper = spark.sparkContext.broadcast(Upper(list(zip(*(c.to_pylist() for c in nodes.columns), strict=True))))
    out = proven(dealt, k, upper, proofs).withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.withColumnRenamed("id", order)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    lowered = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(docs, {"text": F.when(tampered, lowered).otherwise(docs["text"])})


#: CRC-32 of the digits of a number in DuckDB SQL; {} is the number.
CRC32 = (
    "xor(4294967295, list_reduce(list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, x: xor(c >> 8, "
    "list_transform(range(256), lambda b: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(3988292384, y >> 1) ELSE y >> 1 END, b))[xor(c & 255, x) + 1]), 4294967295))"
)


def oracle(rounds: int = 7) -> str:
    """DuckDB SQL for query(), for up to ARITY^rounds rows a group."""
    part = lambda c, of: f"coalesce(strlen({of}::VARCHAR) || ':' || {of}::VARCHAR, '-')"
    h = lambda text: f"sha256({' || '.join(part(c, text if c == 'text' else c) for c in FIELDS)})"
    lowered = f"CASE WHEN {CRC32.format('doc_id')} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    out = [f"WITH d AS (SELECT doc_id, lang, {h('text')} AS leaf, {h('now')} AS now FROM (SELECT *, {lowered} AS now FROM documents))", "n0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)", "f0 AS (SELECT doc_id, lang, leaf, now AS cur, '' AS proof, pos FROM n0)", "m0 AS (SELECT lang, pos, leaf AS h FROM n0)"]

    def climb(i: int, key: str, same: str) -> None:
        """Levels m, f -> m, f: a tree with one node stays as it is."""
        by = f"{key}, " if key else ""
        out.append(f"r{i} AS (SELECT {by}pos // {ARITY} AS run, list(h ORDER BY pos) AS hs, any_value(c) AS c FROM (SELECT *, count(*) OVER ({f'PARTITION BY {key}' if key else ''}) AS c FROM m{i}) GROUP BY ALL)")
        out.append(f"m{i + 1} AS (SELECT {by}run AS pos, CASE WHEN c = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM r{i})")
        left, right = f"array_to_string(r.hs[1:f.pos % {ARITY}], '')", f"array_to_string(r.hs[f.pos % {ARITY} + 2:], '')"
        out.append(f"f{i + 1} AS (SELECT f.* EXCLUDE (cur, proof, pos), CASE WHEN c = 1 THEN cur ELSE sha256({left} || cur || {right}) END AS cur, proof || {left} || {right} AS proof, f.pos // {ARITY} AS pos FROM f{i} f JOIN r{i} r ON {same} r.run = f.pos // {ARITY})")

    for i in range(rounds):
        climb(i, "lang", "r.lang IS NOT DISTINCT FROM f.lang AND")
    out.append(f"g AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM m{rounds})")
    out.append(f"m{rounds + 1} AS (SELECT pos, subroot AS h FROM g)")
    out.append(f"f{rounds + 1} AS (SELECT f.* EXCLUDE (pos), g.subroot, g.pos FROM f{rounds} f JOIN g ON g.lang IS NOT DISTINCT FROM f.lang)")
    for i in range(rounds + 1, rounds + 5):
        climb(i, "", "")
    last = rounds + 5
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM f{last}, m{last}"


ORACLE = oracle()
