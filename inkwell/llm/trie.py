"""Conversation prefix trie: hash partitions of first-turn subtries as pointer dictionaries, oversized ones split by their next turn.

A turn is told by the MD5 of its role and text, which SQL functions make where the texts are; only digests and byte lengths are
shuffled. A conversation is its path of digests, and equal paths become one row: their ids are gathered in chunks of CHUNK
neighbouring ids, and a path's chunks are then streamed in order through one SHA-256, so no group of copies is ever held in memory.

The paths are dealt by the hash of their first turn; a task builds the subtries of a bucket of first turns from dictionaries of pointers,
and sums them up in postorder without recursion. A first turn with more than one path and more turns under it than its
limit is oversized: its paths are dealt by the turn behind the ones that they all share (found from the least and the greatest path), and again
until nothing is oversized. The few nodes above the subtries, the root among them, are the spine; their numbers are sums over the tops
of the subtries and over spine nodes below them, as aggregations with partial sums.

Turns of one conversation are ordered by turn (null first), ties by role and digest. Defined results. Null conv_id: no conversation,
left out. Null role or text: empty. Equal rows: a turn each. Empty table: no rows, not even a root. Extra columns are ignored. A
conversation's path is one value: 32 digits a turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import common
from inkwell.llm.manifest import CRC32

LIMIT, FEW, BUCKET, CHUNK, DIGEST = 50_000, 64, 100_000, 4096, 32
NOTHING = sha256(b"").hexdigest()
TURNS = "array<struct<i:long,digest:string,bytes:long>>"


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, digest, bytes): the turns of each conversation numbered from 0."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.filter("conv_id is not null").withColumn("i", (F.row_number().over(order) - 1).cast("long")).select("conv_id", "i", "digest", "bytes")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of turns (conv_id, i, digest, bytes); a row without a digest only says that the conversation exists."""
    one = F.when(F.col("digest").isNotNull(), F.struct(F.col("i").cast("long").alias("i"), "digest", F.col("bytes").cast("long").alias("bytes")))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def paths_of(conversations: DataFrame) -> DataFrame:
    """(path, sizes, n, conv_id, ends): the distinct paths with their number of conversations, the smallest id, and the hash of all ids."""
    spark = conversations.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    rows = rows.withColumns({"id": F.md5("path"), "chunk": F.expr(f"conv_id div {CHUNK}")})
    ids = F.sort_array(F.collect_list("conv_id"))
    chunks = rows.groupBy("id", "chunk").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), ids.alias("ids"))
    chunks = chunks.select("id", "chunk", "path", "sizes", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("conv_id"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, open_, hashed = ["path", "sizes", "n", "conv_id", "ends"], None, None
        for batch in batches:
            done = []
            for id_, path, sizes, n, conv, text in zip(*(batch.column(c).to_pylist() for c in ("id", "path", "sizes", "n", "conv_id", "ids")), strict=True):
                if open_ and open_[0] == id_:
                    open_[3] += n
                    hashed.update(b"," + text.encode())
                    continue
                if open_:
                    done.append([*open_[1:], hashed.hexdigest()])
                open_, hashed = [id_, path, sizes, n, conv], sha256(text.encode())
            if done:
                yield _batch(done, names)
        if open_:
            yield _batch([[*open_[1:], hashed.hexdigest()]], names)

    dealt = chunks.repartition(partitions, "id").sortWithinPartitions("id", "chunk").select("id", "path", "sizes", "n", "conv_id", "ids")
    return dealt.mapInArrow(common.tidied(run), "path string, sizes array<long>, n long, conv_id long, ends string")


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "sizes": pa.list_(pa.int64()), "n": pa.int64(), "conv_id": pa.int64(), "ends": pa.string()}
    return pa.record_batch([pa.array(list(c), kinds[k]) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def prefix(path: Column, turns: Column) -> Column:
    return F.substring(path, F.lit(1), (turns * DIGEST).cast("int"))


def shared_turns(least: Column, most: Column) -> Column:
    """How many first turns the least and the greatest path of a group share, and so all between them."""
    n = F.least(F.length(least), F.length(most)) / DIGEST
    piece = lambda c, i: F.substring(c, (i * DIGEST + 1).cast("int"), F.lit(DIGEST))
    differ = F.array_position(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: piece(least, i) == piece(most, i)), F.lit(False))
    return F.when(differ == 0, n).otherwise(differ - 1).cast("int")


def cut(paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """paths with cut, the number of turns above their subtrie: 0, and more where a subtrie would be oversized. Paths of up to cut turns end above."""
    length = (F.length("path") / DIGEST).cast("int")
    alive, done = paths.withColumn("cut", F.lit(0)), None
    while True:
        key = prefix(F.col("path"), F.col("cut") + 1)
        keyed = alive.withColumn("key", F.when(length > F.col("cut"), key))
        big = keyed.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(length - F.col("cut")).alias("below"), F.min("path").alias("least"), F.max("path").alias("most"))
        big = common.materialize(big.filter((F.col("n") > 1) & (F.col("below") > limit)).select("key", shared_turns(F.col("least"), F.col("most")).alias("at")), "trie-oversized")
        if big.isEmpty():
            last = alive
            break
        met = common.materialize(keyed.filter("key is not null").join(big, "key", "left"), "trie-cut")
        settled = met.filter("at is null").drop("key", "at").unionByName(keyed.filter("key is null").drop("key"))
        done = settled if done is None else done.unionByName(settled)
        alive = met.filter("at is not null").withColumn("cut", F.col("at")).drop("key", "at")
    return last if done is None else done.unionByName(last)


NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, digest string, above string, sizes array<long>"


def build(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes (NODE) of the subtries of paths (path, sizes, n, conv_id, ends, cut). Tops have above, their parent's path, and the sizes of its turns."""
    pointers: list[dict[str, int] | None] = []
    tops: dict[str, int] = {}
    digest, parent, depth, size, convs, least, ends, above = [], [], [], [], [], [], [], []

    def added(d: str, up: int, at: int, bytes_: int, over: tuple | None) -> int:
        for column, x in ((pointers, None), (digest, d), (parent, up), (depth, at), (size, bytes_), (convs, 0), (least, None), (ends, NOTHING), (above, over)):
            column.append(x)
        return len(digest) - 1

    for path, sizes, n, conv, hashed, first in zip(*(frame[c] for c in ("path", "sizes", "n", "conv_id", "ends", "cut")), strict=True):
        key = path[: DIGEST * (first + 1)]
        node = tops.get(key)
        if node is None:
            node = tops[key] = added(key[-DIGEST:], -1, first + 1, int(sizes[first]), (key[:-DIGEST], [int(x) for x in sizes[:first]]))
        at = first + 1
        while True:
            convs[node] += n
            if least[node] is None or conv < least[node]:
                least[node] = conv
            if at == len(sizes):
                break
            d = path[DIGEST * at : DIGEST * (at + 1)]
            at += 1
            if pointers[node] is None:
                pointers[node] = {}
            child = pointers[node].get(d)
            if child is None:
                child = pointers[node][d] = added(d, node, at, int(sizes[at - 1]), None)
            node = child
        ends[node] = hashed
    leaves, saved = [0] * len(digest), [(n - 1) * s for n, s in zip(convs, size, strict=True)]
    for node in reversed(range(len(digest))):  # a node is older than its children, so this is a postorder
        if pointers[node] is None:
            leaves[node] = 1
        if (up := parent[node]) >= 0:
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    return pd.DataFrame({
        "depth": depth, "conv_id": least, "parent_conv_id": pd.array([least[p] if p >= 0 else None for p in parent], "Int64"), "n_convs": convs, "n_children": [len(p or ()) for p in pointers], "n_leaves": leaves,
        "saved_tokens": saved, "ends_sha256": ends, "digest": digest, "above": [a and a[0] for a in above], "sizes": [a and a[1] for a in above],
    })


def spine(tops: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes above the subtries: (path, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest).

    tops: above, sizes and the numbers of the subtries' tops; ended: the paths that end above them.
    """
    zero = F.lit(0).cast("long")
    under = tops.select(F.col("above").alias("path"), "sizes", F.col("n_convs").alias("n"), "conv_id", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"), F.lit(1).cast("long").alias("kids"))
    rows = under.unionByName(ended.select("path", "sizes", "n", "conv_id", zero.alias("leaves"), zero.alias("saved"), "ends", zero.alias("kids")))
    at = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("sizes"))).alias("depth"))
    last = F.col("depth") == F.size("sizes")
    at = at.select(prefix(F.col("path"), F.col("depth")).alias("path"), F.col("depth").cast("long").alias("depth"), "n", "conv_id", "leaves", "saved", F.when(last, F.col("ends")).alias("ends"), F.when(last, F.col("kids")).otherwise(zero).alias("kids"), F.coalesce(F.get("sizes", F.col("depth") - 1), zero).alias("bytes"))
    nodes = at.groupBy("path", "depth").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.sum("kids").alias("kids"), F.max("bytes").alias("bytes"))
    nodes = common.materialize(nodes.withColumn("parent", F.when(F.col("depth") > 0, prefix(F.col("path"), F.col("depth") - 1))), "trie-spine")
    own = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(zero)
    up = nodes.select("path", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("depth").cast("int"))).alias("to"), "depth")
    sums = up.groupBy(prefix(F.col("path"), F.col("to")).alias("path")).agg(F.sum("own").alias("below"), F.count(F.when(F.col("to") == F.col("depth") - 1, 1)).alias("more"))
    parents = nodes.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(sums, "path").join(parents, "parent", "left").withColumn("n_children", F.col("kids") + F.col("more"))
    leaves = F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    return nodes.select("path", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), (F.col("saved") + F.col("below")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"), F.when(F.col("depth") > 0, F.expr(f"right(path, {DIGEST})")).alias("digest"))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest"]


def trie(turns: DataFrame, limit: int | None = None) -> DataFrame:
    """A row (COLUMNS) for each node of the prefix trie of turns (conv_id, i, digest, bytes), whose order in a conversation is i.

    limit: turns of a subtrie; as many as a partition has on average, FEW at least and LIMIT at most, unless given.

    n_leaves and saved_tokens are of the whole subtree; digest is that of the node's turn, by which with_texts() finds role and text.
    """
    spark = turns.sparkSession
    paths = common.materialize(paths_of(conversations_of(turns)), "trie-paths")
    below = F.size("sizes") > F.col("cut")
    total = paths.agg(F.sum(F.size("sizes"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    dealt = common.materialize(cut(paths, limit or min(LIMIT, max(FEW, total // buckets))), "trie-dealt")
    bucket = F.pmod(F.xxhash64(prefix(F.col("path"), F.col("cut") + 1)), F.lit(buckets))
    nodes = dealt.filter(below).withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda frame: build(frame), NODE)
    nodes = common.materialize(nodes, "trie-nodes")
    tops = nodes.filter("above is not null")
    over = common.materialize(spine(tops, dealt.filter(~below)), "trie-above")
    named = tops.drop("parent_conv_id").join(over.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id")), "above")
    return over.select(*COLUMNS).unionByName(nodes.filter("above is null").select(*COLUMNS)).unionByName(named.select(*COLUMNS))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes with the role and text of their turn, null at the root."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    said = conversations.select(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), role.alias("role"), text.alias("text"))
    return nodes.join(said.groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text")), "digest", "left")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The turns of digested() as the conversations of the query: each has the first h turns of the one whose id is its own less id % 5, then its own after its first h; h is crc32(id) % 9."""
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % 9
    c, i = F.col("conv_id"), F.col("i")
    own, own_h = F.when(i >= h(c), F.array(c)), F.when((c % 5 == 0) & (i < 8), F.filter(F.sequence(c - 4, c + 4), lambda x: (x - x % 5 == c) & (h(x) > i)))
    empty = F.array().cast("array<bigint>")
    to = F.concat(F.coalesce(own, empty), F.coalesce(own_h, empty))
    given = turns.select(F.explode(to).alias("conv_id"), "i", "digest", "bytes", F.lit(False).alias("real"))
    there = turns.filter("i = 0").select("conv_id", "i", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("bytes"), F.lit(True).alias("real"))
    rows = given.unionByName(there).groupBy("conv_id").agg(F.max("real").alias("real"), F.collect_list(F.struct("i", "digest", "bytes")).alias("turns"))
    return rows.filter("real").select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")


def query(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(digested(common.read(spark, sf_dir, "conversations")))).drop("digest")


ORACLE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, {CRC32.format('conv_id')} % 9 AS h FROM t),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE i < h UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE i >= h),
p AS (SELECT c.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY i) FILTER (i IS NOT NULL), []) AS p FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
n AS (SELECT conv_id, len(p) AS l, d, md5(to_json(p[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(p[1:d - 1])::VARCHAR) END AS up, CASE WHEN d > 0 THEN strlen(p[d].t) ELSE 0 END AS b FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM p)),
g AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '')) AS ends FROM n GROUP BY k, d),
v AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.up = g.k) AS kids FROM g),
a AS (SELECT DISTINCT x.k AS top, y.k AS k FROM n x JOIN n y ON x.conv_id = y.conv_id AND y.d >= x.d),
s AS (SELECT top, count(*) FILTER (v.kids = 0) AS leaves, sum((v.n - 1) * v.b)::BIGINT AS saved FROM a JOIN v ON v.k = a.k GROUP BY top)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, v.ends AS ends_sha256 FROM v JOIN s ON s.top = v.k LEFT JOIN g u ON u.k = v.up
"""
