"""Approximate filtered cosine top-K over an index that is a table: coarse cells, and in each a byte a number.

build() writes two Parquet tables under a path. `cells` has the centroids of a spherical k-means, fitted on a bounded sample; `rows` has
the columns of the input with each row's cell, its vector's code (a byte a number), the code's scale and the distance between the unit
vector and what its code says. The rows are sorted by cell, so a filter on cells reaches the scan and skips row groups.

search() probes the cells nearest to the query, with the caller's filters applied before anything is scored, and reads codes only. The
distance of a code gives each row a lower and an upper bound of its similarity; a task keeps the rows whose upper bound reaches the lower
bound of its K-th best, of equal vectors those with the least ids. While fewer rows than asked for have passed the filters, twice as many
cells are probed (iterative refill). Then the vectors of the few rows that are left are read and scored exactly. So within the probed
cells the result is exact, and with all cells probed it is that of vector.top_k().

Vectors without length are in a cell of their own (-1), which is probed last; they come last, with a null similarity, as in top_k().
Null vectors are left out. Ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import vector as V
from inkwell.sources import tables

#: At most so many cells; so many sampled vectors for each of them; so many numbers in the sample.
CELLS, SAMPLE, NUMBERS, STEPS = 4096, 64, 1 << 24, 10
#: Cells probed at first, as a share of all (enough for vectors that lie almost at random; clustered ones need a few cells), and rows that must pass the filters, as a multiple of K.
PROBED, REFILL = 0.7, 4
INDEX = {"cell": "int", "code": "binary", "scale": "double", "off": "double", "same": "bigint"}


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def centroids(x: np.ndarray, cells: int, seed: int, steps: int = STEPS) -> np.ndarray:
    """Spherical k-means of unit vectors: a cell that loses all its vectors starts again at the vector that is farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = x @ c.T
        own, best = near.argmax(1), near.max(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        total[empty] = x[np.argsort(best)[: len(empty)]]
        c = unit(total)
    return c


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, distance) of unit vectors: the greatest number of a vector is 127 bytes' steps."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(np.divide(x, scale[:, None], out=np.zeros_like(x), where=scale[:, None] > 0)).astype(np.int8)
    return code, scale, np.linalg.norm(x - code * scale[:, None], axis=1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dim or (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError(f"every vector needs {dim} numbers")
    return flat.reshape(-1, dim)


def build(chunks: DataFrame, path: str, cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding", seed: int = 1) -> None:
    """Write the index of chunks, whose columns stay, under path. cells: the square root of the number of vectors, CELLS at most, unless given."""
    clash = sorted(set(INDEX) & set(chunks.columns))
    if clash:
        raise ValueError(f"columns that the index uses itself: {clash}")
    spark = chunks.sparkSession
    rows = chunks.filter(F.col(vector).isNotNull())
    n = rows.count()
    cells = max(1, min(CELLS, cells or int(n**0.5)))
    first = rows.select(F.size(vector)).first()
    dim = first[0] if first else 1
    sampled = rows.select(vector, F.xxhash64(F.lit(seed), id_col).alias("h")).orderBy("h").limit(max(1, min(SAMPLE * cells, NUMBERS // max(dim, 1)))).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    x = unit(matrix(sampled.column("v").combine_chunks(), dim)) if sampled.num_rows else np.zeros((0, dim))
    x = x[np.abs(x).sum(1) > 0]
    c = centroids(x, cells, seed) if len(x) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(c)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(matrix(batch.column(batch.schema.get_field_index(vector)).cast(pa.list_(pa.float64())), dim))
            code, scale, off = codes(v)
            cell = np.where(np.abs(v).sum(1) > 0, (v @ shared.value.T).argmax(1), -1)
            own = [pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale), pa.array(off)]
            yield pa.record_batch([*batch.columns, *own], names=[*batch.schema.names, "cell", "code", "scale", "off"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(place, f"{kind}, cell int, code binary, scale double, off double").withColumn("same", F.xxhash64(vector))
    placed = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", id_col).sortWithinPartitions("cell", id_col)
    placed.write.mode("overwrite").parquet(f"{path}/rows")
    found = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "cell int, centroid array<double>")
    counted = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    counted.join(found, "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def shortlist(rows: DataFrame, query: np.ndarray, k: int, id_col: str) -> DataFrame:
    """(id, same, low, high) of the rows that may be among the k most similar ones of their task."""
    dim, weight = len(query), query.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(-1, dim)
            near = (code @ weight) * batch.column(3).to_numpy()
            off = batch.column(4).to_numpy() + 1e-9
            own = pd.DataFrame({"id": batch.column(0).to_pandas(), "same": batch.column(1).to_numpy(), "low": near - off, "high": near + off})
            kept = own if kept is None else pd.concat([kept, own])
            if len(kept) > k:
                kept = kept[kept["high"] >= np.partition(kept["low"].to_numpy(), -k)[-k]]
            if len(kept) > 4 * k:
                kept = kept.sort_values("id").groupby("same", sort=False).head(k)
        if kept is not None:
            yield pa.RecordBatch.from_pandas(kept, preserve_index=False)

    return rows.select(F.col(id_col).alias("id"), "same", "code", "scale", "off").mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, same long, low double, high double")


def search(spark: SparkSession, path: str, query: list[float], k: int, *, nprobe: int | None = None, refill: int = REFILL, where: Column | None = None, episode_range: tuple[int | None, int | None] = (None, None), exclude: DataFrame | None = None, id_col: str = "vec_id", vector: str = "embedding", episode: str = "episode_no") -> DataFrame:
    """The columns of the indexed rows and similarity, as vector.top_k() has them, of the k nearest rows in the probed cells.

    nprobe: cells probed at first; a share PROBED of all unless given, and all of them give the exact result. At least refill * k rows
    that pass the filters are looked at, if there are so many: a filter that few rows pass makes more cells be probed.
    """
    V.guard(query, k, episode_range)
    found = spark.read.parquet(f"{path}/cells").collect()  # at most CELLS and one
    q = unit(np.array(query, np.float64)[None])[0]
    order = [r["cell"] for r in sorted(found, key=lambda r: (r["centroid"] is None, -float(np.dot(r["centroid"], q)) if r["centroid"] else 0.0, r["cell"]))]
    rows = V.filtered(spark.read.parquet(f"{path}/rows"), where, episode_range, exclude, id_col, episode)
    first = max(1, min(len(order), nprobe if nprobe is not None else -int(-PROBED * len(order) // 1)))
    wanted, probed, short = k * refill, 0, None
    while probed < len(order) and (short is None or short.count() < wanted):
        more = order[probed : max(first, 2 * probed)]
        part = tables.settled(shortlist(rows.filter(F.col("cell").isin(more)), q, wanted, id_col))
        short = part if short is None else short.union(part)
        probed += len(more)
    if short is None:
        return V.ranked(rows.filter(F.lit(False)), query, k, id_col, vector).drop(*INDEX)
    floor = short.orderBy(F.col("low").desc()).limit(k).agg(F.min("low"), F.count(F.lit(1))).first()
    if floor[1] == k:
        short = short.filter(F.col("high") >= floor[0])
    # of equal vectors only the k least ids can count, so what is left is about as many rows as are asked for
    few = short.groupBy("same").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids")).select(F.explode("ids").alias(id_col))
    return V.ranked(rows.filter(F.col("cell").isin(order[:probed])).join(few, id_col, "left_semi"), query, k, id_col, vector).drop(*INDEX)
