"""Exact filtered cosine top-K, and embedding in batches by an injected provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECOVERABLE = (408, 409, 429)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Similarity in double precision; null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def guard(query: list[float], k: int, episode_range: tuple[int | None, int | None]) -> None:
    low, high = episode_range
    if not query or k < 1 or (low is not None and high is not None and low > high):
        raise ValueError("a query vector, k of at least 1 and an ordered range are needed")


def filtered(rows: DataFrame, where: Column | None, episode_range: tuple[int | None, int | None], exclude: DataFrame | None, id_col: str, episode: str) -> DataFrame:
    low, high = episode_range
    if where is not None:
        rows = rows.filter(where)
    if low is not None:
        rows = rows.filter(F.col(episode) >= low)
    if high is not None:
        rows = rows.filter(F.col(episode) <= high)
    return rows if exclude is None else rows.join(exclude.select(id_col), id_col, "left_anti")


def ranked(rows: DataFrame, query: list[float], k: int, id_col: str, vector: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    length = float(sum(x * x for x in query)) ** 0.5
    own = F.col(vector)
    similarity = F.try_divide(dot(own, q), F.sqrt(dot(own, own)) * F.lit(length))
    return rows.withColumn("similarity", similarity).orderBy((1 - F.col("similarity")).asc_nulls_last(), id_col).limit(k)


def top_k(chunks: DataFrame, query: list[float], k: int, *, where: Column | None = None, episode_range: tuple[int | None, int | None] = (None, None), exclude: DataFrame | None = None, id_col: str = "vec_id", vector: str = "embedding", episode: str = "episode_no") -> DataFrame:
    """The k nearest rows by cosine distance, ids breaking ties. Filters come before the scoring and reach the scan; the limit runs as a top-K in every task."""
    guard(query, k, episode_range)
    return ranked(filtered(chunks.filter(F.col(vector).isNotNull()), where, episode_range, exclude, id_col, episode), query, k, id_col, vector)


def search(chunks: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], k: int, dim: int, **options) -> DataFrame:
    """top_k() of a query text, which the provider embeds once, after all arguments are checked."""
    if not text or not text.strip():
        raise ValueError("a query text is needed")
    top_k(chunks, [1.0] * dim, k, **options)  # the arguments' errors come before the call
    found = provider([text])
    if len(found) != 1 or len(found[0]) != dim:
        raise ValueError("one vector of the given dimension is needed for the query")
    return top_k(chunks, found[0], k, **options)


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], dim: int, model: str, batch: int = 64, id_col: str = "chunk_id", text_col: str = "chunk_text") -> DataFrame:
    """(id, embedding, embedding_model): the provider's vectors in request order, each of dim numbers.

    A provider error with a recoverable status (408, 409, 429, 5xx) leaves the batch's vectors null; other errors end the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    vectors = provider(part["t"].tolist())
                except Exception as e:
                    status = getattr(e, "status_code", None)
                    if not (status in RECOVERABLE or (status or 0) >= 500):
                        raise
                    vectors = [None] * len(part)
                else:
                    if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                        raise ValueError("one vector of the given dimension is needed for each text")
                yield pd.DataFrame({"i": part["i"], "embedding": vectors, "embedding_model": model})

    source = chunks.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return source.mapInPandas(run, f"i {source.schema['i'].dataType.simpleString()}, embedding array<double>, embedding_model string").withColumnRenamed("i", id_col)


def in_order(items: Column, dim: int) -> Column:
    """Response items (index, embedding) as the list of vectors; an error unless the indexes are 0..n-1 and all have dim numbers."""
    ordered = F.array_sort(items)
    good = F.forall(F.transform(ordered, lambda x, i: (x["index"] == i) & (F.size(x["embedding"]) == dim)), lambda x: x)
    return F.when(F.coalesce(good, F.lit(False)), F.transform(ordered, lambda x: x["embedding"])).otherwise(F.raise_error(F.lit("the response lacks vectors or has wrong ones")))
