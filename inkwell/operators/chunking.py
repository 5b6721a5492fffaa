"""Paragraphs and chunks with exact source offsets (code points, end exclusive): one pass of an Arrow function over each text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

TARGET, LARGEST, SMALLEST = 2500, 3000, 1000


def _lines(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of the lines that aren't blank, in order; a line break other than the usual ones belongs to the body that it ends."""
    at = 0
    for line in (text or "").splitlines(keepends=True):
        body = line[:-2] if line.endswith("\r\n") else line[:-1] if line[-1] in "\r\n" else line
        if body.strip():
            yield at, at + len(body), body
        at += len(line)


def _lists(rows: list[list[tuple]], kinds: dict[str, pa.DataType]) -> pa.Array:
    """An array of lists of structs."""
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(kinds)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds)))


#: Bytes of text that are Python objects at once, with all that is made of them.
SLICE = 1 << 20


def _by_slices(texts: pa.Array, one: Callable[[str | None], list[tuple]], kinds: dict[str, pa.DataType]) -> pa.Array:
    """_lists() of one(text) of each text; only a slice of the batch is Python objects, and what was freed goes back to the system."""
    step = max(1, len(texts) * SLICE // max(texts.nbytes, 1))
    done = [_lists([one(t) for t in texts.slice(at, step).to_pylist()], kinds) for at in range(0, max(len(texts), 1), step)]
    out = pa.concat_arrays(done) if len(done) > 1 else done[0]
    del done
    pa.default_memory_pool().release_unused()
    return out


@F.arrow_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("body", StringType())])))
def paragraphs(texts: pa.Array) -> pa.Array:
    """Array of (start, end, body) of the lines that aren't blank, in order: one pass over each text."""
    return _by_slices(texts, lambda t: list(_lines(t)), {"start": pa.int32(), "end": pa.int32(), "body": pa.string()})


def split_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph_index, paragraph_text, start_offset, end_offset), within each row: nothing is shuffled."""
    rows = docs.select(id_col, F.posexplode(paragraphs(F.col(text_col))).alias("paragraph_index", "p"))
    return rows.select(id_col, "paragraph_index", F.col("p.body").alias("paragraph_text"), F.col("p.start").alias("start_offset"), F.col("p.end").alias("end_offset"))


def split_long(paragraphs_: DataFrame, most: int = LARGEST) -> DataFrame:
    """Paragraphs over `most` characters in pieces of that length; the others as they are."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("paragraph_text") - 1, F.lit(0)), F.lit(most)))
    rows = paragraphs_.withColumn("at", at)
    return rows.withColumn("paragraph_text", F.expr(f"substring(paragraph_text, at + 1, {most})")).withColumn("start_offset", F.col("start_offset") + F.col("at")).withColumn("end_offset", F.col("start_offset") + F.length("paragraph_text")).drop("at")


def packed(lines: Iterable[tuple[int, int, str]], target: int, most: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first, last) of the chunks of a text's paragraphs.

    A paragraph over `most` closes the open chunk and is cut. One that would make the chunk longer than `most` closes it and
    opens the next, without a look at the target in that step. Otherwise it is added, and a chunk of target length is closed.
    """
    held = None  # start, end, first and last paragraph of the open chunk
    for k, (start, end, _) in enumerate(lines):
        if end - start > most:
            if held:
                yield held
            held = None
            for at in range(start, end, most):
                yield at, min(at + most, end), k, k
        elif held and end - held[0] > most:
            yield held
            held = start, end, k, k
        else:
            held = (held[0], end, held[2], k) if held else (start, end, k, k)
            if held[1] - held[0] >= max(target, least):
                yield held
                held = None
    if held:
        yield held


def pack(c: Column, target: int = TARGET, most: int = LARGEST, least: int = SMALLEST) -> Column:
    """Array of (start, end, first, last, body) of the chunks of a text: one pass over it."""
    if not 0 < least <= target <= most:
        raise ValueError("0 < least <= target <= most is needed")
    kinds = {"start": pa.int32(), "end": pa.int32(), "first": pa.int32(), "last": pa.int32(), "body": pa.string()}

    @F.arrow_udf("array<struct<start:int,end:int,first:int,last:int,body:string>>")
    def run(texts: pa.Array) -> pa.Array:
        return _by_slices(texts, lambda t: [(*x, t[x[0] : x[1]]) for x in packed(_lines(t), target, most, least)], kinds)

    return run(c)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """(id, chunk_index, chunk_text, start_offset, end_offset, paragraph_start_index, paragraph_end_index, chunk_id).

    chunk_text is the slice of the source. chunk_id is a deterministic name of (id, chunk_index).
    """
    rows = docs.select(id_col, F.posexplode(pack(F.col(text_col), **sizes)).alias("chunk_index", "c"))
    return rows.select(
        id_col, "chunk_index", F.col("c.body").alias("chunk_text"), F.col("c.start").alias("start_offset"), F.col("c.end").alias("end_offset"),
        F.col("c.first").alias("paragraph_start_index"), F.col("c.last").alias("paragraph_end_index"), F.sha1(F.concat_ws(":", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"))).alias("chunk_id"),
    )


def with_context(rows: DataFrame, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """The texts before and after each row of a document, null at its ends."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    return rows.withColumns({"previous_text": F.lag(text_col).over(w), "next_text": F.lead(text_col).over(w)})


def limit_chunks(rows: DataFrame, most: int) -> DataFrame:
    if most < 1:
        raise ValueError("the limit must be at least 1")
    return rows.filter(F.col("chunk_index") < most)
