"""Token counts by offset-mapped attribution.

A document is encoded once. The vocabulary is byte-level, so the tokens cover the UTF-8 bytes without gaps, and the running
sum of their byte lengths gives every token's span. Spans are joined to the document's sections by binary search over the
section bounds. A token that crosses a boundary goes, by the explicit rule, to the section of its first byte ("start") or to
the one that holds most of its bytes, the earlier one on a tie ("majority"); so the counts of the sections always add up to
the document's tokens.

Fast path: tiktoken over the ranks of the same vocabulary (a test holds its ids against the tokenizers library); texts
that it refuses go to the tokenizers library itself.

Defined results. Null or empty text: no sections, no rows from attribute(), an empty id list from encode(). A section
without a token of its own gets 0. Repeated rows and ids: each row is counted by itself. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm import common

VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
RULES = ("start", "majority")


@lru_cache(1)
def _ranks() -> dict[bytes, int]:
    with open(public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(1)
def _fast():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(), special_tokens=SPECIAL)


@lru_cache(1)
def _plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{VOCABULARY}.json"))


@lru_cache(1)
def byte_lengths() -> np.ndarray:
    """Bytes of each token id."""
    out = np.zeros(max(max(_ranks().values()), *SPECIAL.values()) + 1, np.int64)
    for token, i in (_ranks() | {k.encode(): v for k, v in SPECIAL.items()}).items():
        out[i] = len(token)
    return out


def encode(text: str | None) -> np.ndarray:
    """Ids (little-endian unsigned 32 bit) of the text, without special tokens added."""
    if not text:
        return np.zeros(0, "<u4")
    try:
        ids = _fast().encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else _fast().encode_ordinary(text)
    except BaseException as e:  # a panic of its regex engine on odd input is no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        ids = _plain().encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4")


def spans(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end byte of each token."""
    ends = np.cumsum(byte_lengths()[ids])
    return np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends


def allocate(ids: np.ndarray, ends: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section; ends: end bytes of the sections, ascending, the last one the text's length."""
    first, last = spans(ids)
    at = np.searchsorted(ends, first, side="right")
    if rule == "majority":
        to = np.searchsorted(ends, last, side="left")
        for i in np.flatnonzero(to > at):
            cuts = np.concatenate(([first[i]], ends[at[i] : to[i]], [last[i]]))
            at[i] += int(np.argmax(np.diff(cuts)))
    elif rule != "start":
        raise ValueError(f"rule must be one of {RULES}")
    return np.bincount(at, minlength=len(ends))[: len(ends)]


def line_ends(text: bytes) -> np.ndarray:
    """End bytes of the lines; a line holds its line feed, and an empty last line is none."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attribute(df: DataFrame, id_col: str, fields: list[str], lines: bool = False, rule: str = "start") -> DataFrame:
    """(id, field, section, start, end, n_tokens) for each section of each row.

    The fields of a row are joined without a separator into one document, null as empty, and encoded once. Sections are the
    fields, or the lines of the fields. start and end are bytes in the field.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if id_col.lower() in ("field", "section", "start", "end", "n_tokens"):
        raise ValueError(f"id_col {id_col!r} is the name of a column of the result; rename it first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row, *parts in zip(batch.column(0).to_pylist(), *(common.utf8(batch, f"f{i}") for i in range(len(fields))), strict=True):
                ends, names, sections, starts = [], [], [], []
                base = 0
                for name, part in zip(fields, parts, strict=True):
                    if part:
                        own = line_ends(part) if lines else np.array([len(part)])
                        ends.append(own + base)
                        names += [name] * len(own)
                        sections += range(len(own))
                        starts.append(np.concatenate(([0], own[:-1])))
                        base += len(part)
                if not ends:
                    continue
                bounds, begun = np.concatenate(ends), np.concatenate(starts)
                counts = allocate(encode(b"".join(p for p in parts if p).decode()), bounds, rule)
                widths = np.diff(np.concatenate(([0], bounds)))
                for to, x in zip(out, ([row] * len(names), names, sections, begun, begun + widths, counts), strict=True):
                    to.extend(x)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[id_col, "field", "section", "start", "end", "n_tokens"])

    source = df.select(df[id_col].alias(id_col), *(df[f].cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    return source.mapInArrow(common.tidied(run), f"`{id_col}` {source.schema[0].dataType.simpleString()}, field string, section long, start long, end long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return attribute(common.read(spark, sf_dir, "documents"), "doc_id", ["text"], lines=True).drop("field")
