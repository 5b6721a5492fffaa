"""Where a quote stands in its source."""

from __future__ import annotations

import re
from bisect import bisect_left
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from inkwell.functions import text as T

#: So many patterns are looked for by one automaton instead of one by one.
MANY = 8
#: Fixed value: quotes with this matching ratio are of one passage.
RATIO = 0.9
CLASSES = 128
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
_RUN = re.compile(r"\s+")


def locate(source: Column, quote: Column, base: Column | None = None) -> Column:
    """(start, end) of the first occurrence, plus base; null where there is none or the quote is empty."""
    base = F.lit(0) if base is None else base
    at = F.call_function("instr", source, quote)
    return F.when((F.length(quote) > 0) & (at > 0), F.struct((base + at - 1).cast("int").alias("start"), (base + at - 1 + F.length(quote)).cast("int").alias("end")))


class Flat:
    """A text with each run of white space as one blank, and the way back to its offsets."""

    def __init__(self, text: str):
        self.runs: list[int] = []  # places of the runs of more than one character in the flat text
        self.more = [0]  # what these runs and all before them are longer
        parts, last, at = [], 0, 0
        for m in _RUN.finditer(text):
            a, b = m.span()
            parts += (text[last:a], " ")
            at += a - last + 1
            last = b
            if b - a > 1:
                self.runs.append(at - 1)
                self.more.append(self.more[-1] + b - a - 1)
        self.text = "".join([*parts, text[last:]])

    def origin(self, at: int) -> int:
        return at + self.more[bisect_left(self.runs, at)]


def _firsts(text: str, patterns: list[str]) -> list[int]:
    """Where each pattern (none is empty) stands first in a text, -1 for those that don't: many patterns share one pass."""
    if len(patterns) < MANY:
        return [text.find(p) for p in patterns]
    found = ahocorasick.Automaton()
    for p in patterns:
        found.add_word(p, p)
    found.make_automaton()
    first: dict[str, int] = {}
    for end, p in found.iter(text):
        if p not in first:
            first[p] = end + 1 - len(p)
    return [first.get(p, -1) for p in patterns]


def located(source: str | None, quotes: list[str | None]) -> list[tuple[int, int] | None]:
    """(start, end) of each quote in a source: its exact place, else the first one where any run of white space matches any other."""
    out: list[tuple[int, int] | None] = [None] * len(quotes)
    asked = [i for i, q in enumerate(quotes) if q] if source else []
    rest = []
    for i, at in zip(asked, _firsts(source, [quotes[i] for i in asked]) if asked else (), strict=True):
        if at >= 0:
            out[i] = at, at + len(quotes[i])
        elif _RUN.search(quotes[i]):
            rest.append(i)
    if rest:
        flat, wanted = Flat(source), [_RUN.sub(" ", quotes[i]) for i in rest]
        for i, q, at in zip(rest, wanted, _firsts(flat.text, wanted), strict=True):
            if at >= 0:
                out[i] = flat.origin(at), flat.origin(at + len(q))
    return out


@F.arrow_udf(SPANS)
def spans(source: pa.Array, quotes: pa.Array) -> pa.Array:
    """located() of each row: an array of (start, end), null for quotes that aren't there."""
    rows = [located(s, q or []) for s, q in zip(source.to_pylist(), quotes.to_pylist(), strict=True)]
    return pa.array([[x and {"start": x[0], "end": x[1]} for x in r] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def _shifted(at: Column, base: Column | None) -> Column:
    return at if base is None else F.when(at.isNotNull(), F.struct((base + at["start"]).cast("int").alias("start"), (base + at["end"]).cast("int").alias("end")))


def locate_spaced(source: Column, quote: Column, base: Column | None = None) -> Column:
    """Like locate(), but any run of white space matches any other, where the quote doesn't stand there as it is."""
    return _shifted(F.get(spans(source, F.array(quote)), F.lit(0)), base)


def locate_all(rows: DataFrame, quoted: str, source: str, base: str | None = None) -> DataFrame:
    """The quotes of an array of structs with their offsets, in one pass over the source; offsets that were there before are ignored."""
    found = rows.withColumn("_ink_at", spans(F.col(source), F.transform(quoted, lambda s: s["quote"])))
    shifted = lambda at: _shifted(at, F.col(base) if base else None)
    one = F.zip_with(quoted, "_ink_at", lambda s, at: F.struct(s["quote"].alias("quote"), shifted(at)["start"].alias("start_offset"), shifted(at)["end"].alias("end_offset")))
    return found.withColumn(quoted, one).drop("_ink_at")


def locate_quotes(texts: DataFrame, quotes: DataFrame, key: str, text: str = "text", quote: str = "quote", most: int = 1000) -> DataFrame:
    """quotes with `at`, the (start, end) of each in the text of its key, null where it isn't there.

    The distinct quotes of a text are looked for together, at most about `most` in a row, so the text is read once for all of these. A quote
    whose key has no text isn't there. texts: one row a key.
    """
    asked = quotes.select(F.col(key).alias("_k"), F.col(quote).alias("_q")).filter(F.length("_q") > 0).distinct()
    parts = asked.groupBy("_k").agg(F.ceil(F.count(F.lit(1)) / most).alias("_n"))
    groups = asked.join(parts, "_k").groupBy("_k", F.pmod(F.xxhash64("_q"), F.col("_n")).alias("_part")).agg(F.collect_list("_q").alias("_qs"))
    found = groups.join(texts.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_k").select("_k", F.explode(F.arrays_zip("_qs", spans("_t", "_qs").alias("_at"))).alias("_x"))
    found = found.select("_k", F.col("_x._qs").alias("_q"), F.col("_x._at").alias("at")).filter("at is not null")
    return quotes.join(found, (quotes[key] == F.col("_k")) & (quotes[quote] == F.col("_q")), "left").drop("_k", "_q")


def verified(source: Column, quote: Column, start: Column, end: Column) -> Column:
    """Whether the slice of the source is the quote."""
    return F.coalesce(F.substring(source, start + 1, end - start) == quote, F.lit(False))


def excerpt(source: Column, quotes: Column, around: int = 300, most: int = 600) -> Column:
    """The source around the first quote that it holds, else its beginning."""
    found = F.get(F.filter(quotes, lambda q: (F.length(q) > 0) & source.contains(q)), 0)
    at = F.call_function("instr", source, found) - 1
    start = F.greatest(at - around, F.lit(0))
    return F.when(at.isNotNull(), F.substring(source, start + 1, F.least(at + F.length(found) + around, F.length(source)) - start)).otherwise(F.substring(source, F.lit(1), F.lit(most)))


def _counts(texts: list[str]) -> np.ndarray:
    """How many characters of each text fall into each of CLASSES classes."""
    out = np.zeros((len(texts), CLASSES), np.int64)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES, minlength=CLASSES)
    return out


def possible(left: list[str], right: list[str], ratio: float = RATIO) -> np.ndarray:
    """Which pairs of texts can be as alike as `ratio`: twice the characters that they have in common, over the characters of both, bounds the matching ratio.

    First by the lengths alone, then by the characters of a class. Both are upper bounds, so no pair that is alike is left out.
    """
    m, n = (np.array([len(t) for t in x], np.int64) for x in (left, right))
    both = m[:, None] + n[None]
    out = 2 * np.minimum(m[:, None], n[None]) >= ratio * both - 1e-9
    i, j = np.nonzero(out)
    if len(i):
        a, b = _counts(left), _counts(right)
        for at in range(0, len(i), 20_000):
            p, q = i[at : at + 20_000], j[at : at + 20_000]
            out[p, q] = 2 * np.minimum(a[p], b[q]).sum(1) >= ratio * both[p, q] - 1e-9
    return out


def alike(left: list[str], right: list[str], ratio: float = RATIO) -> np.ndarray:
    """Which pairs of normalised quotes are of one passage: one holds the other, or their matching ratio reaches `ratio`. The ratio is only computed where it can."""
    out = np.array([[bool(a and b) and (a in b or b in a) for b in right] for a in left], bool).reshape(len(left), len(right))
    for i, j in zip(*np.nonzero(~out & possible(left, right, ratio)), strict=True):
        if left[i] and right[j]:
            out[i, j] = SequenceMatcher(None, left[i], right[j]).ratio() >= ratio
    return out


def same_span(left: str, right: str, ratio: float = RATIO) -> bool:
    """Two quotes of one passage: one holds the other, or they are alike, after normalisation."""
    return bool(alike([T.plain_normalize(left)], [T.plain_normalize(right)], ratio)[0, 0])


def covered(left: list[str], right: list[str]) -> int:
    """How many of the normalised quotes on the left are alike() one on the right. Most hold one another; only the rest needs bounds and ratios."""
    rest = [a for a in left if a and not any(b and (a in b or b in a) for b in right)]
    held = sum(map(bool, left)) - len(rest)
    return held + (int(alike(rest, right).any(1).sum()) if rest and right else 0)


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("quotes", "locatable", "gold", "covered")]))
def evaluate(gold: pd.Series, given: pd.Series, source: pd.Series) -> pd.DataFrame:
    """Counts of the given quotes, those found in the source, the gold quotes, and those that a given quote covers."""
    rows, seen, whole = [], None, ""
    for g, p, s in zip(gold, given, source, strict=True):
        g, p = ([T.plain_normalize(q) for q in (x if x is not None else [])] for x in (g, p))
        if s is not seen and s != seen:  # the rows of an episode have equal texts, which needn't be one object
            seen, whole = s, T.plain_normalize(s if isinstance(s, str) else None)
        rows.append((len(p), sum(bool(whole) and q in whole for q in p), len(g), covered(g, p)))
    return pd.DataFrame(rows, columns=["quotes", "locatable", "gold", "covered"])


def acceptable(e: Column, has_source: Column) -> Column:
    """Gold quotes, where there are any, are covered, and with a source there are quotes and every one is found in it."""
    return ((e["gold"] == 0) | (e["covered"] > 0)) & (~has_source | ((e["quotes"] > 0) & (e["locatable"] == e["quotes"])))
