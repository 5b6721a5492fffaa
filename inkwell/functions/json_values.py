"""JSON functions that Spark lacks: canonical form, containment and lenient parsing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from inkwell.functions import text


def number_of(value) -> Decimal | None:
    """The number that a JSON value shows; a truth value shows none."""
    if value is None or isinstance(value, bool):
        return None
    return Decimal(str(value)) if isinstance(value, (int, float, Decimal)) else text.plain_number(str(value))


def truth_of(value) -> bool | None:
    """The truth value that a JSON value shows."""
    word = text.plain_normalize("" if value is None else str(value))
    return word in text.TRUE_WORDS if word in text.TRUE_WORDS + text.FALSE_WORDS else None


def nodes(tree, at: tuple = ()) -> Iterator[tuple[tuple, object]]:
    """Every value of a JSON tree with its path."""
    yield at, tree
    inner = tree.items() if isinstance(tree, dict) else enumerate(tree) if isinstance(tree, list) else ()
    for k, v in inner:
        yield from nodes(v, (*at, k))


#: kind of wanted value -> (its types, whether a given value satisfies it), the first that fits.
KINDS = (
    ((dict,), lambda w, g: isinstance(g, dict)),
    ((list,), lambda w, g: isinstance(g, list) and len(g) == len(w)),
    ((bool,), lambda w, g: truth_of(g) == w),
    ((int, float, Decimal), lambda w, g: number_of(g) == number_of(w)),
    ((type(None),), lambda w, g: g is None),
    ((object,), lambda w, g: text.plain_normalize(str(g)) == text.plain_normalize(str(w))),
)


def contains(wanted, given) -> bool:
    """Whether given has all that wanted asks for: further fields of objects don't matter, lists must have equal length."""
    there = dict(nodes(given))
    return all(at in there and next(fits for types, fits in KINDS if isinstance(w, types))(w, there[at]) for at, w in nodes(wanted))


@F.pandas_udf(BooleanType())
def json_contains(wanted: pd.Series, given: pd.Series) -> pd.Series:
    """Null where wanted is null or an empty object."""
    def one(w, g):
        w = json.loads(w) if isinstance(w, str) else None
        return contains(w, json.loads(g) if isinstance(g, str) else None) if w else None

    return pd.Series([one(w, g) for w, g in zip(wanted, given, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """Keys sorted, no blanks, UTF-8 kept; 1 and 1.0 stay different. Text that is no JSON gives null."""
    def one(v):
        try:
            return json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(v, str) else None
        except ValueError:
            return None

    return values.map(one)


def lenient_object(c: Column) -> Column:
    """The JSON object in a model's answer: a code fence is removed, else the part from the first { to the last } is taken."""
    bare = text.strip(F.regexp_replace(text.strip(c), r"^```[A-Za-z]*\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(ok(bare) & bare.startswith("{"), bare).when((inner != "") & ok(inner), inner)


def summary_object(c: Column) -> Column:
    """A stored summary as JSON object text: nothing as {}, a scalar or text under the key value."""
    bare = text.strip(F.coalesce(c, F.lit("")))
    wrapped = F.concat(F.lit('{"value":'), F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(F.to_json(F.struct(bare.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(bare.alias("v")))) - 6)), F.lit("}"))
    return F.when(bare == "", "{}").when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare).otherwise(wrapped)


@F.pandas_udf(StringType())
def stable_uuid(values: pd.Series) -> pd.Series:
    """uuid5 in the namespace of URLs."""
    return values.map(lambda v: str(uuid.uuid5(uuid.NAMESPACE_URL, v)) if isinstance(v, str) else None)
