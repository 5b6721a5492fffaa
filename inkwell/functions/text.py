"""Scalar text functions. Built-ins wherever Spark has them; NFKC and full case folding need an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: what Python calls white space, as a character class for Spark's regular expressions.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed value: a line with its terminator; C stands for every line break.
LINE = r"[^C]*(?:\r\n|[C])|[^C]+".replace("C", r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}")
#: Fixed value: a text up to and with its first number, which is group 1.
NUMBER = r"[^\d+\-]*([+\-]?\d+(?:\.\d+)?)"
#: Words that stand for a truth value.
TRUE_WORDS = ("true", "1", "yes", "y", "예", "참")
FALSE_WORDS = ("false", "0", "no", "n", "아니오", "거짓")
#: Any other character than white space.
SOLID = "[^" + SPACE[1:]
_PY_SPACE, _PY_NUMBER = re.compile(r"\s+"), re.compile(NUMBER)


def strip(c: Column) -> Column:
    """Without white space at both ends, in the sense of SPACE."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(c, f"{SPACE}+", " ")


def fold(c: Column) -> Column:
    """Case folding by built-ins: the lower case of the upper case, which unfolds letters such as sharp s, with one sigma. Only dotless i, capital sharp s and Cherokee differ."""
    # the inner translate() changes nothing, but keeps the optimizer from taking lower(upper(c)) for lower(c)
    return F.translate(F.lower(F.translate(F.upper(c), "ς", "Σ")), "ς", "σ")


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility characters in their plain form, as full-width digits; null stays null."""
    return values.map(lambda v: v if not isinstance(v, str) or v.isascii() else unicodedata.normalize("NFKC", v))


def plain_normalize(value: str | None) -> str:
    """NFKC, white space squeezed and stripped, case folded."""
    return _PY_SPACE.sub(" ", unicodedata.normalize("NFKC", value)).strip().casefold() if value else ""


@F.pandas_udf(StringType())
def normalize_text(values: pd.Series) -> pd.Series:
    """plain_normalize of each value; null gives the empty text."""
    return values.map(lambda v: plain_normalize(v) if isinstance(v, str) else "")


def plain_fact_key(value: str) -> str:
    """NFKC and case folding, each segment between dots stripped, blanks as underscores."""
    whole = unicodedata.normalize("NFKC", value).strip().casefold()
    return ".".join(part.strip().replace(" ", "_") for part in whole.split("."))


@F.pandas_udf(StringType())
def fact_key(values: pd.Series) -> pd.Series:
    return values.map(lambda v: plain_fact_key(v) if isinstance(v, str) else None)


def plain_id_part(value: str) -> str:
    return unicodedata.normalize("NFKC", value).strip().casefold().replace(" ", "_")


@F.pandas_udf(StringType())
def id_part(values: pd.Series) -> pd.Series:
    """A name or key as a part of a gold id: NFKC, stripped, case folded, blanks as underscores."""
    return values.map(lambda v: plain_id_part(v) if isinstance(v, str) else None)


def plain_number(value: str) -> Decimal | None:
    """The first number of a text, after NFKC and without commas; None where there is none."""
    m = _PY_NUMBER.match(unicodedata.normalize("NFKC", value).replace(",", "").strip())
    return Decimal(m[1]) if m else None


def parse_decimal(c: Column) -> Column:
    """plain_number as a column, for the digits 0 to 9 in any width; null beyond 28 digits before the point, and rounded beyond 10 behind it."""
    first = F.regexp_extract(strip(F.regexp_replace(nfkc(c), ",", "")), f"^{NUMBER}", 1)
    return F.when(first != "", first.try_cast("decimal(38,10)"))


def parse_boolean(c: Column) -> Column:
    word = fold(strip(squeeze(nfkc(c))))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def confidence(c: Column) -> Column:
    """A confidence as it is stored: four digits after the point, rounded half up from its shortest decimal form."""
    return c.cast("string").cast("decimal(5,4)")


def truncate(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def content_version(c: Column, prefix: str, digits: int = 12) -> Column:
    """Content-addressed name: a prefix and the first hex digits of the SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, digits))


def percent(c: Column) -> Column:
    """A ratio as a percentage with two digits, 'pending' where it is null."""
    return F.coalesce(F.format_string("%.2f%%", c * 100), F.lit("pending"))
