"""Column functions on text with Python's notions of white space, words and Unicode classes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

MARK = "\ufdd0"  # a code point that is no character
SPACE = r"[\s\x1c-\x1f]"
#: the characters of that class
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def rx(pattern: str, flags: str = "") -> str:
    """A pattern with Unicode classes and Unix line ends, whose \\s also takes U+001C to U+001F."""
    return f"(?Ud{flags})" + pattern.replace(r"\s", SPACE)


def let(value: Column, body) -> Column:
    """body of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Without white space at the ends; trimming looks only there, where a pattern is tried at each character."""
    return F.trim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, rx(r"\s+")), lambda w: w != "")


def fold(c: Column) -> Column:
    """White space folded to single blanks, none at the ends; null is empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), rx(r"\s+"), " "))


@pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Unicode NFKC, which no built-in function has; only texts beyond ASCII go to Python."""
    return F.coalesce(_nfkc(F.when(F.length(c) != F.octet_length(c), c)), c)


def hash_embedding(c: Column, dim: int = 64) -> Column:
    """A text's SHA-256 bytes, repeated to `dim` values from -1 to 1 and scaled to length 1: equal texts meet, others don't."""
    # the digest is read eight hex digits at once, each of its 32 bytes once
    group = lambda h, k: F.conv(F.substr(h, k * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
    byte = lambda gs, i: F.call_function("shiftright", F.get(gs, (i / 4).cast("int")), 24 - i % 4 * 8).bitwiseAND(255) / 255.0 * 2.0 - 1.0
    steps = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    repeated = lambda v: v if dim <= 32 else F.slice(F.concat(*[v] * -(-dim // 32)), 1, dim)
    groups = let(F.sha2(c, 256), lambda h: F.transform(steps(8), lambda k: group(h, k)))
    values = let(groups, lambda gs: F.transform(steps(min(dim, 32)), lambda i: byte(gs, i)))
    length = lambda v: F.sqrt(F.aggregate(repeated(v), F.lit(0.0), lambda s, x: s + x * x))
    return let(values, lambda v: let(length(v), lambda n: repeated(F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter of two lists."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def relation_type(c: Column) -> Column:
    """Trimmed, upper case, each blank an underscore; RELATED_TO where there is nothing."""
    return F.replace(F.upper(strip(F.when(F.coalesce(c, F.lit("")) == "", "RELATED_TO").otherwise(c))), F.lit(" "), F.lit("_"))


def edge_type(c: Column) -> Column:
    """As relation_type, with white space folded before; RELATED_TO where nothing is left."""
    folded = F.replace(F.upper(fold(c)), F.lit(" "), F.lit("_"))
    return F.when(folded == "", "RELATED_TO").otherwise(folded)


def is_number(c: Column) -> Column:
    return c.rlike(rx(r"^\d+(\.\d+)?$"))


def canonical_key(c: Column) -> Column:
    """A name's key: NFKC, plain dashes, lower case, only a-z, digits, plus, minus, period and blanks, without leading articles."""
    plain = F.lower(F.translate(strip(nfkc(F.coalesce(c, F.lit("")))), "–—", "--"))
    kept = fold(F.regexp_replace(plain, r"[^a-z0-9+\-. ]+", " "))
    return strip(F.regexp_replace(kept, "^((the|a|an)( |$))+", ""))


def fixed3(c: Column) -> Column:
    """Three decimals; exact ties go to the even digit (the formatter alone rounds them up)."""
    tie = F.abs(c * 16) % 2 == 1
    return F.when(tie, F.format_string("%.3f", F.bround(c.cast("decimal(30,6)"), 3).cast("double"))).otherwise(F.format_string("%.3f", c))
