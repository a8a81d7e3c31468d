"""The registry of queries and their DuckDB SQL, and SQL fragments that several oracles use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Python's white space, as characters
WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is long for each row: narrow rows compress so well that few tasks, or one, read millions of them, so they are dealt out."""
    return table(spark, sf_dir, name).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_strip(x: str) -> str:
    return f"trim({x}, '{WS}')"


def s_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda w_: w_ <> '')"


def s_fold(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def s_sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, '{flags}')"


def s_embedding(x: str) -> str:
    """The hash embedding of a text."""
    raw = f"list_transform(range(64), lambda i_: ('0x' || substr(sha256({x}), (i_ % 32 * 2 + 1)::int, 2))::int / 255.0::double * 2 - 1)"
    return f"list_transform([{raw}], lambda v_: list_transform(v_, lambda e_: e_ / sqrt(list_dot_product(v_, v_))))[1]"
