"""Document fingerprints by winnowing, with DataFrame functions only.

A text's words (lower-cased, split at spaces, tabs and line breaks) give one hash per `k` words in a row, a shorter text one hash of all its
words.  Scripts without blanks between words give a word for each character, and so does a run of more than LONG characters without a
blank (data, minified code), so that the guarantee below holds there too.  Of every `window` hashes in a row the smallest is chosen, the
rightmost of equal ones; chosen (hash, position) pairs are the fingerprint.  Two texts that share window + k - 1 words in a row share a
chosen hash, at the positions kept.

Each word is hashed once; hashes of k words roll out of those of fewer, as polynomials modulo a prime, in about 2 * log2(k) steps over the
text.  Hash and position live in one long (31 bits of hash, then 32 that fall as the position rises), so the smallest long of a window is
the rightmost smallest hash; minima over windows come from minima over halves of windows.

A null text counts as empty, and an empty or blank text has an empty fingerprint.  Likeness is shared over all distinct hashes; two empty
fingerprints are alike (1), an empty and another one not (0).  Repeated rows each count as documents; other columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.base import partitions, range_bounds, range_bucket

PLACES = 32
LAST = (1 << PLACES) - 1
PRIME, BASE = 2147483629, 1000003
LONG = 32
_BLANK = "[\\t-\\r ]"
#: scripts that put no blanks between words (fixed value)
_SCRIPTS = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}\\p{IsTibetan}]"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """A text's words; characters for words where there are no blanks."""
    low = F.lower(text)
    plain = F.filter(F.split(low, f"{_BLANK}+"), lambda w: w != "")
    apart = F.filter(F.split(F.regexp_replace(low, _SCRIPTS, " $0 "), f"{_BLANK}+"), lambda w: w != "")
    each = F.flatten(F.transform(apart, lambda w: F.when(F.length(w) > LONG, F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))).otherwise(F.array(w))))
    odd = low.rlike(f"(?:^|{_BLANK})[^\\t-\\r ]{{{LONG + 1}}}") | ((F.length(low) != F.octet_length(low)) & low.rlike(_SCRIPTS))
    return F.when(odd, each).otherwise(plain)


def rolled(hashes: Column, k: int, placed) -> Column:
    """Hashes of k in a row, by doubling: those of n and m in a row give those of n + m; placed(hash, position) of each."""

    def joined(x: Column, n: int, y: Column, m: int) -> Column:
        scale, last = pow(BASE, m, PRIME), n + m == k
        value = lambda v, i: (v * scale + F.get(y, i + n)) % PRIME
        return F.transform(F.slice(x, 1, F.greatest(F.size(y) - n, F.lit(0))), (lambda v, i: placed(value(v, i), i)) if last else value)

    def grown(x: Column, n: int, bits: str) -> Column:
        if not bits:
            return x if k > 1 else F.transform(x, placed)
        return _let(joined(x, n, x, n), lambda two: grown(two, 2 * n, bits[1:]) if bits[0] == "0" else _let(joined(two, 2 * n, hashes, 1), lambda odd: grown(odd, 2 * n + 1, bits[1:])))

    return grown(hashes, 1, bin(k)[3:])


def picks(text: Column, k: int, window: int) -> Column:
    """The chosen hashes as longs, in the order of their positions."""
    placed = lambda h, i: h * (1 << PLACES) + (LAST - i)

    def hashes(w: Column) -> Column:
        grams = _let(F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))), lambda h: rolled(h, k, placed))
        return F.when(F.size(w) >= k, grams).when(F.size(w) > 0, F.array(placed(F.pmod(F.xxhash64(w), F.lit(PRIME)), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    def minima(a: Column, step: int) -> Column:
        """Minima over width + step from minima over width, step being at most width."""
        return _let(a, lambda x: F.when(F.size(x) > step, F.transform(F.slice(x, 1, F.size(x) - step), lambda v, i: F.least(v, F.get(x, i + step)))).otherwise(x))

    def chosen(h: Column) -> Column:
        # a text of fewer hashes than a window is one window
        out, width = h, 1
        while width < window:
            step = min(width, window - width)
            out = minima(out, step)
            width += step
        return F.when(F.size(h) > window, F.array_distinct(out)).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)

    return _let(_let(words(text), hashes), chosen)


def fingerprint(picked: Column) -> Column:
    """Chosen pairs as text: hash in hex, a colon and the position, comma-joined."""
    return F.array_join(F.transform(picked, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, PLACES))), F.lit(":"), (LAST - x.bitwiseAND(LAST)).cast("string"))), ",")


def pairs(picked: Column) -> Column:
    """Chosen pairs as array<struct<hash, position>>."""
    return F.transform(picked, lambda x: F.struct(F.shiftright(x, PLACES).alias("hash"), (LAST - x.bitwiseAND(LAST)).alias("position")))


def likeness(a: Column, b: Column) -> Column:
    """Shared over all distinct hashes of two lists of chosen pairs, 0 to 1."""
    distinct = lambda p: F.array_distinct(F.transform(p, lambda x: F.shiftright(x, PLACES)))
    return _let(
        F.struct(distinct(a).alias("x"), distinct(b).alias("y")),
        lambda s: _let(F.size(F.array_intersect(s["x"], s["y"])), lambda n: F.when(F.size(s["x"]) + F.size(s["y"]) == 0, F.lit(1.0)).otherwise(n / (F.size(s["x"]) + F.size(s["y"]) - n))),
    )


def with_next(docs: DataFrame, k: int, window: int) -> DataFrame:
    """doc_id, text, picked, and next_text and next_picked of the following document by doc_id (ties by text); the first follows the last.

    Texts move once: rows go to ranges of doc_id, each with a copy of the row that begins the next range.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", 4 * partitions(spark))
    least = docs.agg(F.min("doc_id").alias("least")).first()["least"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    home = range_bucket(F.col("doc_id"), bounds)
    # a range begins with its bound, which is an id of the table; the smallest id of all follows the last range
    first = F.lit(False) if least is None else F.col("doc_id") == least
    nulls = rows.filter("doc_id is null").limit(1).count() if least is not None else 0
    if nulls:
        first = F.col("doc_id").isNull()
    begins = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    places = F.array_compact(F.array(home.cast("int"), F.when(begins, home.cast("int") - 1), F.when(first | F.lit(least is None), F.lit(len(bounds)))))
    placed = rows.select("doc_id", "text", F.posexplode(F.when(begins | first | F.lit(least is None), places).otherwise(F.array(home.cast("int")))).alias("copy", "range"))
    placed = placed.repartition("range").withColumn("picked", picks(F.col("text"), k, window))
    order = Window.partitionBy("range").orderBy(F.col("copy") > 0, F.col("copy") == 2, "doc_id", "text")
    placed = placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_picked", F.lead("picked").over(order))
    return placed.filter("copy = 0").drop("copy", "range")


def compare(docs: DataFrame, k: int = 5, window: int = 12) -> DataFrame:
    """Each document's fingerprint, that of its text with the last half replaced by the beginning of the next document, and likenesses.

    doc_id, text, edited, picked, edited_picked, near_edited, near_next.
    """
    rows = with_next(docs, k, window)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "text", edited.alias("edited"), "picked", likeness(F.col("picked"), F.col("next_picked")).alias("near_next"))
    rows = rows.withColumn("edited_picked", picks(F.col("edited"), k, window))
    return rows.withColumn("near_edited", likeness(F.col("picked"), F.col("edited_picked")))
