"""Text cleaning: a fixed chain of rewrites, a cut at the first closing heading, and whole-word expansions.

Every function takes and gives a Column, so a chain stays one projection over the scan.  A null text becomes empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.config import Cleaning
from loomtext.functions.text import MARK, let, nfkc, rx, strip
from loomtext.sources.staging import small_batches

BULLETS = "•▪■►◆▶●◦"  # fixed value
_NUMBERS = r"\s*\d+\s*(?:[-–]\s*\d+\s*)?"


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def join_hyphenated(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"(\w)-\n(\w)"), "$1$2")


def drop_citations(c: Column) -> Column:
    """Without [1], [1, 2] and [3-5, 7]."""
    return F.regexp_replace(c, rx(rf"\[{_NUMBERS}(?:,{_NUMBERS})*\]"), "")


def drop_years(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"\(\s*\d{4}\s*\)"), "")


def drop_bullets(c: Column) -> Column:
    return F.translate(c, BULLETS, "")


def drop_decoration(c: Column) -> Column:
    """Three or more of one of - = _ * become a blank."""
    return F.regexp_replace(c, "-{3,}|={3,}|_{3,}|\\*{3,}", " ")


def drop_display_latex(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)\\\[.*?\\\]", " "), r"(?s)\$\$.*?\$\$", " ")


def drop_inline_latex(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"\$(?!\s).*?(?<!\s)\$", "s"), " ")


def fold_blanks(c: Column) -> Column:
    return F.regexp_replace(c, "[ \t]+", " ")


#: the steps that a Cleaning names
STEPS: dict[str, Callable[[Column], Column]] = {
    "nul": lambda c: F.replace(c, F.lit("\0"), F.lit("")),
    "newlines": newlines,
    "nfkc": nfkc,
    "hyphens": join_hyphenated,
    "citations": drop_citations,
    "years": drop_years,
    "bullets": drop_bullets,
    "decoration": drop_decoration,
    "display_latex": drop_display_latex,
    "inline_latex": drop_inline_latex,
    "blanks": fold_blanks,
    "blank_lines": lambda c: F.regexp_replace(c, "\n{3,}", "\n\n"),
    "ends": strip,
}


def clean_text(c: Column, cleaning: Cleaning = Cleaning()) -> Column:
    return reduce(lambda x, name: STEPS[name](x), cleaning.steps, F.coalesce(c, F.lit("")))


def cut_at_stop_heading(c: Column, cleaning: Cleaning = Cleaning()) -> Column:
    """What stands before the first line that is only a closing heading (numbered or not)."""
    names = "|".join(cleaning.endings)

    def stops(line: Column) -> Column:
        bare = F.lower(strip(line))
        return F.length(bare).between(1, 59) & bare.rlike(rx(rf"^(\d+\.?\s*)?({names})$", "i"))

    text = F.coalesce(c, F.lit(""))
    before = lambda lines, at: F.when(at == 0, text).otherwise(F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0)).cast("int")), "\n"))
    return strip(let(F.split(text, "\n"), lambda lines: let(F.array_position(F.transform(lines, stops), True), lambda at: before(lines, at))))


def _one_after_another(c: Column, expansions: list[tuple[str, str]]) -> Column:
    quoted = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return reduce(lambda x, kv: F.regexp_replace(x, rx(rf"\b\Q{kv[0]}\E\b", "i"), quoted(kv[1])), expansions, c)


def closed_expansions(expansions: list[tuple[str, str]]) -> dict[str, str] | None:
    """What each word becomes after all expansions, one after another; None where they could meet each other or the text around them.

    That can't be if words are of ASCII word characters alone and expansions begin and end with one: a word is then a whole run of such
    characters, before and after.
    """
    if not all(re.fullmatch(r"[A-Za-z0-9_]+", k) and re.fullmatch(r"\w(.*\w)?", v, re.DOTALL) for k, v in expansions):
        return None
    closed: dict[str, str] = {}
    for i, (word, text) in enumerate(expansions):
        for later, longer in expansions[i + 1 :]:
            text = re.sub(rf"\b{re.escape(later)}\b", lambda _, longer=longer: longer, text, flags=re.IGNORECASE)
        closed.setdefault(word.lower(), text)
    return closed


def expand_synonyms(c: Column, cleaning: Cleaning = Cleaning()) -> Column:
    """Whole words, whatever their case, spelled out one after another, longest first (so an expansion can be expanded).

    One search marks them all, and each hit takes the text that it ends up as; expansions that could meet each other are made one by one.
    """
    ordered = sorted(cleaning.expansions.items(), key=lambda kv: len(kv[0]), reverse=True)
    closed = closed_expansions(ordered)
    if not closed:
        return _one_after_another(c, ordered)
    first = "".join(sorted({re.escape(k[0]) for k in closed}))
    some = rx(rf"(?=[{first}])\b({'|'.join(closed)})\b", "i")
    texts = F.create_map(*(F.lit(x) for kv in closed.items() for x in kv))
    plain = lambda hit: F.lower(F.translate(hit, "\u017f\u0131\u0130", "sii"))  # noqa: E731  (what a search without case takes for s and i; lower knows the others)
    spelled = lambda hit: F.coalesce(F.try_element_at(texts, plain(hit)), hit)

    def put(marked: Column) -> Column:
        pieces = F.transform(F.split(marked, MARK), lambda x, i: F.when(i % 2 == 1, spelled(x)).otherwise(x))
        return F.when(F.contains(marked, F.lit(MARK)), F.array_join(pieces, "")).otherwise(c)

    one = let(F.regexp_replace(c, some, f"{MARK}$1{MARK}"), put)
    return F.when(F.contains(c, F.lit(MARK)), _one_after_another(c, ordered)).otherwise(one)


def preprocess_text(c: Column, cleaning: Cleaning = Cleaning()) -> Column:
    """Cleaning, cut and expansion of a text that is already in normal form: Spark allows no Python function below a lambda, so `preprocess` makes that its own step."""
    return expand_synonyms(cut_at_stop_heading(clean_text(c, cleaning.without("nfkc")), cleaning), cleaning)


def preprocess(docs: DataFrame, cleaning: Cleaning = Cleaning(), column: str = "text") -> DataFrame:
    """docs with the column put in normal form, then cleaned, cut and expanded."""
    small_batches(docs.sparkSession)  # whole texts go to Python for their normal form
    first = replace(cleaning, steps=tuple(s for s in cleaning.steps if s in ("nul", "newlines", "nfkc")))
    return docs.withColumn(column, clean_text(F.col(column).cast("string"), first)).withColumn(column, preprocess_text(F.col(column), cleaning))
