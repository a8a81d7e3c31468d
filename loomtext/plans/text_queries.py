"""Queries on text: cleaning, chunking, ranking, vector search.  The documents hold none of what cleaning removes, so queries put it in first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.config import SECTION_HEADINGS, STOP_HEADINGS, SYNONYMS, Chunking, Ranking
from loomtext.functions import text as T
from loomtext.operators import chunk, clean, rank, retrieve, vector
from loomtext.plans.register import LETTER, WS, dealt, query, quoted, s_embedding, s_fold, s_strip, s_sub, s_words, table
from loomtext.sources.layout import layout_elements
from loomtext.sources.readers import decoded, element_sections, flatten_sections, html_elements
from loomtext.sources.staging import small_batches

DOC = "coalesce(text, '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _lines_end(c: Column, with_: str) -> Column:
    """Text put before each line end and at the end."""
    return F.concat(F.replace(c, F.lit("\n"), F.lit(with_ + "\n")), F.lit(with_))


def s_lines_end(with_: str) -> str:
    return f"(replace({DOC}, '\n', {quoted(with_)} || '\n') || {quoted(with_)})"


def _one(sql_text: str) -> str:
    return f"select doc_id, {sql_text} as text from documents"


_ws = f"[{WS}]*"
_numbers = rf"{_ws}\p{{Nd}}+{_ws}(?:[-–]{_ws}\p{{Nd}}+{_ws})?"
CITATIONS, S_CITATIONS = " [1, 2] so [3-5, 7] [x]", rf"\[{_numbers}(?:,{_numbers})*\]"
YEARS, S_YEARS = " (2019) ( 1998 ) (123)", rf"\({_ws}\p{{Nd}}{{4}}{_ws}\)"
DECOR, S_DECOR = "\n-----\n====\n__ ***", "-{3,}|={3,}|_{3,}|\\*{3,}"
BULLETS = " • one ▪ two ◦"
SPACES = " \t two\r\n\r\n\r\n\rthree"


@query(_one(s_sub(s_lines_end(CITATIONS), S_CITATIONS, "")))
def clean_citations(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.drop_citations(_lines_end(F.col("text"), CITATIONS)).alias("text"))


@query(_one(s_sub(s_lines_end(YEARS), S_YEARS, "")))
def clean_years(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.drop_years(_lines_end(F.col("text"), YEARS)).alias("text"))


@query(_one(s_sub(s_lines_end(DECOR), S_DECOR, " ")))
def clean_decor(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.drop_decoration(_lines_end(F.col("text"), DECOR)).alias("text"))


@query(_one(s_sub(s_lines_end(BULLETS), f"[{clean.BULLETS}]", "")))
def clean_bullets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.drop_bullets(_lines_end(F.col("text"), BULLETS)).alias("text"))


def s_whitespace(x: str) -> str:
    return s_strip(s_sub(s_sub(s_sub(x, "\r\n?", "\n"), "[ \t]+", " "), "\n{3,}", "\n\n"))


@query(_one(s_whitespace(s_lines_end(SPACES))))
def clean_ws(spark, sf_dir):
    folded = clean.fold_blanks(clean.newlines(_lines_end(F.col("text"), SPACES)))
    return _docs(spark, sf_dir).select("doc_id", T.strip(F.regexp_replace(folded, "\n{3,}", "\n\n")).alias("text"))


def s_join(x: str) -> str:
    return s_sub(x, rf"({LETTER})-\n({LETTER})", r"\1\2")


@query(_one(s_join(s_sub(DOC, "([a-z]{3})([a-z]{3})", "\\1-\n\\2"))))
def clean_hyphen(spark, sf_dir):
    broken = F.regexp_replace("text", "([a-z]{3})([a-z]{3})", "$1-\n$2")
    return _docs(spark, sf_dir).select("doc_id", clean.join_hyphenated(broken).alias("text"))


@query(_one(f"{DOC} || ' fine 12  x2'"))
def clean_nfkc(spark, sf_dir):
    """Ligatures, full-width digits and no-break blanks; the oracle has no such function, but documents are in normal form already."""
    return _docs(spark, sf_dir).select("doc_id", T.nfkc(F.concat("text", F.lit(" ﬁne １２ \u00a0x²"))).alias("text"))


@query(_one(f"{DOC} || 'x'"))
def clean_nul(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.STEPS["nul"](F.concat("text", F.lit("\0x\0"))).alias("text"))


S_NO_SIGNS = s_sub(DOC, r"[$\\]", "")


@query(f"select doc_id, 'a     c $ 5 ' || {S_NO_SIGNS} || ' 6 $ d   ' || {S_NO_SIGNS} as text from documents")
def clean_latex(spark, sf_dir):
    """Formulas around, within and between whole texts; a dollar before a blank opens none.  Dollars and backslashes of the texts themselves go first, so the oracle names what stays."""
    text = F.regexp_replace("text", r"[$\\\\]", "")
    made = F.concat(F.lit("a \\[x\n"), text, F.lit("\\] $$"), text, F.lit("$$ c $ 5 "), text, F.lit(" 6 $ d $a\nb$ "), text)
    return _docs(spark, sf_dir).select("doc_id", clean.drop_inline_latex(clean.drop_display_latex(made)).alias("text"))


EVERY = CITATIONS + YEARS + BULLETS + DECOR + SPACES + " end-\nings"
S_EVERY = reduce(lambda x, r: s_sub(x, *r), [(S_CITATIONS, ""), (S_YEARS, ""), (f"[{clean.BULLETS}]", ""), (S_DECOR, " ")], s_join(s_sub(s_lines_end(EVERY), "\r\n?", "\n")))


@query(_one(s_whitespace(S_EVERY)))
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.clean_text(_lines_end(F.col("text"), EVERY)).alias("text"))


@query(f"""
select doc_id, {s_strip("case when stop is null then t else array_to_string(lines[1:stop - 1], '\n') end")} as text from (
  select *, list_position(list_transform(lines, lambda x: regexp_matches(lower({s_strip("x")}), '^([0-9]+\\.?[{WS}]*)?({"|".join(STOP_HEADINGS)})$')), true) as stop
  from (select doc_id, t, string_split(t, '\n') as lines from (select doc_id, replace({DOC}, '. ', '.\n 3. Data Availability \n') as t from documents)))
""")
def stop_heading_cut(spark, sf_dir):
    headed = F.replace("text", F.lit(". "), F.lit(".\n 3. Data Availability \n"))
    return _docs(spark, sf_dir).select("doc_id", clean.cut_at_stop_heading(headed).alias("text"))


TERMS = " (llms) LLM, kg KGs; nlp gnn Transformer cnn-rnn"


@query(_one(reduce(lambda x, k: s_sub(x, rf"\b{k}\b", SYNONYMS[k], "gi"), sorted(SYNONYMS, key=len, reverse=True), s_lines_end(TERMS))))
def entity_expand(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.expand_synonyms(_lines_end(F.col("text"), TERMS)).alias("text"))


CHAINED = TERMS + EVERY + "\n 3. References "
S_PREPARED = s_whitespace(S_EVERY.replace(s_lines_end(EVERY), s_lines_end(CHAINED)))


@query(f"""select doc_id, {reduce(lambda x, k: s_sub(x, rf"\b{k}\b", SYNONYMS[k], "gi"), sorted(SYNONYMS, key=len, reverse=True), "t")} as text from (
  select doc_id, {s_strip("case when stop is null then t else array_to_string(lines[1:stop - 1], '\n') end")} as t from (
    select *, list_position(list_transform(lines, lambda x: regexp_matches(lower({s_strip("x")}), '^([0-9]+\\.?[{WS}]*)?({"|".join(STOP_HEADINGS)})$')), true) as stop
    from (select doc_id, t, string_split(t, '\n') as lines from (select doc_id, {S_PREPARED} as t from documents))))""")
def preprocessed(spark, sf_dir):
    """The whole chain: every kind of thing to clean, a closing heading after each line end, terms to spell out."""
    return clean.preprocess(_docs(spark, sf_dir).select("doc_id", _lines_end(F.col("text"), CHAINED).alias("text")))


# chunkers: arrays in Spark, lists in the oracle
def _exploded(spark: SparkSession, sf_dir: str, chunks: Column, source: Column | None = None) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", (F.col("text") if source is None else source).alias("text"))
    return rows.select("doc_id", F.posexplode(chunks).alias("chunk_no", "text")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


def _listed(with_: str, chunks: str) -> str:
    """SQL that numbers the elements of a list of texts of `s`."""
    return f"with s as ({with_}), l as (select doc_id, {chunks} as c from s) select doc_id, unnest(range(len(c)))::bigint as chunk_no, unnest(c) as text from l"


BLANK_LINES = f"select doc_id, replace({DOC}, '\n', '\n\n') as t from documents"
S_LONG = f"list_filter(list_transform(string_split(t, '\n\n'), lambda x: {s_strip('x')}), lambda x: length(x) >= 160)"
S_PARAGRAPHS = f"case when len({S_LONG}) > 0 then {S_LONG} when {s_strip('t')} <> '' then [{s_strip('t')}] else [] end"


def _blank_lines() -> Column:
    return F.replace("text", F.lit("\n"), F.lit("\n\n"))


@query(_listed(BLANK_LINES, S_PARAGRAPHS))
def paragraphs(spark, sf_dir):
    return _exploded(spark, sf_dir, chunk.paragraphs(F.col("text")), _blank_lines())


@query(_listed(f"select doc_id, {S_PARAGRAPHS} as p from ({BLANK_LINES})", "list_transform(p, lambda x, i: case when i = 1 then x else p[i - 1] || '\n\n' || x end)"))
def paragraph_overlap(spark, sf_dir):
    return _exploded(spark, sf_dir, T.let(chunk.paragraphs(F.col("text")), lambda ps: chunk.with_overlap(ps, 1)), _blank_lines())


def s_sliding(t: str, window: int, step: int, most: int) -> str:
    windows = f"list_transform(range(0, length({t}), {step}), lambda i: {s_strip(f'substr({t}, i + 1, {window})')})"
    return f"list_filter({windows}, lambda x: length(x) >= 200)[1:{most}]"


@query(_listed(f"select doc_id, {s_strip(DOC)} as t from documents", s_sliding("t", 2400, 700, 40)))
def sliding_chunks(spark, sf_dir):
    return _exploded(spark, sf_dir, chunk.sliding_chunks(F.col("text"), 2400, 700, 40))


def s_pages(t: str, least: int) -> str:
    pages = f"list_filter(list_transform(string_split_regex({t}, '\n*--- Page \\d+ ---\n*'), lambda x: {s_strip('x')}), lambda x: x <> '')"
    flush = f"case when a.buf <> '' and length(a.buf) >= {least} then list_append(a.out, a.buf) else a.out end"
    fold = f"list_reduce(list_transform({pages}, lambda p: {{'out': []::varchar[], 'buf': p}}), lambda a, x: case when a.buf <> '' and length(a.buf) + length(x.buf) < 4000 then {{'out': a.out, 'buf': a.buf || '\n\n' || x.buf}} else {{'out': {flush}, 'buf': x.buf}} end, {{'out': []::varchar[], 'buf': ''}})"
    return f"list_transform([{fold}], lambda a: {flush})[1]"


MARKED = "\n--- Page 3 ---\n"


@query(_listed(f"select doc_id, {s_strip(f'replace({DOC}, chr(10), {quoted(MARKED)})')} as t from documents", s_pages("t", 120)))
def page_chunks(spark, sf_dir):
    return _exploded(spark, sf_dir, chunk.page_chunks(F.col("text"), 120), F.replace("text", F.lit("\n"), F.lit(MARKED)))


def s_sections(t: str, most: int, overlap: int) -> str:
    names = "|".join(SECTION_HEADINGS).replace(" ", f"[{WS}]+")
    marked = f"regexp_replace({t}, '(?m)^(?:\\p{{Nd}}+\\.|[IVX]+\\.|[IVX]+\\b|\\p{{Nd}}+\\b)?[{WS}]*({names})[{WS}]*$', '{chunk.MARK}\\1{chunk.MARK}', 'gi')"
    parts = f"list_filter(string_split({marked}, '{chunk.MARK}'), lambda p: p <> '')"
    part = s_strip("x.cur")
    heading = f"length({part}) < 60 and regexp_matches({part}, '^(?:{chunk.HEADING_PREFIX})', 'i')"
    joined = f"case when a.cur is null then {part} else a.cur || ' ' || {part} end"
    titled = f"'\n\n## ' || {part} || '\n\n'"
    full = s_strip(f"({joined})")
    state = lambda out, cur: f"{{'out': {out}, 'cur': {cur}}}"
    rest = f"nullif({s_strip(f'substr({full}, greatest(length({full}) - {overlap}, 0) + 1)')}, '')"
    step = f"case when {heading} then {state('a.out', f'case when a.cur is null then {titled} else a.cur || chr(32) || {titled} end')} when length({full}) >= {most} then {state(f'list_append(a.out, {full})', rest)} else {state('a.out', joined)} end"
    fold = f"list_reduce(list_transform({parts}, lambda p: {state('[]::varchar[]', 'p')}), lambda a, x: {step}, {state('[]::varchar[]', 'null::varchar')})"
    done = f"list_transform([{fold}], lambda a: case when a.cur is null then a.out else list_append(a.out, {s_strip('a.cur')}) end)[1]"
    return f"list_filter({done}, lambda x: length(x) >= 200)"


@query(_listed(f"select doc_id, {s_strip(f'replace({DOC}, chr(10), {quoted(chr(10) + "2. Related  Work " + chr(10))})')} as t from documents", s_sections("t", 2600, 900)))
def section_chunks(spark, sf_dir):
    return _exploded(spark, sf_dir, chunk.section_chunks(F.col("text"), 2600, 900), F.replace("text", F.lit("\n"), F.lit("\n2. Related  Work \n")))


_state = lambda out, buf, n, e: f"{{'out': {out}, 'buf': {buf}, 'n': {n}, 'e': {e}}}"
_split = "a.n + 2 + x.n > 3400 or (a.n + 2 + x.n > 2600 and list_dot_product(a.e, x.e) < 0.78)"
_mean = "list_transform(list_zip(a.e, x.e), lambda z_: (z_[1] + z_[2]) / 2)"
S_SEMANTIC = f"""list_transform([list_reduce(list_transform(p, lambda y: {_state("[]::varchar[]", "y", "length(y)", s_embedding("y"))}),
  lambda a, x: case when {_split} then {_state("list_append(a.out, a.buf)", "x.buf", "x.n", "x.e")} else {_state("a.out", "a.buf || chr(10) || chr(10) || x.buf", "a.n + 2 + x.n", _mean)} end)], lambda a: list_append(a.out, a.buf))[1]"""
S_TAIL = f"list_filter(list_transform(string_split(g[i - 1], '\n\n'), lambda y: {s_strip('y')}), lambda y: y <> '')[-1]"


@query(_listed(f"select doc_id, {S_SEMANTIC} as g from (select doc_id, {S_PARAGRAPHS} as p from ({BLANK_LINES})) where len(p) > 0", f"list_transform(g, lambda x, i: case when i = 1 then x else {S_TAIL} || '\n\n' || x end)"))
def semantic_chunks(spark, sf_dir):
    return _exploded(spark, sf_dir, chunk.semantic_chunks(F.col("text")), _blank_lines())


_heads = "(?im)" + "|".join(f"(?:^[{WS}]*{p}$)" for p in (x.replace("\\s", f"[{WS}]").replace("\\d", r"\p{Nd}") for x in (*(rf"{n}\s*" for n in chunk.SECTION_NAMES), chunk.NUMBERED_LINE)))
_para_words = f"len({s_words('x')})"
_paras = f"list_transform(list_filter(list_transform(string_split_regex(body, '\n[{WS}]*\n+'), lambda x: {s_strip('x')}), lambda x: x <> ''), lambda x: {{'out': []::varchar[], 'cur': [{{'p': x, 'w': {_para_words}}}]}})"
_text = lambda cur: f"array_to_string(list_transform({cur}, lambda y: y.p), '\n\n')"
_words_in = lambda cur: f"list_sum(list_transform({cur}, lambda y: y.w))"
_kept = f"list_filter(a.cur, lambda y, i: i = len(a.cur) or {_words_in('a.cur[i:]').replace('y', 'z')} <= 15)"
_cut = f"list_transform(range(0, x.cur[1].w, 75), lambda i: array_to_string(({s_words('x.cur[1].p')})[i + 1:i + 90], ' '))"
S_WINDOWS = f"""list_transform([list_reduce({_paras}, lambda a, x: case when x.cur[1].w > 135 then {{'out': list_concat(a.out, {_cut}), 'cur': a.cur}}
  when len(a.cur) > 0 and {_words_in("a.cur")} + x.cur[1].w > 90 then {{'out': list_append(a.out, {_text("a.cur")}), 'cur': list_concat({_kept}, x.cur)}}
  else {{'out': a.out, 'cur': list_concat(a.cur, x.cur)}} end, {{'out': []::varchar[], 'cur': []::struct(p varchar, w bigint)[]}})], lambda a: case when len(a.cur) > 0 then list_append(a.out, {_text("a.cur")}) else a.out end)[1]"""


@query(f"""
with pages_of as (select doc_id, unnest([1, 2]) as page, unnest(['Introduction\n' || replace({DOC}, '. ', '.\n\n'), 'Results\n' || {DOC}]) as t from documents),
heads as (select doc_id, page, {s_strip("t")} as t, list_transform(regexp_extract_all({s_strip("t")}, {quoted(_heads)}), lambda x: {s_fold("x")}) as titles, list_transform(string_split_regex({s_strip("t")}, {quoted(_heads)})[2:], lambda x: {s_strip("x")}) as bodies from pages_of),
found as (select doc_id, page, t, list_filter(list_zip(titles, bodies), lambda x: x[2] <> '') as rows_ from heads),
sections as (select doc_id, page, unnest(range(len(r))) as section, unnest(r) as r from (select doc_id, page, case when len(rows_) > 0 then rows_ else [row('page', t)] end as r from found)),
windows as (select doc_id, page, section, r[1] as title, r[2] as body from sections where lower(r[1]) <> 'references'),
listed as (select doc_id, page, section, title, unnest(range(len(c))) as place, unnest(c) as text from (select doc_id, page, section, title, {S_WINDOWS} as c from windows)),
numbered as (select *, row_number() over (partition by doc_id order by page, section, place) as n from listed)
select doc_id, n - 1 as chunk_no, printf('%05d|p%d|%s', n, page, {s_strip("substr(title, 1, 30)")}) as chunk_id, text from numbered
""")
def custom_chunks(spark, sf_dir):
    """Word windows of sections of pages; paragraphs on the first page are short, on the second whole."""
    source = F.concat(F.lit("\n--- Page 1 ---\nIntroduction\n"), F.replace("text", F.lit(". "), F.lit(".\n\n")), F.lit("\n--- page 2 ---\nResults\n"), F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", source.alias("text"))
    return chunk.chunk(rows, chunk.custom_chunks(F.col("text"), 90, 15)).withColumn("chunk_no", F.col("chunk_no").cast("long"))


_all = f"list_concat(list_concat({s_pages('t', 120)}, {s_sections('t', 2600, 900)}), {s_sliding('t', 2400, 700, 40)})"
S_FALLBACK = f"list_transform([list_filter(list_transform({_all}, lambda x: {s_strip('x')}), lambda x: length(x) >= 200)], lambda c: list_filter(c, lambda x, i: list_position(c, x) = i))[1][1:40]"


@query(_listed(f"select doc_id, {s_strip(DOC)} as t from documents", S_FALLBACK))
def fallback_chunks(spark, sf_dir):
    return _exploded(spark, sf_dir, chunk.fallback_chunks(F.col("text")))


KEYWORDS = ("the", "and", "der", "les", "los", "tion", "ing", "data", "licen", "http")


@query(f"""
with c as ({_listed(f"select doc_id, {s_strip(DOC)} as t from documents", s_sliding("t", 2400, 700, 40))}),
s as (select *, ({" + ".join(f"contains(lower(text), '{k}')::int" for k in KEYWORDS)} + contains(text, '##')::int)::bigint as score from c),
r as (select *, row_number() over (partition by doc_id order by score desc, chunk_no) as chunk_rank from s)
select doc_id, chunk_no, score, chunk_rank::bigint as chunk_rank from r where chunk_rank <= 28
""")
def rank_chunks_topk(spark, sf_dir):
    ranked = rank.rank_chunks(sliding_chunks(spark, sf_dir), 28, KEYWORDS)
    return ranked.select("doc_id", "chunk_no", F.col("score").cast("long").alias("score"), F.col("chunk_rank").cast("long").alias("chunk_rank"))


@query(f"""
with c as ({_listed(f"select doc_id, {s_strip(DOC)} as t from documents", s_sliding("t", 2400, 700, 40))}),
s as (select *, ({" + ".join(f"contains(lower(text), '{k}')::int" for k in KEYWORDS)} + contains(text, '##')::int)::bigint as score from c),
r as (select *, row_number() over (partition by doc_id order by score desc, chunk_no) as chunk_rank from s)
select doc_id, chunk_rank::bigint as chunk_rank, (chunk_no + 1)::varchar as chunk_id, text from r where chunk_rank <= 28
""")
def build_chunks(spark, sf_dir):
    """Chunks of a strategy, ranked and capped within their rows."""
    best = rank.best_chunks(chunk.chunks_by_strategy(F.col("text"), Chunking(" Sliding ")), Ranking(KEYWORDS))
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(best).alias("i", "c"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("chunk_rank"), "c.chunk_id", "c.text")


QUESTION = "which model improves the metric"


@query(f"with v as (select doc_id, {s_embedding(DOC)} as emb from documents) select doc_id, round(list_dot_product(emb, {s_embedding(quoted(QUESTION))}), 9) as score from v order by list_dot_product(emb, {s_embedding(quoted(QUESTION))}) desc, doc_id limit 10")
def vector_topk(spark, sf_dir):
    hits = vector.search(vector.embed(_docs(spark, sf_dir)).select("doc_id", "emb"), QUESTION, 10, order=("doc_id",))
    return hits.select("doc_id", F.round("score", 9).alias("score"))


@query(f"""
with v as (select doc_id, {s_embedding(DOC)} as emb from documents), q as (select item_id, {s_embedding("coalesce(text, '')")} as qe from benchmark),
s as (select item_id as query_id, doc_id, list_dot_product(emb, qe) as score from q cross join v),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
select query_id, rank::bigint as rank, doc_id, round(score, 9) as score from r where rank <= 5
""")
def vector_topk_multi(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.hash_embedding(F.coalesce("text", F.lit(""))).alias("emb"))
    hits = vector.search_many(vector.embed(_docs(spark, sf_dir)).select("doc_id", "emb"), questions, 5, order=("doc_id",))
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 9).alias("score"))


@query("""
with e as (select vec_id, embedding::double[] as emb from embeddings), q as (select vec_id as query_id, emb as qe from e where vec_id % 50 = 0),
s as (select query_id, vec_id, list_dot_product(emb, qe) as score from q cross join e),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, round(score, 6) as score from r where rank <= 10
""")
def embedding_dot_topk(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("emb"))
    hits = vector.search_many(items, items.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "emb"), 10, order=("vec_id",))
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"))


_shown = f"case when length({DOC}) > 1500 then substr({DOC}, 1, 1500) || '...' else {DOC} end"
_cut = f"case when length({DOC}) > 1200 then rtrim(substr({DOC}, 1, 1200), '{WS}') || '…' else {DOC} end"


@query(f"select doc_id, {_shown} as shown, {_cut} as cut from documents")
def shortened_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", retrieve.display(F.col("text")).alias("shown"), retrieve.shortened(F.col("text")).alias("cut"))


@query("select doc_id, 'é' || coalesce(text, '') as text, 'é' as other from documents")
def decode_bytes(spark, sf_dir):
    """UTF-8 as it is; a lone byte E9 is no UTF-8 and read as Latin-1."""
    return _docs(spark, sf_dir).select("doc_id", decoded(F.encode(F.concat(F.lit("é"), "text"), "UTF-8")).alias("text"), decoded(F.unhex(F.lit("E9"))).alias("other"))


NAMES = " The (Größe) – BLEU-4 [v2.1]"
_plain = f"regexp_replace(translate(lower('the An ' || c_name || {quoted(NAMES)}), '–—', '--'), '[^a-z0-9+\\-. ]+', ' ', 'g')"


@query(f"select c_custkey, {s_strip(s_sub(s_fold(_plain), '^((the|a|an)( |$))+', ''))} as canonical from customer")
def canonical_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.canonical_key(F.concat(F.lit("the An "), "c_name", F.lit(NAMES))).alias("canonical"))


_raw = "regexp_extract_all(coalesce(html, ''), '(?is)<(?:h[1-6]\\b[^>]*>.*?</h[1-6]|p\\b[^>]*>.*?</p|li\\b[^>]*>.*?</li|title\\b[^>]*>.*?</title|table\\b[^>]*>.*?</table)\\s*>')"
S_ELEMENTS = f"select page_id as doc_id, unnest(range(len(r))) as pos, unnest(r) as raw from (select page_id, {_raw} as r from pages)"


S_SECTIONS = f"""
with x as ({S_ELEMENTS}),
e as (select doc_id, pos, lower(regexp_extract(raw, '^<([A-Za-z0-9]+)', 1)) as tag, {s_strip(s_sub("raw", "(?s)<[^>]*>", ""))} as text from x),
g as (select *, sum((tag in ('heading', 'title', 'h1', 'h2', 'h3'))::int) over (partition by doc_id order by pos) as grp from e),
s as (select doc_id, grp, max(text) filter (tag in ('heading', 'title', 'h1', 'h2', 'h3')) as heading,
  string_agg(case when tag = 'table' then '\n' || text || '\n' else text end, '\n' order by pos) filter (tag not in ('heading', 'title', 'h1', 'h2', 'h3') and text <> '') as body,
  count(*) filter (tag = 'table' and text <> '') as n_tables from g group by 1, 2)
select doc_id, row_number() over (partition by doc_id order by grp) - 1 as section_no, coalesce(heading, 'Abstract') as heading, {s_strip("body")} as text, n_tables from s where body is not null
"""


@query(S_SECTIONS)
def element_sections_of_pages(spark, sf_dir):
    rows = element_sections(html_elements(table(spark, sf_dir, "pages")))
    return rows.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "heading", "text", F.size("tables").cast("long").alias("n_tables"))


@query(f"""select doc_id, {s_strip("string_agg('\n\n## ' || heading || '\n\n' || text, '' order by section_no)")} as text from ({S_SECTIONS}) group by doc_id""")
def section_texts_of_pages(spark, sf_dir):
    """Sections of pages put together as texts."""
    return flatten_sections(element_sections(html_elements(table(spark, sf_dir, "pages"))))


S_STRATEGIES = {"sections": s_sections("t", 2600, 900), "pages": s_pages("t", 120), "sliding": s_sliding("t", 2400, 700, 40), "all": S_FALLBACK}


@query(" union all ".join(f"(select '{name}' as strategy, doc_id, chunk_no, (chunk_no + 1)::varchar as chunk_id, text from ({_listed(f'select doc_id, {s_strip(DOC)} as t from documents', sql)}))" for name, sql in S_STRATEGIES.items()))
def chunk_strategies(spark, sf_dir):
    """Chunks by each strategy's name; a name that is none takes all."""
    docs = dealt(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = docs.select("doc_id", F.explode(chunk.chunks_by_strategies(F.col("text"), tuple(S_STRATEGIES))).alias("by"))
    rows = each.select("by.strategy", "doc_id", F.posexplode("by.chunks").alias("chunk_no", "c"))
    return rows.select("strategy", "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "c.chunk_id", "c.text")


_decoded = lambda x: s_sub(f"replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')", "&amp;?", "&")
_pieces = r"""regexp_extract_all(replace(replace(coalesce(html, ''), '<br><p>', '<br></p><p>'), '<br></article>', '<br></p>'), '(?s)<title>.*?</title>|<li>.*?</li>|<div class="ad">.*?</div>|<h1>.*?</h1>|<p>.*?</p>|<footer>.*?</footer>')"""


@query(f"""
select doc_id, (row_number() over (partition by doc_id order by place) - 1)::int as pos, tag, case tag when 'li' then '- ' else '' end || text as text from (
  select page_id as doc_id, place, case when tag in ('div', 'footer') then 'p' else tag end as tag, {s_fold(_decoded(s_sub("raw", "<[^>]*>", "")))} as text
  from (select page_id, place, raw, regexp_extract(raw, '^<([a-z0-9]+)', 1) as tag from (select page_id, unnest(range(len(r))) as place, unnest(r) as raw from (select page_id, {_pieces} as r from pages)))) where text <> ''
""")
def layout_of_pages(spark, sf_dir):
    """All blocks of whole pages, unclosed paragraphs and missing ends included."""
    return layout_elements(table(spark, sf_dir, "pages"))


# a page for each nation: items with a list inside, a table of its customers whose head spans rows and columns, a table in a cell, few ends
S_CUSTOMERS = "select n_nationkey, n_name, c_custkey, c_name, c_mktsegment, cast(cast(c_acctbal as decimal(12, 2)) as string) as balance from nation join customer on c_nationkey = n_nationkey"
_row = "'<tr><td>' || c_name || '<td>' || balance || '<td colspan=\"2\">' || c_mktsegment || case when c_custkey % 3 = 0 then '<table><tr><td>in<td>' || c_custkey || '</table>' else '' end"
_line = "'| ' || c_name || ' | ' || balance || ' | ' || (c_mktsegment || case when c_custkey % 3 = 0 then ' in ' || c_custkey else '' end) || ' | ' || (c_mktsegment || case when c_custkey % 3 = 0 then ' in ' || c_custkey else '' end) || ' |'"
NATION_HEAD, NATION_TABLE = "<h2>{n}</h2><ul><li>one of<ol><li>first<li>second</ol>them<li>last</ul>", "<p>before<table><tr><th rowspan=2>name<th colspan=3>of {n}<tr><th>balance<th>a|b<th>"


@query(f"""
with c as ({S_CUSTOMERS}), t as (select n_nationkey, any_value(n_name) as n, string_agg({_line}, chr(10) order by c_custkey) as lines from c group by n_nationkey)
select n_nationkey as doc_id, pos, tag, text from (select n_nationkey, unnest(range(8))::int as pos, unnest(['h2', 'li', 'li', 'li', 'li', 'li', 'p', 'table']) as tag,
  unnest([n, '- one of', '  1. first', '  2. second', '  them', '- last', 'before', '| name | of ' || n || ' | of ' || n || ' | of ' || n || ' |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| name | balance | a\\|b |  |' || chr(10) || lines]) as text from t)
""")
def layout_tables(spark, sf_dir):
    for name in ("nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    rows = spark.sql(S_CUSTOMERS).selectExpr("n_nationkey", "n_name", "c_custkey", f"{_row} as line")
    pages = rows.groupBy("n_nationkey").agg(F.first("n_name").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "").alias("lines"))
    put = lambda text: F.replace(F.lit(text), F.lit("{n}"), F.col("n"))
    return layout_elements(pages.select("n_nationkey", F.concat(put(NATION_HEAD), put(NATION_TABLE), "lines").alias("html")), key="n_nationkey")
