"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from functools import reduce

from loomtext.llm import licenses

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP8 = f"""
with pages_in as (select page_id, sha1(coalesce(html, '')) as sha, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
first as (select sha, min(page_id) as first_id from pages_in group by sha)
select page_id, payload_bytes::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('{ALPHABET}', 1 + ((('0x' || substr(sha, 1 + 5 * (i // 4)::int, 5))::bigint >> (5 * (3 - i % 4))::int) & 31)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from pages_in join first using (sha)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_lines(text: str) -> str:
    folded = f"regexp_replace(translate(coalesce({text}, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^a-z0-9\n]+', ' ', 'g')"
    rule = lambda c, r: f"regexp_replace({c}, {_quoted(r[0])}, '{r[1].replace('$', chr(92))}', 'g')"
    spelled = reduce(rule, licenses.SPELLINGS, folded)
    return f"list_filter(list_transform(string_split({spelled}, '\n'), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, {_quoted(licenses.COPYRIGHT)}))"


OP5 = f"""
with known as (select * from (values {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.known_licenses())}) as t(license_id, text)),
digests as (select sha256(array_to_string({_license_lines("text")}, ' ')) as digest, string_agg(distinct license_id, ',' order by license_id) as license_id from known group by 1),
docs as (select doc_id, {_license_lines("text")} as lines from documents),
entire as (select doc_id, license_id from docs join digests on digest = sha256(array_to_string(lines, ' ')) where len(lines) > 0),
each_line as (select doc_id, unnest(lines) as line from docs),
matched as (select doc_id, license_id from each_line join digests on digest = sha256(line)),
found as (select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices, count(*) as n_notices from matched group by doc_id)
select d.doc_id, e.license_id, f.notices, coalesce(f.n_notices, 0)::bigint as n_notices
from documents d left join entire e using (doc_id) left join found f using (doc_id)
"""


LOWERED = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"

OP3 = f"""
with recursive w as (select doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as s from w),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)),
reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on l.x = r.y)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join sizes using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by x) c using (doc_id)
"""

OP4 = f"""
with words as (select doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (select coalesce(item_id::varchar, 'null') as item, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
windows as (select distinct item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) as k, least(len(w), 10) as n from items where len(w) > 0),
places as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as k from words, (select distinct n from windows) where len(w) >= n),
found as (select doc_id, i, n, item from places join windows using (k, n)),
hits as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from found) group by doc_id),
named as (select doc_id, list_sort(list(distinct item)) as items from found group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hits using (doc_id) left join named using (doc_id)
"""

OP7 = """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
blocks as (select doc_id, o, substr(h, 2 * o + 1, 2 * 249) as h from (select doc_id, h, unnest(range(0, length(h) // 2 - 49, 200)) as o from bytes where length(h) >= 100)),
starts as (select doc_id, o + unnest(range(length(h) // 2 - 49)) as i, unnest(list_transform(range(length(h) // 2 - 49), lambda i: hash(substr(h, 2 * i + 1, 100)))) as k from blocks),
least as (select k, min(doc_id) as first_id from starts group by k),
gone as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from starts join least using (k) where first_id < doc_id),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from gone) group by doc_id, run),
sums as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, list(a order by a) as a, list(b order by b) as b from runs group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when n_spans is null then h else array_to_string(list_transform(range(n_spans + 1), lambda j: h[2 * coalesce(b[j], 0) + 1:2 * coalesce(a[j + 1], length(h) // 2)]), '') end)) as kept_sha256
from bytes left join sums using (doc_id)
"""

OP12 = f"""
with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
often as (select lang, term from (select lang, unnest(list_distinct(w)) as term from docs) group by lang, term having count(*) >= 30),
counted as (select lang, source, term, count(*) as n from (select lang, source, unnest(w) as term from docs) join often using (lang, term) group by lang, source, term),
groups as (select distinct lang, source from docs),
sizes as (select lang, count(*) as v from often group by lang),
totals as (select lang, source, coalesce(sum(n), 0) as total from groups left join counted using (lang, source) group by lang, source),
grid as (select g.lang, g.source, o.term, coalesce(c.n, 0)::hugeint as n from groups g join often o using (lang) left join counted c using (lang, source, term)),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as p from grid join totals using (lang, source) join sizes using (lang)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (lang_total + 5 * v) as q from grid join (select lang, sum(total) as lang_total from totals group by lang) using (lang) join sizes using (lang) group by lang, term, lang_total, v),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::integer as rank
from (select * from pair union all select * from term) qualify part = 'pair' or rank <= 50
"""

def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain Lloyd rounds, one after another, over all parts and entries."""
    nearest = lambda book: f"select r, p, arg_min(e, (d, e)) as e, min(d) as d, any_value(x) as x from (select r, p, e, u.x as x, list_sum(list_transform(list_zip(u.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from part_of u join {book} b using (p)) group by r, p"
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [f"""
kept as materialized (select vec_id, label, list_transform(embedding, lambda v: floor(v::double * 1024)::bigint) as x, row_number() over (order by vec_id nulls last, list_transform(embedding, lambda v: floor(v::double * 1024)::bigint)) as r from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
part_of as materialized (select r, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] as x from kept, range({parts}) as t(p)),
b0 as materialized (select p, (r - 1)::bigint as e, x from part_of where r <= {entries})"""]
    for i in range(rounds):
        steps.append(f"""
a{i} as materialized ({nearest(f"b{i}")}),
m{i} as (select p, e, j, sum(v)::bigint as s, count(*) as n from (select p, e, unnest(x) as v, unnest(range(len(x))) as j from a{i}) group by all),
b{i + 1} as materialized (select b.p, b.e, coalesce(m.x, b.x) as x from b{i} b left join (select p, e, list({floor} order by j) as x from m{i} group by p, e) m using (p, e))""")
    return f"""with {",".join(steps)},
last as materialized ({nearest(f"b{rounds}")}),
coded as (select r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from last group by r),
sha as (select sha256(string_agg(v::varchar, ',' order by p, e, j)) as codebooks_sha256 from (select p, e, unnest(x) as v, unnest(range(len(x))) as j from b{rounds}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (r), sha
"""


OP13 = _codes_sql()

WINNOW_EDITS = """
with d as (select doc_id, coalesce(text, '') as t, coalesce(lead(coalesce(text, '')) over (order by doc_id, text), first_value(coalesce(text, '')) over (order by doc_id, text)) as next from documents)
select doc_id, length(t)::bigint as n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(next, 1, length(t) // 2)) as edited_sha256 from d
"""

#: crc32 of a short ASCII text: a table by its rule, then a step for each byte
CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n))"
CRC = "xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295))"

MAXENT_BASE = f"""
with crc as (select {CRC_TABLE} as t),
d as (select doc_id, {CRC.format("doc_id::varchar")} % 7 = 2 as held_out, list_append(regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+'), ' ') as w from documents, crc),
counted as (select w, count(*) as c from (select unnest(w) as w from d where not held_out) group by w),
sizes as (select sum(c) as n, count(*) as v from counted)
select doc_id, held_out, any_value(len(d.w))::bigint as n_tokens, count(c)::bigint as n_known, any_value(n)::bigint as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 6) as base_score
from (select doc_id, held_out, w, unnest(w) as token from d) d left join counted on counted.w = token, sizes group by doc_id, held_out
"""

ORACLES: dict[str, str] = {"op3_minhash": OP3, "op4_decontamination": OP4, "op5_license_scan": OP5, "op7_suffix_dedup": OP7, "op8_warc": OP8, "op12_source_divergence": OP12, "op13_vector_codes": OP13, "winnow_edits": WINNOW_EDITS, "maxent_base_scores": MAXENT_BASE}
