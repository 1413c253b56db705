"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op11_lines"] = """
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (
    select r, doc_id, unnest(string_split(text, chr(10))) as line,
        unnest(range(len(string_split(text, chr(10))))) as place
    from docs),
keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines),
repeated as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 20 and doc_id is not null
    group by key having count(distinct doc_id) >= 3),
marked as (
    select k.*, coalesce(k.doc_id < p.keeper, false) as gone from keyed k left join repeated p on k.key = p.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by r
"""

ORACLE["op1_warc"] = """
with payloads as (
    select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as bytes from pages),
latest as (select payload, max(page_id) as keeper from payloads where bytes >= 1000 group by payload)
select page_id, bytes as payload_bytes, sha1(payload) as payload_digest,
    if(page_id < keeper, 'revisit', 'response') as record_type, if(page_id < keeper, keeper, null) as refers_to
from payloads left join latest using (payload)
"""

_WORDS = "regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLE["op3_repeats"] = f"""
with docs as (
    select row_number() over () as r, doc_id, {_WORDS.format(text='text')} as w from documents),
windows as (
    select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as words
    from (select *, unnest(range(1, len(w) - 11)) as i from docs)),
first as (select words, min(doc_id) as holder from windows group by words),
covered as (
    select distinct r, j from (
        select r, unnest(range(i, i + 13)) as j from windows join first using (words) where holder < doc_id)),
listed as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from docs),
kept as (
    select l.r, count(c.j) as n_removed, string_agg(word, ' ' order by l.j) filter (c.j is null) as kept
    from listed l left join covered c on l.r = c.r and l.j = c.j group by l.r)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join kept using (r)
"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op10_minhash"] = f"""
with recursive docs as (select doc_id, {_WORDS.format(text=_LOWERED)} as w from documents),
shingles as (
    select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s
    from (select *, unnest(range(1, greatest(len(w) - 2, 2))) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * common >= 80 * (x.n + y.n - common)),
edges as (select a, b from links union all select b, a from links),
reached as (
    select doc_id, doc_id as node from docs
    union select r.doc_id, e.b from reached r join edges e on e.a = r.node),
roots as (select doc_id, min(node) as component_id from reached group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from docs left join sizes using (doc_id) join roots using (doc_id)
"""
