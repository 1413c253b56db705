"""DuckDB twins of the registered queries, computed from the raw tables.

Shared parts are named CTEs; a query pulls in the ones its text mentions.
"""

from __future__ import annotations

import re

from sidforge.functions.geo import ALPHABET
from sidforge.functions.text import WHITE_SPACE
from sidforge.operators.joins import FINAL_FIELDS
from sidforge.operators.merges import MIN_COUNT, V_MEM
from sidforge.plans.catalog import DIM, MERGE_MIN, MERGES
from sidforge.plans.views import CODES, DIRTY_SQL, GAINS, ITEMS_SQL, LEVELS
from sidforge.sources.items import ITEM_FIELDS

CTES: dict[str, str] = {}
ORACLE: dict[str, str] = {}

SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACES})"


def with_ctes(body: str) -> str:
    """Prefix the CTEs a query needs, in the order they were defined."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{n} as materialized ({CTES[n]})" for n in CTES if n in needed]
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(body) for name, body in ORACLE.items()} | SINKHORN


# --- items --------------------------------------------------------------------

CTES["raw_items"] = ITEMS_SQL.format(S="varchar", T="1000::double", part="part")


def geohash(precision: int) -> str:
    """Geohash text: the bits as digits, cut into fives and looked up."""
    lng_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    col = f"least(floor((lng + 180) / 360 * {1 << lng_bits}), {(1 << lng_bits) - 1})::bigint"
    row = f"least(floor((lat + 90) / 180 * {1 << lat_bits}), {(1 << lat_bits) - 1})::bigint"
    bits = []
    for i in range(5 * precision):
        source, width = (col, lng_bits) if i % 2 == 0 else (row, lat_bits)
        bits.append(f"(({source}) >> {width - 1 - i // 2}) & 1")
    letters = []
    for k in range(precision):
        digit = " + ".join(f"{1 << (4 - b)} * ({bits[5 * k + b]})" for b in range(5))
        letters.append(f"substr('{ALPHABET}', ({digit} + 1)::int, 1)")
    inside = "lng between -180 and 180 and lat between -90 and 90"
    return f"case when {inside} then {' || '.join(letters)} end"


CTES["points"] = (
    "select idx, try_cast(trim(i_lng) as double) as lng, try_cast(trim(i_lag) as double) as lat "
    "from raw_items"
)
CTES["hashes"] = (
    f"select idx, {geohash(6)} as geohash, {geohash(9)} as geohash_9, {geohash(3)} as geohash_3 "
    "from points"
)
PLAIN = [f for f in ITEM_FIELDS if f != "geohash"]
CTES["text_items"] = (
    "select idx, country_code, "
    + ", ".join(f"coalesce({f}, '') as {f}" for f in PLAIN)
    + ", coalesce(geohash, '') as geohash from raw_items join hashes using (idx)"
)
NOT_BLANK = f"{strip('i_lng')} <> '' and {strip('i_lag')} <> ''"
CTES["kept_items"] = f"select * from text_items where {NOT_BLANK}"

# --- vectors and codes ----------------------------------------------------------

CTES["vec"] = (
    "select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings"
)
CTES["item_vec"] = (
    "select p_partkey as idx, p_partkey % (select count(*) from embeddings) as vec_id from part"
)
GAIN = "case level " + " ".join(f"when {i} then {g}::double" for i, g in enumerate(GAINS)) + " end"
MEANS = ", ".join(f"avg(embedding[{i}]::double) * gain" for i in range(1, DIM + 1))
CTES["classes"] = (
    f"select level, ((vec_id + level * label) % {CODES})::int as code, {GAIN} as gain, embedding "
    f"from embeddings, range({LEVELS}) as l(level)"
)
CTES["cb"] = (
    f"select level, code, list_value({MEANS}) as c from classes group by level, code, gain"
)
GAP = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def nearest(source: str, vector: str, key: str, level: int, book: str = "cb") -> str:
    """Nearest codeword of each row, lowest code on ties, with the vector left over."""
    return (
        f"select {key}, code, d, list_transform(list_zip({vector}, c), lambda z: z[1] - z[2]) as rest "
        f"from (select *, row_number() over (partition by {key} order by d, code) as place "
        f"from (select s.{key}, s.{vector}, b.code, b.c, {GAP.format(a=f's.{vector}', b='b.c')} as d "
        f"from {source} s, {book} b where b.level = {level})) where place = 1"
    )


CTES["near0"] = nearest("vec", "x", "vec_id", 0)
CTES["near1"] = nearest("near0", "rest", "vec_id", 1)
CTES["near2"] = nearest("near1", "rest", "vec_id", 2)
CTES["vec_codes"] = (
    "select vec_id, a.code as code_0, b.code as code_1, c.code as code_2, "
    "a.rest as rest0, b.rest as rest1, c.rest as rest2 "
    "from near0 a join near1 b using (vec_id) join near2 c using (vec_id)"
)
CTES["codes"] = (
    "select idx, code_0, code_1, code_2 from item_vec join vec_codes using (vec_id)"
)
CTES["ranked"] = (
    "select *, row_number() over (partition by code_0, code_1, code_2 order by idx)::int as code_3 "
    "from codes"
)


def tokens(levels: int) -> str:
    return ", ".join(
        f"'<{'abcde'[i]}_' || code_{i} || '>' as code_{i}" for i in range(levels)
    )


CTES["toks"] = f"select idx, {tokens(3)} from codes"
CTES["index_rows"] = f"select idx, {tokens(4)} from ranked"
CTES["kept_ranked"] = (
    "select c.*, row_number() over (partition by code_0, code_1, code_2 order by idx)::int as code_3 "
    "from codes c semi join kept_items using (idx)"
)
CTES["kept_index"] = f"select idx, {tokens(4)} from kept_ranked"
CTES["buckets"] = "select code_0, code_1, code_2, count(*) as n from codes group by all"
SID = "code_0 || code_1 || code_2 || code_3"
CTES["kept_sid"] = (
    f"select k.*, '<' || geohash || '>' || {SID} as geo_sid, code_0, code_1, code_2 "
    "from kept_items k join kept_index using (idx)"
)


def long_form(key: str, vector: str, source: str, digits: int = 6) -> str:
    return (
        f"select {key}, (p - 1)::int as pos, round({vector}[p]::double, {digits}) as value "
        f"from {source}, range(1, len({vector}) + 1) as r(p)"
    )


FIELDS = ", ".join(ITEM_FIELDS)
FINAL = ", ".join(FINAL_FIELDS)

# --- sources and sinks ------------------------------------------------------------

ORACLE["scan_partition"] = (
    "select country_code, dt, idx, item_id, title, i_lng, i_lag from raw_items"
)
ORACLE["project_tolerant"] = (
    f"select idx, {', '.join(PLAIN)}, geohash, true as category_missing "
    "from raw_items join hashes using (idx)"
)
CTES["drift"] = """
select idx, item_id,
  case idx % 3 when 2 then (item_id::int / 3e9::double)::varchar end as sence_id,
  case idx % 3 when 2 then null else title end as title,
  case when idx % 3 = 2 then if(item_id::int % 2 = 0, 'True', 'False') end as description,
  case idx % 3 when 0 then null else brand end as brand,
  case idx % 3 when 0 then null else item_id::int::varchar end as shop_id,
  case idx % 3 when 1 then (try_cast(trim(i_lng) as double) / 1e6::double)::varchar else i_lng end as i_lng,
  i_lag
from raw_items
"""
CTES["drift_points"] = (
    "select *, try_cast(trim(i_lng) as double) as lng, try_cast(trim(i_lag) as double) as lat from drift"
)
ORACLE["scan_drift"] = (
    "select idx, " + ", ".join(f"coalesce({f}, '') as {f}" for f in PLAIN)
    + f", coalesce({geohash(6)}, '') as geohash from drift_points"
)
ORACLE["stringify_floats"] = """
with priced as (
    select *, l_extendedprice::double as price,
        ('1e' || ((l_orderkey + l_linenumber) % 31 - 12))::double as factor
    from lineitem)
select l_orderkey, l_linenumber, (price * factor)::varchar as large,
    (-price / factor / 7::double)::varchar as small, l_discount::float::double::varchar as narrow,
    if(l_tax > 0.04, 'True', 'False') as taxed,
    coalesce(case when l_linenumber <> 3 then l_quantity::double::varchar end, '') as quantity
from priced
"""
ORACLE["take_first_n"] = (
    "select idx, idx as key, item_id from "
    "(select * from raw_items order by idx limit 700) "
    f"where {strip('coalesce(i_lng, chr(32))')} <> '' and {strip('coalesce(i_lag, chr(32))')} <> ''"
)
ORACLE["load_vectors"] = long_form("vec_id", "embedding", "embeddings")
ORACLE["load_vectors_wide"] = "select " + ", ".join(
    f"{c}::float::double as v{i}"
    for i, c in enumerate(
        ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )
) + " from lineitem"
ORACLE["sink_items"] = f"select idx, country_code, {FIELDS} from kept_items"
NORM = "sqrt(list_sum(list_transform({v}, lambda e: e::double * e::double)))"
ORACLE["sink_embeddings"] = (
    "select idx::varchar as row_id, idx::varchar as item_id, len(embedding)::int as dim, "
    f"round({NORM.format(v='embedding')}, 6) as norm, round(embedding[1]::double, 6) as first_value "
    "from item_vec join embeddings using (vec_id)"
)
ORACLE["sink_index"] = "select * from index_rows"
ORACLE["sink_index_json"] = (
    """select '{"idx":' || idx || ',"codes":["' || code_0 || '","' || code_1 || '","' || code_2 """
    """|| '"]}' as line from toks"""
)
ORACLE["sink_joined"] = f"select idx, {FINAL}, geo_sid from kept_sid"

# --- projections, filters, scalar functions -----------------------------------------

ORACLE["stringify_nulls"] = f"select idx, {FIELDS} from text_items"
ORACLE["geohash_encode"] = "select idx, geohash, geohash_9 from hashes"
ORACLE["drop_blank_geo"] = f"select idx, i_lng, i_lag from raw_items where {NOT_BLANK}"
ORACLE["geo_drop_rate"] = (
    f"select total, dropped, total - dropped as kept, round(dropped * 100.0 / total, 6) as dropped_pct "
    f"from (select count(*) as total, count(*) filter (not ({NOT_BLANK})) as dropped from text_items)"
)
CTES["texts"] = (
    "select idx, "
    + strip(
        " || ' ' || ".join(strip(f"coalesce({f}, '')") for f in ("brand", "title", "description"))
    )
    + " as text from raw_items"
)
ORACLE["item_text"] = "select * from texts"
CTES["words"] = (
    "select doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n\\f]+'), "
    "lambda w: w <> '')) as word from documents"
)
CTES["word_counts"] = (
    f"select doc_id, (('0x' || substr(md5(word), 1, 8))::bigint % {DIM})::int as pos, "
    "count(*)::double as n from words group by all"
)
ORACLE["embed_text"] = (
    "select doc_id, pos, "
    "round((n / sqrt(sum(n * n) over (partition by doc_id)))::float::double, 6) as value "
    "from word_counts"
)
ORACLE["embed_dim_check"] = (
    "select w.dim::int as dim, count(*) as n, "
    "count(*) filter (len(embedding) <> w.dim) as mismatched "
    f"from item_vec join embeddings using (vec_id), (values ({DIM}), ({DIM // 2})) as w(dim) "
    "group by w.dim"
)
ORACLE["embedding_preview"] = (
    "select idx, substr(text, 1, 300) as input, "
    f"round({NORM.format(v='embedding')}, 4) as norm, "
    + ", ".join(f"round(embedding[{i + 1}]::double, 6) as first_{i}" for i in range(5))
    + ", "
    + ", ".join(f"round(embedding[{DIM - 4 + i}]::double, 6) as last_{i}" for i in range(5))
    + " from item_vec join embeddings using (vec_id) join texts using (idx) order by idx limit 5"
)
ORACLE["validate_vectors"] = (
    "select count(*) as n, count(*) filter (embedding is null) as nulls, "
    "min(len(embedding))::int as min_dim, max(len(embedding))::int as max_dim "
    "from item_vec join embeddings using (vec_id)"
)
CTES["dirty"] = (
    "select vec_id, i, "
    + DIRTY_SQL.format(nan="'nan'::float", inf="'inf'::float")
    + " as x from (select vec_id, (p - 1) as i, embedding[p] as x from embeddings, "
    f"range(1, {DIM + 1}) as r(p))"
)
BROKEN = "(x is null or isnan(x))"
ORACLE["sanitize_vectors"] = (
    f"select vec_id, i::int as pos, round(case when {BROKEN} or isinf(x) then 0 else x end::double, 6)"
    " as value from dirty"
)
ORACLE["sanitize_counts"] = (
    f"select count(*) filter {BROKEN} as nan_values, "
    "count(*) filter (x is not null and isinf(x)) as inf_values from dirty"
)
ORACLE["observed_vectors"] = (
    f"select (select count(*) from embeddings) as rows, 0::bigint as nulls, {DIM} as min_dim, {DIM} as max_dim, "
    f"count(*) filter {BROKEN} as nan_values, count(*) filter (x is not null and isinf(x)) as inf_values from dirty"
)
ORACLE["stream_observed"] = (
    "select (select count(*) from embeddings) as rows, 0::bigint as nulls, "
    f"count(*) filter {BROKEN} as nan_values, count(*) filter (x is not null and isinf(x)) as inf_values from dirty"
)
ORACLE["vector_stats"] = (
    "select round(min(v::double), 6) as min_value, round(max(v::double), 6) as max_value, "
    "round(avg(v::double), 6) as mean_value "
    "from (select unnest(embedding) as v from item_vec join embeddings using (vec_id))"
)
ORACLE["code_token"] = "select * from toks"
ORACLE["parse_code"] = "select * from ranked"
ORACLE["sid_concat"] = f"select idx, {SID} as sid from index_rows"
ORACLE["geo_sid"] = "select idx, geohash, geo_sid from kept_sid"
CTES["level0"] = f"select vec_id, code, {GAP.format(a='x', b='c')} as d from vec, cb where level = 0"
CTES["level0_batches"] = (
    "select vec_id // 128 as batch, max(d) as high, (max(d) + min(d)) / 2 as middle "
    "from level0 group by all"
)
ORACLE["center_distances"] = (
    "select vec_id as idx, batch, code, round((d - middle) / (high - middle + 1e-5), 6) as distance "
    "from level0 join level0_batches on batch = vec_id // 128"
)

# --- row identity and joins ------------------------------------------------------------

ORACLE["contiguous_idx"] = (
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as idx from lineitem"
)
ORACLE["join_index_items"] = (
    "select idx, item_id, title, code_0, code_1, code_2, code_3 "
    "from raw_items join index_rows using (idx)"
)
ORACLE["index_item_mismatch"] = (
    "select idx, 'items' as side, 1::bigint as n from kept_items where idx not in (select idx + 100 from codes) "
    "union all select idx + 100, 'index', case when (idx + 100) % 50 = 0 then 2 else 1 end from codes "
    "where idx + 100 not in (select idx from kept_items) or (idx + 100) % 50 = 0"
)
ORACLE["output_projection"] = (
    "select idx, "
    + ", ".join(f"coalesce({f}, '') as {f}" for f in FINAL_FIELDS)
    + f", '<' || coalesce(geohash, '') || '>' || {SID} as geo_sid, 'filled' as mode "
    "from raw_items join index_rows using (idx) join hashes using (idx) union all select idx, "
    + ", ".join("'' as shop_id" if f == "shop_id" else f for f in FINAL_FIELDS)
    + f", '<' || coalesce(geohash, '') || '>' || {SID} as geo_sid, 'raw' as mode "
    "from raw_items join index_rows using (idx) join hashes using (idx)"
)

# --- vector quantization -----------------------------------------------------------------

CTES["hidden"] = (
    "select vec_id, list(greatest(list_sum(list_transform(list_zip(x, c), lambda z: z[1] * z[2])) "
    "+ code / 100.0::double, 0) order by code) as h from vec, cb where level = 0 group by vec_id"
)
ORACLE["mlp_project"] = (
    "select vec_id as idx, u::int as pos, round(list_sum(list_transform(h, "
    "lambda e, i: e * ((((i - 1) * 7 + u * 3) % 11) - 5) / 10.0::double)) + u / 10.0::double, 6) as value "
    f"from hidden, range({CODES}) as r(u)"
)
ORACLE["codebook_distance"] = (
    "select vec_id as idx, code, round(d, 6) as distance from level0"
)
ORACLE["nearest_code"] = "select vec_id as idx, code, round(d, 6) as distance from near0"
ORACLE["residual_quantize"] = "select * from codes"
CTES["clean_vec"] = (
    f"select vec_id, list(case when {BROKEN} or isinf(x) then 0 else x end::double order by i) as x "
    "from dirty group by vec_id"
)
CTES["clean0"] = nearest("clean_vec", "x", "vec_id", 0)
CTES["clean1"] = nearest("clean0", "rest", "vec_id", 1)
CTES["clean2"] = nearest("clean1", "rest", "vec_id", 2)
ORACLE["residual_quantize_dirty"] = (
    "select vec_id as idx, a.code as code_0, b.code as code_1, c.code as code_2 "
    "from clean0 a join clean1 b using (vec_id) join clean2 c using (vec_id)"
)
CTES["words_of"] = (
    "select vec_id, level, c from vec_codes join cb on "
    "(level = 0 and code = code_0) or (level = 1 and code = code_1) or (level = 2 and code = code_2)"
)
CTES["recon"] = (
    "select vec_id, list_value("
    + ", ".join(f"sum(c[{i}])" for i in range(1, DIM + 1))
    + ") as y from words_of group by vec_id"
)
ORACLE["decode_codes"] = long_form("vec_id as idx", "y", "recon")
CTES["level_errors"] = (
    "select level, avg(e) as mse from (select level, "
    "case level when 0 then rest0 when 1 then rest1 else rest2 end as r, "
    f"list_sum(list_transform(r, lambda v: v * v)) / {DIM} as e "
    "from item_vec join vec_codes using (vec_id), range(3) as l(level)) group by level"
)
ORACLE["quantization_loss"] = (
    "select level::int as level, round(mse, 6) as mse, round(1.25 * mse, 6) as loss, "
    "round(avg(1.25 * mse) over (), 6) as mean_loss from level_errors"
)
ORACLE["reconstruction_loss"] = (
    "select kind, round(recon, 6) as recon, "
    "round(recon + (select avg(1.25 * mse) from level_errors), 6) as total from ("
    f"select 'mse' as kind, avg({GAP.format(a='x', b='y')} / {DIM}) as recon "
    "from item_vec join vec using (vec_id) join recon using (vec_id) union all "
    f"select 'l1', avg(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) / {DIM}) "
    "from item_vec join vec using (vec_id) join recon using (vec_id))"
)
CTES["moved"] = (
    "select code, list_value("
    + ", ".join(f"avg(x[{i}])" for i in range(1, DIM + 1))
    + ") as m from item_vec join near0 using (vec_id) join vec using (vec_id) group by code"
)
CTES["updated"] = (
    "select cb.code, coalesce(m, c) as w from cb left join moved using (code) where level = 0"
)
ORACLE["lloyd_step"] = long_form("code", "w", "updated")
CTES["even"] = (
    "select 0 as level, code::int as code, list((('0x' || substr(md5('2024-0-' || code || '-' || p), 1, 8))"
    f"::bigint / 4294967296.0::double * 2 - 1) / {CODES} order by p) as c "
    f"from range({CODES}) as k(code), range({DIM}) as r(p) group by code"
)
CTES["near_even"] = nearest("vec", "x", "vec_id", 0, "even")
ORACLE["uniform_codebook"] = (
    "select vec_id as idx, code, round(d, 6) as distance from near_even"
)
AVERAGE = "list_value(" + ", ".join("avg({v}[%d])" % i for i in range(1, DIM + 1)) + ")"


def move_words(book: str, chosen: str, level: int) -> str:
    """Codewords of a level after an update; ``chosen`` has a code and a mean for each code taken."""
    return (
        f"select {level} as level, b.code, coalesce(m, c) as c from {book} b left join ({chosen}) using (code) "
        f"where b.level = {level}"
    )


def update_chain(prefix: str, source: str, vector: str, level: int, steps: int) -> str:
    """k-means updates over item vectors from the words of ``cb``; names the last codebook."""
    book = "cb"
    for step in range(steps):
        near, new = f"{prefix}n{step}", f"{prefix}b{step}"
        CTES[near] = nearest(source, vector, "vec_id", level, book)
        mean = AVERAGE.format(v=f"s.{vector}")
        chosen = (
            f"select n.code, {mean} as m from item_vec join {near} n using (vec_id) "
            f"join {source} s using (vec_id) group by n.code"
        )
        CTES[new] = move_words(book, chosen, level)
        book = new
    return book


GIVEN = []
for level in (0, 1):
    last = update_chain(f"km{level}", "vec", "x", level, 3)
    CTES[f"km{level}n"] = nearest("vec", "x", "vec_id", level, last)
    GIVEN.append(
        f"select level::int as restart, code, (p - 1)::int as pos, round(c[p], 6) as value, "
        f"(select round(sum(d), 6) from item_vec join km{level}n using (vec_id)) as cost "
        f"from {last}, range(1, {DIM} + 1) as r(p)"
    )
ORACLE["fit_codebook_given"] = " union all ".join(GIVEN)

RESIDUAL, source, vector = [], "vec", "x"
for level in range(LEVELS):
    last = update_chain(f"rq{level}", source, vector, level, 2)
    CTES[f"rq{level}n"] = nearest(source, vector, "vec_id", level, last)
    source, vector = f"rq{level}n", "rest"
    RESIDUAL.append(
        f"select {level} as level, round(avg(d) / {DIM}, 6) as mse from item_vec join rq{level}n using (vec_id)"
    )
ORACLE["fit_residual_given"] = " union all ".join(RESIDUAL)

ORACLE["fit_decoder"] = (
    f"select place::int as place, (select count(*) from item_vec) as n, 0.0::double as largest "
    f"from range({DIM} + 1) as r(place)"
)
CTES["code_mean"] = (
    "select code, " + AVERAGE.format(v="x") + " as m from item_vec join near0 using (vec_id) "
    "join vec using (vec_id) group by code"
)
CTES["decoded"] = "select idx, vec_id, m from item_vec join near0 using (vec_id) join code_mean using (code)"
ORACLE["decode_projected"] = long_form("idx", "m", "decoded")
ORACLE["reconstruction_loss_decoded"] = (
    f"select 'mse' as kind, round(avg({GAP.format(a='x', b='m')} / {DIM}), 6) as recon "
    "from decoded join vec using (vec_id) union all "
    f"select 'l1', round(avg(list_sum(list_transform(list_zip(x, m), lambda z: abs(z[1] - z[2]))) / {DIM}), 6) "
    "from decoded join vec using (vec_id)"
)
CTES["mixtures"] = (
    "select a.vec_id, list_transform(list_zip(a.x, b.x), lambda z: 0.55::double * z[1] + 0.5::double * z[2]) as m "
    "from vec a join vec b on b.vec_id = a.vec_id + 1"
)
CTES["all_words"] = "select 0 as level, vec_id::int as code, x as c from vec"
CTES["near_all"] = nearest("mixtures", "m", "vec_id", 0, "all_words")
ORACLE["nearest_code_grouped"] = "select vec_id as idx, code, round(d, 6) as distance from near_all"
ORACLE["model_tables"] = "select * from codes"
ORACLE["stream_assign"] = "select * from codes"


def sinkhorn_steps(p: str, source: str, batch: str, eps: float, iters: int) -> list[str]:
    """CTEs that normalise rows and columns of the long matrix of ``source(vec_id,
    code, d)`` in turn; the last, ``<p>_pick``, holds the code of the largest entry."""
    steps = [
        f"{p}_q0 as materialized (select vec_id, {batch} as batch, code, "
        "exp(-((d - middle) / (high - middle + 1e-5)) / "
        f"{eps}::double) as q from (select *, max(d) over w as high, (max(d) over w + min(d) over w) / 2 "
        f"as middle from {source} window w as (partition by {batch})))"
    ]
    for i in range(iters):
        steps.append(
            f"{p}_r{i} as materialized (select vec_id, batch, code, q / sum(q) over "
            f"(partition by batch, vec_id) as q from {p}_q{i})"
        )
        steps.append(
            f"{p}_q{i + 1} as materialized (select vec_id, batch, code, q / sum(q) over "
            f"(partition by batch, code) / {CODES} as q from {p}_r{i})"
        )
    steps.append(
        f"{p}_pick as materialized (select vec_id, batch, code from (select *, row_number() over "
        f"(partition by vec_id order by q desc, code) as place from {p}_q{iters}) where place = 1)"
    )
    return steps


def with_steps(base: str, steps: list[str], body: str) -> str:
    """A query whose own CTEs ``steps`` follow the shared CTEs that ``base`` names."""
    shared = with_ctes(base)[: -len(base)].rstrip()
    return shared + ",\n" + ",\n".join(steps) + "\n" + body


def sinkhorn(batch: str, eps: float, iters: int) -> str:
    return with_steps(
        "select level0",
        sinkhorn_steps("s", "level0", batch, eps, iters),
        "select vec_id as idx, batch, code from s_pick",
    )


def left_over(source: str, vector: str, picks: str, level: int) -> str:
    return (
        f"select s.vec_id, list_transform(list_zip(s.{vector}, c), lambda z: z[1] - z[2]) as rest "
        f"from {source} s join {picks} p using (vec_id) join cb on cb.level = {level} and cb.code = p.code"
    )


def measured(source: str, level: int) -> str:
    gap = GAP.format(a="s.rest", b="cb.c")
    return f"select s.vec_id, cb.code, {gap} as d from {source} s, cb where cb.level = {level}"


def balanced_codes() -> str:
    """Level 0 balanced, level 1 nearest, level 2 balanced."""
    steps = sinkhorn_steps("x", "level0", "vec_id // 128", 0.05, 4)
    steps.append(f"left0 as materialized ({left_over('vec', 'x', 'x_pick', 0)})")
    steps.append(f"mid as materialized ({nearest('left0', 'rest', 'vec_id', 1)})")
    steps.append(f"gap2 as materialized ({measured('mid', 2)})")
    steps += sinkhorn_steps("z", "gap2", "vec_id // 128", 0.05, 4)
    return with_steps(
        "select level0, vec, cb",
        steps,
        "select vec_id as idx, x_pick.batch, x_pick.code as code_0, mid.code as code_1, "
        "z_pick.code as code_2 from x_pick join mid using (vec_id) join z_pick using (vec_id)",
    )


CTES["run_epochs"] = (
    "select (o_custkey % 7)::varchar as run, "
    "(row_number() over (partition by o_custkey % 7 order by o_orderkey) - 1)::int as epoch, "
    "o_totalprice / 100000::double as loss, floor(o_totalprice / 5000::double) / 100::double "
    "as collision_rate from orders"
)
# The border of the kept rates is found by walking epochs with a growing best list.
CTES["walk"] = """
select run, 0 as epoch, [{rate: collision_rate, name: '0_'}] as best
from run_epochs where epoch = 0
union all
select w.run, e.epoch, case
    when len(w.best) < 5 then list_sort(list_append(w.best, {rate: e.collision_rate, name: e.epoch || '_'}))
    when e.collision_rate < list_max(w.best).rate then
      list_append(list_filter(w.best, lambda b: not (b.rate = list_max(w.best).rate and b.name =
        list_min(list_transform(list_filter(w.best, lambda t: t.rate = list_max(w.best).rate), lambda t: t.name)))),
        {rate: e.collision_rate, name: e.epoch || '_'})
    else w.best end
from walk w join run_epochs e on e.run = w.run and e.epoch = w.epoch + 1
"""
CTES["last_walk"] = (
    "select run, epoch as last_epoch, list_transform(best, lambda b: b.name) as names from walk "
    "where epoch = (select max(epoch) from run_epochs r where r.run = walk.run)"
)
ORACLE["pick_best_model"] = (
    "select run, epoch, loss, collision_rate, "
    "epoch = arg_min(epoch, (loss, epoch)) over (partition by run) as best_loss, "
    "epoch = arg_min(epoch, (collision_rate, epoch)) over (partition by run) as best_collision, "
    "(epoch > last_epoch - 5 or list_contains(names, epoch || '_')) as kept "
    "from run_epochs join last_walk using (run)"
)

# --- codes ---------------------------------------------------------------------------------

ORACLE["collision_stats"] = (
    "select sum(n)::bigint as total, count(*) as unique_sids, max(n) as max_bucket, "
    "round((sum(n) - count(*)) / sum(n), 6) as rate from buckets"
)
ORACLE["validation_collision"] = (
    "select count(*) as total, count(distinct k) as unique_keys, "
    "round((count(*) - count(distinct k)) / count(*), 6) as rate "
    "from (select code_0 || '-' || code_1 || '-' || code_2 as k from codes)"
)
ORACLE["collision_groups"] = (
    "select code_0, code_1, code_2, idx, n as group_size "
    "from codes join buckets using (code_0, code_1, code_2) where n > 1"
)
ORACLE["dedup_rank"] = "select * from ranked"
ORACLE["index_in_batches"] = "select * from ranked"
ORACLE["stream_index"] = (
    "select code_0, code_1, code_2, count(*) as items, 1 as low, count(*)::int as high, count(*) as ranks, "
    "sum(idx)::bigint as idx_sum from ranked group by all"
)
ORACLE["is_collision_free"] = (
    "select count(*) = count(distinct (code_0, code_1, code_2)) as collision_free, 'raw' as codes "
    "from ranked union all select count(*) = count(distinct (code_0, code_1, code_2, code_3)), 'ranked' "
    "from ranked"
)
CTES["usage"] = (
    "select level, code, count(*) as n from (select unnest([0, 1, 2]) as level, "
    "unnest([code_0, code_1, code_2]) as code from codes) group by all"
)
CTES["usage_share"] = (
    "select *, n / sum(n) over (partition by level) as p, "
    "row_number() over (partition by level order by n desc, code) as place from usage"
)
ORACLE["level_usage"] = (
    "select level, count(*) as used, max(code)::bigint + 1 as slots, "
    "round(case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 0 end, 6) as entropy_ratio, "
    "round(sum(p) filter (place <= 5), 6) as top5_share, round(max(p), 6) as top1_share "
    "from usage_share group by level"
)
ORACLE["top_buckets"] = (
    "select '<a_' || code_0 || '><b_' || code_1 || '><c_' || code_2 || '>' as sid, n as bucket_size "
    "from buckets order by bucket_size desc, sid limit 100"
)
ORACLE["bucket_percentiles"] = "select " + ", ".join(
    f"floor(quantile_cont(n, {q / 100}))::bigint as p{q}" for q in (50, 90, 99)
) + " from buckets"
ORACLE["exclusive_items"] = (
    "select count(*) filter (n = 1) as exclusive, "
    "round(count(*) filter (n = 1) / sum(n), 6) as exclusive_share from buckets"
)
CTES["geo_codes"] = (
    "select codes.*, coalesce(geohash_3, '') as geohash from codes join hashes using (idx)"
)
CTES["geo_buckets"] = (
    "select geohash, code_0, code_1, code_2, count(*) as n from geo_codes group by all"
)


def bucket_summary(source: str, scope: str) -> str:
    return (
        f"select '{scope}' as scope, sum(n)::bigint as total, count(*) as unique_sids, "
        "max(n) as max_bucket, round((sum(n) - count(*)) / sum(n), 6) as rate, "
        "count(*) filter (n = 1) as exclusive, "
        f"round(count(*) filter (n = 1) / sum(n), 6) as exclusive_share from {source}"
    )


ORACLE["geo_collision"] = (
    bucket_summary("geo_buckets", "geo_sid") + " union all " + bucket_summary("buckets", "sid")
)
ORACLE["geo_collision_sets"] = ORACLE["geo_collision"]
ORACLE["distinct_geohashes"] = "select count(distinct geohash) as geohashes from geo_codes"
ORACLE["norm_stats"] = (
    "select count(*) as n, round(min(x), 6) as min_norm, round(median(x), 6) as median_norm, "
    "round(avg(x), 6) as mean_norm, round(max(x), 6) as max_norm, round(stddev_pop(x), 6) as std_norm "
    "from (select x from (select "
    + NORM.format(v="embedding")
    + " as x, idx from item_vec join embeddings using (vec_id)) order by md5(idx || '-0') limit 200000)"
)


def repeats(source: str) -> str:
    return (
        "select count(*) as total, count(distinct embedding) as distinct_vectors, "
        "count(*) - count(distinct embedding) as repeats, "
        "round((count(*) - count(distinct embedding)) * 100.0 / count(*), 6) as repeat_pct "
        f"from {source}"
    )


ORACLE["dup_vectors_sample"] = repeats(
    "(select embedding from item_vec join embeddings using (vec_id) order by md5(idx || '-0') limit 900)"
)
ORACLE["dup_vectors_full"] = repeats("item_vec join embeddings using (vec_id)")

# --- sampling --------------------------------------------------------------------------------

ORACLE["row_sample"] = "select idx, item_id from raw_items order by md5(idx || '-7') limit 777"
CTES["picked_blocks"] = (
    "select b from range((select greatest(count(*) // 100, 1) from part)) as r(b) "
    "order by md5(b || '-2024') limit (select ceil(least(730, count(*)) / 100.0)::int from part)"
)
ORACLE["block_sample"] = (
    "select idx, item_id from raw_items where idx // 100 in (select b from picked_blocks) "
    "order by idx limit 730"
)
ORACLE["epoch_shuffle"] = (
    "select idx, position, position // 512 as batch, epoch from (select idx, epoch::int as epoch, "
    "row_number() over (partition by epoch order by md5(idx || '-' || epoch || '-2024')) - 1 as position "
    "from raw_items, range(2) as e(epoch))"
)

# --- merge tokens --------------------------------------------------------------------------------

CTES["seqs"] = (
    "select [code_0, code_1, code_2] as seq, count(*) as n from toks group by all"
)
CTES["kept_seqs"] = (
    "select [code_0, code_1, code_2] as seq, count(*) as n from kept_index group by all"
)
ORACLE["seq_freq"] = "select array_to_string(seq, '') as seq, n from seqs"


def pairs(source: str, seq: str) -> str:
    return (
        f"select a, b, sum(n)::bigint as n from (select {seq}[i] as a, {seq}[i + 1] as b, n "
        f"from {source}, range(1, 3) as r(i) where i < len({seq})) group by a, b"
    )


def best(source: str, least: int) -> str:
    return f"select n, a, b from ({source}) where n >= {least} order by n desc, a desc, b desc limit 1"


def merged(seq: str, a: str, b: str, sym: str) -> str:
    """Sequences hold at most three tokens, so a merge is a choice of positions."""
    return (
        f"case when {seq}[1] = {a} and {seq}[2] = {b} then list_concat([{sym}], {seq}[3:]) "
        f"when {seq}[2] = {a} and {seq}[3] = {b} then [{seq}[1], {sym}] else {seq} end"
    )


ORACLE["pair_counts"] = pairs("seqs", "seq")
ORACLE["best_pair"] = best(pairs("seqs", "seq"), 10)
CTES["top_pair"] = best(pairs("seqs", "seq"), 10)
ORACLE["merge_pair"] = (
    "select array_to_string(seq, '') as seq, array_to_string("
    + merged("seq", "a", "b", "'<m_1>'")
    + ", '') as merged, s.n from seqs s, top_pair"
)


def merge_chain(source: str, prefix: str) -> None:
    """One best pair and one rewritten corpus per round."""
    CTES[f"{prefix}_w0"] = f"select seq, seq as cur, []::varchar[] as produced, n from {source}"
    for i in range(1, MERGES + 1):
        before = f"{prefix}_w{i - 1}"
        CTES[f"{prefix}_b{i}"] = best(pairs(before, "cur"), MERGE_MIN)
        new = merged("cur", "a", "b", f"'<m_{i}>'")
        CTES[f"{prefix}_w{i}"] = (
            f"select seq, coalesce({new}, cur) as cur, case when len(coalesce({new}, cur)) < len(cur) "
            f"then list_append(produced, '<m_{i}>') else produced end as produced, w.n "
            f"from {before} w left join {prefix}_b{i} on true"
        )


merge_chain("seqs", "m")
merge_chain("kept_seqs", "k")
LEARNED = " union all ".join(
    f"select {i - 1} as rank, a, b, '<m_{i}>' as sym from m_b{i}" for i in range(1, MERGES + 1)
)
CTES["rules"] = LEARNED
ORACLE["learn_merges"] = "select * from rules"
CTES["spelled"] = (
    "select rank, map([sym], [a || b]) as known, sym, a || b as expansion from rules where rank = 0 "
    "union all select r.rank, map_concat(s.known, map([r.sym], [coalesce(s.known[r.a], r.a) || "
    "coalesce(s.known[r.b], r.b)])), r.sym, coalesce(s.known[r.a], r.a) || coalesce(s.known[r.b], r.b) "
    "from spelled s join rules r on r.rank = s.rank + 1"
)
ORACLE["expand_merges"] = "select sym, expansion from spelled"
# All rounds of the default limits: each round's corpus is the next one's input, and the
# recursion ends when no pair is frequent enough.
CTES["default_rounds"] = (
    "select 0 as round, seq, seq as cur, n, null::varchar as a, null::varchar as b from seqs union all "
    f"select w.round + 1, w.seq, coalesce({merged('w.cur', 't.a', 't.b', chr(39) + '<m_' + chr(39) + ' || (w.round + 1) || ' + chr(39) + '>' + chr(39))}, w.cur), "
    f"w.n, t.a, t.b from default_rounds w, ({best(pairs('default_rounds', 'cur'), MIN_COUNT)}) t where w.round < {V_MEM}"
)
CTES["default_rules"] = (
    "select distinct round - 1 as rank, a, b, '<m_' || round || '>' as sym from default_rounds where round > 0"
)
CTES["default_spelled"] = CTES["spelled"].replace("spelled", "default_spelled").replace("rules", "default_rules")
ORACLE["learn_merges_default"] = (
    "select rank::int as rank, a, b, sym, expansion from default_spelled join default_rules using (rank, sym)"
)
LAST = f"m_w{MERGES}"
ORACLE["apply_merges"] = (
    f"select array_to_string(seq, '') as seq, array_to_string(produced, ' ') as produced from {LAST}"
)
ORACLE["mem_coverage"] = (
    "select sym, sum(n)::bigint as items_with, round(sum(n) / (select sum(n) from seqs), 6) as ratio "
    f"from (select unnest(produced) as sym, n from {LAST}) group by sym"
)
ORACLE["mem_totals"] = (
    "select sum(n)::bigint as items, sum(case when len(produced) > 0 then n else 0 end)::bigint as with_mem, "
    f"sum(case when len(produced) = 0 then n else 0 end)::bigint as without_mem from {LAST}"
)
MEM = "array_to_string(produced, '')"
ORACLE["mem_sid"] = (
    f"select idx, {MEM} as mem_sid from toks join {LAST} on seq = [code_0, code_1, code_2]"
)
ORACLE["lookup_mem"] = ORACLE["mem_sid"]
ORACLE["final_table"] = (
    f"select idx, {FINAL}, geo_sid, {MEM} as mem_sid from kept_sid "
    f"join k_w{MERGES} on seq = [code_0, code_1, code_2]"
)

def balanced_fit(steps: int) -> str:
    """Two levels refined in turn, the first one balanced."""
    out, book = [], "cb"
    for s in range(steps):
        gap = GAP.format(a="s.x", b="b.c")
        out.append(
            f"fd{s} as materialized (select s.vec_id, b.code, {gap} as d from vec s, {book} b where b.level = 0)"
        )
        out += sinkhorn_steps(f"fs{s}", f"fd{s}", "vec_id // 128", 0.05, 3)
        mean = f"select code, {AVERAGE.format(v='x')} as m from vec join fs{s}_pick using (vec_id) group by code"
        out.append(f"fa{s} as materialized ({move_words(book, mean, 0)})")
        out.append(
            f"fl{s} as materialized (select vec_id, list_transform(list_zip(x, c), lambda z: z[1] - z[2]) as rest "
            f"from vec join fs{s}_pick using (vec_id) join fa{s} using (code))"
        )
        out.append(f"fn{s} as materialized ({nearest(f'fl{s}', 'rest', 'vec_id', 1, book)})")
        mean = (
            f"select code, {AVERAGE.format(v='l.rest')} as m from fl{s} l join fn{s} using (vec_id) group by code"
        )
        out.append(f"fb{s} as materialized (select * from fa{s} union all {move_words(book, mean, 1)})")
        book = f"fb{s}"
    body = (
        f"select level, code, (p - 1)::int as pos, round(c[p], 6) as value from {book}, range(1, {DIM} + 1) as r(p)"
    )
    return with_steps("select vec, cb", out, body)


def repaired(rounds: int, eps: float, iters: int) -> str:
    """Rounds of repair: every shared tuple is a batch over the last level's codes."""
    last = LEVELS - 1
    names = ", ".join(f"code_{i}" for i in range(last))
    out = [
        "e0 as materialized (select idx, vec_id, " + names + f", code_{last} as code "
        "from item_vec join vec_codes using (vec_id))",
        f"egap as materialized (select vec_id, cb.code, {GAP.format(a=f'rest{last - 1}', b='cb.c')} as d "
        f"from vec_codes, cb where cb.level = {last})",
    ]
    for r in range(rounds):
        out.append(
            f"em{r} as materialized (select * from (select *, count(*) over (partition by {names}, code) as held, "
            f"concat_ws('-', {names}, code) as grp from e{r}) where held > 1)"
        )
        out.append(
            f"ed{r} as materialized (select m.idx as vec_id, m.grp, g.code, g.d from em{r} m join egap g using (vec_id))"
        )
        out += sinkhorn_steps(f"es{r}", f"ed{r}", "grp", eps, iters)[:-1]
        # Weights that are equal but for rounding count as equal.
        out.append(
            f"ep{r} as materialized (select vec_id as idx, min(code) as moved from (select *, max(q) over "
            f"(partition by vec_id) as top from es{r}_q{iters}) where q >= top * (1 - 1e-9) group by vec_id)"
        )
        out.append(
            f"e{r + 1} as materialized (select idx, vec_id, {names}, coalesce(moved, code) as code "
            f"from e{r} left join ep{r} using (idx))"
        )
    body = f"select idx, {names}, code::int as code_{last} from e{rounds}"
    return with_steps("select vec_codes, item_vec, cb", out, body)


SINKHORN = {
    "sinkhorn_assign": sinkhorn("vec_id // 128", 0.05, 5),
    "sinkhorn_assign_spread": sinkhorn("0", 0.05, 5),
    "residual_quantize_balanced": balanced_codes(),
    "fit_balanced": balanced_fit(2),
    "resolve_collisions_given": repaired(2, 0.05, 4),
}
