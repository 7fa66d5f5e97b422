"""SQL (DuckDB) for the rows of the queries that SQL can express, over the same tables."""

from __future__ import annotations


def _tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _fold(x: str) -> str:
    return f"replace(replace(replace(replace(strip_accents(lower({x})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')"


def _native(x: str) -> str:
    return f"regexp_matches({x}, '[\\x{{0900}}-\\x{{0DFF}}]')"


def _bucket(x: str, seed: int, k: int) -> str:
    return f"(('0x' || substr(md5({x} || ':{seed}'), 1, 8))::BIGINT % {k})"


def _leet(x: str) -> str:
    return f"case when regexp_matches({x}, '[0-9]') and regexp_matches({x}, '[a-z]') and not regexp_matches({x}, '^[0-9]+(st|nd|rd|th)$') then translate({x}, '0123456789', 'olzeasgtbg') else {x} end"


def _unzero(x: str) -> str:
    return f"case when regexp_matches({x}, '^[0-9]+$') then regexp_replace({x}, '^0+([0-9])', '\\1') else {x} end"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda x: x <> '')"


def _runs(x: str) -> str:
    return f"list_filter({x}, lambda t, i: i = 1 or t <> ({x})[i - 1])"


_CUSTOMER = f"""
np as (select max(p_partkey) + 1 as n from part),
own as (
  select c_custkey::varchar as k, lower(r_name) as country, {_tokens("lower(p_name || ' ' || p_type || ' ' || p_brand)")} as w,
    replace(lower((c_custkey % 977)::varchar || ' ' || c_mktsegment || ' ' || n_name), '_', ' ') as addr
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey cross join np join part on p_partkey = c_custkey % np.n),
cp as (
  select *, {_bucket("k", 3, 4)} = 0 as blank, {_bucket("k", 1, 5)} = 0 as lost1, {_bucket("k", 2, 5)} = 0 as lost2, array_to_string(w, ' ') as plain,
    list_transform(w, lambda t: case when t = 'gizmo' and {_bucket("k", 8, 2)} = 0 then 'कमल' else t end) as v,
    array_to_string(list_transform(w, lambda t: case when t = 'medium' and {_bucket("k", 9, 2)} = 0 then 'med' else t end), ' ') as short, {_bucket("k", 10, 8)} = 0 as dom from own),
rec0 as (
  select 'S1-' || k as id, country, plain as name_n, addr as addr_n, 0 as role, 'S1-' || k as owner, false as is_domain from cp
  union all select 'S2-' || k, country, array_to_string(list_concat(list_concat(v[2:2], v[1:1]), v[3:22]), ' '), case when blank then '' when lost1 then '9' || addr else addr end, 1, case when not lost1 then 'S1-' || k end, false from cp
  union all select 'S3-' || k, country, replace(substr(short, 1, greatest(length(short) - 1, 1)), case when dom then ' ' else '#' end, ''), case when blank then '' when lost2 then '9' || addr else addr end, 2, case when not lost2 then 'S1-' || k end, dom from cp),
rec as (
  select *, replace(name_n, ' ', '') as name_sq, {_words("name_n")} as nt, {_words("addr_n")} as aw, string_split(name_n, ' ') as nr, string_split(addr_n, ' ') as ar from rec0),
ref as (select * from rec where role = 0), qry as (select * from rec where role > 0)"""

_P = f"with recursive {_CUSTOMER}"
_PAIRS = f"""{_P},
pairs as (
  select q.id as q_id, r.id as s1_id, r.name_n as n1, r.addr_n as a1, q.name_n as n2, q.addr_n as a2, r.nr as nr1, q.nr as nr2, r.ar as ar1, q.ar as ar2, r.nt as nt1, q.nt as nt2, r.aw as at1, q.aw as at2, q.country, q.is_domain
  from qry q join ref r on r.id = q.owner)"""

_TOKDF = "tokdf as (select country, t, count(*) as df from (select country, unnest(list_distinct(aw)) as t from ref) group by all)"


def _rare_pairs(source: str, n: int) -> str:
    return f"""
  select a.id, a.country, 'p:' || a.t || '_' || b.t as key
  from (select id, country, t, row_number() over (partition by id order by df, t) as r from (select id, country, unnest(list_distinct(aw)) as t from {source}) join tokdf using (country, t)) a
  join (select id, t, row_number() over (partition by id order by df, t) as r from (select id, country, unnest(list_distinct(aw)) as t from {source}) join tokdf using (country, t)) b on a.id = b.id and a.r <= {n} and b.r <= {n} and a.t < b.t"""


def _own_keys(source: str) -> str:
    return f"""
  select distinct id, country, 'n:' || unnest(list_distinct(nt)) as key from {source}
  union select id, country, 'a:' || unnest(list_distinct(aw)) from {source}
  union select id, country, 'b:' || nt[i] || '_' || nt[i + 1] from (select id, country, nt, unnest(range(1, len(nt))) as i from {source})
  union select id, country, 'q:' || substr(name_sq, 1, 8) from {source} where length(name_sq) >= 6
  union select id, country, 'x:' || array_to_string(list_sort(aw), ' ') from {source} where len(aw) >= 3
  union select a.id, a.country, 'h:' || d || '_' || w from (select id, country, unnest(list_distinct(aw)) as d from {source}) a join (select id, unnest(list_distinct(aw)) as w from {source}) b on a.id = b.id
    where regexp_matches(d, '[0-9]') and not regexp_matches(w, '[0-9]')"""


_CAND = f"""{_P}, {_TOKDF},
rk as ({_own_keys('ref')} union all {_rare_pairs('ref', 7)}),
qk as ({_own_keys('qry')} union all {_rare_pairs('qry', 5)}),
idx as (
  select id, country, key, df from (select *, count(*) over (partition by country, key) as df from rk)
  where df <= case substr(key, 1, 2) when 'n:' then 40 when 'a:' then 40 when 'b:' then 150 when 'q:' then 150 when 'p:' then 100 when 'h:' then 100 when 'x:' then 150 else 0 end),
n1 as (select country, count(*) as n1 from ref group by country),
ev as (
  select qk.id as q_id, idx.id as s1_id, count(*) as n_keys, round(sum(ln((n1 + 1) / df)), 6) as score, round(max(ln((n1 + 1) / df)), 6) as max_idf,
    count(*) filter (where key[1:2] = 'n:') as k_name, count(*) filter (where key[1:2] = 'a:') as k_addr, count(*) filter (where key[1:2] = 'b:') as k_bigram, count(*) filter (where key[1:2] = 'q:') as k_sq,
    count(*) filter (where key[1:2] = 'p:') as k_pair, count(*) filter (where key[1:2] = 'h:') as k_numpair, count(*) filter (where key[1:2] = 'x:') as k_addrbag, count(*) filter (where key[1:2] = 'c:') as k_cross
  from qk join idx using (country, key) join n1 using (country) group by all),
cand as materialized (select * exclude (r) from (select *, row_number() over (partition by q_id order by score desc, s1_id) as r from ev) where r <= 10)"""

_DOCS = f"""with d0 as (
  select doc_id, lang as country, regexp_extract(source, '([0-9]+)$', 1)::int % 3 as role, {_tokens(_fold("replace(text, '&', ' and ')"))} as w from documents),
docs as (
  select 'S' || (role + 1) || '-' || doc_id as id, country, role, array_to_string({_runs('w[1:6]')}, ' ') as name_n, array_to_string(list_transform(w[7:], lambda t: {_unzero('t')}), ' ') as addr_n from d0)"""


def _subset_keys() -> str:
    bag = f"list_sort(list_distinct(list_transform(nt, lambda t: {_leet('t')})))"
    return f"""{_P},
bags as (select id, {bag} as b, len({bag}) as n from rec),
ij as (select id, b, n, i, unnest(range(i, n + 1)) as j from (select id, b, n, unnest(range(0, n + 1)) as i from bags)),
cuts as (
  select id, (i < n)::int + (j < n and j <> i)::int as d, least(case when n <= 7 then 2 else 1 end, n - 1) as most, list_filter(b, lambda t, k: k - 1 <> i and k - 1 <> j) as ws
  from ij where i = n or i < j),
sets as (select * from cuts where d <= most and len(ws) > 0 and not (len(ws) = 1 and ws[1] = 'brand'))"""


_SCORED = """scored as (
  select case when l_orderkey % 2 = 0 then 'S2-' else 'S3-' end || l_orderkey as q_id, 'S1-' || l_suppkey as s1_id, max(((l_partkey * 7919 + l_linenumber * 104729) % 1000) / 1000.0::double) as p
  from lineitem group by all),
ranked as (select *, row_number() over (partition by q_id order by p desc, s1_id) as r from scored),
best as (
  select q_id, max(s1_id) filter (where r = 1) as s1_id, max(p) filter (where r = 1) as p1, max(s1_id) filter (where r = 2) as s1_id2, coalesce(max(p) filter (where r = 2), 0.0) as p2 from ranked where r <= 2 group by q_id)"""
_S = f"with {_SCORED}"
_TRUTH = "truth as (select distinct 'S1-' || l_suppkey as s1, case when l_orderkey % 2 = 0 then 'S2-' else 'S3-' end || l_orderkey as other from lineitem where l_linenumber = 1 and l_orderkey % 4 <> 0)"
_EVENTS = """ev as (
  select l_orderkey::varchar as q_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::int as s1_id, (l_quantity > 25)::int as label, (l_orderkey % 5)::int as fold, g, event
  from (select *, unnest([{'g': 'nop', 'event': l_returnflag}, {'g': 'aop', 'event': l_linestatus}, {'g': 'nins', 'event': l_suppkey::varchar}], recursive := true) from lineitem)),
ap as (select count(*) filter (where l_quantity > 25) as ap, count(*) filter (where l_quantity <= 25) as an from lineitem),
cnt as (select g, event, sum(label)::bigint as pos, sum(1 - label)::bigint as neg from (select distinct g, event, q_id, s1_id, label, fold from ev) group by all)"""
_EF = f"""with {_SCORED}, {_TRUTH},
pred as (select s1_id as s1, q_id as other from best where p1 >= 0.8),
ent as (
  select 'S1-' || s_suppkey as s1, s_nationkey::varchar as country, coalesce(t.n, 0) as n_true, coalesce(p.n, 0) as n_pred, coalesce(b.n, 0) as tp
  from supplier left join (select s1, count(*) as n from truth group by 1) t on t.s1 = 'S1-' || s_suppkey left join (select s1, count(*) as n from pred group by 1) p on p.s1 = 'S1-' || s_suppkey
    left join (select s1, count(*) as n from truth join pred using (s1, other) group by 1) b on b.s1 = 'S1-' || s_suppkey),
f as (
  select *, case when n_true = 0 then (n_pred = 0)::int::double when tp = 0 then 0.0 else 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) end as f from ent)"""
_FM = """count(*) as entities, round(avg(f), 6) as macro_f05, round(avg(f) filter (where n_true = 0), 6) as singleton_f, round(avg(f) filter (where n_true > 0), 6) as matched_f,
  round(avg(tp / n_pred) filter (where n_true > 0 and n_pred > 0), 6) as matched_precision, round(avg((n_pred > 0)::int), 6) as predicted_share, round(avg(tp / n_true) filter (where n_true > 0), 6) as matched_recall"""
_GRID = f"""{_S}, {_TRUTH},
grid as (select * from (values (0.5), (0.7), (0.9)) a(threshold), (values (0.0), (0.2)) b(gap)),
cells as (
  select threshold::double as threshold, gap::double as gap, count(*) filter (where p1 >= threshold and p1 - p2 >= gap) as n_pred, count(*) filter (where p1 >= threshold and p1 - p2 >= gap and s1_id = s1) as tp, count(s1) as n_true
  from best left join truth on other = q_id cross join grid group by all),
scores as (
  select *, round(tp / n_pred, 6) as precision, round(tp / n_true, 6) as recall, round(case when tp > 0 then 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) else 0.0 end, 6) as f05 from cells)"""
_SIB = f"""{_P},
sc as (
  select id as q_id, owner as s1_id, 0.85::double + {_bucket('id', 7, 15)} / 100.0::double as p from qry where owner is not null),
sc2 as (select * from sc union all select q_id, 'S1-' || (substr(s1_id, 4)::bigint + 1), p - 0.5 from sc where 'S1-' || (substr(s1_id, 4)::bigint + 1) in (select id from ref)),
sr as (select *, row_number() over (partition by q_id order by p desc, s1_id) as r from sc2)"""
_SIBCAND = f"""{_SIB},
bag as (select id, country, substr(id, 2, 1) as src, 'b:' || array_to_string(list_sort(aw), ' ') as key from qry where len(aw) >= 3 and regexp_matches(addr_n, '[0-9]')),
wd as (select id, country, substr(id, 2, 1) as src, unnest(list_distinct(list_filter(aw, lambda t: not regexp_matches(t, '[0-9]')))) as t from qry),
tp as (select id, country, src, t from (select id, country, src, t, row_number() over (partition by id order by df, t) as r from wd join (select country, t, count(*) as df from wd group by all) using (country, t)) where r <= 2),
hn as (select distinct id, h from (select id, regexp_replace(unnest(regexp_extract_all(addr_n, '[0-9]+')), '^0+', '') as h from qry) where length(h) >= 2),
ks as (select id as q_id, country, src, key from bag union all select tp.id, country, src, 'h:' || h || '_' || t from tp join hn using (id)),
k2 as (select * from ks where (country, src, key) in (select (country, src, key) from ks group by country, src, key having count(*) <= 20)),
held as (select q_id as o_id, country, src, key, s1_id from k2 join (select q_id, s1_id from sr where r = 1 and p >= 0.9) using (q_id)),
h2 as (select * from held where (country, src, key) in (select (country, src, key) from held group by country, src, key having count(distinct s1_id) <= 2)),
pr as (select k2.q_id, s1_id, count(distinct o_id) as sc_n, count(distinct key) as sc_keys from k2 join h2 using (country, src, key) where k2.q_id <> o_id group by all),
found as (select * exclude (r) from (select *, row_number() over (partition by q_id order by sc_n desc, sc_keys desc, s1_id) as r from pr) where r <= 3)"""
_SHARED = """len(list_filter({a}, lambda t: list_contains({b}, t)))"""
_SIBFEAT = f"""{_SIB},
cn as (select country, t from (select country, unnest(list_distinct(nt)) as t from ref) group by all having count(*) > 50),
ca as (select country, t from (select country, unnest(list_distinct(aw)) as t from ref) where not regexp_matches(t, '[0-9]') group by all having count(*) > 50),
cl as (select c.country, coalesce((select list(t) from cn where cn.country = c.country), []) as cn, coalesce((select list(t) from ca where ca.country = c.country), []) as ca from (select distinct country from ref) c),
dv as (
  select sr.q_id, sr.s1_id, sr.p, sr.r, substr(sr.q_id, 2, 1) as src, list_distinct(list_filter(q.nt, lambda t: not list_contains(e.nt, t) and not list_contains(cl.cn, t))) as nd,
    list_distinct(list_filter(q.aw, lambda t: not list_contains(e.aw, t) and not list_contains(cl.ca, t))) as ad
  from sr join ref e on e.id = sr.s1_id join qry q on q.id = sr.q_id join cl on cl.country = q.country),
sb as (
  select x.q_id, x.s1_id, max({_SHARED.format(a='x.ad', b='y.ad')}) as ash, max({_SHARED.format(a='x.ad', b='y.ad')}) filter (where x.src = y.src) as asm, max({_SHARED.format(a='x.nd', b='y.nd')}) as nsh
  from dv x join dv y on x.s1_id = y.s1_id and x.q_id <> y.q_id and y.r = 1 and y.p >= 0.9 group by all)"""

_STOPS = """lv as (select country, t, count(*) as df from (select country, unnest(list_distinct(list_transform(nt, lambda t: {leet}))) as t from ref) group by all),
n1 as (select country, count(*) as n1 from ref group by country),
st as (select country, t from lv join n1 using (country) where df >= 0.004 * n1),
wv as (select country, t, count(*) as df from (select country, unnest(list_distinct(list_filter(aw, lambda t: not regexp_matches(t, '[0-9]')))) as t from ref) group by all)""".replace("{leet}", _leet("t"))


def _corruption_keys(source: str, name: str, words: int) -> str:
    """(id, country, fam, key) of a record set, as common table expressions whose names end in ``name``."""
    leet = _leet("t")
    return f"""
bg_{name} as (select id, country, name_sq, addr_n, list_sort(list_distinct(list_transform(nt, lambda t: {leet}))) as b from {source}),
ij_{name} as (select *, unnest(range(i, n + 1)) as j from (select id, country, b, len(b) as n, unnest(range(0, len(b) + 1)) as i from bg_{name})),
ct_{name} as (
  select id, country, (i < n)::int + (j < n and j <> i)::int as d, least(case when n <= 7 then 2 else 1 end, n - 1) as most, list_filter(b, lambda t, k: k - 1 <> i and k - 1 <> j) as ws
  from ij_{name} where i = n or i < j),
se_{name} as (select id, c.country, d, ws from ct_{name} c left join st on st.country = c.country and len(ws) = 1 and st.t = ws[1] where d <= most and len(ws) > 0 and st.t is null),
ty_{name} as (select id, x.country, x.t from (select id, country, unnest(b) as t from bg_{name}) x left join st on st.country = x.country and st.t = x.t where st.t is null and regexp_matches(x.t, '[a-z]')),
w_{name} as (select id, t from (select id, t, row_number() over (partition by id order by df, t) as r from (select id, country, unnest(list_distinct(aw)) as t from {source}) join wv using (country, t)) where r <= {words}),
r_{name} as (select id, t from (select id, t, row_number() over (partition by id order by df, t) as r from (select id, country, unnest(b) as t from bg_{name}) join lv using (country, t)) where r <= 2),
h0_{name} as (select distinct id, t from (select id, unnest(list_filter(list_transform(regexp_extract_all(addr_n, '[0-9]+'), lambda x: regexp_replace(x, '^0+', '')), lambda x: x <> '')[1:3]) as t from {source})),
h_{name} as (select id, t from h0_{name} union select id, substr(t, 1, i - 1) || substr(t, i + 1) from (select id, t, unnest(range(1, least(length(t), 8) + 1)) as i from h0_{name} where length(t) >= 3)),
sq_{name} as (select id, substr({_leet('name_sq')}, 1, 10) as p from {source} where length(name_sq) >= 5),
{name} as materialized (
  select distinct id, country, split_part(key, ':', 1) as fam, key from (
    select id, country, 'nb:' || array_to_string(ws, ' ') as key from se_{name}
    union all select id, country, 'ag:' || array_to_string(list_sort(string_split(array_to_string(ws, ''), '')), '') from se_{name} where d <= 1
    union all select id, country, 'ty:' || t from ty_{name}
    union all select id, country, 'ty:' || substr(t, 1, i - 1) || substr(t, i + 1) from (select *, unnest(range(1, length(t) + 1)) as i from ty_{name} where length(t) >= 5)
    union all select h.id, country, 'hn:' || h.t || '_' || w.t from h_{name} h join w_{name} w using (id) join {source} using (id)
    union all select r.id, country, 'cx:' || r.t || '_' || w.t from r_{name} r join w_{name} w using (id) join {source} using (id)
    union all select s.id, country, 'sw:' || s.p || '_' || w.t from sq_{name} s join w_{name} w using (id) join {source} using (id)))"""


def _hits(start: str, n1: str = "n1") -> str:
    return f"""{start}, {_STOPS.replace("n1 as (", f"{n1} as (").replace("join n1 using", f"join {n1} using")}, {_corruption_keys('ref', 'r2', 4)}, {_corruption_keys('qry', 'q2', 3)},
i2 as materialized (select * from (select *, count(*) over (partition by country, key) as df from r2) where df <= case when fam = 'ty' then 60 else 200 end),
hits as materialized (
  select q2.id as q_id, i2.id as s1_id, count(*) as v2_nkeys, round(sum(ln((n1 + 1) / df)), 6) as v2_score, round(max(ln((n1 + 1) / df)), 6) as v2_max_idf,
    count(*) filter (where i2.fam = 'nb') as v2_k_nb, count(*) filter (where i2.fam = 'ag') as v2_k_ag, count(*) filter (where i2.fam = 'hn') as v2_k_hn,
    count(*) filter (where i2.fam = 'cx') as v2_k_cx, count(*) filter (where i2.fam = 'sw') as v2_k_sw, count(*) filter (where i2.fam = 'ty') as v2_k_ty
  from q2 join i2 using (country, key) join {n1} using (country) group by all)"""


ORACLES = {
    "norm_names": f"""
with w as (select p_partkey, {_tokens("replace(lower(p_name || ' & ' || p_brand || ' & ' || p_type || ' & ' || p_type), '&', ' and ')")} as w from part)
select p_partkey, array_to_string({_runs('w')}, ' ') as name, false as is_domain from w""",
    "norm_addresses": f"""
select c_custkey, array_to_string(list_transform({_tokens("lower('00' || c_custkey || ', ' || c_mktsegment || ' - ' || c_name)")}, lambda t: {_unzero('t')}), ' ') as addr from customer""",
    "fold_documents": f"select doc_id, md5({_fold('text')}) as folded_md5 from documents",
    "domain_names": """
with h as (select page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as h from pages)
select page_id, case when regexp_matches(h, '^[a-z0-9][a-z0-9\\-]*(?:\\.[a-z0-9\\-]+)*\\.(?:com|net|org|in|fr|co|biz|info|io|us)$')
    then replace(replace(regexp_replace(h, '\\.(?:co\\.in|co\\.uk|com|net|org|in|fr|co|biz|info|io|us)$', ''), '-', ''), '.', '') else trim(regexp_replace(h, '[^0-9a-z]+', ' ', 'g')) end as name,
  regexp_matches(h, '^[a-z0-9][a-z0-9\\-]*(?:\\.[a-z0-9\\-]+)*\\.(?:com|net|org|in|fr|co|biz|info|io|us)$') as is_domain
from h""",
    "leet_tokens": "select p_partkey, 'b' || translate(p_partkey::varchar, '0123456789', 'olzeasgtbg') || 'r' as word, p_partkey::varchar as number, p_partkey || 'th' as ordinal from part",
    "native_flags": f"{_P} select id, {_native('name_n')} as native_name, {_native('addr_n')} as native_addr from rec",
    "party_records": f"{_P} select id, country, name_n, addr_n, name_sq, role, owner from rec",
    "document_records": f"{_DOCS} select id, country, name_n, addr_n, replace(name_n, ' ', '') as name_sq, role from docs",
    "token_df": f"{_P}, {_TOKDF} select country, t, df from tokdf",
    "keys_token": f"{_P} select id, 'n:' || unnest(list_distinct(nt)) as key from rec union all select id, 'a:' || unnest(list_distinct(aw)) from rec",
    "keys_bigram": f"{_P} select distinct id, 'b:' || nt[i] || '_' || nt[i + 1] as key from (select id, nt, unnest(range(1, len(nt))) as i from rec)",
    "keys_squash": f"{_P} select id, 'q:' || substr(name_sq, 1, 8) as key from rec where length(name_sq) >= 6",
    "keys_addrbag": f"{_P} select id, 'x:' || array_to_string(list_sort(aw), ' ') as key from rec where len(aw) >= 3",
    "keys_numword": f"""{_P} select a.id, 'h:' || d || '_' || w as key from (select id, unnest(list_distinct(aw)) as d from rec) a join (select id, unnest(list_distinct(aw)) as w from rec) b on a.id = b.id
where regexp_matches(d, '[0-9]') and not regexp_matches(w, '[0-9]')""",
    "keys_cross": f"""{_P} select a.id, 'c:' || n || '_' || w as key from (select id, unnest(list_distinct(nt)) as n from rec) a join (select id, unnest(list_distinct(aw)) as w from rec) b on a.id = b.id where not regexp_matches(w, '[0-9]')""",
    "keys_rarepair": f"{_P}, {_TOKDF} select id, key from ({_rare_pairs('qry', 5)})",
    "index_capped": f"{_CAND} select id, country, key, df from idx",
    "candidates_topk": f"{_CAND.replace('where r <= 10)', 'where r <= 5)')} select q_id, s1_id, n_keys, score from cand",
    "candidates_all_keys": f"{_CAND} select * from cand",
    "v2_namebag_keys": f"{_subset_keys()} select distinct id, 'nb:' || array_to_string(ws, ' ') as key from sets",
    "v2_anagram_keys": f"{_subset_keys()} select distinct id, 'ag:' || array_to_string(list_sort(string_split(array_to_string(ws, ''), '')), '') as key from sets where d <= 1",
    "v2_typo_keys": f"""{_P},
t as (select id, t from (select id, unnest(list_distinct(list_transform(nt, lambda t: {_leet('t')}))) as t from rec) where regexp_matches(t, '[a-z]') and t <> 'brand')
select id, 'ty:' || t as key from t union select id, 'ty:' || substr(t, 1, i - 1) || substr(t, i + 1) from (select id, t, unnest(range(1, length(t) + 1)) as i from t where length(t) >= 5)""",
    "v2_house_keys": f"""{_P},
h as (select distinct id, t from (select id, unnest(list_filter(list_transform(regexp_extract_all(addr_n, '[0-9]+'), lambda x: regexp_replace(x, '^0+', '')), lambda x: x <> '')[1:3]) as t from rec))
select id, t as key from h union select id, substr(t, 1, i - 1) || substr(t, i + 1) from (select id, t, unnest(range(1, least(length(t), 8) + 1)) as i from h where length(t) >= 3)""",
    "v2_cross_keys": f"{_P}, {_STOPS}, {_corruption_keys('qry', 'q2', 3)} select id, key from q2 where fam in ('hn', 'cx', 'sw')",
    "v2_hits": f"{_hits(_P)} select * from hits",
    "candidates_union": f"""{_hits(_CAND, 'n1b')},
t2 as (select * from (select *, row_number() over (partition by q_id order by v2_score desc, s1_id) as r from hits) where r <= 5)
select q_id, s1_id, (c.s1_id is not null)::bigint as in_v1, (t2.s1_id is not null)::bigint as in_v2, coalesce(n_keys, 0) as n_keys, coalesce(h.v2_nkeys, 0) as v2_nkeys, coalesce(c.score, 0) as score, coalesce(h.v2_score, 0) as v2_score
from (select q_id, s1_id from cand union select q_id, s1_id from t2) left join cand c using (q_id, s1_id) left join t2 using (q_id, s1_id) left join hits h using (q_id, s1_id)""",
    "blocking_recall": f"""{_CAND},
hit as (select q.id, q.country, q.addr_n = '' as blank, {_native('q.name_n')} as native, q.is_domain as dom, c.s1_id from qry q left join cand c on c.q_id = q.id and c.s1_id = q.owner where q.owner is not null),
per as (select country, avg(coalesce(n, 0)) as per_query from qry left join (select q_id, count(*) as n from cand group by 1) c on c.q_id = qry.id group by country)
select country, count(*) as n_true, count(s1_id) as n_found, round(count(s1_id) / count(*), 6) as recall, round(any_value(per_query), 6) as per_query,
  count(*) filter (where s1_id is null and blank) as missed_blank, count(*) filter (where s1_id is null and native) as missed_native, count(*) filter (where s1_id is null and dom) as missed_domain,
  round(count(s1_id) filter (where blank) / nullif(count(*) filter (where blank), 0), 6) as recall_blank, round(count(s1_id) filter (where native) / nullif(count(*) filter (where native), 0), 6) as recall_native,
  round(count(s1_id) filter (where dom) / nullif(count(*) filter (where dom), 0), 6) as recall_domain
from hit join per using (country) group by country""",
    "alias_fit": f"""{_PAIRS},
lo as (
  select 'n' as field, list_filter(nt1, lambda t: not list_contains(nt2, t)) as l, list_filter(nt2, lambda t: not list_contains(nt1, t)) as r from pairs
  union all select 'a', list_filter(at1, lambda t: not list_contains(at2, t)), list_filter(at2, lambda t: not list_contains(at1, t)) from pairs),
al as (select field, l[i] as s_tok, r[i] as q_tok from (select *, unnest(range(1, len(l) + 1)) as i from lo where len(l) = len(r) and len(l) between 1 and 4)),
c as (select field, q_tok, s_tok, count(*) as cnt from al group by all),
b as (select *, sum(cnt) over (partition by field, q_tok)::bigint as total, row_number() over (partition by field, q_tok order by cnt desc, s_tok) as r from c)
select field, q_tok, s_tok, cnt, total, round(cnt / total, 6) as purity from b where r = 1 and total >= 2 and cnt / total >= 0.3 and q_tok <> s_tok""",
    "alias_apply": f"""{_P},
x as (select id, array_to_string(list_transform(nr, lambda t: case t when 'small' then 'little' when 'ring' then 'band' else t end), ' ') as name_n, array_to_string(list_transform(ar, lambda t: case t when 'nation' then 'land' else t end), ' ') as addr_n from rec)
select id, x.name_n, x.addr_n, case when is_domain then name_sq else replace(x.name_n, ' ', '') end as name_sq from x join rec using (id)""",
    "alias_classes": f"{_P} select id, array_to_string(list_transform(nr, lambda t: case t when 'small' then 'tiny' when 'little' then 'tiny' when 'b0lt' then 'bolt' else t end), ' ') as name_n, name_sq from rec",
    "s1_ambiguity": f"{_P} select id, count(*) over (partition by country, name_n) as s1_name_dup, count(*) over (partition by country, addr_n) as s1_addr_dup from ref",
}


def _left(a: str, b: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({a}, lambda t: not list_contains({b}, t)))), ' ')"


_NUM = lambda c: f"regexp_extract_all({c}, '[0-9]+')"
_WHOLE = lambda c: f"list_filter(string_split({c}, ' '), lambda x: regexp_matches(x, '^[0-9]+$'))"
_INTER = lambda a, b: f"len(list_distinct(list_filter({a}, lambda t: list_contains({b}, t))))::bigint"
_ENTITY = """base as (select q_id, s1_id, p, r - 1 as q_rank, substr(q_id, 2, 1) = '3' as s3 from ranked),
t as (select s1_id, count(*) filter (where p >= 0.9) as st, count(*) filter (where p >= 0.9 and not s3) as s2, count(*) filter (where p >= 0.9 and s3) as st3, count(*) filter (where p >= 0.5) as md, sum(p) as sm, count(*) as n from base where q_rank = 0 group by 1),
a as (select s1_id, sum(p) as al, count(*) as an from base group by 1),
ec as (
  select b.q_id, b.s1_id, coalesce(st, 0) - (q_rank = 0 and p >= 0.9)::int as e_strong, coalesce(s2, 0) - (q_rank = 0 and p >= 0.9 and not s3)::int as e_strong_s2, coalesce(st3, 0) - (q_rank = 0 and p >= 0.9 and s3)::int as e_strong_s3,
    coalesce(md, 0) - (q_rank = 0 and p >= 0.5)::int as e_mid, coalesce(n, 0) - (q_rank = 0)::int as e_n, an - 1 as e_all_n, s3::bigint as src3, round(coalesce(sm, 0) - case when q_rank = 0 then p else 0 end, 6) as e_sum,
    coalesce((select max(o.p) from base o where o.s1_id = b.s1_id and o.q_rank = 0 and o.q_id <> b.q_id), 0.0) as e_max, round(al - p, 6) as e_all_sum
  from base b left join t using (s1_id) join a using (s1_id))"""

ORACLES |= {
    "leftover_tokens": f"""{_PAIRS} select q_id, s1_id, {_left('nr1', 'nr2')} as nr1, {_left('nr2', 'nr1')} as nr2, {_left('ar1', 'ar2')} as ar1, {_left('ar2', 'ar1')} as ar2,
{_left(_WHOLE('a1'), _WHOLE('a2'))} as mr1, {_left(_WHOLE('a2'), _WHOLE('a1'))} as mr2 from pairs""",
    "levenshtein_rest": f"""{_PAIRS} select q_id, length({_left('nr1', 'nr2')}) as n_rest_len1, length({_left('nr2', 'nr1')}) as n_rest_len2, length({_left('ar1', 'ar2')}) as a_rest_len1, length({_left('ar2', 'ar1')}) as a_rest_len2,
length({_left(_WHOLE('a1'), _WHOLE('a2'))}) as m_rest_len1, length({_left(_WHOLE('a2'), _WHOLE('a1'))}) as m_rest_len2,
levenshtein({_left(_WHOLE('a1'), _WHOLE('a2'))}, {_left(_WHOLE('a2'), _WHOLE('a1'))}) as m_rest_dist from pairs""",
    "token_overlap": f"{_PAIRS} select q_id, {_INTER('nr1', 'nr2')} as n_shared_tok, {_INTER('ar1', 'ar2')} as a_shared_tok, len(nr1) as n1_ntok, len(nr2) as n2_ntok, len(ar1) as a1_ntok, len(ar2) as a2_ntok from pairs",
    "number_features": f"""{_PAIRS} select q_id, {_INTER(_NUM('a1'), _NUM('a2'))} as num_inter, len({_NUM('a1')}) as num1, len({_NUM('a2')}) as num2, (({_NUM('a1')})[1] = ({_NUM('a2')})[1])::bigint as num_first_eq from pairs""",
    "flag_features": f"""{_PAIRS} select q_id, (q_id[2] = '3')::bigint as src3, is_domain::bigint as q_is_domain, (a2 = '')::bigint as q_addr_empty, (n1 = n2)::bigint as n_exact, (a1 = a2)::bigint as a_exact, length(n1) as n1_len, length(n2) as n2_len,
length(a1) as a1_len, length(a2) as a2_len, {_native('n2')}::bigint as q_native_name, {_native('a2')}::bigint as q_native_addr, round(length(n1) / greatest(length(n2), 1), 6) as n_len_ratio, round(length(a1) / greatest(length(a2), 1), 6) as a_len_ratio from pairs""",
    "jaro_winkler": f"{_PAIRS} select q_id, round(jaro_winkler_similarity(a1, a2), 6) as a_jw from pairs",
    "house_number_relations": f"""{_PAIRS},
h as (select q_id, nullif(coalesce(({_WHOLE('a1')})[1], ''), '') as x, nullif(coalesce(({_WHOLE('a2')})[1], ''), '') as y from pairs)
select q_id, round(ln(1 + abs(x::double - y::double)), 6) as hn_diff, round(abs(ln(1 + x::double) - ln(1 + y::double)), 6) as hn_logdiff, (starts_with(x, y) or starts_with(y, x))::bigint as hn_prefix, (ends_with(x, y) or ends_with(y, x))::bigint as hn_suffix, length(x) - length(y) as hn_lendiff from h""",
    "vocab_features": f"""{_PAIRS},
df as (select country, w, count(*) as df from (select country, unnest(list_distinct(nt)) as w from ref) group by all),
e as (select q_id, df from (select q_id, country, unnest(list_distinct(list_filter(nt2, lambda t: not list_contains(nt1, t)))) as w from pairs) left join df using (country, w)),
g as (select q_id, round(min(ln(coalesce(df, 0) + 1)), 6) as v_min, round(max(ln(coalesce(df, 0) + 1)), 6) as v_max, count(*) filter (where df is null) as v_unknown, count(df) as v_known from e group by q_id)
select pairs.q_id, v_min, v_max, v_unknown, v_known from pairs left join g using (q_id)""",
    "cross_encoder_texts": f"{_PAIRS} select q_id, n1 || ' | ' || a1 as text1, n2 || ' | ' || a2 as text2 from pairs",
    "top2": f"{_S} select * from best",
    "query_context": f"""{_S} select q_id, s1_id, r - 1 as q_rank, count(*) over (partition by q_id) as q_ncand, round(p, 6) as p, round(sum(p) over (partition by q_id), 6) as q_psum,
round(coalesce(case when r = 1 then max(case when r = 2 then p end) over (partition by q_id) else max(p) over (partition by q_id) end, 0), 6) as q_pother from ranked""",
    "entity_context": f"{_S}, {_ENTITY} select q_id, s1_id, e_strong, e_strong_s2, e_strong_s3, e_mid, e_n, e_all_n, case when src3 = 1 then e_strong_s3 else e_strong_s2 end as e_same_src_strong, src3, e_sum, round(e_max, 6) as e_max, e_all_sum from ec",
    "context_features": f"""with {_SCORED.replace('ranked as (select *,', 'ranked0 as (select *,').replace('from ranked where', 'from ranked0 where')},
ranked as (select q_id, s1_id, p1 as p, 1 as r from best), {_ENTITY},
lk as (select s1_id2 as s1_id, sum(p2) as leak from best where s1_id2 is not null group by 1)
select ec.q_id, ec.s1_id, e_strong, e_mid, e_n, case when src3 = 1 then e_strong_s3 else e_strong_s2 end as n_src, e_sum, round(e_max, 6) as e_max, round(coalesce(leak, 0), 6) as leak, round(p1 - p2, 6) as gap
from ec join best using (q_id) left join lk on lk.s1_id = ec.s1_id""",
    "sibling_features": f"""{_SIBFEAT}
select q_id, s1_id, len(ad) as q_addr_rdiv, coalesce(ash, 0) as sib_addr_shared, coalesce(asm, 0) as sib_addr_shared_same, len(nd) as q_name_rdiv, coalesce(nsh, 0) as sib_name_shared
from dv left join sb using (q_id, s1_id)""",
    "stage2_context": f"""{_SIBCAND},
ranked as (
  select *, row_number() over (partition by q_id order by p desc, s1_id) as r
  from (select q_id, s1_id, p, 0 as sc_new from sc2 union all select q_id, s1_id, 0.0, 1 from found where (q_id, s1_id) not in (select (q_id, s1_id) from sc2))),
{_ENTITY},
{_SIBFEAT.split(_SIB + ",")[1].replace("from sr join", "from ranked sr join")},
vd as (select country, t, count(*) as df from (select country, unnest(list_distinct(nt)) as t from ref) group by all),
vu as (
  select q_id, s1_id, count(*) filter (where df is null) as v_unknown
  from (select x.q_id, x.s1_id, q.country, unnest(list_distinct(list_filter(q.nt, lambda t: not list_contains(e.nt, t)))) as t from ranked x join qry q on q.id = x.q_id join ref e on e.id = x.s1_id) left join vd using (country, t) group by all)
select ec.q_id, ec.s1_id, ranked.r - 1 as q_rank, e_n, e_strong, case when src3 = 1 then e_strong_s3 else e_strong_s2 end as e_same_src_strong, coalesce(sc_n, 0) as sc_n, sc_new,
  len(ad) as q_addr_rdiv, coalesce(ash, 0) as sib_addr_shared, coalesce(nsh, 0) as sib_name_shared, {_INTER(_NUM('e.addr_n'), _NUM('q.addr_n'))} as num_inter, v_unknown
from ec join ranked using (q_id, s1_id) join dv using (q_id, s1_id) join qry q on q.id = ec.q_id join ref e on e.id = ec.s1_id
  left join found using (q_id, s1_id) left join sb using (q_id, s1_id) left join vu using (q_id, s1_id)""",
    "validate_lists": f"""{_S},
ls as (select 'S1-' || s_suppkey as s1, s_suppkey as pos, coalesce(ids, '') as ids from supplier left join (select s1_id, string_agg(q_id, ',' order by q_id) as ids from best where p1 >= 0.95 group by 1) on s1_id = 'S1-' || s_suppkey),
bad as (
  select s1, case when pos % 7 = 0 then 'S2-1,S2-1,S1-5,X-2' else ids end as ids from ls where pos % 10 <> 3
  union all select s1, ids from ls where pos % 10 = 4 union all select 'S1-none', ids from ls where pos = 1),
ea as (select s1, unnest(string_split(ids, ',')) as id from bad where ids <> '')
select 'duplicate_row' as rule, s1 as id from bad group by s1 having count(*) > 1
union select 'duplicate_id', s1 from ea group by s1, id having count(*) > 1
union select 'blank_id', s1 from ea where trim(id) = ''
union select 'self_match', id from ea where starts_with(id, 'S1-')
union select 'wrong_prefix', id from ea where trim(id) <> '' and not regexp_matches(id, '^S[123]-')
union select 'missing_entity', s1 from ls where s1 not in (select s1 from bad)
union select 'extra_entity', s1 from bad where s1 not in (select s1 from ls)
union select 'quote', s1 from bad where contains(ids, '"')
union select 'matched_twice', id from ea group by id having count(distinct s1) > 1""",
    "sibling_candidates": f"{_SIBCAND} select q_id, s1_id, sc_n, sc_keys from found",
    "sibling_pairs_added": f"""{_SIBCAND}
select q_id, s1_id, round(p, 6) as p, coalesce(sc_n, 0) as sc_n, coalesce(sc_keys, 0) as sc_keys, 0::bigint as sc_new from sc2 left join found using (q_id, s1_id)
union all select q_id, s1_id, 0.0, sc_n, sc_keys, 1 from found where (q_id, s1_id) not in (select (q_id, s1_id) from sc2)""",
    "channel_llr_table": f"with {_EVENTS} select g, event, pos, neg, round(ln((pos + 1) / (ap + 1)) - ln((neg + 1) / (an + 1)), 6) as llr from cnt, ap where pos + neg >= 5",
    "channel_features": f"""with {_EVENTS},
l as (select g, event, ln((pos + 1) / (ap + 1)) - ln((neg + 1) / (an + 1)) as llr from cnt, ap where pos + neg >= 5)
select q_id, s1_id, round(coalesce(sum(llr) filter (where g = 'nop'), 0), 6) as nop_sum, round(min(llr) filter (where g = 'nop'), 6) as nop_min, round(coalesce(sum(llr) filter (where g = 'nins'), 0), 6) as nins_sum, round(min(llr) filter (where g = 'nins'), 6) as nins_min,
  count(*) filter (where g = 'nop') as nop_n, count(*) filter (where g = 'nins') as nins_n, count(*) filter (where g = 'nins' and llr is null) as nins_unknown, 0::bigint as adel_n
from ev left join l using (g, event) group by q_id, s1_id""",
    "validate_lines": """
with raw as (
  select s_suppkey as k, 'S1-' || s_suppkey || case when s_suppkey % 11 = 0 then ' ' else chr(9) end || case when s_suppkey % 7 = 0 then 'S2-1,S2-1,S1-5,X-2' when s_suppkey % 5 = 0 then '' else 'S3-' || s_suppkey || ',S2-' || s_suppkey end as value
  from supplier where s_suppkey % 10 <> 3
  union all select s_suppkey, 'S1-' || s_suppkey || chr(9) from supplier where s_suppkey % 10 = 4
  union all select s_suppkey, '' from supplier where s_suppkey % 25 = 0
  union all select s_suppkey, 'S1-none' || chr(9) || 'S2-9' from supplier where s_suppkey = 1),
ln as (select value, row_number() over (order by k, value) + 1 as line from raw),
rw as (select line, split_part(value, chr(9), 1) as s1, case when trim(split_part(value, chr(9), 2)) = '' then []::varchar[] else string_split(split_part(value, chr(9), 2), ',') end as ids from ln where contains(value, chr(9))),
each as (select distinct line, unnest(ids) as id from rw),
ent as (select 'S1-' || s_suppkey as id from supplier),
known as (select 'S2-' || s_suppkey as id from supplier where s_suppkey % 13 <> 0 union all select 'S3-' || s_suppkey from supplier)
select 'malformed_row' as rule, line, value as id from ln where not contains(value, chr(9)) and trim(value) <> ''
union all select 'duplicate_row', line, s1 from (select *, min(line) over (partition by s1) as f from rw) where line > f
union all select 'duplicate_id', line, s1 from rw where len(ids) > len(list_distinct(ids))
union all select 'self_match', line, id from each where id[1:3] = 'S1-'
union all select 'wrong_prefix', line, id from each where id[1:3] not in ('S1-', 'S2-', 'S3-')
union all select 'extra_entity', line, s1 from rw where s1 not in (select id from ent)
union all select 'missing_entity', -1, id from ent where id not in (select s1 from rw)
union all select 'unknown_id', line, id from each where id[1:3] in ('S2-', 'S3-') and id not in (select id from known)""",
    "stage2_model_rows": f"""with {_EVENTS},
x as (select *, {_bucket("q_id", 99, 2)} as half, {_bucket("q_id", 5, 4)} as sub from ev),
u as (select distinct g, event, q_id, s1_id, label, sub from x where half = 0),
pr as (select distinct q_id, s1_id, half, sub from x),
np as (select sub, count(*) filter (where l_quantity > 25) as kp, count(*) filter (where l_quantity <= 25) as kn from (select l_quantity, {_bucket("l_orderkey::varchar", 5, 4)} as sub, {_bucket("l_orderkey::varchar", 99, 2)} as half from lineitem) where half = 0 group by sub),
ks as (select unnest([-1, 0, 1, 2, 3]) as k),
ps as (select k, sum(kp) as ap, sum(kn) as an from ks join np on sub <> k group by k),
c as (select k, g, event, sum(label) as pos, sum(1 - label) as neg from ks join u on sub <> k group by all having count(*) >= 5),
l as (select k, g, event, ln((pos + 1) / (ap + 1)) - ln((neg + 1) / (an + 1)) as llr from c join ps using (k)),
j as (select x.*, llr from x left join l on l.g = x.g and l.event = x.event and k = case when half = 0 then sub else -1 end)
select pr.q_id, pr.s1_id, pr.half, pr.sub, {", ".join(f"round(coalesce(sum(llr) filter (where g = '{g}'), 0), 6) as {g}_sum, round(min(llr) filter (where g = '{g}'), 6) as {g}_min, count(*) filter (where g = '{g}') as {g}_n, count(*) filter (where g = '{g}' and llr is null) as {g}_unknown" for g in ("nop", "nins", "ndel", "aop", "ains", "adel"))}
from pr join j using (q_id, s1_id) group by pr.q_id, pr.s1_id, pr.half, pr.sub""",
    "channel_fold_tables": f"""with {_EVENTS},
u as (select distinct g, event, q_id, s1_id, label, fold from ev),
fs as (select null::bigint as fold union all select distinct fold::bigint from u),
ps as (select f.fold, count(*) filter (where l_quantity > 25) as ap, count(*) filter (where l_quantity <= 25) as an from fs f join lineitem on f.fold is null or l_orderkey % 5 <> f.fold group by f.fold),
c as (select f.fold, g, event, coalesce(sum(label) filter (where f.fold is null or u.fold <> f.fold), 0)::bigint as pos, coalesce(sum(1 - label) filter (where f.fold is null or u.fold <> f.fold), 0)::bigint as neg from fs f cross join u group by all)
select c.fold, g, event, pos, neg, round(ln((pos + 1) / (ap + 1)) - ln((neg + 1) / (an + 1)), 6) as llr from c join ps on c.fold is not distinct from ps.fold where pos + neg >= 5""",
    "accept_threshold": f"{_S} select q_id, s1_id, round(p1, 6) as p1, round(p2, 6) as p2 from best where p1 >= 0.7 and p1 - p2 >= 0.1",
    "entity_guard": f"{_S} select q_id, s1_id from best where p1 >= 0.6 and s1_id in (select s1_id from best where p1 >= 0.97)",
    "stage2_decision": f"{_S} select q_id, round(p1, 6) as r from best where p1 >= 0.85",
    "assemble_lists": f"""{_S} select 'S1-' || s_suppkey as source1_entity_id, coalesce((select string_agg(q_id, ',' order by q_id) from best where p1 >= 0.95 and s1_id = 'S1-' || s_suppkey), '') as matched_entity_ids, s_suppkey as pos from supplier""",
    "candidate_lists": f"""{_S}, l as (select s1_id, string_agg(q_id, ',' order by q_id) as ids from scored where p >= 0.9 group by s1_id)
select 'S1-' || s_suppkey as source1_entity_id, coalesce(ids, '') as candidate_entity_ids from supplier left join l on s1_id = 'S1-' || s_suppkey""",
    "macro_f05": f"{_EF} select {_FM} from f",
    "macro_f05_by_country": f"{_EF} select country, {_FM} from f group by rollup (country)",
    "threshold_grid": f"{_GRID} select threshold, gap, n_pred, tp, n_true, precision, recall, f05 from scores",
    "tuned_halves": f"""{_S}, {_TRUTH},
grid as (select * from (values (0.5), (0.7), (0.9)) a(threshold), (values (0.0), (0.2)) b(gap), (values (0.0), (0.95)) c(guard)),
acc as (select threshold, gap, guard, s1_id, q_id, p1 from best cross join grid where p1 >= threshold and p1 - p2 >= gap),
ok as (select threshold, gap, guard, s1_id, count(*) as n_pred, count(*) filter (where (s1_id, q_id) in (select (s1, other) from truth)) as tp from acc group by all having max(p1) >= guard),
en as (
  select 'S1-' || s_suppkey as s1, coalesce(n, 0) as n_true, {_bucket("'S1-' || s_suppkey", 99, 2)} as half from supplier left join (select s1, count(*) as n from truth group by 1) t on t.s1 = 'S1-' || s_suppkey),
sc as (
  select g.threshold, g.gap, g.guard, half, case when n_true = 0 then (coalesce(n_pred, 0) = 0)::int::double when coalesce(tp, 0) = 0 then 0.0 else 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) end as f
  from en cross join grid g left join ok on ok.s1_id = en.s1 and ok.threshold = g.threshold and ok.gap = g.gap and ok.guard = g.guard)
select threshold::double as threshold, gap::double as gap, guard::double as guard, half, round(avg(f), 6) as f05 from sc group by all""",
    "reader_rows": f"{_P} select id from rec where {_bucket('coalesce(owner, id)', 77, 3)} = 0 and {_bucket('coalesce(owner, id)', 99, 2)} = 0",
    "best_threshold": f"{_GRID} select threshold, gap, f05 from scores order by f05 desc, threshold, gap limit 1",
    "run_diagnostics": f"""{_S},
e as (select 'S1-' || s_suppkey as s1_id, s_nationkey::varchar as country from supplier),
b as (select country, count(*) as queries, round(avg((p1 >= 0.8)::int), 6) as accepted, round(avg((p1 >= 0.9)::int), 6) as sure from best join e using (s1_id) group by 1)
select e.country, any_value(queries) as queries, any_value(accepted) as accepted, any_value(sure) as sure, round(avg((e.s1_id not in (select s1_id from best where p1 >= 0.8))::int), 6) as empty_lists from e left join b using (country) group by 1""",
    "group_folds": f"{_P} select id, {_bucket('coalesce(owner, id)', 13, 5)} as fold from rec",
    "exact_sample": f"{_P} select id from rec order by md5(id || ':3'), id limit 100",
    "world_split": f"""{_P},
e as (select id, country, case when {_bucket('id', 21, 2)} = 0 then 'A' else 'B' end as world, 'entity' as kind from ref),
o as (select q.id, q.country, e.world, 'owned' as kind from qry q join e on e.id = q.owner),
f as (select id, country, case when {_bucket('id', 21, 2)} = 0 then 'A' else 'B' end as world from qry where owner is null),
fr as (select *, row_number() over (partition by world, country order by md5(id || ':22'), id) as r from f)
select * from e union all select * from o
union all select fr.id, fr.country, fr.world, 'orphan' from fr join (select world, country, count(*) as n from e group by all) n using (world, country) left join (select world, country, count(*) as k from o group by all) t using (world, country) where r <= 1.7 * n - coalesce(k, 0)""",
    "training_halves": f"""{_S}, o as (select q_id, s1_id as grp from ranked where r = 1)
select q_id, s1_id, {_bucket('grp', 99, 2)} as half, {_bucket('grp', 5, 4)} as sub from ranked join o using (q_id)""",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}
