"""The text operators' results as SQL for DuckDB, where SQL can express them at a bearable cost."""

from __future__ import annotations

from tidemark.llm import url_filter as U

COMPONENTS = """, reach(id, other) as (select id, id from ids union select r.id, e.b from reach r join edges e on r.other = e.a),
comp as (select id, min(other) as component from reach group by 1)"""


def url_filter(rules: list[tuple[str, str]]) -> str:
    fits, verdicts = [], []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, p = U.split_rule(rule)
        fits.append(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{rule}'")
        verdicts.append(f"when rule = '{rule}' then '{verdict}'")
    seg = "list_filter(string_split(path, '/'), lambda s: s <> '')"
    pick = [f"shape({seg}[{k + 1}])" for k in range(U.LEVELS)]
    keys = ", ".join(f"s{k}" for k in range(U.LEVELS))
    out = f"""with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '\\A[^/?#]*') as raw, rest from u),
q as (select page_id, translate(raw, '{U.UPPER}', '{U.LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '\\A[^?#]*') as path from h),
m as (select *, case {' '.join(fits)} end as rule from q), v as (select *, case {' '.join(verdicts)} end as ruled from m),
d as (select *, case ruled when 'block' then 1 when 'allow' then 0 end as bad, {', '.join(f'{x} as s{k}' for k, x in enumerate(pick))}, len({seg}) > {U.LEVELS} as deep from v),
t as (select host, {keys}, deep, count(*) as n, sum((bad is not null)::int) as l, sum(coalesce(bad, 0)) as b from d group by all),
w as (select coalesce(sum(l), 0) as al, coalesce(sum(b), 0) as ab from t), hp as (select host, (sum(b) + {U.SMOOTHING} * ((any_value(ab) + 1.0::double) / (any_value(al) + 2.0::double))) / (sum(l) + {U.SMOOTHING}) as p from t, w group by 1),
l0 as (select t.*, hp.p::double as p, '' as node from t join hp using (host))"""
    for k in range(U.LEVELS):
        out += f""",
k{k} as (select host, node, s{k} as seg, sum(n) as n, sum(l) as l, sum(b) as b, any_value(p) as up from l{k} where s{k} is not null group by 1, 2, 3),
a{k} as (select host, node, count(*) as kids, sum(l) as pl, sum(b) as pb from k{k} group by 1, 2),
c{k} as (select x.*, case when x.l > 0 and pl - x.l > 0 and pb > 0 and pb < pl and abs(x.b::double / x.l - (pb - x.b)::double / (pl - x.l)) > {U.SIGNIFICANT} * sqrt((pb::double / pl) * (1 - pb::double / pl) * (1.0::double / x.l + 1.0::double / (pl - x.l))) and not (kids > {U.WIDE} and x.n < {U.SUPPORT}) then seg else '*' end as child from k{k} x join a{k} using (host, node)),
b{k} as (select host, node, child, (sum(b) + {U.SMOOTHING} * any_value(up)) / (sum(l) + {U.SMOOTHING}) as new from c{k} group by 1, 2, 3),
l{k + 1} as (select x.host, {', '.join(f'x.s{j}' for j in range(U.LEVELS))}, x.deep, x.n, x.l, x.b, coalesce(y.new, x.p)::double as p, case when c.child is null then x.node else x.node || '/' || c.child end as node from l{k} x left join c{k} c on x.host = c.host and x.node = c.node and x.s{k} = c.seg left join b{k} y on c.host = y.host and c.node = y.node and c.child = y.child)"""
    same = " and ".join(f"d.s{k} is not distinct from z.s{k}" for k in range(U.LEVELS))
    out += f"""
select d.page_id, d.host, d.path, d.rule, coalesce(d.ruled, case when z.p >= {U.LIMIT} then 'block' else 'allow' end) as verdict, z.node || case when d.deep then '/**' else '' end as template, round(z.p, 9) as purity from d join l{U.LEVELS} z on d.host = z.host and d.deep = z.deep and {same}"""
    stem, end = (f"regexp_extract(shape_arg, '\\A(.*?)(\\.[A-Za-z]{{1,5}})?\\z', {g})" for g in (1, 2))
    kind = f"(case when shape_arg is null then null else (case when regexp_matches({stem}, '\\A[0-9]+\\z') then '<n>' when regexp_matches({stem}, '\\A[0-9a-fA-F-]{{8,}}\\z') and regexp_matches({stem}, '[0-9]') then '<h>' else {stem} end) || {end} end)"
    for k in range(U.LEVELS):
        out = out.replace(pick[k], kind.replace("shape_arg", f"{seg}[{k + 1}]"))
    return out


EARLIER_WORDS = """with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, unnest(generate_series(1, len(w) - 19)) as s, w from d), x as (select doc_id, s, list_aggregate(w[s : s + 19], 'string_agg', ' ') as g from p),
f as (select doc_id, s, row_number() over (partition by g order by doc_id, s) as r from x), gone as (select distinct doc_id, unnest(generate_series(s, s + 19)) as i from f where r > 1),
e as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as i from d), k as (select e.doc_id, e.i, e.word, g.i is null as keep from e left join gone g on e.doc_id = g.doc_id and e.i = g.i),
n as (select doc_id, count(*) as n_words, sum((not keep)::int)::bigint as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (keep), '')) as kept_sha256 from k group by 1)
select d.doc_id, coalesce(n.n_words, 0) as n_words, coalesce(n.n_removed, 0) as n_removed, coalesce(n.kept_sha256, sha256('')) as kept_sha256 from d left join n using (doc_id)"""

JACCARD = f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{U.UPPER}', '{U.LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as s from d),
r as (select doc_id, len(s)::bigint as n, unnest(s) as x from g), o as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from r a join r b on a.x = b.x and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by 1, 2),
edges as (select a, b from o where 100 * c >= 90 * (na + nb - c)), ids as (select doc_id as id from g){COMPONENTS}
select g.doc_id, len(g.s)::bigint as n_shingles, c.component as component_id from g join comp c on g.doc_id = c.id"""

EMBEDDINGS = f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
ok as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
edges as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95), ids as (select vec_id as id from v){COMPONENTS},
k as (select a, count(*) as n from edges group by 1)
select v.vec_id, coalesce(k.n, 0) as n_links, c.component as component_id, v.vec_id = c.component as kept from v join comp c on v.vec_id = c.id left join k on v.vec_id = k.a"""
