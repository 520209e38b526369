"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .linededup import WORDS_PER_EDIT
from .urltrust import DAMPING, EVIDENCE, RULES

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAP}'), lambda x: x <> '')"

OP1 = f"""
with b as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s
        from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0) z),
sizes as (select distinct n from win),
d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
p as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n) z),
hit as (select distinct rid, p.n, i, item_id from p join win on p.s = win.s and p.n = win.n),
places as (select rid, count(distinct k) as n_hit from (select distinct rid, unnest(range(i, i + n)) as k from hit) z group by rid),
items as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hit group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (rid) left join items using (rid)
"""

_BITS = "list_aggregate(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: right('000' || bin(('0x' || c)::int), 4)), 'string_agg', '')"
_BASE32 = f"list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: substr(bits, i*5 + k + 1, 1)::int * (16 >> k)))::int, 1)), 'string_agg', '')"

OP2 = f"""
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, {_BITS} as bits, max(page_id) over (partition by coalesce(html, '')) as top from pages)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from p
"""

OP9 = f"""
with l as (select doc_id, n, line, list_filter(regexp_split_to_array(line, '[ \\t\\r\\x0B\\x0C]+'), lambda x: x <> '') as w, regexp_matches(line, '[0-9A-Za-z]|[^\\x00-\\x7F]') as says
      from (select doc_id, generate_subscripts(ls, 1) as n, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents) y) z),
f as (select w, min((doc_id, n)) as place from l where says group by w),
k as (select w, place, w[1:(len(w) - less)//2] as h, w[len(w) + 1 - (len(w) - less) + (len(w) - less)//2:] as t, len(w) - less as c from f, (values (0), (1)) v(less) where len(w) - less >= {WORDS_PER_EDIT}),
pairs as (select a.w, b.w as y from k a join k b on a.c = b.c and a.h = b.h and b.place < a.place and a.w <> b.w union select a.w, b.w from k a join k b on a.c = b.c and a.t = b.t and b.place < a.place and a.w <> b.w),
sided as (select w, case when len(w) >= len(y) then w else y end as p, case when len(w) >= len(y) then y else w end as q from pairs where abs(len(w) - len(y)) <= 1),
near as (select distinct w from sided where len(list_filter(range(0, len(p)), lambda i: p[1:i] = q[1:i] and p[i + 2:] = q[i + 2 - (len(p) - len(q)):])) > 0),
kept as (select l.doc_id, l.n, l.line, not l.says or ((l.doc_id, l.n) = f.place and near.w is null) as stays from l left join f on l.says and l.w = f.w left join near on l.says and l.w = near.w)
select doc_id, coalesce(string_agg(case when stays then line end, chr(10) order by n), '') as text, count(*) as n_lines, count(*) filter (where not stays) as n_dropped from kept group by doc_id
union all select doc_id, null, 0, 0 from documents where text is null
"""

_REST = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")


def _chosen(what: int) -> str:
    """CASE over the rules, the longest first: the rule's text (1) or verdict (0)."""
    order = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    rows = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(v, h + p)[what]}'" for v, h, p in order]
    return f"case {' '.join(rows)} end"


_RULED = [
    f"u as (select page_id, html, {_REST} as rest from pages)",
    f"q as (select page_id, html, {_HOST} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u)",
    f"r as (select page_id, html, host, path, {_chosen(1)} as rule, {_chosen(0)} as ruled from q)",
    "s as (select host, count(*) as pages, sum(case when ruled = 'allow' then 1 else 0 end)::double as a, sum(case when ruled = 'block' then 1 else 0 end)::double as b from r where host <> '' group by host)",
]


def _ranks(rounds: int) -> list[str]:
    """Tables of personalised PageRank over e (src, dst, n) from seeds s, and f with the verdicts."""
    ctes = [
        "w as materialized (select src, dst, n/sum(n) over (partition by src) as wt, n/sum(n) over (partition by dst) as wd from e)",
        "h as materialized (select host, coalesce(a, 0) as st, coalesce(b, 0) as sd, host not in (select src from e) as sink, host not in (select dst from e) as source from (select host from s union select src from e union select dst from e) z left join s using (host))",
        "mass as (select greatest(sum(st), 1e-300) as mt, greatest(sum(sd), 1e-300) as md from h)",
        "r0 as materialized (select host, st as t, sd as d from h)",
    ]
    for k in range(rounds):
        ctes.append(f"g{k} as (select host, sum(t) as t, sum(d) as d from (select dst as host, wt*t as t, 0 as d from w join r{k} on src = host union all select src, 0, wd*d from w join r{k} on dst = host) z group by host)")
        ctes.append(f"x{k} as (select coalesce(sum(case when sink then t end), 0) as t, coalesce(sum(case when source then d end), 0) as d from h join r{k} using (host))")
        ctes.append(
            f"r{k + 1} as materialized (select host, st*({1 - DAMPING!r} + {DAMPING}*x{k}.t/mt) + {DAMPING}*coalesce(g{k}.t, 0) as t, sd*({1 - DAMPING!r} + {DAMPING}*x{k}.d/md) + {DAMPING}*coalesce(g{k}.d, 0) as d from h cross join mass cross join x{k} left join g{k} using (host))"
        )
    return [*ctes, f"f as (select host, t, d, d > t and d >= {EVIDENCE}*pages as bad from r{rounds} join s using (host))"]


def _op10() -> str:
    links = [
        """x as (select host as src, unnest(regexp_split_to_array(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?\\s*(?:https?:)?//')[2:]) as x from r)""",
        f"""y as (select src, {_LOWER.format("""regexp_extract(x, '^([^/?#"''<>\\s]*)', 1)""")} as dst from x)""",
        "e as (select src, dst, count(*) as n from y where src <> '' and dst <> '' and src <> dst group by src, dst)",
    ]
    verdict = "coalesce(ruled, case when bad then 'block' else 'allow' end)"
    return f"with {', '.join([*_RULED, *links, *_ranks(40)])} select page_id, r.host, path, rule, {verdict} as verdict from r left join f on r.host = f.host"


def _derived() -> str:
    links = ["e as (select a.host as src, b.host as dst, count(*) as n from (select host, unnest([3*page_id + 1, page_id//2]) as o from r where host <> '') a join r b on b.page_id = a.o and b.host <> '' and a.host <> b.host group by a.host, b.host)"]
    return f"with {', '.join([*_RULED, *links, *_ranks(90)])} select host, case when bad then 'block' else 'allow' end as verdict, round(t, 3) as trust, round(d, 3) as distrust from f"


ORACLE_SQL = {"op1_decontamination": OP1, "op2_warc": OP2, "op9_line_dedup": OP9, "op10_url_trust": _op10(), "host_trust_derived_links": _derived()}
