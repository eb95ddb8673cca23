"""DuckDB SQL for the queries of this package that SQL can express."""

from . import quality

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORD = r"[^\x20\x09-\x0D]+"

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') as w from documents),
b as (select item_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') as w from benchmark),
win as (select distinct item_id, list_slice(w, i, i + 9) as g
        from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct len(g) as n from win),
spots as (select rid, n, i, list_slice(w, i, i + n - 1) as g
       from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select spots.rid, spots.i, spots.n, win.item_id from spots join win on spots.g = win.g),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from m) group by rid),
k as (select rid, count(item) as n_items, string_agg(item, ',' order by item) as ids
      from (select distinct rid, cast(item_id as varchar) as item from m) group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(k.n_items, 0)::bigint as n_items,
       sha256(coalesce(k.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join h on h.rid = d.rid left join k on k.rid = d.rid
"""

OP2 = r"""
with d as (select row_number() over (order by doc_id) as rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) as l from documents),
u as (select rid, doc_id, unnest(l) as x, unnest(range(len(l))) as p from d),
n as (select *, strlen(x) as n, row_number() over (partition by rid order by p) as i,
        sum(strlen(x)) over (partition by rid order by p) as upto,
        sum(strlen(x)) over (partition by rid order by p) - strlen(x) as before
      from u where regexp_matches(x, '[^\x20\x09-\x0D]')),
w as (select rid, i as lo, count(*) over f as c, sum(n) over f as total, string_agg(x, chr(10)) over f as g
      from n window f as (partition by rid order by before range between current row and 199 following)
      union all
      select rid, i - count(*) over f + 1 as lo, count(*) over f as c, sum(n) over f as total, string_agg(x, chr(10) order by p) over f as g
      from n window f as (partition by rid order by -upto range between current row and 199 following)),
k as (select *, row_number() over (partition by g order by rid, lo) as turn, min(rid * 1000000 + lo) over (partition by g) as first
      from (select distinct rid, lo, c, g from w where total >= 200)),
gone as (select distinct rid, unnest(range(lo, lo + c)) as i from k where rid * 1000000 + lo > first),
lost as (select n.rid, n.p from n join gone on gone.rid = n.rid and gone.i = n.i),
kept as (select u.rid, string_agg(u.x, chr(10) order by u.p) as text from u anti join lost on lost.rid = u.rid and lost.p = u.p group by u.rid),
cnt as (select rid, count(*) as k from lost group by rid),
len as (select rid, count(*) as k from n group by rid)
select d.doc_id, case when d.text is null then null else coalesce(kept.text, '') end as text,
       coalesce(len.k, 0)::bigint as n_lines, coalesce(cnt.k, 0)::bigint as n_deleted
from d left join kept on kept.rid = d.rid left join cnt on cnt.rid = d.rid left join len on len.rid = d.rid
"""


def _classes() -> str:
    """Characters of each class, counted; DuckDB's RE2 knows the same classes."""
    each = [f"length(regexp_replace(t, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in quality.CLASSES]
    return ", ".join([*each, "length(t) - length(array_to_string(w, ''))"])


def _jsd(a: str, b: str) -> str:
    return f"sum(case when {a} > 0 then {a} * log2({a} / (({a} + {b}) / 2)) else 0 end / 2 + case when {b} > 0 then {b} * log2({b} / (({a} + {b}) / 2)) else 0 end / 2)"


def op5() -> str:
    words = ", ".join(f"'{w}'" for w in quality.VOCABULARY)
    symbols = ", ".join(f"'{w}'" for w in quality.SYMBOLS)
    langs = ", ".join(f"'{x}'" for x in sorted(quality.COMMON))
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from (select rid, i, count(*) over (partition by rid, g) as k from g) where k > 1) group by rid),
l as (select rid, count(*) - count(distinct x) as n from (select rid, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by rid),
c as (select rid, [{_classes()}] as h, length(t) as n from d),
hc as (select rid, 'c' || i as bin, v as n, 'c' as part from (select rid, unnest(h) as v, unnest(range({len(quality.CLASSES) + 1})) as i from c)
       union all select rid, 'c_' as bin, n - list_sum(h) as n, 'c' as part from c),
hits as (select rid, case when x in ({symbols}) then ' ' else x end as x from (select rid, rtrim(lower(x), '.,;:?!') as x from (select rid, unnest(w) as x from d))),
hw as (select d.rid, v.v as bin, coalesce(k.n, 0) as n, 'w' as part from d cross join (select unnest([{words}, ' ']) as v) v
         left join (select rid, x, count(*) as n from hits where x in ({words}, ' ') group by rid, x) k on k.rid = d.rid and k.x = v.v
       union all select d.rid, '_' as bin, len(d.w) - coalesce(k.n, 0) as n, 'w' as part from d
         left join (select rid, count(*) as n from hits where x in ({words}, ' ') group by rid) k on k.rid = d.rid),
h as (select * from hc union all select * from hw),
p as (select rid, part, bin, n / nullif(sum(n) over (partition by rid, part), 0) as p from h),
q as (select lang, part, bin, n / sum(n) over (partition by lang, part) as q from
       (select d.lang, h.part, h.bin, sum(h.n)::double as n from h join d on d.rid = h.rid
        where (h.part = 'c' or d.lang in ({langs})) and d.lang in (select lang from d where lang is not null group by lang
          having sum(length(t)) > 0 and sum(length(t)) >= {quality.MIN_SHARE} * (select sum(length(t)) from d where lang is not null)) group by all)),
j as (select p.rid, p.part, q.lang, {_jsd("p.p", "q.q")} as j from p join q on q.part = p.part and q.bin = p.bin group by all),
m as (select rid, min(j) filter (part = 'c') as jc, min(j) filter (part = 'w') as jw from j group by rid),
b as (select d.doc_id, d.lang, len(d.w)::bigint as n_words, length(array_to_string(d.w, ''))::bigint as word_chars,
        length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, m.jc, m.jw
      from d left join l on l.rid = d.rid left join r on r.rid = d.rid left join m on m.rid = d.rid),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and ((lang is not null and lang not in (select lang from q where part = 'c')) or coalesce(sqrt(greatest(jc, 0)) <= sqrt({quality.MAX_CHAR_DIVERGENCE}), true))
         and (lang is null or lang not in (select lang from q where part = 'w') or coalesce(sqrt(greatest(jw, 0)) <= sqrt({quality.MAX_WORD_DIVERGENCE} + {quality.WORD_SLACK} / n_words), true)) as kept
from f
"""

OP7 = """
with p as (select page_id, url, strpos(url, '://') as mark from pages),
r as (select page_id, case when mark > 0 then substr(url, mark + 3) end as rest from p),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from r),
rules(rule, host, path, verdict) as (values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
f as (select h.page_id, rules.rule, rules.verdict, row_number() over (partition by h.page_id order by length(rules.rule) desc) as n
      from h join rules on (h.host = rules.host or suffix(h.host, '.' || rules.host)) and prefix(h.path, rules.path))
select h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') as verdict from h left join f on f.page_id = h.page_id and f.n = 1
"""

OP10 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e as (select *, 12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 1
                + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11 as size from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(size)::bigint as formatted_chars
from e group by conv_id
"""
