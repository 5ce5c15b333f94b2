"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

OP2 = """with b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark),
d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents),
bi as (select item_id, w, len(w) as n, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [array_to_string(w, ' ') || ' .'] end as s from b where len(w) > 0),
di as (select doc_id, w, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [array_to_string(w, ' ') || ' .'] end as s from d where len(w) > 0),
sizes as (select distinct n, unnest(s) as g from bi), dp as (select doc_id, unnest(s) as g, unnest(range(0, len(s))) as p from di),
-- every window of n words that holds a shingle of an item of n words; the similarity of all others is 0
starts as (select distinct doc_id, n, unnest(range(p - greatest(n - 5, 0), p + 1)) as start from dp join sizes using (g)),
wd as (select doc_id, start, n, list_slice(w, greatest(start, 0) + 1, start + n) as v from starts join di using (doc_id)),
ws as (select doc_id, start, n, len(v) as words, case when len(v) >= 5 then list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' ')) else [array_to_string(v, ' ') || ' .'] end as s from wd where len(v) > 0),
wg as (select doc_id, start, n, g, count(*) as x from (select doc_id, start, n, unnest(s) as g from ws) group by all),
bg as (select item_id, n, g, count(*) as y from (select item_id, n, unnest(s) as g from bi) group by all),
c as (select doc_id, start, n, item_id, sum(least(x, y)) as common from wg join bg using (n, g) group by all),
sim as (select c.doc_id, c.item_id, c.start, words, common::double / (len(ws.s) + len(bi.s) - common) as similarity from c join ws using (doc_id, start, n) join bi on bi.item_id = c.item_id)
select doc_id, item_id, similarity, greatest(start, 0)::int as start_word, words::int as n_words from sim where similarity >= 0.8 qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1"""

OP4 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) as i from d)),
m as (select s, min(doc_id) as f from w group by s),
hit as (select w.doc_id, i from w join m using (s) where f < w.doc_id),
cut as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from hit),
num as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from cut),
runs as (select doc_id, run, min(i) as a, max(i) + 50 as b from num group by 1, 2),
seg as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as p from runs),
agg as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) as head from seg join d using (doc_id) group by 1)
select d.doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join agg using (doc_id)"""

OP8 = f"""with recursive d as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as g from d),
e as (select doc_id, len(g) as n, unnest(g) as g from s),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
l as (select a, b from p where 100 * c >= 80 * (na + nb - c) union select b, a from p where 100 * c >= 80 * (na + nb - c)),
r(node, root) as (select doc_id, doc_id from s union select l.b, r.root from r join l on l.a = r.node where r.root < l.b),
c as (select node, min(root) as component_id from r group by 1)
select doc_id, len(g)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c on c.node = s.doc_id"""

OP10 = f"""with d as (select doc_id, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w from documents),
tri as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)),
rep as (select doc_id, i from tri qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, count(distinct i + k) as n from rep, range(3) t(k) group by 1),
lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as ls from d),
m as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(ls)::bigint as n_lines,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(regexp_extract_all(t, '\\p{{Lu}}'))::bigint as n_upper from d join lines using (doc_id) left join cov using (doc_id)),
f as (select *, (n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (100 * n_symbols > 10 * n_words)::int + 8 * (100 * n_dup_lines > 50 * n_lines)::int
  + 16 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::int + 32 * (100 * n_upper > 60 * word_chars)::int as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits from f"""

OP11 = """with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d)),
k as (select key, max(doc_id) as last from l where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select l.*, coalesce(l.doc_id < k.last, false) as gone from l left join k using (key))
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from (
  select r, any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from m group by r)"""

OP12 = """with crc as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) x(i))),
o as (select conv_id, coalesce(text, '') as x, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as s, turn from conversations where conv_id is not null),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, s) as place from o),
c as (select conv_id, conv_id - conv_id % 5 as base, count(*) as own from o group by 1),
h as (select c.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda z: ascii(z)::bigint)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 9 as h from c, crc),
k as (select h.*, least(h.h, coalesce(b.own, 0)) as taken from h left join c b on b.conv_id = h.base),
r as (select k.conv_id, place as depth, s, x from k join p on p.conv_id = k.base where place <= h union all select k.conv_id, place - h + taken, s, x from k join p on p.conv_id = k.conv_id where place > h),
m as (select conv_id, depth, string_agg(s, '') over (partition by conv_id order by depth) as key, strlen(x) as bytes from r union all select conv_id, 0, '', 0 from c),
v as (select depth, key, min(conv_id) as conv_id, count(*) as n, any_value(bytes) as bytes from m group by 1, 2),
kids as (select depth - 1 as depth, left(key, (64 * depth - 64)::bigint) as key, count(*) as n from v where depth > 0 group by 1, 2),
w as (select v.*, coalesce(kids.n, 0) as n_children from v left join kids using (depth, key)),
sub as (select a as depth, left(key, (64 * a)::bigint) as key, sum((n - 1) * bytes) as saved, count(*) filter (n_children = 0) as leaves from (select *, unnest(range(depth + 1)) as a from w) group by 1, 2),
e as (select depth, key, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select * from m qualify depth = max(depth) over (partition by conv_id)) group by 1, 2)
select w.conv_id, w.depth::bigint as depth, up.conv_id as parent_conv_id, w.n as n_convs, w.n_children, sub.leaves as n_leaves, sub.saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from w join sub using (depth, key) left join v up on up.depth = w.depth - 1 and up.key = left(w.key, (64 * w.depth - 64)::bigint) left join e on e.depth = w.depth and e.key = w.key"""

OP13 = """with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
h as (select doc_id, t, u, len(u) as n, [('0x' || s[i:i + 7])::bigint for i in [1, 9, 17, 25]] as h from d),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b, t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 as plain from h),
x as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf, case when plain then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from c)
select doc_id, n::bigint as n, form, case when not plain then length(pre) end as prefix_chars, case when not plain then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from x"""

ORACLES = {
    "op2_decontamination": OP2, "op4_suffix_dedup": OP4, "op8_minhash_near_dup": OP8, "op10_quality_rules": OP10,
    "op11_line_dedup": OP11, "op12_prefix_trie": OP12, "op13_fill_middle": OP13,
}
