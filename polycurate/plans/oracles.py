"""DuckDB SQL for the queries of the catalog. RE2 spellings stand where Spark has Java's; the patterns in them are fixed values."""

from __future__ import annotations

from ..functions.scripts import letter_ranges
from ..sources.io import MISSING

#: Texts in scripts that the driver's tables lack; their ids are -1, -2 and so on.
SCRIPT_TEXTS = ("Здоровье важно", "الصحة مهمة", "Η υγεία είναι", "健康很重要", "ጤና አስፈላጊ ነው", "स्वास्थ्य", "건강은 중요", "abcде", "abcdде", "12 34", "")

BLANK = "regexp_replace({0}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"
QA = f"""qa as (
  select * from (
    select doc_id as id, doc_id as ord, substr(text, 1, instr(text, chr(10)) - 1) as input, substr(text, instr(text, chr(10)) + 1) as output, lang as subset, source
    from documents where instr(text, chr(10)) > 0)
  where {BLANK.format('input')} <> '' and {BLANK.format('output')} <> '')"""
TOKENS = "regexp_extract_all({0}, '[^\\s\\x0b]+')"
GRAMS = "list_transform(range(1, greatest(len({0}) - 2, 2)), lambda i: array_to_string(list_slice({0}, i, i + 3), chr(1)))"
METRICS = f"""{QA}, tok as (select *, {TOKENS.format('input')} as qt, {TOKENS.format('output')} as att from qa),
m as (select *, len(qt) as q_tokens, len(att) as a_tokens,
  case when len(att) <= 4 then 0.0 else 1.0 - len(list_distinct({GRAMS.format('att')}))::double / len({GRAMS.format('att')}) end as a_repetition,
  len(regexp_extract_all(output, '\\p{{Latin}}'))::double / nullif(len(regexp_extract_all(output, '\\p{{L}}')), 0) as a_share,
  len(regexp_extract_all(input, '\\p{{Latin}}'))::double / nullif(len(regexp_extract_all(input, '\\p{{L}}')), 0) as q_share from tok),
d as (select *, coalesce(q_share >= 0.6, false) as q_script_ok, coalesce(a_share >= 0.6, false) as a_script_ok from m)"""
DIAGNOSTIC = f"""{METRICS},
cosines as (select a.vec_id as id, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double * b.embedding[i]::double)) as qa_cos
  from embeddings a join embeddings b on b.vec_id = (a.vec_id + 1) % (select count(*) from embeddings)),
g as (select d.*, ord % 7 <> 0 and (ord % 10) / 10.0 + 0.1 >= 0.5 as q_lang_ok, ord % 5 <> 0 and (ord % 8) / 8.0 + 0.3 >= 0.5 as a_lang_ok, l.toxic::double as tox, c.qa_cos from d left join labels l on l.doc_id = d.id left join cosines c on c.id = d.id)"""
REASON = """case when q_tokens < 3 then 'Q < 3 tokens' when a_tokens < 5 then 'A < 5 tokens' when a_tokens > 400 then 'A > 400 tokens'
  when a_repetition > 0.5 then 'A repetition > 0.5' when not a_script_ok then '[' || subset || '] answer script mismatch' end"""
DRAW = "md5('{seed}|' || {key}::varchar)"
SHINGLES = "case when t = '' then [] when length(t) < 5 then [t] else list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) end"
FIRST_LINES = f"{QA}, low as (select *, {BLANK.format(chr(39).join(['regexp_replace(lower(input), ', '[\\s\\x0b]+', ', ', ' ', ', ', 'g', ')']))} as t from qa), sh as (select *, {SHINGLES} as s from low)"
SHINGLED = FIRST_LINES.removeprefix(f"{QA}, ")
PREDICTIONS = f"""{QA}, w as (select id, subset, input, output as reference, {TOKENS.format('output')} as words from qa),
p as (select id, subset, input, reference, array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: i % 5 <> 0), lambda i: words[i]), ' ') as prediction from w)"""
ROUGE_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
#: Longest common subsequences of t(id, subset, a, b), by the bit-parallel recurrence: 62 tokens of a to a number, one step for each token of b.
#: A row v begins with all bits set; with m, the places in a of the token, it becomes (v + (v & m)) | (v & ~m). Its zeros in the end are the length.
SUBSEQUENCES = """
      places as (select id, tok, list(pos order by pos) as ps from (select id, unnest(a) as tok, unnest(range(len(a))) as pos from t) group by 1, 2),
      masks as (select places.id, tok, list_transform(range((len(a) + 61) // 62), lambda k: list_sum(list_transform(list_filter(ps, lambda x: x // 62 = k), lambda x: 1::bigint << (x % 62)::int)::hugeint[])) as m from places join t using (id)),
      steps as (select id, list(list_transform(m, lambda x: coalesce(x, 0)::bigint) order by pos) as ms from (select id, unnest(b) as tok, unnest(range(len(b))) as pos from t) join masks using (id, tok) group by 1),
      rows as (select id, list_reduce(list_prepend(list_transform(range((len(a) + 61) // 62), lambda k: 4611686018427387903), ms), lambda v, m: list_slice(
        list_reduce(list_prepend([0::bigint], list_transform(range(1, len(v) + 1), lambda i: [v[i], m[i]])), lambda done, vm: list_append(
          [(vm[1] + (vm[1] & vm[2]) + done[1]) >> 62] || done[2:], ((vm[1] + (vm[1] & vm[2]) + done[1]) & 4611686018427387903) | (vm[1] - (vm[1] & vm[2])))), 2, len(v) + 1)) as v from t join steps using (id)),
      lcs as (select subset, len(a) as n_a, len(b) as n_b, coalesce((((len(a) + 61) // 62) * 62 - list_sum(list_transform(v, lambda x: bit_count(x)))), 0) as lcs from t left join rows using (id))"""
SCRIPT_PRESENT = "case when tag = 'Amh_Eth' then regexp_matches({0}, '[\\x{{1200}}-\\x{{137F}}]') when tag in ('Aka_Gha', 'Lug_Uga', 'Swa_Eas', 'Eng') then regexp_matches({0}, '[a-zA-Z]') else true end"
REQUESTS = "r as (select event_id::varchar as question_id, event_type as language, round_even(value, 1) as latency_ms, substr(sha256(user_id::varchar), 1, 16) as ip_hash, ts from events)"
FEEDBACK = "f as (select event_id::varchar as question_id, (1 + event_id % 5)::int as rating, (1 + event_id % 5) <= 2 as flagged, ts from events)"
MERGED = f"""{QA}, aug as (select item_id, text as input, text as output, 'en' as subset from benchmark),
al as (select *, {BLANK.format(chr(39).join(['regexp_replace(lower(input), ', '[\\s\\x0b]+', ', ', ' ', ', ', 'g', ')']))} as t from aug), ash as (select *, {SHINGLES} as s from al),
low as (select *, {BLANK.format(chr(39).join(['regexp_replace(lower(input), ', '[\\s\\x0b]+', ', ', ' ', ', ', 'g', ')']))} as t from qa), sh as (select *, {SHINGLES} as s from low),
hit as (select distinct a.item_id from ash a join sh o on o.subset = a.subset
  where len(list_intersect(a.s, o.s))::double / (len(a.s) + len(o.s) - len(list_intersect(a.s, o.s))) >= 0.85),
merged as (select id::varchar as id, input, output, subset, 'original' as source, id as ord from qa
  union all select 'b' || item_id, input, output, subset, 'benchmark', 1000000000 + item_id from aug where item_id not in (select item_id from hit))"""

LENGTHS = "count(*) as n, round(avg(q_tokens), 1) as q_mean, round(quantile_cont(q_tokens, 0.5), 1) as q_median, round(quantile_cont(q_tokens, 0.95), 1) as q_p95, max(q_tokens) as q_max, max(a_tokens) as a_max, round(avg(a_tokens), 1) as a_mean, round(quantile_cont(a_tokens, 0.5), 1) as a_median, round(quantile_cont(a_tokens, 0.95), 1) as a_p95"
SUMMARY = """select subset as language, count(*) as n, round(avg(q_script_ok::int), 6) as q_script_ok_rate, round(avg(a_script_ok::int), 6) as a_script_ok_rate,
  round(avg(q_lang_ok::int), 6) as q_lang_ok_rate, round(avg(a_lang_ok::int), 6) as a_lang_ok_rate,
  round(avg(qa_cos), 6) as qa_cos_mean, round(quantile_cont(qa_cos, 0.5), 6) as qa_cos_median, round(quantile_cont(qa_cos, 0.1), 6) as qa_cos_p10,
  quantile_cont(q_tokens, 0.5)::double as q_tokens_median, quantile_cont(a_tokens, 0.5)::double as a_tokens_median, round(avg(a_repetition), 6) as a_repetition_mean from g group by 1"""
#: The rows of table {rows} (id, subset, s: shingles) that an earlier kept row of their language resembles: edges by later row, folded in order.
GREEDY = """edges as (select a.id as a, b.id as b from {rows} a join {rows} b on a.subset = b.subset and a.id < b.id and len(a.s) between {t} * len(b.s) - 1e-9 and len(b.s) / {t} + 1e-9
    where len(list_intersect(a.s, b.s))::double / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= {t}),
  gone as (select distinct unnest(list_reduce(list([a, b] order by b, a), lambda gone, e: case when list_contains(gone, e[1]) then gone else list_append(gone, e[2]) end, []::bigint[])) as id from edges)"""
KEPT_GATES = "a_tokens::double / greatest(q_tokens, 1) between 0.5 and 20"

THINNED = "array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: i % {1} <> 0), lambda i: {0}[i]), ' ')"
#: From table cp (id, r, h: texts without white space): matches of each order that both texts have, and the averages' F2.
SENTENCE_CHRF = """k as (select id, r, h, unnest(range(1, 7)) as k from cp),
  gr as (select id, k, g, count(*) as n from (select id, k, unnest(list_transform(range(1, length(r) - k + 2), lambda i: substr(r, i, k))) as g from k where length(r) >= k) group by 1, 2, 3),
  gh as (select id, k, g, count(*) as n from (select id, k, unnest(list_transform(range(1, length(h) - k + 2), lambda i: substr(h, i, k))) as g from k where length(h) >= k) group by 1, 2, 3),
  o as (select id, k, sum(least(gr.n, gh.n))::double as c from gr join gh using (id, k, g) group by 1, 2),
  pr as (select k.id, avg(coalesce(c, 0) / (length(h) - k + 1)) as p, avg(coalesce(c, 0) / (length(r) - k + 1)) as q from k left join o using (id, k) where least(length(r), length(h)) >= k group by 1),
  alike as (select cp.id, coalesce(case when p + q > 0 then 5 * p * q / (4 * p + q) end, 0) as f from cp left join pr using (id))"""
SQUEEZED = "regexp_replace({0}, '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '', 'g')"
TAG_CODES = {"Eng_Uga": ["en"], "Eng_Gha": ["en"], "Eng_Eth": ["en"], "Eng_Ken": ["en"], "Aka_Gha": ["tw", "ak"], "Lug_Uga": ["lg"], "Swa_Ken": ["sw"], "Amh_Eth": ["am"]}
PII = "(regexp_matches({0}, '\\b[\\+]?[(]?[0-9]{{1,4}}[)]?[-\\s\\./0-9]{{7,}}\\b') or regexp_matches({0}, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') or regexp_matches({0}, '\\b(Mr|Mrs|Ms|Dr|Prof)\\.?\\s+[A-Z][a-z]+\\b'))"
UNSAFE = "regexp_matches({0}, '(?i)take\\s+\\d+\\s+(tablets?|pills?|mg)\\s+at\\s+once|do\\s+not\\s+go\\s+to\\s+(a\\s+)?(doctor|hospital|clinic)|abort\\s+using\\s+[a-z\\s]+at\\s+home|self[-\\s]medicate\\s+with')"


def noise_stripped(column: str) -> str:
    """nfc, then without tags, addresses and citations, wide spaces narrowed, ends stripped."""
    out = f"nfc_normalize({column})"
    for pattern, by in (("<[^>]+>", ""), ("https?://[^\\s\\x0b]+|www\\.[^\\s\\x0b]+", ""), ("\\[\\[?\\d+\\]?\\]", ""), ("[\\s\\x0b]{2,}", " "), ("^[\\s\\x0b]+|[\\s\\x0b]+$", "")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


#: chrF of cp(id, r, h), blanks removed, as alike(id, f).
CHRF = """k as (select id, r, h, unnest(range(1, 7)) as k from cp),
      gr as (select id, k, g, count(*) as n from (select id, k, unnest(list_transform(range(1, length(r) - k + 2), lambda i: substr(r, i, k))) as g from k) group by 1, 2, 3),
      gh as (select id, k, g, count(*) as n from (select id, k, unnest(list_transform(range(1, length(h) - k + 2), lambda i: substr(h, i, k))) as g from k) group by 1, 2, 3),
      o as (select id, k, sum(least(gr.n, gh.n))::double as c from gr join gh using (id, k, g) group by 1, 2),
      fk as (select k.id, case when c > 0 then 5 * (c / (length(h) - k + 1)) * (c / (length(r) - k + 1)) / (4 * (c / (length(h) - k + 1)) + c / (length(r) - k + 1)) end as f from k left join o using (id, k)),
      alike as (select id, coalesce(avg(f), 0) as f from fk group by 1)"""
#: Predictions with some words moved and some left out.
MOVED = f"""w as (select id, subset, output, {TOKENS.format('output')} as w from qa),
      v as (select *, list_transform(range(1, len(w) + 1), lambda i: case i % 7 when 3 then coalesce(w[i + 1], w[i]) when 4 then w[i - 1] else w[i] end) as m from w),
      p as (select id, subset, output, array_to_string(list_transform(list_filter(range(1, len(m) + 1), lambda i: i % 5 <> 0), lambda i: m[i]), ' ') as prediction from v)"""

ORACLES: dict[str, str] = {
    "clean_drop_report": f"with {METRICS}, x as (select subset, {REASON} as reason from d) select reason, subset, count(*) as n from x where reason is not null group by 1, 2",
    "clean_survivors": f"with {METRICS} select id, subset, q_tokens, a_tokens, round(a_repetition, 6) as a_repetition from d where {REASON} is null",
    "token_stats": f"with {METRICS} select id, q_tokens, a_tokens from d",
    "script_ok_rates": f"with {METRICS} select subset, count(*) as n, round(avg(q_script_ok::int), 6) as q_rate, round(avg(a_script_ok::int), 6) as a_rate from d group by 1",
    "repetition_ratio": f"with {METRICS} select id, round(a_repetition, 6) as a_repetition from d",
    "strip_noise": f"select page_id, md5({BLANK.format(chr(39).join(['regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, ', '<[^>]+>', ', ', '', ', ', 'g', '), ', 'https?://[^\\s\\x0b]+|www\\.[^\\s\\x0b]+', ', ', '', ', ', 'g', '), ', '\\[\\[?\\d+\\]?\\]', ', ', '', ', ', 'g', '), ', '[\\s\\x0b]{2,}', ', ', ' ', ', ', 'g', ')']))}) as text_md5 from pages",
    "clean_whitespace": f"select page_id, md5({BLANK.format(chr(39).join(['regexp_replace(regexp_replace(html, ', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ', ', '', ', ', 'g', '), ', '\\s+', ', ', ' ', ', ', 'g', ')']))}) as text_md5 from pages",
    "exact_dedup_first": f"with {QA} select id, subset from qa qualify row_number() over (partition by md5(input || output) order by ord) = 1",
    "dup_groups_all": f"with {QA} select id, n from (select id, count(*) over (partition by md5(input || '|||' || output)) as n from qa) where n > 1",
    "pii_flags": "select doc_id, regexp_matches(text, '\\b[\\+]?[(]?[0-9]{1,4}[)]?[-\\s\\./0-9]{7,}\\b') as phone, regexp_matches(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') as email, regexp_matches(text, '\\b(Mr|Mrs|Ms|Dr|Prof)\\.?\\s+[A-Z][a-z]+\\b') as titled_name from documents",
    "unsafe_flags": f"with {QA} select subset, count(*) as n, count(*) filter (regexp_matches(output, '(?i)take\\s+\\d+\\s+(tablets?|pills?|mg)\\s+at\\s+once|do\\s+not\\s+go\\s+to\\s+(a\\s+)?(doctor|hospital|clinic)|abort\\s+using\\s+[a-z\\s]+at\\s+home|self[-\\s]medicate\\s+with')) as unsafe from qa group by 1",
    "tag_normalise": """with x as (select doc_id, case doc_id % 5 when 0 then source when 1 then 'Swa_Ken' else case lang when 'en' then ' Eng ' when 'de' then 'KISWAHILI' when 'fr' then 'amh_eth' when 'es' then 'Eng_Kenya' else lang end end as tag from documents),
      v(name, fixed) as (values ('kiswahili', 'Swa_Ken'), ('eng', 'Eng_Uga'), ('amh_eth', 'Amh_Eth'), ('eng_kenya', 'Eng_Ken'))
      select doc_id, tag, case when tag = 'Swa_Ken' then tag else fixed end as fixed from x left join v on v.name = lower(trim(tag))""",
    "dominant_script": f"""with d as (select doc_id, text from documents union all select * from (values {', '.join(f"({-i}, '{t}')" for i, t in enumerate(SCRIPT_TEXTS, 1))}) l(doc_id, text)),
      r(low, high, script) as (values {', '.join(f"({a}, {b}, '{n}')" for a, b, n in letter_ranges())}),
      c as (select doc_id, unicode(c) as point, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '(?s).')) as c from d) group by 1, 2),
      s as (select doc_id, script, sum(n) as n from c join r on point between low and high group by 1, 2),
      m as (select doc_id, case when max(n) >= 0.6 * sum(n) then arg_max(script, n) else 'MIXED' end as script from s group by 1)
      select doc_id, coalesce(script, 'EMPTY') as script from d left join m using (doc_id)""",
    "change_log": f"""with {QA}, first as (select *, row_number() over (partition by md5(input || output) order by ord) as rn from qa),
      n as (select *, {BLANK.format(chr(39).join(['regexp_replace(input, ', '[\\s\\x0b]{2,}', ', ', ' ', ', ', 'g', ')']))} as ni from first)
      select id as row_id, 'REMOVED_DUPLICATE' as change_type, substr(input, 1, 120) as original_value, 'DROPPED' as new_value from n where rn > 1
      union all select id, 'TEXT_NORMALISED_INPUT', substr(input, 1, 120), substr(ni, 1, 120) from n where rn = 1 and ni <> input
      union all select id, 'QUARANTINE_PII', substr(input, 1, 120), 'QUARANTINED' from n where rn = 1 and (regexp_matches(input || ' ' || output, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+'))""",
    "quarantine_split": f"with {QA} select subset, regexp_matches(output, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') as quarantined, count(*) as n from qa group by 1, 2",
    "lang_counts": "select lang, count(*) as n from documents group by 1",
    "length_stats": f"with {METRICS} select subset, {LENGTHS} from d group by 1",
    "imbalance": "select lang, n, round(100.0 * n / sum(n) over (), 2) as pct, round(n / max(n) over (), 3) as ratio from (select lang, count(*)::double as n from documents group by 1)",
    "length_histogram": f"""with {METRICS}, e as (select min(q_tokens)::double as lo, max(q_tokens)::double as hi from d)
      select least(floor((q_tokens - lo) / ((hi - lo) / 40))::int, 39) as bin, count(*) as n from d, e group by 1""",
    "missing_values": "select 'doc_id' as column_name, count(*) - count(doc_id) as missing from documents union all select 'text', count(*) - count(text) from documents union all select 'lang', count(*) - count(lang) from documents union all select 'source', count(*) - count(source) from documents",
    "vocab_overlap": f"with {QA}, v as (select distinct id % 5 = 0 as val, unnest({TOKENS.format('lower(input)')}) as w from qa) select count(*) as val_words, count(*) filter (w in (select w from v where not val)) as common, round(100.0 * count(*) filter (w in (select w from v where not val)) / count(*), 2) as pct from v where val",
    "shingle_jaccard_edges": f"""with {FIRST_LINES}, so as (select id, subset, list_sort(s) as s from sh),
      e as (select a.id as a, b.id as b, a.s = b.s as same, len(list_intersect(a.s, b.s))::double / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) as j
        from so a join so b on a.subset = b.subset and a.id <> b.id and len(a.s) > 0 and len(a.s) between 0.85 * len(b.s) - 1e-9 and len(b.s) / 0.85 + 1e-9),
      l as (select a, count(*) as n, max(j) filter (not same) as nearest from e where j >= 0.85 group by 1)
      select so.id, subset, min(so.id) over (partition by subset, s) as class_id, coalesce(n, 0) as n_links, round(nearest, 6) as nearest from so left join l on l.a = so.id""",
    "aug_vs_original_antijoin": f"with {MERGED} select item_id from aug where item_id not in (select item_id from hit)",
    "cosine_pairs_gt_090": "select count(*) as pairs from embeddings a join embeddings b on a.vec_id < b.vec_id where list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double * b.embedding[i]::double)) > 0.9",
    "length_ratio_gate": f"with {METRICS} select id, {KEPT_GATES} as ok from d",
    "gate_funnel": f"""with {DIAGNOSTIC}, x as (select *, {KEPT_GATES} as g1, a_script_ok as g2, coalesce(tox < 0.5, true) as g3, coalesce(qa_cos >= 0.0, false) as g4 from g),
      l as (select subset as language, 'length_ratio' as gate, true as reached, g1 as ok from x union all select subset, 'language_id', g1, g1 and g2 from x
        union all select subset, 'toxicity', g1 and g2, g1 and g2 and g3 from x union all select subset, 'semantic_relevance', g1 and g2 and g3, g1 and g2 and g3 and g4 from x)
      select gate, language, count(*) filter (reached) as total, count(*) filter (ok) as passing, count(*) filter (reached) - count(*) filter (ok) as failing,
        round_even(count(*) filter (ok)::double / count(*) filter (reached), 4) as pass_rate from l group by 1, 2 having count(*) filter (reached) > 0""",
    "near_dup_greedy": f"with {FIRST_LINES}, {GREEDY.format(rows='sh', t=0.85)} select id, subset, id not in (select id from gone) as kept from sh",
    "near_dup_rate_by_lang": f"with {FIRST_LINES}, {GREEDY.format(rows='sh', t=0.85)} select subset, count(*) as n, round(avg((id in (select id from gone))::int), 6) as near_dup_rate from sh group by 1",
    "diagnostic_summary": f"with {DIAGNOSTIC}, {SHINGLED}, {GREEDY.format(rows='sh', t=0.85)}, su as ({SUMMARY}), nd as (select subset, avg((id in (select id from gone))::int) as rate from sh group by 1) select su.*, round(rate, 6) as near_dup_rate from su join nd on nd.subset = su.language",
    "issue_classification": f"""with {DIAGNOSTIC}, {SHINGLED}, {GREEDY.format(rows='sh', t=0.85)}, s as ({SUMMARY}), nd as (select subset, avg((id in (select id from gone))::int) as rate from sh group by 1)
      select language, coalesce(nullif(array_to_string(list_filter([case when a_script_ok_rate < 0.8 then 'answer-script mismatch' end, case when a_lang_ok_rate < 0.6 then 'answer-language mismatch' end,
        case when qa_cos_median < 0.4 then 'low coherence' end, case when rate > 0.15 then 'high duplication' end, case when a_repetition_mean > 0.2 then 'repetitive answers' end], lambda x: x is not null), '; '), ''), 'looks healthy') as issues
      from s join nd on nd.subset = s.language""",
    "worst20_per_lang": f"with {DIAGNOSTIC} select id, subset, round(qa_cos, 6) as qa_cos from g where qa_cos is not null qualify row_number() over (partition by subset order by qa_cos, ord) <= 20",
    "seed_topk": f"with {DIAGNOSTIC} select id, round(qa_cos, 6) as qa_cos from g where subset = 'en' and q_script_ok and a_script_ok and qa_cos >= 0.0 and q_tokens between 5 and 80 and a_tokens between 10 and 200 and a_repetition < 0.2 order by qa_cos desc, ord limit 40",
    "per_group_topn": f"with {DIAGNOSTIC}, t(lang, n) as (values ('de', 3), ('en', 10), ('fr', 5)) select id, subset, round(qa_cos, 6) as qa_cos from g join t on t.lang = subset where a_script_ok and a_tokens between 10 and 250 and qa_cos is not null qualify row_number() over (partition by subset order by qa_cos desc, ord) <= 2 * n",
    "stratified_sample": f"with {QA} select id, subset from qa qualify row_number() over (partition by subset order by {DRAW.format(seed=42, key='id')}, id) <= 25",
    "simple_sample": f"with {QA} select id from qa order by {DRAW.format(seed=7, key='id')}, id limit 100",
    "quota_backfill": f"""with {QA}, r as (select id, subset, row_number() over (partition by subset order by {DRAW.format(seed=42, key='id')}, id) > greatest(1, 150 // (select count(distinct subset) from qa)) as extra from qa)
      select id, subset from r order by extra, {DRAW.format(seed=42, key='id')}, id limit 150""",
    "ratio_mix": f"""with {QA}, r as (select *, row_number() over (partition by subset order by {DRAW.format(seed=42, key='id')}, id) as rk from qa),
      c as (select subset, count(*) as n, floor(count(*) * case subset when 'de' then 1.7 when 'en' then 0.5 when 'es' then 2.0 else 1.0 end)::int as take from qa group by 1),
      picks as (select subset, n, unnest(range(1, take + 1)) as draw from c where take > n),
      drawn as (select subset, (('0x' || substr(md5('42|' || subset || '|' || draw::varchar), 1, 8))::bigint % n) + 1 as rk from picks)
      select r.id, r.subset, count(*) as copies from r join (select subset, rk from r join c using (subset) where take <= n and rk <= take union all select subset, rk from drawn) x on x.subset = r.subset and x.rk = r.rk group by 1, 2""",
    "temperature_shares": "select lang, round(pow(n, 0.2) / sum(pow(n, 0.2)) over (), 6) as share from (select lang, count(*) as n from documents group by 1)",
    "cap_prefer_original": f"with {MERGED} select id, subset, source from merged qualify row_number() over (partition by subset order by (source <> 'original')::int, ord) <= case subset when 'en' then 620 when 'de' then 50 else 2000000000 end",
    "fallback_ids": f"with {QA} select case when id % 3 = 0 then format('aug_{{:08d}}', n) else id::varchar end as id, ord from (select id, ord, row_number() over (partition by id % 3 = 0 order by ord) - 1 as n from qa)",
    "rouge1_by_lang": f"""with {PREDICTIONS}, t as (select id, subset, regexp_extract_all(lower(prediction), '[\\p{{L}}\\p{{N}}_]+') as a, regexp_extract_all(lower(reference), '[\\p{{L}}\\p{{N}}_]+') as b from p),
      ca as (select id, w, count(*) as n from (select id, unnest(a) as w from t) group by 1, 2), cb as (select id, w, count(*) as n from (select id, unnest(b) as w from t) group by 1, 2),
      o as (select id, sum(least(ca.n, cb.n)) as common from ca join cb using (id, w) group by 1), s as (select subset, coalesce(2.0 * common / (len(a) + len(b)), 0) as f from t left join o using (id))
      select coalesce(subset, 'OVERALL') as language, count(*) as n, round(avg(f), 6) as rouge1_f1 from s group by grouping sets ((subset), ())""",
    "chrf_pairs": f"""with {PREDICTIONS}, q as (select id, replace(input, ' ', '') as r, replace(array_to_string(list_transform(list_filter(range(1, len({TOKENS.format('input')}) + 1), lambda i: i % 5 <> 0), lambda i: {TOKENS.format('input')}[i]), ' '), ' ', '') as h from p),
      k as (select id, r, h, unnest(range(1, 7)) as k from q),
      gr as (select id, k, g, count(*) as n from (select id, k, unnest(list_transform(range(1, length(r) - k + 2), lambda i: substr(r, i, k))) as g from k) group by 1, 2, 3),
      gh as (select id, k, g, count(*) as n from (select id, k, unnest(list_transform(range(1, length(h) - k + 2), lambda i: substr(h, i, k))) as g from k) group by 1, 2, 3),
      o as (select id, k, sum(least(gr.n, gh.n))::double as c from gr join gh using (id, k, g) group by 1, 2),
      f as (select k.id, case when c > 0 then 5 * (c / (length(h) - k + 1)) * (c / (length(r) - k + 1)) / (4 * (c / (length(h) - k + 1)) + c / (length(r) - k + 1)) end as f from k left join o using (id, k))
      select id, round(coalesce(avg(f), 0), 6) as chrf from f group by 1""",
    "judge_parse": """with r as (select event_id as i, props as reply from events union all
        select * from (values (-1, '{"overall": 4.5}'), (-2, '{"accuracy": 4, "completeness": 2}'), (-3, '4.5 / 5'), (-4, 'n/a'), (-5, 'I give it 4 of 5'), (-6, 'so: {"overall": 2, "x": 1} 5'), (-7, '{oops} 2')) v(i, reply)),
      b as (select i, reply, nullif(regexp_extract(reply, '\\{[^}]+\\}'), '') as j from r), p as (select i, reply, case when json_valid(j) then j end as j from b),
      s as (select i, coalesce(case when j is not null then coalesce((j ->> '$.overall')::double, (coalesce((j ->> '$.accuracy')::double, 3) + coalesce((j ->> '$.completeness')::double, 3) + coalesce((j ->> '$.language')::double, 3)) / 3) end,
        nullif(regexp_extract(reply, '\\b[1-5]\\.\\d+\\b'), '')::double, nullif(regexp_extract(reply, '\\b[1-5]\\b'), '')::double, 3.0) as score from p)
      select score, count(*) as n, min(i)::bigint as first_i from s group by 1""",
    "composite_score": "select vec_id, round(0.37 * a + 0.37 * b + 0.26 * least(greatest((c - 1) / 4, 0), 1), 4) as score from (select vec_id, (vec_id % 11) / 10.0 as a, (vec_id % 7) / 6.0 as b, vec_id % 6 + 0.5 as c from embeddings)",
    "argmax_grid": "select lang, beams, penalty from (select lang, b as beams, p as penalty, (lower(lang) = 'en')::int * b + (lower(lang) <> 'en')::int * (p * 2) as score, row_number() over (order by b, p) as o from (select distinct lang from documents), (values (1), (2), (4)) x(b), (values (0.8), (1.0), (1.2)) y(p)) qualify row_number() over (partition by lang order by score desc, beams, penalty) = 1",
    "submission": f'with {PREDICTIONS} select id as "ID", md5(prediction) as "TargetRLF1", md5(prediction) as "TargetR1F1", md5(prediction) as "TargetLLM" from p',
    "prompts": f"""with {QA} select id, md5('Question: ' || {BLANK.format('input')} || chr(10) || 'Answer in ' || subset || ':') as answer_md5, md5('Answer in English: ' || input) as serving_md5 from qa""",
    "merge_provenance": f"with {MERGED} select id, subset, source from merged",
    "lang_source_pivot": f"with {MERGED} select subset, count(*) filter (source = 'benchmark') as benchmark, count(*) filter (source = 'original') as original from merged group by 1",
    "source_counts": "select source, lang, count(*) as n from documents group by 1, 2",
    "request_metrics": f"with {REQUESTS} select language, count(*) as requests, round(avg(latency_ms), 4) as avg_latency_ms from r group by 1",
    "rate_limit_windows": f"with {REQUESTS} select ip_hash, date_trunc('minute', ts) as window_start, count(*) as n, count(*) > 1 as limited from r group by 1, 2",
    "rate_limit_stream": """select a.event_id, count(b.event_id) < 2 as admitted from events a left join events b
      on a.user_id = b.user_id and b.ts > a.ts - interval 6 hours and (b.ts < a.ts or b.ts = a.ts and b.event_id::varchar < a.event_id::varchar) group by 1""",
    "feedback_sinks": f"with {FEEDBACK} select 'log' as sink, rating, count(*) as n from f group by 2 union all select 'flags', rating, count(*) from f where flagged group by 2",
    "rate_limit_requests": """select a.event_id, count(b.event_id) as earlier, count(b.event_id) < 2 as admitted from events a left join events b
      on a.user_id = b.user_id and b.ts > a.ts - interval 6 hours and (b.ts < a.ts or b.ts = a.ts and b.event_id::varchar < a.event_id::varchar) group by 1""",
    "feedback_flags": f"with {FEEDBACK} select question_id, rating, flagged from f where flagged",
    "feedback_totals": f"with {FEEDBACK} select count(*) as feedback_total, count(*) filter (flagged) as flagged_total from f",
    "pause_windows": f"with {FEEDBACK}, w as (select date_trunc('day', ts) - to_days(i::int) as window_start from f, range(7) t(i) where flagged) select window_start, count(*) as n from w group by 1 having count(*) >= 5",
    "retention": "select event_id from events where ts >= timestamp '2024-01-20'",
    "ip_anonymise": "select distinct user_id, substr(sha256(user_id::varchar), 1, 16) as ip_hash from events",
    "script_heuristic": f"""with {QA}, x as (select id, input, regexp_replace(output, '[^0-9]', '', 'g') as digits, case subset when 'en' then 'Aka_Gha' when 'de' then 'Amh_Eth' when 'fr' then 'Swa_Ken' else 'Lug_Uga' end as tag from qa)
      select id, {SCRIPT_PRESENT.format('input')} as ok, {SCRIPT_PRESENT.format('digits')} as digits_ok from x""",
    "nfc_normalise": "select doc_id, md5(nfc_normalize(text)) as text_md5 from documents",
    "synthetic_source": "select format('train_{:06d}', i) as \"ID\", ['Aka_Gha', 'Amh_Eth', 'Lug_Uga', 'Swa_Eas', 'Eng'][(i % 5 + 1)::int] as subset from (select row_number() over () - 1 as i from documents)",
    "hash_separator": f"with {QA} select md5(input || output) as plain, md5(input || '|||' || output) as separated, count(*) as n from qa group by 1, 2",
    "parameters_join": f"with {METRICS} select subset, count(*) as n, count(*) filter (a_tokens < case subset when 'de' then 50 when 'fr' then 80 else 20 end) as short from d group by 1",
    "turn_pairs": "with t as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as output, lead(role) over (partition by conv_id order by turn) as nxt from conversations) select conv_id, turn, md5(text) as q_md5, md5(output) as a_md5 from t where role = 'user' and nxt = 'assistant'",
    "languages_present": "select distinct lang from documents where lang in ('de', 'fr', 'it')",
    "multiset_overlap": f"with {PREDICTIONS}, a as (select subset, unnest({TOKENS.format('prediction')}) as w from p), b as (select subset, unnest({TOKENS.format('input')}) as w from p) select subset, sum(least(x.n, y.n))::bigint as common from (select subset, w, count(*) as n from a group by 1, 2) x join (select subset, w, count(*) as n from b group by 1, 2) y using (subset, w) group by 1",
    "imputed_model_text": f"select conv_id, turn, md5(coalesce(nullif({BLANK.format('text')}, ''), ' ')) as text_md5 from conversations",
    "decoding_overlay": "select doc_id, lang, case lang when 'de' then 2 else 4 end as beams, (case lang when 'de' then 1.3 when 'fr' then 1.1 else 1.0 end)::double as penalty from documents",
    "hash_shuffle": f"with {QA} select id, row_number() over (order by md5('3|' || id::varchar), id) as place from qa",
    "rougeL_by_lang": f"""with {QA}, {MOVED},
      t as (select id, subset, {ROUGE_TOKENS.format('prediction')} as a, {ROUGE_TOKENS.format('output')} as b from p), {SUBSEQUENCES}
      select coalesce(subset, 'OVERALL') as language, count(*) as n, round(avg(coalesce(2.0 * lcs / nullif(n_a + n_b, 0), 0)), 6) as rougeL_f1 from lcs group by grouping sets ((subset), ())""",
    "csv_roundtrip": f"""with {QA}, m(v) as (values {', '.join(f"('{v}')" for v in MISSING)}) select id, md5(case when input not in (select v from m) then input end) as input_md5, md5(case when output not in (select v from m) then output end) as output_md5, subset from qa""",
    "external_rows": f"""with {QA}, m(v) as (values {', '.join(f"('{v}')" for v in MISSING)}) select subset, source, md5({BLANK.format('input')}) as input_md5, md5({BLANK.format('output')}) as output_md5, count(*) as n from qa
      where input not in (select v from m) and output not in (select v from m) group by all""",
    "json_report": f"with {METRICS}, x as (select subset, {REASON} as reason from d) select reason, sum(count(*)) over (partition by reason)::bigint as n, subset, count(*) as n_subset from x where reason is not null group by reason, subset",
    "dual_sink": f"with {QA} select 'training' as sink, subset, count(*) as n from qa group by 2 union all select 'provenance', subset, count(source) from qa group by 2",
    "partition_checkpoint": f"with {QA} select id, subset, md5(output) as output_md5, case when subset in ('de', 'fr') then 1 else 2 end as written from qa",
    "cached_relevance": f"""with {QA} select qa.id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double * b.embedding[i]::double)), 6) as cosine
      from qa join embeddings a on a.vec_id = qa.id left join embeddings b on b.vec_id = qa.id + 1""",
    "observed_clean": f"""with x as (select lang, doc_id % 9 <> 0 and {BLANK.format('text')} <> '' and doc_id % 11 <> 0 as filled from documents), c as (select count(*) as n, count(*) filter (coalesce(filled, false)) as kept from x)
      select lang as subset, count(*) as n, any_value(c.n) as all_n, any_value(c.kept) as all_kept, any_value(c.n - c.kept) as all_dropped from x, c where filled group by 1""",
    "request_log": f"with {REQUESTS} select question_id::bigint as event_id, language, latency_ms, ip_hash from r",
    "embedding_inputs": f"with {QA} select id, md5('query: ' || input) as query_md5, md5('passage: ' || output) as passage_md5 from qa",
    "translated_rows": f"with {QA}, x as (select *, case when id % 2 = 0 then 'en' else 'fr' end as target, coalesce(nullif({BLANK.format('input')}, ''), ' ') as t from qa) select id, md5(case when subset = target then t else t || ' ' || target end) as moved_md5 from x",
    "hosted_answers": "select conv_id, turn, coalesce(length(text)::varchar, '') as answer from conversations",
    "either_side_gate": f"""with {DIAGNOSTIC}, x as (select g.*, case g.subset when 'en' then 'Eng' when 'de' then 'Aka_Gha' when 'fr' then 'Amh_Eth' else 'Swa_Eas' end as tag, n.toxic as a_tox from g left join labels n on n.doc_id = g.id + 1),
      y as (select tag, {KEPT_GATES} as g1, case tag when 'Amh_Eth' then regexp_matches(input, '[\\x{{1200}}-\\x{{137F}}]') else regexp_matches(input, '[a-zA-Z]') end as g2, not (coalesce(tox >= 0.5, false) or coalesce(a_tox >= 0.5, false)) as g3, coalesce(qa_cos >= 0.0, false) as g4 from x),
      l as (select tag as language, 'length_ratio' as gate, true as reached, g1 as ok from y union all select tag, 'language_id', g1, g1 and g2 from y
        union all select tag, 'toxicity', g1 and g2, g1 and g2 and g3 from y union all select tag, 'semantic_relevance', g1 and g2 and g3, g1 and g2 and g3 and g4 from y)
      select gate, language, count(*) filter (reached) as total, count(*) filter (ok) as passing, count(*) filter (reached) - count(*) filter (ok) as failing,
        round_even(count(*) filter (ok)::double / count(*) filter (reached), 4) as pass_rate from l group by 1, 2 having count(*) filter (reached) > 0""",
    "stage2_back_translated": f"""with {METRICS}, drawn as (select *, {THINNED.format('qt', '5')} as rewritten from d join (values ('en', 30), ('de', 10), ('fr', 10)) t(subset, target) using (subset) where q_tokens between 5 and 80
        qualify row_number() over (partition by subset order by {DRAW.format(seed=42, key='id')}, id) <= 2 * target),
      cp as (select id, replace(input, ' ', '') as r, replace(rewritten, ' ', '') as h from drawn), {CHRF}
      select subset, 'backtranslation' as aug_method, md5(rewritten) as input_md5, md5(output) as output_md5, round(f, 6) as chrf_qq from drawn join alike using (id)
      where f between 0.35 and 0.85 and length(rewritten) between 5 and 500 qualify row_number() over (partition by subset order by {DRAW.format(seed=42, key='id')}, id) <= target""",
    "stage4_paraphrased": f"""with {DIAGNOSTIC}, asked as (select *, {THINNED.format('att', '3')} as rewritten from g join (values ('en', 20), ('de', 8), ('fr', 8)) t(subset, target) using (subset)
        where q_script_ok and a_script_ok and qa_cos >= 0.0 and a_tokens between 10 and 250 and a_repetition < 0.25 qualify row_number() over (partition by subset order by qa_cos desc, ord) <= 2 * target),
      cp as (select id, replace(output, ' ', '') as r, replace(rewritten, ' ', '') as h from asked), {CHRF},
      mk as (select *, {TOKENS.format('rewritten')} as rt from asked join alike using (id)),
      y as (select *, 2.0 * len(rt) / (len(rt) + a_tokens) as kept, case when len(rt) <= 4 then 0.0 else 1.0 - len(list_distinct({GRAMS.format('rt')}))::double / len({GRAMS.format('rt')}) end as again from mk)
      select subset, 'llm_paraphrase' as aug_method, md5(input) as input_md5, md5(rewritten) as output_md5, round(f, 6) as chrf_aa, round(kept, 6) as semantic_preserved from y
      where length(rewritten) >= 10 and f between 0.20 and 0.80 and kept >= 0.65 and len(rt) between 5 and 350 and again < 0.3 qualify row_number() over (partition by subset order by kept desc, rewritten) <= target""",
    "first_generation": f"""with {QA}, b as (select id, {BLANK.format('input')} as input, {BLANK.format('output')} as output, case subset when 'en' then 'Eng_Ken' when 'de' then 'Swa_Ken' else 'Lug_Uga' end as tag from qa),
      t as (select b.id, input, output, l.* from b, (values ('Swa_Ken', 5), ('Lug_Uga', 7)) l(tag, every) where b.tag = 'Eng_Ken'),
      w as (select *, row_number() over () as nr, {TOKENS.format('input')} as iw, {TOKENS.format('output')} as ow from t),
      m as (select *, {THINNED.format('iw', 'every')} as ti, {THINNED.format('ow', 'every')} as tt from w), cp as (select nr as id, {SQUEEZED.format('input')} as r, {SQUEEZED.format('ti')} as h from m), {SENTENCE_CHRF},
      fw as (select tag, 'forward_mt' as source, ti as input, tt as output from m join alike on alike.id = m.nr where f >= 0.7 and ti <> '' and tt <> ''),
      base as (select tag, 'original' as source, input, output from b union all select * from fw),
      bw as (select *, {TOKENS.format('input')} as w from base where tag <> 'Eng_Ken'), e1 as (select *, {THINNED.format('w', '7')} as en from bw), e2 as (select *, {TOKENS.format('en')} as ew from e1),
      bk as (select tag, 'back_bt' as source, case tag when 'Swa_Ken' then {THINNED.format('ew', '5')} else {THINNED.format('ew', '7')} end as input, output from e2),
      u as (select * from base union all select * from bk where input <> '')
      select tag as subset, source, md5(input) as input_md5, md5(output) as output_md5, count(*) as n from u group by all""",
    "evaluation_summary": f"""with {QA}, {MOVED}, h as (select * from p order by id limit 300), t as (select id, subset, {ROUGE_TOKENS.format('prediction')} as a, {ROUGE_TOKENS.format('output')} as b from h), {SUBSEQUENCES},
      sc as (select avg(coalesce(2.0 * n_a / nullif(n_a + n_b, 0), 0)) as r1, avg(coalesce(2.0 * lcs / nullif(n_a + n_b, 0), 0)) as rl, count(*) as n from lcs),
      j as (select case when quality is null then 3.0 else 1 + 4 * quality end as score from h left join labels on doc_id = id qualify row_number() over (partition by subset order by {DRAW.format(seed=42, key='id')}, id) <= 20),
      js as (select avg(score)::double as judge from j)
      select n, round(r1, 6) as rouge1_f1, round(rl, 6) as rougeL_f1, round(judge, 6) as judge, round(round(0.37 * rl + 0.37 * r1 + 0.26 * (judge - 1) / 4, 5), 6) as composite from sc, js""",
    "decode_search": f"""with {QA}, w as (select id as doc, subset, output, {TOKENS.format('output')} as w from qa qualify row_number() over (partition by subset order by {DRAW.format(seed=42, key='id')}, id) <= 10),
      gr(ord, every, shift) as (values (0, 2, 0), (1, 2, 1), (2, 3, 0), (3, 3, 1), (4, 4, 0), (5, 4, 1)),
      x as (select *, row_number() over () as id, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: (i - 1 + shift) % every <> 0), lambda i: w[i]), ' ') as prediction from w, gr),
      t as (select id, subset, regexp_extract_all(lower(prediction), '[a-z0-9]+') as a, regexp_extract_all(lower(output), '[a-z0-9]+') as b from x), {SUBSEQUENCES.replace('select subset,', 'select id, subset,')},
      s as (select x.subset, ord, every, shift, avg(coalesce(2.0 * lcs / nullif(n_a + n_b, 0), 0)) as score from lcs join x using (id) group by 1, 2, 3, 4)
      select subset, every::bigint as every, shift::bigint as shift, round(score, 6) as score from s qualify row_number() over (partition by subset order by score desc, ord) = 1""",
    "answers": f"""with x as (select *, lead(text) over (partition by conv_id order by turn) as answer, lead(role) over (partition by conv_id order by turn) as nr from conversations),
      y as (select *, case when turn % 4 = 0 then 'Lug_Uga' when conv_id % 3 = 0 then 'Swa_Eas' else 'Eng' end as language from x where role = 'user' and nr = 'assistant')
      select conv_id || '-' || turn as question_id, language, md5('Answer in ' || case language when 'Lug_Uga' then 'Luganda' when 'Swa_Eas' then 'Swahili' else 'English' end || ': ' || text) as prompt_md5, md5(answer) as answer_md5,
        round((0.5 + 1.0::double / (1 + turn)) / 2, 6) as confidence, case language when 'Eng' then 'information only' when 'Swa_Eas' then 'taarifa tu' else 'ask a professional' end as disclaimer, round_even(length(text) / 7.0, 1)::double as latency_ms, substr(sha256(conv_id::varchar), 1, 16) as ip_hash from y""",
    "sentence_chrf_pairs": f"""with {QA}, w as (select id, input, {TOKENS.format('input')} as w from qa), cp as (select id, {SQUEEZED.format('input')} as r, {SQUEEZED.format(THINNED.format('w', 5))} as h from w), {SENTENCE_CHRF} select id, round(f, 6) as chrf from alike""",
    "clean_totals": f"with {METRICS}, x as (select {REASON} as reason from d) select count(*) as n_before, count(*) filter (reason is null) as n_after, count(reason) as n_dropped, round_even(100.0 * count(*) filter (reason is null) / count(*), 1) as pct_kept from x",
    "clean_counts": f"with x as (select doc_id % 9 <> 0 and {BLANK.format('text')} <> '' and doc_id % 11 <> 0 as filled from documents) select count(*) as n, count(*) filter (coalesce(filled, false)) as kept, count(*) filter (not coalesce(filled, false)) as dropped from x",
    "utf8_anomalies": "select count(*) as n, count(*) filter (decode(encode(text)) <> text) as anomalies from documents",
    "clean_log": f"""with {QA}, x as (select id, ord, input, output, case subset when 'en' then 'eng' when 'de' then 'swahili' when 'fr' then 'Amh_Eth' else 'nowhere' end as tag from qa),
      f as (select *, row_number() over (partition by md5(input || output) order by ord) as rn, {noise_stripped('input')} as ni, {noise_stripped('output')} as no, case tag when 'eng' then 'Eng_Uga' when 'swahili' then 'Swa_Ken' when 'Amh_Eth' then tag end as fixed from x),
      l as (select id, 'REMOVED_DUPLICATE' as change_type, substr(input, 1, 120) as o, 'DROPPED' as n from f where rn > 1
        union all select id, 'TEXT_NORMALISED_INPUT', substr(input, 1, 120), substr(ni, 1, 120) from f where rn = 1 and ni <> input
        union all select id, 'TEXT_NORMALISED_OUTPUT', substr(output, 1, 120), substr(no, 1, 120) from f where rn = 1 and no <> output
        union all select id, 'QUARANTINE_PII', substr(ni, 1, 120), 'QUARANTINED' from f where rn = 1 and ({PII.format('ni')} or {PII.format('no')})
        union all select id, 'FLAGGED_UNSAFE_ANSWER', substr(no, 1, 200), 'FLAGGED' from f where rn = 1 and {UNSAFE.format('no')}
        union all select id, 'SUBSET_TAG_FIXED', tag, fixed from f where rn = 1 and fixed <> tag
        union all select id, 'QUARANTINE_INVALID_SUBSET', tag, 'QUARANTINED' from f where rn = 1 and fixed is null)
      select id as row_id, 'train' as split, change_type, md5(o) as old_md5, md5(n) as new_md5 from l""",
    "batch_tiers": """with x as (select event_id, floor(value) as free_gb, (case event_id % 6 when 0 then 13.0 when 1 then 3.7 when 2 then 1.2 when 3 then 0.58 when 4 then 0.3 else 1.2 end)::double as size_b from events)
      select event_id, size_b, greatest(1, floor(case when free_gb >= 70 then 24 when free_gb >= 55 then 16 when free_gb >= 40 then 12 when free_gb >= 28 then 8 when free_gb >= 18 then 4 when free_gb >= 10 then 2 else 1 end / greatest(1.0, size_b / 3.7)))::int as batch from x""",
    "l2_norms": "with v as (select vec_id, vec_id % 3 as k, embedding, sqrt(list_sum(list_transform(embedding, lambda x: (x::double * (vec_id % 3)) ** 2))) as norm from embeddings) select vec_id, case when k = 0 then 0.0 else 1.0 end as norm, case when k = 0 then 0.0 else round(embedding[1]::double * k / norm, 6) end as first from v",
    "mean_confidence": "select event_id, round(case when event_id % 4 = 0 then 0.85 else value / 100.0 end, 6) as confidence from events",
    "language_accepted": f"""with {QA}, x as (select id, ord, case subset when 'en' then 'Eng_Uga' when 'de' then 'Aka_Gha' when 'fr' then 'Swa_Ken' else 'other' end as tag, input as t, (ord % 10) / 10.0 + 0.1 as conf from qa),
      c as (select *, case when ord % 7 = 0 then null when tag = 'Eng_Uga' then 'en' when tag = 'Aka_Gha' then 'ak' else 'sw' end as raw, length({BLANK.format('t')}) >= 5 as long from x),
      u as (select id, tag, case when long and raw is not null then raw else 'und' end as code, case when long and raw is not null then conf else 0.0 end as confidence from c)
      select id, code, round(confidence::double, 6) as confidence, coalesce(confidence >= 0.5 and case tag when 'Eng_Uga' then code = 'en' when 'Aka_Gha' then code in ('tw', 'ak') when 'Swa_Ken' then code = 'sw' else false end, false) as ok from u""",
    "language_gate": f"""with {QA}, x as (select id, input, case subset when 'en' then 'Eng' when 'de' then 'Swa_Eas' when 'fr' then 'Amh_Eth' else 'Eng_Ken' end as tag, case ord % 4 when 0 then 'en' when 1 then 'sw' end as code from qa)
      select id, least(length(input), 200)::int as asked, case tag when 'Amh_Eth' then regexp_matches(input, '[\\x{{1200}}-\\x{{137F}}]') when 'Eng_Ken' then true else regexp_matches(input, '[a-zA-Z]') end
        and coalesce(case tag when 'Eng' then code = 'en' when 'Swa_Eas' then code = 'sw' when 'Amh_Eth' then code = 'am' end, true) as ok from x""",
    "toxicity_gate": "with x as (select doc_id, case when toxic = 1 then (doc_id % 10) / 10.0 else 1 - (doc_id % 10) / 10.0 end as q, case when doc_id % 3 <> 0 then (doc_id % 4) / 4.0 end as a from labels) select doc_id, round(q::double, 6) as q, q < 0.5 and coalesce(a < 0.5, true) as ok from x",
    "stage1_drops": f"""with {DIAGNOSTIC}, e as (select id, case subset when 'en' then 'Eng_Gha' else 'Lug_Uga' end as subset, input, case when q_tokens < 3 then 'Q < 3 tokens' when a_tokens < 5 then 'A < 5 tokens' when a_tokens > 400 then 'A > 400 tokens' when a_repetition > 0.5 then 'A repetition > 0.5'
        when not a_script_ok then '[' || case subset when 'en' then 'Eng_Gha' else 'Lug_Uga' end || '] answer script mismatch' when subset = 'en' and qa_cos < 0.15 then '[Eng_Gha] cosine < 0.15' when subset <> 'en' and qa_cos < 0.1 then '[Lug_Uga] cosine < 0.1' end as reason from g),
      low as (select id, subset, {BLANK.format(chr(39).join(['regexp_replace(lower(input), ', '[\\s\\x0b]+', ', ', ' ', ', ', 'g', ')']))} as t from e where reason is null), sh as (select *, {SHINGLES} as s from low), {GREEDY.format(rows='sh', t=0.88)}
      select reason, subset, count(*) as n from e where reason is not null group by 1, 2 union all select 'near-duplicates within language', subset, count(*) from sh where id in (select id from gone) group by 2""",
    "english_seeds": f"with {DIAGNOSTIC} select id, round(qa_cos, 6) as qa_cos from g where subset = 'en' and q_script_ok and a_script_ok and q_lang_ok and a_lang_ok and qa_cos >= 0 and q_tokens between 5 and 80 and a_tokens between 10 and 200 and a_repetition < 0.2 order by qa_cos desc, ord limit 20",
    "transfer_topn": f"""with {METRICS}, x as (select *, 0.5 + (ord % 50) / 100.0 + ord / 1e9 as rel from d)
      select md5(input) as input_md5, 'Swa_Ken' as subset, 'crosslingual_from_Eng_Gha' as aug_method, round(rel::double, 6) as kept_meaning from x where q_script_ok and a_script_ok and q_tokens between 3 and 100 and a_tokens between 5 and 300
        and ord % 3 <> 0 and (ord % 10) / 10.0 >= 0.4 and length({BLANK.format('output')}) >= 5 and rel >= 0.55 order by rel desc, input limit 40""",
    "forward_translation": f"""with {QA}, e as (select id, input, output from qa), t as (select e.*, l.* from e, (values ('Swa_Ken', 5, 0.7), ('Lug_Uga', 3, 0.55)) l(tag, every, least)),
      w as (select *, row_number() over () as nr, {TOKENS.format('input')} as iw, {TOKENS.format('output')} as ow from t),
      m as (select *, {THINNED.format('iw', 'every')} as ti, {THINNED.format('ow', 'every')} as tt from w), cp as (select nr as id, {SQUEEZED.format('input')} as r, {SQUEEZED.format('ti')} as h from m), {SENTENCE_CHRF}
      select tag as subset, 'forward_mt' as source, md5(ti) as input_md5, md5(tt) as output_md5, count(*) as n from m join alike on alike.id = m.nr where f >= least and ti <> '' and tt <> '' group by all""",
    "back_translation": f"""with {QA}, x as (select *, case subset when 'en' then 'Eng_Ken' when 'de' then 'Swa_Ken' else 'Lug_Uga' end as tag from qa)
      select case when id % 10 <> 0 then id::varchar else 'nan' end || '_bt' as "ID", tag as subset, 'back_bt' as source, md5({BLANK.format("(input || ' eng ' || case tag when 'Swa_Ken' then 'swh' else 'lug' end)")}) as input_md5, md5(output) as output_md5, count(*) as n from x where tag <> 'Eng_Ken' group by all""",
    "training_prompts": f"""with {QA}, x as (select ord, {BLANK.format('input')} as q, {BLANK.format('output')} as a, subset from qa where subset in ('de', 'fr'))
      select row_number() over (order by ord) - 1 as val_index, md5('Question: ' || q || chr(10) || 'Answer in ' || subset || ':') as prompt_md5, md5(a) as output_md5 from x""",
    "prediction_dump": f"""with {PREDICTIONS}, r as (select *, row_number() over (partition by subset order by {DRAW.format(seed=42, key='id')}, id) > greatest(1, 60 // (select count(distinct subset) from p)) as extra from p),
      t as (select id, subset, {BLANK.format('reference')} as ref, {BLANK.format('prediction')} as pred from r order by extra, {DRAW.format(seed=42, key='id')}, id limit 60),
      n as (select *, len(regexp_extract_all(lower(pred), '[a-z0-9]+')) as a, len(regexp_extract_all(lower(ref), '[a-z0-9]+')) as b from t)
      select 2 as phase, 300 as global_step, 1.5::double as epoch, id, subset, round(coalesce(2.0 * a / nullif(a + b, 0), 0), 6) as rouge1, round(coalesce(2.0 * a / nullif(a + b, 0), 0), 6) as rougel, length(ref)::int as reference_chars, length(pred)::int as prediction_chars from n""",
    "judge_means": f"with {QA} select subset, round_even(avg(case when id % 5 = 0 then 3.0 else id % 5 end), 3) as score, count(*) as n from qa group by 1",
    "agreement_alpha": """with r as (select row_number() over () as i, event_id // 4 as u, 1 + (event_id * 7 + floor(value)::bigint) % 5 as v from events), m as (select u, count(*) as m from r group by 1 having count(*) > 1),
      k as (select r.*, m.m from r join m using (u)), seen as (select sum((a.v - b.v) ** 2 / (a.m - 1)) as i, sum((a.v <> b.v)::int / (a.m - 1)::double) as n from k a join k b on a.u = b.u and a.i <> b.i),
      c as (select v, count(*)::double as c from k group by 1), t as (select count(*)::double as n from k), far as (select sum(x.c * y.c * (x.v - y.v) ** 2) as i, sum(x.c * y.c * (x.v <> y.v)::int) as n from c x, c y)
      select 'interval' as metric, round(1 - seen.i / (far.i / (t.n - 1)), 6) as alpha from seen, far, t union all select 'nominal', round(1 - seen.n / (far.n / (t.n - 1)), 6) from seen, far, t""",
    "rouge_drop": f"""with {PREDICTIONS}, t as (select id, subset, len({ROUGE_TOKENS.format('prediction')}) as a, len({ROUGE_TOKENS.format('reference')}) as b from p),
      m as (select coalesce(subset, 'OVERALL') as language, round(avg(coalesce(2.0 * a / nullif(a + b, 0), 0)) filter (id % 2 = 0), 6) as now, round(avg(coalesce(2.0 * a / nullif(a + b, 0), 0)) filter (id % 2 = 1), 6) as before from t group by grouping sets ((subset), ()))
      select language, now, before, before - now > 0.0001 as paused from m""",
    "monthly_flags": f"with {FEEDBACK} select date_trunc('month', ts)::timestamp as month, 'c' || (question_id::bigint % 3) as category, case when rating = 1 then 'open' else 'closed' end as status, count(*) as n from f where flagged group by all",
}
