"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

URL_RULES = r"""
with p as (
  select page_id,
         coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(h, pre, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
select page_id, host, path,
       (select h || pre from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, pre)
        order by length(h || pre) desc, length(h) desc limit 1) as rule,
       coalesce((select action from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, pre)
        order by length(h || pre) desc, length(h) desc limit 1), 'allow') as verdict
from p
"""

CHAT = r"""
with hostile(conv_id, turn, role, text) as (values
  (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t as (select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text
      from (select conv_id, turn, role, text from conversations union all select * from hostile)),
e as (select *, case when contains(text, '\') or contains(text, '### ') or contains(text, '</turn>')
                     then replace(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ': ', '\: ')
                     else text end as body
      from t)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(role) + length(body) + 14)::bigint as formatted_chars,
       true as identical
from e group by conv_id
"""

# windows of 13 words that also start in a document with a smaller doc_id
SUBSTRINGS = rf"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g
            from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) as i from t)),
first as (select g, min(doc_id) as least from windows group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as k from windows join first using (g) where least < doc_id),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as k from t),
kept as (select w.doc_id, string_agg(w.word, ' ' order by w.k) as kept from words w left join gone g on g.doc_id = w.doc_id and g.k = w.k
         where g.k is null group by w.doc_id)
select t.doc_id, len(ws)::bigint as n_words, (select count(*) from gone where gone.doc_id = t.doc_id)::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from t left join kept on kept.doc_id = t.doc_id
"""

# the quality rules: base counts, and lines that more than 20 different texts of a source hold
LINES = rf"""
with t as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 2], ' ') as g
            from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from t)),
twice as (select doc_id, g from windows group by doc_id, g having count(*) > 1),
repeated as (select doc_id, count(distinct k) as n from (
               select doc_id, unnest(range(i, i + 3)) as k from windows join twice using (doc_id, g)) group by doc_id),
lines as (select doc_id, source, l, row_number() over (partition by doc_id order by k) as k from (
            select doc_id, source, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as k from t)
          where regexp_matches(l, '{WORD}')),
dup as (select doc_id, count(*) - count(distinct l) as n from lines group by doc_id),
normal as (select doc_id, source, k, array_to_string(ws, ' ') as line, len(ws) as words from (
             select *, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '{WORD}') as ws from lines)),
own as (select doc_id, source, line, sum(words) as words from normal group by doc_id, source, line),
common as (select o.source, o.line from own o join t using (doc_id) group by o.source, o.line having count(distinct t.text) > 20),
gone as (select doc_id, count(*) as n, sum(words) as words from own o
         where exists (select 1 from common c where c.source is not distinct from o.source and c.line = o.line) group by doc_id),
counted as (select t.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
              length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
              coalesce(repeated.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_common_lines, coalesce(gone.words, 0)::bigint as common_words
            from t left join dup using (doc_id) left join repeated using (doc_id) left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       n_common_lines, common_words,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - common_words >= 20
         and 100 * (n_words - common_words) >= 30 * n_words as kept
from counted
"""

ORACLE = {
    "op1_substring_dedup": SUBSTRINGS,
    "op3_line_quality": LINES,
    "op6_url_rules": URL_RULES,
    "op7_chat_round_trip": CHAT,
}
