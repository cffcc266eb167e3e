"""The results of this subpackage's queries in DuckDB SQL, where SQL can express them."""

ORACLES = {
    "op2_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), escaped as (
  select *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') as body,
    replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n') as name
  from rows
)
select conv_id,
  count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(name) + 1 + length(body) + length('<|im_end|>') + 1)::bigint as formatted_chars
from escaped group by conv_id
""",
    "op9_url_filters": r"""
with recursive parts as (
  select page_id, url, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's'), '') as tail
  from pages
), rules(action, rhost, rpath) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), pagelinks as (
  select host, case when host <> '' then host || case when starts_with(tail, '/') then tail else '/' || tail end end as source,
    unnest(list_concat(
      list_transform(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'i'), lambda t: regexp_extract(t, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'i')),
      list_transform(regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'i'), lambda t: regexp_extract(t, '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'i')))) as link
  from parts
), absolute as (
  select source, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then 'http:' || link when starts_with(link, '/') then 'http://' || host || link end as link
  from (select host, source, replace(link, '&amp;', '&') as link from pagelinks where link <> '')
), targets as (
  select source, translate(regexp_extract(link, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as thost, regexp_extract(link, '^.*?://[^/?#]*([^#]*)', 1, 's') as ttail
  from absolute where link is not null
), edges as (
  select distinct source, thost || case when starts_with(ttail, '/') then ttail else '/' || ttail end as target from targets where thost <> ''
), both_ways as (
  select source as a, target as b from edges where source is not null and source <> target union select target, source from edges where source is not null and source <> target
), reached as (
  select a, a as b from both_ways union select r.a, e.b from reached r join both_ways e on e.a = r.b
), nodes as (
  select distinct a, split_part(a, '/', 1) as host, regexp_extract(substr(a, length(split_part(a, '/', 1)) + 1), '^[^?]*') as path from both_ways
), decided as (
  select n.a, arg_max(r.action, length(rhost || rpath)) as action from nodes n join rules r
    on (n.host = rhost or n.host like '%.' || rhost) and starts_with(n.path, rpath) group by 1
), classes as (
  select r.a, min(sha256(r.b)) as alias_class, case when bool_or(d.action = 'allow') then 'allow' when bool_or(d.action = 'block') then 'block' else 'allow' end as decision
  from reached r left join decided d on d.a = r.b group by 1
), fitted as (
  select row_number() over () as k, * from parts
), own as (
  select k, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(action, length(rhost || rpath)) as action
  from fitted join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath) group by 1
)
select page_id, host, path, rule, coalesce(own.action, c.decision, 'allow') as verdict, c.alias_class
from fitted f left join own using (k)
left join classes c on c.a = case when f.host <> '' then f.host || case when starts_with(f.tail, '/') then f.tail else '/' || f.tail end end
""",
    "op11_secret_scan": r"""
with docs as (
  select row_number() over () as k, doc_id, coalesce(text, '') as t, coalesce(source, chr(0)) as owner, coalesce(source, chr(0)) || chr(1) || coalesce(lang, chr(0)) as repository from documents
), matched as (
  select k, 0 as rank, 'assign' as kind, regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') as found,
    regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2) as vals,
    string_split_regex(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)') as gaps from docs
  union all select k, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') from docs
  union all select k, 2, 'hex', regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') from docs
  union all select k, 3, 'owned', regexp_extract_all(t, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]+'), string_split_regex(t, '[A-Za-z0-9+/_=-]+') from docs
), listed as (
  select k, rank, kind, generate_subscripts(found, 1) as i, unnest(found) as m, unnest(vals) as value, unnest(gaps[1:len(found)]) as gap from matched where len(found) > 0
), placed as (
  select k, rank, kind, value, length(m) as n, sum(length(gap) + length(m)) over (partition by k, rank order by i) as stop from listed
), told as (
  select k, rank, kind, value, (stop - n)::bigint as start, stop::bigint as stop,
    length(value) between 16 and 256 and len(list_distinct(string_split(value, ''))) >= 8 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
      and not regexp_matches(lower(value), 'example|sample|dummy|fake|test|placeholder|changeme|redacted|your|xxxx|12345|abcdef') as live
  from placed where case rank when 0 then length(value) >= 6 when 1 then length(value) >= 20 when 2 then length(value) >= 24 else length(value) >= 16 end
), spans as (
  select * from told where rank < 3
  union all select x.* from told x where rank = 3 and live and not exists (select 1 from told b where b.rank < 3 and b.k = x.k and b.start < x.stop and x.start < b.stop)
), shared as (
  select value, count(distinct owner) >= 3 or count(distinct repository) >= 6 as shared from spans join docs using (k) group by value
), judged as (
  select k, rank, kind, start, stop, live, shared, kind || ':' || start || ':' || stop as line from spans join shared using (value) where rank < 3 or not shared
), folded as (
  select k, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
    string_agg(line, ',' order by start, rank) filter (rank < 3) as base, string_agg(line, ',' order by start, rank) as spans,
    count(*) filter (live and not shared) as n_live, count(*) filter (shared) as n_shared
  from judged group by k
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_shared, 0)::bigint as n_shared
from docs left join folded using (k)
""",
    "op12_hard_negatives": """
with rows as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
  select a.id as anchor_id, r.id, r.label = a.label as same, list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::bigint as score
  from rows a join rows r on len(a.v) = len(r.v) and a.id <> r.id where a.id % 100 = 0
), positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
), ranked as (
  select anchor_id, positive_id, positive_score, n.id as negative_id, n.score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by n.score desc, n.id) as rank
  from positives p join scored n using (anchor_id)
  where not n.same and 30 * positive_score <= 100 * n.score and 100 * n.score <= 90 * positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 10
""",
}
