"""The same results in SQL, written from the rules the data was derived by, not from the operators."""

from __future__ import annotations

from ..sources.derived import SHARED
from ..wire import Wire

ORACLES: dict[str, str] = {}
P = Wire().prefix

# Views that only the SQL side needs.
LOCAL: dict[str, str] = {
    "event_ids": f"""
        select *, substring(sha256('{P}-schema-id/v1' || chr(10) || 'format:json' || chr(10) || 'body:' ||
               length(body) || ':' || body || chr(10) || 'refs:0' || chr(10)), 1, 32) as schema_id from event_schemas""",
    "reg": f"""
        select *, substring(sha256('{P}-schema-id/v1' || chr(10) || 'format:json' || chr(10) || 'body:' ||
               length(body) || ':' || body || chr(10) || 'refs:0' || chr(10)), 1, 32) as schema_id from version_bodies""",
    # decoded headers, by header case
    "msg": """
        select m.*, i.schema_id as sid0, coalesce(i.schema_id, repeat('0', 32)) as sid,
               'acme.events.' || m.event_type as own_subject from message_base m left join event_ids i using (event_type)""",
    "type_names": """
        select message_id,
               case when properties_type is null then null
                    when properties_type like 'acme.Wrap%' then 'acme.Wrap_of_acme.events.' || event_type
                    when properties_type like '%, Acme.Assembly' then 'acme.events.' || event_type
                    when properties_type like 'acme.events-%' then '!'
                    else replace(properties_type, '+', '.') end as t
        from msg""",
    "resolved": """
        select message_id, case when t is null then 'absent' when t = '!' then 'unusable' else 'resolved' end as subject_outcome,
               case when t <> '!' then t end as resolved_subject from type_names""",
    "type_ok": """
        select message_id, properties_type,
               regexp_matches(properties_type, '^[A-Za-z0-9_]+([.][A-Za-z0-9_]+)*$') as ok from msg""",
    "decoded": """
        select m.message_id, m.ts, m.exchange, m.queue, m.broker_id, m.event_type, m.body_text,
               case when h in (7) then 'none' when h in (8, 9, 10, 12) then 'headers' when h = 11 then 'content_type' else 'none' end as kind,
               case when h in (8, 9, 10, 11, 12) then sid end as schema_id,
               case when h = 9 then 'acme.other' when h in (10, 12) then own_subject
                    when h = 11 and t.ok then m.properties_type end as subject,
               case when h = 10 then 2 when h = 12 then 1 end as ordinal,
               case when h = 10 then '1.0.0' end as semver,
               case when h in (9, 10, 11) then 'json' when h = 12 and m.message_id % 2 = 0 then 'avro' when h = 12 then 'json' end as format,
               case when h = 8 then 'subject_name_invalid,envelope_ordinal_malformed,semver_invalid'
                    when h = 9 and m.properties_type is not null and m.properties_type <> 'acme.other' then 'envelope_subject_type_mismatch'
                    when h in (10, 12) and m.properties_type is not null and m.properties_type <> own_subject then 'envelope_subject_type_mismatch'
                    when h = 11 and m.properties_type is not null and not t.ok then 'subject_name_invalid' else '' end as warnings,
               case h when 2 then 'envelope_version_unsupported' when 3 then 'envelope_header_type_invalid'
                    when 4 then 'envelope_schema_id_missing' when 5 then 'schema_id_malformed'
                    when 6 then 'envelope_header_encoding_invalid' when 7 then 'envelope_format_unknown' end as error_code
        from msg m join type_ok t using (message_id)""",
    # routes and the bindings that cover them
    "routes": "select distinct broker_id, virtual_host, exchange, routing_key from message_base",
    "matches": """
        select r.*, b.contract, b.seq, b.precedence from routes r join publish_rows b
          on r.virtual_host = b.virtual_host and r.exchange = b.exchange and (b.broker_id is null or b.broker_id = r.broker_id)
          and case b.pattern when 'purchase.*' then regexp_matches(r.routing_key, '^purchase[.][^.]*$')
                when '#' then true when 'view.u1' then r.routing_key = 'view.u1'
                when '*.u2' then regexp_matches(r.routing_key, '^[^.]*[.]u2$')
                when 'click.#' then regexp_matches(r.routing_key, '^click([.].*)?$')
                else regexp_matches(r.routing_key, '^signup([.].*)?[.]u3$') end""",
    "best": """
        select * from (select *, row_number() over (partition by broker_id, exchange, routing_key, contract
                 order by coalesce(precedence, 0) desc, seq) as rn from matches) where rn = 1""",
    "route_refs": """
        select broker_id, virtual_host, exchange, routing_key, subject, selector, min(contract) as c0,
               arg_min(pos, (contract, pos)) as p0
        from best join publish_refs using (contract, seq) group by all""",
    "route_subjects": """
        select broker_id, virtual_host, exchange, routing_key, string_agg(subject || '@' || selector, ',' order by c0, p0) as subjects,
               count(*) as n, min(subject) as only_subject from route_refs group by all""",
    "route_modes": """
        select broker_id, virtual_host, exchange, routing_key, string_agg(contract, ',' order by contract) as contracts,
               max(enforcement) as enforcement, count(*) as n_contracts
        from best join contract_rows using (contract) group by all""",
    "governed_routes": """
        select m.*, coalesce(s.subjects, '') as subjects, coalesce(s.n, 0) as n, s.only_subject from route_modes m
        left join route_subjects s using (broker_id, virtual_host, exchange, routing_key)""",
    "first_ref": """
        select broker_id, exchange, routing_key, subject, arg_min(selector, (c0, p0)) as selector from route_refs group by all""",
    "queues": "select distinct broker_id, virtual_host, queue from message_base",
    "queue_best": """
        select * from (select q.*, b.contract, b.seq, row_number() over (partition by q.broker_id, q.queue, b.contract order by b.seq) as rn
          from queues q join consume_rows b on q.queue = b.queue and q.virtual_host = b.virtual_host
               and (b.broker_id is null or b.broker_id = q.broker_id)) where rn = 1""",
    "queue_refs": """
        select broker_id, virtual_host, queue, subject, selector, min(contract) as c0, arg_min(pos, (contract, pos)) as p0
        from queue_best join consume_refs using (contract, seq) group by all""",
    "governed_queues": """
        select m.*, coalesce(s.subjects, '') as subjects from
          (select broker_id, virtual_host, queue, string_agg(contract, ',' order by contract) as contracts, max(enforcement) as enforcement
           from queue_best join contract_rows using (contract) group by all) m
        left join (select broker_id, virtual_host, queue, string_agg(subject || '@' || selector, ',' order by c0, p0) as subjects
           from queue_refs group by all) s using (broker_id, virtual_host, queue)""",
    "queue_first": "select broker_id, queue, subject, arg_min(selector, (c0, p0)) as selector from queue_refs group by all",
    # is the body valid under the schema of an event type? null when the type has no schema
    "payloads": """
        select message_id, event_type,
               case when body_text is null or body_text = '{"k": ' then false
                    when body_text = '{"k":"x"}' then s_ok when body_text = '{}' then e_ok
                    else k_ok end as ok
        from (select m.message_id, e.event_type, m.body_text,
                     cast(e.event_type in ('click') as boolean) as s_ok, cast(e.event_type = 'view' as boolean) as e_ok,
                     case e.event_type when 'signup' then true when 'purchase' then k <= 60 when 'view' then k >= 20 else k % 2 = 0 end as k_ok
              from (select *, try_cast(regexp_extract(body_text, '^[{]"k": (-?[0-9]+)[}]$', 1) as bigint) as k from message_base) m
              cross join event_schemas e)""",
    "accepts": """
        select * from (values ('latest'), ('>=1'), ('2'), ('>=2')) s(selector)""",
    "published": """
        select m.message_id, m.ts, coalesce(g.enforcement, 2) as mode, r.subject_outcome, g.contracts,
               coalesce(r.resolved_subject, case when r.subject_outcome = 'absent' and g.n = 1 then g.only_subject end) as subject,
               g.n, m.broker_id, m.exchange, m.routing_key
        from message_base m join resolved r using (message_id)
        left join governed_routes g using (broker_id, virtual_host, exchange, routing_key)""",
    "publish_steps": """
        select p.*, f.selector, i.ordinal as tip, i.schema_id, y.ok,
          case when mode = 1 then 0 when subject_outcome = 'unusable' then 1
               when p.subject is null and p.contracts is null then 2 when p.subject is null then 3
               when p.contracts is not null and f.selector is null then 4 when i.ordinal is null then 5
               when f.selector is not null and not (f.selector = 'latest' or (f.selector = '>=1') or (f.selector = '2' and i.ordinal = 2)
                    or (f.selector = '>=2' and i.ordinal >= 2)) then 6
               when y.ok then 7 else 8 end as step
        from published p left join first_ref f using (broker_id, exchange, routing_key, subject)
        left join event_ids i on i.subject = p.subject
        left join payloads y on y.message_id = p.message_id and y.event_type = i.event_type""",
    "publish_result": """
        select message_id, ts, mode,
               case step when 1 then 'Observed' when 4 then 'Observed' when 6 then 'Observed' when 8 then 'Observed' when 7 then 'Valid' else 'Unenforced' end as outcome,
               case step when 1 then 'subject_name_invalid' when 2 then 'envelope_subject_unresolvable' when 3 then 'contract_subject_ambiguous'
                    when 4 then 'contract_subject_not_permitted' when 5 then 'subject_not_found' when 6 then 'contract_version_not_permitted'
                    when 8 then 'payload_invalid' end as code,
               case when step > 0 then subject end as judged_subject,
               case when step not in (0, 4) then schema_id end as judged_schema_id
        from publish_steps""",
    "consume_steps": """
        select d.*, coalesce(g.enforcement, 2) as mode, f.selector, t.ordinal as tip, i.event_type as schema_type, y.ok,
          case when coalesce(g.enforcement, 2) = 1 then 0 when error_code is not null then 1 when kind = 'none' then 2
               when g.enforcement is not null and d.subject is not null and f.selector is null then 3
               when g.enforcement is not null and d.subject is not null and d.ordinal is not null
                    and not (f.selector = 'latest' and t.ordinal is null)
                    and not case f.selector when 'latest' then d.ordinal = t.ordinal when '>=1' then d.ordinal >= 1
                                 when '2' then d.ordinal = 2 else d.ordinal >= 2 end then 4
               when i.event_type is null then 5 when d.format = 'avro' then 6 when y.ok then 7 else 8 end as step
        from decoded d left join governed_queues g using (broker_id, queue)
        left join queue_first f using (broker_id, queue, subject)
        left join event_ids t on t.subject = d.subject
        left join event_ids i on i.schema_id = d.schema_id
        left join payloads y on y.message_id = d.message_id and y.event_type = i.event_type""",
    "consume_result": """
        select message_id, ts, mode,
               case when step in (0, 2, 5) then 'Unenforced' when step = 7 then 'Valid' else 'Observed' end as outcome,
               case step when 1 then error_code when 3 then 'contract_subject_not_permitted' when 4 then 'contract_version_not_permitted'
                    when 5 then 'schema_unresolvable' when 6 then 'envelope_format_mismatch' when 8 then 'payload_invalid' end as code,
               case when step > 0 then subject end as judged_subject, case when step > 0 then schema_id end as judged_schema_id
        from consume_steps""",
    "line_findings": """
        with d as (select *, o_orderkey % 53 = 0 as broken, o_orderkey % 7 = 0 and o_orderkey % 5 <> 0 as late from line_docs)
        select doc_id, subject as schema_id, '#' as path, 'malformed_json' as kind from d where broken
        union all select doc_id, subject, '#/order/priority', 'PropertyRequired' from d where not broken and o_orderkey % 3 <> 0
        union all select doc_id, subject, '#/order/status', 'EnumNotMatched' from d where not broken and o_orderstatus not in ('F', 'O')
        union all select doc_id, subject, '#/order/total', 'NumberTooBig' from d where not broken and total > 200000
        union all select doc_id, subject, '#/line/disc', 'NumberTooSmall' from d where not broken and disc < 0.01
        union all select doc_id, subject, '#/line/n', 'NumberNotMultipleOf' from d where not broken and l_linenumber % 2 <> 0
        union all select doc_id, subject, '#/line/qty', 'NumberTooBig' from d where not broken and qty > 45
        union all select doc_id, subject, '#/line/ship', 'PatternMismatch' from d where not broken and not regexp_matches(ship, '^199[2-7]')
        union all select doc_id, subject, '#/flags/0', 'EnumNotMatched' from d where not broken and l_returnflag not in ('N', 'O', 'F')
        union all select doc_id, subject, '#/flags/1', 'EnumNotMatched' from d where not broken and l_linestatus not in ('N', 'O', 'F')
        union all select doc_id, subject, '#/flags', 'ArrayItemNotUnique' from d where not broken and l_returnflag = l_linestatus
        union all select doc_id, subject, '#/note', 'StringTooShort' from d where not broken and late
        union all select doc_id, subject, '#/gift', 'ConstNotMatched' from d where not broken and l_linenumber % 2 = 0""",
    # every node of the line documents: kind o, a, s, n, t, f or z for null; val is a string's text
    "line_nodes": """
        with d as (select * from line_docs where o_orderkey % 53 <> 0)
        select subject, '#' as schema_path, 'o' as kind, null as val, false as whole, false as filled from d
        union all select subject, '#/properties/order', 'o', null, false, false from d
        union all select subject, '#/properties/order/properties/id', 'n', null, true, false from d
        union all select subject, '#/properties/order/properties/status', 's', o_orderstatus, false, false from d
        union all select subject, '#/properties/order/properties/total', 'n', null, false, false from d
        union all select subject, '#/properties/order/properties/priority', 's', o_orderpriority, false, false from d where o_orderkey % 3 = 0
        union all select subject, '#/properties/line', 'o', null, false, false from d
        union all select subject, '#/properties/line/properties/n', 'n', null, true, false from d
        union all select subject, '#/properties/line/properties/qty', 'n', null, true, false from d
        union all select subject, '#/properties/line/properties/disc', 'n', null, false, false from d
        union all select subject, '#/properties/line/properties/ship', 's', ship, false, false from d
        union all select subject, '#/properties/flags', 'a', null, false, true from d
        union all select subject, '#/properties/flags/items', 's', l_returnflag, false, false from d
        union all select subject, '#/properties/flags/items', 's', l_linestatus, false, false from d
        union all select subject, '#/properties/note', case when o_orderkey % 7 = 0 and o_orderkey % 5 <> 0 then 's' else 'z' end,
                         case when o_orderkey % 7 = 0 and o_orderkey % 5 <> 0 then 'late' end, false, false from d
        union all select subject, '#/properties/gift', case when l_linenumber % 2 = 0 then 't' else 'f' end, null, false, false from d""",
    "chat_nodes": """
        select subject, '#' as schema_path, 'o' as kind, null as val, false as whole, false as filled from chat_docs
        union all select subject, '#/properties/role', 's', role, false, false from chat_docs where role is not null
        union all select subject, '#/properties/text', 's', text, false, false from chat_docs where text is not null
        union all select subject, '#/properties/turn', 'n', null, true, false from chat_docs where turn is not null""",
    "line_stats": "{stats:line_nodes}",
    "line_types": """
        select s.*, case schema_path when '#' then null when '#/properties/flags/items' then '#/properties/flags'
                 else regexp_replace(schema_path, '/properties/[^/]*$', '') end as parent_path,
               schema_path not in ('#', '#/properties/flags/items') as member,
               (n_true > 0)::int + (n_false > 0)::int + (n_string > 0)::int + (n_number > 0)::int + (n_object > 0)::int + (n_array > 0)::int as n_kinds
        from line_stats s""",
    "line_full": """
        select t.*, p.occurrences as parent_occurrences,
               case when n_string > 0 and not truncated and all_date then 'date' end as format
        from line_types t left join (select subject, schema_path as parent_path, occurrences from line_stats) p using (subject, parent_path)
        left join (select subject, schema_path, bool_and(regexp_matches(val, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) as all_date
                   from line_nodes where kind = 's' group by all) f using (subject, schema_path)""",
    "line_enums": """
        select subject, schema_path, case when count(distinct val) between 2 and 12 and count(*) >= 10 and count(*) >= 3 * count(distinct val)
                 then ',"enum":["' || string_agg(distinct val, '","' order by val) || '"]' else '' end as listed
        from line_nodes where kind = 's' group by all""",
    "line_texts": """
        select subject,
               max(case when schema_path = '#' then occurrences end) as n,
               max(case when schema_path = '#/properties/flags/items' then listed end) as flags,
               max(case when schema_path = '#/properties/order/properties/priority' then listed end) as priority,
               max(case when schema_path = '#/properties/order/properties/status' then listed end) as status,
               max(case when schema_path = '#/properties/line/properties/ship' then
                     case when format is null then listed else ',"format":"' || format || '"' end end) as ship,
               max(case when schema_path = '#/properties/gift' then case when n_kinds = 1 then '{"type":"boolean"}' else '{}' end end) as gift,
               max(case when schema_path = '#/properties/note' then case when n_string = 0 then '{}' when n_null = 0 then '{"type":"string"}'
                     else '{"type":["string","null"]}' end end) as note
        from line_full left join line_enums using (subject, schema_path) group by subject""",
    # policies
    "policies": """
        select environment_id, subject, content_model,
               case when s.mode is not null then s.mode when default_mode is not null then default_mode else 'BACKWARD' end as mode,
               case when s.mode is not null then s.surface when default_mode is not null then default_surface else 2 end as surface
        from subject_rows s join environment_rows using (environment_id)""",
    "tips": """
        select r.environment_id, r.subject, r.ordinal, r.schema_id, r.body from reg r join subject_rows s
          on s.environment_id = r.environment_id and s.subject = r.subject and s.latest_ordinal = r.ordinal""",
    # one row of rule columns per schema, for comparing pairs of schemas
    "rule": """
        select distinct schema_id, q_max, tax_required, flag_a, flag_n, flag_r, disc_integer, ship_date, closed from reg""",
    "proposals": """
        select distinct r.environment_id, r.subject, r.schema_id, p.mode, p.surface from reg r join policies p using (environment_id, subject)
        where status = 'AwaitingApproval'""",
    "active": "select environment_id, subject, ordinal, schema_id from reg where status = 'Active'",
    "prior_pairs": """
        select q.environment_id, q.subject, q.schema_id as next_id, a.schema_id as prev_id, a.ordinal, q.mode, q.surface
        from proposals q join active a using (environment_id, subject)
        join (select environment_id, subject, max(ordinal) as tip from active group by all) t using (environment_id, subject)
        where mode <> 'NONE' and (mode like '%TRANSITIVE' or a.ordinal = tip)""",
    "prior_findings": """
        select p.*, f.path, f.kind, f.direction, f.surface as found, f.member from prior_pairs p
        join (select distinct prev_id, next_id from prior_pairs) using (prev_id, next_id)
        join ({findings:select distinct prev_id, next_id from prior_pairs}) f using (prev_id, next_id)
        where (mode like 'BACKWARD%' and direction = 'Backward') or (mode like 'FORWARD%' and direction = 'Forward') or mode like 'FULL%'""",
    "verdicts": """
        select q.environment_id, q.subject, q.schema_id, q.mode, q.surface, coalesce(n.compared, 0) as compared,
               coalesce(f.divergences, 0) as divergences, coalesce(f.violations, 0) as violations,
               coalesce(f.violations, 0) = 0 as compatible,
               case when coalesce(n.compared, 0) = 0 then 'None' when coalesce(f.violations, 0) > 0 then 'Major'
                    when coalesce(f.divergences, 0) > 0 then 'Minor' else 'Patch' end as bump
        from proposals q
        left join (select environment_id, subject, next_id as schema_id, count(*) as compared from prior_pairs group by all) n using (environment_id, subject, schema_id)
        left join (select environment_id, subject, next_id as schema_id, count(*) as divergences, count(*) filter (found <= surface) as violations
                   from prior_findings group by all) f using (environment_id, subject, schema_id)""",
    # every version against the versions its mode looks at
    "audit_pairs": """
        select v.environment_id, v.subject, v.ordinal, v.schema_id as next_id, p.mode, p.surface, a.ordinal as prior, a.schema_id as prev_id,
               max(a.ordinal) over (partition by v.environment_id, v.subject, v.ordinal) as tip
        from reg v join policies p using (environment_id, subject)
        join active a on a.environment_id = v.environment_id and a.subject = v.subject and a.ordinal < v.ordinal
        where p.mode <> 'NONE'""",
    "audit_used": "select * from audit_pairs where mode like '%TRANSITIVE' or prior = tip",
    "audit_findings": """
        select u.environment_id, u.subject, u.ordinal, u.prior, u.surface, f.surface as found from audit_used u
        join ({findings:select distinct prev_id, next_id from audit_used}) f using (prev_id, next_id)
        where (mode like 'BACKWARD%' and direction = 'Backward') or (mode like 'FORWARD%' and direction = 'Forward') or mode like 'FULL%'""",
    "version_audit": """
        select v.environment_id, v.subject, v.ordinal, v.schema_id, p.mode, coalesce(f.bad, 0) = 0 as compatible,
               case when p.mode = 'NONE' or n.k is null then 'None' when coalesce(f.bad, 0) > 0 then 'Major'
                    when f.bad is not null then 'Minor' else 'Patch' end as bump, f.conflicts_with
        from reg v join policies p using (environment_id, subject)
        left join (select environment_id, subject, ordinal, count(*) as k from audit_used group by all) n using (environment_id, subject, ordinal)
        left join (select environment_id, subject, ordinal, count(*) filter (found <= surface) as bad,
                          min(prior) filter (found <= surface) as conflicts_with from audit_findings group by all) f
          using (environment_id, subject, ordinal)""",
    "labels_parsed": """
        select environment_id, subject, ordinal, semver, status, cast(split_part(semver, '.', 1) as int) as major,
               cast(split_part(semver, '.', 1) as int) * 1000000 + cast(split_part(semver, '.', 2) as int) * 10
               + case when semver like '%-rc.1' then 0 else 1 end as k
        from reg where semver is not null""",
    "uses": """
        select environment_id, service, case when produces then 'produces' else 'consumes' end as role, subject, selector from service_uses""",
    "impacts": """
        select t.environment_id, t.subject, t.schema_id as candidate_id, u.service, u.selector,
               case u.selector when 'latest' then t.ordinal when '>=2' then 2 else 1 end as reader_ordinal,
               case when u.selector = 'latest' then 'FollowsLatest' when r.schema_id is null then 'Unresolvable' else 'Checked' end as certainty,
               u.selector <> 'latest' and coalesce(f.n, 0) > 0 as breaks,
               case when u.selector = 'latest' then 0 else coalesce(f.n, 0) end as reasons,
               timestamp '1998-09-01 00:00:00' - interval 30 days > s.last_seen_at as stale
        from tips t join uses u on u.environment_id = t.environment_id and u.subject = t.subject and u.role = 'consumes'
        left join service_seen s on s.environment_id = u.environment_id and s.service = u.service
        join policies p on p.environment_id = t.environment_id and p.subject = t.subject
        left join reg r on r.environment_id = t.environment_id and r.subject = t.subject and u.selector <> 'latest'
             and r.ordinal = case u.selector when '>=2' then 2 else 1 end
        left join (select prev_id, next_id, surf, count(*) as n from
             ({findings:select distinct r.schema_id as prev_id, t.schema_id as next_id from tips t join reg r using (environment_id, subject) where r.ordinal in (1, 2)}) f
             cross join (values (1), (2), (3)) x(surf) where direction = 'Forward' and f.surface <= surf group by all) f
          on f.prev_id = r.schema_id and f.next_id = t.schema_id and f.surf = p.surface""",
    "cleaned": """
        select seq, ts, environment_id, upper(trim(side)) as side, trim(route) as route, subject, code,
               nullif(trim(detail), '') as detail, reported_by, occurrences,
               environment_id || '|' || case upper(trim(side)) when 'PUBLISH' then '1' else '2' end || '|' || trim(route) || '|' ||
               coalesce(subject, '-') || '|' || code as fingerprint,
               upper(trim(side)) in ('PUBLISH', 'CONSUME') and trim(route) <> '' and code <> '' as usable
        from violation_reports""",
    "opened": "select fingerprint, min((ts, seq)) as o from cleaned where usable and occurrences >= 1 group by all",
    "rolled": """
        select fingerprint, environment_id, side, route, subject, code, min(ts) as first_seen_at, max(ts) as last_seen_at,
               cast(sum(greatest(occurrences, 0)) as bigint) as occurrences,
               coalesce(arg_max(detail, (ts, seq)) filter (detail is not null), '') as detail,
               coalesce(arg_max(reported_by, (ts, seq)) filter (reported_by is not null), 'unknown') as reported_by
        from cleaned join opened using (fingerprint) where usable and (ts, seq) >= o group by all""",
    "tenant_subjects": "select tenant_id, environment_id, subject from subject_rows",
    "usage": """
        select tenant_id, coalesce(e, 0) as environments, coalesce(s, 0) as subjects, coalesce(m, 0) as seats, coalesce(v, 0) as versions_per_month
        from (select tenant_id, count(distinct environment_id) as e, count(*) as s from tenant_subjects group by all)
        full join (select 't' || (c_custkey % 25) as tenant_id, count(*) as m from customer group by all) using (tenant_id)
        full join (select tenant_id, count(*) as v from reg join tenant_subjects using (environment_id, subject)
                   where registered_at >= timestamp '1997-06-01' group by all) using (tenant_id)""",
    "flush_keys": """
        select time_bucket(interval 30 days, ts, timestamp '1970-01-01') as window_start, coalesce(reported_by, 'unknown') as reporter, side, route, subject, code,
               detail || (seq % 997) as detail, count(*) as n, min((ts, seq)) as first
        from violation_reports group by all""",
    "flush_ranked": "select *, row_number() over (partition by window_start, reporter order by first) as rk from flush_keys",
}

_STATS = """
    select subject, schema_path, count(*) as occurrences, count(*) filter (kind = 'z') as n_null, count(*) filter (kind = 't') as n_true,
           count(*) filter (kind = 'f') as n_false, count(*) filter (kind = 's') as n_string, count(*) filter (kind = 'n') as n_number,
           count(*) filter (kind = 'n' and whole) as n_int64, count(*) filter (kind = 'o') as n_object, count(*) filter (kind = 'a') as n_array,
           bool_or(kind = 'a' and filled) as non_empty, count(distinct val) filter (kind = 's') as distinct_strings,
           false as truncated
    from {0} group by subject, schema_path"""

# Divergences between two schemas of version rules; pairs are given as (prev_id, next_id).
_CHANGES = [
    ("b.disc_integer and not a.disc_integer", "#/properties/disc", "integer_widened_to_number", "Backward", 3, None),
    ("not b.disc_integer and a.disc_integer", "#/properties/disc", "type_narrowed", "Backward", 2, None),
    ("not b.disc_integer and a.disc_integer", "#/properties/disc", "type_widened", "Forward", 2, None),
    ("b.flag_a > a.flag_a or b.flag_n > a.flag_n or b.flag_r > a.flag_r", "#/properties/flag", "enum_value_removed", "Backward", 2, None),
    ("a.flag_a > b.flag_a or a.flag_n > b.flag_n or a.flag_r > b.flag_r", "#/properties/flag", "enum_value_added", "Forward", 2, None),
    ("a.q_max < b.q_max", "#/properties/q/maximum", "numeric_range_narrowed", "Backward", 2, None),
    ("a.q_max > b.q_max", "#/properties/q/maximum", "numeric_range_widened", "Forward", 2, None),
    ("a.ship_date <> b.ship_date", "#/properties/ship/format", "format_changed", "Backward", 3, None),
    ("a.tax_required and not b.tax_required", "#/required", "required_field_added", "Backward", 2, "tax"),
    ("b.tax_required and not a.tax_required", "#/required", "required_field_removed", "Forward", 2, "tax"),
    ("a.closed and not b.closed", "#/additionalProperties", "additional_properties_closed", "Backward", 2, None),
    ("b.closed and not a.closed", "#/additionalProperties", "additional_properties_opened", "Forward", 2, None),
]


def findings(pairs: str) -> str:
    rows = " union all ".join(
        f"select prev_id, next_id, '{path}' as path, '{kind}' as kind, '{way}' as direction, {surface} as surface, "
        + (f"'{member}'" if member else "cast(null as varchar)")
        + f" as member from ({pairs}) x join rule b on b.schema_id = prev_id join rule a on a.schema_id = next_id where {test}"
        for test, path, kind, way, surface, member in _CHANGES
    )
    return rows


def _expand(text: str) -> str:
    while "{stats:" in text or "{findings:" in text:
        for tag, fill in (("{stats:", _STATS.format), ("{findings:", findings)):
            if tag in text:
                head, rest = text.split(tag, 1)
                arg, tail = rest.split("}", 1)
                text = head + fill(arg) + tail
    return text


def _needs(text: str, known: dict[str, str]) -> list[str]:
    words = text
    for ch in "(),.;":
        words = words.replace(ch, " ")
    present = set(words.split())
    return [name for name in known if name in present]


def oracle(name: str, text: str) -> None:
    """Register a query with the views it needs in front of it."""
    views = {**{k: v for k, v in SHARED.items()}, **{k: _expand(v) for k, v in LOCAL.items()}}
    text = _expand(text)
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in _needs(views[n], views):
            if m != n:
                visit(m)
        order.append(n)

    for n in _needs(text, views):
        visit(n)
    with_part = ",\n".join(f"{n} as materialized ({views[n]})" for n in order)
    ORACLES[name] = f"with {with_part}\n{text}" if order else text


# --- sources --------------------------------------------------------------------------------------
oracle("a1_read_messages", "select conv_id, turn, role, text from conversations")
oracle(
    "a2_contract_files",
    """select path, case when bad then null else replace(regexp_extract(path, '([^/]+)$', 1), ext, '') end as subject,
              case when bad then null when ext = '.json' then 'json' when ext = '.AVSC' then 'avro' else 'protobuf' end as format,
              case when bad then 'subject_name_invalid' end as error_code
       from (select path, regexp_extract(path, '([.][a-zA-Z]+)$', 1) as ext, path like '%bad-name%' as bad from contract_file_rows) x
       where ext <> '.txt'
       union all select min(path), null, null, 'subject_defined_twice'
       from (select path, replace(regexp_extract(path, '([^/]+)$', 1), regexp_extract(path, '([.][a-zA-Z]+)$', 1), '') as subject
             from contract_file_rows where path not like '%.txt' and path not like '%bad-name%') y group by subject having count(*) > 1""",
)
oracle("a3_export_latest", "select environment_id, subject, ordinal, schema_id, body from tips")
oracle("a3_export_skipped", "select environment_id, subject from subject_rows where latest_ordinal is null")
oracle(
    "a4_sample_queue",
    """select properties_type as type, count(*) as inspected, count(body_text) as sampled
       from (select * from message_base where queue = 'q.view' order by ts, message_id limit 500) x group by all""",
)
# --- decoding -------------------------------------------------------------------------------------
oracle(
    "b1_decode_envelopes",
    "select message_id, kind, schema_id, subject, ordinal, semver, format, warnings, error_code from decoded",
)
oracle(
    "b2_envelope_report",
    """select exchange, date_trunc('hour', ts) as hour, kind, error_code, nullif(warning, '') as warning, count(*) as messages
       from (select exchange, ts, kind, error_code, unnest(string_split(warnings, ',')) as warning from decoded) x group by all""",
)
oracle(
    "b3_stamp_envelopes",
    """select message_id,
              case when sid0 is null then case when h in (0, 11) then null when h in (1, 2, 3, 4) then 1 when h in (5, 6) then 2 when h = 7 then 3
                     when h = 8 then 5 when h = 9 then 4 when h = 10 then 6 else 5 end
                   else case when h = 1 then 6 when h in (8, 10) then 6 else 5 end end as n_headers,
              case when sid0 is null then case when h = 5 then 'ABC' when h in (7, 8, 9, 10, 12) then sid end else sid0 end as schema_id,
              case when sid0 is null then case when h = 8 then ' ' || own_subject when h = 9 then 'acme.other' when h in (10, 12) then own_subject end else own_subject end as subject,
              case when sid0 is null then case when h = 8 then 'x' when h = 10 then '2' when h = 12 then '1' end
                   else cast(e.ordinal as varchar) end as ordinal,
              case when h = 1 then 'abc' end as trace
       from msg left join (select event_type as et, ordinal from event_schemas) e on e.et = event_type
       where not (sid0 is null and h = 6)
       union all select message_id, 2, null, null, null, null from msg where sid0 is null and h = 6""",
)
oracle("b4_resolve_subjects", "select message_id, subject_outcome, resolved_subject from resolved")
oracle(
    "b5_subject_inventory",
    """select resolved_subject as subject, subject_outcome, count(*) as messages, min(ts) as first_seen, max(ts) as last_seen,
              count(distinct exchange) as exchanges, round(count(*) / (select count(*) from message_base), 6) as share
       from resolved join message_base using (message_id) group by all""",
)
# --- contracts ------------------------------------------------------------------------------------
oracle("c1_topic_match_join", "select broker_id, virtual_host, exchange, routing_key, contract, seq from matches")
oracle(
    "c2_resolve_publish",
    "select broker_id, virtual_host, exchange, routing_key, contracts, enforcement, subjects from governed_routes",
)
oracle("c3_resolve_consume", "select broker_id, virtual_host, queue, contracts, enforcement, subjects from governed_queues")
oracle(
    "c4_route_ambiguity",
    """select count(*) as routes, count(n_contracts) as governed, count(*) filter (n_contracts > 1) as ambiguous,
              count(*) - count(n_contracts) as ungoverned
       from routes left join route_modes using (broker_id, virtual_host, exchange, routing_key)""",
)
_SIDE = """select b.*, g.sig from {0}_rows b join (select contract, seq, string_agg(subject || '@' || selector, ',' order by subject, selector) as sig
              from {0}_refs group by all) g using (contract, seq)"""
oracle(
    "c5_binding_conflicts",
    f"""select b.contract, 'publish' as side, b.virtual_host, b.exchange as address, b.seq, min(a.seq) as clashes_with
        from ({_SIDE.format('publish')}) a join ({_SIDE.format('publish')}) b on a.contract = b.contract and a.exchange = b.exchange and a.seq < b.seq and a.sig <> b.sig
        where (a.broker_id is null or b.broker_id is null or a.broker_id = b.broker_id)
          and not (a.precedence is not null and b.precedence is not null and a.precedence <> b.precedence)
          and (a.pattern = b.pattern or '#' in (a.pattern, b.pattern)
               or ('*.u2' in (a.pattern, b.pattern) and ('purchase.*' in (a.pattern, b.pattern) or 'click.#' in (a.pattern, b.pattern))))
        group by all
        union all
        select b.contract, 'consume', b.virtual_host, b.queue, b.seq, min(a.seq)
        from ({_SIDE.format('consume')}) a join ({_SIDE.format('consume')}) b on a.contract = b.contract and a.queue = b.queue and a.seq < b.seq and a.sig <> b.sig
        where a.broker_id is null or b.broker_id is null or a.broker_id = b.broker_id group by all""",
)
oracle("c6_publish_conformance", "select message_id, outcome, code, mode, judged_subject, judged_schema_id from publish_result")
oracle("c7_consume_conformance", "select message_id, outcome, code, mode, judged_subject, judged_schema_id from consume_result")
oracle(
    "c8_selector_filter",
    """select contract, seq, pos, cast(o.ordinal as int) as ordinal from publish_refs join event_schemas e using (subject)
       cross join lateral (select unnest(generate_series(1, e.ordinal + 1)) as ordinal) o
       where case selector when 'latest' then o.ordinal = e.ordinal when '2' then o.ordinal = 2 when '>=1' then true else o.ordinal >= 2 end""",
)
oracle(
    "c9_quarantine_split",
    """select message_id, case when outcome = 'Observed' and mode = 3 then 'quarantine' else 'pass' end as side,
              case when outcome = 'Observed' and mode = 3 then code end as reason from consume_result""",
)
# --- validation and inference ---------------------------------------------------------------------
oracle("d1_validate_payloads", "select * from line_findings")
oracle(
    "d2_violation_hotspots",
    """select schema_id, path, kind, count(distinct doc_id) as messages, count(*) as findings
       from (select doc_id, schema_id, replace(replace(path, '/0', '/*'), '/1', '/*') as path, kind from line_findings) x group by all""",
)
_STAT_COLUMNS = "subject, schema_path, occurrences, n_null, n_true, n_false, n_string, n_number, n_int64, n_object, n_array, non_empty, distinct_strings, truncated"
oracle("d3_infer_path_stats", f"select {_STAT_COLUMNS} from line_stats")
oracle("d3_infer_chat_stats", f"select {_STAT_COLUMNS} from ({{stats:chat_nodes}}) x")
oracle(
    "d5_infer_findings",
    """select * from (
       select subject, schema_path as path, 3 as confidence, 'thin_evidence' as kind from line_full where schema_path = '#' and occurrences < 10
       union all select subject, schema_path, 3, 'always_null' from line_full where n_kinds = 0
       union all select subject, schema_path, 3, 'mixed_types' from line_full where n_kinds > 1
       union all select subject, schema_path, case when n_number >= 10 then 2 else 3 end, 'integer_from_whole_numbers' from line_full
                 where n_kinds = 1 and n_number > 0 and n_number = n_int64
       union all select subject, schema_path, case when n_kinds = 0 or parent_occurrences < 10 then 3 else 2 end, 'required_from_presence' from line_full
                 where member and occurrences = parent_occurrences
       union all select subject, schema_path, 1, 'optional_from_absence' from line_full where member and occurrences <> parent_occurrences
       union all select subject, schema_path, case when n_string >= 10 then 2 else 3 end, 'format_from_pattern' from line_full where n_kinds = 1 and format is not null
       union all select subject, schema_path, 2, 'constant_value' from line_full where n_kinds = 1 and format is null and not truncated and distinct_strings = 1 and n_string > 1
       union all select subject, schema_path, 3, 'enum_from_low_cardinality' from line_full where n_kinds = 1 and format is null and not truncated
                 and distinct_strings between 2 and 12 and n_string >= 10 and n_string >= 3 * distinct_strings) x""",
)
oracle(
    "d4_infer_schema",
    """select subject, n as sample_count, '{"type":"object","properties":{"flags":{"type":"array","items":{"type":"string"' || flags || '}},"gift":' || gift ||
              ',"line":{"type":"object","properties":{"disc":{"type":"number"},"n":{"type":"integer"},"qty":{"type":"integer"},"ship":{"type":"string"' || ship ||
              '}},"required":["disc","n","qty","ship"]},"note":' || note || ',"order":{"type":"object","properties":{"id":{"type":"integer"},"priority":{"type":"string"' ||
              priority || '},"status":{"type":"string"' || status || '},"total":{"type":"number"}},"required":["id","status","total"]}},"required":["flags","gift","line","note","order"]}' as body
       from line_texts""",
)
oracle("d6_detect_string_format", "select subject, schema_path, n_string, format from line_full where n_string > 0")
# --- catalog --------------------------------------------------------------------------------------
_AUTHORED = """select environment_id, subject, ordinal, body, plain,
    case when ordinal % 5 = 0 then null when ordinal % 7 = 0 then 'schema_malformed' when ordinal % 11 = 0 then 'schema_body_empty'
         when ordinal % 13 = 0 then 'schema_malformed' end as error_code from authored_rows"""
oracle(
    "e1_catalog_canonical_audit",
    f"select environment_id, subject, ordinal, case when error_code is null then plain end as canonical, error_code from ({_AUTHORED}) x",
)
oracle("e2_schema_ids", "select environment_id, subject, ordinal, schema_id from reg")
oracle(
    "e3_dedupe_catalog",
    f"""select r.schema_id, 'json' as format, r.body as canonical, count(*) as documents, count(distinct a.body) as spellings
        from ({_AUTHORED}) a join reg r using (environment_id, subject, ordinal) where error_code is null group by all""",
)
oracle("e4_schema_usages", "select distinct schema_id, environment_id, subject, ordinal from reg")
oracle("e4_reachable_schemas", "select distinct schema_id, body from reg where environment_id = 'ASIA'")
oracle("e5_extract_references", "select distinct 's' || k as schema_id, target as subject, 1 as version from part_refs")
oracle(
    "e5_reference_errors",
    "select schema_id, 'reference_invalid' as error_code from lint_rows where k % 3 = 0",
)
_REACH = """recursive_reach as (
    select k as start, t as node from part_refs where t in (select p_partkey from part)
    union select r.start, e.t from recursive_reach r join part_refs e on e.k = r.node where e.t in (select p_partkey from part))"""


def recursive(name: str, text: str) -> None:
    oracle(name, text.replace("recursive_reach", "part_refs /*reach*/"))
    body = ORACLES[name].replace("part_refs /*reach*/", "recursive_reach")
    head, tail = body.rsplit("\nselect", 1)
    ORACLES[name] = "with recursive" + head[len("with"):] + ",\n" + _REACH + "\nselect" + tail


recursive(
    "e6_transitive_referrers",
    "select distinct 's' || node as target, 's' || start as referrer from recursive_reach",
)
recursive("e6_referrer_counts", "select 's' || node as target, count(distinct start) as referrers from recursive_reach group by node")
oracle(
    "e7_reference_cycles",
    """select 's' || k || '>' || 's' || k as path, 1 as length from part_links l where k = t
       union all select least('s' || k, 's' || (2 * k)) || '>' || greatest('s' || k, 's' || (2 * k)) || '>' || least('s' || k, 's' || (2 * k)), 2
         from part_links where t = 2 * k and t in (select p_partkey from part) and k % 100 = 7
       union all select case when a <= b and a <= c then a || '>' || b || '>' || c || '>' || a
                             when b <= a and b <= c then b || '>' || c || '>' || a || '>' || b
                             else c || '>' || a || '>' || b || '>' || c end, 3
         from (select 's' || k as a, 's' || (4 * k) as b, 's' || (2 * k) as c from part_links where t = 4 * k and k % 100 = 9 and t in (select p_partkey from part)) x""",
)
oracle(
    "e8_portability_lint",
    """select schema_id, '#/$schema' as path, 'dialect_unsupported' as kind, 'error' as severity from lint_rows where k % 6 = 0
       union all select schema_id, '#/properties/a/oneOf', 'keyword_not_compared', 'warning' from lint_rows where k % 6 = 1
       union all select schema_id, '#/properties/p/pattern', 'regex_not_portable', 'warning' from lint_rows where k % 6 = 2
       union all select schema_id, '#/patternProperties', 'keyword_not_compared', 'warning' from lint_rows where k % 6 = 4
       union all select schema_id, '#/patternProperties/^a(?!b)', 'regex_not_portable', 'warning' from lint_rows where k % 6 = 4""",
)
oracle(
    "e10_latest_snapshot",
    """select s.environment_id, s.subject, s.latest_ordinal as ordinal, r.schema_id, r.semver from subject_rows s
       left join reg r on r.environment_id = s.environment_id and r.subject = s.subject and r.ordinal = s.latest_ordinal
       where lifecycle <> 'Retired'""",
)
recursive(
    "e10_needed_schemas",
    "select distinct 's' || x as schema_id from (select p_partkey as x from part where p_partkey % 2 = 1 union select node from recursive_reach where start % 2 = 1) y",
)
oracle(
    "e11_contract_drift",
    """select subject, list_extract(c, 1).p as path, list_extract(c, 1).w as change, cast(len(c) as bigint) as differences from (
         select l.subject, list_filter([
             {'p': '#/additionalProperties', 'w': case when not a.closed and b.closed then 'only_right' when a.closed and not b.closed then 'only_left' end},
             {'p': '#/properties/disc/type', 'w': case when a.disc_integer <> b.disc_integer then 'differs' end},
             {'p': '#/properties/flag/enum', 'w': case when (a.flag_a, a.flag_n, a.flag_r) <> (b.flag_a, b.flag_n, b.flag_r) then 'differs' end},
             {'p': '#/properties/q/maximum', 'w': case when a.q_max <> b.q_max then 'differs' end},
             {'p': '#/properties/ship/format', 'w': case when not a.ship_date and b.ship_date then 'only_right' when a.ship_date and not b.ship_date then 'only_left' end},
             {'p': '#/required', 'w': case when a.tax_required <> b.tax_required then 'differs' end}], lambda x: x.w is not null) as c
         from tips l join tips r on l.subject = r.subject and l.environment_id = 'ASIA' and r.environment_id = 'EUROPE'
         join rule a on a.schema_id = l.schema_id join rule b on b.schema_id = r.schema_id) z where len(c) > 0""",
)
oracle(
    "e12_duplicate_subjects",
    """select subject, count(*) as sources, min(path) as first_source from
         (select distinct path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '[.][a-zA-Z]+$', '') as subject from contract_file_rows
          where path not like '%bad-name%' and path not like '%.txt') x
       group by all having count(*) > 1""",
)
# --- compatibility --------------------------------------------------------------------------------
oracle(
    "f1_json_schema_diff",
    """{findings:select distinct b.schema_id as prev_id, a.schema_id as next_id from reg b join reg a on a.environment_id = b.environment_id and a.subject = b.subject and a.ordinal = b.ordinal + 1}""",
)
_SHAPED = "from shape_pairs x join shapes b on b.schema_id = prev_id join shapes f on f.schema_id = next_id where"


def shaped(rows: list[tuple]) -> str:
    """Divergences of shape pairs: b is before, f after."""
    return " union all ".join(
        f"select prev_id, next_id, '{path}' as path, '{kind}' as kind, '{way}' as direction, {surface} as surface {_SHAPED} {test}"
        for test, path, kind, ways, surface in rows for way in ways
    )


_TWO = ("Backward", "Forward")
oracle("f2_avro_diff", shaped([
    ("b.whole and not f.whole", "#/fields/q", "type_promoted", _TWO[:1], 3),
    ("b.whole and not f.whole", "#/fields/q", "type_widened", _TWO[1:], 1),
    ("f.whole and not b.whole", "#/fields/q", "type_narrowed", _TWO[:1], 1),
    ("f.whole and not b.whole", "#/fields/q", "type_promoted", _TWO[1:], 3),
    ("((b.a and not f.a) or (b.n and not f.n) or (b.r and not f.r))", "#/fields/flag", "enum_value_removed", _TWO[:1], 1),
    ("((f.a and not b.a) or (f.n and not b.n) or (f.r and not b.r))", "#/fields/flag", "enum_value_added", _TWO[1:], 1),
    ("b.ship <> f.ship", "#/fields/ship", "fixed_size_changed", _TWO, 1),
    ("f.tax and not b.tax", "#/fields/tax", "required_field_added", _TWO[:1], 1),
    ("b.tax and not f.tax", "#/fields/tax", "required_field_removed", _TWO[1:], 1),
]))
oracle("f3_protobuf_diff", shaped([
    ("b.whole <> f.whole", "Line/1", "type_promoted", _TWO, 2),
    ("b.tax and not f.tax and not f.closed", "Line/2", "field_removed_without_reserved", _TWO[:1], 1),
    ("f.tax and not b.tax and b.closed", "Line/2", "field_number_reused", _TWO[:1], 1),
    ("b.ship <> f.ship", "Line/3", "type_promoted", _TWO, 2),
    ("b.a and not f.a", "Flag/1", "enum_value_removed", _TWO[:1], 2),
    ("b.n and not f.n", "Flag/2", "enum_value_removed", _TWO[:1], 2),
    ("b.r and not f.r", "Flag/3", "enum_value_removed", _TWO[:1], 2),
    ("f.a and not b.a", "Flag/1", "enum_value_added", _TWO[1:], 2),
    ("f.n and not b.n", "Flag/2", "enum_value_added", _TWO[1:], 2),
    ("f.r and not b.r", "Flag/3", "enum_value_added", _TWO[1:], 2),
]))
oracle(
    "e5_unsupported_references",
    """select distinct 's' || p_partkey as schema_id, 'acme.X' || p_size as reference, 'schema_references_unsupported' as error_code from part
       union select schema_id, path, 'schema_references_unsupported' from import_rows where path like 'acme%'""",
)
oracle("f4_compatibility_check", "select * from verdicts")
oracle(
    "f4_compatibility_changes",
    """select environment_id, subject, next_id as schema_id, ordinal as conflicts_with, path, kind, direction, found as surface, member,
              found <= surface as violation from prior_findings""",
)
oracle("f5_compatibility_audit", "select * from version_audit")
oracle(
    "f6_diff_versions",
    """select x.environment_id, x.subject, x.ordinal as a, y.ordinal as b, x.schema_id = y.schema_id as identical, f.path, f.kind, f.direction, f.surface, f.member
       from reg x join reg y on y.environment_id = x.environment_id and y.subject = x.subject and y.ordinal = x.ordinal + 2
       left join ({findings:select distinct x.schema_id as prev_id, y.schema_id as next_id from reg x join reg y on y.environment_id = x.environment_id and y.subject = x.subject and y.ordinal = x.ordinal + 2}) f
         on f.prev_id = x.schema_id and f.next_id = y.schema_id""",
)
oracle("f7_effective_policy", "select environment_id, subject, content_model, mode, surface from policies")
oracle(
    "f8_semver_sort_key",
    """select semver, count(*) as versions, cast(split_part(semver, '.', 1) as int) as major, cast(split_part(semver, '.', 2) as int) as minor,
              0 as patch, semver not like '%-%' as is_release, case when semver like '%-rc.1' then 2 else 1 end as identifiers
       from reg where semver is not null group by all""",
)
oracle(
    "f9_suggest_semver",
    """select v.environment_id, v.subject, v.schema_id, v.bump,
              case when v.bump = 'None' then null when t.k is null then '1.0.0'
                   when v.bump = 'Major' then (t.k // 1000000 + 1) || '.0.0'
                   when v.bump = 'Minor' then (t.k // 1000000) || '.' || (t.k % 1000000 // 10 + 1) || '.0'
                   else (t.k // 1000000) || '.' || (t.k % 1000000 // 10) || '.1' end as suggested_semver
       from verdicts v left join (select environment_id, subject, max(k) as k from labels_parsed where status <> 'Rejected' group by all) t
         using (environment_id, subject)""",
)
oracle(
    "f10_semver_label_audit",
    """select environment_id, subject, ordinal, semver, code from (
         select l.environment_id, l.subject, l.ordinal, l.semver,
                case when p is not null and l.k <= p then 'semver_not_increasing'
                     when not a.compatible and p is not null and l.major <= p // 1000000 then 'semver_label_understates_breakage'
                     when not a.compatible and p is null and l.major = 0 then 'semver_label_understates_breakage' end as code
         from (select *, max(case when status in ('Active', 'AwaitingApproval') then k end) over
                 (partition by environment_id, subject order by ordinal rows between unbounded preceding and 1 preceding) as p from labels_parsed) l
         join version_audit a using (environment_id, subject, ordinal)) x where code is not null""",
)
_CHECKED = """
    select t.subject, t.schema_id, p.mode, p.surface, p.subject is null as fresh, e.schema_id as tip_id, length(t.subject) % 4 = 0 as other
    from tips t left join policies p on p.subject = t.subject and p.environment_id = 'EUROPE'
    left join tips e on e.subject = t.subject and e.environment_id = 'EUROPE' where t.environment_id = 'ASIA'"""
_AGAINST = f"""
    select c.subject, c.schema_id, count(*) filter (f.surface <= c.surface) as violations from ({_CHECKED}) c
    join active a on a.subject = c.subject and a.environment_id = 'EUROPE'
    join (select subject, max(ordinal) as tip from active where environment_id = 'EUROPE' group by all) m on m.subject = c.subject
    join ({{findings:select distinct a.schema_id as prev_id, t.schema_id as next_id from tips t join active a on a.subject = t.subject where t.environment_id = 'ASIA' and a.environment_id = 'EUROPE'}}) f
      on f.prev_id = a.schema_id and f.next_id = c.schema_id
    where c.mode <> 'NONE' and (c.mode like '%TRANSITIVE' or a.ordinal = m.tip)
      and ((c.mode like 'BACKWARD%' and f.direction = 'Backward') or (c.mode like 'FORWARD%' and f.direction = 'Forward') or c.mode like 'FULL%')
    group by all"""
oracle(
    "f12_bulk_check",
    f"""select 'EUROPE' as environment_id, c.subject, case when other then 'avro' else 'json' end as format, c.schema_id,
               case when other then 'skipped' when fresh then 'new' when coalesce(v.violations, 0) = 0 then 'ok' else 'broken' end as status,
               case when other then 0 else coalesce(v.violations, 0) end as violations
        from ({_CHECKED}) c left join ({_AGAINST}) v using (subject, schema_id)""",
)
oracle(
    "f12_push_plan",
    f"""select 'EUROPE' as environment_id, c.subject, c.schema_id,
               case when fresh then 'would-create' when c.schema_id = tip_id then 'unchanged' when coalesce(v.violations, 0) = 0 then 'would-register'
                    else 'would-await-approval' end as action
        from ({_CHECKED}) c left join ({_AGAINST}) v using (subject, schema_id)""",
)
# --- governance -----------------------------------------------------------------------------------
oracle("g1_impact_analysis", "select * from impacts")
oracle(
    "g1_impact_summary",
    """select environment_id, subject, candidate_id, count(*) as consumers, count(*) filter (breaks) as breaking,
              count(*) filter (certainty = 'Unresolvable') as unresolvable, count(*) filter (stale) as stale from impacts group by all""",
)
oracle("g2_governing_contracts", "select subject, contract from publish_refs union select subject, contract from consume_refs")
oracle(
    "g3_stale_services",
    "select environment_id, service, last_seen_at from service_seen where timestamp '1998-09-01 00:00:00' - interval 30 days > last_seen_at",
)
oracle(
    "g4_service_registry_state",
    """select environment_id, service, case when s % 2 = 0 then e end as produces, case when s % 2 = 1 then e end as consumes,
              first_seen_at, last_seen_at, reports
       from (select 'env' || (user_id % 3) as environment_id, 'svc-' || user_id as service, arg_max('acme.events.' || event_type, (ts, event_id)) as e,
                    arg_max(event_id, (ts, event_id)) as s, min(ts) as first_seen_at, max(ts) as last_seen_at, count(*) as reports
             from events group by all) x""",
)
oracle(
    "g5_lineage_edges",
    """select environment_id, subject, count(distinct service) filter (role = 'produces') as producers,
              count(distinct service) filter (role = 'consumes') as consumers from uses group by all""",
)
oracle(
    "g5_lineage_pairs",
    """select distinct p.environment_id, p.service as producer, p.subject, c.service as consumer from uses p join uses c
         on c.environment_id = p.environment_id and c.subject = p.subject and p.role = 'produces' and c.role = 'consumes'""",
)
oracle(
    "g6_promotion_plan",
    f"""select s.subject, s.latest_ordinal as source_ordinal, t.latest_ordinal as target_ordinal, c.schema_id,
               case when s.latest_ordinal is null then 'refused' when t.subject is null then 'create' when c.schema_id = c.tip_id then 'unchanged'
                    when coalesce(v.violations, 0) = 0 then 'register' else 'await_approval' end as action,
               case when s.latest_ordinal is null then 'version_not_found' end as code, coalesce(v.violations, 0) as violations
        from subject_rows s left join ({_CHECKED}) c on c.subject = s.subject left join ({_AGAINST}) v on v.subject = c.subject and v.schema_id = c.schema_id
        left join subject_rows t on t.subject = s.subject and t.environment_id = 'EUROPE' where s.environment_id = 'ASIA'""",
)
oracle(
    "g7_environment_drift",
    """select subject, state, a_ordinal, b_ordinal, a_id, b_id from (
         select coalesce(a.subject, b.subject) as subject, a.o as a_ordinal, b.o as b_ordinal, a.i as a_id, b.i as b_id,
                case when b.subject is null then 'only_a' when a.subject is null then 'only_b' when a.i is distinct from b.i then 'differs' end as state
         from (select s.subject, s.latest_ordinal as o, t.schema_id as i from subject_rows s left join tips t using (environment_id, subject) where environment_id = 'ASIA') a
         full join (select s.subject, s.latest_ordinal as o, t.schema_id as i from subject_rows s left join tips t using (environment_id, subject) where environment_id = 'EUROPE') b
           on a.subject = b.subject) x where state is not null""",
)
oracle("g8_violation_rollup", "select * from rolled")
oracle(
    "g8_report_outcomes",
    """select environment_id, count(*) filter (usable and (ts, seq) >= o) as accepted, count(*) filter (usable and (ts, seq) = o) as opened,
              count(*) - count(*) filter (usable and (ts, seq) >= o) as rejected
       from cleaned left join opened using (fingerprint) group by all""",
)
oracle(
    "g9_top_violations",
    "select fingerprint, last_seen_at, occurrences from rolled where environment_id = 'env1' order by last_seen_at desc, fingerprint limit 20",
)
oracle(
    "g10_enforcement_counters",
    """select 'PUBLISH' as side, case when outcome = 'Observed' and mode = 3 then 'Blocked' else outcome end as outcome, count(*) as messages from publish_result group by all
       union all select 'CONSUME', case when outcome = 'Observed' and mode = 3 then 'Quarantined' else outcome end, count(*) from consume_result group by all""",
)
oracle(
    "g10_recent_decisions",
    """select side, message_id, outcome, code from (
         select 'PUBLISH' as side, ts, message_id, case when outcome = 'Observed' and mode = 3 then 'Blocked' else outcome end as outcome, code from publish_result
         union all select 'CONSUME', ts, message_id, case when outcome = 'Observed' and mode = 3 then 'Quarantined' else outcome end, code from consume_result)
       where outcome <> 'Valid' order by ts desc, message_id desc, side limit 32""",
)
oracle(
    "g11_audit_query",
    """select audit_id, environment_id, action, actor, target, detail, "at" from audit_rows where environment_id = 'env1' and action = 'VERSION_REGISTERED'
       order by "at" desc, audit_id desc limit 200""",
)
oracle("g12_deployment_trail", "select * from deployment_rows order by occurred_at desc, id desc limit 50")
oracle("g13_usage_meter", "select tenant_id, environments, subjects, seats, versions_per_month from usage")
oracle(
    "g14_plan_limit_check",
    """select tenant_id, meter, used, case when cancelled then 0 else plan_limit end as plan_limit,
              not cancelled and (plan_limit is null or used < plan_limit) as allowed
       from (select u.tenant_id, u.meter, u.used, coalesce(n.n_nationkey % 6 = 5, false) as cancelled, l.plan_limit
             from (select tenant_id, 'environments' as meter, environments as used from usage union all select tenant_id, 'subjects', subjects from usage
                   union all select tenant_id, 'seats', seats from usage union all select tenant_id, 'versions_per_month', versions_per_month from usage) u
             left join nation n on 't' || n.n_nationkey = u.tenant_id and n.n_nationkey <> 3
             left join (values (0, 'environments', 1), (0, 'subjects', 10), (0, 'seats', 3), (0, 'versions_per_month', 100),
                               (1, 'environments', 3), (1, 'subjects', 100), (1, 'seats', 15), (1, 'versions_per_month', 1000),
                               (2, 'environments', 10), (2, 'subjects', 1000), (2, 'seats', 100), (2, 'versions_per_month', 10000)) l(tier, meter, plan_limit)
               on l.tier = n.n_nationkey % 4 and l.meter = u.meter) x""",
)
oracle(
    "g15_registry_overview",
    """select (select count(*) from subject_rows) as subjects, (select count(*) from subject_rows where latest_ordinal is null) as without_latest,
              (select count(*) from reg) as versions, (select count(*) from reg where status = 'AwaitingApproval') as pending""",
)
oracle(
    "g15_recent_subjects",
    """select s.environment_id, s.subject, s.owner, s.latest_ordinal, r.registered_at from subject_rows s
       left join reg r on r.environment_id = s.environment_id and r.subject = s.subject and r.ordinal = s.latest_ordinal
       order by r.registered_at desc nulls last, s.environment_id, s.subject limit 25""",
)
oracle("g16_subject_search", "select environment_id, subject, owner from subject_rows where lower(subject) like '%part.p19%' or owner like '%part.p19%'")
_WANTS = """
    select o.outbox_id, o.environment_id, o.event, n.subscription_id from outbox_rows o join notify_rows n on n.environment_id = o.environment_id
    and n.enabled and (n.events = '' or list_contains(string_split(n.events, ','), o.event))"""
oracle("g17_notification_fanout", _WANTS)
oracle("g17_unwanted", f"select outbox_id, event from outbox_rows where outbox_id not in (select outbox_id from ({_WANTS}) x)")
oracle(
    "g18_outbox_due",
    """select outbox_id, occurred_at, attempts from outbox_rows where delivered_at is null and not parked
       and next_attempt_at <= timestamp '2024-01-15 00:00:00' order by occurred_at, outbox_id limit 50""",
)
oracle(
    "g18_outbox_depth",
    """select environment_id, count(*) filter (delivered_at is null and not parked) as pending,
              count(*) filter (delivered_at is null and parked) as parked from outbox_rows group by all""",
)
oracle(
    "g19_outbox_retry_state",
    """select outbox_id, cast(least(n, 5) as int) as attempts, n >= 5 as parked,
              case when n > 0 and n < 5 and d is null then last + to_minutes(cast(pow(2, n - 1) as int)) end as next_attempt_at,
              case when n < 5 then d end as delivered_at
       from (select a.outbox_id, count(*) filter (not succeeded) as n, max("at") filter (not succeeded) as last, min("at") filter (succeeded) as d
             from attempt_rows a left join (select outbox_id, min(("at", seq)) as done from attempt_rows where succeeded group by all) s using (outbox_id)
             where done is null or ("at", seq) <= done group by all) x""",
)
oracle("h3_violation_flush_windows", "select window_start, reporter, side, route, subject, code, detail, n from flush_keys")
oracle(
    "h3_violation_flush_dropped",
    """select window_start, reporter, count(*) as keys, cast(sum(n) - sum(n) filter (rk <= 256) as bigint) as dropped from flush_ranked group by all""",
)
oracle(
    "i_column_functions",
    """select p_partkey, replace(replace(p_name || '~/' || p_brand, '~', '~0'), '/', '~1') as pointer,
              trim(split_part(replace(replace('Acme+' || p_brand || ':' || p_type, '+', '.'), ':', '.'), ',', 1)) as normal,
              regexp_matches('acme.' || replace(p_brand, '#', '_'), '^[A-Za-z0-9_]+([.][A-Za-z0-9_]+)*$') as valid,
              regexp_matches(p_name, '^[A-Za-z0-9_]+([.][A-Za-z0-9_]+)*$') as name_valid from part""",
)
oracle(
    "flagship_publish_report",
    "select outcome, code, mode, count(*) as messages from publish_result group by all",
)
# --- streams: what a stream has written when all has arrived is what the batch gives ----------------
ORACLES["h1_stream_conformance"] = ORACLES["c7_consume_conformance"]
ORACLES["h2_stream_violation_rollup"] = ORACLES["g8_violation_rollup"]
oracle(
    "h1_registry_reload",
    """select message_id, mode, case when step in (0, 2, 5) then 'Unenforced' when step = 7 then 'Valid' else 'Observed' end as outcome,
              case step when 1 then error_code when 3 then 'contract_subject_not_permitted' when 4 then 'contract_version_not_permitted'
                   when 5 then 'schema_unresolvable' when 6 then 'envelope_format_mismatch' when 8 then 'payload_invalid' end as code,
              case when step > 0 then subject end as judged_subject, case when step > 0 then schema_id end as judged_schema_id
       from (select * replace (case when day(ts) > 15 then mode else 2 end as mode,
                    case when day(ts) > 15 then step when error_code is not null then 1 when kind = 'none' then 2
                         when schema_type is null or schema_type = 'signup' then 5 when format = 'avro' then 6 when ok then 7 else 8 end as step)
             from consume_steps) x""",
)
oracle("h2_violations_opened", f"select fingerprint, 1 as opened from ({ORACLES['g8_violation_rollup']}) x")
oracle(
    "h3_stream_flush_windows",
    """select time_bucket(interval 1 day, ts) as window_start, coalesce(reported_by, 'unknown') as reporter, side, route, subject, code,
              detail || (seq % 997) as detail, count(*) as n, true as flushed_once
       from violation_reports where time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) from violation_reports) - interval 2 days
       group by all""",
)
oracle(
    "g4_stream_service_state",
    """select environment_id, service, case when s % 2 = 0 then e end as produces, case when s % 2 = 1 then e end as consumes, first_seen_at, last_seen_at
       from (select 'env' || (user_id % 3) as environment_id, 'svc-' || user_id as service, arg_max('acme.events.' || event_type, (ts, event_id)) as e,
                    arg_max(event_id, (ts, event_id)) as s, min(ts) as first_seen_at, max(ts) as last_seen_at
             from events group by all) x""",
)
