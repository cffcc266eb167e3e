"""Message and registry views derived from the driver's tables.

Texts in ``SHARED`` use only syntax that Spark and DuckDB read alike, so the data both engines see
is the same by construction; what is *computed* from it is written separately on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema_id
from ..session import is_local, materialize
from ..wire import Wire

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
# Each text may name driver tables and earlier entries.
SHARED: dict[str, str] = {
    # one row per message; h is the header case, sid the id its publisher would write
    "message_base": """
        select event_id as message_id, ts, user_id, event_type,
               'b' || cast(event_id % 2 as string) as broker_id, '/' as virtual_host,
               case when event_type in ('signup', 'purchase') then 'commerce' else 'telemetry' end as exchange,
               event_type || '.u' || cast(user_id % 10 as string) as routing_key,
               'q.' || event_type as queue,
               case when event_id % 17 = 0 then null
                    when event_id % 19 = 0 then 'acme.Events+' || event_type
                    when event_id % 23 = 0 then 'acme.events-' || event_type
                    when event_id % 41 = 0 then 'acme.Wrap`1[[acme.events.' || event_type || ', Acme]]'
                    when event_id % 47 = 0 then 'acme.events.' || event_type || ', Acme.Assembly'
                    else 'acme.events.' || event_type end as properties_type,
               case when event_id % 43 = 0 then null
                    when event_id % 29 = 0 then '{"k": '
                    when event_id % 31 = 0 then '{"k":"x"}'
                    when event_id % 37 = 0 then '{}'
                    else props end as body_text,
               cast(event_id % 13 as int) as h
        from events""",
    "event_schemas": """
        select t.event_type, 'acme.events.' || t.event_type as subject,
               case t.event_type when 'signup' then 1 when 'purchase' then 2 when 'view' then 3 else 2 end as ordinal,
               case t.event_type
                 when 'signup' then '{"properties":{"k":{"type":"integer"}},"required":["k"],"type":"object"}'
                 when 'purchase' then '{"properties":{"k":{"maximum":60,"type":"integer"}},"required":["k"],"type":"object"}'
                 when 'view' then '{"additionalProperties":false,"properties":{"k":{"minimum":20,"type":"number"}},"type":"object"}'
                 else '{"properties":{"k":{"multipleOf":2,"type":["integer","string"]}},"required":["k"],"type":"object"}'
               end as body
        from (select distinct event_type from events where event_type <> 'error') t""",
    "contract_rows": """
        select n_name as contract, min(n_nationkey % 3 + 1) as enforcement from nation
        join supplier on s_nationkey = n_nationkey group by n_name""",
    "publish_rows": """
        select n_name as contract, cast(s_suppkey as int) as seq,
               case when s_suppkey % 5 = 0 then 'b1' else null end as broker_id, '/' as virtual_host,
               case s_suppkey % 3 when 0 then 'commerce' when 1 then 'telemetry' else 'commerce' end as exchange,
               case s_suppkey % 6 when 0 then 'purchase.*' when 1 then '#' when 2 then 'view.u1'
                    when 3 then '*.u2' when 4 then 'click.#' else 'signup.#.u3' end as pattern,
               case when s_suppkey % 4 = 0 then null else cast(s_suppkey % 4 as int) end as precedence,
               s_suppkey as k
        from supplier join nation on s_nationkey = n_nationkey""",
    "consume_rows": """
        select n_name as contract, cast(s_suppkey as int) as seq,
               case when s_suppkey % 7 = 0 then 'b0' else null end as broker_id, '/' as virtual_host,
               case s_suppkey % 4 when 0 then 'q.purchase' when 1 then 'q.view' when 2 then 'q.click' else 'q.none' end as queue,
               s_suppkey as k
        from supplier join nation on s_nationkey = n_nationkey""",
    "ref_names": """
        select cast(p.pos as int) as pos, 'acme.events.' || p.t as subject from (
          select 0 as pos, 'signup' as t union all select 1, 'purchase' union all select 2, 'view'
          union all select 3, 'click' union all select 4, 'error') p""",
    "publish_refs": """
        select b.contract, b.seq, r.pos, r.subject,
               case (b.k + r.pos) % 4 when 0 then 'latest' when 1 then '>=1' when 2 then '2' else '>=2' end as selector
        from publish_rows b join ref_names r on (b.k + r.pos) % 3 <> 0""",
    "consume_refs": """
        select b.contract, b.seq, r.pos, r.subject,
               case (b.k + r.pos) % 4 when 0 then 'latest' when 1 then '>=1' when 2 then '2' else '>=2' end as selector
        from consume_rows b join ref_names r on (b.k + r.pos) % 3 <> 0""",
    # one schema version per order line; rule columns say what its schema holds
    "version_rules": """
        select r_name as environment_id, 'acme.part.P' || cast(p_partkey as string) as subject, p_partkey,
               p_partkey % 25 as tenant,
               cast(row_number() over w as int) as ordinal,
               cast(l_quantity as int) as q_max, l_tax > 0 as tax_required,
               max(case when l_returnflag = 'A' then 1 else 0 end) over w as flag_a,
               max(case when l_returnflag = 'N' then 1 else 0 end) over w as flag_n,
               max(case when l_returnflag = 'R' then 1 else 0 end) over w as flag_r,
               l_discount = 0 as disc_integer, l_linestatus = 'O' as ship_date, l_linenumber = 7 as closed,
               l_shipdate as registered_at
        from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
             join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        window w as (partition by r_name, p_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey,
                     l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
                     rows between unbounded preceding and current row)""",
    "version_bodies": """
        select v.*,
               '{' || case when closed then '"additionalProperties":false,' else '' end ||
               '"properties":{"disc":{"type":"' || case when disc_integer then 'integer' else 'number' end ||
               '"},"flag":{"enum":[' ||
               case when flag_a = 1 then '"A"' || case when flag_n + flag_r > 0 then ',' else '' end else '' end ||
               case when flag_n = 1 then '"N"' || case when flag_r > 0 then ',' else '' end else '' end ||
               case when flag_r = 1 then '"R"' else '' end ||
               '],"type":"string"},"q":{"maximum":' || cast(q_max as string) || ',"type":"integer"},"ship":{' ||
               case when ship_date then '"format":"date",' else '' end ||
               '"type":"string"},"tax":{"type":"number"}},"required":["q"' ||
               case when tax_required then ',"tax"' else '' end || '],"type":"object"}' as body,
               case when (p_partkey + ordinal) % 7 = 0 then 'AwaitingApproval'
                    when (p_partkey + ordinal) % 17 = 0 then 'Rejected' else 'Active' end as status,
               case when (p_partkey + ordinal) % 9 = 0 then null
                    when (p_partkey + ordinal) % 11 = 0 then '0.' || cast(ordinal as string) || '.0-rc.1'
                    else cast(1 + ordinal % 3 as string) || '.' || cast(ordinal as string) || '.0' end as semver
        from version_rules v""",
    # the rules of a version without its maximum, for the Avro and Protobuf shapes of the same data
    "shape_keys": """
        select environment_id, subject, ordinal,
               'v' || cast(case when disc_integer then 1 else 0 end as string) || cast(case when tax_required then 1 else 0 end as string) ||
               cast(flag_a as string) || cast(flag_n as string) || cast(flag_r as string) ||
               cast(case when ship_date then 1 else 0 end as string) || cast(case when closed then 1 else 0 end as string) as schema_id
        from version_rules""",
    "shapes": """
        select schema_id, substring(schema_id, 2, 1) = '1' as whole, substring(schema_id, 3, 1) = '1' as tax,
               substring(schema_id, 4, 1) = '1' as a, substring(schema_id, 5, 1) = '1' as n, substring(schema_id, 6, 1) = '1' as r,
               substring(schema_id, 7, 1) = '1' as ship, substring(schema_id, 8, 1) = '1' as closed
        from (select distinct schema_id from shape_keys) k""",
    "shape_pairs": """
        select distinct b.schema_id as prev_id, a.schema_id as next_id from shape_keys b join shape_keys a
          on a.environment_id = b.environment_id and a.subject = b.subject and a.ordinal = b.ordinal + 1""",
    "avro_rows": """
        select schema_id, 'avro' as format, '{"type":"record","name":"Line","namespace":"acme","fields":[{"name":"q","type":"' ||
               case when whole then 'int' else 'long' end || '"},{"name":"flag","type":{"type":"enum","name":"Flag","symbols":["Z"' ||
               case when a then ',"A"' else '' end || case when n then ',"N"' else '' end || case when r then ',"R"' else '' end ||
               ']}},{"name":"ship","type":{"type":"fixed","name":"Ship","size":' || case when ship then '10' else '8' end || '}}' ||
               case when tax then ',{"name":"tax","type":"double"}' else '' end ||
               case when closed then ',{"name":"note","type":["null","string"],"default":null}' else '' end || ']}' as body
        from shapes""",
    "proto_message_rows": "select schema_id, 'Line' as message from shapes",
    "proto_field_rows": """
        select schema_id, 'Line' as message, 1 as number, 'q' as name, 'singular' as label, case when whole then 'int32' else 'int64' end as type,
               cast(null as string) as map_key from shapes
        union all select schema_id, 'Line', 2, 'tax', 'singular', 'double', cast(null as string) from shapes where tax
        union all select schema_id, 'Line', 3, 'ship', 'singular', case when ship then 'string' else 'bytes' end, cast(null as string) from shapes""",
    "proto_enum_rows": """
        select schema_id, 'Flag' as enum, 0 as number, 'Z' as name from shapes
        union all select schema_id, 'Flag', 1, 'A' from shapes where a
        union all select schema_id, 'Flag', 2, 'N' from shapes where n
        union all select schema_id, 'Flag', 3, 'R' from shapes where r""",
    "proto_reserved_rows": "select schema_id, 'Line' as message, 2 as lo, 2 as hi from shapes where closed and not tax",
    "import_rows": """
        select 's' || cast(p_partkey as string) as schema_id,
               case when p_partkey % 3 = 0 then 'acme/common' || cast(p_size as string) || '.proto' else 'google/protobuf/timestamp.proto' end as path
        from part""",
    "environment_rows": """
        select r_name as environment_id, cast(r_regionkey as int) as k,
               case r_regionkey % 3 when 0 then null when 1 then 'FULL' else 'BACKWARD' end as default_mode,
               cast(case r_regionkey % 3 when 0 then null when 1 then 3 else 2 end as int) as default_surface
        from region""",
    "subject_rows": """
        select environment_id, subject, p_partkey, 't' || cast(max(tenant) as string) as tenant_id, 'json' as format,
               'team-' || cast(p_partkey % 9 as string) as owner,
               case when p_partkey % 11 = 0 then 'Retired' when p_partkey % 13 = 0 then 'Deprecated' else 'Active' end as lifecycle,
               case when p_partkey % 5 = 0 then 'Closed' else 'Open' end as content_model,
               case p_partkey % 8 when 2 then 'BACKWARD' when 3 then 'FORWARD' when 4 then 'FULL' when 5 then 'BACKWARD_TRANSITIVE'
                    when 6 then 'FULL_TRANSITIVE' when 7 then 'NONE' else null end as mode,
               cast(case when p_partkey % 8 < 2 then null else p_partkey % 3 + 1 end as int) as surface,
               max(case when status = 'Active' then ordinal end) as latest_ordinal,
               min(registered_at) as created_at,
               max(case when status = 'Active' then registered_at end) as moved_at
        from version_bodies group by environment_id, subject, p_partkey""",
    "service_uses": """
        select distinct r_name as environment_id, 'svc-' || cast(c_custkey as string) as service,
               l_returnflag = 'R' as produces, 'acme.part.P' || cast(l_partkey as string) as subject,
               case c_custkey % 3 when 0 then 'latest' when 1 then '>=2' else '1' end as selector
        from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
             join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "service_seen": """
        select r_name as environment_id, 'svc-' || cast(c_custkey as string) as service,
               min(o_orderdate) as first_seen_at, max(o_orderdate) as last_seen_at
        from customer join orders on o_custkey = c_custkey
             join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        group by r_name, c_custkey""",
    "violation_reports": """
        select event_id as seq, ts, 'env' || cast(user_id % 3 as string) as environment_id,
               case when event_id % 27 = 0 then 'sideways' when event_id % 2 = 0 then ' publish ' else 'CONSUME' end as side,
               case when event_id % 35 = 0 then '  ' else ' commerce/' || event_type || '.u' || cast(user_id % 10 as string) || ' ' end as route,
               case when event_id % 5 = 0 then null else 'acme.events.' || event_type end as subject,
               case when event_id % 33 = 0 then '' when event_id % 3 = 0 then 'payload_invalid' else 'contract_subject_not_permitted' end as code,
               case when event_id % 4 = 0 then ' ' else 'detail ' || props end as detail,
               case when event_id % 6 = 0 then null else 'svc-' || cast(user_id % 7 as string) end as reported_by,
               event_id % 4 as occurrences
        from events""",
    "audit_rows": """
        select 'a' || cast(event_id as string) as audit_id, 'env' || cast(user_id % 3 as string) as environment_id,
               case event_type when 'signup' then 'SUBJECT_CREATED' when 'purchase' then 'VERSION_REGISTERED'
                    when 'error' then 'VERSION_REJECTED' when 'view' then 'CONTRACT_CHANGED' else 'POLICY_CHANGED' end as action,
               'user-' || cast(user_id % 11 as string) as actor, 'acme.s' || cast(user_id % 50 as string) as target,
               props as detail, ts as at
        from events""",
    "deployment_rows": """
        select 'd' || cast(event_id as string) as id, event_type as action, 'user-' || cast(user_id % 11 as string) as actor,
               't' || cast(user_id % 25 as string) as tenant_id, props as detail, ts as occurred_at
        from events""",
    "outbox_rows": """
        select 'o' || cast(event_id as string) as outbox_id, 'env' || cast(user_id % 3 as string) as environment_id,
               case event_type when 'signup' then 'SUBJECT_CREATED' when 'purchase' then 'VERSION_REGISTERED'
                    when 'error' then 'ENFORCEMENT_VIOLATION' when 'view' then 'CONTRACT_CHANGED' else 'VERSION_AWAITING_APPROVAL' end as event,
               'acme.s' || cast(user_id % 50 as string) as target, props as body, ts as occurred_at,
               case when event_id % 3 = 0 then ts else null end as delivered_at,
               cast(event_id % 6 as int) as attempts, event_id % 6 = 5 as parked, ts as next_attempt_at
        from events""",
    "notify_rows": """
        select 'n' || cast(s_suppkey as string) as subscription_id, 'env' || cast(s_suppkey % 3 as string) as environment_id,
               s_suppkey % 4 <> 0 as enabled,
               case s_suppkey % 3 when 0 then '' when 1 then 'VERSION_REGISTERED,ENFORCEMENT_VIOLATION' else 'CONTRACT_CHANGED' end as events
        from supplier""",
    "attempt_rows": """
        select 'o' || cast(user_id as string) as outbox_id, event_id as seq, ts as at, event_type <> 'error' and value < 0 as succeeded
        from events""",
    # one nested document per order line
    "line_docs": """
        select cast(l_orderkey * 100 + l_linenumber as bigint) as doc_id, 'acme.line.' || l_returnflag as subject,
               o_orderkey, o_orderstatus, o_orderpriority, cast(o_totalprice as decimal(14,2)) as total,
               l_linenumber, cast(l_quantity as int) as qty, cast(l_discount as decimal(6,2)) as disc,
               cast(cast(l_shipdate as date) as string) as ship, l_returnflag, l_linestatus,
               case when o_orderkey % 53 = 0 then '{"order":' else
               '{"order":{"id":' || cast(o_orderkey as string) || ',"status":"' || o_orderstatus || '","total":' ||
               cast(cast(o_totalprice as decimal(14,2)) as string) ||
               case when o_orderkey % 3 = 0 then ',"priority":"' || o_orderpriority || '"' else '' end ||
               '},"line":{"n":' || cast(l_linenumber as string) || ',"qty":' || cast(cast(l_quantity as int) as string) ||
               ',"disc":' || cast(cast(l_discount as decimal(6,2)) as string) || ',"ship":"' ||
               cast(cast(l_shipdate as date) as string) || '"},"flags":["' || l_returnflag || '","' || l_linestatus ||
               '"],"note":' || case when o_orderkey % 5 = 0 then 'null' when o_orderkey % 7 = 0 then '"late"' else 'null' end ||
               ',"gift":' || case when l_linenumber % 2 = 0 then 'true' else 'false' end || '}' end as body
        from orders join lineitem on o_orderkey = l_orderkey""",
    # authored spellings of the version schemas: plain, spaced, doubled key, empty
    "authored_rows": """
        select environment_id, subject, ordinal, body as plain,
               case when ordinal % 5 = 0 then '  ' || body || ' '
                    when ordinal % 7 = 0 then '{"type":"object","type":"object"}'
                    when ordinal % 11 = 0 then ' '
                    when ordinal % 13 = 0 then substring(body, 1, 20) else body end as body
        from version_bodies""",
    # schemas that refer to each other, one per part: mostly towards smaller keys, with some cycles
    "part_links": """
        select p_partkey as k, cast(floor(p_partkey / 2) as bigint) as t from part where p_partkey >= 2
        union select p_partkey, p_partkey * 2 from part where p_partkey % 100 = 7
        union select p_partkey, p_partkey * 4 from part where p_partkey % 100 = 9
        union select p_partkey, p_partkey from part where p_partkey % 333 = 0""",
    "part_refs": """
        select p.p_partkey as k, l.t, 'main' as environment_id, 'acme.P' || cast(p.p_partkey as string) as subject,
               'acme.P' || cast(l.t as string) as target
        from part p join part_links l on l.k = p.p_partkey""",
    "lint_rows": """
        select 's' || cast(p_partkey as string) as schema_id, p_partkey as k, p_size,
               case p_partkey % 6 when 0 then '{"$schema":"http://json-schema.org/draft-07/schema#","type":"object"}'
                 when 1 then '{"properties":{"a":{"oneOf":[{"type":"string"}]}},"type":"object"}'
                 when 2 then '{"properties":{"p":{"pattern":"^(?=x)y"}},"type":"object"}'
                 when 3 then '{"$ref":"#/$defs/x","properties":{"r":{"$ref":"https://example.com/a"}}}'
                 when 4 then '{"patternProperties":{"^a(?!b)":{"pattern":"^[a-z]+$"}},"size":' || cast(p_size as string) || '}'
                 else '{"maximum":' || cast(p_size as string) || ',"type":"integer"}' end as body
        from part""",
    "contract_file_rows": """
        select '/contracts/' || case when p_partkey % 10 = 0 then 'bad-name' || cast(p_partkey as string)
                 else 'acme.P' || cast(p_partkey - p_partkey % 7 % 2 as string) end ||
               case p_partkey % 4 when 0 then '.json' when 1 then '.AVSC' when 2 then '.proto' else '.txt' end as path,
               '{"title":"' || p_name || '"}' as body
        from part""",
    "chat_docs": """
        select conv_id * 1000 + turn as doc_id, 'acme.chat' as subject, conv_id, turn, role, text from conversations""",
}

STORED = ("version_bodies", "subject_rows")


class Views:
    """Derived views over one folder of driver tables, as Spark DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str, wire: Wire = Wire()):
        self.spark, self.dir, self.wire = spark, sf_dir, wire
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._read(name)
        if name in SHARED:
            text = SHARED[name]
            words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
            for dep in [*TABLES, *SHARED]:
                if dep != name and dep in words:
                    getattr(self, dep).createOrReplaceTempView(dep)
            out = self.spark.sql(text)
            for column, kind in out.dtypes:
                if kind == "timestamp_ntz":
                    out = out.withColumn(column, F.col(column).cast("timestamp"))
            # A registry is stored tables, so the derived one is stored too, its versions with their ids: queries
            # read it several times.
            if name == "version_bodies":
                out = out.withColumn("schema_id", self._body_id())
            return materialize(out, name) if name in STORED else out
        return getattr(self, f"_{name}")()

    def _read(self, name: str) -> DataFrame:
        """One driver table as it is. On one machine the two large ones, which are one row group there, are
        spread over its cores."""
        table = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        context = self.spark.sparkContext
        if name in ("lineitem", "events") and is_local(context.master):
            return table.repartition(context.defaultParallelism, table.columns[0])
        return table

    # --- messages --------------------------------------------------------------------------

    def _event_schema_ids(self) -> DataFrame:
        """Registered schemas of the event subjects, with their content-addressed ids."""
        none = F.array().cast("array<struct<name:string,subject:string,version:int>>")
        return self.event_schemas.withColumn("references", none).withColumn(
            "schema_id", schema_id(F.lit("json"), F.col("body"), F.col("references"), self.wire)
        )

    def _messages(self) -> DataFrame:
        w = self.wire
        ids = self.event_schema_ids.select("event_type", F.col("schema_id").alias("sid"))
        base = self.message_base.join(ids, "event_type", "left")
        sid = F.coalesce("sid", F.lit("0" * 32))
        subject = F.concat(F.lit("acme.events."), F.col("event_type"))

        def header(name: str, value: Column, kind: str = "bytes") -> Column:
            data = value.cast("binary")
            return F.map_from_arrays(
                F.array(F.lit(name)), F.array(F.struct(F.lit(kind).alias("kind"), data.alias("bytes")))
            )

        v1 = header(w.version, F.lit("1"))
        good = F.map_concat(v1, header(w.schema_id, sid, "string"))
        cases = {
            1: header("x-trace", F.lit("abc")),
            2: header(w.version, F.lit("2")),
            3: header(w.version, F.lit("1"), "other"),
            4: v1,
            5: F.map_concat(v1, header(w.schema_id, F.lit("ABC"))),
            6: F.map_concat(v1, header(w.schema_id, F.unhex(F.lit("80FF")))),
            7: F.map_concat(good, header(w.format, F.lit("xml"))),
            8: F.map_concat(
                good,
                header(w.subject, F.concat(F.lit(" "), subject)),
                header(w.ordinal, F.lit("x")),
                header(w.semver, F.lit("1.2")),
            ),
            9: F.map_concat(good, header(w.subject, F.lit("acme.other")), header(w.format, F.lit("json"))),
            10: F.map_concat(
                good,
                header(w.subject, subject),
                header(w.ordinal, F.lit("2")),
                header(w.semver, F.lit("1.0.0")),
                header(w.format, F.lit("json")),
            ),
            12: F.map_concat(
                good,
                header(w.subject, subject),
                header(w.ordinal, F.lit("1")),
                header(w.format, F.when(F.col("message_id") % 2 == 0, "avro").otherwise("json")),
            ),
        }
        headers = None
        for case, value in cases.items():
            headers = (F if headers is None else headers).when(F.col("h") == case, value)
        content = F.when(F.col("h") == 11, F.concat(F.lit("application/json" + w.content_marker), sid))
        return base.select(
            "message_id", "ts", "broker_id", "virtual_host", "exchange", "routing_key", "queue",
            "properties_type", content.alias("content_type"), headers.alias("headers"),
            F.coalesce(F.col("body_text").cast("binary"), F.unhex(F.lit("80FF"))).alias("body"),
        )

    def _event_subjects(self) -> DataFrame:
        return self.event_schema_ids.select("subject", "ordinal", "schema_id", F.lit("json").alias("format"))

    def _event_catalog(self) -> DataFrame:
        return self.event_schema_ids.select("schema_id", F.lit("json").alias("format"), "body", "references")

    # --- contracts -------------------------------------------------------------------------

    def _contracts(self) -> DataFrame:
        return self.contract_rows

    def _with_refs(self, rows: DataFrame, refs: DataFrame) -> DataFrame:
        lists = refs.groupBy("contract", "seq").agg(
            F.expr(
                "transform(array_sort(collect_list(struct(pos, subject, selector))), "
                "r -> struct(r.subject as subject, r.selector as selector))"
            ).alias("subjects")
        )
        return rows.drop("k").join(lists, ["contract", "seq"])

    def _publish_bindings(self) -> DataFrame:
        return self._with_refs(self.publish_rows, self.publish_refs)

    def _consume_bindings(self) -> DataFrame:
        return self._with_refs(self.consume_rows, self.consume_refs)

    # --- registry --------------------------------------------------------------------------

    def _body_id(self) -> Column:
        none = F.array().cast("array<struct<name:string,subject:string,version:int>>")
        return schema_id(F.lit("json"), F.col("body"), none, self.wire)

    def _registry(self) -> DataFrame:
        """Every version with its body and id."""
        return self.version_bodies.select(
            "environment_id", "subject", "ordinal", "semver", "status", "registered_at",
            F.lit("json").alias("format"), "body", "schema_id",
        )

    def _versions(self) -> DataFrame:
        return self.registry.drop("body", "format")

    def _schemas(self) -> DataFrame:
        none = F.array().cast("array<struct<name:string,subject:string,version:int>>")
        return self.registry.groupBy("schema_id", "format").agg(F.any_value("body").alias("body")).select(
            "schema_id", "format", "body", none.alias("references")
        )

    def _environments(self) -> DataFrame:
        return self.environment_rows.select("environment_id", "default_mode", "default_surface")

    def _subjects(self) -> DataFrame:
        return self.subject_rows.drop("p_partkey")

    def _services(self) -> DataFrame:
        ref = F.struct("subject", "selector")
        uses = self.service_uses.groupBy("environment_id", "service").agg(
            F.array_sort(F.collect_list(F.when(F.col("produces"), ref))).alias("produces"),
            F.array_sort(F.collect_list(F.when(~F.col("produces"), ref))).alias("consumes"),
        )
        return self.service_seen.join(uses, ["environment_id", "service"], "left")

    def _ref_schemas(self) -> DataFrame:
        """One JSON schema per part whose members refer to other parts' schemas."""
        scheme = self.wire.scheme
        lists = self.part_refs.groupBy("k", "environment_id", "subject").agg(
            F.array_sort(F.collect_list("target")).alias("targets")
        )
        member = lambda t, i: F.concat(
            F.lit('"r'), i.cast("string"), F.lit(f'":{{"$ref":"{scheme}://main/'), t, F.lit('/1"}')
        )
        alone = self.part.select(
            F.col("p_partkey").alias("k"), F.lit("main").alias("environment_id"),
            F.concat(F.lit("acme.P"), F.col("p_partkey").cast("string")).alias("subject"),
        ).join(lists.select("k", "targets"), "k", "left")
        body = F.concat(
            F.lit('{"properties":{'), F.array_join(F.transform(F.coalesce("targets", F.array().cast("array<string>")), member), ","),
            F.lit('},"title":"'), F.col("subject"), F.lit('"}'),
        )
        return alone.select(
            "k", "environment_id", "subject", F.lit(1).alias("ordinal"), F.lit("json").alias("format"), body.alias("body"),
            F.concat(F.lit("s"), F.col("k").cast("string")).alias("schema_id"),
        )


class ArrivingViews(Views):
    """The same views with messages and violation reports as streams of the files of ``events``."""

    STREAMS = ("events", "message_base", "messages", "violation_reports")

    def _build(self, name: str) -> DataFrame:
        if name not in self.STREAMS:
            return Views(self.spark, self.dir, self.wire)._build(name)
        if name != "events":
            return super()._build(name)
        # As a pattern the path may be a file or a folder of files.
        schema = self._read(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.dir}/{name}.parque[t]")
