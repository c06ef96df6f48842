"""Reference SQL (DuckDB) for the registered queries, written from their definitions."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

AS_OF = 996_710_400 * 10**9
DAY = 86_400 * 10**9
SHIFT = 3_652 * DAY

# Common table expressions --------------------------------------------------------------------------
_SPANS = """
spans AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR),32,'0') AS trace_id,
         lpad(CAST(o_orderkey*10 AS VARCHAR),16,'0') AS span_id,
         CAST(NULL AS VARCHAR) AS parent_span_id,
         'gateway' AS service_name, o_orderpriority AS operation_name,
         epoch_us(o_orderdate)*1000 + (o_orderkey % 86400)*1000000000 AS start_ns,
         CAST(floor(o_totalprice) AS BIGINT)*10000 AS duration_ns,
         'server' AS kind,
         CASE WHEN o_orderstatus='F' THEN 'ok' ELSE 'unset' END AS status
  FROM orders
  UNION ALL
  SELECT lpad(CAST(l_orderkey AS VARCHAR),32,'0'),
         lpad(CAST(l_orderkey*10+l_linenumber AS VARCHAR),16,'0'),
         lpad(CAST(l_orderkey*10+l_linenumber-1 AS VARCHAR),16,'0'),
         'svc-'||CAST(l_linenumber AS VARCHAR)||'-'||CAST(max(l_suppkey)%3 AS VARCHAR),
         max(l_returnflag)||'/'||max(l_linestatus),
         max(epoch_us(o_orderdate))*1000 + (l_orderkey % 86400)*1000000000 + l_linenumber*1000000,
         CAST(floor(max(l_extendedprice)) AS BIGINT)*10000,
         CASE WHEN l_linenumber=1 THEN 'client' ELSE 'internal' END,
         CASE WHEN max(l_returnflag)='R' AND max(l_quantity)>45 THEN 'error' ELSE 'ok' END
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey
  GROUP BY l_orderkey, l_linenumber
)"""

_POINTS = """
points AS (
  SELECT epoch_us(ts)*1000 AS ts_ns,
         'user-'||CAST(user_id % 10 AS VARCHAR) AS service_name, event_type AS metric_name,
         CASE WHEN event_type='error' THEN 0.8::DOUBLE
              WHEN event_type='purchase' THEN value*20::DOUBLE+1000.5::DOUBLE ELSE value END AS value
  FROM events
)"""

_LOGS = """
logs AS (
  SELECT event_id, epoch_us(ts)*1000 AS ts_ns,
         'user-'||CAST(user_id % 10 AS VARCHAR) AS service_name,
         CASE WHEN event_id % 2 = 0 THEN lpad(CAST(event_id AS VARCHAR),32,'0') END AS trace_id,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
              WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS severity,
         CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9
              WHEN 'click' THEN 5 ELSE 1 END AS severity_number,
         event_type||' by user '||CAST(user_id AS VARCHAR)||' props '||props AS body
  FROM events
)"""

# One row per trace.
_T = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id
                               ORDER BY (parent_span_id IS NOT NULL)::INT, start_ns, span_id) AS rn
  FROM spans
),
T AS (
  SELECT trace_id,
         max(service_name) FILTER (WHERE rn=1) AS root_service,
         max(operation_name) FILTER (WHERE rn=1) AS root_operation,
         max(span_id) FILTER (WHERE rn=1) AS root_span_id,
         bool_or(parent_span_id IS NULL) AS has_root,
         count(*) AS span_count,
         min(start_ns) AS start_ns,
         max(start_ns+duration_ns) AS end_ns,
         max(start_ns+duration_ns)-min(start_ns) AS duration_ns,
         max(duration_ns) AS max_span_duration_ns,
         count(*) FILTER (WHERE status='error') AS error_count,
         count(*) FILTER (WHERE status='error') > 0 AS has_error,
         string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services,
         count(DISTINCT service_name) AS service_count
  FROM ranked GROUP BY trace_id
)"""

_SEARCH = """
X AS (
  SELECT trace_id, CASE WHEN has_root THEN root_service ELSE 'unknown' END AS root_service,
         CASE WHEN has_root THEN root_operation ELSE 'unknown' END AS root_operation,
         span_count, max_span_duration_ns AS duration_ns, start_ns, has_error, services
  FROM T
)"""

_RANKS = """
ordered AS (
  SELECT service_name, duration_ns, start_ns, status,
         row_number() OVER (PARTITION BY service_name ORDER BY duration_ns)-1 AS i,
         count(*) OVER (PARTITION BY service_name) AS n
  FROM spans
),
M AS (
  SELECT service_name, count(*) AS span_count,
         count(*) FILTER (WHERE status='error') AS error_count,
         CAST(count(*) FILTER (WHERE status='error') AS DOUBLE)/count(*) AS error_rate,
         CAST(count(*) AS DOUBLE)/60.0::DOUBLE AS request_rate,
         max(duration_ns) FILTER (WHERE i = n*50//100) AS p50_ns,
         max(duration_ns) FILTER (WHERE i = n*95//100) AS p95_ns,
         max(duration_ns) FILTER (WHERE i = n*99//100) AS p99_ns,
         CAST(sum(duration_ns)//count(*) AS BIGINT) AS avg_ns,
         min(duration_ns) AS min_ns, max(duration_ns) AS max_ns, max(start_ns) AS last_seen_ns
  FROM ordered GROUP BY service_name
)"""

_CALLS = """
calls AS (
  SELECT p.service_name AS src, c.service_name AS dst, c.duration_ns//1000 AS latency_us,
         c.status='error' AS failed, c.operation_name AS operation, c.trace_id
  FROM spans c JOIN spans p ON c.trace_id=p.trace_id AND c.parent_span_id=p.span_id
  WHERE p.service_name <> c.service_name
)"""

_EDGES = """
call_order AS (
  SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY latency_us)-1 AS i,
         count(*) OVER (PARTITION BY src, dst) AS n
  FROM calls
),
E AS (
  SELECT src AS "from", dst AS "to", count(*) AS call_count,
         count(*) FILTER (WHERE failed) AS error_count,
         CAST(sum(latency_us)//count(*) AS BIGINT) AS avg_latency_us,
         max(latency_us) FILTER (WHERE i = least(CAST(floor(n::DOUBLE*0.99::DOUBLE) AS BIGINT), n-1)) AS p99_latency_us,
         string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations
  FROM call_order GROUP BY src, dst
)"""

_NODES = """
N AS (
  SELECT service_name, count(*) AS request_count,
         CAST(count(*) FILTER (WHERE status='error') AS DOUBLE)/count(*) AS error_rate,
         CAST(sum(duration_ns//1000)//count(*) AS BIGINT) AS avg_latency_us,
         service_name NOT IN (SELECT "to" FROM E) AS is_root,
         service_name NOT IN (SELECT "from" FROM E) AS is_leaf
  FROM spans GROUP BY service_name
)"""

_TIERS = """
walk(s, d) AS (
  SELECT service_name, 0 FROM N WHERE is_root
  UNION
  SELECT E."to", d+1 FROM walk JOIN E ON E."from"=walk.s WHERE d < 30
),
reach AS (SELECT s, min(d) AS tier FROM walk GROUP BY s),
tiers AS (
  SELECT N.service_name,
         CAST(coalesce(tier, CASE WHEN (SELECT bool_or(is_root) FROM N) THEN (SELECT max(tier)+1 FROM reach) ELSE 0 END) AS INT) AS tier
  FROM N LEFT JOIN reach ON reach.s=N.service_name
)"""

_TREE = """
tree(trace_id, span_id, depth, under_root, services, keys) AS (
  SELECT s.trace_id, s.span_id, 0, s.parent_span_id IS NULL, s.service_name,
         lpad(CAST(s.start_ns AS VARCHAR),20,'0')||':'||s.span_id
  FROM spans s LEFT JOIN spans p ON s.trace_id=p.trace_id AND s.parent_span_id=p.span_id
  WHERE p.span_id IS NULL
  UNION ALL
  SELECT c.trace_id, c.span_id, depth+1, under_root, tree.services||'>'||c.service_name,
         keys||'/'||lpad(CAST(c.start_ns AS VARCHAR),20,'0')||':'||c.span_id
  FROM tree JOIN spans c ON c.trace_id=tree.trace_id AND c.parent_span_id=tree.span_id
)"""


def _histogram(source: str, buckets: int) -> str:
    return f"""
bounds AS (SELECT min(start_ns) AS low, max(end_ns) AS high FROM {source}),
placed AS (
  SELECT *, CAST(floor(CAST(start_ns-low AS DOUBLE)/CAST(high-low AS DOUBLE)*{buckets}) AS INT) AS bucket
  FROM {source}, bounds
),
H AS (
  SELECT CAST(r.range AS INT) AS bucket, count(trace_id) AS traces,
         count(*) FILTER (WHERE has_error) AS errors,
         count(*) FILTER (WHERE duration_ns > 1000000000) AS slow,
         coalesce(max(sv.services), 0) AS services,
         min(duration_ns) AS min_ns, max(duration_ns) AS max_ns,
         CAST(sum(duration_ns) AS DOUBLE)/count(trace_id) AS avg_ns
  FROM range({buckets}) r LEFT JOIN placed ON placed.bucket=r.range
  LEFT JOIN (SELECT bucket AS b, count(DISTINCT s) AS services
             FROM (SELECT bucket, unnest(string_split(services, ',')) AS s FROM placed) GROUP BY bucket) sv ON sv.b=r.range
  GROUP BY r.range
)"""


_FEATURES = """
FT AS (
  SELECT trace_id, coalesce(bool_or(status='error'), false) AS has_error, min(start_ns) AS start_ns,
         max(duration_ns) AS max_span_duration_ns, count(*) AS span_count,
         count(DISTINCT service_name) AS service_count,
         (max(start_ns+duration_ns)-min(start_ns))//1000000 AS duration_ms
  FROM spans GROUP BY trace_id
)"""

_MD5 = "(CAST('0x'||substr(md5(trace_id),1,8) AS BIGINT) % 10000)"

_TAIL = f"""
decided AS (
  SELECT *, CASE WHEN has_error THEN 'error' WHEN max_span_duration_ns > 1000000000 THEN 'slow'
                 WHEN span_count > 100 THEN 'complex' WHEN service_count > 5 THEN 'wide'
                 WHEN {_MD5} < 100 THEN 'sampled' ELSE 'normal' END AS reason
  FROM FT
),
tail AS (SELECT *, reason <> 'normal' AS keep FROM decided)"""

_PRIORITY = """
prio AS (
  SELECT *, CASE WHEN has_error THEN 'critical' WHEN duration_ms > 1000 THEN 'high'
                 WHEN span_count > 100 THEN 'medium' ELSE 'low' END AS priority
  FROM {source}
)"""


def _anomalies(partition: str) -> str:
    return f"""
A0 AS (
  SELECT trace_id, start_ns, has_error, span_count, service_count, duration_ns//1000000 AS duration_ms,
         root_operation AS root_service
  FROM T
),
A1 AS (
  SELECT *, count(*) OVER w AS n, sum(duration_ms) OVER w AS s,
         sum(CAST(duration_ms AS HUGEINT)*duration_ms) OVER w AS s2, sum(span_count) OVER w AS sp
  FROM A0 WINDOW w AS ({partition} ORDER BY start_ns, trace_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)
),
A2 AS (SELECT *, s//nullif(n,0) AS mean FROM A1),
A3 AS (SELECT *, (s2-2*mean*s+n*mean*mean)//nullif(n,0) AS variance FROM A2),
A4 AS (
  SELECT *, duration_ms > 5000 OR coalesce(n >= 100 AND
              CASE WHEN variance=0 THEN duration_ms <> mean
                   ELSE abs(CAST(duration_ms-mean AS DOUBLE))/sqrt(CAST(variance AS DOUBLE)) > 3.0 END, false) AS odd_duration,
         span_count > 500 OR coalesce(n >= 100 AND span_count > (sp//nullif(n,0))*5, false) AS odd_size,
         service_count > 10 AS odd_fan_out
  FROM A3
),
A AS (SELECT *, odd_duration OR odd_size OR odd_fan_out AS is_anomalous FROM A4)"""


_BYTES = """
SB AS (
  SELECT *, length(trace_id)+length(span_id)+length(service_name)+length(operation_name)
            + 9+length(kind)+48 + 16+3+48
            + 9+(CASE WHEN (duration_ns//10000)%2=0 THEN 4 ELSE 5 END)+48
            + 11+1+48 AS bytes
  FROM spans
)"""

_WINDOWS = """
W AS (
  SELECT service_name, ts_ns//{w}*{w} AS window_start, ts_ns//{w}*{w}+{w} AS window_end,
         count(*) AS requests, count(*) FILTER (WHERE value>0.5 AND value<=1.0) AS errors,
         count(*) FILTER (WHERE value>1000.0) AS latency_count,
         coalesce(sum(value) FILTER (WHERE value>1000.0), 0.0::DOUBLE) AS latency_sum,
         coalesce(quantile_disc(value, 0.95) FILTER (WHERE value>1000.0), 0.0::DOUBLE) AS p95
  FROM points GROUP BY ALL
)"""

_ROLLING = """
RH AS (
  SELECT service_name, window_start, window_end,
         CAST(sum(requests) OVER f AS BIGINT) AS requests,
         round(sum(requests) OVER f / greatest((window_end - min(window_start) OVER f)/1e9::DOUBLE, 1.0), 9) AS request_rate,
         round(CAST(sum(errors) OVER f AS DOUBLE)/sum(requests) OVER f*100, 6) AS error_rate,
         round(CASE WHEN sum(latency_count) OVER f > 0 THEN sum(latency_sum) OVER f/sum(latency_count) OVER f ELSE 0.0 END, 6) AS avg_latency_ms,
         p95 AS p95_latency_ms
  FROM W WINDOW f AS (PARTITION BY service_name ORDER BY window_start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
)"""

MINUTE, HOUR = 60 * 10**9, 3600 * 10**9


def _w(ns: int) -> str:
    return _WINDOWS.format(w=ns)


def sql(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = (f"WITH RECURSIVE {','.join(ctes)} {body}" if ctes else body).strip()


def _spans(name: str, body: str, *more: str) -> None:
    sql(name, body, _SPANS, *more)


_SLIM = "trace_id, span_id, parent_span_id, service_name, operation_name, start_ns, duration_ns, kind, status"
_HEADER = "trace_id, root_service, root_operation, span_count, duration_ns, start_ns, has_error, services"
_CODE = "CASE WHEN status='error' THEN '500' ELSE '200' END"

# Sources --------------------------------------------------------------------------------------------
_spans(
    "a1_otlp_round_trip",
    f"""SELECT trace_id, span_id, parent_span_id, service_name, operation_name, start_ns+{SHIFT} AS start_ns, duration_ns, kind,
        CASE WHEN status='error' THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN status='error' THEN 'returned' END AS status_message,
        {_CODE} AS http_status_code, 4 AS n_attributes
        FROM spans WHERE trace_id <> repeat('0', 32)""",
)
sql(
    "a2_otlp_metrics",
    """SELECT epoch_us(ts)*1000 AS ts_ns,
       CASE WHEN user_id % 10 <> 0 THEN 'user-'||CAST(user_id % 10 AS VARCHAR) ELSE 'unknown_service' END AS service_name,
       event_type AS metric_name,
       CASE event_type WHEN 'error' THEN value WHEN 'click' THEN floor(value) WHEN 'purchase' THEN value-50
            ELSE value/(event_id % 3) END AS value
       FROM events
       WHERE event_type IN ('error','click') OR (event_type='purchase' AND value-50 > 0)
          OR (event_type='signup' AND value > 0 AND event_id % 3 > 0)""",
)
sql(
    "a3_otlp_logs",
    """SELECT epoch_us(ts)*1000 AS ts_ns, 'unknown_service' AS service_name,
       CASE WHEN event_id % 2 = 0 THEN lpad(lower(to_hex(event_id)),32,'0') END AS trace_id,
       CASE WHEN s BETWEEN 1 AND 4 THEN 'TRACE' WHEN s BETWEEN 5 AND 8 THEN 'DEBUG' WHEN s BETWEEN 13 AND 16 THEN 'WARN'
            WHEN s BETWEEN 17 AND 20 THEN 'ERROR' WHEN s BETWEEN 21 AND 24 THEN 'FATAL' ELSE 'INFO' END AS severity,
       CASE WHEN s BETWEEN 1 AND 4 THEN 1 WHEN s BETWEEN 5 AND 8 THEN 5 WHEN s BETWEEN 13 AND 16 THEN 13
            WHEN s BETWEEN 17 AND 20 THEN 17 WHEN s BETWEEN 21 AND 24 THEN 21 ELSE 9 END AS severity_number,
       event_type AS body, props AS k
       FROM (SELECT *, event_id % 27 AS s FROM events)""",
)
sql(
    "a4_resource_columns",
    """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'unknown' END AS service_name,
       c_name AS host_name, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS INT) END AS process_pid,
       CAST(NULL AS VARCHAR) AS service_version FROM customer""",
)
sql(
    "a5_any_value_text",
    r"""SELECT p_partkey, '{a=['||p_name||', '||regexp_replace(CAST(p_retailprice AS VARCHAR), '\.0$', '')||', '||
       CAST(p_size AS VARCHAR)||', '||(CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END)||', ], b=bytes('||
       CAST(strlen(p_brand) AS VARCHAR)||')}' AS value_text FROM part""",
)
sql(
    "a6_event_attributes",
    """SELECT event_id, unnest(['event.0.name','event.0.time','event.0.props','event.1.name','event.1.time','event.1.props']) AS key,
       unnest([event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S')||
         (CASE WHEN epoch_us(ts)%1000000=0 THEN '' WHEN epoch_us(ts)%1000=0 THEN '.'||lpad(CAST(epoch_us(ts)%1000000//1000 AS VARCHAR),3,'0')
               ELSE '.'||lpad(CAST(epoch_us(ts)%1000000 AS VARCHAR),6,'0') END)||'+00:00', props,
         'end', '2023-11-14T22:13:20+00:00', 'x']) AS value FROM events""",
)
sql(
    "a7_kind_status",
    """SELECT CASE o_orderkey % 8 WHEN 2 THEN 'server' WHEN 3 THEN 'client' WHEN 4 THEN 'producer' WHEN 5 THEN 'consumer'
            ELSE 'internal' END AS kind,
       CASE o_orderkey % 5 WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unknown' END AS status, count(*) AS spans
       FROM orders GROUP BY 1, 2""",
)
_spans(
    "a8_validation",
    """SELECT CASE WHEN k=0 OR k%12=1 THEN 'trace_id_empty_or_zero' WHEN k%12=2 THEN 'span_id_empty_or_zero'
            WHEN k%12=3 THEN 'trace_id_too_long' WHEN k%12=4 THEN 'span_id_too_long' WHEN k%12=5 THEN 'start_time_zero'
            WHEN k%12=6 THEN 'end_time_zero' WHEN k%12=7 THEN 'end_before_start' WHEN k%12=8 THEN 'duration_too_long'
            WHEN k%12=9 THEN 'start_time_out_of_range' WHEN k%12=10 THEN 'end_time_out_of_range'
            WHEN k%12=11 THEN 'service_name_too_long' END AS reject_reason, count(*) AS spans
       FROM (SELECT CAST(trace_id AS BIGINT) AS k FROM spans) GROUP BY 1""",
)
_spans(
    "a9_compliance",
    """SELECT CASE WHEN k%3=0 THEN 'invalid_trace_id' WHEN k%3=1 THEN 'invalid_span_id'
            WHEN k%5=0 THEN 'missing_service_name' END AS compliance_error, count(*) AS spans
       FROM (SELECT CAST(trace_id AS BIGINT) AS k FROM spans) GROUP BY 1""",
)
_spans(
    "a10_traceparent",
    """SELECT span_id AS source_span,
       CASE WHEN status='unset' THEN '01'||substr(h,3) WHEN kind='client' THEN h||'-x' ELSE h END AS header,
       CASE WHEN good THEN trace_id END AS trace_id, CASE WHEN good THEN span_id END AS span_id,
       CASE WHEN good THEN CASE WHEN kind='server' THEN 1 ELSE 0 END END AS flags
       FROM (SELECT *, '00-'||trace_id||'-'||span_id||'-'||(CASE WHEN kind='server' THEN '01' ELSE '00' END) AS h,
             status<>'unset' AND kind<>'client' AS good FROM spans)""",
)
_spans(
    "a12_latest_spans",
    """SELECT trace_id, span_id, service_name, CASE WHEN kind='client' THEN 'cancelled' ELSE status END AS status,
       CASE WHEN kind='client' THEN 2 ELSE 1 END AS arrival FROM spans""",
)

# Damaged requests: every row of the table gives a line, of three kinds.
sql(
    "a1_malformed",
    """SELECT CASE event_id % 3 WHEN 0 THEN 'span' ELSE 'malformed_request' END AS outcome, event_id % 3 AS kind, count(*) AS lines
       FROM events GROUP BY ALL""",
)
sql(
    "a2_missing_time",
    """SELECT 'user-'||CAST(user_id % 10 AS VARCHAR) AS service_name, count(*) AS points,
       count(*) FILTER (WHERE event_id % 2 = 0) AS timed, count(*) FILTER (WHERE event_id % 2 = 1) AS stamped FROM events GROUP BY 1""",
)
sql(
    "a8_hex",
    """SELECT CASE WHEN o_orderkey = 0 THEN 'trace_id_empty_or_zero' ELSE CASE o_orderkey % 4 WHEN 1 THEN 'trace_id_not_hex' WHEN 2 THEN 'span_id_not_hex' WHEN 3 THEN 'parent_span_id_not_hex' END
       END AS reject_reason, count(*) AS spans FROM orders GROUP BY 1""",
)

# Exports --------------------------------------------------------------------------------------------
_spans(
    "b1_json_traces",
    f"""SELECT s.trace_id, 0 AS part, any_value(X.root_service) AS root_service, any_value(X.span_count) AS span_count,
        any_value(X.duration_ns) AS duration_ns, string_agg(span_id, ',' ORDER BY s.start_ns, span_id) AS span_ids,
        string_agg({_CODE}, ',' ORDER BY s.start_ns, span_id) AS codes
        FROM spans s JOIN X ON X.trace_id=s.trace_id
        GROUP BY s.trace_id""",
    _T, _SEARCH,
)
_spans(
    "b2_jaeger",
    """SELECT trace_id, span_id, start_ns//1000 AS start_us, duration_ns//1000 AS duration_us, operation_name, service_name,
       parent_span_id, CASE WHEN status='error' THEN 5 ELSE 4 END AS n_tags, status='error' AS error_tag FROM spans""",
)
_spans(
    "b3_otlp_export",
    """SELECT trace_id, service_name, CAST(count(*) AS INT) AS spans, string_agg(span_id, ',' ORDER BY start_ns, span_id) AS span_ids,
       string_agg(CASE kind WHEN 'server' THEN '2' WHEN 'client' THEN '3' ELSE '1' END, ',' ORDER BY start_ns, span_id) AS kinds,
       string_agg(CASE WHEN status='error' THEN '2' ELSE '1' END, ',' ORDER BY start_ns, span_id) AS codes,
       CAST(arg_min(start_ns+duration_ns, start_ns) AS VARCHAR) AS first_end FROM spans GROUP BY 1, 2""",
)
_CSV = """trace_id, span_id, coalesce(parent_span_id,'') AS parent_span_id, service_name AS service,
       operation_name AS operation, start_ns AS start_time, duration_ns,
       CASE WHEN status='error' THEN 'ERROR' ELSE 'OK' END AS status"""
_spans(
    "b4_csv_rows",
    f"""SELECT {_CSV}, '{{"span.kind":"'||kind||'","http.status_code":"'||{_CODE}||'","cache.hit":"'||
        (CASE WHEN (duration_ns//10000)%2=0 THEN 'true' ELSE 'false' END)||'","retry.count":"'||
        CAST((duration_ns//10000)%5 AS VARCHAR)||'"}}' AS attributes FROM spans""",
)
_spans(
    "b5_export_selection",
    f"""SELECT {_HEADER}, span_count AS spans_kept FROM (
        SELECT X.* FROM X JOIN (SELECT trace_id, max(start_ns) AS latest FROM spans GROUP BY 1) l USING (trace_id)
        WHERE start_ns >= {AS_OF - 900 * DAY} AND latest <= {AS_OF - 200 * DAY}
        ORDER BY start_ns DESC, trace_id LIMIT 1000) WHERE has_error""",
    _T, _SEARCH,
)
_spans("b6_export_trace", f"SELECT {_CSV} FROM spans WHERE trace_id = lpad('42',32,'0')")
_spans(
    "b8_partition_keys",
    f"""SELECT strftime(make_timestamp(start_ns//1000), '%Y%m%d') AS day_key,
        CAST(isoyear(make_timestamp(start_ns//1000)) AS VARCHAR)||'W'||lpad(CAST(week(make_timestamp(start_ns//1000)) AS VARCHAR),2,'0') AS week_key,
        strftime(make_timestamp(start_ns//1000), '%H') AS hour_key,
        CASE WHEN start_ns < {AS_OF - 365 * DAY} THEN 'cold' ELSE 'hot' END AS tier, count(*) AS spans
        FROM spans GROUP BY ALL""",
)
_MONTH = "strftime(make_timestamp(start_ns//1000), '%Y%m')"
_spans(
    "b8_written_tiers",
    f"""SELECT CASE WHEN start_ns < {AS_OF - 365 * DAY} THEN 'cold' ELSE 'hot' END AS tier, {_MONTH} AS dt,
        trace_id, span_id, service_name, start_ns, duration_ns FROM spans""",
)
_spans("x1_expire_pruned", f"SELECT {_MONTH} AS dt, trace_id, span_id FROM spans WHERE start_ns >= {AS_OF - 500 * DAY}")
_spans(
    "b9_trace_events",
    """SELECT trace_id, max(service_name) FILTER (WHERE k=1) AS service_name, count(*) AS span_count, min(start_ns) AS ts_ns
       FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, span_id) AS k FROM spans) GROUP BY trace_id""",
)
ORACLE["q4_event_feed"] = ORACLE["b9_trace_events"]

# Filters --------------------------------------------------------------------------------------------
for _name, _cond in {
    "c1_service": "service_name='svc-2-1'",
    "c2_operation": "operation_name='1-URGENT'",
    "c3_duration": "duration_ns//1000 > 1045000",
    "c4_status": "status IN ('unset','unknown')",
    "c5_ids": "trace_id=lpad('77',32,'0') OR span_id=lpad('1234',16,'0') OR parent_span_id=lpad('5551',16,'0')",
    "c6_kind": "kind='client'",
    "c7_attribute": "status='error'",
    "c8_not_equal": "status <> 'ok'",
    "c9_comparisons": "(duration_ns//10000)%5 >= 3 AND duration_ns//1000 <= 20000",
    "c10_regex": "regexp_matches(operation_name, '^[12]-.*[TH]$')",
    "c11_contains": "contains(operation_name, 'SPEC')",
    "c12_boolean": "(duration_ns//10000)%2=0 AND kind='server'",
    "c14_everything": "true",
    "c15_span_mode": "service_name='svc-1-0' AND (status='error' OR duration_ns//1000 > 1000000)",
    "c17_look_back": f"start_ns >= {AS_OF - 30 * DAY} AND service_name='gateway'",
}.items():
    _spans(_name, f"SELECT trace_id, max(start_ns) AS start_ns FROM spans WHERE {_cond} GROUP BY trace_id")
_spans(
    "c13_grouping",
    """SELECT trace_id, max(start_ns) AS start_ns FROM spans
       WHERE service_name='svc-1-0' OR status='error' OR duration_ns//1000 > 1000000 GROUP BY trace_id
       HAVING bool_or(service_name='svc-1-0') AND (bool_or(status='error') OR bool_or(duration_ns//1000 > 1000000))""",
)
_spans(
    "c16_envelope",
    """SELECT trace_id, start_ns, (SELECT count(*) FROM f) AS total_matches, (SELECT count(*) FROM f) > 250 AS limited
       FROM f ORDER BY start_ns DESC, trace_id LIMIT 250""",
    "f AS (SELECT trace_id, max(start_ns) AS start_ns FROM spans WHERE status='error' OR duration_ns//1000 > 900000 GROUP BY trace_id)",
)

_spans(
    "s1_intersection",
    """SELECT trace_id, max(start_ns) AS start_ns FROM spans WHERE service_name IN ('svc-1-0','svc-2-0')
       AND trace_id IN (SELECT trace_id FROM spans WHERE service_name='svc-1-0' INTERSECT SELECT trace_id FROM spans WHERE service_name='svc-2-0')
       GROUP BY 1""",
)
_spans("s2_union", "SELECT trace_id, max(start_ns) AS start_ns FROM spans WHERE service_name IN ('svc-6-0','svc-7-0') GROUP BY 1")
_spans("s3_distinct", "SELECT trace_id, string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services FROM spans GROUP BY 1")

# Lookups --------------------------------------------------------------------------------------------
_spans("d1_span_by_id", f"SELECT {_SLIM} FROM spans WHERE span_id=lpad('1234',16,'0')")
_spans("d1_root_span_by_id", f"SELECT {_SLIM} FROM spans WHERE span_id=lpad('1230',16,'0')")
_spans("d2_trace_spans", f"SELECT {_SLIM} FROM spans WHERE trace_id=lpad('42',32,'0')")
_spans("d3_service_spans", f"SELECT {_SLIM} FROM spans WHERE service_name='svc-2-1' AND start_ns >= {AS_OF - 400 * DAY}")
_spans("d4_active_services", "SELECT service_name, max(start_ns) AS last_seen_ns FROM spans GROUP BY 1")
_spans("d5_span_count", "SELECT count(*) AS span_count FROM spans")
_spans("d6_services_batch", "SELECT span_id, service_name FROM spans WHERE service_name IN ('svc-7-0','svc-7-2')")
_spans(
    "d7_search_spans",
    """SELECT trace_id, span_id, operation_name FROM spans WHERE contains(lower(operation_name),'urgent')
       ORDER BY start_ns DESC, trace_id, span_id LIMIT 200""",
)
_spans(
    "d7_search_attribute",
    """SELECT trace_id, span_id, status FROM spans
       WHERE service_name='svc-3-0' AND (contains(lower(operation_name),'500') OR status='error')
       ORDER BY start_ns DESC, trace_id, span_id LIMIT 1000""",
)
_spans("d8_root_spans", "SELECT trace_id, span_id, service_name, start_ns FROM spans WHERE parent_span_id IS NULL")
_spans("d8_child_spans", f"SELECT {_SLIM} FROM spans WHERE trace_id=lpad('123',32,'0') AND parent_span_id=lpad('1230',16,'0')")
_spans("d8_service_in_trace", f"SELECT {_SLIM} FROM spans WHERE trace_id=lpad('123',32,'0') AND service_name='gateway'")
_spans(
    "d9_store_statistics",
    """SELECT count(*) AS span_count, min(start_ns) AS oldest_ns, max(start_ns) AS newest_ns, CAST(sum(bytes) AS BIGINT) AS bytes,
       count(*) FILTER (WHERE status='error') AS error_count,
       CAST(count(*) FILTER (WHERE status='error') AS DOUBLE)/count(*) AS error_rate,
       CAST(sum(bytes) AS DOUBLE)/20000000.0::DOUBLE AS pressure,
       CASE WHEN sum(bytes)/20000000.0 >= 0.85 THEN 'critical' WHEN sum(bytes)/20000000.0 >= 0.7 THEN 'degraded' ELSE 'healthy' END AS health
       FROM SB""",
    _BYTES,
)
_spans(
    "d9_exact_counts",
    "SELECT count(*) AS span_count, count(DISTINCT trace_id) AS trace_count, count(DISTINCT service_name) AS service_count FROM spans",
)

# Traces ---------------------------------------------------------------------------------------------
_spans("g1_trace_summary", "SELECT * FROM T", _T)
_spans("g2_recent_traces", f"SELECT {_HEADER} FROM T ORDER BY start_ns DESC, trace_id LIMIT 100", _T)
_spans(
    "g2_recent_of_service",
    f"SELECT {_HEADER} FROM T WHERE list_contains(string_split(services,','),'svc-7-2') ORDER BY start_ns DESC, trace_id LIMIT 100",
    _T,
)
_spans("g3_search_summary", "SELECT * FROM X", _T, _SEARCH)
_spans(
    "g4_search_traces",
    f"""SELECT {_HEADER} FROM X WHERE trace_id IN (SELECT trace_id FROM spans WHERE contains(lower(operation_name),'urgent'))
        AND list_contains(string_split(services,','),'svc-4-1') AND has_error AND start_ns >= {AS_OF - 2000 * DAY}
        ORDER BY start_ns DESC, trace_id LIMIT 300""",
    _T, _SEARCH,
)
_spans(
    "g5_list_traces",
    f"""SELECT {_HEADER} FROM X WHERE services='gateway' AND start_ns >= {AS_OF - 2000 * DAY}
        AND trace_id IN (SELECT trace_id FROM spans GROUP BY 1 HAVING max(start_ns) <= {AS_OF - 100 * DAY})
        ORDER BY start_ns DESC, trace_id LIMIT 1000""",
    _T, _SEARCH,
)
_spans(
    "g5_list_traces_any",
    f"""SELECT {_HEADER} FROM X WHERE list_contains(string_split(services,','),'svc-5-1')
        AND trace_id IN (SELECT trace_id FROM spans GROUP BY 1 HAVING max(start_ns) <= {AS_OF - 300 * DAY})
        ORDER BY start_ns DESC, trace_id LIMIT 400""",
    _T, _SEARCH,
)
_spans("g6_error_traces", f"SELECT {_HEADER} FROM X WHERE has_error ORDER BY start_ns DESC, trace_id LIMIT 500", _T, _SEARCH)
ORACLE |= {"g2_kept_recent": ORACLE["g2_recent_traces"], "g5_kept_list": ORACLE["g5_list_traces"], "g6_kept_errors": ORACLE["g6_error_traces"]}
_spans(
    "g7_slow_traces",
    f"""SELECT {_HEADER} FROM X WHERE trace_id IN (SELECT trace_id FROM T WHERE duration_ns >= 3000000000)
        ORDER BY duration_ns DESC, start_ns DESC, trace_id LIMIT 200""",
    _T, _SEARCH,
)
_spans(
    "g7_slow_traces_newest",
    f"""SELECT {_HEADER} FROM X WHERE trace_id IN (SELECT trace_id FROM T WHERE duration_ns >= 3000000000
        ORDER BY start_ns DESC, trace_id LIMIT 10000) ORDER BY duration_ns DESC, start_ns DESC, trace_id LIMIT 200""",
    _T, _SEARCH,
)
_spans("o5_checked_limit", f"SELECT {_HEADER} FROM X WHERE has_error ORDER BY start_ns DESC, trace_id LIMIT 100", _T, _SEARCH)
_spans(
    "g7_slow_traces_whole",
    f"""SELECT {_HEADER} FROM X WHERE trace_id IN (SELECT trace_id FROM T WHERE duration_ns >= 1000000000)
        ORDER BY duration_ns DESC, start_ns DESC, trace_id LIMIT 200""",
    _T, _SEARCH,
)
_spans("g8_trace_features", "SELECT * FROM FT", _FEATURES)
_spans(
    "g9_dashboard",
    """SELECT count(*) AS traces, count(*) FILTER (WHERE has_error) AS errors,
       CAST(count(*) FILTER (WHERE has_error)*100 AS DOUBLE)/count(*) AS error_percent,
       CAST(sum(ms) AS DOUBLE)/count(*) AS avg_ms, CAST(sum(span_count) AS DOUBLE)/count(*) AS spans_per_trace,
       max(ms) FILTER (WHERE i = n-1-CAST(floor(n::DOUBLE*0.05::DOUBLE) AS BIGINT)) AS p95_ms
       FROM (SELECT *, row_number() OVER (ORDER BY ms)-1 AS i, count(*) OVER () AS n
             FROM (SELECT *, duration_ns//1000000 AS ms FROM T))""",
    _T,
)

# Services -------------------------------------------------------------------------------------------
_spans("j1_service_metrics", "SELECT * FROM M", _RANKS)
_spans(
    "j2_rank_percentiles",
    """SELECT operation_name, max(duration_ns) FILTER (WHERE i=n*50//100) AS p50, max(duration_ns) FILTER (WHERE i=n*95//100) AS p95,
       max(duration_ns) FILTER (WHERE i=CAST(floor((n-1)::DOUBLE*0.9::DOUBLE) AS BIGINT)) AS s90,
       max(duration_ns) FILTER (WHERE i=least(CAST(floor(n::DOUBLE*0.99::DOUBLE) AS BIGINT), n-1)) AS e99 FROM (
       SELECT operation_name, duration_ns, row_number() OVER (PARTITION BY operation_name ORDER BY duration_ns)-1 AS i,
              count(*) OVER (PARTITION BY operation_name) AS n FROM spans) GROUP BY 1""",
)
_spans("j3_approx_percentile", "SELECT DISTINCT service_name, true AS within_error FROM spans")
sql(
    "j4_sample_percentile",
    """SELECT service_name, max(value) FILTER (WHERE i=0) AS p0,
       max(value) FILTER (WHERE i=CAST(floor((n-1)::DOUBLE*0.5::DOUBLE) AS BIGINT)) AS p50,
       max(value) FILTER (WHERE i=CAST(floor((n-1)::DOUBLE*0.95::DOUBLE) AS BIGINT)) AS p95, max(value) FILTER (WHERE i=n-1) AS p100
       FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY value)-1 AS i,
             count(*) OVER (PARTITION BY service_name) AS n FROM points) GROUP BY service_name""",
    _POINTS,
)
_spans(
    "j6_services_in_order",
    "SELECT M.*, CASE service_name WHEN 'svc-3-1' THEN 0 ELSE 2 END AS pos FROM M WHERE service_name IN ('svc-3-1','gateway')",
    _RANKS,
)
_spans(
    "j7_active_spans",
    "SELECT service_name, CAST(floor(request_rate*(p50_ns/1000000000.0::DOUBLE)) AS BIGINT) AS active_spans FROM M",
    _RANKS,
)
_spans(
    "j8_service_list",
    """SELECT service_name, span_count, error_count, error_rate, p50_ns//1000 AS p50_us, p95_ns//1000 AS p95_us,
       p99_ns//1000 AS p99_us FROM M""",
    _RANKS,
)
_spans(
    "j9_running_rates",
    """SELECT service_name, count(*) AS span_count, count(*) FILTER (WHERE status='error') AS error_count,
       CAST(count(*) FILTER (WHERE status='error') AS DOUBLE)/count(*) AS error_rate,
       CAST(sum(duration_ns) AS DOUBLE)/count(*) AS mean_ns, min(duration_ns) AS min_ns, max(duration_ns) AS max_ns,
       max(start_ns) AS last_seen_ns FROM spans GROUP BY 1""",
)
ORACLE["q5_live_metrics"] = ORACLE["j9_running_rates"]
_spans(
    "j10_health_flags",
    "SELECT service_name, error_rate < 0.05 AS is_healthy, 1.0::DOUBLE-error_rate AS success_rate FROM M",
    _RANKS,
)
_SCALES = """
scales AS (
  SELECT service_name,
    CASE WHEN error_rate >= 0.05 THEN 'critical' WHEN error_rate >= 0.01 THEN 'warning' ELSE 'healthy' END AS by_fraction,
    CASE WHEN error_rate*100 = 0 THEN 'healthy' WHEN error_rate*100 < 1 THEN 'warning' ELSE 'critical' END AS by_percent,
    CASE WHEN error_rate*100 > 5.0 THEN 'critical' WHEN error_rate*100 > 1.0 THEN 'warning' ELSE 'healthy' END AS by_graph_percent,
    CASE WHEN error_rate > 0.1 THEN 'critical' WHEN error_rate > 0.01 THEN 'warning' ELSE 'healthy' END AS by_node,
    CASE WHEN p99_ns/1000000.0 >= 500 THEN 'critical' WHEN p99_ns/1000000.0 >= 100 THEN 'warning' ELSE 'healthy' END AS by_p99
  FROM M
)"""
_spans("j11_health_scales", "SELECT * FROM scales", _RANKS, _SCALES)
_spans("j11_health_counts", "SELECT by_fraction AS health, count(*) AS services FROM scales GROUP BY 1", _RANKS, _SCALES)
_spans(
    "j12_fleet_summary",
    """SELECT count(*) AS services, round(sum(request_rate), 6) AS total_rps, round(avg(error_rate), 9) AS avg_error_rate,
       max(p99_ns) AS max_p99_ns FROM M""",
    _RANKS,
)
sql(
    "j13_service_type",
    """SELECT name||'-'||CAST(s_suppkey AS VARCHAR) AS service_name, type FROM supplier JOIN (VALUES
       (0,'db','database'),(1,'postgres','database'),(2,'redis','cache'),(3,'apicache','cache'),(4,'external','external'),(5,'mail','service')
       ) k(i,name,type) ON s_suppkey % 6 = i""",
)
sql(
    "j14_merge_partials",
    """SELECT service_name, metric_name, round(sum(value),4) AS "sum", count(*) AS "count", min(value) AS "min", max(value) AS "max",
       round(sum(value)/count(*),6) AS "avg" FROM points GROUP BY 1,2""",
    _POINTS,
)
_spans(
    "j15_alerts",
    """SELECT service_name, span_count, error_rate*100 > 5.0 AS error_alert, p95_ns > 1000000000 AS latency_alert
       FROM M WHERE span_count >= 100 AND (error_rate*100 > 5.0 OR p95_ns > 1000000000)""",
    _RANKS,
)
sql(
    "j16_system_health",
    """SELECT p_partkey, severity, CASE WHEN severity <= 10 THEN 'healthy' WHEN severity <= 40 THEN 'degraded'
            WHEN severity <= 80 THEN 'unhealthy' ELSE 'critical' END AS health FROM (
       SELECT p_partkey, greatest(
         CASE WHEN p_size*12 > 480 THEN 100 WHEN p_size*12 > 400 THEN 50 ELSE 0 END,
         CASE WHEN p_partkey%110 > 90 THEN 100 WHEN p_partkey%110 > 70 THEN 50 ELSE 0 END,
         CASE WHEN p_retailprice%100/800 > 0.1 THEN 75 WHEN p_retailprice%100/800 > 0.05 THEN 25 ELSE 0 END,
         CASE WHEN p_partkey%130 > 100 THEN 75 WHEN p_partkey%130 > 50 THEN 25 ELSE 0 END) AS severity FROM part)""",
)
sql(
    "j17_errors_by_category",
    """SELECT severity AS name, count(*) AS errors, count(*)/(86400.0::DOUBLE*30) AS errors_per_second
       FROM logs WHERE severity IN ('ERROR','WARN') GROUP BY 1""",
    _LOGS,
)
sql(
    "j17_errors_by_operation",
    """SELECT service_name AS name, count(*) AS errors, count(*)/(86400.0::DOUBLE*30) AS errors_per_second
       FROM logs WHERE severity IN ('ERROR','WARN') AND trace_id IS NOT NULL GROUP BY 1""",
    _LOGS,
)
sql(
    "j17_newest_errors",
    """SELECT event_id, severity AS category, body FROM logs WHERE severity IN ('ERROR','WARN')
       ORDER BY ts_ns DESC, event_id DESC LIMIT 100""",
    _LOGS,
)
_spans(
    "j18_latency_ema",
    """SELECT service_name, count(*) AS samples,
       round(sum(ms*pow(0.9::DOUBLE, n-k)*CASE WHEN k=1 THEN 1.0 ELSE 0.1 END), 6) AS ema FROM (
       SELECT service_name, duration_ns/1e6::DOUBLE AS ms, count(*) OVER (PARTITION BY service_name) AS n,
              row_number() OVER (PARTITION BY service_name ORDER BY start_ns, span_id) AS k FROM spans) GROUP BY 1""",
)

# Graph ----------------------------------------------------------------------------------------------
sql(
    "h1_parent_child",
    """WITH l AS MATERIALIZED (
         SELECT l_orderkey AS k, l_linenumber AS n, max(l_suppkey)%3 AS s FROM lineitem
         WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2)
       SELECT lpad(CAST(c.k AS VARCHAR),32,'0') AS trace_id, lpad(CAST(c.k*10+c.n AS VARCHAR),16,'0') AS span_id,
              'svc-'||CAST(c.n AS VARCHAR)||'-'||CAST(c.s AS VARCHAR) AS service_name,
              CASE WHEN c.n=1 THEN 'gateway' ELSE 'svc-'||CAST(p.n AS VARCHAR)||'-'||CAST(p.s AS VARCHAR) END AS parent_service
       FROM l c LEFT JOIN l p ON p.k=c.k AND p.n=c.n-1 WHERE c.n=1 OR p.k IS NOT NULL""",
)
_spans("h2_service_edges", "SELECT * FROM E", _CALLS, _EDGES)
_spans("h3_service_nodes", "SELECT * FROM N", _CALLS, _EDGES, _NODES)
_spans("h4_service_tiers", "SELECT * FROM tiers", _CALLS, _EDGES, _NODES, _TIERS)


def _newest_map(where: str) -> str:
    """Spans of the newest 1000 traces, in place of all spans."""
    return (
        _SPANS.replace("spans AS", "all_spans AS", 1)
        + f""",
newest AS (SELECT trace_id FROM all_spans GROUP BY 1 HAVING {where} ORDER BY min(start_ns) DESC, trace_id LIMIT 1000),
spans AS (SELECT * FROM all_spans WHERE trace_id IN (SELECT trace_id FROM newest))"""
    )


sql("h5_service_map", "SELECT N.*, tier FROM N JOIN tiers USING (service_name)", _newest_map("true"), _CALLS, _EDGES, _NODES, _TIERS)
sql(
    "h5_service_map_edges",
    "SELECT * FROM E",
    _newest_map(f"min(start_ns) >= {AS_OF - 800 * DAY} AND max(start_ns) <= {AS_OF - 100 * DAY}"), _CALLS, _EDGES,
)
_spans("h6_focus", """SELECT * FROM E WHERE "from"='svc-2-1' OR "to"='svc-2-1'""", _CALLS, _EDGES)
_spans(
    "h6_hot_paths", """SELECT "from", "to", call_count FROM E ORDER BY call_count DESC, "from", "to" LIMIT 10""", _CALLS, _EDGES
)
_spans(
    "h6_error_paths",
    """SELECT "from", "to", error_count, CAST(error_count AS DOUBLE)/call_count*100 AS error_percent FROM E WHERE error_count > 0""",
    _CALLS, _EDGES,
)
sql(
    "h6_tier_groups",
    """SELECT tier, count(*) AS services, string_agg(service_name, ',' ORDER BY service_name) AS names,
       CAST(sum(request_count) AS BIGINT) AS requests FROM N JOIN tiers USING (service_name) GROUP BY 1""",
    _newest_map("true"), _CALLS, _EDGES, _NODES, _TIERS,
)
_spans(
    "h7_dependencies",
    """SELECT "from", "to", E.call_count, E.error_count, least(E.call_count/100.0::DOUBLE, 1.0::DOUBLE) AS strength,
       M.request_rate AS target_request_rate, M.error_rate AS target_error_rate, M.p95_ns AS target_p95_ns,
       (SELECT max(latency_us) FROM calls WHERE dst=E."to") AS target_max_latency_us
       FROM E LEFT JOIN M ON M.service_name=E."to" """,
    _CALLS, _EDGES, _RANKS,
)
_PATHS = """
visits AS (
  SELECT trace_id, service_name, start_ns, span_id FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id, service_name ORDER BY start_ns, span_id) AS k FROM spans) WHERE k=1
),
steps AS (
  SELECT trace_id, service_name AS source, lead(service_name) OVER o AS target, count(*) OVER (PARTITION BY trace_id) AS n
  FROM visits WINDOW o AS (PARTITION BY trace_id ORDER BY start_ns, span_id)
)"""
_spans(
    "h8_path_links",
    """SELECT source, target, requests, errors, latency_ns, CAST(requests AS DOUBLE)/max(requests) OVER ()*10+1 AS strength FROM (
       SELECT source, target, count(*) AS requests, count(*) FILTER (WHERE has_error) AS errors,
              max(lat) FILTER (WHERE k=1) AS latency_ns FROM (
         SELECT steps.*, T.has_error, CAST(T.duration_ns AS DOUBLE)/n AS lat,
                row_number() OVER (PARTITION BY source, target ORDER BY T.start_ns DESC, T.trace_id DESC) AS k
         FROM steps JOIN T USING (trace_id) WHERE target IS NOT NULL) GROUP BY 1,2)""",
    _T, _PATHS,
)
sql("h10_trace_logs", "SELECT event_id, ts_ns, severity, body FROM logs WHERE trace_id=lpad('100',32,'0')", _LOGS)
_spans(
    "h10_correlate_logs",
    """SELECT trace_id, event_id, severity, root_service, root_operation, has_error, T.duration_ns AS trace_duration_ns
       FROM logs JOIN T USING (trace_id)""",
    _T, _LOGS,
)
_spans(
    "h11_sequential_flow",
    """SELECT trace_id, prev AS from_span, span_id AS to_span, failed OR prev_failed AS failed FROM (
       SELECT *, status='error' AS failed, lag(span_id) OVER o AS prev, lag(start_ns) OVER o AS prev_start,
              lag(status='error') OVER o AS prev_failed
       FROM spans WINDOW o AS (PARTITION BY trace_id ORDER BY start_ns, span_id))
       WHERE prev IS NOT NULL AND (coalesce(parent_span_id=prev,false) OR start_ns-prev_start < 1000000)""",
)
_spans(
    "h12_unusual_path",
    """SELECT trace_id, CAST(service_count + has_error::INT AS INT) AS hops, service_count + has_error::INT > 10 OR has_error AS unusual FROM T""",
    _T,
)
_spans(
    "h12_call_paths",
    """SELECT trace_id, span_id, services AS path_text,
       len(string_split(services,'>')) > 10 OR len(list_distinct(string_split(services,'>'))) < len(string_split(services,'>')) AS unusual
       FROM tree t WHERE NOT EXISTS (SELECT 1 FROM spans c WHERE c.trace_id=t.trace_id AND c.parent_span_id=t.span_id)""",
    _TREE,
)

# Windows --------------------------------------------------------------------------------------------
_spans(
    "w1_newest_per_service",
    """SELECT service_name, span_id, start_ns FROM (
       SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY start_ns DESC, span_id DESC) AS k FROM spans) WHERE k <= 50""",
)
_spans(
    "w3_error_clusters",
    """SELECT min(bucket) AS bucket, count(*) AS buckets, CAST(max(ahead) AS BIGINT) AS max_errors FROM (
       SELECT *, bucket - row_number() OVER (ORDER BY bucket) AS island FROM (
         SELECT bucket, sum(errors) OVER (ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead FROM H)
       WHERE ahead > 95 AND bucket+5 <= 99) GROUP BY island""",
    _T, _histogram("T", 100),
)
_spans(
    "w4_traffic_spikes",
    """SELECT bucket, traces FROM (SELECT bucket, traces, lag(traces) OVER (ORDER BY bucket) AS b, lead(traces) OVER (ORDER BY bucket) AS a FROM H)
       WHERE traces > b*2 AND traces > a*2""",
    _T, _histogram("T", 5000),
)
_spans(
    "w5_anomalies",
    "SELECT trace_id, odd_duration, odd_size, odd_fan_out, is_anomalous FROM A",
    _T, _anomalies("PARTITION BY root_service"),
)

# Scalars --------------------------------------------------------------------------------------------
_spans("f1_span_bytes", "SELECT span_id, 100+bytes AS bytes FROM SB", _BYTES)
sql(
    "f2_log_bytes",
    "SELECT event_id, 64+strlen(body)+CASE WHEN severity='ERROR' THEN 48+3+5 ELSE 0 END AS bytes FROM logs",
    _LOGS,
)
_spans(
    "f3_span_columns",
    """SELECT span_id, start_ns+duration_ns AS end_ns, parent_span_id IS NULL AS is_root, status='error' AS is_error,
       duration_ns//1000000 AS duration_ms FROM spans""",
)
sql("f4_time_conversion", "SELECT event_id, epoch_us(ts)*1000 AS ts_ns, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
sql(
    "f7_severity",
    """SELECT CAST(s AS INT) AS number, CASE WHEN s BETWEEN 1 AND 4 THEN 'TRACE' WHEN s BETWEEN 5 AND 8 THEN 'DEBUG'
       WHEN s BETWEEN 13 AND 16 THEN 'WARN' WHEN s BETWEEN 17 AND 20 THEN 'ERROR' WHEN s BETWEEN 21 AND 24 THEN 'FATAL' ELSE 'INFO' END AS severity,
       count(*) AS records FROM (SELECT event_id % 30 - 2 AS s FROM events) GROUP BY 1,2""",
)
_spans("f8_hash_bucket", f"SELECT span_id, {_MD5} AS bucket FROM spans")
_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: strlen(t) > 2))"
sql("f9_tokens", f"SELECT token, count(*) AS documents FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY 1")
_spans(
    "f10_header_search",
    "SELECT trace_id, root_service FROM T WHERE contains(services,'svc-6-2') OR contains(lower(root_operation),'svc-6-2')",
    _T,
)
sql(
    "f11_pattern_positions",
    """SELECT doc_id AS event_id, CAST(count(*) FILTER (WHERE i < n) AS INT) AS hits,
       coalesce(string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i < n), '') AS positions FROM (
         SELECT doc_id, i, sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY i) + (i-1)*2 AS pos,
                count(*) OVER (PARTITION BY doc_id) AS n
         FROM (SELECT doc_id, unnest(string_split(text,'en')) AS part, generate_subscripts(string_split(text,'en'),1) AS i FROM documents))
       GROUP BY doc_id""",
)

# Metrics --------------------------------------------------------------------------------------------
sql(
    "k1_classify",
    """SELECT metric_name, value > 1000.0 AS is_latency, value > 0.5 AND value <= 1.0 AS is_error, count(*) AS points
       FROM points GROUP BY ALL""",
    _POINTS,
)
_W_COLUMNS = "service_name, window_start, window_end, requests, errors, latency_count, round(latency_sum,4) AS latency_sum, p95"
sql("k2_minute_windows", f"SELECT {_W_COLUMNS} FROM W", _POINTS, _w(MINUTE))
sql("k3_rolling_health", "SELECT * FROM RH", _POINTS, _w(HOUR), _ROLLING)
sql(
    "k4_cap_services",
    """SELECT service_name, service_name NOT IN (SELECT service_name FROM points GROUP BY 1 ORDER BY min(ts_ns), 1 LIMIT 6) AS rejected,
       count(*) AS points FROM points GROUP BY 1""",
    _POINTS,
)
sql("k5_metric_services", "SELECT DISTINCT service_name FROM points", _POINTS)
_LATEST = "SELECT * FROM RH QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY window_start DESC) = 1"
sql("k6_current_health", _LATEST, _POINTS, _w(DAY), _ROLLING)
sql(
    "k7_fleet_averages",
    f"""SELECT round(avg(request_rate),6) AS avg_request_rate, round(avg(error_rate),6) AS avg_error_rate,
        round(avg(avg_latency_ms),6) AS avg_latency_ms FROM ({_LATEST})""",
    _POINTS, _w(DAY), _ROLLING,
)


def _series(name: str, width: int, figure: str, where: str = "true") -> None:
    sql(
        name,
        f"""SELECT service_name, metric_name, ts_ns//{width}*{width} AS window_start, count(*) AS points, {figure} AS value
            FROM (SELECT *, row_number() OVER (PARTITION BY service_name, metric_name, ts_ns//{width} ORDER BY ts_ns, value) AS k,
                  count(*) OVER (PARTITION BY service_name, metric_name, ts_ns//{width}) AS n FROM points)
            WHERE {where} GROUP BY ALL""",
        _POINTS,
    )


_series("k8_time_series_sum", HOUR, "round(sum(value),4)", "metric_name='purchase'")
_series(
    "k8_time_series_rate", DAY,
    """CASE WHEN max(ts_ns) > min(ts_ns) THEN round((max(value) FILTER (WHERE k=n) - max(value) FILTER (WHERE k=1))
       /((max(ts_ns)-min(ts_ns))/1000000000.0::DOUBLE),9) END""",
    "metric_name='view'",
)
_series("k8_time_series_average", 900 * 10**9, "round(avg(value),6)")
_series("k8_time_series_percentile", DAY, "quantile_disc(value, 0.95)")

# Logs -----------------------------------------------------------------------------------------------
sql(
    "l1_search_logs",
    """SELECT event_id, ts_ns, body FROM logs WHERE list_has_any(regexp_split_to_array(lower(body),'[^a-z0-9]+'), ['purchase','signup'])
       ORDER BY ts_ns DESC, event_id DESC LIMIT 300""",
    _LOGS,
)
sql(
    "l1_search_documents",
    f"SELECT doc_id AS event_id, source AS service_name FROM documents WHERE list_has_any({_TOKENS}, ['the','und','leaux'])",
)
sql(
    "l1_token_index",
    f"SELECT doc_id AS event_id, doc_id AS ts_ns FROM documents WHERE list_has_any({_TOKENS}, ['the','und','leaux']) ORDER BY doc_id DESC LIMIT 100",
)
ORACLE["l1_written_index"] = ORACLE["l1_token_index"]
sql(
    "l2_logs_by_service",
    "SELECT event_id, ts_ns, severity FROM logs WHERE service_name='user-3' ORDER BY ts_ns DESC, event_id DESC LIMIT 150",
    _LOGS,
)
sql(
    "l3_minimum_severity",
    "SELECT event_id, severity FROM logs WHERE severity_number >= 13 ORDER BY ts_ns DESC, event_id DESC LIMIT 1000",
    _LOGS,
)
sql("l4_recent_logs", "SELECT event_id, severity FROM logs ORDER BY ts_ns DESC, event_id DESC LIMIT 200", _LOGS)
sql(
    "l5_severity_counts",
    "SELECT severity, count(*) AS logs, CAST(sum(strlen(body)) AS BIGINT) AS bytes, count(trace_id) AS with_trace FROM logs GROUP BY 1",
    _LOGS,
)
sql(
    "l5_distinct_terms",
    """SELECT count(DISTINCT t) AS terms FROM (SELECT unnest(regexp_split_to_array(lower(body),'[^a-z0-9]+')) AS t FROM logs)
       WHERE strlen(t) > 2""",
    _LOGS,
)
sql("l6_retain_logs", "SELECT event_id, ts_ns FROM logs ORDER BY ts_ns DESC, event_id DESC LIMIT 3000", _LOGS)
sql(
    "l7_log_statistics",
    """SELECT count(*) AS total_logs, count(*) FILTER (WHERE severity IN ('ERROR','FATAL')) AS errors,
       count(*) FILTER (WHERE severity='WARN') AS warnings, count(trace_id) AS with_trace,
       CAST(sum(strlen(body)) AS BIGINT) AS bytes, count(DISTINCT trace_id) AS traced_logs FROM logs""",
    _LOGS,
)
sql(
    "l8_logs_around_traces",
    f"""SELECT s.trace_id, count(*) AS logs, min(event_id) AS first_log FROM logs l JOIN (
        SELECT service_name||'-'||CAST(ts_ns//{DAY} AS VARCHAR) AS trace_id, service_name, min(ts_ns) AS a, max(ts_ns) AS b
        FROM points WHERE metric_name='purchase' GROUP BY ALL) s
        ON l.service_name=s.service_name AND l.ts_ns BETWEEN s.a AND s.b GROUP BY 1""",
    _LOGS, _POINTS,
)
_AMONG = f"""
moved AS (
  SELECT trace_id, span_count, 1704067200000000000 + start_ns % {30 * DAY} AS start_ns, 1704067200000000000 + start_ns % {30 * DAY} + duration_ns AS end_ns,
         'user-'||CAST(CAST(trace_id AS BIGINT) % 10 AS VARCHAR) AS one, 'user-'||CAST((CAST(trace_id AS BIGINT)+span_count) % 10 AS VARCHAR) AS two FROM T
),
reach AS (
  SELECT trace_id, start_ns - {3600 * 10**9} AS a, end_ns + {3600 * 10**9} AS b, one AS service_name FROM moved
  UNION SELECT trace_id, start_ns - {3600 * 10**9}, end_ns + {3600 * 10**9}, two FROM moved
),
signals AS (
  SELECT 'log' AS signal, service_name, ts_ns, body AS text, CAST(NULL AS DOUBLE) AS value, severity IN ('ERROR','FATAL') AS failed FROM logs
  UNION ALL SELECT 'metric', service_name, ts_ns, metric_name, value, false FROM points
),
around AS (
  SELECT r.trace_id, s.* FROM reach r JOIN signals s ON s.service_name = r.service_name AND s.ts_ns BETWEEN r.a AND r.b
)"""
_spans("l8_context_rows", "SELECT trace_id, signal, service_name, ts_ns, text, value, failed FROM around", _T, _LOGS, _POINTS, _AMONG)
_spans(
    "l8_trace_context",
    """SELECT m.trace_id, span_count, start_ns, end_ns, coalesce(logs, 0) AS logs, coalesce(log_errors, 0) AS log_errors,
       coalesce(points, 0) AS points, round(coalesce(value_sum, 0.0::DOUBLE), 4) AS value_sum, context_start_ns, context_end_ns
       FROM moved m LEFT JOIN (
         SELECT trace_id, count(*) FILTER (WHERE signal='log') AS logs, count(*) FILTER (WHERE failed) AS log_errors,
                count(*) FILTER (WHERE signal='metric') AS points, sum(value) AS value_sum,
                min(ts_ns) AS context_start_ns, max(ts_ns) AS context_end_ns FROM around GROUP BY 1) a ON a.trace_id = m.trace_id""",
    _T, _LOGS, _POINTS, _AMONG,
)
_spans(
    "l8_cross_signal",
    """SELECT signal, service_name, ts_ns, text FROM (
       SELECT 'span' AS signal, service_name, start_ns AS ts_ns, operation_name AS text FROM spans WHERE contains(lower(operation_name),'error')
       UNION ALL SELECT 'log', service_name, ts_ns, body FROM logs WHERE list_contains(regexp_split_to_array(lower(body),'[^a-z0-9]+'),'error')
       UNION ALL SELECT 'metric', service_name, ts_ns, metric_name FROM points WHERE contains(lower(metric_name),'error'))
       ORDER BY ts_ns DESC, signal, service_name, text LIMIT 300""",
    _LOGS, _POINTS,
)
_spans(
    "l8_service_overview",
    """SELECT service_name, CAST(sum(a) AS BIGINT) AS spans, CAST(sum(b) AS BIGINT) AS span_errors, CAST(sum(c) AS BIGINT) AS logs,
       CAST(sum(d) AS BIGINT) AS log_errors, CAST(sum(e) AS BIGINT) AS points FROM (
       SELECT service_name, 1 AS a, (status='error')::INT AS b, 0 AS c, 0 AS d, 0 AS e FROM spans
       UNION ALL SELECT service_name, 0, 0, 1, (severity IN ('ERROR','FATAL'))::INT, 0 FROM logs
       UNION ALL SELECT service_name, 0, 0, 0, 0, 1 FROM points) GROUP BY 1""",
    _LOGS, _POINTS,
)

# Trees ----------------------------------------------------------------------------------------------
_spans("v1_span_depth", "SELECT trace_id, span_id, depth, under_root FROM tree", _TREE)
_spans(
    "v2_waterfall",
    """SELECT trace_id, span_id, service_name,
       round(CASE WHEN b > a THEN CAST(start_ns-a AS DOUBLE)/CAST(b-a AS DOUBLE)*100 ELSE 0.0 END, 6) AS start_percent,
       round(CASE WHEN b > a THEN CAST(duration_ns AS DOUBLE)/CAST(b-a AS DOUBLE)*100 ELSE 0.0 END, 6) AS width_percent
       FROM (SELECT *, min(start_ns) OVER (PARTITION BY trace_id) AS a, max(start_ns+duration_ns) OVER (PARTITION BY trace_id) AS b FROM spans)""",
)
_spans(
    "v3_self_times",
    """SELECT s.trace_id, s.span_id, s.service_name, s.operation_name, s.duration_ns,
       s.duration_ns - coalesce((SELECT CAST(sum(c.duration_ns) AS BIGINT) FROM spans c
                                 WHERE c.trace_id=s.trace_id AND c.parent_span_id=s.span_id), 0) AS self_ns FROM spans s""",
)
_spans("v4_trace_depths", "SELECT trace_id, max(depth) AS max_depth FROM tree GROUP BY 1", _TREE)
_spans("v5_preorder", "SELECT trace_id, span_id, depth AS level, keys AS sort_key FROM tree WHERE under_root", _TREE)
_spans(
    "v5_positions",
    """SELECT trace_id, span_id, depth AS level, row_number() OVER (PARTITION BY trace_id ORDER BY keys) - 1 AS position,
       (SELECT count(*) FROM tree b WHERE b.trace_id = a.trace_id AND (b.keys = a.keys OR starts_with(b.keys, a.keys||'/'))) AS subtree
       FROM tree a WHERE under_root""",
    _TREE,
)
_spans(
    "v6_speed_class",
    """SELECT service_name, CASE WHEN status='error' THEN 'error' WHEN duration_ns > 1000000000 THEN 'slow'
       WHEN duration_ns > 100000000 THEN 'medium' ELSE 'fast' END AS speed, count(*) AS spans FROM spans GROUP BY 1,2""",
)
_spans("v7_time_histogram", "SELECT * FROM H", _T, _histogram("T", 100))
_spans(
    "v8_flow_rows",
    """SELECT * FROM (SELECT trace_id, start_ns, root_service AS source, coalesce(string_split(services,',')[2],'unknown') AS destination,
       root_operation AS path, CASE WHEN has_error THEN 500 ELSE 200 END AS status_code, duration_ns AS latency_ns,
       CASE WHEN has_error THEN 'ERROR' ELSE 'FORWARDED' END AS verdict FROM T)
       WHERE (contains(source,'svc-1') OR contains(destination,'svc-1')) AND verdict='ERROR'""",
    _T,
)
_spans(
    "v9_active_traces",
    "SELECT service_name, CAST(floor(request_rate*(p95_ns/1000000.0::DOUBLE)/1000.0::DOUBLE) AS BIGINT) AS active_traces FROM M",
    _RANKS,
)

# Sampling -------------------------------------------------------------------------------------------
_spans(
    "p2_service_rates",
    f"""SELECT trace_id, span_id, service_name FROM (SELECT *, CASE service_name WHEN 'gateway' THEN 1.0 WHEN 'svc-1-0' THEN 0.0
        WHEN 'svc-2-1' THEN 0.5 ELSE 0.25 END AS rate FROM spans) WHERE rate >= 1 OR (rate > 0 AND {_MD5}/10000.0 < rate)""",
)
_spans("p1_uniform", f"SELECT span_id FROM spans WHERE {_MD5.replace('trace_id', "trace_id||span_id||'7'")} < 1000")
_spans(
    "p3_head_decision",
    f"""SELECT span_id, CASE WHEN {_MD5} < 100 THEN 'keep' WHEN {_MD5} < 2500 THEN 'defer' ELSE 'drop' END AS decision FROM spans""",
)
_spans("p4_tail_decisions", "SELECT trace_id, reason, keep FROM tail", _FEATURES, _TAIL)
_spans(
    "p4_kept_spans",
    "SELECT service_name, count(*) AS spans FROM spans WHERE trace_id IN (SELECT trace_id FROM tail WHERE keep) GROUP BY 1",
    _FEATURES, _TAIL,
)
_spans(
    "p5_budgeted",
    f"""SELECT trace_id, priority, CAST(bytes AS BIGINT) AS bytes, CASE WHEN over THEN 'over_budget' ELSE reason END AS reason,
        reason <> 'not_sampled' AND NOT over AS keep FROM (
        SELECT *, reason IN ('sampled','not_sampled') AND 100000 + coalesce(sum(CASE WHEN reason <> 'not_sampled' THEN bytes END) OVER
               (ORDER BY start_ns, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 800000 AS over FROM (
        SELECT *, CASE WHEN has_error THEN 'error' WHEN duration_ms > 1000 THEN 'slow' WHEN is_anomalous THEN 'anomalous'
          WHEN {_MD5} < CASE priority WHEN 'critical' THEN 10000 WHEN 'high' THEN 5000 WHEN 'medium' THEN 1000 ELSE 100 END
          THEN 'sampled' ELSE 'not_sampled' END AS reason FROM prio JOIN (SELECT trace_id, sum(bytes) AS bytes FROM SB GROUP BY 1) USING (trace_id)))""",
    _T, _BYTES, _anomalies("PARTITION BY root_service"), _PRIORITY.format(source="A"),
)
_spans(
    "p5_smart_decisions",
    f"""SELECT trace_id, priority, reason, reason NOT IN ('over_budget','not_sampled') AS keep FROM (
        SELECT *, CASE WHEN has_error THEN 'error' WHEN duration_ms > 1000 THEN 'slow' WHEN is_anomalous THEN 'anomalous'
          WHEN {_MD5} < CASE priority WHEN 'critical' THEN 10000 WHEN 'high' THEN 5000 WHEN 'medium' THEN 1000 ELSE 100 END
          THEN 'sampled' ELSE 'not_sampled' END AS reason FROM prio)""",
    _T, _anomalies("PARTITION BY root_service"), _PRIORITY.format(source="A"),
)
_spans(
    "p6_adaptive_rates",
    """SELECT interval, rate FROM fold WHERE i > 0""",
    _FEATURES,
    f"""
load AS MATERIALIZED (
  SELECT start_ns//{DAY} AS interval, count(*)/86400.0::DOUBLE AS tps,
         CAST(count(*) FILTER (WHERE has_error) AS DOUBLE)/count(*) AS error_rate,
         row_number() OVER (ORDER BY start_ns//{DAY}) AS i
  FROM FT GROUP BY start_ns//{DAY}
),
fold(i, interval, rate) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(100 AS BIGINT)
  UNION ALL
  SELECT load.i, load.interval,
    CASE WHEN error_rate > 0.05
         THEN least(10*least(greatest(CAST(trunc(rate*least(greatest(0.7::DOUBLE/greatest(tps,1.0::DOUBLE),0.5::DOUBLE),1.5::DOUBLE)) AS BIGINT),1),10000),10000)
         ELSE least(greatest(CAST(trunc(rate*least(greatest(0.7::DOUBLE/greatest(tps,1.0::DOUBLE),0.5::DOUBLE),1.5::DOUBLE)) AS BIGINT),1),10000) END
  FROM fold JOIN load ON load.i = fold.i+1
)""",
)
_spans(
    "p7_anomaly_counts",
    """SELECT root_service, count(*) FILTER (WHERE is_anomalous) AS anomalous, count(*) FILTER (WHERE odd_fan_out) AS odd_fan_out
       FROM A GROUP BY 1""",
    _T, _anomalies(""),
)
_spans(
    "p8_budget_plan",
    """SELECT trace_id, priority, CAST(upto AS BIGINT) AS bytes_upto,
       upto + 1000000 < CASE priority WHEN 'critical' THEN 20000000 WHEN 'high' THEN 16000000 WHEN 'medium' THEN 12000000 ELSE 8000000 END AS admitted
       FROM (SELECT *, sum(bytes) OVER (ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END,
                                        start_ns, trace_id ROWS UNBOUNDED PRECEDING) AS upto
             FROM prio JOIN (SELECT trace_id, sum(bytes) AS bytes FROM SB GROUP BY 1) USING (trace_id))""",
    _BYTES, _FEATURES, _PRIORITY.format(source="FT"),
)
_spans(
    "p9_budget_statistics",
    """SELECT used AS used_bytes, ema AS avg_trace_bytes, CAST(30000000 AS BIGINT) AS budget_bytes, 30000000-used AS available_bytes,
       CAST(6000000 AS BIGINT) AS reserved_bytes, CAST(used AS DOUBLE)/30000000*100 AS usage_percent,
       greatest(30000000-used,0)//greatest(ema,1) AS traces_remaining,
       CAST(CASE WHEN used > 27000000 THEN 6000000 WHEN used > 24000000 THEN 3000000 ELSE 0 END AS BIGINT) AS cleanup_bytes FROM (
       SELECT CAST(sum(bytes) AS BIGINT) AS used,
              CAST(floor(sum(bytes*pow(0.9::DOUBLE, n-k)*0.1::DOUBLE) + 10000.0::DOUBLE*pow(0.9::DOUBLE, max(n))) AS BIGINT) AS ema FROM (
         SELECT bytes, count(*) OVER () AS n, row_number() OVER (ORDER BY start_ns, trace_id) AS k
         FROM (SELECT trace_id, min(start_ns) AS start_ns, sum(bytes) AS bytes FROM SB GROUP BY 1)))""",
    _BYTES,
)
_spans(
    "p10_exact_baselines",
    """SELECT service_name, max(ms) FILTER (WHERE i=n*50//100) AS p50_ms, max(ms) FILTER (WHERE i=n*95//100) AS p95_ms,
       max(ms) FILTER (WHERE i=n*99//100) AS p99_ms, count(*) AS samples FROM (
       SELECT service_name, duration_ns//1000000 AS ms, row_number() OVER (PARTITION BY service_name ORDER BY duration_ns)-1 AS i,
              count(*) OVER (PARTITION BY service_name) AS n FROM spans) GROUP BY 1""",
)
_spans("p11_priority", "SELECT priority, count(*) AS traces FROM prio GROUP BY 1", _FEATURES, _PRIORITY.format(source="FT"))
_spans(
    "p12_decision_statistics",
    """SELECT count(*) AS evaluated, count(*) FILTER (WHERE keep) AS kept,
       CAST(count(*) FILTER (WHERE keep) AS DOUBLE)/count(*) AS keep_ratio FROM tail""",
    _FEATURES, _TAIL,
)

# Retention ------------------------------------------------------------------------------------------
_spans("x1_expire", f"SELECT trace_id, span_id FROM spans WHERE start_ns >= {AS_OF - 500 * DAY}")
ORACLE["x1_expire_by_day"] = ORACLE["x1_expire"]
_spans(
    "x2_drop_incomplete",
    f"""SELECT trace_id, span_id FROM spans WHERE trace_id NOT IN (SELECT trace_id FROM spans GROUP BY 1
        HAVING count(*)=1 AND max(start_ns) < {AS_OF - 300 * DAY - 300 * 10**9})""",
)
_spans(
    "x3_drop_idle",
    f"""SELECT trace_id, span_id FROM spans WHERE service_name IN (SELECT service_name FROM spans GROUP BY 1
        HAVING max(start_ns) > {AS_OF - 2 * DAY})""",
)
_spans(
    "x4_keep_newest",
    "SELECT trace_id, span_id, start_ns FROM spans ORDER BY start_ns DESC, trace_id, span_id LIMIT 12345",
)
_spans(
    "x5_trace_caps",
    """SELECT trace_id, span_id FROM (
       SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns DESC, span_id DESC) AS k FROM spans) WHERE k <= 2""",
)
_MAINTAINED = f"""
k1 AS (SELECT * FROM spans WHERE start_ns >= {AS_OF - 1000 * DAY}),
k2 AS (SELECT * FROM k1 WHERE trace_id NOT IN (SELECT trace_id FROM k1 GROUP BY 1
       HAVING count(*)=1 AND max(start_ns) < {AS_OF - 300 * 10**9})),
k3 AS (SELECT * FROM k2 WHERE service_name IN (SELECT service_name FROM k2 GROUP BY 1 HAVING max(start_ns) > {AS_OF - 2 * DAY}))"""
_spans(
    "x6_maintain",
    """SELECT trace_id, span_id FROM k3 ORDER BY start_ns DESC, trace_id, span_id LIMIT 5000""",
    _MAINTAINED,
)
ORACLE["x6_maintained_rows"] = ORACLE["x6_maintain"]
_spans(
    "x6_maintain_table",
    f"""SELECT dt, count(*) AS rows_before, count(keep) AS rows_after,
        CASE WHEN count(keep) = 0 THEN 'removed' WHEN count(keep) < count(*) THEN 'cut' ELSE 'compacted' END AS action
        FROM (SELECT {_MONTH} AS dt, kept.span_id AS keep FROM spans s LEFT JOIN
              (SELECT trace_id, span_id FROM k3 ORDER BY start_ns DESC, trace_id, span_id LIMIT 5000) kept
              ON kept.trace_id = s.trace_id AND kept.span_id = s.span_id) GROUP BY dt""",
    _MAINTAINED,
)

# Streaming: the batch result, less what the watermark has not closed yet -----------------------------
_spans(
    "q1_ingest",
    f"""SELECT trace_id, span_id, parent_span_id, service_name, operation_name, start_ns+{SHIFT} AS start_ns, duration_ns, kind,
       CASE WHEN status='error' THEN 'error' ELSE 'ok' END AS status FROM spans WHERE trace_id <> repeat('0', 32)""",
)
sql("q2_metric_windows", f"SELECT {_W_COLUMNS} FROM W", _POINTS, _w(MINUTE))
_spans(
    "q3_tail_sampling",
    "SELECT trace_id, span_count, reason, keep FROM tail",
    _FEATURES, _TAIL,
)
_spans(
    "a11_quarantine",
    """SELECT output, reason, count(*) AS "rows" FROM (
       SELECT CASE WHEN trace_id = repeat('0', 32) OR service_name='gateway' THEN 'rejected' ELSE 'spans' END AS output,
              CASE WHEN trace_id = repeat('0', 32) THEN 'trace_id_empty_or_zero' WHEN service_name='gateway' THEN 'start_time_zero' END AS reason FROM spans
       UNION ALL SELECT 'malformed', 'malformed_request' FROM customer
       UNION ALL SELECT 'malformed', 'malformed_request' FROM supplier) GROUP BY 1, 2""",
)
_spans(
    "q3_released_spans",
    """SELECT s.trace_id, s.span_id, s.duration_ns, reason, reason <> 'normal' AS keep, late FROM early_or_late s JOIN decided d ON d.trace_id = s.trace_id""",
    "early_or_late AS (SELECT *, CAST(right(span_id, 1) AS INTEGER) >= 6 AS late FROM spans)",
    _FEATURES.replace("FROM spans", "FROM early_or_late WHERE NOT late"),
    _TAIL,
)
_spans(
    "q6_live_edges",
    """SELECT src AS "from", dst AS "to", count(*) AS call_count, count(*) FILTER (WHERE failed) AS error_count,
       CAST(sum(latency_us) AS BIGINT) AS total_us FROM calls GROUP BY 1,2""",
    _CALLS,
)
_spans("q7_deduplicated", "SELECT trace_id, span_id, start_ns FROM spans")
sql(
    "q8_sliding_windows",
    f"""SELECT service_name, window_start, window_start+{5 * MINUTE} AS window_end, count(*) AS requests,
        count(*) FILTER (WHERE value>0.5 AND value<=1.0) AS errors, count(*) FILTER (WHERE value>1000.0) AS latency_count,
        round(coalesce(sum(value) FILTER (WHERE value>1000.0), 0.0::DOUBLE),4) AS latency_sum,
        coalesce(quantile_disc(value, 0.95) FILTER (WHERE value>1000.0), 0.0::DOUBLE) AS p95
        FROM (SELECT *, unnest([ts_ns//{MINUTE}*{MINUTE} - k*{MINUTE} for k in range(5)]) AS window_start FROM points)
        GROUP BY ALL""",
    _POINTS,
)
