"""The same questions as :mod:`servelens.plans.queries` in plain SQL, for an independent check."""

from __future__ import annotations

DAY_MS = 86_400_000
HOUR_MS = 3_600_000

# --- shared projections ------------------------------------------------------------------------

REQUESTS = """
requests_v AS (
  SELECT event_id AS request_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value, k,
         concat('user-', user_id) AS user_name, concat('team-', user_id % 5) AS team,
         concat('model-', k % 4) AS base_model,
         CASE WHEN k % 3 = 0 THEN concat('lora-', k % 2) END AS lora,
         CASE WHEN k % 3 = 0 THEN concat('model-', k % 4, '#lora-', k % 2)
              ELSE concat('model-', k % 4) END AS requested_model,
         CASE event_type WHEN 'view' THEN '/v1/models' WHEN 'signup' THEN '/v1/embeddings'
              WHEN 'purchase' THEN '/v1/completions' ELSE '/v1/chat/completions' END AS path,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         CAST(round(value * 1000) AS BIGINT) AS latency_us, k % 10 = 0 AS stream,
         concat('container_', user_id % 6) AS container_id, concat('host-', user_id % 6) AS host,
         CAST(k AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)
),
forwarded AS (SELECT *, base_model AS model FROM requests_v WHERE path <> '/v1/models'),
with_shadow AS (
  SELECT request_id, ts_ms, model, status, latency_us FROM forwarded
  UNION ALL
  SELECT request_id, ts_ms, concat('shadow:', base_model), status,
         latency_us + 1000 * (prompt_tokens % 7)
  FROM forwarded WHERE prompt_tokens % 10 = 9
),
usage_v AS (
  SELECT user_name, base_model AS model, prompt_tokens, completion_tokens, ts_ms FROM forwarded
  WHERE status = 200 AND NOT stream
  UNION ALL
  SELECT user_name, requested_model, prompt_tokens, completion_tokens, ts_ms FROM forwarded
  WHERE stream
),
billed AS (
  SELECT user_name, model, sum(greatest(prompt_tokens, 0)) AS tokens_in,
         sum(greatest(completion_tokens, 0)) AS tokens_out
  FROM usage_v WHERE prompt_tokens > 0 OR completion_tokens > 0 GROUP BY 1, 2
),
depth_v AS (
  SELECT container_id, host, ts_ms, request_id AS event_id, CAST(prompt_tokens % 20 AS INT) AS depth
  FROM requests_v
),
roster_v AS (
  SELECT DISTINCT CAST(user_id % 6 AS INT) AS ord, container_id, host,
         concat('dep-', user_id % 6 % 2) AS deployment
  FROM requests_v
)
"""


def req(body: str, *extra: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([REQUESTS, *extra]) + body


ORACLE: dict[str, str] = {}

# --- columns -----------------------------------------------------------------------------------

ORACLE["split_model_ref"] = req(
    """
SELECT request_id,
       CASE WHEN p > 1 AND p < length(ref) THEN substr(ref, 1, p - 1) ELSE ref END AS base,
       CASE WHEN p > 1 AND p < length(ref) THEN substr(ref, p + 1) END AS lora
FROM (SELECT request_id, ref, instr(ref, '#') AS p FROM (
  SELECT request_id, CASE WHEN k % 7 = 0 THEN '#' || base_model WHEN k % 7 = 1 THEN base_model || '#'
    WHEN k % 7 = 2 THEN base_model || '#a#b' ELSE requested_model END AS ref FROM requests_v))
"""
)
ORACLE["resolve_identity"] = req(
    """
SELECT request_id, user_name, 'anonymous' AS direct_user,
       CASE k % 3 WHEN 0 THEN concat('203.0.113.', k) WHEN 1 THEN concat('198.51.100.', k)
            ELSE concat('192.0.2.', k) END AS client_ip
FROM requests_v
"""
)
ORACLE["classify_endpoint"] = req(
    """
SELECT request_id, CASE WHEN p LIKE '%/models' THEN 'models'
  WHEN p LIKE '%/completions' OR p LIKE '%/embeddings' THEN 'inference'
  WHEN p LIKE '%/usage' THEN 'usage' ELSE 'not_found' END AS endpoint
FROM (SELECT request_id, CASE k % 11 WHEN 0 THEN '/v1/usage' WHEN 1 THEN '/x/' || path || '/more'
      ELSE path END AS p FROM requests_v)
"""
)
CHECKED = """
checked AS (
  SELECT *, CASE WHEN k % 50 = 4 THEN 'method_not_allowed' WHEN k % 50 = 3 THEN 'invalid_json'
                 WHEN k % 50 IN (1, 2) THEN 'missing_model' END AS request_error
  FROM requests_v
)"""
ORACLE["validate_request"] = req(
    """
SELECT request_id, CAST(CASE WHEN request_error = 'method_not_allowed' THEN 405
                             WHEN request_error IS NOT NULL THEN 400 END AS INT) AS request_status,
       request_error, CASE WHEN request_error IS NULL THEN requested_model END AS model,
       stream AND k % 50 <> 3 AS stream
FROM checked
""",
    CHECKED,
)
ORACLE["validate_usage_report"] = req(
    """
SELECT request_id, usage_error,
       CAST(CASE WHEN usage_error = 'method_not_allowed' THEN 405
                 WHEN usage_error IS NULL THEN 200 ELSE 400 END AS INT) AS usage_status,
       CASE WHEN usage_error IS NULL THEN
         CASE WHEN k % 20 IN (3, 4, 5) THEN 'm' ELSE requested_model END END AS usage_model,
       CASE WHEN usage_error IS NULL THEN CASE WHEN k % 20 = 4 THEN 0 ELSE prompt_tokens END END
         AS prompt_tokens,
       CASE WHEN usage_error IS NULL THEN CASE WHEN k % 20 = 4 THEN prompt_tokens
         WHEN k % 20 IN (3, 5) THEN 0 ELSE completion_tokens END END AS completion_tokens
FROM (SELECT *, CASE k % 20 WHEN 6 THEN 'method_not_allowed' WHEN 0 THEN 'empty_body'
        WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'missing_model'
        WHEN 3 THEN CASE WHEN k > 0 THEN 'invalid_tokens' END END AS usage_error FROM requests_v)
"""
)
ORACLE["redact_env"] = """
SELECT event_id, unnest(['PUBLIC_VAR', 'dbPassword', concat('API_', user_id, '_Token'),
                         concat('NAME_', user_id)]) AS name,
       unnest([event_type, '***REDACTED***', '***REDACTED***', event_type]) AS shown
FROM events
"""
ORACLE["parse_query_string"] = r"""
SELECT page_id,
       CAST(3 + (url LIKE '%?%page=%')::INT + (url LIKE '%utm_source=%')::INT AS BIGINT) AS params,
       nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
       concat('z ', page_id) AS ref,
       nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source,
       '%zz' AS raw, 'a b' AS plus, CAST(NULL AS VARCHAR) AS bad
FROM pages
"""
PAGES = """
page_v AS (
  SELECT page_id, url, split_part(url, '://', 2) AS full_tail,
         regexp_extract(url, '://([^/?#]*)', 1) AS host
  FROM pages
)"""
ORACLE["safe_host"] = (
    "WITH "
    + PAGES
    + r""",
c AS (
  SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INT) AS pos, unnest(h) AS candidate
  FROM (SELECT page_id, [host,
    concat(page_id % 256, '.', (page_id * 7) % 256, '.', (page_id * 3) % 300, '.1'),
    concat('127.', page_id % 10, '.0.1'), concat('169.254.', page_id % 256, '.1'),
    concat(page_id % 300, '.1'), concat('a..', host), concat('-', host), concat(host, ';rm'),
    CASE page_id % 3 WHEN 0 THEN 'localhost' WHEN 1 THEN '' END] AS h FROM page_v)
),
n AS (
  SELECT *, string_split(candidate, '.') AS parts FROM c
),
v AS (
  SELECT *, regexp_full_match(candidate, '[0-9.]+') AS numeric_name,
    CASE WHEN NOT regexp_full_match(candidate, '[0-9]+(\.[0-9]+){1,3}') THEN NULL
         WHEN len(parts) = 4 AND list_max(list_transform(parts, lambda x: TRY_CAST(x AS BIGINT))) <= 255
           THEN CAST(parts[1] AS BIGINT) * 16777216 + CAST(parts[2] AS BIGINT) * 65536
                + CAST(parts[3] AS BIGINT) * 256 + CAST(parts[4] AS BIGINT)
         WHEN len(parts) = 3 AND TRY_CAST(parts[1] AS BIGINT) <= 255
              AND TRY_CAST(parts[2] AS BIGINT) <= 255
           THEN CAST(parts[1] AS BIGINT) * 16777216 + CAST(parts[2] AS BIGINT) * 65536
                + CAST(parts[3] AS BIGINT)
         WHEN len(parts) = 2 AND TRY_CAST(parts[1] AS BIGINT) <= 255
           THEN CAST(parts[1] AS BIGINT) * 16777216 + CAST(parts[2] AS BIGINT) END AS ip
  FROM n
)
SELECT page_id, pos, candidate,
  coalesce(length(candidate) BETWEEN 1 AND 253 AND candidate NOT LIKE '%..%'
    AND regexp_full_match(candidate,
      '[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*')
    AND CASE WHEN numeric_name THEN ip IS NOT NULL AND ip <> 0 AND ip // 16777216 <> 127
               AND ip // 65536 <> 43518 AND ip // 16777216 NOT BETWEEN 224 AND 239
             ELSE lower(candidate) <> 'localhost' END, false) AS safe
FROM v
"""
)
ORACLE["safe_path"] = (
    "WITH "
    + PAGES
    + r""",
p AS (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('hdfs:///', full_tail)
    WHEN 1 THEN concat('/', full_tail) WHEN 2 THEN full_tail
    WHEN 3 THEN concat('/', full_tail, '; rm') WHEN 4 THEN concat('/a', chr(10), page_id) END AS path
  FROM page_v
)
SELECT page_id,
  path IS NULL OR path = '' OR (NOT regexp_matches(path, '[\s;&|`$()<>"''\\*?]')
    AND (path LIKE 'hdfs://%' OR path LIKE '/%')) AS safe,
  page_id % 2 = 1 AS bind_ok,
  CASE WHEN path LIKE 'hdfs://%' THEN './models' WHEN path LIKE '/%' THEN path ELSE '/models' END
    AS repository
FROM p
"""
)
ORACLE["audit_launcher_configs"] = r"""
WITH c AS (
  SELECT p_partkey AS n, p_partkey % 70000 AS http, p_partkey % 11 - 1 AS metrics,
    9000 + p_partkey % 3 AS admin, p_partkey % 5 - 1 AS lo, p_partkey % 7 AS hi,
    CAST(p_partkey % 13 AS DOUBLE) / CAST(10 AS DOUBLE) AS up,
    CAST(p_partkey % 9 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(0.1 AS DOUBLE) AS down,
    CASE WHEN p_partkey % 14 = 0 THEN 0 ELSE 9001 END AS proxy,
    ['1g.10gb', '0.5', '.25', '1.0', '2.0', '1g10gb', ''][p_partkey % 7 + 1] AS slice,
    CAST(p_partkey % 12 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(0.05 AS DOUBLE) AS shadow
  FROM part
), v AS (
  SELECT n, unnest([
    CASE WHEN n % 9 = 0 THEN 'model_repository' END,
    CASE WHEN n % 10 = 1 THEN 'secrets_path' END,
    CASE WHEN n % 8 = 0 THEN 'bind_address' END,
    CASE WHEN http <= 0 OR http > 65535 THEN 'http_port' END,
    CASE WHEN metrics <= 0 THEN 'metrics_port' END,
    CASE WHEN lo < 0 THEN 'min_containers' END,
    CASE WHEN hi < lo THEN 'max_containers' END,
    CASE WHEN up <= 0 OR up > 1 THEN 'scale_up_threshold' END,
    CASE WHEN down < 0 OR down >= up THEN 'scale_down_threshold' END,
    CASE WHEN n % 4 = 0 AND n % 8 <> 0 THEN 'tls_keystore' END,
    CASE WHEN n % 2 = 0 AND proxy <= 0 THEN 'proxy_port' END,
    CASE WHEN n % 2 = 0 AND proxy = admin THEN 'proxy_port_clash' END,
    CASE WHEN slice IN ('2.0', '1g10gb') THEN 'slice_size' END,
    CASE WHEN shadow < 0 OR shadow > 1 THEN 'shadow_rate' END,
    CASE WHEN shadow > 0 AND n % 3 <> 0 THEN 'shadow_endpoint' END]) AS violation FROM c
)
SELECT n AS config_id, violation FROM v WHERE violation IS NOT NULL
"""

DEPLOYMENTS = """
d AS (
  SELECT o_orderkey AS n, concat('dep-', o_orderkey) AS name,
    CASE WHEN o_orderkey % 17 <> 0 THEN concat('img:', o_orderpriority) END AS image,
    CASE WHEN o_orderkey % 19 <> 0 THEN concat('hdfs:///m/', o_custkey) END AS model_repository,
    CAST(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 13 ELSE 1 END AS INT) AS replicas,
    CAST(CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 4 ELSE 1 END AS INT) AS tensor_parallelism,
    CAST(CASE WHEN o_orderkey % 5 = 2 THEN 2 ELSE 1 END AS INT) AS pipeline_parallelism,
    CASE WHEN o_orderkey % 2 = 0 THEN ['nvidia_gpu', 'amd_gpu', 'intel_gaudi', 'aws_neuron',
      'cpu_only', 'tpu'][o_orderkey % 6 + 1] ELSE 'nvidia_gpu' END AS accelerator_type,
    CAST(CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 3 ELSE 1 END AS INT) AS accelerator_count,
    CASE WHEN o_orderkey % 12 = 0 THEN 'bogus' ELSE 'composite' END AS scaling_mode,
    CAST(CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 5 - 1 ELSE 1 END AS INT) AS min_replicas,
    o_orderkey % 5 AS variants
  FROM orders
),
t AS (
  SELECT n, name, d.image AS base_image, d.model_repository AS base_repository, replicas,
    CAST(i - 1 AS INT) AS pos, concat('v', i) AS variant,
    CAST(CASE WHEN (n + i) % 11 <> 0 THEN (n * (i + 3)) % 7 END AS INT) AS weight,
    CASE WHEN (n + i) % 3 = 0 THEN concat('image:', i) END AS image,
    CASE WHEN (n + i) % 5 = 0 THEN CASE WHEN (n + i) % 2 = 0 THEN '' ELSE concat('s3://v/', i) END
      END AS model_repository
  FROM d, unnest(range(1, variants + 1)) AS r(i)
)"""
ORACLE["audit_deployments"] = (
    "WITH "
    + DEPLOYMENTS
    + """,
v AS (
  SELECT name, unnest([
    CASE WHEN image IS NULL THEN 'image_required' END,
    CASE WHEN model_repository IS NULL THEN 'model_repository_required' END,
    CASE WHEN tensor_parallelism < 1 THEN 'tensor_parallelism_minimum' END,
    CASE WHEN accelerator_type = 'tpu' THEN 'accelerator_type_enum' END,
    CASE WHEN scaling_mode = 'bogus' THEN 'scaling_mode_enum' END,
    CASE WHEN min_replicas < 0 THEN 'min_replicas_minimum' END,
    CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.n = d.n AND weight IS NULL) THEN 'variant_weight' END
  ]) AS violation FROM d
)
SELECT name, violation FROM v WHERE violation IS NOT NULL
"""
)
ORACLE["normalise_category"] = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 6 = 0 THEN 'GPU_UTIL' WHEN o_orderkey % 6 = 1 THEN 'QUEUE_DEPTH'
       ELSE 'COMPOSITE' END AS mode,
  coalesce(['AMD_GPU', 'CPU_ONLY', 'AWS_NEURON', 'NVIDIA_GPU', 'INTEL_GAUDI'][o_orderkey % 7 + 1],
           'NVIDIA_GPU') AS accelerator,
  CASE o_orderkey % 7 WHEN 0 THEN 'amd.com/gpu' WHEN 1 THEN NULL WHEN 2 THEN 'aws.amazon.com/neuron'
       WHEN 4 THEN 'habana.ai/gaudi' ELSE 'yarn.io/gpu' END AS resource
FROM orders
"""
ORACLE["normalised_load"] = req(
    """,
x AS (
  SELECT request_id, CASE WHEN k % 9 = 0 THEN 0
      ELSE least(1, greatest(0, value / CAST(250 AS DOUBLE) - CAST(0.1 AS DOUBLE))) END AS gpu,
    greatest(0, k - 10) AS depth, CAST(user_id % 4 AS INT) AS n, greatest(1, k % 3 * 8) AS cap
  FROM requests_v
), y AS (
  SELECT *, CASE WHEN n = 0 THEN CASE WHEN depth = 0 THEN 0 ELSE 1 END
    ELSE least(1, CAST(depth AS DOUBLE) / n / cap) END AS queue FROM x
)
SELECT request_id AS event_id, CAST(gpu AS DOUBLE) AS gpu_load, CAST(queue AS DOUBLE) AS queue_load,
       CAST(greatest(gpu, queue) AS DOUBLE) AS composite_load FROM y
"""
)
ORACLE["retry_after"] = req(
    """
SELECT request_id, greatest(1, CAST(floor((latency_us - 1000 + 999) / 1000.0) AS BIGINT)) AS seconds
FROM requests_v
"""
)
ORACLE["safe_counter_key"] = req(
    """
SELECT CASE WHEN k % 5 <> 0 THEN concat(team, '_', user_name) ELSE 'unknown' END AS user_name,
       coalesce(lora, 'unknown') AS model, count(*) AS requests
FROM requests_v GROUP BY 1, 2
"""
)

# --- joins -------------------------------------------------------------------------------------

ACCESS = """
access_v AS (
  SELECT *, CASE WHEN team = 'team-4' THEN base_model = 'model-0' ELSE true END AS base_allowed,
    CASE WHEN lora IS NULL THEN true WHEN team = 'team-4' THEN false ELSE true END AS lora_allowed
  FROM requests_v
)"""
ORACLE["evaluate_access"] = req(
    "SELECT request_id, base_allowed, base_allowed AND lora_allowed AS allowed FROM access_v", ACCESS
)
ORACLE["evaluate_access_large_policy"] = req(
    r""",
g AS (
  SELECT c_custkey % 40 = 0 AS is_group,
    CASE WHEN c_custkey % 40 = 0 THEN concat('team-', c_custkey % 5)
         ELSE concat('user-', c_custkey) END AS principal,
    lower(CASE c_custkey % 6 WHEN 0 THEN concat('model-', c_custkey % 4)
      WHEN 1 THEN concat('MODEL-', c_custkey % 4, '#*')
      WHEN 2 THEN concat('model-?#lora-', c_custkey % 2) WHEN 3 THEN concat('*-', c_custkey % 4)
      WHEN 4 THEN concat('mod%l-', c_custkey % 4)
      ELSE concat('model-', c_custkey % 4, '#lora-', c_custkey % 2) END) AS glob
  FROM customer WHERE c_custkey % 5 <> 4
),
q AS (
  SELECT r.request_id, r.lora,
    EXISTS (SELECT 1 FROM g WHERE g.principal = CASE WHEN is_group THEN r.team ELSE r.user_name END
            AND r.base_model GLOB g.glob) AS base_allowed,
    EXISTS (SELECT 1 FROM g WHERE g.principal = CASE WHEN is_group THEN r.team ELSE r.user_name END
            AND r.requested_model GLOB g.glob) AS full_allowed
  FROM requests_v r
)
SELECT request_id, base_allowed, base_allowed AND (lora IS NULL OR full_allowed) AS allowed FROM q
"""
)
ORACLE["visible_catalog"] = req(
    """,
u AS (SELECT DISTINCT user_name, team FROM requests_v),
g AS (
  SELECT c_custkey % 50 = 0 AS is_group,
    CASE WHEN c_custkey % 50 = 0 THEN concat('team-', c_custkey % 5)
         ELSE concat('user-', c_custkey) END AS principal,
    CASE WHEN c_custkey % 3 = 0 THEN concat('model-', c_custkey, '*')
         ELSE concat('model-', c_custkey) END AS glob
  FROM customer
),
m AS (SELECT concat('model-', p_partkey) AS model, concat('lora-', p_partkey % 2) AS adapter,
             p_partkey % 2 = 0 AS loaded FROM part),
ug AS (SELECT u.user_name, g.glob FROM u JOIN g
       ON g.principal = CASE WHEN is_group THEN u.team ELSE u.user_name END),
listed AS (SELECT DISTINCT user_name, model, adapter, loaded FROM ug JOIN m ON m.model GLOB ug.glob)
SELECT user_name, 'model' AS kind, model, CAST(NULL AS VARCHAR) AS adapter FROM listed
UNION ALL
SELECT DISTINCT l.user_name, 'adapter', l.model, l.adapter FROM listed l JOIN ug
  ON ug.user_name = l.user_name AND concat(l.model, '#', l.adapter) GLOB ug.glob
UNION ALL
SELECT user_name, 'loaded', model, NULL FROM listed WHERE loaded
"""
)
RULED = """
ruled AS (
  SELECT *, CASE WHEN user_name = 'user-1' AND base_model = 'model-0' THEN 1
                 WHEN user_name = 'user-2' THEN 2 WHEN team = 'team-1' THEN 3 ELSE 4 END AS rule,
    CASE WHEN rule = 1 THEN 'user-1' WHEN rule = 2 THEN 'user-2' END AS rule_user,
    CASE WHEN rule = 3 THEN 'team-1' END AS rule_group,
    CASE WHEN rule = 1 THEN 'model-0' ELSE '*' END AS rule_model,
    CAST([2, 0, 5, 40][rule] AS INT) AS rpm,
    ['u:user-1|model-0', NULL, 'g:team-1|*', '*|*'][rule] AS bucket
  FROM requests_v
)"""
ORACLE["match_quota_rule"] = req(
    "SELECT request_id, rule_user, rule_group, rule_model, rpm, bucket FROM ruled", RULED
)
ORACLE["match_quota_rule_large_policy"] = req(
    """,
r AS (
  SELECT CASE WHEN c_custkey % 8 >= 4 THEN concat('user-', c_custkey) END AS rule_user,
    CASE WHEN c_custkey % 4 >= 2 THEN concat('team-', c_custkey % 5) END AS rule_group,
    CASE WHEN c_custkey % 2 = 1 THEN concat('model-', c_custkey % 4) ELSE '*' END AS rule_model,
    CAST(c_custkey % 9 AS INT) AS rpm,
    c_custkey % 8 * -1000000000 + c_custkey AS rule_ord
  FROM customer
),
b AS (
  SELECT q.request_id, r.*, row_number() OVER (PARTITION BY q.request_id ORDER BY rule_ord) AS rn
  FROM requests_v q LEFT JOIN r ON (r.rule_user IS NULL OR r.rule_user = q.user_name)
    AND (r.rule_group IS NULL OR r.rule_group = q.team)
    AND (r.rule_model = '*' OR r.rule_model = q.base_model)
)
SELECT request_id, rule_user, rule_group, rule_model, rpm,
  CASE WHEN rpm > 0 THEN concat(CASE WHEN rule_user IS NOT NULL THEN 'u:' || rule_user
    WHEN rule_group IS NOT NULL THEN 'g:' || rule_group ELSE '*' END, '|', rule_model) END AS bucket
FROM b WHERE rn = 1
"""
)
ORACLE["rules_asof"] = req(
    f""",
v AS (
  SELECT CAST(n_nationkey AS INT) AS version,
         1704067200000 + n_nationkey * {DAY_MS} + n_nationkey * 1000 AS valid_from_ms
  FROM nation WHERE n_nationkey % 4 <> 1
)
SELECT request_id, (SELECT max_by(version, valid_from_ms) FROM v WHERE valid_from_ms <= q.ts_ms)
  AS version
FROM requests_v q
"""
)
ROUTES = f"""
ticks AS (
  SELECT DISTINCT ts_ms // {HOUR_MS} AS tick FROM requests_v
),
grid AS (
  SELECT t.tick, r.container_id, r.host, r.ord, d.depth FROM ticks t CROSS JOIN roster_v r
  ASOF LEFT JOIN (
    SELECT container_id, ts_ms // {HOUR_MS} + 1 AS tick, max_by(depth, event_id) AS depth
    FROM depth_v GROUP BY 1, 2) d
  ON d.container_id = r.container_id AND d.tick <= t.tick
),
routes AS (
  SELECT tick, container_id AS routed_container, host AS routed_host,
         coalesce(depth, 0) AS routed_depth
  FROM grid
  QUALIFY row_number() OVER (PARTITION BY tick ORDER BY coalesce(depth, 0), host, ord) = 1
)"""
ORACLE["route_least_loaded"] = req(
    f"""
SELECT request_id, routed_container, routed_host, routed_depth
FROM forwarded f LEFT JOIN routes r ON r.tick = f.ts_ms // {HOUR_MS}
""",
    ROUTES,
)
CARD = """
recent AS (
  SELECT model, latency_us FROM with_shadow
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts_ms DESC, request_id DESC) <= 1000
),
card AS (
  SELECT c.*, p50_us, p95_us, p99_us, CAST(errors AS DOUBLE) / requests AS error_rate FROM
    (SELECT model, count(*) AS requests, count(*) FILTER (status // 100 = 2) AS success,
            count(*) FILTER (status // 100 <> 2) AS errors FROM with_shadow GROUP BY 1) c
  JOIN (SELECT model, quantile_disc(latency_us, 0.5) AS p50_us,
               quantile_disc(latency_us, 0.95) AS p95_us,
               quantile_disc(latency_us, 0.99) AS p99_us, count(*) AS samples
        FROM with_shadow GROUP BY 1) q USING (model)
)"""
ORACLE["shadow_compare"] = req(
    """
SELECT model, p.requests AS primary_requests, p.error_rate AS primary_error_rate,
  p.p50_us AS primary_p50_us, p.p95_us AS primary_p95_us, p.p99_us AS primary_p99_us,
  s.requests AS shadow_requests, s.error_rate AS shadow_error_rate, s.p50_us AS shadow_p50_us,
  s.p95_us AS shadow_p95_us, s.p99_us AS shadow_p99_us,
  s.error_rate - p.error_rate AS delta_error_rate, s.p50_us - p.p50_us AS delta_p50_us,
  s.p95_us - p.p95_us AS delta_p95_us, s.p99_us - p.p99_us AS delta_p99_us
FROM (SELECT * FROM card WHERE model NOT LIKE 'shadow:%') p
FULL JOIN (SELECT * REPLACE (substr(model, 8) AS model) FROM card WHERE model LIKE 'shadow:%') s
USING (model)
""",
    CARD,
)
ORACLE["merge_token_counters"] = req(
    "SELECT user_name, model, CAST(tokens_in AS BIGINT) AS tokens_in,"
    " CAST(tokens_out AS BIGINT) AS tokens_out, CAST(tokens_in + tokens_out AS BIGINT) AS total"
    " FROM billed"
)
ORACLE["reconcile_snapshot"] = """
WITH desired AS (
  SELECT DISTINCT concat('be-', o_orderkey % 5) AS backend, concat('inst-', o_orderkey % 3000)
    AS instance, o_orderkey % 3000 AS inst_ord FROM orders
),
slots AS (
  SELECT concat('be-', p_partkey % 5) AS backend, concat('slot-', p_partkey) AS slot,
    p_partkey AS slot_ord,
    CASE WHEN p_partkey % 3 = 0 THEN concat('inst-', p_partkey - p_partkey % 2)
         ELSE concat('old-', p_partkey) END AS instance,
    p_partkey % 4 % 2 AS admin_state FROM part
),
held AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.backend, s.instance
                                 ORDER BY s.admin_state <> 0, slot_ord) AS rn
  FROM slots s JOIN desired d USING (backend, instance)
),
chosen AS (SELECT * FROM held WHERE rn = 1),
free AS (
  SELECT s.*, row_number() OVER (PARTITION BY backend ORDER BY slot_ord) AS r FROM slots s
  WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.backend = s.backend AND c.slot = s.slot)
),
fresh AS (
  SELECT d.*, row_number() OVER (PARTITION BY backend ORDER BY inst_ord) AS r FROM desired d
  WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.backend = d.backend AND c.instance = d.instance)
)
SELECT backend, instance, slot, CASE WHEN admin_state = 0 THEN 'keep' ELSE 'enable' END AS action
FROM chosen
UNION ALL
SELECT * FROM (
  SELECT backend, n.instance, f.slot, CASE WHEN f.slot IS NULL THEN 'unplaced'
    WHEN n.instance IS NOT NULL THEN 'assign' WHEN f.admin_state <> 1 THEN 'maint' END AS action
  FROM free f FULL JOIN fresh n USING (backend, r)) WHERE action IS NOT NULL
"""
LIFECYCLE = """
life AS (
  SELECT event_id, ts_ms, concat('container_', user_id) AS container_id, host, k, event_id // 2
    AS start_id, user_id, role AS event,
    CASE WHEN role = 'completed' THEN k % 3 END AS exit_status,
    CASE WHEN k % 5 <> 0 THEN concat('detail ', k) END AS detail
  FROM (SELECT request_id AS event_id, ts_ms, user_id, host, k, CASE event_type
      WHEN 'signup' THEN 'start' WHEN 'click' THEN 'ready' WHEN 'view' THEN 'registered'
      WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'stopped' ELSE 'drain' END
      ELSE CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'start_error' END END AS role
    FROM requests_v)
)"""
ORACLE["startup_times"] = req(
    """
SELECT container_id, max(ts_ms) FILTER (event = 'start') AS start_ms,
       max(ts_ms) FILTER (event = 'ready') AS ready_ms,
       max(ts_ms) FILTER (event = 'ready') - max(ts_ms) FILTER (event = 'start') AS startup_ms
FROM life GROUP BY 1
""",
    LIFECYCLE,
)
ORACLE["proxy_overhead"] = req(
    """,
o AS (
  SELECT base_model AS model, user_name, stream,
    greatest(latency_us - (latency_us - completion_tokens - prompt_tokens), 0) AS overhead_us
  FROM forwarded
)
SELECT model, user_name, stream, count(*) AS calls,
  CAST(sum(overhead_us) AS BIGINT) AS overhead_sum_us, quantile_disc(overhead_us, 0.5) AS p50_us,
  quantile_disc(overhead_us, 0.95) AS p95_us, quantile_disc(overhead_us, 0.99) AS p99_us
FROM o GROUP BY 1, 2, 3
"""
)
ORACLE["correlate_logs"] = req(
    """
SELECT concat('trace-', request_id) AS trace_id, 's' AS span_id, concat('POST ', path) AS name,
  CAST(count(doc_id) AS BIGINT) AS lines, count(*) FILTER (doc_id % 5 = 0) AS warnings,
  count(*) FILTER (doc_id % 5 = 1) AS errors
FROM forwarded f LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) l
  ON l.doc_id = f.request_id
GROUP BY 1, 2, 3
"""
)
ORACLE["effective_variants"] = (
    "WITH "
    + DEPLOYMENTS
    + """
SELECT name, pos, variant, concat(name, '-', variant) AS deployment_name,
  coalesce(nullif(image, ''), base_image) AS image,
  coalesce(nullif(model_repository, ''), base_repository) AS model_repository
FROM t
"""
)
ORACLE["stale_variants"] = (
    "WITH "
    + DEPLOYMENTS
    + """
SELECT name, variant FROM (
  SELECT name, variants, CAST(NULL AS VARCHAR) AS variant, 0 AS i FROM d
  UNION ALL SELECT name, variants, concat('v', n % 6), n % 6 FROM d)
WHERE CASE WHEN variant IS NULL THEN variants > 0 ELSE NOT (i BETWEEN 1 AND variants) END
UNION ALL SELECT concat('old-', n), NULL FROM d WHERE n % 50 = 0
"""
)
RESOURCE = """CASE accelerator_type WHEN 'amd_gpu' THEN 'amd.com/gpu'
  WHEN 'intel_gaudi' THEN 'habana.ai/gaudi' WHEN 'aws_neuron' THEN 'aws.amazon.com/neuron'
  WHEN 'cpu_only' THEN NULL ELSE '{nvidia}' END"""
ORACLE["accelerator_lookup"] = (
    "WITH "
    + DEPLOYMENTS
    + f"""
SELECT name, accelerator_type, {RESOURCE.format(nvidia='nvidia.com/gpu')} AS kubernetes_resource,
       {RESOURCE.format(nvidia='yarn.io/gpu')} AS yarn_resource FROM d
"""
)

# --- aggregations ------------------------------------------------------------------------------

ORACLE["request_counts"] = req(
    """
SELECT model, count(*) AS requests, count(*) FILTER (status // 100 = 2) AS success,
       count(*) FILTER (status // 100 <> 2) AS errors FROM forwarded GROUP BY 1
"""
)
ORACLE["error_rate"] = req("SELECT model, error_rate FROM card", CARD)
BUCKETS = """
le AS (
  SELECT * FROM (VALUES ('0.005', 0.005::DOUBLE), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05),
    ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0),
    ('10.0', 10.0), ('30.0', 30.0), ('60.0', 60.0), ('+Inf', 'inf'::DOUBLE)) AS b(le, le_sec)
),
hist AS (
  SELECT model, le, le_sec,
    count(*) FILTER (latency_us <= le_sec * 1000000) AS cum_count,
    CAST(sum(latency_us) AS BIGINT) AS sum_us, count(*) AS count
  FROM forwarded CROSS JOIN le GROUP BY 1, 2, 3
)"""
ORACLE["latency_histogram"] = req("SELECT model, le, cum_count, sum_us, count FROM hist", BUCKETS)
ORACLE["histogram_quantile"] = req(
    """,
p AS (
  SELECT *, CAST(0.9 AS DOUBLE) * count AS rank,
    coalesce(lag(le_sec) OVER w, 0) AS lo, coalesce(lag(cum_count) OVER w, 0) AS below
  FROM hist WINDOW w AS (PARTITION BY model ORDER BY le_sec)
)
SELECT model, min_by(CASE WHEN isinf(le_sec) THEN lo ELSE
    lo + (le_sec - lo) * ((rank - below) / (cum_count - below)) END, le_sec) AS quantile_sec
FROM p WHERE cum_count >= rank GROUP BY 1
""",
    BUCKETS,
)
ORACLE["token_chargeback"] = req(
    "SELECT user_name, model, CAST(tokens_in AS BIGINT) AS tokens_in,"
    " CAST(tokens_out AS BIGINT) AS tokens_out FROM billed"
)
ORACLE["chat_chargeback"] = r"""
WITH w AS (
  SELECT conv_id, role, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> ''))
    AS words FROM conversations
), u AS (
  SELECT concat('user-', conv_id % 20) AS user_name, concat('model-', conv_id % 4) AS model,
    CASE WHEN role IN ('system', 'user') THEN words ELSE 0 END AS i,
    CASE WHEN role IN ('system', 'user') THEN 0 ELSE words END AS o FROM w
)
SELECT user_name, model, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out
FROM u WHERE i > 0 OR o > 0 GROUP BY 1, 2
"""
LOADS = """
loads AS (
  SELECT request_id AS scrape_id, ts_ms, host, container_id,
    concat('dep-', user_id % 6 % 2) AS deployment,
    CASE WHEN k % 10 = 8 THEN 0.0::DOUBLE WHEN k % 10 = 7 THEN 0.3::DOUBLE
         ELSE ((k + 0.5::DOUBLE) + request_id % 100) / 2 / 100 END AS gpu_load,
    CAST(CASE WHEN k % 10 = 8 THEN 0 ELSE k % 20 + 1 END AS BIGINT) AS queue_depth
  FROM requests_v
)"""
for name in ("scrape_load", "scrape_load_inline"):
    ORACLE[name] = req("SELECT container_id, scrape_id, gpu_load, queue_depth FROM loads", LOADS)
ORACLE["fleet_queue_depth"] = req(
    """
SELECT CAST(sum(d) AS BIGINT) AS total_depth, count(*) AS containers
FROM (SELECT container_id, max_by(queue_depth, scrape_id) AS d FROM loads GROUP BY 1)
""",
    LOADS,
)
ORACLE["gpu_table"] = req(
    """,
g AS (
  SELECT host, request_id, unnest(['0', '1', '0']) AS gpu,
    unnest(['utilization', 'utilization', 'memory_used_bytes']) AS metric,
    unnest([concat(k, '.5'), CAST(request_id % 100 AS VARCHAR),
            CAST(completion_tokens * 1000 AS VARCHAR)]) AS value
  FROM requests_v WHERE k % 10 NOT IN (7, 8)
)
SELECT host, gpu, metric, max_by(value, request_id) AS value FROM g GROUP BY 1, 2, 3
"""
)
SIGNAL = f"""
answered AS (
  SELECT deployment, ts_ms // {HOUR_MS} AS tick, container_id,
    max_by(gpu_load, scrape_id) AS gpu_load, max_by(queue_depth, scrape_id) AS queue_depth
  FROM loads GROUP BY 1, 2, 3
),
signal AS (
  SELECT deployment, tick,
    CAST(sum(CAST(round(gpu_load * 1000000) AS BIGINT)) AS BIGINT) / count(*) / 1000000 AS gpu_util,
    CAST(sum(queue_depth) AS BIGINT) AS queue_depth, count(*) AS answered, count(*) AS containers
  FROM answered GROUP BY 1, 2
)"""
ORACLE["load_signal"] = req(
    """
SELECT *, greatest(least(1, greatest(0, gpu_util)),
                   least(1, CAST(queue_depth AS DOUBLE) / containers / 16)) AS load
FROM signal
""",
    LOADS,
    SIGNAL,
)
ORACLE["fleet_health"] = req(
    """
SELECT deployment, count(*) AS backends, count(*) FILTER (ready) AS ready_hosts,
  CASE WHEN bool_or(ready) THEN 'OK' ELSE 'NO_INSTANCES_READY' END AS health, 'OK' AS proxy_health
FROM (SELECT deployment, host, max_by(status = 200, request_id) AS ready
      FROM roster_v JOIN requests_v USING (host) GROUP BY 1, 2) GROUP BY 1
"""
)
FAILURES = """
failures AS (
  SELECT event_id AS alert_id, ts_ms, 'container_failure' AS alert_type,
    concat('Failure of container ', container_id, ': ', CASE WHEN event = 'completed'
      THEN concat('exit code ', exit_status, ' - ', coalesce(detail, ''))
      ELSE concat('no start - ', coalesce(detail, 'null')) END) AS message,
    'critical' AS severity
  FROM life WHERE (event = 'completed' AND exit_status <> 0) OR event = 'start_error'
)"""
WARMUP = """
warm AS (
  SELECT start_id, container_id, start_ms,
    CASE WHEN ready_ms - start_ms < 120000 THEN ready_ms - start_ms END AS took_ms
  FROM (SELECT request_id // 2 AS start_id, concat('container_', request_id // 2 % 97)
          AS container_id, min(ts_ms) FILTER (request_id % 2 = 0) AS start_ms,
          min(ts_ms) FILTER (request_id % 2 = 1 AND event_type <> 'error') AS ready_ms
        FROM requests_v GROUP BY 1, 2) WHERE start_ms IS NOT NULL
),
warmups AS (
  SELECT start_id AS alert_id, start_ms + coalesce(took_ms, 120000) AS ts_ms,
    CASE WHEN took_ms IS NULL THEN 'warmup_timeout' ELSE 'warmup_ok' END AS alert_type,
    CASE WHEN took_ms IS NULL THEN concat('Container ', container_id,
        ' was not ready after 120000 ms and is listed all the same')
      ELSE concat('Container ', container_id, ' took ', took_ms, ' ms to get ready') END AS message,
    CASE WHEN took_ms IS NULL THEN 'warning' ELSE 'info' END AS severity
  FROM warm
)"""
ORACLE["alert_rollup"] = req(
    """,
a AS (SELECT * FROM failures UNION ALL SELECT * FROM warmups),
x AS (
  SELECT 'all' AS scope, alert_type FROM a
  UNION ALL SELECT 'recent', alert_type
  FROM (SELECT * FROM a ORDER BY ts_ms DESC, alert_id DESC LIMIT 100)
)
SELECT scope, count(*) AS alerts, count(*) FILTER (alert_type = 'container_failure')
  AS container_failures, count(*) FILTER (alert_type = 'scaling_event') AS scaling_events
FROM x GROUP BY 1
""",
    LIFECYCLE,
    FAILURES,
    WARMUP,
)
STATUS = """
st AS (
  SELECT *, image IS NULL OR model_repository IS NULL AS bad,
    CAST(n % 7 + n % 3 AS BIGINT) AS ready FROM d
)"""
ORACLE["deployment_status"] = (
    "WITH "
    + DEPLOYMENTS
    + ","
    + STATUS
    + """
SELECT name, replicas AS target_replicas, CASE WHEN NOT bad THEN ready END AS ready_replicas,
  CASE WHEN bad THEN 'Failed' WHEN ready >= replicas AND replicas > 0 THEN 'Ready'
       ELSE 'Reconciling' END AS phase,
  CASE WHEN bad THEN 'InvalidSpec' WHEN ready >= replicas AND replicas > 0 THEN 'DeploymentReady'
       ELSE 'WaitingForReplicas' END AS reason,
  CASE WHEN bad THEN 'spec.image and spec.modelRepository are required'
       ELSE concat(ready, '/', replicas, ' replicas ready') END AS message
FROM st
"""
)
ORACLE["fleet_progress"] = (
    "WITH "
    + DEPLOYMENTS
    + ","
    + STATUS
    + """
SELECT name, CASE WHEN replicas <= 0 THEN 0::DOUBLE
  ELSE CAST(CASE WHEN bad THEN 0 ELSE ready END AS DOUBLE) / replicas END AS progress FROM st
"""
)
ORACLE["capacity_demand"] = (
    "WITH "
    + DEPLOYMENTS
    + f"""
SELECT {RESOURCE.format(nvidia='nvidia.com/gpu')} AS resource,
  CAST(sum(greatest(1, accelerator_count * tensor_parallelism * pipeline_parallelism) * replicas)
    AS BIGINT) AS units,
  CAST(sum(greatest(1, tensor_parallelism * pipeline_parallelism) * replicas) AS BIGINT)
    AS yarn_units, count(*) AS deployments
FROM d WHERE accelerator_type <> 'cpu_only' GROUP BY 1
"""
)
ORACLE["tracked_models"] = req("SELECT DISTINCT model FROM with_shadow")
ORACLE["model_scorecard"] = req(
    """
SELECT model, requests, success, errors, p50_us, p95_us, p99_us, error_rate
FROM card WHERE model NOT LIKE 'shadow:%'
""",
    CARD,
)

# --- windows and top-k -------------------------------------------------------------------------

ORACLE["recent_percentiles"] = req(
    """
SELECT model, quantile_disc(latency_us, 0.5) AS p50_us, quantile_disc(latency_us, 0.95) AS p95_us,
       quantile_disc(latency_us, 0.99) AS p99_us, count(*) AS samples
FROM recent WHERE model NOT LIKE 'shadow:%' GROUP BY 1
""",
    CARD,
)


def limited(source: str) -> str:
    """Fixed windows from each bucket's first request, over rows of ``source`` with rule columns."""
    return f"""
anchored AS (
  SELECT *, min(ts_ms) OVER (PARTITION BY bucket) AS t0 FROM {source}
),
placed AS (
  SELECT *, (ts_ms - t0) // {DAY_MS} AS w FROM anchored
),
limited AS (
  SELECT *, bucket IS NOT NULL AND row_number() OVER (
      PARTITION BY bucket, w ORDER BY ts_ms, request_id) > rpm AS over_limit,
    rpm = 0 OR over_limit AS denied,
    CASE WHEN rpm = 0 THEN 60000
         WHEN over_limit THEN greatest(1, t0 + (w + 1) * {DAY_MS} - ts_ms) ELSE 0
      END AS retry_after_ms,
    CASE WHEN rpm = 0 THEN 'quota_zero' WHEN over_limit THEN 'rate_limited' END AS reason,
    CASE WHEN denied THEN concat('rule[user=', coalesce(rule_user, 'null'), ',group=',
      coalesce(rule_group, 'null'), ',model=', rule_model, ',rpm=', rpm, ']') END AS rule_desc
  FROM placed
)"""


ORACLE["rate_limit"] = req(
    """
SELECT request_id, NOT denied AS allowed, retry_after_ms, reason, rule_desc FROM limited
""",
    RULED,
    "used AS (SELECT * FROM ruled WHERE path <> '/v1/models')",
    limited("used"),
)
ORACLE["allocate_replicas"] = (
    "WITH "
    + DEPLOYMENTS
    + """,
w AS (
  SELECT *, greatest(coalesce(weight, 0), 0) AS wt,
    sum(greatest(coalesce(weight, 0), 0)) OVER (PARTITION BY n) AS total FROM t
),
e AS (
  SELECT *, CAST(wt AS DOUBLE) * replicas / nullif(total, 0) AS exact FROM w
),
f AS (
  SELECT *, exact - floor(exact) AS rem,
    CASE WHEN wt > 0 AND floor(exact) = 0 THEN 1 ELSE floor(exact) END AS fl FROM e
),
r AS (
  SELECT *, replicas - sum(fl) OVER (PARTITION BY n) AS leftover,
    row_number() OVER (PARTITION BY n, wt > 0 ORDER BY rem DESC, pos) AS rk FROM f
)
SELECT name, pos, variant, weight, CAST(CASE WHEN total = 0 THEN 1
  ELSE fl + CASE WHEN wt > 0 AND rk <= leftover THEN 1 ELSE 0 END END AS INT) AS replicas
FROM r
"""
)
ORACLE["phase_transitions"] = req(
    """,
h AS (
  SELECT user_name AS name, ts_ms, request_id AS seq, CASE WHEN k % 10 = 0 THEN 'Failed'
    WHEN k % 3 = 0 THEN 'Reconciling' ELSE 'Ready' END AS phase FROM requests_v
),
p AS (SELECT *, lag(phase) OVER (PARTITION BY name ORDER BY ts_ms, seq) AS previous FROM h)
SELECT name, ts_ms, seq, previous, phase,
  CASE WHEN phase = 'Failed' THEN 'Warning' ELSE 'Normal' END AS event_type,
  CASE WHEN phase = 'Failed' THEN 'InvalidSpec' ELSE phase END AS reason
FROM p WHERE phase = 'Failed' OR (phase = 'Ready' AND phase IS DISTINCT FROM previous)
  OR (phase = 'Reconciling' AND previous IS NOT NULL AND previous <> phase)
"""
)
ORACLE["last_alerts"] = req(
    """
SELECT alert_id, concat('# [', strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g'),
  'Z] ', upper(severity), ' - ', alert_type, ': ', message) AS line
FROM failures ORDER BY ts_ms DESC, alert_id DESC LIMIT 100
""",
    LIFECYCLE,
    FAILURES,
)
ORACLE["latest_depth"] = req(
    "SELECT container_id, host, max_by(depth, event_id) AS depth FROM depth_v GROUP BY 1, 2"
)
ORACLE["counter_increase"] = req(
    f""",
s AS (
  SELECT container_id, ts_ms, request_id % 500 AS v,
    lag(request_id % 500) OVER (PARTITION BY container_id ORDER BY ts_ms, request_id) AS prev
  FROM requests_v
)
SELECT container_id, ts_ms // {DAY_MS} * {DAY_MS} AS window_start_ms,
  CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN v < prev THEN v ELSE v - prev END) AS BIGINT)
    AS increase,
  CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN v < prev THEN v ELSE v - prev END) AS BIGINT)
    * 1000.0::DOUBLE / {DAY_MS} AS rate_per_sec
FROM s GROUP BY 1, 2
"""
)
ORACLE["top_consumers"] = req(
    """
SELECT user_name, model, CAST(tokens_in AS BIGINT) AS tokens_in,
  CAST(tokens_out AS BIGINT) AS tokens_out, CAST(tokens_in + tokens_out AS BIGINT) AS total
FROM billed ORDER BY total DESC, user_name, model LIMIT 10
"""
)
ORACLE["drain_candidate"] = req(
    """
SELECT deployment, container_id, depth FROM roster_v
JOIN (SELECT container_id, max_by(depth, event_id) AS depth FROM depth_v GROUP BY 1)
  USING (container_id)
QUALIFY row_number() OVER (PARTITION BY deployment ORDER BY depth, ord) = 1
"""
)

# --- sources and sinks -------------------------------------------------------------------------

ORACLE["parse_exposition"] = req(
    """,
p AS (
  SELECT request_id AS scrape_id, k % 10 AS kind, base_model, unnest(range(9)) AS i, k,
    completion_tokens FROM requests_v
),
l AS (
  SELECT scrape_id, CAST(CASE kind WHEN 7 THEN [NULL, NULL, NULL, NULL, NULL, NULL, 1, 2, 0][i + 1]
      WHEN 6 THEN [NULL, NULL, 2, 3, 4, NULL, 6, 7, 8][i + 1]
      ELSE [NULL, NULL, 2, 3, 4, NULL, 5, 6, 7][i + 1] END AS INT) AS line_no,
    [NULL, NULL, 'nv_gpu_utilization', 'nv_gpu_utilization', 'nv_gpu_memory_used_bytes', NULL,
     'nv_inference_pending_request_count', 'nv_inference_pending_request_count',
     'nv_inference_request_success'][i + 1] AS metric,
    [NULL, NULL, '0', '1', '0', NULL, NULL, NULL, NULL][i + 1] AS gpu,
    [NULL, NULL, NULL, NULL, NULL, NULL, base_model, 'other', base_model][i + 1] AS model,
    CAST([NULL, NULL, k + 0.5, scrape_id % 100, completion_tokens * 1000, NULL, k % 20 + 0.7, 1,
     scrape_id][i + 1] AS DOUBLE) AS value
  FROM p WHERE kind <> 8
)
SELECT * FROM l WHERE line_no IS NOT NULL
"""
)
ORACLE["service_log_round_trip"] = """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'WARN' WHEN doc_id % 5 = 1 THEN 'ERROR' ELSE 'INFO' END
  AS level, source AS logger, text AS message,
  CASE WHEN doc_id % 5 = 1 THEN 'java.io.IOException' END AS exception,
  CASE WHEN doc_id % 5 = 1 THEN
    concat('at line ', doc_id, chr(10), chr(9), 'at "x"', chr(92), 'y', chr(10)) END AS stack,
  CAST(CASE WHEN doc_id % 4 <> 0 THEN 3 ELSE 2 END AS BIGINT) AS context_keys,
  concat('trace-', doc_id) AS trace_id, CASE WHEN doc_id % 4 <> 0 THEN 's' END AS span_id
FROM documents
"""
ORACLE["load_quota_rules"] = """
WITH r AS (
  SELECT o_orderkey, unnest([0, 1, 2]) AS pos,
    unnest([NULL, NULL, CASE WHEN o_orderkey % 3 <> 0 THEN concat('user-', o_custkey) END])
      AS rule_user,
    unnest([NULL, concat('team-', o_orderkey % 5), NULL]) AS rule_group,
    unnest(['*', CASE WHEN o_orderkey % 2 = 0 THEN '*' ELSE concat('model-', o_orderkey % 4) END,
            'model-1']) AS rule_model,
    CAST(unnest([greatest(0, o_orderkey % 40 - 3), o_orderkey % 7, 0]) AS INT) AS rpm
  FROM orders WHERE o_orderkey % 10 NOT IN (7, 8)
), s AS (
  SELECT *, CAST((rule_user IS NOT NULL)::INT * 4 + (rule_group IS NOT NULL)::INT * 2
    + (rule_model <> '*')::INT AS INT) AS specificity FROM r
)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey
    ORDER BY specificity DESC, pos) - 1 AS INT) AS rule_ord,
  rule_user, rule_group, rule_model, rpm, specificity FROM s
"""
ORACLE["valid_rule_versions"] = """
SELECT o_orderkey, CAST(length(CASE WHEN o_orderkey % 10 = 8 THEN '{"rules":[]}' ELSE concat(
  '{"rules":[{"requestsPerMinute":', o_orderkey % 40 - 3, '},{"group":"team-', o_orderkey % 5,
  '","model":"', CASE WHEN o_orderkey % 2 = 0 THEN '*' ELSE concat('model-', o_orderkey % 4) END,
  '","requestsPerMinute":"', o_orderkey % 7, '"},{"user":"',
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('user-', o_custkey) END,
  '","group":null,"model":"model-1"}]}') END) AS BIGINT) AS doc_length
FROM orders WHERE o_orderkey % 10 <> 7
"""
ORACLE["load_adapters"] = """
SELECT o_orderkey, concat('base-', o_orderkey) AS base,
       unnest(['a', concat('b-', o_orderkey % 3)]) AS adapter
FROM orders WHERE o_orderkey % 9 <> 0
"""
ORACLE["model_inventory"] = """
SELECT CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey AS VARCHAR) ELSE concat('m', l_partkey) END
  AS model, count(*) AS files, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS bytes,
  max(l_orderkey) AS modified
FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1
"""
ORACLE["loaded_models"] = req(
    """
SELECT host, request_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS version,
       CAST(NULL AS VARCHAR) AS state FROM requests_v WHERE k % 10 = 0
UNION ALL
SELECT host, request_id, unnest([base_model, 'other']), unnest([CAST(k AS VARCHAR), NULL]),
       unnest(['READY', NULL]) FROM requests_v WHERE k % 10 <> 0
"""
)
ORACLE["parse_requests"] = req(
    """
SELECT request_id, CASE WHEN request_error IS NULL THEN base_model END AS base_model,
  CASE WHEN request_error IS NULL THEN lora END AS lora, stream AND k % 50 <> 3 AS stream,
  CASE WHEN NOT stream THEN prompt_tokens END AS prompt_tokens,
  CASE WHEN NOT stream THEN completion_tokens END AS completion_tokens
FROM checked
""",
    CHECKED,
)
ORACLE["read_deployments"] = (
    "WITH "
    + DEPLOYMENTS
    + """
SELECT name, image, replicas, tensor_parallelism, pipeline_parallelism, accelerator_type,
  accelerator_count, '4Gi' AS memory, '2' AS cpu, false AS proxy_enabled,
  CAST(9000 AS INT) AS proxy_port, scaling_mode, min_replicas, CAST(10 AS INT) AS max_replicas,
  0.7::DOUBLE AS up_threshold, variants
FROM d
"""
)
ORACLE["to_exposition"] = req(
    """,
m(metric, labels, value) AS (
  SELECT 'inference_latency_seconds_bucket', concat('{model="', model, '",le="', le, '"}'),
    CAST(cum_count AS VARCHAR) FROM hist
  UNION ALL SELECT 'inference_latency_seconds_sum', concat('{model="', model, '"}'),
    CAST(CAST(sum_us AS DOUBLE) / 1000000 AS VARCHAR) FROM hist WHERE le = '+Inf'
  UNION ALL SELECT 'inference_latency_seconds_count', concat('{model="', model, '"}'),
    CAST(count AS VARCHAR) FROM hist WHERE le = '+Inf'
  UNION ALL SELECT 'inference_latency_p50_ms', concat('{model="', model, '"}'),
    CAST(CAST(p50_us AS DOUBLE) / 1000 AS VARCHAR) FROM pc
  UNION ALL SELECT 'inference_latency_p95_ms', concat('{model="', model, '"}'),
    CAST(CAST(p95_us AS DOUBLE) / 1000 AS VARCHAR) FROM pc
  UNION ALL SELECT 'inference_latency_p99_ms', concat('{model="', model, '"}'),
    CAST(CAST(p99_us AS DOUBLE) / 1000 AS VARCHAR) FROM pc
  UNION ALL SELECT 'inference_requests_total', concat('{model="', model, '",status="success"}'),
    CAST(success AS VARCHAR) FROM pc
  UNION ALL SELECT 'inference_requests_total', concat('{model="', model, '",status="error"}'),
    CAST(errors AS VARCHAR) FROM pc
  UNION ALL SELECT 'model_error_rate', concat('{model="', model, '"}'),
    CAST(error_rate AS VARCHAR) FROM pc
  UNION ALL SELECT 'tokens_in_total', concat('{user="', user_name, '",model="', model, '"}'),
    CAST(tokens_in AS VARCHAR) FROM billed WHERE tokens_in > 0
  UNION ALL SELECT 'tokens_out_total', concat('{user="', user_name, '",model="', model, '"}'),
    CAST(tokens_out AS VARCHAR) FROM billed WHERE tokens_out > 0
)
SELECT concat('fleet_', metric, labels, ' ', value) AS line FROM m
UNION ALL
SELECT concat('# ', unnest(['HELP', 'TYPE']), ' fleet_', f, ' ', unnest([h, t])) FROM (VALUES
  ('inference_latency_seconds', 'histogram', 'Answer times in seconds'),
  ('inference_latency_p50_ms', 'gauge', 'Median answer time in milliseconds'),
  ('inference_latency_p95_ms', 'gauge', '95th percentile of answer times in milliseconds'),
  ('inference_latency_p99_ms', 'gauge', '99th percentile of answer times in milliseconds'),
  ('inference_requests_total', 'counter', 'Answered calls for each model and result'),
  ('model_error_rate', 'gauge', 'Share of calls that failed, for each model'),
  ('tokens_in_total', 'counter', 'Tokens of prompts'),
  ('tokens_out_total', 'counter', 'Tokens of answers')) AS x(f, t, h)
""",
    BUCKETS,
    CARD,
    "pc AS (SELECT * FROM card WHERE model NOT LIKE 'shadow:%')",
)
ROSTER = """
live AS (
  SELECT container_id, host, max_by(event, event_id) AS event, max(ts_ms) AS since_ms FROM life
  WHERE event NOT IN ('start', 'ready') GROUP BY 1, 2
)"""
ORACLE["instance_roster"] = req(
    "SELECT container_id, host, since_ms FROM live WHERE event = 'registered'", LIFECYCLE, ROSTER
)
ORACLE["instance_list"] = req(
    "SELECT concat(host, ':8000') AS value FROM live WHERE event = 'registered'", LIFECYCLE, ROSTER
)

ORACLE["fleet_exposition"] = req(
    """,
latest AS (
  SELECT container_id, host, max_by(gpu_load, scrape_id) AS gpu_load,
    max_by(queue_depth, scrape_id) AS queue_depth FROM loads GROUP BY 1, 2
),
started AS (
  SELECT container_id, max(ts_ms) FILTER (event = 'ready') - max(ts_ms) FILTER (event = 'start')
    AS startup_ms FROM life GROUP BY 1
),
gpu AS (
  SELECT host, request_id, unnest(['0', '1', '0']) AS gpu,
    unnest(['utilization', 'utilization', 'memory_used_bytes']) AS metric,
    unnest([concat(k, '.5'), CAST(request_id % 100 AS VARCHAR),
            CAST(completion_tokens * 1000 AS VARCHAR)]) AS value
  FROM requests_v WHERE k % 10 NOT IN (7, 8)
),
label AS (SELECT *, concat('{container_id="', container_id, '",host="', host, '"}') AS l FROM latest)
SELECT concat('container_load', l, ' ', CAST(gpu_load AS VARCHAR)) AS line FROM label
UNION ALL SELECT concat('container_queue_depth', l, ' ', queue_depth) FROM label
UNION ALL SELECT concat('container_startup_ms{container_id="', container_id, '"} ', startup_ms)
  FROM latest JOIN started USING (container_id) WHERE startup_ms IS NOT NULL
UNION ALL SELECT concat('gpu_', metric, '{container_id="', replace(host, 'host-', 'container_'),
    '",host="', host, '",gpu="', gpu, '"} ', max_by(value, request_id))
  FROM gpu GROUP BY host, gpu, metric
UNION ALL SELECT 'target_containers 8'
UNION ALL SELECT concat('running_containers ', count(*)) FROM latest
UNION ALL SELECT concat('queue_depth_total ', CAST(sum(queue_depth) AS BIGINT)) FROM latest
UNION ALL SELECT concat('alerts_total ', count(*)) FROM failures
UNION ALL SELECT concat('container_failures_total ', count(*)) FROM failures
UNION ALL SELECT 'scaling_events_total 0'
UNION ALL SELECT concat('# ', unnest(['HELP', 'TYPE']), ' ', f, ' ', unnest([h, t])) FROM (VALUES
  ('target_containers', 'gauge', 'Containers that are wanted'),
  ('running_containers', 'gauge', 'Containers that run'),
  ('queue_depth_total', 'gauge', 'Requests that wait, over all containers'),
  ('container_startup_ms', 'gauge', 'Milliseconds from start to registration'),
  ('alerts_total', 'counter', 'Alerts of all kinds'),
  ('container_failures_total', 'counter', 'Alerts of failed containers'),
  ('scaling_events_total', 'counter', 'Alerts of changes in scale')) AS x(f, t, h)
WHERE f <> 'container_startup_ms' OR EXISTS (
  SELECT 1 FROM latest JOIN started USING (container_id) WHERE startup_ms IS NOT NULL)
""",
    LOADS,
    LIFECYCLE,
    FAILURES,
)

# --- state and lifecycle -----------------------------------------------------------------------

ORACLE["breaker_transitions"] = req(
    f"""
SELECT host, ts_ms, event_id, CAST(step AS INT) AS step, from_state, to_state FROM (
  SELECT host, ts_ms, event_id, 0 AS step,
    CASE WHEN before IS NULL THEN 'CLOSED' ELSE 'OPEN' END AS from_state,
    CASE WHEN before IS NULL THEN 'OPEN' ELSE 'HALF_OPEN' END AS to_state
  FROM walk WHERE (before IS NULL AND resume IS NOT NULL) OR (before IS NOT NULL AND tried)
  UNION ALL
  SELECT host, ts_ms, event_id, 1, 'HALF_OPEN', CASE WHEN ready THEN 'CLOSED' ELSE 'OPEN' END
  FROM walk WHERE before IS NOT NULL AND tried)
""",
    """
seq AS (
  SELECT host, list(ts_ms ORDER BY ts_ms, request_id) AS ts, list(request_id ORDER BY ts_ms,
    request_id) AS ids, list(status = 200 ORDER BY ts_ms, request_id) AS ok
  FROM requests_v GROUP BY 1
)""",
    f"""
walk AS (
  SELECT host, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS BIGINT) AS event_id,
    true AS ready, CAST(NULL AS BIGINT) AS before, false AS tried, CAST(NULL AS BIGINT) AS resume,
    0 AS fails
  FROM seq
  UNION ALL
  SELECT host, i + 1, ts[i + 1], ids[i + 1], ok[i + 1], resume,
    resume IS NOT NULL AND ts[i + 1] >= resume,
    CASE WHEN resume IS NULL THEN CASE WHEN NOT ok[i + 1] AND fails + 1 >= 2
                                       THEN ts[i + 1] + {HOUR_MS} END
         WHEN ts[i + 1] >= resume THEN CASE WHEN NOT ok[i + 1] THEN ts[i + 1] + {HOUR_MS} END
         ELSE resume END,
    CASE WHEN resume IS NOT NULL OR ok[i + 1] THEN 0 ELSE fails + 1 END
  FROM walk JOIN seq USING (host) WHERE i < len(ts)
)""",
)
SCALING = f"""
loaded AS (
  SELECT deployment, list(tick ORDER BY tick) AS ticks,
    list(least(1, greatest(0, gpu_util)) ORDER BY tick) AS load
  FROM signal GROUP BY 1
),
steps AS (
  SELECT deployment, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS tick, 1 AS before, 1 AS target,
    CAST(NULL AS BIGINT) AS changed
  FROM loaded
  UNION ALL
  SELECT deployment, i, tick, before, before + move,
    CASE WHEN move <> 0 THEN tick * {HOUR_MS} ELSE changed END
  FROM (
    SELECT deployment, i + 1 AS i, ticks[i + 1] AS tick, target AS before, changed,
      CASE WHEN changed IS NOT NULL AND ticks[i + 1] * {HOUR_MS} - changed < 2 * {HOUR_MS} THEN 0
           WHEN load[i + 1] > 0.6::DOUBLE AND target < 10 THEN 1
           WHEN load[i + 1] < 0.4::DOUBLE AND target > 1 THEN -1 ELSE 0 END AS move
    FROM steps JOIN loaded USING (deployment) WHERE i < len(ticks))
),
recommended AS (
  SELECT deployment, tick, tick * {HOUR_MS} AS ts_ms,
    CASE WHEN target > before THEN 'scale_up' ELSE 'scale_down' END AS action,
    CAST(before AS INT) AS from_target, CAST(target AS INT) AS to_target
  FROM steps WHERE target <> before
)"""
ORACLE["scale_recommendations"] = req("SELECT * FROM recommended", LOADS, SIGNAL, SCALING)
ORACLE["readiness_deadlines"] = req(
    """
SELECT container_id, start_id, start_ms,
  CASE WHEN took_ms IS NULL THEN 'warmup_timeout' ELSE 'warmup_ok' END AS verdict, took_ms,
  start_ms + coalesce(took_ms, 120000) AS registered_ms FROM warm
""",
    WARMUP,
)
DRAINS = f"""
drained AS (
  SELECT d.container_id, d.request_id AS drain_id, d.ts_ms AS drain_ms,
    (SELECT max_by(depth, event_id) FROM depth_v v
     WHERE v.container_id = d.container_id AND v.ts_ms <= d.ts_ms) AS entry,
    (SELECT min(depth) FROM depth_v v WHERE v.container_id = d.container_id
       AND v.ts_ms >= d.ts_ms AND v.ts_ms < d.ts_ms + {HOUR_MS}) AS lowest,
    (SELECT max_by(depth, event_id) FROM depth_v v WHERE v.container_id = d.container_id
       AND v.ts_ms >= d.ts_ms AND v.ts_ms < d.ts_ms + {HOUR_MS}) AS final
  FROM requests_v d WHERE path = '/v1/models'
),
drains AS (
  SELECT container_id, drain_id, drain_ms, CAST(CASE WHEN coalesce(entry, 0) <= 0 OR lowest <= 0
    THEN 0 ELSE coalesce(final, entry) END AS INT) AS remaining FROM drained
)"""
ORACLE["drain_verdicts"] = req(
    """
SELECT container_id, drain_id, drain_ms,
  CASE WHEN remaining > 0 THEN 'drain_timeout' ELSE 'drained' END AS verdict, remaining FROM drains
""",
    DRAINS,
)
RELOADS = """
reloads AS (
  SELECT 1704067200000 + o_orderkey * 1000 AS ts_ms, 'quota_reloaded' AS alert_type, 'info' AS severity,
    'New quota rules in force: document of 12 bytes' AS message
  FROM orders WHERE o_orderkey % 4 NOT IN (1, 2)
)"""
CONTROLS = """
controls AS (
  SELECT event_id AS alert_id, ts_ms, event AS alert_type, coalesce(detail, '') AS message, strict,
    CASE WHEN event IN ('ranger_degraded', 'zk_init_failed')
           THEN CASE WHEN strict THEN 'critical' ELSE 'warning' END
         WHEN event = 'zk_connection_lost' THEN CASE WHEN detail = 'LOST' THEN 'critical' ELSE 'warning' END
         ELSE 'info' END AS severity
  FROM (SELECT request_id AS event_id, ts_ms, unnest([true, false]) AS strict,
          ['ranger_degraded', 'zk_init_failed', 'zk_connection_lost', 'zk_reconnected', 'quota_reloaded',
           'probe'][request_id % 6 + 1] AS event,
          CASE WHEN request_id % 6 = 2 THEN CASE WHEN k % 2 = 0 THEN 'LOST' ELSE 'SUSPENDED' END
               WHEN k % 3 <> 0 THEN concat('detail ', k) END AS detail
        FROM requests_v)
  WHERE event <> 'probe'
)"""
ORACLE["all_alerts"] = req(
    f""",
a AS (
  SELECT alert_type, severity, message, ts_ms FROM failures
  UNION ALL SELECT alert_type, severity, message, ts_ms FROM warmups
  UNION ALL SELECT 'drain_timeout', 'warning', concat('Drain of container ', container_id, ' ended with ',
    remaining, ' requests open'), drain_ms + {HOUR_MS}
  FROM drains WHERE remaining > 0
  UNION ALL SELECT 'scaling_event', 'info', concat(action, ' from ', from_target, ' to ', to_target,
    ' containers'), ts_ms FROM recommended
  UNION ALL SELECT alert_type, severity, message, ts_ms FROM controls WHERE strict
  UNION ALL SELECT alert_type, severity, message, ts_ms FROM reloads
)
SELECT alert_type, severity, count(*) AS alerts, CAST(sum(length(message)) AS BIGINT)
  AS message_chars, max(ts_ms) AS newest_ms FROM a GROUP BY 1, 2
""",
    LIFECYCLE,
    FAILURES,
    WARMUP,
    DRAINS,
    LOADS,
    SIGNAL,
    SCALING,
    CONTROLS,
    RELOADS,
)

# --- scoring and the composite plan ------------------------------------------------------------

ORACLE["score_batch"] = """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos,
       CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
"""
ORACLE["score_routed"] = """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos,
  CAST(unnest(embedding) * CASE WHEN label % 3 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS x
FROM embeddings WHERE label % 3 IN (0, 1)
UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE label % 3 NOT IN (0, 1)
"""
OUTCOMES = f"""
gated AS (
  SELECT *, CASE WHEN path <> '/v1/models' AND request_error IS NULL THEN rule END AS rule_in
  FROM (SELECT *, CASE WHEN k % 50 = 4 THEN 'method_not_allowed'
          WHEN k % 50 = 3 THEN 'invalid_json' WHEN k % 50 IN (1, 2) THEN 'missing_model' END
          AS request_error FROM ruled)
),
used AS (SELECT * FROM gated WHERE rule_in IS NOT NULL),
{limited("used")},
outcomes AS (
  SELECT g.*, l.retry_after_ms, l.reason, l.rule_desc, r.routed_container,
    CASE WHEN g.path = '/v1/models' THEN 'models' WHEN g.request_error IS NOT NULL
      THEN g.request_error WHEN l.denied THEN l.reason
      WHEN g.team = 'team-4' AND g.base_model <> 'model-0' THEN 'permission_denied'
      WHEN g.team = 'team-4' AND g.lora IS NOT NULL THEN 'adapter_denied'
      ELSE 'forwarded' END AS outcome
  FROM gated g LEFT JOIN limited l USING (request_id)
  LEFT JOIN routes r ON r.tick = g.ts_ms // {HOUR_MS}
),
adjudicated AS (
  SELECT request_id, ts_ms, user_name,
    CASE k % 3 WHEN 0 THEN concat('203.0.113.', k) WHEN 1 THEN concat('198.51.100.', k)
         ELSE concat('192.0.2.', k) END AS client_ip,
    CASE WHEN request_error IS NULL THEN base_model END AS model,
    CASE WHEN request_error IS NULL THEN lora END AS lora, outcome,
    CAST(CASE outcome WHEN 'models' THEN 200 WHEN 'method_not_allowed' THEN 405
      WHEN 'invalid_json' THEN 400 WHEN 'missing_model' THEN 400 WHEN 'rate_limited' THEN 429
      WHEN 'quota_zero' THEN 429 WHEN 'permission_denied' THEN 403 WHEN 'adapter_denied' THEN 403
      ELSE status END AS INT) AS code,
    CASE WHEN outcome IN ('rate_limited', 'quota_zero') THEN rule_desc END AS rule_desc,
    CASE WHEN outcome IN ('rate_limited', 'quota_zero')
      THEN greatest(1, (retry_after_ms + 999) // 1000) END AS retry_after_sec,
    CASE WHEN outcome = 'forwarded' THEN routed_container END AS container_id,
    outcome = 'forwarded' AS forwarded, outcome = 'forwarded' AND status = 200 AS ok,
    CASE WHEN outcome = 'forwarded' THEN latency_us END AS latency_us,
    CASE WHEN outcome = 'forwarded' AND status = 200 AND NOT stream THEN prompt_tokens END AS prompt_tokens,
    CASE WHEN outcome = 'forwarded' AND status = 200 AND NOT stream THEN completion_tokens END
      AS completion_tokens
  FROM outcomes
)"""
ORACLE["adjudicate"] = req("SELECT * FROM adjudicated", RULED, ROUTES, OUTCOMES)
ORACLE["adjudication_summary"] = req(
    """
SELECT model, outcome, count(*) AS requests, count(*) FILTER (ok) AS succeeded,
  CAST(sum(latency_us) AS BIGINT) AS latency_us, CAST(sum(prompt_tokens) AS BIGINT) AS tokens_in,
  CAST(sum(completion_tokens) AS BIGINT) AS tokens_out
FROM adjudicated GROUP BY 1, 2
""",
    RULED,
    ROUTES,
    OUTCOMES,
)

# --- streams -----------------------------------------------------------------------------------

DAILY = f"""
daily AS (
  SELECT ts_ms // {DAY_MS} * {DAY_MS} AS window_start_ms, user_name, model,
    CAST(sum(greatest(prompt_tokens, 0)) AS BIGINT) AS tokens_in,
    CAST(sum(greatest(completion_tokens, 0)) AS BIGINT) AS tokens_out
  FROM usage_v WHERE prompt_tokens > 0 OR completion_tokens > 0 GROUP BY 1, 2, 3
)"""
ORACLE["windowed_chargeback"] = req("SELECT * FROM daily", DAILY)
ORACLE["stream_windowed_chargeback"] = ORACLE["windowed_chargeback"]
ORACLE["windowed_metrics"] = req(
    f"""
SELECT ts_ms // {DAY_MS} * {DAY_MS} AS window_start_ms, model,
  count(*) FILTER (status // 100 = 2) AS success, count(*) FILTER (status // 100 <> 2) AS errors,
  CAST(sum(latency_us) AS BIGINT) AS sum_us, count(*) AS count, le,
  count(*) FILTER (latency_us <= le_sec * 1000000) AS cum_count
FROM forwarded CROSS JOIN le GROUP BY window_start_ms, model, le
""",
    BUCKETS,
)
ORACLE["stream_windowed_metrics"] = ORACLE["windowed_metrics"]
ORACLE["stream_breaker"] = ORACLE["breaker_transitions"]
ORACLE["stream_rate_limit"] = ORACLE["rate_limit"]
ORACLE["sample_requests"] = req(
    "SELECT request_id FROM requests_v WHERE left(md5(CAST(request_id AS VARCHAR)), 8) < '40000000'"
)
ORACLE["chargeback_from_bodies"] = req(
    """,
paid AS (
  SELECT user_name, base_model AS model, prompt_tokens, completion_tokens FROM checked
  WHERE path <> '/v1/models' AND request_error IS NULL AND status = 200 AND NOT stream
  UNION ALL
  SELECT user_name, requested_model, prompt_tokens - 2, completion_tokens FROM requests_v
  WHERE stream AND prompt_tokens >= 2
)
SELECT user_name, model, CAST(sum(prompt_tokens) AS BIGINT) AS tokens_in,
  CAST(sum(completion_tokens) AS BIGINT) AS tokens_out
FROM paid WHERE prompt_tokens > 0 OR completion_tokens > 0 GROUP BY 1, 2
""",
    CHECKED,
)
ORACLE["rules_asof_many_versions"] = req(
    """,
v AS (
  SELECT o_orderkey AS version, epoch_us(o_orderdate)::BIGINT // 1000
    + (SELECT min(ts_ms) - min(epoch_us(o_orderdate)::BIGINT // 1000) FROM requests_v, orders)
    AS valid_from_ms FROM orders
),
w AS (SELECT max(version) AS version, valid_from_ms FROM v GROUP BY 2)
SELECT q.request_id, w.version FROM (SELECT request_id, ts_ms FROM requests_v) q
ASOF LEFT JOIN w ON q.ts_ms >= w.valid_from_ms
"""
)
ORACLE["access_modes"] = req(
    """
SELECT mode, count(*) AS calls, count(*) FILTER (allowed) AS allowed FROM (
  SELECT unnest(['off', 'degraded_strict', 'degraded_lenient']) AS mode,
         unnest([true, false, true]) AS allowed FROM requests_v
) GROUP BY 1
"""
)
ORACLE["reload_alerts"] = f"WITH {RELOADS} SELECT * FROM reloads WHERE ts_ms > 1704067200000 + 100000"
ORACLE["control_alerts"] = req("SELECT * FROM controls", CONTROLS)
ORACLE["fleet_health_modes"] = req(
    """,
f AS (
  SELECT count(*) AS n, count(*) FILTER (ready) AS up FROM (
    SELECT host, max_by(status = 200, request_id) AS ready FROM roster_v JOIN requests_v USING (host) GROUP BY 1)
)
SELECT mode, CASE WHEN mode = 'empty' THEN 0 ELSE n END AS backends,
  CASE WHEN mode IN ('empty', 'none_ready') THEN 0 ELSE up END AS ready_hosts,
  CASE WHEN mode = 'degraded_strict' THEN 'RANGER_UNAVAILABLE'
       WHEN mode IN ('empty', 'none_ready') OR up = 0 THEN 'NO_INSTANCES_READY' ELSE 'OK' END AS health,
  CASE WHEN mode = 'empty' THEN 'NO_BACKENDS' ELSE 'OK' END AS proxy_health
FROM f, (SELECT unnest(['ok', 'degraded_strict', 'none_ready', 'empty']) AS mode)
"""
)
ORACLE["adjudicate_versions"] = req(
    """
SELECT request_id, CASE WHEN outcome = 'forwarded' AND latency_us % 20 = 7 THEN 'upstream_timeout'
    WHEN outcome = 'forwarded' AND latency_us % 20 = 11 THEN 'upstream_error' ELSE outcome END AS outcome,
  CAST(CASE WHEN outcome = 'forwarded' AND latency_us % 20 = 7 THEN 504
            WHEN outcome = 'forwarded' AND latency_us % 20 = 11 THEN 502 ELSE code END AS INT) AS code,
  container_id, ok AND latency_us % 20 NOT IN (7, 11) AS ok, shown AS latency_us, retry_after_sec
FROM (SELECT a.* EXCLUDE (latency_us), a.latency_us AS shown, r.latency_us
      FROM adjudicated a JOIN requests_v r USING (request_id))
""",
    RULED,
    ROUTES,
    OUTCOMES.replace(
        "used AS (SELECT * FROM gated WHERE rule_in IS NOT NULL)",
        f"""used AS (
  SELECT * REPLACE (bucket || CASE WHEN ts_ms >= 1704067200000 + 15 * {DAY_MS} THEN '@2' ELSE '@1' END AS bucket)
  FROM gated WHERE rule_in IS NOT NULL
)""",
    ),
)
ORACLE["stream_rate_limit_reload"] = req(
    """
SELECT request_id, CAST(version AS INT) AS version, NOT denied AS allowed, retry_after_ms, reason,
  rule_desc FROM limited
""",
    RULED,
    f"""
used AS (
  SELECT * REPLACE (bucket || '@' || version AS bucket) FROM (
    SELECT *, CASE WHEN ts_ms >= 1704067200000 + 20 * {DAY_MS} THEN 3
                   WHEN ts_ms >= 1704067200000 + 10 * {DAY_MS} THEN 2 ELSE 1 END AS version
    FROM ruled WHERE path <> '/v1/models')
)""",
    limited("used"),
)
ORACLE["stream_instance_roster"] = ORACLE["instance_roster"]
ORACLE["stream_scale_recommendations"] = ORACLE["scale_recommendations"]
ORACLE["stream_readiness"] = req(
    """
SELECT concat(container_id, '/', start_id) AS container_id, start_ms,
  CASE WHEN took_ms IS NULL THEN 'warmup_timeout' ELSE 'warmup_ok' END AS verdict, took_ms FROM warm
""",
    WARMUP,
)
ORACLE["stream_adjudication_summary"] = ORACLE["adjudication_summary"]
ORACLE["stream_rate_limit_keyed"] = ORACLE["rate_limit"]
ORACLE["stream_drain_verdicts"] = ORACLE["drain_verdicts"]
ORACLE["stream_roster_changes"] = ORACLE["instance_roster"]
ORACLE["stream_running_totals"] = req(
    """
SELECT user_name, model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out
FROM daily GROUP BY 1, 2
""",
    DAILY,
)
ORACLE["stream_reports_sent_twice"] = ORACLE["windowed_chargeback"]
ORACLE["stream_latency_quantiles"] = req(
    "SELECT model, requests, p50_us, p95_us, p99_us FROM card WHERE model NOT LIKE 'shadow:%'", CARD
)
ORACLE["stream_proxy_overhead"] = ORACLE["proxy_overhead"]
ORACLE["inventory_changes"] = """
WITH files AS (
  SELECT o_orderkey // 7 AS m, o_orderkey % 10 AS d, o_custkey AS length FROM orders
)
SELECT concat('m', m) AS model,
  CASE WHEN bool_and(d = 2) THEN 'added' WHEN bool_and(d = 0) THEN 'removed' ELSE 'changed' END AS change,
  count(*) FILTER (d = 2) AS files_added, count(*) FILTER (d = 0) AS files_removed,
  count(*) FILTER (d = 1) AS files_changed,
  CAST(sum(CASE d WHEN 2 THEN length WHEN 0 THEN -length WHEN 1 THEN 5 ELSE 0 END) AS BIGINT) AS bytes_grown
FROM files GROUP BY m HAVING bool_or(d <= 2)
"""
ORACLE["scrape_log_family"] = req(
    """
SELECT host, ts_ms, unnest([base_model, 'other']) AS model,
  unnest([k % 20 + 0.7, 1.0])::DOUBLE AS value
FROM requests_v WHERE k % 10 <> 8
"""
)
ORACLE["stream_scrape_log"] = req(
    """,
l AS (
  SELECT host, ts_ms, unnest(CASE k % 10
    WHEN 7 THEN ['nv_inference_request_success', 'nv_inference_pending_request_count',
                 'nv_inference_pending_request_count']
    ELSE [NULL, NULL, 'nv_gpu_utilization', 'nv_gpu_utilization', 'nv_gpu_memory_used_bytes',
          'nv_inference_pending_request_count', 'nv_inference_pending_request_count',
          'nv_inference_request_success']
      || CASE WHEN k % 10 = 6 THEN ['nv_inference_pending_request_count'] ELSE [] END END) AS metric
  FROM requests_v WHERE k % 10 <> 8
)
SELECT host, metric, count(*) AS lines, max(ts_ms) AS newest_ms FROM l GROUP BY 1, 2
"""
)
