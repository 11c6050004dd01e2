"""SQL twins of the registered queries, for DuckDB on the same tables.

Written from the meaning of each query, not from its Spark plan: conversions of
the derived tables are stated as value tables here.
"""

from __future__ import annotations

from jobfacts import fixed_values as fv
from jobfacts.plans import views as v

# ------------------------------------------------------------------- fragments


def _lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _pick(values: list, index: str) -> str:
    listed = ", ".join(_lit(x) for x in values)
    return f"list_extract([{listed}], CAST(({index}) % {len(values)} + 1 AS INT))"


def _clock(s: str) -> str:
    return f"printf('%02d:%02d:%02d', ({s}) // 3600, ({s}) % 3600 // 60, ({s}) % 60)"


def _iso(epoch: str) -> str:
    return f"strftime(make_timestamp(CAST({epoch} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(_CTES[c] for c in ctes) + "\n" + body


def _case(column: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {_lit(k)} THEN {_lit(x)}" for k, x in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


_LIMIT_MINUTES = {"5m": 5, "1h": 60, "30s": 1, "2:00:00": 120, "45:30": 45, "30": 30, "1-02:30:00": 1590,
                  "0000000000000007m": 7}
_DURATION_SECONDS = {"1.5h": 5400, "90m": 5400, "30s": 30, "2d": 172800, "42": 42, "-": 0, "0.5m": 30}
_MEMORY_BYTES = {
    "4GB": 4 << 30, "16GB": 16 << 30, "512M": 512 << 20, "1T": 1 << 40,
    "2048MB": 2048 << 20, "8G": 8 << 30, "32gb": 32 << 30, "00000000004GB": 4 << 30,
    "12345678901234567890T": (1 << 63) - 1,
}

_TERMINAL = "('COMPLETED', 'FAILED', 'CANCELLED', 'TIMEOUT', 'NODE_FAIL', 'PREEMPTED')"

_CTES: dict[str, str] = {}

_CTES["clusters"] = """clusters AS (
  SELECT lower(r_name) AS cluster, CASE WHEN r_regionkey % 2 = 0 THEN 'slurm' ELSE 'flux' END AS backend,
         r_regionkey AS cluster_key
  FROM region)"""

_CTES["native"] = f"""usage AS (
  SELECT l_orderkey, count(*) AS line_count,
         CAST(floor(max(l_extendedprice)) AS BIGINT) * 1048576 AS memory_used_bytes,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey AS k, o_orderkey // 40 AS phase, o_orderstatus AS st, cluster, backend, o_totalprice,
         'user-' || o_custkey AS "user",
         lower(replace(substr(o_orderpriority, 3), ' ', '_')) AS "partition",
         epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400 AS submit_epoch,
         CAST(greatest(1, coalesce(line_count, 0)) AS INT) AS nodes,
         memory_used_bytes, quantity
  FROM orders JOIN clusters ON o_custkey % 5 = cluster_key LEFT JOIN usage ON l_orderkey = o_orderkey),
native AS (
  SELECT k AS native_id, cluster, backend,
         CASE WHEN k % 97 = 0 THEN '' ELSE 'app-' || k % 40 END AS job_name,
         "user", "partition",
         CASE WHEN backend = 'slurm' THEN
           CASE st WHEN 'F' THEN {_pick(v.SLURM_ENDED, 'phase')} WHEN 'P' THEN {_pick(v.SLURM_QUEUED, 'phase')}
                   ELSE {_pick(v.SLURM_STARTED, 'phase')} END
         ELSE
           CASE st WHEN 'F' THEN {_pick(v.FLUX_ENDED, 'phase')} WHEN 'P' THEN {_pick(v.FLUX_QUEUED, 'phase')}
                   ELSE {_pick(v.FLUX_STARTED, 'phase')} END
         END AS native_state,
         CASE WHEN backend = 'flux' AND st = 'F' THEN {_pick(v.FLUX_RESULTS, 'phase')} END AS result,
         submit_epoch,
         CASE WHEN st <> 'P' THEN submit_epoch + k % 7200 + 1 END AS start_epoch,
         CASE WHEN st = 'F' THEN submit_epoch + k % 7200 + 1 + CAST(floor(o_totalprice) AS BIGINT) % 90000 END
           AS end_epoch,
         {_pick(v.TIME_LIMITS, 'k')} AS time_limit, {_pick(v.FLUX_DURATIONS, 'k')} AS flux_duration,
         nodes, CAST(nodes * (1 + k % 4) AS INT) AS tasks, CAST(1 + k % 3 AS INT) AS cpus_per_task,
         {_pick(v.MEMORY, 'k')} AS memory, memory_used_bytes,
         CASE WHEN k % 3 <> 0 THEN quantity * 60 END AS cpu_seconds
  FROM base)"""

_CTES["jobs"] = f"""jobs AS (
  SELECT native_id, cluster, backend,
         CASE WHEN backend = 'flux' THEN 'ƒ' ELSE '' END || native_id AS job_id,
         CASE WHEN job_name = '' THEN 'unnamed' ELSE job_name END AS name,
         CASE WHEN backend = 'slurm' THEN
           {_case('native_state', fv.SLURM_STATES, 'native_state')}
         WHEN native_state = 'INACTIVE' THEN {_case('result', fv.FLUX_RESULTS, "'COMPLETED'")}
         ELSE {_case('native_state', fv.FLUX_STATES, 'native_state')} END AS state,
         submit_epoch, start_epoch, end_epoch,
         CASE WHEN start_epoch IS NULL THEN 0
              ELSE greatest(0, coalesce(end_epoch, {v.AS_OF}) - start_epoch) END AS runtime_seconds,
         CAST(CASE WHEN backend = 'flux' THEN CASE result WHEN 'COMPLETED' THEN 0 WHEN 'FAILED' THEN 1 END
              ELSE CASE native_state WHEN 'COMPLETED' THEN 0 WHEN 'FAILED' THEN 1 END END AS INT) AS exit_code,
         "user", "partition",
         CAST({_case('time_limit', _LIMIT_MINUTES, 'NULL')} AS BIGINT) * 60 AS time_limit_seconds,
         nodes, tasks, cpus_per_task, memory, memory_used_bytes, cpu_seconds,
         '/tmp/job-' || CASE WHEN backend = 'flux' THEN 'ƒ' ELSE '' END || native_id AS path
  FROM native)"""

_NODE_NAMES = (
    "array_to_string(list_transform(range(1, nodes + 1), lambda i: printf('node-%02d', i)), ',')"
)

_CTES["nodes"] = f"""nodes AS (
  SELECT cluster, 'node-' || s_suppkey AS name, {_pick(v.NODE_STATES, 's_suppkey')} AS state,
         CAST(4 + s_suppkey % 5 AS INT) AS cpus, {_pick([16, 32, 64, 128], 's_suppkey // 4')} AS memory_gb,
         CASE WHEN s_suppkey % 3 = 0 THEN [{_pick(v.PARTITIONS, 's_suppkey')}]
              ELSE [{_pick(v.PARTITIONS, 's_suppkey')}, {_pick(v.PARTITIONS, 's_suppkey + 2')}] END AS parts
  FROM supplier JOIN clusters ON s_nationkey % 5 = cluster_key),
node_parts AS (SELECT cluster, name AS node, state AS node_state, cpus, unnest(parts) AS name FROM nodes),
parts AS (
  SELECT cluster, {_pick(v.PARTITIONS, 'slot')} AS name,
         CASE WHEN (cluster_key + slot) % 4 = 3 THEN 'DOWN' ELSE 'UP' END AS state, n AS nodes,
         {_pick(v.PARTITION_LIMITS, 'slot')} AS max_time_limit,
         {_pick([1440, 720, 60, 150, 1440], 'slot')} AS max_minutes
  FROM (SELECT cluster, cluster_key, s_suppkey % 5 AS slot, count(*) AS n
        FROM supplier JOIN clusters ON s_nationkey % 5 = cluster_key GROUP BY ALL))"""

_CTES["requests"] = f"""requests AS (
  SELECT doc_id AS request_id, coalesce(cluster, 'nowhere') AS cluster, backend,
         CASE WHEN doc_id % 17 = 0 THEN chr(10) || chr(9) || ' ' ELSE '' END
         || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '#!/bin/bash' || chr(10) END
         || CASE WHEN doc_id % 7 = 0 THEN 'mpirun -n ' || doc_id % 33 || ' ./solver' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 11 = 0 THEN 'rsync -a in out' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 13 = 0 THEN 'Module load gcc/11.2.0' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 19 = 0 THEN '# Process 64GB dataset' || chr(10) ELSE '' END
         || coalesce(text, chr(10) || '  # nothing here' || chr(10) || chr(9) || chr(10)) AS script,
         'app-' || doc_id % 40 AS job_name,
         {_pick(v.REQUEST_NODES, 'doc_id')} AS nodes, {_pick(v.REQUEST_TASKS, 'doc_id')} AS tasks_per_node,
         {_pick(v.REQUEST_CPUS, 'doc_id')} AS cpus_per_task, {_pick(v.REQUEST_MEMORY, 'doc_id')} AS memory,
         {_pick(v.REQUEST_LIMITS, 'doc_id')} AS time_limit, {_pick(v.REQUEST_PARTITIONS, 'doc_id')} AS "partition"
  FROM (SELECT doc_id, text FROM documents
        UNION ALL SELECT doc_id + {v.COMMENT_IDS}, NULL FROM documents WHERE doc_id % 23 = 0)
  LEFT JOIN clusters ON doc_id % 6 = cluster_key)"""


def _any(patterns: list[str]) -> str:
    return " OR ".join(f"regexp_matches(lower(script), {_lit(p)})" for p in patterns)


def _plain(text: str) -> str:
    """The text with a letter, blank or mark of ASCII for all others, as the patterns of this engine know ASCII only.

    No word of the patterns has a j, so no character that becomes one makes a word.
    """
    for kind, stand_in in [*((k, "j") for k in ("L", "M", "Nd", "Nl", "Pc")), ("Z", " ")]:
        text = f"regexp_replace({text}, '[^\\x00-\\x7F\\P{{{kind}}}]', '{stand_in}', 'g')"
    return f"regexp_replace({text}, '[^\\x00-\\x7F]', ';', 'g')"


_CTES["classes"] = f"""plain AS (SELECT * REPLACE ({_plain('script')} AS script) FROM requests),
classes AS (
  SELECT request_id, cluster, backend, job_name, {_any(fv.CPU_PATTERNS)} AS cpu_intensive,
         {_any(fv.MEMORY_PATTERNS)} AS memory_intensive, {_any(fv.IO_PATTERNS)} AS io_intensive,
         nullif(try_cast(regexp_extract(lower(script), {_lit(fv.MPI_RANKS_PATTERN)}, 1) AS INT), 0) AS mpi_ranks
  FROM plain),
estimates AS (
  SELECT *,
    CASE workload WHEN 'cpu' THEN '8GB' WHEN 'memory' THEN '32GB' WHEN 'io' THEN '16GB' ELSE '4GB' END AS estimated_memory,
    CASE workload WHEN 'cpu' THEN '02:00:00' WHEN 'memory' THEN '01:30:00' WHEN 'io' THEN '03:00:00'
         ELSE '01:00:00' END AS estimated_runtime,
    CAST(CASE WHEN workload <> 'cpu' THEN 1 WHEN mpi_ranks IS NULL THEN 2 ELSE greatest(1, mpi_ranks // 4) END AS INT)
      AS recommended_nodes,
    CAST(CASE WHEN workload = 'cpu' THEN coalesce(mpi_ranks, 8) WHEN workload = 'generic' THEN 1 ELSE 4 END AS INT)
      AS recommended_tasks
  FROM (SELECT *, CASE WHEN cpu_intensive THEN 'cpu' WHEN memory_intensive THEN 'memory'
                       WHEN io_intensive THEN 'io' ELSE 'generic' END AS workload FROM classes))"""

_CTES["history"] = f"""history AS (
  SELECT cluster, name, count(*) AS similar_jobs,
         CAST(sum(runtime_seconds) AS BIGINT) / count(*) AS avg_runtime_seconds,
         CAST(sum(memory_used_bytes // 1048576) AS BIGINT) / nullif(count(memory_used_bytes), 0) AS avg_memory_mib,
         count(*) FILTER (state = 'COMPLETED') / count(*) AS success_rate
  FROM jobs WHERE state IN {_TERMINAL} GROUP BY cluster, name)"""

_CTES["issues"] = """facts AS (
  SELECT r.request_id, r.cluster, r.backend, script, r.nodes,
         regexp_replace(time_limit, '^\\s+|\\s+$', '', 'g') AS lim,
         regexp_replace("partition", '^\\s+|\\s+$', '', 'g') AS part,
         CASE memory WHEN '32GB' THEN 32::BIGINT << 30 WHEN '512M' THEN 512::BIGINT << 20
                     WHEN '1T' THEN 1::BIGINT << 40 WHEN '9999TB' THEN 9999::BIGINT << 40
                     WHEN '9999999999GB' THEN 9223372036854775807
                     WHEN '12345678901234567890M' THEN 9223372036854775807 END AS mem_bytes,
         memory, c.total, c.idle, c.mem_gb, names, p.state AS pstate, p.max_time_limit, p.max_minutes
  FROM requests r
  LEFT JOIN (SELECT cluster, count(*) AS total, count(*) FILTER (state = 'IDLE') AS idle, max(memory_gb) AS mem_gb
             FROM nodes GROUP BY cluster) c ON c.cluster = r.cluster
  LEFT JOIN (SELECT cluster, string_agg(name, ', ' ORDER BY name) AS names FROM parts GROUP BY cluster) n
    ON n.cluster = r.cluster
  LEFT JOIN parts p ON p.cluster = r.cluster
    AND p.name = regexp_replace(r."partition", '^\\s+|\\s+$', '', 'g')),
issues AS (
  SELECT request_id, cluster, 'error' AS severity, 'syntax' AS category,
         'Script missing shebang line (e.g., #!/bin/bash)' AS message, 1 AS line
  FROM facts WHERE NOT starts_with(regexp_replace(script, '^\\s+', ''), '#!')
  UNION ALL SELECT request_id, cluster, 'error', 'resources', 'Unknown cluster: ' || cluster, NULL
  FROM facts WHERE backend IS NULL
  UNION ALL SELECT request_id, cluster, 'error', 'resources', 'Node count must be >= 1, got ' || nodes, NULL
  FROM facts WHERE nodes < 1
  UNION ALL SELECT request_id, cluster, 'error', 'resources',
         'Requested ' || nodes || ' nodes, but cluster only has ' || total || ' total nodes', NULL
  FROM facts WHERE nodes >= 1 AND total > 0 AND nodes > total
  UNION ALL SELECT request_id, cluster, 'warning', 'resources',
         'Requested ' || nodes || ' nodes, but only ' || idle || ' nodes currently idle (cluster has ' || total || ' total)', NULL
  FROM facts WHERE nodes >= 1 AND NOT (total > 0 AND nodes > total) AND idle > 0 AND nodes > idle
  UNION ALL SELECT request_id, cluster, 'error', 'syntax', 'Time limit parameter cannot be empty string', NULL
  FROM facts WHERE lim = ''
  UNION ALL SELECT request_id, cluster, 'error', 'syntax', 'Invalid time limit format: ' || lim ||
         '. Expected formats: 1h, 30m, 60s, 1:30, or 1:30:00', NULL
  FROM facts WHERE lim IN ('invalid', '1.5h', '12345678901234567890')
  UNION ALL SELECT request_id, cluster, 'error', 'resources',
         'Partition ''' || part || ''' does not exist. Available partitions: ' || names, NULL
  FROM facts WHERE backend = 'slurm' AND part IS NOT NULL AND names IS NOT NULL AND pstate IS NULL
  UNION ALL SELECT request_id, cluster, 'warning', 'resources',
         'Partition ''' || part || ''' is not UP (current state: ' || pstate || ')', NULL
  FROM facts WHERE backend = 'slurm' AND pstate <> 'UP'
  UNION ALL SELECT request_id, cluster, 'error', 'limits',
         'Time limit ' || lim || ' exceeds the maximum ' || max_time_limit || ' of partition ''' || part || '''', NULL
  FROM facts WHERE backend = 'slurm' AND
         CASE lim WHEN '1h' THEN 60 WHEN '30m' THEN 30 WHEN '1:30' THEN 1 WHEN '2:30:00' THEN 150
                  WHEN '999:00:00' THEN 59940 WHEN '45M' THEN 45
                  WHEN '9999999999999m' THEN 9999999999999 END > max_minutes
  UNION ALL SELECT request_id, cluster, 'error', 'resources',
         'Requested memory ' || memory || ' exceeds the largest node of the cluster', NULL
  FROM facts WHERE mem_bytes > mem_gb::BIGINT << 30
  UNION ALL SELECT request_id, cluster, 'warning', 'syntax',
         'Script contains no executable commands (only comments or whitespace)', NULL
  FROM facts WHERE len(list_filter(string_split(script, chr(10)), lambda x: regexp_matches(x, '^\\s*[^\\s#]'))) = 0
  UNION ALL SELECT request_id, cluster, 'info', 'compatibility',
         'Script uses ''module load'' - ensure modules are available on target cluster', NULL
  FROM facts WHERE contains(lower(script), 'module load'))"""

_CTES["batches"] = f"""batches AS (
  SELECT p_partkey AS batch_id, {_pick(v.ARRAY_SPECS, 'p_partkey')} AS array_spec,
         string_split(p_type, ' ') AS words, CASE WHEN p_partkey % 3 = 0 THEN 10 END AS cap,
         {_pick([1, 1, 1, None, None, None, None, 3, None, None, 10**18 + 1, None], 'p_partkey')} AS first,
         {_pick([10, 100, 50, None, None, None, None, 7, None, None, 10**18 + 4, None], 'p_partkey')} AS last,
         {_pick([1, 2, 1, None, None, None, None, 1, None, None, 2, None], 'p_partkey')} AS step
  FROM part),
tasks AS (
  SELECT batch_id, task_index, task_id FROM (
    SELECT batch_id, cap, CAST(i - 1 AS BIGINT) AS task_index, CAST(first + (i - 1) * step AS BIGINT) AS task_id
    FROM (SELECT *, unnest(range(1, (last - first) // step + 2)) AS i FROM batches WHERE first IS NOT NULL))
  WHERE cap IS NULL OR task_index < cap)"""

_PARAMETERS = [float(p) for p in fv.SWEEP_PARAMETERS]
_CTES["params"] = (
    "params AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {p}::DOUBLE)" for i, p in enumerate(_PARAMETERS))
    + ") AS t(position, parameter))"
)

_CTES["lines"] = """lines AS (
  SELECT conv_id AS native_id, stream, turn, i - 1 AS line_no, parts[i] AS line FROM (
    SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'stdout' ELSE 'stderr' END AS stream,
             string_split(text, chr(10)) AS parts FROM conversations))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY native_id, stream ORDER BY turn DESC, line_no DESC, line DESC) AS from_end,
         count(*) OVER (PARTITION BY native_id, stream) AS n
  FROM lines)"""

_CTES["status"] = f"""status AS (
  SELECT 'job-' || user_id || '-' || strftime(ts, '%Y%m%d') AS job_id, user_id,
         {_case('event_type', v.EVENT_STATES, 'NULL')} AS state,
         epoch_us(ts) // {v.TICK} * {v.TICK} AS ts FROM events)"""

_CTES["ready"] = """mc AS (
  SELECT 'ns-' || user_id % 7 AS namespace, 'mc-' || user_id AS name, epoch_us(ts) AS ts, event_type,
         CAST(props ->> '$.k' AS INT) AS k FROM events),
ready AS (
  SELECT *, event_type = 'purchase' OR (event_type = 'signup' AND k >= 90)
            OR (event_type = 'error' AND k > 60) AS ok FROM mc)"""

_CTES["readings"] = """uniq AS (
  SELECT event_id AS reading_id, user_id AS sensor_id, ts,
         CASE WHEN event_id % 79 <> 0 THEN value END AS value, event_type AS kind FROM events),
readings AS (SELECT * FROM uniq UNION ALL SELECT * FROM uniq WHERE reading_id % 100 = 0)"""


# --------------------------------------------------------------------- queries
_COUNTS = """count(*) AS total_jobs, count(*) FILTER (state = 'RUNNING') AS running,
  count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'COMPLETED') AS completed"""
_MORE = """, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'CANCELLED') AS cancelled"""
_JOBS = ["clusters", "native", "jobs"]
_CONCISE = f"""SELECT job_id, name, state, {_iso('submit_epoch')} AS submitted,
  {_clock('runtime_seconds')} AS runtime, exit_code FROM jobs"""
_CPU = "coalesce(cpu_seconds, CAST(trunc(runtime_seconds * 0.8::DOUBLE) AS BIGINT))"
_CPUS = "(CAST(tasks AS BIGINT) * cpus_per_task)"
_EFFICIENCY = f"CASE WHEN runtime_seconds * {_CPUS} > 0 THEN {_CPU} / (runtime_seconds * {_CPUS}) END"

_SLURM_FLAT = f"""SELECT native_id::VARCHAR AS job_id, job_name AS name,
  {_case('native_state', fv.SLURM_STATES, 'native_state')} AS state,
  CASE WHEN start_epoch IS NULL THEN 0 ELSE greatest(0, coalesce(end_epoch, {v.AS_OF}) - start_epoch) END
    AS runtime_seconds,
  CAST(CASE native_state WHEN 'COMPLETED' THEN 0 WHEN 'FAILED' THEN 1 END AS INT) AS exit_code,
  "user", "partition", CAST({_case('time_limit', _LIMIT_MINUTES, 'NULL')} AS BIGINT) * 60 AS time_limit_seconds,
  '/home/work' AS working_directory, '/tmp/slurm-' || native_id || '.out' AS stdout_path,
  '/tmp/slurm-' || native_id || '.err' AS stderr_path,
  submit_epoch AS submitted, start_epoch AS started, end_epoch AS ended, nodes, tasks, cpus_per_task,
  CASE WHEN native_id % 4 <> 0 THEN memory ELSE '' END AS memory,
  CAST(CASE WHEN start_epoch IS NULL THEN 0 ELSE nodes END AS INT) AS n_allocated
FROM native WHERE backend = 'slurm' AND native_id % 101 <> 0 AND native_id % 107 <> 0"""

_FLUX_REJECT = """CASE WHEN native_id % 103 = 0 THEN 'too few fields'
  WHEN native_id % 89 = 0 THEN 'too many fields'
  WHEN native_id % 83 = 0 OR flux_duration = '1.2.3s' THEN 'unparsable number' END"""
_FLUX_FLAT = f"""SELECT 'ƒ' || native_id AS job_id, CASE WHEN job_name = '' THEN 'unnamed' ELSE job_name END AS name,
  CASE WHEN native_state = 'INACTIVE' THEN {_case('result', fv.FLUX_RESULTS, "'COMPLETED'")}
       ELSE {_case('native_state', fv.FLUX_STATES, 'native_state')} END AS state,
  coalesce(end_epoch - start_epoch, 0) AS runtime_seconds,
  CAST(CASE result WHEN 'COMPLETED' THEN 0 WHEN 'FAILED' THEN 1 END AS INT) AS exit_code,
  'flux' AS "user", 'default' AS "partition",
  CAST({_case('flux_duration', _DURATION_SECONDS, 'NULL')} AS BIGINT) AS time_limit_seconds,
  '/tmp' AS working_directory, '' AS stdout_path, '' AS stderr_path,
  submit_epoch AS submitted, start_epoch AS started, end_epoch AS ended,
  CAST(CASE WHEN native_id % 7 = 0 THEN 0 ELSE nodes END AS INT) AS nodes, tasks, 1 AS cpus_per_task,
  'N/A' AS memory, 0 AS n_allocated
FROM native WHERE backend = 'flux' AND ({_FLUX_REJECT}) IS NULL"""

_SUMMARY = f"""SELECT CASE WHEN native_id % 101 <> 0 THEN native_id::VARCHAR END AS job_id, job_name AS name, "user",
  native_state AS state, "partition", nodes::VARCHAR AS nodes, tasks AS ntasks,
  CAST(tasks * cpus_per_task AS INT) AS cpus,
  CASE WHEN native_id % 4 <> 0 AND memory <> '' THEN memory ELSE 'mem=' || memory END AS memory,
  CASE WHEN native_id % 107 <> 0 THEN {_iso('submit_epoch')} END AS submit_time, {_iso('start_epoch')} AS start_time,
  {_iso('end_epoch')} AS end_time, end_epoch - start_epoch AS runtime_seconds,
  CASE WHEN native_id % 5 = 0 THEN '/tmp/expanded-' ELSE '/tmp/slurm-' END || native_id || '.out' AS stdout,
  '/tmp/slurm-' || native_id || '.err' AS stderr,
  CASE WHEN start_epoch IS NULL THEN '' ELSE {_NODE_NAMES} END AS node_list,
  CAST(CASE native_state WHEN 'COMPLETED' THEN 0 WHEN 'FAILED' THEN 1 END AS INT) AS exit_code
FROM native WHERE backend = 'slurm'"""


def _human(s: str) -> str:
    return f"""CASE WHEN {s} >= 3600 THEN ({s} // 3600) || 'h' ELSE '' END
    || CASE WHEN {s} % 3600 >= 60 THEN ({s} % 3600 // 60) || 'm' WHEN {s} >= 3600 AND {s} % 60 <> 0 THEN '0m' ELSE '' END
    || {s} % 60 || 's'"""


_STATS = """stats AS (SELECT sensor_id, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low,
  max(value) AS high FROM {source} GROUP BY sensor_id)"""


def _prep(body: str, source: str = "uniq") -> str:
    return "WITH " + _CTES["readings"] + ",\n" + _STATS.format(source=source) + "\n" + body


_CLEANED = (
    "WITH "
    + _CTES["readings"]
    + ", kept AS (SELECT * FROM uniq WHERE value IS NULL OR value BETWEEN 0.05 AND 200),\n"
    + _STATS.format(source="kept")
    + """, counters AS (SELECT (SELECT count(*) FROM readings) AS input_records, count(*) AS output_records,
  (SELECT count(*) FROM readings WHERE value NOT BETWEEN 0.05 AND 200) AS rejected_records,
  count(*) FILTER (value IS NULL) AS missing_values_imputed,
  count(*) FILTER (abs(value - mean) > 3 * std) AS outliers_detected,
  (SELECT count(*) FROM readings) - count(*) - (SELECT count(*) FROM readings WHERE value NOT BETWEEN 0.05 AND 200)
    AS duplicates_removed FROM kept JOIN stats USING (sensor_id))"""
)

_REQUEST_REASONS = """array_to_string(list_filter([
    CASE WHEN NOT regexp_matches(script, '\\S') THEN 'empty script' END,
    CASE WHEN length(script) > 20000 THEN 'script too long' END,
    CASE WHEN regexp_matches(script, '\\S') AND NOT starts_with(regexp_replace(script, '^\\s+', ''), '#!')
         THEN 'no shebang' END,
    CASE WHEN nodes < 1 THEN 'nodes below 1' END,
    CASE WHEN tasks_per_node < 1 THEN 'tasks per node below 1' END,
    CASE WHEN cpus_per_task < 1 THEN 'cpus per task below 1' END,
    CASE WHEN memory = '  ' THEN 'empty memory' END,
    CASE WHEN memory = 'invalid' THEN 'memory format' END,
    CASE WHEN time_limit = ' ' THEN 'empty time limit' END,
    CASE WHEN time_limit IN ('invalid', '12345678901234567890') THEN 'time limit format' END], lambda x: x IS NOT NULL), '; ')"""

_ADVICE = """SELECT request_id, 'nodes' AS parameter, recommended_nodes::VARCHAR AS value,
  CASE WHEN cpu_intensive THEN 'high' ELSE 'medium' END AS confidence,
  'Based on ' || CASE WHEN cpu_intensive THEN 'parallel workload detection' ELSE 'workload analysis' END || ', '
  || recommended_nodes || ' node(s) recommended' AS reason FROM estimates
UNION ALL SELECT request_id, 'tasks', recommended_tasks::VARCHAR, 'medium', 'Optimal task count for '
  || CASE WHEN cpu_intensive THEN 'CPU-intensive' ELSE 'standard' END || ' workload' FROM estimates
UNION ALL SELECT request_id, 'memory', estimated_memory, CASE WHEN memory_intensive THEN 'medium' ELSE 'low' END,
  'Estimated based on ' || CASE WHEN memory_intensive THEN 'memory-intensive patterns'
  ELSE 'typical workload requirements' END FROM estimates
UNION ALL SELECT request_id, 'time_limit', estimated_runtime, 'low',
  'Estimated runtime with 20% buffer. Monitor first run and adjust.' FROM estimates
UNION ALL SELECT request_id, 'partition', 'io-optimized', 'medium',
  'I/O-intensive workload detected. Consider using I/O-optimized partition if available.'
  FROM estimates WHERE io_intensive"""

_ISSUES = ["clusters", "nodes", "requests", "issues"]
_CLASSES = ["clusters", "requests", "classes"]

_NEWEST = f"first(state ORDER BY ts DESC, (state IN {_TERMINAL})::INT DESC, state DESC)"

_FIRST_TERMINAL = _with(
    ["status"],
    f"SELECT job_id, first(state ORDER BY ts, state) AS state, min(ts) AS ts FROM status WHERE state IN {_TERMINAL} GROUP BY job_id",
)
_TIMEOUTS = _with(
    ["status"],
    f"""SELECT job_id, CASE WHEN ok THEN end_state ELSE 'TIMEOUT' END AS state,
  CASE WHEN ok THEN end_ts ELSE deadline END AS ts, ok AND end_state = 'COMPLETED' AS success
FROM (SELECT job_id, end_state, end_ts, first_ts + 3600000000 AS deadline,
             coalesce(end_ts <= first_ts + 3600000000, false) AS ok
      FROM (SELECT job_id, min(ts) AS first_ts, min(ts) FILTER (state IN {_TERMINAL}) AS end_ts,
                   first(state ORDER BY ts, state) FILTER (state IN {_TERMINAL}) AS end_state
            FROM status GROUP BY job_id))""",
)
_READY = _with(
    ["ready"],
    """SELECT namespace, name,
  CASE WHEN min(ts) FILTER (ok) IS NULL THEN 'Unknown'
       WHEN first(event_type ORDER BY ts) FILTER (ok) = 'purchase' THEN 'Running' END AS phase,
  CASE WHEN min(ts) FILTER (ok) IS NULL THEN 'Timeout' END AS reason, min(ts) FILTER (ok) AS ts
FROM ready GROUP BY namespace, name""",
)

ORACLE: dict[str, str] = {
    "queue_status": _with(_JOBS, f"SELECT cluster, {_COUNTS} FROM jobs GROUP BY cluster"),
    "queue_status_detailed": _with(_JOBS, f"SELECT cluster, {_COUNTS}{_MORE} FROM jobs GROUP BY cluster"),
    "node_summary": _with(
        ["clusters", "nodes"],
        """SELECT cluster, count(*) AS nodes_total, count(*) FILTER (state = 'IDLE') AS nodes_idle,
  count(*) FILTER (state IN ('ALLOCATED', 'MIXED')) AS nodes_allocated, count(*) FILTER (state = 'DOWN') AS nodes_down,
  CAST(sum(cpus) AS BIGINT) AS cores_total,
  CAST(coalesce(sum(cpus) FILTER (state = 'IDLE'), 0) AS BIGINT) AS cores_available FROM nodes GROUP BY cluster""",
    ),
    "utilization": _with(
        _JOBS + ["nodes"],
        f"""SELECT n.cluster, least(coalesce(held, 0), nodes_total) AS nodes_allocated, nodes_total,
  least(coalesce(cores, 0), cores_total) AS cores_allocated, cores_total
FROM (SELECT cluster, count(*) AS nodes_total, CAST(sum(cpus) AS BIGINT) AS cores_total FROM nodes GROUP BY cluster) n
LEFT JOIN (SELECT cluster, CAST(sum(nodes) AS BIGINT) AS held, CAST(sum({_CPUS}) AS BIGINT) AS cores
           FROM jobs WHERE state = 'RUNNING' GROUP BY cluster) j ON j.cluster = n.cluster""",
    ),
    "partition_summary": _with(
        ["clusters", "nodes"],
        """SELECT p.cluster, p.name, p.state, p.max_time_limit, coalesce(n, 0) AS nodes, coalesce(c, 0) AS cpus,
  coalesce(u, 0) AS nodes_up FROM parts p LEFT JOIN (
  SELECT cluster, name, count(*) AS n, CAST(sum(cpus) AS BIGINT) AS c, count(*) FILTER (node_state <> 'DOWN') AS u
  FROM node_parts GROUP BY cluster, name) x ON x.cluster = p.cluster AND x.name = p.name""",
    ),
    "partition_names": _with(
        ["clusters", "nodes"],
        "SELECT cluster, string_agg(name, ', ' ORDER BY name) AS partition_names FROM parts GROUP BY cluster",
    ),
    "node_partitions": _with(["clusters", "nodes"], "SELECT cluster, node, node_state, cpus, name FROM node_parts"),
    "cluster_types": _with(["clusters"], 'SELECT cluster AS name, backend AS "type" FROM clusters'),
    "clusters_redacted": _with(
        ["clusters"],
        """SELECT cluster AS name, 'user' AS setting, cluster AS value FROM clusters
UNION ALL SELECT cluster, 'jwt_token', '***' FROM clusters""",
    ),
    "jobs_by_backend": _with(
        _JOBS, "SELECT backend, state, count(*) AS jobs FROM jobs GROUP BY backend, state"
    ),
    "list_jobs_recent": _with(_JOBS, f"{_CONCISE} ORDER BY job_id DESC LIMIT 100"),
    "list_jobs_filtered": _with(
        _JOBS, f"{_CONCISE} WHERE cluster = 'asia' AND state = 'RUNNING' ORDER BY job_id DESC LIMIT 50"
    ),
    "list_total": _with(_JOBS, "SELECT count(*) AS total, true AS filtered FROM jobs WHERE state = 'FAILED'"),
    "list_envelope": _with(
        _JOBS,
        f"""SELECT CAST(to_json({{'success': true, 'jobs': (SELECT list(j ORDER BY j.job_id DESC) FROM (
    {_CONCISE} WHERE cluster = 'europe' AND state = 'FAILED' ORDER BY job_id DESC LIMIT 25) j),
  'total': (SELECT count(*) FROM jobs WHERE cluster = 'europe' AND state = 'FAILED'), 'filtered': true}}) AS VARCHAR)
  AS response""",
    ),
    "list_sample": _with(
        _JOBS,
        f"SELECT job_id, name, state, {_clock('runtime_seconds')} AS runtime FROM jobs ORDER BY job_id DESC LIMIT 20",
    ),
    "recent_per_cluster": _with(
        _JOBS,
        f"""SELECT * FROM (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY job_id DESC) AS INT)
  AS position, job_id, name, state, {_clock('runtime_seconds')} AS runtime FROM jobs) WHERE position <= 20""",
    ),
    "job_lookup": _with(_JOBS, f"{_CONCISE} WHERE job_id = '100'"),
    "native_state_pushdown": _with(
        _JOBS, "SELECT cluster, state, count(*) AS jobs FROM jobs WHERE state = 'FAILED' GROUP BY cluster, state"
    ),
    "job_concise": _with(_JOBS, _CONCISE),
    "job_detailed": _with(
        _JOBS,
        f"""SELECT job_id, name, state, {_iso('submit_epoch')} AS submitted, {_clock('runtime_seconds')} AS runtime,
  exit_code, "user", "partition", {_iso('start_epoch')} AS started, {_iso('end_epoch')} AS ended,
  {_clock('time_limit_seconds')} AS time_limit, '/tmp' AS working_directory, path || '.out' AS stdout_path,
  path || '.err' AS stderr_path, nodes, tasks, cpus_per_task, memory,
  CASE WHEN start_epoch IS NULL THEN '' ELSE {_NODE_NAMES} END AS allocated_nodes FROM jobs""",
    ),
    "slurm_normalized": _with(["clusters", "native"], _SLURM_FLAT),
    "slurm_roundtrip": _with(["clusters", "native"], _SLURM_FLAT),
    "slurm_rejects": _with(
        ["clusters", "native"],
        """SELECT CASE WHEN native_id % 101 = 0 THEN 'no job id' ELSE 'time out of range' END AS reject, count(*) AS jobs
FROM native WHERE backend = 'slurm' AND (native_id % 101 = 0 OR native_id % 107 = 0) GROUP BY 1""",
    ),
    "flux_normalized": _with(["clusters", "native"], _FLUX_FLAT),
    "flux_rejects": _with(
        ["clusters", "native"],
        f"""SELECT line, CAST(len(string_split(line, ',')) AS INT) AS n_fields, reject FROM (
  SELECT {_FLUX_REJECT} AS reject, CASE WHEN native_id % 103 = 0 THEN head ELSE concat_ws(',', head,
    coalesce(start_epoch::VARCHAR, '-'), coalesce(end_epoch::VARCHAR, '-'), coalesce(result, '-'),
    CASE WHEN native_id % 7 = 0 THEN '?' ELSE nodes::VARCHAR END, tasks::VARCHAR, flux_duration,
    coalesce((end_epoch - start_epoch) || 's', '-')) END AS line
  FROM (SELECT *, concat_ws(',', 'ƒ' || native_id, CASE WHEN native_id % 89 = 0 THEN 'with,comma' ELSE job_name END,
          native_state, CASE WHEN native_id % 166 = 0 THEN '1e300' WHEN native_id % 83 = 0 THEN 'soon' ELSE submit_epoch || '.25' END) AS head
        FROM native WHERE backend = 'flux')) WHERE reject IS NOT NULL""",
    ),
    "flux_short_listing": _with(
        ["clusters", "native"],
        f"""SELECT 'ƒ' || native_id AS job_id, CASE WHEN job_name = '' THEN 'unnamed' ELSE job_name END AS name,
  {_case('native_state', fv.FLUX_STATES, 'native_state')} AS state, submit_epoch AS submitted,
  coalesce(end_epoch - start_epoch, 0) AS runtime_seconds FROM native WHERE backend = 'flux'""",
    ),
    "all_jobs": _with(
        ["clusters", "native"],
        f"""SELECT "partition", state, count(*) AS jobs, CAST(sum(runtime_seconds) AS BIGINT) AS runtime_seconds
FROM ({_SLURM_FLAT} UNION ALL {_FLUX_FLAT}) GROUP BY "partition", state""",
    ),
    "job_summary": _with(["clusters", "native"], _SUMMARY),
    "job_summary_text": _with(
        ["clusters", "native"],
        f"""SELECT job_id, 'Job ' || coalesce(job_id, 'None') || ' (' || name || '), user=' || "user" || ', state=' || state
  || ', partition=' || "partition" || ', nodes=' || nodes || ', tasks=' || ntasks
  || coalesce(', runtime=' || {_human('runtime_seconds')}, '') AS status_text FROM ({_SUMMARY})""",
    ),
    "state_normalization": _with(
        _JOBS,
        """SELECT n.backend, native_state, result, state, count(*) AS jobs FROM native n JOIN jobs USING (native_id)
GROUP BY n.backend, native_state, result, state""",
    ),
    "slurm_time_limits": _with(
        ["clusters", "native"],
        f"""SELECT time_limit, CAST({_case('time_limit', _LIMIT_MINUTES, 'NULL')} AS BIGINT) AS minutes, count(*) AS jobs
FROM native GROUP BY time_limit""",
    ),
    "flux_durations": _with(
        ["clusters", "native"],
        f"""SELECT flux_duration, CAST({_case('flux_duration', _DURATION_SECONDS, 'NULL')} AS BIGINT) AS seconds,
  count(*) AS jobs FROM native GROUP BY flux_duration""",
    ),
    "runtime_clock": _with(
        _JOBS,
        f"""SELECT job_id, runtime_seconds, {_clock('runtime_seconds')} AS clock, runtime_seconds AS seconds_back,
  {_human('runtime_seconds')} AS human FROM jobs""",
    ),
    "memory_bytes": _with(
        ["clusters", "native"],
        f"""SELECT memory, CAST({_case('memory', _MEMORY_BYTES, 'NULL')} AS BIGINT) AS bytes, count(*) AS jobs
FROM native GROUP BY memory""",
    ),
    "accounting_page": _with(
        _JOBS,
        f"""SELECT job_id, name, "user", state, exit_code, {_clock('runtime_seconds')} AS runtime, {_clock(_CPU)} AS cpu_time,
  memory_used_bytes, memory AS memory_requested, {_EFFICIENCY} AS cpu_efficiency,
  {_clock('start_epoch - submit_epoch')} AS wait_time,
  CASE WHEN start_epoch IS NULL THEN 'node-01' ELSE {_NODE_NAMES} END AS nodes_used,
  {_iso('submit_epoch')} AS submit_time, {_iso('coalesce(start_epoch, submit_epoch)')} AS start_time,
  {_iso('coalesce(end_epoch, submit_epoch)')} AS end_time
FROM jobs WHERE cluster = 'africa' ORDER BY job_id DESC LIMIT 200""",
    ),
    "accounting_range": _with(
        _JOBS,
        f"""SELECT job_id, name, "user", state, exit_code, {_clock('runtime_seconds')} AS runtime, {_clock(_CPU)} AS cpu_time
FROM jobs WHERE submit_epoch BETWEEN epoch_us(TIMESTAMP '1997-01-01') // 1000000
  AND epoch_us(TIMESTAMP '1998-06-30 12:00:00') // 1000000 ORDER BY job_id DESC LIMIT 1000""",
    ),
    "accounting_total": _with(
        _JOBS,
        """SELECT count(*) AS total FROM jobs
WHERE "user" = 'user-7' AND submit_epoch >= epoch_us(TIMESTAMP '1997-01-01') // 1000000""",
    ),
    "cpu_efficiency": _with(
        _JOBS,
        f"SELECT job_id, runtime_seconds, {_CPU} AS cpu_time_seconds, {_EFFICIENCY} AS cpu_efficiency FROM jobs",
    ),
    "wait_time": _with(
        _JOBS,
        """SELECT cluster, state, count(start_epoch) AS started,
  CAST(sum(start_epoch - submit_epoch) AS BIGINT) AS total_wait_seconds,
  max(start_epoch - submit_epoch) AS max_wait_seconds FROM jobs GROUP BY cluster, state""",
    ),
    "request_checks": _with(
        ["clusters", "requests"],
        f"SELECT request_id, reasons = '' AS success, reasons FROM (SELECT request_id, {_REQUEST_REASONS} AS reasons FROM requests)",
    ),
    "minicluster_checks": """SELECT name, namespace, reasons = '' AS valid, reasons FROM (
  SELECT 'mc-' || p_partkey AS name, 'ns-' || p_partkey % 7 AS namespace, array_to_string(list_filter([
    CASE WHEN p_size < 3 THEN 'size below 1' END,
    CASE WHEN p_partkey % 2 = 0 AND p_size - 2 > 25 THEN 'max size below size' END,
    CASE WHEN p_partkey % 6 = 0 THEN 'negative tasks' END,
    CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN 'image' END,
    CASE WHEN p_partkey % 3 = 0 AND (p_partkey % 5 = 0 OR p_partkey % 4 = 0) THEN 'batch needs command and tasks' END
  ], lambda x: x IS NOT NULL), '; ') AS reasons FROM part WHERE p_partkey % 7 IN (1, 2, 5))""",
    "unknown_clusters": _with(["clusters", "requests"], "SELECT request_id, cluster FROM requests WHERE backend IS NULL"),
    "script_classes": _with(
        _CLASSES, "SELECT request_id, cpu_intensive, memory_intensive, io_intensive, mpi_ranks FROM classes"
    ),
    "script_estimates": _with(
        _CLASSES,
        """SELECT request_id, workload, estimated_memory, estimated_runtime, recommended_nodes, recommended_tasks
FROM estimates""",
    ),
    "script_recommendations": _with(_CLASSES, _ADVICE),
    "workload_mix": _with(
        _CLASSES,
        """SELECT cpu_intensive, memory_intensive, io_intensive, count(*) AS scripts FROM classes
GROUP BY cpu_intensive, memory_intensive, io_intensive""",
    ),
    "script_analysis": _with(
        _JOBS + ["requests", "classes", "history"],
        """SELECT request_id, coalesce(backend, 'unknown') AS backend, workload,
  coalesce(similar_jobs, 0) AS similar_jobs, avg_runtime_seconds, avg_memory_mib,
  coalesce(success_rate, 0) AS success_rate, CAST(CASE WHEN io_intensive THEN 5 ELSE 4 END AS INT) AS n_recommendations
FROM estimates e LEFT JOIN history h ON h.cluster = e.cluster AND h.name = e.job_name""",
    ),
    "validate_issues": _with(_ISSUES, "SELECT request_id, cluster, severity, category, message, line FROM issues"),
    "validate_recommendations": _with(
        _ISSUES,
        """SELECT request_id, cluster, 'nodes' AS field, nodes::VARCHAR AS current, total::VARCHAR AS suggested,
  'Cluster maximum' AS reason FROM facts WHERE nodes >= 1 AND total > 0 AND nodes > total""",
    ),
    "validate_rollup": _with(
        _ISSUES,
        """SELECT request_id, count(*) FILTER (severity = 'error') = 0 AS valid, count(*) FILTER (severity = 'error') AS errors,
  count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos
FROM requests LEFT JOIN issues USING (request_id) GROUP BY request_id""",
    ),
    "validate_issue_kinds": _with(
        _ISSUES, "SELECT severity, category, count(*) AS issues FROM issues GROUP BY severity, category"
    ),
    "missing_partitions": _with(
        ["clusters", "nodes", "requests"],
        """SELECT DISTINCT r.cluster, trim(r."partition") AS "partition" FROM requests r
WHERE r.backend = 'slurm' AND r."partition" IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM parts p WHERE p.cluster = r.cluster AND p.name = trim(r."partition"))""",
    ),
    "history_comparison": _with(_JOBS + ["history"], "SELECT * FROM history"),
    "similar_jobs": _with(
        _JOBS,
        f"""SELECT j.job_id, j.cluster, j.name, coalesce(n - me, 0) AS similar_jobs,
  CASE WHEN n - me > 0 THEN CAST(r - me * runtime_seconds AS BIGINT) / (n - me) END AS avg_runtime_seconds,
  CASE WHEN n - me > 0 THEN (c - CAST(state = 'COMPLETED' AS INT)) / (n - me) END AS success_rate
FROM (SELECT *, CAST(state IN {_TERMINAL} AS INT) AS me FROM jobs) j
LEFT JOIN (SELECT cluster, name, count(*) AS n, sum(runtime_seconds) AS r, count(*) FILTER (state = 'COMPLETED') AS c
           FROM jobs WHERE state IN {_TERMINAL} GROUP BY cluster, name) h
  ON h.cluster = j.cluster AND h.name = j.name""",
    ),
    "time_limit_from_history": _with(
        _JOBS + ["history"],
        f"""SELECT cluster, name, similar_jobs, m AS suggested_minutes, {_clock('m * 60')} AS suggested_time_limit
FROM (SELECT *, CAST(ceil(avg_runtime_seconds * 1.25::DOUBLE / 60) AS BIGINT) AS m FROM history)""",
    ),
    "requested_vs_used": _with(
        _JOBS,
        f"""SELECT cluster, "user", count(*) AS jobs, CAST(sum(p) AS BIGINT) / count(*) AS avg_percent_used,
  max(p) AS max_percent_used, quantile_cont(CAST(p AS DOUBLE), 0.9) AS p90_percent_used,
  CAST(ceil(max(memory_used_bytes // 1048576) * 1.25::DOUBLE) AS BIGINT) AS recommended_mib
FROM (SELECT *, memory_used_bytes * 100 // CAST({_case('memory', _MEMORY_BYTES, 'NULL')} AS BIGINT) AS p FROM jobs)
WHERE p IS NOT NULL GROUP BY cluster, "user" """,
    ),
    "array_expansion": _with(["batches"], "SELECT batch_id, task_index, task_id FROM tasks"),
    "array_errors": _with(
        ["batches"],
        """SELECT batch_id, 0 AS "index", array_spec AS command, 'invalid array spec' AS error FROM batches
WHERE array_spec IN ('1-10:0', 'a-b', '1-99999999999999999999')""",
    ),
    "capped_tasks": _with(["batches"], "SELECT batch_id, task_index, task_id FROM tasks WHERE task_index < 3"),
    "bulk_commands": _with(
        ["batches"],
        """SELECT batch_id, CAST(i - 1 AS INT) AS task_index, words[i] AS command
FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM batches WHERE array_spec IS NULL)""",
    ),
    "batch_sources": _with(
        ["batches"],
        """SELECT batch_id, CASE WHEN array_spec IS NULL AND batch_id % 4 <> 0
  THEN 'neither array_spec nor commands' END AS reason FROM batches""",
    ),
    "batch_summary": _with(
        ["batches"],
        """SELECT *, submitted > 0 AS success FROM (
  SELECT batch_id, reason,
    CASE WHEN reason IS NOT NULL THEN NULL WHEN array_spec IS NULL THEN 'bulk' ELSE 'array' END AS batch_type,
    CASE WHEN reason IS NOT NULL THEN 0 WHEN array_spec IS NULL THEN commands ELSE coalesce(n, 0) END AS submitted,
    CAST(reason IS NULL AND coalesce(array_spec IN ('1-10:0', 'a-b', '1-99999999999999999999'), false) AS BIGINT) AS failed
  FROM (SELECT *, CASE WHEN array_spec IS NOT NULL AND commands > 0 THEN 'both array_spec and commands'
                       WHEN array_spec IS NULL AND commands = 0 THEN 'neither array_spec nor commands' END AS reason
        FROM (SELECT *, CASE WHEN batch_id % 11 = 0 THEN 1 WHEN batch_id % 4 <> 1 AND array_spec IS NULL THEN len(words)
                             ELSE 0 END AS commands FROM batches)
        LEFT JOIN (SELECT batch_id, count(*) AS n FROM tasks GROUP BY batch_id) USING (batch_id)))""",
    ),
    "param_sweep": _with(
        ["batches", "params"],
        """SELECT batch_id, task_index, task_id, parameter, round(parameter * 100 + task_id, 4) AS result,
  CASE WHEN parameter IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM tasks LEFT JOIN params ON position = greatest(task_id - 1, 0)""",
    ),
    "sweep_performance": _with(
        _JOBS + ["params"],
        """SELECT parameter, count(*) AS runs, CAST(sum(runtime_seconds) AS BIGINT) / count(*) AS avg_runtime_seconds,
  count(*) FILTER (state = 'COMPLETED') / count(*) AS success_rate
FROM jobs LEFT JOIN params ON position = greatest(native_id % 12 - 1, 0) GROUP BY parameter""",
    ),
    "tail_lines": _with(
        ["lines"],
        "SELECT native_id, stream, CAST(from_end AS INT) AS from_end, line, n > 3 AS truncated FROM ranked WHERE from_end <= 3",
    ),
    "tail_output": _with(
        ["lines"],
        """SELECT native_id, stream, string_agg(line, chr(10) ORDER BY from_end DESC) AS tail, count(*) AS lines_shown,
  bool_or(n > 5) AS truncated FROM ranked WHERE from_end <= 5 GROUP BY native_id, stream""",
    ),
    "tail_text": """SELECT conv_id, turn, array_to_string(parts[greatest(len(parts) - 1, 1):], chr(10)) AS tail,
  len(parts) > 2 AS truncated FROM (SELECT *, string_split(text, chr(10)) AS parts FROM conversations)""",
    "job_results": _with(
        _JOBS + ["lines"],
        f"""SELECT job_id, state, exit_code, coalesce(o.tail, '') AS stdout, coalesce(e.tail, '') AS stderr
FROM jobs LEFT JOIN (SELECT native_id, string_agg(line, chr(10) ORDER BY from_end DESC) AS tail FROM ranked
  WHERE from_end <= 2 AND stream = 'stdout' GROUP BY native_id) o ON o.native_id = jobs.native_id
LEFT JOIN (SELECT native_id, string_agg(line, chr(10) ORDER BY from_end DESC) AS tail FROM ranked
  WHERE from_end <= 2 AND stream = 'stderr' GROUP BY native_id) e ON e.native_id = jobs.native_id
WHERE state IN {_TERMINAL}""",
    ),
    "jobs_with_output": _with(
        _JOBS, "SELECT job_id, state FROM jobs WHERE native_id IN (SELECT conv_id FROM conversations)"
    ),
    "jobs_without_output": _with(
        _JOBS,
        """SELECT job_id, path || '.out' AS stdout_path, path || '.err' AS stderr_path FROM jobs
WHERE native_id NOT IN (SELECT conv_id FROM conversations)""",
    ),
    "cancel_merge": _with(
        _JOBS,
        f"""SELECT native_id, job_id, CASE WHEN hit AND state IN ('PENDING', 'RUNNING') THEN 'CANCELLED' ELSE state END AS state,
  CASE WHEN hit AND state IN {_TERMINAL} THEN 'job is already ' || state END AS cancel_error
FROM (SELECT *, native_id IN (SELECT event_id // 2 * 3 FROM events WHERE event_type IN ('signup', 'error')) AS hit FROM jobs)""",
    ),
    "latest_status": _with(
        ["status"], f"SELECT job_id, {_NEWEST} AS state, max(ts) AS ts FROM status GROUP BY job_id"
    ),
    "first_terminal": _FIRST_TERMINAL,
    "stream_terminal": _FIRST_TERMINAL,
    "status_timeouts": _TIMEOUTS,
    "stream_timeout": _TIMEOUTS,
    "minicluster_ready": _READY,
    "stream_minicluster_ready": _READY,
    "stream_queue_status": _with(
        ["status"],
        f"""SELECT cluster, {_COUNTS}{_MORE} FROM (SELECT substr(user_id::VARCHAR, 1, 1) AS cluster,
  {_NEWEST} AS state FROM status GROUP BY job_id, user_id) GROUP BY cluster""",
    ),
    "range_rejects": _prep(
        """SELECT reading_id, sensor_id, value, CASE WHEN value < 0.05 THEN 'below range' ELSE 'above range' END AS reject
FROM readings WHERE value < 0.05 OR value > 200"""
    ),
    "impute": _prep(
        """SELECT reading_id, sensor_id, round(coalesce(value, mean), 8) AS value, value IS NULL AS imputed
FROM uniq JOIN stats USING (sensor_id)"""
    ),
    "outliers": _prep(
        """SELECT reading_id, sensor_id, coalesce(abs(value - mean) > 3 * std, false) AS outlier
FROM uniq JOIN stats USING (sensor_id)"""
    ),
    "dedup": _prep("SELECT reading_id, sensor_id, value FROM uniq"),
    "source_union": "WITH "
    + _CTES["readings"]
    + ",\n"
    + _CTES["lines"]
    + """ SELECT 'sensors' AS source, count(*) AS records, count(value) AS with_value, 0::BIGINT AS with_line FROM readings
UNION ALL SELECT 'logs', count(*), 0, count(*) FROM lines""",
    "temporal_features": _prep(
        """SELECT reading_id, CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
  isodow(ts) >= 6 AS is_weekend FROM uniq"""
    ),
    "rolling_stats": _prep(
        """SELECT reading_id, round(avg(value) OVER w, 6) AS rolling_avg, round(stddev_samp(value) OVER w, 6) AS rolling_std
FROM uniq WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
    ),
    "percentile_rank": _prep(
        """SELECT reading_id, sensor_id,
  round(percent_rank() OVER (PARTITION BY sensor_id ORDER BY value), 6) AS percentile_rank
FROM uniq WHERE value IS NOT NULL"""
    ),
    "log_transform": _prep("SELECT reading_id, round(ln(1 + value), 6) AS log_value FROM uniq"),
    "scaling": _prep(
        """SELECT reading_id, sensor_id, round(CASE WHEN high > low THEN (value - low) / (high - low)
  WHEN value IS NOT NULL THEN 0 END, 6) AS scaled FROM uniq JOIN stats USING (sensor_id)"""
    ),
    "one_hot": _prep(
        "SELECT reading_id, "
        + ", ".join(f"CAST(kind = '{k}' AS INT) AS kind_{k}" for k in v.EVENT_TYPES)
        + " FROM uniq"
    ),
    "clean_readings": "WITH "
    + _CTES["readings"]
    + ", kept AS (SELECT * FROM uniq WHERE value IS NULL OR value BETWEEN 0.05 AND 200),\n"
    + _STATS.format(source="kept")
    + """ SELECT reading_id, sensor_id, round(coalesce(value, mean), 8) AS value, value IS NULL AS imputed,
  coalesce(abs(coalesce(value, mean) - mean) > 3 * std, false) AS outlier,
  round(CASE WHEN high > low THEN (coalesce(value, mean) - low) / (high - low)
        WHEN coalesce(value, mean) IS NOT NULL THEN 0 END, 6) AS scaled
FROM kept JOIN stats USING (sensor_id)""",
    "split_counts": _prep(
        """SELECT CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split, count(*) AS records
FROM (SELECT CAST('0x' || substr(md5(reading_id::VARCHAR), 1, 8) AS BIGINT) % 100 AS b FROM uniq) GROUP BY split"""
    ),
    "quality_report": _CLEANED
    + """ SELECT metric, value FROM counters UNPIVOT (value FOR metric IN (input_records, output_records, rejected_records,
  missing_values_imputed, outliers_detected, duplicates_removed))""",
    "run_metadata": _CLEANED
    + """, cut AS (SELECT CAST('0x' || substr(md5(reading_id::VARCHAR), 1, 8) AS BIGINT) % 100 AS b FROM kept)
SELECT 'run' AS pipeline_id, input_records, output_records,
  (SELECT count(*) FROM cut WHERE b < 70) AS train, (SELECT count(*) FROM cut WHERE b BETWEEN 70 AND 84) AS validation,
  (SELECT count(*) FROM cut WHERE b >= 85) AS test, 13 AS features, rejected_records, missing_values_imputed,
  outliers_detected, duplicates_removed FROM counters""",
    "feature_table": _CLEANED
    + """, filled AS (SELECT reading_id, sensor_id, ts, kind, coalesce(value, mean) AS value, low, high
  FROM kept JOIN stats USING (sensor_id))
SELECT reading_id, CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
  isodow(ts) >= 6 AS is_weekend, round(avg(value) OVER w, 6) AS rolling_avg,
  round(stddev_samp(value) OVER w, 6) AS rolling_std,
  round(percent_rank() OVER (PARTITION BY sensor_id ORDER BY value), 6) AS percentile_rank,
  round(ln(1 + value), 6) AS log_value,
  round(CASE WHEN high > low THEN (value - low) / (high - low) ELSE 0 END, 6) AS scaled, """
    + ", ".join(f"CAST(kind = '{k}' AS INT) AS kind_{k}" for k in v.EVENT_TYPES)
    + """ FROM filled WHERE value IS NOT NULL
WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, reading_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
}

# Round trips through files give what the tables themselves give.
ORACLE |= {
    name: ORACLE[same]
    for name, same in {
        "slurm_files": "slurm_normalized",
        "slurm_answers": "slurm_normalized",
        "slurm_ranges": "slurm_normalized",
        "flux_roundtrip": "flux_normalized",
        "flux_short_files": "flux_short_listing",
        "clusters_file": "cluster_types",
        "nodes_file": "node_summary",
        "partitions_file": "partition_names",
        "miniclusters_file": "minicluster_checks",
        "split_export": "split_counts",
        "sweep_export": "param_sweep",
    }.items()
}
ORACLE |= {
    "accounting_store": _with(
        _JOBS,
        """SELECT range_id, cluster, count(*) AS jobs, CAST(sum(runtime_seconds) AS BIGINT) AS runtime_seconds
FROM jobs JOIN (VALUES (1::INT, epoch('1995-01-01'::TIMESTAMP), epoch('1995-03-31 12:00:00'::TIMESTAMP)),
  (2, epoch('1995-03-01'::TIMESTAMP), epoch('1996-01-15'::TIMESTAMP))) AS r(range_id, low, high)
  ON submit_epoch BETWEEN low AND high GROUP BY range_id, cluster""",
    ),
    "output_files": _with(
        ["lines"],
        """SELECT native_id, stream, line,
  row_number() OVER (PARTITION BY native_id, stream ORDER BY turn, line_no, line) - 1 AS line_no FROM lines""",
    ),
    "output_file_tails": ORACLE["tail_lines"],
    "stream_ready_timeout": _with(
        ["ready"],
        """SELECT namespace, name, CASE WHEN NOT ok THEN 'Unknown' WHEN kind = 'purchase' THEN 'Running' END AS phase,
  CASE WHEN NOT ok THEN 'Timeout' END AS reason, CASE WHEN ok THEN ready END AS ts,
  CASE WHEN ok THEN ready ELSE limit_ts END AS decided
FROM (SELECT *, coalesce(ready <= limit_ts, false) AS ok FROM (
  SELECT namespace, name, min(ts) + 21600000000 AS limit_ts, min(ts) FILTER (ok) AS ready,
    first(event_type ORDER BY ts) FILTER (ok) AS kind FROM ready GROUP BY namespace, name))""",
    ),
    "commands_file": """SELECT CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1 AS INT) AS task_index,
  p_name AS command FROM part""",
    "scripts_files": _with(
        _CLASSES,
        """SELECT cpu_intensive, memory_intensive, io_intensive, mpi_ranks, count(*) AS scripts FROM classes GROUP BY ALL""",
    ),
    "sensor_csv": """SELECT 's-' || user_id % 50 AS sensor_id, count(*) AS records,
  count(*) FILTER (event_id % 3 <> 0) AS with_humidity,
  CAST(sum(event_id % 100) FILTER (event_id % 3 <> 0) AS DOUBLE) AS humidity, max(value) AS highest,
  epoch_us(max(ts)) AS latest FROM events GROUP BY user_id % 50""",
    "user_events_csv": """SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events
GROUP BY event_type""",
    "script_advice": _with(
        _JOBS + ["requests", "classes", "history"],
        f"""SELECT a.request_id, parameter,
  CASE WHEN parameter = 'time_limit' AND similar_jobs > 0 THEN {_clock('m * 60')}
       WHEN parameter = 'memory' AND mib IS NOT NULL THEN mib || 'MB' ELSE value END AS value,
  CASE WHEN parameter = 'time_limit' AND similar_jobs > 0 OR parameter = 'memory' AND mib IS NOT NULL
       THEN 'medium' ELSE confidence END AS confidence,
  CASE WHEN parameter = 'time_limit' AND similar_jobs > 0 OR parameter = 'memory' AND mib IS NOT NULL
       THEN 'Average of ' || similar_jobs || ' similar finished jobs plus a quarter' ELSE reason END AS reason
FROM ({_ADVICE}) a JOIN requests r ON r.request_id = a.request_id
LEFT JOIN (SELECT *, CAST(ceil(avg_runtime_seconds * 1.25::DOUBLE / 60) AS BIGINT) AS m,
             CAST(ceil(avg_memory_mib * 1.25::DOUBLE) AS BIGINT) AS mib FROM history) h
  ON h.cluster = r.cluster AND h.name = r.job_name""",
    ),
}
