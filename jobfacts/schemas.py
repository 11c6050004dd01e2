"""Explicit schemas. Readers never infer types."""

RESOURCES = "struct<nodes:int,tasks:int,cpus_per_task:int,memory:string>"

WRAPPED_TIMES = ["submit_time", "start_time", "end_time"]
WRAPPED_LIMITS = ["time_limit", "node_count"]

# One Slurm job. job_state and exit_code occur in more than one JSON shape, so
# they are read as the JSON text and resolved by the normalisation.
_NUMBER = "struct<set:boolean,number:bigint>"
_LIMIT = "struct<set:boolean,number:bigint,infinite:boolean>"
SLURM_JOB = f"""
    job_id string, name string, user_id bigint, user_name string, account string,
    partition string, job_state string, exit_code string,
    submit_time {_NUMBER}, start_time {_NUMBER}, end_time {_NUMBER},
    time_limit {_LIMIT}, node_count {_LIMIT},
    nodes string, tasks int, cpus int, cpus_per_task int,
    memory_per_node string, memory_per_tres string,
    current_working_directory string, standard_output string, standard_error string,
    stdout_expanded string, stderr_expanded string
"""
FLUX_LONG_FIELDS = [
    "id", "name", "state", "t_submit", "t_run", "t_inactive", "result",
    "nnodes", "ntasks", "duration", "runtime",
]
FLUX_SHORT_FIELDS = ["id", "name", "state", "t_submit", "runtime"]

# The unified job record.
JOB_COLUMNS = [
    "job_id", "name", "state", "submitted", "runtime_seconds", "exit_code", "user",
    "partition", "started", "ended", "time_limit_seconds", "resources",
    "allocated_nodes", "working_directory", "stdout_path", "stderr_path",
]

NODES = "cluster string, name string, state string, cpus int, memory string, partitions array<string>"
PARTITIONS = (
    "cluster string, name string, state string, nodes int, "
    "max_time_limit string, default_memory_per_cpu string"
)
CLUSTERS = (
    "name string, type string, endpoint string, namespace string, minicluster string, "
    "flux_uri string, auth map<string,string>"
)
CONTAINER = (
    "struct<image:string,name:string,command:string,cores:int,tasks:int,"
    "runFlux:boolean,batch:boolean,environment:map<string,string>>"
)
CONDITIONS = "array<struct<type:string,status:string>>"
MINICLUSTERS = f"""
    metadata struct<name:string,namespace:string>,
    spec struct<size:int,maxSize:int,tasks:int,interactive:boolean,deadline:string,
                containers:array<{CONTAINER}>>,
    status struct<phase:string,size:int,maximumSize:int,desiredSize:int,specSize:int,
                  conditions:{CONDITIONS}>
"""
STATUS = "job_id string, state string, ts timestamp"
SENSORS = "timestamp timestamp_ntz, sensor_id string, temperature double, humidity double"
USER_EVENTS = "event_id string, user_id string, event_type string, timestamp timestamp_ntz"
REQUESTS = """
    request_id bigint, cluster string, script string, job_name string, nodes int,
    tasks_per_node int, cpus_per_task int, memory string, time_limit string,
    partition string, output_path string, error_path string, working_dir string
"""

# The given parquet tables the derived job tables start from.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def slurm_text() -> str:
    """`SLURM_JOB` with every wrapped number as its JSON text, whatever shape it has."""
    out = SLURM_JOB
    for kind in (_NUMBER, _LIMIT):
        out = out.replace(kind, "string")
    return out
