"""Word lists, lookup tables, patterns, limits and message texts.

They are part of the data contract of the job records and checks, so results
are only right if they hold exactly.  Everything that computes lives elsewhere.
"""

# ---------------------------------------------------------------- job states
# Native Slurm state -> unified state.
SLURM_STATES = {
    "PENDING": "PENDING",
    "RUNNING": "RUNNING",
    "COMPLETED": "COMPLETED",
    "FAILED": "FAILED",
    "CANCELLED": "CANCELLED",
    "TIMEOUT": "TIMEOUT",
    "NODE_FAIL": "FAILED",
    "PREEMPTED": "CANCELLED",
    "COMPLETING": "RUNNING",
    "CONFIGURING": "PENDING",
}

# Native Flux state -> unified state.
FLUX_STATES = {
    "DEPEND": "PENDING",
    "SCHED": "PENDING",
    "RUN": "RUNNING",
    "INACTIVE": "COMPLETED",
    "CANCELED": "CANCELLED",
    "TIMEOUT": "TIMEOUT",
}

# Result of an INACTIVE Flux job -> unified state.
FLUX_RESULTS = {
    "COMPLETED": "COMPLETED",
    "FAILED": "FAILED",
    "CANCELED": "CANCELLED",
    "TIMEOUT": "TIMEOUT",
}

# States a list may be filtered by, and states that end a job.
LIST_STATES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]
TERMINAL_STATES = ["COMPLETED", "FAILED", "CANCELLED", "TIMEOUT", "NODE_FAIL", "PREEMPTED"]

# MiniCluster readiness.
READY_PHASES = ["Running", "Succeeded"]
READY_CONDITIONS = ["Running", "Succeeded", "JobMiniClusterReady"]

# ------------------------------------------------------------------- scripts
# Patterns looked for in the lower-cased script text.
CPU_PATTERNS = [
    r"\b(mpirun|mpiexec|srun)\b",
    r"\b(openmp|omp_num_threads)\b",
    r"\bfor\s+\w+\s+in\s+",
    r"\b(numpy|scipy|tensorflow|pytorch)\b",
    r"\b(fft|matrix|linear algebra)\b",
]
MEMORY_PATTERNS = [
    r"\b(malloc|calloc|new\s+\w+\[)\b",
    r"\b(array|matrix|tensor)\b",
    r"\b(sort|merge|hash)\b",
    r"\b(\d+)gb\b",
    r"\b(cache|buffer|heap)\b",
]
IO_PATTERNS = [
    r"\b(read|write|fopen|fread|fwrite)\b",
    r"\b(dd|rsync|cp|mv)\b",
    r"\b(database|sql|query)\b",
    r"\b(/dev/|/mnt/|/data/)\b",
    r"\b(parallel.*io|mpi.*io)\b",
]

# The same patterns taken apart. Words stand alone; a phrase counts
# where its pattern matches, and can only match where all its texts occur.
CPU_WORDS = [
    "mpirun", "mpiexec", "srun", "openmp", "omp_num_threads",
    "numpy", "scipy", "tensorflow", "pytorch", "fft", "matrix",
]
CPU_PHRASES = [
    (r"\bfor\s+\w+\s+in\s+", ["for", "in"]),
    (r"\blinear algebra\b", ["linear algebra"]),
]
MEMORY_WORDS = [
    "malloc", "calloc", "array", "matrix", "tensor", "sort", "merge", "hash",
    "cache", "buffer", "heap",
]
MEMORY_PHRASES = [
    (r"\bnew\s+\w+\[\b", ["new", "["]),
    (r"\b\d+gb\b", ["gb"]),
]
IO_WORDS = [
    "read", "write", "fopen", "fread", "fwrite", "dd", "rsync", "cp", "mv",
    "database", "sql", "query",
]
IO_PHRASES = [
    (r"\b/dev/\b", ["/dev/"]),
    (r"\b/mnt/\b", ["/mnt/"]),
    (r"\b/data/\b", ["/data/"]),
    (r"\bparallel.*io\b", ["parallel", "io"]),
    (r"\bmpi.*io\b", ["mpi", "io"]),
]
MPI_RANKS_PATTERN = r"mpirun\s+-n\s+(\d+)"

# Estimates per workload class (memory, runtime, nodes, tasks).
ESTIMATES = {
    "cpu": ("8GB", "02:00:00", 2, 8),
    "memory": ("32GB", "01:30:00", 1, 4),
    "io": ("16GB", "03:00:00", 1, 4),
    "generic": ("4GB", "01:00:00", 1, 1),
}
RANKS_PER_NODE = 4
IO_PARTITION = "io-optimized"

# Recommendation texts; %s marks are filled in order, and of each pair
# the first applies when the class is found.
NODES_REASON = "Based on %s, %s node(s) recommended"
NODES_BASIS = ("parallel workload detection", "workload analysis")
TASKS_REASON = "Optimal task count for %s workload"
TASKS_BASIS = ("CPU-intensive", "standard")
MEMORY_REASON = "Estimated based on %s"
MEMORY_BASIS = ("memory-intensive patterns", "typical workload requirements")
TIME_REASON = "Estimated runtime with 20% buffer. Monitor first run and adjust."
# Our own text: the reference names no wording for it.
HISTORY_REASON = "Average of %s similar finished jobs plus a quarter"
PARTITION_REASON = (
    "I/O-intensive workload detected. Consider using I/O-optimized partition if available."
)

# Request checks.
MEMORY_FORMAT = r"^\d+\s*(MB|GB|TB|M|G|T)$"
REQUEST_TIME_FORMATS = [r"^\d+(\.\d+)?[hmsHMS]$", r"^\d+:\d+$", r"^\d+:\d+:\d+$"]
SCRIPT_TIME_FORMATS = [r"^\d+[hmsHMS]$", r"^\d+:\d+$", r"^\d+:\d+:\d+$"]
MAX_SCRIPT_CHARS = 20000

# Issue texts; %s marks are filled in order.
NO_SHEBANG = "Script missing shebang line (e.g., #!/bin/bash)"
NODES_TOO_FEW = "Node count must be >= 1, got %s"
NODES_OVER_TOTAL = "Requested %s nodes, but cluster only has %s total nodes"
NODES_OVER_IDLE = (
    "Requested %s nodes, but only %s nodes currently idle (cluster has %s total)"
)
TIME_LIMIT_EMPTY = "Time limit parameter cannot be empty string"
TIME_LIMIT_FORMAT = (
    "Invalid time limit format: %s. Expected formats: 1h, 30m, 60s, 1:30, or 1:30:00"
)
TIME_LIMIT_OVER_MAX = "Time limit %s exceeds the maximum %s of partition '%s'"
PARTITION_MISSING = "Partition '%s' does not exist. Available partitions: %s"
PARTITION_NOT_UP = "Partition '%s' is not UP (current state: %s)"
MEMORY_NOT_FEASIBLE = "Requested memory %s exceeds the largest node of the cluster"
ONLY_COMMENTS = "Script contains no executable commands (only comments or whitespace)"
MODULE_LOAD = "Script uses 'module load' - ensure modules are available on target cluster"
CLUSTER_MAXIMUM = "Cluster maximum"

# ------------------------------------------------------------------ defaults
# What stands in for a missing field.
UNNAMED_JOB = "unnamed"
DEFAULT_PARTITION = "default"
FLUX_USER = "flux"
FLUX_MEMORY = "N/A"
FLUX_WORKDIR = "/tmp"
FLUX_ID_PREFIX = "ƒ"
MISSING_FLUX_FIELD = "-"
REDACTED = "***"
SECRET_KEYS = ["jwt_token", "jwt_secret"]

# Page sizes and windows.
DEFAULT_LIMIT = 100
MAX_ACCOUNTING_LIMIT = 1000
RECENT_JOBS = 20
CPU_TIME_SHARE = 0.8
HISTORY_BUFFER = 1.25
WAIT_TIMEOUT_MINUTES = 60

# ------------------------------------------------------------------- batches
# Parameters of the sweep, by position.
SWEEP_PARAMETERS = [
    "0.001", "0.005", "0.01", "0.05", "0.1", "0.5", "1.0", "5.0", "10.0", "50.0",
]

# Shares of the data-preparation split, in percent.
SPLIT_SHARES = [("train", 70), ("validation", 15), ("test", 15)]
