import random
import re

from jobfacts import fixed_values as fv
from jobfacts.functions import scripts as text
from jobfacts.operators import filters, scripts, validate


def classify(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, script string")
    return {r.request_id: r for r in scripts.estimate(scripts.classify(df)).collect()}


def test_workload_examples(spark):
    got = classify(spark, [
        "#!/bin/bash\nmpirun -n 16 ./my_mpi_program",
        "#!/bin/bash\n# Process 64GB dataset\npython process_large_array.py",
        "#!/bin/bash\ndd if=/dev/zero of=/tmp/test",
        "#!/bin/bash\necho hello\n./simple_program",
        "#!/bin/bash\nmpirun -n 0 ./x",
        "#!/bin/bash\nmpirun -n 2 ./x",
    ])
    assert (got[0].workload, got[0].recommended_tasks, got[0].recommended_nodes) == ("cpu", 16, 4)
    assert got[1].memory_intensive and got[1].estimated_memory == "32GB"
    assert got[2].io_intensive and not got[2].cpu_intensive
    assert (got[3].workload, got[3].recommended_nodes, got[3].recommended_tasks) == ("generic", 1, 1)
    assert (got[4].recommended_nodes, got[4].recommended_tasks) == (2, 8)
    assert (got[5].recommended_nodes, got[5].recommended_tasks) == (1, 2)


def test_classes_equal_the_patterns(spark):
    """Brute force: words and gated phrases give what the whole patterns give."""
    rng = random.Random(7)
    pieces = (
        "mpirun mpiexec srun openmp omp_num_threads numpy fft matrix linear algebra linear_algebra for x in "
        "y forx in malloc new foo[ a new bar[ 64gb 64gbx x64gb array tensor sort hash cache read fread dd "
        "rsync cp mv sql query parallel hdf io mpi io_x mpiio parallelio x/dev/null a/mnt/b /data/ z/data/q "
        "éread für readé naïve - _ ( ) \n \t . , ; 9 gb in for"
    ).split(" ")
    bodies = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(0, 9)))
              for _ in range(1500)]
    got = classify(spark, bodies)
    for i, body in enumerate(bodies):
        for name, patterns in (("cpu", fv.CPU_PATTERNS), ("memory", fv.MEMORY_PATTERNS), ("io", fv.IO_PATTERNS)):
            expected = any(re.search(p, body.lower()) for p in patterns)
            assert got[i][f"{name}_intensive"] == expected, (name, body)


def test_shebang_and_comments(values):
    texts = ["#!/bin/sh\nls", "\n\t #!/bin/sh", "echo", "", "# a\n\n  # b", "# a\n  ls", "  \n\t"]
    assert values(text.has_shebang, texts) == [True, True, False, False, False, False, False]
    assert values(text.only_comments, texts) == [False, True, False, True, True, False, True]


def test_recommendations(spark):
    df = spark.createDataFrame(
        [(1, "#!/bin/bash\nmpirun -n 8 x\nrsync a b"), (2, "#!/bin/bash\nls")], "request_id int, script string"
    )
    rows = scripts.recommendation_rows(scripts.recommend(scripts.estimate(scripts.classify(df)))).collect()
    by = {(r.request_id, r.parameter): r for r in rows}
    assert by[1, "nodes"].value == "2" and by[1, "nodes"].confidence == "high"
    assert by[1, "partition"].value == "io-optimized"
    assert (2, "partition") not in by and len(rows) == 9
    assert {r.confidence for r in rows} <= {"high", "medium", "low"}


def requests(spark, rows):
    schema = "request_id int, cluster string, script string, nodes int, time_limit string, partition string, memory string"
    return spark.createDataFrame(rows, schema)


def issues_of(spark, rows, nodes=8, idle=4):
    clusters = spark.createDataFrame([("s", "slurm"), ("f", "flux")], "name string, type string")
    node_rows = [
        (c, f"n{i}", "IDLE" if i < idle else "ALLOCATED", 4, "16GB", ["default"]) for c in "sf" for i in range(nodes)
    ]
    node_df = spark.createDataFrame(
        node_rows, "cluster string, name string, state string, cpus int, memory string, partitions array<string>"
    )
    parts = spark.createDataFrame(
        [("s", "default", "UP", 8, "24:00:00", "4GB"), ("s", "old", "DOWN", 1, "01:00:00", "2GB")],
        "cluster string, name string, state string, nodes int, max_time_limit string, default_memory_per_cpu string",
    )
    checked = validate.validate(requests(spark, rows), clusters, node_df, parts).cache()
    found = {}
    for r in validate.issue_rows(checked).orderBy("request_id", "position").collect():
        found.setdefault(r.request_id, []).append((r.severity, r.category, r.message, r.line))
    advice = {r.request_id: r for r in validate.recommendation_rows(checked).collect()}
    valid = {r.request_id: r.valid for r in checked.collect()}
    return found, advice, valid


def test_every_request_has_an_answer(spark):
    found, _, valid = issues_of(spark, [
        (1, "s", OK, 1, "1h", "default", "4GB"),
        (2, "gone", OK, 1, None, None, None),
        (3, "s", OK, 1, None, None, "9999999999GB"),
        (4, "s", OK, 1, "9999999999999m", "default", None),
        (5, None, OK, 1, None, None, None),
    ])
    assert valid == {1: True, 2: False, 3: False, 4: False, 5: False} and 1 not in found
    assert found[2] == [("error", "resources", "Unknown cluster: gone", None)]
    assert found[3][0][:2] == ("error", "resources") and found[4][0][:2] == ("error", "limits")


OK = "#!/bin/bash\nls\n"


def test_validation_rules(spark):
    found, advice, valid = issues_of(spark, [
        (1, "s", OK, 2, "1h", "default", "4GB"),
        (2, "s", "ls", None, None, None, None),
        (3, "s", OK, 0, None, None, None),
        (4, "s", OK, 1000, None, None, None),
        (5, "s", OK, 6, None, None, None),
        (6, "s", OK, None, "invalid", None, None),
        (7, "s", OK, None, " ", None, None),
        (8, "s", OK, None, None, "nope", None),
        (9, "s", OK, None, None, " old ", None),
        (10, "f", OK, None, "999:00:00", "nope", None),
        (11, "s", "#!/bin/bash\n# only\n\n", None, None, None, None),
        (12, "s", OK + "Module Load gcc", None, None, None, None),
        (13, "s", OK, None, "999:00:00", "default", None),
        (14, "s", OK, None, None, None, "9999GB"),
    ])
    assert 1 not in found and valid[1]
    assert found[2] == [("error", "syntax", fv.NO_SHEBANG, 1)] and not valid[2]
    assert found[3] == [("error", "resources", "Node count must be >= 1, got 0", None)]
    assert found[4][0][2] == "Requested 1000 nodes, but cluster only has 8 total nodes"
    assert (advice[4].field, advice[4].current, advice[4].suggested, advice[4].reason) == (
        "nodes", "1000", "8", "Cluster maximum")
    assert found[5][0][0] == "warning" and valid[5]
    assert found[6][0][1] == "syntax" and "invalid" in found[6][0][2]
    assert found[7] == [("error", "syntax", fv.TIME_LIMIT_EMPTY, None)]
    assert found[8][0][2] == "Partition 'nope' does not exist. Available partitions: default, old"
    assert found[9][0][:2] == ("warning", "resources") and valid[9]
    assert 10 not in found
    assert found[11][0][0] == "warning" and found[11][0][1] == "syntax"
    assert found[12][0][0] == "info" and valid[12]
    assert found[13][0][1] == "limits"
    assert not valid[14] and len(advice) == 1


def test_no_warning_without_idle_nodes(spark):
    found, _, _ = issues_of(spark, [(1, "s", OK, 6, None, None, None)], idle=0)
    assert found == {}


def test_request_checks(spark):
    schema = ("request_id int, script string, nodes int, tasks_per_node int, cpus_per_task int, "
              "memory string, time_limit string")
    good = ["32GB", "1024MB", "2TB", "512M", "4G", "1T", "8 gb", None]
    limits = ["1h", "30m", "60s", "1:30", "2:30:00", "1.5h", " 5M ", None]
    rows = [(i, OK, 1, 1, 1, m, t) for i, (m, t) in enumerate(zip(good, limits))]
    rows += [(100, OK, 0, None, None, "invalid", "x"), (101, " \n ", 1, None, None, " ", ""),
             (102, "#!" + "x" * 20000, None, 0, 0, None, None)]
    got = {r.request_id: r for r in filters.check_requests(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[i].success for i in range(len(good)))
    assert got[100].reasons == ["nodes below 1", "memory format", "time limit format"]
    assert got[101].reasons == ["empty script", "empty memory", "empty time limit"]
    assert got[102].reasons == ["script too long", "tasks per node below 1", "cpus per task below 1"]
    assert "script" not in got[100].asDict()
