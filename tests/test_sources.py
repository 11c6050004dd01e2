import json

import pytest
from pyspark.sql import functions as F

from jobfacts import schemas
from jobfacts.operators import batch, filters, normalize, output, queue
from jobfacts.plans import views
from jobfacts.sources import readers, sinks

def as_of():
    return F.timestamp_seconds(F.lit(views.AS_OF))


ENVELOPE = {
    "jobs": [
        {"job_id": "1", "name": "a", "user_name": "u", "job_state": ["RUNNING", "X"], "partition": "p",
         "exit_code": {"status": ["PENDING"], "return_code": "PENDING"},
         "submit_time": {"set": True, "number": 1705234567}, "start_time": {"set": True, "number": 978307100},
         "end_time": {"set": False, "number": 0}, "time_limit": {"set": True, "number": 60, "infinite": False},
         "node_count": {"set": True, "number": 2}, "nodes": "n1,n2", "tasks": 4, "cpus_per_task": 1},
        {"job_id": 2, "name": "b", "job_state": "NODE_FAIL", "exit_code": {"return_code": {"set": True, "number": 7}},
         "submit_time": {"set": True, "number": 0}, "start_time": {"set": True, "number": 10},
         "end_time": {"set": True, "number": 5}, "nodes": ""},
        {"name": "no id", "job_state": "RUNNING"},
    ]
}


def test_slurm_envelope_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ENVELOPE, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"jobs": []}))
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "x.json").write_text("\n".join(json.dumps(j) for j in ENVELOPE["jobs"]))
    found = []
    for df in (readers.read_slurm_jobs(spark, str(tmp_path / "*.json")),
               readers.read_slurm_jobs(spark, str(lines), layout="lines")):
        rows = {r.job_id: r for r in normalize.normalize_slurm(df, as_of()).collect()}
        assert set(rows) == {"1", "2"}
        a, b = rows["1"], rows["2"]
        assert (a.state, a.exit_code, a.runtime_seconds, a.time_limit_seconds) == ("RUNNING", None, 100, 3600)
        assert a.allocated_nodes == ["n1", "n2"] and a.resources.nodes == 2 and a.ended is None
        assert (b.state, b.exit_code, b.runtime_seconds, b.submitted) == ("FAILED", 7, 0, None)
        assert b.allocated_nodes == [] and b.resources.memory == ""
        found.append(rows)
    assert found[0] == found[1]
    with pytest.raises(ValueError):
        readers.read_slurm_jobs(spark, "x", layout="other")


def test_flux_long_and_short(spark, tmp_path):
    long = tmp_path / "long.txt"
    long.write_text(
        "ƒA,,INACTIVE,1705234567.9,1705234570.1,1705234600.2,FAILED,2,8,1.5h,30s\n\n"
        "ƒB,x,RUN,1705234567,1705234570,-,-,?,1,-,-\n"
        "ƒC,x,y,RUN,1705234567,1705234570,-,-,1,1,-,-\n"
        "ƒD,x,RUN,soon,-,-,-,1,1,-,-\n"
        "ƒE,x,RUN,-,-,-,-,1,1,1.2.3s,-\n"
        "ƒF,x,RUN,1\n"
        ",x,RUN,-,-,-,-,1,1,-,-\n"
    )
    split = readers.read_flux_jobs(spark, str(long))
    rows = {r.job_id: r for r in normalize.normalize_flux(split).collect()}
    assert set(rows) == {"ƒA", "ƒB"}
    a, b = rows["ƒA"], rows["ƒB"]
    assert (a.name, a.state, a.exit_code, a.runtime_seconds, a.time_limit_seconds) == ("unnamed", "FAILED", 1, 30, 5400)
    assert (a.user, a.partition, a.resources.memory, a.resources.tasks) == ("flux", "default", "N/A", 8)
    assert a.submitted.timestamp() == 1705234567
    assert (b.state, b.exit_code, b.ended, b.resources.nodes) == ("RUNNING", None, None, 0)
    rejects = {r.line.split(",")[0]: r.reject for r in normalize.flux_rejects(split).collect()}
    assert rejects == {"ƒC": "too many fields", "ƒD": "unparsable number", "ƒE": "unparsable number",
                       "ƒF": "too few fields", "": "no job id"}
    short = tmp_path / "short.txt"
    short.write_text("ƒA,n,DEPEND,1705234567,90m\nƒB,n,INACTIVE,-,-\nƒC,n,RUN\n")
    listed = normalize.normalize_flux(readers.read_flux_jobs(spark, str(short), fields=5))
    got = {r.job_id: (r.state, r.runtime_seconds) for r in listed.collect()}
    assert got == {"ƒA": ("PENDING", 5400), "ƒB": ("COMPLETED", 0)}
    both = normalize.union_jobs(normalize.normalize_flux(split), listed)
    assert both.count() == 4 and both.filter("user is null").count() == 2
    with pytest.raises(ValueError):
        readers.read_flux_jobs(spark, "x", fields=7)


def test_round_trips_through_files(spark, sf, tmp_path):
    dump = views.slurm_dump(spark, sf)
    dump.write.json(str(tmp_path / "slurm"))
    back = readers.read_slurm_jobs(spark, str(tmp_path / "slurm"), layout="lines")
    a, b = (normalize.normalize_slurm(d, as_of()) for d in (dump, back))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() > 0
    lines = views.flux_lines(spark, sf)
    lines.write.text(str(tmp_path / "flux"))
    split = readers.read_flux_jobs(spark, str(tmp_path / "flux"))
    a, b = normalize.normalize_flux(views.flux_split(spark, sf)), normalize.normalize_flux(split)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() > 0


def test_tables(spark, sf, tmp_path):
    nodes = views.nodes(spark, sf)
    for fmt in ("json", "parquet"):
        nodes.write.format(fmt).save(str(tmp_path / fmt))
        assert readers.read_nodes(spark, str(tmp_path / fmt), fmt).exceptAll(nodes).count() == 0
    parts = views.partitions(spark, sf)
    parts.write.parquet(str(tmp_path / "parts"))
    assert readers.read_partitions(spark, str(tmp_path / "parts")).exceptAll(parts).count() == 0
    with pytest.raises(ValueError):
        readers.read_nodes(spark, "x", "csv")


def test_clusters(spark, tmp_path):
    entries = [
        {"name": "slurm-local", "type": "slurm", "auth": {"jwt_token": "t", "user": "u"}},
        {"name": "flux-local"}, {"type": "slurm"},
    ]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(e) for e in entries))
    clusters = readers.read_clusters(spark, str(tmp_path / "c.json"))
    types = {r.name: r.type for r in normalize.cluster_types(clusters).collect()}
    assert types == {"slurm-local": "slurm", "flux-local": "unknown"}
    auth = normalize.redacted_clusters(clusters).filter("auth is not null").first().auth
    assert auth == {"jwt_token": "***", "user": "u"}
    asked = spark.createDataFrame([("slurm-local",), ("x",)], "cluster string")
    assert [r.cluster for r in filters.unknown_clusters(asked, clusters).collect()] == ["x"]
    backends = {r.cluster: r.backend for r in queue.with_backend(asked, clusters).collect()}
    assert backends == {"slurm-local": "slurm", "x": "unknown"}


def test_miniclusters(spark, tmp_path):
    item = {
        "metadata": {"name": "m", "namespace": "ns"},
        "spec": {"size": 2, "maxSize": 1, "containers": [{"image": "a/../b", "environment": {"A": "1"}}]},
        "status": {"phase": "Running", "size": 2, "conditions": [{"type": "Running", "status": "True"}]},
    }
    (tmp_path / "m.json").write_text(json.dumps({"items": [item]}))
    df = readers.read_miniclusters(spark, str(tmp_path / "m.json"))
    r = df.first()
    assert (r.namespace, r.name, r.spec.size, r.status.conditions[0].type) == ("ns", "m", 2, "Running")
    checked = filters.check_miniclusters(df).first()
    assert checked.reasons == ["max size below size", "image"] and not checked.valid


def test_output_files(spark, tmp_path):
    (tmp_path / "12.out").write_text("a\nb\nc\n")
    (tmp_path / "12.err").write_text("")
    (tmp_path / "ƒX.out").write_text("only")
    lines = readers.read_job_output(spark, str(tmp_path))
    tails = output.tail_output(lines, 2, ["job_id", "stream"], ["block", "line_no"])
    got = {(r.job_id, r.stream): (r.tail, r.truncated) for r in tails.collect()}
    assert got == {("12", "stdout"): ("c\n", True), ("ƒX", "stdout"): ("only", False)}
    jobs = spark.createDataFrame([("12",), ("13",)], "job_id string")
    results = {r.job_id: (r.stdout, r.stderr) for r in output.with_output(jobs, tails).collect()}
    assert results == {"12": ("c\n", ""), "13": ("", "")}
    assert output.jobs_without_output(jobs, lines).first().job_id == "13"


def test_output_lines_of_a_split_file(spark, tmp_path):
    """A file cut into many blocks keeps its line order."""
    lines = [f"line {i}" for i in range(5000)]
    (tmp_path / "1.out").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.read_job_output(spark, str(tmp_path), layout="lines")
        tails = output.tail_output(df, 700, ["job_id", "stream"], ["block", "line_no"])
        assert df.select("block").distinct().count() > 5
        assert tails.first().tail.split("\n") == lines[-700:]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        readers.read_job_output(spark, "x", layout="other")


def test_commands_and_scripts(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# comment\n\necho 1\n   \npython x.py\n")
    df = readers.read_commands(spark, str(tmp_path / "c.txt"))
    assert [r.command for r in batch.expand_commands(df).orderBy("task_index").collect()] == ["echo 1", "python x.py"]
    assert batch.batch_summary(df).first().submitted == 2
    (tmp_path / "s.sh").write_text("#!/bin/sh\nls\n")
    r = readers.read_scripts(spark, str(tmp_path / "s.sh")).first()
    assert r.path.endswith("s.sh") and r.script == "#!/bin/sh\nls\n"


def test_sensor_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,sensor_id,temperature,humidity\n2025-01-15T10:05:00,sensor_1,21,40\n")
    (tmp_path / "e.csv").write_text("event_id,user_id,event_type,timestamp\nevt_1,user_2,click,2025-01-15T10:05:00\n")
    s = readers.read_sensors(spark, str(tmp_path / "s.csv")).first()
    assert (s.sensor_id, s.temperature, s.timestamp.minute) == ("sensor_1", 21.0, 5)
    e = readers.read_user_events(spark, str(tmp_path / "e.csv")).first()
    assert (e.event_id, e.event_type, e.timestamp.hour) == ("evt_1", "click", 10)


def test_accounting_export_and_sweep_records(spark, tmp_path):
    rows = spark.createDataFrame([("1", 5), ("2", 7)], "job_id string, runtime bigint")
    sinks.write_sweep_results(rows, str(tmp_path / "p"))
    sinks.write_sweep_results(rows, str(tmp_path / "j"), format="json")
    back = readers.read_accounting_export(spark, str(tmp_path / "p"), "job_id string, runtime bigint")
    assert back.exceptAll(rows).count() == 0 and spark.read.json(str(tmp_path / "j")).count() == 2
    assert schemas.JOB_COLUMNS == normalize.normalize_slurm(
        normalize.parse_slurm_lines(spark.createDataFrame([("{}",)], "value string")), as_of()).columns


def test_wrapped_numbers_are_parsed_once(spark, sf, plan):
    """A filter or column that uses a number does not parse it again."""
    lines = views.slurm_dump(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    df = normalize.normalize_slurm(normalize.parse_slurm_lines(lines), as_of()).filter("runtime_seconds > 5")
    text = df._jdf.queryExecution().optimizedPlan().toString()
    wrapped = len(schemas.WRAPPED_TIMES + schemas.WRAPPED_LIMITS)
    assert 0 < text.count("from_json") <= wrapped + 1  # and the line itself
    assert not any("from_json" in line for line in text.splitlines() if line.strip(" +-:").startswith("Filter"))


def test_jobs_of_an_answer_are_parsed_one_by_one(spark, tmp_path):
    job = '{"job_id":"%d","submit_time":{"set":true,"number":%d},"job_state":["RUNNING"],"exit_code":{"return_code":0}}'
    (tmp_path / "a.json").write_text('{"meta":{"x":[1]},"jobs":[' + ",\n".join(job % (k, k) for k in range(2000)) + "]}")
    (tmp_path / "c.json").write_text('{"jobs":[{"job_id":"x","tasks":"no number","name":"ü \\"q\\" }"},null,{}],"errors":[]}')
    (tmp_path / "d.json").write_text('{"jobs":[]}')
    (tmp_path / "e.json").write_text('{"other":1}')
    sums = readers.read_slurm_jobs(spark, str(tmp_path / "a.json")).selectExpr("count(*)", "sum(submit_time.number)", "min(job_state)")
    assert tuple(sums.first()) == (2000, 2000 * 1999 // 2, '["RUNNING"]')
    answers = readers.read_slurm_jobs(spark, str(tmp_path / "[cde].json"))
    odd = answers.select("job_id", "name", "tasks").collect()
    assert sorted(map(str, map(tuple, odd))) == sorted(map(str, [("x", 'ü "q" }', None), (None, None, None), (None, None, None)]))
    assert "Scan json" not in answers._jdf.queryExecution().executedPlan().toString()  # which takes many times as long for texts of objects
