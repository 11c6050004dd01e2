import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from jobfacts import schemas
from jobfacts.operators import accounting, batch, filters, history, lists, normalize, output, queue, resources, status
from jobfacts.plans import views
from jobfacts.sources import sinks


@pytest.fixture(scope="module")
def jobs(spark, sf):
    return views.jobs(spark, sf).cache()


def test_argument_checks():
    assert filters.clean_state(" failed ") == "FAILED" and filters.clean_state("  ") is None
    for bad in ("NOPE", "timeout"):
        with pytest.raises(ValueError):
            filters.clean_state(bad)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            filters.check_list_limit(bad)
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            filters.check_accounting_limit(bad)
    with pytest.raises(ValueError):
        filters.check_iso("2024")
    assert filters.is_filtered(" ", None) is False and filters.is_filtered("a") is True


def test_namespaces(spark):
    df = spark.createDataFrame([("a",), ("b",)], "namespace string")
    assert filters.in_namespaces(df, " a , ").count() == 1
    assert filters.in_namespaces(df, " , ").count() == 2


def test_list_is_text_order_and_counts_before_the_limit(spark, jobs):
    rows = lists.list_jobs(jobs, limit=7).select("job_id").collect()
    ids = sorted((r.job_id for r in jobs.select("job_id").collect()), reverse=True)
    assert [r.job_id for r in rows] == ids[:7]
    total = lists.list_total(jobs, user="user-7").first()
    assert total.filtered and total.total == jobs.filter("user = 'user-7'").count()
    assert lists.list_total(jobs, user="  ").first().filtered is False


def test_unknown_job_is_an_empty_table(jobs):
    assert filters.filter_jobs(jobs, job_id="none such").count() == 0


def test_list_plans(spark, jobs, plan, sf):
    plain = views.jobs(spark, "/root/testdata/sf0.01")  # not the cached table
    assert "TakeOrderedAndProject" in plan(normalize.concise(lists.list_jobs(plain)))
    recent = plan(lists.recent_per_cluster(plain))
    assert recent.count("WindowGroupLimit") >= 2
    # a list does not read what it does not show: lineitem is only joined for node counts
    assert "lineitem" not in plan(normalize.concise(lists.list_jobs(plain)))


def test_native_filter_reaches_the_scan(spark, tmp_path, plan):
    path = str(tmp_path / "native")
    rows = [("slurm", "FAILED", None), ("flux", "INACTIVE", "FAILED"), ("slurm", "RUNNING", None)]
    spark.createDataFrame(rows, "backend string, native string, result string").write.parquet(path)
    from jobfacts.functions import states

    df = spark.read.parquet(path)
    found = df.filter(states.native_state_filter("FAILED", *[F.col(c) for c in df.columns]))
    assert found.count() == 2
    pushed = [line for line in plan(found).splitlines() if "PushedFilters" in line]
    assert pushed and "NODE_FAIL" in pushed[0] and "INACTIVE" in pushed[0]


def test_queue_invariants(jobs):
    rows = queue.queue_status(jobs, detailed=True).collect()
    assert sum(r.total_jobs for r in rows) == jobs.count()
    assert all(
        r.running + r.pending + r.completed + r.failed + r.cancelled <= r.total_jobs for r in rows
    )


def test_resource_invariants(spark, sf):
    for r in resources.node_summary(views.nodes(spark, sf)).collect():
        assert r.nodes_idle + r.nodes_allocated + r.nodes_down == r.nodes_total
        assert 0 <= r.cores_available <= r.cores_total
    summary = resources.node_summary(views.nodes(spark, sf))
    for r in queue.utilization(views.jobs(spark, sf), summary).collect():
        assert r.nodes_allocated <= r.nodes_total and r.cores_allocated <= r.cores_total


def test_accounting(jobs):
    brief = accounting.accounting(jobs, limit=10)
    full = accounting.accounting(jobs, limit=10, detailed=True)
    assert set(brief.columns) < set(full.columns)
    assert brief.filter("state = 'FAILED' and exit_code = 0").count() == 0
    day = jobs.agg(F.min("submitted")).first()[0]
    text = day.strftime("%Y-%m-%dT%H:%M:%SZ")
    assert accounting.accounting_total(jobs, start_time=text, end_time=text).first().total >= 1
    assert accounting.accounting_total(jobs, end_time="1990-01-01").first().total == 0


def test_history_excludes_the_job_itself(spark):
    rows = [("a", "c", "n", "COMPLETED", 10, 1 << 30), ("b", "c", "n", "FAILED", 30, None),
            ("d", "c", "n", "RUNNING", 99, None), ("e", "c", "m", "COMPLETED", 5, None)]
    df = spark.createDataFrame(
        rows, "job_id string, cluster string, name string, state string, runtime_seconds bigint, memory_used_bytes bigint")
    got = {r.job_id: r for r in history.compare_with_similar(df).collect()}
    assert (got["a"].similar_jobs, got["a"].avg_runtime_seconds, got["a"].success_rate) == (1, 30.0, 0.0)
    assert (got["d"].similar_jobs, got["d"].avg_runtime_seconds, got["d"].success_rate) == (2, 20.0, 0.5)
    assert got["e"].similar_jobs == 0 and got["e"].avg_runtime_seconds is None
    limits = {r.name: r for r in history.time_limit_from_history(df).collect()}
    assert limits["n"].suggested_minutes == 1 and limits["n"].suggested_time_limit == "00:01:00"


BATCH = "batch_id int, array_spec string, commands array<string>, max_concurrent int"


def batches(spark, rows):
    return spark.createDataFrame(rows, BATCH)


def expand(spec, cap):
    """Brute force of one array spec: task ids, and whether the spec is bad."""
    if "-" not in spec:
        return [], False
    first, rest = spec.split("-")[:2]
    try:
        end, step = rest.split(":") if ":" in rest else (rest, "1")
        ids = list(range(int(first), int(end) + 1, int(step)))
    except ValueError:
        return [], True
    return (ids[:cap] if cap else ids), False


def test_array_specs_equal_brute_force(spark):
    specs = ["1-10", "1-100:2", "1-50", "5", "1,3,5", "1-10:0", "a-b", "10-1", "0-0", " 2 - 5 ", "1-5:2:3",
             "1-", "-3", "1-10-20", "7-7:9", "1-25000", "3-x:1", "1-10:", "0-9:3"]
    rows = [(i * 10 + c, s, None, cap) for i, s in enumerate(specs) for c, cap in enumerate([None, 0, 4])]
    df = batches(spark, rows)
    tasks = {}
    for r in batch.expand_arrays(df).collect():
        tasks.setdefault(r.batch_id, {})[r.task_index] = r.task_id
    errors = {r.batch_id for r in batch.array_errors(df).collect()}
    summary = {r.batch_id: r for r in batch.batch_summary(df).collect()}
    for key, spec, _, cap in rows:
        ids, bad = expand(spec, cap)
        got = tasks.get(key, {})
        assert [got[i] for i in sorted(got)] == ids and sorted(got) == list(range(len(ids))), spec
        assert (key in errors) == bad, spec
        assert (summary[key].submitted, summary[key].failed, summary[key].success) == (len(ids), int(bad), bool(ids))
    capped = batch.expand_arrays(df, cap=3)
    assert sorted(map(tuple, capped.collect())) == sorted(map(tuple, batch.cap_tasks(batch.expand_arrays(df), 3).collect()))


def test_a_huge_spec_is_expanded_lazily(spark):
    df = batches(spark, [(1, "5-1000000000000004:1", None, None), (2, "1-99999999999999999999", None, None)])
    summary = {r.batch_id: (r.submitted, r.failed) for r in batch.batch_summary(df).collect()}
    assert summary == {1: (10**15, 0), 2: (0, 1)}
    got = batch.expand_arrays(df).limit(5).collect()
    assert len(got) == 5 and all(r.task_id == r.task_index + 5 for r in got)


def test_bad_rows_are_rejects_and_stop_nothing(spark):
    wrap = "named_struct('set', true, 'number', {}L)"
    dump = views.slurm_dump(spark, "/root/testdata/sf0.001").filter("submit_time.number < 10000000000").orderBy("job_id").filter("job_id IS NOT NULL").limit(3)
    broken = dump.withColumn("start_time", F.expr(wrap.format(10**17))).unionByName(dump.withColumn("job_id", F.lit(None)))
    whole = dump.unionByName(broken)
    as_of = F.timestamp_seconds(F.lit(views.AS_OF))
    assert len(normalize.normalize_slurm(whole, as_of).collect()) == 3
    assert sorted(r.reject for r in normalize.slurm_rejects(whole).collect()) == ["no job id"] * 3 + ["time out of range"] * 3
    lines = [f"f{i},n,RUN,{t},-,-,-,1,1,1h,-" for i, t in enumerate(["5", "1e300", "99999999999999", "x"])]
    split = normalize.split_flux_lines(spark.createDataFrame([(x,) for x in lines], "value string"), schemas.FLUX_LONG_FIELDS)
    assert [r.job_id for r in normalize.normalize_flux(split).collect()] == ["f0"]
    assert normalize.flux_rejects(split).count() == 3


def test_commands_and_sources(spark):
    df = batches(spark, [(1, None, ["a", "b", "c"], None), (2, "1-3", None, None), (3, "1-3", ["a"], None),
                         (4, None, None, None), (5, "", [], None)])
    assert [r.command for r in batch.expand_commands(df).orderBy("task_index").collect()] == ["a", "b", "c"]
    reasons = {r.batch_id: r.reason for r in batch.has_one_source(df).collect()}
    assert reasons[1] is None and reasons[2] is None
    assert reasons[3].startswith("both") and reasons[4] == reasons[5] == "neither array_spec nor commands"


def test_sweep(spark):
    tasks = spark.createDataFrame([(i,) for i in (0, 1, 2, 10, 11)], "task_id bigint")
    got = {r.task_id: r for r in batch.sweep(tasks, views.sweep_parameters(spark)).collect()}
    assert (str(got[0].parameter), got[0].result) == ("0.001", 0.1)
    assert (got[2].result, got[10].result) == (2.5, 5010.0)
    assert got[11].status == "FAILED" and got[11].parameter is None and got[1].status == "SUCCESS"


def test_tail(spark, values):
    sample = "Mock job output\nLine 2\nLine 3\nCompleted successfully"
    assert values(lambda c: output.tail_text(c, 2), [sample, "one", "", "a\nb\n"]) == [
        "Line 3\nCompleted successfully", "one", "", "b\n"]
    assert values(lambda c: output.is_truncated(c, 2), [sample, "a\nb", "a\nb\n"]) == [True, False, True]


def test_tail_lines_limits_before_the_exchange(spark, sf, plan):
    tails = output.tail_lines(views.output_lines(spark, sf), 3, ["native_id", "stream"], ["turn", "line_no", "line"])
    assert plan(tails).count("WindowGroupLimit") >= 2


def test_cancels(spark):
    jobs = spark.createDataFrame(
        [("1", "PENDING"), ("2", "RUNNING"), ("3", "COMPLETED"), ("4", "RUNNING"), ("6", "SUSPENDED")],
        "job_id string, state string")
    asked = spark.createDataFrame([("1",), ("1",), ("2",), ("3",), ("5",), ("6",)], "job_id string")
    got = {r.job_id: (r.state, r.cancel_error) for r in status.apply_cancels(jobs, asked).collect()}
    assert got == {"1": ("CANCELLED", None), "2": ("CANCELLED", None), "3": ("COMPLETED", "job is already COMPLETED"),
                   "4": ("RUNNING", None), "6": ("SUSPENDED", None)}


def test_envelope(jobs):
    page = normalize.concise(lists.list_jobs(jobs, limit=3))
    text = sinks.list_envelope(page, lists.list_total(jobs)).first().response
    answer = json.loads(text)
    assert answer["success"] and answer["total"] == jobs.count() and answer["filtered"] is False
    ids = [j["job_id"] for j in answer["jobs"]]
    assert len(ids) == 3 and ids == sorted(ids, reverse=True)
    assert "exit_code" in answer["jobs"][0]
    assert answer["jobs"][0]["submitted"].endswith("Z")


def test_concise_is_far_smaller_than_detailed(jobs):
    def size(df):
        return df.select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.avg("n")).first()[0]

    assert size(normalize.concise(jobs)) < 0.5 * size(normalize.detailed(jobs))


def test_summary_fallbacks(spark):
    from jobfacts.sources import readers

    line = json.dumps({"job_id": "1", "name": "x", "user_name": "u", "job_state": ["RUNNING"], "partition": "",
                       "node_count": {"set": False, "number": 3}, "nodes": "n[1-3]", "tasks": 0,
                       "submit_time": {"set": True, "number": 1705234567}, "start_time": {"set": True, "number": 10},
                       "end_time": {"set": True, "number": 3615}, "memory_per_tres": "mem=1"})
    row = normalize.job_summary(normalize.parse_slurm_lines(spark.createDataFrame([(line,)], "value string")))
    r = row.first()
    assert (r.nodes, r.memory, r.runtime_seconds, r.submit_time) == ("n[1-3]", "mem=1", 3605, "2024-01-14T12:16:07Z")
    text = normalize.status_text(row).first().status_text
    assert text == "Job 1 (x), user=u, state=RUNNING, nodes=n[1-3], runtime=1h0m5s"
    assert readers  # the reader module imports without a session


def test_latest_and_first(spark):
    t = [dt.datetime(2024, 1, 1, 0, m) for m in range(5)]
    rows = [("a", "PENDING", t[0]), ("a", "COMPLETED", t[2]), ("a", "RUNNING", t[1]), ("a", "FAILED", t[3]),
            ("b", "RUNNING", t[4])]
    df = spark.createDataFrame(rows, "job_id string, state string, ts timestamp")
    assert {r.job_id: r.state for r in status.latest_status(df).collect()} == {"a": "FAILED", "b": "RUNNING"}
    assert [(r.job_id, r.state) for r in status.first_terminal(df).collect()] == [("a", "COMPLETED")]
    assert {r.job_id: (r.state, r.success) for r in status.outcomes(df, 1).collect()} == {
        "a": ("TIMEOUT", False), "b": ("TIMEOUT", False)}
    assert {r.job_id: r.state for r in status.outcomes(df, 2).collect()}["a"] == "COMPLETED"
