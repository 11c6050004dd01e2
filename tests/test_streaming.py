import datetime as dt

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from jobfacts import schemas
from jobfacts.operators import queue, status
from jobfacts.plans import streams
from jobfacts.streaming import changes, keyed, timeouts
from jobfacts.streaming.runs import RunLog

T0 = dt.datetime(2024, 1, 1)


def write(spark, folder, name, rows, schema=schemas.STATUS):
    spark.createDataFrame(
        [(*r[:-1], T0 + dt.timedelta(minutes=r[-1])) for r in rows], schema
    ).coalesce(1).write.parquet(f"{folder}/{name}")


def drain(spark, source, start):
    stream = spark.readStream.schema(schemas.STATUS).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = start(stream)
    query.awaitTermination()


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_first_terminal_over_several_runs_with_late_statuses(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    write(spark, src, "a", [("1", "RUNNING", 0), ("1", "FAILED", 9), ("2", "PENDING", 1)])
    drain(spark, src, lambda s: changes.stream_first_terminal(s, out, ckpt))
    assert [r.state for r in changes.read_first_terminal(spark, out).collect()] == ["FAILED"]
    write(spark, src, "b", [("1", "COMPLETED", 5), ("2", "CANCELLED", 30), ("1", "TIMEOUT", 50)])
    drain(spark, src, lambda s: changes.stream_first_terminal(s, out, ckpt))
    everything = spark.read.schema(schemas.STATUS).parquet(f"{src}/*")
    expected = as_set(status.first_terminal(everything).select("job_id", "state", "ts"))
    assert as_set(changes.read_first_terminal(spark, out).select("job_id", "state", "ts")) == expected
    assert {(j, s) for j, s, _ in expected} == {("1", "COMPLETED"), ("2", "CANCELLED")}


def test_queue_status_counts_jobs_not_statuses(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "cluster string, " + schemas.STATUS
    write(spark, src, "a", [("c", "1", "PENDING", 0), ("c", "1", "RUNNING", 1), ("c", "2", "PENDING", 0)], schema)
    write(spark, src, "b", [("c", "1", "COMPLETED", 2), ("d", "3", "FAILED", 3)], schema)
    stream = spark.readStream.schema(schema).parquet(f"{src}/*")
    changes.stream_queue_status(stream, out, ckpt).awaitTermination()
    every = spark.read.schema(schema).parquet(f"{src}/*")
    newest = every.groupBy("cluster", "job_id").agg(F.max_by("state", "ts").alias("state"))
    got = changes.read_queue_status(spark, out)
    expected = queue.queue_status(newest, detailed=True)
    assert as_set(got.select(*expected.columns)) == as_set(expected)
    assert {r.cluster: r.total_jobs for r in got.collect()} == {"c": 2, "d": 1}


def test_outcomes_are_emitted_once_and_equal_the_batch_twin(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    files = {
        "a": [("ok", "RUNNING", 0), ("slow", "PENDING", 0), ("late", "RUNNING", 2), ("hot", "RUNNING", 1)]
        + [("hot", "RUNNING", 2 + i % 30) for i in range(400)],
        "b": [("ok", "COMPLETED", 20), ("late", "FAILED", 25)],
        "c": [("late", "COMPLETED", 18), ("hot", "CANCELLED", 31), ("beat1", "PENDING", 24)],
        "d": [("slow", "COMPLETED", 200), ("ok", "RUNNING", 100), ("hot", "FAILED", 101)],
        "e": [("beat2", "PENDING", 2000)],
    }
    for name, rows in files.items():
        write(spark, src, name, rows)
        stream = spark.readStream.schema(schemas.STATUS).parquet(f"{src}/*")
        timeouts.stream_outcomes(stream, out, ckpt, 60, 30).awaitTermination()
    got = timeouts.read_outcomes(spark, out)
    rows = [tuple(r) for r in got.filter("job_id not like 'beat%'").collect()]
    everything = spark.read.schema(schemas.STATUS).parquet(f"{src}/*").filter("job_id not like 'beat%'")
    assert sorted(rows) == sorted(as_set(status.outcomes(everything, 60)))
    assert {r[0]: r[1] for r in rows} == {"ok": "COMPLETED", "slow": "TIMEOUT", "late": "COMPLETED", "hot": "CANCELLED"}


def test_decided_jobs_leave_the_state_and_are_not_decided_again(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for n, rows in enumerate([[("a", "RUNNING", 0)], [("b", "PENDING", 100)], [("c", "PENDING", 5000)], [("d", "RUNNING", 5001), ("a", "COMPLETED", 4999)]]):
        write(spark, src, f"f{n}", rows)
        stream = spark.readStream.schema(schemas.STATUS).parquet(f"{src}/*")
        timeouts.stream_outcomes(stream, out, ckpt, 60, 5).awaitTermination()
    assert sorted((r.job_id, r.state) for r in timeouts.read_outcomes(spark, out).collect()) == [("a", "TIMEOUT"), ("b", "TIMEOUT")]
    held = spark.read.format("statestore").option("stateVarName", "facts").load(ckpt)
    assert {r.key.job_id for r in held.collect() if not r.value.decided} == {"c", "d"}


def feed(spark, src, names, rows, start, schema=schemas.STATUS):
    """Write a file and run the stream until it is used up; its query."""
    write(spark, src, names, rows, schema)
    query = start(spark.readStream.schema(schema).parquet(f"{src}/*"))
    query.awaitTermination()
    return query


def held(query):
    """Keys with state after the last trigger."""
    return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def test_what_comes_too_late_is_a_row_of_its_own(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))

    def start(stream):
        return timeouts.stream_outcomes(stream, out, ckpt, 60, 5, 30)

    feed(spark, src, "a", [("x", "RUNNING", 0), ("x", "COMPLETED", 20), ("y", "RUNNING", 0), ("z", "PENDING", 0), ("w", "FAILED", 3)], start)
    feed(spark, src, "b", [("beat", "PENDING", 500)], start)
    late = [("x", "FAILED", 10), ("y", "RUNNING", 70), ("z", "COMPLETED", 59), ("w", "CANCELLED", 90), ("z", "FAILED", 300)]
    feed(spark, src, "c", late, start)
    query = feed(spark, src, "d", [("x", "CANCELLED", 10), ("beat", "FAILED", 520)], start)
    first = {r.job_id: r.state for r in timeouts.read_outcomes(spark, out).collect()}
    assert {k: v for k, v in first.items() if k != "beat"} == {"x": "COMPLETED", "y": "TIMEOUT", "z": "TIMEOUT", "w": "FAILED"}
    assert timeouts.read_outcomes(spark, out).count() == len(first)
    assert {(r.job_id, r.kept) for r in timeouts.read_late(spark, out).collect()} == {("x", "FAILED"), ("x", "CANCELLED"), ("z", "COMPLETED")}
    everything = spark.read.schema(schemas.STATUS).parquet(f"{src}/*").filter("job_id <> 'beat'")
    now = timeouts.all_outcomes(spark, out, 60).filter("job_id <> 'beat'")
    assert as_set(now) == as_set(status.outcomes(everything, 60))
    assert held(query) > 0
    after = feed(spark, src, "e", [("beat2", "PENDING", 60 * 24 * 40)], start)
    assert held(after) == 1  # all but the last beat are forgotten
    feed(spark, src, "f", [("x", "FAILED", 1), ("x", "RUNNING", 60 * 24 * 40)], start)
    assert timeouts.read_late(spark, out).filter("job_id = 'x'").count() == 2  # a new x waits, with its oldest status


def test_a_trigger_touches_its_own_keys_only(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))

    def start(stream):
        return timeouts.stream_outcomes(stream, out, ckpt, 60, 5)

    feed(spark, src, "a", [(f"j{i}", "RUNNING", 0) for i in range(500)], start)
    query = feed(spark, src, "b", [(f"j{i}", "COMPLETED", 1) for i in range(7)], start)
    ops = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert [o["numRowsUpdated"] for o in ops] == [7] and held(query) == 500


def test_a_key_with_most_rows_is_one_row_a_batch(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 > 0, 'hot', concat('k', id)) AS k", "id AS first", "lpad(id, 20, '0') AS best")
    reduced = keyed._reduced(rows.coalesce(1), ["k"], {"first": "min", "best": "max"})
    got = {r.k: r.n for r in reduced.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert 1 <= got["hot"] <= 4 and len(got) == 10_001
    assert reduced.agg(F.min("first"), F.max("best")).first() == (0, "0" * 15 + "29999")


def test_rows_of_a_key_in_many_batches_of_a_task_are_one(spark):
    rows = spark.range(300_000).selectExpr("concat('k', id % 20000) AS k", "id AS first", "lpad(id, 20, '0') AS best")
    reduced = keyed._reduced(rows.coalesce(1), ["k"], {"first": "min", "best": "max"}).cache()
    assert reduced.count() == 20_000 and reduced.select("k").distinct().count() == 20_000
    assert reduced.selectExpr("sum(first)", "sum(CAST(best AS BIGINT) - first)").first() == (20_000 * 19_999 // 2, 20_000 * 280_000)
    apart = keyed._reduced(spark.range(600_000).coalesce(1).selectExpr("id AS k", "id AS first"), ["k"], {"first": "min"})
    assert apart.selectExpr("count(*)", "count(DISTINCT k)", "sum(first)").first() == (600_000, 600_000, 600_000 * 599_999 // 2)


def test_files_of_the_stream_can_be_cut(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "shared_folder", lambda spark, purpose: str(tmp_path / "events"))
    monkeypatch.setattr(streams, "ROW_GROUP", 2000)
    streams._events(spark, sf)
    files = list((tmp_path / "events").glob("*.parquet"))
    assert len(files) == streams.TRIGGERS * streams.FILES
    assert all(pq.ParquetFile(f).metadata.num_row_groups > 1 for f in files)


def test_ends_are_written_once_and_forgotten(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))

    def start(stream):
        return timeouts.stream_ends(stream, out, ckpt, 10, 1)

    seen = []
    day = 1440
    for n, rows in enumerate(
        [
            [("a", "RUNNING", 0), ("a", "FAILED", 9), ("b", "PENDING", 1), (None, "FAILED", 1)],
            [("a", "COMPLETED", 5), ("c", "FAILED", 30), ("c", "CANCELLED", 30)],  # a is not settled before 19: the late one counts
            [("b", "RUNNING", 100)],
            [("c", "COMPLETED", 25), ("a", "FAILED", 8)],  # c is settled: 25 is too late
            [("d", "TIMEOUT", 2 * day)],
            [("b", "COMPLETED", 2 * day + 1), ("e", "FAILED", 50), ("f", "PENDING", 4 * day)],
        ]
    ):
        seen.append(held(feed(spark, src, f"f{n}", rows, start)))
    got = {(r.job_id, r.state) for r in timeouts.read_ends(spark, out).collect()}
    assert got == {("a", "COMPLETED"), ("c", "CANCELLED"), ("d", "TIMEOUT"), ("b", "COMPLETED")}
    assert timeouts.read_ends(spark, out).count() == 4
    assert {(r.job_id, r.kept) for r in timeouts.read_late(spark, out).collect()} == {("c", "COMPLETED"), ("e", "FAILED")}
    everything = spark.read.schema(schemas.STATUS).parquet(f"{src}/*").filter("job_id IS NOT NULL")
    assert as_set(timeouts.all_ends(spark, out)) == as_set(status.first_terminal(everything).select("job_id", "state", "ts"))
    assert max(seen) == 2 and seen[-1] == 0, seen


def test_a_minicluster_times_out_before_its_readiness(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    body = "struct<phase:string,size:int,maximumSize:int,desiredSize:int,specSize:int,conditions:array<struct<type:string,status:string>>>"
    schema = f"namespace string, name string, status {body}, ts timestamp"

    def mc(name, phase, minute, size=None):
        return ("ns", name, (phase, size, 4, None, None, None), minute)

    def start(stream):
        return timeouts.stream_readiness(stream, out, ckpt, 30, 5)

    feed(spark, src, "a", [mc("slow", "Pending", 0), mc("quick", "Pending", 0), mc("sized", None, 3, 2)], start, schema)
    feed(spark, src, "b", [mc("quick", "Running", 12), mc("sized", None, 20, 4), mc("other", "Pending", 40)], start, schema)
    assert timeouts.read_readiness(spark, out).filter("name = 'slow'").first().reason == "Timeout"
    feed(spark, src, "c", [mc("slow", "Running", 45), mc("other", "Pending", 200)], start, schema)
    got = {r.name: (r.phase, r.reason, r.ts, r.decided) for r in timeouts.read_readiness(spark, out).collect()}
    at = {n: T0 + dt.timedelta(minutes=n) for n in (12, 20, 30, 70)}
    assert got == {
        "slow": ("Unknown", "Timeout", None, at[30]),
        "quick": ("Running", None, at[12], at[12]),
        "sized": (None, None, at[20], at[20]),
        "other": ("Unknown", "Timeout", None, at[70]),
    }
    assert timeouts.read_late(spark, out).count() == 0  # readiness after the time is up changes nothing
    feed(spark, src, "d", [mc("slow", "Running", 29)], start, schema)
    assert {r.name: r.phase for r in timeouts.all_readiness(spark, out, 30).collect()}["slow"] == "Running"


def test_queue_status_adds_differences_and_forgets(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "cluster string, " + schemas.STATUS

    def start(stream):
        return changes.stream_queue_status(stream, out, ckpt, 2)

    day, sizes, rows = 1440, [], []
    for n in range(6):
        new = [("c", f"j{n}-{i}", s, n * day + 60 * k) for i in range(20) for k, s in enumerate(("PENDING", "RUNNING", "COMPLETED")[: 1 + i % 3])]
        new += [("d", "long", "RUNNING" if n % 2 else "PENDING", n * day)]
        if n > 1:
            new += [("c", f"j{n - 1}-0", "FAILED", n * day + 5), ("c", f"j{n - 1}-1", "PENDING", n * day - day - 90), ("d", None, "FAILED", 1)]
        rows += new
        query = feed(spark, src, f"f{n}", new, start, schema)
        sizes.append(held(query))
        every = spark.read.schema(schema).parquet(f"{src}/*").filter("job_id IS NOT NULL")
        newest = every.groupBy("cluster", "job_id").agg(status.newest_state().alias("state"))
        expected = queue.queue_status(newest, detailed=True)
        got = changes.read_queue_status(spark, out)
        assert as_set(got.select(*expected.columns)) == as_set(expected)
    alive = newest.filter("state IN ('PENDING', 'RUNNING')").count()
    assert sizes[-1] < newest.count() and sizes[-1] >= alive
    feed(spark, src, "late", [("c", "j0-2", "FAILED", 10), ("d", "never seen", "PENDING", 10)], start, schema)
    assert as_set(changes.read_late_statuses(spark, out)) == {("c", 1), ("d", 1)}
    assert as_set(changes.read_queue_status(spark, out).select(*expected.columns)) == as_set(expected)


def test_runs_are_merged_and_repeats_change_nothing(spark, tmp_path):
    log = RunLog(str(tmp_path / "log"), fan=3)
    most = 0
    for epoch in range(40):
        rows = spark.range(epoch * 10, epoch * 10 + 10).coalesce(1)
        log.append(rows, epoch)
        if epoch % 7 in (0, 2):  # the trigger is run again
            log.append(rows, epoch)
        if epoch % 5 == 4:
            got = log.read(spark)
            assert sorted(r.id for r in got.collect()) == list(range(epoch * 10 + 10))
            most = max(most, len(got.inputFiles()))
    assert len(log.folders(40)) == 1 + 1 + 1 + 1 and most <= 8  # 40 is 1111 in base 3
    log.append(spark.range(0).coalesce(1), 40)
    assert log.read(spark).count() == 400 and log.triggers(spark) == 41


def test_a_trigger_that_broke_off_is_not_read(spark, tmp_path):
    log = RunLog(str(tmp_path / "log"), fan=2)
    for epoch in range(3):
        log.append(spark.range(epoch, epoch + 1).coalesce(1), epoch)
    spark.range(50, 60).write.parquet(f"{log.path}/level-0/run-3")  # trigger 3 has written rows, not its count
    assert sorted(r.id for r in log.read(spark).collect()) == [0, 1, 2]
    log.append(spark.range(3, 4).coalesce(1), 3)
    assert sorted(r.id for r in log.read(spark).collect()) == [0, 1, 2, 3]


def test_merging_live_versions_keeps_the_earliest(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for n in range(9):
        write(spark, src, f"f{n}", [("hot", "FAILED", 100 - n), (f"j{n}", "COMPLETED", n)])
        drain(spark, src, lambda s: changes.stream_first_terminal(s, out, ckpt))
    every = spark.read.schema(schemas.STATUS).parquet(f"{src}/*")
    expected = as_set(status.first_terminal(every).select("job_id", "state", "ts"))
    assert as_set(changes.read_first_terminal(spark, out).select("job_id", "state", "ts")) == expected
    assert RunLog(out).read(spark).filter("job_id = 'hot'").count() == 2
