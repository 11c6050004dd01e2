import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from jobfacts.operators import history, prep
from jobfacts.sources import store

SCHEMA = "job_id string, submitted timestamp"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(f"j{i}", T0 + dt.timedelta(hours=i * 7 % 2400)) for i in range(1200)]
    rows += [(f"hot{i}", T0 + dt.timedelta(days=5, seconds=i)) for i in range(2000)] + [("never", None)]
    path = str(tmp_path_factory.mktemp("store") / "jobs")
    store.write_accounting(spark.createDataFrame(rows, SCHEMA).repartition(5), path)
    return path, rows


@pytest.fixture
def broken(spark, folder, tmp_path):
    """The store with a day whose file can't be read: whoever opens it fails."""
    path, rows = folder
    out = tmp_path / "store"
    shutil.copytree(path, out)
    (out / "submit_day=2024-03-01").mkdir(exist_ok=True)
    for file in (out / "submit_day=2024-03-01").iterdir():
        file.unlink()
    (out / "submit_day=2024-03-01" / "part-0.parquet").write_bytes(b"this is no parquet file")
    with pytest.raises(Exception, match="part-0.parquet"):
        store.read_accounting(spark, str(out), SCHEMA).collect()
    return str(out), rows


def test_rows_come_back(spark, folder):
    path, rows = folder
    back = store.read_accounting(spark, path, SCHEMA).select("job_id", "submitted")
    assert {tuple(r) for r in back.collect()} == set(rows)


def test_a_range_reads_its_days(spark, broken):
    path, rows = broken
    low, high = T0 + dt.timedelta(days=10, hours=3), T0 + dt.timedelta(days=12, hours=9)
    df = store.read_accounting(spark, path, SCHEMA, F.lit(low), F.lit(high))
    assert {r.job_id for r in df.collect()} == {j for j, t in rows if t and low <= t <= high}


def test_a_table_of_ranges_prunes_too(spark, broken, tmp_path):
    path, rows = broken
    ranges = [(1, T0 + dt.timedelta(days=3), T0 + dt.timedelta(days=5)), (2, T0 + dt.timedelta(days=4, hours=5), T0 + dt.timedelta(days=4, hours=20)), (3, None, T0), (4, T0, T0 - dt.timedelta(days=1))]
    spark.createDataFrame(ranges, "range_id int, start timestamp, end timestamp").coalesce(1).write.parquet(str(tmp_path / "ranges"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5k")  # the ranges fit, the store doesn't
    try:
        df = store.in_ranges(store.read_accounting(spark, path, SCHEMA), spark.read.parquet(str(tmp_path / "ranges")))
        want = {(k, j) for k, low, high in ranges for j, t in rows if t and low and low <= t <= high}
        assert {(r.range_id, r.job_id) for r in df.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_months(spark, folder, tmp_path):
    path, rows = str(tmp_path / "months"), folder[1]
    store.write_accounting(spark.createDataFrame(rows, SCHEMA), path, unit="month")
    assert len(list((tmp_path / "months").glob("submit_month=*"))) == 5
    ranges = spark.createDataFrame([(1, T0 + dt.timedelta(days=20), T0 + dt.timedelta(days=40))], "range_id int, start timestamp, end timestamp")
    got = store.in_ranges(store.read_accounting(spark, path, SCHEMA, unit="month"), ranges, unit="month")
    assert {r.job_id for r in got.collect()} == {j for j, t in rows if t and dt.timedelta(days=20) <= t - T0 <= dt.timedelta(days=40)}


def test_rows_are_in_order_inside(spark, folder):
    path, _ = folder
    day = spark.read.schema(SCHEMA).parquet(f"{path}/submit_day=2024-01-06")
    times = [r.submitted for r in day.coalesce(1).collect()]
    assert len(times) > 2000 and times == sorted(times)


HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def split(spark):
    """Whether a query's final plan split a frequent key."""
    for k, v in HOT.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "16")

    def run(df):
        rows = df.collect()
        return rows, "skew=true" in df._jdf.queryExecution().executedPlan().toString()

    yield run
    for k in HOT:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", ["impute", "flag_outliers", "min_max_scale", "clean"])
def test_a_hot_sensor_is_split(spark, split, tmp_path, name):
    rows = spark.range(20_000).selectExpr(
        "id AS reading_id", "IF(id % 2 = 0, 'hot', concat('s', id % 300)) AS sensor_id",
        "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "CAST(id % 97 + 1 AS double) AS value",
    ).repartition(12)
    rows.write.parquet(str(tmp_path / "readings"))
    readings = spark.read.parquet(str(tmp_path / "readings"))
    found, was_split = split(prep.clean(readings, 0, 1000) if name == "clean" else getattr(prep, name)(readings))
    assert was_split and len(found) == 20_000


def test_a_hot_job_name_is_split(spark, split, tmp_path):
    jobs = spark.range(20_000).selectExpr(
        "CAST(id AS string) AS job_id", "'c' AS cluster", "IF(id % 2 = 0, 'hot', concat('n', id % 300)) AS name",
        "IF(id % 3 = 0, 'COMPLETED', 'FAILED') AS state", "id % 50 AS runtime_seconds", "id * 1048576 AS memory_used_bytes",
    ).repartition(12)
    jobs.write.parquet(str(tmp_path / "jobs"))
    found, was_split = split(history.compare_with_similar(spark.read.parquet(str(tmp_path / "jobs"))))
    assert was_split and len(found) == 20_000
