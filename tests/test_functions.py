from pyspark.sql import functions as F

from jobfacts import fixed_values as fv
from jobfacts.functions import clocks, fields, states


def test_time_limit_minutes(values):
    cases = {
        "5m": 5, "1h": 60, "30s": 1, "90s": 1, "120S": 2, "2:00:00": 120, "45:30": 45, "30": 30,
        "1-02:30:00": 1590, "0:59": 0, "1-30": 1470, "": 0, "1.5h": None, "abc": None, "1:2:3:4": None,
        " 10m\n": 10, "-": None, "1-": None,
    }
    assert values(clocks.time_limit_minutes, list(cases)) == list(cases.values())
    assert values(clocks.time_limit_minutes, [None]) == [None]
    many = values(clocks.time_limit_minutes, ["9999999999999m", "9" * 30, "9" * 30 + "h", "9" * 20 + "-00:01", "1:" + "0" * 20 + "1:00"])
    assert many[0] == 9999999999999 and all(m >= clocks.BEYOND for m in many[1:4]) and many[4] == 61
    assert values(clocks.epoch_to_ts, [10**15, -(10**15), 0], "bigint") == [None] * 3


def test_flux_duration_seconds(values):
    cases = {
        "1.5h": 5400, "90m": 5400, "30s": 30, "2d": 172800, "42": 42, "-": 0, "": 0, "x9": 0,
        "1.2.3s": None, "0.5m": 30, "7w": 7, "1.": 1, ".5h": 1800, ".": None,
    }
    assert values(clocks.flux_duration_seconds, list(cases)) == list(cases.values())
    assert values(clocks.flux_duration_seconds, [None]) == [0]


def test_duration_human(values):
    cases = {3600: "1h0s", 3605: "1h0m5s", 65: "1m5s", 60: "1m0s", 5: "5s", 0: "0s", None: None}
    assert values(clocks.duration_human, list(cases), "bigint") == list(cases.values())


def test_clock_and_back(values):
    seconds = [0, 59, 923, 3600, 359999, 360000, 1234567]
    clock = values(clocks.to_clock, seconds, "bigint")
    assert clock[:6] == ["00:00:00", "00:00:59", "00:15:23", "01:00:00", "99:59:59", "100:00:00"]
    assert values(clocks.from_clock, clock) == seconds
    assert values(clocks.from_clock, ["1:2", "x:1:2", None]) == [None, None, None]
    assert values(clocks.to_clock, [None], "bigint") == [None]


def test_cpu_time_is_cut_to_whole_seconds(values):
    none = F.lit(None).cast("bigint")
    assert values(lambda c: clocks.cpu_seconds(none, c), [923, 0], "bigint") == [738, 0]
    assert values(lambda c: clocks.cpu_seconds(F.lit(5), c), [923], "bigint") == [5]


def test_iso_is_utc_in_any_session_zone(spark, values):
    def iso(c):
        return clocks.iso_utc(clocks.epoch_to_ts(c))

    epochs = [1705234567, 0, 1, 951782400, None]
    expected = ["2024-01-14T12:16:07Z", None, "1970-01-01T00:00:01Z", "2000-02-29T00:00:00Z", None]
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert values(iso, epochs, "bigint") == expected
            wall = values(lambda c: clocks.ntz_seconds(c.cast("timestamp_ntz")), ["2024-03-10 02:30:05"])
            micros = values(lambda c: clocks.ntz_micros(c.cast("timestamp_ntz")), ["2024-03-09 02:30:05.25"])
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert wall == [1710037805]
        assert micros == [1709951405250000]


def test_runtime(spark):
    rows = [(None, None), (100, None), (100, 160), (100, 90)]
    df = spark.createDataFrame(rows, "s bigint, e bigint")
    ts = [F.timestamp_seconds(F.col(c)) for c in ("s", "e")]
    got = df.select(clocks.runtime_seconds(*ts, F.timestamp_seconds(F.lit(1000)))).collect()
    assert [r[0] for r in got] == [0, 900, 60, 0]


def test_states(values):
    natives = list(fv.SLURM_STATES) + ["SUSPENDED", None]
    assert values(states.slurm_state, natives) == list(fv.SLURM_STATES.values()) + ["SUSPENDED", None]
    for result, want in [("FAILED", "FAILED"), ("CANCELED", "CANCELLED"), ("TIMEOUT", "TIMEOUT"),
                         ("COMPLETED", "COMPLETED"), ("-", "COMPLETED"), (None, "COMPLETED")]:
        got = values(lambda c: states.flux_state(c, F.lit(result)), ["INACTIVE", "RUN", "CLEANUP"])
        assert got == [want, "RUNNING", "CLEANUP"]
    assert values(states.first_state, ['["RUNNING","X"]', "RUNNING", "[]"]) == ["RUNNING", "RUNNING", None]
    assert values(states.joined_state, ['["RUNNING","X"]', "RUNNING"]) == ["RUNNING,X", "RUNNING"]


def test_native_filter_equals_filter_on_unified_state(spark):
    slurm = [("slurm", s, None) for s in list(fv.SLURM_STATES) + ["SUSPENDED"]]
    flux = [
        ("flux", s, r)
        for s in list(fv.FLUX_STATES) + ["CLEANUP"]
        for r in list(fv.FLUX_RESULTS) + ["-", None]
    ]
    df = spark.createDataFrame(slurm + flux, "backend string, native string, result string")
    cols = F.col("backend"), F.col("native"), F.col("result")
    for state in fv.LIST_STATES + ["TIMEOUT"]:
        wanted = df.filter(states.unified_state(*cols) == state).collect()
        assert sorted(wanted, key=str) == sorted(
            df.filter(states.native_state_filter(state, *cols)).collect(), key=str
        )


def test_numbers(values):
    texts = ["12", " 1.5 ", "", "x", "1d", '{"set":true,"number":4}', '{"set":false,"number":4}', None]
    assert values(fields.numeric_text, texts) == [12.0, 1.5, None, None, None, 4.0, None, None]
    codes = [
        '{"status":["SUCCESS"],"return_code":0}', '{"return_code":"PENDING"}', '{"return_code":"-1"}',
        '{"return_code":{"set":true,"number":3}}', '{"return_code":{"set":false,"number":3}}', "7", None,
    ]
    assert values(fields.slurm_exit_code, codes) == [0, None, None, 3, None, 7, None]
    assert values(fields.flux_exit_code, ["COMPLETED", "FAILED", "CANCELED", "-"]) == [0, 1, None, None]


def test_memory_bytes(values):
    cases = {"32GB": 32 << 30, "1024MB": 1 << 30, "2TB": 2 << 40, "512M": 512 << 20, "4g": 4 << 30,
             "9999999999GB": (1 << 63) - 1, "00000000000000000000001M": 1 << 20, "9" * 40 + "M": (1 << 63) - 1,
             "1T": 1 << 40, "invalid": None, "": None, "16": None}
    assert values(fields.memory_bytes, list(cases)) == list(cases.values())


def test_names(values):
    assert values(fields.node_names, [0, 2, 100], "int")[:2] == [[], ["node-01", "node-02"]]
    assert values(fields.node_names, [100], "int")[0][-1] == "node-100"
    assert values(fields.split_nodes, ["a,b", "", None]) == [["a", "b"], [], []]
    assert values(lambda c: fields.job_id_for(F.lit("flux"), c), [7], "int") == ["ƒ7"]
    secrets = {"jwt_token": "x", "jwt_secret": "y", "user": "z"}
    got = values(fields.redact, [secrets], "map<string,string>")
    assert got == [{"jwt_token": "***", "jwt_secret": "***", "user": "z"}]


def test_readiness(spark):
    none = []
    rows = [
        ("Running", 0, None, none, True), ("Pending", 2, 2, none, True), ("Pending", 1, 2, none, False),
        ("Pending", 0, 0, none, False), (None, None, None, [("JobMiniClusterReady", "True")], True),
        (None, None, None, [("JobMiniClusterReady", "False"), ("Other", "True")], False),
        (None, None, None, None, False),
    ]
    schema = "phase string, size int, want int, conditions array<struct<type:string,status:string>>, ok boolean"
    df = spark.createDataFrame(rows, schema)
    got = df.select(
        states.is_ready(F.col("phase"), F.col("size"), F.col("want"), F.col("conditions")).alias("r"), "ok"
    ).collect()
    assert all(r.r == r.ok for r in got)
    sizes = spark.createDataFrame([(0, 3, 5), (None, 0, 5), (2, 3, 5)], "m int, d int, s int")
    got = sizes.select(states.desired_size(F.col("m"), F.col("d"), F.col("s"))).collect()
    assert [r[0] for r in got] == [3, 5, 2]
