import io
import random

import pytest
from pyspark.sql import functions as F

from jobfacts.operators import batch, output
from jobfacts.sources import job_files, lines, readers, sinks


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    files = {f"{k}.out": [f"{k} {i} " + "é" * rng.randrange(60) for i in range(rng.choice((1, 7, 900)))] for k in range(30)}
    files["31.err"] = ["", "", "x", ""]
    files["32.err"] = ["one line longer than many blocks " * 400]
    for name, body in files.items():
        (tmp_path / name).write_text("\n".join(body) + "\n")
    (tmp_path / "33.out").write_text("no newline\nat the end")
    (tmp_path / "34.out").write_text("")
    files["33.out"] = ["no newline", "at the end"]
    return tmp_path, files


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(f"{r.job_id}.{'err' if r.stream == 'stderr' else 'out'}", {})[r.line_no] = r.line
    return out


def test_lines_have_their_numbers_in_split_files(spark, folder, small_blocks):
    path, files = folder
    df = readers.read_job_output(spark, str(path), "lines")
    assert by_file(df.collect()) == {n: dict(enumerate(body)) for n, body in files.items()}
    per = df.groupBy("job_id").agg(F.countDistinct("block").alias("n"))
    assert per.agg(F.max("n")).first()[0] > 5  # a file is many blocks
    assert [r.line for r in df.filter("job_id = '31' AND line_no > 0").orderBy("line_no").collect()] == ["", "x", ""]


def test_numbering_moves_no_lines(spark, folder, plan):
    text = plan(lines.numbered_lines(spark, str(folder[0])))
    scans = text.count("Scan text")
    assert scans == 4 and "Window" in text  # two scans, each in tree and list
    assert "BroadcastHashJoin" in text


def test_command_lists_of_any_length(spark, tmp_path, small_blocks):
    body = []
    for i in range(3000):
        body += [f"run {i}"] + ["# note"] * (i % 3 == 0) + [""] * (i % 5 == 0) + ["  \t"] * (i % 7 == 0)
    (tmp_path / "a.txt").write_text("\n".join(body) + "\n")
    (tmp_path / "b.txt").write_text("# nothing\n\n")
    (tmp_path / "c.txt").write_text("# comment\n\necho 1\n   \npython x.py")
    got = readers.read_command_lines(spark, str(tmp_path))
    want = batch.expand_commands(readers.read_commands(spark, str(tmp_path)))
    rows = lambda df: sorted((r.batch_id, r.task_index, r.command) for r in df.collect())
    assert rows(got) == rows(want) and got.count() == 3002


@pytest.mark.parametrize("n", [1, 3, 50])
def test_ends_are_those_of_the_whole_files(spark, folder, n):
    path, _ = folder
    whole = readers.read_job_output(spark, str(path), "lines")
    want = output.tail_lines(whole, n, ["job_id", "stream"], ["line_no"])
    got = readers.read_output_tails(spark, str(path), n)
    columns = ["job_id", "stream", "from_end", "line", "truncated"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_only_the_end_is_read():
    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            self.seen += n
            return super().read(n)

    for rows in (10_000, 200_000):
        body = b"".join(b"line %d\n" % i for i in range(rows))
        file = Counted(body)
        tail, more = job_files.last_lines(file, len(body), 5)
        assert more and tail == [b"line %d" % i for i in range(rows - 5, rows)]
        assert file.seen <= 2 * job_files.BLOCK
    assert job_files.last_lines(io.BytesIO(b""), 0, 3) == ([], False)
    assert job_files.last_lines(io.BytesIO(b"a\nb\n"), 4, 2) == ([b"a", b"b"], False)
    assert job_files.last_lines(io.BytesIO(b"\n"), 1, 2) == ([b""], False)


def test_output_round_trip(spark, tmp_path, small_blocks):
    rows = [(f"j{k % 9}" if k % 4 else "hot job", "stderr" if k % 3 else "stdout", k, f"line {k} ü") for k in range(5000)]
    df = spark.createDataFrame(rows, "job_id string, stream string, n int, line string").repartition(7)
    path = str(tmp_path / "out")
    for _ in range(2):  # written again, files are replaced by the same
        sinks.write_job_output(df, path, ["n"])
    assert not (tmp_path / "out" / "_staging").exists() and (tmp_path / "out" / "_SUCCESS").exists()
    got = by_file(readers.read_job_output(spark, path, "lines").collect())
    want = {}
    for job, stream, _, line in rows:
        mine = want.setdefault(f"{job}.{'err' if stream == 'stderr' else 'out'}", {})
        mine[len(mine)] = line
    assert got == want
    with pytest.raises(Exception, match="slash"):
        sinks.write_job_output(df.limit(1).withColumn("job_id", F.lit("a/b")), path, ["n"])
    sinks.write_job_output(df.filter("1 = 0"), str(tmp_path / "none"), ["n"])
    assert readers.read_output_tails(spark, str(tmp_path / "none"), 2).collect() == []
