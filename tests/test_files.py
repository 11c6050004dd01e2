import json

import pyarrow as pa
import pytest

from jobfacts.plans import files, views
from jobfacts.sources import readers, script_files, sinks


@pytest.mark.parametrize("kind", ["jobs", "items"])
def test_answers_are_pages(spark, sf, tmp_path, monkeypatch, kind):
    folder = tmp_path / "answers"
    monkeypatch.setattr(files, "PER_ANSWER", 20, raising=False)
    monkeypatch.setattr(files, "shared_folder", lambda spark, purpose: str(folder))
    if kind == "jobs":
        n = views.slurm_dump(spark, sf).count()
        got = files.slurm_jobs(spark, sf, "envelope").count()
    else:
        n = views.minicluster_specs(spark, sf).count()
        got = files.minicluster_checks(spark, sf).count()
    sizes = [len(json.loads(f.read_text())[kind]) for f in folder.glob("part-*")]
    assert got == sum(sizes) == n and n > 100
    assert max(sizes) <= 45


def test_scripts_are_files_in_folders_of_bounded_size(spark, sf, tmp_path, monkeypatch):
    folder = tmp_path / "scripts"
    monkeypatch.setattr(files, "shared_folder", lambda spark, purpose: str(folder))
    found = files.script_classes(spark, sf)
    want = sorted((r.script or "") + "\n" for r in views.requests(spark, sf).collect())
    assert found.selectExpr("sum(scripts)").first()[0] == len(want)
    folders = [d for d in folder.iterdir() if d.is_dir()]
    assert sorted(f.read_bytes().decode() for d in folders for f in d.glob("*.sh")) == want
    assert len([f for f in folder.iterdir() if f.is_file()]) < 5
    batch = pa.RecordBatch.from_pylist([{"script": str(n)} for n in range(700)])
    done = script_files._Writer({"path": str(tmp_path / "many")}).write(iter([batch] * 3))
    assert [len(list((tmp_path / "many" / name).iterdir())) for name in done.folders] == [1000, 1000, 100]


def test_scripts_of_repeated_tasks_and_of_plain_folders(spark, tmp_path):
    rows = [("echo ü\n",), ("",), (None,), ("a\nb",)]
    sinks.write_scripts(spark.createDataFrame(rows, "script string").repartition(3), str(tmp_path / "a"))
    (tmp_path / "a" / "repeated-0").mkdir()
    (tmp_path / "a" / "repeated-0" / "0.sh").write_text("of a task that was lost\n")
    read = readers.read_scripts(spark, str(tmp_path / "a"), "folders").collect()
    assert sorted(r.script for r in read) == ["\n", "\n", "a\nb\n", "echo ü\n\n"] and len({r.path for r in read}) == 4
    (tmp_path / "b" / "x" / "deep").mkdir(parents=True)
    for n, name in enumerate(("top.sh", "x/in.sh", "x/deep/er.sh", "_left", ".hidden")):
        (tmp_path / "b" / name).write_text(f"echo {n}")
    read = readers.read_scripts(spark, str(tmp_path / "b"), "folders").collect()
    assert sorted(r.script for r in read) == ["echo 0", "echo 1", "echo 2"]
