import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from sextant.service import SearchService, hashing_query
from sextant.sources import files as S
from sextant.sources import git as G
from sextant.sources import index as I


@pytest.fixture()
def index_rows(spark):
    texts = ["def add(a, b):\n    return a + b", "def sub(a, b):\n    return a - b", "def add(a, b):\n    return b + a"]
    return spark.createDataFrame([(i, f"d{i}", t, [float(x) for x in hashing_query(t)], "add" if i != 1 else "sub", i + 1, f"h{i}") for i, t in enumerate(texts)], "row long, doc_id string, text string, embedding array<float>, lineage_id string, version int, content_hash string")


def test_index_round_trip(spark, index_rows, tmp_path):
    folder = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        I.load_index(spark, folder)
    assert I.write_index(index_rows, folder)["kind"] == "versioned"
    rows, manifest = I.load_index(spark, folder)
    assert rows.count() == 3 == manifest["n_docs"] and I.verify_index(spark, folder) == []
    name = next(iter(manifest["files"]))
    os.remove(os.path.join(folder, "rows", f".{name}.crc"))
    with open(os.path.join(folder, "rows", name), "ab") as f:
        f.write(b"x")
    assert I.verify_index(spark, folder) == [f"changed: {name}"]
    with pytest.raises(ValueError):
        I.write_index(index_rows.unionByName(index_rows), folder)


def test_service(spark, index_rows):
    s = SearchService(index_rows)
    exact = s.search("def add(a, b):   # comment\n    return a + b").collect()
    assert [(r["row"], r["score"]) for r in exact] == [(0, 1.0)]
    hits = s.search("add a b", k=5).collect()
    assert {r["lineage_id"] for r in hits} == {"add", "sub"} and len(hits) == 2 and hits[-1]["gap"] is None
    assert len(s.search("add a b", all_versions=True).collect()) == 3
    with pytest.raises(ValueError):
        s.search("x", version=99)
    with pytest.raises(KeyError):
        s.get_doc("nope")
    assert s.get_doc("d1")["n_lines"] == 2 and s.diff("add", 1, 3)["removed"] == 1
    assert {r["status"] for r in s.compare("add", 1, 3).collect()} == {"same"}
    assert [r["version"] for r in s.history("add").collect()] == [1, 3]


def test_folder(spark, tmp_path):
    (tmp_path / "pkg" / "build").mkdir(parents=True)
    (tmp_path / "pkg" / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (")
    (tmp_path / "pkg" / "build" / "b.py").write_text("def g():\n    return 1\n")
    chunks, stats = S.chunk_folder(spark, str(tmp_path))
    assert [r["chunk_id"] for r in chunks.collect()] == ["pkg/a.py:1-2"]
    assert stats["failures"] == ["pkg/bad.py"] and stats["files_scanned"] == 2
    with pytest.raises(NotADirectoryError):
        S.read_sources(spark, str(tmp_path / "nope"))


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    S.append_jsonl(path, {"key": "a", "n": 1})
    with open(path, "a") as f:
        f.write('{"key": "b", "n"')
    done = S.read_jsonl(spark, path, "key string, n int")
    assert [tuple(r) for r in done.collect()] == [("a", 1)]
    todo = S.still_to_do(spark.createDataFrame([("a",), ("b",), ("b",)], "key string"), done, "key")
    assert [r["key"] for r in todo.collect()] == ["b"]


def test_fixture_and_split(spark):
    f = S.version_fixture(spark, 5, 3)
    assert f.count() == 15 and f.subtract(S.version_fixture(spark, 5, 3)).count() == 0
    parts = S.hash_split(spark.range(1000), "id", 0.3).groupBy("part").count().collect()
    assert {r["part"] for r in parts} == {"tune", "holdout"} and 200 < min(r["count"] for r in parts) < 400


def test_git(spark, tmp_path):
    repo = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for text in ("def f():\n    return 1\n", "def f():\n    return 1  # same\n", "def f():\n    return 2\n\ndef g():\n    return 3\n"):
        (tmp_path / "a.py").write_text(text)
        run("add", ".")
        run("commit", "-qm", "step")
    rows = G.function_versions(spark, repo)
    from sextant.operators.versions import change_labels

    got = {(r["lineage_id"], r["version"]): r["change"] for r in change_labels(rows.withColumn("row", F.col("version")).withColumn("repo", F.lit("r")), ["repo"]).collect()}
    assert got == {("a.py::f", 1): "added", ("a.py::f", 2): "unchanged", ("a.py::f", 3): "modified", ("a.py::g", 3): "added"}


def test_git_keeps_long_functions(spark, tmp_path):
    repo = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for n in (1, 3000):
        (tmp_path / "a.py").write_text("def f():\n" + "    x = 1\n" * n)
        run("add", ".")
        run("commit", "-qm", "step")
    assert sorted((r["version"], len(r["text"]) > 20_000) for r in G.function_versions(spark, repo).collect()) == [(1, False), (2, True)]


def test_git_links_by_file_rename(spark, tmp_path):
    """Short and changed functions of a renamed file are linked by the file, others by their bodies."""
    repo = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    filler = "".join(f"NAME_{i} = {i} * {i}\n" for i in range(60))
    body = "def {}(items):\n    total = 0\n    for x in items:\n        total += x\n    return total\n"
    (tmp_path / "a.py").write_text(filler + "def f():\n    return 1\n\ndef g(n):\n    return sorted(n)\n")
    (tmp_path / "c.py").write_text(body.format("old"))
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").unlink()
    (tmp_path / "b.py").write_text(filler + "def f():\n    return 1\n\ndef g(n):\n    import os\n    os.remove(str(n))\n")
    (tmp_path / "c.py").write_text(body.format("new"))
    run("add", ".")
    run("commit", "-qm", "two")
    got = sorted((r["version"], r["old"], r["new"], r["scope"]) for r in G.function_links(spark, repo).collect())
    assert got == [(2, "a.py::f", "b.py::f", "file"), (2, "a.py::g", "b.py::g", "file"), (2, "c.py::old", "c.py::new", "function")]


def test_reindex_stream(spark, tmp_path):
    from sextant.streaming.reindex import reindex_stream

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "row long, content_hash string, text string"
    seen = []

    def encode(work):
        seen.append(sorted(r["content_hash"] for r in work.collect()))
        return work.withColumn("embedding", F.array(F.lit(1.0)))

    for batch in ([(1, "a", "x"), (2, "a", "x")], [(3, "a", "x"), (4, "b", "y")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(source)
        reindex_stream(stream, out, encode, str(tmp_path / "check")).awaitTermination()
    assert seen == [["a"], ["b"]]
    assert json.dumps(sorted(os.listdir(os.path.join(out, "rows")))) == '["batch=0", "batch=1"]'


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "dense_topk" in e.queries()
