import json
import os
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from sextant.agent import CodeAgent
from sextant.server import Application, answer, serve
from sextant.sources import encoders as E
from sextant.sources import files as S
from sextant.sources.index import load_index, verify_index, write_index
from sextant.sources.reindex import ReindexError, check_name, reindex_index, reindexable

CODE = {"a.py": "def alpha(items):\n    total = sum(items)\n    return total\n", "b.py": "import os\n\ndef beta(path):\n    data = os.listdir(path)\n    return sorted(data)\n"}


@pytest.fixture
def index(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    for name, text in CODE.items():
        (source / name).write_text(text)
    encoder = E.hashing()
    chunks, stats = S.chunk_folder(spark, str(source))
    assert stats["oversize"] == 0
    rows = chunks.withColumn("row", F.xxhash64("chunk_id")).withColumn("doc_id", F.col("chunk_id")).withColumn("ast_family", F.lit("other"))
    write_index(rows.join(encoder.encode_docs(rows), "row"), str(tmp_path / "index"), source_root=str(source), task="folder", **encoder.manifest())
    return source, str(tmp_path / "index")


def test_reindex(spark, index):
    source, folder = index
    asked = []

    def encode(work):
        asked.append(work.count())
        return E.hashing().encode_docs(work, "hash")

    same = reindex_index(spark, folder, encode)
    assert (same["unchanged"], same["written"], same["embeddings_recomputed"]) == (2, False, 0) and not asked
    (source / "a.py").write_text(CODE["a.py"].replace("sum", "max"))
    (source / "c.py").write_text(CODE["b.py"].replace("b.py", "c.py"))
    plan = reindex_index(spark, folder, encode, dry_run=True)
    assert (plan["modified"], plan["added"], plan["embeddings_recomputed"], plan["written"]) == (1, 1, 1, False) and not asked
    done = reindex_index(spark, folder, encode)
    assert done["written"] and done["categories_dropped"] and asked == [1] and verify_index(spark, folder) == []
    rows, manifest = load_index(spark, folder)
    assert manifest["n_docs"] == 3 and manifest["last_reindex"]["modified"] == 1 and "ast_family" not in rows.columns
    assert reindex_index(spark, folder, encode)["written"] is False and asked == [1]


def test_reindex_guards(spark, index, tmp_path):
    _, folder = index
    assert reindexable(folder)["kind"] == "folder" and not reindexable(folder, [folder])["reindexable"]
    with pytest.raises(ReindexError) as e:
        reindex_index(spark, str(tmp_path / "none"), lambda w: w)
    assert e.value.status == 404
    for bad in ("", "x\0", 5, "/etc", "y" * 600):
        with pytest.raises(ReindexError):
            check_name(bad, {"main": folder}, "main", {"ALLOWED_INDEXES": "extra, more"})
    assert check_name("more", {}, None, {"ALLOWED_INDEXES": "extra, more"}) == "more"


def test_http(spark, index):
    _, folder = index
    app = Application(spark, {"main": folder}, encode=lambda work: E.hashing().encode_docs(work, "hash"))
    server = serve(app, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert json.load(urllib.request.urlopen(f"{url}/health"))["index"]["n_docs"] == 2
        hits = json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/search", json.dumps({"query": "alpha total items", "k": 1}).encode())))["hits"]
        assert hits[0]["doc_id"] == "a.py:1-3"
    finally:
        server.shutdown()
    assert answer(app, "GET", "/nothing")[0] == 404 and answer(app, "GET", "/doc?doc_id=zzz")[0] == 404
    assert answer(app, "POST", "/search", b'{"query": 5}')[0] == 400 and answer(app, "GET", "/health?index=/etc")[0] == 400
    assert answer(app, "GET", "/route?query=who%20calls%20beta")[1]["intent"] == "who_calls" and answer(app, "POST", "/agent", b'{"question": "x"}')[0] == 404
    assert answer(app, "POST", "/reindex", b'{"dry_run": true}')[1]["unchanged"] == 2 and answer(app, "GET", "/indexes")[1]["indexes"] == ["main"]
    assert answer(app, "GET", "/describe")[1]["chunked"] and app.service(None).performance("a b")["truncated"] is False


def test_encoders(spark, rows):
    assert (E.query_cap(None), E.query_cap(0), E.query_cap("7")) == (1024, None, 7)
    seen = []

    def embed(frame):
        seen.append(sorted(r["text"] for r in frame.collect()))
        return frame.withColumn("embedding", F.array(F.lit(1.0)))

    e = E.make_encoder({"model": "m", "dim": 1, "query_prefix": "Q: ", "doc_prefix": "D: "}, {"m": embed}, cap=2)
    d = spark.createDataFrame([("1", "one two three"), ("2", None)], "qid string, text string")
    e.encode_queries(d)
    e.encode_docs(d, "qid")
    assert seen == [["Q: ", "Q: one two "], ["D: ", "D: one two three"]]
    assert E.make_encoder({"dim": 64}).model == E.HASHING
    with pytest.raises(LookupError):
        E.make_encoder({"model": "other", "dim": 3})
    with pytest.raises(ValueError):
        E.make_encoder({"dim": 64}, transform="narrative")


def test_guards_and_caches(spark, tmp_path, rows):
    read = lambda: (spark.createDataFrame([("d",)], "doc_id string"), spark.createDataFrame([("q", "t"), ("p", " "), ("o", "t")], "qid string, text string"), spark.createDataFrame([("q", "d", 1), ("q", "x", 1), ("p", "d", 1), ("o", "d", 0)], "qid string, doc_id string, gain int"))
    with pytest.raises(PermissionError):
        S.load_test(read)
    assert [r["qid"] for r in S.load_test(read, True)[1].collect()] == ["q"] and rows(S.load_test(read, True)[2]) == [("q", "d", 1)]
    docs = spark.createDataFrame([(1, "a")], "row long, text string")
    with pytest.raises(S.CacheMissError):
        S.cached_only(docs, str(tmp_path / "v"), "m")
    S.cached_vectors(docs, lambda x: x.withColumn("embedding", F.array(F.lit(1.0))), str(tmp_path / "v"), "m", "docs")
    assert S.cached_only(docs, str(tmp_path / "v"), "m").count() == 1
    asked = []

    def call(missing):
        asked.append(missing.count())
        return S.mock_replies(missing)

    prompts = spark.createDataFrame([("PROBLEM:\nadd numbers\nCODE:\nadd numbers",), ("hello",), ("hello",), (None,)], "prompt string")
    for _ in range(2):
        got = {r["prompt"]: r["reply"] for r in S.cached_replies(prompts, call, str(tmp_path / "replies")).collect()}
    assert asked == [2] and got["hello"] == "mock response" and json.loads(got[prompts.first()["prompt"]])["score"] == 1.0 and got[None] is None


def test_agent(spark):
    files = spark.createDataFrame([("a.py", "def load(p):\n    return open(p)\n\ndef main():\n    load('x')\n    save('y')\n"), ("b.py", "def save(p):\n    pass\n")], "file string, text string")
    agent = CodeAgent(spark, files)
    order = agent.run("which files call load before save?")
    assert order["steps"][0].tool == "call_order" and order["answers"][0]["first_line"] == 5
    where = agent.run("where is pkg.save defined?")
    assert any(s.tool == "read" and s.results[0]["text"].startswith("def save") for s in where["steps"])


def test_local_paths_only_where_they_are(spark, tmp_path):
    os.makedirs(tmp_path / "a b+c")
    (tmp_path / "a b+c" / "x.py").write_text("x = 1\n")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert [r["file"] for r in S.read_sources(spark, root).collect()] == ["a b+c/x.py"]


def test_history_index_and_categories(spark, tmp_path):
    import subprocess

    from sextant.service import SearchService
    from sextant.sources.build import build_categories, build_history_index
    from sextant.sources.git import tracked_history

    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    body = "def {}(items):\n    total = 0\n    for x in sorted(items):\n        total += {}\n    return total\n"
    for name, step in (("first", "x"), ("second", "x"), ("second", "2 * x")):
        (repo / "a.py").write_text(body.format(name, step))
        run("add", ".")
        run("commit", "-qm", "step")
    got = {r["version"]: r for r in tracked_history(spark, str(repo)).collect()}
    assert {v: (r["key"], r["lineage_id"], r["change"], r["link_kind"]) for v, r in got.items()} == {1: ("a.py::first", "a.py::first", "added", None), 2: ("a.py::second", "a.py::first", "modified", "rename"), 3: ("a.py::second", "a.py::first", "modified", None)}
    folder = str(tmp_path / "index")
    assert build_history_index(spark, str(repo), folder, E.hashing())["n_docs"] == 3
    service = SearchService.open(spark, folder)
    assert service.describe()["versions"] == [1, 2, 3] and service.search("total items", 5).count() == 1 and service.diff("a.py::first", 2, 3)["added"] == 1
    assert reindex_index(spark, folder, lambda w: w)["unchanged"] == 3
    assert build_categories(spark, folder, 2)["families"] == {"sorting": 3}
    assert SearchService.open(spark, folder).search("total", 3, category="sorting").count() == 1


def test_router_asks_only_when_unsure(spark):
    from sextant.operators.pipeline import routed

    d = spark.createDataFrame([("a", "who calls"), ("b", "sort a list of numbers"), ("c", None)], "qid string, text string")
    asked = []

    def ask(rows):
        asked.extend(r["qid"] for r in rows.collect())
        return rows.select("qid", F.when(F.col("qid") == "a", "code_query").otherwise("nonsense").alias("kind"))

    got = {r["qid"]: (r["kind"], r["source"]) for r in routed(d, ask).collect()}
    assert sorted(asked) == ["a", "c"] and got["a"] == ("code_query", "asked") and got["b"][1] == got["c"][1] == "rules"
