"""Plans, sources, sinks, the engine and the run log."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.api import Engine
from corvane.model import BadPlan, NotFound, Project, Refused, Settings
from corvane.operators import change_plan as cp
from corvane.operators import index, lookup
from corvane.sources import files as source
from corvane.sources import sinks
from corvane.streaming import run_log


def test_extract_json():
    assert cp.repair_json('{"a":[1,{"b":"q') == '{"a":[1,{"b":"q"}]}'
    assert cp.repair_json('{"a": "x\\" {[') == '{"a": "x\\" {["}'
    assert cp.repair_json('{"a": ""') == '{"a": ""}'
    assert cp.extract_json('say ```json\n{"a": 1}\n``` ok') == {"a": 1}
    assert cp.extract_json('x {"a": {"b": 2}} y') == {"a": {"b": 2}}
    assert cp.extract_json('x {"a": [1, {"b": "q') == {"a": [1, {"b": "q"}]}
    for bad in ('{"a":1,', '{"a": "x\\', "none", ""):
        with pytest.raises(BadPlan):
            cp.extract_json(bad)


def test_plan_columns(spark):
    texts = ['{"files":[{"path":"a.md","operation":"Delete"},{"path":"b.md","operation":"modify","content":""},{"operation":"x"}]}', '{"storyId":"s","summary":"m","notes":["n"]}', "[1] trailing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(cp.parse_reply("t").alias("r"))
    got = df.select(cp.plan_from_json(F.col("r.json"), F.lit("mine")).alias("p"), cp.plan_from_json(F.col("r.json"), F.lit("mine"), True).alias("q"), "r.error").collect()
    assert got[0].p.storyId == "mine" and [f.path for f in got[0].p.files] == ["a.md"] and got[0].q is None
    assert got[1].q.notes == ["n"] and got[1].p.summary == "m"
    assert got[2].error.startswith("Could not parse")


def test_rejection(spark):
    rows = [("a.md", "rename", "x", None), (" ", "x", "x", "empty path"), ("a.md", "", "x", "empty operation"), ("../a.md", "x", "x", "traversal"), ("/etc/a.md", "x", "x", "traversal"), ("a/../.git/x.md", "x", "x", "excluded"), (".git", "x", "x", "Extension"), ("a.md", "DELETE", "x", "must be null"), ("a.md", "delete", " \n", None), ("a.md", "modify", " ", "required for modify"), ("A.MD", "x", "x" * 40000, None), ("a.md", "x", "x" * 40001, "too large"), ("noext", "x", "x", "Extension")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, o string, c string, want string")
    why = cp.rejection(F.col("p"), F.col("o"), F.col("c"), ["md"], [".git"])
    for r in df.withColumn("why", why).orderBy("i").collect():
        assert (r.why is None) if r.want is None else (r.want in (r.why or "")), r


def test_diff_and_reply(spark):
    df = spark.createDataFrame([("p", "a\n", "a\nb\n"), ("p", "a", "a")], "p string, o string, n string")
    got = [r.d for r in df.select(cp.diff("p", "o", "n").alias("d")).collect()]
    assert got == ["diff --git a/p b/p\n--- a/p\n+++ b/p\n@@ -1 +1,2 @@\n a\n+b\n", ""]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "app"
    for name, data in {"src/A.JAVA": b"class A {}\r\n// TODO\r", ".hidden.md": b"h\xffi", ".git/x.md": b"no", "sub/.json": b"{}", "b.txt": b" \n", "c.py": b"x", "deep/.k/d.md": b"deep", "_u.yml": b"k: v"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (root / "gone.md").symlink_to(root / "nowhere")
    return root


def test_scan(spark, tree):
    p = Project("P", repo_root=str(tree))
    got = {r.path: r.content for r in source.scan(spark, p).collect()}
    assert got == {"src/A.JAVA": "class A {}\n// TODO\n", ".hidden.md": "hi", "deep/.k/d.md": "deep", "_u.yml": "k: v"}
    assert [r.path for r in source.scan(spark, p, rejects=True).collect()] == ["gone.md"]
    assert source.read_file(source.scan(spark, p), ".git/x.md") is None
    assert [r.path for r in source.scan(spark, p, only="deep/.k/d.md").collect()] == ["deep/.k/d.md"]
    assert source.scan(spark, p, only=".git/x.md").count() == source.scan(spark, p, only="../app/b.md").count() == source.scan(spark, p, only="").count() == 0
    with pytest.raises(NotFound):
        source.scan(spark, Project("x", repo_root="/no/such"))


def test_engine(spark, tree, tmp_path):
    stories = tmp_path / "s.json"
    stories.write_text(json.dumps([{"id": "S-1", "title": "T", "description": "D", "acceptanceCriteria": ["x"]}], indent=2))
    asked = []

    def reply(prompt):
        asked.append(prompt)
        return 'ok {"summary": "s", "files": [{"path": "new/n.md", "operation": "create", "content": "hello\\n"}, {"path": "_u.yml", "operation": "delete"}], "notes": ["'

    (tree / "long.md").write_text("deep " * 3000)
    settings = Settings(projects=(Project("App", "app", str(tree), str(stories)),), max_context_files=5, max_file_chars=300)
    e = Engine(spark, settings, str(tmp_path / "home"), index.HashingEmbedder(16), reply, "\n\nhint")
    assert e.project("aPP").id == "App" and e.project().id == "App" and e.projects().count() == 1
    assert e.stories("app").first().priority == "Medium" and e.file("app", "_u.yml") == "k: v"
    assert {r.chunk_id for r in e.rebuild_index("app").collect()} == {"src/A.JAVA#0", ".hidden.md#0", "deep/.k/d.md#0", "_u.yml#0", "long.md#0"}
    assert [r.rank for r in e.search("app", "deep", 0).collect()] == [1]
    plan = e.plan("app", "s-1", "run-1")
    told = e.run_log("run-1").orderBy("seq").collect()
    assert [r.frame for r in told[:2]] == list(run_log.OPENING) and told[-1].frame == run_log.DONE and told[-1].ends and len(told) > 5
    assert e.plan("app", {"title": "Only a title"})["storyId"].startswith("adhoc-")
    with pytest.raises(NotFound):
        e.plan("app", "no such story", "run-2")
    assert e.run_log("run-2").orderBy("seq").collect()[-1].ends
    for bad in ("none", "../x"):
        with pytest.raises(NotFound):
            e.run_log(bad)
    plan = e.plan("app", "s-1")
    assert asked[0].startswith("ROLE:") and asked[0].endswith("\n\nhint") and "acceptanceCriteria: ['x']" in asked[0] and "contains TODO" in asked[0]
    assert "deep " * 60 + "\n...[TRUNCATED]" in asked[0] and "deep " * 61 not in asked[0]  # context is capped as the index is
    assert plan["storyId"] == "S-1" and "+hello" in plan["diff"] and "-k: v" in plan["diff"] and plan["notes"] == [""]
    assert e.accept("APP")["touched"] == ["new/n.md", "_u.yml"] and (tree / "new/n.md").read_text() == "hello\n" and not (tree / "_u.yml").exists()
    with pytest.raises(NotFound):
        e.accept("app")
    e.reject("app")
    up = spark.createDataFrame([("my\\src\\a.md", "A"), ("my/../../b.md", "B"), ("c.md", None)], "path string, content string")
    pid, n = e.upload(up, "mine")
    assert n == 2 and {r.path for r in e.files(pid).collect()} == {"src/a.md"}
    again = Engine(spark, settings, str(tmp_path / "home"), index.HashingEmbedder(16), reply)
    assert again.projects().count() == 2
    with pytest.raises(NotFound):
        e.file("app", "../x")


def test_apply_is_checked_first(spark, tree):
    rows = spark.createDataFrame([(0, "ok.md", "create", "x"), (1, "bad.exe", "create", "x")], "pos int, path string, operation string, content string")
    with pytest.raises(Refused):
        sinks.apply_plan(rows, Project("P", repo_root=str(tree)))
    assert not (tree / "ok.md").exists()


def test_settings(tmp_path):
    f = tmp_path / "c.yml"
    f.write_text("bedrock:\n  region: r1\n  max_tokens: 7\nagent:\n  max_context_files: 4\n")
    pytest.importorskip("yaml")
    s = Settings.load(str(f), {"AWS_REGION": "r2"})
    assert (s.region, s.max_tokens, s.max_context_files, s.temperature) == ("r2", 7, 4, 0.1)
    assert Settings.load(str(tmp_path / "none"), {}) == Settings()


def test_lookup_and_merge(spark):
    rows = spark.createDataFrame([("B", 0), ("a", 1), ("A", 2)], "id string, pos int")
    assert lookup.find_by_id(rows, "A").first().pos == 1 and lookup.find_by_id(rows, None).first().id == "B"
    assert lookup.find_by_id(rows, "z").count() == 0 and lookup.find_by_id(rows, "", "b").first().pos == 0
    kept = spark.createDataFrame([("A", 9), ("n", 8), ("n", 7)], "id string, pos int")
    assert sorted(lookup.merge_registry(rows, kept).collect()) == [("A", 2), ("B", 0), ("a", 1), ("n", 7)]
    got = spark.createDataFrame([], "op string").agg(lookup.operations_summary(F.col("op")).alias("x")).first().x
    assert got == "none"


def test_search_ties(spark):
    rows = [(p, i, [float(x), 1.0]) for p, i, x in [("b", 0, 1), ("a", 1, 1), ("a", 0, 0), ("c", 0, 5)]]
    df = spark.createDataFrame(rows, "path string, chunk_index int, embedding array<double>")
    assert [r.path for r in index.search(df, [1.0, 1.0], 9).orderBy("rank").collect()] == ["a", "b", "c"]
    assert index.search(df, [1.0, 1.0], 0).count() == 1 and index.search(df, [], 3).count() == 0 and index.search(df.limit(0), [1.0], 3).count() == 0


def test_index_parts(spark, tmp_path):
    for pid in ("one", "two", "one"):
        index.store(spark.createDataFrame([(pid, 1)], "path string, n int"), str(tmp_path / "i"), pid)
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "i")).collect()) == ["one", "two"]


def test_log_stream(spark, tmp_path):
    rows = [("r", 0, "a", "2026-01-01T00:00:00Z"), ("r", 1, "b", "2026-01-01T00:01:00Z"), ("r", 2, None, "2026-01-01T01:00:00Z")]
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/x.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "seq", "msg", "ts"), r))) for r in rows))
    q = run_log.sessions(run_log.read_log(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("log_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n_msgs for r in spark.table("log_out").collect()) == [0, 2]
    got = run_log.frames(spark.read.json(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))).orderBy("seq").collect()
    assert [r.ends for r in got] == [False, True, True] and got[2].frame == run_log.DONE and json.loads(got[0].frame[6:]) == {"msg": "a"}


def test_progress(spark):
    rows = [("r", i, "x" * n) for i, n in enumerate([299, 1, 0, 599, 1, 2000, 1, 1, 1])]
    got = run_log.progress(spark.createDataFrame(rows, "run_id string, seq long, delta string")).first()
    assert got.n_chars == 2903 and got.reports == "300,900,2900,2901,2902"[: len(got.reports)] and got.reports.startswith("300,900,2900")
