"""Listing on executors, pushed filters, the committing writer, snapshots, held plans, vectors by
content, search by cells, the linear rule."""

import os
import random
import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.api import Engine
from corvane.model import NotFound, Project, Refused, Settings
from corvane.operators import cells, index, rules
from corvane.sources import files as source
from corvane.sources import sinks
from corvane.sources.store import HeldPlans, Snapshots, create, exists, read_text, swap

PLAN = "pos int, path string, operation string, content string"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "app"
    for name, data in {"a.md": b"A\r\n", "src/deep/b.md": b"B", "target/c.md": b"no", "blank.txt": b" ", "x.py": b"x"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (root / "gone.md").symlink_to("nowhere")
    (root / "linked").symlink_to(root / "src")
    return Project("P", repo_root=str(root))


def reader(project, columns=("project_id", "path", "content", "reason")):
    return source._Reader({"root": project.repo_root, "extensions": "md,txt", "excluded": "target"}, list(columns))


def test_one_pass_and_listing(spark, tree):
    got = {r.path: (r.content, r.reason) for r in source.scan_all(spark, tree).collect()}
    assert got == {"a.md": ("A\n", None), "src/deep/b.md": ("B", None), "gone.md": (None, "FileNotFoundError")}
    assert {r.path for r in source.listing(spark, tree).collect()} == {"a.md", "src/deep/b.md", "gone.md", "blank.txt"}


def test_filters_reach_the_source(spark, tree, monkeypatch):
    """A path asked for is opened alone; a listing opens none."""
    asked = source.scan(spark, tree).where("path = 'a.md'")
    assert "= a.md" not in asked._jdf.queryExecution().optimizedPlan().toString() and asked.first().content == "A\n"
    from pyspark.sql.datasource import EqualTo, In, IsNull

    opened = []
    monkeypatch.setattr("builtins.open", lambda p, *a, own=open, **k: (opened.append(str(p)), own(p, *a, **k))[1])
    r = reader(tree)
    left = list(r.pushFilters([EqualTo(("path",), "src/deep/b.md"), IsNull(("reason",))]))
    assert [type(f) for f in left] == [IsNull] and len(r.partitions()) == 1
    assert [x for p in r.partitions() for x in r.read(p)] == [("", "src/deep/b.md", "B", None)] and len(opened) == 1
    r = reader(tree)
    list(r.pushFilters([In(("path",), ("a.md", "x.py", "linked/deep/b.md", "../app/a.md", "target/c.md", "none.md", "src", "", "./a.md"))]))
    assert [x[1] for p in r.partitions() for x in r.read(p)] == ["a.md"]
    opened.clear()
    r = reader(tree, ("path",))
    assert sorted(x[0] for p in r.partitions() for x in r.read(p)) == ["a.md", "blank.txt", "gone.md", "src/deep/b.md"] and not opened
    assert source.scan(spark, tree, only="a.md").first().content == "A\n"
    assert source.read_file(source.scan(spark, tree, 1), "a.md") == "A\n...[TRUNCATED]"


def test_many_files(spark, tmp_path):
    """A folder of many files is cut; the driver's partitions name folders, not files."""
    root = tmp_path / "many"
    for folder, n in (("big", 20_000), *((f"s{i}", 3) for i in range(300))):
        (root / folder).mkdir(parents=True)
        for i in range(n):
            (root / folder / f"{i}.md").touch()
    r = reader(Project("p", repo_root=str(root)), ("path",))
    parts = r.partitions()
    assert len(parts) == 40 + 2 + 0 and sum(len(p.parts) for p in parts) == 40 + 300
    assert max(sum(1 for _ in r.read(p)) for p in parts) < 1000
    got = source.listing(spark, Project("p", repo_root=str(root)))
    assert got.count() == got.distinct().count() == 20_900


def test_unlistable_folder(tree, monkeypatch):
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError()) if str(p).endswith("deep") else real(p))
    r = reader(tree)
    assert ("", "src/deep", None, "PermissionError") in [x for p in r.partitions() for x in r.read(p)]


def test_writer_commits_or_leaves_nothing(spark, tree):
    root = tree.repo_root
    rows = [(0, "n/new.md", "create", "1"), (1, "n/new.md", "modify", "2"), (2, "a.md", "DELETE", None), (3, "n/gone.md", "create", "x"), (4, "./n/gone.md", "delete", ""), (5, "none.md", "delete", None), (6, "src/deep/b.md", "delete", None), (7, "src/deep/b.md", "create", "B2")]
    touched = sinks.apply_plan(spark.createDataFrame(rows, PLAN).repartition(4), tree)
    assert [r.path for r in touched.orderBy("pos").collect()] == [r[1] for r in rows]
    assert open(f"{root}/n/new.md").read() == "2" and open(f"{root}/src/deep/b.md").read() == "B2"
    assert not os.path.exists(f"{root}/a.md") and not os.path.exists(f"{root}/n/gone.md")
    before = sorted(os.listdir(os.path.dirname(root)))
    many = [(i, f"m/{i}.md", "create", "x") for i in range(50)]
    for bad in ([*many, (99, "linked/../../out.md", "create", "x")], [*many, (99, "linked/evil.md", "create", "x")]):
        os.path.islink(f"{root}/linked") and os.unlink(f"{root}/linked")
        os.symlink("/tmp", f"{root}/linked")
        with pytest.raises(Refused, match="traversal"):
            sinks.apply_plan(spark.createDataFrame(bad, PLAN).repartition(8), tree)
        assert not os.path.exists(f"{root}/m") and sorted(os.listdir(os.path.dirname(root))) == before

    def fail(parts):
        for p in parts:
            if (p["pos"] == 40).any():
                raise RuntimeError("lost")
            yield p

    with pytest.raises(Exception, match="lost"):
        sinks.write_files(spark.createDataFrame(many, PLAN).repartition(8).mapInPandas(fail, PLAN), root)
    assert not os.path.exists(f"{root}/m") and sorted(os.listdir(os.path.dirname(root))) == before


@pytest.fixture(params=["local", "mounted"])
def home(request, spark, tmp_path):
    """A plain folder, and one that only Hadoop's file systems know."""
    if request.param == "local":
        return str(tmp_path)
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.m{os.getpid()}{tmp_path.name[-1]}{abs(hash(str(tmp_path)))}.link./in", f"file://{tmp_path}")
    return f"viewfs://m{os.getpid()}{tmp_path.name[-1]}{abs(hash(str(tmp_path)))}/in"


def test_records(spark, home):
    assert read_text(spark, f"{home}/r/x.json") is None and not exists(spark, f"{home}/r")
    for text in ("one", "twö"):
        swap(spark, f"{home}/r/x.json", text)
        assert read_text(spark, f"{home}/r/x.json") == text
    assert create(spark, f"{home}/r/y.json", "first") and not create(spark, f"{home}/r/y.json", "second")
    assert read_text(spark, f"{home}/r/y.json") == "first"


def test_snapshots(spark, home):
    store, rows = Snapshots(spark, f"{home}/index"), lambda n: spark.range(n).selectExpr("id", "'x' AS path")
    assert not store.exists("p/ä") and store.open("p/ä") is None
    store.publish("p/ä", rows(3))
    old = store.open("p/ä")
    with pytest.raises(Exception, match="boom"):
        store.publish("p/ä", rows(9).withColumn("id", F.expr("CASE WHEN id = 5 THEN raise_error('boom') ELSE id END").cast("long")))
    assert store.open("p/ä").count() == 3
    store.publish("p/ä", rows(5))
    assert (old.count(), store.open("p/ä").count()) == (3, 5)  # who has begun to read can finish
    store.publish("p/ä", rows(0))
    assert store.open("p/ä").count() == 0 and store.open("p/ä").columns == ["id", "path"] and store.exists("p/ä") and not store.exists("p")


def test_held_plans(spark, home):
    one, two = HeldPlans(spark, f"{home}/plans"), HeldPlans(spark, f"{home}/plans")
    assert one.claim("P") is None
    one.hold("P", [[0, "a.md", "create", "x"]], "diff")
    number, state = two.claim("p")
    assert state["rows"] == [[0, "a.md", "create", "x"]] and one.claim("P") is None
    assert two.settle("p", number, state) and one.latest("p")[1]["state"] == "held"
    one.reject("P")
    assert two.claim("P") is None and two.latest("P")[1] == {"state": "rejected"}
    one.hold("P", [], "second")
    number, state = one.claim("P")
    two.hold("P", [], "newer")
    assert not one.settle("P", number, {"state": "accepted"}) and two.claim("P")[1]["diff"] == "newer"


def test_one_of_many_claims(spark, tmp_path):
    for _ in range(5):
        HeldPlans(spark, str(tmp_path)).hold("p", [], "d")
        won = []
        threads = [threading.Thread(target=lambda: won.append(HeldPlans(spark, str(tmp_path)).claim("p"))) for _ in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert sum(w is not None for w in won) == 1


def counting(log):
    """An embedder that tells each text it is asked for to a file, and fails on some."""

    class Counting:
        name = "counting"

        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no vector")
            with open(log, "a") as f:
                f.writelines(f"{t!r}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

    return Counting()


def test_vectors_by_content(spark, tmp_path):
    def calls():
        text = open(tmp_path / "log").read().splitlines() if os.path.exists(tmp_path / "log") else []
        open(tmp_path / "log", "w").close()
        return sorted(text)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a", "a", "bad", "token=abc"])], "i int, t string")
    got = {r.i: (r.embedding, r.norm) for r in index.embed_new(rows, F.col("t"), counting(str(tmp_path / "log")), str(tmp_path / "v")).collect()}
    assert calls() == ["'a'", "'bb'", "'token=[REDACTED]'"]
    assert got[0][0] == got[2][0] == [1.0, 1.0] and got[4] == ([], 0.0) and got[5][0] == [16.0, 1.0]
    more = rows.unionByName(spark.createDataFrame([(9, "new"), (10, "a")], "i int, t string"))
    assert index.embed_new(more, F.col("t"), counting(str(tmp_path / "log")), str(tmp_path / "v")).count() == 8 and calls() == ["'new'"]
    assert index.embed_new(rows.where("t <> 'bad'"), F.col("t"), counting(str(tmp_path / "log")), str(tmp_path / "v")).count() == 5 and calls() == []


def test_two_engines_on_one_home(spark, tree, tmp_path):
    """A rebuild of an unchanged project asks for no vector; a plan survives a restart and is accepted once."""
    log = str(tmp_path / "log")
    reply = lambda prompt: '{"summary": "s", "files": [{"path": "new.md", "operation": "create", "content": "hi\\n"}, {"path": "a.py", "operation": "create", "content": "x"}]}'
    make = lambda: Engine(spark, Settings(projects=(tree,)), str(tmp_path / "home"), counting(log), reply)
    one = make()
    assert not one.index_exists("p") and one.rebuild_index("p").count() == 2 and one.index_exists("p")
    os.unlink(log)
    two = make()
    assert two.rebuild_index("p").count() == 2 and not os.path.exists(log)
    one.plan("p", {"title": "t", "description": "d"}, "run")
    with pytest.raises(Refused):
        two.accept("p")
    assert make().pending.latest("p")[1]["state"] == "held"
    plain = '{"summary": "s", "files": [{"path": "new.md", "operation": "create", "content": "hi\\n"}]}'
    one.generate = lambda prompt: plain
    one.plan("p", {"title": "t", "description": "d"})
    assert make().accept("p")["touched"] == ["new.md"]
    with pytest.raises(NotFound):
        one.accept("p")
    assert one.follow().isStreaming


def test_search_by_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 16))
    x = middle[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.15
    x[:30] = x[0]  # ties
    rows = [(f"p{i % 900}", i, v.tolist()) for i, v in enumerate(x)] + [("zero", 0, [0.0] * 16), ("short", 0, [1.0]), ("none", 0, None), ("nan", 0, [float("nan")] * 16), ("hole", 0, [None] * 16)]
    df = spark.createDataFrame(rows, "path string, chunk_index int, embedding array<double>").cache()
    cells.store_cells(df, str(tmp_path / "c"))
    for q, k in ((x[0], 5), (x[0], 40), (x[77] + 0.05, 10), (rng.normal(size=16), 3), (-x[5], 4)):
        found = cells.search_cells(spark, str(tmp_path / "c"), q, k)
        want = [(r.path, round(r.score, 9)) for r in index.search(df, q.tolist(), k).orderBy("rank").collect()]
        assert [(r.path, round(r.score, 9)) for r in found.rows.orderBy("rank").collect()] == want
    near = [cells.search_cells(spark, str(tmp_path / "c"), x[i] + 0.02, 4) for i in (100, 200, 300)]
    assert all(f.chunks == 6005 and f.chunks_read < 0.2 * f.chunks for f in near)
    for q, k in (([0.0] * 16, 3), ([1.0], 2), ([], 2), (x[0].tolist(), 2000)):
        found, want = cells.search_cells(spark, str(tmp_path / "c"), q, k).rows, index.search(df, q, k)
        assert found.count() == want.count()
    cells.store_cells(df.limit(0), str(tmp_path / "e"))
    assert cells.search_cells(spark, str(tmp_path / "e"), x[0], 3).rows.count() == 0


SWALLOWED = re.compile(r"catch\s*\(.*?Exception.*?\)\s*\{\s*\}", re.DOTALL)


def test_swallowed_rule_is_linear(spark):
    rng = random.Random(3)
    parts = ["catch", " ", "(", ")", "{", "}", "Exception", "e", "\n", "catch (", "){}", ") { }", "\x1c", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(10_000)]
    pattern = next(p for n, p, _ in rules.RULES if n == "swallowed")
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).orderBy("i").select(F.col("t").rlike(pattern).alias("x")).collect()]
    want = [SWALLOWED.search(t) is not None for t in texts]
    assert got == want and 500 < sum(want) < 9500
    for hostile in ("catch (Exception " * 60_000, "catch (Exception )" * 60_000, "catch (Exception ){ " * 50_000, "catch " + " " * 1_000_000, "catch (Exception )" + " {" * 500_000, "catch (" * 150_000):
        df = spark.createDataFrame([(hostile,)], "t string").cache()
        df.count()
        began = time.perf_counter()
        assert df.select(F.col("t").rlike(pattern).alias("x")).first().x is False
        assert time.perf_counter() - began < 3


def test_parts_of_a_folder_are_bounded(spark, tmp_path, monkeypatch):
    """Each part passes all of a folder's names, so their number ends; every file is found once."""
    for i in range(3000):
        (tmp_path / f"{i}.md").touch()
    monkeypatch.setattr(source, "PATHS_PER_TASK", 10)
    r = reader(Project("p", repo_root=str(tmp_path)), ("path",))
    parts = [p for p in r.partitions() if p.parts]
    assert len(parts) == source.MOST_PARTS
    assert sorted(x[0] for p in parts for x in r.read(p)) == sorted(f"{i}.md" for i in range(3000))


def test_small_files_are_written_by_many_tasks(spark):
    """Few bytes are not little work: adaptive execution may not join them in one task."""
    rows = spark.range(4000).selectExpr("concat(id % 2000, '.md') AS path", "'create' AS operation", "'x' AS content", "id AS pos")
    assert sinks._dealt(rows, 4000).select(F.spark_partition_id()).distinct().count() >= 8
    assert sinks._dealt(rows, 4000).count() == 2000


def test_stories_are_read_whole(spark, tmp_path):
    """Many arrays make as many files, and what follows a file's array is not passed over."""
    from corvane.plans.catalog import QUERIES

    rows = spark.range(1, 20_001).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "int(id % 25) AS c_nationkey", "double(0) AS c_acctbal", "'X' AS c_mktsegment")
    rows.coalesce(1).write.parquet(f"{tmp_path}/d/customer.parquet")
    assert QUERIES["stories_read"](spark, f"{tmp_path}/d").distinct().count() == 20_000
    (tmp_path / "s.json").write_text('﻿[{"id": "a"},\n {"id": "b", "priority": "High"}]\n')
    project = Project("p", stories_file=str(tmp_path / "s.json"))
    assert [(r.id, r.priority) for r in source.stories(spark, project).collect()] == [("a", "Medium"), ("b", "High")]
    (tmp_path / "s.json").write_text('[{"id": "a"}]\n[{"id": "b"}]\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        source.stories(spark, project).collect()


def test_long_prompts_are_dealt_over_tasks(spark, sf_dir):
    from corvane.operators.prompt import capped
    from corvane.plans.catalog import QUERIES

    assert QUERIES["prompt_hint"](spark, sf_dir).select(F.spark_partition_id()).distinct().count() > 1
    texts = ["é" * 63_999, "é" * 64_000, "é" * 64_001, "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(capped(F.col("t"), "!").alias("t"))
    assert [r.t for r in got.collect()] == [texts[0] + "!", texts[1] + "!", texts[1] + "\n...[TRUNCATED]!", "!", "!"]
