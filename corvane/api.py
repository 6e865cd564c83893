"""The engine: one object for what a user of the service asks for."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import story_text
from corvane.model import RUN_LOG, STORY, NotFound, Project, Settings
from corvane.operators import change_plan, index, lookup, rules
from corvane.operators.prompt import file_block, prompt
from corvane.sources import files as source
from corvane.sources import sinks
from corvane.sources.store import HeldPlans, Snapshots
from corvane.streaming import live, run_log


class Engine:
    """Projects, index, plans. ``embedder`` and ``generate`` (prompt to model text) are supplied by
    the caller; nothing here calls a remote model."""

    def __init__(self, spark: SparkSession, settings: Settings, home: str, embedder: index.Embedder, generate: Callable[[str], str], hint: str = "") -> None:
        self.spark, self.settings, self.home, self.embedder, self.generate, self.hint = spark, settings, home, embedder, generate, hint
        self.pending = HeldPlans(spark, f"{home}/plans")
        self.snapshots = Snapshots(spark, f"{home}/index")
        known = {p.id for p in settings.projects}
        stored = [Project(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items() if v is not None}) for r in source.read_registry(spark, f"{home}/registry.json").collect()]
        self._projects = list(settings.projects)
        for p in stored:
            if p.id not in known:
                known.add(p.id)
                self._projects.append(p)

    # projects and files

    def projects(self) -> DataFrame:
        return source.project_rows(self.spark, self._projects).select("id", "name", "repo_root", "stories_file", "index_file", "test_command", "static_analysis_command")

    def project(self, project_id: str | None = None) -> Project:
        row = lookup.find_by_id(source.project_rows(self.spark, self._projects), project_id, self.settings.active_project).first()
        if row is None:
            raise NotFound(f"Project not found: {project_id}")
        return self._projects[row.pos]

    def upload(self, files: DataFrame, name: str) -> tuple[str, int]:
        project, written = sinks.upload(files, f"{self.home}/uploads", name)
        self._projects.append(project)
        sinks.save_registry(self._projects, f"{self.home}/registry.json")
        return project.id, written

    def files(self, project_id: str) -> DataFrame:
        return source.scan(self.spark, self.project(project_id)).select("path")

    def file(self, project_id: str, path: str) -> str:
        text = source.read_file(source.scan(self.spark, self.project(project_id), self.settings.max_file_chars, only=path), path)
        if text is None:
            raise NotFound(path)
        return text

    def stories(self, project_id: str) -> DataFrame:
        try:
            return source.stories(self.spark, self.project(project_id))
        except NotFound:
            return self.spark.createDataFrame([], STORY)

    # index

    def rebuild_index(self, project_id: str) -> DataFrame:
        """Store the project's index anew; its chunk ids. Texts that were embedded before are not sent
        again; whoever searches meanwhile has the index before."""
        p = self.project(project_id)
        built = index.build(source.scan(self.spark, p, self.settings.max_file_chars), self.embedder, vectors=f"{self.home}/vectors")
        self.snapshots.publish(p.id, built)
        return self._index(p).select(F.concat_ws("#", "path", F.col("chunk_index").cast("string")).alias("chunk_id"))

    def index_exists(self, project_id: str) -> bool:
        return self.snapshots.exists(self.project(project_id).id)

    def _index(self, p: Project) -> DataFrame | None:
        return self.snapshots.open(p.id)

    def search(self, project_id: str, text: str, k: int) -> DataFrame:
        p = self.project(project_id)
        own = self._index(p)
        if own is None:
            self.rebuild_index(p.id)
            own = self._index(p)
        return index.search(own, self.embedder([text[: index.INPUT_CHARS]])[0], k)

    def analysis(self, project_id: str) -> DataFrame:
        return rules.report(rules.findings(source.scan(self.spark, self.project(project_id), self.settings.max_file_chars)))

    # plans

    def plan(self, project_id: str, story: str | dict, run_id: str = "") -> dict:
        """Make a plan for a story (its id, or its fields; without an id it gets one) and hold it for
        review. With a run id the steps are told in the run's log, whose end is always written."""
        tell = run_log.RunLog(self._runs(run_id), run_id) if run_id else lambda msg: None
        try:
            return self._plan(self.project(project_id), {"id": f"adhoc-{int(time.time())}"} | story if isinstance(story, dict) else story, tell)
        finally:
            tell(None)

    def _runs(self, run_id: str) -> str:
        if not re.fullmatch(r"[\w-]+", run_id):
            raise NotFound(f"No such run: {run_id}")
        return f"{self.home}/runs/{run_id}"

    def run_log(self, run_id: str) -> DataFrame:
        """The frames of a run so far, in the order of ``seq``: two opening ones, a message each, one end, at
        the run's own or after silence; nothing follows it."""
        path = self._runs(run_id)
        if not os.path.isdir(path):
            raise NotFound(f"No such run: {run_id}")
        told = live.told(run_log.read_log(self.spark, path, stream=False), until=F.current_timestamp())
        return told.select("run_id", F.col("n").alias("seq"), "frame", (F.col("frame") == run_log.DONE).alias("ends"))

    def follow(self) -> DataFrame:
        """A streaming DataFrame (run_id, n, frame) of all runs as they are told: two opening frames, a
        frame a message, one end at the run's own or after silence."""
        os.makedirs(f"{self.home}/runs", exist_ok=True)
        return live.follow(self.spark.readStream.schema(RUN_LOG).option("recursiveFileLookup", True).json(f"{self.home}/runs"))

    def _plan(self, p: Project, story: str | dict, tell: Callable[[str | None], None]) -> dict:
        tell("Looking for the story and the project's index")
        stories = self.stories(p.id) if isinstance(story, str) else self.spark.createDataFrame([{"priority": "Medium", "acceptanceCriteria": []} | story], STORY)
        hit = lookup.find_by_id(stories.where("id <> ''").withColumn("pos", F.monotonically_increasing_id()), story if isinstance(story, str) else story["id"])
        row = hit.first()
        if row is None:
            raise NotFound(f"Story not found: {story}")
        text = story_text(*[F.lit(row[c]).cast("string") for c in ("id", "title", "description")], F.lit(list(row.acceptanceCriteria or [])) if row.acceptanceCriteria else F.array().cast("array<string>"), F.lit(row.priority).cast("string"))
        checked = self.analysis(p.id).first()
        report = checked.report
        tell(f"Rules: {checked.n_findings} findings")
        files, shown = source.scan(self.spark, p), source.scan(self.spark, p, self.settings.max_file_chars)
        ranked = self.search(p.id, f"{row.title}\n{row.description}", self.settings.max_context_files).select("path", "rank")
        blocks = lookup.load_context(ranked, shown).agg(F.array_sort(F.collect_list(F.struct("rank", file_block(F.col("path"), F.col("content")).alias("b")))).alias("b"))
        head = {"id": F.lit(p.id), "name": F.lit(p.name), "repoRoot": F.lit(p.repo_root)}
        asked = blocks.select(prompt(head, F.lit(p.extensions()), text, F.lit(report), F.transform("b", lambda x: x["b"]), self.hint).alias("p")).first().p
        tell(f"Asking for a plan: {len(asked)} characters")
        reply = change_plan.extract_json(self.generate(asked))
        plan = self.spark.createDataFrame([(json.dumps(reply), row.id)], "j string, s string").select(change_plan.plan_from_json(F.col("j"), F.col("s")).alias("p")).select("p.*").first().asDict(recursive=True)
        rows = [(i, f["path"], f["operation"], f["content"]) for i, f in enumerate(plan["files"])]
        diff = self._diff(files, rows)
        self.pending.hold(p.id, rows, diff)
        tell(f"{len(rows)} files, {diff.count(chr(10))} lines of difference: waiting for review")
        return plan | {"diff": diff, "pending_review": True}

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "pos int, path string, operation string, content string")

    def _diff(self, files: DataFrame, rows: list[tuple]) -> str:
        """Against whole current texts, not truncated ones."""
        new = F.when(F.lower("operation") == "delete", "").otherwise(F.coalesce("content", F.lit("")))
        both = self._rows(rows).select("pos", "path", new.alias("new")).join(files.select("path", F.col("content").alias("old")), "path", "left")
        return "".join(r.d for r in both.select("pos", change_plan.diff("path", "old", "new").alias("d")).orderBy("pos").collect())

    def accept(self, project_id: str) -> dict:
        """Write the held plan. Of several engines that accept at once one gets it; if it is refused or
        fails it stays held."""
        p = self.project(project_id)
        taken = self.pending.claim(p.id)
        if taken is None:
            raise NotFound(f"No pending plan: {project_id}")
        number, state = taken
        try:
            touched = [r.path for r in sinks.apply_plan(self._rows([tuple(r) for r in state["rows"]]), p).orderBy("pos").collect()]
        except BaseException:
            self.pending.settle(p.id, number, state)
            raise
        self.pending.settle(p.id, number, {"state": "accepted"})
        return {"touched": touched, "diff": state["diff"]}

    def reject(self, project_id: str) -> None:
        self.pending.reject(self.project(project_id).id)
