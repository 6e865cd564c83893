"""Sinks: registry, uploads, accepted plans."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.model import Project, Refused
from corvane.operators.change_plan import rejection, resolved
from corvane.session import tasks
from corvane.sources.files import ProjectFiles

#: Files that one task writes at most.
FILES_PER_TASK = 5000


def save_registry(projects: list[Project], path: str) -> None:
    """Overwrite the registry, by way of a second file, so that a reader never sees half of it."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    Path(part).write_text(json.dumps([asdict(p) for p in projects], indent=2), encoding="utf-8")
    os.replace(part, path)


def upload_path(path: Column) -> Column:
    """Slashes for backslashes, without the first component where there are more; null if the rest
    is empty or leaves the root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    rest = F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return F.nullif(F.array_join(resolved(F.array_join(rest, "/")), "/"), F.lit(""))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """One row (path, operation, content) a path, the last by ``pos``, dealt over tasks by their number:
    adaptive execution goes by bytes and would join many small files in one task."""
    last = F.max_by(F.struct(F.lower("operation").alias("operation"), F.col("content")), "pos").alias("r")
    return rows.repartition(tasks(rows.sparkSession, n, FILES_PER_TASK), "path").groupBy("path").agg(last).select("path", "r.operation", "r.content")


def write_files(rows: DataFrame, root: str) -> int:
    """Write or delete the files of (path, operation, content, pos) below ``root``, all or none: tasks
    stage them, the job's end renames them. Of several rows for a path the last by ``pos`` counts.
    Returns how many rows there were."""
    rows.sparkSession.dataSource.register(ProjectFiles)
    n = rows.count()
    try:
        _dealt(rows, n).write.format("project_files").mode("append").option("root", root).save()
    except Exception as e:
        if m := re.search(r"Path traversal attempt blocked: [^\n]*", str(e)):
            raise Refused(m[0]) from None
        raise
    return n


def upload(files: DataFrame, root: str, name: str) -> tuple[Project, int]:
    """Write (path, content) rows below a new project's root; the project and how many there were."""
    project = Project(id=f"upload-{uuid.uuid4().hex}", name=name, repo_root="")
    base = Path(root).resolve() / project.id
    base.mkdir(parents=True, exist_ok=True)
    rows = files.select(upload_path(F.col("path")).alias("path"), F.lit("create").alias("operation"), "content").where("path IS NOT NULL").withColumn("pos", F.monotonically_increasing_id())
    return replace(project, repo_root=str(base)), write_files(rows, str(base))


def apply_plan(files: DataFrame, project: Project) -> DataFrame:
    """Check all entries (pos, path, operation, content), then write and delete; (pos, path) of those
    touched. Nothing is written if one entry is refused. A deletion's target may be missing."""
    why = rejection(F.col("path"), F.col("operation"), F.col("content"), project.extensions(), project.excluded())
    bad = files.select("pos", why.alias("why")).where("why IS NOT NULL").orderBy("pos").first()
    if bad:
        raise Refused(bad.why)
    write_files(files.select(F.array_join(resolved(F.col("path")), "/").alias("path"), "operation", "content", "pos"), project.repo_root)
    return files.select("pos", "path")
