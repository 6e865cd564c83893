"""Sources: a project's files as a Spark data source, stories, and the project registry."""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache, partial
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructType

from corvane.functions.text import limit, ustrip
from corvane.model import PROJECTS, STORY, NotFound, Project

#: Files that one task lists and reads, where a folder is not cut more often than ``MOST_PARTS``.
PATHS_PER_TASK = 500
#: Parts of one folder at most, or twice the session's cores: each part passes the names of all, so
#: that more parts with more names would be quadratic.
MOST_PARTS = 64
#: Folders that a writing task remembers.
FOLDERS_HELD = 10_000
COLUMNS = "project_id string, path string, content string, reason string"


class _Folders(InputPartition):
    """Parts of folders: (folder, k, of) stands for the names whose hash is ``k`` of ``of``."""

    def __init__(self, parts: list[tuple[str, int, int]]) -> None:
        self.parts = parts


class _Named(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.root, self.project, self.columns = options["root"], options.get("project_id", ""), columns
        split = lambda name: [x for x in options.get(name, "").split(",") if x]
        self.extensions, self.excluded = set(split("extensions")), set(split("excluded"))
        self.most = max(MOST_PARTS, int(options.get("parts", 0)))
        self.endings = tuple(f".{x}" for x in self.extensions)
        self.named: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Paths asked for by name need no listing; all other filters are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.named = asked if self.named is None else self.named & asked
            else:
                yield f

    def _folders(self) -> Iterator[tuple[str, int]]:
        """Folders below the root outside excluded ones, with the number of their files. Names are
        counted and not kept; a folder that can't be listed is left to its task, which says why."""
        due = [self.root]
        while due:
            folder, n = due.pop(), 0
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        if not e.is_dir(follow_symlinks=False):
                            n += 1
                        elif e.name not in self.excluded:
                            due.append(e.path)
            except OSError:
                n = 1
            yield folder, n

    def partitions(self) -> list[InputPartition]:
        """Folders only; large ones are cut by their names' hashes, into a bounded number of parts;
        small ones share a task."""
        if self.named is not None:
            asked = sorted(filter(self._may_see, self.named))
            return [_Named(asked[i : i + PATHS_PER_TASK]) for i in range(0, len(asked), PATHS_PER_TASK)] or [_Named([])]
        out: list[InputPartition] = []
        held: list[tuple[str, int, int]] = []
        size = 0
        for folder, n in self._folders():
            if n > PATHS_PER_TASK:
                of = min(-(-n // PATHS_PER_TASK), self.most)
                out += [_Folders([(folder, k, of)]) for k in range(of)]
            elif n:
                if size + n > PATHS_PER_TASK:
                    out.append(_Folders(held))
                    held, size = [], 0
                held.append((folder, 0, 1))
                size += n
        return [*out, _Folders(held)]

    def _kind(self, name: str) -> bool:
        return name.lower().endswith(self.endings) and Path(name).suffix.lower().lstrip(".") in self.extensions

    def _may_see(self, path: str) -> bool:
        """Whether a listing would show the path: written plainly, of a kind that is read, outside
        excluded folders, and by way of no link to a folder."""
        parts = path.split("/")
        if not path or any(x in ("", ".", "..") for x in parts) or not self._kind(parts[-1]) or set(parts[:-1]) & self.excluded:
            return False
        folder = os.path.join(self.root, *parts[:-1])
        return not any(os.path.islink(os.path.join(self.root, *parts[:i])) for i in range(1, len(parts))) and os.path.isdir(folder)

    def _found(self, part: InputPartition) -> Iterator[tuple[str, str | None]]:
        """(path, reason) of a task's files."""
        if isinstance(part, _Named):
            for p in part.paths:
                at = os.path.join(self.root, p)
                if os.path.lexists(at) and not os.path.isdir(at):
                    yield at, None
            return
        for folder, k, of in part.parts:
            try:
                with os.scandir(folder) as entries:
                    names = sorted(e.name for e in entries if (of == 1 or zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % of == k) and self._kind(e.name) and not e.is_dir())
            except OSError as e:
                yield folder, type(e).__name__
                continue
            yield from ((os.path.join(folder, n), None) for n in names)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        opens = "content" in self.columns or "reason" in self.columns
        below = os.path.join(self.root, "")
        for at, reason in self._found(partition):
            path = at[len(below) :] if at.startswith(below) else os.path.relpath(at, self.root)
            row = {"project_id": self.project, "path": path.replace(os.sep, "/"), "content": None, "reason": reason}
            if opens and reason is None:
                try:
                    with open(at, encoding="utf-8", errors="ignore") as f:
                        row["content"] = f.read()
                    if not row["content"].strip():
                        continue
                except OSError as e:
                    row["reason"] = type(e).__name__
            yield tuple(row[c] for c in self.columns)


@dataclass
class _Done(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    """Rows (path, operation, content): a task stages its files beside the root; the end of the job
    renames them into place and removes what is deleted, or drops them all."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.realpath(options["root"])
        self.staging = f"{self.root}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Done:
        context = TaskContext.get()
        own = Path(self.staging, f"{context.partitionId()}-{context.taskAttemptId()}")
        gone = []
        # Nothing below the root changes before the commit, so a folder is resolved and made once.
        real, made = lru_cache(FOLDERS_HELD)(os.path.realpath), lru_cache(FOLDERS_HELD)(partial(os.makedirs, exist_ok=True))
        for r in iterator:
            folder, name = os.path.split(os.path.join(self.root, r.path))
            target = os.path.join(real(folder), name)
            if name in ("", ".", "..") or os.path.islink(target):
                target = os.path.realpath(target)
            if not target.startswith(f"{self.root}{os.sep}"):  # by way of a link
                raise ValueError(f"Path traversal attempt blocked: {r.path}")
            rel = target[len(self.root) + 1 :]
            if r.operation == "delete":
                gone.append(rel)
                continue
            part = f"{own}/files/{rel}"
            made(os.path.dirname(part))
            with open(part, "wb") as f:
                f.write((r.content or "").encode())
        if gone:
            own.mkdir(parents=True, exist_ok=True)
            (own / "deletes").write_text(json.dumps(gone), encoding="utf-8")
        return _Done(str(own))

    def commit(self, messages: list[_Done | None]) -> None:
        """Attempts that were lost or repeated have folders of their own, which no message names."""
        for m in filter(None, messages):
            files = Path(m.folder, "files")
            for folder, _, names in os.walk(files):
                into = os.path.join(self.root, os.path.relpath(folder, files))
                os.makedirs(into, exist_ok=True)
                for n in names:
                    os.replace(os.path.join(folder, n), os.path.join(into, n))
            deletes = Path(m.folder, "deletes")
            for rel in json.loads(deletes.read_text(encoding="utf-8")) if deletes.exists() else ():
                Path(self.root, rel).unlink(missing_ok=True)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[_Done | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class ProjectFiles(DataSource):
    """``spark.read.format("project_files")``: files below ``root`` with one of ``extensions``,
    outside ``excluded`` directories; hidden names count, invalid bytes are dropped, line ends
    become line feeds, blank files are left out. What can't be read has a null content and a ``reason``.

    The driver lists folders, tasks list and read files. ``where path = x`` opens that file only, with
    ``spark.sql.python.filterPushdown.enabled``. Asked for by a schema without content and reason, a
    listing opens no file and so shows blank ones too. Writing takes (path, operation, content), one row a
    path. The root must be a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "project_files"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def _load(spark: SparkSession, project: Project, schema: str) -> DataFrame:
    if not os.path.isdir(project.repo_root):
        raise NotFound(f"No such directory: {project.repo_root}")
    spark.dataSource.register(ProjectFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("project_files").schema(schema).option("root", project.repo_root).option("project_id", project.id).option("parts", str(2 * spark.sparkContext.defaultParallelism))
    return read.option("extensions", ",".join(x.lstrip(".").lower() for x in Project("").extensions())).option("excluded", ",".join(project.excluded())).load()


def scan_all(spark: SparkSession, project: Project) -> DataFrame:
    """(project_id, path, content, reason): what could be read and what could not, in one pass."""
    return _load(spark, project, COLUMNS)


def listing(spark: SparkSession, project: Project) -> DataFrame:
    """(project_id, path) of all files of the kinds that are read, blank ones too; none is opened."""
    return _load(spark, project, "project_id string, path string")


def scan(spark: SparkSession, project: Project, max_chars: int | None = None, rejects: bool = False, only: str | None = None) -> DataFrame:
    """A project's files, cut to ``max_chars`` if given, or the file at the path ``only``. A missing
    root fails here and now."""
    rows = scan_all(spark, project)
    rows = rows if only is None else rows.where(F.col("path") == only)
    if rejects:
        return rows.where("reason IS NOT NULL").select("project_id", "path", "reason")
    rows = rows.where("reason IS NULL").drop("reason")
    return rows if max_chars is None else rows.withColumn("content", limit(F.col("content"), max_chars))


def not_blank(files: DataFrame) -> DataFrame:
    return files.where(F.length(ustrip(F.coalesce("content", F.lit("")))) > 0)


def read_file(files: DataFrame, path: str) -> str | None:
    """A point lookup through the filtered files, so what the scan may not see can't be read."""
    row = files.where(F.col("path") == path).select("content").first()
    return row.content if row else None


def stories(spark: SparkSession, project: Project) -> DataFrame:
    """A JSON array of stories, or a folder of such files, each read by a task of its own; none
    configured: empty; a missing file or bad row fails, and so does anything after a file's array."""
    if not project.stories_file:
        return spark.createDataFrame([], STORY)
    if not os.path.exists(project.stories_file):
        raise NotFound(project.stories_file)
    # Spark's JSON reader passes over what follows a file's first value; inside brackets it is an error.
    whole = F.concat(F.lit("["), F.ltrim("value", F.lit("\ufeff")), F.lit("]"))
    arrays = F.from_json(whole, ArrayType(ArrayType(StructType.fromDDL(STORY))), {"mode": "FAILFAST"})
    rows = spark.read.text(project.stories_file, wholetext=True).select(F.explode(F.flatten(arrays)).alias("s"))
    return rows.select("s.*").fillna("Medium", ["priority"])


def project_rows(spark: SparkSession, projects: list[Project]) -> DataFrame:
    rows = [(*(list(v) if isinstance(v, tuple) else v for v in asdict(p).values()), i) for i, p in enumerate(projects)]
    return spark.createDataFrame(rows, PROJECTS + ", pos int")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Persisted projects whose root exists; rows that don't fit are skipped, a missing or corrupt
    file is empty."""
    empty = spark.createDataFrame([], PROJECTS)
    if not os.path.exists(path):
        return empty
    rows = spark.read.schema(PROJECTS + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where("_bad IS NULL AND id IS NOT NULL AND repo_root IS NOT NULL").drop("_bad").toLocalIterator()
    kept = [r for r in rows if os.path.isdir(r.repo_root)]
    return spark.createDataFrame(kept, PROJECTS) if kept else empty
