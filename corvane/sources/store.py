"""Small records and snapshots through Hadoop's file systems: whole or not at all, whoever looks."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Times and seconds for which a reader waits for a record that another is just writing.
TRIES, PAUSE = 50, 0.1


def _at(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def local(spark: SparkSession, path: str) -> str | None:
    """The path for Python's own calls, if it lies in the local file system."""
    fs, where = _at(spark, path)
    return where.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it is missing."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(fs, where, text: str) -> None:
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def swap(spark: SparkSession, path: str, text: str) -> None:
    """Replace a record by renaming a finished one over it: a reader sees the old or the new one."""
    fs, where = _at(spark, path)
    part = f"{path}.{uuid.uuid4().hex}"
    _, source = _at(spark, part)
    _write(fs, source, text)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(source, where, over)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a record if there is none at ``path``. Of several writers exactly one is told True.

    Local files appear whole by a link, which fails where one exists; elsewhere the file system's own
    exclusive creation decides (HDFS and other stores that have one).
    """
    own = local(spark, path)
    if own is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        part = f"{own}.{uuid.uuid4().hex}"
        with open(part, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(part, own)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    fs, where = _at(spark, path)
    try:
        _write(fs, where, text)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


class Snapshots:
    """Tables by name below ``root``, each a folder of immutable snapshots and a manifest that names the
    current one and is swapped last. A reader during a rebuild has the old snapshot or the new; the one
    before the current stays until the next rebuild, so that whoever reads it can finish."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str) -> str:
        return f"{self.root}/{quote(name, safe='')}"

    def manifest(self, name: str) -> dict | None:
        text = read_text(self.spark, f"{self._folder(name)}/manifest.json")
        return json.loads(text) if text else None

    def exists(self, name: str) -> bool:
        return self.manifest(name) is not None

    def publish(self, name: str, table: DataFrame) -> dict:
        """Store a table as the current snapshot. If the job fails, the current one stays as it is. Only a
        snapshot that a manifest named is ever removed: another writer's may not be swapped in yet."""
        before, folder, own = self.manifest(name), self._folder(name), f"data-{uuid.uuid4().hex}"
        table.write.parquet(f"{folder}/{own}")
        files = [n for n in names(self.spark, f"{folder}/{own}") if n.endswith(".parquet")]
        now = {"snapshot": own, "files": files, "before": before and before["snapshot"], "schema": table.schema.json()}
        swap(self.spark, f"{folder}/manifest.json", json.dumps(now))
        if before and before["before"]:  # readers have had a whole rebuild's time to leave it
            remove(self.spark, f"{folder}/{before['before']}")
        return now

    def open(self, name: str) -> DataFrame | None:
        """The current snapshot, by the files its manifest names; None if there is none."""
        from pyspark.sql.types import StructType

        now = self.manifest(name)
        if now is None:
            return None
        schema = StructType.fromJson(json.loads(now["schema"]))
        paths = [f"{self._folder(name)}/{now['snapshot']}/{f}" for f in now["files"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


class HeldPlans:
    """Plans waiting for review: per project an append-only row of numbered states. A state is added
    only as the successor of the one that was read, so of two that act on one state one wins, and a
    restart finds what was held. States: held, claimed, accepted, rejected."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, project: str) -> str:
        return f"{self.root}/{quote(project.lower(), safe='')}"

    def latest(self, project: str) -> tuple[int, dict]:
        """The number and content of the last state; 0 and nothing if there is none."""
        known = [int(m[1]) for n in names(self.spark, self._folder(project)) if (m := re.fullmatch(r"(\d{9})\.json", n))]
        if not known:
            return 0, {}
        for _ in range(TRIES):
            if text := read_text(self.spark, f"{self._folder(project)}/{max(known):09}.json"):
                return max(known), json.loads(text)
            time.sleep(PAUSE)  # its writer has created it and not yet closed it
        raise TimeoutError(f"state {max(known)} of {project} stays empty")

    def follow(self, project: str, number: int, state: dict) -> bool:
        """Add the state after ``number``; False if another has."""
        return create(self.spark, f"{self._folder(project)}/{number + 1:09}.json", json.dumps(state))

    def hold(self, project: str, rows: list, diff: str) -> None:
        """Hold a plan in place of any other. One that is just being applied is not disturbed: the new
        plan follows it."""
        while not self.follow(project, self.latest(project)[0], {"state": "held", "rows": rows, "diff": diff}):
            pass

    def claim(self, project: str) -> tuple[int, dict] | None:
        """Take the held plan; None if none is held or another has taken it."""
        number, state = self.latest(project)
        if state.get("state") != "held" or not self.follow(project, number, state | {"state": "claimed"}):
            return None
        return number + 1, state

    def settle(self, project: str, number: int, state: dict) -> bool:
        """Follow a claim by its outcome, unless a newer plan has come meanwhile."""
        return self.follow(project, number, state)

    def reject(self, project: str) -> None:
        while (now := self.latest(project))[1].get("state") == "held":
            if self.follow(project, now[0], {"state": "rejected"}):
                return
