"""Change plans: from model text to validated files, and their diff."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import in_excluded, ustrip
from corvane.model import PLAN_FILE, BadPlan

MOST_CHARS = 40_000
_PIECE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', re.S)
_CLOSER = {"{": "}", "[": "]"}


def repair_json(text: str) -> str:
    """Text with the quote and brackets that its end still needs."""
    due, cut = [], ""
    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece in _CLOSER:
            due.append(_CLOSER[piece])
        elif piece in "}]":
            if due and due[-1] == piece:
                due.pop()
        elif m.end() == len(text) and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', piece, re.S):
            cut = '"'
    return text + cut + "".join(reversed(due))


def extract_json(text: str) -> object:
    """The first reading that parses strictly: all of it, a fenced block, the widest braces, the
    repaired rest from the first brace."""
    text = text.strip()

    def readings():
        yield text
        if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
            yield m[1].strip()
        a, b = text.find("{"), text.rfind("}")
        if 0 <= a < b:
            yield text[a : b + 1]
        if 0 <= a < len(text) - 1:
            yield repair_json(text[a:])

    for reading in readings():
        try:
            return json.loads(reading)
        except json.JSONDecodeError:
            continue
    raise BadPlan(f"Could not parse JSON from model response:\n{text[:400]}")


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def parse_reply(texts: pd.Series) -> pd.DataFrame:
    """Canonical JSON of each reply, or why there is none."""
    rows = []
    for t in texts:
        try:
            rows.append((json.dumps(extract_json(t or "")), None))
        except BadPlan as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["json", "error"])


@F.pandas_udf(T.StringType())
def repaired(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: repair_json(t or ""))


def usable_files(files: Column) -> Column:
    """Entries with path and operation, and with content unless they delete (in any case)."""
    return F.filter(files, lambda f: f["path"].isNotNull() & f["operation"].isNotNull() & ((F.lower(f["operation"]) == "delete") | (F.coalesce(F.length(f["content"]), F.lit(0)) > 0)))


def plan_from_json(text: Column, story_id: Column, strict: bool = False) -> Column:
    """A plan struct with defaults for what is missing. ``strict`` keeps all files and needs
    storyId and summary, else null."""
    raw = F.from_json(text, f"storyId string, summary string, files array<{PLAN_FILE}>, tests array<string>, notes array<string>")
    none = F.array().cast("array<string>")
    files = F.coalesce(raw["files"], F.array().cast(f"array<{PLAN_FILE}>"))
    plan = F.struct(F.coalesce(raw["storyId"], story_id).alias("storyId"), F.coalesce(raw["summary"], F.lit("")).alias("summary"), (files if strict else usable_files(files)).alias("files"), F.coalesce(raw["tests"], none).alias("tests"), F.coalesce(raw["notes"], none).alias("notes"))
    return F.when(raw["storyId"].isNotNull() & raw["summary"].isNotNull(), plan) if strict else plan


def reply_text(output_text: Column, output: Column) -> Column:
    """The reply's text, else the texts of its content of type output_text or text; empty is null."""
    parts = F.filter(F.flatten(F.transform(output, lambda o: o["content"])), lambda c: c["type"].isin("output_text", "text"))
    joined = F.array_join(F.transform(parts, lambda c: c["text"]), "")
    return F.coalesce(F.nullif(output_text, F.lit("")), F.nullif(joined, F.lit("")))


def resolved(path: Column) -> Column:
    """Path components with ``.`` and ``..`` worked off; null if it leaves the root or is absolute."""
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc["p"]) > 0, F.struct(F.slice(acc["p"], F.lit(1), F.size(acc["p"]) - 1).alias("p"), acc["out"].alias("out"))).otherwise(F.struct(none.alias("p"), F.lit(True).alias("out")))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.struct(F.concat(acc["p"], F.array(part)).alias("p"), acc["out"].alias("out")))

    start = F.struct(none.alias("p"), path.startswith("/").alias("out"))
    return F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(~acc["out"], acc["p"]))


def rejection(path: Column, operation: Column, content: Column, extensions: list[str], excluded: list[str]) -> Column:
    """Why an entry is refused, the first reason only; null if it is fine."""
    blank = lambda c: F.length(ustrip(F.coalesce(c, F.lit("")))) == 0
    parts = resolved(path)
    rel = F.array_join(parts, "/")
    op = F.lower(operation)
    ext = F.lower(F.when(F.contains(rel, F.lit(".")), F.substring_index(rel, ".", -1)).otherwise(""))
    say = lambda a: F.concat(F.lit(f"{a}: "), path)
    return (
        F.when(blank(path), "Patch entry has an empty path")
        .when(blank(operation), "Patch entry has an empty operation")
        .when(parts.isNull(), say("Path traversal attempt blocked"))
        .when(in_excluded(rel, excluded), say("Patch forbidden in excluded directory"))
        .when((op == "delete") & ~blank(content), say("content must be null/empty for delete"))
        .when((op != "delete") & blank(content), F.concat(F.lit("content is required for "), op, F.lit(": "), path))
        .when(~ext.isin(*extensions), say("Extension not allowed"))
        .when(F.length(content) > MOST_CHARS, say("Patch content too large (>40 000 chars)"))
    )


def file_diff(path: str, old: str, new: str) -> str:
    body = list(difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), fromfile=f"a/{path}", tofile=f"b/{path}"))
    return "".join([f"diff --git a/{path} b/{path}\n", *body]) if body else ""


@F.pandas_udf(T.StringType())
def diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """Unified diff per file; empty if nothing changes. The caller gives empty text for deletions."""
    return pd.Series([file_diff(p, a or "", b or "") for p, a, b in zip(path, old, new)], dtype="object")


