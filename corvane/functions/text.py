"""Text operators as Column expressions.

White space and letter case follow Unicode as Python's do: ``(?U)`` plus the four separators
U+001C to U+001F that Java's class lacks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = "\n...[TRUNCATED]"
WS, NOT_WS = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"

# Secrets in three passes, whose order matters.
SECRET = rf"(?Ui)(api[_-]?key|secret|token|password|passwd|bearer){WS}*[:=]{WS}*{NOT_WS}+"
CLOUD_KEY = "AKIA[0-9A-Z]{16}"
#: A whole run of at least 32 token characters that holds a digit and a letter.
TOKEN = "(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{32,}"


def once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once: a column named twice would be computed twice."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def limit(text: Column, n: int) -> Column:
    """The first ``n`` code points and a mark if there are more; null as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(TRUNCATED))).otherwise(t)


def ustrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{WS}+|{WS}+\z", "")


def clean(text: Column) -> Column:
    """Null as empty; white space runs as one space; stripped."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U){WS}+", " "))


def redact(text: Column) -> Column:
    one = F.regexp_replace(F.coalesce(text, F.lit("")), SECRET, "$1=[REDACTED]")
    return F.regexp_replace(F.regexp_replace(one, CLOUD_KEY, "[REDACTED_AWS_KEY]"), TOKEN, "[REDACTED_TOKEN]")


def chunks(text: Column, size: int = 1800, least: int = 200) -> Column:
    """Greedy chunks as array of (chunk_index, text).

    A chunk ends at the last newline after ``least`` characters, else at ``size``. Blank
    chunks are left out but counted, so indexes may have gaps. A fold over a bounded sequence
    keeps this one expression: no shuffle, no Python. Each step looks at the next ``size``
    characters of what is left, so time is in proportion to the text; what a step needs more
    than once is bound, as a lambda's body is computed as often as it is named.
    """
    none = F.array().cast("array<struct<chunk_index:int,text:string>>")

    def cut(acc: Column, head: Column) -> Column:
        """How many characters the next chunk has: the newest line feed in reach decides."""
        found = F.instr(F.reverse(F.substring(head, least + 1, size - least)), "\n")
        return once(found, lambda back: F.when(acc["left"] <= size, acc["left"]).when((back == 0) | (back >= size - least), F.lit(size)).otherwise(F.lit(size) - back))

    def step(acc: Column, _: Column) -> Column:
        def put(head: Column, n: Column) -> Column:
            def out(piece: Column) -> Column:
                row = F.array(F.struct(acc["c"].alias("chunk_index"), piece.alias("text")))
                return F.when(F.length(piece) > 0, F.concat(acc["out"], row)).otherwise(acc["out"])

            rest = F.when(acc["left"] <= size, F.lit("")).otherwise(F.substring(acc["rest"], n + 1, acc["left"]))
            return F.struct(rest.alias("rest"), (acc["left"] - n).cast("int").alias("left"), (acc["c"] + 1).cast("int").alias("c"), once(ustrip(F.substring(head, F.lit(1), n)), out).alias("out"))

        after = once(F.substring(acc["rest"], 1, size), lambda head: once(cut(acc, head), lambda n: put(head, n)))
        return F.when(acc["left"] <= 0, acc).otherwise(after)

    def whole(t: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(F.length(t) / (least + 1)).cast("int"))
        start = F.struct(t.alias("rest"), F.length(t).alias("left"), F.lit(0).alias("c"), none.alias("out"))
        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    return once(text, lambda t: F.when(t.isNotNull(), whole(t)))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat_ws("#", path, index.cast("string"))


def embedding_text(path: Column, index: Column, text: Column) -> Column:
    return F.concat(F.lit("FILE: "), path, F.lit("\nCHUNK: "), index.cast("string"), F.lit("\n"), text)


def python_list(items: Column) -> Column:
    """An array of strings as Python prints it: single quotes unless only those occur inside."""

    def shown(x: Column) -> Column:
        body = F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
        single, double = F.contains(x, F.lit("'")), F.contains(x, F.lit('"'))
        return F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), shown), ", "), F.lit("]"))


def story_text(id_: Column, title: Column, description: Column, criteria: Column, priority: Column) -> Column:
    lines = [F.concat(F.lit("id: "), clean(id_)), F.concat(F.lit("title: "), clean(title)), F.concat(F.lit("description: "), clean(description)), F.concat(F.lit("acceptanceCriteria: "), python_list(criteria)), F.concat(F.lit("priority: "), clean(priority))]
    return limit(redact(F.concat_ws("\n", *lines)), 6000)


def fix_text(text: Column) -> Column:
    return limit(redact(text), 12000)


def extension(name: Column) -> Column:
    """Without leading dots, in lower case."""
    return F.lower(F.ltrim(name, F.lit(".")))


def directory(name: Column) -> Column:
    return F.trim(name, F.lit("/\\"))


def newline_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's name; a name whose only dot leads has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def in_excluded(path: Column, excluded: list[str]) -> Column:
    """Whether a parent directory of the path is excluded; the file's own name is not tested."""
    if not excluded:
        return F.lit(False)
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, excluded)))
