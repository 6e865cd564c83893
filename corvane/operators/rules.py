"""Hygiene rules: each document against each rule, one finding per pair at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import NOT_WS, WS

# Name, pattern, message. In ``swallowed`` each atomic group takes the first place of its
# part, which is the best one for the parts after it, so one pass over the text decides.
RULES = (
    ("todo", r"(?Ui)(?<![\p{L}\p{N}_])(TODO|FIXME|XXX)(?![\p{L}\p{N}_])", "contains TODO/FIXME markers"),
    ("print", rf"(?U)System\.out\.println|System\.err\.println|printStackTrace{WS}*\(", "contains console logging / stack traces"),
    ("secret", rf"(?Ui)(api[_-]?key|secret|token|password|passwd){WS}*[:=]{WS}*{NOT_WS}+", "possible secret-like literal"),
    ("swallowed", rf"(?Us)\A(?>.*?catch{WS}*+\()(?>.*?Exception)(?>.*?\){WS}*+\{{{WS}*+\}})", "swallowed exception block detected"),
    ("null", rf"(?U)return{WS}+null{WS}*;", "returns null explicitly"),
)
CLEAN = "Static analysis OK: no basic hygiene issues found."


def findings(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, rule_no, rule, message): one pass over the files, no shuffle."""
    hits = [F.when(F.col(content).rlike(p), F.struct(F.lit(i).alias("rule_no"), F.lit(n).alias("rule"), F.concat(F.col(path), F.lit(f": {m}")).alias("message"))) for i, (n, p, m) in enumerate(RULES)]
    one = F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("f")
    return files.select(F.col(path).alias("path"), one).select("path", "f.*")


def report(found: DataFrame) -> DataFrame:
    """One row: success, n_findings, report. The report is one value by definition; the findings
    table is what scales."""
    rows = F.array_sort(F.collect_list(F.struct("path", "rule_no", "message")))
    got = found.agg(F.count("*").alias("n_findings"), F.array_join(F.transform(rows, lambda r: r["message"]), "\n").alias("text"))
    return got.select((F.col("n_findings") == 0).alias("success"), "n_findings", F.when(F.col("n_findings") == 0, F.lit(CLEAN)).otherwise(F.col("text")).alias("report"))
