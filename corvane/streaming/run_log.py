"""The run log: ordered messages, frames, ends; batch and streaming forms."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.model import RUN_LOG

IDLE_SECONDS = 300
OPENING = (": stream-open\n\n", 'data: {"msg": "Agent initializing…"}\n\n')
DONE = "event: done\ndata: {}\n\n"


def frame(msg: Column) -> Column:
    """A message as one event-stream frame."""
    quoted = F.to_json(F.struct(msg.alias("msg")))  # {"msg":"..."}, every control character escaped
    return F.when(msg.isNull(), F.lit(DONE)).otherwise(F.concat(F.lit('data: {"msg": '), F.substring(quoted, len('{"msg":') + 1, F.length(quoted)), F.lit("\n\n")))


def frames(log: DataFrame, opening: bool = False) -> DataFrame:
    """(run_id, seq, frame, ends): a run ends at a null message, or where the next one is more than
    ``IDLE_SECONDS`` of event time away or missing. With ``opening`` a reader's two first frames
    stand before a run's first message, at the numbers below its own."""
    order = Window.partitionBy("run_id").orderBy("seq")
    gap = F.unix_micros(F.lead("ts").over(order).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    ends = F.col("msg").isNull() | F.coalesce(gap > IDLE_SECONDS * 1_000_000, F.lit(True))
    told = log.select("run_id", "seq", frame(F.col("msg")).alias("frame"), ends.alias("ends"), F.lag("seq").over(order).isNull().alias("_first"))
    if not opening:
        return told.drop("_first")
    row = lambda seq, text, end: F.struct(seq.cast("long").alias("seq"), text.alias("frame"), end.alias("ends"))
    own = row(F.col("seq"), F.col("frame"), F.col("ends"))
    before = [row(F.col("seq") - (len(OPENING) - i), F.lit(x), F.lit(False)) for i, x in enumerate(OPENING)]
    return told.select("run_id", F.explode(F.when(F.col("_first"), F.array(*before, own)).otherwise(F.array(own))).alias("f")).select("run_id", "f.*")


class RunLog:
    """Writes one run's messages as JSON rows below ``root``, one file a message, so that batch and
    streaming readers see whole rows only."""

    def __init__(self, root: str, run_id: str) -> None:
        self.root, self.run_id, self.seq = Path(root), run_id, 0

    def __call__(self, msg: str | None) -> None:
        """Append a message; None ends the run."""
        self.root.mkdir(parents=True, exist_ok=True)
        row = {"run_id": self.run_id, "seq": self.seq, "msg": msg, "ts": datetime.now(timezone.utc).isoformat()}
        part = self.root / f".{self.run_id}-{self.seq}.part"
        part.write_text(json.dumps(row), encoding="utf-8")
        part.rename(self.root / f"{self.run_id}-{self.seq:06d}.json")
        self.seq += 1


def sessions(log: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Streaming or batch: messages per run and idle-bounded session, with a watermark."""
    return log.withWatermark("ts", lateness).groupBy("run_id", F.session_window("ts", f"{IDLE_SECONDS} seconds").alias("w")).agg(F.count("msg").alias("n_msgs")).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_msgs")


def read_log(spark, path: str, stream: bool = True) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(RUN_LOG).json(path)


def progress(deltas: DataFrame, key: str = "run_id", seq: str = "seq", text: str = "delta", first: int = 300, step: int = 600) -> DataFrame:
    """(key, n_chars, reports): the running character counts at which progress is told, at most one
    per delta. A run is one ordered fold, so it is one value."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.length(text).alias("n"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(first).alias("due"), F.array().cast("array<int>").alias("out"))

    def fold(acc: Column, r: Column) -> Column:
        n = (acc["n"] + r["n"]).cast("int")
        hit = (n >= acc["due"]) & (r["n"] > 0)
        return F.struct(n.alias("n"), F.when(hit, acc["due"] + step).otherwise(acc["due"]).cast("int").alias("due"), F.when(hit, F.concat(acc["out"], F.array(n))).otherwise(acc["out"]).alias("out"))

    done = deltas.groupBy(key).agg(rows.alias("rows")).select(key, F.aggregate("rows", zero, fold).alias("a"))
    return done.select(key, F.col("a.n").cast("long").alias("n_chars"), F.array_join(F.col("a.out").cast("array<string>"), ",").alias("reports"))
