"""Hard negatives by a vector-approximation file: each dimension in cells, bounds of a score by table
lookup, exact scores only for rows that may enter a list or a window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.llm.common import bounded, materialize, release, scratch_dir, small_batches, stored

#: Rows of a block, and anchors that meet a block at once.
BLOCK, STRIP = 2048, 64
#: Anchors that a pass over the rows takes along; what the driver and a task hold of them.
CHUNK = 2048
#: Cells of a dimension are 2 to this power.
BITS = 6
#: Rows whose values place the cells' borders. Any borders give right results.
SAMPLE = 2000
#: Pairs that are scored exactly at once.
PAIRS = 100_000
#: Components beyond this are an error: sums of products must fit 64 bits.
MOST = 1 << 20


@dataclass(frozen=True)
class Cells:
    """Per dimension, the least and greatest whole number of each cell."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, some: np.ndarray, least: np.ndarray, most: np.ndarray) -> "Cells":
        """Cells with about equally many of the sampled rows, from the least to the greatest value of all."""
        inner = np.quantile(some, np.linspace(0, 1, (1 << BITS) + 1)[1:-1], axis=0).astype(np.int64)
        low = np.vstack([least, np.clip(inner, least, most)])
        high = np.vstack([low[1:] - 1, most])
        return cls(low, np.maximum(high, low))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The cell of each component, a row a dimension."""
        return np.stack([np.searchsorted(self.low[:, d], x[:, d], "right") - 1 for d in range(x.shape[1])]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each cell of each dimension adds to a score with each anchor, at least and at most:
        arrays of (dimension, cell, anchor)."""
        a, b = self.low.T[:, :, None] * q.T[:, None, :], self.high.T[:, :, None] * q.T[:, None, :]
        small, large = np.minimum(a, b), np.maximum(a, b)
        fits = max(np.abs(small).max(axis=1).sum(axis=0).max(), np.abs(large).max(axis=1).sum(axis=0).max()) < 2**31
        kind = np.int32 if fits else np.int64
        return small.astype(kind), large.astype(kind)


@dataclass(frozen=True)
class Rows:
    """Ids, labels and whole-number vectors, in order of label."""

    id: np.ndarray
    label: np.ndarray
    x: np.ndarray

    @classmethod
    def read(cls, ids: bytes, labels: bytes, x: bytes) -> "Rows":
        i = np.frombuffer(ids, np.int64)
        return cls(i, np.frombuffer(labels, np.int64), np.frombuffer(x, np.int32).reshape(len(i), -1))

    def span(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, "right"))


_PACKED = "ids binary, labels binary, x binary"


def _pack(most: int):
    """Rows of a task in blocks of at most ``most``, each sorted by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def put(n: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held[:] = t.slice(n).to_batches()
            t = t.slice(0, n).combine_chunks()
            label = t["label"].to_numpy()
            order = np.argsort(label, kind="stable")
            x = pc.list_flatten(t["x"]).to_numpy().reshape(n, -1)[order].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (t["id"].to_numpy()[order].tobytes(), label[order].tobytes(), x.tobytes())], names=["ids", "labels", "x"])

        for b in batches:
            held.append(b)
            while sum(h.num_rows for h in held) >= most:
                yield put(most)
        if n := sum(h.num_rows for h in held):
            yield put(n)

    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the least and greatest value of each dimension."""
    low = high = None
    for b in batches:
        for raw, ids in zip(b.column("x"), b.column("ids")):
            x = np.frombuffer(raw.as_py(), np.int32).reshape(len(ids.as_py()) // 8, -1)
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["low", "high"])


def _coded(cells: Cells):
    """Blocks with the cells of their rows beside them: the approximation file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [cells.codes(Rows.read(i.as_py(), l.as_py(), x.as_py()).x).tobytes() for i, l, x in zip(b.column("ids"), b.column("labels"), b.column("x"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary())], names=[*b.schema.names, "codes"])

    return run


def _sum(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Bounds of all rows with all anchors: one lookup a dimension."""
    out = tables[0][codes[0]]
    for d in range(1, len(codes)):
        out += tables[d][codes[d]]
    return out


def _sum_pairs(tables: np.ndarray, codes: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), np.int64)
    for d in range(len(codes)):
        out += tables[d][codes[d][row], anchor]
    return out


def _exact(x: np.ndarray, q: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", x[row[k : k + PAIRS]].astype(np.int64), q[anchor[k : k + PAIRS]].astype(np.int64)) for k in range(0, len(row), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Best:
    """The best rows so far of each of ``n`` lists: higher scores first, ties by smaller id."""

    def __init__(self, n: int, keep: int) -> None:
        self.n, self.keep = n, keep
        self.list, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(at):
            return
        at, ids, score = np.r_[self.list, at], np.r_[self.id, ids], np.r_[self.score, score]
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < self.keep
        self.list, self.id, self.score = at[top], ids[top], score[top]
        full = place == self.keep - 1
        self.least[at[full]] = score[full]


def _found(parts: list[tuple[int, Best]]) -> pa.RecordBatch:
    """The lists of all strips, numbered from each strip's first."""
    columns = [np.concatenate([x for x in own] or [np.zeros(0, np.int64)]) for own in zip(*[(b.list + at, b.id, b.score) for at, b in parts])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "id", "score"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rows, np.ndarray]]:
    for b in batches:
        for k in range(b.num_rows):
            rows = Rows.read(*(b.column(c)[k].as_py() for c in ("ids", "labels", "x")))
            yield rows, np.frombuffer(b.column("codes")[k].as_py(), np.uint8).reshape(-1, len(rows.id))


def _strips(anchors: Rows) -> Iterator[tuple[int, int]]:
    """Runs of at most ``STRIP`` anchors of one label."""
    at = 0
    while at < len(anchors.id):
        end = min(at + STRIP, anchors.span(anchors.label[at])[1])
        yield at, end
        at = end


def _positives(cells: Cells, anchors: Rows, keep: int):
    """Each task's best rows of each anchor's own label. The rows with the highest bounds give a score
    that ``keep`` rows reach; a row whose upper bound is below it, or below what earlier blocks
    gave, is never scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = [(a, b, cells.tables(anchors.x[a:b].astype(np.int64))[1], Best(b - a, keep)) for a, b in _strips(anchors)]
        for rows, codes in _blocks(batches):
            for a, b, upper, best in prepared:
                lo, hi = rows.span(anchors.label[a])
                if lo == hi:
                    continue
                bound = _sum(upper, codes[:, lo:hi]).astype(np.int64)
                own = rows.id[lo:hi, None] == anchors.id[None, a:b]
                bound[own] = np.iinfo(np.int64).min
                first = np.argpartition(-bound, min(keep, hi - lo) - 1, axis=0)[:keep]
                row, anchor = first.ravel(), np.tile(np.arange(b - a), len(first))
                score = _exact(rows.x[lo:hi], anchors.x[a:b], row, anchor).reshape(first.shape)
                score[np.take_along_axis(own, first, axis=0)] = np.iinfo(np.int64).min
                need = np.maximum(best.least, score.min(axis=0) if len(first) == keep else np.iinfo(np.int64).min)
                row, anchor = np.nonzero((bound >= need) & ~own)
                best.add(anchor, rows.id[lo:hi][row], _exact(rows.x[lo:hi], anchors.x[a:b], row, anchor))
        yield _found([(a, best) for a, _, _, best in prepared])
        release()

    return run


def _negatives(cells: Cells, anchors: Rows, low: np.ndarray, high: np.ndarray, keep: int):
    """Each task's best rows of other labels in each anchor's windows (``low`` to ``high``, an array of
    (anchor, window); an empty window has low > high). A row is scored if its bounds meet a window
    above the score at which the window is full."""
    windows = low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = [(a, b, *cells.tables(anchors.x[a:b].astype(np.int64)), Best((b - a) * windows, keep)) for a, b in _strips(anchors)]
        for rows, codes in _blocks(batches):
            for a, b, lower, upper, best in prepared:
                lo, hi = rows.span(anchors.label[a])
                for x, y in ((0, lo), (hi, len(rows.id))):
                    if x == y:
                        continue
                    need = np.maximum(low[a:b], best.least.reshape(-1, windows))
                    need = np.where(low[a:b] > high[a:b], np.iinfo(np.int64).max, need)
                    bound = _sum(upper, codes[:, x:y])
                    row, anchor = np.nonzero(bound >= need.min(axis=1))
                    most = bound[row, anchor]
                    # A bound that lies in a window's reach decides; the lower one is looked up for those only.
                    least = _sum_pairs(lower, codes[:, x:y], row, anchor)
                    some = ((most[:, None] >= need[anchor]) & (least[:, None] <= high[a:b][anchor])).any(axis=1) & (rows.id[x:y][row] != anchors.id[a:b][anchor])
                    row, anchor = row[some], anchor[some]
                    score = _exact(rows.x[x:y], anchors.x[a:b], row, anchor)
                    i, w = np.nonzero((score[:, None] >= need[anchor]) & (score[:, None] <= high[a:b][anchor]))
                    best.add(anchor[i] * windows + w, rows.id[x:y][row[i]], score[i])
        yield _found([(a * windows, best) for a, *_, best in prepared])
        release()

    return run


def _top(found: DataFrame, keep: int) -> DataFrame:
    """The best of what tasks have found: (list, id, score, rank)."""
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= keep)


def mine_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all long but rank.

    Components become whole numbers, ``floor(scale * x)``; a score is the inner product with the
    anchor. ``anchor`` tells which rows are anchors. An anchor's positives are its ``positives``
    best other rows of the same label; for each, the ``negatives`` best rows of other labels with
    scores from ``share[0] / share[1]`` of the positive's score up to that score. Ties go to the
    smaller id. Fewer: all; a positive whose window is empty gives no row.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor
    do empty vectors and those of another length than most (of equally frequent lengths, the least). Scaled components from 2 ** 20 on are an
    error. Rows that repeat an id all count, but never with an anchor of that id; anchors that
    repeat in full count once. Other columns are ignored; an empty table gives an empty table.

    The rows are stored as blocks with their cells. Anchors are taken ``CHUNK`` at a time over all
    blocks, so neither the driver nor a task holds more of them, and no label or vector gathers
    rows in one task: blocks stay where they are, and a task gives its few best.
    """
    spark = rows.sparkSession
    small_batches(spark)
    v = F.col(f"`{vec_col}`")
    good = F.size(v).cast("int") > 0
    good = F.coalesce(good & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) < MOST / scale, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large for whole-number scores"))).cast("long"))
    kind = rows.schema[label_col].dataType
    label = F.col(f"`{label_col}`").cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(F.col(f"`{label_col}`"))
    valid = rows.where(good & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    known = valid.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), whole.alias("x"), anchor.alias("is_anchor"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dims = valid.agg(F.mode(F.size(v), True)).first()[0]
    if dims is None:
        return spark.createDataFrame([], schema)
    known = known.where(F.size("x") == dims)
    packed = materialize(known.select("id", "label", "x").mapInArrow(_pack(BLOCK), _PACKED))
    ends = packed.mapInArrow(_bounds, "low array<long>, high array<long>").agg(*[F.min(F.get("low", F.lit(d))).alias(f"l{d}") for d in range(dims)], *[F.max(F.get("high", F.lit(d))).alias(f"h{d}") for d in range(dims)]).first()
    some = np.array([r.x for r in known.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").collect()], np.int64)
    cells = Cells.of(some, np.array(ends[:dims], np.int64), np.array(ends[dims:], np.int64))
    file = materialize(packed.mapInArrow(_coded(cells), f"{_PACKED}, codes binary"))
    asked = materialize(known.where("is_anchor").select("id", "label", "x").distinct())
    if not (n := asked.count()):
        return spark.createDataFrame([], schema)
    out = scratch_dir(spark)
    stored(spark).append(out)
    chunks = materialize(asked.repartition(-(-n // CHUNK)).mapInArrow(_pack(CHUNK), _PACKED))
    lists = "list long, id long, score long"
    for k, chunk in enumerate(chunks.toLocalIterator()):
        anchors = Rows.read(bytes(chunk.ids), bytes(chunk.labels), bytes(chunk.x))
        near = _top(file.mapInArrow(_positives(cells, anchors, positives), lists), positives).collect()
        held, low, high = np.zeros((len(anchors.id), positives), np.int64), *(np.full((len(anchors.id), positives), e, np.int64) for e in (1, 0))
        for r in near:
            held[r.list, r.rank - 1], high[r.list, r.rank - 1], low[r.list, r.rank - 1] = r.id, r.score, -(-share[0] * r.score // share[1])
        best = _top(file.mapInArrow(_negatives(cells, anchors, low, high, negatives), lists), negatives)
        pairs = spark.createDataFrame([(int(r.list) * positives + r.rank - 1, int(anchors.id[r.list]), r.id, r.score) for r in near], "list long, anchor_id long, positive_id long, positive_score long")
        told = best.join(bounded(pairs, len(near)), "list")
        told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/chunk={k}")
    return spark.read.schema(schema).parquet(out).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
