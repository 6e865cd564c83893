"""SimHash near-duplicates: links by generalised pigeonhole, components by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import BROADCAST_IDS, bounded, join_hot, map_text, materialize, row_key
from corvane.llm.components import components
from corvane.llm.crowds import crowd_links
from corvane.llm.set_join import alike

BITS = 64
#: Fingerprints read to plan the partitions. The plan changes the cost and never the links.
PLAN_SAMPLE = 20_000
#: Fingerprints of one probed value that are compared in one block; more are dealt over block pairs.
BLOCK = 4096
#: Wide fingerprints: 64-bit words of one, and the share of pairs of the least similarity to meet.
LANES, RECALL = 4, 0.98
#: Members of a family that are compared with its centre in one task.
FAMILY = 2000


def _shingles(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it has fewer words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    whole = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1)
    return np.fromiter([digest(whole[a:b], seed) for a, b in zip((end - size)[:n].tolist(), end[min(words, len(w)) - 1 :].tolist())], np.uint64, n)


def _majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 16384):
        ones += np.unpackbits(h[at : at + 16384].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """SimHash of a text's word shingles, repeats included, as an unsigned 64-bit integer."""
    return _majority(_shingles(text, words, seed))


def wide_fingerprint(text: str | None, words: int, seed: int) -> list[int]:
    """SimHash of the set of a text's word shingles in ``LANES`` words of 64 bits, each from
    another mixing of the shingles' hashes."""
    h = np.unique(_shingles(text, words, seed))
    out = []
    for lane in range(LANES):
        x = h ^ np.uint64(0x9E3779B97F4A7C15 * (lane + 1) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fp``: the fingerprint's 64 bits as a long. Null and blank texts have 0."""

    def start():
        return lambda texts: [pa.array(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))]

    return map_text(docs, text_col, [T.StructField("fp", T.LongType())], start, keep)


# ---- plan ---------------------------------------------------------------------------


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """Bits cut into ``m`` groups of like size so that correlated bits share a group."""
    total = bits.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.nan_to_num(np.abs(np.corrcoef(bits.T.astype(np.float64)))) if len(bits) > 1 else np.zeros((total, total))
    np.fill_diagonal(near, 0)
    free, out = np.ones(total, bool), []
    for k in range(m):
        want = (int(free.sum())) // (m - k)
        own = [int(np.argmax(np.where(free, near @ free, -1.0)))]
        free[own[0]] = False
        pull = near[own[0]].copy()
        while len(own) < want:
            own.append(int(np.argmax(np.where(free, pull, -1.0))))
            free[own[-1]] = False
            pull += near[own[-1]]
        out.append(sorted(own))
    return out


def plan(sample: np.ndarray, n: int, radius: int, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """Partitions of the bits with a threshold each: [(bits, t)], t < 0 left out.

    If x and y differ in at most ``radius`` bits and the thresholds of m partitions sum to
    ``radius - m + 1``, they differ in at most t bits in one partition at least. For each m,
    dynamic programming splits that sum so that the estimated rows (probes of each ball) and
    candidates (pairs of the sample that agree within t, scaled to n) cost least.
    """
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8)).reshape(-1, BITS) if len(sample) else np.zeros((0, BITS), np.uint8)
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, max(1, len(bits)), 200_000) for _ in range(2))
    differ = bits[a] != bits[b] if len(bits) > 1 else np.ones((1, BITS), bool)
    differ = differ[differ.any(axis=1)] if differ.any() else differ
    best = (float("inf"), [])
    for m in range(1, most_parts + 1):
        groups = _groups(bits, m)
        cost = []
        for g in groups:
            d = differ[:, g].sum(axis=1)
            cost.append({-1: 0.0})
            for t in range(0, radius + 1):
                ball = sum(comb(len(g), j) for j in range(t + 1))
                share = max((d <= t).mean(), ball / 2.0 ** len(g))
                cost[-1][t] = 40.0 * n * ball + share * n * n / 2
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (x, ts) in table.items():
                for t, y in c.items():
                    if s + t not in step or x + y < step[s + t][0]:
                        step[s + t] = (x + y, [*ts, t])
            table = step
        if radius - m + 1 in table and table[radius - m + 1][0] < best[0]:
            best = (table[radius - m + 1][0], [(g, t) for g, t in zip(groups, table[radius - m + 1][1]) if t >= 0])
    return best[1]


# ---- links --------------------------------------------------------------------------


def _project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for b in bits:
        out = (out << 1) | ((fp >> np.uint64(BITS - 1 - b)) & np.uint64(1)).astype(np.int64)
    return out


def _probe(parts: list[tuple[list[int], int]]):
    masks = [[0] + [sum(1 << i for i in c) for r in range(1, t + 1) for c in combinations(range(len(g)), r)] for g, t in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                fp = whole.column("fp").slice(at, 2000).to_numpy(zero_copy_only=False).astype(np.int64)
                for k, (g, _) in enumerate(parts):
                    code = _project(fp.view(np.uint64), g)
                    for flip in masks[k]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(code ^ flip), pa.array(fp)], names=["part", "code", "fp"])

    return run


def _tree(fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is linked in one block: a spanning forest by breadth-first search.
    Each found fingerprint leaves the set that later ones are compared with."""
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if hit.any():
                got = left[hit]
                out.append((np.full(len(got), fp[x]), fp[got]))
                queue.extend(got.tolist())
                left = left[~hit]
    return out


def _verify(radius: int):
    """Over rows sorted by (part, code, block): exact links of each run of equal keys."""

    def links(key: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        size = np.diff(np.r_[new, len(fp)])
        out = []
        small = np.repeat(size <= 8, size)
        group = np.repeat(np.arange(len(new)), size)
        for d in range(1, 8):
            if len(fp) <= d:
                break
            hit = small[d:] & (group[d:] == group[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius)
            out.append((fp[:-d][hit], fp[d:][hit]))
        for k in np.flatnonzero(size > 8):
            out += _tree(np.unique(fp[new[k] : new[k] + size[k]]), radius)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            col = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "code", "block", "fp")]
            key, fp = np.concatenate([held_key, np.stack(col[:3], axis=1)]), np.concatenate([held_fp, col[3].view(np.uint64)])
            cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            held_key, held_fp = key[cut:], fp[cut:]
            if cut:
                yield from emit(links(key[:cut], fp[:cut]))
        if len(held_fp):
            yield from emit(links(held_key, held_fp))

    def emit(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        u, v = u[u != v], v[u != v]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def hamming_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (u, v) among distinct longs ``fp`` whose closure holds every pair within ``radius`` bits.

    The rows of a probed value meet in one task. A value with more than ``BLOCK`` rows is cut
    into blocks by hash, and its rows are dealt to each pair of blocks, so no task holds more
    than two blocks of a value at once. Within a block only a spanning forest leaves the task.
    """
    n = prints.count()
    sample = prints.orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = plan(sample, n, radius)
    rows = _blocks(prints.select("fp").mapInArrow(_probe(parts), "part int, code long, fp long"), "fp")
    return rows.mapInArrow(_verify(radius), "u long, v long").distinct()


def _blocks(rows: DataFrame, own: str) -> DataFrame:
    """Probed rows (part, code, ...) with ``block``, dealt and sorted by all three. A value with
    more than ``BLOCK`` rows is cut by a hash of ``own``; its rows go to each pair of blocks."""
    large = materialize(rows.groupBy("part", "code").count().where(F.col("count") > BLOCK).select("part", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("_nb")))
    if many := large.count():
        dealt = rows.join(bounded(large, many), ["part", "code"], "left")
        other = F.explode(F.when(F.col("_nb").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_nb") - 1)))
        dealt = dealt.select(*rows.columns, "_nb", F.pmod(F.xxhash64(own), F.col("_nb")).cast("int").alias("_own"), other.alias("_other"))
        block = F.when(F.col("_nb").isNull(), 0).otherwise(F.least("_own", "_other") * F.col("_nb") + F.greatest("_own", "_other"))
        rows = dealt.select(*rows.columns, block.cast("int").alias("block"))
    else:
        rows = rows.select("*", F.lit(0).alias("block"))
    return rows.repartition("part", "code", "block").sortWithinPartitions("part", "code", "block")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Texts are lower-cased in A-Z only and cut at ASCII white space; h is a shingle's XXH64.
    Fingerprints within ``radius`` bits are linked; ``component_id`` is the least id reachable.
    Equal fingerprints are one node from the start, so copies never multiply. Null and blank
    texts have fingerprint zero and are linked like others. A null id never is the least one
    unless its component has no other. Repeated rows each give a row; an empty table gives an
    empty table; other columns are ignored whatever their names.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = materialize(fingerprints(own, "_text", words, seed, keep=["_id"]))
    nodes = materialize(rows.groupBy("fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")))
    size = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    roots = components(hamming_links(nodes.select("fp"), radius))
    named = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = materialize(named.groupBy("root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_m")))
    label = materialize(join_hot(named, least, ["root"], "_m", size["nodes"]).select("fp", "component_id", "_n"))
    return join_hot(rows, label, ["fp"], "_n", size["rows"]).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by Jaccard similarity -------------------------------------------------


def wide_plan(sample: np.ndarray, n: int, flip: float, recall: float = RECALL) -> list[tuple[list[int], int]]:
    """Partitions of wide fingerprints' bits with a threshold each, for pairs that differ in a bit
    with probability ``flip``.

    Thresholds that must sum to the radius would ask for nearly all pairs at such a radius. Here
    a partition of k bits with threshold t meets the pair with probability P(Bin(k, flip) <= t),
    and dynamic programming over the logarithm of what is missed allots the thresholds (or none)
    that reach ``recall`` with the least estimated rows and candidates.
    """
    bits = np.unpackbits(np.ascontiguousarray(sample).astype(">u8", order="C").view(np.uint8), axis=1)
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, max(1, len(bits)), 50_000) for _ in range(2))
    differ = bits[a] != bits[b]
    differ = differ[differ.any(axis=1)]
    need, units = -np.log(1 - recall), 400
    best: tuple[float, list] = (float("inf"), [])
    for width in (6, 8, 9, 10, 11, 12, 14, 16, 20, 24):
        groups = _groups(bits, bits.shape[1] // width)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            d = differ[:, g].sum(axis=1) if len(differ) else np.full(1, len(g))
            step = {u: (x, [*ts, -1]) for u, (x, ts) in table.items()}
            for t in (0, 1):
                ball = sum(comb(len(g), j) for j in range(t + 1))
                met = sum(comb(len(g), j) * flip**j * (1 - flip) ** (len(g) - j) for j in range(t + 1))
                cost = 200.0 * n * ball + max((d <= t).mean(), ball / 2.0 ** len(g)) * n * n / 2
                for u, (x, ts) in table.items():
                    v = min(units, u + int(units * -np.log(1 - met) / need))
                    if v not in step or x + cost < step[v][0]:
                        step[v] = (x + cost, [*ts, t])
            table = step
        u = max(table)
        if u >= units - len(groups) and table[u][0] < best[0]:
            best = (table[u][0], [(g, t) for g, t in zip(groups, table[u][1]) if t >= 0])
    return best[1]


def _wide_probe(parts: list[tuple[list[int], int]]):
    masks = [[0] + [1 << i for i in range(len(g) if t else 0)] for g, t in parts]
    lanes = [f"w{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                w = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in lanes], axis=1)
                for k, (g, _) in enumerate(parts):
                    code = np.zeros(len(w), np.int64)
                    for bit in g:
                        code = (code << 1) | ((w[:, bit // BITS] >> np.uint64(BITS - 1 - bit % BITS)) & np.uint64(1)).astype(np.int64)
                    for flip in masks[k]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), k, np.int32)), pa.array(code ^ flip), *(b.column(c) for c in ("node", *lanes))], names=["part", "code", "node", *lanes])

    return run


def _wide_forest(w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of links that join what is linked among rows of lanes: those that have a
    neighbour are found in strips, then each row found leaves the set that later ones meet."""
    near = np.zeros(len(w), bool)
    strip = max(1, 1_000_000 // len(w))
    for at in range(0, len(w), strip):
        d = np.zeros((min(strip, len(w) - at), len(w)), np.uint16)
        for lane in range(w.shape[1]):
            d += np.bitwise_count(w[at : at + strip, lane, None] ^ w[None, :, lane])
        d[np.arange(len(d)), np.arange(at, at + len(d))] = radius + 1
        near[at : at + strip] = (d <= radius).any(axis=1)
    left, u, v = np.flatnonzero(near), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(w[left] ^ w[x]).sum(axis=1) <= radius
            got = left[hit]
            u.append(np.full(len(got), x))
            v.append(got)
            queue.extend(got.tolist())
            left = left[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def _wide_verify(radius: int):
    """Over rows sorted by (part, code, block): a forest of each run of equal keys."""
    lanes = [f"w{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4 + LANES), np.int64)
        for b in _then_none(batches):
            if b is not None:
                held = np.concatenate([held, np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "code", "block", "node", *lanes)], axis=1)])
            new = np.flatnonzero(np.r_[True, (held[1:, :3] != held[:-1, :3]).any(axis=1)]) if len(held) else np.zeros(0, np.int64)
            ends = np.r_[new[1:], len(held)] if b is None else new[1:]
            out = []
            for lo, hi in zip(new, ends):
                if hi - lo > 1:
                    w, node = held[lo:hi, 4:].view(np.uint64), held[lo:hi, 3]
                    u, v = _wide_forest(w, radius)
                    out.append(np.stack([node[u], node[v]]))
            held = held[ends[-1] :] if len(ends) else held
            both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            both = both[:, both[0] != both[1]]
            if both.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets(docs: DataFrame, text_col: str, words: int, seed: int, keep: list[str]) -> DataFrame:
    """``keep`` with ``s``: the hashes of the set of the text's word shingles."""

    def start():
        def kernel(texts: list) -> list[pa.Array]:
            own = [np.unique(_shingles(t, words, seed)).view(np.int64) for t in texts]
            ends = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))]

        return kernel

    return map_text(docs, text_col, [T.StructField("s", T.ArrayType(T.LongType(), False))], start, keep)


def _family_links(members: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Links (u, v) that join what is alike among ``members`` (_c, root) of candidate families.

    Each member is compared with its family's centre; a large family's members are dealt to
    several copies of the centre. What is unlike it is compared with all of its family.
    """
    size = materialize(members.groupBy("root").agg(F.count("*").alias("n")))
    copies = F.ceil(F.col("n") / FAMILY)
    salted = join_hot(members.where("_c <> root"), size, ["root"], "n", members.count()).select("_c", "root", F.pmod(F.xxhash64("_c"), copies).cast("int").alias("salt"))
    centre = size.select(F.col("root").alias("_c"), F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))).alias("salt")).join(sets, "_c").select(F.col("_c").alias("root"), "salt", F.col("s").alias("t"))
    both = salted.join(sets, "_c").join(centre, ["root", "salt"])
    told = materialize(both.select("_c", "root", alike(F.col("s"), F.col("t"), jaccard).alias("like")))
    good = told.where("like").select(F.col("_c").alias("u"), F.col("root").alias("v"))
    failed = told.where("NOT like").select("root").distinct()
    known = told.select(F.col("root").alias("key"), F.col("_c").alias("c"), F.col("like").alias("joined")).unionByName(size.select(F.col("root").alias("key"), F.col("root").alias("c"), F.lit(True).alias("joined")))
    left = materialize(known.join(bounded(failed.withColumnRenamed("root", "key"), failed.count(), BROADCAST_IDS), "key", "left_semi"))
    if left.isEmpty():
        return good
    as_sets = lambda rows: [np.array(x, np.int64) for x in rows]
    return good.unionByName(crowd_links(left, sets.withColumnRenamed("s", "x"), as_sets, jaccard))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, jaccard: float = 0.8, seed: int = 42) -> DataFrame:
    """(_k1, _k2, stays): for each distinct (id, text) of ``docs``, by its ``row_key``, whether it is the
    one that stays of its group of near copies.

    Texts whose sets of word shingles (A-Z lower-cased, ASCII white space; the whole sequence
    where a text has fewer words) reach the Jaccard similarity are linked, and groups are what
    links join. Candidates share a partition of their wide SimHash by ``wide_plan`` and differ in
    no more bits than all but one in a hundred pairs of that similarity; every family of
    candidates is then joined by exact similarity. The row with the least id (null last) stays;
    equal texts are near copies, and so are all texts without a word. An empty table gives an
    empty table. Rows that repeat id and text are one row here.
    """
    flip = float(np.arccos(2 * jaccard / (1 + jaccard)) / np.pi)
    total = BITS * LANES
    radius = int(np.ceil(total * flip + 2.33 * np.sqrt(total * flip * (1 - flip))))
    lanes = [f"w{i}" for i in range(LANES)]

    def start():
        def kernel(texts: list) -> list[pa.Array]:
            w = np.array([wide_fingerprint(t, words, seed) for t in texts], np.uint64).reshape(len(texts), LANES)
            return [pa.array(w[:, i].copy().view(np.int64)) for i in range(LANES)]

        return kernel

    own = docs.select(F.col(id_col).alias("_id"), *row_key(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    told = map_text(own, "_text", [T.StructField(c, T.LongType()) for c in lanes], start, ["_id", "_k1", "_k2"])
    rows = materialize(told.withColumn("node", F.xxhash64(*lanes)))
    prints = materialize(rows.select("node", *lanes).distinct())
    n = prints.count()
    sample = prints.orderBy(F.xxhash64("node")).limit(PLAN_SAMPLE).select(*lanes).toPandas().to_numpy(np.int64).copy(order="C").view(np.uint64)
    parts = wide_plan(sample, n, flip) if n > 1 else []
    probed = prints.mapInArrow(_wide_probe(parts), "part int, code long, node long, " + ", ".join(f"{c} long" for c in lanes))
    links = materialize(_blocks(probed, "node").mapInArrow(_wide_verify(radius), "u long, v long").distinct())
    members = materialize(components(links).select(F.col("node").alias("_c"), "root"))
    # One text of each fingerprint that has a candidate gives its set.
    ids = materialize(members.select("_c"))
    first = rows.withColumnRenamed("node", "_c").join(bounded(ids, ids.count(), BROADCAST_IDS), "_c").groupBy("_c").agg(F.min(F.struct("_k1", "_k2")).alias("k"))
    first = materialize(first.select("_c", "k.*"))
    texts = docs.select(*row_key(docs, id_col, text_col), F.col(text_col).alias("_text")).join(bounded(first, first.count(), BROADCAST_IDS // 4), ["_k1", "_k2"]).select("_c", "_text")
    sets = materialize(_sets(texts, "_text", words, seed, ["_c"]))
    if sets.count() > first.count():  # rows that repeat id and text
        sets = materialize(sets.dropDuplicates(["_c"]))
    groups = components(_family_links(members, sets, jaccard))
    place = F.struct(F.col("_id").isNull().alias("z"), "_id", "_k1", "_k2")
    nodes = rows.groupBy("node").agg(F.min(place).alias("low"), F.count("*").alias("_n"))
    nodes = materialize(nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = materialize(nodes.groupBy("root").agg(F.min("low").alias("best"), F.count("*").alias("_m")))
    label = materialize(join_hot(nodes.select("node", "_n", "root"), best, ["root"], "_m", n).select("node", "_n", "best._k1", "best._k2"))
    one = join_hot(rows.select("node", "_k1", "_k2"), label.select("node", "_n", F.col("_k1").alias("_b1"), F.col("_k2").alias("_b2")), ["node"], "_n", rows.count())
    return one.select("_k1", "_k2", ((F.col("_k1") == F.col("_b1")) & (F.col("_k2") == F.col("_b2"))).alias("stays"))
