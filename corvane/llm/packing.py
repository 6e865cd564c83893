"""Best-fit packing: documents as token pieces, bins filled by bin completion."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_text, materialize

#: Pieces packed together by one task. More pieces make more groups, each at most one bin worse.
GROUP_PIECES = 60_000
#: Steps that the first filling of a bin may take, and that the search over all bins may take.
NODES, SEARCH = 400, 200_000
#: Bins with the most room that are searched together where all are too many for one search.
TAIL = 24
#: Windows that are completed anew once that search has ended, the bins they are drawn from, and
#: the most bins of one window.
ROUNDS, POOL, WINDOW = 12_000, 400, 16

_SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoding(ranks_file: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={_SPECIAL: len(ranks)})


def token_pieces(docs: DataFrame, tokenizer: str, ranks_file: str, pattern: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids``-free.

    A document is its token ids followed by id 0. Only documents longer than ``size`` are
    cut: the last pieces are full and the first may be shorter. ``ranks_file`` holds the same
    vocabulary as ``tokenizer`` for the faster library; what that library refuses is encoded
    with this package's own codec over ``tokenizer``.
    """
    fields = [T.StructField("_pieces", T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])))]
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def start():
        enc = _encoding(ranks_file, pattern)

        def ids_of(text: str) -> np.ndarray:
            try:
                return np.asarray(enc.encode(text, allowed_special={_SPECIAL}), "<u4")
            except ValueError:  # the regular expression gave up on a very long run
                from corvane.llm.bpe import codec

                return codec(tokenizer).encode([text])[0].astype("<u4")

        def one(text: str | None) -> list[dict]:
            ids = np.append(ids_of(text or ""), np.uint32(0)).astype("<u4")
            n = len(ids)
            first = n % size or size
            cuts = [0, *range(first, n + 1, size)]
            return [{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

        return lambda texts: [pa.array([one(t) for t in texts], kind)]

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cut = map_text(own, "_text", fields, start, keep=["_id"])
    return cut.select("_id", F.explode("_pieces").alias("p")).select(F.col("_id").alias(id_col), "p.*")


def complete(sizes: list[int], left: dict[int, int], room: int, nodes: int = NODES) -> list[int]:
    """A filling of ``room`` by lengths of ``left`` with least waste, found by branch and bound.

    ``sizes`` are the distinct lengths in ascending order. Best fit (always the largest length
    that fits) gives the first incumbent. The search then takes lengths in descending order;
    a branch is cut when its waste cannot fall below the incumbent's even if all smaller
    lengths went in, or when the filling is dominated: a length left out that fits into the
    waste would do better, and a filling that swaps one length for two with the same sum is
    tried only if the one is not there. A filling without waste ends the search.
    """
    best: list[int] = []
    at, free = bisect_right(sizes, room), room
    while at and free >= sizes[0]:
        s = sizes[at - 1]
        k = min(left[s], free // s)
        best += [s] * k
        free -= s * k
        at = min(at - 1, bisect_right(sizes, free))
    waste, budget = free, nodes
    if not waste or not sizes:
        return best
    total, sums = 0, []  # all that the lengths up to each one hold
    for s in sizes:
        total += s * left[s]
        sums.append(total)
        if total >= room and len(sums) < len(sizes):
            sums += [total] * (len(sizes) - len(sums))
            break

    def search(at: int, free: int, chosen: list[int]) -> None:
        nonlocal best, waste, budget
        if free < waste:
            best, waste = chosen[:], free
        at = min(at, bisect_right(sizes, free))
        while at and waste and budget > 0:
            if free - min(free, sums[at - 1]) >= waste:
                return
            s = sizes[at - 1]
            if left[s] and free in left and left[free] and free != s and free not in chosen:
                best, waste = [*chosen, free], 0
                return
            top = min(left[s], free // s)
            for k in range(top, 0, -1):
                budget -= 1
                chosen += [s] * k
                search(at - 1, free - s * k, chosen)
                del chosen[-k:]
                if not waste or budget <= 0:
                    return
            at -= 1

    search(bisect_right(sizes, room), room, [])
    return best


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: for each small length a, items over ``capacity - a`` share a bin
    with nothing that counts, larger halves stand alone, and what is left must fit their rest."""
    x = np.sort(lengths)[::-1].astype(np.int64)
    total = np.r_[0, np.cumsum(x)]
    over = lambda v: int(np.searchsorted(-x, -v, side="left"))  # noqa: E731  items longer than v
    best, half = -(-int(total[-1]) // capacity), over(capacity // 2)
    for a in {0, *np.unique(x[x <= capacity // 2]).tolist()}:
        alone, end = over(capacity - a), int(np.searchsorted(-x, -a, side="right")) if a else len(x)
        free = (half - alone) * capacity - int(total[half] - total[alone])
        best = max(best, half + max(0, -(-(int(total[end] - total[half]) - free) // capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each item goes to the fullest bin that takes it."""
    free: list[int] = []
    at: dict[int, list[list[int]]] = {}
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        i = bisect_left(free, n)
        if i < len(free):
            room = free[i]
            own = at[room].pop()
            if not at[room]:
                del at[room]
                free.pop(i)
        else:
            room, own = capacity, []
            bins.append(own)
        own.append(n)
        if room - n not in at:
            insort(free, room - n)
        at.setdefault(room - n, []).append(own)
    return bins


def fillings(sizes: list[int], left: dict[int, int], room: int, waste: int, budget: list[int]) -> list[tuple[int, list[int]]]:
    """All undominated fillings (waste, lengths) of ``room`` with at most ``waste`` left, least waste first.

    ``sizes``: distinct lengths in descending order. A filling is dominated if a length left out
    can take the place of some of its lengths, not the same one alone, that are together no
    longer, without leaving the room: whatever that length would have held goes there instead.
    """
    out: list[tuple[int, list[int]]] = []
    rest = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        rest[i] = rest[i + 1] + sizes[i] * left[sizes[i]]

    def dominated(own: list[int], free: int) -> bool:
        sums = {0: 0}  # a sum, and the most lengths that make it
        for s in own:
            for t, k in list(sums.items()):
                sums[t + s] = max(sums.get(t + s, 0), k + 1)
        for x in sizes:
            if left[x] > own.count(x):
                for t, k in sums.items():
                    if t <= x <= t + free and (t < x or k > 1):
                        return True
        return False

    def grow(i: int, free: int, own: list[int]) -> None:
        budget[0] -= 1
        if budget[0] < 0 or free - rest[i] > waste:
            return
        while i < len(sizes) and (sizes[i] > free or not left[sizes[i]]):
            i += 1
        if i == len(sizes):
            if free <= waste and not dominated(own, free):
                out.append((free, own[:]))
            return
        s = sizes[i]
        for k in range(min(left[s], free // s), -1, -1):
            grow(i + 1, free - k * s, own + [s] * k)

    grow(0, room, [])
    return sorted(out, key=lambda f: (f[0], len(f[1])))


def search(lengths: list[int], capacity: int, fewer: int, steps: int = SEARCH) -> list[list[int]] | None:
    """A packing into fewer than ``fewer`` bins by bin completion, or None if there is none or the
    steps are used up. Each level fills the bin of the largest item left with one undominated
    filling after the other; a branch ends when its waste exceeds what one bin less allows."""
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    total, budget = sum(lengths), [steps]
    seen: set = set()

    def go(bins: list[list[int]], waste: int) -> list[list[int]] | None:
        sizes = sorted((s for s in left if left[s]), reverse=True)
        if not sizes:
            return bins
        state = tuple((s, left[s]) for s in sizes)
        if len(bins) + 1 >= fewer or budget[0] < 0 or state in seen:
            return None
        large = sizes[0]
        left[large] -= 1
        for free, own in fillings([s for s in sizes if left[s]], left, capacity - large, waste, budget):
            for s in own:
                left[s] -= 1
            got = go([*bins, [large, *own]], waste - free)
            for s in own:
                left[s] += 1
            if got is not None:
                return got
        left[large] += 1
        seen.add(state)
        return None

    waste = (fewer - 1) * capacity - total
    return go([], waste) if waste >= 0 else None


def greedy_completion(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins opened around the largest item left, each completed with a least-waste filling. A filling
    is used again as long as its lengths last, so the search runs per distinct filling."""
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    sizes, bins = sorted(left), []
    while sizes:
        large = sizes[-1]
        left[large] -= 1
        filling = [large, *complete(sizes if left[large] else sizes[:-1], left, capacity - large)]
        left[large] += 1
        need: dict[int, int] = {}
        for s in filling:
            need[s] = need.get(s, 0) + 1
        times = min(left[s] // k for s, k in need.items())
        bins += [list(filling) for _ in range(times)]
        for s, k in need.items():
            left[s] -= k * times
        if any(not left[s] for s in need):
            sizes = [s for s in sizes if left[s]]
    return bins


def gather(bins: list[list[int]], capacity: int, least: int, rounds: int = ROUNDS) -> list[list[int]]:
    """Fewer bins, or as many with their room in fewer of them. Windows, half of them bins with room,
    move over the bins with most room; each is completed anew from its largest items on and takes the
    place of the old one if the room is gathered no less (the sum of squared loads). A bin whose room
    has all been gathered is gone. Ends at ``least`` bins or after ``rounds`` windows."""
    rng = np.random.default_rng(17)
    bins.sort(key=sum)
    pool, rest = bins[:POOL], bins[POOL:]
    loads = [sum(b) for b in pool]
    for _ in range(rounds):
        if len(pool) + len(rest) <= least:
            break
        room = [i for i, n in enumerate(loads) if n < capacity]
        k = int(rng.integers(3, WINDOW + 1))
        own = set(rng.choice(room, min(len(room), k // 2), replace=False).tolist())
        own.update(rng.choice(len(pool), min(len(pool), k - len(own)), replace=False).tolist())
        new = greedy_completion([n for i in own for n in pool[i]], capacity)
        full = [sum(b) for b in new]
        if sum(n * n for n in full) >= sum(loads[i] ** 2 for i in own):
            pool = [b for i, b in enumerate(pool) if i not in own] + new
            loads = [n for i, n in enumerate(loads) if i not in own] + full
    return pool + rest


def bin_completion(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Lengths must lie in 1 to ``capacity``.

    Best fit and greedy completion give the incumbent. While it exceeds the lower bound, the
    branch and bound looks for one bin less, over all bins where they are few, else over the
    bins with the most room. When that finds none, ``gather`` completes windows of bins anew, and
    the search goes on from the incumbent it leaves, until neither saves a bin.
    """
    own = lengths.tolist()
    bins = min(best_fit(own, capacity), greedy_completion(own, capacity), key=len)
    least = lower_bound(lengths, capacity) if len(lengths) else 0
    before = len(bins) + 1
    while least < len(bins) < before:
        before = len(bins)
        while len(bins) > least:
            bins.sort(key=sum)
            head, rest = bins[:TAIL], bins[TAIL:]
            got = search([n for b in head for n in b], capacity, len(head))
            if got is None:
                break
            bins = got + rest
        if len(bins) > max(least, TAIL):  # fewer bins were all in the search
            bins = gather(bins, capacity, least)
    order = np.argsort(lengths, kind="stable")
    values, first = np.unique(lengths[order], return_index=True)
    next_at = dict(zip(values.tolist(), first.tolist()))
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for n in b:
            row = order[next_at[n]]
            next_at[n] += 1
            place[row], offset[row] = k, at
            at += n
    return place, offset


def pack(pieces: DataFrame, size: int = 2048, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: bins of ``size`` tokens, gapless from 0.

    Pieces of full length are sequences by themselves and are never grouped. The others are
    dealt by a hash of their key and place (so no length, document or repeated row can fill one
    group) to as many groups as their counted number asks for; each group is packed by bin
    completion in one task of bounded size. Lengths must lie in 1 to ``size``. ``sequence_id`` is unique over
    all groups. Repeated rows are packed like others. Columns named ``sequence_id`` or
    ``offset`` are replaced, others pass through.
    """
    rows = pieces.drop("sequence_id", "offset")
    part = rows.where(F.col(length_col) < size)
    full = rows.where(F.col(length_col) >= size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    groups = max(1, -(-part.count() // GROUP_PIECES))
    # Rows that repeat have one key: their places in the stored table tell them apart.
    dealt = part.withColumn("_g", F.pmod(F.xxhash64(*key_cols, F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = rows.columns

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length_col, *key_cols], kind="stable")
        bins, offset = bin_completion(pdf[length_col].to_numpy(np.int64), size)
        return pdf[names].assign(sequence_id=bins * groups + int(key[0]), offset=offset)

    return dealt.groupBy("_g").applyInPandas(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, ranks_file: str, pattern: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut ``docs`` into pieces and pack them (see ``token_pieces`` and ``pack``).

    Null and empty texts are one piece of one token. An empty table gives an empty table;
    rows that repeat are separate documents; other columns are ignored whatever their names.
    """
    return pack(materialize(token_pieces(docs, tokenizer, ranks_file, pattern, size, id_col, text_col)), size, key_cols=(id_col, "piece"))
