"""Fuzzy line deduplication by MinHash over character shingles, in Spark expressions; lines of crowded
buckets are gathered by stars, and what stays apart meets by small bitmaps of the sets first."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_IDS, bounded, join_hot, materialize, once, row_key
from corvane.llm.components import components

#: Lines of a bucket, unlike its centre, that meet the whole bucket in one task.
MEET = 2000
#: Words of 64 bits in a set's bitmap, twice the minima of a crowded line.
BIT_WORDS = 16
#: Minima that lines of a star share, so many neighbouring ones of ``BIT_WORDS / 2`` in a ring.
STARS = (5, 3)
#: Stars drawn from each crowded bucket as a whole.
WHOLE = 3
#: Hashes of a line, on average, among which each minimum of its signature is looked for at first.
LOWEST = 10


@dataclass(frozen=True)
class Shape:
    """``chars``: characters of a shingle; ``bands`` of
    ``rows`` minima each, a power of two minima in all; ``jaccard``: least similarity of shingle
    sets; ``small``: buckets of so many lines are compared pair by pair."""

    chars: int = 12
    bands: int = 4
    rows: int = 2
    jaccard: float = 0.8
    small: int = 8


def _lines(docs: DataFrame, id_col: str, text_col: str, shape: Shape) -> DataFrame:
    """Lines with a letter or digit, with their row's keys, their place and their hash, twice."""
    cut = docs.select(F.col(id_col).alias("_id"), *row_key(docs, id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("_k", "_line"))
    cut = cut.select("_id", "_k1", "_k2", "_k", _trimmed(F.col("_line")).alias("_line"))
    return cut.where(_lettered(F.col("_line"))).withColumns({"_c": F.xxhash64("_line"), "_d": F.xxhash64(F.lit(1), "_line")})


def _trimmed(line: Column) -> Column:
    """The line without white space at its ends. Most have none, and a trim walks the whole line."""
    padded = [f(F.lit(x)) for x in " \t\r" for f in (line.startswith, line.endswith)]
    return F.when(reduce(or_, padded), F.trim(line, F.lit(" \t\r"))).otherwise(line)


def _lettered(line: Column) -> Column:
    """Whether the line has a letter or digit. Most begin with one, as the order of strings tells."""
    first = [(line >= lo) & (line < hi) for lo, hi in (("a", "{"), ("A", "["), ("0", ":"))]
    return reduce(or_, first) | line.rlike(r"[\p{L}\p{N}]")


def _starts(wide: Column, chars: int, size: int = 4) -> Column:
    """The bytes, from 1, at which shingles start."""
    return F.sequence(F.lit(1), F.greatest(F.length(wide) - size * chars, F.lit(0)) + 1, F.lit(size))


def _shingle(wide: Column, at: Column, chars: int, size: int = 4) -> Column:
    """The hash of the shingle that starts at a byte. ``wide`` has ``size`` bytes a character, so
    that it is cut without a scan."""
    return F.xxhash64(F.substring(wide, at, F.lit(size * chars)))


def _shingles(line: Column, shape: Shape) -> Column:
    """A line's shingles in order, repeated ones too. The wide form is bound in a lambda, so that it is made once."""
    one = lambda w: F.transform(_starts(w, shape.chars), lambda i: _shingle(w, i, shape.chars))
    return once(F.encode(line, "UTF-32"), one)


def _set(line: Column, shape: Shape) -> Column:
    """The set of a line's shingles, made outside of lambdas, where it is compiled."""
    return F.array_distinct(_shingles(line, shape))


def _among(aggregate: str, rows: str) -> Column:
    """An aggregate over some rows alone. The others pass it by; an aggregate of nulls in their place
    would write its buffer anew for each of them."""
    return F.expr(f"{aggregate} FILTER (WHERE {rows})")


def _minima(lines: DataFrame, shape: Shape, lowest: int | None = None) -> DataFrame:
    """(_c, n, m0, m1, ..., _from) per distinct line, n: how often it stands. A shingle at every unit
    of UTF-16 gives one hash; its last bits name the minimum it counts for (one permutation). The
    minima are taken by the hash aggregate, combined before the shuffle, and the same aggregate
    makes the lines distinct. The list of starts reads the wide form, so that this is made once a
    line and not once a shingle.

    With ``lowest``, only hashes so low that about as many for each minimum of a line are lower
    reach the aggregate. ``_from`` is a row with a line that has others and lacks a minimum so."""
    m = shape.bands * shape.rows
    wide = lines.select("_c", "_k1", F.encode("_line", "UTF-16BE").alias("w"))
    count = F.length("w") / 2 - (shape.chars - 1)
    some = count > (lowest or 0) * m if lowest else F.lit(False)
    most = F.when(some, (2.0**64 * (lowest or 0) * m / count - 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1))
    wide = wide.select("_c", F.when(some, F.col("_k1")).alias("k"), "w", most.alias("most"))
    rows = wide.select("_c", "k", "w", "most", F.explode(_starts(F.col("w"), shape.chars, 2)).alias("i"))
    rows = rows.select("_c", "k", "i", "most", _shingle(F.col("w"), F.col("i"), shape.chars, 2).alias("h"))
    rows = rows.where((F.col("i") == 1) | (F.col("h") <= F.col("most"))) if lowest else rows
    rows = rows.select("_c", "k", "i", "h", F.when(F.col("h") <= F.col("most"), F.col("h").bitwiseAND(m - 1)).otherwise(-1).alias("r"))
    names = [f"m{k}" for k in range(m)]
    least = [_among("min(h)", f"r = {k}").alias(x) for k, x in enumerate(names)]
    out = rows.groupBy("_c").agg(_among("count(*)", "i = 1").alias("n"), *least, _among("min(k)", "i = 1").alias("_from"))
    lacks = reduce(or_, [F.col(x).isNull() for x in names])
    return out.select("_c", "n", *names, F.when(lacks, F.col("_from")).alias("_from"))


def _signatures(docs: DataFrame, id_col: str, text_col: str, shape: Shape) -> DataFrame:
    """(_c, n, m0, m1, ...) per distinct line, stored. Minima are looked for among low hashes, which
    spares the aggregate most of them; lines that lack one so, as those that repeat a few shingles
    do, get theirs from all of their hashes."""
    m = [f"m{k}" for k in range(shape.bands * shape.rows)]
    sig = materialize(_minima(_lines(docs, id_col, text_col, shape), shape, LOWEST))
    lacking = materialize(sig.where("_from IS NOT NULL").select("_c", "n", "_from"))
    if not (few := lacking.count()):
        return sig.select("_c", "n", *m)
    rows = docs.withColumn("_from", row_key(docs, id_col, text_col)[0])
    rows = rows.join(bounded(lacking.select("_from").distinct(), few, BROADCAST_IDS), "_from", "left_semi").select(id_col, text_col)
    again = _lines(rows, id_col, text_col, shape).join(bounded(lacking.select("_c"), few, BROADCAST_IDS), "_c", "left_semi")
    again = _minima(again, shape).select("_c", *m).join(bounded(lacking.select("_c", "n"), few), "_c").select("_c", "n", *m)
    return sig.where("_from IS NULL").select("_c", "n", *m).unionByName(materialize(again))


def _buckets(sig: DataFrame, shape: Shape) -> DataFrame:
    """(c, key) per line and band. A band without a shingle of the line has no bucket."""
    keys = []
    for b in range(shape.bands):
        own = [F.col(f"m{b * shape.rows + i}") for i in range(shape.rows)]
        keys.append(F.when(F.coalesce(*own).isNotNull(), F.xxhash64(F.lit(b), *own)))
    return sig.select(F.col("_c").alias("c"), F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("key"))


def _like(pairs: DataFrame, found: DataFrame, shape: Shape) -> DataFrame:
    """The pairs (u, v) with ``like``, from the lines themselves: they are shorter than their sets."""
    a, b = found.select(F.col("_c").alias("u"), F.col("_line").alias("a")), found.select(F.col("_c").alias("v"), F.col("_line").alias("b"))
    met = pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b", _outsized(F.col("a"), F.col("b"), shape).alias("out"))
    made = [F.when(~F.col("out"), f(F.col(x), shape)).alias(x) for x, f in (("a", _set), ("b", _shingles))]
    both = F.when(F.size("b") >= shape.jaccard * F.size("a") - 1e-9, F.size(F.array_intersect("a", "b"))).otherwise(-1)
    told = met.select("u", "v", *made).select("u", "v", "a", "b", both.alias("both"))
    return told.select("u", "v", F.coalesce(_reaches(F.col("both"), F.col("a"), F.col("b"), shape.jaccard), F.lit(False)).alias("like"))


def _reaches(both: Column, a: Column, b: Column, jaccard: float) -> Column:
    """Whether ``a``, a set, and that of ``b``'s members, which may repeat, reach the similarity, of which
    ``both`` are in both. Most pairs are told without the second set: it has no more members than ``b``, and
    two alike sets share that part of either one."""
    enough = lambda n: both >= F.lit(jaccard / (1 + jaccard)) * (F.size(a) + n) - 1e-9
    return F.when(both < jaccard * F.size(a) - 1e-9, False).when(enough(F.size(b)), True).otherwise(enough(F.size(F.array_distinct(b))))


def _outsized(a: Column, b: Column, shape: Shape) -> Column:
    """Whether the start of the longer line alone has more different shingles than two alike lines may,
    as the shorter one has no more than places for them."""
    longer, least = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.least(F.length(a), F.length(b))
    need = (F.greatest(least - (shape.chars - 1), F.lit(1)) / shape.jaccard + 1e-9).cast("int") + 1
    start = need + (need / 16).cast("int") + shape.chars
    return F.when(F.length(longer) < start, False).otherwise(F.size(_set(F.substring(longer, F.lit(1), start), shape)) >= need)


def line_links(lines: DataFrame, sig: DataFrame, shape: Shape = Shape()) -> tuple[DataFrame, DataFrame]:
    """Verified links (u, v) between hashes of distinct lines, from their stored signatures, and
    the stored places of lines that stand more than once or may have a link.

    Small buckets are compared pair by pair, larger ones with their least line. What is unlike it
    is gathered by ``star_pairs``, and meets what is then still apart in its bucket in
    ``crowd_links``, so every pair that shares a bucket and is alike ends in one component.
    """
    rows = _buckets(sig, shape)
    full = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("v"), F.max("c").alias("w")).where("n > 1")
    full = materialize(full)
    # A bucket of two is its own pair; only members of larger ones are looked up.
    more = full.where("n > 2").select("key", "n", "v")
    met = materialize(rows.join(bounded(more, more.count(), BROADCAST_IDS // 3), "key").select("c", "v", "n", "key"))
    crowd, few = met.where(F.col("n") > shape.small), met.where(F.col("n") <= shape.small).select("c", "key")
    within = few.join(few.select(F.col("c").alias("v"), "key"), "key").where("c > v").select(F.col("c").alias("u"), "v")
    pairs = full.where("n = 2").select(F.col("w").alias("u"), "v").unionByName(within).unionByName(crowd.where("c <> v").select(F.col("c").alias("u"), "v"))
    pairs = materialize(pairs.distinct())
    ends = pairs.select(F.explode(F.array("u", "v")).alias("_c")).groupBy("_c").agg(F.lit(True).alias("end")).unionByName(sig.where("n > 1").select("_c", F.lit(False).alias("end")))
    wanted = materialize(ends.groupBy("_c").agg(F.max("end").alias("end")))
    stored = lines.join(bounded(wanted, wanted.count(), BROADCAST_IDS), "_c").select("_id", "_k1", "_k2", "_k", "_c", "_d", F.when(F.col("end"), F.col("_line")).alias("_line"))
    stored = materialize(stored)
    found = materialize(stored.where("_line IS NOT NULL").select("_c", "_line").dropDuplicates(["_c"]))
    told = materialize(_like(pairs, found, shape))
    good = told.where("like").select("u", "v")
    # Members of larger buckets, with whether they are like the centre; others meet all exactly.
    known = crowd.join(told.withColumnRenamed("u", "c"), ["c", "v"], "left").select("key", "c", "v", F.coalesce("like", F.lit(True)).alias("joined"))
    known = materialize(known)
    failed = known.where("NOT joined").select("key").distinct()
    left = known.join(bounded(failed, failed.count(), BROADCAST_IDS), "key", "left_semi")
    roots = known.where("joined").groupBy("c").agg(F.min("v").alias("root"))
    left = materialize(left.join(roots, "c", "left").select("key", "c", "joined", F.coalesce("root", "c").alias("root")))
    if left.isEmpty():
        return good, stored
    bits = materialize(_bitmaps(left, found, shape))
    near = materialize(star_pairs(left, bits, shape))
    # Stored before it is filtered: a filter would be pushed into the comparison, which then makes its sets anew.
    stars = good.unionByName(materialize(_like(near, found, shape)).where("like").select("u", "v"))
    gathered = materialize(components(stars).select(F.col("node").alias("c"), F.col("root").alias("_root")))
    left = left.join(gathered, "c", "left").withColumn("root", F.coalesce("_root", "c")).drop("_root")
    rest = crowd_links(materialize(left), found, shape, bits)
    return gathered.select(F.col("c").alias("u"), F.col("_root").alias("v")).unionByName(rest), stored


def _bitmaps(members: DataFrame, found: DataFrame, shape: Shape) -> DataFrame:
    """(c, n, b0, b1, ..., m0, m1, ...) per line of ``members``: the size of its set, for each bit of
    a few words whether an odd number of its shingles falls on it, and minima beside the signature's.
    A shingle counts for one word and one minimum."""
    ids = members.select("c").distinct()
    lines = found.withColumnRenamed("_c", "c").join(bounded(ids, members.count(), BROADCAST_IDS), "c", "left_semi")
    rows = lines.select("c", _set(F.col("_line"), shape).alias("set")).select("c", F.explode("set").alias("h"))
    rows = rows.select("c", "h", F.shiftright("h", 6).bitwiseAND(BIT_WORDS - 1).alias("w"), F.expr("shiftleft(1L, int(h & 63))").alias("b"))
    words = [F.coalesce(_among("bit_xor(b)", f"w = {k}"), F.lit(0).cast("long")).alias(f"b{k}") for k in range(BIT_WORDS)]
    minima = [_among("min(h)", f"w % {BIT_WORDS // 2} = {k}").alias(f"m{k}") for k in range(BIT_WORDS // 2)]
    return rows.groupBy("c").agg(F.count("*").alias("n"), *words, *minima)


def _near(shape: Shape) -> Column:
    """Whether two lines, the second one's columns ending in ``_``, can be alike: a shingle that only one
    of two sets has changes one bit of their bitmaps, so these differ in no more bits than the sets in
    shingles. The first words alone decide most pairs."""
    most = (F.col("n") + F.col("n_")) * ((1 - shape.jaccard) / (1 + shape.jaccard)) + 1e-6
    differ = [F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"b{k}_"))) for k in range(BIT_WORDS)]
    total = lambda xs: sum(xs[1:], xs[0])
    return (F.abs(F.col("n") - F.col("n_")) <= most) & (total(differ[: BIT_WORDS // 4]) <= most) & (total(differ) <= most)


def _words() -> list[str]:
    return ["n", *(f"b{k}" for k in range(BIT_WORDS))]


def star_pairs(members: DataFrame, bits: DataFrame, shape: Shape) -> DataFrame:
    """Pairs (u, v) of unlinked lines that may be alike, in number linear in the members.

    Lines that share some minima, and each bucket as a whole a few times, are a star around a line
    drawn by hash, another for each star. Near copies of one text share most stars, so nearly all
    of them end in one component by these pairs, and need not meet each other in ``crowd_links``.
    """
    ring = [F.col(f"m{k}") for k in range(BIT_WORDS // 2)]
    keys = []
    for many in STARS:
        for k in range(len(ring)):
            own = [(ring + ring)[k + i] for i in range(many)]
            keys.append(F.when(~F.array_contains(F.transform(F.array(*own), lambda x: x.isNull()), True), F.xxhash64(F.lit(many), F.lit(k), *own)))
    fine = bits.select("c", F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("star"))
    whole = members.select("c", F.explode(F.array(*[F.xxhash64(F.lit(-i), "key") for i in range(WHOLE)])).alias("star"))
    rows = materialize(fine.unionByName(whole))
    stars = rows.groupBy("star").agg(F.count("*").alias("all"), F.min_by("c", F.xxhash64("star", "c")).alias("v")).where("all > 1")
    pairs = join_hot(rows, materialize(stars), ["star"], "all", rows.count()).where("c <> v")
    pairs = pairs.select(F.greatest("c", "v").alias("c"), F.least("c", "v").alias("c_")).distinct()
    own = materialize(bits.join(members.groupBy("c").agg(F.min("root").alias("root")), "c").select("c", "root", *_words()))
    other = own.select(*[F.col(x).alias(f"{x}_") for x in own.columns])
    met = pairs.join(own, "c").join(other, "c_").where((F.col("root") != F.col("root_")) & _near(shape))
    return met.select(F.col("c").alias("u"), F.col("c_").alias("v"))


def crowd_links(members: DataFrame, found: DataFrame, shape: Shape, bits: DataFrame | None = None) -> DataFrame:
    """Links (u, v) of all alike lines that share a bucket, but for two that are linked already.

    ``members``: (key, c, joined, root), stored: joined ones are linked to the bucket's centre, and
    lines of one root to one line. The others meet all of their bucket, dealt over tasks in parts of
    ``MEET``; of two lines the bitmaps (``bits``) are compared, and the sets if these can be alike.
    """
    if bits is None:
        bits = materialize(_bitmaps(members, found, shape))
    words = _words()
    size = members.groupBy("key").agg(F.count("*").alias("all"), F.ceil(F.count_if(~F.col("joined")) / MEET).cast("int").alias("parts"))
    rows = join_hot(members, materialize(size), ["key"], "all", members.count()).join(bits, "c")
    rows = materialize(rows.select("key", "c", "joined", "root", "parts", *words))
    every = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    apart = rows.where("NOT joined").withColumn("part", F.pmod(F.xxhash64("c"), "parts").cast("int"))
    apart = apart.select("key", "part", *[F.col(x).alias(f"{x}_") for x in ("c", "root", *words)])
    once_only = (F.col("root") != F.col("root_")) & (F.col("c") != F.col("c_")) & (F.col("joined") | (F.col("c") < F.col("c_")))
    met = every.join(apart.hint("merge"), ["key", "part"]).where(once_only & _near(shape))
    met = materialize(met.select(F.greatest("c", "c_").alias("u"), F.least("c", "c_").alias("v")).distinct())
    return materialize(_like(met, found, shape)).where("like").select("u", "v")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``lines_total``, ``lines_dropped`` (long).

    Lines whose shingle sets are alike are one component, however far apart; its first line,
    by id (null last) and place, stays, and the others leave all texts. Equal lines (after
    trimming) are one node from the start. A line shorter than a shingle is its own only shingle, so
    it is like its equals alone. Lines without a letter or digit (blank ones, brackets, rules) say
    nothing by themselves and always stay. What moves between stages is hashes and places
    of lines, and the text of lines to verify. Lines are named by 64-bit hashes; a second one
    guards against strangers of one name, of which the one with the larger stays.

    A null text stays null; a text may become empty, its row stays. Rows that repeat id and text
    are read as one row and get equal results. Columns pass through; those named as the counts
    are replaced. An empty table gives an empty table.
    """
    lines = _lines(docs, id_col, text_col, shape)
    sig = _signatures(docs, id_col, text_col, shape)
    links, stored = line_links(lines, sig, shape)
    roots = components(links).select(F.col("node").alias("_c"), "root")
    often = sig.select("_c", "n").join(roots, "_c", "left").where("n > 1 OR root IS NOT NULL")
    own = stored.groupBy("_c").agg(F.min("_d").alias("_d"))
    often = materialize(often.select("_c", F.coalesce("root", "_c").alias("root")).join(own, "_c"))
    held = materialize(stored.join(bounded(often, often.count(), BROADCAST_IDS // 3), ["_c", "_d"]).select("_id", "_k1", "_k2", "_k", "root"))
    place = F.struct(F.col("_id").isNull().alias("z"), "_id", "_k1", "_k2", "_k")
    first = materialize(held.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    lost = join_hot(held, first, ["root"], "n", held.count()).where(place != F.col("first"))
    lost = materialize(lost.groupBy("_k1", "_k2").agg(F.collect_set("_k").alias("_lost")))
    rows, places = lost.agg(F.count("*"), F.coalesce(F.sum(F.size("_lost")), F.lit(0))).first()
    names = [c for c in docs.columns if c not in ("lines_total", "lines_dropped", text_col)]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col), *row_key(docs, id_col, text_col))
    both = keyed.join(bounded(lost, rows + places // 4, BROADCAST_IDS // 2), ["_k1", "_k2"], "left")
    parts = F.split(F.col(text_col), "\n")

    def rest(p: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_lost")), lambda i: F.get(p, i)), "\n")

    text = F.when(F.col("_lost").isNull(), F.col(text_col)).otherwise(once(parts, rest))
    total = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    out = both.select(*[F.col(f"`{c}`") for c in names], text.alias(text_col), total.alias("lines_total"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("lines_dropped"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c in (*names, text_col)], "lines_total", "lines_dropped")
