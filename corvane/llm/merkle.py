"""Merkle manifest of a table: a tree of hashes a group, one over the groups' roots, and each row's
proof. Blocks of rows are reduced where they lie; the driver builds the small tree above them, and
the paths from it to the root are broadcast to the tasks that finish each row's proof."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import bounded, materialize

#: Children of a node.
FAN = 16
#: Levels that one block takes away: blocks of ``FAN ** BLOCK_LEVELS`` nodes.
BLOCK_LEVELS = 3
#: Nodes that the driver may hold; more are reduced in blocks again.
TOP = 2048
_PATH = "array<struct<at:int,others:array<string>>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_hash(*values: Column) -> Column:
    """The digest of values told apart by their sizes: ``-`` for null, else UTF-8 bytes, ``:``, value."""
    said = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    step = lambda at, run: digest(F.array_join(F.concat(F.slice(run["others"], F.lit(1), run["at"]), F.array(at), F.slice(run["others"], run["at"] + 1, F.lit(FAN))), ""))
    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """The digests of a proof in one array, level by level, left to right."""
    return F.flatten(F.transform(path, lambda run: run["others"]))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (_g, ...) with _pos, the place within _g by ``order``, and _n, the number of rows of _g.

    A range sort, so a group of any size lies in as many tasks as it needs; the counts of groups by
    task tell where each task's part of a group begins. The rows' own numbers go last in the
    order: they keep the many copies of one row apart, which are the same leaf in any order.
    """
    own = materialize(rows.withColumn("_m", F.monotonically_increasing_id()))
    keys = ["_g", *order, "_m"]
    put = materialize(own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_m").withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33).alias("_task")
    parts = put.groupBy("_g", task).agg(F.count("*").alias("_c"), F.min("_at").alias("_from"))
    by = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(by.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.select("_g", "_task", (before - F.col("_from")).alias("_shift"), F.sum("_c").over(by).alias("_n")))
    both = put.withColumn("_task", task).join(bounded(parts, parts.count()), ["_g", "_task"])
    return both.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift")


def _above(level: Column) -> Column:
    """The digests of a level's runs."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / FAN).cast("int") - 1)
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(level, r * FAN + 1, F.lit(FAN)), "")))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Stored blocks of ``nodes`` (_g, _pos, _n, _digest, _row): their members in order, the levels
    above them (empty where the group's tree ends below), and the last level's only node."""
    size = FAN**BLOCK_LEVELS
    member = F.struct(F.col("_pos"), F.col("_digest"), F.col("_row"))
    out = nodes.groupBy("_g", "_n", F.floor(F.col("_pos") / size).cast("long").alias("_block")).agg(F.array_sort(F.collect_list(member)).alias("_m"))
    out = out.withColumn("_l0", F.transform("_m", lambda m: m["_digest"]))
    none = F.array().cast("array<string>")
    for k in range(BLOCK_LEVELS):
        out = out.withColumn(f"_l{k + 1}", F.when(F.col("_n") > FAN**k, _above(F.col(f"_l{k}"))).otherwise(none))
    node = F.coalesce(*[F.when(F.size(f"_l{k}") > 0, F.element_at(f"_l{k}", 1)) for k in range(BLOCK_LEVELS, -1, -1)])
    return materialize(out.select("_g", "_n", "_block", "_m", *[f"_l{k}" for k in range(BLOCK_LEVELS)], node.alias("_node")))


def _upper(blocks: DataFrame) -> DataFrame:
    """The blocks' nodes as nodes of their groups' smaller trees."""
    n = F.ceil(F.col("_n") / FAN**BLOCK_LEVELS).cast("long")
    return blocks.select("_g", F.col("_block").alias("_pos"), n.alias("_n"), F.col("_node").alias("_digest"))


def _run(level: Column, at: Column) -> Column:
    """One step of a path: the place within its run, and the run's other digests."""
    own = (at % FAN).cast("int")
    run = F.slice(level, (F.floor(at / FAN) * FAN + 1).cast("int"), F.lit(FAN))
    return F.struct(own.alias("at"), F.filter(run, lambda x, k: k != own).alias("others"))


def _expanded(blocks: DataFrame, paths: DataFrame, rows: int) -> DataFrame:
    """(_g, _pos, _digest, _row, path, subroot, root) of each member, from its block's levels and the
    path above the block. Runs of siblings are taken apart first, as they share all but one step."""
    above = paths.select(F.col("_g"), F.col("_pos").alias("_block"), "path", "subroot", "root")
    both = blocks.join(bounded(above, rows, TOP), ["_g", "_block"])
    steps = lambda r: F.filter(F.array(*[F.when(F.col("_n") > FAN**k, _run(F.col(f"_l{k}"), F.floor(r / FAN ** (k - 1)))) for k in range(1, BLOCK_LEVELS)], F.lit(None).cast("struct<at:int,others:array<string>>")), lambda s: s.isNotNull())
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_m") / FAN).cast("int") - 1), lambda r: F.struct(F.slice("_m", r * FAN + 1, F.lit(FAN)).alias("m"), steps(r).alias("steps")))
    run = both.select("_g", "_n", F.explode(runs).alias("_r"), "path", "subroot", "root")
    run = run.select("_g", "_n", "_r.m", F.transform("_r.m", lambda m: m["_digest"]).alias("_l"), F.concat("_r.steps", "path").alias("_up"), "subroot", "root")
    one = run.select("_g", "_n", F.posexplode("m").alias("_i", "_x"), "_l", "_up", "subroot", "root")
    first = F.when(F.col("_n") > 1, F.array(_run(F.col("_l"), F.col("_i")))).otherwise(F.array().cast(_PATH))
    return one.select("_g", "_x._pos", "_x._digest", "_x._row", F.concat(first, "_up").alias("path"), "subroot", "root")


def _tree(digests: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root of a list of nodes, and the path of each."""
    from hashlib import sha256

    paths: list[list[tuple[int, list[str]]]] = [[] for _ in digests]
    width, level = 1, digests
    while len(level) > 1:
        for i, path in enumerate(paths):
            at = i // width
            low = at - at % FAN
            path.append((at % FAN, level[low:at] + level[at + 1 : low + FAN]))
        level = [sha256("".join(level[k : k + FAN]).encode()).hexdigest() for k in range(0, len(level), FAN)]
        width *= FAN
    return level[0], paths


def _top(nodes: DataFrame) -> DataFrame:
    """The trees above at most ``TOP`` nodes, on the driver."""
    rows = sorted(nodes.select("_g", "_pos", "_digest").collect(), key=lambda r: (r._g.encode(), r._pos))
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r._g, []).append(r)
    subs = {g: _tree([r._digest for r in own]) for g, own in groups.items()}
    root, above = _tree([sub for sub, _ in subs.values()])
    out = [(r._g, r._pos, path + up, sub, root) for (g, (sub, paths)), up in zip(subs.items(), above) for r, path in zip(groups[g], paths)]
    return nodes.sparkSession.createDataFrame(out, f"_g string, _pos long, path {_PATH}, subroot string, root string")


def _paths(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(_g, _pos, path, subroot, root) of ``nodes``, and how many there are."""
    if (count := nodes.count()) <= TOP:
        return _top(nodes), count
    if nodes.where("_n > 1").isEmpty():
        # Only groups' roots are left: nodes of the tree over the groups, in the groups' order.
        ranked = _ranked(nodes.select(F.lit("").alias("_g"), F.col("_g").alias("_own"), "_digest"), ["_own"])
        blocks = _blocks(ranked.select("_g", "_pos", "_n", "_digest", F.struct("_own").alias("_row")))
        out = _expanded(blocks, *_paths(_upper(blocks))).select(F.col("_row._own").alias("_g"), F.lit(0).cast("long").alias("_pos"), "path", F.col("_digest").alias("subroot"), "root")
    else:
        blocks = _blocks(nodes.withColumn("_row", F.struct(F.lit(0).alias("none"))))
        out = _expanded(blocks, *_paths(_upper(blocks))).select("_g", "_pos", "path", "subroot", "root")
    return materialize(out), count


def merkle_manifest(leaves: DataFrame, group_col: str = "source", order_col: str = "doc_id", leaf_col: str = "leaf") -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``path`` (from the leaf up: the place within its run of
    at most ``FAN`` nodes, and the run's other digests).

    Within a group, leaves stand by ``order_col``, nulls first, ties by digest; while a level has
    more than one node, each run of ``FAN`` neighbours (the last may be short) becomes the digest of
    its digests. The groups' roots, by name (null first, then by UTF-8 bytes), likewise give the
    root. Rows that repeat all count; a null digest counts as an empty text. Columns of these three
    names are replaced, others pass through. An empty table gives an empty table.

    Groups of any size are cut into blocks of one size, so none meets in one task; the text of the
    rows takes no part, only what ``leaves`` holds. What the driver collects and broadcasts is at
    most ``TOP`` nodes and their paths, however large the table.
    """
    made = ("subroot", "root", "path")
    kept = [c for c in leaves.columns if c not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    g = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group_col}`").cast("string")), F.lit("n"))
    rows = leaves.select(g.alias("_g"), F.col(f"`{order_col}`").alias("_order"), F.coalesce(F.col(f"`{leaf_col}`"), F.lit("")).alias("_digest"), row.alias("_row"))
    ranked = _ranked(rows, ["_order", "_digest"])
    blocks = _blocks(ranked.select("_g", "_pos", "_n", "_digest", "_row"))
    if blocks.isEmpty():
        return leaves.select(*kept, F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(_PATH).alias("path")).limit(0)
    return _expanded(blocks, *_paths(_upper(blocks))).select(*[F.col(f"_row.`{c}`") for c in kept], *made)


def nibble_table() -> list[int]:
    """The CRC-32 remainders of the 16 half bytes, from the polynomial."""
    return [reduce(lambda c, _: c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1, range(4), i) for i in range(16)]


def oracle(levels: int = 5, top: int = 3) -> str:
    """The manifest of ``documents`` in SQL, for groups of at most 16 ** ``levels`` rows and 16 ** ``top``
    groups. Levels that a smaller tree lacks pass their only node on."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    half = lambda c, b: f"xor({c} >> 4, list_extract({nibble_table()}, (xor({c}, {b}) & 15) + 1))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {half(half('c', 'b'), '(b >> 4)')}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"x AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS seen FROM documents)", "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM x)", "l0 AS (SELECT source, pos, n, leaf AS h FROM a0)"]
    for k in range(levels):
        sql.append(f"r{k} AS (SELECT source, pos // 16 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM l{k} GROUP BY source, pos // 16)")
        sql.append(f"l{k + 1} AS (SELECT source, run AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{k})")
    sql.append(f"t0 AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM l{levels})")
    for k in range(top):
        sql.append(f"u{k} AS (SELECT pos // 16 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM t{k} GROUP BY pos // 16)")
        sql.append(f"t{k + 1} AS (SELECT run AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM u{k})")
    step = lambda at: f"CASE WHEN r.n > 1 THEN proof || array_to_string(list_concat(r.hs[:{at}], r.hs[{at} + 2:]), '') ELSE proof END AS proof, CASE WHEN r.n > 1 THEN sha256(array_to_string(r.hs[:{at}], '') || acc || array_to_string(r.hs[{at} + 2:], '')) ELSE acc END AS acc"
    sql.append("f0 AS (SELECT doc_id, source, leaf, pos, '' AS proof, seen AS acc FROM a0)")
    for k in range(levels):
        sql.append(f"f{k + 1} AS (SELECT doc_id, f.source, leaf, f.pos // 16 AS pos, {step('(f.pos % 16)')} FROM f{k} f JOIN r{k} r ON f.source IS NOT DISTINCT FROM r.source AND f.pos // 16 = r.run)")
    sql.append(f"g0 AS (SELECT doc_id, leaf, t0.pos, t0.h AS subroot, proof, acc FROM f{levels} f JOIN t0 ON f.source IS NOT DISTINCT FROM t0.source)")
    for k in range(top):
        sql.append(f"g{k + 1} AS (SELECT doc_id, leaf, g.pos // 16 AS pos, subroot, {step('(g.pos % 16)')} FROM g{k} g JOIN u{k} r ON g.pos // 16 = r.run)")
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.h AS verified FROM g{top}, t{top} t"
