"""Personal data: pattern spans, and terms that disclose a protected value. Spark expressions only.

Base spans are found by patterns. Words are weighed by what the corpus says about them: a term
discloses a protected value e when the pointwise mutual information of term and value reaches a
share of the information content of e, that is
``log(n_te * N / (n_t * n_e)) >= share * log(N / n_e)``. All four count whole documents, rows that
repeat included. A disclosing term is a span wherever it stands, in texts without the value too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded, materialize, once, row_key, running

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Slices of the documents over which terms are counted, in parts of the last number.
SLICES = (1, 4, 16, 64)
_A, _B, _C = "\u0001", "\u0002", "\u0003"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Limits:
    """``support``: least number of documents in which term and value meet; ``generalise`` and
    ``remove``: shares of the value's information content from which a term is replaced by its
    class, or removed."""

    support: int = 3
    generalise: float = 0.98
    remove: float = 0.999


# Fixed values. Local parts start where their run of characters starts or where the last
# match ended; elsewhere in a run the same @ would be tried again. Quantifiers are possessive
# where what follows cannot lie in them, so that no run is read twice.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole chain of digits with single separators that holds 13 to 19 digits; others fail anyway.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_WORD = r"[\p{L}][\p{L}\p{N}]++"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _found(text: Column, pattern: str, kind: str) -> Column:
    """All matches as spans in code points. Each match is put between two control characters
    (the text's own are first swapped for a third), and the string is cut at the first."""
    marked = F.regexp_replace(text, f"({pattern})", f"{_A}$1{_B}")

    def spans(parts: Column) -> Column:
        # A part behind the first holds a match, the second control character and what follows.
        ends = running(F.transform(parts, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0)), lambda a, x: a + x)

        def one(p: Column, i: Column, at: Column) -> Column:
            value = F.substring_index(p, _B, 1)
            return F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"))

        return once(ends, lambda e: F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p, i: one(p, i, F.get(e, i))))

    return once(F.split(marked, _A), lambda parts: F.when(F.size(parts) > 1, spans(parts)).otherwise(F.array().cast(_SPAN)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def passes(d: Column) -> Column:
        def weigh(acc: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return acc + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), weigh) % 10 == 0

    return once(_digits(value), passes)


def base_spans(text: Column) -> Column:
    """Spans (kind, start, end, value) of a text without nulls and control characters 1 and 2."""
    none = F.array().cast(_SPAN)
    email = F.when(F.contains(text, F.lit("@")), _found(text, _EMAIL, "email")).otherwise(none)
    numeric = F.filter(_found(text, _IP, "ip"), lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), numeric).otherwise(none)
    card = F.when(text.rlike("[0-9][ -]?[0-9]"), F.filter(_found(text, _CARD, "card"), lambda s: _luhn(s["value"]))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(_found(text, _PHONE, "phone"), lambda s: F.length(_digits(s["value"])).between(9, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _A + _B, _C + _C)


_EXTRA = "array<struct<kind:string,start:int,end:int,value:string,gone:boolean>>"
_TERMS = "array<struct<t:string,gone:boolean>>"


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def _sets(rows: DataFrame, key: str, count: str) -> DataFrame:
    """(key, count, x, y, rep) of rows (_r, key, count): keys with one count that stand in the same rows
    have one set (x, y) of rows, whose least key stands for all."""
    sets = rows.groupBy(key, count).agg(F.bit_xor(F.xxhash64(F.lit(1), "_r")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "_r")).alias("y"))
    sets = materialize(sets)
    least = sets.groupBy(count, "x", "y").agg(F.min(key).alias("rep"))
    return materialize(sets.join(least, [count, "x", "y"]))


def _disclosing(own: DataFrame, slim: DataFrame, limits: Limits) -> DataFrame | None:
    """(_k1, _k2, terms): what each text holds of the terms that disclose a value; None if no value
    is in enough documents.

    Only values and terms that can reach the limits are paired: values of ``support`` documents
    at least, and terms whose documents with such values, a lower bound of n_t, are few enough.
    Values that stand in the same documents are one when they are paired, and so are terms with
    equal counts that do: copies of a long list of addresses have a few pairs and not a square.
    """
    n = F.lit(float(max(2, slim.count())))
    some = slim.where(F.size("base") > 0).select("_r", "_text", F.array_distinct(F.transform("base", lambda s: F.lower(s["value"]))).alias("es"))
    held = materialize(some.select("_r", F.explode("es").alias("e")))
    values = materialize(held.groupBy("e").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= limits.support))
    if not (known := values.count()):
        return None
    meets = materialize(held.join(bounded(values, known), "e"))
    # n_t may be this large at most for a value of n_e documents: it grows with n_e.
    bound = F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(1 - limits.generalise)) * 1.000001
    rows = meets.groupBy("_r").agg(F.max("n_e").alias("n_e")).select("_r", bound.alias("most"))
    near = materialize(some.join(rows, "_r").select("_r", "most", F.explode(_words(F.col("_text"))).alias("t")).where("t <> ''"))
    terms = near.groupBy("t").agg(F.count("*").alias("m"), F.max("most").alias("most")).where((F.col("m") >= limits.support) & (F.col("m") <= F.col("most")))
    terms = materialize(terms.select("t", "most", F.lit(0).cast("long").alias("n_t")))
    if not (left := terms.count()):
        return None
    # n_t is counted over growing slices of the documents. A count over some is a lower bound, so
    # frequent words go early, and what is left never stands much more often than the bound.
    stands = None
    for lo, hi in zip((0, *SLICES), SLICES):
        part = own.where(F.pmod("_k1", F.lit(SLICES[-1])).between(lo, hi - 1))
        words = part.select("_k1", "_k2", F.explode(_words(F.col("_text"))).alias("t"))
        found = materialize(words.join(bounded(terms.select("t"), left), "t", "left_semi"))
        stands = found if stands is None else stands.unionByName(found)
        more = found.groupBy("t").agg(F.count("*").alias("more"))
        terms = terms.join(more, "t", "left").select("t", "most", (F.col("n_t") + F.coalesce("more", F.lit(0))).alias("n_t")).where(F.col("n_t") <= F.col("most"))
        terms = materialize(terms)
        if not (left := terms.count()):
            return None
    n_t = terms.select("t", "n_t")
    stand = materialize(near.select("_r", "t").join(bounded(n_t, left), "t"))
    one_t, one_e = _sets(stand, "t", "n_t"), _sets(meets, "e", "n_e")
    reps = lambda sets, key: sets.where(F.col(key) == F.col("rep")).select(key)
    some_t = stand.join(bounded(reps(one_t, "t"), left), "t", "left_semi")
    some_e = meets.join(bounded(reps(one_e, "e"), known), "e", "left_semi")
    pairs = some_t.join(some_e, "_r").groupBy("e", "t").agg(F.count("*").alias("n_te"), F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t"))
    content, mutual = F.log(n / F.col("n_e")), F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e")))
    share = F.when(content > 0, mutual / content).otherwise(0.0)
    told = pairs.where(F.col("n_te") >= limits.support).select(F.col("t").alias("rep"), share.alias("share")).where(F.col("share") >= limits.generalise)
    told = told.groupBy("rep").agg((F.max("share") >= limits.remove).alias("gone"))
    told = materialize(one_t.select("t", "rep").join(told, "rep").select("t", "gone"))
    return materialize(stands.join(bounded(told, told.count()), "t").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("t", "gone")).cast(_TERMS).alias("terms")))


def _spans_of(text: Column, base: Column, terms: Column) -> Column:
    """The places of ``terms`` in a text, outside its base spans."""
    gone = F.map_from_entries(terms)
    own = F.filter(_found(text, _WORD, TERM), lambda w: F.element_at(gone, F.lower(w["value"])).isNotNull())
    own = F.filter(own, lambda w: ~F.exists(base, lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    return F.transform(own, lambda w: F.struct(w["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value"), F.element_at(gone, F.lower(w["value"])).alias("gone"))).cast(_EXTRA)


def _marked(docs: DataFrame, id_col: str, text_col: str, limits: Limits, names: list[str], slim_only: bool) -> DataFrame:
    """``names`` of each row with ``base`` and ``extra``. Texts with a disclosing term are read once
    more; no other text moves."""
    own = docs.select(*[F.col(f"`{c}`") for c in names], _clean(F.col(text_col)).alias("_text"), *row_key(docs, id_col, text_col))
    found = own.withColumn("base", base_spans(F.col("_text")))
    hit = F.size("base") > 0
    slim = materialize(found.select(*(names if slim_only else []), "_k1", "_k2", "base", F.when(hit, F.col("_text")).alias("_text"), F.monotonically_increasing_id().alias("_r")))
    terms = _disclosing(own, slim, limits)
    rows, none = (slim if slim_only else found), F.array().cast(_EXTRA)
    if terms is None:
        return rows.withColumn("extra", none)
    held, most = terms.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    few = bounded(terms, held + most)
    if not slim_only:
        both = found.join(few, ["_k1", "_k2"], "left")
        return both.withColumn("extra", F.when(F.col("terms").isNull(), none).otherwise(_spans_of(F.col("_text"), F.col("base"), F.col("terms")))).drop("terms")
    told = found.join(few, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", _spans_of(F.col("_text"), F.col("base"), F.col("terms")).alias("extra"))
    told = materialize(told)
    return rows.join(bounded(told, held + most, 50_000), ["_k1", "_k2"], "left").withColumn("extra", F.coalesce("extra", none))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per input row: id, ``base`` and ``spans`` (kind, start, end, value), sorted by kind
    as listed and start; terms come last.

    Positions are code points, end exclusive. The base patterns read each text once. Counts of
    values, terms and both cover whole documents and all rows, those that repeat included. A
    disclosing term is a span in each text where it stands, outside base spans. Null and empty
    texts have no spans; an empty table gives an empty table; other columns are ignored whatever
    their names. Rows that repeat get equal results.
    """
    both = _marked(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw")), "_id", "_raw", limits, ["_id"], True)
    plain = F.transform("extra", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return both.select(F.col("_id").alias(id_col), F.col("base").cast(_SPAN).alias("base"), F.concat("base", plain).cast(_SPAN).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with the spans of ``find_pii`` taken out of ``text_col``: base values become their
    kind in brackets, terms that tell as much as the value itself are removed, other disclosing
    terms become their class: ``[CODE]`` with a digit, ``[NAME]`` with a capital first, else
    ``[TERM]``. Texts without spans, nulls included, stay as they are; all rows and columns pass
    through in their order."""
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_raw"))
    both = _marked(work, "_id", "_raw", limits, ["_row", "_raw"], False)
    text = F.when((F.size("base") == 0) & (F.size("extra") == 0), F.col("_raw")).otherwise(_sanitised())
    return both.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def _sanitised() -> Column:
    """The text with each span replaced; spans that overlap become one, named by the first. The text
    is cut in a form with four bytes a character, so that no cut scans it."""
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.concat(F.lit("["), F.upper(b["kind"]), F.lit("]")).alias("by")))
    kind = lambda v: F.when(v.rlike(r"\p{N}"), "[CODE]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
    terms = F.transform("extra", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["gone"], "").otherwise(kind(x["value"])).alias("by")))

    def joined(wide: Column, spans: Column) -> Column:
        # A mark of the byte order before each cut keeps one of the text's own from being read as such.
        cut = lambda a, b: F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring(wide, a * 4 + 1, (b - a) * 4)), "UTF-32")
        ends = F.concat(F.array(F.lit(0)), running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)))
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), s["by"])).otherwise("")
        whole = lambda e: F.concat(F.array_join(F.transform(spans, lambda s, i: piece(s, F.get(e, i))), ""), cut(F.element_at(e, -1), (F.length(wide) / 4).cast("int")))
        return once(ends, whole)

    return once(F.encode("_raw", "UTF-32"), lambda wide: once(F.array_sort(F.concat(base, terms)), lambda spans: joined(wide, spans)))
