"""Document fingerprints: a canonical exact digest, by DataFrame functions alone.

A text's canonical form: Unicode NFKC, full case folding, NFKC again, runs of white space as one space, none at the
ends. Its fingerprint is 128 bits of XXH64 (two seeds). Where several texts have one hash, their canonical
bytes are compared: texts that only share the hash get a number behind it, in the order of their bytes.
So two texts have one fingerprint exactly if their canonical forms are equal.

Normalisation and case folding are static methods of ICU, which Spark ships and calls by reflect().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, text_or_empty

#: rows that one range of ids holds, or so; and the number of ranges, which are literals of the plan, beyond which they grow instead
RANGE_ROWS, RANGES = 20_000, 4_096
#: bytes of keys up to which they are broadcast to the texts
BROADCAST_BYTES = 16 << 20


def canonical(text: Column) -> Column:
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    plain = ~text.rlike("[^\\x00-\\x7F]")  # ASCII is normal as it is
    form = F.when(plain, F.lower(text)).otherwise(compose(folded))
    return F.trim(F.regexp_replace(form, "[\\s\\p{Z}\\x85]+", " "))


def wide_hash(form: Column, bits: int = 64) -> tuple[Column, Column]:
    """Two seeded XXH64 of the canonical form; fewer bits are for tests of colliding hashes."""
    a, b = F.xxhash64(form), F.xxhash64(F.lit(1), form)
    return (F.shiftrightunsigned(a, 64 - bits), F.shiftrightunsigned(b, 64 - bits)) if bits < 64 else (a, b)


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows * 32 <= BROADCAST_BYTES else df


def _named(h1: str | Column, h2: str | Column, number: str | None = None) -> Column:
    name = F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))
    return name if number is None else F.when(F.col(number) > 0, F.concat(name, F.lit("-"), F.col(number).cast("string"))).otherwise(name)


def collisions(forms: DataFrame) -> DataFrame:
    """forms: h1, h2, form, rows at will. (h1, h2, form, number) for hashes of more than one form; forms are compared by their bytes, equal ones combined before they are moved."""
    distinct = forms.groupBy("h1", "h2", "form").agg(F.count("*").alias("n"))
    clash = distinct.groupBy("h1", "h2").agg(F.count("*").alias("of")).where("of > 1").select("h1", "h2")
    number = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("form")) - 1
    return distinct.join(clash, ["h1", "h2"]).withColumn("number", number).select("h1", "h2", "form", "number")


def fingerprint(docs: DataFrame, text_col: str = "text", *, bits: int = 64, out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of text_col in column `out`; null counts as empty, and texts without any visible sign are equal.

    Rows, repeated ones and those of one id too, and other columns stay, whatever their names; a column named as out is replaced. An empty table stays empty.
    """
    form = canonical(text_or_empty(text_col))
    h1, h2 = wide_hash(form, bits)
    hashes = docs.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    shared = materialize(hashes, "shared-hashes")
    met = docs.select(h1.alias("h1"), h2.alias("h2"), form.alias("form")).join(_near(shared, shared.count()), ["h1", "h2"])
    clash = materialize(collisions(met), "collisions")
    if clash.limit(1).count() == 0:
        return docs.select(*[F.col(f"`{x}`") for x in docs.columns if x != out], _named(h1, h2).alias(out))
    row = fresh(docs, "row")
    d, c = docs.withColumn(row, F.struct(h1.alias("h1"), h2.alias("h2"), form.alias("form"))).alias("d"), clash.alias("c")
    r = F.col(f"d.`{row}`")
    marked = d.join(c, (r["h1"] == F.col("c.h1")) & (r["h2"] == F.col("c.h2")) & (r["form"] == F.col("c.form")), "left")
    return marked.select(*[F.col(f"d.`{x}`") for x in docs.columns if x != out], _named(r["h1"], r["h2"], "c.number").alias(out))


def _keys(id_col: str, text: Column) -> dict[str, Column]:
    """Order: null ids first, then by id, then by hashes of the text (repeated ids)."""
    i = F.col(id_col).cast("long")
    return {"z": i.isNotNull(), "i": F.coalesce(i, F.lit(0).cast("long")), "s": F.xxhash64(text), "t": F.xxhash64(F.lit(1), text)}


def _range(bounds: list[int], i: Column) -> Column:
    """How many bounds are at or below i: two levels, so that many bounds cost their root."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    outer = F.size(F.filter(longs([g[0] for g in groups]), lambda b: b <= i))
    inner = F.element_at(F.array(*[longs(g) for g in groups]), F.greatest(outer, F.lit(1)))
    return F.when(outer == 0, 0).otherwise((outer - 1) * step + F.size(F.filter(inner, lambda b: b <= i)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, z, i, s, t, text, and z, i, s, t, text of the next row in ascending order of the id as nz .. ntext (after the last: the first).

    Rows are moved once, to ranges of ids; the first row of each range is also sent to the end of the range before.
    """
    text = text_or_empty(text_col)
    keys = _keys(id_col, text)
    n = docs.count()
    ranges = min(RANGES, max(1, math.ceil(n / range_rows)))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = docs.select(F.percentile_approx(keys["i"], shares, 10 * ranges)).first()[0] if shares and n else []
    bounds = sorted(set(bounds or []))
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keys.items()], text.alias("text")).withColumn("b", _range(bounds, F.col("i")))
    key = F.struct("z", "i", "s", "t")
    firsts = rows.groupBy("b").agg(F.min(key).alias("k")).orderBy("b").collect()  # one row per range
    guests = [(r.k.z, r.k.i, r.k.s, r.k.t, firsts[at - 1].b) for at, r in enumerate(firsts)]
    spark = docs.sparkSession
    invited = spark.createDataFrame(guests, "z boolean, i long, s long, t long, host int")
    again = rows.join(F.broadcast(invited), ["z", "i", "s", "t"]).select("doc_id", "z", "i", "s", "t", "text", F.col("host").alias("b"), F.lit(1).alias("guest"))
    every = rows.select("doc_id", "z", "i", "s", "t", "text", "b", F.lit(0).alias("guest")).unionByName(again)
    w = Window.partitionBy("b").orderBy("guest", "z", "i", "s", "t")
    following = [F.lead(c).over(w).alias("n" + c) for c in ("z", "i", "s", "t", "text")]
    return every.select("doc_id", "z", "i", "s", "t", "text", "guest", *following).where("guest = 0").drop("guest")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 64) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (1.0 if the fingerprints are equal, else 0.0).

    Ids are integers. The next document is that of the next larger id (null ids first; rows of one id by the hash of their texts; repeated
    rows, of one id and text, follow each other), after the last the first; a table of one row has itself as the next. A null text is empty.
    An empty table gives no row.
    """
    pairs = with_next(docs, id_col, text_col)
    other = edited(F.col("text"), F.col("ntext"))
    pairs = pairs.select("doc_id", "z", "i", "s", "t", "nz", "ni", "ns", "nt", F.length("text").cast("long").alias("n_chars"), canonical(F.col("text")).alias("f"), other.alias("e"))
    pairs = pairs.withColumn("g", canonical(F.col("e")))  # worked out once: Catalyst does not repeat what reflect() gives
    h1, h2 = wide_hash(F.col("f"), bits)
    e1, e2 = wide_hash(F.col("g"), bits)
    rows = pairs.select("doc_id", "z", "i", "s", "t", "nz", "ni", "ns", "nt", "n_chars", F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"), h1.alias("h1"), h2.alias("h2"), e1.alias("e1"), e2.alias("e2"))
    rows = materialize(rows, "edit-hashes")
    clash = _clashes(docs, rows, id_col, text_col, bits)
    key = ["z", "i", "s", "t"]
    if clash is None:
        rows = rows.withColumns({"fingerprint": _named("h1", "h2"), "edited_fingerprint": _named("e1", "e2")})
    else:  # (z, i, s, t, which, number) of texts whose hash is not theirs alone
        for which, a, b, name in ((0, "h1", "h2", "fingerprint"), (1, "e1", "e2", "edited_fingerprint")):
            mine = clash.where(F.col("which") == which).select(*key, F.col("number").alias("m"))
            rows = rows.join(mine, key, "left").withColumn(name, _named(a, b, "m")).drop("m")
        rows = materialize(rows, "edit-names")
    names = rows.groupBy(*[F.col(k).alias("n" + k) for k in key]).agg(F.first("fingerprint").alias("next_fingerprint"))
    out = rows.join(names, ["n" + k for k in key])
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


def _clashes(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame | None:
    """Compares the canonical bytes of all texts and edited texts that share a hash; None if equal hashes are equal texts."""
    key = ["z", "i", "s", "t"]
    both = rows.select(F.col("h1"), F.col("h2")).unionByName(rows.select(F.col("e1").alias("h1"), F.col("e2").alias("h2")))
    shared = materialize(both.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "shared-hashes")
    shared = _near(shared, shared.count())
    text = text_or_empty(text_col)
    texts = docs.select(*[c.alias(k) for k, c in _keys(id_col, text).items()], text.alias("text"))
    own = materialize(rows.join(shared, ["h1", "h2"], "left_semi").select(*key, "h1", "h2").distinct(), "own-shared")
    turned = rows.join(shared.select(F.col("h1").alias("e1"), F.col("h2").alias("e2")), ["e1", "e2"], "left_semi")
    turned = materialize(turned.select(*key, *["n" + k for k in key], "e1", "e2").distinct(), "edited-shared")
    one = texts.join(_near(own, own.count()), key).select(*key, F.lit(0).alias("which"), "h1", "h2", canonical(F.col("text")).alias("form"))
    n = turned.count()
    if n:
        mine = texts.join(_near(turned, n), key).dropDuplicates(key)
        next_texts = texts.select(*[F.col(k).alias("n" + k) for k in key], F.col("text").alias("ntext"))
        wanted = turned.select(*["n" + k for k in key]).distinct()
        next_texts = next_texts.join(_near(wanted, n), ["n" + k for k in key], "left_semi").dropDuplicates(["n" + k for k in key])
        two = mine.join(next_texts, ["n" + k for k in key])
        two = two.select(*key, F.lit(1).alias("which"), F.col("e1").alias("h1"), F.col("e2").alias("h2"), canonical(edited(F.col("text"), F.col("ntext"))).alias("form"))
        one = one.unionByName(two)
    found = materialize(collisions(one), "collisions")
    if found.limit(1).count() == 0:
        return None
    return materialize(one.join(found, ["h1", "h2", "form"]).select(*key, "which", "number").distinct(), "clashes")
