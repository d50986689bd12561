"""Fuzzy line dedup by MinHash, by DataFrame functions alone.

A line is the set of its shingles of SHINGLE characters (code points; a shorter line is one shingle; blank lines take no
part). One letter changed inside a line of 49 characters or more leaves it at SIMILARITY. Equal lines are one: a line is
known by its 128-bit hash. One XXH64 per shingle serves all PLACES signature places: place j is the least value of
hash XOR salt j, so equal places estimate the Jaccard similarity. Shingles are taken in blocks of BLOCK_SHINGLES, each
block's least values by expressions, so that the aggregation has one row per block.

A band is ROWS places; lines that agree in a band meet in a bucket. Bands are the blocks of a design in which two bands
share one place at most, so few places serve many bands: a pair at similarity 0.8 meets with probability 0.9986, one at
0.85 with 0.9999 (independent places taken for granted).

Within a bucket a pair goes on if AGREE of its PLACES agree in their low eight bits; a pair at similarity 0.8 fails this
with a probability of 0.0005, one at 0.85 with 0.000005. Every line is held against the bucket's first. Then all lines of buckets that
still lie in several components are held against those outside the largest one, so that no pair of one bucket is left out.
That is done in cells: a bucket is a grid of BLOCK by BLOCK lines, each cell a join of its own, so a hot bucket
spreads over tasks, and a line moves once per cell. A pair that shares several buckets is looked at in one of them.

The exact Jaccard similarity of the shingle sets decides. Before it, bitmaps of the shingles (by parity) rule out pairs of the
second search that cannot be similar enough, and no others (public as the bitmap filter of set similarity joins). Of a line's pairs with one component two are verified first; of the
others, those that then still lie in different components are verified too. Components come from distributed union-find
(components.py); of each component the line that stands first (by id, then by the text's hash, then by place) stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_shuffles, fresh, materialize, row_keys
from .components import connected_components

SHINGLE = 5
#: places form ROWS rows of SIDE (a prime); band (s, x) takes place k x + s of row k, and place x of row 0
ROWS, SIDE = 5, 7
PLACES = ROWS * SIDE
BANDS = [(x, *(k * SIDE + (k * x + s) % SIDE for k in range(1, ROWS))) for s in range(SIDE) for x in range(SIDE)][:30]
SIMILARITY = 0.8
#: places of a pair that have to agree for its sets to be compared
AGREE = 20
#: shingles of one row of the aggregation
BLOCK_SHINGLES = 16
#: bands whose rows are on disk at a time
BANDS_AT_ONCE = 10
#: line ids up to which their table is broadcast to the texts (24 bytes each)
BROADCAST_LINES = 400_000
#: pairs of one line that one task verifies
LEAVES = 2_000
#: lines along each side of a cell of a bucket's grid, in the mean
BLOCK = 512
#: pairs of a bucket across its components from which bitmaps are made before the pairs are
MANY = 4_096
#: 64-bit words of a line's bitmap
WORDS = 16
#: places, of eight bits, in one word of a sketch
_PACKED = 7

#: odd steps of the golden ratio of 2**64: any distinct values serve as salts
_SALTS = [(j * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) - (1 << 63) for j in range(PLACES)]


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t1, t2 (the text's hash), line_no (from 0), line, and its hash a1, a2, without blank lines. A null text has no line."""
    key, t1, t2 = row_keys(docs, id_col, text_col)
    parts = docs.where(F.col(text_col).isNotNull()).select(key.alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    return parts.where(F.trim("line") != "").select("doc_id", "t1", "t2", "line_no", "line", F.xxhash64("line").alias("a1"), F.xxhash64(F.lit(1), "line").alias("a2"))


class Shingles(NamedTuple):
    """How a text is cut: column line to column data, the number of shingles of data, and the hash of the one at a place (from 1)."""

    data: Callable[[], Column]
    count: Callable[[], Column]
    hash: Callable[[Column], Column]
    #: hashes of one array where sets are made: 64 of a line's make a method that HotSpot leaves to its interpreter (over 8,000 bytes)
    array: int = BLOCK_SHINGLES


# UTF-32: four bytes a code point
OF_LINES = Shingles(
    lambda: F.encode("line", "UTF-32"),
    lambda: (F.octet_length("data") / 4).cast("int") - (SHINGLE - 1),
    lambda i: F.xxhash64(F.substring(F.col("data"), 4 * i - 3, F.lit(4 * SHINGLE))),
    32,
)


def _hashed(how: Shingles, lines: DataFrame, size: int, *keep: str) -> tuple[DataFrame, list[Column]]:
    """A row for every so many shingles of column line, with keep, and the hashes of its shingles; the last one fills the last row."""
    data = lines.select(*keep, how.data().alias("data")).select(*keep, "data", F.greatest(how.count(), F.lit(1)).alias("n"))
    blocks = data.select(*keep, "data", "n", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(size))).alias("i"))
    return blocks, [how.hash(F.least(F.col("i") + b, F.col("n"))) for b in range(size)]


def _blocks(how: Shingles, lines: DataFrame, *keep: str) -> DataFrame:
    """keep, and h0 ...: the hashes of the shingles of column line, BLOCK_SHINGLES a row."""
    blocks, hashes = _hashed(how, lines, BLOCK_SHINGLES, *keep)
    return blocks.select(*keep, *[h.alias(name) for h, name in zip(hashes, _HASHES, strict=True)])


def _arrays(how: Shingles, lines: DataFrame, *keep: str) -> DataFrame:
    """keep, and hs: the hashes as arrays. They are made before they are gathered, since an aggregation of objects interprets its expressions."""
    blocks, hashes = _hashed(how, lines, how.array, *keep)
    return blocks.select(*keep, F.array(*hashes).alias("hs"))


def _set(hs: Column) -> Column:
    """The distinct hashes of gathered arrays."""
    return F.array_distinct(F.flatten(F.collect_list(hs)))


_HASHES = [f"h{b}" for b in range(BLOCK_SHINGLES)]


def signatures(how: Shingles, lines: DataFrame) -> DataFrame:
    """node (a number), a1, a2, s0 ...: the signature of every distinct line. lines: a1, a2, line.

    s0 ... hold the low eight bits of each place, _PACKED to a word: an eighth of the places' size. Places that agree agree in them;
    of unequal ones 2**-8 do by chance, of the bands of unlike lines 2**-40. That makes candidates, and loses none.
    """
    places = [F.min(F.least(*[F.col(h).bitwiseXOR(F.lit(s)) for h in _HASHES])).alias(f"m{j}") for j, s in enumerate(_SALTS)]
    whole = _blocks(how, lines, "a1", "a2").groupBy("a1", "a2").agg(*places)
    words = []
    for w, at in enumerate(range(0, PLACES, _PACKED)):
        parts = [f"shiftleft(m{m} & 255L, {8 * (m - at)})" for m in range(at, min(PLACES, at + _PACKED))]
        words.append(F.expr(" | ".join(parts)).alias(f"s{w}"))
    return whole.select(F.monotonically_increasing_id().alias("node"), "a1", "a2", *words)


def _band(j: int) -> Column:
    """The key of band j: its places in the words that hold them."""
    return F.xxhash64(F.lit(j), *[F.col(f"s{m // _PACKED}").bitwiseAND(F.lit(255 << 8 * (m % _PACKED))) for m in BANDS[j]])


def _buckets(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(firsts, members). firsts: x, y: of every bucket of two lines its lines, of a larger one its smallest and largest line.
    members: key, node, first of all lines of larger buckets.

    BANDS_AT_ONCE bands are dealt out at a time, which bounds the disk that their rows take; no band is left out.
    """
    firsts, members = [], []
    for at in range(0, len(BANDS), BANDS_AT_ONCE):
        keyed = table.select("node", F.explode(F.array(*[_band(j) for j in range(at, min(len(BANDS), at + BANDS_AT_ONCE))])).alias("key"))
        met = keyed.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("n")).where("n > 1")
        met = materialize(met, "buckets")
        clean_shuffles(table.sparkSession)
        large = met.where("n > 2").select("key", F.col("x").alias("first"))
        firsts.append(met.select("x", "y"))
        members.append(materialize(keyed.join(_near(large), "key").select("key", "node", "first"), "large-buckets"))
        clean_shuffles(table.sparkSession)
    return reduce(DataFrame.unionByName, firsts), reduce(DataFrame.unionByName, members)


def _near(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has BROADCAST_LINES rows at most (of numbers)."""
    return F.broadcast(df) if df.count() <= BROADCAST_LINES else df


def _agree(x: str = "x", y: str = "y") -> Column:
    """Whether AGREE places of two sketches agree: bytes that are equal leave a zero byte behind, which keeps its high bit clear."""
    differing = []
    low, high = int.from_bytes(b"\x7f" * _PACKED, "big"), int.from_bytes(b"\x80" * _PACKED, "big")
    for w in range(-(-PLACES // _PACKED)):
        v = f"({x}{w} ^ {y}{w})"
        differing.append(f"bit_count(((({v} & {low}L) + {low}L) | {v}) & {high}L)")
    return F.expr(f"{' + '.join(differing)} <= {PLACES - AGREE}")


def _stars(firsts: DataFrame, members: DataFrame, sketches: DataFrame) -> DataFrame:
    """x, y: every bucket's lines, each with the bucket's first, where AGREE places agree."""
    pairs = firsts.unionByName(members.where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y")))
    pairs = materialize(pairs.distinct(), "first-pairs")
    sides = []
    for side in ("x", "y"):  # a small table of pairs goes to the sketches, so that only theirs are moved
        sides.append(sketches.select(*[F.col(c).alias(side + c[1:]) for c in sketches.columns]).join(_near(pairs), side))
    return sides[0].join(sides[1], ["x", "y"]).where(_agree()).select("x", "y")


def _texts(lines: DataFrame, table: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, line: the lines of the nodes."""
    nodes = materialize(nodes.distinct(), "wanted-nodes")
    wanted = materialize(table.select("node", "a1", "a2").join(_near(nodes), "node", "left_semi"), "wanted-lines")
    found = lines.select("a1", "a2", "line").join(_near(wanted), ["a1", "a2"]).groupBy("node").agg(F.first("line").alias("line"))
    return materialize(found, "candidate-lines")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("node"))


def verified(how: Shingles, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (x, y) those whose exact Jaccard similarity is at least SIMILARITY.

    Texts are moved, never sets: sets are made where the texts of a pair have met. A line with many pairs is dealt to several tasks, LEAVES pairs each.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    centers = pairs.groupBy("x").agg(F.ceil(F.count("*") / LEAVES).alias("salts"))
    dealt = pairs.join(centers, "x").select("x", "y", F.pmod(F.xxhash64("y"), "salts").alias("salt"))
    y = dealt.join(texts.select(F.col("node").alias("y"), F.col("line").alias("ly")), "y")
    x = centers.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    x = x.join(texts.select(F.col("node").alias("x"), F.col("line").alias("lx")), "x")
    both = y.repartition(parts, "x", "salt").join(x.repartition(parts, "x", "salt"), ["x", "salt"])
    sides = both.select("x", "salt", "y", F.posexplode(F.array("lx", "ly")).alias("side", "line"))
    sets = [_set(F.when(F.col("side") == k, F.col("hs"))).alias(f"s{k}") for k in (0, 1)]  # two lines' hashes
    both = _arrays(how, sides, "x", "salt", "y", "side").groupBy("x", "salt", "y").agg(*sets)
    # common >= SIMILARITY (n0 + n1 - common), with common named once: a filter works out twice what it names twice
    similar = (1 + SIMILARITY) * F.size(F.array_intersect("s0", "s1")) >= SIMILARITY * (F.size("s0") + F.size("s1")) - 1e-6
    return both.where(similar).select("x", "y")


def _bitmaps(how: Shingles, texts: DataFrame) -> DataFrame:
    """node, n (distinct shingles), w0 ...: WORDS words, a bit being the parity of the shingles whose hash falls on it."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = _arrays(how, texts.repartition(parts, "node"), "node").groupBy("node").agg(_set(F.col("hs")).alias("hs"))  # one line's hashes, where the line is
    each = sets.select("node", F.explode("hs").alias("h"))
    marked = each.select("node", F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"), F.expr(f"(h >> 6) & {WORDS - 1}").alias("word"))
    words = [F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    return marked.groupBy("node").agg(F.count("*").alias("n"), *words)


def _able() -> Column:
    """Whether the bitmaps of x and y allow SIMILARITY: a bit that differs stands for a shingle that they do not share, of which (1 - s) / (1 + s) of both sizes may be. No link is lost."""
    bits = [F.bit_count(F.col(f"xw{w}").bitwiseXOR(F.col(f"yw{w}"))) for w in range(WORDS)]
    sizes = F.col("xn") + F.col("yn")
    return (F.col("xn") >= SIMILARITY * F.col("yn")) & (F.col("yn") >= SIMILARITY * F.col("xn")) & ((1 + SIMILARITY) * sum(bits[1:], bits[0]) <= (1 - SIMILARITY) * sizes + 1e-6)


def _possible(how: Shingles, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose bitmaps allow SIMILARITY."""
    maps = materialize(_bitmaps(how, texts), "line-bitmaps")
    x, y = (_near(maps.select(*[F.col(c).alias(side if c == "node" else side + c) for c in maps.columns])) for side in ("x", "y"))
    return pairs.join(x, "x").join(y, "y").where(_able()).select(*pairs.columns)


def _left_apart(how: Shingles, lines: DataFrame, table: DataFrame, members: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """x, y, xroot, yroot: pairs of lines of one bucket that are in different components and agree in AGREE places.

    All of them, from one bucket each; a bucket of two lines has no pair but the one that _buckets() gives.
    i numbers the blocks of the lines outside the largest component (x), j those of all lines (y). Buckets with MANY pairs
    are looked at by bitmaps instead of sketches, so that they give few pairs.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    by_root = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    grids = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main")).where("roots > 1")
    apart = F.col("n") - F.col("main.n")
    grids = grids.select("key", F.col("main.root").alias("main"), F.ceil(F.col("n") / BLOCK).alias("js"), F.ceil(apart / BLOCK).alias("is"), (apart * F.col("n") >= MANY).alias("many"))
    mixed = materialize(named.join(grids, "key"), "mixed-buckets")
    keys = materialize(mixed.groupBy("node").agg(F.collect_list("key").alias("keys"), F.max("many").alias("many")), "bucket-keys")  # at most one per band
    near_keys = _near(keys.select("node", "keys"))
    own = sketches.withColumnRenamed("s", "node").join(near_keys, "node")
    found = _cells(mixed.where("not many").join(own, "node"), [c for c in sketches.columns if c != "s"], _agree(), parts)
    crowded = keys.where("many").select("node")
    if crowded.limit(1).count() == 0:
        return found
    maps = materialize(_bitmaps(how, _texts(lines, table, crowded)), "line-bitmaps")
    own = _near(maps).join(near_keys, "node")
    return found.unionByName(_cells(mixed.where("many").join(own, "node"), [c for c in maps.columns if c != "node"], _able(), parts))


def _cells(known: DataFrame, words: list[str], near: Column, parts: int) -> DataFrame:
    """The pairs of the mixed buckets in known that meet the condition near, of which words are the columns of either line."""
    place = F.xxhash64(F.lit("block"), "node")

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def side(df: DataFrame, name: str) -> DataFrame:
        own = [F.col(w).alias(name + (w[1:] if w[0] == "s" else w)) for w in words]
        return df.select(*[F.col(c).alias(name if c == "node" else f"{name}{c}") for c in ("key", "i", "j", "node", "root", "main", "keys")], *own)

    outside = known.where("root <> main").withColumn("i", F.pmod(place, "is")).withColumn("j", upto("js"))
    every = known.withColumn("j", F.pmod(place, "js")).withColumn("i", upto("is"))
    x = side(outside, "x").repartition(parts, "xkey", "xi", "xj")
    y = side(every, "y").repartition(parts, "ykey", "yi", "yj")
    cell = (F.col("xkey") == F.col("ykey")) & (F.col("xi") == F.col("yi")) & (F.col("xj") == F.col("yj"))
    once = ((F.col("yroot") == F.col("ymain")) | (F.col("x") < F.col("y"))) & (F.array_min(F.array_intersect("xkeys", "ykeys")) == F.col("xkey"))
    return x.join(y.hint("merge"), cell & (F.col("xroot") != F.col("yroot")) & near & once).select("x", "y", "xroot", "yroot")


def near_sets(how: Shingles, lines: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(a1, a2, root) for texts that are near-duplicates of a different text; root is a number that the component shares.

    lines: a1, a2, line (the text; equal texts share a1 and a2), cut into shingles as how says. more: further candidate
    pairs (x1, x2, y1, y2), verified like all others. Which number a component gets may differ between runs.
    """
    spark = lines.sparkSession
    table = materialize(signatures(how, lines), "signatures")
    clean_shuffles(spark)
    firsts, members = _buckets(table)
    sketches = table.select(F.col("node").alias("s"), *[c for c in table.columns if c[0] == "s"])
    stars = _stars(firsts, members, sketches)
    if more is not None:
        names = table.select("node", "a1", "a2")
        for side in ("x", "y"):
            more = more.join(names.select(F.col("node").alias(side), F.col("a1").alias(f"{side}1"), F.col("a2").alias(f"{side}2")), [f"{side}1", f"{side}2"])
        stars = stars.unionByName(more.select("x", "y")).distinct()
    stars = materialize(stars, "line-pairs")
    texts = _texts(lines, table, _ends(stars))
    links = materialize(verified(how, stars, texts), "line-links")
    roots = materialize(connected_components(links, "x", "y"), "line-roots")
    clean_shuffles(spark)
    apart = materialize(_left_apart(how, lines, table, members, roots, sketches), "line-pairs")
    clean_shuffles(spark)
    if apart.limit(1).count():
        texts = _texts(lines, table, _ends(apart))
        apart = materialize(_possible(how, apart, texts), "line-pairs")
        early = apart.groupBy("x", "yroot").agg(F.min("y").alias("y"), F.max("y").alias("z"))
        early = materialize(early.select("x", "y").unionByName(early.where("y <> z").select("x", F.col("z").alias("y"))), "line-pairs")
        found = materialize(verified(how, early, texts), "line-links")
        if found.limit(1).count():
            links = links.unionByName(found)
            roots = materialize(connected_components(links, "x", "y"), "line-roots")
        for side in ("x", "y"):
            now = roots.select(F.col("node").alias(side), F.col("root").alias("now"))
            apart = apart.join(now, side, "left").withColumn(f"{side}root", F.coalesce("now", f"{side}root")).drop("now")
        rest = apart.where("xroot <> yroot").select("x", "y").join(early, ["x", "y"], "left_anti")
        found = materialize(verified(how, materialize(rest, "line-pairs"), texts), "line-links")
        if found.limit(1).count():
            roots = materialize(connected_components(links.unionByName(found), "x", "y"), "line-roots")
    return table.select("node", "a1", "a2").join(roots, "node").select("a1", "a2", "root")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per line of docs that is not blank: doc_id, t1, t2 (the text's hash), line_no, component_id, keep.

    component_id is the 128-bit hash, in hex, of the line that stands first in the component: smallest id (nulls first), then the
    text's hash (repeated ids with other texts), then line_no. keep is true for that line alone. Repeated rows, of one id and text, share
    their lines and so the decision. Blank lines and null texts give no row; an empty table gives none.
    """
    lines = lines_of(docs, id_col, text_col)
    narrow = materialize(lines.drop("line"), "lines")
    roots = materialize(near_sets(OF_LINES, lines.select("a1", "a2", "line")), "line-components")
    place = F.struct(F.col("doc_id").isNotNull().alias("z"), F.col("doc_id").alias("i"), F.col("t1").alias("s"), F.col("t2").alias("t"), F.col("line_no").alias("l"))
    seen = narrow.groupBy("a1", "a2").agg(F.min(place).alias("p"), F.count("*").alias("n")).join(roots, ["a1", "a2"], "left")
    # lines that are alone need no join with their own place
    many = materialize(seen.where("n > 1 or root is not null"), "line-groups")
    groups = many.where("root is not null").groupBy("root").agg(F.min(F.struct("p", "a1", "a2")).alias("first"))
    near = many.join(groups, "root").select("a1", "a2", F.col("first.p").alias("p"), F.col("first.a1").alias("f1"), F.col("first.a2").alias("f2"))
    known = near.unionByName(many.where("root is null").select("a1", "a2", "p", F.col("a1").alias("f1"), F.col("a2").alias("f2")))
    out = narrow.join(materialize(known, "line-firsts"), ["a1", "a2"], "left")
    mine = F.col("doc_id").eqNullSafe(F.col("p.i")) & (F.col("t1") == F.col("p.s")) & (F.col("t2") == F.col("p.t")) & (F.col("line_no") == F.col("p.l"))
    name = F.lower(F.concat(F.lpad(F.hex(F.coalesce("f1", "a1")), 16, "0"), F.lpad(F.hex(F.coalesce("f2", "a2")), 16, "0")))
    return out.select("doc_id", "t1", "t2", "line_no", name.alias("component_id"), (F.col("p").isNull() | mine).alias("keep"))


def drop_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs without the lines that near-duplicate an earlier line; its columns, the text and its length (code points) set anew.

    A document that loses all its lines goes; one without a line that goes (blank and null texts among them) stays as it is. A row
    is known by its id (null or not) and its text, so rows that share an id keep their own lines; repeated rows, of one id and text, keep
    theirs each. An empty table stays empty. Columns of docs may have any names.
    """
    key, t1, t2 = row_keys(docs, id_col, text_col)
    gone = line_groups(docs, id_col, text_col).where(~F.col("keep")).groupBy("doc_id", "t1", "t2").agg(F.collect_set("line_no").alias("gone"))  # at most one document's lines
    g = materialize(gone, "gone-lines").select(F.struct("doc_id", "t1", "t2", "gone").alias("g"))
    inner, gone_name = fresh(docs, "row"), fresh(docs, "gone")
    rows = docs.withColumn(inner, F.struct(key.alias("doc_id"), t1.alias("t1"), t2.alias("t2"))).alias("d")
    g = g.withColumnRenamed("g", gone_name)
    r, s = F.col(f"d.`{inner}`"), F.col(f"`{gone_name}`")
    joined = rows.join(g, r["doc_id"].eqNullSafe(s["doc_id"]) & (r["t1"] == s["t1"]) & (r["t2"] == s["t2"]), "left")
    lines = s["gone"]
    parts = F.split(F.col(f"d.`{text_col}`").cast("string"), "\n")
    left = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~F.array_contains(lines, p["i"]))
    text = F.when(lines.isNull(), F.col(f"d.`{text_col}`")).otherwise(F.array_join(left["x"], "\n"))
    nothing = lines.isNotNull() & (F.trim(F.translate(F.array_join(left["x"], ""), "\n\r\t", "   ")) == "")
    kept = []
    for c in docs.columns:
        if c == text_col:
            kept.append(text.alias(c))
        elif c == length_col:
            kept.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            kept.append(F.col(f"d.`{c}`").alias(c))
    return joined.where(~nothing).select(*kept)
