"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of a benchmark item (13; an item of fewer words, but not none, is
one window). Of both sides the hashes of all k-grams of words are taken, and of every w consecutive
k-grams the least is kept (ties: all of them), with k + w - 1 = window: so any span of `window` words that
both sides share yields a kept k-gram that both share. Windows of shorter items are fingerprinted
whole (w = 1). A shared fingerprint is extended: every window around it is compared word by word.

Two plans give the same rows. Where the benchmark's text is at most BROADCAST_BYTES (measured first; an index takes
about 65 times as much as the text), its windows go to the executors as one broadcast index and each text is settled where it is read. Beyond
that, fingerprints and then windows are joined by shuffles.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import fresh, materialize, text_or_empty

WINDOW = 13
BROADCAST_BYTES = 1 << 20
#: contaminated: at least one word in `ONE_IN` is hit
ONE_IN = 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; then runs of digits, a-z and anything beyond ASCII, as UTF-8."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def shape(length: int, window: int) -> tuple[int, int]:
    """(k, w) for windows of `length` words: k + w - 1 = length."""
    k = (window + 1) // 2 if length == window else length
    return k, length - k + 1


def kgrams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k):
        if n > 0:
            out = out * _STEP + (hashes[j : j + n] ^ (hashes[j : j + n] >> np.uint64(29)))
    return out ^ (out >> np.uint64(32)) if n > 0 else out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some w consecutive ones."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = grams[:n].copy()
    for j in range(1, w):
        np.minimum(least, grams[j : j + n], out=least)
    kept = np.zeros(len(grams), dtype=bool)
    for j in range(w):
        kept[j : j + n] |= grams[j : j + n] == least
    return np.flatnonzero(kept)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0)


class Index:
    """The windows of a small benchmark: vocabulary, fingerprints by window length, and windows to items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        self.windows: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        hashes = [int(_FAR)]
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            if not words:
                continue
            for word in words:
                if word not in self.vocabulary:
                    self.vocabulary[word] = len(self.vocabulary) + 1
                    hashes.append(_hash(word))
            ids = np.array([self.vocabulary[x] for x in words], dtype=np.int32)
            length = min(len(ids), window)
            for s in range(len(ids) - length + 1):
                self.windows[length][ids[s : s + length].tobytes()].add(number)
            k, w = shape(length, window)
            grams = kgrams(np.array(hashes, dtype=np.uint64)[ids], k)
            prints[length].append(grams[winnow(grams, w)])
        self.hashes = np.array(hashes, dtype=np.uint64)
        self.prints = {n: np.unique(np.concatenate(p)) for n, p in prints.items()}
        self.windows = {n: {k: sorted(v) for k, v in by.items()} for n, by in self.windows.items()}

    def hits(self, text: str | None) -> tuple[int, int, list[str], bool]:
        """(words, words hit, ids of the items with a window in the text, sorted as strings, whether one of them is a window of full length)."""
        words = words_of(text)
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * n), dtype=np.int32, count=n)
        known = ids > 0
        run = np.cumsum(known)
        marks = np.zeros(n + 1, dtype=np.int64)
        found: set[int] = set()
        full = False
        for length, prints in self.prints.items():
            if n < length:
                continue
            k, w = shape(length, self.window)
            whole = (run[k - 1 :] - np.concatenate(([0], run[: n - k]))) == k
            if not whole.any():
                continue
            grams = kgrams(self.hashes[ids], k)
            grams[~whole] = _FAR
            at = winnow(grams, w)
            at = at[whole[at]]
            g = grams[at]
            slot = np.minimum(np.searchsorted(prints, g), len(prints) - 1)
            at = at[prints[slot] == g]
            starts = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= n - length)]
            table = self.windows[length]
            for s in starts.tolist():
                if (who := table.get(ids[s : s + length].tobytes())) is not None:
                    marks[s] += 1
                    marks[s + length] -= 1
                    found.update(who)
                    full |= length == self.window
        hit = int((np.cumsum(marks[:n]) > 0).sum())
        return n, hit, sorted(self.items[i] for i in found), full


_RESULT = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("full", BooleanType())])


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_or_empty(text_col).alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, out: str = "found") -> DataFrame:
    """docs with one more column `out`: struct<n_words, n_hit, items: sorted array of item ids as strings, full: whether a window of `window` words occurs>.

    A null text has no words; an item without words has no window; repeated items count by id once; a null
    item id counts as the empty string. Rows of docs stay as they are, repeated or not, and so do its columns, but for one named as
    `out`, which is replaced. Empty tables on either side: no rows, or no hits.
    """
    spark = docs.sparkSession
    items = _items(benchmark, item_id, item_text)
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if total > broadcast_bytes:
        return _by_shuffles(docs, items, text_col, window, out)
    index = spark.sparkContext.broadcast(Index([(r.item, r.text) for r in items.distinct().collect()], window))

    @F.pandas_udf(_RESULT)
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index.value.hits(t) for t in texts], columns=["n_words", "n_hit", "items", "full"])

    return docs.withColumn(out, find(text_or_empty(text_col)))


def _windows_of(text: str, window: int):
    """(length, position, window, fingerprint or None) are found through these arrays: words and their hashes."""
    words = words_of(text)
    return words, np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))


def _by_shuffles(docs: DataFrame, items: DataFrame, text_col: str, window: int, out: str) -> DataFrame:
    """The plan for a benchmark of any size; texts are known by a 128-bit hash, equal texts are done once."""
    t = text_or_empty(text_col)
    key = {"__t1": F.xxhash64(t), "__t2": F.xxhash64(F.lit(1), t)}
    texts = docs.select(t.alias("text"), *[c.alias(n) for n, c in key.items()])

    def item_side(batches):
        for batch in batches:
            rows = {"item": [], "length": [], "window": [], "hash": []}
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words, hashes = _windows_of(text, window)
                if not words:
                    continue
                length = min(len(words), window)
                k, w = shape(length, window)
                grams = kgrams(hashes, k)
                kept = set(winnow(grams, w).tolist())
                for s in range(max(len(words) - length, len(grams) - 1) + 1):
                    rows["item"].append(item)
                    rows["length"].append(length)
                    rows["window"].append(b" ".join(words[s : s + length]) if s <= len(words) - length else None)
                    rows["hash"].append(int(grams[s].view(np.int64)) if s in kept else None)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("item", pa.string()), ("length", pa.int64()), ("window", pa.binary()), ("hash", pa.int64())]))

    windows = materialize(items.mapInArrow(item_side, "item string, length long, window binary, hash long"), "windows")
    lengths = [r.length for r in windows.select("length").distinct().collect()]  # at most `window` of them

    def prints(batches):
        for batch in batches:
            for i, text in enumerate(batch["text"].to_pylist()):
                _, hashes = _windows_of(text, window)
                for length in lengths:
                    k, w = shape(length, window)
                    grams = kgrams(hashes, k)
                    found = np.unique(grams[winnow(grams, w)].view(np.int64))
                    one = np.ones(len(found), dtype=np.int64)
                    yield pa.RecordBatch.from_pydict({"__t1": one * batch["__t1"][i].as_py(), "__t2": one * batch["__t2"][i].as_py(), "length": one * length, "hash": found})

    theirs = windows.where("hash is not null").select("length", "hash").distinct()
    ours = texts.mapInArrow(prints, "__t1 long, __t2 long, length long, hash long")
    shared = ours.join(theirs, ["length", "hash"], "left_semi").distinct()
    shared = shared.groupBy("__t1", "__t2").agg(F.collect_list(F.struct("length", "hash")).alias("shared"))  # at most a text's own k-grams

    def spans(batches):
        for batch in batches:
            for i, text in enumerate(batch["text"].to_pylist()):
                rows = {"__t1": [], "__t2": [], "at": [], "length": [], "window": []}
                words, hashes = _windows_of(text, window)
                by = defaultdict(list)
                for x in batch["shared"][i].as_py():
                    by[x["length"]].append(x["hash"])
                for length, wanted in by.items():
                    k, w = shape(length, window)
                    at = np.flatnonzero(np.isin(kgrams(hashes, k).view(np.int64), wanted))
                    starts = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
                    for s in starts[(starts >= 0) & (starts <= len(words) - length)].tolist():
                        rows["__t1"].append(batch["__t1"][i].as_py())
                        rows["__t2"].append(batch["__t2"][i].as_py())
                        rows["at"].append(s)
                        rows["length"].append(length)
                        rows["window"].append(b" ".join(words[s : s + length]))
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("__t1", pa.int64()), ("__t2", pa.int64()), ("at", pa.int64()), ("length", pa.int64()), ("window", pa.binary())]))

    distinct = texts.groupBy("__t1", "__t2").agg(F.first("text").alias("text"))
    around = distinct.join(shared, ["__t1", "__t2"]).mapInArrow(spans, "__t1 long, __t2 long, at long, length long, window binary")
    hits = materialize(around.join(windows.where("window is not null").select("item", "length", "window").distinct(), ["length", "window"]), "hits")
    k = ["__t1", "__t2"]
    words = hits.select(*k, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("word")).distinct().groupBy(*k).agg(F.count("*").alias("n_hit"))
    who = hits.select(*k, "item", "length").distinct().groupBy(*k).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("length") == window).alias("full"))
    found = words.join(who, k).select(*[F.col(c).alias(f"f{c}") for c in k], "n_hit", "items", "full").alias("f")
    row = fresh(docs, "row")
    n_words = F.regexp_count(F.translate(t, _UPPER, _UPPER.lower()), F.lit("[0-9a-z\\x{80}-\\x{10ffff}]+")).cast("long")
    marked = docs.withColumn(row, F.struct(*[c.alias(n) for n, c in key.items()], n_words.alias("n"))).alias("d")
    r = F.col(f"d.`{row}`")
    joined = marked.join(found, (r["__t1"] == F.col("f.f__t1")) & (r["__t2"] == F.col("f.f__t2")), "left")
    made = F.struct(r["n"].alias("n_words"), F.coalesce("f.n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("f.items", F.array().cast("array<string>")).alias("items"), F.coalesce("f.full", F.lit(False)).alias("full"))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns if c != out], made.alias(out))


def is_contaminated(found: str = "found"):
    return (F.col(f"{found}.n_hit") > 0) & (F.col(f"{found}.n_hit") * ONE_IN >= F.col(f"{found}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a whole window of `window` words of the benchmark and of which less than one word in ONE_IN is hit (by shorter items), with the columns of docs.

    However long a document, a passage of the benchmark makes it go. Null and empty texts stay.
    """
    out = fresh(docs, "found")
    marked = contamination(docs, benchmark, out=out, **options)
    return marked.where(~F.col(f"`{out}`.full") & ~is_contaminated(f"`{out}`")).select(*[f"`{c}`" for c in docs.columns])
