"""Removal of byte strings that occur more than once, by a hash-compared suffix sort.

A string of LENGTH bytes is a window; every window that also starts anywhere else is covered, and covered bytes go.

1. Windows meet by anchors. A window's anchor is the least hashed GRAM-byte string in it (the leftmost of
   equal ones), so equal windows have equal anchors at equal places. Runs of windows share an anchor, about one per
   85 bytes. Texts are known by a 128-bit hash; equal texts are one text here, and if long enough are covered whole.
2. Anchors whose hash occurs once are done with. Of the others, the bytes that their run of windows
   spans are taken; equal spans are folded by a grouped count, so that a passage which many texts share moves once.
3. An anchor with more than CROWD different spans is split: its windows by the anchor's place in them, in halves, and each half by the
   bytes around the anchor that all its windows hold. Equal windows stay together, and spans are folded anew. This is done
   until no group is crowded, at the latest when a group's windows are all equal.
4. Within one group, the windows (suffixes, of which LENGTH bytes count) are sorted by
   mergesort. Two suffixes are compared by their longest common extension, found by binary search over prefix
   polynomial hashes; neighbours that share LENGTH bytes are verified byte by byte.
5. The covered runs of each span go to all its places; those of one text are merged, and cut out of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialize, text_or_empty

LENGTH = 200
GRAM = 32
#: different spans of one group that one task sorts, at most
CROWD = 3_000
#: bytes of what is joined to the texts up to which it is broadcast; beyond, the texts are shuffled
BROADCAST_BYTES = 16 << 20
#: bytes of text, and suffixes, that are worked on at a time
BLOCK, BLOCK_SUFFIXES = 1 << 20, 300_000

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, size=256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to 0 .. n - 1, and its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1024)
        up, down = np.full(size, np.uint64(_BASE)), np.full(size, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


class Hashes:
    """Prefix polynomial hashes of a buffer: of(starts, size) hashes buffer[start : start + size]."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.data = data
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.prefix[1:])

    def of(self, starts: np.ndarray, sizes) -> np.ndarray:
        return (self.prefix[starts + sizes] - self.prefix[starts]) * self.down[starts]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many bytes, up to most, the suffixes at a and b share: a binary search over hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), most, dtype=np.int64)
        for _ in range(most.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For texts that lie one after the other and end at ends: per run of windows (first start, last start, anchor, anchor's hash)."""
    none = np.zeros(0, dtype=np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    up, down = powers(len(data) + 1)
    h = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    full = h.of(at, gram)
    mixed = full ^ (full >> np.uint64(31))
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    packed = (mixed >> bits << bits) | at.astype(np.uint64)
    # sliding minimum over `span` places, by doubling
    span, done, least = length - gram + 1, 1, packed
    while done * 2 <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < span:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    where = (least[:n] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    starts = np.arange(n)
    valid = starts + length <= ends[np.searchsorted(ends, starts, side="right")]
    starts, where = starts[valid], where[valid]
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(where) != 0) | (np.diff(starts) != 1))))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    return starts[new], starts[last], where[new], full[where[new]]


def sorted_suffixes(h: Hashes, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): mergesort of suffixes within groups (given in ascending order); same: equal, verified, to the one before."""
    n = len(at)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
    begin = np.repeat(first, np.diff(np.concatenate((first, [n]))))
    end = np.repeat(np.concatenate((first[1:], [n])), np.diff(np.concatenate((first, [n]))))
    place = np.arange(n)
    width, largest = 1, int((end - begin).max(initial=0))
    while width < largest:
        run = (place - begin) // width
        low = begin + (run ^ 1) * width  # the run to merge with
        low, high = np.minimum(low, end), np.minimum(low + width, end)
        start, right = low.copy(), run % 2 == 1
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            mine, theirs = at[order[live]], at[order[mid]]
            c = h.common(mine, theirs, length)
            full = c == length
            x, y = h.data[np.minimum(mine + c, len(h.data) - 1)], h.data[np.minimum(theirs + c, len(h.data) - 1)]
            after = np.where(full, right[live], x > y)  # equal ones stay as they stood
            low[live], high[live] = np.where(after, mid + 1, low[live]), np.where(after, high[live], mid)
            live = live[low[live] < high[live]]
        own = begin + (run >> 1) * 2 * width
        to = own + (place - begin - run * width) + (low - start)
        merged = np.empty_like(order)
        merged[to] = order
        order = merged
        width *= 2
    same = np.zeros(n, dtype=bool)
    pair = np.flatnonzero(np.diff(group) == 0) + 1
    a, b = at[order[pair - 1]], at[order[pair]]
    equal = h.of(a, length) == h.of(b, length)
    pair, a, b = pair[equal], a[equal], b[equal]
    reach = np.arange(length)
    for i in range(0, len(pair), 20_000):  # the hashes agree: the bytes decide
        s = slice(i, i + 20_000)
        good = (h.data[a[s, None] + reach] == h.data[b[s, None] + reach]).all(axis=1)
        same[pair[s]] = good
        if not good.all():
            return _sorted_by_bytes(h.data, at, group, length)
    return order, same


def _sorted_by_bytes(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes: for blocks in which two different windows have one hash."""
    keys = [(g, data[a : a + length].tobytes()) for g, a in zip(group.tolist(), at.tolist(), strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    same = [i > 0 and keys[order[i]] == keys[order[i - 1]] for i in range(len(order))]
    return np.array(order, dtype=np.int64), np.array(same, dtype=bool)


def covered(spans: list[bytes], offsets: np.ndarray, classes: np.ndarray, times: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(span, first window, last window) for runs of windows that occur in another span too, or whose span occurs several times.

    Spans differ within a class (ascending), or in the anchor's place (offsets). Windows can only be equal within a class and at one
    distance from the anchor.
    """
    number = np.unique(classes, return_inverse=True)[1]
    windows = np.array([len(x) - length + 1 for x in spans])
    hit = [np.full(w, t > 1) for w, t in zip(windows.tolist(), times.tolist(), strict=True)]
    # a class needs sorting if it has other spans and one that is alone
    needy = np.bincount(number, weights=times == 1) > 0
    todo = np.flatnonzero((np.bincount(number) > 1)[number] & needy[number])
    if len(todo):
        data = np.frombuffer(b"".join(spans[j] for j in todo), dtype=np.uint8)
        size = np.array([len(spans[j]) for j in todo])
        base = np.cumsum(size) - size
        w = windows[todo]
        who = np.repeat(np.arange(len(todo)), w)
        inside = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        at = base[who] + inside
        shift = offsets[todo][who] - inside  # the anchor's place in the window
        group = number[todo][who] * length + shift
        by = np.argsort(group, kind="stable")
        order, same = sorted_suffixes(Hashes(data), at[by], group[by], length)
        dup = same.copy()
        dup[:-1] |= same[1:]
        chosen = by[order[dup]]
        for j, x in zip(who[chosen].tolist(), inside[chosen].tolist(), strict=True):
            hit[todo[j]][x] = True
    out = []
    for i, marks in enumerate(hit):
        mark = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
        out += [(i, a, b - 1) for a, b in zip(mark[::2].tolist(), mark[1::2].tolist(), strict=True)]
    return np.array(out, dtype=np.int64).reshape(-1, 3)


_T = ["t1", "t2"]


def _anchors_of(batches, length: int = LENGTH):
    for batch in batches:
        t1, t2 = batch["t1"].to_numpy(), batch["t2"].to_numpy()
        texts = batch["text"]
        at = 0
        while at < len(texts):
            parts, size, first = [], 0, at
            while at < len(texts) and (not parts or size < BLOCK):
                parts.append(texts[at].as_py())
                size += len(parts[-1])
                at += 1
            ends = np.cumsum([len(p) for p in parts])
            a, b, p, h = anchors(np.frombuffer(b"".join(parts), dtype=np.uint8), ends, length)
            which = np.searchsorted(ends, a, side="right")
            begin = (ends - [len(p) for p in parts])[which]
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "t1": t1[first + which], "t2": t2[first + which], "a": (a - begin).astype(np.int32), "b": (b - begin).astype(np.int32), "p": (p - begin).astype(np.int32)})


def _spans_of(batches):
    schema = pa.schema([("h", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("a", pa.int32()), ("offset", pa.int32()), ("span", pa.binary())])
    for batch in batches:
        for t1, t2, text, found in zip(*(batch[c].to_pylist() for c in ("t1", "t2", "text", "found")), strict=True):
            rows = [(x["h"], t1, t2, x["a"], x["p"] - x["a"], text[x["a"] : x["b"] + LENGTH]) for x in found]
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 4096], strict=True), schema, strict=True)], schema=schema)


_HITS = "k1 long, k2 long, lo long, hi long"


def _covered_of(batches):
    """Rows come sorted by h within a partition; whole classes are worked on together."""
    columns = ("h", "k1", "k2", "offset", "span", "times")
    held: list[tuple] = []

    def work(rows):
        h, k1, k2, offset, spans, times = zip(*rows, strict=True)
        hits = covered(list(spans), np.array(offset, dtype=np.int64), np.array(h, dtype=np.int64), np.array(times, dtype=np.int64))
        i = hits[:, 0]
        return pa.RecordBatch.from_pydict({"k1": np.array(k1, dtype=np.int64)[i], "k2": np.array(k2, dtype=np.int64)[i], "lo": hits[:, 1], "hi": hits[:, 2] + LENGTH})

    weight = 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in columns), strict=True):
            if weight > BLOCK_SUFFIXES and row[0] != held[-1][0]:
                yield work(held)
                held, weight = [], 0
            held.append(row)
            weight += len(row[4]) - LENGTH + 1
    if held:
        yield work(held)


def _split(crowd: DataFrame) -> DataFrame:
    """The spans of crowded groups in two parts each: windows that have the anchor in the lower or the upper half of its places, grouped by the bytes that all of a half's windows hold."""
    middle = F.floor((F.col("s1") + F.col("s2")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("s1").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("s2").alias("b"))))
    rows = crowd.withColumn("half", halves).where("half.a <= half.b")
    first = F.greatest(F.col("offset") - F.col("half.b"), F.lit(0))
    last = F.least(F.col("offset") - F.col("half.a"), F.octet_length("span") - LENGTH)
    rows = rows.withColumns({"first": first, "last": last}).where("first <= last")
    common = F.substring("span", F.col("offset") - F.col("half.a") + 1, F.col("half.a") + LENGTH - F.col("half.b"))
    return rows.select(
        F.xxhash64("h", "half.a", common).alias("h"), *_T, (F.col("a") + F.col("first")).alias("a"), (F.col("offset") - F.col("first")).alias("offset"),
        F.substring("span", F.col("first") + 1, F.col("last") - F.col("first") + LENGTH).alias("span"), F.col("half.a").alias("s1"), F.col("half.b").alias("s2"),
    )


def _runs(spans: DataFrame, uncopied: DataFrame, crowd: int) -> DataFrame:
    """t1, t2, lo, hi: the covered runs of the texts in uncopied, from spans (h, t1, t2, a, offset, span)."""
    spans, runs = spans.withColumns({"s1": F.lit(0), "s2": F.lit(LENGTH - GRAM)}), None
    while True:
        key = {"k1": F.xxhash64("h", "offset", "span"), "k2": F.xxhash64(F.lit(1), "h", "offset", "span")}
        folded = materialize(spans.groupBy("h", "offset", "span").agg(F.count("*").alias("times")).withColumns(key), "folded-spans")
        crowds = folded.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("h")
        crowds = materialize(crowds, "crowds")
        n = crowds.count()
        near = F.broadcast(crowds) if n <= 100_000 else crowds
        ready = folded.join(near, "h", "left_anti") if n else folded
        hits = ready.repartition("h").sortWithinPartitions("h").mapInArrow(_covered_of, _HITS)
        hits = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))  # one span's runs
        places = spans.withColumns(key).select("k1", "k2", *_T, "a").join(uncopied, _T, "left_semi")
        found = places.join(materialize(hits, "hits"), ["k1", "k2"]).select(*_T, F.transform("hits", lambda x: F.struct((F.col("a") + x["lo"]).alias("lo"), (F.col("a") + x["hi"]).alias("hi"))).alias("runs"))
        found = materialize(found, "covered")
        runs = found if runs is None else runs.unionByName(found)
        if not n:
            return runs
        spans = materialize(_split(spans.join(near, "h", "left_semi")), "split-spans")


_CUT = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is kept, maximal removed spans)."""
    spans = merge(runs)
    at = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True)), spans


@F.pandas_udf(_CUT)
def _cut_column(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for text, r in zip(texts, runs, strict=True):
        kept, spans = cut(bytes(text), [(x["lo"], x["hi"]) for x in r])
        out.append((len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])


def _near(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def covered_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, crowd: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, runs). texts: t1, t2 of every distinct text, its number of rows (copies). runs: t1, t2, runs: lists of covered byte ranges, which may overlap, of texts without copies."""
    t = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"), F.encode(t, "UTF-8").alias("text"))
    texts = materialize(rows.groupBy(*_T).agg(F.count("*").alias("copies"), F.min("id").alias("first")), "texts")
    found = materialize(rows.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchors_of, "h long, t1 long, t2 long, a int, b int, p int"), "anchors")
    place = F.struct("t1", "t2", "p")
    shared = found.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("h")
    kept = found.join(shared, "h", "left_semi").groupBy(*_T).agg(F.collect_set(F.struct("h", "a", "b", "p")).alias("found"))  # at most one text's anchors
    per = materialize(kept.join(texts, _T).select("first", *_T, "found"), "shared-anchors")
    size = per.agg(F.sum(24 * F.size("found") + 64)).first()[0] or 0
    # of equal texts the rows with the smallest id stand for all, and of those one
    r, q = rows.alias("r"), _near(per, size).alias("q")
    one = r.join(q, (F.col("r.t1") == F.col("q.t1")) & (F.col("r.t2") == F.col("q.t2")) & F.col("r.id").eqNullSafe(F.col("q.first"))).select("r.t1", "r.t2", "text", "found")
    spans = one.mapInArrow(_spans_of, "h long, t1 long, t2 long, a int, offset int, span binary")
    repeated = rows.groupBy("id", *_T).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    spans = materialize(spans.dropDuplicates(["h", *_T, "a"]) if repeated else spans, "spans")
    return texts, _runs(spans, texts.where("copies = 1").select(*_T), crowd or CROWD)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", crowd: int | None = None) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. A text under LENGTH bytes keeps all. Repeated rows are copies, and so are rows of one text under several ids or
    none: covered whole. An empty table gives no row. Other columns of docs are not looked at. crowd does not change the result.
    """
    t = text_or_empty(text_col)
    keys = [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2")]
    texts, runs = covered_runs(docs, id_col, text_col, crowd=crowd)
    copied = materialize(texts.where("copies > 1").select(*_T, "copies"), "copied")
    own = materialize(runs.groupBy(*_T).agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")  # at most one text's
    size = own.agg(F.sum(24 * F.size("runs") + 64)).first()[0] or 0
    bodies = docs.select(*keys, F.encode(t, "UTF-8").alias("text")).join(_near(own, size), _T)
    made = materialize(bodies.select(*_T, _cut_column("text", "runs").alias("c")).select(*_T, "c.*"), "cut")
    rows = docs.select(F.col(id_col).alias("id"), *keys, F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(F.encode(t, "UTF-8"), 256).alias("whole"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    joined = rows.join(made, _T, "left").join(copied, _T, "left")
    return joined.select(
        "id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
