"""SimHash near-duplicate search with Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded with zeros to a
23-bit word. The binary Golay code (23, 12) is perfect: every word has exactly one codeword at
distance 3 or less. For a word at distance 3 there are five more codewords at distance 4, for a
nearer word none. Two words that differ in at most two bits always share one of the codewords that lie
within distance 4 of both, so a word's codeword indices serve as fuzzy keys.

Two fingerprints that differ in at most two bits agree, by the pigeonhole principle, in one of the
three segments, and differ by two bits at most in each of the others. The join key is therefore
(which segment, its bits, a codeword index of the next segment): up to 18 keys per fingerprint, and no
pair within two bits is missed. Where a key gathers many fingerprints, it is split by the codeword
indices of the third segment, which such a pair shares too. Every candidate is verified by its bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import keep_rows, materialize, row_keys, text_or_empty
from .components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
#: fingerprints under one key beyond which the third segment splits it
CROWDED = 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as an unsigned int: A-Z lower-cased, words cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    if n < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_intdigest
        spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n - shingle + 1)
    # eight byte columns, then bits, in blocks: bounded memory for a text of any length
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def simhash_column(text: str | Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long; a null text counts as empty."""

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text_or_empty(text))


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2**11 syndromes: its error pattern of weight 3 at most; the 253 codewords of weight 7."""
    generator = 0b101011100011  # fixed value: a generator polynomial of the (23, 12) Golay code

    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= generator << (bit - 11)
        return word

    single = [rest(1 << i) for i in range(23)]
    error = np.zeros(1 << 11, dtype=np.int64)
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    words = np.array([m << 11 | rest(m << 11) for m in range(1 << 12)], dtype=np.int64)
    return error, words[np.bitwise_count(words) == 7]


def golay_indices(words: np.ndarray) -> list[np.ndarray]:
    """For 23-bit words: the 12-bit indices of all codewords within distance 4 (one, or six)."""
    error, heavy = _golay()
    words = np.asarray(words, dtype=np.int64)
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (0b101011100011 << (bit - 11)), rest)
    e = error[rest]
    near = words ^ e
    out = []
    far = np.bitwise_count(e) == 3
    covers = (heavy[None, :] & e[:, None]) == e[:, None]
    for i in range(len(words)):
        if far[i]:
            out.append(np.concatenate(([near[i]], near[i] ^ heavy[covers[i]])) >> 11)
        else:
            out.append(near[i : i + 1] >> 11)
    return out


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]


def _keys(batches):
    """(fp) to (key, fp, third): one row per key; third holds the third segment's indices, for crowded keys."""
    import pyarrow as pa

    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(signed), 4096):
            part = signed[at : at + 4096]
            seg = _segments(part.view(np.uint64))
            idx = [golay_indices(s) for s in seg]
            keys, fps, third = [], [], []
            for i in range(len(part)):
                for s in range(3):
                    other = idx[(s + 2) % 3][i].tolist()
                    for g in idx[(s + 1) % 3][i].tolist():
                        keys.append((s << 40) | (int(seg[s][i]) << 12) | g)
                        fps.append(int(part[i]))
                        third.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(third, pa.list_(pa.int64()))], ["key", "fp", "third"])


def near_links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in at most MAX_BITS bits."""
    keyed = materialize(fps.mapInArrow(_keys, "key long, fp long, third array<bigint>"), "simhash-keys")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(counts, "key"), "simhash-shared")
    plain = shared.where(F.col("n") <= CROWDED).select("key", F.lit(-1).cast("long").alias("g"), "fp")
    crowded = shared.where(F.col("n") > CROWDED).select("key", F.explode("third").alias("g"), "fp")
    rows = plain.unionByName(crowded)
    a, b = rows.select("key", "g", F.col("fp").alias("a")), rows.select("key", "g", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return a.join(b, (a.key == b.key) & (a.g == b.g) & near).select("a", "b").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: its row_keys(), fingerprint (signed long), component_id, the smallest id reachable, and root, the
    component's smallest fingerprint.

    A null or blank text has fingerprint 0, linked like any other. A null id takes part, but never names a
    component unless the component has no other id; then component_id is null. Repeated rows stay repeated.
    """
    rows = materialize(docs.select(*row_keys(docs, id_col, text_col), simhash_column(text_col, shingle).alias("fp")), "simhash")
    seen = materialize(rows.groupBy("fp").agg(F.min("__id").alias("first")), "simhash-distinct")
    roots = connected_components(near_links(seen.select("fp")))
    named = seen.join(roots, seen.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = materialize(named.join(least, "root").select("fp", "root", "component_id"), "simhash-components")
    return rows.join(names, "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Of each component the row with the smallest id stays (nulls last; of rows tied in the id, that with the smallest text hash; of repeated rows, one)."""
    return keep_first(docs, materialize(near_groups(docs, id_col, text_col, shingle), "simhash-groups"), id_col, text_col)


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that drop_near_duplicates() keeps, given rows: the row_keys() of docs, and root (the component)."""
    one = F.struct(F.col("__id").isNull().alias("x"), F.col("__id").alias("i"), F.col("__t1").alias("s"), F.col("__t2").alias("t"))
    best = rows.groupBy("root").agg(F.min(one).alias("best"))
    kept = best.select(F.col("best.i").alias("__id"), F.col("best.s").alias("__t1"), F.col("best.t").alias("__t2"))
    n = rows.groupBy("__id", "__t1", "__t2").agg(F.count("*").alias("__n")).alias("n")
    kept = kept.alias("k")
    on = F.col("k.__id").eqNullSafe(F.col("n.__id")) & (F.col("k.__t1") == F.col("n.__t1")) & (F.col("k.__t2") == F.col("n.__t2"))
    return keep_rows(docs, materialize(n.join(kept, on, "left_semi"), "simhash-kept"), id_col, text_col)
