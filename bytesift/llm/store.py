"""A content-addressed store of token ids.

Files, all Parquet in one folder (written by Spark's own committer, so a lost task leaves nothing behind):

- chunks/: one row per place of a chunk: row, seq (whose, and the how-manieth of that document), digest
  (BLAKE2b, 16 bytes, of the ids' bytes), n (ids), ids (little-endian, 2 or 4 bytes each). Only the first
  place of a chunk holds its ids: every distinct chunk is stored once.
- recipes/: one row per document, in ascending order of its id over shards and within them: shard, doc_id, row, start (ids before it),
  n_tokens, digests and lengths of its chunks in order, root (of the Merkle tree over the digests).
- manifest/: one row per shard: documents, n_tokens, start, root (of the Merkle tree over the documents' roots).

Chunks end where a rolling polynomial hash of the last ROLL ids falls below a threshold, so an edit
changes the chunks around it alone; MIN_IDS and MAX_IDS bound them.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .common import in_slices, text_or_empty
from .encode import encoder

ROLL = 16
MIN_IDS, MEAN_IDS, MAX_IDS = 96, 384, 4096
SHARD_DOCUMENTS = 65_536

_B = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, size=1 << 17, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(size: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64."""
    b, inverse = np.uint64(_B), np.uint64(pow(_B, -1, 1 << 64))
    up, down = np.full(size, b), np.full(size, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks end: the last is len(ids)."""
    up, down = _powers()
    n = len(ids)
    marks: list[np.ndarray] = []
    for at in range(0, n, len(up) - ROLL):  # blocks that overlap by the window
        part = ids[max(0, at - ROLL) : at + len(up) - ROLL]
        total = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[part.astype(np.int64) & 0x1FFFF] * up[: len(part)], dtype=np.uint64)))
        if len(part) >= ROLL:
            window = (total[ROLL:] - total[:-ROLL]) * down[: len(part) - ROLL + 1]
            marks.append(np.flatnonzero(window < np.uint64((1 << 64) // MEAN_IDS)) + ROLL + max(0, at - ROLL))
    out, last = [], 0
    for mark in np.unique(np.concatenate(marks)).tolist() if marks else []:
        while mark - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if mark - last >= MIN_IDS:
            out.append(mark)
            last = mark
    while n - last > MAX_IDS:
        last += MAX_IDS
        out.append(last)
    if n > last or not out:
        out.append(n)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves in order; an odd one out moves up as it is. No leaves: the digest of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@F.pandas_udf(BinaryType())
def _root(lists: pd.Series) -> pd.Series:
    return pd.Series([merkle([bytes(x) for x in one]) for one in lists])


_PLACE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int32()), ("digest", pa.binary()), ("n", pa.int32()), ("ids", pa.binary())])


def _places(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path)
        row = TaskContext.get().partitionId() << 33
        sent: set[bytes] = set()  # of this task: a chunk's ids leave it once
        for batch in in_slices(batches):
            out: list[tuple] = []
            for key, ids in zip(batch["doc_id"].to_pylist(), enc.encode(batch["text"].to_pylist()), strict=True):
                ids = np.append(ids, np.array([end_id], dtype=ids.dtype))
                raw, width, at = ids.tobytes(), ids.dtype.itemsize, 0
                for seq, to in enumerate(cuts(ids)):
                    data = raw[at * width : to * width]
                    name = digest(data)
                    out.append((key, row, seq, name, to - at, None if name in sent else data))
                    sent.add(name)
                    at = to
                row += 1
            for at in range(0, len(out), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 8192], strict=True), _PLACE, strict=True)], schema=_PLACE)

    return run


def write_store(docs: DataFrame, path: str, vocabulary_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends end_id, and writes the store to path, a folder that all machines see.

    A null text is empty: the end id alone. Repeated ids are documents of their own, in any order among themselves; null ids come first.
    Ids are integers. Other columns of docs are not looked at; an empty table makes a store without documents.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    places = source.mapInArrow(_places(vocabulary_path, end_id), "doc_id long, row long, seq int, digest binary, n int, ids binary")
    # places without ids are spread at will; those with ids meet by digest, and the first keeps them
    meet = places.withColumns({"at": F.when(F.col("ids").isNotNull(), F.col("digest")), "spread": F.when(F.col("ids").isNull(), F.xxhash64("row", "seq")).otherwise(0)})
    first = F.row_number().over(Window.partitionBy("at", "spread").orderBy("row", "seq"))
    meet = meet.withColumn("rank", first).withColumn("ids", F.when(F.col("rank") == 1, F.col("ids")))
    meet.select("doc_id", "row", "seq", "digest", "n", "ids").write.option("compression", "zstd").parquet(f"{path}/chunks")

    narrow = _read_chunks(spark, path).select("doc_id", "row", "seq", "digest", "n")
    parts = F.array_sort(F.collect_list(F.struct("seq", "digest", "n")))  # at most one document's chunks
    recipes = narrow.groupBy("row").agg(F.first("doc_id").alias("doc_id"), parts.alias("p")).select(
        "doc_id", "row", F.aggregate("p.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"), F.col("p.digest").alias("digests"), F.col("p.n").alias("lengths")
    )
    shards = max(1, math.ceil(narrow.where("seq = 0").count() / SHARD_DOCUMENTS))
    ranged = recipes.withColumn("root", _root("digests")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "row")
    ranged.withColumn("shard", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/unplaced")

    unplaced = spark.read.parquet(f"{path}/unplaced")
    totals = unplaced.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    totals = totals.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    inside = Window.partitionBy("shard").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    own = unplaced.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0).cast("long")))
    placed = own.join(totals.select("shard", "start"), "shard").withColumn("start", F.col("start") + F.col("inside")).drop("inside")
    placed.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "row").write.option("compression", "zstd").parquet(f"{path}/recipes")
    roots = placed.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("start", "root"))).alias("r")).select("shard", _root("r.root").alias("root"))  # SHARD_DOCUMENTS roots or so
    totals.join(roots, "shard").write.option("compression", "zstd").parquet(f"{path}/manifest")
    from .common import remove

    remove(spark, f"{path}/unplaced")


def _read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, row long, seq int, digest binary, n int, ids binary").parquet(f"{path}/chunks")


@lru_cache(maxsize=1)
def _crc_tables() -> np.ndarray:
    """tables[k][b][x]: byte x at place b of a CRC-32, moved on by 2**k zero bytes."""
    poly = 0xEDB88320  # fixed value: the reversed polynomial of CRC-32
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(poly), one >> 1).astype(np.uint32)

    def step(c: np.ndarray) -> np.ndarray:
        return (c >> np.uint32(8)) ^ one[c & np.uint32(255)]

    tables = np.zeros((48, 4, 256), dtype=np.uint32)
    tables[0] = np.stack([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])
    for k in range(1, 48):
        tables[k] = _moved(tables[k - 1], tables[k - 1])
    return tables


def _moved(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24 & 255]


def crc_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds (by XOR) to that of the whole, `after` bytes before the whole's end."""
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    for k, table in enumerate(_crc_tables()):
        on = (after >> k & 1).astype(bool)
        if on.any():
            crc[on] = _moved(table, crc[on])
    return crc


@F.pandas_udf(LongType())
def _crc_part(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(crc_shift(crc.to_numpy(), after.to_numpy()).astype(np.int64))


def _checked(width: int):
    """(digest, ids) to (digest, n, crc32 of the ids as 32-bit integers); other bytes than the digest's are an error."""

    def run(batches):
        import zlib

        for batch in batches:
            names, sizes, sums = batch["digest"].to_pylist(), [], []
            for name, data in zip(names, batch["ids"].to_pylist(), strict=True):
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} does not have its digest")
                ids = np.frombuffer(data, dtype=f"<u{width}")
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sums, pa.int64())], ["digest", "n", "crc"])

    return run


def _verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes; an error where roots, manifest or counts disagree."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    wrong = F.raise_error(F.lit("a recipe does not have the root or the length that it states"))
    good = (_root("digests") == F.col("root")) & (F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x) == F.col("n_tokens"))
    recipes = recipes.withColumn("n_tokens", F.when(good, F.col("n_tokens")).otherwise(wrong.cast("long")))
    roots = recipes.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("start", "root"))).alias("r"), F.sum("n_tokens").alias("t"), F.count("*").alias("d"))
    said = manifest.withColumnRenamed("root", "said")
    bad = roots.join(said, "shard", "full").where(~(F.col("said").eqNullSafe(_root(F.coalesce("r.root", F.array().cast("array<binary>")))) & F.col("t").eqNullSafe(F.col("n_tokens")) & F.col("d").eqNullSafe(F.col("documents"))))
    if bad.limit(1).count():
        raise ValueError("the manifest does not describe the recipes")
    return recipes


def _entries(recipes: DataFrame) -> DataFrame:
    """One row per chunk of a recipe, with the number of ids that come after it in its document."""
    e = recipes.select("doc_id", "row", "start", "n_tokens", F.posexplode(F.arrays_zip("digests", "lengths")).alias("seq", "c"))
    e = e.select("doc_id", "row", "start", "n_tokens", "seq", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("n"))
    upto = Window.partitionBy("row").orderBy("seq")
    return e.withColumn("after", F.col("n_tokens") - F.sum("n").over(upto))


def read_summary(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Every chunk is read, held against its digest and summed once, wherever it is; documents add up the sums of
    their chunks (CRC-32 is linear), so no ids are moved.
    """
    sums = _read_chunks(spark, path).where("ids is not null").select("digest", "ids").mapInArrow(_checked(width), "digest binary, n int, crc long")
    e = _entries(_verified_recipes(spark, path)).join(sums.withColumnRenamed("n", "stored"), "digest", "left")
    gone = F.raise_error(F.lit("a chunk of a recipe is missing, or has another length")).cast("long")
    e = e.withColumn("part", F.when(F.col("stored") == F.col("n"), _crc_part(F.coalesce("crc", F.lit(0).cast("long")), F.col("after") * 4)).otherwise(gone))
    return e.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32")).drop("row")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids (their bytes, as stored)."""
    stored = _read_chunks(spark, path).where("ids is not null").select("digest", "ids")
    e = _entries(_verified_recipes(spark, path)).join(stored, "digest", "left")
    gone = F.raise_error(F.lit("a chunk of a recipe is missing")).cast("binary")
    e = e.withColumn("ids", F.coalesce("ids", gone))
    whole = F.array_sort(F.collect_list(F.struct("seq", "ids")))
    e = e.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), whole.alias("p"))
    return e.select("doc_id", "start", "n_tokens", F.aggregate("p.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"))
