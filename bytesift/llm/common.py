"""What the operators of this subpackage share: scratch tables, key joins and text kernels."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder for scratch tables: under spark.checkpoint.dir, which driver and executors share.

    Only where that is unset (a local session, such as in tests) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="bytesift-")
        _OWN[app] = f"{base.rstrip('/')}/bytesift-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _OWN[app])
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended: nothing to clean through it
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the scratch folder and reads it back: this cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._bytesift_path = path  # type: ignore[attr-defined]
    return back


def drop_scratch(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df."""
    remove(df.sparkSession, df._bytesift_path)  # type: ignore[attr-defined]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clean_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark deletes the shuffle files of queries that are done."""
    spark.sparkContext._jvm.System.gc()


def text_or_empty(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def in_slices(batches, rows: int = 1024):
    """Arrow batches of so many rows at most: what Python makes of one at a time is bounded without a setting of the session."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """A row is known by its id and a 128-bit hash of its text, so that repeated ids with other texts stay apart."""
    t = text_or_empty(text_col)
    return [F.col(id_col).alias("__id"), F.xxhash64(t).alias("__t1"), F.xxhash64(F.lit(1), t).alias("__t2")]


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose row_keys() are in keys (__id, __t1, __t2, __n); of repeated rows (__n > 1) one stays.

    All columns of docs come back, whatever their names, and no other.
    """
    row = fresh(docs, "row")
    marked = docs.withColumn(row, F.struct(*row_keys(docs, id_col, text_col))).alias("d")
    r, keys = F.col(f"d.`{row}`"), keys.alias("k")
    on = r["__id"].eqNullSafe(F.col("k.__id")) & (r["__t1"] == F.col("k.__t1")) & (r["__t2"] == F.col("k.__t2"))
    once = marked.join(keys.where("__n = 1"), on, "left_semi").select(*[F.col(f"d.`{c}`") for c in docs.columns])
    if keys.where("__n > 1").limit(1).count() == 0:
        return once
    again = marked.join(keys.where("__n > 1"), on, "left_semi").dropDuplicates([row]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(again)
