"""Near-duplicate documents: shingles of five words, exact Jaccard similarity of 0.8 or more.

A document is the set of its shingles of WORDS words (A-Z lower-cased, words cut at ASCII white space; a
shorter one is one shingle). Texts of the same words are one. Candidates come from two searches:

- SimHash over the same shingles with Golay keys (simhash.near_links): all texts whose fingerprints differ in two bits at most;
- MinHash bands (lines.near_sets, which states their probabilities): at a similarity of 0.8 two fingerprints of 64 bits differ in about
  ten bits, far beyond what any number of Golay keys of such segments can bring together, so SimHash alone cannot do it.

The exact similarity decides on every candidate of either search, and components are joined over what it confirms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_keys, text_or_empty
from .lines import Shingles, near_sets
from .simhash import keep_first, near_links, simhash_column

WORDS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OF_DOCUMENTS = Shingles(
    lambda: F.split("line", " "),
    lambda: F.size("data") - (WORDS - 1),
    lambda i: F.xxhash64(*[F.get("data", i + (k - 1)) for k in range(WORDS)]),  # beyond the end: null, which takes no part
)


def plain_words(text_col: str) -> Column:
    """The words between single spaces; a null text is empty."""
    return F.trim(F.regexp_replace(F.translate(text_or_empty(text_col), _UPPER, _LOWER), "[ \\t\\n\\x0B\\f\\r]+", " "))


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("a1"), F.xxhash64(F.lit(1), line).alias("a2")]


def simhash_candidates(texts: DataFrame) -> DataFrame:
    """(x1, x2, y1, y2): pairs of the texts (a1, a2, line) whose SimHash fingerprints differ in two bits at most, one text for each fingerprint, and that text with all others of its fingerprint."""
    marked = materialize(texts.select("a1", "a2", simhash_column("line", WORDS).alias("fp")).distinct(), "document-simhash")
    name = F.struct("a1", "a2")
    first = materialize(marked.groupBy("fp").agg(F.min(name).alias("f")), "document-fingerprints")
    same = marked.join(first, "fp").where(name != F.col("f")).select(F.col("f.a1").alias("x1"), F.col("f.a2").alias("x2"), F.col("a1").alias("y1"), F.col("a2").alias("y2"))
    x, y = first.select(F.col("fp").alias("a"), F.col("f").alias("x")), first.select(F.col("fp").alias("b"), F.col("f").alias("y"))
    near = near_links(first.select("fp")).join(x, "a").join(y, "b")
    return same.unionByName(near.select(F.col("x.a1").alias("x1"), F.col("x.a2").alias("x2"), F.col("y.a1").alias("y1"), F.col("y.a2").alias("y2")))


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its row_keys(), a1, a2 (hash of its words) and root, what the component's rows have in common. Texts without a word are one."""
    texts = docs.select(plain_words(text_col).alias("line")).where("line <> ''").select(*_hashes(F.col("line")), "line")
    candidates = materialize(simhash_candidates(texts), "document-candidates")
    roots = materialize(near_sets(OF_DOCUMENTS, texts, candidates), "document-roots")
    rows = docs.select(*row_keys(docs, id_col, text_col), *_hashes(plain_words(text_col)))
    own = F.struct(F.lit(None).cast("long").alias("r"), F.col("a1").alias("s"), F.col("a2").alias("t"))
    of = F.struct(F.col("root").alias("r"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    return rows.join(roots, ["a1", "a2"], "left").withColumn("root", F.when(F.col("root").isNull(), own).otherwise(of))


def drop_near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row that simhash.keep_first() names stays, with the columns of docs."""
    return keep_first(docs, materialize(near_documents(docs, id_col, text_col), "document-groups"), id_col, text_col)
