"""Prefix scans over rows of positions: toggles, depths and the filters made of them.

All are window aggregates from the first row of a key to the current one, ordered by position; a key's
state begins anew. For keys whose rows lie in numbered chunks, chunk_*() first sum each chunk, carry the sums
over the chunks' order, and add the carry: no window spans more than one chunk's rows or one key's chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def toggle(df: DataFrame, bit: Column, keys: Sequence[str], order: str = "pos", out: str = "inside") -> DataFrame:
    """Inclusive running XOR of a bit."""
    return df.withColumn(out, F.bit_xor(bit.cast("int")).over(_upto(keys, order)))


def depth(df: DataFrame, delta: Column, keys: Sequence[str], order: str = "pos", out: str = "depth") -> DataFrame:
    """Inclusive running sum, exact in 64 bits."""
    return df.withColumn(out, F.sum(delta.cast("long")).over(_upto(keys, order)))


def shift(df: DataFrame, value: str, n: int, keys: Sequence[str], order: str = "pos", out: str = "shifted") -> DataFrame:
    """The value n rows before, 0 where there is none."""
    return df.withColumn(out, F.lag(value, n, 0).over(Window.partitionBy(*keys).orderBy(order)))


def quote_filter(matches: DataFrame, quote: str, keys: Sequence[str]) -> DataFrame:
    """Matches outside quotes, and the quotes."""
    is_quote = F.col("name") == quote
    return toggle(matches, is_quote, keys, out="__inside").where(is_quote | (F.col("__inside") == 0)).drop("__inside")


def no_filter(matches: DataFrame) -> DataFrame:
    return matches


def nesting(matches: DataFrame, opening: str, closing: str, keys: Sequence[str]) -> DataFrame:
    """Opening and closing matches with depth: after an opening, after a closing."""
    delta = F.when(F.col("name") == opening, 1).when(F.col("name") == closing, -1).otherwise(0)
    return depth(matches.where(F.col("name").isin(opening, closing)), delta, keys)


def mask_then_nesting(matches: DataFrame, quote: str, opening: str, closing: str, keys: Sequence[str]) -> DataFrame:
    """Nesting of what stands outside quotes: two filters, one after the other."""
    return nesting(quote_filter(matches, quote, keys), opening, closing, keys)


def chunk_carry(chunks: DataFrame, total: Column, keys: Sequence[str], seq: str = "seq", *, xor: bool = False) -> DataFrame:
    """chunks with carry: the sum (or parity) of all chunks before, by their order within the keys."""
    before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum(total.cast("long")).over(before), F.lit(0).cast("long"))
    return chunks.withColumn("carry", carried % 2 if xor else carried)


def chunk_scan(matches: DataFrame, delta: Column, keys: Sequence[str], seq: str = "seq", *, xor: bool = False, out: str = "state") -> DataFrame:
    """The running sum (or XOR) of delta over all chunks of a key, from matches with a chunk number and a position within it."""
    d = matches.withColumn("__d", delta.cast("long"))
    sums = d.groupBy(*keys, seq).agg(F.sum("__d").alias("__total"))
    carry = chunk_carry(sums, F.col("__total"), keys, seq, xor=xor).select(*keys, seq, "carry")
    local = F.sum("__d").over(_upto([*keys, seq], "pos"))
    state = F.col("__local") + F.col("carry")
    joined = d.withColumn("__local", local).join(carry, [*keys, seq])
    return joined.withColumn(out, F.pmod(state, F.lit(2)) if xor else state).drop("__d", "__local", "carry")
