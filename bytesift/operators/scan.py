"""find(): every match of a target set in a text or binary column, as rows of (keys, pos, lit, name).

strategy "arrow" runs one narrow stage of numpy over whole Arrow batches, and takes any bytes. "sql" is Catalyst alone, for
well-formed text and targets that are characters. "auto" takes arrow. Either way rows without any target are dropped
by an expression before they are taken apart. Null buffers have no match.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import kernels
from ..functions.spec import Codepoint, Group, SpecError, TargetSpec
from .filters import MatchFilter, QuoteFilter


def _is_binary(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, BinaryType)


def _with_target(df: DataFrame, col: str, spec: TargetSpec) -> DataFrame:
    return df if _is_binary(df, col) else df.where(F.col(col).rlike(spec.pattern()))


def is_match(ch: Column, spec: TargetSpec) -> Column:
    """The id of a single character, or null."""
    out = F.lit(None).cast("int")
    for t in reversed(spec.targets):
        if isinstance(t, Group):
            hit = ch.isin([chr(c) for c in t.codepoints])
        elif isinstance(t, Codepoint):
            hit = ch == chr(t.codepoint)
        else:
            hit = (F.octet_length(ch) == 1) & F.ascii(ch).between(t.low, t.high)
        out = F.when(hit, F.lit(spec.literals[t.name])).otherwise(out)
    return out


def characters(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """keys, i (from 0), ch, pos: every character with its byte offset. Rows stay apart even if their keys are equal."""
    rows = df.select(*keys, F.monotonically_increasing_id().alias("__row"), F.split(col, "").alias("__chars"))
    each = rows.select(*keys, "__row", F.posexplode("__chars").alias("i", "ch")).where("ch <> ''")
    w = Window.partitionBy("__row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("pos", F.coalesce(F.sum(F.octet_length("ch")).over(w), F.lit(0)).cast("long")).drop("__row")


def _arrow(spec: TargetSpec, keep, n_keys: int):
    names = pa.array([""] + [spec.names()[i] for i in range(1, len(spec.names()) + 1)], pa.string())

    def run(batches):
        for whole in batches:
            for batch, data, ends in kernels.strung(whole, n_keys):
                if not len(data):
                    continue
                pos, ids = kernels.scan(data, spec, ends)
                row = np.searchsorted(ends, pos, side="right")
                if keep is not None:
                    stays = keep(row, ids)
                    pos, ids, row = pos[stays], ids[stays], row[stays]
                begins = np.concatenate(([0], ends[:-1]))
                for at in range(0, len(pos), 1 << 18):
                    s = slice(at, at + (1 << 18))
                    taken = pa.array(row[s])
                    yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[:n_keys]), pa.array(pos[s] - begins[row[s]]), pa.array(ids[s].astype(np.int32)), pa.DictionaryArray.from_arrays(pa.array(ids[s].astype(np.int32)), names).cast(pa.string())], names=[*batch.schema.names[:n_keys], "pos", "lit", "name"])

    return run


def find(df: DataFrame, col: str, spec: TargetSpec, *, keys: Sequence[str], quote_filter: str | None = None, match_filter: MatchFilter | None = None, strategy: str = "auto") -> DataFrame:
    """One row per match: keys, pos (byte offset in the row's buffer), lit, name. quote_filter names the target that toggles: matches between
    its pairs go, it stays itself. match_filter is any filter of filters.py (arrow only). Keys may not be named as the other columns."""
    if quote_filter is not None:
        if match_filter is not None:
            raise ValueError("give quote_filter or match_filter; Both() joins two filters")
        match_filter = QuoteFilter(quote_filter)
    for name in match_filter.needs if match_filter else ():
        if name not in spec.literals:
            raise SpecError(f"the filter's target {name!r} is not declared")
    if strategy not in ("auto", "arrow", "sql"):
        raise ValueError("strategy is auto, arrow or sql")
    if clash := {"pos", "lit", "name"} & {k.lower() for k in keys}:
        raise ValueError(f"a key is named {sorted(clash)[0]!r}, as a column of the result: rename it first")
    source = _with_target(df.where(F.col(col).isNotNull()), col, spec)
    if strategy == "sql":
        if _is_binary(df, col) or spec.byte_only():
            raise SpecError("the sql strategy takes characters of text; use arrow for bytes")
        if match_filter is not None and not isinstance(match_filter, QuoteFilter):
            raise ValueError("the sql strategy knows the quote filter only")
        return _sql(source, col, spec, keys, match_filter.quote if match_filter else None)
    literals = dict(spec.literals)
    keep = None if match_filter is None else lambda rows, ids: match_filter.keep(rows, ids, literals)
    picked = source.select(*keys, F.col(col).cast("binary").alias("__data"))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(_arrow(spec, keep, len(keys)), f"{schema}{', ' if keys else ''}pos long, lit int, name string")


#: In _sql() a character of several bytes that is looked for is one sign from here on, by its id, and filling signs: ISO-8859-1 has none of the former, and the latter is no target.
_SIGNS, _FILL = 0x100, "\x80"


def _sql(source: DataFrame, col: str, spec: TargetSpec, keys, quote_filter) -> DataFrame:
    """Text read as ISO-8859-1 has a character for each byte: an exploded place is a byte offset, without a sum over the row's characters and so without a shuffle."""
    latin = F.decode(F.col(col).cast("binary"), "ISO-8859-1")
    signs: dict[int, list[str]] = {number: [] for number in spec.names()}
    for byte, number in enumerate(spec.table().tolist()):
        if number:
            signs[number].append(chr(byte))
    for seq, number in spec.sequences():
        if _SIGNS + number >= 0xD800:
            raise SpecError("the sql strategy takes fewer targets; use arrow")
        signs[number].append(chr(_SIGNS + number))
        latin = F.replace(latin, F.lit(seq.decode("latin-1")), F.lit(chr(_SIGNS + number) + _FILL * (len(seq) - 1)))
    if quote_filter is not None and (quotes := signs[spec.literals[quote_filter]]):  # every other part lies between quotes: it is filled up
        parts = F.split(latin, "[" + "".join(f"\\x{{{ord(c):x}}}" for c in quotes) + "]")
        latin = F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 0, part).otherwise(F.repeat(F.lit(_FILL), F.length(part)))), quotes[0])
    lit = F.lit(None).cast("int")
    for number, own in signs.items():
        if own:
            lit = F.when(F.col("ch").isin(own), F.lit(number)).otherwise(lit)
    hits = source.select(*keys, F.posexplode(F.split(latin, "")).alias("pos", "ch")).withColumn("lit", lit).where("lit is not null")
    name = F.create_map(*[F.lit(x) for pair in spec.names().items() for x in pair])[F.col("lit")]
    return hits.select(*keys, F.col("pos").cast("long").alias("pos"), "lit", name.alias("name"))


def totals(df: DataFrame, col: str, spec: TargetSpec) -> DataFrame:
    """name, n_matches over all buffers, counted where they are found: one small row per target and batch leaves a task."""
    names = spec.names()

    def run(batches):
        for whole in batches:
            total = np.zeros(len(names) + 1, dtype=np.int64)
            for _, data, ends in kernels.strung(whole, 0):
                if spec.sequences():
                    total += np.bincount(kernels.scan(data, spec, ends)[1], minlength=len(names) + 1)
                else:  # single bytes alone: how often each value occurs tells it
                    total += np.bincount(spec.table(), weights=np.bincount(data, minlength=256), minlength=len(names) + 1).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"name": [names[i] for i in range(1, len(names) + 1)], "n": pa.array(total[1:])})

    found = df.where(F.col(col).isNotNull()).select(F.col(col).cast("binary").alias("__data")).mapInArrow(run, "name string, n long")
    return found.groupBy("name").agg(F.sum("n").alias("n_matches")).where("n_matches > 0")


def count(df: DataFrame, col: str, spec: TargetSpec, *, keys: Sequence[str]) -> DataFrame:
    """keys and n_matches, one row per row, without taking the text apart. Null text: 0."""
    return df.select(*keys, F.coalesce(F.regexp_count(F.col(col), F.lit(spec.pattern())), F.lit(0)).cast("long").alias("n_matches"))


def exists(df: DataFrame, col: str, spec: TargetSpec) -> DataFrame:
    """The rows with a match."""
    return df.where(F.col(col).rlike(spec.pattern()))


def histogram(matches: DataFrame, *by: str) -> DataFrame:
    return matches.groupBy(*by, "name").agg(F.count("*").alias("n_matches"))


def density(df: DataFrame, col: str, spec: TargetSpec, *, keys: Sequence[str]) -> DataFrame:
    """Matches per byte; 0 for an empty text."""
    size = F.octet_length(F.coalesce(F.col(col), F.lit("")))
    n = F.coalesce(F.regexp_count(F.col(col), F.lit(spec.pattern())), F.lit(0))
    return df.select(*keys, n.cast("long").alias("n_matches"), size.cast("long").alias("n_bytes"), F.when(size > 0, n / size).otherwise(0.0).alias("density"))


def index(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """matches with idx, from 0 in order of position within the keys: access by number."""
    return matches.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1).cast("long"))


def utf8_class(ch: Column) -> Column:
    """1 to 4: the bytes that a character takes (its first byte's class)."""
    return F.octet_length(ch)


def non_ascii(col: str) -> Column:
    return F.octet_length(col) > F.length(col)
