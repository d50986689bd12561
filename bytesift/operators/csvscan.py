"""CSV held in a column: one buffer per row. Tokens, fields, rows, headers.

Rows end at LF, CR LF or CR; a blank line is a row of one empty field; rows may differ in width; empty fields are
empty strings, never null. A quote anywhere toggles; a field that begins with one is quoted and its value is
unescaped; quotes inside other fields stay as they are. Null buffers have no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.spec import SpecError

TOKENS = {kernels.QUOTE: "quote", kernels.DELIMITER: "delimiter", kernels.LF: "newline", kernels.CR: "cr"}


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    header: bool = False
    compat: str = "lossless"

    def __post_init__(self):
        for sign in (self.delimiter, self.quote):
            if len(sign) != 1 or ord(sign) > 0x7F or sign in "\r\n":
                raise SpecError("delimiter and quote are single ASCII characters other than line ends")
        if self.delimiter == self.quote:
            raise SpecError("delimiter and quote are the same")
        if self.compat not in ("lossless", "strict"):
            raise SpecError("compat is lossless or strict")


#: fields of one batch that is sent on
_FIELDS = 1 << 17


def _map(df: DataFrame, col: str, keys: Sequence[str], make, extra: str) -> DataFrame:
    """make(data, ends) yields (the buffers that rows come from, arrays of extra); a block of buffers at a time."""
    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    names = [x.strip().split()[0] for x in extra.split(", ")]

    def run(batches):
        for whole in batches:
            for batch, data, ends in kernels.strung(whole, len(keys)):
                for buffer, columns in make(data, ends):
                    same = pa.array(buffer)
                    yield pa.RecordBatch.from_arrays([*(c.take(same) for c in batch.columns[: len(keys)]), *(p if isinstance(p, pa.Array) else pa.array(p) for p in columns)], names=[*keys, *names])

    return df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("binary").alias("__data")).mapInArrow(run, schema + extra)


def tokens(df: DataFrame, col: str, *, keys: Sequence[str], dialect: Dialect = Dialect()) -> DataFrame:
    """keys, pos, token: quotes, and delimiters and line ends outside them."""
    name = np.array(["", *(TOKENS[i] for i in range(1, 5))], dtype=object)

    def make(data, ends):
        lut = np.zeros(256, dtype=np.int64)
        lut[[10, 13]] = kernels.LF, kernels.CR
        lut[ord(dialect.delimiter)], lut[ord(dialect.quote)] = kernels.DELIMITER, kernels.QUOTE
        token = lut[data]
        pos = np.flatnonzero(token)
        token = token[pos]
        buffer = np.searchsorted(ends, pos, side="right")
        is_quote = token == kernels.QUOTE
        total = np.cumsum(is_quote)
        before = np.concatenate(([0], total))[np.searchsorted(buffer, buffer, side="left")]
        stays = is_quote | ((total - before) % 2 == 0)
        pos, token, buffer = pos[stays], token[stays], buffer[stays]
        begins = np.concatenate(([0], ends[:-1]))
        for at in range(0, len(pos), _FIELDS):
            s = slice(at, at + _FIELDS)
            yield buffer[s], [pos[s] - begins[buffer[s]], pa.array(name[token[s]], pa.string())]

    return _map(df, col, keys, make, "pos long, token string")


def field_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, quoted: np.ndarray, dialect: Dialect) -> pa.Array:
    """The values of fields as text: quotes stripped and halved; bytes that are no UTF-8 are replaced."""
    q = ord(dialect.quote)
    inner = quoted if dialect.compat == "strict" else quoted & (end - start >= 2) & (data[np.maximum(end - 1, 0)] == q)
    a = np.where(inner, start + 1, start)
    b = np.maximum(np.where(inner, end - 1, end), a)
    offsets, content = kernels.slices(data, a, b)
    binary = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(content)])
    if quoted.any() and (content == q).any():
        binary = pc.if_else(pa.array(quoted), pc.replace_substring(binary, bytes([q, q]), bytes([q])), binary)
    try:
        return binary.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in binary.to_pylist()], pa.string())


def fields(df: DataFrame, col: str, *, keys: Sequence[str], dialect: Dialect = Dialect(), content: bool = True) -> DataFrame:
    """keys, row, col, start, end, quoted, and with content raw (bytes) and value (text); a header row counts as row -1.

    Batches of buffers are walked together and fields are cut out where they are found: a buffer never leaves its task.
    """

    def make(data, ends):
        buffer, row, column, start, end, quoted = kernels.csv_fields_of(data, ends, ord(dialect.delimiter), ord(dialect.quote))
        begins = np.concatenate(([0], ends[:-1]))
        for at in range(0, len(row), _FIELDS):
            s = slice(at, at + _FIELDS)
            base = begins[buffer[s]]
            out = [row[s] - int(dialect.header), column[s].astype(np.int32), start[s] - base, end[s] - base, pa.array(quoted[s])]
            if content:
                offsets, raw = kernels.slices(data, start[s], end[s])
                out.append(pa.Array.from_buffers(pa.binary(), len(base), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)]))
                out.append(field_texts(data, start[s], end[s], quoted[s], dialect))
            yield buffer[s], out

    return _map(df, col, keys, make, "row long, col int, start long, end long, quoted boolean" + (", raw binary, value string" if content else ""))


def _rows(df: DataFrame, col: str, keys: Sequence[str], dialect: Dialect) -> DataFrame:
    """keys, row, fields: every row with its values, the header as row -1; made where the buffer is, without a shuffle."""

    def make(data, ends):
        buffer, row, column, start, end, quoted = kernels.csv_fields_of(data, ends, ord(dialect.delimiter), ord(dialect.quote))
        first = np.flatnonzero(column == 0)
        bounds = np.concatenate((first, [len(row)]))
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _FIELDS, side="right")) - 1)
            s = slice(int(bounds[at]), int(bounds[to]))
            lists = pa.ListArray.from_arrays(pa.array((bounds[at : to + 1] - bounds[at]).astype(np.int32)), field_texts(data, start[s], end[s], quoted[s], dialect))
            yield buffer[first[at:to]], [row[first[at:to]] - int(dialect.header), lists]
            at = to

    return _map(df, col, keys, make, "row long, fields array<string>")


def rows(df: DataFrame, col: str, *, keys: Sequence[str], dialect: Dialect = Dialect()) -> DataFrame:
    """keys, row, fields (array of values): rows as wide as they are, without the header."""
    return _rows(df, col, keys, dialect).where("row >= 0")


def headers(df: DataFrame, col: str, *, keys: Sequence[str], dialect: Dialect) -> DataFrame:
    """keys, headers (array): the first row of buffers read with a header; no row for empty buffers."""
    if not dialect.header:
        raise SpecError("the dialect has no header")
    return _rows(df, col, keys, dialect).where("row = -1").select(*keys, F.col("fields").alias("headers"))


def row_count(df: DataFrame, col: str, *, keys: Sequence[str], dialect: Dialect = Dialect()) -> DataFrame:
    """keys, n_rows: rows without the header."""
    f = fields(df, col, keys=keys, dialect=dialect, content=False).where("col = 0 and row >= 0")
    return f.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def field_sizes(df: DataFrame, col: str, *, keys: Sequence[str], dialect: Dialect = Dialect()) -> DataFrame:
    """keys, n_fields, n_bytes: the number of fields, the header's too, and the sum of the bytes they take in the buffer."""
    f = fields(df, col, keys=keys, dialect=dialect, content=False)
    return f.groupBy(*keys).agg(F.count("*").alias("n_fields"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"))


def token_row_count(df: DataFrame, col: str, *, keys: Sequence[str], dialect: Dialect = Dialect()) -> DataFrame:
    """keys, n_rows by LF tokens alone, header included."""
    return tokens(df, col, keys=keys, dialect=dialect).groupBy(*keys).agg(F.count_if(F.col("token") == "newline").alias("n_rows"))


def named(parsed: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows() with a column per name; fields beyond a row's width are null."""
    return parsed.select(*[c for c in parsed.columns if c != "fields"], *[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])


def to_csv(df: DataFrame, columns: Sequence[str], out: str = "line", dialect: Dialect = Dialect(), end: str = "\n") -> DataFrame:
    """df with a CSV line of columns: values with signs are quoted, quotes doubled; null is empty."""
    q, d = dialect.quote, dialect.delimiter
    cells = []
    for c in columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        signs = v.contains(q) | v.contains(d) | v.contains("\n") | v.contains("\r")
        cells.append(F.when(signs, F.concat(F.lit(q), F.replace(v, F.lit(q), F.lit(q + q)), F.lit(q))).otherwise(v))
    return df.withColumn(out, F.concat(F.concat_ws(d, *cells), F.lit(end)))
