"""Kernels over byte arrays: scans, prefix scans, the quote filter and the CSV walk. No Spark here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .spec import TargetSpec

QUOTE, DELIMITER, LF, CR = 1, 2, 3, 4

#: bytes of buffers that are looked at together
BLOCK = 1 << 20


def strung(batch: pa.RecordBatch, at: int, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, where each row's bytes end) of a batch with buffers in column at, without a copy of them: as many rows at a time as hold size bytes together, or one
    that alone holds more. What is made of a batch is so bounded by the size, or the longest buffer, however many rows Spark puts into a batch. Null buffers are left out."""
    size = BLOCK if size is None else size
    column = batch.columns[at]
    if column.null_count:
        batch = batch.filter(pc.is_valid(column))
        column = batch.columns[at]
    if not len(column):
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, int(offsets[row]) + size, side="right")) - 1)
        own = offsets[row : to + 1].astype(np.int64)
        yield batch.slice(row, to - row), data[own[0] : own[-1]], own[1:] - own[0]
        row = to


def scan(data: np.ndarray, spec: TargetSpec, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ids), ascending. ends: where the buffers that data strings together end; no match reaches over an end."""
    found = spec.table()[data]
    for seq, number in spec.sequences():
        n = len(seq)
        if len(data) < n:
            continue
        at = np.flatnonzero(data[: len(data) - n + 1] == seq[0])
        for k in range(1, n):
            at = at[data[at + k] == seq[k]]
        if ends is not None and len(at):
            at = at[np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + n - 1, "right")]
        found[at] = np.where(found[at] == 0, number, found[at])
    pos = np.flatnonzero(found)
    return pos, found[pos].astype(np.int64)


def utf8_class(data: np.ndarray) -> np.ndarray:
    """1 for ASCII, 0 for a continuation byte, 2 to 4 for a first byte of so many (F8 to FF count as 4)."""
    lut = np.array([1] * 8 + [0] * 4 + [2, 2, 3, 4], dtype=np.int8)
    return lut[data >> 4]


def nibbles(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) halves of each byte."""
    return data & 15, data >> 4


def prefix_xor(v: np.ndarray, carry: int = 0) -> tuple[np.ndarray, int]:
    """(inclusive running XOR of the low bits, carry out)."""
    out = (np.cumsum(v.astype(np.int64) & 1) + carry) & 1
    return out, int(out[-1]) if len(out) else carry


def prefix_sum(v: np.ndarray, carry: int = 0, clamp: tuple[int, int] | None = None) -> tuple[np.ndarray, int]:
    """(inclusive running sum, carry out); with clamp every step saturates, which makes it sequential."""
    if clamp is None:
        out = np.cumsum(v.astype(np.int64)) + carry
    else:
        out, depth = np.empty(len(v), dtype=np.int64), carry
        for i, x in enumerate(v.tolist()):
            depth = min(max(depth + x, clamp[0]), clamp[1])
            out[i] = depth
    return out, int(out[-1]) if len(out) else carry


def shift_right(v: np.ndarray, n: int) -> np.ndarray:
    """Moved by n places, zeros moving in."""
    out = np.zeros_like(v)
    if n < len(v):
        out[n:] = v[: len(v) - n]
    return out


def quote_filter(ids: np.ndarray, quote: int, carry: int = 0) -> tuple[np.ndarray, int]:
    """(which matches stay, carry out): matches between quotes go, the quotes stay."""
    is_quote = ids == quote
    inside, out = prefix_xor(is_quote, carry)
    return is_quote | (inside == 0), out


def csv_tokens(data: np.ndarray, delimiter: int, quote: int, carry: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, tokens, carry out) of quotes, and of delimiters, LF and CR outside quotes."""
    lut = np.zeros(256, dtype=np.int8)
    lut[[10, 13]] = LF, CR
    lut[delimiter], lut[quote] = DELIMITER, QUOTE
    found = lut[data]
    pos = np.flatnonzero(found)
    found = found[pos].astype(np.int64)
    stays, out = quote_filter(found, QUOTE, carry)
    return pos[stays], found[stays], out


def csv_fields_of(data: np.ndarray, ends: np.ndarray, delimiter: int, quote: int) -> tuple[np.ndarray, ...]:
    """(buffer, row, column, start, end, quoted) of every field of buffers that lie one after the other and end at ends.

    Rows are counted, and quotes toggle, from each buffer's first byte. LF, CR LF and CR each end a row; a last row needs no end. start and end
    are places in data.
    """
    lut = np.zeros(256, dtype=np.int8)
    lut[[10, 13]] = LF, CR
    lut[delimiter], lut[quote] = DELIMITER, QUOTE
    kind = lut[data]
    pos = np.flatnonzero(kind)
    kind = kind[pos]
    buffer = np.searchsorted(ends, pos, side="right")
    is_quote = kind == QUOTE
    total = np.cumsum(is_quote)
    first = np.searchsorted(buffer, buffer, side="left")
    inside = (total - total[first] + is_quote[first]) % 2 if len(pos) else total
    keep = ~is_quote & (inside == 0)
    pos, kind, buffer = pos[keep], kind[keep], buffer[keep]
    size = np.ones(len(pos), dtype=np.int64)
    if len(pos) > 1:  # LF right after CR is one end of a row, at the CR
        pair = np.concatenate(([False], (kind[1:] == LF) & (kind[:-1] == CR) & (pos[1:] == pos[:-1] + 1) & (buffer[1:] == buffer[:-1])))
        size[:-1] += pair[1:]
        pos, kind, buffer, size = pos[~pair], kind[~pair], buffer[~pair], size[~pair]
    n = len(ends)
    order = np.argsort(np.concatenate((pos * 2 + 1, ends * 2)), kind="stable")  # every buffer's end closes a field too, before what follows it
    pos, buffer, size = np.concatenate((pos, ends))[order], np.concatenate((buffer, np.arange(n)))[order], np.concatenate((size, np.zeros(n, dtype=np.int64)))[order]
    closes = np.concatenate((kind != DELIMITER, np.zeros(n, dtype=bool)))[order]
    last = np.concatenate((np.zeros(len(kind), dtype=bool), np.ones(n, dtype=bool)))[order]
    fresh = np.concatenate(([True], buffer[1:] != buffer[:-1]))[: len(pos)]
    begins = np.concatenate(([0], ends[:-1])) if n else ends
    start = np.where(fresh, begins[buffer], np.concatenate(([0], (pos + size)[:-1]))) if len(pos) else pos
    after_row = np.concatenate(([True], closes[:-1])) | fresh if len(pos) else fresh
    live = ~(last & (start == pos) & after_row)  # nothing after the last row's end
    before = np.concatenate(([0], np.cumsum(closes)[:-1])) if len(pos) else pos
    row = before - before[np.searchsorted(buffer, buffer, side="left")]
    buffer, row, start, end = buffer[live], row[live], start[live], pos[live]
    same = np.concatenate(([True], (row[1:] != row[:-1]) | (buffer[1:] != buffer[:-1])))[: len(row)]
    column = np.arange(len(row)) - np.maximum.accumulate(np.where(same, np.arange(len(row)), 0)) if len(row) else row
    quoted = np.zeros(len(row), dtype=bool)
    some = start < end
    quoted[some] = data[start[some]] == quote
    return buffer, row.astype(np.int64), column.astype(np.int64), start.astype(np.int64), end.astype(np.int64), quoted


def csv_fields(data: np.ndarray, delimiter: int, quote: int) -> tuple[np.ndarray, ...]:
    """(row, column, start, end, quoted) of every field of one buffer."""
    return csv_fields_of(data, np.array([len(data)]), delimiter, quote)[1:]


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the given slices, one behind the other."""
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    return offsets, data[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]


def unescape(raw: bytes, quoted: bool, quote: int, compat: str = "lossless") -> bytes:
    """A field's value. lossless: quotes go only as a pair; strict: a quoted field loses its first and last byte whatever they are."""
    if not quoted:
        return raw
    q = bytes([quote])
    if compat == "strict":
        raw = raw[1:-1]
    elif len(raw) >= 2 and raw[:1] == q and raw[-1:] == q:
        raw = raw[1:-1]
    return raw.replace(q + q, q)
