"""Best-fit packing of token ids into sequences of a fixed length.

Documents longer than a sequence are cut into pieces of full length, the first piece taking the rest. A full
piece is a sequence of its own and is not moved. The others are placed by bounded-space online best fit: at most
OPEN_BINS sequences are open; an integer's bits mark which amounts of free space some open sequence has,
so the tightest fit is the lowest set bit at or above the piece's length. Where no open sequence fits and
all places are taken, the fullest closes first.

Pieces are dealt to groups by a hash; a group's size is set (GROUP_PIECES), so their number grows with the
input. Within a group they arrive in the order of the hash, so a lost task packs again to the same places; the next
AHEAD of them are held and placed longest first. A group has many times more pieces than sequences may be open.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_slices, materialize, text_or_empty
from .encode import encoder

SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 1_024
#: pieces that one group packs; groups are whole partitions
GROUP_PIECES = 65_536
#: pieces that are held to be placed longest first
AHEAD = 1_024


class BestFit:
    """place(length) gives (sequence, offset); sequences are numbered from 0 as they are opened."""

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.size, self.limit = size, open_bins
        self.mask = 0  # bit f: some open sequence has f free
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = 0
        self.made = 0

    def _take(self, room: int) -> int:
        bins = self.free[room]
        number = bins.pop()
        if not bins:
            self.mask ^= 1 << room
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        if length <= 0 or length > self.size:
            raise ValueError("a piece has 1 to `size` tokens")
        if fits := self.mask >> length:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            room, number = self.size, self.made
            self.made += 1
        left = room - length
        if left:
            if self.open == self.limit:  # the fullest closes, be it this one
                fullest = (self.mask & -self.mask).bit_length() - 1
                if fullest >= left:
                    return number, self.size - room
                self._take(fullest)
            self.free[left].append(number)
            self.mask |= 1 << left
            self.open += 1
        return number, self.size - room


_PIECES = "piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, size: int, end_id: int, with_ids: bool, id_type: pa.DataType):
    def cut(batches):
        enc = encoder(path)
        fields = [("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)
        for batch in in_slices(batches):
            rows: list[tuple] = []
            for key, ids in zip(batch["doc_id"].to_pylist(), enc.encode(batch["text"].to_pylist()), strict=True):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                first = len(ids) % size or size
                at = 0
                for number, to in enumerate(range(first, len(ids) + 1, size)):
                    part = ids[at:to]
                    rows.append((key, number, at, to - at, zlib.crc32(part.tobytes()), *([part] if with_ids else [])))
                    at = to
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return cut


def pieces(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id (of id_col's type), piece, start, length, ids_crc32, and with_ids the ids.

    A null or empty text is one piece, the end id. Repeated rows and null ids are cut like any others; an empty table gives no piece.
    """
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(_cutter(vocabulary_path, size, end_id, with_ids, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, " + _PIECES + (", ids array<int>" if with_ids else ""))


def pack(cut: DataFrame, *, size: int = SEQUENCE, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES, ahead: int = AHEAD) -> DataFrame:
    """Adds sequence_id and offset to pieces (as from pieces(), further columns stay, those of these two names are replaced).

    Only the pieces' numbers decide. Repeated rows are placed each for itself. No rows: no rows.
    """
    cut = cut.drop("sequence_id", "offset")
    short = cut.where(F.col("length") < size)
    full = cut.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    groups = max(1, math.ceil(short.count() / group_pieces))
    names = cut.columns
    fill = names.index("length")
    order = ["doc_id", "piece", "length", "ids_crc32"]
    mix, other = F.xxhash64(*order), F.xxhash64(F.lit(1), *order)
    dealt = short.repartition(groups, mix).sortWithinPartitions(other, *order)

    def place(batches):
        bins = BestFit(size, open_bins)
        from pyspark import TaskContext

        base = (TaskContext.get().partitionId() + 1) << 40
        for batch in in_slices(batches, ahead):
            lengths = np.asarray(batch.column(fill))
            numbers, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                numbers[i], offsets[i] = bins.place(int(lengths[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(numbers + base), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.mapInArrow(place, schema + ", sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, vocabulary_path: str, **options) -> DataFrame:
    """pieces() written once, then pack()."""
    return pack(materialize(pieces(docs, vocabulary_path, **options), "pieces"), size=options.get("size", SEQUENCE))
