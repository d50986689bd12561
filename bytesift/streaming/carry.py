"""Scans of byte streams that arrive in numbered chunks: (stream_id, seq, data).

Per stream the state holds the next chunk's number, whether a quote is open, the depth, the offset, up to three bytes that may begin a
character, and chunks that came early. Chunks are worked on in the order of seq, whatever order they arrive in; a number
that was worked on already is passed over.

Streams are dealt into buckets by a hash of their id, and a bucket's state is read, worked on and written as one: what a group costs in Python is
paid per bucket, and all bytes of a bucket that are due are scanned together. A bucket's state grows with its streams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels
from ..functions.spec import TargetSpec

_STATE = "streams array<string>, next_seq array<long>, inside array<int>, depth array<long>, offset array<long>, pending array<binary>, early_stream array<int>, early_seq array<long>, early_data array<binary>"
_OUT = "stream_id string, pos long, lit int, name string, inside int, depth long"

#: bytes that are scanned at a time (a stream's run of chunks within one Arrow batch is not cut)
_BLOCK = 1 << 20


class _Stream:
    __slots__ = ("next_seq", "inside", "depth", "offset", "pending", "early")

    def __init__(self, next_seq: int = 0, inside: int = 0, depth: int = 0, offset: int = 0, pending: bytes = b""):
        self.next_seq, self.inside, self.depth, self.offset, self.pending = next_seq, inside, depth, offset, pending
        self.early: dict[int, bytes] = {}

    def due(self) -> bytes:
        """The bytes that wait and all chunks that now follow them."""
        parts = [self.pending]
        while self.next_seq in self.early:
            parts.append(self.early.pop(self.next_seq))
            self.next_seq += 1
        return b"".join(parts)


def _loaded(state: GroupState) -> dict[str | None, _Stream]:
    if not state.exists:
        return {}
    ids, *values, early_stream, early_seq, early_data = state.get
    streams = {k: _Stream(*v[:-1], bytes(v[-1])) for k, *v in zip(ids, *values, strict=True)}
    for n, seq, data in zip(early_stream, early_seq, early_data, strict=True):
        streams[ids[n]].early[seq] = bytes(data)
    return streams


def _saved(streams: dict[str | None, _Stream]) -> tuple:
    all_ = list(streams.values())
    early = [(n, seq, data) for n, s in enumerate(all_) for seq, data in s.early.items()]
    return (list(streams), *([getattr(s, x) for s in all_] for x in _Stream.__slots__[:-1]), *([e[i] for e in early] for i in range(3)))


def find_in_stream(chunks: DataFrame, spec: TargetSpec, *, quote: str | None = None, opening: str | None = None, closing: str | None = None, max_early: int | None = None, buckets: int = 1024) -> DataFrame:
    """Matches with their offset in the whole stream, the state of the quote after them, and the depth after them (outside quotes).

    chunks: stream_id string, seq long (from 0), data binary. A stream of which more than max_early chunks wait for an earlier one is an error (None: they wait).
    buckets: groups that streams are dealt into; one checkpoint, one number.
    """
    for name in (quote, opening, closing):
        if name is not None and name not in spec.literals:
            raise ValueError(f"the target {name!r} is not declared")
    names = np.array(["", *(spec.names()[i] for i in range(1, len(spec.names()) + 1))], dtype=object)
    q, up, down = (spec.literals.get(n, -1) if n else -1 for n in (quote, opening, closing))
    starts = {s[:k] for s, _ in spec.sequences() for k in range(1, len(s))}
    longest = max(map(len, starts), default=0)

    def scanned(block: list[tuple[str | None, _Stream, bytes]]) -> pd.DataFrame:
        ends = np.cumsum([len(whole) for *_, whole in block], dtype=np.int64)
        begins = np.concatenate(([0], ends[:-1]))
        pos, ids = kernels.scan(np.frombuffer(b"".join(whole for *_, whole in block), dtype=np.uint8), spec, ends)
        row = np.searchsorted(ends, pos, side="right")
        # what may yet become a longer match waits: matches that begin there are not given out now
        keep = np.array([next((k for k in range(min(longest, len(whole)), 0, -1) if whole[-k:] in starts), 0) for *_, whole in block], dtype=np.int64)
        live = pos < (ends - keep)[row]
        pos, ids, row = pos[live], ids[live], row[live]
        inside, depth, offset = (np.array([getattr(s, x) for _, s, _ in block], dtype=np.int64) for x in ("inside", "depth", "offset"))
        bounds = np.searchsorted(row, np.arange(len(block) + 1))

        def carried(steps: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(inclusive running sums that begin at each stream's carry, the carries after)."""
            total = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
            return total[1:] - total[bounds[row]] + carry[row], carry + total[bounds[1:]] - total[bounds[:-1]]

        quotes, inside = carried(ids == q, inside)
        toggles = quotes & 1
        outside = (toggles == 0) & (ids != q)
        depths, depth = carried(np.where(outside, (ids == up).astype(np.int64) - (ids == down), 0), depth)
        out = pd.DataFrame({"stream_id": np.array([k for k, *_ in block], dtype=object)[row], "pos": pos - begins[row] + offset[row], "lit": ids.astype(np.int32), "name": names[ids], "inside": toggles.astype(np.int32), "depth": depths})
        for (_, s, whole), n, i, d in zip(block, keep.tolist(), (inside & 1).tolist(), depth.tolist(), strict=True):
            s.inside, s.depth, s.offset, s.pending = i, d, s.offset + len(whole) - n, whole[len(whole) - n :]
        return out

    def run(key, frames, state: GroupState):
        streams = _loaded(state)
        for frame in frames:
            touched = {}
            for k, seq, data in zip(frame["stream_id"].tolist(), frame["seq"].tolist(), frame["data"].tolist(), strict=True):
                s = streams.get(k)
                if s is None:
                    s = streams[k] = _Stream()
                if seq >= s.next_seq:
                    s.early[seq] = bytes(data)
                    touched[k] = s
            block, size = [], 0
            for k, s in touched.items():
                if s.next_seq not in s.early:
                    continue
                block.append((k, s, s.due()))
                size += len(block[-1][-1])
                if size >= _BLOCK:
                    yield scanned(block)
                    block, size = [], 0
            if block:
                yield scanned(block)
        if max_early is not None:
            for k, s in streams.items():
                if len(s.early) > max_early:
                    raise ValueError(f"stream {k!r}: chunk {s.next_seq} is missing, and {len(s.early)} wait for it")
        state.update(_saved(streams))

    dealt = chunks.select("stream_id", "seq", "data", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).alias("__bucket"))
    return dealt.groupBy("__bucket").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
