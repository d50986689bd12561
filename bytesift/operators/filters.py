"""Filters of matches: what find() lets through once targets are found.

A filter is any object with keep(rows, ids, literals): rows numbers the buffer of each match (ascending, matches of one buffer together and in
order of position), ids are the targets' numbers, literals gives the number of each target's name. It returns which matches stay.
Its state begins anew with each buffer. A filter names the targets that it needs in needs; find() holds them against the target set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np


class MatchFilter(Protocol):
    needs: Sequence[str]

    def keep(self, rows: np.ndarray, ids: np.ndarray, literals: Mapping[str, int]) -> np.ndarray: ...


@dataclass(frozen=True)
class NoFilter:
    """Everything stays."""

    needs: Sequence[str] = ()

    def keep(self, rows: np.ndarray, ids: np.ndarray, literals: Mapping[str, int]) -> np.ndarray:
        return np.ones(len(ids), dtype=bool)


@dataclass(frozen=True)
class QuoteFilter:
    """Matches between two quotes go; the quotes stay. Buffers without a quote are let through as they are."""

    quote: str

    @property
    def needs(self) -> Sequence[str]:
        return (self.quote,)

    def keep(self, rows: np.ndarray, ids: np.ndarray, literals: Mapping[str, int]) -> np.ndarray:
        is_quote = ids == literals[self.quote]
        if not is_quote.any():
            return np.ones(len(ids), dtype=bool)
        return is_quote | (running(is_quote, rows) % 2 == 0)


@dataclass(frozen=True)
class EveryNth:
    """The first match of a buffer, and every n-th after it."""

    n: int
    needs: Sequence[str] = ()

    def keep(self, rows: np.ndarray, ids: np.ndarray, literals: Mapping[str, int]) -> np.ndarray:
        return (running(np.ones(len(ids), dtype=np.int64), rows) - 1) % self.n == 0


@dataclass(frozen=True)
class Both:
    """second over what first lets through."""

    first: MatchFilter
    second: MatchFilter

    @property
    def needs(self) -> Sequence[str]:
        return (*self.first.needs, *self.second.needs)

    def keep(self, rows: np.ndarray, ids: np.ndarray, literals: Mapping[str, int]) -> np.ndarray:
        out = self.first.keep(rows, ids, literals).copy()
        out[out] = self.second.keep(rows[out], ids[out], literals)
        return out


def running(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inclusive running sums that begin anew with each buffer."""
    total = np.cumsum(values)
    before = np.concatenate(([0], total))[np.searchsorted(rows, rows, side="left")]
    return total - before
