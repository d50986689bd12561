"""What a scan looks for: named character groups, single code points and byte ranges.

Ids are dense, 1 to N in the order of declaration, and 0 means no match. Targets may not overlap and names may not repeat,
unless on_overlap="first" lets the earlier target keep the byte.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class SpecError(ValueError):
    """A target set that cannot be scanned for."""


@dataclass(frozen=True)
class Group:
    name: str
    codepoints: tuple[int, ...]


@dataclass(frozen=True)
class Codepoint:
    name: str
    codepoint: int

    @property
    def utf8(self) -> bytes:
        return chr(self.codepoint).encode("utf-8")


@dataclass(frozen=True)
class ByteRange:
    name: str
    low: int
    high: int


Target = Group | Codepoint | ByteRange


@dataclass(frozen=True)
class TargetSpec:
    targets: tuple[Target, ...]
    on_overlap: str = "error"
    max_literals: int | None = None
    literals: dict[str, int] = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "literals", {})
        if self.on_overlap not in ("error", "first"):
            raise SpecError("on_overlap is 'error' or 'first'")
        if not self.targets:
            raise SpecError("no target is declared")
        if self.max_literals is not None and len(self.targets) > self.max_literals:
            raise SpecError(f"{len(self.targets)} targets exceed the limit of {self.max_literals}")
        taken: set[int] = set()
        points: set[int] = set()
        for number, t in enumerate(self.targets, 1):
            if t.name in self.literals:
                raise SpecError(f"the name {t.name!r} is declared twice")
            self.literals[t.name] = number
            if isinstance(t, Group):
                if not t.codepoints:
                    raise SpecError(f"{t.name!r} has no characters")
                if any(not 0 <= c <= 0x7F for c in t.codepoints):
                    raise SpecError(f"{t.name!r}: groups are of ASCII characters; declare others one by one")
                own = set(t.codepoints)
            elif isinstance(t, Codepoint):
                if not 0 <= t.codepoint <= 0x10FFFF or 0xD800 <= t.codepoint <= 0xDFFF:
                    raise SpecError(f"{t.name!r}: no Unicode scalar value")
                own = {t.codepoint} if t.codepoint <= 0x7F else set()
                if not own:
                    if t.codepoint in points and self.on_overlap == "error":
                        raise SpecError(f"{t.name!r} repeats a code point")
                    points.add(t.codepoint)
            else:
                if not 0 <= t.low <= t.high <= 0xFF:
                    raise SpecError(f"{t.name!r}: a range runs from low to high within 0 to 255")
                own = set(range(t.low, t.high + 1))
            if own & taken and self.on_overlap == "error":
                raise SpecError(f"{t.name!r} overlaps an earlier target")
            taken |= own
        leads = {chr(c).encode()[0] for c in points}
        if leads & taken and self.on_overlap == "error":
            raise SpecError("a range covers the first byte of a declared code point")

    @staticmethod
    def builder() -> "SpecBuilder":
        return SpecBuilder()

    def table(self) -> np.ndarray:
        """256 entries: the id of each single byte."""
        lut = np.zeros(256, dtype=np.uint16)
        for t in self.targets:
            if isinstance(t, Group):
                own = t.codepoints
            elif isinstance(t, ByteRange):
                own = range(t.low, t.high + 1)
            else:
                own = (t.codepoint,) if t.codepoint <= 0x7F else ()
            for b in own:
                if lut[b] == 0:
                    lut[b] = self.literals[t.name]
        return lut

    def sequences(self) -> list[tuple[bytes, int]]:
        """The code points of several bytes, with their ids."""
        return [(t.utf8, self.literals[t.name]) for t in self.targets if isinstance(t, Codepoint) and t.codepoint > 0x7F]

    def names(self) -> dict[int, str]:
        return {number: name for name, number in self.literals.items()}

    def byte_only(self) -> bool:
        """True if a target is a range that reaches beyond ASCII: such bytes are no characters of their own."""
        return any(isinstance(t, ByteRange) and t.high > 0x7F for t in self.targets)

    def pattern(self) -> str:
        """A Java character class of all characters that any target matches (ranges beyond ASCII: any non-ASCII character)."""
        parts = [f"\\x{{{b:x}}}" for b in np.flatnonzero(self.table()) if b <= 0x7F]
        parts += [f"\\x{{{t.codepoint:x}}}" for t in self.targets if isinstance(t, Codepoint) and t.codepoint > 0x7F]
        return "[" + "".join(parts) + ("\\x{80}-\\x{10ffff}" if self.byte_only() else "") + "]"


class SpecBuilder:
    """Collects targets one call at a time; build() checks them together."""

    def __init__(self):
        self._targets: list[Target] = []
        self._options: dict = {}

    def codepoints(self, name: str, *chars: int | str) -> "SpecBuilder":
        points = tuple(p for c in chars for p in ([c] if isinstance(c, int) else map(ord, c)))
        self._targets.append(Group(name, points))
        return self

    def codepoint(self, name: str, char: int | str) -> "SpecBuilder":
        self._targets.append(Codepoint(name, char if isinstance(char, int) else ord(char)))
        return self

    def range(self, name: str, low: int | str, high: int | str) -> "SpecBuilder":
        self._targets.append(ByteRange(name, *(b if isinstance(b, int) else ord(b) for b in (low, high))))
        return self

    def options(self, **options) -> "SpecBuilder":
        """on_overlap, max_literals."""
        self._options |= options
        return self

    def build(self) -> TargetSpec:
        return TargetSpec(tuple(self._targets), **self._options)
