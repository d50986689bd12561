"""DuckDB SQL for the registered queries, written from the same target sets."""

from __future__ import annotations

from ..functions.spec import Codepoint, Group, TargetSpec


def _quoted(ch: str) -> str:
    return f"chr({ord(ch)})" if ord(ch) < 32 else "'" + ch.replace("'", "''") + "'"


def case(spec: TargetSpec, name: bool) -> str:
    """CASE over column ch: the target's id, or its name."""
    whens = []
    for t in spec.targets:
        if isinstance(t, Group):
            cond = f"ch IN ({', '.join(_quoted(chr(c)) for c in t.codepoints)})"
        elif isinstance(t, Codepoint):
            cond = f"ch = {_quoted(chr(t.codepoint))}"
        else:
            cond = f"strlen(ch) = 1 AND ord(ch) BETWEEN {t.low} AND {t.high}"
        value = f"'{t.name}'" if name else f"CAST({spec.literals[t.name]} AS INTEGER)"
        whens.append(f"WHEN {cond} THEN {value}")
    return f"CASE {' '.join(whens)} END"


def characters(table: str, keys: str, text: str) -> str:
    """CTEs c (characters) and p (with byte offsets), to follow WITH."""
    return (
        f"c AS (SELECT {keys}, unnest(string_split({text}, '')) AS ch, generate_subscripts(string_split({text}, ''), 1) AS i FROM {table}),\n"
        f"p AS (SELECT *, CAST(sum(strlen(ch)) OVER (PARTITION BY {keys} ORDER BY i) - strlen(ch) AS BIGINT) AS pos FROM c WHERE ch <> '')"
    )


def matches(table: str, keys: str, text: str, spec: TargetSpec) -> str:
    """CTEs up to m: keys, pos, lit, name, ch."""
    return f"{characters(table, keys, text)},\nm AS (SELECT {keys}, pos, {case(spec, False)} AS lit, {case(spec, True)} AS name, ch FROM p WHERE {case(spec, False)} IS NOT NULL)"


def find(table: str, keys: str, text: str, spec: TargetSpec, quote: str | None = None) -> str:
    with_ = f"WITH {matches(table, keys, text, spec)}"
    if quote is None:
        return f"{with_}\nSELECT {keys}, pos, lit, name FROM m"
    return f"{with_},\nq AS (SELECT *, sum(CASE WHEN name = '{quote}' THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY pos) % 2 AS inside FROM m)\nSELECT {keys}, pos, lit, name FROM q WHERE name = '{quote}' OR inside = 0"
