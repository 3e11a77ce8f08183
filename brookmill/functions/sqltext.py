"""Small helpers to write the same pattern into a Column and into SQL."""

from __future__ import annotations


def lit(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def contains_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def values(rows: list[tuple], names: str) -> str:
    """SELECT over VALUES, for fixture tables in either engine."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return lit(v) if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"
