"""SQL text that behaves like a Column: rules written over the functions of folio.functions.core give both.

A rule applied to Columns is a Spark expression; applied to E it is the DuckDB text of
the same rule, which is what the oracles of the registered queries are made of.
"""

from __future__ import annotations


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


class E:
    """An expression in parentheses."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def __format__(self, spec: str) -> str:
        return self.text

    @staticmethod
    def of(value) -> E:
        return value if isinstance(value, E) else E(quoted(value))

    def _two(self, op: str, other) -> E:
        return E(f"({self} {op} {E.of(other)})")

    def __and__(self, other):
        return self._two("AND", other)

    def __or__(self, other):
        return self._two("OR", other)

    def __invert__(self):
        return E(f"(NOT {self})")

    def __eq__(self, other):
        return self._two("=", other)

    def __ne__(self, other):
        return self._two("<>", other)

    def __lt__(self, other):
        return self._two("<", other)

    def __le__(self, other):
        return self._two("<=", other)

    def __gt__(self, other):
        return self._two(">", other)

    def __ge__(self, other):
        return self._two(">=", other)

    def __add__(self, other):
        return self._two("+", other)

    def __sub__(self, other):
        return self._two("-", other)

    def __mul__(self, other):
        return self._two("*", other)

    def __truediv__(self, other):
        return E(f"({self}::DOUBLE / {E.of(other)})")

    def __mod__(self, other):
        return self._two("%", other)

    def __neg__(self):
        return E(f"(-{self})")

    def isNull(self):  # noqa: N802
        return E(f"({self} IS NULL)")

    def isNotNull(self):  # noqa: N802
        return E(f"({self} IS NOT NULL)")

    def isin(self, *values):
        return E(f"({self} IN ({', '.join(quoted(v) for v in values)}))")

    __hash__ = None
