"""The selection language, compiled to one Catalyst predicate.

    selection = term (OR term)*; term = factor (AND factor)*; factor = NOT factor | ( selection ) | named X | field op value

Fields: x y z, type / type_id, element, name, resname, residue_id / resid / mol, chain_id / chain. Selections are
two-valued: a null field compares as -1 or the empty string. In the panel dialect element compares in any case, a null type is 0,
and coordinates equal a value within 1e-9.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<op>==|!=|>=|<=|=|>|<)|(?P<paren>[()])|(?P<text>"[^"]*"|'[^']*')|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][\w'*]*))""")
_NUMBERS = {"type": "type_id", "type_id": "type_id", "residue_id": "residue_id", "resid": "residue_id", "mol": "residue_id"}
_STRINGS = {"element": "element", "name": "name", "resname": "resname", "chain_id": "chain_id", "chain": "chain_id"}


class SelectionError(ValueError):
    """The text is no selection."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise SelectionError(f"unexpected text: {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, named: dict[str, Column], dialect: str, compat: bool):
        self.tokens, self.at, self.named, self.panel, self.compat = _tokens(text), 0, named, dialect == "panel", compat

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def keyword(self, word: str) -> bool:
        kind, value = self.peek()
        if kind == "word" and value.upper() == word:
            self.at += 1
            return True
        return False

    def either(self) -> Column:
        out = self.both()
        while self.keyword("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.factor()
        while self.keyword("AND"):
            out = out & self.factor()
        return out

    def factor(self) -> Column:
        if self.keyword("NOT"):
            return ~self.factor()
        kind, value = self.take()
        if value == "(":
            out = self.either()
            if self.take()[1] != ")":
                raise SelectionError("a parenthesis is open")
            return out
        if kind != "word":
            raise SelectionError(f"expected a field, not {value!r}")
        if value.lower() == "named":
            name = self.take()[1]
            if name not in self.named:
                raise SelectionError(f"unknown selection {name!r}")
            return self.named[name]
        return self.compare(value)

    def compare(self, field: str) -> Column:
        kind, op = self.take()
        value_kind, value = self.take()
        if kind != "op" or value_kind not in ("text", "number", "word"):
            raise SelectionError(f"expected an operator and a value after {field!r}")
        value, op = value.strip("\"'"), "==" if op == "=" else op
        if field in ("x", "y", "z") or field in _NUMBERS:
            try:
                number = float(value)
            except ValueError:
                raise SelectionError(f"{field} needs a number, not {value!r}") from None
            if field in _NUMBERS:
                column, number = F.coalesce(F.col(_NUMBERS[field]), F.lit(0 if self.panel and field.startswith("type") else -1)), int(number)
            else:
                column = F.col(field)
                if self.panel and op in ("==", "!="):
                    near = F.abs(column - number) < 1e-9
                    return near if op == "==" else ~near
            return {"==": column == number, "!=": column != number, ">": column > number, "<": column < number, ">=": column >= number, "<=": column <= number}[op]
        if field in _STRINGS:
            if op not in ("==", "!="):
                raise SelectionError(f"{field} compares by == or != only")
            column = F.coalesce(F.col("name" if self.compat and field == "resname" else _STRINGS[field]), F.lit(""))
            if self.panel and field == "element":
                column, value = F.upper(column), value.upper()
            return column == value if op == "==" else column != value
        raise SelectionError(f"unknown field {field!r}")


def compile_selection(text: str, named: dict[str, Column] | None = None, dialect: str = "core", compat: bool = False) -> Column:
    """compat: resname compares the atom name."""
    parser = _Parser(text, named or {}, dialect, compat)
    out = parser.either()
    if parser.peek()[0] != "end":
        raise SelectionError(f"unexpected text: {parser.peek()[1]!r}")
    return out


def index_range(text: str, col: str = "idx") -> Column:
    """`all` or nothing, `a-b` inclusive, or a list of indices."""
    text = text.strip()
    if text.lower() in ("", "all"):
        return F.lit(True)
    out = F.lit(False)
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise SelectionError(f"no index range: {part!r}")
        out = out | F.col(col).between(int(m[1]), int(m[2] or m[1]))
    return out
