"""Threshold text -> boolean Column over the aggregate aliases.

Accepted: aliases, numbers, + - * /, comparisons (= == != <> < > <= >=),
AND / OR / NOT in any case or as && and ||, true / false, parentheses, and
CASE [operand] WHEN .. THEN .. [ELSE ..] END.

Each grammar rule below yields a built-in Column, so the flag is part of the
aggregate's plan.  Contract:

  * identifiers are keywords or aliases, as written (`Total` is not `total`),
    so `1e5` is rejected: `e5` reads as an identifier;
  * text that doesn't parse, or an empty one, gives a constant false flag and
    never an error; a null result is false;
  * `/` never fails: division by zero is null.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# The keywords of threshold text (in any case).
KEYWORDS = {"AND", "OR", "NOT", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END"}

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*|\.\d+)|(?P<word>[A-Za-z_]\w*)|(?P<sign>&&|\|\||==|<=|>=|!=|<>|[=<>()+*/-])|(?P<other>\S))", re.ASCII)
_SAME = {"&&": "AND", "||": "OR", "==": "=", "<>": "!="}


class ThresholdError(ValueError):
    pass


@dataclass
class Threshold:
    """Compiled threshold: the flag column and, if rejected, why."""

    column: Column
    error: str | None = None


def tokens(text: str, aliases: set[str]) -> list[str]:
    """The tokens of threshold text: keywords in capitals, aliases as they are."""
    found = []
    for m in _TOKEN.finditer(text.rstrip()):
        token = m[m.lastgroup]
        if m.lastgroup == "other":
            raise ThresholdError(f"{token!r} has no place in a threshold")
        if m.lastgroup == "word" and token not in aliases:
            if token.upper() not in KEYWORDS:
                raise ThresholdError(f"no aggregate is called {token!r}")
            token = token.upper()
        found.append(_SAME.get(token, token))
    return found


class _Reader:
    """Recursive descent over the tokens; every rule returns a Column."""

    def __init__(self, found: list[str], columns: dict[str, Column]) -> None:
        self.left, self.columns = found[::-1], columns

    def next_is(self, *wanted: str) -> str | None:
        return self.left.pop() if self.left and self.left[-1] in wanted and self.left[-1] not in self.columns else None

    def must(self, wanted: str) -> None:
        if not self.next_is(wanted):
            raise ThresholdError(f"expected {wanted}, found {self.left[-1] if self.left else 'the end'}")

    def whole(self) -> Column:
        value = self.either()
        if self.left:
            raise ThresholdError(f"unexpected {self.left[-1]!r}")
        return value

    def either(self) -> Column:
        value = self.both()
        while self.next_is("OR"):
            value = value | self.both()
        return value

    def both(self) -> Column:
        value = self.negated()
        while self.next_is("AND"):
            value = value & self.negated()
        return value

    def negated(self) -> Column:
        return ~self.negated() if self.next_is("NOT") else self.compared()

    def compared(self) -> Column:
        a = self.sum()
        sign = self.next_is("=", "!=", "<", "<=", ">", ">=")
        if not sign:
            return a
        b = self.sum()
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]

    def sum(self) -> Column:
        value = self.product()
        while sign := self.next_is("+", "-"):
            value = value + self.product() if sign == "+" else value - self.product()
        return value

    def product(self) -> Column:
        value = self.signed()
        while sign := self.next_is("*", "/"):
            other = self.signed()
            value = value * other if sign == "*" else self.divided(value, other)
        return value

    def signed(self) -> Column:
        if sign := self.next_is("+", "-"):
            return -self.signed() if sign == "-" else self.signed()
        return self.atom()

    def atom(self) -> Column:
        if self.next_is("("):
            value = self.either()
            self.must(")")
            return value
        if self.next_is("CASE"):
            return self.case()
        if word := self.next_is("TRUE", "FALSE"):
            return self.literal(word == "TRUE")
        token = self.left.pop() if self.left else ""
        if token in self.columns:
            return self.columns[token]
        if token and token[0] in ".0123456789":
            return self.literal(int(token) if token.isdigit() and len(token) < 19 else float(token))
        raise ThresholdError(f"unexpected {token or 'end'!r}")

    def case(self) -> Column:
        operand = None if self.left and self.left[-1] == "WHEN" else self.either()
        branches, other = [], None
        self.must("WHEN")
        while True:
            when = self.either()
            self.must("THEN")
            branches.append((when if operand is None else operand == when, self.either()))
            if not self.next_is("WHEN"):
                break
        if self.next_is("ELSE"):
            other = self.either()
        self.must("END")
        return self.chosen(branches, other)

    # what depends on the kind of value

    def literal(self, value):
        return F.lit(value)

    def divided(self, a, b):
        return F.try_divide(a.cast("double"), b.cast("double"))

    def chosen(self, branches, other):
        chain = F
        for when, then in branches:
            chain = chain.when(when, then)
        return chain if other is None else chain.otherwise(other)


class _Plain:
    """One value with SQL's rules for null; for rows of many rules, each with
    a threshold of its own, where the text is data and not part of the plan."""

    __slots__ = ("v",)
    __hash__ = None

    def __init__(self, v):
        self.v = v

    def _with(self, other, f):
        return _Plain(None if self.v is None or other.v is None else f(self.v, other.v))

    def __or__(self, other):
        sides = (self.v, other.v)
        return _Plain(True if any(s is not None and bool(s) for s in sides) else None if None in sides else False)

    def __and__(self, other):
        sides = (self.v, other.v)
        return _Plain(False if any(s is not None and not s for s in sides) else None if None in sides else True)

    def __invert__(self):
        return _Plain(None if self.v is None else not self.v)

    def __neg__(self):
        return _Plain(None if self.v is None else -self.v)

    def __eq__(self, other):
        return self._with(other, lambda a, b: a == b)

    def __ne__(self, other):
        return self._with(other, lambda a, b: a != b)

    def __lt__(self, other):
        return self._with(other, lambda a, b: a < b)

    def __le__(self, other):
        return self._with(other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self._with(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._with(other, lambda a, b: a >= b)

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)


class _PlainReader(_Reader):
    def literal(self, value):
        return _Plain(value)

    def divided(self, a, b):
        return a._with(b, lambda x, y: None if y == 0 else x / y)

    def chosen(self, branches, other):
        return next((then for when, then in branches if when.v), other if other is not None else _Plain(None))


def threshold_of(expr: str | None, values: dict) -> bool:
    """The flag for one row's aggregate values; as `compile_threshold` where
    the text is part of the plan."""
    try:
        found = tokens(expr or "", set(values))
        return bool(found) and bool(_PlainReader(found, {k: _Plain(v) for k, v in values.items()}).whole().v)
    except (ThresholdError, RecursionError):
        return False


def compile_threshold(expr: str | None, aliases: list[str] | set[str],
                      columns: dict[str, Column] | None = None) -> Threshold:
    """Threshold text -> Threshold(column=boolean never null)."""
    columns = columns or {a: F.col(a) for a in set(aliases)}
    try:
        found = tokens(expr or "", set(aliases))
        if not found:
            return Threshold(F.lit(False))
        flag = _Reader(found, columns).whole()
    except (ThresholdError, RecursionError) as exc:
        log.warning("threshold rejected: %s", exc)
        return Threshold(F.lit(False), str(exc))
    return Threshold(F.coalesce(flag.try_cast("boolean"), F.lit(False)))
