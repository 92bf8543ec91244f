"""Filter tree -> one boolean Column.

The tree is a JSON document of groups ({"type": "group", "logic": "AND"|"OR",
"conditions": [...]}) and leaves ({"type": "condition", "field", "operator",
"value", "format"}).  It is walked on the driver; the result is a single
Catalyst expression, so comparisons on plain columns reach the Parquet scan
as pushed filters.

Lenient mode (the default) drops a leaf it cannot compile -- which widens
the match -- the way the rule editor's users rely on.  Strict mode raises.
"""

from __future__ import annotations

import datetime as dt
import functools
import logging
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.spec import column_for

log = logging.getLogger(__name__)

COMPARISONS = {
    "EQUALS": lambda c, v: c == v,
    "NOT_EQUALS": lambda c, v: c != v,
    "GREATER_THAN": lambda c, v: c > v,
    "GREATER_THAN_EQUAL": lambda c, v: c >= v,
    "LESS_THAN": lambda c, v: c < v,
    "LESS_THAN_EQUAL": lambda c, v: c <= v,
}
TEXT_OPS = {
    "CONTAINS": lambda s, v: s.contains(v),
    "NOT_CONTAINS": lambda s, v: ~s.contains(v),
    "STARTS_WITH": lambda s, v: s.startswith(v),
    "ENDS_WITH": lambda s, v: s.endswith(v),
}
DATE_OPS = {
    "DATE_BEFORE": lambda c, v: c < v,
    "DATE_AFTER": lambda c, v: c > v,
    "DATE_EQUALS": lambda c, v: c == v,
}
# The code-list membership operator name, and the field it reads.
CODE_LIST_OPERATOR = "IS_FINANCIAL_AUA"
CODE_LIST_FIELD = "_data.aua"
CODE_LIST_MARKER = "__in_code_list"


class FilterError(ValueError):
    """Raised in strict mode for a leaf or group that cannot be compiled."""


class UnknownColumnError(LookupError):
    """A valid identifier that names no column: always an error (the lenient
    mode only forgives malformed leaves, never a wrong table)."""


@dataclass
class FilterContext:
    """What the compiler needs to know about the frame it filters."""

    schema: T.StructType
    strict: bool = False
    # name of the column that holds the code-list membership marker (see
    # `attach_code_list`); None means the code list is a plain value list
    code_values: tuple | None = None
    code_marker: str | None = None
    code_field: str = CODE_LIST_FIELD
    dropped: list = field(default_factory=list)

    def dtype(self, name: str) -> T.DataType:
        for f in self.schema.fields:
            if f.name.lower() == name:
                return f.dataType
        raise UnknownColumnError(f"unknown column: {name!r}")

    def resolve(self, name: str) -> str:
        for f in self.schema.fields:
            if f.name.lower() == name:
                return f.name
        raise UnknownColumnError(f"unknown column: {name!r}")


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                          T.FloatType, T.DoubleType, T.DecimalType))


def bind_value(col: Column, dtype: T.DataType, value) -> tuple[Column, Column]:
    """Line up a JSON value with a column of type `dtype`.

    Text against a typed column is cast to the column's type (bad text ->
    null -> no match).  A number against a text column compares the column's
    numeric reading.  Numbers against numbers compare as numbers.
    """
    if isinstance(value, bool):
        if isinstance(dtype, T.BooleanType):
            return col, F.lit(value)
        if isinstance(dtype, T.StringType):
            return col.try_cast("boolean"), F.lit(value)
        return col, F.lit(value).cast(dtype)
    if isinstance(value, (int, float)):
        if _numeric(dtype):
            return col, F.lit(value)
        if isinstance(dtype, T.StringType):
            return col.try_cast("double"), F.lit(float(value))
        return col, F.lit(value).try_cast(dtype)
    if value is None:
        return col, F.lit(None).cast(dtype)
    text = str(value)
    if isinstance(dtype, T.StringType):
        return col, F.lit(text)
    return col, F.lit(text).try_cast(dtype)


def resolve_date_value(value, fmt: str | None) -> dt.datetime:
    """Date filter value -> naive UTC datetime.

    EPOCH_MILLIS: integer text or number.  ISO_STRING (or no format): ISO
    8601 text that must carry an offset.  Any other format is an error.
    """
    fmt = fmt or ""
    if fmt == "EPOCH_MILLIS":
        if isinstance(value, float) and value.is_integer():
            value = int(value)
        ms = int(str(value).strip())
        return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    if fmt in ("ISO_STRING", ""):
        text = str(value).strip()
        if text.endswith("Z"):
            text = text[:-1] + "+00:00"
        parsed = dt.datetime.fromisoformat(text)
        if parsed.tzinfo is None or "T" not in text:
            raise ValueError(f"ISO value needs a date, 'T', time and offset: {value!r}")
        return parsed.astimezone(dt.timezone.utc).replace(tzinfo=None)
    raise ValueError(f"unknown date format {fmt!r}")


def _split_in_values(value) -> list:
    if isinstance(value, list):
        return value
    if isinstance(value, str):
        return [s.strip() for s in value.split(",")]
    return []


def compile_filter(node: dict | None, ctx: FilterContext) -> Column | None:
    """Compile a filter tree; None means "no filter"."""
    if not node:
        return None
    kind = node.get("type")
    if kind == "group":
        logic = node.get("logic")
        logic = logic if logic in ("AND", "OR") else "AND"
        parts = [
            p for p in (compile_filter(c, ctx) for c in (node.get("conditions") or []) if isinstance(c, dict))
            if p is not None
        ]
        if not parts:
            return None
        if len(parts) == 1:
            return parts[0]
        op = (lambda a, b: a & b) if logic == "AND" else (lambda a, b: a | b)
        return functools.reduce(op, parts)
    if kind == "condition":
        try:
            return _compile_leaf(node, ctx)
        except (ValueError, TypeError, OverflowError) as exc:
            if ctx.strict:
                raise FilterError(str(exc)) from exc
            log.warning("dropping filter leaf %r: %s", node, exc)
            ctx.dropped.append((node, str(exc)))
            return None
    if ctx.strict:
        raise FilterError(f"unknown node type: {kind!r}")
    return None


def _compile_leaf(node: dict, ctx: FilterContext) -> Column | None:
    op = node.get("operator") or ""
    if op == CODE_LIST_OPERATOR:
        return _code_list_predicate(ctx)
    name = column_for(str(node.get("field") or ""))
    real = ctx.resolve(name)
    dtype = ctx.dtype(name)
    col = F.col(real)
    value = node.get("value")
    if op in COMPARISONS:
        c, v = bind_value(col, dtype, value)
        return COMPARISONS[op](c, v)
    if op == "IN":
        items = _split_in_values(value)
        if not items:
            raise ValueError("empty IN list")
        # each item fixes how the column is read (as text, as a number ..), so items are grouped by their kind
        bound = [(isinstance(v, (bool, int, float)), isinstance(v, bool), *bind_value(col, dtype, v)) for v in items]
        groups: dict[tuple, list] = {}
        for number, flag, side, literal in bound:
            groups.setdefault((number, flag), [side, []])[1].append(literal)
        return functools.reduce(lambda a, b: a | b, (F.coalesce(side.isin(literals), F.lit(False)) if len(groups) > 1 else side.isin(literals)
                                                     for side, literals in groups.values()))
    from thresher.functions.timeutil import number_text

    if op == "REGEX":
        return number_text(col, dtype).rlike(str(value))
    if op in TEXT_OPS:
        return TEXT_OPS[op](number_text(col, dtype), F.lit(str(value)).cast("string"))
    if op == "IS_NULL":
        return col.isNull()
    if op == "IS_NOT_NULL":
        return col.isNotNull()
    if op in DATE_OPS:
        when = resolve_date_value(value, node.get("format"))
        from thresher.functions.timeutil import ntz_literal

        return DATE_OPS[op](col.try_cast("timestamp_ntz"), ntz_literal(when))
    raise ValueError(f"unknown operator {op!r}")


def _code_list_predicate(ctx: FilterContext) -> Column:
    if ctx.code_marker is not None:
        return F.coalesce(F.col(ctx.code_marker), F.lit(False))
    if ctx.code_values is not None:
        name = column_for(ctx.code_field)
        real = ctx.resolve(name)
        return F.col(real).isin(list(ctx.code_values))
    raise ValueError("no code list configured")


def uses_code_list(node: dict | None) -> bool:
    if not node:
        return False
    if node.get("type") == "condition":
        return node.get("operator") == CODE_LIST_OPERATOR
    return any(uses_code_list(c) for c in (node.get("conditions") or []) if isinstance(c, dict))


def attach_code_list(df: DataFrame, codes: DataFrame, field_col: str,
                     code_col: str | None = None) -> DataFrame:
    """Add a boolean marker column: does `field_col` appear in the code list?

    The list is a table, so it can be maintained as data.  It is made
    distinct first; AQE broadcasts it when its size at run time is small,
    otherwise the join shuffles (and AQE splits skewed partitions).
    """
    code_col = code_col or codes.columns[0]
    marks = codes.select(F.col(code_col).alias("__code")).distinct().withColumn(CODE_LIST_MARKER, F.lit(True))
    joined = df.join(marks, df[field_col] == marks["__code"], "left")
    return joined.drop("__code")


def filter_frame(df: DataFrame, tree: dict | None, strict: bool = False,
                 code_values: Iterable | None = None, code_field: str = CODE_LIST_FIELD) -> DataFrame:
    """Apply a filter tree to a frame (convenience wrapper)."""
    marker = CODE_LIST_MARKER if CODE_LIST_MARKER in df.columns else None
    ctx = FilterContext(df.schema, strict=strict,
                        code_values=tuple(code_values) if code_values is not None else None,
                        code_marker=marker, code_field=code_field)
    pred = compile_filter(tree, ctx)
    return df if pred is None else df.where(pred)
