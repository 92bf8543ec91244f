"""Rule documents as small dataclasses.

Rules are few and small, so they are parsed and validated on the driver; the
data they run over never passes through here.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from typing import Any

# The envelope fields of an event message.  A field written as
# "_<name>" for one of these names maps to the flat column "<name>".
ENVELOPE_FIELDS = ("event_timestamp", "event_id", "category", "event_type", "version")

# The grouping key that means "one group for all events".
GLOBAL_KEY = "__GLOBAL__"

# Default window size and the backtest row cap.
DEFAULT_WINDOW_MS = 300000
BACKTEST_ROW_CAP = 5000

AGG_FUNCTIONS = ("COUNT", "COUNT_DISTINCT", "SUM", "AVG", "MIN", "MAX")
RULE_STATUSES = ("DRAFT", "ACTIVE", "PAUSED", "DELETED")


def translate_field(name: str) -> str:
    """Message field name -> flat column name.

    "_data.X" becomes "X" (case is folded later by `validate_identifier`);
    "_event_timestamp" and the other envelope names lose their underscore.
    Any other name keeps its text after the first "_data." is removed.
    """
    if name.startswith("_") and name[1:] in ENVELOPE_FIELDS:
        return name[1:]
    return name.replace("_data.", "", 1)


def validate_identifier(name: str) -> str:
    """Trim and lower-case; then require a letter or "_" first and only
    letters, digits and "_" after.  Raises ValueError otherwise."""
    clean = name.strip().lower()
    if not clean:
        raise ValueError("empty identifier")
    for i, ch in enumerate(clean):
        is_letter = unicodedata.category(ch).startswith("L")
        is_digit = unicodedata.category(ch) == "Nd"
        if i == 0 and not (is_letter or ch == "_"):
            raise ValueError(f"invalid column identifier: {name!r}")
        if i > 0 and not (is_letter or is_digit or ch == "_"):
            raise ValueError(f"invalid column identifier: {name!r}")
    return clean


def column_for(field_name: str) -> str:
    """translate + validate in one step."""
    return validate_identifier(translate_field(field_name))


@dataclass(frozen=True)
class AggSpec:
    alias: str
    field: str
    function: str
    cardinality_hint: str = ""

    @property
    def function_upper(self) -> str:
        return (self.function or "").upper()


@dataclass(frozen=True)
class WindowSpec:
    type: str = "TUMBLING"
    size_ms: int | None = None
    slide_ms: int = 0
    allowed_lateness_ms: int = 0
    alignment_offset_ms: int = 0
    time_type: str = ""
    timestamp_field: str = ""
    timestamp_format: str = ""
    use_kafka_timestamp: bool = False

    def backtest_seconds(self) -> int:
        """Backtest windows are always tumbling: size in whole seconds,
        default 300 s, at least 1 s (the integer division truncates)."""
        ms = DEFAULT_WINDOW_MS if self.size_ms is None else int(self.size_ms)
        secs = int(ms / 1000) if ms >= 0 else -int(-ms / 1000)
        return max(secs, 1)


@dataclass(frozen=True)
class RuleSpec:
    rule_id: str
    rule_name: str = ""
    status: str = "DRAFT"
    severity_level: str = ""
    penalty_ttl_seconds: int = 0
    source_topic: str = ""
    filters: dict | None = None
    keys: tuple[str, ...] = ()
    entity_name: str = ""
    anomaly_entity_field: str = ""
    window: WindowSpec = field(default_factory=WindowSpec)
    aggregations: tuple[AggSpec, ...] = ()
    threshold: str = ""
    agg_sink_enabled: bool = False
    anomaly_sink_enabled: bool = False
    anomaly_store_sink_enabled: bool = False

    @property
    def is_global(self) -> bool:
        return len(self.keys) == 1 and str(self.keys[0]) == GLOBAL_KEY

    @classmethod
    def from_dict(cls, doc: dict[str, Any] | str) -> "RuleSpec":
        if isinstance(doc, str):
            doc = json.loads(doc)
        meta = doc.get("rule_metadata") or {}
        routing = doc.get("execution_routing") or {}
        grouping = doc.get("grouping") or {}
        win = doc.get("windowing") or {}
        sinks = doc.get("sinks") or {}
        having = doc.get("having_thresholds") or {}
        filters = doc.get("filters")
        if isinstance(filters, str):
            filters = json.loads(filters) if filters.strip() else None
        size = win.get("size_ms")
        window = WindowSpec(
            type=str(win.get("type") or "TUMBLING"),
            size_ms=int(size) if isinstance(size, (int, float)) and not isinstance(size, bool) else None,
            slide_ms=int(win.get("slide_ms") or 0),
            allowed_lateness_ms=int(win.get("allowed_lateness_ms") or 0),
            alignment_offset_ms=int(win.get("alignment_offset_ms") or 0),
            time_type=str(win.get("time_type") or ""),
            timestamp_field=str(win.get("timestamp_field") or ""),
            timestamp_format=str(win.get("timestamp_format") or ""),
            use_kafka_timestamp=bool(win.get("use_kafka_timestamp") or False),
        )
        aggs = tuple(
            AggSpec(
                alias=str(a.get("alias") or ""),
                field=str(a.get("field") or ""),
                function=str(a.get("function") or ""),
                cardinality_hint=str(a.get("cardinality_hint") or ""),
            )
            for a in (doc.get("aggregations") or [])
            if isinstance(a, dict)
        )
        return cls(
            rule_id=str(meta.get("rule_id") or ""),
            rule_name=str(meta.get("rule_name") or ""),
            status=str(meta.get("status") or "DRAFT"),
            severity_level=str(meta.get("severity_level") or ""),
            penalty_ttl_seconds=int(meta.get("penalty_ttl_seconds") or 0),
            source_topic=str(routing.get("target_source_topic") or ""),
            filters=filters if isinstance(filters, dict) else None,
            keys=tuple(str(k) for k in (grouping.get("keys") or [])),
            entity_name=str(grouping.get("entity_name") or ""),
            anomaly_entity_field=str(grouping.get("anomaly_entity_field") or ""),
            window=window,
            aggregations=aggs,
            threshold=str(having.get("expression") or ""),
            agg_sink_enabled=bool(sinks.get("agg_sink_enabled") or False),
            anomaly_sink_enabled=bool(sinks.get("anomaly_sink_enabled") or False),
            anomaly_store_sink_enabled=bool(sinks.get("anomaly_store_sink_enabled") or False),
        )

    def to_dict(self) -> dict[str, Any]:
        w = self.window
        return {
            "rule_metadata": {
                "rule_id": self.rule_id, "rule_name": self.rule_name, "status": self.status,
                "severity_level": self.severity_level, "penalty_ttl_seconds": self.penalty_ttl_seconds,
            },
            "execution_routing": {"target_source_topic": self.source_topic},
            "filters": self.filters,
            "grouping": {"keys": list(self.keys), "entity_name": self.entity_name,
                         "anomaly_entity_field": self.anomaly_entity_field},
            "windowing": {
                "type": w.type, "time_type": w.time_type, "timestamp_field": w.timestamp_field,
                "timestamp_format": w.timestamp_format, "use_kafka_timestamp": w.use_kafka_timestamp,
                "size_ms": w.size_ms if w.size_ms is not None else DEFAULT_WINDOW_MS,
                "slide_ms": w.slide_ms, "allowed_lateness_ms": w.allowed_lateness_ms,
                "alignment_offset_ms": w.alignment_offset_ms,
            },
            "aggregations": [
                {"alias": a.alias, "field": a.field, "function": a.function,
                 "cardinality_hint": a.cardinality_hint} for a in self.aggregations
            ],
            "having_thresholds": {"expression": self.threshold},
            "sinks": {"agg_sink_enabled": self.agg_sink_enabled,
                      "anomaly_sink_enabled": self.anomaly_sink_enabled,
                      "anomaly_store_sink_enabled": self.anomaly_store_sink_enabled},
        }


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """Request parameter clamp: missing or out-of-range -> default."""
    if value is None:
        return default
    value = int(value)
    if value < low or value > high:
        return default
    return value


_ID_LIST_SPLIT = re.compile(r",")


def split_id_list(text: str) -> list[str]:
    """Comma text -> trimmed, non-empty ids (driver-side parameter parsing)."""
    return [p.strip() for p in _ID_LIST_SPLIT.split(text or "") if p.strip()]
