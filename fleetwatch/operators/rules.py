"""Alert rules and limits from nested documents: conditions become predicates over observations."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from fleetwatch.operators.alerts import OBSERVATION, Rule

# Condition names that differ from their column or aren't an equality, and severities in rising order.
_NAMES = {
    "event_type": ("kind", "="), "consecutive_count": ("streak", ">="), "distinct_sms": ("failing_sms", ">="),
    "min_severity": ("severity_code", ">="), "max_severity": ("severity_code", "<="), "min_confidence": ("confidence", ">="),
    "pattern_type": ("pattern", "="),
}
_ENDINGS = {"_gt": ">", "_gte": ">=", "_lt": "<", "_lte": "<="}
SEVERITIES = ("INFO", "WARNING", "HIGH", "CRITICAL")
#: Conditions that say how observations are made, not which ones match.
_MAKING = {"window_seconds", "timeout_seconds"}
#: Columns whose values are lower case in observations.
_LOWER = {"pattern", "action"}


def _column(name: str) -> tuple[str, str]:
    if name in _NAMES:
        return _NAMES[name]
    if name in OBSERVATION:
        return name, "="
    for ending, sign in _ENDINGS.items():
        if name.endswith(ending) and name.removesuffix(ending) in OBSERVATION:
            return name.removesuffix(ending), sign
    raise ValueError(f"no observation column for the condition {name!r}")


def _literal(column: str, value: Any) -> str:
    if column == "severity_code" and isinstance(value, str):
        return str(SEVERITIES.index(value) + 1)
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, str):
        text = value.lower() if column in _LOWER else value
        return "'" + re.sub(r"([\\'])", r"\\\1", text) + "'"
    raise ValueError(f"{column} can't be compared with {value!r}")


def predicate(condition: Mapping[str, Any]) -> str:
    """All conditions of a rule as one SQL predicate; a list means any of its values, an empty mapping matches all."""
    parts = []
    for name, value in condition.items():
        if name in _MAKING:
            continue
        column, sign = _column(name)
        if isinstance(value, list):
            if sign != "=" or not value:
                raise ValueError(f"{name} takes one value")
            parts.append(f"{column} IN ({', '.join(_literal(column, v) for v in value)})")
        else:
            parts.append(f"{column} {sign} {_literal(column, value)}")
    return " AND ".join(parts) or "true"


def rules_from(document: Mapping[str, Any], channels: Mapping[str, str] | None = None) -> tuple[Rule, ...]:
    """The rules of a document {rules: [...], global: {...}}.

    `channels` renames channels. A rule without a cooldown takes the document's `default_cooldown_seconds` (300 without one).
    Rules of one name, unknown conditions, severities and grouping columns are errors.
    """
    names = channels or {}
    cool = (document.get("global") or {}).get("default_cooldown_seconds", 300)
    found = []
    for r in document.get("rules") or []:
        rule = Rule(
            r["name"], predicate(r.get("condition") or {}), r["severity"], tuple(names.get(c, c) for c in r.get("channels") or ()),
            int(r.get("cooldown_seconds", cool)), r.get("group_by", "gpu_uuid"),
        )
        if rule.severity not in SEVERITIES or rule.group_by not in OBSERVATION:
            raise ValueError(f"rule {rule.name!r}: unknown severity or grouping")
        found.append(rule)
    if len({r.name for r in found}) < len(found):
        raise ValueError("two rules have one name")
    return tuple(found)


def making_seconds(document: Mapping[str, Any]) -> dict[str, int]:
    """Windows and timeouts that rules ask observations to be made with: {rule: seconds}."""
    return {
        r["name"]: int(v) for r in document.get("rules") or [] for k, v in (r.get("condition") or {}).items() if k in _MAKING
    }
