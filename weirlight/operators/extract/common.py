"""What extractors share: a fact as a dictionary, line numbers, database kinds."""

from __future__ import annotations

import json
import re
from typing import Any

PLACEHOLDER = re.compile(r"\$\{?\w|\{[A-Za-z_]\w*\}|%s")
IDENTIFIER = r"[\w$`{}:-]+(?:\.[\w$`{}:-]+)*"


def fact(kind: str, line: int, confidence: float, method: str, urn: str | None = None, dataset_type: str | None = None, evidence: str = "", params: dict[str, Any] | None = None, **more: Any) -> dict[str, Any]:
    return {
        "fact_type": kind, "line_number": line, "confidence": confidence, "extraction_method": method, "dataset_urn": urn, "dataset_type": dataset_type, "evidence": evidence[:200],
        "params": json.dumps(params, sort_keys=True) if params else None, "has_placeholders": bool(urn and PLACEHOLDER.search(urn)), "is_ambiguous": False,
    } | more


def config(key: str, value: str, line: int, confidence: float, method: str = "REGEX", source: str = "code") -> dict[str, Any]:
    return fact("CONFIG", line, confidence, method, config_key=key, config_value=value, config_source=source, evidence=f"{key}={value}")


def hive(name: str) -> str:
    return "hive://" + re.sub("[`\"]", "", name).lower()


def database(url: str) -> str:
    low = url.lower()
    return next((kind for mark, kind in (("oracle", "oracle"), ("postgres", "postgres"), ("mysql", "mysql"), ("sqlserver", "mssql")) if mark in low), "jdbc")


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1
