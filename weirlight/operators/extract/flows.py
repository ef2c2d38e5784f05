"""Facts of NiFi flows and of configuration files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from weirlight.operators.extract.common import config, fact, line_of

READERS = re.compile(r"\.(Get|List|Fetch|Consume|Query|Select|Execute|Scan|Tail|Listen|Generate(?=TableFetch))\w*$")
WRITERS = re.compile(r"\.(Put|Publish|Store|Insert|Upsert|Merge|Post)\w*$")


def _first(p: dict[str, Any], *keys: str) -> str | None:
    low = {re.sub(r"[^a-z]", "", k.lower()): v for k, v in p.items()}
    return next((str(low[k]) for k in keys if low.get(k)), None)


def dataset_of(kind: str, p: dict[str, Any]) -> tuple[str, str] | None:
    """URN and type of what a processor reads or writes, by the family in its class name."""
    low = kind.lower()
    path = _first(p, "directory", "inputdirectory", "remotepath", "hdfsfilename", "filename", "filetofetch", "filetotail", "path")
    table = _first(p, "tablename", "table", "hivetablename", "putdbrecordtablename")
    if "hdfs" in low or "hadoop" in low or "parquet" in low:
        return (path, "hdfs") if path else None
    if "sftp" in low or "ftp" in low:
        host = _first(p, "hostname", "host") or "unknown"
        return f"{'sftp' if 'sftp' in low else 'ftp'}://{host}/{(path or '').lstrip('/')}", "sftp" if "sftp" in low else "ftp"
    if "kafka" in low:
        topic = _first(p, "topic", "topicname", "topics", "topicnames")
        return (f"kafka://{topic}", "kafka") if topic else None
    if "hive" in low:
        name = f"{_first(p, 'databasename', 'hivedatabasename', 'database') or 'default'}.{table}" if table and "." not in table else table
        return (f"hive://{name.lower()}", "hive") if name else None
    if "hbase" in low:
        return (f"hbase://{table}", "hbase") if table else None
    if "mongo" in low:
        return f"mongodb://{_first(p, 'mongodatabasename', 'database') or 'unknown'}/{_first(p, 'mongocollectionname', 'collection') or 'unknown'}", "mongodb"
    if "s3" in low:
        return f"s3://{_first(p, 'bucket') or 'unknown'}/{_first(p, 'objectkey', 'prefix') or ''}", "s3"
    if "elasticsearch" in low:
        return (f"elasticsearch://{i}", "elasticsearch") if (i := _first(p, "index", "elindex")) else None
    if "http" in low:
        return (u, "http") if (u := _first(p, "url", "httpurl", "remoteurl")) else None
    if "sql" in low or "database" in low or "dbrecord" in low or "tablefetch" in low:
        if table:
            return f"jdbc://{table}", "jdbc"
        m = re.search(r"(?i)\b(?:from|into)\s+([\w.$`{}#]+)", _first(p, "sqlselectquery", "sqlquery", "sqlstatement") or "")
        return (f"jdbc://{m[1]}", "jdbc") if m else None
    return (path, "file") if "file" in low and path else None


def _groups(x: Any) -> Iterator[dict[str, Any]]:
    if isinstance(x, dict):
        if isinstance(x.get("processors"), list):
            yield x
        for v in x.values():
            yield from _groups(v) if not isinstance(v, list) else (g for i in v for g in _groups(i))


def nifi(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    flow, out = json.loads(content), []
    line = lambda mark: line_of(content, max(0, content.find(mark)))
    for context in flow.get("parameterContexts", []) if isinstance(flow, dict) else []:
        for p in context.get("parameters", []):
            if p.get("value") is not None:
                out.append(config(str(p.get("name")), str(p["value"]), line(f'"{p.get("name")}"'), 0.95, "JSON_PARSE", f"nifi:{context.get('name')}"))
    for group in _groups(flow):
        for p in group["processors"]:
            kind = str(p.get("type", ""))
            properties = (p.get("config") or {}).get("properties") or p.get("properties") or {}
            got = dataset_of(kind.rsplit(".", 1)[-1], properties)
            way = "WRITE" if WRITERS.search("." + kind.rsplit(".", 1)[-1]) else "READ" if READERS.search("." + kind.rsplit(".", 1)[-1]) else None
            if got and way and not (way == "WRITE" and got[1] == "http") and not (way == "READ" and got[1] == "elasticsearch"):
                out.append(fact(way, line_of(content, at.start() if (at := re.search(rf'"identifier"\s*:\s*"{re.escape(str(p.get("identifier")))}"', content)) else 0), 0.75, "JSON_PARSE", got[0], got[1], f"{p.get('name')} ({kind})", {"processor": p.get("name"), "type": kind}))
    return out


def flat(x: Any, prefix: str = "", listed: bool = False) -> Iterator[tuple[str, str, float]]:
    if isinstance(x, dict):
        for k, v in x.items():
            yield from flat(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from flat(v, f"{prefix}[{i}]", True)
    elif x is not None and prefix:
        yield prefix, str(x).lower() if isinstance(x, bool) else str(x), 0.8 if listed else 0.9


def _flat_facts(x: Any, content: str, source: str) -> list[dict[str, Any]]:
    out = []
    for k, v, c in flat(x) if isinstance(x, dict) else ():
        own = re.escape(re.sub(r"(\[\d+\])+$", "", k).rsplit(".", 1)[-1])
        at = re.search(rf"""(?:^|[\s{{\[,-])(["']?){own}\1\s*:""", content)
        out.append(config(k, v, line_of(content, at.start(1) if at else 0), c, "JSON_PARSE", source))
    return out


def json_config(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    return _flat_facts(json.loads(content), content, "json")


def yaml_config(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    import yaml

    return [f for x in yaml.safe_load_all(content) for f in _flat_facts(x, content, "yaml")]


def properties(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    out = []
    for i, line in enumerate(content.splitlines(), 1):
        m = re.match(r"\s*([^#!=:\s][^=:]*?)\s*[=:]\s*(.*?)\s*$", line)
        if m:
            out.append(config(m[1], m[2], i, 0.9, "REGEX", "properties"))
    return out


def xml(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    from xml.etree import ElementTree

    out = []
    for e in ElementTree.fromstring(content).iter():
        name, value = e.findtext("name"), e.findtext("value")
        if e.tag == "property" and name and value is not None:
            out.append(config(name.strip(), value.strip(), line_of(content, max(0, content.find(name))), 0.9, "REGEX", "xml"))
        for k, v in e.attrib.items():
            out.append(config(f"{e.tag}.{k}", v, line_of(content, max(0, content.find(f'{k}="'))), 0.7, "REGEX", "xml"))
    return out


def conf(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    """JSON, else a YAML mapping, else properties."""
    for way in (json_config, yaml_config):
        try:
            if got := way(content):
                return got
        except Exception:  # noqa: BLE001 - not of this format
            continue
    return properties(content)
