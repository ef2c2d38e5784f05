"""Facts of Scala and Java programs, by regular expressions over text whose comments are blanked."""

from __future__ import annotations

import datetime
import re
from typing import Any

from weirlight.operators.extract.common import config, database, fact, hive, line_of
from weirlight.operators.extract.sql_code import sql_facts

LITERAL = r'(?:s|f|raw)?"""(?:.*?)"""|(?:s|f)?"(?:[^"\\\n]|\\.)*"'
ARGUMENT = rf"({LITERAL}|[A-Za-z_][\w.]*)((?:\s*\+\s*(?:{LITERAL}|[A-Za-z_][\w.]*))*)"
VALUE = re.compile(rf"\b(?:val|var|(?:(?:public|private|protected|static|final)\s+)*String)\s+(\w+)\s*(?::\s*String\s*)?=\s*(?:if\s*\([^\n]*?\)\s*[^\n]*?\belse\s+)?({LITERAL})((?:\s*\+\s*(?:{LITERAL}|\w+))*)", re.S)
NAMED = re.compile(rf"\b(?:val|var|String)\s+(\w+)\s*(?::\s*String\s*)?=\s*([A-Za-z_]\w*)((?:\s*\+\s*(?:{LITERAL}|\w+))+)\s*[;\n]", re.S)
STAMP = re.compile(r"\b(?:val|var|String)\s+(\w+)\s*(?::\s*String\s*)?=\s*[^\n]*?(?:SimpleDateFormat|ofPattern|DateTimeFormatter[^\n]*?)\(\s*\"([^\"]+)\"[^\n]*")
PATTERN = (("yyyy", "%Y"), ("yy", "%y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S"))


def uncommented(text: str) -> str:
    """Comments blanked, outside of string literals only."""
    return re.sub(rf"({LITERAL})|//[^\n]*|/\*.*?\*/", lambda m: m[1] if m[1] else re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def strftime_of(java: str) -> str:
    for a, b in PATTERN:
        java = java.replace(a, b)
    return java.replace("'", "")


class Source:
    def __init__(self, content: str, as_of: str | None):
        self.text, self.names, self.facts = uncommented(content), {}, []
        for m in VALUE.finditer(self.text):
            self.names[m[1]] = self.fold(m[2], m[3])
            choice = "else" in m[0][: m.start(2) - m.start()]
            self.facts.append(config(m[1], self.names[m[1]], line_of(self.text, m.start()), 0.85 if choice else 0.9))
        for m in NAMED.finditer(self.text):  # names put together from others are known, though no settings of their own
            self.names.setdefault(m[1], self.fold(m[2], m[3]))
        for m in STAMP.finditer(self.text):
            form = strftime_of(m[2])
            self.names[m[1]] = datetime.date.fromisoformat(as_of).strftime(form) if as_of else "{date:%s}" % form
            self.facts.append(config(m[1], self.names[m[1]], line_of(self.text, m.start()), 0.88))

    def one(self, part: str) -> str:
        part = part.strip()
        m = re.fullmatch(r'(s|f|raw)?("""|")(.*)\2', part, re.S)
        if not m:
            name = part.rsplit(".", 1)[-1]
            return self.names.get(name, "{%s}" % name)
        if m[1] in ("s", "f"):
            return re.sub(r"\$\{?([A-Za-z_]\w*)\}?", lambda v: self.names.get(v[1], "${%s}" % v[1]), m[3])
        return m[3]

    def fold(self, first: str, rest: str = "") -> str:
        return "".join(self.one(p) for p in [first, *re.findall(rf"{LITERAL}|[A-Za-z_][\w.]*", rest or "", re.S)])

    def put(self, kind: str, m: re.Match, confidence: float, urn: str, dataset_type: str) -> None:
        self.facts.append(fact(kind, line_of(self.text, m.start()), confidence, "REGEX", urn, dataset_type, " ".join(m[0].split())))

    def each(self, pattern: str) -> list[re.Match]:
        return list(re.finditer(pattern, self.text, re.S))


CALL = re.compile(r"\s*\.\s*(\w+)\s*(?:\[[^\[\]]*\]\s*)?(\()?", re.S)
PIECE = re.compile(rf"{LITERAL}|[()\[\]{{}},]", re.S)


def arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose opening parenthesis is before `at`, and where it has ended."""
    depth, begin, out = 0, at, []
    for m in PIECE.finditer(text, at):
        c = m[0]
        if c in ("(", "[", "{"):
            depth += 1
        elif c in (")", "]", "}"):
            if not depth:
                return [*out, text[begin : m.start()].strip()] if out or text[begin : m.start()].strip() else [], m.end()
            depth -= 1
        elif c == "," and not depth:
            out.append(text[begin : m.start()].strip())
            begin = m.end()
    return [*out, text[begin:].strip()], len(text)


def chained(text: str, at: int) -> list[tuple[str, list[str], int]]:
    """The calls that follow one another from `at`, however long: name, arguments and end of each."""
    out = []
    while m := CALL.match(text, at):
        args, at = arguments(text, m.end()) if m[2] else ([], m.end())
        out.append((m[1], args, at))
    return out


def _spark(s: Source, confidence: float) -> None:
    def given(x: str | None) -> str | None:
        m = re.match(ARGUMENT, x or "", re.S)
        return s.fold(m[1], m[2]) if m else None

    for m in s.each(r"\.\s*(?:read|write)(?:Stream)?\b(?:\s*\(\s*\))?"):
        reading = "read" in m[0]
        ends = ("parquet", "csv", "json", "orc", "text", "avro", "jdbc", *(("load", "table") if reading else ("save", "start", "saveAsTable", "insertInto")))
        options, name = {}, ""
        for call, args, stop in chained(s.text, m.end()):
            if call == "option" and len(args) > 1:
                options.setdefault(given(args[0]) or "", given(args[1]) or "")
            elif call == "format" and args:
                name = name or given(args[0]) or ""
            elif call in ends:
                break
        else:
            continue
        way, first = "READ" if reading else "WRITE", given(args[0]) if args else None

        def put(confidence: float, urn: str, kind: str) -> None:
            s.facts.append(fact(way, line_of(s.text, m.start()), confidence, "REGEX", urn, kind, " ".join(s.text[m.start() : stop].split())))  # noqa: B023

        if call in ("table", "saveAsTable", "insertInto"):
            if first:
                put(confidence, hive(first), "hive")
        elif call == "jdbc":
            for t in _query_tables((given(args[1]) if len(args) > 1 else None) or ""):
                put(0.8, f"{first}#{t}", database(first or ""))
        elif name == "kafka":
            topic = options.get("topic") or (options.get("subscribe") if reading else None)
            put(0.85 if topic else 0.75, f"kafka://{topic or 'unknown_topic'}", "kafka")
        elif name == "jdbc":
            for t in _query_tables(options.get("dbtable") or (options.get("query") if reading else None) or ""):
                put(0.8, f"{options.get('url', 'jdbc')}#{t}", database(options.get("url", "")))
        elif first or options.get("path"):
            put(confidence, first or options["path"], {"delta": "delta", "sftp": "sftp"}.get(name, "hdfs"))
        if not reading and options.get("checkpointLocation"):
            put(0.85, options["checkpointLocation"], "hdfs")
    for m in s.each(rf"\.\s*(?:textFile|sequenceFile)\s*\(\s*{ARGUMENT}"):
        s.put("READ", m, confidence, s.fold(m[1], m[2]), "hdfs")
    for m in s.each(rf"\.\s*saveAsTextFile\s*\(\s*{ARGUMENT}"):
        s.put("WRITE", m, confidence, s.fold(m[1], m[2]), "hdfs")
    for m in s.each(rf"\b(?:spark|sqlContext|hiveContext|session|sparkSession)\s*\.\s*sql\s*\(\s*{ARGUMENT}"):
        s.facts += sql_facts(s.fold(m[1], m[2]), 0.8, "REGEX", line_of(s.text, m.start()))
    for m in s.each(rf"new\s+ProducerRecord\s*(?:[<\[][^>\])]*[>\]])?\s*\(\s*({LITERAL}|[\w.]+)"):
        topic = s.fold(m[1])
        s.put("WRITE", m, 0.75 if topic.startswith("{") else 0.85, f"kafka://{topic}", "kafka")
    for m in s.each(rf"\.\s*subscribe\s*\(\s*(?:[\w.]*(?:asList|singletonList|singleton|List|Seq)\s*\(\s*)?({LITERAL})"):
        s.put("READ", m, 0.85, f"kafka://{s.fold(m[1])}", "kafka")


def _query_tables(text: str) -> list[str]:
    if not text:
        return []
    if re.fullmatch(r"[\w.${}]+", text):
        return [text]
    return [f["dataset_urn"][7:] for f in sql_facts(text.strip().strip("()")) if f["fact_type"] == "READ"] or [text[:50]]


def scala(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    s = Source(content, as_of)
    _spark(s, 0.75)
    _wrappers(s)
    return s.facts


def _wrappers(s: Source) -> None:
    """Calls of the file's own one-expression helpers, with their arguments in place of the parameters."""
    for d in s.each(r"\bdef\s+(\w+)\s*\(([^)]*)\)[^={]*=\s*(\{[^}]*\}|[^\n]+)"):
        params = [(p.split(":")[0].strip(), p.partition("=")[2].strip()) for p in d[2].split(",") if ":" in p]
        if not params or not re.search(r"\b(read|write)", d[3]):
            continue
        for c in s.each(rf"(?<!def )\b{d[1]}\s*\(([^()]*)\)"):
            args = re.findall(rf"{LITERAL}|[\w.]+", c[1], re.S)
            if len(args) > len(params):
                continue
            body = d[3]
            for (name, default), a in zip(params, args + [""] * len(params)):
                value = a if a.startswith(('"', "s")) and '"' in a else f'"{s.one(a)}"' if a else default
                if value:
                    body = re.sub(rf"\b{name}\b", lambda _, v=value: v, body)
            inner = Source(body, None)
            inner.names = s.names
            inner.facts = []
            _spark(inner, 0.75)
            at = line_of(s.text, c.start())
            s.facts += [f | {"line_number": at, "confidence": min(0.8, f["confidence"])} for f in inner.facts]


def _path(s: Source, args: list[str]) -> str | None:
    """new Path(path) or new Path(parent, child)."""
    parts = [s.fold(m[1], m[2]) for x in args if (m := re.match(ARGUMENT, x, re.S))]
    return "/".join([parts[0].rstrip("/"), *(p.strip("/") for p in parts[1:])]) if len(parts) > 1 else parts[0] if parts else None


def java(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    s = Source(content, as_of)
    _spark(s, 0.8)
    held = {}  # Path variables; of one name the last before the call counts
    for m in s.each(r"\bPath\s+(\w+)\s*=\s*new\s+Path\s*\("):
        held.setdefault(m[1], []).append((m.start(), _path(s, arguments(s.text, m.end())[0])))

    def target(x: str, at: int) -> str | None:
        if m := re.match(r"new\s+Path\s*\(", x):
            return _path(s, arguments(x, m.end())[0])
        return next((p for k, p in reversed(held.get(x, [])) if k < at), None)

    verbs = {"copyToLocalFile": ("READ", ""), "moveToLocalFile": ("READ", ""), "copyFromLocalFile": ("", "WRITE"), "moveFromLocalFile": ("", "WRITE"), "rename": ("READ", "WRITE"), "open": ("READ",), "exists": ("READ",), "delete": ("READ",), "listStatus": ("READ",), "create": ("WRITE",), "append": ("WRITE",), "mkdirs": ("WRITE",), "addInputPath": ("", "READ"), "setInputPaths": ("", "READ"), "setOutputPath": ("", "WRITE")}
    for m in s.each(rf"\.\s*({'|'.join(verbs)})\s*\("):
        args, stop = arguments(s.text, m.end())
        own = [a for a in args if a not in ("true", "false")] if m[1].endswith("LocalFile") else args
        for kind, x in zip(verbs[m[1]], own):
            urn = target(x, m.start()) if kind else None
            if urn and not (m[1] == "exists" and any(f["dataset_urn"] == urn for f in s.facts)):
                s.facts.append(fact(kind, line_of(s.text, m.start()), 0.75, "REGEX", urn, "hdfs", " ".join(s.text[m.start() : stop].split())))
    for m in s.each(rf"String\.format\s*\(\s*((?:{LITERAL})(?:\s*\+\s*(?:{LITERAL}))*)\s*((?:,\s*[\w.\"/ -]+)*)\)"):
        args = [s.one(a) for a in re.findall(rf"{LITERAL}|[\w.]+", m[2], re.S)]
        text = s.fold('""', m[1])
        for a in args:
            text = text.replace("%s", a, 1)
        s.facts += sql_facts(text, 0.8, "REGEX", line_of(s.text, m.start()))
    for m in s.each(rf"\.\s*(?:execute|executeQuery|executeUpdate|prepareStatement)\s*\(\s*{ARGUMENT}"):
        s.facts += sql_facts(s.fold(m[1], m[2]), 0.8, "REGEX", line_of(s.text, m.start()))
    return s.facts
