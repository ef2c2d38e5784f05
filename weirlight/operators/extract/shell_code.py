"""Facts of shell scripts and crontabs."""

from __future__ import annotations

import datetime
import re
import shlex
from typing import Any

from weirlight.operators.extract.common import config, fact, line_of
from weirlight.operators.extract.sql_code import sql_facts

ASSIGN = re.compile(r"^\s*(?:export\s+|readonly\s+|local\s+)?([A-Za-z_]\w*)=(\"[^\"]*\"|'[^']*'|\$\([^)]*\)|`[^`]*`|[^\s;#]*)")
DEFAULT = re.compile(r"\$\{(\w+):[-=]((?:[^{}$]|\$(?!\{)|\$\{\w+\})*)\}")
DATE = re.compile(r"(?:\$\(|`)\s*date\s*(?:(?:-d|--date)[= ]?\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?\s*\+?(?:\"\+?([^\"]*)\"|'\+?([^']*)'|([^\s)`]*))\s*(?:\)|`)")
FS = re.compile(r"\b(?:hdfs\s+dfs|hadoop\s+fs)\s+-(\w+)\s+([^|;&\n]*)")
CRON = re.compile(r"^\s*(@\w+|(?:[\d*/,\-]+\s+){4}[\d*/,\-A-Za-z]+)\s+(.+)$")
UNIT = {"day": 1, "week": 7, "month": 30, "year": 365}


def uncommented(text: str) -> str:
    """Text with comments blanked; a # inside quotes or a word is none."""
    out = []
    for line in text.split("\n"):
        quote, cut = "", len(line)
        for i, c in enumerate(line):
            if quote:
                quote = "" if c == quote and line[i - 1] != "\\" else quote
            elif c in "\"'":
                quote = c
            elif c == "#" and (i == 0 or line[i - 1].isspace() or line[i - 1] == ";"):
                cut = i
                break
        out.append(line[:cut])
    return "\n".join(out)


def logical_lines(text: str) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    number, part = 0, ""
    for i, line in enumerate(text.split("\n"), 1):
        number = number or i
        if line.rstrip().endswith("\\"):
            part += line.rstrip()[:-1] + " "
            continue
        out.append((number, part + line))
        number, part = 0, ""
    if part:
        out.append((number, part))
    return out


def dated(text: str, as_of: str | None) -> str:
    """date commands worked out for the day as_of; without it they become {date:format}."""

    def put(m: re.Match) -> str:
        when, form = (m[1] or m[2] or m[3] or "").lower(), (m[4] or m[5] or m[6] or "").lstrip("+") or "%Y-%m-%d"
        if as_of is None:
            return "{date:%s}" % form
        day = datetime.date.fromisoformat(as_of)
        if "yesterday" in when:
            day -= datetime.timedelta(1)
        elif "tomorrow" in when:
            day += datetime.timedelta(1)
        else:
            for sign, n, unit, ago in re.findall(r"([+-]?)\s*(\d+|\$\{?\w+\}?)?\s*(day|week|month|year)s?(\s+ago)?", when):
                if n.startswith("$"):
                    continue
                k = int(n or 30) * UNIT[unit]
                day += datetime.timedelta(-k if ago or sign == "-" else k)
        if form == "%s":
            return str(int(datetime.datetime(day.year, day.month, day.day, tzinfo=datetime.UTC).timestamp()))
        return day.strftime(form)

    return DATE.sub(put, text)


def defaulted(text: str) -> str:
    """Every ${x:-default} replaced, from the inside out; each replacement is shorter, so this ends."""
    while (new := DEFAULT.sub(lambda m: m[2], text)) != text:
        text = new
    return text


def words_of(text: str) -> list[str]:
    try:
        return shlex.split(text)
    except ValueError:
        return text.split()


def submitted(words: list[str]) -> dict[str, Any]:
    """Main application, class, configuration and arguments of spark-submit."""
    out: dict[str, Any] = {"configs": {}, "args": []}
    takes = {"--master", "--deploy-mode", "--class", "--name", "--jars", "--py-files", "--files", "--archives", "--packages", "--conf", "--properties-file", "--driver-memory", "--executor-memory", "--executor-cores", "--num-executors", "--queue", "--principal", "--keytab", "--driver-cores", "--driver-class-path", "--driver-java-options", "--repositories", "--exclude-packages", "--proxy-user", "--total-executor-cores"}
    i = 0
    while i < len(words):
        w = words[i]
        if "main" in out:
            if w in ("|", "&&", "||", ";", ">", ">>", "2>&1", "&") or w.startswith((">", "2>")):
                break
            out["args"].append(w)
        elif w.startswith("--"):
            key, _, value = w.partition("=")
            if not value and key in takes:
                i += 1
                value = words[i] if i < len(words) else ""
            if key == "--conf":
                k, _, v = value.partition("=")
                out["configs"][k] = v
            elif key == "--class":
                out["class"] = value
            else:
                out.setdefault("options", {})[key.lstrip("-")] = value
        elif re.search(r"\.(py|jar|R)$", w.strip("\"'")) or w.startswith("$"):
            out["main"] = w
        i += 1
    return out


def _remote(path: str) -> bool:
    return bool(re.match(r"^(?:[\w.$%{}-]+@)?[\w.$%{}-]+:.+", path)) or path.startswith("rsync://")


def _copies(line: int, text: str, out: list[dict[str, Any]]) -> None:
    for m in FS.finditer(text):
        verb, args = m[1], [w for w in words_of(m[2]) if not w.startswith("-") and not re.match(r"^[12]?>", w)]
        reads = args[:-1] if verb in ("get", "copyToLocal", "cp", "mv", "getmerge") and len(args) > 1 else args if verb in ("cat", "text", "get") else []
        writes = args[-1:] if verb in ("put", "copyFromLocal", "moveFromLocal", "cp", "mv", "appendToFile") and len(args) > 1 else []
        out += [fact("READ", line, 0.7, "REGEX", a, "hdfs", m[0]) for a in reads] + [fact("WRITE", line, 0.7, "REGEX", a, "hdfs", m[0]) for a in writes]
    for m in re.finditer(r"\bdistcp\s+([^|;&\n]*)", text):
        words, args = words_of(m[1]), []
        skip = False
        for w in words:
            if skip:
                skip = False
            elif w in ("-m", "-bandwidth", "-log", "-f", "-filters"):
                skip = True
            elif not w.startswith("-"):
                args.append(w)
        if len(args) > 1:
            out += [fact("READ", line, 0.75, "REGEX", a, "hdfs", m[0]) for a in args[:-1]] + [fact("WRITE", line, 0.75, "REGEX", args[-1], "hdfs", m[0])]
    for m in re.finditer(r"(?:^|[;&|]\s*|\s)(scp|rsync)\s+([^|;&\n]*)", text):
        args = [w for w in words_of(m[2]) if not w.startswith("-") and not re.fullmatch(r"\d+|ssh", w)]
        if len(args) > 1:
            for a in args[:-1]:
                if _remote(a):
                    out.append(fact("READ", line, 0.7, "REGEX", a, "sftp", m[0].strip()))
            if _remote(args[-1]):
                out.append(fact("WRITE", line, 0.7, "REGEX", args[-1], "sftp", m[0].strip()))


def _databases(text: str, out: list[dict[str, Any]]) -> None:
    named = lambda s, *flags: next((m[1] for f in flags if (m := re.search(rf"(?:^|\s){f}[= ]?\s*[\"']?([^\s\"']+)", s))), "unknown")
    for m in re.finditer(r"\bpsql\b([^;|\n]*?)(?:-c\s+)?[\"']?\\?copy\s*\(\s*(select.*?)\)\s*to\b", text, re.I | re.S):
        for f in sql_facts(m[2]):
            out.append(fact("READ", line_of(text, m.start()), 0.65, "REGEX", f"jdbc:postgresql://{named(m[1], '-h')}/{named(m[1], '-d')}#{f['dataset_urn'][7:]}", "postgres", m[0]))
    for m in re.finditer(r"\bmysqldump\b([^|;&>\n]*)", text):
        words = words_of(m[1])
        args = [w for i, w in enumerate(words) if not w.startswith("-") and not (i and words[i - 1] in ("-h", "-u", "-P", "--host", "--user", "--port"))]
        for t in args[1:]:
            out.append(fact("READ", line_of(text, m.start()), 0.7, "REGEX", f"jdbc:mysql://{named(m[1], '-h', '--host')}/{args[0]}#{t}", "mysql", m[0]))
    for m in re.finditer(r"\b(mysql|sqlplus)\b([^\n]*)<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n(.*?)\n\s*\3\b", text, re.S):
        kind = "mysql" if m[1] == "mysql" else "oracle"
        for f in sql_facts(m[4]):
            if f["fact_type"] in ("READ", "WRITE"):
                out.append(fact(f["fact_type"], line_of(text, m.start(4)) + f["line_number"] - 1, 0.65 if kind == "mysql" else 0.6, "REGEX", f"jdbc:{kind}://{named(m[2], '-h')}#{f['dataset_urn'][7:]}", kind, m[0]))
    for m in re.finditer(r"\bexpdp\b[^\n]*?\btables=([\w.,$]+)", text, re.I):
        out += [fact("READ", line_of(text, m.start()), 0.7, "REGEX", f"jdbc:oracle://unknown#{t}", "oracle", m[0]) for t in m[1].split(",") if t]
    for m in re.finditer(r"\b(s?ftp)\b([^\n]*)<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n(.*?)\n\s*\3\b", text, re.S):
        at = re.search(r"([\w.$%{}-]+@[\w.$%{}-]+|[\w.-]+\.[\w.-]+)", m[2])
        host, folder = at[1] if at else "unknown", ""
        for i, line in enumerate(m[4].split("\n")):
            w = words_of(line.strip())
            if not w:
                continue
            if w[0] == "cd" and len(w) > 1:
                folder = w[1] if w[1].startswith("/") or not folder else f"{folder}/{w[1]}"
            elif w[0] in ("get", "mget", "put", "mput", "reget") and len(w) > 1:
                own = w[2] if w[0] == "put" and len(w) > 2 else w[1]
                name = own if own.startswith("/") else f"{folder.rstrip('/')}/{own.rsplit('/', 1)[-1] if w[0] in ('put', 'mput') else own}"
                out.append(fact("WRITE" if "put" in w[0] else "READ", line_of(text, m.start(4)) + i, 0.65, "REGEX", f"{host}:{name}", m[1], line.strip()))


def _jobs(line: int, text: str, out: list[dict[str, Any]], spark: float = 0.85) -> None:
    for m in re.finditer(r"\bspark-submit\b(.*)", text):
        got = submitted(words_of(m[1]))
        if got.get("main") or got.get("class"):
            out.append(fact("JOB_DEPENDENCY", line, spark, "REGEX", None, None, m[0], got, dependency_job=got.get("main") or got.get("class"), dependency_type="spark-submit"))
    for m in re.finditer(r"\b(hive|beeline|spark-sql)\b[^|;&\n]*?\s-(e|f)\s+(\"[^\"]*\"|'[^']*'|\S+)", text, re.S):
        body, confidence = m[3].strip("\"'"), {("beeline", "e"): 0.75, ("hive", "e"): 0.75}.get((m[1], m[2]), 0.8)
        out.append(fact("JOB_DEPENDENCY", line, confidence, "REGEX", None, None, m[0], {"sql": body} if m[2] == "e" else None, dependency_job=body if m[2] == "f" else m[1], dependency_type=f"{m[1]} -{m[2]}"))
        if m[2] == "e":
            out += sql_facts(body, confidence, "SQL_PARSE", line)


def extract(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    out: list[dict[str, Any]] = []
    plain = dated(uncommented(content), as_of)
    for number, line in logical_lines(plain):
        cron = CRON.match(line)
        body = cron[2] if cron else line
        if not cron and (m := ASSIGN.match(line)):
            value = defaulted(m[2].strip("\"'"))
            out.append(config(m[1], value, number, 0.7 if re.search(r"\$|\{", value) else 0.85, "REGEX", "shell"))
        body = defaulted(body)
        _copies(number, body, out)
        before = len(out)
        _jobs(number, body, out, 0.75 if cron else 0.85)
        if cron and len(out) == before:
            runs = re.search(r"(\S+\.(?:sh|py))\b|\b(hive|hdfs|hadoop|sqoop|distcp)\b", body)
            if runs:
                out.append(fact("JOB_DEPENDENCY", number, 0.7, "REGEX", None, None, body, {"schedule": cron[1]}, dependency_job=runs[1] or runs[2], dependency_type="cron"))
    quoted = re.sub(r"\\\n", "  ", plain)
    _databases(defaulted(quoted), out)
    # statements over several lines in hive -e
    for m in re.finditer(r"\b(?:hive|beeline)\b[^|;&\n]*?\s-e\s+([\"'])((?:(?!\1).)*\n(?:(?!\1).)*)\1", plain, re.S):
        out.append(fact("JOB_DEPENDENCY", line_of(plain, m.start()), 0.75, "REGEX", None, None, m[0], None, dependency_job="hive", dependency_type="hive -e"))
        out += sql_facts(m[2], 0.75, "SQL_PARSE", line_of(plain, m.start(2)))
    return out


