"""Facts of PySpark programs, from their syntax tree.

Strings are folded as far as the program tells them: literals, f-strings, concatenation, names of the same file, and the
parameters of a function of the file that is called with known arguments. What isn't known becomes {name}.
"""

from __future__ import annotations

import ast
import datetime
from typing import Any

from weirlight.operators.extract.common import config, database, fact, hive
from weirlight.operators.extract.sql_code import sql_facts

FILES = set("parquet csv json orc text avro load save start textFile".split())
DEPTH = 4


class Reader(ast.NodeVisitor):
    def __init__(self, names: dict[str, str], functions: dict[str, ast.FunctionDef], as_of: str | None, depth: int = 0, line: int | None = None):
        self.names, self.functions, self.as_of, self.depth, self.line = dict(names), functions, as_of, depth, line
        self.facts: list[dict[str, Any]] = []
        self.forpath: dict[str, str] = {}
        self.attributes: dict[str, str] = {}

    # strings

    def fold(self, x: ast.AST | None) -> str | None:
        if isinstance(x, ast.Constant):
            return str(x.value) if isinstance(x.value, str | int | float) and not isinstance(x.value, bool) else None
        if isinstance(x, ast.JoinedStr):
            return "".join(p.value if isinstance(p, ast.Constant) else self.fold(p.value) or "{%s}" % ast.unparse(p.value) for p in x.values)
        if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Add):
            left, right = self.fold(x.left), self.fold(x.right)
            return None if left is None and right is None else (left or "{%s}" % ast.unparse(x.left)) + (right or "{%s}" % ast.unparse(x.right))
        if isinstance(x, ast.Name):
            return self.names.get(x.id, "{%s}" % x.id)
        if isinstance(x, ast.Attribute):
            own = isinstance(x.value, ast.Name) and x.value.id == "self"
            return (self.attributes.get(x.attr) or self.names.get(x.attr) if own else self.names.get(ast.unparse(x))) or "{%s}" % x.attr
        if isinstance(x, ast.Call):
            return self.known_call(x) or "{%s}" % ast.unparse(x.func)
        if isinstance(x, ast.Subscript):
            return "{%s}" % ast.unparse(x.value).rsplit(".", 1)[-1]
        if isinstance(x, ast.IfExp):
            return self.fold(x.orelse) if isinstance(x.orelse, ast.Constant) else None
        return None

    def known_call(self, x: ast.Call) -> str | None:
        name = ast.unparse(x.func)
        if name.endswith(("getenv", "environ.get")) and len(x.args) > 1:
            return self.fold(x.args[1])
        if name.endswith(".format") and isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Constant):
            try:
                return str(x.func.value.value).format(*[self.fold(a) for a in x.args], **{k.arg: self.fold(k.value) for k in x.keywords if k.arg})
            except (IndexError, KeyError, ValueError):
                return None
        if name.endswith("strftime") and self.as_of and x.args and isinstance(x.args[0], ast.Constant):
            return datetime.date.fromisoformat(self.as_of).strftime(str(x.args[0].value))
        if name.endswith("os.path.join") and x.args:
            return "/".join((self.fold(a) or "{?}").strip("/") if i else (self.fold(a) or "{?}").rstrip("/") for i, a in enumerate(x.args))
        return None

    def put(self, x: ast.AST, **k: Any) -> None:
        k["line"] = self.line or getattr(x, "lineno", 1)
        if self.line:
            k["confidence"] = min(k["confidence"], 0.8)
        self.facts.append(fact(method="AST", evidence=ast.unparse(x), **k))

    # assignments

    def bind(self, name: str, value: ast.AST, at: ast.AST) -> None:
        text = self.fold(value)
        if text is None or isinstance(value, ast.Call) and self.known_call(value) is None or isinstance(value, ast.Name | ast.Subscript | ast.Attribute):
            self.names.pop(name, None)
            return
        kind = 0.95 if isinstance(value, ast.Constant) else 0.8 if isinstance(value, ast.IfExp) else 0.9 if isinstance(value, ast.Call) and "strftime" in ast.unparse(value.func) else 0.85
        self.names[name] = text
        if not self.line:
            self.facts.append(config(name, text, at.lineno, kind, "AST"))

    def visit_Assign(self, x: ast.Assign) -> None:
        for t in x.targets:
            if isinstance(t, ast.Name):
                self.bind(t.id, x.value, x)
                if isinstance(x.value, ast.Call) and ast.unparse(x.value.func).endswith(("forPath", "forName")) and x.value.args:
                    self.forpath[t.id] = self.fold(x.value.args[-1]) or ""
            elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str):
                self.attributes[t.attr] = x.value.value
                self.facts.append(config(f"config.{t.attr}", x.value.value, x.lineno, 0.75, "AST"))
        self.generic_visit(x)

    def visit_FunctionDef(self, x: ast.FunctionDef) -> None:
        outer = dict(self.names)
        args = x.args.args
        for a in args:
            self.names.pop(a.arg, None)
        for a, v in zip(args[len(args) - len(x.args.defaults) :], x.args.defaults):
            if isinstance(v, ast.Constant) and isinstance(v.value, str):
                self.names[a.arg] = v.value
                if not self.line:
                    self.facts.append(config(a.arg, v.value, x.lineno, 0.8, "AST"))
        self.generic_visit(x)
        self.names = outer

    # calls

    def visit_Call(self, x: ast.Call) -> None:
        chain, options, formats, node = [], {}, None, x
        while isinstance(node, ast.Call | ast.Attribute):
            if isinstance(node, ast.Attribute):
                chain.append(node.attr)
            else:
                called = getattr(node.func, "attr", "")
                if called == "option" and len(node.args) > 1:
                    options.setdefault(self.fold(node.args[0]) or "", self.fold(node.args[1]))
                if called == "options":
                    options = {k.arg: self.fold(k.value) for k in node.keywords if k.arg} | options
                if called == "format" and node.args:
                    formats = formats or self.fold(node.args[0])
            node = node.func if isinstance(node, ast.Call) else node.value
        last = chain[0] if chain else (x.func.id if isinstance(x.func, ast.Name) else "")
        keywords = {k.arg: self.fold(k.value) for k in x.keywords if k.arg}
        first = self.fold(x.args[0]) if x.args else keywords.get("path")
        way = next((c for c in chain[1:] if c in ("read", "readStream", "write", "writeStream")), "")
        reading, writing = way.startswith("read"), way.startswith("write")
        streaming = bool({"readStream", "writeStream"} & set(chain))
        self.dispatch(x, chain, last, first, keywords, options, formats, reading, writing, streaming)
        name = last if (isinstance(x.func, ast.Name) or len(chain) == 1) else ""
        if name in self.functions and self.depth < DEPTH:
            self.follow(x, self.functions[name])
        self.generic_visit(x)

    def dispatch(self, x, chain, last, first, keywords, options, formats, reading, writing, streaming) -> None:
        params = {"streaming": True} if streaming else None
        if last in ("forPath", "forName"):
            target = self.fold(x.args[-1]) if x.args else None
            if target:
                self.put(x, kind="READ", confidence=0.9, urn=target if last == "forPath" else hive(target), dataset_type="delta")
        elif last == "merge" and x.args:
            base = x.func.value
            while isinstance(base, ast.Call | ast.Attribute):
                base = base.func if isinstance(base, ast.Call) else base.value
            target = self.forpath.get(base.id) if isinstance(base, ast.Name) else None
            if target:
                self.put(x, kind="WRITE", confidence=0.75, urn=target, dataset_type="delta")
        elif last == "jdbc" and (reading or writing):
            url, table = first or keywords.get("url"), (self.fold(x.args[1]) if len(x.args) > 1 else None) or keywords.get("table")
            if url and table:
                self.put(x, kind="READ" if reading else "WRITE", confidence=0.85, urn=f"{url}#{table}", dataset_type=database(url))
        elif (reading or writing) and formats == "jdbc" and last in ("load", "save"):
            table = options.get("dbtable") or options.get("query")
            if options.get("url") and table:
                for t in [table] if " " not in table else [r["dataset_urn"][7:] for r in sql_facts(table.strip("() ")) if r["fact_type"] == "READ"] or [table]:
                    self.put(x, kind="READ" if reading else "WRITE", confidence=0.85, urn=f"{options['url']}#{t}", dataset_type=database(options["url"] or ""))
        elif (reading or writing) and formats == "kafka" and last in ("load", "save", "start"):
            topic = (options.get("subscribe") or options.get("topics")) if reading else None
            topic = topic or options.get("topic")
            self.put(x, kind="READ" if reading else "WRITE", confidence=0.85 if topic else 0.75, urn=f"kafka://{topic or 'unknown_topic'}", dataset_type="kafka", params=params)
            self.checkpoint(x, options)
        elif reading and last in FILES:
            if first or options.get("path"):
                self.put(x, kind="READ", confidence=0.75, urn=first or options["path"], dataset_type="delta" if formats == "delta" else "hdfs", params=params)
            elif streaming:
                self.put(x, kind="READ", confidence=0.75, urn=f"stream:{formats or 'unknown'}", dataset_type="stream", params=params)
        elif writing and last in FILES:
            target = first or options.get("path")
            if target:
                self.put(x, kind="WRITE", confidence=0.75, urn=target, dataset_type="delta" if formats == "delta" else "hdfs", params=params, write_mode=keywords.get("mode") or self.mode(x))
            self.checkpoint(x, options)
        elif last in ("textFile", "sequenceFile", "wholeTextFiles") and first:
            self.put(x, kind="READ", confidence=0.75, urn=first, dataset_type="hdfs")
        elif last in ("saveAsTextFile", "saveAsSequenceFile") and first:
            self.put(x, kind="WRITE", confidence=0.75, urn=first, dataset_type="hdfs")
        elif last == "table" and first and isinstance(x.func, ast.Attribute):
            self.put(x, kind="READ", confidence=0.9, urn=hive(first), dataset_type="hive")
        elif last in ("saveAsTable", "insertInto") and first:
            self.put(x, kind="WRITE", confidence=0.9, urn=hive(first), dataset_type="hive", write_mode=keywords.get("mode") or self.mode(x))
        elif last == "sql" and first:
            for f in sql_facts(first, 0.8, "AST", self.line or x.lineno):
                self.facts.append(f | ({"line_number": self.line} if self.line else {}))

    def mode(self, x: ast.Call) -> str | None:
        node: ast.AST = x
        while isinstance(node, ast.Call | ast.Attribute):
            if isinstance(node, ast.Call) and node.args and getattr(node.func, "attr", "") == "mode":
                return self.fold(node.args[0])
            node = node.func if isinstance(node, ast.Call) else node.value
        return None

    def checkpoint(self, x: ast.Call, options: dict[str, str | None]) -> None:
        if options.get("checkpointLocation"):
            self.put(x, kind="WRITE", confidence=0.85, urn=options["checkpointLocation"], dataset_type="hdfs", params={"is_checkpoint": True})

    def follow(self, x: ast.Call, f: ast.FunctionDef) -> None:
        """The facts of a called function of this file, with the arguments of this call; they count at the call's line."""
        args = [a.arg for a in f.args.args]
        args = args[1:] if args[:1] == ["self"] else args
        if len(x.args) > len(args) or not (x.args or x.keywords):
            return
        names = self.names | {a.arg: v for a, d in zip(f.args.args[len(f.args.args) - len(f.args.defaults) :], f.args.defaults) if (v := self.fold(d)) is not None}
        names |= {a: v for a, e in zip(args, x.args) if (v := self.fold(e)) is not None} | {k.arg: v for k in x.keywords if k.arg and (v := self.fold(k.value)) is not None}
        inner = Reader(names, self.functions, self.as_of, self.depth + 1, self.line or x.lineno)
        inner.attributes = dict(self.attributes)
        for s in f.body:
            inner.visit(s)
        self.facts += [i for i in inner.facts if i["fact_type"] in ("READ", "WRITE")]


def extract(content: str, as_of: str | None = None) -> list[dict[str, Any]]:
    tree = ast.parse(content)
    functions = {n.name: n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)}
    reader = Reader({}, functions, as_of)
    reader.visit(tree)
    return reader.facts
