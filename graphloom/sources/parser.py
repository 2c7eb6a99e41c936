"""Source files to nodes and edges, as one distributed pass of Arrow batches.

Python files go through the standard library's syntax trees, without the lines that don't parse; JavaScript, TypeScript,
Go, Rust and Java through ``braces``. Other languages give their File node; a parser for one can be added with
``register_parser`` (path, text) -> iterable of records.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import braces

RECORD = "record string, kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, parent_name string, params string, return_type string, is_test boolean, file_hash string, source_qualified string, target_qualified string, line long"
_FIELDS = [x.split()[0] for x in RECORD.split(", ")]
_PARSERS: dict[str, Callable[[str, str], Iterable[dict]]] = {}


def register_parser(language: str, parse: Callable[[str, str], Iterable[dict]]) -> None:
    _PARSERS[language] = parse


def is_test(name: str, role: str) -> bool:
    if role == "function":
        return name.startswith(("test_", "Test")) or name.endswith(("_test", "_spec"))
    return name.startswith("Test") or name.endswith(("Test", "Tests", "TestCase", "Spec"))


def qualify(path: str, parent: str | None, name: str) -> str:
    return f"{path}::{parent}.{name}" if parent else f"{path}::{name}"


class _Python(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.path, self.text, self.out = path, text, []
        self.cls: str | None = None
        self.fn: str | None = None

    def _node(self, n, kind, test, params=None, returns=None):
        qn = qualify(self.path, self.cls, n.name) if kind != "Class" else qualify(self.path, None, n.name)
        parent = self.cls if kind != "Class" else None
        first = n.lineno
        self.out.append({"record": "node", "kind": kind, "name": n.name, "qualified_name": qn, "line_start": first, "line_end": n.end_lineno, "parent_name": parent, "params": params, "return_type": returns, "is_test": test})
        owner = f"{self.path}::{parent}" if parent else self.path
        self.out.append({"record": "edge", "kind": "CONTAINS", "source_qualified": owner, "target_qualified": qn, "line": 1 if not parent else n.lineno})
        return qn

    def visit_ClassDef(self, n):  # noqa: N802
        self._node(n, "Class", is_test(n.name, "class"))
        for d in n.decorator_list:
            self.visit(d)
        before, self.cls = self.cls, n.name
        for x in [*n.bases, *n.keywords, *n.body]:
            self.visit(x)
        self.cls = before

    def _function(self, n):
        test = is_test(n.name, "function")
        params = f"({ast.unparse(n.args)})"
        qn = self._node(n, "Test" if test else "Function", test, params, ast.unparse(n.returns) if n.returns else None)
        for d in n.decorator_list:
            self.visit(d)
        before, self.fn = self.fn, qn
        for x in [n.args, *n.body]:
            self.visit(x)
        self.fn = before

    visit_FunctionDef = visit_AsyncFunctionDef = _function  # noqa: N815

    def _import(self, target, line):
        self.out.append({"record": "edge", "kind": "IMPORTS_FROM", "source_qualified": self.path, "target_qualified": target, "line": line})

    def visit_Import(self, n):  # noqa: N802
        for a in n.names:
            self._import(a.name, n.lineno)

    def visit_ImportFrom(self, n):  # noqa: N802
        self._import("." * n.level + (n.module or ""), n.lineno)

    def visit_Call(self, n):  # noqa: N802
        f = n.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            self.out.append({"record": "edge", "kind": "CALLS", "source_qualified": self.fn or self.path, "target_qualified": name, "line": n.lineno})
        self.generic_visit(n)


def parse_python(path: str, text: str, most_faults: int = 100) -> list[dict]:
    """Records of what parses: up to ``most_faults`` faulty lines become empty statements."""
    lines, tree = text.replace("\0", " ").split("\n"), None
    for _ in range(most_faults):
        try:
            tree = ast.parse("\n".join(lines))
            break
        except SyntaxError as e:
            at = min(len(lines), e.lineno or 1) - 1
            bare = "expected an indented block" in (e.msg or "")
            while at > 0 and (not lines[at].strip() or bare and not lines[at].rstrip().endswith(":")):
                at -= 1
            kept = lines[at][: len(lines[at]) - len(lines[at].lstrip())]
            if bare and lines[at].rstrip().endswith(":"):
                lines[at] += " pass"
            else:
                lines[at] = "" if isinstance(e, IndentationError) or lines[at].strip() == "pass" else f"{kept}pass"
        except (ValueError, RecursionError, MemoryError):
            return []
    v = _Python(path, text)
    try:
        if tree is not None:
            v.visit(tree)
    except RecursionError:  # what was seen before the deep expression stays
        pass
    return v.out


register_parser("python", parse_python)
for _language in braces.LANGUAGES:
    register_parser(_language, braces.parser(_language, is_test, qualify))


def parse_text(path: str, text: str, language: str, file_hash: str = "") -> list[dict]:
    """All records of one file; the File node always comes first."""
    name = path.rsplit("/", 1)[-1]
    rows = [{"record": "node", "kind": "File", "name": name, "qualified_name": path, "line_start": 1, "line_end": text.count("\n") + 1, "is_test": False}]
    if language in _PARSERS:
        rows += list(_PARSERS[language](path, text))
    for r in rows:
        r.setdefault("file_path", path)
        r.setdefault("language", language)
        r.setdefault("file_hash", file_hash)
    return rows


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (path, language, content, file_hash) rows; each row has ``seq``, its order within its file."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, lang, content, sha in zip(pdf["path"], pdf["language"], pdf["content"], pdf["file_hash"], strict=True):
                for i, r in enumerate(parse_text(path, bytes(content).decode("utf-8", "replace"), lang, sha)):
                    rows.append([r.get(f) for f in _FIELDS] + [i])
            yield pd.DataFrame(rows, columns=[*_FIELDS, "seq"]).astype({"line_start": "Int64", "line_end": "Int64", "line": "Int64"})

    parsed = files.select("path", "language", "content", "file_hash").mapInPandas(run, RECORD + ", seq long")
    nodes = parsed.filter("record = 'node'").select("kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language", "parent_name", "params", "return_type", "is_test", "file_hash", "seq")
    edges = parsed.filter("record = 'edge'").select("kind", "source_qualified", "target_qualified", "file_path", F.coalesce("line", F.lit(0)).alias("line"), F.lit("{}").alias("extra"), "seq")
    return nodes, edges
