"""A tolerant parser for languages whose blocks stand in braces: JavaScript, TypeScript, Go, Rust, Java.

Comments and strings are blanked out first, so lines and braces keep their places. Declarations are found by one pattern a
language; a body is what stands between its braces, so unfinished or faulty code loses at most what is unfinished.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

_NAME = r"[A-Za-z_$][\w$]*"
_BLANK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n]){2,}'", re.S)
_CALL = re.compile(rf"({_NAME})\s*(?:::\s*<[^<>()]*>\s*)?\(")
#: Words before a parenthesis that are no calls.
_NO_CALLS = frozenset("if for while switch catch return function func fn match await typeof new sizeof loop else do super this throw select defer go in of with synchronized try".split())
_SCRIPT = (
    rf"\b(?:class|interface)\s+(?P<type>{_NAME})|\bfunction\s*\*?\s*(?P<func>{_NAME})\s*(?=[(<])|\b(?:const|let|var)\s+(?P<arrow>{_NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)(?:\s*:[^=;\n{{]+)?|{_NAME})\s*=>"
    rf"|^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*\*?(?P<method>{_NAME})\s*(?:<[^<>()]*>)?(?=\([^()]*\)\s*(?::[^{{;=\n]+)?\{{)"
)
#: Declarations: ``type`` opens a class, the other groups name functions; ``owner`` is the type of a method outside it.
_DECLARATIONS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "tsx": _SCRIPT,
    "go": rf"\btype\s+(?P<type>{_NAME})\s+(?:struct|interface)\b|\bfunc\s+(?:\(\s*(?:{_NAME}\s+)?\*?\s*(?P<owner>{_NAME})[^()]*\)\s*)?(?P<func>{_NAME})\s*(?=[(\[])",
    "rust": rf"\b(?:struct|enum|trait|union)\s+(?P<type>{_NAME})|\bimpl(?:\s*<[^{{]*?>)?\s+(?:[^{{;]*?\bfor\s+)?(?P<block>{_NAME})[^{{;]*(?=\{{)|\bfn\s+(?P<func>{_NAME})\s*(?=[(<])",
    "java": rf"\b(?:class|interface|enum|record)\s+(?P<type>{_NAME})|(?:^|[;{{}}])\s*(?:@{_NAME}\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^<>]*>\s*)?(?P<returns>(?!return\b|new\b|else\b|throw\b){_NAME}(?:\.{_NAME})*(?:<[^()=;]*>)?(?:\[\])*)\s+(?P<func>{_NAME})\s*(?=\([^()]*\)\s*(?:throws[^{{;]+)?[{{;])",
}
_IMPORTS = {
    **dict.fromkeys(("javascript", "typescript", "tsx"), r"^[ \t]*(?:import|export)\b[^'\"\n;]*['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]"),
    "go": r"^[ \t]*import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"|^[ \t]+(?:[\w.]+\s+)?\"([^\"\n]+)\"[ \t]*$",
    "rust": r"^[ \t]*(?:pub\s+)?use\s+([^;]+);",
    "java": r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;",
}


def _blanked(text: str) -> str:
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closers(code: str) -> dict[int, int]:
    """Place of the closing bracket of each opening one; the end of the text if there is none."""
    out, stack = {}, []
    for m in re.finditer(r"[(){}]", code):
        if m[0] in "({":
            stack.append(m.start())
        else:
            want = "(" if m[0] == ")" else "{"
            while stack and code[stack[-1]] != want:
                out[stack.pop()] = m.start()
            if stack:
                out[stack.pop()] = m.start()
    return out | {i: len(code) for i in stack}


def parser(language: str, is_test: Callable[[str, str], bool], qualify: Callable[[str, str | None, str], str]):
    """(path, text) -> records, for one language of this module."""
    declared, imported = re.compile(_DECLARATIONS[language], re.M), re.compile(_IMPORTS[language], re.M)

    def parse(path: str, text: str) -> list[dict]:
        code = _blanked(text)
        closer, lines = _closers(code), [0, *(m.end() for m in re.finditer("\n", code))]
        line = lambda at: bisect.bisect_right(lines, at)
        out, scopes, names = [], [], set()  # scopes: (start, end, kind, name or qualified name)
        for m in imported.finditer(text):
            if code[m.start() : m.end()].strip():  # not in a comment
                out.append({"record": "edge", "kind": "IMPORTS_FROM", "source_qualified": path, "target_qualified": " ".join(next(x for x in m.groups() if x).split()), "line": line(m.start() + len(m[0]) - len(m[0].lstrip()))})
        for m in declared.finditer(code):
            found = m.groupdict()
            kind = next(k for k in ("type", "block", "func", "arrow", "method") if found.get(k))
            name, at = found[kind], m.start(kind)
            if name in _NO_CALLS:
                continue
            stop = re.compile(r"[{;]" if kind != "func" or language != "go" else r"[{\n]")
            head = closer.get(m.end(), m.end()) if code[m.end() : m.end() + 1] == "(" else m.end()
            opened = stop.search(code, head)
            body = opened.start() if opened and opened[0] == "{" else None
            end = closer.get(body, len(code)) if body is not None else (opened.start() if opened else m.end())
            if kind == "block":
                scopes.append((body if body is not None else m.end(), end, "type", name))
                continue
            around = [s for s in scopes if s[0] <= at < s[1]]
            parent = found.get("owner") or next((s[3] for s in reversed(around) if s[2] == "type"), None) if kind != "type" else None
            role = "class" if kind == "type" else "function"
            qn, test = qualify(path, parent, name), is_test(name, role)
            params = code[m.end() : head + 1].strip() if head > m.end() else None
            returns = found.get("returns") or (code[head + 1 : body].strip(" \t:->") or None if body is not None and kind in ("func", "method") and head > m.end() else None)
            row = {"record": "node", "kind": "Class" if kind == "type" else "Test" if test else "Function", "name": name, "qualified_name": qn, "line_start": line(at), "line_end": line(min(end, len(code) - 1)), "parent_name": parent, "params": params, "return_type": returns, "is_test": test}
            out.append(row)
            names.add(at)
            out.append({"record": "edge", "kind": "CONTAINS", "source_qualified": f"{path}::{parent}" if parent else path, "target_qualified": qn, "line": row["line_start"] if parent else 1})
            scopes.append((body if body is not None else m.end(), end, "type", name) if kind == "type" else (m.end(), end, "func", qn))
        functions = sorted(s for s in scopes if s[2] == "func")
        open_: list[tuple] = []
        for m in _CALL.finditer(code):
            while functions and functions[0][0] <= m.start():
                open_.append(functions.pop(0))
            open_ = [s for s in open_ if m.start() < s[1]]
            if m[1] not in _NO_CALLS and m.start() not in names:
                out.append({"record": "edge", "kind": "CALLS", "source_qualified": open_[-1][3] if open_ else path, "target_qualified": m[1], "line": line(m.start())})
        return out

    return parse


LANGUAGES = tuple(_DECLARATIONS)
