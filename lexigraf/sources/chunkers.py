"""Files to chunks: (symbol, kind, start_line, end_line, text), by suffix.

Python goes through ``ast``.  TypeScript, JavaScript and Go go through a scanner that
blanks strings and comments, follows brackets, and reads declarations at bracket depth 0
(members at depth 1), since no parser for them can be assumed.
"""

from __future__ import annotations

import ast
import posixpath
import re
from typing import NamedTuple

SUFFIXES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}
MOST_BYTES = 1_000_000


class Span(NamedTuple):
    symbol: str | None
    kind: str
    start_line: int
    end_line: int
    text: str


def language_of(path: str) -> str | None:
    return SUFFIXES.get(posixpath.splitext(path)[1].lower())


def eligible(path: str, content: bytes) -> bool:
    return language_of(path) is not None and len(content) <= MOST_BYTES and b"\0" not in content


def whole_file(text: str) -> list[Span]:
    return [Span(None, "file", 1, max(1, len(text.splitlines())), text)]


def python_spans(text: str) -> list[Span]:
    """Top-level functions and classes, from the first decorator on; the whole file if there are none or it can't be parsed."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return whole_file(text)
    lines, out = text.splitlines(keepends=True), []
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append(Span(node.name, kind, first, node.end_lineno, "".join(lines[first - 1 : node.end_lineno])))
    return out or whole_file(text)


_BLANKS = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def blanked(text: str) -> str:
    """The text with strings and comments as spaces, line ends kept."""
    return _BLANKS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _depths(code: str) -> list[int]:
    """Bracket depth before each character."""
    out, depth = [], 0
    for c in code:
        if c in ")]}":
            depth = max(0, depth - 1)
        out.append(depth)
        if c in "([{":
            depth += 1
    return out


def _closes(code: str, at: int, go: bool) -> int:
    """Where the declaration at ``at`` ends: after its outermost block, or at its line's end if brackets are closed there."""
    depth, seen_block = 0, False
    for i in range(at, len(code)):
        c = code[i]
        if c in "([{":
            depth += 1
            seen_block |= c == "{"
        elif c in ")]}":
            depth -= 1
            if depth == 0 and c == "}" and seen_block and not re.match(r"\s*(?:[;,.(\[]|=>|as\b)", code[i + 1 : i + 40].split("\n")[0] or "\n"):
                rest = code[i + 1 :].split("\n", 1)[0]
                if not rest.strip(" ;\t\r"):
                    return i + 1
        elif depth == 0 and (c == ";" or c == "\n" and not go and re.search(r"[\w)\]}\"'`]\s*$", code[at:i]) and not re.match(r"\s*[.?:&|{=+*/<-]", code[i + 1 :])):
            return i
        elif depth == 0 and go and c == "\n":
            return i
    return len(code)


_TS = re.compile(
    r"^[ \t]*(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:(?P<fn>(?:async\s+)?function\s*\*?)\s*(?P<fname>[\w$]+)?|(?P<cls>(?:abstract\s+)?class)\s+(?P<cname>[\w$]+)|"
    r"(?P<iface>interface)\s+(?P<iname>[\w$]+)|(?P<type>type)\s+(?P<tname>[\w$]+)|(?P<enum>(?:const\s+)?enum)\s+(?P<ename>[\w$]+)|(?P<var>const|let|var)\s+(?P<vname>[\w$]+))",
    re.M,
)
_MEMBER = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*[*#]?(?P<name>[\w$]+)\s*(?:<[^>]*>)?\s*(?P<what>\(|=|:)", re.M)
_GO = re.compile(r"^(?:func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<fname>\w+)|type\s+(?P<tname>\w+))", re.M)
_KINDS = (("fn", "fname", "function"), ("cls", "cname", "class"), ("iface", "iname", "interface"), ("type", "tname", "type"), ("enum", "ename", "enum"), ("var", "vname", "variable"))


def scanned_spans(text: str, go: bool) -> list[Span]:
    code = blanked(text)
    depth, lines, out, done = _depths(code), text.splitlines(keepends=True), [], 0
    line = lambda at: code.count("\n", 0, at) + 1
    body = lambda a, b: "".join(lines[a - 1 : b])
    for m in (_GO if go else _TS).finditer(code):
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        if begin < done or depth[begin]:
            continue
        end = _closes(code, begin, go)
        done = end
        first, last = line(begin), line(max(begin, end - 1))
        if first == last:
            continue
        if go:
            name = m["fname"] or m["tname"]
            kind = "type" if m["tname"] else "method" if m["recv"] else "function"
            out.append(Span(f"{m['recv']}.{name}" if m["recv"] else name, kind, first, last, body(first, last)))
            continue
        name, kind = next((m[n], k) for g, n, k in _KINDS if m[g])
        members = []
        if kind == "class":
            inner = depth[code.index("{", begin)] + 1 if "{" in code[begin:end] else -1
            at = begin
            for f in _MEMBER.finditer(code, code.find("{", begin) + 1, end) if inner > 0 else ():
                start = f.start() + len(f[0]) - len(f[0].lstrip())
                if start < at or depth[start] != inner or f["name"] in ("if", "for", "while", "switch", "return"):
                    continue
                at = _closes(code, start, False)
                a, b = line(start), line(max(start, at - 1))
                if b > a:
                    members.append((f["name"], a, b))
        if members:
            if members[0][1] - 1 >= first:
                out.append(Span(name, "class", first, members[0][1] - 1, body(first, members[0][1] - 1)))
            out += [Span(f"{name}.{n}", "method", a, b, body(a, b)) for n, a, b in members]
        else:
            out.append(Span(name, kind, first, last, body(first, last)))
    return out or whole_file(text)


def spans(path: str, text: str) -> list[Span]:
    language = language_of(path)
    return python_spans(text) if language == "python" else scanned_spans(text, language == "go")


def enclosing(found: list[Span], line: int) -> str | None:
    """The symbol of the shortest chunk that covers the line."""
    over = [s for s in found if s.symbol and s.start_line <= line <= s.end_line]
    return min(over, key=lambda s: s.end_line - s.start_line).symbol if over else None
