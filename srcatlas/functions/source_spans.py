"""Line spans of definitions in one source text, in time linear in its size.

Literals and comments are blanked first, over as many lines as they take; brackets are then paired in one pass, and a
header's body is found by stepping over pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

Span = tuple[str, str | None, int, int]

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
_PAIRS = {")": "(", "]": "[", "}": "{"}

# Literals and comments.  An unclosed one reaches to the end of its line, or of the text if it may span lines.
_ONE_LINE = r'"(?:\\.|[^"\\\n])*+(?:"|$)|\'(?:\\.|[^\'\\\n])*+(?:\'|$)'
_PY_LITERAL = re.compile(r'"""(?:\\.|(?!""")[^\\])*+(?:"""|\Z)|\'\'\'(?:\\.|(?!\'\'\')[^\\])*+(?:\'\'\'|\Z)|' + _ONE_LINE + r"|\#[^\n]*", re.S | re.M)
_BLOCK_COMMENT = r"/\*(?:(?!\*/).)*+(?:\*/|\Z)|//[^\n]*"
_GO_LITERAL = re.compile(_BLOCK_COMMENT + r"|`[^`]*+(?:`|\Z)|" + _ONE_LINE, re.S | re.M)
_JS_REGEX = r"(?P<before>[=(,:;!&|?\[{}][ \t]*|\breturn[ \t]+)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/"
_JS_LITERAL = re.compile(_BLOCK_COMMENT + r"|`(?:\\.|[^`\\])*+(?:`|\Z)|" + _ONE_LINE + "|" + _JS_REGEX, re.S | re.M)

_PY_HEAD = re.compile(r"[ \t]*(?:(?:async[ \t]+)?(def)|(class))[ \t]+(\w+)")
_GO_FUNC = re.compile(r"^func[ \t]+(\w+)", re.M)
_GO_METHOD = re.compile(r"^func[ \t]*\(", re.M)
_GO_STRUCT = re.compile(r"^[ \t]*type[ \t]+(\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*struct\b", re.M)
_GO_GROUP = re.compile(r"^type[ \t]*\([ \t]*$", re.M)
_GO_GROUPED = re.compile(r"^[ \t]+(\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]+struct\b", re.M)
_JS_EXPORT = r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?"
_JS_FUNC = re.compile(rf"{_JS_EXPORT}(?:async[ \t]+)?function[ \t]+({_NAME})", re.M)
_JS_CLASS = re.compile(rf"{_JS_EXPORT}(?:abstract[ \t]+)?class[ \t]+({_NAME})", re.M)
_JS_VAR = re.compile(rf"^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+({_NAME})[ \t]*(?::[^=\n]*)?=[ \t]*(?:async\b[ \t]*)?(?:(function\b)|(\()|{_NAME}[ \t]*(=>))", re.M)
_JS_METHOD = re.compile(
    r"^[ \t]*(?:(?:public|private|protected|override|static)[ \t]+)*(?:async\b[ \t]*)?(?:(?:get|set)[ \t]+)?(?:\*[ \t]*)?"
    rf"(?!(?:if|for|while|switch|catch|function|return|with)\b)({_NAME})[ \t]*(?:<[^<>()\n]*>)?[ \t]*\(",
    re.M,
)
_JS_FUNC_EXPR = re.compile(rf"\bfunction\b\s*(?:{_NAME}\s*)?\(")
_ARROW = re.compile(r"=>")
_STOP = re.compile(r"[(\[{)\]},;\n]")
_TYPE_BRACE = re.compile(r"(?:interface|struct)[ \t]*\Z")


def _blank(text: str, literal: re.Pattern, filler: str = " ") -> str:
    def fill(m: re.Match) -> str:
        kept = m.groupdict().get("before") or ""
        return kept + re.sub(r"[^\n]", filler if m[0][0] not in "#" else " ", m[0][len(kept) :])

    return literal.sub(fill, text)


class _Source:
    """A text without literals and comments, its line starts and paired brackets."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.at, self.outer, self.close, self.open = [], [], {}, {}
        held: list[int] = []
        counts = dict.fromkeys("([{", 0)
        for m in re.finditer(r"[()\[\]{}]", text):
            c, p = m[0], m.start()
            if c in counts:
                self.at.append(p)
                held.append(p)
                self.outer.append(p)
                counts[c] += 1
            elif counts[_PAIRS[c]]:
                while text[held[-1]] != _PAIRS[c]:
                    counts[text[held.pop()]] -= 1
                self.close[held[-1]], self.open[p] = p, held[-1]
                counts[text[held.pop()]] -= 1
                self.at.append(p)
                self.outer.append(held[-1] if held else -1)

    def line(self, p: int) -> int:
        return bisect_right(self.lines, p)

    def enclosing(self, p: int) -> int:
        """The open bracket around a position, -1 if none."""
        i = bisect_left(self.at, p) - 1
        return self.outer[i] if i >= 0 else -1

    def after(self, p: int) -> int:
        """The position after the bracket that closes the one at ``p``; the end of the text if none does."""
        return self.close.get(p, len(self.text)) + 1

    def next_char(self, p: int) -> int:
        while p < len(self.text) and self.text[p].isspace():
            p += 1
        return p

    def end_line(self, brace: int) -> int:
        return self.line(min(self.close.get(brace, len(self.text)), len(self.text)))

    def body(self, p: int, type_braces: bool) -> int:
        """The brace that opens the body of a header whose name ends at ``p``; -1 if there is none.

        With ``type_braces`` (Go) the signature ends with its line, and ``interface{}`` is a type; otherwise a pair of
        braces right before another brace is one.
        """
        while m := _STOP.search(self.text, p):
            c, p = m[0], m.start()
            if c == "{":
                after = self.after(p)
                if type_braces:
                    is_type = bool(_TYPE_BRACE.search(self.text, max(0, p - 40), p))
                else:
                    n = self.next_char(after)
                    is_type = n < len(self.text) and self.text[n] == "{"
                if not is_type:
                    return p
                p = after
            elif c in "([":
                p = self.after(p)
            elif c == "," or (c == "\n" and not type_braces):
                p += 1
            else:
                return -1
        return -1

    def expression_end(self, p: int) -> int:
        """The line on which an expression that begins at ``p`` ends."""
        p = self.next_char(p)
        while m := _STOP.search(self.text, p):
            if m[0] not in "([{":
                return self.line(max(p, m.start() - 1) if m[0] == "\n" else m.start())
            p = self.after(m.start())
        return self.line(len(self.text))


def _python(text: str) -> list[Span]:
    """A definition ends before the next line that is not indented deeper; lines that continue another do not count."""
    source = _Source(_blank(text, _PY_LITERAL, '"'))
    inside = {m.start() + n.end() for m in _PY_LITERAL.finditer(text) if "\n" in m[0] for n in re.finditer("\n", m[0])}
    held: list[tuple[str, str, int, int]] = []
    out: list[Span] = []
    last = 0
    for number, start in enumerate(source.lines, 1):
        end = source.lines[number] - 1 if number < len(source.lines) else len(text)
        line = source.text[start:end]
        if not line.strip():
            continue
        head = _PY_HEAD.match(line)
        if start not in inside and (head or source.enclosing(start) < 0):
            indent = len(line[: len(line) - len(line.lstrip(" \t"))].replace("\t", " " * 8))
            while held and held[-1][3] >= indent:
                kind, name, first, _ = held.pop()
                out.append((kind, name, first, last))
            if head:
                held.append(("function" if head[1] else "class", head[3], number, indent))
        last = number
    return out + [(kind, name, first, last) for kind, name, first, _ in held]


def _go(text: str) -> list[Span]:
    source = _Source(_blank(text, _GO_LITERAL))
    heads = [("function", m[1], m.start(), m.end()) for m in _GO_FUNC.finditer(source.text)]
    for m in _GO_METHOD.finditer(source.text):
        name = re.compile(r"[ \t]*(\w+)").match(source.text, source.after(m.end() - 1))
        if name:
            heads.append(("function", name[1], m.start(), name.end()))
    heads += [("class", m[1], m.start(1), m.end()) for m in _GO_STRUCT.finditer(source.text)]
    groups = {m.end() - 1 - len(m[0]) + len(m[0].rstrip()) for m in _GO_GROUP.finditer(source.text)}
    if groups:
        found = (m for m in _GO_GROUPED.finditer(source.text) if source.enclosing(m.start(1)) in groups)
        heads += [("class", m[1], m.start(1), m.end()) for m in found if not _GO_STRUCT.match(source.text, m.start())]
    out = []
    for kind, name, start, end in heads:
        brace = source.next_char(end) if kind == "class" else source.body(end, True)
        first = source.line(start)
        has_body = 0 <= brace < len(text) and source.text[brace] == "{"
        out.append((kind, name, first, source.end_line(brace) if has_body else first))
    return out


def _javascript(text: str) -> list[Span]:
    source = _Source(_blank(text, _JS_LITERAL))
    code, out = source.text, []

    def add(kind: str, name: str | None, start: int, brace: int) -> None:
        first = source.line(start)
        out.append((kind, name, first, source.end_line(brace) if brace >= 0 else first))

    def arrow_end(p: int) -> int:
        n = source.next_char(p)
        return source.end_line(n) if n < len(code) and code[n] == "{" else source.expression_end(p)

    declared = set()
    for kind, pattern in (("function", _JS_FUNC), ("class", _JS_CLASS)):
        for m in pattern.finditer(code):
            declared.add(source.line(m.start(1)))
            add(kind, m[1], m.start(1), source.body(m.end(), False))
    unnamed: dict[int, int] = {}
    expressions = set()
    for m in _JS_FUNC_EXPR.finditer(code):
        first = source.line(m.start())
        if first not in declared:
            expressions.add(first)
            brace = source.body(m.end() - 1, False)
            unnamed[first] = max(unnamed.get(first, first), source.end_line(brace) if brace >= 0 else first)
    ends = {}
    for m in _ARROW.finditer(code):
        p = m.start() - 1
        while p >= 0 and code[p].isspace():
            p -= 1
        start = source.open.get(p, p) if p >= 0 else m.start()
        ends[m.start()] = end = arrow_end(m.end())
        first = source.line(max(start, 0))
        unnamed[first] = max(unnamed.get(first, first), end)
    out += [("function", None, first, end) for first, end in unnamed.items()]
    for m in _JS_METHOD.finditer(code):
        first = source.line(m.start(1))
        if first in declared or first in expressions:
            continue
        n = source.next_char(source.after(m.end() - 1))
        if n < len(code) and code[n] in "{:":
            brace = source.body(n, False)
            if brace >= 0 and (code[n] == "{" or ";" not in code[n:brace]):
                add("function", m[1], m.start(1), brace)
    for m in _JS_VAR.finditer(code):
        if m[2]:
            add("function", m[1], m.start(1), source.body(m.end(), False))
            continue
        at = m.start(4) if m[4] else _ARROW.search(code, source.after(m.start(3)) if m[3] else m.end())
        if at is None:
            continue
        arrow = at if m[4] else at.start()
        between = "" if m[4] else code[source.after(m.start(3)) : arrow]
        if arrow in ends and re.fullmatch(r"\s*(?::[^;{}]*)?", between):
            out.append(("function", m[1], source.line(m.start(1)), ends[arrow]))
    return out


_BY_EXTENSION = {".py": _python, ".go": _go, ".js": _javascript, ".ts": _javascript, ".jsx": _javascript, ".tsx": _javascript}
EXTENSIONS = tuple(_BY_EXTENSION)


def definition_spans(extension: str, text: str) -> list[Span]:
    """(kind, name, first line, last line) of the definitions in a text; none for other extensions."""
    find = _BY_EXTENSION.get(extension.lower())
    return find(text) if find else []
