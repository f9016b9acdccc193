"""Functions of JavaScript and TypeScript files, from one pass over each file's tokens.

A file's tokens are cut once (strings, templates, regular expressions and comments as wholes) and brackets are paired;
functions and branching statements are then spans of tokens, and a sweep gives each its innermost function. A file is at
most 1 MiB; Spark spreads the files, a task takes an Arrow batch at a time.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import spread

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')|(?P<i>#?[^\W\d][\w$]*|\$[\w$]*)|(?P<n>\d[\w.]*)"
    r"|(?P<p>=>|\.\.\.|\?\.(?!\d)|(?:&&|\|\||\?\?)=?|[=!]==?|<=|\+\+|--|[-+*%&|^]=|.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(?:`|\$\{|\Z)", re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}
#: Words after which an expression begins.
_BEFORE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof", "default", "extends", "as"}
_GOES_ON = {*"= ( [ { . ?. , ? : => * / % + - & | ^ < > = == === != !== <= && || ?? &&= ||= ??= += -= *= %= &= |= ^=".split(), "in", "instanceof", "of", "as"}
_LOGICAL = {"&&", "||", "??"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "function", "return", "await", "typeof", "new", "super", "import"}
_MODIFIERS = {"async", "get", "set", "static", "public", "private", "protected", "readonly", "override", "abstract", "accessor", "*"}
#: What may stand before the parameters of an arrow function.
_ARROW = {None, *"= ( [ , : ? => { } ; ... &&= ||= ??= ${".split(), "return", "default", "yield", "async"}


class _Source:
    def __init__(self, text: str):
        self.t: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        self.last: list[int] = []
        self._cut(text)
        self._pair()
        self.ends: dict[int, int] = {}
        self.arrows: dict[int, int] = {}  # last tokens of arrow functions by their first
        self.of_do: set[int] = set()

    def _cut(self, text: str) -> None:
        at, line, n, braces = 0, 1, len(text), []

        def put(end: int, kind: str, name: str | None = None) -> None:
            nonlocal at, line
            body = text[at:end]
            self.t.append(body if name is None else name)
            self.kind.append(kind)
            self.line.append(line)
            line += body.count("\n")
            self.last.append(line)
            at = end

        while at < n:
            c = text[at]
            if c == "`" or (c == "}" and braces and braces[-1] == "${"):
                if c == "}":
                    braces.pop()
                    put(at + 1, "p")
                    end = _TEMPLATE.match(text, at).end()
                else:
                    end = _TEMPLATE.match(text, at + 1).end()
                opens = text[end - 2 : end] == "${"
                if end - 2 * opens > at:
                    put(end - 2 * opens, "s", "`")
                if opens:
                    braces.append("${")
                    put(end, "p")
                continue
            if c == "/" and (m := _REGEX.match(text, at)):
                before = self.t[-1] if self.t else None
                if before is None or (self.kind[-1] == "p" and before not in (")", "]", "}", "<", "++", "--")) or (self.kind[-1] == "i" and before in _BEFORE):
                    put(m.end(), "s", "/")
                    continue
            m = _TOKEN.match(text, at)
            if m["skip"] is not None:
                line += m[0].count("\n")
                at = m.end()
                continue
            if c == "{":
                braces.append("{")
            elif c == "}" and braces:
                braces.pop()
            if m.lastgroup == "s":
                put(m.end(), m.lastgroup)
                continue
            # no newline in it
            self.t.append(m[0])
            self.kind.append(m.lastgroup)
            self.line.append(line)
            self.last.append(line)
            at = m.end()

    def _pair(self) -> None:
        n = len(self.t)
        self.mate, self.inside = [-1] * n, [-1] * n  # the other bracket; the bracket around
        stack: list[int] = []
        held = {")": 0, "]": 0, "}": 0}
        for i, t in enumerate(self.t):
            if self.kind[i] == "p" and t in _CLOSE and held[t]:
                while True:
                    o = stack.pop()
                    held[_OPEN[self.t[o]]] -= 1
                    if _OPEN[self.t[o]] == t:
                        break
                self.mate[o], self.mate[i] = i, o
            self.inside[i] = stack[-1] if stack else -1
            if self.kind[i] == "p" and t in _OPEN:
                stack.append(i)
                held[_OPEN[t]] += 1

    def at(self, i: int) -> str | None:
        """A token; None outside the file, and strings never look like words."""
        return (self.t[i] if self.kind[i] != "s" else "'") if 0 <= i < len(self.t) else None

    def over(self, i: int) -> int:
        """The token after a token, or after its bracket's partner."""
        return (self.mate[i] if self.mate[i] > i else i) + 1

    def expression(self, i: int, comma: bool) -> int:
        """The last token of an expression; with ``comma``, one that ends before a comma or the colon of a ternary around it."""
        j, asked = i, 0
        while j < len(self.t):
            t = self.at(j)
            if t in _CLOSE or t == ";" or (comma and (t == "," or t == ":" and not asked)):
                return max(j - 1, i - 1)
            asked += (t == "?") - (t == ":")
            if j > i and self.line[j] > self.last[j - 1]:
                p = self.at(j - 1)
                ended = self.kind[j - 1] in "sin" and p not in _BEFORE or p in _CLOSE or p in ("++", "--") or p == "return"
                if ended and not (t in _GOES_ON or t == "`"):
                    return j - 1
            j = self.arrows[j] + 1 if j in self.arrows else self.over(j)
        return len(self.t) - 1

    def statement(self, i: int) -> int:
        """The last token of the statement that begins at a token."""
        if i not in self.ends:
            self.ends[i] = self._statement(i)
        return self.ends[i]

    def _statement(self, i: int) -> int:
        t = self.at(i)
        if t is None:
            return len(self.t) - 1
        if t == "{":
            return self.over(i) - 1
        if t in ("if", "for", "while", "with"):
            head = i + 1 + (self.at(i + 1) == "await")
            end = self.statement(self.over(head))
            if t == "if":
                e = end + 1 + (self.at(end + 1) == ";" and self.at(end + 2) == "else")
                if self.at(e) == "else":
                    end = self.statement(e + 1)
            return end
        if t == "do":
            end = self.statement(i + 1)
            w = end + 1 + (self.at(end + 1) == ";")
            if self.at(w) == "while":
                self.of_do.add(w)
                return self.over(w + 1) - 1
            return end
        if t == "switch":
            return self.over(self.over(i + 1)) - 1
        if t == "try":
            end = self.over(i + 1) - 1
            if self.at(end + 1) == "catch":
                b = end + 2
                end = self.over(self.over(b) if self.at(b) == "(" else b) - 1
            if self.at(end + 1) == "finally":
                end = self.over(end + 2) - 1
            return end
        return self.expression(i, False)

    def body(self, close: int) -> int:
        """Where, after the parameters and a type, the brace of a body or the arrow stands; -1 without either."""
        j = close + 1
        if self.at(j) in ("{", "=>"):
            return j
        if self.at(j) != ":":
            return -1
        j, operand = j + 1, True  # whether a type is to come
        angles = 0
        while (t := self.at(j)) is not None:
            if t == "{" and not operand and not angles:
                return j
            if t == "=>" and not angles:
                if self.at(j - 1) == ")" and self.mate[j - 1] > close and self.at(self.mate[j - 1] - 1) in (":", "|", "&", "=>"):
                    k = j + 1  # a function type, unless what follows is the body
                    if self.at(k) != "{" and self.body_after_type(k) >= 0:
                        j, operand = k, True
                        continue
                return j
            if t == "<":
                angles += 1
            elif t == ">":
                angles -= 1
            elif not angles and (t in (";", ",", "=", "?") or t in _CLOSE):
                return -1
            operand = t in ("|", "&", "<", ",", "is", "keyof", "typeof", "readonly", "asserts", "extends") or (t == "=>" and angles > 0)
            j = self.over(j)
        return -1

    def body_after_type(self, j: int) -> int:
        """The arrow that follows a type without brackets of its own; -1 without one."""
        while self.kind[j : j + 1] == ["i"] or self.at(j) in (".", "|", "[", "]", "<", ">"):
            j += 1
        return j if self.at(j) == "=>" else -1

    def path(self, i: int) -> tuple[str, int]:
        """The dotted name that ends at a token, and where it begins."""
        parts = [self.t[i]]
        while self.at(i - 1) in (".", "?.") and i > 1:
            i -= 2
            while self.at(i) == "]" and self.mate[i] > 0:
                parts.append("[...]")
                i = self.mate[i] - 1
            if self.kind[i] != "i":
                parts.append("(expr)")
                break
            parts.append(self.t[i])
        return ".".join(reversed(parts)), i

    def params(self, o: int) -> int:
        found, any_here, angles, typed, j = 0, False, 0, False, o + 1
        while j < self.mate[o]:
            t = self.at(j)
            if t == "," and not angles:
                found, any_here, typed = found + any_here, False, False
            else:
                any_here = True
                typed = (typed or t == ":") and not (t == "=" and not angles)
                angles = max(0, angles + (typed and t == "<") - (typed and t == ">"))
            j = self.over(j)
        return found + any_here


def _measure(s: _Source) -> list[tuple]:
    """name, line, end_line, params, complexity and nesting of every closed function with a body."""
    n, at = len(s.t), s.at
    places: dict[str, list[int]] = {}  # of words that are no properties
    for i, kind in enumerate(s.kind):
        if kind == "i" and at(i - 1) not in (".", "?."):
            places.setdefault(s.t[i], []).append(i)
    words = lambda *w: sorted(i for x in w for i in places.get(x, ()))

    # parts that only declare types
    skip = bytearray(n)
    for i in words("type", "interface"):
        if i + 1 < n and s.kind[i + 1] == "i" and at(i - 1) in (None, ";", "{", "}", ")", "export", "declare") or i + 1 < n and s.kind[i + 1] == "i" and s.line[i] > s.last[i - 1]:
            j = i + 2
            if s.t[i] == "interface":
                while j < n and at(j) not in ("{", ";"):
                    j += 1
                end = s.over(j) - 1
            else:
                while j < n and at(j) not in ("=", ";"):
                    j += 1
                if at(j) != "=":
                    continue
                end = s.expression(j + 1, False)
            skip[i : end + 1] = b"\1" * (min(end, n - 1) + 1 - i)
    # a question mark with its colon
    colons, ternary = set(), set()
    waiting: dict[int, list[int]] = {}
    for i in range(n):
        if skip[i] or s.kind[i] != "p":
            continue
        t = s.t[i]
        if t == "?" and at(i + 1) not in (":", ")", ",", "=", ";", "]", "}", None):
            waiting.setdefault(s.inside[i], []).append(i)
        elif t == ":" and waiting.get(s.inside[i]):
            ternary.add(waiting[s.inside[i]].pop())
            colons.add(i)
        elif t == ";":
            waiting.pop(s.inside[i], None)
    # what braces hold
    classes: dict[int, str | None] = {}
    for i in words("class"):
        if at(i + 1) in (":", "=", ",", ")", None):
            continue
        j, angles = i + 1, 0
        while j < n and (at(j) != "{" or angles > 0) and at(j) != ";":
            angles += (at(j) == "<") - (at(j) == ">")
            j = s.over(j)
        if j < n and at(j) == "{":
            named = s.kind[i + 1] == "i" and at(i + 1) not in ("extends", "implements")
            classes[j] = s.t[i + 1] if named else None
    kinds: dict[int, str] = {}

    def value(colon: int) -> bool:
        """Whether a value, not a type, follows a colon."""
        return colon in colons or kinds.get(s.inside[colon]) in ("object", "switch")

    for i in range(n):
        if s.t[i] == "{" and s.kind[i] == "p":
            p = at(i - 1)
            if i in classes:
                kinds[i] = "class"
            elif p == ")" and at(s.mate[i - 1] - 1) == "switch":
                kinds[i] = "switch"
            elif p == ":":
                kinds[i] = "object" if value(i - 1) and kinds.get(s.inside[i]) != "switch" else "block"
            else:
                kinds[i] = "object" if p in ("=", "(", ",", "[", "?", "return", "default", "&&", "||", "??", "{", "...", "yield", "await", "${", "const", "let", "var") and not (p == "{" and kinds.get(i - 1) in ("block", "class", "switch")) else "block"

    found: dict[int, tuple] = {}  # start: (end, name, line, params)

    def assigned(i: int) -> str:
        """The name of a function that begins at a token, by what stands before it."""
        p = at(i - 1)
        if p == ">":  # type parameters
            return "(anonymous)"
        if p == "=" and i > 1:
            k = i - 2
            name, first = s.path(k) if s.kind[k] == "i" else ("", k)
            o = s.inside[i]
            if at(o) == "{" and kinds.get(o) == "object" or at(o) == "(" and at(o - 1) not in _CONTROL - {"function"} and s.body(s.mate[o]) >= 0:
                return "(anonymous)"  # a default
            if s.kind[k] == "i" and at(first - 1) not in (":", "|", "&", "=>", ">"):
                return name
            while k > 0:  # before a type
                t = at(k)
                if t == ":" and (s.kind[k - 1] == "i" or at(k - 1) in ("?", "!")):
                    return s.t[k - 1 - (at(k - 1) in ("?", "!"))]
                if t in (";", "{", "(", "const", "let", "var"):
                    break
                k = (s.mate[k] if t in _CLOSE and s.mate[k] >= 0 else k) - 1
            return name or "(anonymous)"
        if p == ":" and (i - 1) not in colons:
            k = i - 2
            if s.kind[k] == "s":
                return s.t[k][1:-1] or "(anonymous)"
            return "(computed)" if at(k) == "]" else s.t[k]
        if p in ("(", ","):
            o = s.inside[i]
            before, angles = o - 1, 0
            while at(o) == "(" and before > 0 and (at(before) == ">" or angles):  # type arguments
                angles += (at(before) == ">") - (at(before) == "<")
                before -= 1
            if o > 0 and at(o) == "(" and s.kind[before] == "i" and at(before) not in _BEFORE | _CONTROL | {"async"}:
                name, first = s.path(before)
                return "(anonymous)" if at(first - 1) == "new" else f"(callback in {name})"
            return "(callback in call)" if o > 0 and at(o) == "(" and at(o - 1) in (")", "]") else "(anonymous)"
        return "(default export)" if p == "default" else "(anonymous)"

    def before_async(i: int) -> int:
        return i - 1 if at(i - 1) == "async" and at(i - 2) not in (".", "?.") else i

    types: set[int] = set()  # arrows of function types
    arrows: list[tuple[int, int, int]] = []  # start, body, params
    for i in range(n):
        if skip[i] or s.kind[i] == "s":
            continue
        t = s.t[i]
        if t == "function" and s.kind[i] == "i" and at(i - 1) not in (".", "?."):
            o = i + 1 + (at(i + 1) == "*")
            name = s.t[o] if o < n and s.kind[o] == "i" else None
            while o < n and at(o) not in ("(", "{", ";"):
                o += 1
            if at(o) != "(" or s.mate[o] < 0:
                continue
            b = s.body(s.mate[o])
            if b >= 0 and at(b) == "{" and s.mate[b] >= 0:
                start = before_async(i)
                if name is None:
                    name = "(anonymous function)" if at(start - 1) == "default" else assigned(start)
                found[start] = (s.mate[b], name, s.line[start], s.params(o))
        elif t == "(" and s.mate[i] >= 0:
            first = i
            if at(i - 1) == ">":
                k, angles = i - 1, 0
                while k > 0:
                    angles += (at(k) == ">") - (at(k) == "<")
                    if angles == 0:
                        break
                    k -= 1
                first = k
            key = first - 1
            member = kinds.get(s.inside[i]) in ("class", "object") and key >= 0 and (s.kind[key] in "isn" or at(key) == "]") and at(key) not in _ARROW - {"return", "default", "yield", "async"}
            if member:
                k = s.mate[key] if at(key) == "]" else key
                start = k
                while at(start - 1) in _MODIFIERS and at(start - 1) is not None:
                    start -= 1
                p = at(start - 1)
                in_class = kinds[s.inside[i]] == "class"
                begins = p in ("{", ",", ";", "}") or in_class and (s.line[start] > s.last[start - 1] or p == ")")
                b = s.body(s.mate[i]) if begins else -1
                if b >= 0 and at(b) == "{" and s.mate[b] >= 0 and at(key) != "function":
                    name = "(computed)" if at(key) == "]" else s.t[key][1:-1] if s.kind[key] == "s" else s.t[key]
                    owner = s.inside[i]
                    while owner >= 0 and not classes.get(owner):
                        owner = s.inside[owner]
                    found[start] = (s.mate[b], f"{classes[owner]}.{name}" if owner >= 0 else name, s.line[start], s.params(i))
                    continue
            start = before_async(first)
            p = at(start - 1)
            if p not in _ARROW and not (p == ")" and s.line[start] > s.last[start - 1]):
                if at(s.mate[i] + 1) == "=>":
                    types.add(s.mate[i] + 1)
                continue
            b = s.mate[i] + 1 if p == "?" and at(s.mate[i] + 1) != "=>" else s.body(s.mate[i])
            if b < 0 or at(b) != "=>":
                continue
            o = s.inside[first]
            if p == ":" and not value(start - 1) or p == "=>" and start - 1 in types or p == "(" and at(o - 1) == ":" and not value(o - 1):
                types.add(b)
                continue
            arrows.append((start, b + 1, s.params(i)))
        elif t == "=>" and i > 0 and s.kind[i - 1] == "i" and i not in types:
            start = before_async(i - 1)
            p = at(start - 1)
            if p in _ARROW or s.line[start] > s.last[start - 1]:
                if p == ":" and not value(start - 1) or (p == ":" and at(start - 2) == ")" and start - 1 not in colons):
                    continue  # the type that an arrow function returns
                arrows.append((start, i + 1, 1))
    for start, b, params in reversed(arrows):  # inner ones first
        if at(b) != "{" or s.mate[b] >= 0:
            s.arrows[start] = s.over(b) - 1 if at(b) == "{" else s.expression(b, True)
            found[start] = (s.arrows[start], assigned(start), s.line[start], params)

    complexity, deepest = dict.fromkeys(found, 1), dict.fromkeys(found, 0)
    stack: list[tuple[int, int, int]] = []  # end, function, depth in it
    for i in range(n):
        while stack and stack[-1][0] < i:
            stack.pop()
        if i in found:
            stack.append((found[i][0], i, 0))
        if skip[i] or s.kind[i] == "s" or not stack:
            continue
        t, f = s.t[i], stack[-1][1]
        if t in _LOGICAL or i in ternary:
            complexity[f] += 1
            continue
        if s.kind[i] != "i" or at(i - 1) in (".", "?.") or at(i + 1) == ":":
            continue
        after = at(i + 1)
        if i in found and t in _CONTROL | {"do", "try", "case"} and t != "function":
            continue  # a method of that name
        nests = t in ("if", "for", "while", "switch") and (after == "(" or t == "for" and after == "await") or t == "try" and after == "{" or t == "do" and after not in ("=", ",", ")", "(", ".", None)
        if nests:
            end = s.statement(i)
            if i in s.of_do:
                continue
            stack.append((end, f, stack[-1][2] + 1))
            deepest[f] = max(deepest[f], stack[-1][2])
            complexity[f] += t not in ("switch", "try")
        elif t == "catch" and after in ("(", "{") or t == "case" and kinds.get(s.inside[i]) == "switch":
            complexity[f] += 1
    return [(name, line, s.last[end], params, complexity[k], deepest[k]) for k, (end, name, line, params) in sorted(found.items())]


#: Calls that one file's statements and expressions may nest; a file beyond is an error, not a lost worker.
MAX_CALLS = 20_000


def _rows(k: int, text: str | None) -> Iterator[tuple]:
    """A file's functions and its error, each behind the file's place in its batch."""
    try:
        source = _Source(text or "")
        found, fault = _measure(source), _unmatched(source)
    except Exception as e:  # noqa: BLE001  # one file must not take the others along
        found, fault = [], f"Analyzer error: {'nested too deep' if isinstance(e, RecursionError) else e}"
    for r in found:
        yield k, *r, None
    if fault:
        yield k, *[None] * 6, fault


def read(files: DataFrame) -> DataFrame:
    """Functions of files (file, content), and one row with ``error`` for each file that can't be read, or whose brackets
    don't match: file, name, line, end_line, params, complexity, nesting, error. Other files' rows don't depend on it."""
    kind = files.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(MAX_CALLS)
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column("content").to_pylist()):
                rows += _rows(k, text)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = (pa.string(), *[pa.int64()] * 5, pa.string())
            file = batch.column("file").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([file, *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], ["file", "name", "line", "end_line", "params", "complexity", "nesting", "error"])

    return spread(files).select("file", "content").mapInArrow(run, f"file {kind}, name string, line long, end_line long, params long, complexity long, nesting long, error string")


def _unmatched(s: _Source) -> str | None:
    """The first bracket without a partner."""
    for k, t in enumerate(s.t):
        if s.kind[k] == "p" and (t in _OPEN or t in _CLOSE) and s.mate[k] < 0:
            return f"Unexpected token, no partner for {t} (line {s.line[k]})"
    return None


def shaped(found: DataFrame, language: str) -> DataFrame:
    """Functions of ``read`` with the columns of ``extract.brace_functions``."""
    return found.where("error is null").select("file", "name", "line", "end_line", (F.col("end_line") - F.col("line") + 1).alias("lines"), F.col("params").cast("int").alias("params"), "complexity", "nesting", F.lit(language).alias("language"))


def functions(files: DataFrame, language: str) -> DataFrame:
    """Functions of files (file, content), with the columns of ``extract.brace_functions``; one not closed is left out."""
    return shaped(read(files), language)
