"""Reading source code without a parser: masking, bracket matching, arguments, lines.

`mask` blanks comments and the insides of strings, keeping every offset, so that patterns meet code only; the places they
find are then read from the source itself. Template holes (${...}) stay code."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property, lru_cache

_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Where code may stop being plain, where a template may, and the brackets; what lies between is passed over at once.
_STOP, _HOLE, _BRACKET = re.compile(r"""["'`/{}#]"""), re.compile(r"\\|`|\$\{"), re.compile(r"[()\[\]{}]")
#: The inside of a string, up to its quote or the end of the line.
_INSIDE = {q: re.compile(rf"[^{q}\\\n]*+(?:\\(?s:.|\Z)[^{q}\\\n]*+)*+") for q in "\"'"}


def mask(source: str, hash_comments: bool = False, char_quotes: bool = True) -> str:
    out, done, i, n = [], 0, 0, len(source)
    holes: list[int] = []  # open braces within each template hole

    def blank(a: int, b: int) -> None:
        nonlocal done
        out.append(source[done:a])
        out.append("\n".join([" " * len(line) for line in source[a:b].split("\n")]))
        done = b

    def template(at: int) -> int:
        """Blank from inside a template up to its end or its next hole."""
        k = at
        while m := _HOLE.search(source, k):
            k = m.start()
            if m[0] == "\\":
                k += 2
                continue
            blank(at, k)
            if m[0] == "`":
                return k + 1
            holes.append(0)
            return k + 2
        blank(at, n)
        return n

    while m := _STOP.search(source, i):
        i, c = m.start(), m[0]
        if source.startswith("//", i) or hash_comments and c == "#":
            end = source.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif source.startswith("/*", i):
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
        elif source.startswith('"""', i):
            end = source.find('"""', i + 3)
            end = n if end < 0 else end
            blank(i + 3, end)
            i = end + 3
        elif c == '"' or c == "'" and char_quotes:
            k = _INSIDE[c].match(source, i + 1).end()
            blank(i + 1, k)
            i = k + 1
        elif c == "`":
            i = template(i + 1)
        elif holes and c == "{":
            holes[-1] += 1
            i += 1
        elif holes and c == "}":
            if holes[-1]:
                holes[-1] -= 1
                i += 1
            else:
                holes.pop()
                i = template(i + 1)
        else:
            i += 1
    out.append(source[done:])
    return "".join(out)


@lru_cache(maxsize=2)
def _closings(masked: str) -> dict[int, int]:
    """The place of every bracket's closing one, from one pass over the text; brackets that none closes are missing."""
    out, stack = {}, []
    for m in _BRACKET.finditer(masked):
        c = m[0]
        if c in _PAIRS:
            stack.append((_PAIRS[c], m.start()))
        elif stack and c == stack[-1][0]:
            out[stack.pop()[1]] = m.start()
    return out


def closing(masked: str, at: int) -> int:
    """Place of the bracket that closes the one at `at`, or else the next one; the end of the text if none does."""
    if masked[at : at + 1] not in _PAIRS:
        at = next((m.start() for m in _OPEN.finditer(masked, at)), -1)
    return _closings(masked).get(at, len(masked))


@lru_cache
def _marks(mark: str) -> re.Pattern:
    return re.compile(rf"[()\[\]{{}}{re.escape(mark)}]")


def split_top(masked: str, start: int, end: int, mark: str = ",") -> list[tuple[int, int]]:
    """Spans between marks that stand in no bracket."""
    out, depth, at = [], 0, start
    for m in _marks(mark).finditer(masked, start, end):
        c = m[0]
        if c in _PAIRS:
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif not depth:
            out.append((at, m.start()))
            at = m.end()
    if masked[at:end].strip():
        out.append((at, end))
    return out


_LINE = re.compile("\n")
_IMPORT, _BRACES, _TYPE = re.compile(r"(?<![\w.])import\s++(type\s++)?([^'\"`;]*+)(['\"])"), re.compile(r"\{([^}]*)\}"), re.compile(r"^type\s+")
_STRING = re.compile(r"""\s*(['"`])((?:\\.|(?!\1).)*)\1\s*\Z""", re.S)


#: Named functions, arrow constants and methods: words of which a text holds one, if it holds the shape.
_SHAPES = (
    (("function",), re.compile(r"(?P<head>(?:export\s+(?:default\s+)?)?(?:async\s+)?)function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\(")),
    (("const", "let", "var"), re.compile(r"(?P<head>(?:export\s+)?)(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:[A-Za-z_$][\w$.]*\s*(?:<[^>(]*>)?\()*\s*(?:async\s*)?(?:function\s*\w*\s*)?(?P<paren>\(|[A-Za-z_$][\w$]*\s*=>)")),
    (("(",), re.compile(r"(?P<head>(?<=[\n;{}])\s*(?:public\s+|private\s+|protected\s+|static\s+)*(?:async\s+)?)(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[A-Za-z_$][\w$]*)\s*\(")),
)
_TAIL, _BRACE, _OPEN = re.compile(r"\s*(?::[^={;]*(?:\{[^}]*\})?[^={;]*)?(=>)?\s*(\{)?"), re.compile(r"\s*(\{)?"), re.compile(r"[(\[{]")


class Source:
    """A source text with its mask, lines and call arguments; each is made once, when first asked for."""

    def __init__(self, path: str, text: str, kotlin: bool = False):
        self.path, self.text, self.kotlin = path, text, kotlin
        self._imports = self._functions = None

    @cached_property
    def code(self) -> str:
        return mask(self.text, char_quotes=not self.kotlin)

    @cached_property
    def _starts(self) -> list[int]:
        return [0, *(m.end() for m in _LINE.finditer(self.text))]

    def line(self, at: int) -> int:
        return bisect_right(self._starts, at)

    def place(self, at: int) -> tuple[int, int]:
        """Line and column."""
        line = self.line(at)
        return line, at - self._starts[line - 1] + 1

    def find(self, pattern: str, start: int = 0, end: int | None = None):
        return re.compile(pattern).finditer(self.code, start, len(self.code) if end is None else end)

    def arguments(self, paren: int) -> list[tuple[int, int]]:
        return split_top(self.code, paren + 1, closing(self.code, paren))

    def string(self, span: tuple[int, int] | None) -> str | None:
        """The value of a string literal, or None."""
        found = _STRING.match(self.text[span[0] : span[1]]) if span else None
        return found[2] if found else None

    def raw(self, span: tuple[int, int]) -> str:
        return self.text[span[0] : span[1]].strip()

    def body(self, at: int) -> tuple[int, int] | None:
        """The next braces from `at` on, as (open, close)."""
        i = self.code.find("{", at)
        return (i, closing(self.code, i)) if i >= 0 else None

    def imports(self) -> list[dict]:
        """ES imports: names (local to imported), path, line, type_only."""
        if self._imports is None:
            self._imports = self._read_imports()
        return self._imports

    def _read_imports(self) -> list[dict]:
        out = []
        if "import" not in self.code:
            return out
        for m in _IMPORT.finditer(self.code):
            end = self.code.find(m[3], m.end())
            path = self.text[m.end() : end]
            names = {}
            clause = m[2].rstrip().removesuffix("from").strip()
            braces = _BRACES.search(clause)
            if braces:
                for part in braces[1].split(","):
                    words = _TYPE.sub("", part.strip()).split(" as ")
                    if words[0].strip():
                        names[words[-1].strip()] = words[0].strip()
            rest = _BRACES.sub("", clause).strip(" ,")
            for part in filter(None, (x.strip() for x in rest.split(","))):
                names[part.removeprefix("* as ").strip()] = "*" if part.startswith("*") else "default"
            out.append({"names": names, "path": path, "line": self.line(m.start()), "type_only": bool(m[1])})
        return out

    def functions(self) -> list[dict]:
        """Named functions, arrow constants and methods: name, start, line, exported, default, body."""
        if self._functions is None:
            self._functions = self._read_functions()
        return self._functions

    def _read_functions(self) -> list[dict]:
        out = []
        seen = set()
        for kind, (words, shape) in enumerate(_SHAPES):
            if not any(w in self.code for w in words):
                continue
            for m in shape.finditer(self.code):
                at = m.start("name")
                if at in seen:
                    continue
                after = m.end()
                if kind != 1 or m["paren"] == "(":
                    close = closing(self.code, m.end() - 1)
                    tail = _TAIL.match(self.code, close + 1)
                    if kind == 1 and not (tail and tail[1]) and "function" not in m[0]:
                        continue
                    if kind != 1 and not (tail and tail[2]):
                        continue
                    after = tail.end() - (1 if tail[2] else 0)
                else:
                    tail = _BRACE.match(self.code, after)
                    after = tail.end() - (1 if tail[1] else 0)
                end = closing(self.code, after) if self.code[after : after + 1] in ("{", "(") else self.code.find("\n", after)
                seen.add(at)
                head = m["head"] or ""
                out.append({"name": m["name"], "start": m.start() + len(m[0]) - len(m[0].lstrip()), "line": self.line(at), "exported": "export" in head, "default": "default" in head, "body": (after, len(self.code) if end < 0 else end + 1)})
        return sorted(out, key=lambda f: f["start"])


def pascal(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z0-9]+", name) if p)


class Out:
    """What an extractor emits, in order."""

    def __init__(self, source: Source, parser: str):
        self.source, self.parser, self.nodes, self.edges, self.errors = source, parser, [], [], []

    def node(self, kind: str, name: str, at: int = 0, path: str | None = None, /, **metadata) -> str:
        path = self.source.path if path is None else path
        id_ = f"{kind}:{path}:{name}"
        line, column = self.source.place(at)
        self.nodes.append({"id": id_, "type": kind, "name": name, "file_path": path, "line": line, "column": column, "metadata": {k: v for k, v in metadata.items() if v is not None}})
        return id_

    def edge(self, source: str, kind: str, target: str, certain: bool = True, /, **metadata) -> None:
        self.edges.append({"id": f"{source}--{kind}--{target}", "source": source, "target": target, "type": kind, "confidence": "certain" if certain else "inferred", "metadata": {k: v for k, v in metadata.items() if v is not None}})

    def error(self, message: str, severity: str = "error", code: str | None = None) -> None:
        self.errors.append({"file": self.source.path, "message": message, "severity": severity, "parser": self.parser, "code": code})
