"""Extractors for tests: Vitest and Jest, Playwright, Cypress, JUnit, Kotest."""

from __future__ import annotations

import re

from .code import Out, Source, closing
from .kotlin import declarations

_LIFE = {"beforeEach": "before_each", "afterEach": "after_each", "beforeAll": "before_all", "afterAll": "after_all", "before": "before_all", "after": "after_all"}


def _title(src: Source, paren: int) -> str:
    args = src.arguments(paren)
    if not args:
        return "anonymous"
    value = src.string(args[0])
    return value if value is not None else re.sub(r"\s+", " ", src.raw(args[0]))[:80] or "anonymous"


def _spec(src: Source, parser: str, framework: str, suites: str, cases: str, hooks: str, uses: bool = True) -> Out:
    """Suites and cases by call, nested by their braces; names joined by ` > `."""
    out = Out(src, parser)
    file_name = src.path.rsplit("/", 1)[-1]
    root = out.node("test_suite", file_name, 0, framework=framework, kind="file")
    found = []
    for m in src.find(rf"(?<![\w.$])({suites}|{cases}|{hooks})((?:\.\w+)*)\s*(?:<[^(>]*>)?\s*(?=[(`])"):
        at = m.end()
        if src.code[at] != "(":
            close = src.code.find("`", at + 1)
            at = src.code.find("(", close)
        elif ".each" in m[2]:
            second = re.compile(r"\s*\(").match(src.code, closing(src.code, at) + 1)
            at = second.end() - 1 if second else at
        if at >= 0:
            found.append((m.start(), at, closing(src.code, at), m[1], m[2]))
    stack: list[tuple[int, str, str]] = []
    fixtures: list[tuple[str, str]] = []  # scope name, id
    for start, paren, end, name, mods in found:
        while stack and start > stack[-1][0]:
            stack.pop()
        scope = stack[-1][1] if stack else ""
        parent = stack[-1][2] if stack else root
        if re.fullmatch(hooks, name):
            label = " > ".join(filter(None, (scope, f"{name} {src.line(start)}")))
            fixtures.append((scope, out.node("test_fixture", label, start, framework=framework, lifecycle=_LIFE.get(name, "custom"))))
            continue
        title = " > ".join(filter(None, (scope, _title(src, paren))))
        if re.fullmatch(suites, name):
            id_ = out.node("test_suite", title, start, framework=framework, kind="describe")
            out.edge(parent, "tests", id_, True, relation="contains")
            stack.append((end, title, id_))
            continue
        off = name.startswith("x") or bool(re.search(r"\.(?:skip|todo|fixme)(?!\w)", mods))
        case = out.node("test_case", title, start, framework=framework, isParameterized=".each" in mods, parameterSource="each" if ".each" in mods else None, disabled=off)
        out.edge(parent, "tests", case, True, relation="contains")
        for at, id_ in fixtures if uses else ():
            if title.startswith(at):
                out.edge(case, "uses_fixture", id_, True, usage="lifecycle")
    return out


def vitest_jest(src: Source, meta: dict) -> Out:
    framework = "jest" if re.search(r"@jest/globals|(?<!\w)jest\.", src.text) and "vitest" not in src.text else "vitest"
    return _spec(src, "vitest_jest", framework, "x?describe", "(?:x?it|x?test)", "beforeEach|afterEach|beforeAll|afterAll")


def is_vitest_jest(path: str, text: str) -> bool:
    return bool(re.search(r"\.(?:test|spec)\.[cm]?[jt]sx?\Z", path) or "/__tests__/" in "/" + path) and "@playwright/test" not in text and bool(re.search(r"vitest|@jest/globals|(?<!\w)jest\.|(?<!\w)(?:describe|it|test)(?:\.\w+)*\s*\(", text))


def playwright(src: Source, meta: dict) -> Out:
    """As the other specs, with the fixtures of `test.extend`, which cases take as parameters."""
    out = _spec(src, "playwright", "playwright", r"test\.describe", "test", r"test\.(?:beforeEach|afterEach|beforeAll|afterAll)")
    out.nodes = [n for n in out.nodes if not (n["type"] == "test_case" and n["name"].endswith("anonymous"))]
    own = {}
    for m in () if ".extend" not in src.code else src.find(r"\.extend\s*(?:<[^(]*>)?\s*\(\s*\{"):
        open_ = m.end() - 1
        for f in src.find(r"(?:(?<=[{,])|(?<=\n))\s*(\w+)\s*:\s*(?:async|\[)", open_, closing(src.code, open_)):
            own[f[1]] = out.node("test_fixture", f[1], f.start(1), framework="playwright", lifecycle="custom")
    for case in [n for n in out.nodes if n["type"] == "test_case"] if own else ():
        line_start = sum(len(x) + 1 for x in src.text.split("\n")[: case["line"] - 1])
        taken = re.search(r"\(\s*\{([^}]*)\}", src.code[line_start : line_start + 400])
        for name in re.findall(r"\w+", taken[1]) if taken else ():
            if name in own:
                out.edge(case["id"], "uses_fixture", own[name], True, usage="parameter")
    return out


def cypress(src: Source, meta: dict) -> Out:
    return _spec(src, "cypress", "cypress", "(?:describe|context)", "(?:x?it|specify)", "beforeEach|afterEach|before|after", uses=False)


def is_cypress(path: str, text: str) -> bool:
    return "cypress/e2e" in path or "cy." in text and bool(re.search(r"\bcy\.(?:visit|request)\s*\(", text)) or "cypress" in text and bool(re.search(r"from\s+['\"]cypress", text))


def junit(src: Source, meta: dict) -> Out:
    """Test classes, lifecycle functions and cases. Cases belong to the file's first class."""
    out = Out(src, "junit")
    framework = "junit5" if "org.junit.jupiter" in src.text else "junit4"
    suites = [(d, out.node("test_suite", d["name"], d["at"], framework=framework, kind="class")) for d in declarations(src) if d["kind"] == "class"]
    for m in src.find(r"((?:@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?\s*)+)(?:(?:private|public|internal|open|override|suspend)\s+)*fun\s+(`[^`]*`|\w+)"):
        notes = re.findall(r"@([\w.]+)", m[1])
        name = src.text[m.start(2) : m.end(2)].strip("`")
        hook = next((n for n in notes if n.startswith(("Before", "After"))), None)
        if hook:
            life = ("before_" if hook.startswith("Before") else "after_") + ("all" if hook.endswith(("All", "Class")) else "each")
            out.node("test_fixture", name, m.start(2), framework=framework, lifecycle=life)
        elif any(n in ("Test", "ParameterizedTest", "RepeatedTest", "TestFactory") for n in notes):
            param = next((n for n in notes if n.endswith("Source")), None)
            case = out.node("test_case", name, m.start(2), framework=framework, isParameterized="ParameterizedTest" in notes, parameterSource=param, disabled=bool({"Disabled", "Ignore"} & set(notes)))
            if suites:
                out.edge(suites[0][1], "tests", case, True, relation="contains")
    return out


def kotest(src: Source, meta: dict) -> Out:
    out = Out(src, "kotest")
    spec = next((d for d in declarations(src) if any(p.endswith("Spec") for p, _ in d["parents"])), None)
    name = spec["name"] if spec else src.path.rsplit("/", 1)[-1]
    suite = out.node("test_suite", name, spec["at"] if spec else 0, framework="kotest", kind="spec")
    for m in src.find(r"(?<![\w.])(beforeTest|afterTest|beforeSpec|afterSpec|beforeEach|afterEach)\s*\{"):
        life = ("before_" if m[1].startswith("before") else "after_") + ("all" if m[1].endswith("Spec") else "each")
        out.node("test_fixture", f"{name} > {m[1]} {src.line(m.start())}", m.start(), framework="kotest", lifecycle=life)
    for m in src.find(r"(?<![\w.])(x?)(?:test|should|it)\s*\(\s*\""):
        title = src.text[m.end() : src.code.find('"', m.end())]
        case = out.node("test_case", f"{name} > {title}", m.start(), framework="kotest", isParameterized=False, disabled=bool(m[1]))
        out.edge(suite, "tests", case, True, relation="contains")
    return out
