"""Extractors for web frameworks: routers, procedures, components and calls."""

from __future__ import annotations

import re
from functools import lru_cache

from .code import Out, Source, closing, pascal

METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
_EXT = r"\.(?:tsx?|jsx?)\Z"


@lru_cache(maxsize=4)  # asked by one extractor after the other
def is_test(path: str) -> bool:
    p = path.lower()
    return any(f in p for f in ("__tests__", "e2e")) and bool({"__tests__", "e2e"} & set(p.split("/"))) or any(k in p for k in (".test.", ".spec.", ".cy."))


def app_file(path: str) -> bool:
    return "app/" in path and bool(re.search(r"(?:^|/)app/(?:.*/)?(?:page|route)" + _EXT, path))


def next_app(src: Source, meta: dict) -> Out:
    """App router: pages and API routes by path; methods from exports; page to component by JSX of imported names."""
    out, path = Out(src, "next_app"), src.path
    inner = re.sub(r"^(?:.*/)?app(?=/)", "", path)
    folder = re.sub(r"/[^/]*\Z", "", inner)
    route = re.sub(r"/@", "/", re.sub(r"/\([^/)]*\)", "", folder)) or "/"
    if re.search(r"/route" + _EXT, inner):
        found = list(src.find(r"export\s+(?:async\s+)?(?:function|const|let|var)\s+(" + "|".join(METHODS) + r")(?!\w)"))
        methods = list(dict.fromkeys(m[1] for m in found)) or ["GET"]
        out.node("api_route", route, found[0].start() if found else 0, method=",".join(methods), route=route, isNextApiRoute=True)
        return out
    default = re.search(r"export\s+default", src.code)
    params = re.findall(r"\[+(?:\.\.\.)?([^\[\]]+)\]+", route)
    page = out.node("page", route, default.start() if default else 0, route=route, isDynamic=bool(params), params=params, isGroupLayout=bool(re.search(r"/\([^/)]*\)", folder)))
    used = set(m[1] for m in src.find(r"<([A-Z][\w$]*)"))
    for item in src.imports():
        for local in item["names"]:
            if local in used:
                out.edge(page, "renders", f"component:unknown:{local}", True, jsxLine=item["line"])
    return out


def pages_file(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return "pages/" in path and bool(re.search(r"(?:^|/)pages/.*" + _EXT, path)) and not name.startswith(("_app.", "_document.", "_error.")) and not is_test(path)


def next_pages(src: Source, meta: dict) -> Out:
    """Pages router: routes by path; API methods from named exports, else from comparisons of req.method, else GET."""
    out = Out(src, "next_pages")
    route = re.sub(r"/index\Z", "", re.sub(_EXT, "", re.sub(r"^(?:.*/)?pages(?=/)", "", src.path))) or "/"
    if route == "/api" or route.startswith("/api/"):
        methods = list(dict.fromkeys(m[1] for m in src.find(r"export\s+(?:async\s+)?function\s+(" + "|".join(METHODS) + r")(?!\w)")))
        if not methods:
            methods = [m for m in ("POST", "PUT", "DELETE") if re.search(rf"req\.method\s*===?\s*['\"]{m}['\"]", src.text)]
        out.node("api_route", route, 0, method=",".join(methods or ["GET"]), route=route, isNextApiRoute=True)
    else:
        params = re.findall(r"\[+(?:\.\.\.)?([^\[\]]+)\]+", route)
        out.node("page", route, 0, route=route, isDynamic=bool(params), params=params, isGroupLayout=False)
    return out


def trpc(src: Source, meta: dict) -> Out:
    """Routers with their procedures: the kind from mutation, subscription or query in the chain."""
    out = Out(src, "trpc")
    for m in src.find(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:[\w$.]+\.)?(?:router|createTRPCRouter)\s*\(\s*\{"):
        name = re.sub(r"Router\Z", "", m[1]) or m[1]
        open_ = m.end() - 1
        router = out.node("trpc_procedure", name, m.start(), procedureType="query", routerName=name, procedureName=name, hasInput=False, hasOutput=False, isRouter=True)
        from .code import split_top

        for a, b in split_top(src.code, open_ + 1, closing(src.code, open_)):
            key = re.match(r"\s*([A-Za-z_$][\w$]*)\s*:", src.code[a:b])
            chain = src.code[a:b]
            if not key or not re.search(r"\.(?:query|mutation|subscription)\s*\(", chain):
                continue
            kind = next((k for k in ("mutation", "subscription") if f".{k}" in chain), "query")
            at = a + key.start(1)
            full = f"{name}.{key[1]}"
            procedure = out.node("trpc_procedure", full, at, procedureType=kind, routerName=name, procedureName=key[1], hasInput=".input(" in chain, hasOutput=".output(" in chain)
            out.edge(router, "contains", procedure, reason="router", routerName=name, procedureName=key[1])
    return out


def tsrpc(src: Source, meta: dict) -> Out:
    """APIs from Api* functions and Req* types, messages from Msg* types; the path from the folder, ws from the path."""
    out = Out(src, "tsrpc")
    transport = "ws" if re.search(r"(?:^|/|\b)ws(?:/|\b)", src.path.lower()) else "http"
    folder = re.sub(r"^.*?(?:protocols|api)/", "", re.sub(r"/?[^/]*\Z", "", src.path) + "/").strip("/")
    seen = set()
    answers = {m[1] for m in src.find(r"(?:interface|type)\s+(?=(Res\w+))")}

    def api(name: str, at: int, req=None, res=None) -> None:
        if name and name not in seen:
            seen.add(name)
            out.node("tsrpc_api", name, at, apiPath="/".join(filter(None, (folder, name))), transport=transport, reqTypeName=req, resTypeName=res, hasCustomError=False)

    for m in src.find(r"(?:function\s+|(?:const|let)\s+)Api([A-Z]\w*)"):
        call = re.search(r"ApiCall\s*<\s*(\w+)\s*,\s*(\w+)", src.code[m.end() : m.end() + 300])
        api(m[1], m.start(), call and call[1], call and call[2])
    for m in src.find(r"(?:interface|type)\s+Req([A-Z]\w*)"):
        api(m[1], m.start(), f"Req{m[1]}", f"Res{m[1]}" if f"Res{m[1]}" in answers else None)
    for m in src.find(r"(?:interface|type)\s+Msg([A-Z]\w*)"):
        out.node("tsrpc_msg", m[1], m.start(), msgName="/".join(filter(None, (folder, m[1]))), msgTypeName=f"Msg{m[1]}", transport=transport, hasImplementation=False)
    return out


def _path_value(src: Source, span) -> tuple[str, bool] | None:
    """A path literal with template holes as :param, and whether it is plain."""
    value = src.string(span)
    if value is None:
        return None
    plain = "${" not in value
    return re.sub(r"\$\{\s*([^}]*?)\s*\}", lambda m: ":" + (re.split(r"\W", m[1].strip())[-1] or "param"), value), plain


def express(src: Source, meta: dict) -> Out:
    """Routes per verb call on an app or router, with the prefix of its own `use`."""
    out, prefix = Out(src, "express"), {}
    for m in src.find(r"(?<![\w.])([A-Za-z_$][\w$]*)\.use\s*\("):
        args = src.arguments(m.end() - 1)
        base = src.string(args[0]) if args else None
        if base is not None and len(args) > 1:
            target = src.raw(args[-1])
            prefix[target if re.fullmatch(r"[\w$]+", target) else m[1]] = base
        elif base is not None:
            prefix[m[1]] = base
    for m in src.find(r"(?<![\w.])([A-Za-z_$][\w$]*)\.(get|post|put|delete|patch)\s*\("):
        args = src.arguments(m.end() - 1)
        value = _path_value(src, args[0]) if args else None
        if value is None or len(args) < 2:
            continue
        route = re.sub(r"/+", "/", "/" + prefix.get(m[1], "") + "/" + value[0])
        route = route.rstrip("/") or "/"
        handler = src.raw(args[-1])
        named = handler if re.fullmatch(r"[\w$.]+", handler) else None
        out.node("api_route", f"{m[2].upper()} {route}", m.start(), method=m[2].upper(), route=route, isNextApiRoute=False, handlerName=named)
    return out


def api_calls(src: Source, meta: dict) -> Out:
    """Calls to APIs as edges to placeholder targets: fetch, axios, tRPC hooks and TSRPC clients."""
    out = Out(src, "api_calls")
    has = [any(w in src.text and w in src.code for w in words) for words in (("fetch",), ("axios",), ("trpc", "api", "client", "utils"), ("callApi", "listenMsg", "sendMsg"))]
    if not any(has):
        return out
    stem = re.sub(r"\.[^.]+\Z", "", src.path.rsplit("/", 1)[-1])
    name = pascal(src.path.split("/")[-2]) if stem in ("page", "index") and "/" in src.path else pascal(stem)
    source = f"component:{src.path}:{name}"

    def call(at: int, kind: str, target: str, certain: bool, **metadata) -> None:
        out.edge(source, "calls_api", target, certain, callType=kind, callLine=src.line(at), **metadata)

    for m in src.find(r"(?<![\w.])fetch\s*\(") if has[0] else ():
        args = src.arguments(m.end() - 1)
        value = _path_value(src, args[0]) if args else None
        if value:
            option = re.search(r"method\s*:\s*['\"`](\w+)['\"`]", src.raw(args[1])) if len(args) > 1 else None
            call(m.start(), "fetch", f"api_route:unknown:{value[0]}", value[1], method=option[1].upper() if option else "GET", url=value[0])
    for m in src.find(r"(?<![\w.])axios(?:\.(get|post|put|delete|patch))?\s*(?:<[^(>]*>)?\s*\(") if has[1] else ():
        args = src.arguments(m.end() - 1)
        value = _path_value(src, args[0]) if args else None
        if value is None and args and not m[1]:
            url = re.search(r"url\s*:\s*(['\"`])(.*?)\1", src.raw(args[0]))
            value = (url[2], True) if url else None
        if value:
            call(m.start(), "axios", f"api_route:unknown:{value[0]}", value[1], method=(m[1] or "get").upper(), url=value[0])
    for m in src.find(r"(?<![\w.])(?:trpc|api|client|utils)\.([\w$]+(?:\.[\w$]+)*)\.(useQuery|useMutation|useSubscription|useInfiniteQuery|query|mutate|fetch)\s*\(") if has[2] else ():
        call(m.start(), "trpc", f"trpc_procedure:unknown:{m[1]}", True, url=m[1], method="mutation" if "utat" in m[2] else "query")
    for m in src.find(r"\.(callApi|listenMsg|sendMsg)\s*\(") if has[3] else ():
        args = src.arguments(m.end() - 1)
        value = src.string(args[0]) if args else None
        if value is None:
            continue
        if m[1] == "callApi":
            call(m.start(), "tsrpc", f"tsrpc_api:unknown:{value}", True, url=value)
        else:
            out.edge(source, "listens_msg" if m[1] == "listenMsg" else "sends_msg", f"tsrpc_msg:unknown:{value}", True, msgName=value, callLine=src.line(m.start()))
    return out


def components(src: Source, meta: dict) -> Out:
    """React components: exported functions and constants with a capital; what their JSX renders."""
    out = Out(src, "react")
    imported = {local: item for item in src.imports() for local in item["names"]}
    large = [f for f in src.functions() if f["name"][:1].isupper()]
    local = {f["name"] for f in large}
    found = [f for f in large if (f["exported"] or re.search(rf"export\s+(?:default\s+{f['name']}(?!\w)|\{{[^}}]*(?<!\w){f['name']}(?!\w))", src.code))]
    anonymous = "default" in src.code and re.search(r"export\s+default\s+(?:async\s+)?(?:function\s*\(|\([^)]*\)\s*=>|\(\s*\)\s*=>)", src.code)
    if anonymous and not any(f["default"] for f in found):
        body = src.body(anonymous.end())
        stem = re.sub(r"\.[^.]+\Z", "", src.path.rsplit("/", 1)[-1])
        name = pascal(src.path.split("/")[-2]) if stem in ("page", "index") and "/" in src.path else pascal(stem)
        found.append({"name": name or "Default", "start": anonymous.start(), "body": body or (anonymous.end(), len(src.code))})
    for f in found:
        a, b = f["body"]
        head = src.code[f["start"] : a]
        props = re.search(r"\(\s*\{([^}]*)\}", head)
        names = [re.split(r"[:=\s]", p.strip())[0].lstrip(".") for p in props[1].split(",") if p.strip()] if props else []
        tags = list(re.finditer(r"<([A-Z][\w$]*)", src.code[a:b]))
        id_ = out.node("component", f["name"], f["start"], props=names, hasState="useState" in src.code[a:b], isPage="/page." in "/" + src.path, jsxChildCount=len(tags))
        seen = set()
        for t in tags:
            if t[1] in seen or t[1] == f["name"]:
                continue
            seen.add(t[1])
            here = t[1] in local and t[1] not in imported
            out.edge(id_, "renders", f"component:{src.path}:{t[1]}" if here else f"component:unknown:{t[1]}", t[1] in imported or here, jsxLine=src.line(a + t.start()))
    return out


def _join(prefix: str | None, path: str | None) -> str:
    whole = re.sub(r"/+", "/", "/" + (prefix or "") + "/" + (path or ""))
    return whole.rstrip("/") or "/"


def _decorated(src: Source, name: str):
    """(decorator place, its first string, class name, class body) of classes with a decorator."""
    for m in src.find(rf"@{name}\s*\("):
        args = src.arguments(m.end() - 1)
        end = closing(src.code, m.end() - 1)
        kind = re.compile(r"[^;{}]*?class\s+(\w+)[^{]*\{").match(src.code, end + 1) or re.compile(r"(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)[^{]*\{").match(src.code, end + 1)
        if kind:
            yield m, args, kind[1], (kind.end() - 1, closing(src.code, kind.end() - 1))


def nest_controller(src: Source, meta: dict) -> Out:
    """Controllers: a route, a handler and their link for each verb decorator; prefixes joined."""
    out = Out(src, "nest_controller")
    for _, args, name, (a, b) in _decorated(src, "Controller"):
        prefix = src.string(args[0]) if args else None
        if prefix is None and args:
            path = re.search(r"path\s*:\s*['\"`]([^'\"`]*)", src.raw(args[0]))
            prefix = path[1] if path else None
        for m in src.find(r"@(Get|Post|Put|Delete|Patch|All|Head|Options)\s*\(", a, b):
            inner = src.arguments(m.end() - 1)
            route = _join(prefix, src.string(inner[0]) if inner else None)
            method = re.compile(r"(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:public\s+|private\s+)?(?:async\s+)?(\w+)\s*\(").match(src.code, closing(src.code, m.end() - 1) + 1)
            verb = m[1].upper()
            id_ = out.node("api_route", f"{verb} {route}", m.start(), method=verb, route=route, isNextApiRoute=False)
            if method:
                handler = out.node("handler", f"{name}.{method[1]}", method.start(1), functionName=method[1], routeId=id_)
                out.edge(id_, "handles", handler, handlerName=method[1])
    return out


def nest_module(src: Source, meta: dict) -> Out:
    out = Out(src, "nest_module")
    for m, args, name, _ in _decorated(src, "Module"):
        lists = {}
        for key in ("controllers", "providers", "imports", "exports"):
            found = re.search(rf"(?<!\w){key}\s*:\s*\[([^\]]*)\]", src.raw(args[0])) if args else None
            lists[key] = [x.strip() for x in found[1].split(",") if x.strip()] if found else []
        count = sum(map(len, lists.values()))
        out.node("module", name, m.start(), childCount=count, childTypes=[k for k, v in lists.items() if v])
    return out


def nest_service(src: Source, meta: dict) -> Out:
    """Injectable classes, with queries to the entities whose repositories they inject."""
    out = Out(src, "nest_service")
    for m, _, name, (a, b) in _decorated(src, "Injectable"):
        id_ = out.node("service", name, m.start(), className=name, methodName=name)
        for r in src.find(r"@InjectRepository\s*\(\s*(\w+)", a, b):
            out.edge(id_, "queries_db", f"db_model:{src.path}:{r[1]}", True, repository=r[1], callLine=src.line(r.start()))
    return out


def directive(src: Source) -> str | None:
    """client or server, if the text begins with that directive."""
    found = _DIRECTIVE.match(src.text[:500].lstrip())
    return found[1] if found else None


def scopes(src: Source) -> list[dict]:
    """Functions with their texts."""
    return [{"name": f["name"], "line": f["line"], "text": src.text[f["start"] : f["body"][1]]} for f in src.functions()]


_DIRECTIVE = re.compile(r"""['"]use (client|server)['"]""")
_LOOPS = re.compile(r"(?<![\w.])for\s*(?:await\s*)?\(|\.(?:forEach|map|flatMap)\s*\(")
_QUERY = re.compile(
    r"await\s+(?:[\w$]+\.)*?(prisma\.\w+\.\w+|(?:\w*[rR]epository|\w*[rR]epo)\.(?:find\w*|save|update|delete|remove|insert|count|create)|(?:entityManager|manager)\.(?:find\w*|save|update|delete|remove|query))\s*\("
)


def loop_queries(src: Source) -> list[dict]:
    """Queries awaited inside loops or in callbacks over arrays: line, call."""
    out = {}
    if "await" not in src.text:  # most sources have none, and need no mask then
        return []
    for m in _LOOPS.finditer(src.code):
        paren = m.end() - 1
        end = closing(src.code, paren)
        if m[0].lstrip(".").startswith("for") and not m[0].startswith("."):
            body = re.compile(r"\s*(\{)?").match(src.code, end + 1)
            end = closing(src.code, body.end() - 1) if body[1] else src.code.find("\n", end + 1)
            end = len(src.code) if end < 0 else end
        for q in _QUERY.finditer(src.code, paren, end):
            out[src.line(q.start())] = q[1]
    return [{"line": k, "call": v} for k, v in sorted(out.items())]
