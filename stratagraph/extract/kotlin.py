"""Extractors for Kotlin: declarations, Spring, Ktor, Room, Exposed."""

from __future__ import annotations

import re

from .code import Out, Source, closing

_DECL = re.compile(
    r"(?P<notes>(?:@[\w.:]+(?:\s*\((?:[^()]|\([^()]*\))*\))?\s*)*)(?P<mods>(?:(?:public|private|internal|protected|open|abstract|sealed|data|enum|inner|annotation|value|inline|companion|fun)\s+)*)"
    r"(?P<kind>class|interface|object)(?:\s+(?P<name>\w+))?(?:\s*<[^>{]*>)?"
)


def declarations(src: Source) -> list[dict]:
    package = re.search(r"(?m)^\s*package\s+([\w.]+)", src.code)
    out = []
    for m in _DECL.finditer(src.code):
        if m.start("kind") and (src.code[m.start("kind") - 1].isalnum() or src.code[m.start("kind") - 1] in "._:"):
            continue
        at = m.end()
        while at < len(src.code) and src.code[at] in " \t\n":
            at += 1
        params = None
        if src.code[at : at + 1] == "(":
            end = closing(src.code, at)
            params, at = (at, end), end + 1
        tail = re.compile(r"\s*(?::\s*([^{\n]*(?:\([^)]*\)[^{\n]*)*))?").match(src.code, at)
        parents = []
        for part in re.split(r",(?![^(<]*[)>])", tail[1] or ""):
            p = re.match(r"\s*([\w.]+)\s*(?:<[^>]*>)?\s*(\(|by\b)?", part)
            if p and p[1]:
                parents.append((p[1].rsplit(".", 1)[-1], p[2] == "("))
        open_ = re.compile(r"\s*\{").match(src.code, tail.end())
        body = (open_.end() - 1, closing(src.code, open_.end() - 1)) if open_ else None
        mods = m["mods"].split()
        notes = [n for n in re.findall(r"@(?:\w+:)?([\w.]+)", m["notes"])]
        name = m["name"] or ("Companion" if "companion" in mods else None)
        if name:
            out.append({"name": name, "kind": m["kind"], "mods": mods, "notes": notes, "note_span": m.span("notes"), "params": params, "parents": parents, "body": body, "at": m.start("kind"), "package": package[1] if package else ""})
    return out


def base(src: Source, meta: dict) -> Out:
    """Classes, interfaces and objects, with edges to supertypes of the same file (with a call: a class)."""
    out = Out(src, "kotlin")
    for d in declarations(src):
        classes = [p for p, called in d["parents"] if called]
        faces = [p for p, called in d["parents"] if not called]
        if d["kind"] == "interface":
            id_ = out.node("kotlin_interface", d["name"], d["at"], interfaceName=d["name"], packageName=d["package"], annotations=d["notes"], superInterfaces=faces)
        elif d["kind"] == "object":
            id_ = out.node("kotlin_object", d["name"], d["at"], objectName=d["name"], packageName=d["package"], isCompanion="companion" in d["mods"], annotations=d["notes"])
        else:
            kind = next((k for k in ("data", "sealed", "abstract", "enum") if k in d["mods"]), "regular")
            id_ = out.node("kotlin_class", d["name"], d["at"], className=d["name"], kind=kind, packageName=d["package"], annotations=d["notes"], superClass=classes[0] if classes else None, interfaces=faces)
        for p in classes:
            out.edge(id_, "kotlin_inherits", f"kotlin_class:{src.path}:{p}", True, superClass=p, line=src.line(d["at"]))
        for p in faces:
            out.edge(id_, "kotlin_implements", f"kotlin_interface:{src.path}:{p}", True, interfaceName=p, line=src.line(d["at"]))
    return out


def _table(src: Source, d: dict, note: str, key: str) -> str | None:
    found = re.search(rf"@{note}\s*\((?:[^)]*?{key}\s*=\s*)?\"([^\"]+)\"", src.text[slice(*d["note_span"])])
    return found[1] if found else None


def _properties(src: Source, d: dict) -> list[dict]:
    span = d["params"] or d["body"]
    fields = []
    if span:
        for p in re.finditer(r"((?:@[\w:]+(?:\([^)]*\))?\s*)*)(?:val|var)\s+(\w+)\s*:\s*([\w.]+(?:<[^>]*>)?\??)", src.code[span[0] : span[1]]):
            fields.append({"name": p[2], "type": p[3].strip(), "isRequired": not p[3].strip().endswith("?"), "isId": "@Id" in p[1] or "PrimaryKey" in p[1], "isRelation": False})
    return fields


def spring(src: Source, meta: dict) -> Out:
    """Entities as models; services, repositories and controllers as classes; a route for each mapping in a controller."""
    out = Out(src, "spring")
    for d in declarations(src):
        notes = set(d["notes"])
        if "Entity" in notes:
            fields = _properties(src, d)
            out.node("db_model", d["name"], d["at"], tableName=_table(src, d, "Table", "name") or d["name"].lower(), fieldCount=len(fields), fields=fields)
        elif notes & {"Service", "Repository", "RestController", "Controller"} or any(p.endswith("Repository") for p, _ in d["parents"]):
            out.node("kotlin_class", d["name"], d["at"], className=d["name"], kind="regular", packageName=d["package"], annotations=d["notes"], interfaces=[p for p, _ in d["parents"]])
        if notes & {"RestController", "Controller"} and d["body"]:
            for m in src.find(r"@(Get|Post|Put|Delete|Patch|Request)Mapping(?:\s*\((?:[^()]|\([^()]*\))*\))?(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:suspend\s+)?fun\s+(\w+)", *d["body"]):
                method = "GET" if m[1] == "Request" else m[1].upper()
                out.node("kotlin_route", m[2], m.start(), method=method, path="", framework="spring", annotations=[f"{m[1]}Mapping"])
    return out


def ktor(src: Source, meta: dict) -> Out:
    out = Out(src, "ktor")
    for m in src.find(r"(?<![\w.])(get|post|put|delete|patch|head|options)\s*\(\s*\""):
        end = src.code.find('"', m.end())
        path = src.text[m.end() : end]
        out.node("kotlin_route", f"{m[1].upper()} {path}", m.start(), method=m[1].upper(), path=path, framework="ktor", annotations=[])
    for m in src.find(r"@Route\b(?:\([^)]*\))?\s*fun\s+(?:\w+\.)?(\w+)"):
        out.node("kotlin_route", m[1], m.start(), method="GET", path="", framework="ktor", annotations=["Route"])
    return out


def room(src: Source, meta: dict) -> Out:
    out = Out(src, "room")
    for d in declarations(src):
        if "Entity" in d["notes"]:
            fields = _properties(src, d)
            out.node("db_model", d["name"], d["at"], tableName=_table(src, d, "Entity", "tableName") or d["name"].lower(), fieldCount=len(fields), fields=fields)
        if "Dao" in d["notes"]:
            id_ = out.node("kotlin_interface", d["name"], d["at"], interfaceName=d["name"], packageName=d["package"], annotations=d["notes"], superInterfaces=[])
            for m in src.find(r"@(Query|Insert|Update|Delete)(?!\w)", *(d["body"] or (0, 0))):
                out.edge(id_, "queries_db", f"db_model:{src.path}:unknown", False, operation=m[1].lower(), callLine=src.line(m.start()))
    return out


def exposed(src: Source, meta: dict) -> Out:
    """Table objects as models in the singular, entity classes, references as relations."""
    out, known = Out(src, "exposed"), {}
    decls = declarations(src)
    for d in decls:
        parent = next((p for p, _ in d["parents"] if re.fullmatch(r"(?:Int|Long|UUID|Id)?(?:Id)?Table", p)), None)
        if d["kind"] == "object" and parent:
            name = d["name"][:-1] if d["name"].endswith("s") else d["name"]
            known[d["name"]] = name
            body = src.code[slice(*d["body"])] if d["body"] else ""
            columns = re.findall(r"val\s+(\w+)\s*=\s*(\w+)\s*\(", body)
            given = re.match(r"\s*[^{]*Table\s*\(\s*\"([^\"]+)", src.text[d["at"] :])
            fields = [{"name": n, "type": t, "isRequired": True, "isId": n == "id", "isRelation": t == "reference"} for n, t in columns]
            id_ = out.node("db_model", name, d["at"], tableName=given[1] if given else d["name"].lower(), fieldCount=len(fields), fields=fields)
            for r in re.finditer(r"val\s+(\w+)\s*=\s*(?:optR|r)eference\s*\(\s*\"[^\"]*\"\s*,\s*(\w+)", body):
                target = r[2][:-1] if r[2].endswith("s") else r[2]
                out.edge(id_, "db_relation", f"db_model:{src.path}:{target}", False, relationType="many_to_one", fieldName=r[1], relationName=f"{name}_{r[1]}")
    for d in decls:
        if d["kind"] == "class" and any(re.fullmatch(r"(?:Int|Long|UUID)Entity", p) for p, _ in d["parents"]) and d["name"] not in known.values():
            out.node("db_model", d["name"], d["at"], tableName=d["name"].lower(), fieldCount=0, fields=[])
    return out
