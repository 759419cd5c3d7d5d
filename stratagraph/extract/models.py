"""Extractors for data models: Prisma, TypeORM, Drizzle."""

from __future__ import annotations

import re

from .code import Out, Source, closing, split_top

_SCALARS = {"String", "Boolean", "Int", "BigInt", "Float", "Decimal", "DateTime", "Json", "Bytes"}


def prisma(src: Source, meta: dict) -> Out:
    """Models with their scalar fields, and a relation for each field whose type is a model."""
    out = Out(src, "prisma")
    blocks = {}
    for m in re.finditer(r"(?m)^\s*model\s+(\w+)\s*\{", src.code):
        blocks[m[1]] = (m.start(1), src.text[m.end() : closing(src.code, m.end() - 1)])
    enums = set(re.findall(r"(?m)^\s*enum\s+(\w+)\s*\{", src.code))
    parsed = {}
    for name, (at, body) in blocks.items():
        fields = []
        for line in body.split("\n"):
            f = re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?\s*(.*)", line.split("//")[0])
            if f and not line.strip().startswith("@@"):
                fields.append({"name": f[1], "type": f[2], "list": bool(f[3]), "optional": bool(f[4]), "rest": f[5]})
        table = re.search(r'@@map\(\s*(?:name\s*:\s*)?"([^"]+)"', body)
        parsed[name] = (at, fields, table[1] if table else name.lower() + "s")
    if not blocks and src.text.strip() and "model" in src.text:
        out.error("no model could be read", "warning", "PRISMA_NO_MODEL")
    for name, (at, fields, table) in parsed.items():
        plain = [f for f in fields if f["type"] in _SCALARS or f["type"] in enums]
        shown = [{"name": f["name"], "type": f["type"], "isRequired": not f["optional"], "isId": "@id" in f["rest"], "isRelation": False} for f in plain]
        id_ = out.node("db_model", name, at, tableName=table, fieldCount=len(shown), fields=shown)
        unique = {f["name"] for f in fields if re.search(r"@(?:unique|id)(?!\w)", f["rest"])}
        for f in fields:
            if f["type"] not in parsed:
                continue
            back = [g for g in parsed[f["type"]][1] if g["type"] == name]
            keys = re.search(r"fields\s*:\s*\[([^\]]*)\]", f["rest"])
            own = [k.strip() for k in keys[1].split(",")] if keys else []
            if f["list"] and any(g["list"] for g in back):
                kind = "many_to_many"
            elif f["list"]:
                kind = "one_to_many"
            elif any(g["list"] for g in back):
                kind = "many_to_one"
            elif own and set(own) <= unique or not own and back:
                kind = "one_to_one"
            else:
                kind = "many_to_one"
            named = re.search(r'@relation\(\s*(?:name\s*:\s*)?"([^"]+)"', f["rest"])
            out.edge(id_, "db_relation", f"db_model:{src.path}:{f['type']}", True, relationType=kind, fieldName=f["name"], relationName=named[1] if named else f"{name}_{f['name']}")
    return out


_TYPEORM = {"OneToOne": "one_to_one", "OneToMany": "one_to_many", "ManyToOne": "many_to_one", "ManyToMany": "many_to_many"}


def typeorm(src: Source, meta: dict) -> Out:
    """Entity classes: columns as fields, relations by decorator."""
    out = Out(src, "typeorm")
    for m in src.find(r"@Entity\s*\("):
        args = src.arguments(m.end() - 1)
        head = re.compile(r"[^{}]*?class\s+(\w+)[^{]*\{").match(src.code, closing(src.code, m.end() - 1) + 1)
        if not head:
            continue
        table = src.string(args[0]) if args else None
        if table is None and args:
            named = re.search(r"name\s*:\s*['\"`]([^'\"`]+)", src.raw(args[0]))
            table = named[1] if named else None
        a, b = head.end() - 1, closing(src.code, head.end() - 1)
        fields, relations = [], []
        for d in src.find(r"@(PrimaryGeneratedColumn|PrimaryColumn|Column|CreateDateColumn|UpdateDateColumn|DeleteDateColumn|VersionColumn|OneToOne|OneToMany|ManyToOne|ManyToMany)\s*\(", a, b):
            inner = src.arguments(d.end() - 1)
            prop = re.compile(r"(?:\s*@\w+\s*(?:\((?:[^()]|\([^()]*\))*\))?)*\s*(?:public\s+|private\s+|readonly\s+)*(\w+)\s*([?!]?)\s*:\s*([^;=\n]+)").match(src.code, closing(src.code, d.end() - 1) + 1)
            if not prop:
                continue
            if d[1] in _TYPEORM:
                text = src.raw(inner[0]) if inner else ""
                arrow = re.search(r"=>\s*(\w+)", text)
                target = arrow[1] if arrow else text if re.fullmatch(r"\w+", text) else re.sub(r"\W.*", "", prop[3].strip())
                relations.append((d[1], target, prop[1], d.start()))
            else:
                fields.append({"name": prop[1], "type": prop[3].strip(), "isRequired": prop[2] != "?", "isId": d[1].startswith("Primary"), "isRelation": False})
        id_ = out.node("db_model", head[1], m.start(), tableName=table or head[1].lower(), fieldCount=len(fields), fields=fields)
        for kind, target, field, at in relations:
            out.edge(id_, "db_relation", f"db_model:{src.path}:{target}", True, relationType=_TYPEORM[kind], fieldName=field, relationName=f"{head[1]}_{field}")
    return out


# Column kinds, the longer names before those they begin with.
_COLUMN_KINDS = ("bigserial", "smallserial", "serial", "bigint", "smallint", "mediumint", "tinyint", "integer", "int", "varchar", "char", "text", "boolean", "timestamp", "datetime", "date", "time", "jsonb", "json", "decimal", "numeric", "doublePrecision", "double", "real", "float", "uuid", "blob", "binary")
_PLAIN_KIND, _KIND_OF = (re.compile(rf"{before}({'|'.join(_COLUMN_KINDS)})(?!\w)") for before in ("", r"\w+\."))


def drizzle(src: Source, meta: dict) -> Out:
    """Tables by builder call, named by their constants; relations from `relations()`."""
    out = Out(src, "drizzle")
    for m in src.find(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:\w+\.)?(pgTable|mysqlTable|sqliteTable)\s*\("):
        args = src.arguments(m.end() - 1)
        fields = []
        if len(args) > 1 and "{" in src.code[args[1][0] : args[1][1]]:
            open_ = src.code.index("{", args[1][0])
            for a, b in split_top(src.code, open_ + 1, closing(src.code, open_)):
                f = re.match(r"\s*(\w+)\s*:\s*(.*)", src.code[a:b], re.S)
                if f:
                    kinds = [k[1] for k in (_PLAIN_KIND.match(f[2]), _KIND_OF.match(f[2])) if k]
                    kind = min(kinds, key=_COLUMN_KINDS.index, default="unknown")
                    fields.append({"name": f[1], "type": kind, "isRequired": ".notNull(" in f[2] or ".primaryKey(" in f[2], "isId": ".primaryKey(" in f[2], "isRelation": False})
        out.node("db_model", m[1], m.start(1), tableName=(src.string(args[0]) if args else None) or m[1], fieldCount=len(fields), fields=fields)
    for m in src.find(r"(?<![\w.])relations\s*\("):
        args = src.arguments(m.end() - 1)
        if len(args) < 2:
            continue
        owner = src.raw(args[0])
        for r in src.find(r"(\w+)\s*:\s*(one|many)\s*\(\s*(\w+)", args[1][0], args[1][1]):
            kind = "many_to_one" if r[2] == "one" else "one_to_many"
            out.edge(f"db_model:{src.path}:{owner}", "db_relation", f"db_model:{src.path}:{r[3]}", True, relationType=kind, fieldName=r[1], relationName=f"{owner}_{r[1]}")
    return out
