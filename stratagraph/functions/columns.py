"""Scalar functions over ids, URLs, paths and text, as Column expressions.

Patterns end with \\z and use ASCII word edges, so that they mean the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schema import LAYER_OF

Name = Column | str


def _col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def node_id(kind: Name, path: Name, name: Name) -> Column:
    return F.concat_ws(":", _col(kind), _col(path), _col(name))


def node_id_parts(id_: Name) -> Column:
    """struct(type, file_path, name); the name may hold colons. Null if there are fewer than three parts."""
    p = F.split(_col(id_), ":", 3)
    return F.when(F.size(p) == 3, F.struct(p[0].alias("type"), p[1].alias("file_path"), p[2].alias("name")))


def edge_id(source: Name, kind: Name, target: Name) -> Column:
    return F.concat_ws("--", _col(source), _col(kind), _col(target))


def edge_id_parts(id_: Name) -> Column:
    """struct(source, type, target), the source as short as can be."""
    pattern = r"^(.+?)--(\w+)--(.+)\z"
    e = _col(id_)
    return F.when(e.rlike(pattern), F.struct(*[F.regexp_extract(e, pattern, i).alias(n) for i, n in ((1, "source"), (2, "type"), (3, "target"))]))


def placeholder_id(kind: Name, target: Name) -> Column:
    """The id of a call's target before it is resolved."""
    return node_id(_col(kind), F.lit("unknown"), _col(target))


def normalize_url(url: Name) -> Column:
    """Without query and one trailing slash, with a leading slash; "/" for nothing."""
    bare = F.regexp_replace(F.substring_index(_col(url), "?", 1), r"/\z", "")
    return F.when(F.coalesce(_col(url), F.lit("")) == "", "/").when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def last_segment(path: Name) -> Column:
    """The last part of a path that isn't empty; null if there is none."""
    return F.get(F.reverse(F.filter(F.split(_col(path), "/"), lambda x: x != "")), F.lit(0))


def without_api(url: Name) -> Column:
    return F.regexp_replace(_col(url), "^/api", "")


def without_base(url: Name) -> Column:
    """What follows a first segment if it begins with /api/; null otherwise."""
    return F.nullif(F.regexp_extract(_col(url), r"^/[^/]+(/api/.+)\z", 1), F.lit(""))


def slashes(path: Name) -> Column:
    return F.translate(_col(path), "\\", "/")


def capitalized(s: Name) -> Column:
    return F.concat(F.upper(F.substring(_col(s), 1, 1)), F.substring(_col(s), 2, 1 << 30))


def pascal_case(s: Name) -> Column:
    """Parts between characters other than letters and digits, each capitalised and joined."""
    parts = F.filter(F.split(_col(s), r"[^A-Za-z0-9]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def line_of(text: Name, offset: Name) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(_col(text), F.lit(1), _col(offset).cast("int")), "\n", -1))


def join_route(prefix: Name, path: Name) -> Column:
    """A controller's prefix and a method's path as one route with single slashes."""
    whole = F.concat_ws("/", F.lit(""), F.coalesce(_col(prefix), F.lit("")), F.coalesce(_col(path), F.lit("")))
    clean = F.regexp_replace(F.regexp_replace(whole, "/+", "/"), r"(?<=.)/\z", "")
    return clean


def app_route(path: Name) -> Column:
    """Route of an app-router file: groups go, parallel slots lose their mark, the root is "/"."""
    inner = F.regexp_replace(F.regexp_replace(slashes(path), r"^(?:.*/)?app(?=/)", ""), r"/(?:page|route|layout)\.(?:tsx?|jsx?)\z", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"/\([^/)]*\)", ""), r"/@", "/")
    return F.when(inner == "", "/").otherwise(inner)


def pages_route(path: Name) -> Column:
    """Route of a pages-router file; index files stand for their folder."""
    inner = F.regexp_replace(F.regexp_replace(slashes(path), r"^(?:.*/)?pages(?=/)", ""), r"\.(?:tsx?|jsx?)\z", "")
    inner = F.regexp_replace(inner, r"/index\z", "")
    return F.when(inner == "", "/").otherwise(inner)


def route_params(route: Name) -> Column:
    """Names in [x], [...x] and [[...x]]."""
    return F.regexp_extract_all(_col(route), F.lit(r"\[+(?:\.\.\.)?([^\[\]]+)\]+"), F.lit(1))


def directory_scope(path: Name) -> Column:
    """struct(root, leaf): the directory scopes that a file counts for."""
    p = F.filter(F.split(slashes(path), "/"), lambda x: x != "")
    part = lambda i: F.get(p, F.lit(i))
    nested = part(0).isin("frontend", "backend") & (part(1) == "src") & (F.size(p) > 3)
    leaf = F.when(F.coalesce(nested, F.lit(False)), F.concat_ws("/", part(0), part(2))).when(F.size(p) > 2, F.concat_ws("/", part(0), part(1))).otherwise(part(0))
    return F.when(F.size(p) <= 1, F.struct(F.lit("project").alias("root"), F.lit("project").alias("leaf"))).otherwise(F.struct(part(0).alias("root"), leaf.alias("leaf")))


def is_test_path(path: Name) -> Column:
    p = F.lower(slashes(path))
    return F.arrays_overlap(F.split(p, "/"), F.array(F.lit("__tests__"), F.lit("e2e"))) | p.rlike(r"\.(?:test|spec|cy)\.")


def directive(text: Name) -> Column:
    """'client' or 'server' where a file's first 500 characters begin with that directive."""
    head = F.regexp_replace(F.substring(_col(text), 1, 500), r"^\s+", "")
    return F.when(head.rlike("""^['"]use client['"]"""), "client").when(head.rlike("""^['"]use server['"]"""), "server")


def trace_layer(kind: Name) -> Column:
    out = F.lit("other")
    for layer in ("frontend", "api", "logic", "data"):
        out = F.when(_col(kind).isin(*[t for t, at in LAYER_OF.items() if at == layer]), layer).otherwise(out)
    return out


def severity_rank(severity: Name) -> Column:
    """critical < error < warning < info < anything else."""
    s = _col(severity)
    return F.when(s == "critical", 0).when(s == "error", 1).when(s == "warning", 2).when(s == "info", 3).otherwise(4)


# Names of functions that guard a route, and routes that need no guard.
AUTH_FUNCTIONS = (
    "getServerSession", "getSession", "auth", "verifyToken", "getToken", "jwtVerify", "checkAuth", "requireAuth", "isAuthenticated", "withAuth",
    "validateToken", "authenticate", "authorize", "useGuards", "canActivate", "passport.authenticate", "verify", "protectedProcedure", "isAuthed",
)
PUBLIC_ROUTES = ("health", "webhook", "auth", "trpc/public", "public", "cron", "verify", "csrf", "geolocation", "ip", "email", "avatar", "signup", "cancel", "book$", "track$")

AUTH_PATTERN = r"(?<!\w)protectedProcedure(?!\w)|(?i:(?<!\w)(?:" + "|".join(f.replace(".", r"\.") for f in AUTH_FUNCTIONS) + r")\s*\()"
PUBLIC_PATTERN = "^/api/(?:" + "|".join(p.replace("$", r"\z") for p in PUBLIC_ROUTES) + ")"


def has_auth(text: Name) -> Column:
    return _col(text).rlike(AUTH_PATTERN)


def is_public_route(route: Name) -> Column:
    return _col(route).rlike(PUBLIC_PATTERN)


def duration_ms(seconds: Name) -> Column:
    """Milliseconds of a text or number of seconds, not below 0; 0 for what is no number."""
    x = _col(seconds).try_cast("double")
    return F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)) * 1000)


_SQL = {
    "graph_node_id": ("kind string, path string, name string", "string", "concat_ws(':', kind, path, name)"),
    "graph_edge_id": ("source string, kind string, target string", "string", "concat_ws('--', source, kind, target)"),
    "graph_normalize_url": (
        "url string", "string",
        "case when coalesce(url, '') = '' then '/' when substring_index(url, '?', 1) like '/%' then regexp_replace(substring_index(url, '?', 1), r'/\\z', '') "
        "else concat('/', regexp_replace(substring_index(url, '?', 1), r'/\\z', '')) end",
    ),
    "graph_severity_rank": ("severity string", "int", "case severity when 'critical' then 0 when 'error' then 1 when 'warning' then 2 when 'info' then 3 else 4 end"),
    "graph_trace_layer": (
        "kind string", "string",
        "case " + " ".join(f"when kind in ({', '.join(repr(t) for t, at in LAYER_OF.items() if at == layer)}) then '{layer}'" for layer in ("frontend", "api", "logic", "data")) + " else 'other' end",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """The functions as SQL functions of the session. They are SQL text, so Catalyst inlines them."""
    for name, (arguments, returns, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    return sorted(_SQL)
