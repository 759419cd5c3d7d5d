"""Which file defines a name that others pass on: `export { a as b } from`, `export * from` and names exported after an import.

Names go up the stars from the files that provide them: a round takes each name one star further, to files that haven't had it
from nearer, so there is at most one row for each file and name, and not one for each two files that stars connect. Only names
that somebody asks for go. Named links are followed one at a time, since each may go on through stars of its own.
`star_closure` gives the pairs of files themselves, by doubling; it is as large as there are such pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Comments go before exports are read; a sign in a string that looks like a comment is rare in front of an export.
_COMMENTS = r"(?s)/\*.*?\*/|(?m)(?:^|(?<=[\s;]))//[^\n]*"
_LIST = r"""(?s)\bexport\s+(?:type\s+)?\{([^{}]*)\}(?:\s*from\s*["']([^"']+)["'])?"""
_STAR = r"""\bexport\s*\*\s*(?:as\s+([A-Za-z_$][\w$]*)\s+)?from\s*["']([^"']+)["']"""


def export_facts(files: DataFrame) -> DataFrame:
    """(file, name, specifier, wanted) of files (path, text): `name` is `wanted` of the module `specifier`, or of the file itself
    where that is null. name '*' passes on all names, wanted '*' is the whole module."""
    texts = files.select(F.col("path").alias("file"), F.regexp_replace("text", _COMMENTS, " ").alias("text"))
    lists = texts.select("file", F.explode(F.regexp_extract_all("text", F.lit(_LIST), F.lit(0))).alias("hit"))
    lists = lists.select("file", F.nullif(F.regexp_extract("hit", _LIST, 2), F.lit("")).alias("specifier"), F.explode(F.split(F.regexp_extract("hit", _LIST, 1), ",")).alias("item"))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace("item", r"\s+", " "), r"^\s*type\s", "")), " as ")
    lists = lists.select("file", F.trim(F.element_at(words, -1)).alias("name"), "specifier", F.trim(words[0]).alias("wanted")).where("name <> ''")
    stars = texts.select("file", F.explode(F.regexp_extract_all("text", F.lit(_STAR), F.lit(0))).alias("hit"))
    stars = stars.select("file", F.coalesce(F.nullif(F.regexp_extract("hit", _STAR, 1), F.lit("")), F.lit("*")).alias("name"), F.regexp_extract("hit", _STAR, 2).alias("specifier"), F.lit("*").alias("wanted"))
    return lists.unionByName(stars).distinct()


def star_closure(stars: DataFrame) -> DataFrame:
    """(file, target, depth): what the stars (file, target) of a file lead to, at the least number of steps."""
    near = cut(stars.select("file", "target").where("file <> target").distinct().withColumn("depth", F.lit(1)))
    state = None
    while (now := tuple(near.agg(F.count("*"), F.sum("depth")).first())) != state:
        state = now
        on = near.select(F.col("file").alias("target"), F.col("target").alias("_end"), F.col("depth").alias("_more"))
        far = near.join(on, "target").where(F.col("file") != F.col("_end")).select("file", F.col("_end").alias("target"), (F.col("depth") + F.col("_more")).alias("depth"))
        near = cut(near.unionByName(far).groupBy("file", "target").agg(F.min("depth").alias("depth")))
    return near


def nearest_givers(provided: DataFrame, stars: DataFrame, names: DataFrame) -> DataFrame:
    """(file, name, giver) for each of the names (name) and each file that has it by stars (file, target) or of its own
    (provided: file, name): the provider at the fewest steps, ties to the smaller path. `default` isn't passed on.

    The least of (steps, path) for a file is that of its best target, a step further; rounds go by steps, so what a file gets
    first is its best, and later rounds needn't come back to it. There are as many rounds as steps to the farthest giver."""
    stars = cut(stars.select("file", "target").where("file <> target").distinct())
    seen = cut(provided.select("file", "name").distinct().join(names.distinct(), "name", "left_semi").select("file", "name", F.col("file").alias("giver")))
    frontier, depth = seen.where("name <> 'default'"), 0
    while frontier.take(1):
        above = frontier.withColumnRenamed("file", "target").join(stars, "target").groupBy("file", "name").agg(F.min("giver").alias("giver"))
        frontier = cut(above.join(seen, ["file", "name"], "left_anti").select("file", "name", "giver"))
        seen, depth = seen.union(frontier), depth + 1
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def resolve(wanted: DataFrame, defined: DataFrame, links: DataFrame, stars: DataFrame) -> DataFrame:
    """(file, name, def_file, def_name): where each wanted (file, name) is defined; those that nobody defines are left out.

    defined: file, name. links: file, name, to_file, to_name. stars: file, target. A file's own definition goes before its
    links, these before its stars; of several stars that have a name the nearest counts, ties to the smaller path. Stars do
    not pass on `default`. Links that go in circles define nothing."""
    own = defined.select("file", "name").distinct().withColumn("to", F.lit(None).cast("struct<file:string,name:string>"))
    passed = links.groupBy("file", "name").agg(F.min(F.struct(F.col("to_file").alias("file"), F.col("to_name").alias("name"))).alias("to"))
    passed = passed.join(own.select("file", "name"), ["file", "name"], "left_anti")
    provided = cut(own.unionByName(passed))
    asked = wanted.select("name").union(links.select(F.col("to_name").alias("name"))).distinct()
    givers = nearest_givers(provided, stars, asked).withColumnRenamed("file", "at").join(provided.withColumnRenamed("file", "giver"), ["giver", "name"])
    givers = cut(givers.select("at", "name", "giver", "to"))
    walks = cut(wanted.select("file", "name").distinct().select(F.struct("file", "name").alias("origin"), F.col("file").alias("at"), "name", F.array(F.concat_ws("#", "file", "name")).alias("seen")))
    out = None
    while True:
        step = cut(walks.join(givers, ["at", "name"]).select("origin", "seen", "giver", "name", "to"))
        done = step.where("to is null").select("origin.file", "origin.name", F.col("giver").alias("def_file"), F.col("name").alias("def_name"))
        out = done if out is None else out.unionByName(done)
        key = F.concat_ws("#", "to.file", "to.name")
        walks = step.where("to is not null").where(~F.array_contains("seen", key)).select("origin", F.col("to.file").alias("at"), F.col("to.name").alias("name"), F.array_append("seen", key).alias("seen"))
        if not walks.take(1):
            return out


def resolve_imports(imports: DataFrame, facts: DataFrame, exports: DataFrame, paths: DataFrame) -> DataFrame:
    """(imported, wanted, def_file, def_name) of imported names (imported: a file, wanted: a name in it).

    facts: scopes and imports of all files; exports: as from `export_facts`; paths: file, specifier, imported, what a specifier
    may mean, of which files that exist count."""
    scopes = facts.where("kind = 'scope'").select(F.col("path").alias("file"), "name")
    found = paths.join(facts.select(F.col("path").alias("imported")).distinct(), "imported", "left_semi")
    given = exports.where("specifier is not null").join(found, ["file", "specifier"])
    links = given.where("name <> '*'").select("file", "name", F.col("imported").alias("to_file"), F.col("wanted").alias("to_name"))
    names = facts.where("kind = 'import' and name <> ''").select(F.col("path").alias("file"), F.col("name").alias("wanted"), F.col("source").alias("specifier"), F.col("target").alias("to_name"))
    later = exports.where("specifier is null").select("file", "name", "wanted").join(names, ["file", "wanted"]).join(found, ["file", "specifier"]).select("file", "name", F.col("imported").alias("to_file"), "to_name")
    renamed = exports.where("specifier is null and name <> wanted").join(scopes.withColumnRenamed("name", "wanted"), ["file", "wanted"], "left_semi").select("file", "name", F.col("file").alias("to_file"), F.col("wanted").alias("to_name"))
    stars = given.where("name = '*'").select("file", F.col("imported").alias("target"))
    asked = imports.select(F.col("imported").alias("file"), F.col("wanted").alias("name"))
    got = resolve(asked, scopes, links.unionByName(later).unionByName(renamed), stars)
    return got.select(F.col("file").alias("imported"), F.col("name").alias("wanted"), "def_file", "def_name")
