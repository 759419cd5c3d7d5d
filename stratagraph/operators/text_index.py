"""An inverted index of trigrams over the names and paths of nodes, for substring search without a scan of the nodes.

Postings (gram, doc) lie in buckets of the gram, sorted by it, so a search reads the buckets and row groups of a few grams;
texts lie in buckets of the doc, so only the candidates' buckets are read to verify them. The rarest grams of the searched
text are intersected; what they leave is tested for the whole text, so more grams would change the work and not the result.
Texts of one or two characters, which have no trigram, are compared with all grams of that length; a blank text finds all.

`search_once` searches many texts at once without an index, where it would serve no second search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import broadcast_if_small, cut, small, tabled, work_folder
from ..schema import NODE

#: Nodes to a bucket, the least number of buckets, and the grams of a searched text that are intersected.
BUCKET_NODES, LEAST_BUCKETS, RAREST = 1_000_000, 16, 3
#: Candidate buckets are read by name up to so many candidates; with more, all buckets are.
FEW = 10_000
#: Many searched texts go by runs of the texts where the postings of their rarest grams hold more rows than this times the texts.
RUNS_FROM = 4
#: A search without an index keeps so many beginnings of searched texts by length in its plan; with more, an index is made.
MOST_STARTS = 20_000
#: Between the texts of a node; a searched text that holds it goes by an index.
_BETWEEN = "\0"
_SCHEMAS = {
    "postings": "gram string, doc long, bucket int", "counts": "gram string, n long, bucket int",
    "texts": f"doc long, id string, name string, path string, ord {NODE['ord'].dataType.simpleString()}, bucket int",
}


def grams(text: str, length: int = 3):
    """The different runs of `length` characters of a text column."""
    size = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), size - (length - 1)), lambda i: F.substr(F.col(text), i, F.lit(length)))
    return F.when(size >= length, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


class TextIndex:
    """The index in a folder: postings (gram, doc), counts (gram, n) and texts (doc, id, name, path, ord)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.postings, self.counts, self.texts = (spark.read.schema(kind).parquet(f"{self.path}/{part}") for part, kind in _SCHEMAS.items())
        self.buckets = spark.read.parquet(f"{self.path}/size").first()["buckets"]

    @classmethod
    def build(cls, graph: Graph, path: str) -> "TextIndex":
        """Writes the index of a graph's nodes. Null names and paths hold nothing. A bucket that a hot gram fills is split into
        several files, small ones share a task."""
        path, buckets = path.rstrip("/"), max(LEAST_BUCKETS, -(-graph.nodes.count() // BUCKET_NODES))
        graph.spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/size")
        texts = graph.nodes.select(F.xxhash64("id").alias("doc"), "id", F.lower("name").alias("name"), F.lower("file_path").alias("path"), "ord")
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")
        texts.select("*", bucket("doc")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/texts")
        texts = graph.spark.read.schema(_SCHEMAS["texts"]).parquet(f"{path}/texts")
        found = texts.select("doc", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(c), F.array().cast("array<string>")) for c in ("name", "path")])))).alias("gram"))
        found = found.distinct().select("gram", "doc", bucket("gram"))
        found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
        postings = graph.spark.read.schema(_SCHEMAS["postings"]).parquet(f"{path}/postings")
        counts = postings.groupBy("gram").agg(F.count("*").alias("n")).select("gram", "n", bucket("gram"))
        counts.hint("rebalance", "bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{path}/counts")
        return cls(graph.spark, path)

    def _holds(self, text):
        return F.coalesce(F.contains("name", text), F.lit(False)) | F.coalesce(F.contains("path", text), F.lit(False))

    def search(self, query: str | None) -> DataFrame:
        """(id, ord) of the nodes whose name or path holds the trimmed text, whatever the case."""
        q = (query or "").strip().lower()
        shown = self.texts.select("id", "ord", "name", "path", "doc", "bucket")
        if len(q) < 3:
            return (shown.where(self._holds(F.lit(q))) if q else shown).select("id", "ord")
        spark, asked = self.texts.sparkSession, sorted({q[i : i + 3] for i in range(len(q) - 2)})
        homes = {r["gram"]: r["bucket"] for r in spark.createDataFrame([(g,) for g in asked], "gram string").select("gram", F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int").alias("bucket")).collect()}
        at = lambda df, some: df.where(F.col("bucket").isin(sorted({homes[g] for g in some})) & F.col("gram").isin(some))
        counts = {r["gram"]: r["n"] for r in at(self.counts, asked).select("gram", "n").collect()}
        if len(counts) < len(asked):  # a gram that no text has
            return shown.where(F.lit(False)).select("id", "ord")
        rare = sorted(asked, key=lambda g: (counts[g], g))[:RAREST]
        docs = at(self.postings, rare).groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("doc")
        docs = cut(docs)
        if small(docs, FEW):
            some = [r["b"] for r in docs.select(F.pmod(F.xxhash64("doc"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]
            shown = shown.where(F.col("bucket").isin(some))
        return shown.join(broadcast_if_small(docs), "doc", "left_semi").where(self._holds(F.lit(q))).select("id", "ord")

    def search_all(self, queries: DataFrame) -> DataFrame:
        """(query, id) of every different searched text of a column `query` at once, trimmed and lower-cased; blank ones find
        nothing. A text meets the postings of its rarest gram only, by equality; where so many texts share grams that these
        meetings would outnumber the nodes, they are looked up among the runs of names and paths instead."""
        asked = queries.select(F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct()
        long = asked.where(F.length("query") >= 3)
        each = long.select("query", F.explode(grams("query")).alias("gram"))
        known = each.join(self.counts.select("gram", "n"), "gram", "left")  # a gram without postings counts as rarest
        rarest = known.groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
        rarest = cut(rarest.where("r.n > 0").select("query", F.col("r.n").alias("n"), F.col("r.gram").alias("gram")))
        volume = rarest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if volume <= RUNS_FROM * self.texts.count():
            found = rarest.join(self.postings.select("gram", "doc"), "gram").select("query", "doc")
            found = found.join(self.texts.select("doc", "id", "name", "path"), "doc").where(self._holds(F.col("query"))).select("query", "id")
        else:
            found = self._by_runs(rarest.select("query"))
        short = asked.where(F.length("query") < 3)
        if not short.take(1):
            return found
        runs = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(c, k), F.array().cast("array<string>")) for c in ("name", "path") for k in (1, 2)])))
        return found.unionByName(self.texts.select("id", F.explode(runs).alias("query")).join(broadcast_if_small(short), "query").select("query", "id").distinct())

    def _by_runs(self, queries: DataFrame) -> DataFrame:
        """(query, id) for many texts that share their grams: the runs of each name and path that begin with the first gram of a
        searched text and have its length, joined by equality, so there are hardly more rows than finds."""
        starts = queries.groupBy(F.substring("query", 1, 3).alias("gram")).agg(F.collect_set(F.length("query")).alias("lengths"))
        texts = self.texts.select("id", F.explode(F.array("name", "path")).alias("text")).where("length(text) >= 3")
        at = texts.select("id", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 2)).alias("i"))
        at = at.withColumn("gram", F.expr("substr(text, i, 3)")).join(broadcast_if_small(starts), "gram")
        runs = at.select("id", "text", "i", F.explode("lengths").alias("k")).where("i + k - 1 <= length(text)")
        return runs.select("id", F.expr("substr(text, i, k)").alias("query")).join(broadcast_if_small(queries, 500_000), "query").select("query", "id").distinct()


def search_once(graph: Graph, queries: DataFrame, most_starts: int = MOST_STARTS) -> DataFrame:
    """(query, id) as from `TextIndex.search_all`, without an index, which costs more than one search of all nodes. Each node's
    runs are those that begin as a searched text of their length does; they are made distinct within the node, so neither
    positions nor finds are shuffled. Nodes are gathered by id first, as an id may come with several names and paths."""
    asked = queries.select(F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct()
    asked = tabled(asked.select("query", F.substring("query", 1, 3).alias("start"), F.length("query").alias("k")))
    kinds = asked.select("start", "k").distinct()
    if not small(kinds, most_starts) or asked.where(F.contains("query", F.lit(_BETWEEN))).take(1):
        return TextIndex.build(graph, work_folder(graph.spark)).search_all(queries)
    by_length: dict[int, list[str]] = {}
    for r in kinds.collect():
        by_length.setdefault(r["k"], []).append(r["start"])
    long = {k: set(some) for k, some in by_length.items() if k >= 3}
    every = sorted(set().union(*long.values()))
    run = lambda i, k: F.substr(F.col("text"), i, F.lit(k))
    places = lambda k: F.when(F.length("text") >= k, F.sequence(F.lit(1), F.length("text") - (k - 1))).otherwise(F.array().cast("array<int>"))
    held = F.array_union(F.collect_set(F.lower("name")), F.collect_set(F.lower("file_path")))
    texts = graph.nodes.groupBy("id").agg(F.array_join(held, _BETWEEN).alias("text"))
    texts = tabled(texts.select("id", "text", F.filter(places(3), lambda i: run(i, 3).isin(every)).alias("at")))
    # Beginnings that no node has go, and with them the searched texts that need not be compared.
    known = {r["start"] for r in texts.select(F.explode(F.transform("at", lambda i: run(i, 3))).alias("start")).distinct().collect()}
    long = {k: sorted(some & known) for k, some in sorted(long.items()) if some & known}
    starts = sorted(known)

    def longer(k: int, some: list[str]):
        """The runs of k characters at places where one of the given beginnings stands."""
        fits = lambda i: i <= F.length("text") - (k - 1)
        mine = F.filter("at", lambda i: fits(i) & run(i, 3).isin(some)) if len(some) < len(starts) else F.filter("at", fits)
        return F.transform(mine, lambda i: run(i, k))

    short = [F.filter(F.transform(places(k), lambda i: run(i, k)), lambda g: g.isin(by_length[k])) for k in (1, 2) if k in by_length]
    found = short + [longer(k, some) for k, some in long.items()]
    if not found:
        return texts.select(F.lit("").alias("query"), "id").where(F.lit(False))
    live = asked.where((F.col("k") < 3) | F.col("start").isin(starts)).select("query")
    each = texts.select(F.explode(F.array_distinct(F.concat(*found))).alias("query"), "id")
    return each.join(broadcast_if_small(live, 500_000), "query").select("query", "id")
