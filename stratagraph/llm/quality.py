"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes 1 (good), -1 (bad) or 0 (abstains). Spark counts the documents of each combination of votes (at most
3 ** rules rows, whatever the corpus), and expectation-maximisation on those counts estimates, without labels, how often
each rule votes either way or abstains on good and on bad documents, and the share of good documents. The posterior that
a document is good is then a sum of log odds, which Spark evaluates with the weights as literals: a bad vote of a rule
that errs often can be outweighed, and several abstentions can reject a document without any bad vote.

Two base conditions reject by themselves. The rules' rates are those of the documents that pass the base; among all
documents the two classes would settle on whether a text repeats itself, which the base decides already.

Edge cases: null and empty texts have no words, so they fail the base; very long texts are measured whole, in one row; a
rule whose measure is undefined abstains; rows without doc_id are judged too; repeated rows are judged alike; a posterior
equal to the threshold keeps; an empty table gives no rows; other columns are ignored, and none of the measures' names
reaches the output of `keep_good`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_GAP = r"[ \t\n\x0B\f\r]"
#: Rules: measure, bad below, good from, good to, bad above. Between good and bad a rule abstains.
RULES = {
    "length": ("n_words", 10, 20, None, None),
    "word_length": ("word_chars / n_words", 3.0, 3.6, 7.0, 9.0),
    "symbols": ("n_symbols / n_words", None, 0, 0.05, 0.3),
    "lines": ("n_dup_lines / n_lines", None, 0, 0.1, 0.3),
    "repeats": ("n_repeat_words / n_words", None, 0, 0.1, 0.2),
    "variety": ("n_distinct / sqrt(n_words)", 1.5, 3.0, None, None),
    "digits": ("n_digits / word_chars", None, 0, 0.1, 0.3),
    "letters": ("n_letters / word_chars", 0.7, 0.9, None, None),
}


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a run of `width` words found twice or more in the array.

    Runs are hashed; only where two hashes agree are they sorted by hash to find the places, and the places are then
    merged in order."""

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def places(pairs: Column) -> Column:
        again = lambda p, k: (p["g"] == F.get(pairs, k - 1)["g"]) | (p["g"] == F.get(pairs, k + 1)["g"])
        at = F.transform(pairs, lambda p, k: F.when(F.coalesce(again(p, k), F.lit(False)), p["i"]))
        return F.sort_array(F.array_compact(at))

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(let(pairs, places), covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width, 0).otherwise(let(let(hashed, grams), count)).cast("long")


def _not_null_or(a: Column) -> Column:
    return F.coalesce(a, F.lit(False))


def measures(docs: DataFrame) -> DataFrame:
    """The columns of docs as struct `row`, and the measures of its text."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    words = F.array_remove(F.split(text, _GAP + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    counted = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"))
    per_line = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    out = out.select("row", let(words, counted).alias("w"), let(lines, per_line).alias("l"), kept(_GAP + "+").alias("word_chars"), kept(r"[^#*$%&|<>]+").alias("n_symbols"), kept(r"[^0-9]+").alias("n_digits"), kept(r"[^\p{L}]+").alias("n_letters"))
    return out.select("row", "w.*", "l.*", "word_chars", "n_symbols", "n_digits", "n_letters")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> dict[str, Column]:
    out = {}
    for name, (measure, *limits) in RULES.items():
        if " / " in measure:
            above, below = measure.split(" / ")
            measure = f"{above} / nullif({below}, 0)"
        x, (bad_below, good_from, good_to, bad_above) = F.expr(measure), limits
        bad, good = F.lit(False), x.isNotNull()
        for limit, over in ((bad_below, False), (bad_above, True)):
            if limit is not None:
                bad = bad | ((x > limit) if over else (x < limit))
        for limit, over in ((good_from, False), (good_to, True)):
            if limit is not None:
                good = good & ((x <= limit) if over else (x >= limit))
        out[name] = F.when(_not_null_or(bad), -1).when(_not_null_or(good), 1).otherwise(0)
    return out


#: Made-up documents of each class that count beside the real ones: their votes, in the order bad, abstained, good.
PRIOR = {True: (0.5, 0.5, 2.0), False: (2.0, 0.5, 0.5)}
#: Accuracy of every rule in the first guess.
START = 0.7

#: Share of good documents, and for each rule the rates of bad votes, abstentions and good votes in good and in bad ones.
Model = tuple[float, list[tuple[float, ...]], list[tuple[float, ...]]]


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> Model:
    """The latent-class model of votes, from (votes, documents).

    Rules vote independently given the class; each has its own rates of bad votes, abstentions and good votes in either
    class, without bounds. Starts from all rules being equally accurate, so that the majority of votes decides, and adds
    the votes of PRIOR. The class whose rules vote better is called good."""
    n = len(patterns[0][0]) if patterns else len(RULES)
    weights = [1 / (1 + (1 / START - 1) ** sum(vote)) for vote, _ in patterns]
    for _ in range(rounds):
        rates, size = {}, {}
        for good in (True, False):
            parts = [docs * (w if good else 1 - w) for w, (_, docs) in zip(weights, patterns)]
            size[good] = sum(parts) + sum(PRIOR[good])
            cast = [list(PRIOR[good]) for _ in range(n)]
            for part, (vote, _) in zip(parts, patterns):
                for j, v in enumerate(vote):
                    cast[j][v + 1] += part
            rates[good] = [tuple(x / size[good] for x in c) for c in cast]
        model: Model = (size[True] / (size[True] + size[False]), rates[True], rates[False])
        new = [posterior(vote, model) for vote, _ in patterns]
        moved = max((abs(x - y) for x, y in zip(new, weights)), default=0.0)
        weights = new
        if moved < 1e-9:
            break
    if sum(r[2] - r[0] for r in model[1]) < sum(r[2] - r[0] for r in model[2]):
        model = (1 - model[0], model[2], model[1])
    return model


def _evidence(model: Model) -> list[tuple[float, ...]]:
    """Log odds of good that each rule's bad vote, abstention and good vote add."""
    return [tuple(math.log(g / b) for g, b in zip(*rates)) for rates in zip(model[1], model[2])]


def posterior(vote, model: Model) -> float:
    odds = math.log(model[0] / (1 - model[0])) + sum(e[v + 1] for v, e in zip(vote, _evidence(model)))
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def fit(measured: DataFrame) -> Model:
    """The model of the documents that pass the base; the others are rejected whatever their votes."""
    rules = votes()
    counts = measured.where(~base_failed()).groupBy(*[v.alias(k) for k, v in rules.items()]).count().collect()
    return expectation_maximisation(sorted((tuple(r[k] for k in rules), r["count"]) for r in counts))


def quality_probability(model: Model) -> Column:
    odds = F.lit(math.log(model[0] / (1 - model[0])))
    for vote, (bad, none, good) in zip(votes().values(), _evidence(model)):
        odds = odds + F.when(vote < 0, bad).when(vote > 0, good).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, measures, base_failed, quality, kept) of each row."""
    measured = measures(docs.select("doc_id", "text"))
    measured = cut(measured.select(F.col("row.doc_id").alias("doc_id"), *[c for c in measured.columns if c != "row"]))
    quality = quality_probability(fit(measured))
    out = measured.withColumn("base_failed", base_failed()).withColumn("quality", quality)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    measured = measures(docs)
    return measured.where(~base_failed() & (quality_probability(fit(measured)) >= threshold)).select("row.*")
