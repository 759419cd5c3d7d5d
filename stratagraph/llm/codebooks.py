"""Vector code compression: product codebooks, searched by annular norm pruning.

Each part of a vector goes to the nearest entry of its position's codebook. Entries are sorted by norm. By the triangle
inequality an entry nearer than the best distance so far has a norm within that distance of the part's own, so a binary
search gives the interval of entries that may win, ends included, and only those are compared, in exact integers. The
search starts from the entries whose norms lie next to the part's.

A round is one pass over the table: tasks sum the parts of each entry, Spark adds the sums up, and the driver replaces at
most parts * entries codebook rows. Nothing but that fixed-size table goes to the tasks, and no vector is shuffled.

Edge cases: vectors that are null or hold a null, NaN or infinite component are dropped. The length is the most frequent one
that the parts divide (ties: the smaller), or the one that is given; rows of another length, and rows with a component of
2**24 or more after scaling (beyond exact 64-bit errors), stay with null code and error. Repeated ids and rows stay and are
coded alike; ids that tie for the codebook's start go by the smaller vector, null ids last. Ties between entries go to the
lower index; fewer vectors than entries make shorter codebooks; an empty table gives no rows. Null labels count as one label.
A label's error beyond 64 bits is null. Very long vectors are coded in one row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_totals, gentle, keep
from .lloyd import finite, matrix, scaled

#: Integers from here on are beyond exact 64-bit errors.
BEYOND = 1 << 24
#: Pairs of a part and an entry that are compared at a time.
PAIRS = 1 << 18
#: Entries on either side of a part's norm that give the first best distance.
START = 4
_FAR = np.iinfo(np.int64).max


class Ring:
    """One codebook, its entries sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt(np.einsum("ij,ij->i", entries, entries).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.order], norms[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each part's nearest entry, and how many pairs were compared."""
        norm = np.sqrt(np.einsum("ij,ij->i", parts, parts).astype(np.float64))
        place = np.searchsorted(self.norms, norm)
        best = np.full(len(parts), _FAR)
        for step in range(-START, START):  # the entries next to the part's own norm give the best distance so far
            d = parts - self.entries[np.clip(place + step, 0, len(self.norms) - 1)]
            best = np.minimum(best, np.einsum("ij,ij->i", d, d))
        radius = np.sqrt(best.astype(np.float64))
        slack = (norm + radius) * 1e-12 + 1e-12  # roots are rounded; the ends belong to the ring
        low = np.searchsorted(self.norms, norm - radius - slack, "left")
        size = np.searchsorted(self.norms, norm + radius + slack, "right") - low
        index, distance, ends = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64), np.cumsum(size)
        at = 0
        while at < len(parts):
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
            n = size[at:to]
            start = np.cumsum(n) - n
            row = np.repeat(np.arange(at, to), n)
            entry = np.repeat(low[at:to] - start, n) + np.arange(len(row))
            d = parts[row] - self.entries[entry]
            d = np.einsum("ij,ij->i", d, d)
            distance[at:to] = np.minimum.reduceat(d, start)
            index[at:to] = np.minimum.reduceat(np.where(d == distance[row], self.order[entry], len(self.order)), start)
            at = to
        return index, distance, int(size.sum())


def _split(b, books) -> list[np.ndarray]:
    """The parts of a batch of vectors, by position."""
    width = sum(x.shape[1] for x in books)
    return np.split(matrix(b.column("x"), width), len(books), axis=1)


def _sums(books: list[np.ndarray]):
    """Of each position and entry: how many parts it has, and their sum."""

    def run(batches):
        rings = [Ring(x) for x in books]
        totals, counts = [np.zeros_like(x) for x in books], [np.zeros(len(x), np.int64) for x in books]
        for b in batches:
            for p, parts in enumerate(_split(b, books)):
                index = rings[p].nearest(parts)[0]
                np.add.at(totals[p], index, parts)
                counts[p] += np.bincount(index, minlength=len(books[p]))
        rows = [(p, e, int(counts[p][e]), totals[p][e].tolist()) for p in range(len(books)) for e in range(len(books[p])) if counts[p][e]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches):
        rings = [Ring(x) for x in books]
        hexes = np.asarray([f"{i:02x}" for i in range(max(len(x) for x in books))], dtype=object)
        for b in batches:
            code, error = np.full(b.num_rows, "", dtype=object), np.zeros(b.num_rows, np.int64)
            for p, parts in enumerate(_split(b, books)):
                index, distance, _ = rings[p].nearest(parts)
                code, error = code + hexes[index], error + distance
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, type=pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _length(vectors: DataFrame, parts: int) -> int | None:
    sizes = vectors.where(finite("embedding")).groupBy(F.size("embedding").alias("size")).count()
    row = sizes.where((F.col("size") > 0) & (F.col("size") % parts == 0)).orderBy(F.desc("count"), "size").first()
    return row["size"] if row else None


def encode(vectors: DataFrame, *, parts: int = 16, entries: int = 64, scale: int = 256, rounds: int = 2, length: int | None = None) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector.

    A codebook starts as the position's parts of the vectors with the smallest ids. Each round assigns all parts and replaces
    each entry that is used by the floor of its parts' mean; then the parts are assigned once more."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    usable = gentle(vectors).select("vec_id", "embedding", "label").where(finite("embedding"))
    length = length or _length(usable, parts)
    usable = usable.select("vec_id", "label", F.when(F.size("embedding") == (length or -1), scaled("embedding", scale, BEYOND)).alias("x"))
    whole, kind = usable.where("x is not null"), dict(usable.dtypes)
    first = np.asarray([r["x"] for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()], dtype=np.int64)
    other = usable.where("x is null").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not len(first):
        return other.withColumns({"label_error": F.lit(None).cast("long"), "codebooks_sha256": F.lit(None).cast("string")})
    books = np.split(first, parts, axis=1)
    width = books[0].shape[1]
    for _ in range(rounds):
        sums = whole.select("x").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        exact = lambda c: F.sum(c.cast("decimal(38,0)"))
        total = sums.groupBy("part", "entry").agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
        new = [x.copy() for x in books]
        for row in total.collect():  # at most parts * entries rows
            new[row["part"]][row["entry"]] = [int(s) // int(row["n"]) for s in row["sums"]]
        books = new
    digest = hashlib.sha256(",".join(str(v) for x in books for v in x.ravel().tolist()).encode()).hexdigest()
    coded = whole.mapInArrow(_codes(books), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")
    coded = keep(coded.unionByName(other))
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("n"))
    return attach_totals(coded, totals, "label", "n").withColumn("codebooks_sha256", F.lit(digest))
