"""SimHash near duplicates by anchor points of a covering code.

A fingerprint's bits are cut into parts; two fingerprints that differ in at most `threshold` bits differ in at most
threshold // parts bits of some part. The anchors of a part are the words of a product of perfect Hamming codes and of plain
bits, so each word has one nearest anchor, its home, at most the covering radius away (one bit a code). A fingerprint is
replicated to every anchor within covering radius plus the part's threshold, and at each anchor the fingerprints at home are
compared with all replicas, over all 64 bits. So no link is missed: whoever lies within the threshold of a fingerprint has a
replica at its home.

Work stays off the square of a group. Equal fingerprints are one entry. First the members of each home meet only its
heaviest fingerprint, and what links is one component; then only fingerprints of different components are compared, against
the most frequent component of an anchor only by those outside it, and only pairs of components come out. Homes with many
members are dealt in blocks, each of which meets the anchor's replicas as a stream.

Edge cases: null, empty and blank texts have the fingerprint zero, which links like any other; texts of fewer than `width`
words have one shingle, the whole sequence; a bit that exactly half the shingles set is 0. Very long texts are hashed whole,
some thousand shingles at a time; memory follows the longest text. Repeated rows and ids keep their rows, each with its own
text's fingerprint. A row without doc_id has a fingerprint, links others and gets their component_id, which is null where a
class holds no id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_totals, cut, gentle, keep, map_frames
from .components import components

#: Codes as parts of (first bit, length, plain): Hamming codes of that length (2 ** m - 1), or plain bits, which are their own
#: anchors. A coarse code has fewer replicas, a fine one fewer comparisons.
COARSE = [[(0, 15, False), (15, 7, True)], [(22, 15, False), (37, 6, True)], [(43, 15, False), (58, 6, True)]]
FINE = [[(0, 31, False), (31, 1, True)], [(32, 31, False), (63, 1, True)]]
#: From so many different fingerprints on, the coarse code's comparisons outweigh the fine one's replicas.
FINE_FROM = 1 << 26
#: Fingerprints at home that a task compares with a stream of replicas, and replicas compared at a time.
BLOCK, STREAM = 4096, 1024
#: Links of one anchor that a task remembers, to give no link twice.
REMEMBERED = 1_000_000
_ONE = np.uint64(1)


def _bits(first: int, length: int) -> np.uint64:
    return np.uint64(((1 << length) - 1) << first)


def decode(words: np.ndarray, part) -> np.ndarray:
    """The nearest anchor of each word: the bits of the part, each Hamming block corrected by its syndrome."""
    out = np.zeros_like(words)
    for first, length, plain in part:
        block = words & _bits(first, length)
        if not plain:
            syndrome = np.zeros(words.shape, np.uint64)
            for j in range(length.bit_length()):
                check = sum(1 << (first + i) for i in range(length) if (i + 1) >> j & 1)
                syndrome |= (np.bitwise_count(block & np.uint64(check)).astype(np.uint64) & _ONE) << np.uint64(j)
            shift = np.uint64(first) + np.maximum(syndrome, _ONE) - _ONE
            block = block ^ np.where(syndrome > 0, _ONE << shift, np.uint64(0))
        out |= block
    return out


def _errors(part, most: int) -> np.ndarray:
    """All patterns of at most `most` bits of a part."""
    bits = [_ONE << np.uint64(first + i) for first, length, _ in part for i in range(length)]
    found = [np.zeros(1, np.uint64)]
    for _ in range(most):
        found.append(np.unique(np.bitwise_xor.outer(np.concatenate(found), np.asarray(bits))))
    return np.unique(np.concatenate(found))


def replicas(words: np.ndarray, part, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, anchor) of every anchor within covering radius plus `most` of a word.

    With perfect codes these are the homes of the words within `most`."""
    anchors = np.sort(decode(words[:, None] ^ _errors(part, most)[None, :], part), axis=1)
    fresh = np.ones(anchors.shape, dtype=bool)
    fresh[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
    return np.nonzero(fresh)[0], anchors[fresh]


def fingerprint(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - width + 1, 1)
    starts, ends, counts = starts[:n], ends[-n:], np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        spans = zip(starts[at : at + 8192].tolist(), ends[at : at + 8192].tolist())
        hashes = np.asarray([xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((_ONE << np.arange(64, dtype=np.uint64))[2 * counts > n]).sum(dtype=np.uint64))


def simhash(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row, the 64 bits as a signed long."""

    def run(frames):
        for f in frames:
            prints = np.asarray([fingerprint(t, width) for t in f["text"]], dtype=np.uint64)
            yield {"doc_id": f["doc_id"], "fp": prints.view(np.int64)}

    return map_frames(gentle(docs).select("doc_id", F.col("text").cast("binary").alias("text")), run, "doc_id long, fp long")


def _homes(code):
    """A row for each part: the home of each fingerprint."""

    def run(frames):
        for f in frames:
            fp = f["fp"].to_numpy(np.int64)
            anchors = np.concatenate([decode(fp.view(np.uint64), part) for part in code]).view(np.int64)
            yield {"part": np.repeat(np.arange(len(code)), len(fp)), "anchor": anchors, "fp": np.tile(fp, len(code)), "n": np.tile(f["n"].to_numpy(np.int64), len(code))}

    return run


def _entries(code, most: int):
    """A row for each replica; the one at home is marked."""

    def run(frames):
        for f in frames:
            fps, labels = f["fp"].to_numpy(np.int64), f["label"].to_numpy(np.int64)
            step = max(1, (1 << 18) // len(_errors(code[0], most)))
            for at in range(0, len(fps), step):
                fp, label = fps[at : at + step], labels[at : at + step]
                for p, part in enumerate(code):
                    row, anchor = replicas(fp.view(np.uint64), part, most)
                    home = anchor == decode(fp.view(np.uint64), part)[row]
                    yield {"part": np.full(len(row), p), "anchor": anchor.view(np.int64), "fp": fp[row], "label": label[row], "home": home}

    return run


class _Joined:
    """Which components an anchor has linked so far; gives each link that is news."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def add(self, pairs) -> list[tuple[int, int]]:
        if len(self.parent) > REMEMBERED:
            self.parent = {}
        new = []
        for a, b in pairs:
            ra, rb = self.find(a), self.find(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                new.append((a, b))
        return new


def _linked(homes, home_labels, fps, labels, threshold: int):
    """Pairs of labels that a home and a replica link."""
    found = []
    for at in range(0, len(homes), STREAM):
        near = np.bitwise_count(homes[at : at + STREAM, None] ^ fps[None, :]) <= threshold
        i, j = np.nonzero(near)
        pairs = np.stack([home_labels[at + i], labels[j]], axis=1)
        found.append(pairs[pairs[:, 0] != pairs[:, 1]])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _compare(threshold: int):
    """Over rows sorted by (part, anchor, slot), a slot's fingerprints at home before the replicas."""

    def groups(frames):
        """(key, home fps, home labels, replica chunks) runs: a batch cut where the key changes."""
        for f in frames:
            part, anchor, slot = (f[c].to_numpy(np.int64) for c in ("part", "anchor", "slot"))
            change = np.flatnonzero((np.diff(part) != 0) | (np.diff(anchor) != 0) | (np.diff(slot) != 0)) + 1
            home, fp, label = f["home"].to_numpy(bool), f["fp"].to_numpy(np.int64).view(np.uint64), f["label"].to_numpy(np.int64)
            for a, b in zip([0, *change], [*change, len(part)]):
                yield (part[a], anchor[a], slot[a]), home[a:b], fp[a:b], label[a:b]

    def run(frames):
        key, at_home, joined, common = None, [], None, None
        for now, home, fp, label in groups(frames):
            if now != key:
                key, at_home, joined, common = now, [], _Joined(), None
            if home.any():
                at_home.append((fp[home], label[home]))
                common = None
            if home.all():
                continue
            if common is None and at_home:
                at_home = [tuple(np.concatenate(x) for x in zip(*at_home))]
                values, counts = np.unique(at_home[0][1], return_counts=True)
                common = values[np.argmax(counts)]
            if not at_home:
                continue
            (homes, home_labels), fp, label = at_home[0], fp[~home], label[~home]
            inside, outside = home_labels == common, label != common
            links = [_linked(homes[~inside], home_labels[~inside], fp, label, threshold), _linked(homes[inside], home_labels[inside], fp[outside], label[outside], threshold)]
            new = joined.add(np.concatenate(links).tolist())
            if new:
                yield {"a": [x[0] for x in new], "b": [x[1] for x in new]}

    return run


def near_fingerprints(fps: DataFrame, threshold: int = 4, fine_from: int = FINE_FROM, block: int = BLOCK) -> DataFrame:
    """(fp, component) of distinct fingerprints (fp, n: their rows): components of links at `threshold` or fewer differing bits,
    named by their smallest fingerprint."""
    gentle(fps)
    code = COARSE if fps.count() < fine_from else FINE
    most = threshold // len(code)
    homes = map_frames(fps.select("fp", "n"), _homes(code), "part int, anchor long, fp long, n long")
    heads = homes.groupBy("part", "anchor").agg(F.max_by("fp", F.struct("n", "fp")).alias("head"), F.count("*").alias("members"))
    heads = keep(heads.where("members > 1"))
    stars = homes.join(heads.select("part", "anchor", "head"), ["part", "anchor"])
    stars = stars.where((F.col("fp") != F.col("head")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= threshold))
    first = keep(components(stars.select(F.col("fp").alias("a"), F.col("head").alias("b"))))
    labelled = fps.join(first.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"))

    entries = map_frames(labelled, _entries(code, most), "part int, anchor long, fp long, label long, home boolean")
    large = cut(heads.where(F.col("members") > block).select("part", "anchor", F.ceil(F.col("members") / block).cast("int").alias("slots")))
    if large.take(1):
        entries = entries.join(large, ["part", "anchor"], "left")
        slots = F.coalesce("slots", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), slots).cast("int")
        at = F.when(F.col("home"), F.array(own)).otherwise(F.array().cast("array<int>"))
        # A replica goes to every block; a fingerprint at home is also a replica there, for the others at home.
        rows = entries.select("part", "anchor", "fp", "label", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), at.alias("at"), "home")
        both = F.array(F.lit(False), F.lit(True))
        rows = rows.select("part", "anchor", "slot", "fp", "label", F.explode(F.when(F.col("home") & F.array_contains("at", F.col("slot")), both).otherwise(F.slice(both, 1, 1))).alias("home"))
    else:
        both = F.array(F.lit(False), F.lit(True))
        rows = entries.select("part", "anchor", F.lit(0).alias("slot"), "fp", "label", F.explode(F.when(F.col("home"), both).otherwise(F.slice(both, 1, 1))).alias("home"))
    dealt = rows.repartition("part", "anchor", "slot").sortWithinPartitions("part", "anchor", "slot", F.desc("home"))
    links = keep(map_frames(dealt, _compare(threshold), "a long, b long"))
    second = components(links).select(F.col("id").alias("label"), "component")
    return labelled.join(second, "label", "left").select("fp", F.coalesce("component", "label").alias("component"))


def simhash_classes(docs: DataFrame, width: int = 4, threshold: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = keep(simhash(docs, width))
    fps = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    named = keep(fps.join(near_fingerprints(fps, threshold), "fp"))
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    totals = keep(attach_totals(named, least, "component", "members").select("fp", "n", "component_id"))
    return attach_totals(prints, totals, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
