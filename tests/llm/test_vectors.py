"""Centroids, codebooks and fingerprints against brute force, with nulls, odd vectors, ties, repeated rows and empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratagraph.llm import codebooks, common, lloyd, simhash

VECTORS = "vec_id long, embedding array<double>, label int, x string, n long, owner string"
DOCS = "doc_id long, text string, fp string, n string, label string"


def usable(v, length=None):
    return v is not None and (length is None or len(v) == length) and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return tuple(math.floor(scale * x) for x in v)


def odd_rows(rng, width):
    """Rows that are dropped or set apart, ties, copies and repeated rows."""
    vec = lambda: [rng.uniform(-1, 1) for _ in range(width)]
    hot, other = vec(), vec()
    rows = [(i, vec(), i % 4) for i in range(60)] + [(100 + i, hot, None) for i in range(30)] + [(200, other, 1)] * 3
    rows += [(300, None, 1), (301, [], 1), (302, [None] + vec()[1:], 1), (303, [math.nan] + vec()[1:], 2), (304, [math.inf] + vec()[1:], 2), (305, vec()[1:], 1)]
    rows += [(None, vec(), 3), (7, vec(), 3), (7, vec(), None), (2**60, vec(), 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", -1, "o") for r in rows], VECTORS).repartition(3)


def plain_lloyd(rows, length, scale, k, rounds):
    kept = [(i, floors(v, scale)) for i, v, _ in rows if usable(v, length)]
    inside = [v for _, v in kept if all(abs(c) < lloyd.BEYOND for c in v)]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept if v in inside)
    cents = [v for _, v in order[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for v in inside]
        cents = [tuple(sum(col) // own.count(j) for col in zip(*[v for v, o in zip(inside, own) if o == j])) if j in own else c for j, c in enumerate(cents)]
    found = [(i, *(near(v) if v in inside else (None, None))) for i, v in kept]
    whole = sum(d for _, d, _ in found if d is not None)
    of = {j: sum(d for _, d, o in found if o == j) for j in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, o, d, of[o], whole, sha[o]) if o is not None else (i, None, None, None, None, None) for i, d, o in found), key=repr)


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 0), (200, 2)])
def test_delta_lloyd(spark, k, rounds):
    rng = random.Random(k)
    rows = odd_rows(rng, 6) + [(400, [3e5, *[0.0] * 5], 1)]
    got = lloyd.delta_lloyd(frame(spark, rows), length=6, k=k, rounds=rounds, buckets=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lloyd(rows, 6, 1024, k, rounds)


def test_delta_lloyd_of_few(spark):
    assert lloyd.delta_lloyd(frame(spark, [])).collect() == []
    one = lloyd.delta_lloyd(frame(spark, [(1, [0.5, -0.001], 0)]), length=2).collect()
    assert [tuple(r)[:3] for r in one] == [(1, 0, 0)]
    assert [tuple(r)[:2] for r in lloyd.delta_lloyd(frame(spark, [(1, [1e300, 0.0], 0)]), length=2).collect()] == [(1, None)]


def test_compare_only_what_moved():
    """A step from held distances equals a comparison of everything, ties included."""
    rng = np.random.default_rng(3)
    x, old = rng.integers(-3, 4, (400, 3)), rng.integers(-3, 4, (5, 3))
    owner, distance = lloyd._compare(x, np.full(400, -1), np.zeros(400, np.int64), old, np.ones(5, bool))
    for moved in ([1], [0, 4], [2, 3], []):
        new, flags = old.copy(), np.zeros(5, bool)
        new[moved], flags[moved] = rng.integers(-3, 4, (len(moved), 3)), True
        d = ((x[:, None, :] - new[None]) ** 2).sum(axis=2)
        who, best = lloyd._compare(x, owner, distance, new, flags)
        assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def plain_codes(rows, parts, entries, rounds, length):
    kept = [(i, floors(v, 256), lab) for i, v, lab in rows if usable(v)]
    whole = [r for r in kept if len(r[1]) == length and all(abs(c) < codebooks.BEYOND for c in r[1])]
    start = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = length // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(r[1], p) for r in start] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [near(r[1], p)[1] for r in whole]
            new.append([tuple(sum(col) // own.count(j) for col in zip(*[cut(r[1], p) for r, o in zip(whole, own) if o == j])) if j in own else e for j, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for r in kept:
        found = [near(r[1], p) for p in range(parts)] if r in whole else None
        out.append((r[0], r[2], found and "".join(f"{j:02x}" for _, j in found), found and sum(d for d, _ in found)))
    of = {lab: sum(r[3] for r in out if r[1] == lab and r[3] is not None) for lab in {r[1] for r in out}}
    return sorted(((*r, of[r[1]], sha) for r in out), key=repr)


@pytest.mark.parametrize("entries", [64, 5])
def test_codes(spark, entries):
    rows = odd_rows(random.Random(entries), 8) + [(401, [1e6, *[0.0] * 7], 1)]
    got = codebooks.encode(frame(spark, rows), parts=4, entries=entries)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows, 4, entries, 2, 8)


def test_codes_of_few(spark):
    assert codebooks.encode(frame(spark, [])).collect() == []
    assert [r["code"] for r in codebooks.encode(frame(spark, [(1, [1.0, 2.0], 0), (2, [0.0], 0)]), parts=2).collect()] in (["0000", None], [None, "0000"])
    assert [r["code"] for r in codebooks.encode(frame(spark, [(1, [1.0] * 3, 0)])).collect()] == [None]


def test_ring_is_exact_and_prunes():
    rng = np.random.default_rng(5)
    entries = np.concatenate([rng.integers(-300, 300, (50, 4)), np.zeros((4, 4), np.int64), [[3, 4, 0, 0], [5, 0, 0, 0], [0, 5, 0, 0]]]).astype(np.int64)
    parts = np.concatenate([rng.integers(-300, 300, (3000, 4)), entries, [[0, 0, 0, 5], [1 << 23, -(1 << 23), 0, 1]]]).astype(np.int64)
    index, distance, pairs = codebooks.Ring(entries).nearest(parts)
    d = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all() and pairs < 0.95 * d.size


def test_totals_of_many_keys(spark, monkeypatch):
    """Beyond the broadcast bound only hot keys are broadcast; nulls are one key."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    keys = [None] * 10 + [1] * 8 + [2, 3, 4, 5]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k int")
    totals = rows.groupBy("k").agg(F.sum("id").alias("total"), F.count("*").alias("n"))
    got = common.attach_totals(rows, totals, "k", "n")
    assert sorted(map(tuple, got.collect())) == [(i, k, sum(j for j, o in enumerate(keys) if o == k)) for i, k in enumerate(keys)]


# Fingerprints


def plain_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(len(words) - width + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, threshold):
    """The smallest index that links reach from each."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_anchors_cover():
    """Every word has an anchor within the covering radius, and all words within the threshold of it meet it there."""
    rng = np.random.default_rng(2)
    words = rng.integers(-(1 << 63), 1 << 63, 40).view(np.uint64)
    for code, most in ((simhash.COARSE, 1), (simhash.FINE, 2), (simhash.COARSE, 2)):
        assert sorted(first + i for part in code for first, length, _ in part for i in range(length)) == list(range(64))
        for part in code:
            mask = sum((1 << length) - 1 << first for first, length, _ in part)
            home = simhash.decode(words, part)
            radius = sum(not plain for _, _, plain in part)
            assert (simhash.decode(home, part) == home).all() and (np.bitwise_count(home ^ (words & np.uint64(mask))) <= radius).all()
            near = words ^ rng.choice(simhash._errors(part, most), len(words))
            row, anchor = simhash.replicas(near, part, most)
            met = set(zip(row.tolist(), anchor.tolist()))
            assert all((i, a) in met for i, a in enumerate(home.tolist()))
            assert (np.bitwise_count((near & np.uint64(mask))[row] ^ anchor) <= radius + most).all()


@pytest.mark.parametrize("fine_from, block", [(1 << 26, 4096), (1, 4096), (1 << 26, 3)])
def test_near_fingerprints(spark, fine_from, block):
    rng = random.Random(11)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(6)):  # chains whose links differ in 3 to 6 bits
            values.add(v)
            for b in rng.sample(range(64), rng.randint(3, 6)):
                v ^= 1 << b
    dense = rng.getrandbits(64)
    values |= {dense ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(150)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    rows = spark.createDataFrame([(v, 1) for v in values], "fp long, n long").repartition(3)
    got = dict(map(tuple, simhash.near_fingerprints(rows, fine_from=fine_from, block=block).collect()))
    want = classes([v & (1 << 64) - 1 for v in values], 4)
    assert [got[v] for v in values] == [values[w] for w in want]


def test_simhash_classes(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(40)) for _ in range(n))
    base = prose(300)
    texts = [prose(rng.randint(1, 60)) for _ in range(40)] + [base] * 20 + [None, "", " \n\t", "one Two", "ONE two", "one two three four", "Grüße 漢字 É é É é"]
    for k in range(25):
        words = base.split()
        words[rng.randrange(300)] = f"new{k}"
        texts.append(" ".join(words))
    texts.append(prose(9000) + " " + base)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "another text of a repeated id"), (3, texts[3]), (2**60, base), (None, base), (None, "alone without any id at all")]
    got = simhash.simhash_classes(spark.createDataFrame([(*r, "f", "n", "l") for r in rows], DOCS).repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [plain_print(t) for _, t in order]
    want = [(i, f"{p:016x}", order[c][0]) for (i, _), p, c in zip(order, prints, classes(prints, 4))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.simhash_classes(spark.createDataFrame([], DOCS)).collect() == []
