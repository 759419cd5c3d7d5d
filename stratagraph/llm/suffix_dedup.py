"""Suffix-array deduplication of byte passages across a whole corpus.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or earlier in the same
document). That is where the longest-previous-factor (LPF) array is at least `length`: for a suffix, the previous and
next smaller positions in suffix order give its longest earlier match.

One suffix array over a corpus doesn't distribute, so suffixes are dealt by content. Every window of `length` bytes is
keyed by its smallest 32-gram hash; equal windows have equal keys, so all matches of a window meet at one key. Runs of
windows with one key make a segment:

1. Segments whose key occurs once in the corpus have no match (but for those that repeat in themselves, which are marked)
   and are left out before any text moves.
2. Of equal segments (equal in key, size and a further 56 bits of hash) all but the first are later copies as a whole:
   their LPF is their length. Counts combine before the shuffle, so thousands of copies cost a row each and no bytes.
3. The first occurrences of different segments at one key are gathered with their bytes; those with no window hash that
   occurs twice are left out. Prefix doubling ranks the suffixes and gives the LCP array, previous and next smaller
   positions in that order give the LPF array, and every factor of `length` bytes or more is cut out.
4. Keys with more than `hot` different segments are re-dealt by whole window, where equal windows collapse to a minimum;
   so no task ever holds an unbounded key.

Edge cases: null and empty texts have no bytes and stay; texts shorter than `length` stay as they are; equal texts keep
the row with the smallest doc_id; rows that repeat id and text are one document, and none of them is removed for another;
different texts of one doc_id are documents of their own, in the order of a hash of theirs; rows without doc_id stay whole
and take no part; other columns are ignored. A very long text is scanned in one task, at some 60 bytes of memory a byte.

Positions are 64-bit: the low half is the place in a text, the high half tells the texts of one doc_id apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import broadcast_if_small
from .common import as_bytes, columns, cut, gentle, keep, map_frames, mix, repeated_ids, text_hash

GRAM = 32
#: Bits of a position within its text, and their mask.
_PLACE, _TEXT = 32, (1 << 32) - 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_CHUNK, _BATCH = 1 << 16, 1 << 18


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _M1
    x += right
    x ^= x >> np.uint64(29)
    x *= _M2
    return x


def _hashes(arr: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 32-grams and of all windows."""
    powers, h, width = {}, _BYTE[arr], 1
    powers[width] = h
    while 2 * width <= length and len(h):
        h, width = _join(h[: max(len(h) - width, 0)], h[width:]), 2 * width
        powers[width] = h
    n = max(len(arr) - length + 1, 0)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    window, at = np.zeros(n, np.uint64), 0
    for w in sorted(powers, reverse=True):
        if length - at >= w:
            window = _join(window * _M3, powers[w][at : at + n])
            at += w
    return powers[GRAM], window


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    have, out = 1, h
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _segments(ids: np.ndarray, base: np.ndarray, blobs: list[bytes], length: int) -> pd.DataFrame:
    arr = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    sizes = np.array([len(b) for b in blobs], dtype=np.int64)
    ends = np.cumsum(sizes)
    gram, window = _hashes(arr, length)
    if not len(window):
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("key", "sig", "doc_id", "pos", "own")})
    key = _smallest(gram, length - GRAM + 1)
    doc = np.repeat(np.arange(len(blobs)), sizes)[: len(window)]
    at = np.flatnonzero(np.arange(length, length + len(window)) <= ends[doc])
    if not len(at):
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("key", "sig", "doc_id", "pos", "own")})
    k = key[at]
    start = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)) + 1))
    n = np.diff(start, append=len(at))
    if n.max() > length:  # a segment's first and last window must cover it
        parts = -(-n // length)
        first = np.repeat(start, parts) + length * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        start, n = first, np.minimum(length, np.repeat(start + n, parts) - first)
    p = at[start]
    sig = mix(window[p] * _M1 + window[p + n - 1] * _M3 + n.astype(np.uint64))
    sig = (sig >> np.uint64(8) << np.uint64(8)) | n.astype(np.uint64)  # its low byte is n, at most `length`
    d = doc[p]
    return pd.DataFrame({"key": key[p].view(np.int64), "sig": sig.view(np.int64), "doc_id": ids[d], "pos": p - (ends - sizes)[d] + base[d], "own": _own_repeats(gram, key, p, n, length)})


def _own_repeats(gram: np.ndarray, key: np.ndarray, p: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Whether a segment may hold a window twice: then its smallest 32-gram stands at two places in it."""
    width = length - GRAM + 1
    edge = np.zeros(width - 1, np.uint64)
    most = ~_smallest(~np.concatenate((edge, key, edge)), width)  # largest key of the windows over each 32-gram
    anchor = np.flatnonzero(most == gram)
    anchor = anchor[np.argsort(gram[anchor], kind="stable")]
    pair = np.flatnonzero((gram[anchor[1:]] == gram[anchor[:-1]]) & (anchor[1:] - anchor[:-1] < 2 * length))
    if not len(pair):
        return np.zeros(len(p), dtype=np.int64)
    u, v = anchor[pair], anchor[pair + 1]
    near = np.zeros(len(key) + 1, dtype=np.int64)
    np.add.at(near, np.clip(u - width + 1, 0, len(key)), 1)
    np.add.at(near, np.clip(v + 1, 0, len(key)), -1)
    near = np.concatenate(([0], np.cumsum(np.cumsum(near)[:-1] > 0)))
    own = (near[p + n] > near[p]).astype(np.int64)
    at = np.flatnonzero(own)
    own[at] = np.isin(key[p[at]], gram[u])
    return own


def _scan(length: int):
    def run(batches):
        for pdf in batches:
            ids, base, blobs = pdf.doc_id.to_numpy(dtype=np.int64), pdf["sub"].to_numpy(dtype=np.int64) << _PLACE, [as_bytes(t) for t in pdf.text]
            i = 0
            while i < len(blobs):
                j, size = i, 0
                while j < len(blobs) and (j == i or size + len(blobs[j]) < _CHUNK):
                    size += len(blobs[j])
                    j += 1
                yield _segments(ids[i:j], base[i:j], blobs[i:j], length)
                i = j

    return run


def _fetch(length: int):
    """Bytes of the wanted segments of each document."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text, want in zip(pdf.doc_id, pdf.text, pdf.want):
                b = as_bytes(text)
                for w in want if want is not None else ():
                    at = w["pos"] & _TEXT
                    rows.append((w["key"], doc, w["pos"], b[at : at + w["n"] + length - 1], w["hot"]))
            if rows:
                yield columns(rows, "key doc_id pos seg hot")

    return run


def suffix_ranks(arr: np.ndarray, left: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by their first 4, 8, 16, ... bytes, up to `depth` at least, by prefix doubling.

    left: bytes from each position to the end of its own string; what is past the end counts as smallest."""
    unit, first = np.zeros(len(arr) + 3, dtype=np.uint64), np.zeros(len(arr), dtype=np.uint64)
    unit[: len(arr)] = arr.astype(np.uint64) + np.uint64(1)
    for k in range(4):
        first = (first << np.uint64(16)) | np.where(left > k, unit[k : k + len(arr)], np.uint64(0))
    ranks, have = {4: np.unique(first, return_inverse=True)[1] + 1}, 4
    while have < depth:
        rank = ranks[have]
        after = np.zeros_like(rank)
        after[: max(len(rank) - have, 0)] = rank[have:]
        pair = rank * np.int64(len(arr) + 2) + np.where(left > have, after, 0)
        have *= 2
        ranks[have] = np.unique(pair, return_inverse=True)[1] + 1
    return ranks


def shared_prefix(i: np.ndarray, j: np.ndarray, arr: np.ndarray, left: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
    """Bytes that the suffixes at i and at j share: whole powers of two by their ranks, the last few byte by byte."""
    most, out, end = np.minimum(left[i], left[j]), np.zeros(len(i), dtype=np.int64), len(arr) - 1
    for depth in sorted(ranks, reverse=True):
        same = (out < most) & (ranks[depth][np.minimum(i + out, end)] == ranks[depth][np.minimum(j + out, end)])
        out[same] += depth
    for _ in range(3):
        same = (out < most) & (arr[np.minimum(i + out, end)] == arr[np.minimum(j + out, end)])
        out[same] += 1
    return np.minimum(out, most)


def longest_previous(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF of the suffixes in `order` (their positions in suffix order); lcp[i] is shared by order[i - 1] and order[i].

    One stack pass finds the previous and the next smaller position of each suffix and the least lcp in between."""
    lpf = [0] * len(order)
    stack: list[tuple[int, int, int]] = []  # index into order, its position, lcp with the entry below
    for i, (place, common) in enumerate(zip(order.tolist(), lcp.tolist())):
        if not i:
            common = 0
        while stack and stack[-1][1] > place:
            j, _, below = stack.pop()
            if common > lpf[j]:  # place is the next smaller position of order[j]
                lpf[j] = common
            if below < common:
                common = below
        if stack and common > lpf[i]:
            lpf[i] = common
        stack.append((i, place, common))
    return np.array(lpf, dtype=np.int64)


def _with_matches(segs: list[bytes], length: int) -> np.ndarray:
    """Which segments hold a window whose hash another window has too; the others need no place in the suffix array."""
    sizes = np.array([len(s) for s in segs], dtype=np.int64)
    window = _hashes(np.frombuffer(b"".join(segs), dtype=np.uint8), length)[1]
    n = sizes - length + 1
    seg = np.repeat(np.arange(len(segs)), n)
    at = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(n) + n, n) + np.arange(n.sum())
    h = window[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(segs), dtype=bool)
    out[seg[order[1:][same]]] = True
    out[seg[order[:-1][same]]] = True
    return out


def _later(group: list[tuple[np.ndarray, np.ndarray, list[bytes]]], length: int) -> pd.DataFrame:
    """Windows of the gathered segments that also start earlier, as runs (doc_id, start, end)."""
    docs, pos, segs = (np.concatenate([g[0] for g in group]), np.concatenate([g[1] for g in group]), [s for g in group for s in g[2]])
    order = np.lexsort((pos, docs))
    again = (np.diff(docs[order]) == 0) & (np.diff(pos[order]) == 0)
    if again.any():  # rows that repeat a doc_id fetch a segment once each
        one = order[np.concatenate(([True], ~again))]
        docs, pos, segs = docs[one], pos[one], [segs[i] for i in one]
    use = np.flatnonzero(_with_matches(segs, length))
    if not len(use):
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("doc_id", "start", "end")})
    docs, pos, segs = docs[use], pos[use], [segs[i] for i in use]
    sizes = np.array([len(s) for s in segs], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    arr = np.frombuffer(b"".join(segs), dtype=np.uint8)
    windows = sizes - length + 1
    seg = np.repeat(np.arange(len(segs)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start, at = first[seg] + offset, pos[seg] + offset
    left = np.repeat(first + sizes, sizes) - np.arange(len(arr))
    ranks = suffix_ranks(arr, left, int(sizes.max()))
    whole = ranks.pop(max(ranks))[start]
    place = np.empty(len(seg), dtype=np.int64)  # position in the corpus order, dense within this batch
    place[np.lexsort((at, docs[seg]))] = np.arange(len(seg))
    order = np.argsort(whole, kind="stable")  # the suffix array of the windows' places
    lcp = np.concatenate(([0], shared_prefix(start[order[:-1]], start[order[1:]], arr, left, ranks)))
    # A suffix that shares less than `length` with both neighbours shares less with all others, so its LPF is less too.
    near = np.maximum(lcp, np.append(lcp[1:], 0)) >= length
    order, lcp = order[near], lcp[near]
    lpf = longest_previous(place[order], lcp)
    hit = lpf >= length
    out = pd.DataFrame({"doc_id": docs[seg[order[hit]]], "start": at[order[hit]], "lpf": lpf[hit]}).sort_values(["doc_id", "start"], ignore_index=True)
    if not len(out):
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("doc_id", "start", "end")})
    new = (out.doc_id.diff().fillna(1) != 0) | (out.start.diff().fillna(1) != 1)
    # Each factor's bytes go. It loses at most its first byte from one place to the next, so a run ends where its last one does.
    return out.assign(end=out.start + out.lpf).groupby(new.cumsum(), sort=False).agg(doc_id=("doc_id", "first"), start=("start", "first"), end=("end", "last"))


def _match(length: int):
    """Rows come sorted by key; whole keys are gathered until a batch is full."""

    def run(batches):
        group, size, last = [], 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            keys, docs, pos, segs = (pdf[c].to_numpy() for c in ("key", "doc_id", "pos", "seg"))
            held = np.cumsum([0, *map(len, segs)])
            new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            at = 0
            for j in new if keys[0] == last else (0, *new):
                if size + held[j] - held[at] >= _BATCH:
                    group.append((docs[at:j], pos[at:j], segs[at:j]))
                    yield _later(group, length)
                    group, size, at = [], 0, j
            group.append((docs[at:], pos[at:], segs[at:]))
            size, last = size + held[-1] - held[at], keys[-1]
        if group:
            yield _later(group, length)

    return run


def _windows(length: int):
    """Every window of a hot key's segments, by two hashes."""

    def run(batches):
        for pdf in batches:
            for doc, pos, seg in zip(pdf.doc_id, pdf.pos, pdf.seg):
                gram, window = _hashes(np.frombuffer(seg, dtype=np.uint8), length)
                lowest = _smallest(gram, length - GRAM + 1)
                yield pd.DataFrame({"w1": window.view(np.int64), "w2": lowest.view(np.int64), "doc_id": doc, "pos": pos + np.arange(len(window))})

    return run


def _cut_out(as_text: bool):
    """What is left of each text; the other columns pass through as they are."""

    def run(batches):
        for batch in batches:
            sizes, gone, n_runs, left = [], [], [], []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                b = as_bytes(text)
                runs: list[list[int]] = []
                for s, e in sorted((x["start"] & _TEXT, x["end"] & _TEXT) for x in spans or ()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                kept, at = [], 0
                for s, e in runs:
                    kept.append(b[at:s])
                    at = e
                kept.append(b[at:])
                sizes.append(len(b))
                gone.append(sum(e - s for s, e in runs))
                n_runs.append(len(runs))
                if not as_text:
                    left.append(b"".join(kept))
                else:  # a character that a cut splits goes whole; each part is valid but for its ends
                    left.append("".join([k.decode("utf-8", "ignore") for k in kept]) if runs else text)
            names = [n for n in batch.schema.names if n not in ("text", "spans")]
            done = [*(pa.array(x, type=pa.int64()) for x in (sizes, gone, n_runs)), pa.array(left, type=pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *done], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = 20_000, with_row: bool = False, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row.

    kept is binary; as_text makes it a string, without the characters that a cut splits, and null where the text was.
    with_row adds a struct `row` of all columns but the text."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if with_row else []
    rows, texts = gentle(docs).select("doc_id", *row, "text"), repeated_ids(docs)
    if texts is None:
        by, sub = ["doc_id"], lambda place: []
        rows = rows.withColumn("sub", F.lit(0))
    else:
        by, sub = ["doc_id", "sub"], lambda place: [F.shiftright(place, _PLACE).cast("int").alias("sub")]
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
        texts = broadcast_if_small(cut(texts.withColumn("_sub", number)).withColumnRenamed("doc_id", "_doc"))
        own = (F.col("doc_id") == F.col("_doc")) & (text_hash() == F.col("h"))
        rows = rows.join(texts, own, "left").select("doc_id", *[c for c in rows.columns if c == "row"], "text", F.coalesce("_sub", F.lit(0)).alias("sub"))
    docs = rows.select("doc_id", "sub", "text")
    segs = docs.where("doc_id is not null").mapInPandas(_scan(length), "key long, sig long, doc_id long, pos long, own int")
    keys = segs.groupBy("key").agg(F.count("*").cast("int").alias("c"), F.max("own").alias("own")).where("c > 1 or own > 0")
    shared = keep(segs.drop("own").join(keys.select("key", "own"), "key").withColumn("n", F.expr("cast(sig & 255 as int)")))

    place = F.struct("doc_id", "pos")
    firsts = shared.groupBy("key", "sig").agg(F.min(place).alias("f"), F.first("n").alias("n"), F.max("own").alias("own"), F.count("*").alias("c"))
    copies = shared.join(firsts.where("c > 1").select("key", "sig", "f"), ["key", "sig"]).where(place != F.col("f"))
    span = lambda start, end: F.struct(F.expr(start).cast("long").alias("start"), F.expr(end).cast("long").alias("end"))
    copies = copies.select("doc_id", span("pos", f"pos + n + {length - 1}").alias("span"))

    busy = firsts.groupBy("key").agg(F.count("*").alias("c"), F.max("own").alias("o")).where("c > 1 or o > 0").select("key", (F.col("c") > hot).alias("hot"))
    mixed = keep(firsts.join(busy, "key").select("key", F.col("f.doc_id").alias("doc_id"), F.col("f.pos").alias("pos"), "n", "hot"))
    wanted = mixed.groupBy("doc_id", *sub("pos")).agg(F.collect_list(F.struct("key", "pos", "n", "hot")).alias("want"))
    # Outer as the last join is, so that both read the texts from one exchange.
    fetched = map_frames(docs.join(wanted, by, "left"), _fetch(length), "key long, doc_id long, pos long, seg binary, hot boolean")
    some_hot = bool(mixed.where("hot").take(1))
    cold = (fetched.where("not hot") if some_hot else fetched).drop("hot")
    cold = cold.repartition("key").sortWithinPartitions("key").mapInPandas(_match(length), "doc_id long, start long, end long")
    spans = copies.union(cold.select("doc_id", span("start", "end").alias("span")))
    if some_hot:
        windows = fetched.where("hot").mapInPandas(_windows(length), "w1 long, w2 long, doc_id long, pos long")
        least = windows.groupBy("w1", "w2").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c")
        again = windows.join(least, ["w1", "w2"]).where(place != F.col("f"))
        spans = spans.union(again.select("doc_id", span("pos", f"pos + {length}").alias("span")))

    spans = spans.groupBy("doc_id", *sub("span.start")).agg(F.collect_list("span").alias("spans"))
    kept = f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    kinds = StructType([*[f for f in rows.schema if f.name not in ("text", "sub")], *StructType.fromDDL(kept)])
    return rows.join(spans, by, "left").drop("sub").mapInArrow(_cut_out(as_text), kinds)


def removal_report(docs: DataFrame, length: int = 100) -> DataFrame:
    """The digest of `remove_repeats`: the SHA-256 of each document's remaining bytes in place of the bytes."""
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], length: int = 100) -> dict[int, tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) by a dictionary of all windows; for tests."""
    seen, out = set(), {}
    for doc in sorted(texts):
        b = texts[doc]
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out
