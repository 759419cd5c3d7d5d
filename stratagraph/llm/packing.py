"""Best-fit packing of tokenised documents into sequences, after a Martello-Toth dominance reduction.

Only lengths matter to a packing, and there are at most `capacity` of them. Spark counts the pieces of each length; the
driver plans on that histogram, whose size doesn't grow with the corpus:

1. Reduction. For the longest remaining length s, a small set that dominates every other set holding s is fixed for good:
   {s, k} if s + k fills the sequence; {s} if nothing fits beside it; {s, k} with the longest fitting k if no two pieces
   fit beside s, or if no two that fit are together longer than k. Each fixing is repeated as often as counts allow.
2. The rest, longest first, goes where the least room remains (best fit). Open sequences of equal content are one entry
   with a multiplicity, so a step handles all pieces of a length together.

The plan gives each length runs of ranks with their sequences and offsets. A piece's rank within its length comes from a
window over (length, salt) and the counts of the salts before it, so a length that a third of all pieces share is still
dealt to many tasks.

Edge cases: null and empty texts are one piece holding the end id alone; long documents are cut into full pieces and a
rest; repeated rows are packed each; rows without doc_id are packed too; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, cut, gentle, map_frames

#: Pieces of one length that one task ranks, about; a length has as many salts as its pieces need.
RANKED = 250_000
#: Up to so many rows (length, salt, base) are broadcast; more, at some 10 ** 11 pieces, are joined by a shuffle.
BROADCAST_BASES = 500_000
_MEMO, _FLUSH = 400_000, 100_000
_tokenizers: dict = {}
#: What a tokenizer must do before its model for `_Encoder` to look up stems: lower-case, and take a run of letters as one piece.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Lower case of A-Z and of the letters of Latin-1, which are two bytes in UTF-8, and what may follow a stem as one piece.
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256))
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_STEM = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class _Encoder:
    """Ids of texts as little-endian uint32 bytes, by words: this tokenizer drops white space, and no merge crosses it.

    The ids of words are kept in two generations of at most _MEMO words each. Most new words are a stem of Latin letters
    and signs behind it: their ids are those of the lower-case stem, which the tokenizer's model makes once for all its
    forms, and those of the signs. A stem is looked up in bytes; letters of other scripts never are one, as only Latin-1
    letters begin with the byte C3. All other words go through the tokenizer many at a time, with a mark between them that
    none of them holds."""

    MARK = "~"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.before = Tokenizer.from_file(path), {}, {}
        (self.mark,) = self._ids(self.MARK)
        self.stems, self.stems_before, self.signs = {}, {}, {b"": b""}
        normalizer, before_model = (json.loads(part.__getstate__()) if part else {} for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        steps = before_model.get("pretokenizers", [])
        self.by_stems = (
            normalizer.get("normalizers") == _NORMALIZERS and [s["type"] for s in steps] == ["Split", "ByteLevel"] and not getattr(self.tokenizer.model, "dropout", None)
            and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ({"Regex": _SPLIT}, "Removed", True, False, False)
        )
        if self.by_stems:
            from tokenizers.pre_tokenizers import ByteLevel

            level = ByteLevel(add_prefix_space=False, use_regex=False)
            self.model, self.bytes = self.tokenizer.model, {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _by_stems(self, words: set[bytes]) -> set[bytes]:
        """Learns the words that are a stem and signs; returns the others."""
        if len(self.stems) > _MEMO:
            self.stems, self.stems_before = {}, self.stems
        memo, stems, before, signs, tokenize, rest = self.memo, self.stems, self.stems_before, self.signs, self.model.tokenize, set()
        for w in words:
            low = w.translate(_LOWER)
            stem = low.rstrip(_SIGNS)
            ids = stems.get(stem)
            if ids is None:
                ids = before.get(stem)
                if ids is None:
                    if stem.isalpha():  # of ASCII letters only
                        text = stem.decode()
                    elif _STEM.fullmatch(stem):
                        text = stem.decode().translate(self.bytes)
                    else:
                        rest.add(w)
                        continue
                    found = tokenize(text)
                    ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
                stems[stem] = ids
            if len(stem) < len(low):
                tail = low[len(stem) :]
                after = signs.get(tail)
                if after is None:
                    after = np.array(self._ids(tail.decode()), dtype="<u4").tobytes()
                    if len(signs) < _MEMO:
                        signs[tail] = after
                ids += after
            memo[w] = ids
        return rest

    def learn(self, words: set[bytes]) -> None:
        if len(self.memo) > _MEMO:
            self.memo, self.before = {}, self.memo
        new = words.difference(self.memo)
        if self.before:
            kept = new.intersection(self.before)
            self.memo.update(zip(kept, map(self.before.__getitem__, kept)))
            new -= kept
        if self.by_stems:
            new = self._by_stems(new)
        odd = [w for w in new if b"~" in w]
        plain = [w for w in new if b"~" not in w]
        for w in odd:
            self.memo[w] = np.array(self._ids(w.decode("utf-8", "replace")), dtype="<u4").tobytes()
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            ids = np.array(self._ids(b" ~ ".join(part).decode("utf-8", "replace")), dtype="<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            data, at = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                self.memo[w] = data[4 * at : 4 * end]
                at = end + 1

    def encode(self, texts) -> list[bytes]:
        words = [t.encode("utf-8", "replace").split() if isinstance(t, str) else [] for t in texts]
        out: list[list[bytes]] = [[] for _ in words]
        todo, held = [], 0
        for k, w in enumerate(words):
            for i in range(0, len(w), _FLUSH):
                todo.append((k, w[i : i + _FLUSH]))
                held += len(todo[-1][1])
                if held >= _FLUSH:
                    self._flush(todo, out)
                    todo, held = [], 0
        self._flush(todo, out)
        return [b"".join(parts) for parts in out]

    def _flush(self, todo, out) -> None:
        self.learn(set().union(*(w for _, w in todo)))
        for k, w in todo:
            out[k].append(b"".join(map(self.memo.__getitem__, w)))


def encoder(path: str) -> _Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = _Encoder(path)
    return _tokenizers[path]


def _pieces(path: str, capacity: int, end_id: int):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for pdf in batches:
            rows = []
            for doc, ids in zip(pdf.doc_id, enc.encode(pdf.text)):
                ids += tail
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
            yield columns(rows, "doc_id piece start length ids_crc32")

    return run


def _three(sizes: list[int], left: dict[int, int]) -> int:
    """Sum of the three shortest pieces; endless if there are fewer."""
    out, need = 0, 3
    for s in sizes:
        n = min(left[s], need)
        out, need = out + n * s, need - n
        if not need:
            return out
    return 1 << 60


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(how many sequences, {length: pieces in each})] for a histogram of lengths."""
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[int, dict[int, int]]] = []

    def add(s: int, n: int) -> None:
        if s not in left:
            left[s] = 0
            insort(sizes, s)
        left[s] += n
        if not left[s]:
            del left[s]
            sizes.remove(s)

    def best_pair(room: int) -> int:
        """Longest sum of two pieces that fit into the room; 0 if no two do."""
        best, j = 0, len(sizes) - 1
        for i, a in enumerate(sizes):
            while j >= i and a + sizes[j] > room:
                j -= 1
            if j < i:
                break
            if j > i or left[a] > 1:
                best = max(best, a + sizes[j])
            elif j > 0 and i and sizes[i - 1] + a <= room:
                best = max(best, sizes[i - 1] + a)
        return best

    def dominating(s: int) -> dict[int, int] | None:
        """A set with s that dominates all others; pieces of every length may be partners."""
        add(s, -1)
        room = capacity - s
        i = bisect_right(sizes, room)
        k = sizes[i - 1] if i else 0
        if not k:
            found = {s: 1}
        elif s + k == capacity or best_pair(room) <= k and (not best_pair(room) or _three(sizes, left) > room):
            found = {s: 2} if k == s else {s: 1, k: 1}
        else:
            found = None
        add(s, 1)
        return found

    moved = True
    while moved:
        moved = False
        for s in sorted(left, reverse=True):
            while s in left and (content := dominating(s)):
                times = min(left[x] // n for x, n in content.items())
                fixed.append((times, content))
                for x, n in content.items():
                    add(x, -times * n)
                moved = True
    rest = left

    open_at: dict[int, list[list]] = defaultdict(list)  # room -> [[how many, content]]
    rooms: list[int] = []

    def put(room: int, times: int, content: dict[int, int]) -> None:
        if times:
            if room not in open_at or not open_at[room]:
                if room not in rooms:
                    insort(rooms, room)
            for entry in open_at[room]:
                if entry[1] == content:
                    entry[0] += times
                    return
            open_at[room].append([times, content])

    for s in sorted(rest, reverse=True):
        n = rest[s]
        for room in [r for r in rooms if r >= s]:
            each, entries = room // s, open_at.pop(room)
            rooms.remove(room)
            for times, content in entries:
                full = min(times, n // each)
                put(room - each * s, full, content | {s: each})
                n -= full * each
                if n and full < times:
                    put(room - n * s, 1, content | {s: n})
                    full, n = full + 1, 0
                put(room, times - full, content)
            if not n:
                break
        each = capacity // s
        put(capacity - each * s, n // each, {s: each})
        if n % each:
            put(capacity - n % each * s, 1, {s: n % each})
    return fixed + [(times, content) for entries in open_at.values() for times, content in entries]


def _runs(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length: rows (rank from, first sequence, pieces in each, offset of the first)."""
    runs, seen, sequence = defaultdict(list), defaultdict(int), 0
    for times, content in patterns:
        offset = 0
        for s in sorted(content, reverse=True):
            runs[s].append((seen[s], sequence, content[s], offset))
            seen[s] += times * content[s]
            offset += s * content[s]
        sequence += times
    return {s: np.array(rows, dtype=np.int64) for s, rows in runs.items()}


def _place(runs: dict[int, np.ndarray]):
    def run(batches):
        for pdf in batches:
            length, rank = pdf.length.to_numpy(), pdf["rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                table = runs[int(s)]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + inside // row[:, 2]
                offset[at] = row[:, 3] + inside % row[:, 2] * s
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)  # the id may be None

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(map_frames(gentle(docs).select("doc_id", "text"), _pieces(tokenizer_path, capacity, end_id), kinds))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = {s: -(-n // RANKED) for s, n in histogram.items()}
    table = pieces.sparkSession.createDataFrame(list(salts.items()), "length long, salts long")
    salted = pieces.join(F.broadcast(table), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    bases = F.broadcast(bases) if sum(salts.values()) <= BROADCAST_BASES else bases
    runs = _runs(plan(histogram, capacity))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return map_frames(ranked, _place(runs), kinds + ", sequence_id long, offset long")
