"""Language-model scoring with a weighted backoff automaton over trigrams.

States are the contexts that training saw: pairs of words, single words, and one root. A text's boundary counts as a word
of its own, END. With C and c counts, N all training tokens, T(x) the number of different words that follow x in training
and d the discount (interpolated absolute discounting):

    root       arc for w:  p1(w) = C(w) / (N + 1), an unknown word 1 / (N + 1)
    word v     arc for w:  (c(v w) - d) / C(v) + b(v) p1(w)               failure arc to the root: b(v) = d T(v) / C(v)
    pair u v   arc for w:  (c(u v w) - d) / c(u v) + b(u v) p2(w | v)     failure arc to v: b(u v) = d T(u v) / c(u v)

A word or pair that training never saw is no state; the state of a history is the longest suffix of it that is one. Each
state's probabilities sum to 1. A text is read once from left to right: from the state carried along, the word's arc is
taken if there is one, else the failure arc and its weight, up to the root; the log-probabilities add up.

The automaton grows with the corpus, so it is never gathered or broadcast. Texts are dealt to blocks as they are scanned,
and n-grams to shards by ranges of their 64-bit hashes; a row is the packed, sorted hashes that one block asks of one
shard, and there is none where nothing is asked. In one plan whose exchanges are reused:

1. Shards total the counts of the words and pairs that blocks ask for. Each n-gram that training saw is owned by one of
   the blocks that have it, and the reply says so; it also says which pairs no other block has.
2. The same for triples, but for those with a pair that no other block has: the block knows all about them.
3. Blocks count the followers of each word and pair among the n-grams they own; shards total these counts of types.
4. Blocks build the states, arcs and failure arcs that their texts need, and walk the texts.

Edge cases: a null or empty text is the end token alone; rows without doc_id count as id text "" and keep a null id;
repeated rows are scored and counted each; ties don't arise; a block holds at least one whole text, so a task's memory
follows the longest text; an empty table gives no rows and an empty training part scores with N = 0; other columns are
ignored. N-grams are told apart by 64-bit hashes. A block that a retried task put together otherwise raises an error.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, gentle, mix, tokenize

END = np.uint64(0x6A09E667F3BCC908)
#: What a row holds: what a block asks or sends, or a shard's reply about words and pairs, triples, or followers.
ASK, WORDS_PAIRS, TRIPLES, FOLLOWERS = range(4)
_BLOCK = "block long, data binary"
_SHIP = "shard long, block long, kind int, data binary"
_WALKED = "doc_id long, held_out boolean, n_tokens long, n_known long, counts_score double, score double"


def _planes(a: np.ndarray) -> bytes:
    """Whole numbers by byte place, low bytes first, so that the many zeros lie together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(_planes, arrays)))


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    at, out = 8 * (len(types) + 1), []
    for kind, n in zip(types, np.frombuffer(raw, np.int64, len(types) + 1)[1:].tolist()):
        width = np.dtype(kind).itemsize
        part = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(n))
        at += n * width
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, which have fewer high bytes."""
    return np.diff(keys, prepend=np.uint64(0))


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def _batches_of_text(batches, size: int):
    """Ids (None where missing) and texts, about `size` bytes at a time."""
    ids, blobs, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            ids.append(doc)
            blobs.append(as_bytes(text))
            held += len(blobs[-1]) + 64
            if held >= size:
                yield ids, blobs
                ids, blobs, held = [], [], 0
    if ids:
        yield ids, blobs


def _corpus(size: int):
    """Bytes of all texts, and training tokens."""

    def run(batches):
        for ids, blobs in _batches_of_text(batches, size):
            counts = tokenize(blobs)[1]
            trained = sum(int(n) + 1 for d, n in zip(ids, counts) if not held_out(d))
            yield pa.RecordBatch.from_pydict({"n_bytes": [sum(map(len, blobs))], "tokens": [trained]}, schema=pa.schema([("n_bytes", pa.int64()), ("tokens", pa.int64())]))

    return run


def _blocks(size: int):
    """One row for each block: ids, which are missing, which are held out, words per text, vocabulary, words.

    A word is told by its rank among the block's words, frequent ones first, which packs better."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for nth, (ids, blobs) in enumerate(_batches_of_text(batches, size)):
            h, counts = tokenize(blobs)
            words, sizes = np.insert(h, np.cumsum(counts), END), counts + 1
            known, inverse, times = np.unique(words, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(known), dtype=np.uint32)
            rank[order] = np.arange(len(known), dtype=np.uint32)
            own, missing = np.array([0 if d is None else d for d in ids], dtype=np.int64), np.array([d is None for d in ids])
            data = _pack(own, missing, np.array([held_out(d) for d in ids]), sizes, _steps(known), order.astype(np.uint32), rank[inverse])
            name = int.from_bytes(hashlib.blake2b(data, digest_size=8, key=f"{task} {nth}".encode()).digest(), "little", signed=True)
            yield pa.RecordBatch.from_pydict({"block": [name], "data": [data]}, schema=pa.schema([("block", pa.int64()), ("data", pa.binary())]))

    return run


class _Block:
    """A block's texts and their n-grams: for each order the sorted distinct keys, and each position's place among them."""

    def __init__(self, data: bytes):
        self.ids, self.missing, self.held, self.sizes, steps, order, rank = _unpack(data, np.int64, bool, bool, np.int64, np.uint64, np.uint32, np.uint32)
        self.words, self.word = np.cumsum(steps, dtype=np.uint64), order[rank]
        self.first = np.cumsum(self.sizes) - self.sizes
        end = np.searchsorted(self.words, END)
        self.before = np.concatenate(([end], self.word[:-1])).astype(np.uint32)  # the word before, END at a text's start
        self.before[self.first] = end
        self.train = np.repeat(~self.held, self.sizes)
        self._pair = mix(self.words[self.before] * np.uint64(0x9FB21C651E98DF25) + self.words[self.word])
        self.pairs, self.pair = np.unique(self._pair, return_inverse=True)

    def contexts(self) -> np.ndarray:
        """The first word of each distinct pair."""
        out = np.zeros(len(self.pairs), dtype=np.uint32)
        out[self.pair] = self.before
        return out

    def with_triples(self) -> _Block:
        """Also the distinct triples, where they stand, and the two pairs of each."""
        third = np.ones(len(self.word), dtype=bool)
        third[self.first] = False  # a text's first word has no triple, as only END stands before it
        self.third_at = np.flatnonzero(third)
        key = mix(self._pair[self.third_at - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + self.words[self.word[self.third_at]])
        self.triples, self.triple = np.unique(key, return_inverse=True)
        self.triple_count = np.bincount(self.triple[self.train[self.third_at]], minlength=len(self.triples)).astype(np.uint32)
        self.head, self.tail = np.zeros((2, len(self.triples)), dtype=np.int64)
        self.head[self.triple], self.tail[self.triple] = self.pair[self.third_at - 1], self.pair[self.third_at]
        return self


def _ranges(shards: int, *keys: np.ndarray) -> list[tuple[int, list[slice]]]:
    """Shards that have any of the ascending keys, and their ranges in each array of keys."""
    shard = [(k >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32) for k in keys]
    present = np.unique(np.concatenate([np.unique(x) for x in shard]))
    sides = [[np.searchsorted(x, present, side).tolist() for side in ("left", "right")] for x in shard]
    return [(s, [slice(low[k], high[k]) for low, high in sides]) for k, s in enumerate(present.tolist())]


def _parcels(name: int, shards: int, keys: list[np.ndarray], values: list[np.ndarray], with_keys: bool) -> list[tuple]:
    """Rows that take each shard its keys (if wanted) and values."""
    rows = []
    for s, parts in _ranges(shards, *keys):
        arrays = [x for k, v, part in zip(keys, values, parts) for x in ((_steps(k[part]), v[part]) if with_keys else (v[part],))]
        rows.append((s, name, ASK, _pack(*arrays)))
    return rows


def _gather(shards: int, keys: list[np.ndarray], replies: pd.DataFrame, kind: int) -> list[np.ndarray]:
    """The shards' replies of a kind to what `_parcels` sent for the keys, in the order of the keys."""
    out = [np.zeros(len(k), dtype=np.uint64) for k in keys]
    expected = dict(_ranges(shards, *keys))
    for s, k, data in zip(replies["shard"], replies["kind"], replies["data"]):
        if k == kind:
            for values, part, got in zip(out, expected.pop(s), _unpack(data, *(np.uint64,) * len(keys))):
                values[part] = got
    if expected:
        raise ValueError("a block was put together otherwise when its task ran again; give a table that reads the same each time")
    return out


def _ship(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["shard", "block", "kind", "data"])


def _ask(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf["data"].iloc[0])
        counts = [np.bincount(x[block.train], minlength=len(k)).astype(np.uint32) for x, k in ((block.word, block.words), (block.pair, block.pairs))]
        return _ship(_parcels(int(pdf.block.iloc[0]), shards, [block.words, block.pairs], counts, True))

    return run


def _asked(data: bytes, orders: int) -> list[np.ndarray]:
    """For each order its keys and their counts."""
    got = _unpack(data, *(np.uint64, np.uint32) * orders)
    return [np.cumsum(x, dtype=np.uint64) if i % 2 == 0 else x for i, x in enumerate(got)]


def _merged(parts: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Distinct keys of all parts, each key's place among them, and where each part ends."""
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return len(keys), inverse, np.cumsum([len(x) for x in parts])


def _count(orders: int, kind: int):
    """One shard: training count of each n-gram asked for, times four, plus two if one block alone has it, plus one if the
    block owns it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        asked = [_asked(d, orders) for d in pdf["data"]]
        replies: list[list[np.ndarray]] = [[] for _ in asked]
        for order in range(orders):
            n, inverse, ends = _merged([a[2 * order] for a in asked])
            seen = np.concatenate([a[2 * order + 1] for a in asked])
            total = np.bincount(inverse, weights=seen, minlength=n).astype(np.uint64)
            alone = (np.bincount(inverse, minlength=n) == 1).astype(np.uint64)
            trained = np.flatnonzero(seen)[::-1]
            owner = np.full(n, -1, dtype=np.int64)
            owner[inverse[trained]] = trained  # the first of them, written last
            reply = (total * np.uint64(4) + alone * np.uint64(2))[inverse] + (owner[inverse] == np.arange(len(inverse))).astype(np.uint64)
            for k, part in enumerate(np.split(reply, ends[:-1])):
                replies[k].append(part)
        return _ship([(s, b, kind, _pack(*r)) for s, b, r in zip(pdf["shard"], pdf["block"], replies)])

    return run


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: different words that training saw."""
    parts = [a[0][a[1] > 0] for a in (_asked(d, 2) for d in pdf["data"])]
    return pd.DataFrame({"words": [len(np.unique(np.concatenate(parts)))]})


def _triple_counts(block: _Block, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which triples other blocks may have too: those whose pairs both stand in training texts and in other blocks. And
    the replies for all others, which the block knows by itself."""
    shared = (pairs >= np.uint64(4)) & (pairs & np.uint64(2) == 0)
    ask = shared[block.head] & shared[block.tail]
    return ask, block.triple_count.astype(np.uint64) * np.uint64(4) + (block.triple_count > 0).astype(np.uint64)


def _ask_triples(shards: int):
    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return _ship([])
        block = _Block(blocks["data"].iloc[0]).with_triples()
        ask, _ = _triple_counts(block, _gather(shards, [block.words, block.pairs], replies, WORDS_PAIRS)[1])
        return _ship(_parcels(int(blocks.block.iloc[0]), shards, [block.triples[ask]], [block.triple_count[ask]], True) if ask.any() else [])

    return run


def _all_counts(shards: int, block: _Block, replies: pd.DataFrame) -> list[np.ndarray]:
    """The replies for the block's words, pairs and triples."""
    words, pairs = _gather(shards, [block.words, block.pairs], replies, WORDS_PAIRS)
    ask, triples = _triple_counts(block, pairs)
    if ask.any():
        (triples[ask],) = _gather(shards, [block.triples[ask]], replies, TRIPLES)
    return [words, pairs, triples]


def _types(shards: int):
    """Followers of each word and pair among the n-grams that the block owns."""

    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return _ship([])
        block = _Block(blocks["data"].iloc[0]).with_triples()
        words, pairs, triples = _all_counts(shards, block, replies)
        owned = lambda x: (x & np.uint64(1)).astype(bool)
        of_word = np.bincount(block.contexts()[owned(pairs)], minlength=len(words)).astype(np.uint32)
        of_pair = np.bincount(block.head[owned(triples)], minlength=len(pairs)).astype(np.uint32)
        return _ship(_parcels(int(blocks.block.iloc[0]), shards, [block.words, block.pairs], [of_word, of_pair], False))

    return run


def _total_types(asks: pd.DataFrame, types: pd.DataFrame) -> pd.DataFrame:
    """One shard: followers of each word and pair in the whole corpus."""
    sent = dict(types[["block", "data"]].itertuples(index=False, name=None))
    asked = [(b, _asked(d, 2)) for b, d in zip(asks["block"], asks["data"]) if b in sent]
    if not asked:
        return _ship([])
    parts = [_unpack(sent[b], np.uint32, np.uint32) for b, _ in asked]
    replies: list[list[np.ndarray]] = [[] for _ in asked]
    for order in range(2):
        n, inverse, ends = _merged([a[2 * order] for _, a in asked])
        total = np.bincount(inverse, weights=np.concatenate([p[order] for p in parts]), minlength=n).astype(np.uint64)
        for k, part in enumerate(np.split(total[inverse], ends[:-1])):
            replies[k].append(part)
    return _ship([(int(asks["shard"].iloc[0]), b, FOLLOWERS, _pack(*r)) for (b, _), r in zip(asked, replies)])


def _walk(shards: int, tokens: int, discount: float):
    """Builds the part of the automaton that the block's texts touch, and walks all of them."""

    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame({k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "counts_score", "score")})
        block = _Block(blocks["data"].iloc[0]).with_triples()
        c1, c2, c3 = ((x >> np.uint64(2)).astype(np.float64) for x in _all_counts(shards, block, replies))
        t1, t2 = (x.astype(np.float64) for x in _gather(shards, [block.words, block.pairs], replies, FOLLOWERS))
        with np.errstate(divide="ignore", invalid="ignore"):
            # Failure arcs: of a word to the root, of a pair to its second word. What is no state passes on for nothing.
            fail1, fail2 = np.where(c1 > 0, discount * t1 / c1, 1.0), np.where(c2 > 0, discount * t2 / c2, 1.0)
            root = np.maximum(c1, 1) / (tokens + 1)
            v, w = block.contexts(), np.zeros(len(c2), dtype=np.uint32)
            w[block.pair] = block.word
            arc2 = np.where(c2 > 0, (c2 - discount) / c1[v], 0.0) + fail1[v] * root[w]
            arc3 = np.where(c3 > 0, (c3 - discount) / c2[block.head], 0.0) + fail2[block.head] * arc2[block.tail]
            fail1, fail2, root, arc2, arc3 = (np.log10(x) for x in (fail1, fail2, root, arc2, arc3))

        # One pass over all positions. The state carried to a position is the pair before it where training saw that pair,
        # else the word before it, else the root; a position whose state has no arc for its word falls along failure arcs.
        step = np.zeros(len(block.word))
        left = np.ones(len(step), dtype=bool)
        has = c3[block.triple] > 0
        at, falls = block.third_at[has], block.third_at[~has]
        step[at], left[at] = arc3[block.triple[has]], False
        step[falls] = fail2[block.pair[falls - 1]]
        at = np.flatnonzero(left & (c2[block.pair] > 0))
        step[at] += arc2[block.pair[at]]
        left[at] = False
        at = np.flatnonzero(left)
        step[at] += fail1[block.before[at]] + root[block.word[at]]

        add = lambda x: np.add.reduceat(x, block.first)
        ids = pd.array(block.ids, dtype="Int64")
        ids[block.missing] = pd.NA
        known = add((c1 > 0)[block.word].astype(np.int64))
        return pd.DataFrame({"doc_id": ids, "held_out": block.held, "n_tokens": block.sizes, "n_known": known, "counts_score": add(np.log10(c1 + 1.0)[block.word]), "score": add(step)})

    return run


def score_documents(docs: DataFrame, block_bytes: int = 16_000_000, discount: float = 0.75) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    block_bytes: text in one block; there are as many shards as blocks of that size. discount: taken off each count."""
    docs = gentle(docs).select("doc_id", "text")
    n_bytes, tokens = (int(x or 0) for x in docs.mapInArrow(_corpus(block_bytes), "n_bytes long, tokens long").agg(F.sum("n_bytes"), F.sum("tokens")).first())
    shards = max(1, -(-n_bytes // block_bytes))
    # An exchange of their own, so that every use reads the same blocks.
    blocks = docs.mapInArrow(_blocks(block_bytes), _BLOCK).repartition("block")
    asks = blocks.groupBy("block").applyInPandas(_ask(shards), _SHIP)
    counts = asks.groupBy("shard").applyInPandas(_count(2, WORDS_PAIRS), _SHIP)
    more = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(_ask_triples(shards), _SHIP)
    triples = more.groupBy("shard").applyInPandas(_count(1, TRIPLES), _SHIP)
    # Replies are sent again where they are needed again: they are small, and shards give them from the same exchanges.
    known = triples.union(counts)
    types = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_types(shards), _SHIP)
    totals = asks.groupBy("shard").cogroup(types.groupBy("shard")).applyInPandas(_total_types, _SHIP)
    walked = blocks.groupBy("block").cogroup(known.union(totals).groupBy("block")).applyInPandas(_walk(shards, tokens, discount), _WALKED)
    words = asks.groupBy("shard").applyInPandas(_count_words, "words long").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    base = F.col("counts_score") - F.col("n_tokens") * F.log10(F.lit(tokens + 1) + words.scalar())
    return walked.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


class BackoffAutomaton:
    """The same automaton in memory, word by word, for small corpora and tests. A state is the tuple of its words."""

    def __init__(self, texts: list[str], discount: float = 0.75):
        self.arcs, self.discount, self.words = defaultdict(Counter), discount, Counter()
        for text in texts:
            tokens = [*as_bytes(text).lower().split(), None]
            self.words.update(tokens)
            history = (None,)
            for word in tokens:
                for k in range(len(history) + 1):
                    self.arcs[history[k:]][word] += 1
                history = (*history, word)[-2:]
        self.total = sum(self.words.values())

    def fail(self, state: tuple) -> float:
        """Weight of the failure arc to the state without its first word."""
        arcs = self.arcs[state]
        return self.discount * len(arcs) / sum(arcs.values())

    def arc(self, state: tuple, word) -> float:
        if not state:
            return max(self.words[word], 1) / (self.total + 1)
        lower = self.arc(state[1:], word) if len(state) == 1 or word in self.arcs[state[1:]] else self.fail(state[1:]) * self.arc(state[2:], word)
        return (self.arcs[state][word] - self.discount) / sum(self.arcs[state].values()) + self.fail(state) * lower

    def step(self, state: tuple, word) -> float:
        """Probability of a word in a state, along failure arcs where they are needed."""
        if state and state not in self.arcs:
            return self.step(state[1:], word)
        return self.arc(state, word) if not state or word in self.arcs[state] else self.fail(state) * self.step(state[1:], word)

    def score(self, text: str | None) -> float:
        history, total = (None,), 0.0
        for word in [*as_bytes(text).lower().split(), None]:
            total += math.log10(self.step(history, word))
            history = (*history, word)[-2:]
        return total
