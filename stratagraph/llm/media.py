"""Media columns: content-defined chunking, chunk deduplication by joins, verified reconstruction.

A payload is stored as 8-bit mono PCM in a WAV container. A rolling gear hash cuts the stored bytes where their content
says so, so equal passages give equal chunks wherever they stand. Two passes over the texts:

1. Digests only: each medium's ordered list of chunk digests. Joins on digests find equal media, the medium that owns
   each distinct chunk, and which chunks are wanted by others. No bytes are shuffled.
2. Bytes: chunks meet their medium's list in one shuffle. A medium keeps the chunks it owns (the store); only chunks that
   others refer to move again, to those media. Copies of a medium are never rebuilt, but take its results.

Each medium is then put together from its list, every chunk and the whole are checked against their digests, and the
features are computed from the samples read back.

Edge cases: null and empty texts are 64 zero bytes; equal texts share one medium; repeated rows and rows without doc_id
get a row each; an empty table gives no rows; other columns are ignored. A failed check raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, columns, cut, gentle, map_frames, mix

RATE = 8000
#: Bounds of a chunk; between them a cut falls after about MEAN bytes.
SHORTEST, MEAN, LONGEST = 256, 2048, 16_384
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text) -> tuple[bytes, int]:
    """A text's bytes, padded with zeros to a positive multiple of 64, and their length before."""
    b = as_bytes(text)
    return b + bytes(-len(b) % 64 if b else 64), len(b)


def to_wav(samples: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(media: bytes) -> bytes:
    kind, _, wave = struct.unpack_from("<4sI4s", media)
    at = 12
    while kind == b"RIFF" and wave == b"WAVE" and at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("not a WAV file with samples")


def chunks_of(media: bytes) -> list[bytes]:
    """Cut where the gear hash of the last 32 bytes is 0 in its top bits."""
    h = _GEAR[np.frombuffer(media, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h = np.concatenate((h[:step], h[step:] + (h[:-step] << np.uint32(step))))
    ends = np.flatnonzero(h >> np.uint32(32 - (MEAN.bit_length() - 1)) == 0) + 1
    out, at = [], 0
    while at < len(media):
        i = np.searchsorted(ends, at + SHORTEST)
        end = min(int(ends[i]) if i < len(ends) else len(media), at + LONGEST, len(media))
        out.append(media[at:end])
        at = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _lists(batches):
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf.doc_id, pdf.text):
            samples, n = payload_of(text)
            media = to_wav(samples)
            rows.append((doc, n, len(samples), len(media), hashlib.sha256(media).hexdigest(), [digest(c) for c in chunks_of(media)]))
        yield columns(rows, "doc_id n_bytes payload_bytes media_bytes media_sha256 chunks")


def _bytes(batches):
    pack = zstandard.ZstdCompressor(level=12, write_content_size=True, write_checksum=False, write_dict_id=False)
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf.doc_id, pdf.text):
            media = to_wav(payload_of(text)[0])
            rows.append((doc, hashlib.sha256(media).hexdigest(), [pack.compress(c) for c in chunks_of(media)]))
        yield columns(rows, "doc_id medium data")


def features(samples: bytes) -> str:
    """Mean, root mean square about the middle, peak, zero crossings; from whole numbers, so the same everywhere."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={int(x.sum()) / len(x):.6f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.6f};peak={int(np.abs(x).max())};crossings={crossings}"


def _rebuild(batches):
    unpack = zstandard.ZstdDecompressor()
    for pdf in batches:
        rows = []
        for medium, wanted, own, fetched in zip(pdf.medium, pdf.chunks, pdf.own, pdf.fetched):
            parts = {c["i"]: unpack.decompress(c["data"]) for c in (*own, *(fetched if fetched is not None else ()))}
            for i, want in enumerate(wanted):
                if digest(parts[i]) != bytes(want):
                    raise ValueError(f"chunk {i} of medium {medium} is damaged")
            media = b"".join(parts[i] for i in range(len(wanted)))
            if hashlib.sha256(media).hexdigest() != medium:
                raise ValueError(f"medium {medium} is damaged")
            samples = from_wav(media)
            rows.append((medium, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), features(samples)))
        yield pd.DataFrame(rows, columns=["media_sha256", "payload_sha256", "tail_crc32", "feature"])


def media_features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks) of every row."""
    docs = gentle(docs).select("doc_id", "text")
    lists = cut(map_frames(docs, _lists, "doc_id long, n_bytes long, payload_bytes long, media_bytes long, media_sha256 string, chunks array<binary>"))
    named = F.coalesce("doc_id", F.lit(-(1 << 63)))

    # One row for each distinct medium, in the name of its first document. `mid` is short for the digest; with the
    # document's name it is the key of all that follows, and the digest itself is checked in the end.
    first = lists.groupBy("media_sha256").agg(F.min(named).alias("doc"))
    media = lists.withColumn("doc", named).join(first, ["media_sha256", "doc"], "left_semi")
    media = media.select("doc", F.xxhash64("media_sha256").alias("mid"), F.col("media_sha256").alias("medium"), "chunks").dropDuplicates(["doc", "mid"])
    refs = media.select("doc", "mid", F.posexplode("chunks").alias("i", "chunk"))
    owners = refs.groupBy("chunk").agg(F.min(F.struct("doc", "mid", "i")).alias("owner"), (F.count("*") > 1).alias("wanted"))
    own = (F.col("owner.doc") == F.col("doc")) & (F.col("owner.mid") == F.col("mid")) & (F.col("owner.i") == F.col("i"))
    refs = cut(refs.join(owners.where("wanted").drop("wanted"), "chunk", "left").select("doc", "mid", "i", "owner", F.coalesce(own, F.lit(True)).alias("mine")))
    mine = refs.where("mine").groupBy("doc", "mid").agg(F.collect_list("i").alias("keep"), F.collect_list(F.when(F.col("owner").isNotNull(), F.col("i"))).alias("lend"))
    empty = F.array().cast("array<int>")
    layout = media.join(mine, ["doc", "mid"], "left").withColumn("keep", F.coalesce("keep", empty)).withColumn("lend", F.coalesce("lend", empty))

    held = map_frames(docs, _bytes, "doc_id long, medium string, data array<binary>").select(named.alias("doc"), F.xxhash64("medium").alias("mid"), "data")
    store = held.join(layout, ["doc", "mid"])
    pick = lambda which: F.transform(F.col(which), lambda i: F.struct(i.alias("i"), F.get(F.col("data"), i).alias("data")))
    lent = store.select(F.col("doc").alias("d"), F.col("mid").alias("m"), F.explode(pick("lend")).alias("c")).select("d", "m", F.col("c.i").alias("j"), "c.data")
    borrowed = refs.where("not mine").select("doc", "mid", "i", F.col("owner.doc").alias("d"), F.col("owner.mid").alias("m"), F.col("owner.i").alias("j")).join(lent, ["d", "m", "j"])
    borrowed = borrowed.groupBy("doc", "mid").agg(F.collect_list(F.struct("i", "data")).alias("fetched"))
    whole = store.select("doc", "mid", "medium", "chunks", pick("keep").alias("own")).join(borrowed, ["doc", "mid"], "left")
    rebuilt = whole.select("medium", "chunks", "own", "fetched").mapInPandas(_rebuild, "media_sha256 string, payload_sha256 string, tail_crc32 long, feature string")
    out = lists.withColumn("n_chunks", F.size("chunks")).join(rebuilt.dropDuplicates(["media_sha256"]), "media_sha256")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
