"""Document fingerprints (operator 5) by one-permutation MinHash.

Each five-word shingle is hashed once; the high bits choose one of 512 bins and
the rest is the value whose minimum the bin keeps. Empty bins are filled by
optimal densification: each takes the value of the first filled bin in a random
order of its own. The low four bits of each bin are stored packed, and a likeness
is the share of equal bins corrected for chance matches.

A document's neighbour is the next one by descending id. Rows are dealt to ranges
of ids and read in order there; the first row of each range goes to the range
before it as well, so every text is shuffled once, compressed.

Defined results: a null text counts as empty; texts without a word have the empty
fingerprint, alike (1) to another such and unlike (0) any other; a text of fewer
than five words is one shingle; very long texts count whole; null ids sort last; rows
that repeat an id are ordered by a hash of their text (if that is equal too they are
the same text, so their order doesn't matter); a table of one row is its own
neighbour; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, small_batches, text_chunks

SHINGLE, BINS, BITS = 5, 512, 4
BIN_SHIFT = np.uint64(64 - 9)
NONE = np.uint64(2**64 - 1)
#: Random bins that an empty bin tries before it goes through all filled ones.
TRIES = 16
#: Rows of a range of ids, about, and the most ranges that are made.
RANGE_ROWS, RANGES = 3000, 16384

_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_ALL = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin the bins that it tries first, and the priorities of all bins after those."""
    rng = np.random.default_rng(20170)
    return rng.integers(0, BINS, (BINS, TRIES)), rng.random((BINS, BINS), np.float32)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, which white space separates, and each text's offsets among them."""
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    begin = 1 + offsets([len(r) + 1 for r in raw])
    space = SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = 1 << max(16, (len(data) - 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(size, _P)[: len(data)], out=sums[1:])
    # a polynomial of the word's bytes, moved to its own start by the inverse power
    word = _mix((sums[end] - sums[start]) * _powers(size, pow(_P, -1, 1 << 64))[start])
    return word, np.searchsorted(start, begin)


def shingle_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles and each text's offsets among them."""
    word, of = word_hashes(raw)
    n = np.diff(of)
    pad = np.r_[word, np.zeros(SHINGLE, np.uint64)]
    run = np.zeros(len(word), np.uint64)
    for k in range(SHINGLE):
        run = run * np.uint64(_Q) + pad[k : k + len(word)]
    left = np.repeat(of[1:], n) - np.arange(len(word))  # words from here to the text's end
    keep = left >= SHINGLE
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        h = 0
        for w in word[of[i] : of[i + 1]].tolist():
            h = (h * _Q + w) & _ALL
        run[of[i]] = h ^ int(n[i])
        keep[of[i]] = True
    return _mix(run[keep]), offsets(np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1)))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BINS) bin codes of BITS bits, and which texts have a shingle."""
    h, off = shingle_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    n = np.diff(off)
    least = np.full(len(texts) * BINS, NONE)
    place = np.repeat(np.arange(len(texts)), n) * BINS + (h >> BIN_SHIFT).astype(np.int64)
    np.minimum.at(least, place, h & np.uint64(2**55 - 1))
    least = least.reshape(len(texts), BINS)
    filled, full = least != NONE, n > 0
    first, priority = _orders()
    doc, empty = np.nonzero(~filled & full[:, None])
    source = np.full(len(doc), -1, np.int64)
    open_ = np.arange(len(doc))
    for t in range(TRIES):
        tried = first[empty[open_], t]
        hit = filled[doc[open_], tried]
        source[open_[hit]] = tried[hit]
        open_ = open_[~hit]
        if not len(open_):
            break
    if len(open_):
        edges = np.flatnonzero(np.diff(doc[open_], prepend=-1))
        for i, j in zip(edges, np.r_[edges[1:], len(open_)], strict=True):
            own = np.flatnonzero(filled[doc[open_[i]]])
            source[open_[i:j]] = own[priority[np.ix_(empty[open_[i:j]], own)].argmin(axis=1)]
    least[doc, empty] = least[doc, source]
    # a value that fills many bins gives each its own bits, or chance matches would come in bulk
    apart = np.arange(BINS, dtype=np.uint64) * np.uint64(_Q)
    return (_mix(least + apart) & np.uint64((1 << BITS) - 1)).astype(np.uint8), full


def all_codes(texts: list[str], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    parts = [codes(texts[a:b]) for a, b in text_chunks(texts, limit)]
    if not parts:
        return np.zeros((0, BINS), np.uint8), np.zeros(0, bool)
    return np.concatenate([c for c, _ in parts]), np.concatenate([f for _, f in parts])


def packed(code: np.ndarray, full: np.ndarray) -> list[str]:
    """Hex digits, a bin each; empty where there is no shingle."""
    data = (code[:, ::2] << 4 | code[:, 1::2]).astype(np.uint8)
    return [d.tobytes().hex() if f else "" for d, f in zip(data, full, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, full_a: np.ndarray, full_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of each row of codes, without the chance matches of BITS bits."""
    chance = 1 / (1 << BITS)
    same = (a == b).mean(axis=1) if len(a) else np.zeros(0)
    found = np.clip((same - chance) / (1 - chance), 0, 1)
    return np.where(full_a & full_b, found, np.where(full_a | full_b, 0.0, 1.0))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            code, full = all_codes([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(code, full), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _ranges(ids: DataFrame) -> np.ndarray:
    """Rising edges between ranges of ids; at most RANGES - 1, whatever the input."""
    n = ids.count()
    k = int(min(RANGES, max(1, n // RANGE_ROWS)))
    if k == 1:
        return np.zeros(0, np.int64)
    at = ids.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 10 * k).alias("at")).first()["at"]
    return np.unique(np.array(at or [], np.int64))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    edges = _ranges(own.select("doc_id"))

    def range_of(column: pa.Array) -> np.ndarray:
        """Ranges count from the largest ids down; null ids are in the last."""
        ids = column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return len(edges) - np.searchsorted(edges, ids, side="right")

    def first_rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(batch.column(0))), batch.column(0), batch.column(1)], ["range", "doc_id", "h"])

    # The first row of each range: one per range, so at most RANGES rows come here.
    order = F.struct(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min).cast("long")), F.col("doc_id").isNotNull(), F.col("h"))
    narrow = own.select("doc_id", "h").mapInArrow(first_rows, "range long, doc_id long, h long")
    heads = sorted((r["range"], r["head"]["doc_id"], r["head"]["h"]) for r in narrow.groupBy("range").agg(F.max_by(F.struct("doc_id", "h"), order).alias("head")).collect())
    before = {(doc_id, h): heads[k - 1][0] for k, (_, doc_id, h) in enumerate(heads)}  # the first one's is the last range

    def deal(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at, ids, hashes = range_of(batch.column(0)), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data = [press.compress(t.encode()) for t in batch.column(2).to_pylist()]
            extra = [(before[k], i) for i, k in enumerate(zip(ids, hashes, strict=True)) if k in before]
            pick = [i for _, i in extra]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*at.tolist(), *(r for r, _ in extra)], pa.int64()),
                    pa.array([False] * len(ids) + [True] * len(pick)),
                    pa.array(ids + [ids[i] for i in pick], pa.int64()),
                    pa.array(hashes + [hashes[i] for i in pick], pa.int64()),
                    pa.array(data + [data[i] for i in pick], pa.binary()),
                ],
                ["range", "ghost", "doc_id", "h", "data"],
            )

    def walk(batches):
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple] = []
        for batch in batches:
            rows = [*held, *zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), (unpack.decompress(d).decode() for d in batch.column(4).to_pylist()), strict=True)]
            held = rows[-1:]
            if len(rows) < 2:
                continue
            texts = [t for _, _, t in rows]
            code, full = all_codes(texts)
            real = np.array([i for i in range(len(rows) - 1) if not rows[i][0]], np.int64)
            edited = []
            for i in real.tolist():
                half = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            e_code, e_full = all_codes(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][1] for i in real], pa.int64()),
                    pa.array([len(texts[i]) for i in real], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(packed(code[real], full[real]), pa.string()),
                    pa.array(packed(e_code, e_full), pa.string()),
                    pa.array(likeness(code[real], e_code, full[real], e_full)),
                    pa.array(likeness(code[real], code[real + 1], full[real], full[real + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    dealt = own.select("doc_id", "h", "text").mapInArrow(deal, "range long, ghost boolean, doc_id long, h long, data binary")
    parts = max(len(heads), 1)
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "ghost", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return ordered.mapInArrow(
        walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
