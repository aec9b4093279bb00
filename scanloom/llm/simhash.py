"""SimHash near-duplicates (operator 10) over a Gray-order hierarchical index.

Each text gives one fingerprint; equal fingerprints become one node. The index
has masks of some of a fingerprint's bits as its upper nodes: a node goes to the
bucket of each mask's pattern, and Spark shuffles by bucket. Of 64 bits, those
within 3 differing ones agree on one of four masks of 16 bits, so no link is lost;
large buckets are dealt out again by 12 of the other bits, which loses none either.
Inside a bucket the fingerprints are sorted by Gray rank, runs of them share masked
bit patterns in upper nodes, and a search adds up the differences from node to node
and leaves whole groups when they pass the radius. A bucket gives a spanning forest
of its links, not all its pairs; components over those edges come from alternating
large-star and small-star rounds.

Defined results: null and empty texts, and texts without a word, have the zero
fingerprint and link like any other; very long texts are hashed in bounded memory
beside their words; repeated rows and null ids keep a row each (a component's id is
its smallest non-null id); an empty table gives no rows; other columns of the input
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, offsets, small_batches, text_chunks

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bucket size beyond which a bucket is dealt out again by blocks of its other bits, or in pairs of slices of half that size.
LARGE, SLICE = 2048, 16384
FAN = 16
#: Hashes whose bits are summed at once.
FOLDED = 1 << 18
#: Rows that a task holds before it looks at the buckets that are whole.
HELD = 50_000


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 of each shingle of ``size`` words; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    join, h = b" ".join, xxhash.xxh64_intdigest
    return [h(join(s), SEED) for s in zip(*(words[i:] for i in range(size)), strict=False)]


def fold(hashes: np.ndarray, off: np.ndarray, words: int, ties: np.ndarray | None = None) -> np.ndarray:
    """Majority bits of each slice of ``hashes``: (texts, words) of uint64.

    Word 0 takes the hashes as they are, the others remixed ones. A bit that half of the
    hashes set is that of the slice's hash in ``ties`` (remixed likewise), else 0.
    """
    out = np.zeros((len(off) - 1, words), np.uint64)
    own = np.flatnonzero(np.diff(off))
    if not len(own):
        return out
    n, edges = np.diff(off)[own], off[np.r_[own, len(off) - 1]]
    for k in range(words):
        turn = (lambda h: h) if not k else (lambda h, k=k: _mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        sums = np.zeros((len(own), 64), np.int64)
        for p in range(0, len(hashes), FOLDED):
            first, last = np.searchsorted(edges, p, "right") - 1, np.searchsorted(edges, min(p + FOLDED, len(hashes)))
            bits = np.unpackbits(turn(hashes[p : p + FOLDED])[:, None].view(np.uint8), axis=1, bitorder="little")
            sums[first:last] += np.add.reduceat(bits, np.maximum(edges[first:last] - p, 0), axis=0, dtype=np.int32)
        major = 2 * sums > n[:, None]
        if ties is not None:
            other = np.unpackbits(turn(ties[own])[:, None].view(np.uint8), axis=1, bitorder="little")
            major |= (2 * sums == n[:, None]) & other.astype(bool)
        out[own, k] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is big-endian binary of 64 bits."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = []
            for a, b in text_chunks(texts, 2 << 20):
                lists = [np.array(shingle_hashes(t, shingle), np.uint64) for t in texts[a:b]]
                words = fold(np.concatenate(lists), offsets([len(hs) for hs in lists]), 1).astype(">u8")
                found += [w.tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary")


# -- the index inside a bucket ---------------------------------------------------


def gray_order(fps: np.ndarray) -> np.ndarray:
    """Order of (n, words) fingerprints by their rank in the reflected Gray code."""
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    for k in range(1, fps.shape[1]):  # an odd prefix reflects what follows
        odd = (rank[:, k - 1] & np.uint64(1)).astype(bool)
        rank[odd, k] = ~rank[odd, k]
    return np.lexsort(rank.T[::-1])


def _diff(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    x = a ^ b
    if mask is not None:
        x &= mask
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


def gray_links(fps: np.ndarray, radius: int):
    """Pairs (i, j), i < j, of rows at most ``radius`` bits apart, in slices; rows are in Gray order."""
    every = ~np.zeros(fps.shape[1], np.uint64)
    levels = [(fps, np.broadcast_to(every, fps.shape))]  # pattern and shared mask of each node
    while len(levels[-1][0]) > FAN:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FAN)
        ones, any_ = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
        levels.append((ones, ~(ones ^ any_) & np.bitwise_and.reduceat(mask, at)))
    for q0 in range(0, len(fps), 512):
        q = np.arange(q0, min(q0 + 512, len(fps)))
        top = np.arange(len(levels[-1][0]))
        who, node = np.repeat(q, len(top)), np.tile(top, len(q))
        acc, above = np.zeros(len(who), np.int32), None
        for depth in range(len(levels) - 1, -1, -1):
            pattern, mask = levels[depth]
            last = np.minimum((node + 1) * FAN**depth, len(fps)) - 1
            keep = last > who  # only pairs whose second row comes later
            who, node, acc = who[keep], node[keep], acc[keep]
            fresh = mask[node] if above is None else mask[node] & ~above[keep]
            acc = acc + _diff(fps[who], pattern[node], fresh)
            keep = acc <= radius
            who, node, acc = who[keep], node[keep], acc[keep]
            if depth:
                below = len(levels[depth - 1][0])
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                ok = child < below
                above = np.repeat(mask[node], FAN, axis=0)[ok]
                who, acc, node = np.repeat(who, FAN)[ok], np.repeat(acc, FAN)[ok], child[ok]
        yield who, node


def small_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs in many small buckets at once; a bucket of up to FAN rows is one leaf of the index."""
    pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(starts, sizes) + pos
    later = np.repeat(sizes, sizes) - 1 - pos
    i = np.repeat(row, later)
    j = i + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
    near = _diff(fps[i], fps[j]) <= radius
    return i[near], j[near]


def forest(n: int, pairs) -> np.ndarray:
    """Each row's smallest connected row, over slices of pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (nxt := label[label]).tobytes() != label.tobytes():
                label = nxt
    return label


def whole_buckets(batches, column: str = "bucket"):
    """Tables of whole buckets, HELD rows or one bucket at a time, of batches in the order of their buckets."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        keys = batch.column(column).to_numpy()
        if not len(keys):
            continue
        begins = int(np.searchsorted(keys, keys[-1]))  # of the bucket that may go on in the next batch
        goes_on = begins == 0 and last == keys[0]
        last = keys[-1]
        if rows + len(keys) < HELD or goes_on:
            held.append(batch)
            rows += len(keys)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, begins)]).combine_chunks()
        held, rows = [batch.slice(begins)], len(keys) - begins
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def bucket_runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the table's buckets."""
    starts = np.flatnonzero(np.diff(table.column("bucket").to_numpy(), prepend=-1) != 0)
    if not len(starts) or starts[0]:
        starts = np.r_[0, starts]
    return starts, np.diff(np.r_[starts, len(table)])


def leading_words(column: pa.ChunkedArray, words: int) -> np.ndarray:
    """(rows, words) of the first bytes of binaries of one length."""
    data = b"".join(column.to_pylist())
    return np.ascontiguousarray(np.frombuffer(data, ">u8").astype(np.uint64).reshape(len(column), -1)[:, :words])


def near_pairs(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int):
    """Slices of the pairs of rows within the radius, of all buckets."""
    small = sizes <= FAN
    yield small_links(fps, starts[small], sizes[small], radius)
    for s, n in zip(starts[~small], sizes[~small], strict=True):
        order = s + gray_order(fps[s : s + n])
        for i, j in gray_links(fps[order], radius):
            yield order[i], order[j]


def _edges(radius: int, words: int, nearest: bool = False):
    """Rows (bucket, node) in the order of their buckets to edges (a, b), many buckets at a time.

    The edges are a spanning forest of a bucket's links; with ``nearest`` each
    row's closest link to one of another ``part``.
    """

    def closest(fps: np.ndarray, parts: np.ndarray, found) -> tuple[np.ndarray, np.ndarray]:
        best = np.full(len(fps), np.iinfo(np.int64).max)
        for i, j in found:
            apart = parts[i] != parts[j]
            i, j = i[apart], j[apart]
            off = _diff(fps[i], fps[j]).astype(np.int64) << 32
            np.minimum.at(best, i, off | j)
            np.minimum.at(best, j, off | i)
        own = np.flatnonzero(best != np.iinfo(np.int64).max)
        return own, best[own] & 0xFFFFFFFF

    def run(batches):
        for table in whole_buckets(batches):
            raw = table.column("node")
            fps = leading_words(raw, words)
            found = near_pairs(fps, *bucket_runs(table), radius)
            if nearest:
                parts = table.column("part").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                i, j = closest(fps, parts, found)
            else:
                label = forest(len(fps), found)
                i = np.flatnonzero(label != np.arange(len(label)))
                j = label[i]
            if len(i):
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in (raw.take(pa.array(i)), raw.take(pa.array(j)))], ["a", "b"])

    return run


def _word(k: int) -> Column:
    return F.conv(F.hex(F.substring("node", 8 * k + 1, 8)), 16, -10).cast("long")


def _bits(word: Column, start: int, n: int) -> Column:
    """``n`` bits of a word from ``start`` on, the highest being bit 0."""
    return F.shiftrightunsigned(word, 64 - start - n).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def byte_pairs(bits: int) -> list[tuple[int, int]]:
    """Masks of wide fingerprints: each byte with the next one, and with the one half way round."""
    n = bits // 8
    return [(i, (i + 1) % n) for i in range(n)] + [(i, i + n // 2) for i in range(n // 2)]


def bucketed(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` once for each mask, with the ``bucket`` (long) of its pattern."""
    words = [_word(k) for k in range(bits // 64)]
    held = nodes.withColumns({f"w{k}": w for k, w in enumerate(words)})
    byte = lambda i: _bits(F.col(f"w{i // 8}"), 8 * (i % 8), 8)
    if bits == 64:
        patterns = [_bits(F.col("w0"), 16 * k, 16) for k in range(4)]
    else:
        patterns = [F.shiftleft(byte(i), 8).bitwiseOR(byte(j)) for i, j in byte_pairs(bits)]
    keys = F.array(*(F.lit(k << 16).cast("long") + p for k, p in enumerate(patterns)))
    return held.select(*nodes.columns, F.explode(keys).alias("bucket"))


def sliced(keyed: DataFrame, most: int) -> DataFrame:
    """``keyed`` with buckets of more than ``most`` rows dealt out so that each pair of rows still meets.

    Rows of a large bucket are in slices of half as many by a hash; each pair of slices is a bucket.
    """
    large = cut(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most))
    met = keyed.join(large, "bucket", "left")
    count = F.ceil(F.col("n") / (most // 2)).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit("slice")), F.col("c"))
    pair = lambda t: F.xxhash64(F.col("bucket"), F.least("s", t), F.greatest("s", t))
    others = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda t: t != F.col("s")), pair)
    met = met.withColumn("c", count).withColumn("s", own)
    return met.withColumn("bucket", F.explode(F.when(F.col("c").isNull(), F.array("bucket")).otherwise(others))).drop("n", "c", "s")


def _dealt(keyed: DataFrame) -> DataFrame:
    """64-bit nodes' buckets with the large ones dealt out by blocks of 12 of their other 48 bits.

    Pairs within 3 bits agree on one of those as well.
    """
    large = cut(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > LARGE))
    met = keyed.join(large, "bucket", "left").withColumn("w0", _word(0))
    mask = F.shiftright("bucket", 16)
    high = lambda k: _bits(F.col("w0"), 0, 16 * k) if k else F.lit(0).cast("long")
    low = lambda k: _bits(F.col("w0"), 16 * k + 16, 48 - 16 * k) if k < 3 else F.lit(0).cast("long")
    rest = F.coalesce(*(F.when(mask == k, F.shiftleft(high(k), 48 - 16 * k).bitwiseOR(low(k))) for k in range(4)))
    met = met.withColumn("rest", F.shiftleft(rest, 16))
    again = F.array(*(F.xxhash64("bucket", F.lit(k), _bits(F.col("rest"), 12 * k, 12)) for k in range(4)))
    return met.select("node", F.explode(F.when(F.col("n").isNull(), F.array("bucket")).otherwise(again)).alias("bucket"))


def link(nodes: DataFrame, bits: int = 64, radius: int = 3, nearest: bool = False) -> DataFrame:
    """Spanning edges (a, b) among distinct nodes (binary column ``node``, its first bits a fingerprint) within ``radius`` bits.

    All links are found of 64 bits with a radius of at most 3; else those that agree on
    one of ``byte_pairs``. With ``nearest``, nodes have a ``part``, and the edges are each
    node's closest ones, per bucket, to another part.
    """
    if bits == 64 and radius > 3:
        raise ValueError("64 bits are for a radius of 3 at most")
    keyed = bucketed(nodes, bits)
    dealt = _dealt(keyed) if bits == 64 else sliced(keyed, SLICE)
    dealt = dealt.select("bucket", "node", *(["part"] if nearest else [])).repartition("bucket").sortWithinPartitions("bucket", "node")
    return dealt.mapInArrow(_edges(radius, bits // 64, nearest), "a binary, b binary").distinct()


# -- components ----------------------------------------------------------------


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``u``. It is written, so that the join by ``u`` has plain exchanges, which Spark splits where a hub's rows are many."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    met = both.where("v > u").join(_least(both), "u")
    return met.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges from the larger to the smaller node."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = _least(down)
    moved = down.join(low, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("u", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node that it reaches."""
    edges = cut(edges.where("a <> b").select("a", "b"))
    while True:
        edges = cut(_small_star(cut(_large_star(edges))))
        # done if every node has one root, and no root has one itself
        n, own = edges.agg(F.count("*"), F.count_distinct("a")).first()
        if n == own and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


# -- the operator ---------------------------------------------------------------

def _tag(doc_id: Column) -> Column:
    """16 bytes that sort like the ids, null after all."""
    turned = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.unhex(F.when(doc_id.isNull(), F.lit("01" + "0" * 30)).otherwise(F.concat(F.lit("0" * 16), turned)))


def _tagged(tag: Column) -> Column:
    own = F.conv(F.hex(F.substring(tag, 9, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.substring(tag, 1, 1) == F.lit(b"\x00"), own)


def grouped(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of ``fps`` (doc_id, fp), which should be a written table.

    A node is a fingerprint and the smallest id that has it; components compare the
    ids first, so that a component's least node holds its id.
    """
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = link(nodes.select(F.concat("fp", _tag(F.col("first_id"))).alias("node")), 64, radius)
    turn = lambda c: F.concat(F.substring(c, 9, 16), F.substring(c, 1, 8))
    roots = components(edges.select(turn("a").alias("a"), turn("b").alias("b")))
    roots = roots.select(F.substring("node", 17, 8).alias("fp"), _tagged(F.col("root")).alias("least"), F.lit(True).alias("linked"))
    met = nodes.join(roots, "fp", "left")
    return met.select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    fps = cut(fingerprints(docs, shingle))
    parts = cut(grouped(fps, radius))  # written, so that Spark can split a fingerprint that many rows have
    return fps.join(parts, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
