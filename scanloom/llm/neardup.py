"""One document of each group of near-duplicates, by SimHash and an exact check.

Documents are near-duplicates if their distinct five-word shingles have a Jaccard
similarity of ``NEAR`` or more. Wide fingerprints (256 bits, of distinct shingles)
propose links through the Gray-order index of operator 10; each proposed link is then
checked on the shingles themselves. Texts of few shingles, whose bits are often tied,
are also joined by the shingles that their smallest ones must share, which loses none.
Groups are the components of the links that stand.

Few links are looked at: a spanning forest of the proposals first. Of the parts that
this leaves and that a refused link leads out of, every node's closest ones in other
parts come next, and what is still apart is looked at whole inside the buckets' tasks,
in slices of bounded size, where no pair is emitted that doesn't join two parts.

Defined results: null and empty texts and those without a word are alike and unlike
any other; very long texts count whole; of a group the row with the smallest id stays
(null after all, then by hashes of text and row), and of rows that are equal in all
columns one; an empty table stays empty; other columns, of whatever names, come along.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .common import cut, offsets, ragged_take, small_batches, text_chunks
from .minhash import shingle_hashes
from .simhash import LOWER, SEED, bucket_runs, bucketed, components, fold, leading_words, link, near_pairs, sliced, whole_buckets

#: Least Jaccard similarity of near-duplicates, as a fraction.
NEAR = (4, 5)
BITS = 256
#: Differing bits of a proposed link. At a similarity of 0.8 a share of acos(2 * 0.8 / 1.8) / pi = 0.151
#: of them differ: 38.8 on average, with a standard deviation of 5.7; of unrelated texts 128 with 8.
RADIUS = 56
#: Texts of so many distinct shingles are also joined by shared ones. A partner of a smaller text has at most a quarter more.
FEW = 50
#: Rounds of closest links before what is left is looked at whole, and rows with their shingles of a bucket that a task holds at most.
NEAREST_ROUNDS, ROWS = 2, 2048


def distinct_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct five-word shingles' hashes of all texts (A-Z in lower case), in order, and each text's offsets."""
    low = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    flat, off = shingle_hashes(low)
    owner = np.repeat(np.arange(len(texts)), np.diff(off))
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[keep], offsets(np.bincount(owner[keep], minlength=len(texts)))


def _plain(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that have one."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if _plain(f.dataType)))


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """(key, node, few) of every row.

    ``node`` has BITS bits and eight bytes of a digest of the distinct shingles, so that
    texts share it only if they share their shingles; ``few`` are these of texts that have
    at most FEW, and ``key`` tells rows apart and orders them.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            nodes, few = [], []
            for a, b in text_chunks(texts, 2 << 20):
                flat, off = distinct_shingles(texts[a:b])
                ties = np.zeros(b - a, np.uint64)
                own = np.flatnonzero(np.diff(off))
                ties[own] = flat[off[own]]
                words, raw = fold(flat, off, BITS // 64, ties).astype(">u8"), flat.astype("<u8")
                for i in range(b - a):
                    held = raw[off[i] : off[i + 1]].tobytes()
                    nodes.append(words[i].tobytes() + xxhash.xxh64_digest(held, SEED))
                    few.append(held if 0 < len(held) <= 8 * FEW else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(few, pa.binary())], ["key", "node", "few"])

    kind = "key struct<none:boolean,doc_id:bigint,text_hash:bigint,row_hash:bigint>"
    return docs.select(_key(docs).alias("key"), F.col("text").cast("string")).mapInArrow(run, f"{kind}, node binary, few binary")


def _key(docs: DataFrame) -> Column:
    doc_id = F.col("doc_id").cast("long")
    return F.struct(
        doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), _row_hash(docs).alias("row_hash")
    )


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of ``wanted`` (node, key): the distinct hashes in order, as bytes, of the row with that key."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, sets = batch.column(1).to_pylist(), []
            for a, b in text_chunks(texts, 2 << 20):
                flat, off = distinct_shingles(texts[a:b])
                raw = flat.astype("<u8")
                sets += [raw[off[i] : off[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    parts = ["none", "doc_id", "text_hash", "row_hash"]
    asked = wanted.select("node", *(F.col(f"key.{p}").alias(p) for p in parts))
    own = docs.select(F.col("text").cast("string").alias("own_text"), _key(docs).alias("key"))
    own = own.select("own_text", *(F.col(f"key.{p}").alias(p) for p in parts))
    return own.join(asked, parts).select("node", "own_text").mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``edges`` (a, b) whose shingles have a Jaccard similarity of ``NEAR`` or more."""
    part, whole = NEAR

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(whole * both >= part * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sized = sets.withColumn("n", F.length("shingles"))
    one = sized.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("n").alias("m"))
    pairs = edges.join(one, "a").join(sized.withColumnRenamed("node", "b"), "b").where(whole * F.least("m", "n") >= part * F.greatest("m", "n"))
    return pairs.select("a", "b", "x", "shingles").mapInArrow(run, "a binary, b binary")


def near_sets(flat: np.ndarray, off: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Which of the sets ``js`` are near to set ``i``."""
    part, whole = NEAR
    own, n = flat[off[i] : off[i + 1]], off[js + 1] - off[js]
    found = np.zeros(len(js), bool)
    fit = np.flatnonzero(whole * np.minimum(n, len(own)) >= part * np.maximum(n, len(own)))
    for f in range(0, len(fit), 512):
        some = fit[f : f + 512]
        held, at = ragged_take(flat, off, js[some])
        place = np.minimum(np.searchsorted(own, held), len(own) - 1)
        both = np.add.reduceat((own[place] == held).astype(np.int64), at[:-1])
        found[some] = whole * both >= part * (len(own) + n[some] - both)
    return found


def _joined(radius: int | None):
    """Rows (bucket, node, part, shingles) in the order of their buckets to near edges (a, b) between parts.

    Of all pairs, or those within the radius. Two rows that edges of the bucket already
    connect aren't looked at, so that there are fewer edges than rows.
    """

    def every(starts: np.ndarray, sizes: np.ndarray):
        for s, n in zip(starts, sizes, strict=True):
            for i in range(s, s + n - 1):
                yield np.full(s + n - 1 - i, i), np.arange(i + 1, s + n)

    def run(batches):
        for table in whole_buckets(batches):
            raw, sets = table.column("node"), table.column("shingles").to_pylist()
            flat, off = np.frombuffer(b"".join(sets), "<u8"), offsets([len(x) // 8 for x in sets])
            label = table.column("part").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            starts, sizes = bucket_runs(table)
            own = np.repeat(np.arange(len(starts)), sizes)
            _, label = np.unique(own * (label.max() + 1) + label, return_inverse=True)  # a part in each bucket for itself
            out: list[tuple[int, int]] = []
            pairs = every(starts, sizes) if radius is None else near_pairs(leading_words(raw, BITS // 64), starts, sizes, radius)
            for a, b in pairs:
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    continue
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                first = np.flatnonzero(np.diff(a, prepend=-1))
                for p, q in zip(first, [*first[1:], len(a)], strict=True):
                    i, js = int(a[p]), b[p:q]
                    js = js[label[js] != label[i]]
                    if not len(js):
                        continue
                    for j in js[near_sets(flat, off, i, js)].tolist():
                        if label[i] != label[j]:
                            s = starts[own[i]]
                            mine = label[s : s + sizes[own[i]]]
                            mine[mine == label[j]] = label[i]
                            out.append((i, j))
            if out:
                i, j = (pa.array(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in (raw.take(i), raw.take(j))], ["a", "b"])

    return run


def _in_buckets(keyed: DataFrame, radius: int | None) -> DataFrame:
    dealt = sliced(keyed, ROWS).select("bucket", "node", "part", "shingles")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_joined(radius), "a binary, b binary").distinct()


def short_keys(few: DataFrame) -> DataFrame:
    """(bucket, node) of the shingles by which near sets of ``few`` (node, few) must meet.

    Of two near sets in one order, the first n - ceil(0.8 n) + 1 members have one in
    common. The order is that of document frequency, the rarest first, so that a phrase
    of many texts is a key only of texts that have little else; a shingle of one text
    takes a place but is no key, since it meets nothing.
    """
    part, whole = NEAR

    def run(batches):
        for batch in batches:
            sets = batch.column(1)
            n = pa.array([len(x) // 8 for x in sets.to_pylist()], pa.int32())
            flat = np.frombuffer(b"".join(sets.to_pylist()), "<i8")
            take = pa.array(np.repeat(np.arange(len(sets)), n.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), n.take(take), pa.array(flat)], ["node", "n", "shingle"])

    rows = few.mapInArrow(run, "node binary, n int, shingle long")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    own = rows.join(shared, "shingle").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    first = F.col("n") - F.ceil(F.col("n") * part / whole).cast("int") + 1 - (F.col("n") - F.size("s"))
    return own.select("node", F.explode(F.slice("s", F.lit(1), F.greatest(first, F.lit(0)))).alias("s")).select(F.col("s.shingle").alias("bucket"), "node")


def short_links(nodes: DataFrame) -> DataFrame:
    """Near edges (a, b) of the ``nodes`` (node, few) that connect all that near links do."""
    few = nodes.where("few is not null").select("node", "few")
    keyed = short_keys(few).join(few, "node").select("bucket", "node", F.col("node").alias("part"), F.col("few").alias("shingles"))
    return _in_buckets(cut(keyed), None)


def confirmed_roots(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) over all links of ``nodes`` (node, key, few) that are proposed and near, for nodes that have one."""
    proposed = cut(link(nodes.select("node"), BITS, RADIUS))
    short = cut(short_links(nodes))
    ends = proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(shingle_sets(docs, nodes.join(ends, "node", "left_semi").select("node", "key")))
    good = cut(confirmed(proposed, sets).union(short))
    parts = cut(components(good))

    def left() -> DataFrame:
        """(node, part) of the parts that a proposed link leads out of."""
        known = parts.withColumnRenamed("root", "part")
        a, b = (known.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
        met = proposed.join(a, "a", "left").join(b, "b", "left")
        ends = met.select(F.coalesce("part_a", "a").alias("p"), F.coalesce("part_b", "b").alias("q")).where("p <> q").distinct()
        open_parts = cut(ends.select(F.explode(F.array("p", "q")).alias("part")).distinct())
        own = nodes.join(known, "node", "left").select("node", F.coalesce("part", "node").alias("part"))
        return cut(own.join(open_parts, "part", "left_semi").select("node", "part"))

    def merged(more: DataFrame, own: DataFrame) -> DataFrame:
        """The parts after further good links (a, b) between nodes of ``own``: components of the parts that they join."""
        a, b = (own.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
        met = more.join(a, "a").join(b, "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct()
        roots = cut(components(met).select(F.col("node").alias("part"), F.col("root").alias("top")))
        every = parts.select("node", F.col("root").alias("part")).union(own.where("node = part"))
        every = every.join(roots, "part", "left").select("node", F.coalesce("top", "part").alias("root"))
        return cut(every.where("node <> root").distinct())

    for _ in range(NEAREST_ROUNDS):
        own = left()
        if own.isEmpty():
            return parts
        closest = link(own, BITS, RADIUS, nearest=True)
        closest = closest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        parts = merged(cut(confirmed(closest, sets)), own)
    own = left()
    if own.isEmpty():
        return parts
    keyed = cut(bucketed(own, BITS))
    mixed = cut(keyed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket"))
    rest = keyed.join(mixed, "bucket", "left_semi").join(sets, "node")
    return merged(cut(_in_buckets(rest, RADIUS)), own)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each group of near-duplicates; columns stay."""
    fps = cut(wide_fingerprints(docs))
    nodes = cut(fps.groupBy("node").agg(F.min("key").alias("key"), F.max("few").alias("few")))
    worded = nodes.where(F.substring("node", 1, BITS // 8) != F.lit(bytes(BITS // 8)))
    roots = confirmed_roots(docs, worded)
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("key").alias("key"))
    # Decided on narrow rows; the texts are shuffled once, by the columns of the key.
    mark = f"__{uuid.uuid4().hex}"
    names = [f"{mark}_{p}" for p in ("none", "doc_id", "text_hash", "row_hash")]
    keys = kept.select(*(F.col("key").getField(n.removeprefix(f"{mark}_")).alias(n) for n in names))
    own = docs.withColumn(mark, _key(docs)).withColumns({n: F.col(mark).getField(n.removeprefix(f"{mark}_")) for n in names}).drop(mark)
    return own.join(keys, names, "left_semi").dropDuplicates(names).select(*(F.col(f"`{c}`") for c in docs.columns))


def recall(similarity: float, pairs: int = 100_000, seed: int = 1) -> float:
    """Share of simulated pairs of that similarity which the bits propose, for independent bits."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    off = np.random.default_rng(seed).random((pairs, BITS), np.float32) < p
    same = ~off.reshape(pairs, -1, 8).any(axis=2)
    n = BITS // 8
    met = (same & np.roll(same, -1, axis=1)).any(axis=1) | (same[:, : n // 2] & same[:, n // 2 :]).any(axis=1)
    return float((met & (off.sum(axis=1) <= RADIUS)).mean())
