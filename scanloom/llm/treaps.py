"""Ranked lexical search (operator 13): inverted treaps with simultaneous traversal.

Each term of a shard of documents has a treap over its postings: in-order they
stand by doc_id, and no posting has a larger impact than its parent. A query goes
down the treaps of all its terms at once. Its unit is a range of doc_ids with, per
term, the root of the part of the treap that lies in the range; the sum of these
roots' weighted impacts bounds the score of every document there. A range whose
bound cannot enter the best k so far is dropped whole; another is split at the
document of its strongest root, that document is scored, and in each treap both
sides' roots are found by going down. Many ranges go in one numpy step, those of
highest bound first.

On Spark: terms of the queries are made distinct, one pass over the texts writes
each document's length and its counts of asked terms, statistics of all documents
come from that table, and each of its tasks searches its documents shard by shard,
with the best k so far carried on. Only the best k of a query leave a task. Postings
are never shuffled, so a term of all documents is no hot key. Queries go in blocks of
``BLOCK`` (item, term) pairs, the one thing that the driver holds.

Defined results: null text has no term and is in no result; an item without terms,
or none of whose terms occurs, has no rows; rows of items that share an id (or have
none) are one item with all their terms; document rows are ranked each for itself, so
repeated rows stand beside each other, and null ids come last among equal scores;
very long texts are read whole; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, offsets, small_batches, text_chunks

#: Fixed values of the contract: term characters (all but ASCII that is no letter or digit), length constants.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (item, term) pairs of a block of queries; documents of a shard; ranges of one step of the traversal.
BLOCK, SHARD, STEP = 200_000, 16_384, 256
#: Parts in which one item's candidates of all tasks are reduced first.
SLICES = 64
#: Every byte of a text in UTF-8: letters in lower case, what separates terms as a space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_pairs(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct."""
    terms = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(terms).alias("term")).distinct()


def forward(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, slots, tfs) of documents that have a term: its terms with repeats, and the counts of those asked for."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast([t.encode() for t in terms])

    def run(batches):
        slot_of = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(texts):
                n, hits, rows = np.zeros(b - a, np.int64), [], []
                for i, t in enumerate(texts[a:b]):
                    words = t.encode().translate(BYTES).split()
                    n[i] = len(words)
                    hits.append([slot_of[w] for w in words if w in slot_of])
                    rows.append(len(hits[-1]))
                row = np.repeat(np.arange(b - a), rows)
                key, tf = np.unique(row * len(slot_of) + np.fromiter((s for h in hits for s in h), np.int64, sum(rows)), return_counts=True)
                row, slot = np.divmod(key, max(len(slot_of), 1))
                off = pa.array(offsets(np.bincount(row, minlength=b - a)), pa.int32())
                lists = [pa.ListArray.from_arrays(off, pa.array(x, pa.int32())) for x in (slot, tf)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *lists], ["doc_id", "n", "slots", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, slots array<int>, tfs array<int>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's share of a score but for the term's weight; ``n`` is its document's length."""
    if int(n.max(initial=0)) * 50 * n_docs < 2**63:
        m = 50 + 50 * n * n_docs // n_terms
    else:
        m = np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 10**9 * tf // (1000 * tf + 20 * m)


class Treaps:
    """The treaps of a shard's terms. Documents are numbers 0, 1, ... by doc_id."""

    def __init__(self, slot: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        """Postings in the order of documents."""
        self.n_docs, self.row_off, self.row_slot, self.row_impact = n_docs, offsets(np.bincount(doc, minlength=n_docs)), slot, impact
        order = np.argsort(slot, kind="stable")
        slot, doc, impact = slot[order], doc[order], impact[order]
        at = np.arange(len(slot))
        # Equal impacts are ordered by a hash of the place, so that long runs of them don't make deep treaps.
        key = impact << 32 | ((at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
        first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
        last = np.r_[first[1:], True] if len(slot) else first
        before, after = self._nearest(key, np.where(first, -1, at - 1), True), self._nearest(key, np.where(last, -1, at + 1), False)
        # The parent is the lower one of the nearest higher postings on both sides.
        under_after = (after >= 0) & ((before < 0) | (key[after] <= key[before]))
        under_before = (before >= 0) & ~under_after
        self.left, self.right = np.full(len(slot) + 1, -1), np.full(len(slot) + 1, -1)
        self.left[after[under_after]] = at[under_after]
        self.right[before[under_before]] = at[under_before]
        roots = at[(before < 0) & (after < 0)]
        self.root = dict(zip(slot[roots].tolist(), roots.tolist(), strict=True))
        # The last place of each array, -1, stands for an empty part.
        self.impact = np.r_[impact, 0]
        self.doc = np.r_[doc, -1]

    @staticmethod
    def _nearest(key: np.ndarray, near: np.ndarray, ties: bool) -> np.ndarray:
        """The nearest posting of a higher key along ``near``; all are lower up to there. Jumps are taken for all postings at once."""
        while True:
            has = np.flatnonzero(near >= 0)
            k, own = key[near[has]], key[has]
            lower = has[(k < own) if ties else (k <= own)]
            if not len(lower):
                return near
            near[lower] = near[near[lower]]

    def _down(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From each range's nodes down to the first ones that lie in the range: the roots of what the range has of the treaps."""
        flat, terms = nodes.reshape(-1), nodes.shape[1]
        go = np.flatnonzero(flat >= 0)
        while len(go):
            doc, row = self.doc[flat[go]], go // terms
            over, under = doc > high[row], doc < low[row]
            flat[go[over]] = self.left[flat[go[over]]]
            flat[go[under]] = self.right[flat[go[under]]]
            go = go[over | under]
            go = go[flat[go] >= 0]
        return nodes

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        lens = self.row_off[docs + 1] - self.row_off[docs]
        out = offsets(lens)
        at = np.arange(out[-1]) + np.repeat(self.row_off[docs] - out[:-1], lens)
        total = offsets(weight[self.row_slot[at]] * self.row_impact[at])
        return np.diff(total[out])

    def search(self, slots: list[int], weight: np.ndarray, best: Best) -> int:
        """Offer ``best`` every document that can enter it; ``weight`` is 0 for slots that aren't asked for. Returns the documents scored."""
        slots = [s for s in slots if s in self.root and weight[s] > 0]
        if not slots:
            return 0
        w = weight[slots]
        nodes = np.array([[self.root[s] for s in slots]])
        low, high = np.zeros(1, np.int64), np.full(1, self.n_docs - 1)
        bound, scored = (self.impact[nodes] * w).sum(1), 0
        while len(bound):
            now = np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else np.arange(len(bound))
            own = nodes[now]
            strongest = np.argmax(self.impact[own] * w, axis=1)
            d = self.doc[own[np.arange(len(own)), strongest]]
            best.offer(d, self.scores(d, weight))
            scored += len(d)
            sides = np.repeat(own, 2, axis=0)
            new_low = np.stack([low[now], d + 1], axis=1).reshape(-1)
            new_high = np.stack([d - 1, high[now]], axis=1).reshape(-1)
            sides = self._down(sides, new_low, new_high)
            new = (self.impact[sides] * w).sum(1)
            least = best.least()
            rest = bound >= least
            rest[now] = False
            some = new >= least
            nodes, bound = np.concatenate([nodes[rest], sides[some]]), np.r_[bound[rest], new[some]]
            low, high = np.r_[low[rest], new_low[some]], np.r_[high[rest], new_high[some]]
        return scored


class Best:
    """The best k (score, id) of one query; ids are those of the shard being searched."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def begin(self, ids: np.ndarray) -> None:
        self.ids = ids

    def least(self) -> int:
        """Below it nothing can enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def offer(self, docs: np.ndarray, score: np.ndarray) -> None:
        some = score >= self.least()
        score, doc = np.r_[self.score, score[some]], np.r_[self.doc, self.ids[docs[some]]]
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


NO_ID = 2**63 - 1


def _search(block, k: int, n_docs: int, n_terms: int):
    """A task's work: its documents in shards, all queries of the block on each."""

    def run(batches):
        queries, weight = block.value
        best = [Best(k) for _ in queries]

        def shard(parts):
            ids = np.concatenate([pc.fill_null(p.column(0), NO_ID).to_numpy(zero_copy_only=False) for p in parts])
            n = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts])
            lens = np.concatenate([pc.list_value_length(p.column(2)).to_numpy(zero_copy_only=False) for p in parts])
            slot, tf = (np.concatenate([p.column(c).flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64) for c in (2, 3))
            by_id = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            doc = np.repeat(place, lens)
            impact = impacts(tf, np.repeat(n, lens), n_docs, n_terms)
            order = np.argsort(doc, kind="stable")
            treaps = Treaps(slot[order], doc[order], impact[order], len(ids))
            own = np.zeros(len(weight), np.int64)
            for q, b in zip(queries, best, strict=True):
                own[q] = weight[q]
                b.begin(ids[by_id])
                treaps.search(q, own, b)
                own[q] = 0

        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows
            if size >= SHARD:
                shard(parts)
                parts, size = [], 0
        if size:
            shard(parts)
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        doc, score = (np.concatenate([getattr(b, x) for b in best]) if best else np.zeros(0, np.int64) for x in ("doc", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == NO_ID), pa.array(score)], ["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of highest score above 0, equal scores by doc_id."""
    spark = docs.sparkSession
    pairs = cut(term_pairs(items))
    blocks = -(-pairs.count() // BLOCK) or 1
    found = None
    for number in range(blocks):
        of_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number if blocks > 1 else F.lit(True)
        one = _search_block(docs, pairs.filter(of_block).toArrow(), items.schema["item_id"].dataType.simpleString(), k)
        found = one if found is None else found.unionByName(one)
    best = Window.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = F.row_number()
    found = found.withColumn("slice", F.spark_partition_id() % SLICES)
    found = found.withColumn("rank", rank.over(best.partitionBy("item_id", "slice"))).filter(F.col("rank") <= k)
    found = found.withColumn("rank", rank.over(best.partitionBy("item_id"))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, pairs: pa.Table, id_type: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    terms = pairs["term"].combine_chunks().dictionary_encode()
    item = pairs["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    slot, terms = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary.to_pylist()
    ids = spark.createDataFrame(list(enumerate(item.dictionary.to_pylist())), f"item long, item_id {id_type}")
    item = item.indices.to_numpy(zero_copy_only=False)
    queries = [x.tolist() for x in np.split(slot[np.lexsort((slot, item))], np.cumsum(np.bincount(item))[:-1])] if len(item) else []
    table = cut(forward(docs, terms))
    n_docs, n_terms = table.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for s, n in table.select(F.explode("slots").alias("slot")).groupBy("slot").count().toLocalIterator():
        df[s] = n
    block = spark.sparkContext.broadcast((queries, weights(df, n_docs)))
    found = table.mapInArrow(_search(block, k, n_docs, n_terms), "item long, doc_id long, score long")
    return found.join(ids, "item").select("item_id", "doc_id", "score")


#: Lower case of A-Z only, terms by the contract's pattern, scores in 64-bit integers.
ORACLE = f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
 tokens AS (SELECT doc_id, r, unnest(ts) AS term FROM words),
 lengths AS (SELECT doc_id, r, count(*) AS n FROM tokens GROUP BY doc_id, r),
 totals AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM lengths),
 postings AS (SELECT r, term, count(*) AS tf FROM tokens GROUP BY r, term),
 w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, nd),
 asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
 scored AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN postings USING (term) JOIN lengths USING (r), totals GROUP BY item_id, doc_id, r),
 ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
