"""Spelling variant grouping (operator 11): a trie self-join with active-node sets.

Two words are near if they differ by one inserted, deleted or replaced code point.
The vocabulary's trie is partitioned by prefix and cut into slabs of three levels: a
slab lies below a prefix, and its terminals are the next three (or, for the longer
word of a pair, four) code points of words that go on alike. In each slab active
nodes are propagated from the root down: the active set of a node holds the nodes at
an edit distance of one or less from it, and a child's set follows from its parent's
by a deletion, a match, a replacement or an insertion. Once the distance is spent a
pair of nodes goes down by equal code points only; below the slab the shuffle key
does that, as it holds the prefix and the rest. A near pair meets in the slab where
the words part. Pairs of terminals at distance one are the near words.

A slab has at most 90 ** 4 terminals (the alphabet's words of four), however large
the vocabulary, and words with a common prefix are dealt out over all that follows;
so no prefix, suffix or length is a hot group. Words are counted before they are
shuffled. A word's form has five times its count or more, so chains of forms are
shorter than the logarithm of the largest count, and roots are found by doubling.

Defined results: null text has no words; an empty table, or one without a word often
enough, gives no rows; very long texts are read whole; rows that are repeated count
as often as they stand; a null id is the empty string in a run's hash; equal counts
among near words go to the smaller in code-point order; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, offsets, small_batches

#: Fixed values of the contract: runs of letters, lower case, one in so many loses a code point; shortest word, fewest occurrences, how much larger a form is.
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROPPED, SHORTEST, FEWEST, LARGER = 199, 6, 5, 5
#: Levels of a slab.
LEVELS = 3


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.filter(runs, lambda r: F.length(r) >= shortest)).alias("run"))
    h = own.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.expr("substr(run, 1, cast(h % length(run) AS int))"), F.col("run").substr(at + 2, F.length("run")))
    words = h.select(F.when(F.col("h") % DROPPED == 0, less).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count("word").alias("n"))
    return counts.filter((F.length("word") >= shortest) & (F.col("n") >= fewest))


def slabs(vocab: DataFrame) -> DataFrame:
    """(key, mid, word, n): the slabs of each word. The key is the prefix and what follows the slab; it holds for the shorter word of a pair, and one code point later for the longer one."""
    length = F.length("word")
    spans = F.concat(
        F.transform(F.sequence(F.lit(0), F.floor(length / LEVELS).cast("int")), lambda k: F.struct((k * LEVELS).alias("start"), F.lit(LEVELS).alias("span"))),
        F.transform(F.filter(F.sequence(F.lit(0), F.floor((length - LEVELS - 1) / LEVELS).cast("int")), lambda k: k >= 0), lambda k: F.struct((k * LEVELS).alias("start"), F.lit(LEVELS + 1).alias("span"))),
    )
    rows = vocab.select("word", "n", F.explode(spans).alias("s"))
    return rows.select(
        F.expr("concat(substr(word, 1, s.start), ' ', substr(word, s.start + s.span + 1))").alias("key"),
        F.expr("substr(word, s.start + 1, s.span)").alias("mid"),
        "word",
        "n",
    )


def _ragged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range its number, repeated, and the places in it."""
    lens = stop - start
    out = offsets(lens)
    which = np.repeat(np.arange(len(start)), lens)
    return which, np.arange(out[-1]) - out[which] + start[which]


def near_pairs(group: np.ndarray, mids: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (both ways) of rows of the same group whose strings are at distance one, by propagation down the groups' tries.

    Strings are distinct within a group and have at most four code points below 256.
    """
    depth = max(map(len, mids), default=0)
    chars = np.zeros((len(mids), depth + 1), np.int64)
    for i, m in enumerate(mids):
        chars[i, : len(m)] = np.frombuffer(m.encode("latin-1"), np.uint8)
    # The nodes of all tries, level by level: parent, code point, the row that ends there.
    first, at = np.unique(group, return_inverse=True)
    parent, char, level = [np.full(len(first), -1)], [np.zeros(len(first), np.int64)], [0, len(first)]
    own = [at]
    for i in range(depth):
        has = np.flatnonzero(chars[:, i])
        key, place = np.unique(at[has] << 8 | chars[has, i], return_inverse=True)
        parent.append(key >> 8)
        char.append(key & 255)
        at = np.full(len(mids), -1)
        at[has] = place + level[-1]
        own.append(at)
        level.append(level[-1] + len(key))
    parent, char = np.concatenate(parent), np.concatenate(char)
    ends = np.full(level[-1], -1)
    lens = np.array([len(m) for m in mids], np.int64)
    ends[np.stack(own)[lens, np.arange(len(mids))] if len(mids) else np.zeros(0, np.int64)] = np.arange(len(mids))
    # Nodes are in the order of their parents, so a node's children are a range.
    child = level[1] + offsets(np.bincount(parent[level[1] :], minlength=level[-1]))

    def children(node):
        which, at = _ragged(child[node], child[node + 1])
        return which, at

    roots = np.arange(level[1])
    which, below = children(roots)
    u, v, d = np.r_[roots, roots[which]], np.r_[roots, below], np.r_[np.zeros(len(roots), np.int64), np.ones(len(below), np.int64)]
    left, right = [], []
    while len(u):
        done = (d == 1) & (ends[u] >= 0) & (ends[v] >= 0)
        left.append(ends[u[done]])
        right.append(ends[v[done]])
        which, u = children(u)
        v, d = v[which], d[which]
        deleted = d == 0
        which, lower = children(v)
        cost = d[which] + (char[lower] != char[u[which]])
        kept = cost <= 1
        mu, mv, md = u[which][kept], lower[kept], cost[kept]
        same = np.flatnonzero(md == 0)
        which, inserted = children(mv[same])
        u, v, d = np.concatenate([mu, u[deleted], mu[same][which]]), np.concatenate([mv, v[deleted], inserted]), np.concatenate([md, np.ones(deleted.sum() + len(inserted), np.int64)])
        order = np.lexsort((d, v, u))
        u, v, d = u[order], v[order], d[order]
        new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
        u, v, d = u[new], v[new], d[new]
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


def _pairs(batches):
    for batch in batches:
        lists = batch.column(0)
        rows = lists.flatten()
        word, n = rows.field("word"), rows.field("n")
        group = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        a, b = near_pairs(group, rows.field("mid").to_pylist())
        a, b = pa.array(a), pa.array(b)
        yield pa.RecordBatch.from_arrays([word.take(a), word.take(b), n.take(b)], ["word", "near", "near_n"])


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, near, near_n): every near pair both ways, once. A word of ``vocab`` stands there once, with code points below 256."""
    small_batches(vocab.sparkSession)
    groups = slabs(vocab).groupBy("key").agg(F.collect_list(F.struct("mid", "word", "n")).alias("rows")).filter(F.size("rows") > 1)
    # The words of a repeated letter part in more than one slab.
    return groups.select("rows").mapInArrow(_pairs, "word string, near string, near_n long").distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one; they must not go round."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return roots


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, larger: int = LARGER) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; see the contract's names in the module's text."""
    vocab = cut(vocabulary(docs, shortest, fewest))
    best = near_words(vocab).groupBy("word").agg(F.count("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    largest = -F.col("best.less")
    is_form = largest >= larger * F.col("n")
    formed = cut(vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, largest).alias("form_n")))
    roots = with_roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The table of CRC-32 by its polynomial, runs and their hashes, pairs by what is left without a code point.
ORACLE = f"""
WITH RECURSIVE steps(i, c, s) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, s + 1 FROM steps WHERE s < 8),
 crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE s = 8),
 runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents),
 counted AS (SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= {SHORTEST} GROUP BY id, run),
 bytes AS (SELECT run, times, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END)) AS b FROM counted),
 hashed AS (SELECT run, times, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) AS h FROM bytes, crc),
 edited AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
 vocab AS (SELECT word, sum(times)::BIGINT AS n FROM edited WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(times) >= {FEWEST}),
 gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS left_over FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
 near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b USING (left_over, i) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN vocab b ON a.left_over = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN vocab b ON a.left_over = b.word),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
 formed AS (SELECT vocab.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {LARGER} * n THEN near END AS form, CASE WHEN near_n >= {LARGER} * n THEN near_n END AS form_n
  FROM vocab LEFT JOIN ranked ON ranked.word = vocab.word AND r = 1),
 chain(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL),
 last AS (SELECT chain.word, chain.root FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)
"""
