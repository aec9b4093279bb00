"""Spelling variants, token counts and ranked search against brute force and the libraries."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from scanloom.llm import counts, spelling, treaps

from .helpers import DOCS, frame, rows

# ---- operator 11


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return (out | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}) - {word}


def variants(data):
    n = collections.Counter()
    for doc_id, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    alphabet = {c for w in n for c in w}
    near = {w: [x for x in edits(w, alphabet) if x in n] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(spark, data, **more):
    got = spelling.variants(frame(spark, data), **more)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len({w for w, *_ in out})
    return set(out)


def spelled(seed):
    """Words of few letters in all lengths, with repeated letters, so that near words of every kind abound; counts spread over chains of forms."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randint(5, 9))) for _ in range(250)] + ["a" * i for i in range(4, 16)]
    words += ["internationalisation", "internationalization", "internationalizations", "Ünterschied", "Unterschied", "unterschied"]
    out, times = [], [5, 6, 30, 160, 900]
    for i, w in enumerate(words):
        out.append((i, " ".join([w.title() if i % 3 == 0 else w] * times[i % 5]), "en", "s", 1))
    return out


def test_variants_are_those_of_brute_force(spark):
    data = spelled(0) + rows()
    want = variants(data)
    assert any(w[1] and w[2] != w[1] for w in want)  # a chain of forms
    assert found(spark, data) == want


def test_pairs_are_those_of_all_edits(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(900)})
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = spelling.near_words(vocab).collect()
    want = {(w, x, words.index(x)) for w in words for x in edits(w, "abc") if x in set(words)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_trie_alone():
    mids = ["", "a", "b", "ab", "ba", "abc", "abcd", "bbcd", "xyz"]
    group = np.zeros(len(mids), np.int64)
    a, b = spelling.near_pairs(group, mids)
    assert {(mids[i], mids[j]) for i, j in zip(a, b)} == {(x, y) for x in mids for y in edits(x, "abcdxyz") if y in mids}
    a, b = spelling.near_pairs(np.arange(len(mids)), mids)  # each in a group of its own
    assert len(a) == len(b) == 0


def test_slabs_are_small_for_a_common_prefix(spark):
    """A third of a vocabulary below one prefix, or before one suffix, is dealt out."""
    words = ["".join(("prefix", *x)) for x in itertools.product("abcdefgh", repeat=4)] + ["".join((*x, "suffix")) for x in itertools.product("abcdefgh", repeat=4)]
    vocab = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    assert spelling.slabs(vocab).groupBy("key").count().agg({"count": "max"}).first()[0] <= 8**4
    assert spelling.slabs(vocab).groupBy("key").count().filter("count > 600").count() <= 4


def test_no_variants(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "letter " * 4, "en", "s", 1)]) == set()


# ---- operator 12

TOKENS = {
    "byte_bpe_50k.json": "tokenizers",
    "word_bpe_49k.json": "tokenizers",
    "piece_bpe_32k.model": "sentencepiece",
}
ODD = [" ", "  a", "a  b   c ", "a\n\n b\tc\r\nd", "x\x1c y", "a　 b  c", "don't we'll I'd", "<|endoftext|>", "a <|endoftext|>b <|endo", "ab12cd", "▁ a ▁", "a ▁b", "</s> <s>", "é ́x", "᠎ ᠎", "word " * 300, "日本語 テキスト", "x" * 9000, "😀 😀😀"]


@pytest.mark.parametrize("name", TOKENS)
def test_counts_are_those_of_the_library(spark, name):
    path = public_tokenizers.path(name)
    data = rows() + [(500 + i, t, "en", "s", len(t)) for i, t in enumerate(ODD)]
    texts = [r[1] or "" for r in data]
    if TOKENS[name] == "tokenizers":
        from tokenizers import Tokenizer

        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts] if len(texts) < 5 else [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    got = counts.token_counts(frame(spark, data).coalesce(2), path).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], len(t.encode()), n, n > 512) for r, t, n in zip(data, texts, want)), key=key)


def test_counts_without_memory_or_large_batches(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t or "" for _, t, *_ in rows()] + ODD
    want = counts.Counter(path).of_texts(texts)
    monkeypatch.setattr(counts, "REMEMBERED", 10)
    monkeypatch.setattr(counts, "BATCH", 16)
    counter = counts.Counter(path)
    assert (counter.of_texts(texts) == want).all() and len(counter.known) <= 10
    counter.boundary = None
    assert (counter.of_texts(texts) == want).all()


def test_batches_are_balanced_by_bytes():
    sizes = np.array([5, 5, 5, 100, 1, 1, 9, 10])
    runs = counts.balanced(sizes, 10)
    assert [sizes[r].tolist() for r in runs] == [[5, 5], [5], [100], [1, 1], [9], [10]]
    assert counts.balanced(np.zeros(0, np.int64), 10) == []


def test_no_counts(spark):
    assert counts.token_counts(frame(spark, [])).collect() == []


# ---- operator 13


def terms(text):
    return re.findall(treaps.TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))


def ranking(docs, items, k):
    words = [(r[0], collections.Counter(terms(r[1]))) for r in docs]
    words = [(i, c) for i, c in words if c]
    n_docs, n_terms = len(words), sum(sum(c.values()) for _, c in words)
    df = collections.Counter(t for _, c in words for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in asked.items():
        scored = []
        for doc_id, c in words:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def queries(spark, items):
    return spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS doc_id", "2 AS score", "'x' AS term")


def items_of(data, seed):
    rng = random.Random(seed)
    texts = [r[1] for r in data if r[1] and r[1].strip()]
    out = [(i, " ".join(rng.sample(terms(rng.choice(texts)) or ["none"], 1) + rng.choice(texts).split()[: rng.randint(1, 60)])) for i in range(30)]
    return [*out, (90, None), (91, ""), (92, "absentword"), (3, "an er th"), (None, "an ing"), (None, "ti"), (94, "AN! an? An")]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_rankings_are_those_of_brute_force(spark, k):
    data = rows()
    items = items_of(data, k)
    got = treaps.search(frame(spark, data), queries(spark, items), k)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranking(data, items, k)


def test_many_blocks_shards_and_steps(spark, monkeypatch):
    for name, value in (("BLOCK", 150), ("SLICES", 2)):
        monkeypatch.setattr(treaps, name, value)
    data = rows(2) + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(["an er th ing on"] * 200)]
    items = items_of(data, 5)
    assert sorted((tuple(r) for r in treaps.search(frame(spark, data).repartition(3), queries(spark, items), 9).collect()), key=str) == ranking(data, items, 9)


def test_no_rankings(spark):
    data = rows()
    assert treaps.search(frame(spark, []), queries(spark, [(1, "an")])).collect() == []
    assert treaps.search(frame(spark, data), queries(spark, [])).collect() == []
    assert treaps.search(frame(spark, [(1, None, "en", "s", None), (2, " .", "en", "s", 1)]), queries(spark, [(1, "an")])).collect() == []


def shard(seed, n_docs=3000, n_terms=200, flat=False):
    """Postings with frequent and rare terms; ``flat``: all impacts equal."""
    rng = np.random.default_rng(seed)
    has = rng.random((n_docs, n_terms)) < 1 / (1 + np.arange(n_terms))
    doc, slot = np.nonzero(has)
    impact = np.full(len(doc), 7) if flat else rng.integers(1, 1000, len(doc))
    return slot, doc, impact


@pytest.mark.parametrize("flat", [False, True])
def test_treaps_are_heaps_over_doc_order(flat):
    slot, doc, impact = shard(0, flat=flat)
    t = treaps.Treaps(slot, doc, impact, 3000)
    seen = []

    def walk(node):
        stack, out, depth = [(node, False, 1)], [], 0
        while stack:
            at, done, level = stack.pop()
            if at < 0:
                continue
            depth = max(depth, level)
            if done:
                out.append(at)
                continue
            for c in (t.left[at], t.right[at]):
                assert c < 0 or t.impact[c] <= t.impact[at]
            stack += [(t.right[at], False, level + 1), (at, True, level), (t.left[at], False, level + 1)]
        assert depth <= 12 + 6 * math.log2(len(out) + 1)
        return out

    for s, root in t.root.items():
        nodes = walk(root)
        assert (t.doc[nodes] == doc[slot == s]).all()
        seen += nodes
    assert sorted(seen) == list(range(len(slot)))


@pytest.mark.parametrize("flat", [False, True])
def test_traversal_is_exact_and_prunes(flat):
    slot, doc, impact = shard(1, flat=flat)
    t, rng = treaps.Treaps(slot, doc, impact, 3000), np.random.default_rng(2)
    scored = 0
    for _ in range(40):
        q = rng.choice(200, rng.integers(1, 12), replace=False)
        weight = np.zeros(200, np.int64)
        weight[q] = rng.integers(0, 50, len(q))
        best = treaps.Best(10)
        best.begin(np.arange(3000) * 3)
        scored += t.search(q.tolist(), weight, best)
        total = np.bincount(doc, weight[slot] * impact, 3000).astype(int)
        order = np.lexsort((np.arange(3000), -total))[:10]
        order = order[total[order] > 0]
        assert (best.doc == 3 * order).all() and (best.score == total[order]).all()
    if not flat:
        assert scored < 0.5 * 40 * 3000


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**12, 7 * 10**12])
    got = treaps.impacts(np.ones(3, np.int64), n, 10**9, 10**15)
    assert got.tolist() == [10**9 // (1000 + 20 * (50 + 50 * x * 10**9 // 10**15)) for x in n.tolist()]
