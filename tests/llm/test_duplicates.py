import hashlib
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scanloom.llm import minhash, neardup, simhash

from .helpers import DOCS, frame, rows, words


def fingerprint(text: str | None, size: int = 3) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_are_those_of_brute_force(spark):
    data = rows()
    got = simhash.near_duplicates(frame(spark), radius=3).collect()
    fps = [fingerprint(r[1]) for r in data]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for r, k in zip(data, label, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    key = lambda t: tuple("" if x is None else str(x) for x in t)
    want = sorted(((r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(data, fps, label, strict=True)), key=key)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(1, 2))
@settings(max_examples=40, deadline=None)
def test_gray_index_finds_every_link(seed, n, width):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (max(1, n // 8), width)).astype(np.uint64)
    fps = base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, width)).astype(np.uint64))
    fps = np.unique(fps, axis=0)
    fps = fps[simhash.gray_order(fps)]
    got = {(int(i), int(j)) for a, b in simhash.gray_links(fps, 3) for i, j in zip(a, b, strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= 3
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if near[i, j]}


def test_gray_neighbours_differ_in_one_bit():
    every = np.arange(256, dtype=np.uint64)[:, None]
    order = every[simhash.gray_order(every)][:, 0]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))


def test_large_buckets_are_dealt_out_whole(spark, monkeypatch):
    rng = random.Random(3)
    fps = {(0xABCD << 48) | rng.getrandbits(48) for _ in range(300)}
    fps |= {f ^ (1 << rng.randrange(48)) ^ (1 << rng.randrange(48)) for f in list(fps)[:150]}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "LARGE", 8)
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")),) for f in fps], "node binary")
    links = simhash.components(simhash.link(nodes)).collect()
    root = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in links}
    label = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    assert {f: root.get(f, f) for f in fps} == label


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    base = words(rng, 400)
    changed = base.split(" ")
    changed[50], changed[200] = "here", "there"
    data = [(3, base, "en", "s", 1), (1, " ".join(changed), "en", "s", 1), (2, words(rng, 400), "en", "s", 1), (7, base, "en", "s", 1), (7, base, "en", "s", 1), (None, words(rng, 300), None, None, None), (9, None, None, None, None)]
    docs = frame(spark, data)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, 1, 2, 9]
    assert neardup.keep_one(frame(spark, [])).count() == 0


def test_the_survivor_does_not_depend_on_partitions(spark):
    base = words(random.Random(5), 100)
    data = [(4, base, "en", source, n) for source in ("a", "b", "c") for n in (1, 2, None)] + [(None, base, "x", "y", 1), (5, base + " more", "en", "s", 1)] * 2
    found = {tuple(neardup.keep_one(frame(spark, data).repartition(n)).collect()) for n in (1, 3, 7)}
    assert len(found) == 1 and [r["doc_id"] for r in found.pop()] == [4]


def test_clashing_names_and_columns_without_a_hash(spark):
    docs = frame(spark, rows()[:20]).selectExpr("*", "map('a', 1) AS key", "2 AS node", "3 AS bucket2", "4 AS few", "5 AS part", "6 AS none", "7 AS row_hash", "8 AS text_hash")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() > 5


def test_short_texts_do_not_join_those_without_words(spark):
    rng = random.Random(8)
    texts = [words(rng, 6) for _ in range(3000)]
    flat, off = neardup.distinct_shingles(texts)
    ones = np.bitwise_count(simhash.fold(flat, off, 4, flat[off[:-1]])).sum(axis=1)
    near = [t for t, n in zip(texts, ones, strict=True) if n <= 104]
    assert len(near) >= 3
    docs = frame(spark, [(1, "", None, None, None), (2, None, None, None, None), *((10 + i, t, None, None, None) for i, t in enumerate(near))])
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == [1, *range(10, 10 + len(near))]


def _wide(texts: list[str]) -> tuple[list[set], np.ndarray]:
    flat, off = neardup.distinct_shingles(texts)
    return [set(flat[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)], simhash.fold(flat, off, 4, flat[off[:-1]])


def _proposed(sets: list[set], fps: np.ndarray, i: int, j: int) -> bool:
    """Whether the bits propose the link, or both texts have few shingles."""
    if max(len(sets[i]), len(sets[j])) <= neardup.FEW:
        return True
    if np.bitwise_count(fps[i] ^ fps[j]).sum() > neardup.RADIUS:
        return False
    x, y = (b"".join(int(w).to_bytes(8, "big") for w in fps[k]) for k in (i, j))
    return any(x[a] == y[a] and x[b] == y[b] for a, b in simhash.byte_pairs(256))


def _least_of_groups(texts: list[str], whole: bool = False) -> list[int]:
    """Places of the first texts of the groups over all pairs that share four fifths of their shingles and that are proposed, or over all."""
    sets, fps = _wide(texts)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and (whole or _proposed(sets, fps, i, j)):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return sorted(set(label))


def test_texts_that_share_a_long_passage_stay(spark):
    rng = random.Random(4)
    passage = words(rng, 150)
    texts = [f"{passage} {words(rng, 32)}" for _ in range(120)]  # a similarity of about 0.7
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == list(range(120))


def near_texts() -> list[str]:
    rng = random.Random(6)
    passage = words(rng, 150)
    texts = []
    for _ in range(40):
        own = f"{passage} {words(rng, rng.randint(20, 40))}"
        texts.append(own)
        for _ in range(rng.randint(0, 2)):
            w = own.split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    texts += [" ".join(w[: rng.randint(6, 30)]) for w in [own.split(" ")] * 30] + ["one", "one two", "ONE", "One two three"]
    rng.shuffle(texts)
    return texts


def test_groups_are_those_of_confirmed_links(spark, monkeypatch):
    texts = near_texts()
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    expected = _least_of_groups(texts)
    assert 40 <= len(expected) < len(texts)
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == expected
    # the same with every bucket dealt out in slices
    monkeypatch.setattr(neardup, "ROWS", 6)
    monkeypatch.setattr(neardup, "NEAREST_ROUNDS", 0)
    monkeypatch.setattr(simhash, "SLICE", 8)
    monkeypatch.setattr(simhash, "HELD", 10)
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == expected


def edited(rng: random.Random, base: list[str], similarity: float) -> list[str]:
    """``base`` with a run of other words at its end, so that the distinct shingles have about that similarity, or a bit more."""
    n = len(base) - 4
    k = int(n * (1 - similarity) / (1 + similarity))
    return base[: len(base) - k] + [f"x{rng.randrange(10**9)}" for _ in range(k)]


def test_recall_against_brute_force():
    """Proposed share of pairs at a similarity of 0.8 or little more, by length."""
    rng = random.Random(7)
    for size, least in ((12, 1.0), (30, 1.0), (45, 1.0), (70, 0.9), (120, 0.9), (400, 0.9)):
        texts = []
        for _ in range(500):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            texts += [" ".join(base), " ".join(edited(rng, base, 0.8))]
        sets, fps = _wide(texts)
        near = [(i, i + 1) for i in range(0, 1000, 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])]
        assert len(near) > 400
        assert np.mean([_proposed(sets, fps, *p) for p in near]) >= least, size
    assert 0.91 < neardup.recall(0.8) < 0.93 and neardup.recall(0.85) > 0.97


def shingles(text: str) -> set:
    w = text.split()
    return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def test_likeness_follows_jaccard(spark):
    rng = random.Random(2)
    data = [(i, words(rng, rng.randint(30, 400)), "en", "s", 1) for i in range(60)]
    got = {r["doc_id"]: r for r in minhash.neighbours(frame(spark, data)).collect()}
    assert len(got) == 60
    order = sorted(data, key=lambda r: -r[0])
    errors = []
    for k, (i, text, *_) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        errors.append(r["near_edited"] - len(a & b) / len(a | b))
        assert r["near_next"] < 0.15
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and abs(np.mean(errors)) < 0.02


def test_order_of_neighbours_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RANGE_ROWS", 7)
    rng = random.Random(4)
    data = [(rng.randrange(10**6), words(rng, 8), None, None, None) for _ in range(100)]
    got = {r["doc_id"]: r["edited_sha256"] for r in minhash.neighbours(frame(spark, data)).collect()}
    order = sorted(data, key=lambda r: -r[0])
    for k, (i, text, *_) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(text) // 2
        assert got[i] == hashlib.sha256((text[: len(text) - half] + nxt[:half]).encode()).hexdigest()


def test_fingerprints_of_hard_rows(spark):
    got = minhash.neighbours(frame(spark)).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["fingerprint"] == by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == ""
    assert by[6][0]["fingerprint"] == by[7][0]["fingerprint"] == by[6][1]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert minhash.neighbours(spark.createDataFrame([], DOCS)).count() == 0
    one = minhash.neighbours(frame(spark, [(5, "a b c d e f", None, None, None)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()
    assert {(r["doc_id"], r["fingerprint"]) for r in minhash.fingerprint(frame(spark)).collect()} == {(r["doc_id"], r["fingerprint"]) for r in got}


def short_texts(n: int, seed: int) -> list[str]:
    """Texts of 20 words of their own and a footer that all share, some of them with a near copy."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        own = [f"w{k}x{i}" for i in range(20)]
        out.append(" ".join([*own, "read", "more", "on", "our", "site", "today"]))
        if k % 10 == 0:
            own[0] = f"other{rng.random()}"
            out.append(" ".join([*own, "read", "more", "on", "our", "site", "today"]))
    return out


def test_a_phrase_of_all_short_texts_is_no_key(spark):
    sizes = []
    for n in (300, 600):
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(short_texts(n, 1))], "doc_id long, text string")
        few = neardup.wide_fingerprints(docs).select("node", "few")
        keys = neardup.short_keys(few).groupBy("bucket").count()
        assert keys.agg({"count": "max"}).first()[0] <= 2
        sizes.append(keys.count())
        links = neardup.short_links(few).collect()
        assert len(links) == n // 10
    assert sizes[1] <= 2.2 * sizes[0]


def test_short_links_connect_what_brute_force_does(spark):
    rng = random.Random(7)
    phrases = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 14))] for _ in range(12)]
    texts = {" ".join(sum(rng.sample(phrases, rng.randint(1, 3)), [])) for _ in range(260)}
    texts |= {t + " z" for t in list(texts)[:80]}
    docs = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string")
    flat, off = neardup.distinct_shingles(sorted(texts))
    sets = [frozenset(flat[a:b].tolist()) for a, b in zip(off[:-1], off[1:])]
    few = neardup.wide_fingerprints(docs).select("node", "few").dropDuplicates(["node"])
    own = {r["node"]: frozenset(np.frombuffer(r["few"], "<u8").tolist()) for r in few.where("few is not null").collect()}

    def joined(pairs, nodes):
        root = {s: s for s in nodes}

        def top(s):
            while root[s] is not s:
                s = root[s]
            return s

        for a, b in pairs:
            root[top(a)] = top(b)
        groups = {}
        for s in nodes:
            groups.setdefault(top(s), set()).add(s)
        return {frozenset(g) for g in groups.values()}

    short = [s for s in set(sets) if 0 < len(s) <= neardup.FEW]
    near = [(a, b) for i, a in enumerate(short) for b in short[:i] if 5 * len(a & b) >= 4 * len(a | b)]
    got = [(own[r["a"]], own[r["b"]]) for r in neardup.short_links(few).collect()]
    assert all(5 * len(a & b) >= 4 * len(a | b) for a, b in got) and len(near) > 50
    assert joined(got, short) == joined(near, short)
