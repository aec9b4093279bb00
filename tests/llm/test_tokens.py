import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scanloom.llm import bpe, packing

from .helpers import DOCS, frame, rows


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


TOKENIZER = None


@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abc'sTd <|>\n.,0é́İΣ\x1c\x85　")), max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text_as_the_library_does(texts):
    global TOKENIZER
    TOKENIZER = TOKENIZER or Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bpe.codec().encode_texts(texts)
    ids, off = got.ids()
    for i, e in enumerate(TOKENIZER.encode_batch(texts, add_special_tokens=False)):
        assert ids[off[i] : off[i + 1]].tolist() == e.ids


def test_special_tokens_and_repeats(library):
    texts = ["a<|endoftext|>b", "<|startoftext|>", "<|endoftext|><|endoftext|>", "aaaaaaa", "abababab" * 50]
    got = bpe.codec().encode_texts(texts)
    ids, off = got.ids()
    for i, t in enumerate(texts):
        e = library.encode(t, add_special_tokens=False)
        assert ids[off[i] : off[i + 1]].tolist() == e.ids
        assert got.joined(bpe.codec().tokens)[i] == library.decode(e.ids, skip_special_tokens=False)


def test_digests_and_round_trip(spark, library):
    docs = frame(spark)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs).collect()}
    want = set()
    for r in rows():
        e = library.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((r[0], len(e), sha(" ".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))))
    assert got == want
    encoded = bpe.encode(docs)
    assert {(r["doc_id"], tuple(r["ids"])) for r in encoded.collect()} == {(r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()}
    assert bpe.decode(encoded).count() == len(rows())


def test_pieces_are_whole_and_gapless(spark, library):
    got = packing.pack_documents(frame(spark), capacity=256).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    want = []
    for r in rows():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want += [(r[0], i // 256, i, len(ids[i : i + 256]), zlib.crc32(np.array(ids[i : i + 256], "<u4").tobytes())) for i in range(0, len(ids), 256)]
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece(counts):
    plan = packing.plan(counts, 64, bins=16)
    got = {}
    for items, n in plan:
        assert sum(k * t for k, t in items) <= 64 and n > 0
        for k, t in items:
            got[k] = got.get(k, 0) + t * n
    assert got == counts


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(4096, rng.lognormal(6.3, 1.2, 30000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    packs = sum(n for _, n in packing.plan(counts))
    assert packs <= 1.002 * np.ceil(lengths.sum() / 4096)


def test_nnls_solves_what_it_can():
    rng = np.random.default_rng(1)
    a = rng.random((12, 30))
    x = np.maximum(0, rng.normal(size=30))
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_empty_tables_and_equal_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert bpe.digests(none).count() == 0 and packing.pack_documents(none).count() == 0
    same = spark.createDataFrame([(None, "one two three", None, None, None)] * 5000, DOCS).repartition(3)
    got = packing.pack_documents(same)
    assert got.columns == [*packing.NAMES, "sequence_id", "offset"]
    places = [(r["sequence_id"], r["offset"]) for r in got.collect()]
    assert len(set(places)) == 5000
    salts = packing.pieces(same).groupBy("salt").count().agg({"count": "max"}).first()[0]
    assert salts < 50  # equal rows don't meet in one group
