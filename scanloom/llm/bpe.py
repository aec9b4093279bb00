"""BPE encoding and decoding (operator 8): batched numpy merge rounds.

The words of many texts are made unique, their byte symbols lie in one flat
array, and each round finds the lowest-ranked pair of every word at once by a
binary search over the sorted pair keys. The vocabulary is a ``tokenizers`` JSON
file with byte-level symbols and a word-end suffix; its path is a parameter and
it is read on the workers.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to the empty string; very long texts are encoded whole; of pairs with the
lowest rank in a word the first one merges first; rows are never merged or dropped,
so repeated rows and null ids give a row each; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, ragged_take, small_batches, text_chunks

#: Splits that str.split() makes and the vocabulary's white space doesn't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Words of Latin letters whose lower case and normal form are plain, with one mark or none.
MARKS = (".", ",")
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
SPACE = regex.compile(r"\p{White_Space}+")
BIG = np.int32(2**31 - 1)


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=1)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Codec:
    """A vocabulary file as arrays, with batched encoding of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.byte_of = {c: b for b, c in enumerate(byte_chars())}
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.decimal = [str(i) for i in range(self.size)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        # A pair's parts are made by earlier merges. Merging all of a word's
        # occurrences of its lowest pair in one round then equals one by one.
        born = np.full(self.size, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("the merges are not in the order in which their parts are made")
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], order.astype(np.int32), made[order]

    def pretokens(self, word: str) -> list[str]:
        """A white-space-free piece of text to the vocabulary's words (special tokens stay whole)."""
        if word.isascii() and "<|" not in word:
            return self.pattern.findall(word.lower())
        out: list[str] = []
        for part in self.split_special.split(word) if self.split_special else [word]:
            if part in self.special:
                out.append(part)
            elif not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part):
                out += self.by_library(part)
            elif part:
                part = unicodedata.normalize("NFC", part)
                out += self.pattern.findall(part.lower() if part.isascii() else "".join([c.lower() for c in part]))
        return out

    def by_library(self, part: str) -> list[str]:
        """Words of a piece with code points that Python's character tables don't have, as the library's tables see them."""
        library = _library(self.path)
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))
        return [bytes(self.byte_of[c] for c in word).decode() for word, _ in found]

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (BIG: none) and its place among the sorted keys."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], BIG), at.astype(np.int32)

    def encode_words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none empty) in one array, and each word's offsets in it."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        lasts = ends[1:] - ends[0] - 1
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends))
        sym = self.inner[raw]
        sym[lasts] = self.last[raw[lasts]]
        done_sym, done_word = [], []
        rank, at = np.full(len(sym), BIG), np.zeros(len(sym), np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], at[inside] = self._find(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(low, sizes)
            if (over := best == BIG).any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, at, best = sym[keep], word[keep], rank[keep], at[keep], best[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # Of overlapping occurrences (aaa) every second one is taken, from the left.
            run = np.r_[True, np.diff(hit) != 1]
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))
            sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
            rank[moved] = BIG
            near = np.zeros(len(sym) + 1, bool)
            near[moved] = near[moved - 1] = True  # at 0 the spare last place
            new = np.flatnonzero(near[: max(len(sym) - 1, 0)])
            new = new[word[new] == word[new + 1]]
            rank[new], at[new] = self._find(sym[new], sym[new + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], offsets(np.bincount(word, minlength=len(words)))

    def encode_texts(self, texts: list[str]) -> Encoded:
        """Encode texts over the unique words of them all."""
        if any(c in t for t in texts for c in ODD_SPACE):
            lists = pa.array([SPACE.split(t) for t in texts], pa.large_list(pa.large_string()))
        else:
            lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string())).cast(pa.large_list(pa.large_string()))
        doc_off = offsets(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten().dictionary_encode()
        codes, unique = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
        # Most words are Latin letters with at most one mark at the end: those are
        # split in bulk, the others one by one.
        simple = pc.match_substring_regex(unique, SIMPLE)
        own = unique.filter(simple)
        marks = [pc.ends_with(own, m).to_numpy(zero_copy_only=False) for m in MARKS]
        bodies = pc.utf8_lower(pc.utf8_rtrim(own, "".join(MARKS)))
        rest = [self.pretokens(w) for w in unique.filter(pc.invert(simple)).to_pylist()]
        pool = [*MARKS, *(p for ps in rest for p in ps)]
        subs = pa.concat_arrays([pa.array(pool, pa.large_string()), bodies]).dictionary_encode()
        sub_codes, sub_words = subs.indices.to_numpy(zero_copy_only=False).astype(np.int64), subs.dictionary
        ids, off = self.encode_words(sub_words)
        for token, i in self.special.items():
            if (k := pc.index(sub_words, token).as_py()) >= 0:
                ids[off[k]], off = i, np.r_[off, off[k], off[k] + 1]
                sub_codes[sub_codes == k] = len(off) - 2
        # The words' codes in the order of ``unique``: a body and its mark, or what the splitter gave.
        is_simple = simple.to_numpy(zero_copy_only=False)
        n = np.empty(len(unique), np.int64)
        n[is_simple] = 1 + sum(marks, np.zeros(len(own), np.int64))
        n[~is_simple] = [len(ps) for ps in rest]
        at = offsets(n)
        chain = np.empty(at[-1], np.int64)
        starts = at[:-1][is_simple]
        chain[starts] = sub_codes[len(pool) :]
        for i, has in enumerate(marks):
            chain[starts[has] + 1] = sub_codes[i]
        chain[np.repeat(~is_simple, n)] = sub_codes[len(MARKS) : len(pool)]
        ids, sub_off = ragged_take(ids, off, chain)
        return Encoded(self, codes, doc_off, ids, sub_off[at])


class Encoded:
    """The words of some texts as codes, and the ids of each unique word."""

    def __init__(self, codec: Codec, codes, doc_off, word_ids, word_off):
        self.codec, self.codes, self.doc_off, self.word_ids, self.word_off = codec, codes, doc_off, word_ids, word_off

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and each text's offsets."""
        flat, off = ragged_take(self.word_ids, self.word_off, self.codes)
        return flat, off[self.doc_off]

    def counts(self) -> np.ndarray:
        """The number of ids of each text."""
        return np.diff(offsets(np.diff(self.word_off)[self.codes])[self.doc_off])

    def joined(self, names: list[str]) -> list[str]:
        """Each text's ids written by ``names`` and joined by one space."""
        ids, off = self.word_ids.tolist(), self.word_off.tolist()
        words = [" ".join([names[i] for i in ids[a:b]]) for a, b in zip(off[:-1], off[1:], strict=True)]
        codes, doc = self.codes.tolist(), self.doc_off.tolist()
        empty = {i for i, w in enumerate(words) if not w}
        out = []
        for a, b in zip(doc[:-1], doc[1:], strict=True):
            own = codes[a:b]
            if empty:
                own = [c for c in own if c not in empty]
            out.append(" ".join([words[c] for c in own]))
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    return Codec(path or default_vocab())


def _digests(path: str | None):
    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, text = [], [], []
            for a, b in text_chunks(texts):
                e = c.encode_texts(texts[a:b])
                n += e.counts().tolist()
                ids += [hashlib.sha256(s.encode()).hexdigest() for s in e.joined(c.decimal)]
                text += [hashlib.sha256(s.encode()).hexdigest() for s in e.joined(c.tokens)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text; ids is an array of int."""
    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(texts):
                ids, off = c.encode_texts(texts[a:b]).ids()
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): tokens joined by one space, as the vocabulary has no decoder; special ones stay."""
    small_batches(encoded.sparkSession)

    def run(batches):
        tokens = codec(path).tokens
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so no ids cross to the JVM."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
