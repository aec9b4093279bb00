"""Token counts (operator 12): batch encoding that gives lengths only.

Texts are split at safe boundaries, where the vocabulary's tokens never reach
across: before white space that follows something else. So a very long text is
many small pieces, and a piece that occurs often is encoded once. Pieces go to the
library in batches of about equal bytes; of what it returns only the lengths are
kept, in an Arrow function that returns a row per document.

The boundary holds for byte-level vocabularies without a normalizer (``.json``,
read by tokenizers) and for ``.model`` files (read by sentencepiece) whose pieces
have no space mark behind another character; of other vocabularies whole texts are
encoded. That is read from the file, not assumed.

Defined results: a null text counts as empty; an empty text has no bytes and no
tokens; very long texts are counted whole, and a text without any white space is
one piece; special strings in a text are special tokens, the library's default;
rows are never merged or dropped, so repeated rows and null ids give a row each; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, small_batches, text_chunks

#: Before white space, after what no Unicode version calls white space.
SAFE = re.compile("(?<=[^\\s\u180e])(?=[ \t\n\r])")
#: The same for space marks: before a single space.
SAFE_MARK = re.compile("(?<=[^\\s\u180e▁]) (?=[^\\s\u180e▁])")
#: UTF-8 bytes that go to the library at a time, pieces that a worker remembers, and the longest of these.
BATCH, REMEMBERED, SHORT = 1 << 20, 400_000, 48
#: Tokens of a sequence in the packed corpus.
LIMIT = 512


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def balanced(sizes: np.ndarray, limit: int) -> list[slice]:
    """Runs of consecutive pieces of about ``limit`` bytes; a larger piece is alone."""
    ends = np.cumsum(sizes)
    out, start = [], 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        out.append(slice(start, stop))
        start = stop
    return out


class Counter:
    """Token counts of texts by a vocabulary file, with the counts of frequent pieces remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work; a task has one core
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            inner = any("▁" in p.lstrip("▁") for p in map(model.id_to_piece, range(model.get_piece_size())))
            # A piece is counted with the dummy prefix in place of the space that it follows.
            plain = len(model.encode("a")) == len(model.encode(" a")) or model.encode("a  b") == model.encode("a b")
            self.boundary = None if inner or plain else SAFE_MARK
            self.lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
            level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            whole = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or SAFE.search(t["content"]) for t in added)
            self.boundary = SAFE if level and not whole and spec.get("normalizer") is None else None
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.lengths = lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        """Counts of distinct pieces; only those that aren't remembered go to the library."""
        counts = np.array([self.known.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(counts < 0)
        fresh = [pieces[i] for i in new]
        sizes = np.array([len(p.encode()) for p in fresh], np.int64)
        for run in balanced(sizes, BATCH):
            counts[new[run]] = self.lengths(fresh[run])
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
        short = [i for i in new.tolist() if len(pieces[i]) <= SHORT]
        self.known.update((pieces[i], int(counts[i])) for i in itertools.islice(short, REMEMBERED))
        return counts

    def of_texts(self, texts: list[str]) -> np.ndarray:
        parts = [self.boundary.split(t) if self.boundary else [t] for t in texts]
        unique = pa.array(itertools.chain.from_iterable(parts), pa.large_string()).dictionary_encode()
        counts = self.of_pieces(unique.dictionary.to_pylist())
        total = offsets(counts[unique.indices.to_numpy(zero_copy_only=False)])
        return np.diff(total[offsets([len(p) for p in parts])])


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): the tokens of every whole text by the vocabulary at ``path``."""
    small_batches(docs.sparkSession)

    def run(batches):
        count = counter(path or default_vocab())
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            texts, tokens = texts.to_pylist(), []
            for a, b in text_chunks(texts):
                tokens.append(count.of_texts(texts[a:b]))
            n = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
