"""Language identification (operator 6): averaged hashed subword embeddings.

Byte n-grams of a text, lower-cased and with spaces around, are hashed to
embeddings, averaged, and classified by a linear softmax; both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows, of which
a bounded number of pieces is drawn from anywhere in their texts. Pieces of rows that
aren't trained on set the softmax temperature; the score below which a prediction
counts as rejected is one that all but a stated share of those rows' whole texts
reach, which are scored where they are.

Training rows are those with a label whose crc32 of the id's digits is not 2
modulo 4; only text is an input of a prediction. Defined results: a null text or
one without a letter is ``und`` with score 0 and rejected, as is every text if
there is no labelled row; very long texts count whole; of languages that score the
same the first in order is predicted; repeated rows and null ids keep a row each (a
null id is held out from training, and ``held_out`` is false for it); an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, offsets, small_batches, text_chunks

UND = "und"
LETTER = regex.compile(r"\p{L}")
GRAMS = (2, 3, 4)
BUCKET_BITS, DIM = 16, 16
#: Rows of one language that the sample has (about, and twice as many at most; a hash of
#: the row decides), characters of a piece, and pieces of one language at most.
SAMPLE, EXAMPLE, EXAMPLES = 500, 160, 4000
#: One of so many rows of the sample isn't trained on, of languages with at least FEWEST rows.
APART, FEWEST = 5, 50
EPOCHS, BATCH, RATE = 3, 128, 0.5
#: Share of right predictions for held-out whole texts that may be rejected; of a few hundred texts it is the lowest score.
LOST = 0.0005
PAD = b" " * max(GRAMS)


def ngram_buckets(data: np.ndarray, n: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte but the last n - 1."""
    h = data[: len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        h = h * np.uint32(0x01000193) ^ data[k : len(data) - n + 1 + k]
    return ((h * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with spaces between, and where each one starts: three spaces before its first byte, so no n-gram spans two texts."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    starts = offsets([len(r) + len(PAD) for r in raw])
    return np.frombuffer(PAD[1:] + PAD.join(raw) + PAD + PAD, np.uint8), starts


@dataclass
class Model:
    """``table``: each bucket's embedding times the softmax weights, so a text's logits are an average of rows."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        data, starts = flat(texts)
        out = np.zeros((len(texts), len(self.langs)))
        for n in GRAMS:
            rows = self.table[ngram_buckets(data, n)[: starts[-1]]]
            out += np.add.reduceat(rows, starts[:-1], axis=0, dtype=np.float64)
        return out / (len(GRAMS) * np.diff(starts))[:, None] + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts) / self.heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], apart: tuple[list[str], list[str]] = ((), ()), seed: int = 7) -> Model:
    """Fit embeddings and softmax on the texts, the temperature on those ``apart``."""
    langs = sorted(set(labels))
    of = np.array([langs.index(x) for x in labels], np.int64)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    share = np.bincount(of, minlength=len(langs)) / max(len(of), 1)
    weight = np.minimum(1 / np.maximum(share * len(langs), 1e-6), 20).astype(np.float32)  # each language counts the same
    data, starts = flat(list(texts))
    grams = [ngram_buckets(data, n) for n in GRAMS]
    steps, done = EPOCHS * -(-len(of) // BATCH), 0
    for _ in range(EPOCHS):
        turn = rng.permutation(len(of))
        for i in range(0, len(turn), BATCH):
            pick = turn[i : i + BATCH]
            n = starts[pick + 1] - starts[pick]
            doc = np.repeat(np.arange(len(pick)), n)
            at = np.arange(n.sum()) + np.repeat(starts[pick] - np.cumsum(n) + n, n)
            bucket = np.concatenate([g[at] for g in grams])
            # what a text holds several times is looked up once
            pair, times = np.unique((bucket.astype(np.int64) << 16) | np.tile(doc, len(GRAMS)), return_counts=True)
            bucket, doc = pair >> 16, pair & 0xFFFF
            times = times[:, None].astype(np.float32)
            size = (len(GRAMS) * n).astype(np.float32)[:, None]
            order = np.argsort(doc, kind="stable")
            begins = np.searchsorted(doc[order], np.arange(len(pick)))
            x = np.add.reduceat(emb[bucket[order]] * times[order], begins, axis=0) / size
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), of[pick]] -= 1
            p *= weight[of[pick]][:, None]
            rate = RATE * (1 - done / steps)
            back = (p @ w.T) / size * (-rate * 40)
            w -= rate * (x.T @ p) / len(pick) * 4
            b -= rate * p.mean(axis=0)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            emb[bucket[first]] += np.add.reduceat(back[doc] * times, first, axis=0)
            done += 1
    model = Model(langs, np.ascontiguousarray(emb @ w), b)
    own = [(t, langs.index(x)) for t, x in zip(*apart, strict=True) if x in langs]
    if own:
        z, y = model.logits([t for t, _ in own]), np.array([k for _, k in own])

        def loss(heat: float) -> float:
            s = z / heat
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        model.heat = float(min(np.geomspace(0.05, 20, 60), key=loss))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame | None:
    """(doc_id, text, lang, apart) of the rows to learn from; None if there are none. Labels are few: there is a count for each."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    own = docs.where(lang.isNotNull() & text.rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 20))
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), lang.alias("lang"), draw.alias("draw"))
    counts = own.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return None
    n = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], r["n"]))), F.col("lang"))
    # the row with the least draw is always in, also of a language of a few rows that repeat
    rate = {r["lang"]: max((sample << 20) // r["n"], r["least"]) + 1 for r in counts}
    rate = F.element_at(F.create_map(*(F.lit(x) for k, v in rate.items() for x in (k, v))), F.col("lang"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    drawn = own.where(F.col("draw") < rate).withColumn("nth", F.row_number().over(order))
    apart = (n >= FEWEST) & (F.pmod(F.xxhash64("doc_id", "text", F.lit("apart")), F.lit(APART)) == 0)
    return drawn.where(F.col("nth") <= 2 * sample).select("doc_id", "text", "lang", apart.alias("apart"))


def pieces(rows: DataFrame, most: int) -> DataFrame:
    """(lang, apart, piece): at most ``most`` pieces of each language's texts, drawn by a hash from anywhere in them."""
    cut = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{EXAMPLE}}}"), F.lit(0))
    own = rows.select("doc_id", "lang", "apart", F.posexplode(cut).alias("place", "piece")).where(F.col("piece").rlike(r"\p{L}"))
    order = Window.partitionBy("lang", "apart").orderBy(F.xxhash64("doc_id", "place", "piece"), "doc_id", "place", "piece")
    return own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("lang", "apart", "piece")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on about ``sample`` rows of each language."""
    rows = sampled(docs, sample)
    if rows is None:
        return None
    rows = cut(rows)
    found = sorted((r["apart"], r["lang"], r["piece"]) for r in pieces(rows, EXAMPLES).collect())
    learnt, apart = ([r[1:] for r in found if r[0] is x] for x in (False, True))
    if not learnt:
        return None
    model = train([t for _, t in learnt], [y for y, _ in learnt], ([t for _, t in apart], [y for y, _ in apart]))
    whole = rows.where("apart").select("doc_id", "text", "lang")
    right = predict(whole, model, label="lang").where("lang_pred = label").select("score").collect()
    if right:
        model.least = float(np.quantile([r["score"] for r in right], LOST))
    return model


def predict(docs: DataFrame, model: Model | None, keep: bool = False, label: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, and the column ``label`` if one is asked for.

    With ``keep`` the rows of ``docs`` that aren't rejected.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def decide(texts: list[str | None]):
        m = shared.value
        pred, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if m is None:
            return pred, score, rejected
        for a, b in text_chunks(texts, max(1 << 16, (8 << 20) // max(len(m.langs), 4))):
            own = [i for i in range(a, b) if texts[i] is not None and LETTER.search(texts[i])]
            if not own:
                continue
            p = m.scores([texts[i] for i in own])
            best = p.argmax(axis=1)
            for i, k in zip(own, best, strict=True):
                pred[i] = m.langs[k]
            score[own] = p[np.arange(len(own)), best]
            rejected[own] = score[own] < m.least
        return pred, score, rejected

    if keep:
        at = [c.lower() for c in docs.columns].index("text")

        def kept(batches):
            for batch in batches:
                _, _, rejected = decide(batch.column(at).to_pylist())
                yield batch.filter(pa.array(~rejected))

        return docs.mapInArrow(kept, docs.schema)

    def run(batches):
        for batch in batches:
            pred, score, rejected = decide(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected), *batch.columns[3:]],
                ["doc_id", "held_out", "lang_pred", "score", "rejected", *(["label"] if label else [])],
            )

    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    if label:
        own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"), F.col(label).cast("string").alias("label"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean" + (", label string" if label else ""))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predict(docs, fit(docs, sample))


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose language is rejected; columns stay."""
    return predict(docs, fit(docs, sample), keep=True)
