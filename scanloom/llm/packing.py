"""Best-fit packing (operator 1) by patterns fitted with non-negative least squares.

Spark counts the pieces by length; that histogram has at most ``capacity`` rows,
whatever the input, and only it reaches the driver. There, patterns of at most
three pieces are enumerated over length bins, their repeat counts are fitted to
the binned histogram by non-negative least squares and rounded down, and each
pattern is realised on exact lengths, its last piece being the best fit. What
remains is packed best fit, longest first. The outcome says for each length
which ranks go to which sequences; Spark numbers the pieces of each length
(salted, as one length may hold most rows) and looks their places up.

Defined results: a null or empty text is a document of the end id alone; rows
are never merged, so repeated rows and null ids are pieces like any other; very long
texts are encoded some millions of characters at a time and cut into many pieces; of
patterns that fit alike the first enumerated is taken; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import cut, offsets, small_batches, text_chunks

CAPACITY, END_ID = 4096, 1
#: Groups among which the pieces of one length are numbered apart.
SALTS = 1024
#: Length bins that patterns are enumerated over, and pieces in a pattern.
BINS, PARTS = 64, 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [f.split(" ")[0] for f in PIECES.split(", ")]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocab: str | None = None) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut only where longer than ``capacity``.

    ``salt`` deals the pieces to groups by their place in a task, so that equal rows don't meet;
    it is only of use once written.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        c, done = codec(vocab), 7919 * TaskContext.get().partitionId()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(texts, 8 << 20):
                ids, off = c.encode_texts(texts[a:b]).ids()
                ends = off[1:] + np.arange(1, b - a + 1)
                off = offsets(np.diff(off) + 1)
                full = np.empty(off[-1], "<u4")
                own = np.ones(off[-1], bool)
                own[ends - 1] = False
                full[own] = ids
                full[ends - 1] = end_id
                n = np.diff(off)
                k = -(-n // capacity)
                doc = np.repeat(np.arange(b - a), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                data = memoryview(full.view(np.uint8))
                lo = 4 * (off[doc] + start)
                crc = [zlib.crc32(data[i:j]) for i, j in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array((done + np.arange(len(doc))) % SALTS),
                    ],
                    [*NAMES, "salt"],
                )
                done += len(doc)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, f"{PIECES}, salt long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        grad = a.T @ (b - a @ x)
        grad[passive] = -np.inf
        if passive.all() or grad.max() <= tol:
            break
        passive[int(grad.argmax())] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= 0)
            if not low.any():
                x = s
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x += step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
    return x


def patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """Bins (from 1, falling) of at most ``parts`` pieces that on average fill a sequence."""
    found = [(bins,)]
    for k in range(2, parts + 1):
        total = bins + k // 2
        for head in itertools.combinations_with_replacement(range(bins, 0, -1), k - 1):
            last = total - sum(head)
            if 1 <= last <= head[-1]:
                found.append((*head, last))
    return found


class _Stock:
    """Counts by length, with the largest length at most a value that is left."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.left = sorted(self.count)

    def at_most(self, size: int) -> int:
        i = bisect.bisect_right(self.left, size)
        return self.left[i - 1] if i else 0

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.left.pop(bisect.bisect_left(self.left, length))


Strategy = tuple[tuple[tuple[int, int], ...], int]


def plan(counts: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, parts: int = PARTS) -> list[Strategy]:
    """Packs as (((length, times), ...), repeats). Steps depend on the number of lengths, not of pieces."""
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    stock, out = _Stock(counts), []
    bins = min(bins, capacity)
    width = capacity / bins
    hist = np.zeros(bins)
    for length, n in stock.count.items():
        hist[int(np.ceil(length / width)) - 1] += n
    chosen = patterns(bins, parts)
    a = np.zeros((bins, len(chosen)))
    for j, p in enumerate(chosen):
        for b in p:
            a[b - 1, j] += 1
    # (items of the pack so far, space) -> packs; spaces in order
    opened: dict[int, list[list]] = {}
    spaces: list[int] = []

    def put(items: tuple[int, ...], n: int) -> None:
        space = capacity - sum(items)
        if not space:
            out.append((items, n))
            return
        if space not in opened:
            opened[space] = []
            bisect.insort(spaces, space)
        opened[space].append([items, n])

    for p, fitted in zip(chosen, nnls(a, hist), strict=True):
        repeats = int(fitted)
        while repeats > 0:
            items: list[int] = []
            for b in p[:-1]:
                size = stock.at_most(min(int(b * width), capacity - sum(items) - 1))
                items.append(size if size > (b - 2) * width else 0)
            last = stock.at_most(capacity - sum(items))
            if not all(items) or last <= (p[-1] - 2) * width or not last:
                break
            items.append(last)
            n = min(repeats, *(stock.count[x] // items.count(x) for x in items))
            if not n:  # the same length twice, and one is left
                break
            for x in items:
                stock.take(x, n)
            repeats -= n
            put(tuple(items), n)
    while stock.left:
        length = stock.left[-1]
        n = stock.count[length]
        i = bisect.bisect_left(spaces, length)
        if i == len(spaces):
            k = capacity // length
            full, rest = divmod(n, k)
            for times, packs in ((k, full), (rest, 1)):
                if times and packs:
                    put((length,) * times, packs)
            stock.take(length, n)
            continue
        space = spaces[i]
        items, packs = opened[space][-1]
        m = min(n, packs)
        if m == packs:
            opened[space].pop()
            if not opened[space]:
                del opened[space]
                spaces.pop(i)
        else:
            opened[space][-1][1] -= m
        stock.take(length, m)
        put((*items, length), m)
    out += [(items, n) for groups in opened.values() for items, n in groups]
    return [(tuple(sorted(((x, items.count(x)) for x in set(items)), reverse=True)), n) for items, n in out]


def slots(strategies: list[Strategy]) -> dict[str, np.ndarray]:
    """Runs of places by length: from rank ``lo`` on, sequence ``seq`` + (rank - lo) at ``offset``."""
    rows, base, used = [], 0, {}
    for items, n in strategies:
        at = 0
        for length, times in items:
            for _ in range(times):
                lo = used.get(length, 0)
                rows.append((length, lo, base, at))
                used[length] = lo + n
                at += length
        base += n
    t = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": t[:, 0], "lo": t[:, 1], "seq": t[:, 2], "offset": t[:, 3]}


def pack(piece_rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of ``pieces``, which should be a written table, as it is read three times."""
    spark = piece_rows.sparkSession
    counts = {r["length"]: r["n"] for r in piece_rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        piece_rows.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (
        piece_rows.withColumn("nth", F.row_number().over(own) - 1)
        .join(base, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    )

    def place(batches):
        t = places.value
        first = np.searchsorted(t["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for i, j in zip(edges, np.r_[edges[1:], len(order)], strict=True):
                of = order[i:j]
                lo, hi = first[length[of[0]]], first[length[of[0]] + 1]
                row[of] = lo + np.searchsorted(t["lo"][lo:hi], rank[of], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(t["seq"][row] + rank - t["lo"][row]), pa.array(t["offset"][row])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocab: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(cut(pieces(docs, capacity, end_id, vocab)), capacity)
